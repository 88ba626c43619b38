"""Main-text extraction by a minimum cut.

A page is cut into blocks: runs of text between block-level tags. A linear classifier over a
block's own text (words, sentence marks, link share) and its enclosing elements (article,
navigation, advert, comment ...) gives a score: positive is the capacity from the content
terminal, negative the capacity to the boilerplate terminal. Neighbouring blocks, and blocks
that follow each other under one parent, are joined by smoothness edges, weaker across
elements of different kind. The minimum cut (a maximum flow) separates content from the rest.

An element speaks against content by its tag or a word of class, id or role (not by words after
no, has, with and the like). A word that is a part of a longer name, or a form, may only describe
the layout of a page wrapper: such an element is neutral if it holds most of the page's long
paragraphs (those of article, main and content elements, if there are any), and content elements
below it count. An element that is named after its kind, as sidebar or comments, is neutral only
if no such paragraph stands outside elements of this sort.

Script and style have no text, up to their closing tag or the page's end. Media, template, iframe,
svg, select and the like have none if they are closed; without a closing tag in the element
around them, or closed in themselves (<svg/>), only the tag goes. The text of math stays. Character
references are decoded; white space inside a block becomes one space; content blocks are joined
by one space.

Defined cases: null or empty html gives an empty text; open or wrongly nested elements are
closed where the next block begins; a page without any positive block gives an empty text;
rows that repeat a page_id are pages of their own; every page is read whole.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from parcelwise.llm.common import columns_of

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|([^<]++|<)", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
#: Elements whose text is no page text: up to the closing tag or else the page's end, or only if closed.
_RAW = {"script", "style"}
_UNSEEN = {"template", "iframe", "object", "svg", "noembed", "noframes", "textarea", "title", "canvas", "audio",
           "video", "noscript", "select"}
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in _RAW}
_PLAIN_END = re.compile(r"[^<]*+</([a-zA-Z]+)\s*>")
#: Elements that an open one of these does not outlast.
_HOLDERS = {"div", "section", "article", "main", "td", "body"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font",
           "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike",
           "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img",
           "math", "mi", "mn", "mo", "ms", "mtext", "mspace", "mrow", "mfrac", "msqrt", "mroot", "mstyle", "merror",
           "mpadded", "mphantom", "mfenced", "menclose", "msub", "msup", "msubsup", "munder", "mover", "munderover",
           "mmultiscripts", "mprescripts", "none", "mtable", "mtr", "mlabeledtr", "mtd", "maction", "semantics",
           "annotation", "annotation-xml"}
_ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure",
           "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p",
           "pre", "section", "table", "ul"}
#: Elements and words in class, id or role that speak against content, and for it.
_OUT_TAGS = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "head", "fieldset"}
_OUT_WORDS = {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "side", "aside", "rail",
              "widget", "widgets", "footer", "foot", "masthead", "banner", "cookie", "cookies", "consent", "gdpr",
              "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe",
              "subscription", "signup", "promo", "promotion", "sponsor", "sponsored", "sponsors", "advert", "adverts",
              "advertisement", "advertising", "ad", "ads", "adsense", "social", "share", "sharing", "related",
              "recommended", "recommendations", "comment", "comments", "commentlist", "disqus", "respond", "reply",
              "replies", "reviews", "login", "search", "searchbox", "pagination", "pager", "copyright", "disclaimer",
              "legal", "toolbar", "topbar", "contentinfo", "complementary", "form", "skip", "tags", "outbrain", "taboola"}
#: Words that name sections with paragraphs of their own; words whose followers say nothing of the element.
_TALK_WORDS = {"comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "reviews", "related",
               "recommended", "recommendations", "legal", "disclaimer", "cookie", "cookies", "consent", "gdpr"}
_ABOUT = {"no", "not", "has", "have", "with", "without", "hide", "show"}
_HEAD_WORDS = {"header", "head", "top", "site-header"}
_IN_TAGS = {"article", "main"}
_IN_WORDS = {"article", "articlebody", "content", "post", "entry", "story", "main", "body", "text", "prose"}
_WORD_CUT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: The classifier: weights of the score.
W_OUT, W_IN, W_HEADING, W_PARAGRAPH, W_ITEM = -6.0, 3.0, 0.5, 1.0, -0.5
W_WORDS, W_LINKS, W_SENTENCE, W_BIAS = 0.6, -3.0, 0.5, -1.5
#: Capacities of smoothness edges: neighbours, same parent, and the factor across kinds.
E_NEXT, E_SIBLING, E_ACROSS = 0.8, 0.8, 0.1
#: Words of a long paragraph.
LONG = 8


#: How sure an element is no content: a form or a part of a name, such a part that names a section
#: with paragraphs, an element of that name, a landmark or a section of that name.
_LOOSE, _PART, _NAMED, _SECTION = 1, 2, 3, 4


class _Mark:
    """What an element's tag and attributes say, and the long paragraphs (in words) inside it."""
    __slots__ = ("up", "good", "tagged", "bad", "held", "out", "inside")

    def __init__(self, up: _Mark | None, good: bool, tagged: bool, bad: int):
        self.up, self.good, self.tagged, self.bad = up, good, tagged, bad
        self.held, self.out, self.inside = 0, 0, 0

    def chain(self) -> Iterator[_Mark]:
        mark: _Mark | None = self
        while mark:
            yield mark
            mark = mark.up

    def against(self) -> bool:
        return self.bad > _LOOSE or self.bad == _LOOSE and not self.good


class _Element:
    __slots__ = ("tag", "mark", "hidden")

    def __init__(self, tag: str, attributes: str, parent: _Element | None, marks: list[_Mark]):
        self.tag = tag
        self.mark = parent.mark if parent else None
        self.hidden = parent.hidden if parent else False
        names: list[str] = []
        if attributes and tag not in ("html", "body"):
            for name, value in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), value.strip("\"'")
                if name in ("class", "id", "role"):
                    names.extend(value.split())
                elif name == "hidden" or name == "aria-hidden" and value == "true" or \
                        name == "style" and re.search(r"display\s*:\s*none", value):
                    self.hidden = True
        tagged, bad, head = tag in _IN_TAGS, 0, _NAMED * (tag == "header")
        good = tagged
        for name in names:
            words = [w for w in _WORD_CUT.split(_CAMEL.sub("-", name).lower()) if w]
            for at, word in enumerate(words):
                if word in _ABOUT:
                    del words[at:]
                    break
            if not _OUT_WORDS.isdisjoint(words):
                section = not _TALK_WORDS.isdisjoint(words)
                bad = max(bad, _LOOSE + section + 2 * (len(words) == 1))
            elif not _IN_WORDS.isdisjoint(words):
                good = True
            if not _HEAD_WORDS.isdisjoint(words):
                head = max(head, _NAMED if len(words) == 1 else _LOOSE)
        if tag in _OUT_TAGS:
            bad = max(bad, _LOOSE if tag in ("form", "fieldset") else _SECTION)
        if head and not good and not (self.mark and any(m.good and not m.bad for m in self.mark.chain())):
            bad = max(bad, head)
        if good or bad:
            self.mark = _Mark(self.mark, good, tagged, bad)
            marks.append(self.mark)


def _resolve(marks: list[_Mark], paragraphs: list[tuple[_Mark | None, int]]) -> None:
    """Sets ``out`` and ``inside`` of the marks (parents first) from the unlinked texts (in words)."""
    content = [(m, n) for m, n in paragraphs if m and m.good and m.bad <= _LOOSE]
    others = [(m, n) for m, n in paragraphs if not m or m.bad <= _PART]
    kinds = [content] if content else [others, paragraphs]
    base = next((x for kind in kinds if (x := [(m, n) for m, n in kind if n >= LONG])), content)
    open_words = sum(n for m, n in others if not m or not any(x.against() for x in m.chain()))
    total, free = sum(n for _, n in base), False
    for mark, n in base:
        against = False
        for m in mark.chain() if mark else ():
            m.held += n
            against |= m.against()
        free |= not against
    for m in marks:
        m.out, m.inside = (m.up.out, m.up.inside) if m.up else (0, 0)
        most = 2 * m.held > total
        neutral = not m.bad or m.bad == _LOOSE and (most or m.good and m.held > 0) or \
            most and not free and 4 * open_words < m.held and (bool(content) or m.bad <= _NAMED)
        if not neutral:
            m.out = max(m.out, m.bad)
        elif m.good:
            m.inside = 1
            if m.out == _LOOSE and m.held and content and (m.tagged or not free or 4 * m.held >= total):
                m.out = 0


class Block:
    __slots__ = ("text", "score", "parent", "out")

    def __init__(self, text: str, score: float, parent: int, out: int):
        self.text, self.score, self.parent, self.out = text, score, parent, out


def _score(text: str, linked: int, tags: set[str]) -> float:
    words = text.count(" ") + 1
    score = W_BIAS + W_WORDS * min(words, 12) ** 0.5 + W_LINKS * min(1.0, linked / len(text))
    score += W_SENTENCE * (text[-1] in ".!?…\"'»”)")
    if tags & {"h1", "h2", "h3", "h4", "h5", "h6"}:
        score += W_HEADING
    elif tags & {"p", "blockquote", "pre"}:
        score += W_PARAGRAPH
    elif tags & {"li", "td", "th", "dt", "dd", "option"}:
        score += W_ITEM
    return score


def _tag_of(found: re.Match) -> tuple[str, bool, str]:
    """Lower-case name ("" for text, comments and declarations), whether it closes, attributes."""
    if found[2]:
        return found[2].lower(), found[1] == "/", found[3]
    return (found[5] or "").lower(), found[4] == "/", found[6] or ""


def _unseen_ends(html: str) -> dict[int, int]:
    """Where each closed element without page text ends, by the place of its opening tag."""
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    position, size = 0, len(html)
    while position < size:
        found = _TOKEN.match(html, position)
        position = found.end()
        tag, closing, attributes = _tag_of(found)
        if tag in _RAW and not closing:
            end = _RAW_END[tag].search(html, position)
            position = end.end() if end else size
        elif tag in _UNSEEN or tag in _HOLDERS:
            if not closing:
                if tag in _HOLDERS or not attributes.rstrip().endswith("/"):
                    stack.append((tag, found.start()))
                    opened[tag] += 1
                continue
            while opened[tag]:
                name, start = stack.pop()
                opened[name] -= 1
                if name == tag:
                    if tag in _UNSEEN:
                        ends[start] = position
                    break
    return ends


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in page order, scored."""
    marks: list[_Mark] = []
    root = _Element("", "", None, marks)
    stack, numbers, made = [root], [0], 1
    out: list[Block] = []
    places: list[_Mark | None] = []
    paragraphs: list[tuple[_Mark | None, int]] = []
    pieces: list[str] = []
    linked, in_link = 0, 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text and not stack[-1].hidden:
                at = len(stack) - 1
                tags = set()
                while at and stack[at].tag in _INLINE:
                    at -= 1
                tags = {e.tag for e in stack[max(1, at - 1):]}
                parent = numbers[max(0, at - 1)] if stack[at].tag not in ("div", "section", "article", "main", "body", "") \
                    else numbers[at]
                mark, words = stack[at].mark, text.count(" ") + 1
                out.append(Block(text, _score(text, linked, tags), parent, 0))
                places.append(mark)
                if 2 * linked < len(text):
                    paragraphs.append((mark, words))
            pieces.clear()
        linked = 0

    unseen: dict[int, int] | None = None
    position, size = 0, len(html)
    while position < size:
        found = _TOKEN.match(html, position)
        position = found.end()
        text = found[7]
        if text is not None:
            pieces.append(text)
            if in_link:
                linked += len(text)
            continue
        tag, closing, attributes = _tag_of(found)
        if not tag:
            continue
        if not closing and tag in _RAW:
            end = _RAW_END[tag].search(html, position)
            position = end.end() if end else size
            flush()
            continue
        if not closing and tag in _UNSEEN:
            if tag != "svg":
                flush()
            if not attributes.rstrip().endswith("/"):
                end = _PLAIN_END.match(html, position)
                if end and end[1].lower() == tag:
                    position = end.end()
                else:
                    unseen = _unseen_ends(html) if unseen is None else unseen
                    position = unseen.get(found.start(), position)
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        if tag not in _INLINE:
            flush()
            in_link = 0 if tag != "a" else in_link
        if tag in _VOID:
            continue
        if closing:
            for at in range(len(stack) - 1, 0, -1):
                if stack[at].tag == tag:
                    del stack[at:], numbers[at:]
                    break
                if tag in _INLINE and stack[at].tag not in _INLINE:
                    break
            continue
        if tag in _ENDS_P or tag == "li":
            until = "p" if tag != "li" else "li"
            for at in range(len(stack) - 1, 0, -1):
                if stack[at].tag == until:
                    del stack[at:], numbers[at:]
                    break
                if stack[at].tag not in _INLINE and not (until == "li" and stack[at].tag == "p"):
                    break
        if not attributes.endswith("/") or tag not in _INLINE:
            stack.append(_Element(tag, attributes, stack[-1], marks))
            numbers.append(made)
            made += 1
    flush()
    _resolve(marks, paragraphs)
    for block, mark in zip(out, places, strict=True):
        if mark:
            block.out = int(mark.out > 0)
            block.score += W_OUT * block.out + W_IN * (mark.inside and not mark.out)
    return out


def smoothness(parts: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours, and between blocks that follow each other under one parent."""
    edges, last = [], {}
    for i, block in enumerate(parts):
        if i:
            same = 1.0 if parts[i - 1].out == block.out else E_ACROSS
            near = 1.0 if parts[i - 1].parent == block.parent else 0.5
            edges.append((i - 1, i, E_NEXT * same * near))
        before = last.get(block.parent)
        if before is not None:
            edges.append((before, i, E_SIBLING * (1.0 if parts[before].out == block.out else E_ACROSS)))
        last[block.parent] = i
    return edges


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the content side of the minimum cut (ties: the score's sign).

    A node whose score outweighs its edges can only be on its own side; it is settled first
    and its edges become capacities of its neighbours. The rest is decided by maximum flow
    along shortest paths.
    """
    n = len(scores)
    unary = list(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if side[i] is not None or abs(unary[i]) < sum(near[i].values()):
            continue
        side[i] = unary[i] > 0
        for j, w in near[i].items():
            unary[j] += w if side[i] else -w
            del near[j][i]
            queue.append(j)
        near[i] = {}
    open_nodes = [i for i in range(n) if side[i] is None]
    if open_nodes:
        source, sink = n, n + 1
        room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in open_nodes} | {source: {}, sink: {}}
        for i in open_nodes:
            if unary[i] > 0:
                room[source][i], room[i][source] = unary[i], 0.0
            elif unary[i] < 0:
                room[i][sink], room[sink][i] = -unary[i], 0.0
        while True:
            back = {source: source}
            line = deque([source])
            while line and sink not in back:
                a = line.popleft()
                for b, w in room[a].items():
                    if w > 1e-12 and b not in back:
                        back[b] = a
                        line.append(b)
            if sink not in back:
                break
            path, b = [], sink
            while b != source:
                path.append((back[b], b))
                b = back[b]
            flow = min(room[a][b] for a, b in path)
            for a, b in path:
                room[a][b] -= flow
                room[b][a] = room[b].get(a, 0.0) + flow
        for i in open_nodes:
            side[i] = i in back
    return [bool(s) for s in side]


def main_text(html: str | None) -> str:
    parts = blocks(html or "")
    content = minimum_cut([b.score for b in parts], smoothness(parts))
    return " ".join(b.text for b, keep in zip(parts, content, strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
    return columns_of(pages, "page_id", "url", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")

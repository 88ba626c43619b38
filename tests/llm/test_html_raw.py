"""Elements without page text: what goes with them, and what stays."""

import pytest
from parcelwise.llm import html_cut

FIRST = "A long first paragraph of the text, with a good many words in it that belong to the article."
SECOND = "Another long paragraph follows, one with more than only a few words, and it ends the article."
AFTER = "<svg><title>t</title></svg><video>Your browser shows no video.</video><select><option>One</select>"


def page(between, after=""):
    return f"<body><article><p>{FIRST}</p>{between}<p>{SECOND}</p></article>{after}<footer>x</footer></body>"


@pytest.mark.parametrize("after", ["", AFTER])
@pytest.mark.parametrize("between", [
    '<svg class="icon"/>', "<math/>", "<svg />", "<video src='x'>", "<audio controls src=x>", "<object data=x>", "<canvas>",
    '<svg class="icon">', "<iframe src='x'/>", "<iframe src=x>", "<template>", "<p><svg class='icon'></p>",
    "<div><video src=x></div>", '<p data-x="</video>"></p>'])
def test_nothing_goes_with_an_empty_or_open_element(between, after):
    assert html_cut.main_text(page(between, after)) == f"{FIRST} {SECOND}"


@pytest.mark.parametrize("between", [
    "<svg><svg><text>no</text></svg><text>no</text></svg>", "<object><p>no</p><video>no</object>",
    "<video src=x><p>No video can be shown here by your old browser, get a new one.</p></video>", "<canvas>no</canvas>",
    "<svg><!-- </svg> --><text>no</text></svg>", "<svg><style>a::after{content:'</svg>'}</style><text>no</text></svg>",
    "<script>var a = '<svg>';</script>", "<svg/><svg><text>no</text></svg>", "<template><p>no</p></template>",
    "<video src=x><div>no</div></video>", "<svg title='</svg>'><text>no</text></svg>", "<noscript><p>no</p></noscript>"])
def test_closed_elements_go(between):
    assert html_cut.main_text(page(between)) == f"{FIRST} {SECOND}"


def test_script_and_style_reach_to_the_end_and_math_stays():
    assert html_cut.main_text(page("<script>var a = 1;")) == FIRST
    math = "<math><mi>a</mi><mo>+</mo><mn>1</mn></math>"
    assert html_cut.main_text(f"<article><p>{FIRST[:-1]} where {math} is the <svg><text>no</text></svg>sum.</p></article>") == \
        f"{FIRST[:-1]} where a+1 is the sum."
    assert html_cut.main_text(f"<main><p>{FIRST}</p><math display='block'><mrow><mi>b</mi></mrow></math><p>{SECOND}</p></main>") == \
        f"{FIRST} b {SECOND}"


def test_many_open_elements_take_linear_time():
    assert html_cut.main_text(page("<video src=x>" * 20000)) == f"{FIRST} {SECOND}"

"""Merkle manifest of a dataset: nested-interval labels over leaf ranks, proofs by containment.

Every document is a leaf; the leaves of a language, by ascending id, are ranked 0, 1, 2, ... and
every node of the tree carries the half-open interval ``[lo, hi)`` of the leaf ranks it covers.
Nodes of level k start at multiples of 8^k, so ``lo div 8^k`` names a node of that level, and a
containment join of a node with the level above is an equality of buckets plus ``lo``/``hi``
bounds. What a parent's interval holds besides the node's own is its siblings. A proof is the
list of (left siblings, right siblings) up to the root, attached from the top downwards, so a
sibling's hash is moved once per parent and not once per leaf below it.

Nulls: a null field hashes as ``-``; a null language is a group of its own, before all others; a
null doc_id comes first in its language and is never tampered with. Rows of one doc_id are
ordered by their leaf hash; equal rows are leaves of their own. Empty and very long texts are
fields like any other. An empty table has no rows and no root. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import DOCUMENT_COLUMNS, columns_of, ranked
from parcelwise.sources.scratch import Scratch

FAN_OUT = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the concatenated inputs."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A field as its UTF-8 byte count, a colon and its value; null as ``-``."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(text: Column) -> Column:
    return digest(field(F.col("doc_id")), field(F.col("source")), field(F.col("lang")), field(F.col("n_chars")),
                  field(text))


def lower_cased_every_third(text: Column) -> Column:
    """The tampered text: A-Z lower-cased where 3 divides the crc32 of the decimal doc_id."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(hit, F.translate(text, UPPER, LOWER)).otherwise(text)


def _levels(leaves: DataFrame, height: int, scratch: Scratch, name: str) -> list[DataFrame]:
    """Nodes of the levels 0..height: grp, lo, hi, hash, and above level 0 their children.

    A level's rows are the runs of 8 nodes below; a group's tree ends at the level where one
    node covers all of it (``top``), so groups of all sizes are built in the same passes.
    """
    levels = [leaves]
    for k in range(1, height + 1):
        below = levels[-1].where(~F.col("top"))
        runs = below.groupBy("grp", F.expr(f"lo div {FAN_OUT ** k}").alias("bucket"), "size").agg(
            F.sort_array(F.collect_list(F.struct("lo", "hi", "hash"))).alias("children"))
        last = F.col("children")[F.size("children") - 1]
        nodes = runs.select(
            "grp", F.col("children")[0]["lo"].alias("lo"), last["hi"].alias("hi"),
            F.sha2(F.array_join(F.col("children")["hash"], ""), 256).alias("hash"), "size", "children")
        nodes = nodes.withColumn("top", (F.col("lo") == 0) & (F.col("hi") == F.col("size")))
        levels.append(scratch.table(nodes, f"{name}_level_{k}"))
    return levels


def _side(keep) -> Column:
    """The joined hashes of the parent's children on one side of the node's own interval."""
    return F.array_join(F.transform(F.filter("children", keep), lambda c: c["hash"]), "")


def _attach(levels: list[DataFrame], above: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The leaves with ``path``: (left, right) sibling hashes of every level up to the root.

    ``above``: grp, subroot, path and root of each group's top node. From the top level down,
    nodes are joined to the level above by bucket and containment; a parent's interval without
    the node's own gives the siblings.
    """
    done = None
    for k in range(len(levels) - 1, -1, -1):
        nodes = levels[k]
        own = [c for c in nodes.columns if c not in ("children", "top", "size")]
        keep = own + (["children"] if k else [])
        tops = nodes.where("top").join(above, "grp").select(*keep, "subroot", "root", "path")
        if done is None:
            out = tops
        else:
            parents = done.select(F.col("grp").alias("p_grp"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"),
                                  F.col("children").alias("p_children"), "subroot", "root",
                                  F.col("path").alias("p_path"),
                                  F.expr(f"lo div {FAN_OUT ** (k + 1)}").alias("p_bucket"))
            inner = nodes.where(~F.col("top")).withColumn("bucket", F.expr(f"lo div {FAN_OUT ** (k + 1)}"))
            joined = inner.join(parents, (F.col("grp") == F.col("p_grp")) & (F.col("bucket") == F.col("p_bucket"))
                                & (F.col("lo") >= F.col("p_lo")) & (F.col("hi") <= F.col("p_hi")))
            if k:
                joined = joined.withColumnRenamed("children", "own_children")
            joined = joined.withColumnRenamed("p_children", "children")
            step = F.struct(_side(lambda c: c["hi"] <= F.col("lo")).alias("left"),
                            _side(lambda c: c["lo"] >= F.col("hi")).alias("right"))
            path = F.concat(F.array(step), F.col("p_path")).alias("path")
            kept = own + ([F.col("own_children").alias("children")] if k else [])
            out = joined.select(*kept, "subroot", "root", path).unionByName(tops)
        done = scratch.table(out, f"{name}_paths_{k}") if k else out
    return done


def _height(size: int) -> int:
    """Levels above the leaves until one node covers ``size`` leaves."""
    height = 0
    while FAN_OUT ** height < size:
        height += 1
    return height


def _forest(rows: DataFrame, order: list[str], group: str | None, scratch: Scratch, name: str):
    """Leaves ranked inside their group and the levels above them (None for no rows)."""
    dealt = ranked(rows, [F.col(c).asc_nulls_first() for c in order], scratch, "at")
    dealt = scratch.table(dealt.withColumn("grp", F.col(group) if group else F.lit("")), f"{name}_ranked")
    groups = dealt.groupBy("grp").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("size"))
    groups = scratch.table(groups, f"{name}_groups")
    largest = groups.agg(F.max("size")).first()[0]
    if largest is None:
        return None
    # the groups are sizes of groups: small on most data, and joined as Spark sees fit on others
    leaves = dealt.join(groups, "grp").withColumn("lo", F.col("at") - F.col("start")).drop("at", "start")
    leaves = leaves.withColumn("hi", F.col("lo") + 1).withColumn("top", F.col("size") == 1)
    leaves = scratch.table(leaves, f"{name}_leaves")
    return _levels(leaves, _height(largest), scratch, name)


NO_PATH = "CAST(array() AS array<struct<left: string, right: string>>)"
RESULT = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
          "verified boolean")


def manifest(docs: DataFrame, tampered=lower_cased_every_third) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and the root folded from a changed text.

    ``tampered`` maps the text column to the text that the verifier is shown (null: null).
    ``folded_root`` is computed from that text's leaf and the untampered siblings; ``verified``
    says whether it is the root.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    rows = columns_of(docs, *DOCUMENT_COLUMNS)
    lang_key = F.when(F.col("lang").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("lang")))
    text = F.col("text")
    hashed = scratch.table(rows.select("doc_id", lang_key.alias("lang_key"), leaf_hash(text).alias("hash"),
                                       leaf_hash(tampered(text)).alias("shown")), "hashed")
    levels = _forest(hashed, ["lang_key", "doc_id", "hash", "shown"], "lang_key", scratch, "leaves")
    if levels is None:
        return docs.sparkSession.createDataFrame([], RESULT)
    subroots = None
    for nodes in levels:
        tops = nodes.where("top").select(F.col("grp").alias("lang_key"), "hash")
        subroots = tops if subroots is None else subroots.unionByName(tops)
    upper = _forest(scratch.table(subroots, "subroots"), ["lang_key"], None, scratch, "languages")
    # one row: the node that covers all languages
    root = upper[-1].where("top").select("grp", F.col("hash").alias("root"), F.col("hash").alias("subroot"),
                                         F.expr(NO_PATH).alias("path"))
    above = _attach(upper, root, scratch, "languages").select(
        F.col("lang_key").alias("grp"), F.col("hash").alias("subroot"), "root", "path")
    leaves = _attach(levels, scratch.table(above, "above"), scratch, "leaves")
    siblings = F.concat(F.lit(""), F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""))
    folded = F.aggregate("path", F.col("shown"), lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))
    out = leaves.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root",
                        F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))

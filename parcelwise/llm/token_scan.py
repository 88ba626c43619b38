"""Token counts by a separator scan over flat token files without an index.

A flat file holds 16-bit little-endian ids; each document ends with the end-of-document id.
The files are cut into blocks of fixed size. A task reads a block by range and finds the
separators with one vectorised comparison. What crosses a block's border is stitched by a
prefix scan over the blocks of a file: a running count of separators numbers the documents,
and a running maximum of separator places tells where the document that a block begins in
was opened. No task reads a whole file.

Defined cases: two separators in a row are an empty document; ids after the last separator
are a document without end (``ended`` false); an empty file has no documents.

``write_token_files`` makes such files from documents (a null text is empty). A file is
written under a name of its own for each task attempt, and only the files of the attempts
that Spark commits are in the manifest, so a lost executor leaves nothing half-read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelwise.llm.common import as_uri, columns_of, frees_memory
from parcelwise.llm.tokens import default_tokenizer, encoder, forget
from parcelwise.sources.scratch import Scratch

END_ID, BLOCK_TOKENS = 49407, 1 << 20


def write_token_files(docs: DataFrame, folder: str, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Write one flat file per task; returns (file, tokens, ordinal, doc_id), the order of the
    documents in the files. The frame must be written out before the files are used."""
    path, folder = path or default_tokenizer(), as_uri(folder)

    @frees_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"tokens-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.u16"
        count, waiting = 0, []
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in batches:
                for a, b, ids, _ in encoder(path, True).encode(batch.column(1), end_id):
                    out.write(ids.astype("<u2").tobytes())
                    waiting.append((batch.column(0)[a:b], count))
                    count += b - a
                for doc_ids, first in waiting:
                    n = len(doc_ids)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * n, pa.string()), pa.array(np.arange(first, first + n)), doc_ids],
                        names=["file", "ordinal", "doc_id"])
                waiting = []
        forget()
    return columns_of(docs, "doc_id", "text").mapInArrow(run, "file string, ordinal long, doc_id long")


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes) of the flat files in ``folder`` (names and sizes only)."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = [(s.getPath().getName(), s.getLen()) for s in store.listStatus(root)] if store.exists(root) else []
    return spark.createDataFrame([r for r in rows if r[0].endswith(".u16")], "file string, bytes long")


def scan_tokens(files: DataFrame, folder: str, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, n_tokens, ended) of every document in the files (``file``, ``bytes``)."""
    spark, root_uri = files.sparkSession, as_uri(folder)
    scratch = Scratch(spark, "token_scan")
    tokens = F.floor(F.col("bytes") / 2)
    blocks = files.select("file", tokens.alias("tokens"), F.explode(F.sequence(
        F.lit(0).cast("long"), F.greatest(tokens - 1, F.lit(0)), F.lit(block_tokens).cast("long"))).alias("begin"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    @frees_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        store, root = fs.FileSystem.from_uri(root_uri)
        for batch in batches:
            for file, tokens, begin in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                with store.open_input_file(f"{root}/{file}") as source:
                    source.seek(2 * begin)
                    data = source.read(2 * min(block_tokens, tokens - begin))
                ends = np.flatnonzero(np.frombuffer(data, dtype="<u2") == end_id) + begin
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([tokens], pa.int64()), pa.array([begin], pa.int64()),
                     pa.array([ends.tolist()], pa.list_(pa.int64()))], names=["file", "tokens", "begin", "ends"])
    found = blocks.repartition(parts, "file", "begin").mapInArrow(
        run, "file string, tokens long, begin long, ends array<long>")
    found = scratch.table(found, "separators")
    earlier = Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    stitched = found.select("file", "begin", "tokens", F.size("ends").alias("n"),
                            F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(-1)).alias("last")) \
        .select("file", "begin", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
                F.coalesce(F.max("last").over(earlier), F.lit(-1)).alias("opened"))
    joined = found.join(stitched, ["file", "begin"])
    previous = F.concat(F.array("opened"), F.col("ends"))
    each = joined.where(F.size("ends") > 0).select("file", "before", F.posexplode(
        F.transform("ends", lambda e, i: e - F.get(previous, i) - 1)).alias("at", "n_tokens"))
    ended = each.select("file", (F.col("before") + F.col("at")).alias("ordinal"), "n_tokens",
                        F.lit(True).alias("ended"))
    tail = found.groupBy("file").agg(F.max("tokens").alias("tokens"), F.max(F.try_element_at("ends", F.lit(-1))).alias("last"),
                                     F.sum(F.size("ends")).alias("ordinal"))
    rest = tail.select("file", "ordinal", (F.col("tokens") - F.coalesce("last", F.lit(-1)) - 1).alias("n_tokens"),
                       F.lit(False).alias("ended")).where("n_tokens > 0")
    return ended.unionByName(rest)


def document_token_counts(docs: DataFrame, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Write the documents as flat token files, scan them, and name each count by its doc_id."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    folder = f"{scratch.root}/flat"
    order = scratch.table(write_token_files(docs, folder, end_id, path), "order")
    files = token_files(spark, folder).join(order.select("file").distinct(), "file")  # committed ones only
    counts = scan_tokens(files, folder, end_id)
    return order.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")

"""Token counts from flat token files without an index.

A flat file holds the ids of many documents, each followed by an
end-of-document id.  Files are read in blocks of fixed size; a vectorised
search finds the end ids in a block, and a prefix scan over the blocks'
summaries gives each document its number and joins the parts of documents that
run over block borders.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nightspark.llm.common import cut, fresh_path, table, type_of
from nightspark.llm.packing import some_texts, word_ids

#: Ends a document in a file: the largest 16-bit value, which no text has (<|endoftext|> is a word that a text may hold).
END_OF_TEXT = 65535
BLOCK_TOKENS = 1 << 20
#: Blocks whose summaries one task scans.
SPAN = 1024


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end: int = END_OF_TEXT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write one flat file of little-endian 16-bit ids per task; returns (file, place, doc): which document stands where.

    A file is written under a name of its own and named in the result only when
    it is whole, so a task that is run again leaves no half file in the result.
    ``folder`` is shared by driver and executors (any file system that pyarrow
    opens by its address).  ``end`` lies above all ids of the vocabulary.
    """
    kind = type_of(docs, doc_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        name = f"tokens-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
        stop, place, out = np.array([end], "<u2").tobytes(), 0, None
        try:
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for lo, hi in some_texts(texts):
                    if word_ids(tokenizer).size > end:
                        raise ValueError(f"the vocabulary has {word_ids(tokenizer).size} ids, the end id {end} must lie above them")
                    out = out or system.open_output_stream(f"{root}/{name}")
                    ids = word_ids(tokenizer).ids(texts[lo:hi])
                    out.write(b"".join(np.frombuffer(x, "<u4").astype("<u2").tobytes() + stop for x in ids))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * (hi - lo)), pa.array(np.arange(place, place + hi - lo)), batch.column(0).slice(lo, hi - lo)],
                        ["file", "place", "doc"])
                    place += hi - lo
        finally:
            if out:
                out.close()

    return docs.select(doc_id, text).mapInArrow(write, f"file string, place long, doc {kind}")


def token_blocks(spark: SparkSession, folder: str, files: DataFrame, width: int = 2, block: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, size): the blocks of the named files, from their sizes alone."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            names = batch.column("file").to_pylist()
            if names:
                found = system.get_file_info([f"{root}/{n}" for n in names])
                yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array([i.size // width for i in found], pa.int64())], ["file", "tokens"])

    sized = files.select("file").distinct().mapInArrow(sizes, "file string, tokens long")
    count = F.ceil(F.col("tokens") / block).cast("long")
    return sized.filter("tokens > 0").select("file", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("block")).select(
        "file", "block", F.least(F.lit(block).cast("long"), F.col("tokens") - F.col("block") * block).alias("size"))


def count_tokens(spark: SparkSession, folder: str, blocks: DataFrame, end: int = END_OF_TEXT, width: int = 2, block: int = BLOCK_TOKENS) -> DataFrame:
    """(file, place, n_tokens) of every document of the files; the end id is not counted.

    Tokens after a file's last end id are a document too; none make none.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, at, size in zip(*[batch.column(c).to_pylist() for c in ("file", "block", "size")], strict=True):
                with system.open_input_file(f"{root}/{name}") as source:
                    source.seek(at * block * width)
                    ids = np.frombuffer(source.read(size * width), f"<u{width}")
                ends = np.flatnonzero(ids == end)
                # tokens before the first end, between ends, and after the last
                parts = np.diff(np.concatenate(([-1], ends, [len(ids)]))) - 1
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n), pa.array(np.full(n, at)), pa.array(np.arange(n)), pa.array(parts), pa.array(np.full(n, n - 1))],
                    ["file", "block", "part", "tokens", "ends"])

    parts = cut(blocks.repartition("file", "block").mapInArrow(scan, "file string, block long, part long, tokens long, ends long"), "token-parts")
    # prefix scan: ends before a block, over spans of blocks and over the blocks of a span
    summary = parts.filter("part = 0").select("file", "block", "ends", F.floor(F.col("block") / SPAN).alias("span"))
    spans = summary.groupBy("file", "span").agg(F.sum("ends").alias("n"))
    before = lambda keys, order, col: F.coalesce(F.sum(col).over(
        W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("file", "span", before(["file"], "span", "n").alias("base"))
    offsets = summary.join(spans, ["file", "span"]).select(
        "file", "block", (F.col("base") + before(["file", "span"], "block", "ends")).alias("base"))
    placed = parts.join(offsets, ["file", "block"]).select(
        "file", (F.col("base") + F.col("part")).alias("place"), "tokens", (F.col("part") < F.col("ends")).alias("ended"))
    # a document inside a block is one row, one over borders a row per block
    whole = placed.groupBy("file", "place").agg(F.sum("tokens").alias("n_tokens"), F.max("ended").alias("ended"))
    return whole.filter("ended OR n_tokens > 0").select("file", "place", "n_tokens")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as pyarrow reads it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full


def document_token_counts(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK_TOKENS) -> DataFrame:
    """(id, n_tokens) of every row, counted from flat token files in the shared folder.

    Null and empty texts have 0 tokens.  Null and repeated ids are kept, a row
    each.  Other columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    folder = qualified(spark, fresh_path(spark, "tokens"))
    manifest = cut(write_token_files(docs, tokenizer, folder, doc_id=doc_id, text=text), "token-manifest")
    counts = count_tokens(spark, folder, token_blocks(spark, folder, manifest, block=block), block=block)
    return manifest.join(counts, ["file", "place"], "left").select(F.col("doc").alias(doc_id), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return document_token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

"""Flat token files, and document lengths from them by a scan for separators.

Files hold token ids and nothing else: no index, no lengths; every document ends with the separator. Lengths come from
looking at blocks of the files independently. A block gives the tokens before its first separator, those between its separators, and
those after the last. A prefix scan over the blocks of a file gives the number of documents that ended before a block and
the tokens of the one still open, which stitches documents that go over block boundaries.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import small_batches
from .store import new_path, saved

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How a text falls into pieces before byte pairs are merged (a fixed value of the vocabulary).
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
BLOCK_TOKENS = 1 << 21


def tokenizer(path: str):
    """(encode a list of texts to lists of ids, separator id) of a vocabulary of byte pairs; the separator follows the last id."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("vocabulary", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
    return (lambda texts: [enc.encode_ordinary(t) for t in texts]), max(ranks.values()) + 1


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


def as_uri(path: str) -> str:
    """``file:/x`` and ``file:///x`` alike as ``file:///x``."""
    return "file://" + path[5:].replace("//", "", 1) if path.startswith("file:") else path


def write_token_files(docs: DataFrame, tokenizer_path: str = TOKENIZER) -> DataFrame:
    """One file a task under the shared folder; returns (file, separator, width, n_tokens, doc_ids), the ids in file order.

    A task that runs again writes another file, and only the file whose row counts is read. Null texts are empty.
    """
    spark = docs.sparkSession
    small_batches(spark, 200)
    to = as_uri(new_path(spark, "tokens"))
    open_fs(to)[0].create_dir(open_fs(to)[1], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, separator = tokenizer(tokenizer_path)
        kind = np.uint16 if separator < 1 << 16 else np.uint32
        system, folder = open_fs(to)
        name, ids, n = f"{folder}/{uuid.uuid4().hex}.bin", [], 0
        with system.open_output_stream(name) as out:
            for b in batches:
                ids += b.column(0).to_pylist()
                for tokens in encode(b.column(1).fill_null("").to_pylist()):
                    out.write(np.array([*tokens, separator], kind).tobytes())
                    n += len(tokens) + 1
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([separator]), pa.array([np.dtype(kind).itemsize]), pa.array([n]), pa.array([ids], pa.list_(pa.int64()))], names=["file", "separator", "width", "n_tokens", "doc_ids"])

    files = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "file string, separator long, width long, n_tokens long, doc_ids array<long>")
    out = saved(files, "token-files")
    out.at = to
    return out


def scan(files: DataFrame, at: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, n_tokens) of every document of the files (file, separator, width, n_tokens): the separators are not
    counted; tokens after the last separator are a document of their own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = open_fs(at)[0]
        schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("ends", pa.int64()), ("head", pa.int64()), ("tail", pa.int64()), ("inner", pa.list_(pa.int64()))])
        for b in batches:
            for r in b.to_pylist():
                with system.open_input_file(r["file"]) as f:
                    ids = np.frombuffer(f.read_at(r["size"] * r["width"], r["block"] * block_tokens * r["width"]), np.uint16 if r["width"] == 2 else np.uint32)
                ends = np.flatnonzero(ids == r["separator"])
                some = len(ends) > 0
                yield pa.RecordBatch.from_pylist([{
                    "file": r["file"], "block": r["block"], "ends": len(ends), "head": int(ends[0]) if some else None,
                    "tail": len(ids) - int(ends[-1]) - 1 if some else len(ids), "inner": (np.diff(ends) - 1).tolist()}], schema)

    start = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n_tokens") / block_tokens) - 1)).alias("block")
    blocks = files.where("n_tokens > 0").select("file", "separator", "width", "n_tokens", start)
    blocks = blocks.withColumn("size", F.least(F.lit(block_tokens), F.col("n_tokens") - F.col("block") * block_tokens))
    n = max(1, min(10_000, files.agg(F.sum(F.ceil(F.col("n_tokens") / block_tokens))).first()[0] or 1))
    seen = blocks.repartition(n, "file", "block").mapInArrow(run, "file string, block long, ends long, head long, tail long, inner array<long>")
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = seen.withColumns({"done": F.sum("ends").over(upto), "part": F.sum((F.col("ends") > 0).cast("long")).over(upto)})
    seen = saved(seen, "token-blocks")
    inner = seen.select("file", F.posexplode("inner").alias("k", "n_tokens"), "done", "ends").select("file", (F.col("done") - F.col("ends") + F.col("k") + 1).alias("ordinal"), "n_tokens")
    # What a part's first block has after its last separator, the blocks without one, and the next part's head are one document.
    pieces = seen.select("file", "part", F.col("tail").alias("n"), F.col("done").alias("ordinal"), F.lit(False).alias("ended")).unionByName(
        seen.where("ends > 0").select("file", F.col("part") - 1, F.col("head"), F.col("done") - F.col("ends"), F.lit(True)).toDF("file", "part", "n", "ordinal", "ended"))
    stitched = pieces.groupBy("file", "part").agg(F.sum("n").alias("n_tokens"), F.max("ordinal").alias("ordinal"), F.max("ended").alias("ended"))
    return inner.unionByName(stitched.where("ended or n_tokens > 0").select("file", "ordinal", "n_tokens"))


def token_counts(docs: DataFrame, tokenizer_path: str = TOKENIZER, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id and n_tokens for every row of ``docs``, by writing flat token files and scanning them for separators.

    Null and empty texts have 0 tokens. Repeated rows are counted each; null ids are kept. Other columns are ignored; an empty table gives an
    empty result.
    """
    files = write_token_files(docs, tokenizer_path)
    ids = files.select("file", F.posexplode("doc_ids").alias("ordinal", "doc_id"))
    return ids.join(scan(files, files.at, block_tokens), ["file", "ordinal"]).select("doc_id", "n_tokens")

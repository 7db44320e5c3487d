"""Chunkers and text similarities that are folds over a text: pandas UDFs over Arrow batches, a row in, rows out."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks that end a sentence.
SENTENCE = re.compile("[^。！？；!?;]*[。！？；!?;]|[^。！？；!?;]+$")


def _pieces(text: str, size: int, overlap: int) -> list[str]:
    """Paragraphs packed up to ``size`` characters; each chunk begins with the last ``overlap`` characters of the one before.
    A paragraph that is longer than what is left is cut."""
    out, now, new = [], "", False  # new: ``now`` has more than what it took over
    for par in (p.strip() for p in text.split("\n")):
        while par:
            room = size - len(now) - bool(now)
            if len(par) <= room:
                now, par, new = f"{now}\n{par}" if now else par, "", True
            elif now and len(par) + overlap + 1 <= size:
                out.append(now)
                now, new = now[-overlap:] if overlap else "", False
            elif room < 1:
                out.append(now)
                now, new = now[-overlap:] if overlap else "", False
            else:
                now = (f"{now}\n" if now else "") + par[:room]
                par = par[room:]
                out.append(now)
                now, new = now[-overlap:] if overlap and par else "", False
    if new:
        out.append(now)
    return out


def chunk_text(docs: DataFrame, size: int = 600, overlap: int = 100) -> DataFrame:
    """(doc_id, seq, chunk): chunks of at most ``size`` characters with ``overlap`` between neighbours; null texts have none."""
    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _pieces(t or "", size, overlap))

    return docs.select("doc_id", F.posexplode(cut("text")).alias("seq", "chunk"))


def chunk_parent_child(docs: DataFrame, child: int = 300, parent: int = 1200) -> DataFrame:
    """(parent_id, doc_id, seq, chunk, offset, length): parents are packed paragraphs, children lie in them by offset and length."""
    parents = chunk_text(docs, parent, 0).select(F.concat_ws("::p", F.substring(F.md5(F.col("doc_id").cast("string")), 1, 10), "seq").alias("parent_id"), "doc_id", F.col("chunk").alias("parent"))
    starts = F.sequence(F.lit(0), F.floor((F.length("parent") - 1) / child))
    return parents.where(F.length("parent") > 0).select("parent_id", "doc_id", "parent", F.explode(starts).alias("seq")).select(
        "parent_id", "doc_id", "seq", F.substring(F.col("parent"), (F.col("seq") * child + 1).cast("int"), F.lit(child)).alias("chunk"),
        (F.col("seq") * child).alias("offset"), F.least(F.lit(child), F.length("parent") - F.col("seq") * child).alias("length"))


def pack_sentences(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, seq, chunk): whole sentences packed up to ``size`` characters, without blanks at the ends; a longer sentence begins a
    chunk of its own and is cut every ``size`` characters, what is left of it goes on with the next sentences. Null texts have none."""
    def of(text: str) -> list[str]:
        out, now = [], ""
        for sentence in SENTENCE.findall(text):
            cuts = [sentence[i : i + size] for i in range(0, len(sentence), size)]
            if len(now) + len(sentence) <= size:
                now += sentence
            else:
                out += [now, *cuts[:-1]]
                now = cuts[-1]
        return [x for x in (c.strip() for c in [*out, now]) if x]

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: of(t or ""))

    return docs.select("doc_id", F.posexplode(cut("text")).alias("seq", "chunk"))


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row at a time as an array."""
    y, row = np.array([ord(c) for c in b]), np.zeros(len(b) + 1, np.int64)
    for c in a:
        step = np.r_[0, np.where(y == ord(c), row[:-1] + 1, row[1:])]
        row = np.maximum.accumulate(np.maximum(step, row))
    return int(row[-1])


def rouge_l(a: Column, b: Column) -> Column:
    """F1 of the longest common subsequence of characters that aren't blank; 0 if either text has none or is null."""
    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([2 * _lcs(p, q) / (len(p) + len(q)) if p and q else 0.0 for p, q in zip(x, y, strict=True)])

    return score(F.regexp_replace(a, r"\s+", ""), F.regexp_replace(b, r"\s+", ""))


def sequence_ratio(a: Column, b: Column) -> Column:
    """Share of matching blocks (Ratcliff and Obershelp) without the heuristic for frequent characters; null texts are empty."""
    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, p or "", q or "", autojunk=False).ratio() for p, q in zip(x, y, strict=True)])

    return score(a, b)


def embed(text: Column, encode) -> Column:
    """The seam for a model: ``encode`` takes a list of texts, a batch, and gives their vectors."""
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(list(encode(b.fillna("").tolist())))

    return run(text)

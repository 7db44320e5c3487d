"""Vectorised tokens and hashes over the bytes of Arrow string columns, for the operators that run in Python.

A token's hash is a polynomial in its bytes modulo 2**64, taken from running sums, and then mixed. Bytes are looked at in
blocks of a megabyte; of a token that goes on in the next block, the sum so far is carried over. So memory does not depend on the length
of a text or a token except for the 8 bytes a token that are returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1
_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words are runs of bytes that aren't ASCII blanks.
BLANK_CLASSES = np.ones(256, np.uint8)
BLANK_CLASSES[[9, 10, 11, 12, 13, 32]] = 0
#: Words are runs of ASCII letters, digits and everything beyond ASCII.
WORD_CLASSES = np.zeros(256, np.uint8)
WORD_CLASSES[48:58] = WORD_CLASSES[65:91] = WORD_CLASSES[97:123] = WORD_CLASSES[128:] = 1
#: The same words, and runs of other characters than blanks as tokens of their own.
MIXED_CLASSES = np.where(WORD_CLASSES == 1, 1, np.where(BLANK_CLASSES == 1, 2, 0)).astype(np.uint8)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Long texts come in batches of at most so many rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        for k, b in enumerate((_BASE, inverse)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _POW[k] = np.multiply.accumulate(p)
    return _POW[0], _POW[1]


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and len(body) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def tokens(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens in order, and for each row the number of its first token (one more entry at the end)."""
    n, at, hashes, starts = len(data), 0, [], []
    carry = None  # (sum, length, start) of a token that goes on
    p, q = _powers(BLOCK + 1)
    while at < n:
        end = min(n, at + BLOCK)
        c = classes[data[at:end]]
        new = np.empty(len(c) + 1, bool)
        new[0] = new[-1] = True
        np.not_equal(c[1:], c[:-1], out=new[1:-1])
        lo, hi = np.searchsorted(offsets, (at, end))
        new[offsets[lo:hi] - at] = True
        inside = c != 0
        s = np.flatnonzero(new[:-1] & inside)
        e = np.flatnonzero(new[1:] & inside)
        total = np.cumsum((LOWER[data[at:end]].astype(np.uint64) + np.uint64(1)) * p[: len(c)])
        before = total[s - 1]
        if len(s) and s[0] == 0:
            before[0] = 0
        value, length, s = (total[e] - before) * q[s], e + 1 - s, s + at
        if carry is not None:  # the block begins inside it
            value[0] = np.uint64((carry[0] + int(value[0]) * pow(_BASE, carry[1], 1 << 64)) & _M64)
            length[0], s[0], carry = length[0] + carry[1], carry[2], None
        row = np.searchsorted(offsets, end)
        if end < n and c[-1] and classes[data[end]] == c[-1] and offsets[row] != end:
            carry = int(value[-1]), int(length[-1]), int(s[-1])
            value, s = value[:-1], s[:-1]
        hashes.append(mix64(value))
        starts.append(s)
        at = end
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return h, np.searchsorted(s, offsets)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive tokens, without regard to rows: entry i begins at token i."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[k : k + len(out)]
    return mix64(out)

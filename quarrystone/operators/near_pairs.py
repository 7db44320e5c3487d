"""All pairs of texts whose sets of four-character grams are alike: an exact set join by parities of hashed grams.

Sets of natural texts share so many grams that lists of single grams, or of neighbours among them, hold every pair several times.
So sets in order of their size meet all sets in reach of their size, as bits: bit ``h`` of a set is the parity of its grams with
hash ``h``. Two sets differ in at least as many grams as in bits, so too many differing bits rule a pair out; the others'
texts are compared. Equal sets are one set until the pairs are written out. A gram is its four code points in 64 bits (a hash
of them where one is beyond U+FFFF).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Sets in a block of bits, and bytes of it; texts in a block that is compared, and characters of it.
BITS, TEXTS = (1024, 1 << 19), (256, 1 << 20)
#: Rows that are compared at once, and rows of two blocks that Python gets at once.
TILE, BATCH = 64, 16
#: Rows of ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def saved(df: DataFrame, name: str) -> DataFrame:
    """Written to the folder that executors share, and read back."""
    path = f"{df.sparkSession.conf.get('spark.checkpoint.dir', None) or 'file:/tmp/checkpoints'}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def grams(text: str) -> np.ndarray:
    """The set of a text, sorted; a text of fewer than four characters is one gram."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(c) < 4:
        c = np.r_[c, np.full(4 - len(c), 0xD800, np.uint64)]
    parts = [c[i : len(c) - 3 + i] for i in range(4)]
    g = parts[0] | parts[1] << np.uint64(16) | parts[2] << np.uint64(32) | parts[3] << np.uint64(48)
    if (c > 0xFFFF).any():
        wide = np.max(parts, axis=0) > 0xFFFF
        h = np.zeros(len(g), np.uint64)
        for p in parts:
            h = (h ^ p) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        g[wide] = h[wide]
    return np.unique(g)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)


def _batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 500) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _parities(g: np.ndarray) -> bytes:
    """At least two bits for each gram, in a power of two; those of half as many bits are its halves' XOR."""
    bits = max(64, 1 << int(2 * len(g) - 1).bit_length())
    h = g * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)
    return np.packbits(np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("sig", pa.binary()), ("n", pa.int64()), ("bits", pa.binary())])
    sets = ((i, grams(t)) for i, t in _rows(batches))
    yield from _batched(((i, hashlib.blake2b(g.tobytes(), digest_size=16).digest(), len(g), _parities(g)) for i, g in sets), schema)


def _bit_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of n, s, bits in order: blocks with one number of bits."""
    schema = pa.schema([("first", pa.int64()), ("least", pa.int64()), ("most", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("bits", pa.binary())])

    def cut():
        held = []
        for r in _rows(batches):
            if held and (len(r[2]) != len(held[0][2]) or len(held) >= BITS[0] or len(held) * len(r[2]) >= BITS[1]):
                yield held
                held = []
            held.append(r)
        if held:
            yield held

    rows = ((b[0][1], b[0][0], b[-1][0], np.array([s for _, s, _ in b]).tobytes(), np.array([n for n, _, _ in b]).tobytes(), b"".join(x for *_, x in b)) for b in cut())
    yield from _batched(rows, schema, 8)


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of two blocks, or one and itself: pairs that bits don't rule out. Few bits first, then all that both have."""
    for ia, na, ba, ib, nb, bb in _rows(batches):
        alone = ia == ib
        ia, na, ib, nb = (np.frombuffer(z, np.int64) for z in (ia, na, ib, nb))
        a, b = (np.frombuffer(z, np.uint64).reshape(len(i), -1) for z, i in ((ba, ia), (bb, ib)))
        words = min(a.shape[1], b.shape[1])
        a, b = _folded(a, words), _folded(b, words)
        few = max(1, words // 4)
        fa, fb = _folded(a, few), np.ascontiguousarray(_folded(b, few).T)
        xs, ys = [], []
        for k in range(0, len(ia), TILE):
            t = slice(k, k + TILE)
            lo, hi = (k if alone else 0), int(np.searchsorted(nb, na[t][-1] * 5 // 4, "right"))
            if lo >= hi:
                continue
            apart = np.zeros((len(ia[t]), hi - lo), np.uint32)
            for w in range(few):
                apart += np.bitwise_count(fa[t, w, None] ^ fb[None, w, lo:hi])
            r, c = np.nonzero(9 * apart <= na[t, None] + nb[None, lo:hi])
            r, c = r + k, c + lo
            keep = 4 * nb[c] <= 5 * na[r]
            if alone:
                keep &= r < c
            r, c = r[keep], c[keep]
            for j in range(0, len(r), 4096):
                p, q = r[j : j + 4096], c[j : j + 4096]
                near = 9 * np.bitwise_count(a[p] ^ b[q]).sum(axis=1, dtype=np.int64) <= na[p] + nb[q]
                xs.append(ia[p[near]])
                ys.append(ib[q[near]])
        if xs:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(xs)), pa.array(np.concatenate(ys))], names=["x", "y"])


def _text_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("texts", pa.list_(pa.string()))])

    def cut():
        held, chars = [], 0
        for _, s, t in _rows(batches):
            if held and (len(held) >= TEXTS[0] or chars + len(t) > TEXTS[1]):
                yield held
                held, chars = [], 0
            held.append((s, t))
            chars += len(t)
        if held:
            yield held

    yield from _batched(((b[0][0], [s for s, _ in b], [t for _, t in b]) for b in cut()), schema, 8)


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of two blocks of texts, or one and null, the pairs asked for, each set as bits of the grams that stand in them."""
    for xs, ys, ia, ta, ib, tb in _rows(batches):
        texts = dict(zip(ia, ta, strict=True)) | dict(zip(ib or [], tb or [], strict=True))
        ids, at = np.unique(np.concatenate([xs, ys]), return_inverse=True)
        sets = [grams(texts[i]) for i in ids.tolist()]
        n = np.array([len(g) for g in sets])
        known, place = np.unique(np.concatenate(sets), return_inverse=True)
        bits = np.zeros((len(sets), len(known) // 64 + 1), np.uint64)
        for i, p in enumerate(np.split(place, np.cumsum(n)[:-1])):
            word = p >> 6
            starts = np.nonzero(np.r_[True, word[1:] != word[:-1]])[0]
            bits[i, word[starts]] = np.bitwise_or.reduceat(np.uint64(1) << (p & 63).astype(np.uint64), starts)
        step = max(1, (1 << 20) // bits.shape[1])
        x, y = at[: len(xs)], at[len(xs) :]
        c = np.concatenate([np.bitwise_count(bits[x[k : k + step]] & bits[y[k : k + step]]).sum(axis=1, dtype=np.int64) for k in range(0, len(x), step)])
        both = n[x] + n[y] - c
        keep = 5 * c >= 4 * both
        yield pa.RecordBatch.from_arrays([pa.array(z[keep]) for z in (ids[x], ids[y], c, both)], names=["x", "y", "c", "both"])


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _in_small_batches(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Saved, while rows that hold whole blocks go to Python by a few."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(BATCH))
    try:
        return saved(df, name)
    finally:
        spark.conf.set(key, was)


def near_pairs(docs: DataFrame) -> DataFrame:
    """x, y, jaccard: all pairs x < y of ids whose texts' sets are at least 80 % alike. Ids are unique; rows with a null id or
    text are in no pair; empty texts are equal."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    sets = saved(docs.mapInArrow(_signatures, "doc_id long, sig binary, n long, bits binary"), "gram-sets")
    of = saved(sets.select("doc_id", F.min("doc_id").over(Window.partitionBy("sig")).alias("s")), "gram-set-of")
    copies = of.where("doc_id <> s")
    n_copies = copies.count()
    one = sets.join(_small(copies.select("doc_id"), n_copies), "doc_id", "left_anti").select("n", F.col("doc_id").alias("s"), "bits")
    blocks = saved(
        one.repartitionByRange("n", "s").sortWithinPartitions("n", "s").mapInArrow(_bit_blocks, "first long, least long, most long, ids binary, sizes binary, bits binary"),
        "gram-blocks")
    a, b = blocks.alias("a"), blocks.alias("b").hint("shuffle_replicate_nl")
    reach = F.expr("(a.least < b.least OR a.least = b.least AND a.first <= b.first) AND 4 * b.least <= 5 * a.most")
    met = a.join(b, reach).selectExpr("a.ids AS ia", "a.sizes AS na", "a.bits AS ba", "b.ids AS ib", "b.sizes AS nb", "b.bits AS bb")
    pairs = _in_small_batches(spark, met.mapInArrow(_possible, "x long, y long"), "gram-pairs")
    # what may be alike goes to one block of texts or few: by the least that may be like it
    beside = pairs.selectExpr("x AS s", "y AS o").unionByName(pairs.selectExpr("y AS s", "x AS o")).groupBy("s").agg(F.least(F.min("o"), "s").alias("by"))
    beside = saved(beside, "gram-beside")
    n_beside = beside.count()
    texts = docs.withColumnRenamed("doc_id", "s").join(_small(beside, n_beside), "s").select("by", "s", "text")
    texts = saved(texts.repartitionByRange("by", "s").sortWithinPartitions("by", "s").mapInArrow(_text_blocks, "block long, ids array<long>, texts array<string>"), "gram-texts")
    home = texts.select("block", F.explode("ids").alias("s"))
    asked = pairs.join(_small(home.selectExpr("s AS x", "block AS a"), n_beside), "x").join(_small(home.selectExpr("s AS y", "block AS b"), n_beside), "y")
    asked = asked.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.collect_list(F.struct("x", "y")).alias("p"))
    asked = asked.withColumn("b", F.expr("nullif(b, a)"))
    met = asked.join(texts.selectExpr("block AS a", "ids AS ia", "texts AS ta"), "a").join(texts.selectExpr("block AS b", "ids AS ib", "texts AS tb"), "b", "left")
    linked = _in_small_batches(spark, met.select("p.x", "p.y", "ia", "ta", "ib", "tb").mapInArrow(_overlaps, "x long, y long, c long, both long"), "gram-links")
    jaccard = F.round(F.col("c") / F.col("both"), 6)
    m = copies.groupBy("s").agg(F.collect_list("doc_id").alias("ids"))
    apart = linked.join(_small(m.selectExpr("s AS x", "ids AS i"), n_copies), "x", "left").join(_small(m.selectExpr("s AS y", "ids AS j"), n_copies), "y", "left")
    all_of = lambda s, ids: F.explode(F.concat(F.array(s), F.coalesce(ids, F.array().cast("array<bigint>"))))
    apart = apart.select("y", "j", "c", "both", all_of(F.col("x"), F.col("i")).alias("i")).select("i", "c", "both", all_of(F.col("y"), F.col("j")).alias("j"))
    apart = apart.select(F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), jaccard.alias("jaccard"))
    again = copies.selectExpr("s", "doc_id AS y")
    same = of.selectExpr("s", "doc_id AS x").join(_small(again, n_copies), "s").where("x < y").select("x", "y", F.lit(1.0).alias("jaccard"))
    return apart.unionByName(same)

"""Exact similarity join on word shingles, answered as components, that skips by set relations.

* Sets that are equal are one node, named by a 64-bit hash of the set, so copies cost a row each and nothing more.
* Answers from similar sets: nodes with the same smallest shingle (then: under other hashes, one node a component) are read in the order of their sizes beside
  a few leading sets; one that is similar to a leader takes over the leader's component. Links that these answers imply
  are never looked for again.
* Index with skipping: every node is listed under its rarest shingles, so many that two similar nodes share a list. Lists are
  in the order of sizes, with positions; a pair is skipped when its sizes or the two positions leave no room for the
  overlap needed, and a whole list is skipped when its nodes are of one component already.
* What remains are pairs across components. Counts of shingles by 256 classes bound their overlap from above, then three
  bytes of each shingle in a quarter of the classes do; only pairs that pass have their sets compared.

The order of shingles is by hash, with those last that batches of documents repeat most; any order gives the same links,
so the bound on that table (``MOST_COMMON``) is one of size only. No step sends all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .kernel import BLANK_CLASSES, flat, mix64, ngrams, small_batches, tokens
from .runs import split_join
from .store import drop, saved

#: Entries of the table of common shingles that goes to all executors: 24 MB at most.
MOST_COMMON = 2_000_000
#: Shingles of one count for that table, and how often one must be repeated in it.
COUNTED, REPEATED = 1 << 21, 2
#: Seeds of the hashes whose smallest value is a further key of a set.
SEEDS = (0x1234567, 0x89ABCDE, 0xF012345)
#: Lists up to this length give their pairs at once; longer ones first learn their nodes' components.
SHORT = 6
#: Nodes that share their smallest shingle are dealt over tasks by this number; leaders held while reading them.
SHARE, LEADERS = 2000, 16
#: Ids that may be broadcast (8 bytes each).
BROADCAST_IDS = 500_000


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct 56-bit hashes of the n-word shingles of each text; shorter texts have one of all their words."""
    h, first = tokens(*flat(column), BLANK_CLASSES)
    g, out, cut = ngrams(h, n) >> np.uint64(8), [], np.uint64(8)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        out.append(np.unique(g[a : b - n + 1]) if b - a >= n else (ngrams(h[a:b], b - a) + np.uint64(b - a)) >> cut if b > a else g[:0])
    return out


def _pack(u: np.ndarray) -> bytes:
    """The seven low bytes of each hash."""
    return np.ascontiguousarray(u.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(b, np.uint8).reshape(-1, 7)
    return out.view("<u8").ravel()


def signature(u: np.ndarray) -> int:
    m = mix64(u + np.uint64(0xA0761D6478BD642F))
    both = np.array([np.bitwise_xor.reduce(m), np.add.reduce(m), len(u)], np.uint64)
    return int(ngrams(both, 3).astype(np.int64)[0])


def _histogram(u: np.ndarray) -> bytes | None:
    counts = np.bincount((u >> np.uint64(20)).astype(np.int64) & 255, minlength=256)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def _needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Smallest overlap with 100 * overlap >= percent * union."""
    return -(-(percent * (a + b)) // (100 + percent))


NODE = "doc_id long, sig long, n long, keys array<long>, hist binary, common binary"


def _describe(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("sig", pa.int64()), ("n", pa.int64()), ("keys", pa.list_(pa.int64())), ("hist", pa.binary()), ("common", pa.binary())])
        held, size, seen = [], 0, set()

        def common() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            some = c >= REPEATED
            table = np.rec.fromarrays([h[some], c[some].astype(np.int64)]).tobytes()
            return pa.RecordBatch.from_pylist([{"common": table}], schema)

        for batch in batches:
            rows = []
            for doc, u in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), n), strict=True):
                if not len(u):
                    rows.append({"doc_id": doc, "n": 0})
                    continue
                sig = signature(u)
                rows.append({"doc_id": doc, "sig": sig, "n": len(u), "keys": [int(u[:1].astype(np.int64)[0]), *(int(mix64(u ^ np.uint64(x)).min().astype(np.int64)) for x in SEEDS)], "hist": _histogram(u)})
                if sig not in seen:
                    seen.add(sig)
                    held.append(u)
                    size += len(u)
            yield pa.RecordBatch.from_pylist(rows, schema)
            if size >= COUNTED:
                yield common()
                held, size, seen = [], 0, set()
        if held:
            yield common()
    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in batch.column(0).to_pylist():
            t = np.frombuffer(b, np.dtype([("h", np.uint64), ("c", np.int64)]))
            yield pa.RecordBatch.from_arrays([pa.array(t["h"].astype(np.int64)), pa.array(t["c"])], names=["h", "c"])


def _most_common(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of the shingles that batches repeat most: as many whole classes of like counts as
    ``MOST_COMMON`` holds. The driver never sorts them and gets no other rows than these."""
    packed = rows.where("common is not null").select("common").mapInArrow(_unpacked, "h long, c long")
    counted = saved(packed.groupBy("h").agg(F.sum("c").alias("c")).withColumn("level", F.floor(4 * F.log2("c"))), "counted")
    cut, room = None, MOST_COMMON
    for level, size in counted.groupBy("level").agg(F.count("*")).orderBy(F.desc("level")).collect():  # at most 252 rows
        room -= size
        if room < 0:
            break
        cut = level
    table = counted.where(F.col("level") >= F.lit(cut)).select("h", F.least("c", F.lit((1 << 31) - 1)).cast("int").alias("c")).toArrow()
    drop(counted)
    hashes, counts = table["h"].to_numpy().view(np.uint64), table["c"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def _only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows with these ids (one column); the ids go to all executors if there are few enough."""
    ids = saved(ids.distinct(), "ids")
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, ids.columns[0], "left_semi")


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [u for u in shingle_sets(batch.column(1), n) if len(u)]
            yield pa.RecordBatch.from_arrays([pa.array([signature(u) for u in sets], pa.int64()), pa.array([_pack(u) for u in sets], pa.binary())], names=["sig", "elements"])
    return run


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1])) >= int(_needed(np.int64(len(a)), np.int64(len(b)), percent))


def _follow(percent: int):
    """Sets in the order of (key, part, size): links to leaders, and the leaders themselves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leaders = None, []
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key1", pa.int64()), ("elements", pa.binary())])
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if (row["key1"], row["part"]) != now:
                    now, leaders = (row["key1"], row["part"]), []
                u = _unpack(row["elements"])
                for k, (sig, v) in enumerate(leaders):
                    if sig == row["sig"] or _similar(u, v, percent):
                        if sig != row["sig"]:
                            out.append({"a": row["sig"], "b": sig, "key1": row["key1"]})
                        leaders.insert(0, leaders.pop(k))
                        break
                else:
                    leaders.insert(0, (row["sig"], u))
                    del leaders[LEADERS:]
                    if row["parts"] > 1:  # leaders of a divided group meet again
                        out.append({"a": row["sig"], "b": row["sig"], "key1": row["key1"], "elements": row["elements"]})
            yield pa.RecordBatch.from_pylist(out, schema)
    return run


#: A list is named by its bucket and 32 bits of its shingle: lists that share a name are read as one, which adds pairs to
#: compare and no links.
POSTING = np.dtype([("h", np.uint64), ("doc", np.uint16), ("pos", np.uint16)])
OWNER = np.dtype([("sig", np.int64), ("n", np.int32)])


def _lists(n: int, percent: int, hashes: np.ndarray, counts: np.ndarray, buckets: int):
    """Each node's postings under its rarest shingles, packed by bucket with the table of their owners."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, parts, seen = [], [], set()
            for u in shingle_sets(batch.column(0), n):
                if not len(u) or (sig := signature(u)) in seen:
                    continue
                seen.add(sig)
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, u), len(hashes) - 1)
                    late = np.where(hashes[at] == u, counts[at], 0)
                    u = u[np.argsort(late, kind="stable")]
                whole = len(u)
                u = u[: whole - -(-percent * whole // 100) + 1]
                p = np.empty(len(u), POSTING)
                p["h"], p["doc"], p["pos"] = u, len(owners), np.minimum(np.arange(len(u)), 65535)
                owners.append((sig, whole))
                parts.append(p)
            if not parts:
                continue
            table, all_p = np.array(owners, OWNER), np.concatenate(parts)
            b = (all_p["h"] >> np.uint64(3)) % np.uint64(buckets)
            order = np.argsort(b, kind="stable")
            all_p, b = all_p[order], b[order]
            cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1], True])
            names, blobs, tables = [], [], []
            for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                some, doc = np.unique(all_p["doc"][x:y], return_inverse=True)
                p = all_p[x:y].copy()
                p["doc"] = doc
                names.append(int(b[x]))
                blobs.append((p["h"] >> np.uint64(16)).astype(np.uint32).tobytes() + p["doc"].tobytes() + p["pos"].tobytes())
                tables.append(table["sig"][some].tobytes() + table["n"][some].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary()), pa.array(tables, pa.binary())], names=["bucket", "postings", "owners"])
    return run


def _joined(percent: int):
    """Lists of a bucket at a time: pairs of short lists, and the entries of long ones."""
    schema = pa.schema([("h", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("pos", pa.int64())])

    def of(bucket: int, blobs: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        hs, sigs, ns, poss = [], [], [], []
        for p, o in blobs:
            k, m = len(p) // 8, len(o) // 12
            h, doc, pos = np.frombuffer(p, np.uint32, k), np.frombuffer(p, np.uint16, k, 4 * k), np.frombuffer(p, np.uint16, k, 6 * k)
            hs.append(h)
            sigs.append(np.frombuffer(o, np.int64, m)[doc])
            ns.append(np.frombuffer(o, np.int32, m, 8 * m)[doc])
            poss.append(pos)
        h, sig, n, pos = np.concatenate(hs), np.concatenate(sigs), np.concatenate(ns).astype(np.int64), np.concatenate(poss).astype(np.int64)
        order = np.argsort(h, kind="stable")
        run = np.r_[False, h[order][1:] == h[order][:-1]]
        order = order[run | np.r_[run[1:], False]]  # lists of two entries or more
        order = order[np.lexsort((pos[order], sig[order], n[order], h[order]))]  # a node's first position counts
        h, sig, n, pos = h[order], sig[order], n[order], pos[order]
        if not len(h):
            return
        new = np.r_[True, (h[1:] != h[:-1]) | (sig[1:] != sig[:-1])]
        h, sig, n, pos = h[new], sig[new], n[new], pos[new]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        length = np.diff(np.r_[first, len(h)])
        pairs = set()
        for g in range(2, SHORT + 1):
            starts = first[length == g]
            for i in range(g):
                for j in range(i + 1, g):
                    x, y = starts + i, starts + j
                    ok = _room(n[x], pos[x], n[y], pos[y], percent)
                    lo, hi = np.minimum(sig[x[ok]], sig[y[ok]]), np.maximum(sig[x[ok]], sig[y[ok]])
                    pairs.update(zip(lo.tolist(), hi.tolist(), strict=True))
        if pairs:
            a, b = zip(*pairs, strict=True)
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(a, pa.int64()), pa.array(b, pa.int64()), none, none], schema=schema)
        long = np.repeat(length > SHORT, length)
        if long.any():
            yield pa.RecordBatch.from_arrays([pa.array(h[long].astype(np.int64) + (bucket << 32)), pa.array(sig[long]), pa.nulls(int(long.sum()), pa.int64()), pa.array(n[long]), pa.array(pos[long])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            for k, p, o in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if k != now and blobs:
                    yield from of(now, blobs)
                    blobs = []
                now = k
                blobs.append((p, o))
        if blobs:
            yield from of(now, blobs)
    return run


def _room(n1: np.ndarray, p1: np.ndarray, n2: np.ndarray, p2: np.ndarray, percent: int) -> np.ndarray:
    """Whether a pair whose first shared shingle stands at these positions can overlap enough."""
    return (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)) & (np.minimum(n1 - p1, n2 - p2) >= _needed(n1, n2, percent))


def _across(percent: int, nearest: bool):
    """Long lists in the order (h, n): pairs of nodes of different components that sizes and positions leave possible; or
    each node's next such partner only."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def of(rows: list) -> Iterator[pa.RecordBatch]:
        sig, n, pos, comp = (np.concatenate([r[c] for r in rows]) for c in range(4))
        # Class counts; a set without them is not bounded by them.
        bare = np.array([x is None for r in rows for x in r[4]])
        hist = np.array([np.frombuffer(x, np.uint8) if x is not None else np.zeros(256, np.uint8) for r in rows for x in r[4]])
        near = []
        for i in range(len(sig) - 1):
            upto = int(np.searchsorted(n, n[i] * 100 // percent, "right"))
            j = np.arange(i + 1, upto)
            j = j[comp[j] != comp[i]]
            j = j[_room(np.full(len(j), n[i]), np.full(len(j), pos[i]), n[j], pos[j], percent)]
            j = j[bare[i] | bare[j] | (np.minimum(hist[j], hist[i]).sum(1, dtype=np.int64) >= _needed(n[j], n[i], percent))][: 1 if nearest else None]
            if len(j) and nearest:
                near.append((min(sig[j[0]], sig[i]), max(sig[j[0]], sig[i])))
            elif len(j):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(sig[j], sig[i])), pa.array(np.maximum(sig[j], sig[i]))], schema=schema)
        if near:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*near, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            h, *rest = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(6))
            cut = np.flatnonzero(np.r_[True, h[1:] != h[:-1], True]) if len(h) else np.zeros(0, int)
            for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if h[x] != now and held:
                    yield from of(held)
                    held = []
                now = h[x]
                held.append([c[x:y] for c in rest])
        if held:
            yield from of(held)
    return run


def _bounded(percent: int):
    """Pairs whose class counts leave room for the overlap needed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n1, n2 = (batch.column(c).to_numpy() for c in (2, 3))
            keep = np.zeros(len(n1), bool)
            need = _needed(n1, n2, percent)
            for i, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                keep[i] = x is None or y is None or int(np.minimum(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)).sum()) >= need[i]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))
    return run


def _slice(u: np.ndarray) -> np.ndarray:
    """Three low bytes of the elements in a quarter of the classes, ascending; equal elements stay equal."""
    return np.sort((u[(u >> np.uint64(26)) & np.uint64(3) == 0] & np.uint64(0xFFFFFF)).astype("<u4"))


def _slices(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [u for u in shingle_sets(batch.column(1), n) if len(u)]
            packed = [_slice(u).view(np.uint8).reshape(-1, 4)[:, :3].tobytes() for u in sets]
            yield pa.RecordBatch.from_arrays([pa.array([signature(u) for u in sets], pa.int64()), pa.array([len(u) for u in sets], pa.int64()),
                                              pa.array([_histogram(u) for u in sets], pa.binary()), pa.array(packed, pa.binary())], names=["sig", "n", "hist", "slice"])
    return run


def _within_slices(percent: int):
    """Pairs that can still overlap enough: what their slices share at most, and what the other classes leave room for."""
    def wide(b: bytes) -> np.ndarray:
        out = np.zeros((len(b) // 3, 4), np.uint8)
        out[:, :3] = np.frombuffer(b, np.uint8).reshape(-1, 3)
        return out.view("<u4").ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n1, n2, x, y, s, t in zip(*(batch.column(c).to_pylist() for c in range(2, 8)), strict=True):
                both = np.concatenate((wide(s), wide(t)))
                both.sort(kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                if x is None or y is None:
                    rest = min(n1 - len(s) // 3, n2 - len(t) // 3)
                else:
                    rest = int(np.minimum(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8))[64:].sum(dtype=np.int64))
                keep.append(shared + rest >= int(_needed(np.int64(n1), np.int64(n2), percent)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _compared(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [_similar(_unpack(x), _unpack(y), percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run


def _led(docs: DataFrame, keyed: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) of nodes (sig, n, doc_id, key1) to leaders of the same key. Large groups are divided, and leaders of their
    parts meet again. Keys with the same sets are one group."""
    groups = keyed.groupBy("key1").agg(F.count("*").alias("size"), F.min("sig").alias("least"), F.bit_xor(F.xxhash64("sig")).alias("all")).where("size > 1")
    groups = groups.groupBy("size", "least", "all").agg(F.min("key1").alias("key1"))
    parts = F.ceil(F.col("size") / SHARE)
    grouped = saved(keyed.join(groups, "key1").select("sig", "n", "key1", "doc_id", parts.alias("parts"), F.pmod("sig", parts).alias("part")), "grouped")
    sets = _only(docs, grouped.select("doc_id")).mapInArrow(_sets(words), "sig long, elements binary")
    sets = sets.join(grouped.drop("doc_id"), "sig").repartition("key1", "part").sortWithinPartitions("key1", "part", "n", "sig")
    schema = "a long, b long, key1 long, elements binary"
    first = saved(sets.select("sig", "key1", "part", "parts", "elements").mapInArrow(_follow(percent), schema), "followed")
    again = first.where("elements is not null").select(F.col("a").alias("sig"), "key1", F.lit(0).cast("long").alias("part"), F.lit(1).cast("long").alias("parts"), "elements")
    again = again.repartition("key1").sortWithinPartitions("key1", F.length("elements"), "sig").mapInArrow(_follow(percent), schema)
    return first.where("elements is null").select("a", "b").unionByName(again.select("a", "b"))


def _verified(docs: DataFrame, nodes: DataFrame, comps: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of different components that are links: bounded by class counts, then compared."""
    side = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}"))
    pairs = pairs.distinct().join(side("a"), "a", "left").join(side("b"), "b", "left")
    pairs = saved(pairs.where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select("a", "b"), "pairs-across")
    if pairs.isEmpty():
        return pairs
    both = lambda p: p.select(F.col("a").alias("sig")).unionByName(p.select(F.col("b").alias("sig"))).distinct()
    hist = saved(nodes.join(both(pairs), "sig", "left_semi").select("sig", "n", "hist"), "classes")
    of = lambda c: hist.select(F.col("sig").alias(c), F.col("n").alias(f"n_{c}"), F.col("hist").alias(f"hist_{c}"))
    left = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "n_b", "hist_a", "hist_b")
    left = saved(left.mapInArrow(_bounded(percent), "a long, b long"), "pairs-left")
    drop(pairs, hist)
    if left.isEmpty():
        return left
    ids = nodes.join(both(left), "sig", "left_semi").select("doc_id")
    slices = saved(_only(docs, ids).mapInArrow(_slices(words), "sig long, n long, hist binary, slice binary"), "slices")
    of = lambda c: slices.select(F.col("sig").alias(c), F.col("n").alias(f"n_{c}"), F.col("hist").alias(f"hist_{c}"), F.col("slice").alias(f"slice_{c}"))
    close = left.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "n_b", "hist_a", "hist_b", "slice_a", "slice_b")
    close = saved(close.mapInArrow(_within_slices(percent), "a long, b long"), "pairs-close")
    drop(left, slices)
    left = close
    if left.isEmpty():
        return left
    ids = nodes.join(both(left), "sig", "left_semi").select("doc_id")
    sets = saved(_only(docs, ids).mapInArrow(_sets(words), "sig long, elements binary"), "sets-left")
    of = lambda c: sets.select(F.col("sig").alias(c), F.col("elements").alias(f"elements_{c}"))
    more = left.join(of("a"), "a").join(of("b"), "b").select("a", "b", "elements_a", "elements_b").mapInArrow(_compared(percent), "a long, b long")
    more = saved(more, "verified-links")
    drop(left, sets)
    return more


def similar_components(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id that links reach).

    Words are runs of characters other than ASCII blanks, A-Z lower-cased. A text's set are its distinct shingles of
    ``words`` words; one with fewer words has a single shingle of them all; null, empty and blank texts have none and are alone.
    Two rows are linked when 100 * intersection >= ``percent`` * union. Repeated rows are copies like others; null ids never
    name a component that has others. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = saved(docs.mapInArrow(_describe(words), NODE), "shingled")
    hashes, counts = _most_common(rows)
    described = rows.where("common is null").drop("common")
    nodes = saved(
        described.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.first("keys").alias("keys"), F.first("hist").alias("hist")), "nodes")

    # Components from sets that share their smallest shingle, then from those of different components that share another key.
    keyed = nodes.select("sig", "n", "doc_id", F.posexplode("keys").alias("k", "key1"))
    links = saved(_led(docs, keyed.where("k = 0").drop("k"), words, percent), "first-links")
    comps = saved(components(links), "first-components")
    keyed = keyed.where("k > 0").withColumn("key1", F.xxhash64("k", "key1")).drop("k")
    keyed = keyed.join(comps.withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    one = keyed.groupBy("key1", "comp").agg(F.min("sig").alias("sig"))  # one set stands for its component
    more = saved(_led(docs, keyed.drop("comp").join(one.select("key1", "sig"), ["key1", "sig"]), words, percent), "first-links")
    comps = saved(components(more.unionByName(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")))), "first-components")

    # Pairs across components, from the lists of rarest shingles.
    total = nodes.agg(F.sum("n")).first()[0] or 0
    buckets = max(24, int(total * (100 - percent) / 100) // 1_000_000)
    lists = docs.select("text").mapInArrow(_lists(words, percent, hashes, counts, buckets), "bucket long, postings binary, owners binary")
    lists = lists.repartition(min(buckets, 100_000), "bucket").sortWithinPartitions("bucket")
    found = saved(lists.mapInArrow(_joined(percent), "h long, a long, b long, n long, pos long"), "list-pairs")
    member = saved(found.where("h is not null").select("h", F.col("a").alias("sig"), "n", "pos"), "long-lists")
    # First the pairs of short lists and each node's nearest partner in long ones; most components meet by these, and
    # what they imply is left out when all remaining pairs of the long lists are looked at.
    short = found.where("h is null").select("a", "b")
    classes, moved = None, True
    for nearest in (True, True, False):
        if nearest and not moved:  # the same components leave every node the same nearest partner
            continue
        within = member.join(comps.withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
        mixed = within.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("h")
        # Components only grow, so a list of one component is never mixed again.
        mixed = saved(within.join(mixed, "h", "left_semi"), "mixed-lists")
        drop(member)
        member = mixed.drop("comp")
        member.saved_path = mixed.saved_path
        if short is None and mixed.isEmpty():
            break
        if classes is None:
            classes = saved(_only(nodes.select("sig", "hist"), member.select("sig")), "list-classes")
        across = mixed.join(classes, "sig").repartition("h").sortWithinPartitions("h", "n").select("h", "sig", "n", "pos", "comp", "hist")
        pairs = across.mapInArrow(_across(percent, nearest), "a long, b long")
        pairs = pairs if short is None else pairs.unionByName(short)
        short = None
        links = _verified(docs, nodes, comps, pairs, words, percent)
        moved = not links.isEmpty()
        if moved:
            comps = saved(components(links.unionByName(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")))), "components")
    drop(found, member, classes)

    small = described.select("doc_id", "sig", "n").join(comps.withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    names = small.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("least"), F.count("*").alias("members"))
    out = split_join(small, names, "comp", "members", rows.count(), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))
    out = saved(out, "similar")
    drop(rows, nodes, comps)
    return out

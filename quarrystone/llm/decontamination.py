"""Benchmark decontamination with a positional inverted index of the training tokens.

``build_index`` turns runs of documents into segments: for each term its sorted token positions, with the places
where documents begin. A segment is a row of a Parquet table in the shared folder, built without a shuffle, so the index
is split by documents and every further benchmark can be held against it. ``find`` sends the benchmark's windows to all
segments. In a segment, a window with an unknown term ends at once; else the list of its rarest term gives the
candidates, shifted by that term's offset, which are intersected with the lists of the other terms, rarest first.
Windows are tried in groups that bound the candidates held at once; equal windows of several items are sought once. The benchmark
itself goes out in blocks of at most ``BLOCK_CHARS`` characters (an item that is longer is a block by itself).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import WORD_CLASSES, flat, small_batches, tokens
from .store import drop, saved

#: Tokens of a segment (a longer document is a segment by itself) and candidates held at once.
SEGMENT, CANDIDATES = 1 << 20, 1 << 20
#: Characters of the items that are sent at once, some 15 bytes a character as windows.
BLOCK_CHARS = 8 << 20
INDEX = "segment long, doc_ids array<long>, starts binary, terms binary, ptr binary, pos binary"


def _segment(number: int, ids: list, counts: list[int], hashes: list[np.ndarray]) -> dict:
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    order = np.argsort(h, kind="stable").astype(np.int32)
    ordered = h[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(h) else np.zeros(0, np.int64)
    starts = np.r_[0, np.cumsum(counts)].astype(np.int64)
    return {"segment": number, "doc_ids": ids, "starts": starts.tobytes(), "terms": ordered[first].tobytes(), "ptr": np.r_[first, len(h)].astype(np.int64).tobytes(), "pos": order.tobytes()}


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("segment", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("starts", "terms", "ptr", "pos")]])
    ids, counts, hashes, held = [], [], [], 0
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        h, first = tokens(*flat(batch.column(1)), WORD_CLASSES)
        names, at = batch.column(0).to_pylist(), 0
        while at < len(names):  # as many rows as still fit
            upto = max(at + 1, int(np.searchsorted(first, first[at] + SEGMENT - held, "right")) - 1)
            upto = min(upto, len(names))
            ids += names[at:upto]
            counts += np.diff(first[at : upto + 1]).tolist()
            hashes.append(h[first[at] : first[upto]])
            held += int(first[upto] - first[at])
            at = upto
            if held >= SEGMENT or at < len(names):
                yield pa.RecordBatch.from_pylist([_segment(number, ids, counts, hashes)], schema)
                ids, counts, hashes, held = [], [], [], 0
                number += 1
    if ids:
        yield pa.RecordBatch.from_pylist([_segment(number, ids, counts, hashes)], schema)


def build_index(docs: DataFrame) -> DataFrame:
    """Segments of ``docs`` (doc_id, text; null is empty), written to the shared folder."""
    small_batches(docs.sparkSession)
    return saved(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_segments, INDEX), "positional-index")


class Windows:
    """The distinct windows of items (item_id, text): their lengths, term hashes padded to ``size``, and the items of each."""

    def __init__(self, items: list[tuple], size: int) -> None:
        h, first = tokens(*flat(pa.array([t for _, t in items], pa.string())), WORD_CLASSES)
        n = np.diff(first)
        row = np.repeat(np.arange(len(items)), n)
        start = np.flatnonzero(np.arange(len(h)) + size <= first[1:][row])
        short = np.flatnonzero((n > 0) & (n < size))
        item = np.r_[row[start], short]
        table = np.zeros((len(item), size + 1), np.uint64)  # the first column is the length
        table[: len(start), 0], table[len(start) :, 0] = size, n[short]
        if len(start):
            table[: len(start), 1:] = np.lib.stride_tricks.sliding_window_view(h, size)[start]
        for k, i in enumerate(short.tolist()):
            table[len(start) + k, 1 : n[i] + 1] = h[first[i] : first[i + 1]]
        table, of = np.unique(table, axis=0, return_inverse=True)
        order = np.argsort(of.ravel(), kind="stable")
        self.length, self.rows = table[:, 0].astype(np.int64), np.ascontiguousarray(table[:, 1:])
        self.item, self.ptr = item[order], np.searchsorted(of.ravel()[order], np.arange(len(table) + 1))
        self.names = [i for i, _ in items]

    def items(self, w: int) -> set:
        return {self.names[i] for i in self.item[self.ptr[w] : self.ptr[w + 1]].tolist()}


class Segment:
    def __init__(self, row: dict) -> None:
        self.ids = row["doc_ids"]
        self.starts, self.terms, self.ptr, self.pos = (np.frombuffer(row[c], t) for c, t in (("starts", np.int64), ("terms", np.uint64), ("ptr", np.int64), ("pos", np.int32)))
        self.n = len(self.pos)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Term numbers in this segment, -1 for unknown ones."""
        if not len(self.terms):
            return np.full(hashes.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def doc_of(self, pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, pos, "right") - 1

    def phrases(self, length: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, first position) of every exact occurrence within one document."""
        t = self.numbers(rows)
        used = np.arange(rows.shape[1]) < length[:, None]
        alive = np.flatnonzero(((t >= 0) | ~used).all(1))
        if not len(alive):
            return alive, alive
        t, used, length = t[alive], used[alive], length[alive]
        freq = np.where(used, np.diff(self.ptr)[np.maximum(t, 0)], np.iinfo(np.int64).max)
        order = np.argsort(freq, 1, kind="stable")
        least = np.take_along_axis(freq, order[:, :1], 1)[:, 0]
        at = np.empty(self.n, np.int32)  # term at each position: membership in a shifted list is one look
        at[self.pos] = np.repeat(np.arange(len(self.terms), dtype=np.int32), np.diff(self.ptr))
        found_w, found_p, a = [], [], 0
        total = np.cumsum(least)
        while a < len(alive):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + CANDIDATES, "right")))
            k = least[a:b]
            w = np.repeat(np.arange(a, b), k)
            anchor = order[w, 0]
            inner = np.arange(len(w)) - np.repeat(np.cumsum(k) - k, k)
            p = self.pos[self.ptr[t[w, anchor]] + inner].astype(np.int64) - anchor
            ok = (p >= 0) & (p + length[w] <= self.n)
            w, p = w[ok], p[ok]
            ok = self.doc_of(p) == self.doc_of(p + length[w] - 1)
            w, p = w[ok], p[ok]
            for j in range(1, rows.shape[1]):
                off = order[w, j]
                ok = ~used[w, off]
                ok[~ok] = at[(p + off)[~ok]] == t[w, off][~ok]
                w, p = w[ok], p[ok]
                if not len(w):
                    break
            found_w.append(alive[w])
            found_p.append(p)
            a = b
        return np.concatenate(found_w), np.concatenate(found_p)

    def near(self, words: np.ndarray, slop: int) -> list[tuple[int, int]]:
        """(first, last) position of spans of at most len(words) + slop tokens of one document that hold all the words:
        for each place of the rarest word as an inner point, the first such span from the left, if any.
        """
        t = self.numbers(np.unique(words))
        if not len(t) or (t < 0).any():
            return []
        lists = sorted((self.pos[self.ptr[x] : self.ptr[x + 1]] for x in t), key=len)
        span, out = len(words) + slop, set()
        for p in lists[0].tolist():
            doc = int(self.doc_of(np.array([p]))[0])
            low, high = int(self.starts[doc]), int(self.starts[doc + 1])
            for left in range(max(low, p - span + 1), p + 1):
                ends = [int(x[k]) if (k := np.searchsorted(x, left)) < len(x) else high for x in lists]
                if max(ends) < min(high, left + span):
                    out.add((min(ends), max(ends)))
                    break
        return sorted(out)


def _search(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("segment", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64())), ("spans", pa.list_(pa.int64()))])
        windows = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                seg = Segment(row)
                w, p = seg.phrases(windows.length, windows.rows)
                n = windows.length[w]
                edge = np.bincount(p, minlength=seg.n + 1) - np.bincount(p + n, minlength=seg.n + 1)
                hit = np.r_[0, np.cumsum(np.cumsum(edge[:-1]) > 0)]
                n_hit = hit[seg.starts[1:]] - hit[seg.starts[:-1]]
                found: dict[int, set] = {}
                spans: dict[int, list] = {}
                doc = seg.doc_of(p)
                for d, k in np.unique(np.stack([doc, w]), axis=1).T.tolist():
                    found.setdefault(d, set()).update(windows.items(k))
                for d, x in zip(doc.tolist(), ((p - seg.starts[doc]) * 1_000_000 + n).tolist(), strict=True):
                    spans.setdefault(d, []).append(x)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["segment"]] * len(seg.ids), pa.int64()), pa.array(range(len(seg.ids)), pa.int64()), pa.array(seg.ids, pa.int64()), pa.array(np.diff(seg.starts)), pa.array(n_hit),
                    pa.array([sorted(found.get(d, ()), key=str) for d in range(len(seg.ids))], schema.field(5).type),
                    pa.array([sorted(spans.get(d, ())) for d in range(len(seg.ids))], schema.field(6).type)], schema=schema)
    return run


def find(index: DataFrame, benchmark: DataFrame, size: int = 10, block_chars: int = BLOCK_CHARS) -> list[DataFrame]:
    """A DataFrame for each block of items: a row per document with segment and row (its place
    in the index), doc_id, n_words, n_hit, items (those with occurring windows) and spans (start * 1,000,000 + length of each occurrence, in words).

    Items are read a partition at a time and go out as soon as a block is full.
    """
    spark = index.sparkSession
    small_batches(spark, 4)
    out, block, chars = [], [], 0

    def send() -> None:
        sent = spark.sparkContext.broadcast(Windows(block, size))
        out.append(index.mapInArrow(_search(sent), "segment long, row long, doc_id long, n_words long, n_hit long, items array<long>, spans array<long>"))

    for r in benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).toLocalIterator():
        if block and chars + len(r.text) > block_chars:
            send()
            block, chars = [], 0
        block.append((r.item_id, r.text))
        chars += len(r.text)
    send()
    return out


def find_near(index: DataFrame, phrases: list[tuple[int, str]], slop: int = 5) -> DataFrame:
    """(doc_id, item_id, first, last): words of each phrase, in any order, within its length plus ``slop`` tokens."""
    h, at = tokens(*flat(pa.array([t for _, t in phrases], pa.string())), WORD_CLASSES)
    small_batches(index.sparkSession, 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "item_id", "first", "last")])
        for batch in batches:
            for row in batch.to_pylist():
                seg, out = Segment(row), []
                for i, (name, _) in enumerate(phrases):
                    for a, b in seg.near(h[at[i] : at[i + 1]], slop):
                        d = int(seg.doc_of(np.array([a]))[0])
                        out.append({"doc_id": seg.ids[d], "item_id": name, "first": a - int(seg.starts[d]), "last": b - int(seg.starts[d])})
                yield pa.RecordBatch.from_pylist(out, schema)

    return index.mapInArrow(run, "doc_id long, item_id long, first long, last long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_words, n_hit, items, contaminated.

    Words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased. A window is ``size``
    consecutive words of an item; a shorter item that has words is one window. A word of a document inside any occurrence
    of a window is hit. Null and empty texts, of documents or items, have no words; items without an id only count
    for hits. Repeated items and repeated rows count each by itself; other columns are ignored; an empty table on either side
    gives no hits or no rows.
    """
    index = build_index(docs)
    parts = find(index, benchmark, size, block_chars)
    if len(parts) == 1:
        out = parts[0]
    else:  # hits of several blocks may overlap, so their spans are added up
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        out = out.groupBy("segment", "row", "doc_id", "n_words").agg(
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
        step = "(acc, x) -> struct(greatest(acc.upto, x div 1000000 + x % 1000000) AS upto, acc.n + greatest(0, x div 1000000 + x % 1000000 - greatest(acc.upto, x div 1000000)) AS n)"
        out = out.withColumn("n_hit", F.expr(f"aggregate(spans, struct(0L AS upto, 0L AS n), {step}, acc -> acc.n)"))
    known = F.filter("items", lambda x: x.isNotNull())
    out = saved(out.select("doc_id", "n_words", "n_hit", F.array_distinct(known).alias("items"), (F.col("n_hit") > 0).alias("contaminated")), "decontaminated")
    drop(index)
    return out

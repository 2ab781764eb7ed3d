"""Operator 5: documents that hold a benchmark item, by SimHash of item-sized windows.

Words are runs of letters and digits after lower-casing A-Z.  A window is as many consecutive words of a
document as the item has (a shorter document is one window).  Its weighted shingles are the 5-word shingles
with their multiplicities; fewer than five words are one shingle.  The SimHash of the weighted shingles has 64
bits.  A multi-index over 8 blocks of 8 bits finds all items of the window's length within `radius` bits: of
two fingerprints that differ in at most `radius` bits, some block differs in at most radius // 8.  For each
candidate the exact similarity, the sum of the lower multiplicities over the sum of the higher ones, decides.

Windows that can't reach the similarity with any item (too few of their shingles occur in the benchmark at
all, by a running count) need no fingerprint; this loses nothing.

At the default similarity 0.8 the expected distance of two fingerprints is under 10 bits with a standard deviation
under 3, so that radius 20 leaves out about 2 in 10,000 pairs that are just similar enough, and fewer of the others.

The benchmark goes to all executors only in slices of about `max_items` items and `max_bytes` bytes of text, repeated
items included; a larger one takes several passes over the documents, one slice and its index at a time.

Defined results: null or wordless texts and items match nothing; null ids are kept as null; repeated rows give
repeated rows; repeated items each match; of windows with one similarity the first is reported; texts of any length are
read whole, 4,096 windows at a time; an empty table on either side gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import bytes_of, frugal, id_text, slices
from strandline.llm.shingles import shingle_hashes
from strandline.storage import drop_written, written

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 20
MAX_ITEMS, MAX_BYTES = 20_000, 16 << 20
BLOCKS = 8
#: Windows are looked up so many at a time that they meet at most about so many items in a list.
CANDIDATES = 1 << 20
_SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
_BLANKS = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().translate(_BLANKS).split()


def _bits(h: np.ndarray) -> np.ndarray:
    """One row of 64 values, 1 or -1, for each hash."""
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def window_fingerprints(h: np.ndarray, starts: np.ndarray, q: int) -> np.ndarray:
    """SimHash of the windows of q shingles at the given starts, as 8 bytes each."""
    sums = np.zeros((len(h) + 1, 64), np.int32)
    np.cumsum(_bits(h), axis=0, out=sums[1:])
    return np.packbits(sums[starts + q] - sums[starts] > 0, axis=1)


def similarity(a: Counter, b: Counter) -> float:
    low = sum((a & b).values())
    return low / (sum(a.values()) + sum(b.values()) - low)


def _expanded(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The numbers from each first up to before its last, one range after the other."""
    many = last - first
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)


class MultiIndex:
    """For each block of the fingerprints and each value of the block, the items whose block lies within reach of it.

    Of two fingerprints within the radius some block differs in at most radius // BLOCKS bits.  An item stands in the lists
    of the values near its own: 37 of 256 in each block at the default radius, so the lists grow with the items only.
    """

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        near = _POPCOUNT[np.arange(256)[:, None] ^ np.arange(256)] <= radius // BLOCKS
        value, close = np.nonzero(near)
        self.lists, self.starts = [], []
        for b in range(BLOCKS):
            order = np.argsort(prints[:, b], kind="stable").astype(np.int32)
            at = np.searchsorted(prints[order, b], np.arange(257))
            self.lists.append(order[_expanded(at[close], at[close + 1])])
            self.starts.append(np.concatenate(([0], np.cumsum(np.bincount(value, weights=at[close + 1] - at[close], minlength=256)))).astype(np.int64))

    def within(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fingerprint asked for, item, bits that differ) of all within the radius, in order."""
        n = len(self.prints)
        keys = []
        for b in range(BLOCKS):
            first, last = self.starts[b][asked[:, b]], self.starts[b][asked[:, b].astype(np.int64) + 1]
            keys.append(np.repeat(np.arange(len(asked)), last - first) * n + self.lists[b][_expanded(first, last)])
        w, i = np.divmod(np.unique(np.concatenate(keys)), n)
        apart = _POPCOUNT[asked[w] ^ self.prints[i]].sum(axis=1, dtype=np.int64)
        hit = apart <= self.radius
        return w[hit], i[hit], apart[hit]


class BenchmarkIndex:
    """Items by their number of words; for each length, fingerprints and the multi-index over their blocks."""

    def __init__(self, items: list[tuple[int | None, bytes | None]], k: int = SHINGLE, least: float = SIMILARITY, radius: int = RADIUS):
        self.k, self.least, self.radius = k, least, radius
        by_length: dict[int, list[tuple[int | None, np.ndarray]]] = {}
        for item_id, text in items:
            words = words_of(text)
            if words:
                by_length.setdefault(len(words), []).append((item_id, shingle_hashes(words, k)))
        self.groups = {}
        known = []
        for length, members in sorted(by_length.items()):
            prints = np.concatenate([window_fingerprints(h, np.array([0]), len(h)) for _, h in members])
            self.groups[length] = ([i for i, _ in members], [Counter(h.tolist()) for _, h in members], prints, MultiIndex(prints, radius))
            known += [h for _, h in members]
        self.known = np.unique(np.concatenate(known)) if known else np.zeros(0, np.uint64)
        # a small bit table rejects most shingles before the search in the sorted array
        self.marks = np.zeros(1 << 20, bool)
        self.marks[(self.known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def occurs(self, h: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.marks[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        out = np.zeros(len(h), bool)
        if len(maybe):
            at = np.searchsorted(self.known, h[maybe])
            at[at == len(self.known)] = 0
            out[maybe] = self.known[at] == h[maybe]
        return out

    def matches(self, text: bytes | None) -> list[tuple[int | None, float, int, int, int]]:
        """(item, similarity, first word, words, bits that differ) of each item that some window matches; its best window, then the first."""
        if not text or not self.groups:
            return []
        words = words_of(text)
        n = len(words)
        if not n:
            return []
        h = shingle_hashes(words, self.k)
        hits = self.occurs(h) if n >= self.k else np.ones(len(h), bool)
        short = {m for m in self.groups if m < self.k}  # their shingle is the whole item
        if not hits.any() and not short:
            return []
        upto = np.concatenate(([0], np.cumsum(hits)))
        found = []
        for m, group in self.groups.items():
            if m in short:
                if n < m:
                    continue
                own, q = shingle_hashes(words, m), 1
                starts = np.flatnonzero(self.occurs(own))
            else:
                own, q = h, min(m - self.k + 1, len(h))
                # similarity t with an item of q0 shingles needs at least t * q0 of the window's among the known ones
                need = math.ceil(self.least * (m - self.k + 1) - 1e-9)
                if upto[-1] < need:
                    continue
                starts = np.flatnonzero(upto[q:] - upto[:-q] >= need)
            if len(starts):
                found += self._verified(own, starts, q, min(m, n), group)
        return found

    def _verified(self, h: np.ndarray, starts: np.ndarray, q: int, width: int, group: tuple) -> list[tuple]:
        ids, counters, _, index = group
        low, high = int(starts[0]), int(starts[-1]) + q
        best: dict[int, tuple] = {}
        piece = max(1, min(4096, CANDIDATES // max(1, len(ids))))
        for begin in range(0, len(starts), piece):
            some = starts[begin : begin + piece]
            own = window_fingerprints(h[low:high], some - low, q)
            window, at = Counter(), -1
            for w, i, bits in zip(*(x.tolist() for x in index.within(own))):
                s = int(some[w])
                if s != at:
                    window, at = Counter(h[s : s + q].tolist()), s
                value = similarity(window, counters[i])
                if value >= self.least - 1e-12 and (i not in best or value > best[i][1]):
                    best[i] = (ids[i], round(value, 6), s, width, bits)
        return list(best.values())


def _slices(benchmark: DataFrame, item_col: str, text_col: str, max_items: int, max_bytes: int) -> Iterator[list[tuple]]:
    """The benchmark in slices that are small enough to send to every executor, read one after the other.

    Items are dealt by a number of their own, so that equal ones are spread like any others.
    """
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    n = max(1, math.ceil(1.5 * max(size["n"] / max_items - 0.33, size["bytes"] / max_bytes - 0.33)))
    numbered = items if n == 1 else written(items.withColumn("_n", F.monotonically_increasing_id()), "items")
    for k in range(n):
        own = items if n == 1 else numbered.where(F.pmod(F.xxhash64("_n"), F.lit(n)) == k)
        yield [(r["item_id"], r["text"].encode()) for r in own.orderBy("item_id", "text").collect()]
    drop_written(numbered)


def decontamination(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE, least: float = SIMILARITY, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_items: int = MAX_ITEMS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words, bits: one row for each document and item that it holds."""
    schema = "doc_id long, item_id long, similarity double, first_word long, n_words long, bits long"
    arrow = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("bits", pa.int64())])

    def over(sent) -> DataFrame:
        @frugal
        def match(batches):
            index = BenchmarkIndex(sent.value, k, least, radius)
            for batch in batches:
                for part in slices(batch):
                    rows = [(i, *m) for i, t in zip(part.column("doc_id").to_pylist(), bytes_of(part)) for m in index.matches(t)]
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), arrow)] if rows else [pa.array([], f.type) for f in arrow], schema=arrow)

        return id_text(docs, id_col, text_col).mapInArrow(match, schema)

    found: list[DataFrame] = []
    for more, sent in _sent(docs, benchmark, item_col, item_text_col, max_items, max_bytes):
        found.append(written(over(sent), "matches") if more or found else over(sent))
    return reduce(DataFrame.unionByName, found)


def _sent(docs: DataFrame, benchmark: DataFrame, *how) -> Iterator[tuple[bool, Broadcast]]:
    """Each slice as a broadcast, and whether another one follows; a slice goes from the executors before the next one comes."""
    slices_ = _slices(benchmark, *how)
    now = next(slices_)
    while now is not None:
        after = next(slices_, None)
        sent = docs.sparkSession.sparkContext.broadcast(now)
        yield after is not None, sent
        if after is not None:
            sent.unpersist()
        now = after


def uncontaminated(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE, least: float = SIMILARITY, radius: int = RADIUS, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_items: int = MAX_ITEMS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The rows whose text holds no item, with all their columns; null texts stay.  One pass for each slice of the benchmark."""
    before = None
    for more, sent in _sent(docs, benchmark, item_col, item_text_col, max_items, max_bytes):
        held: dict[str, BenchmarkIndex] = {}

        @F.pandas_udf("boolean")
        def holds(texts, sent=sent, held=held):
            if "index" not in held:
                held["index"] = BenchmarkIndex(sent.value, k, least, radius)
            return texts.map(lambda t: bool(t) and bool(held["index"].matches(t.encode())))

        docs = docs.where(~F.coalesce(holds(F.col(f"`{text_col}`").cast("string")), F.lit(False)))
        if more:
            docs, last = written(docs, "uncontaminated"), before
            before = docs
            if last is not None:
                drop_written(last)
    return docs

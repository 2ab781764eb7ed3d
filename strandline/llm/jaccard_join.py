"""Operator 7: exact n-gram Jaccard join with set-relation skipping, as components of documents.

A document's set is its distinct k-word shingles (lower-cased A-Z; fewer than k words are one shingle).  Two
documents link when 100 * intersection >= percent * union.

* Equal sets are one class, joined once.
* A set's shingles have one global order: by their count in a sketch over all documents, then by hash.  Sets that
  link share a shingle among the first n - ceil(percent * n / 100) + 1 of either (prefix filter), so index lists
  hold those shingles only, each entry with the set's size, the shingle's position and a 256-bit parity bitmap.
* Index-level skipping: a list is cut into blocks of about one size, each in order of position.  Two sets that link
  have positions within an interval that their sizes give (shingles before and after it), so a probe jumps to the
  first entry of a block within reach, by binary search, leaves it after the last one, and skips blocks out of the
  size bound whole.  Sets that share one of the three listed tokens before this one are left to that token's list, so that
  a pair comes up once or a few times, not once for each token it shares.  What is left must also pass the bitmaps, whose Hamming distance never exceeds the sets' symmetric
  difference.
* Answer-level skipping: the first round verifies all candidates of short lists and a spanning forest of each longer
  list's, most alike first.  Sets linked so far form groups, and the least set of a group is its leader.  Pairs within
  a group need no answer.  For a candidate pair across groups the leaders' answers come first: with the symmetric
  differences d of leader and leader and of leader and member, those of the members lie within
  d(leaders) +- d(first) +- d(second), which settles most pairs, either way, without their sets.  Only pairs that
  this leaves open are verified.

So each link is verified, follows from verified distances, or lies within a group already, and the components are
exact.  A list longer than `chunk` is dealt by a hash of the set in the first round and as a grid of chunk pairs in the
second one, so that no task gets an unbounded list.  The sketch has about as many cells as there are shingles, up to
a bound; beyond it, it still puts shingles last that stand out among the documents.  The filter that spares most sets
the way to their verification grows with what is wanted; beyond its bound the documents are picked by a join.

Defined results: null or wordless texts have an empty set and link with nothing; a null id has a null component and
lends no id to a component; rows with one doc_id each give a row, and their sets join by themselves; ties of the order
go by hash and ties of a component by the smaller doc_id; a text of any length is one set, read whole; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import bytes_of, frugal, id_text, slices
from strandline.llm.shingles import shingle_hashes
from strandline.operators.components import components
from strandline.storage import drop_written, free_shuffles, parallelism, scratch, written

SHINGLE, PERCENT, CHUNK = 5, 80, 4096
#: Least and most cells of the sketch of shingle counts, as powers of two, the ranges in which it is summed, and the bytes of text that a cell stands for.
CELLS, RANGES, CELL_BYTES = (16, 24), 64, 6
#: Lists of at most so many entries are compared pair by pair for many lists at once.
SMALL = 8
#: The listed tokens before an entry's own in its set's prefix: two sets that share one of them meet there.
BEFORE = ("before1", "before2", "before3")
#: Sizes within a block of a list differ by at most this share; pairs are tested so many at a time.
SIZE_STEP, PIECE = 0.02, 1 << 18
#: Least and most bits, as powers of two, of the filter of keys whose sets are wanted, and how many bits a key has.
FILTER, FILTER_HASHES = (16, 26), 3


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    return np.unique(shingle_hashes((text or b"").lower().split(), k))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def bitmap(s: np.ndarray, width: int = 256) -> bytes:
    """Parity bits of a set."""
    return np.packbits(np.bincount((s >> np.uint64(20)).astype(np.int64) & width - 1, minlength=width) & 1).tobytes()


def long_bitmap(s: np.ndarray) -> bytes:
    """Parity bits, as many as the set has members, rounded up to a power of two."""
    return bitmap(s, max(256, 1 << (len(s) - 1).bit_length()))


def least_apart(a: bytes, b: bytes) -> int:
    """A lower bound of two sets' symmetric difference by their long bitmaps; the longer one is folded to the shorter one."""
    x, y = (np.frombuffer(v, np.uint8) for v in (a, b))
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def set_key(s: np.ndarray) -> tuple[int, int]:
    from xxhash import xxh3_128_intdigest

    h = xxh3_128_intdigest(s.tobytes())
    return tuple(int(x) for x in np.array([h >> 64, h & (1 << 64) - 1], np.uint64).view(np.int64))


class Sketch:
    """How many documents hold a shingle of each cell: 2 * log2 of the count, one byte a cell."""

    def __init__(self, bits: int, levels: np.ndarray):
        self.mask, self.levels = np.uint64((1 << bits) - 1), levels

    def order(self, s: np.ndarray) -> np.ndarray:
        """Indices of a set's shingles (sorted by hash) in the global order."""
        return np.argsort(self.levels[(s & self.mask).astype(np.int64)], kind="stable")


def sketch(rows: DataFrame, k: int) -> Sketch:
    """Counted over all documents; tasks send the cells that they saw, and each range of cells is summed as a stream."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(CELLS[1], max(CELLS[0], (size // CELL_BYTES).bit_length()))
    width = (1 << bits) // RANGES
    schema = pa.schema([("part", pa.int32()), ("counts", pa.binary())])

    def packed(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
        raw = [pa.compress(c.tobytes(), codec="zstd", asbytes=True) for c in parts.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array(raw, pa.binary())], schema=schema)

    def unpacked(raw: bytes) -> np.ndarray:
        return np.frombuffer(pa.decompress(raw, 4 * width, codec="zstd", asbytes=True), np.uint32)

    @frugal
    def count(batches):
        counts = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for part in slices(batch):
                seen, times = np.unique(np.concatenate([shingle_set(t, k) for t in bytes_of(part)]) & np.uint64((1 << bits) - 1), return_counts=True)
                counts[seen.astype(np.int64)] += times.astype(np.uint32)
        for r in range(RANGES):
            own = counts[r * width : (r + 1) * width]
            if own.any():
                yield packed({r: own})

    @frugal
    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for r, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "counts"))):
                totals.setdefault(r, np.zeros(width, np.int64))[:] += unpacked(raw)
        levels = {r: np.round(2 * np.log2(np.maximum(1, t))).astype(np.uint8) for r, t in totals.items()}
        if levels:
            yield packed(levels)

    parts = rows.select("text").mapInArrow(count, "part int, counts binary").repartition(min(RANGES, parallelism(rows.sparkSession)), "part").mapInArrow(add, "part int, counts binary").collect()
    out = np.zeros(1 << bits, np.uint8)
    for r in parts:
        out[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(pa.decompress(bytes(r["counts"]), width, codec="zstd", asbytes=True), np.uint8)
    return Sketch(bits, out)


def needed(a, b, percent: int):
    """Least intersection with which sets of these sizes link."""
    return -(-percent * (a + b) // (100 + percent))


class Lists:
    """Candidate pairs of index lists, given as columns sorted by list; `component` says which pairs are settled."""

    def __init__(self, percent: int, forest: bool):
        self.percent, self.forest = percent, forest

    def bound(self, x: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether entries i and j may link, by size, position and bitmap, differ in component (and side, on a grid), and meet in no list just before."""
        a, b, p, q = x["n"][i], x["n"][j], x["pos"][i], x["pos"][j]
        least = needed(a, b, self.percent)
        ok = (x["comp"][i] != x["comp"][j]) & (x["off"][i] | (x["side"][i] != x["side"][j]))
        ok &= np.minimum(p, q) + 1 + np.minimum(a - 1 - p, b - 1 - q) >= least
        # pairs that share one of the tokens just before this one meet in that token's list
        for u in x["before"]:
            for v in x["before"]:
                ok &= (u[i] != v[j]) | (u[i] == 0)
        some = np.flatnonzero(ok)
        apart = self.distance(x, i[some], j[some])
        ok[some] = a[some] + b[some] - apart >= 2 * least[some]
        return ok

    @staticmethod
    def distance(x: dict, i, j) -> np.ndarray:
        return np.bitwise_count(x["bits"][i] ^ x["bits"][j]).sum(axis=-1).astype(np.int64)

    def pairs(self, x: dict) -> tuple[np.ndarray, np.ndarray]:
        """Indices of candidate pairs of all lists in x, whose rows are sorted by list, then size."""
        key = x["list"]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        small = np.repeat(sizes <= SMALL, sizes)
        left, right = [np.zeros(0, int)], [np.zeros(0, int)]
        for d in range(1, SMALL):
            i = np.flatnonzero((key[:-d] == key[d:]) & small[:-d]) if len(key) > d else np.zeros(0, int)
            if not len(i):
                break
            keep = self.bound(x, i, i + d)
            left.append(i[keep])
            right.append(i[keep] + d)
        for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
            comp = x["comp"][start : start + size]
            if (comp == comp[0]).all():
                continue
            i, j = (self._forest if self.forest else self._blocks)(x, int(start), int(size))
            left.append(i)
            right.append(j)
        return np.concatenate(left), np.concatenate(right)

    def _blocks(self, x: dict, start: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of the list that may link: blocks of about one size, entries within reach by position."""
        n, pos = x["n"][start : start + size], x["pos"][start : start + size]
        kind = np.floor(np.log(n) / SIZE_STEP).astype(np.int64)
        order = np.lexsort((pos, kind))
        cuts = np.flatnonzero(np.diff(kind[order])) + 1
        blocks = [(rows, pos[rows], int(n[rows].min()), int(n[rows].max())) for rows in np.split(order, cuts)]
        left, right = [np.zeros(0, int)], [np.zeros(0, int)]
        for at, (rows, p, small, large) in enumerate(blocks):
            for other in range(at, len(blocks)):
                members, q, low, high = blocks[other]
                if self.percent * low > 100 * large:
                    break  # this block and all after it are too large
                least = needed(small, low, self.percent)
                first, last = np.searchsorted(q, p + least - large), np.searchsorted(q, p + high - least, side="right")
                if other == at:
                    first = np.maximum(first, np.arange(1, len(rows) + 1))
                many = np.maximum(last - first, 0)
                ends = np.cumsum(many)
                for begin in range(0, int(ends[-1]), PIECE):
                    k = np.arange(begin, min(begin + PIECE, int(ends[-1])))
                    i = np.searchsorted(ends, k, side="right")
                    j = k - (ends[i] - many[i]) + first[i]
                    i, j = start + rows[i], start + members[j]
                    keep = self.bound(x, i, j)
                    left.append(i[keep])
                    right.append(j[keep])
        return np.concatenate(left), np.concatenate(right)

    def _forest(self, x: dict, start: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest of the list's candidate pairs, nearest bitmaps first; members of one component join for free."""
        rows = np.arange(start, start + size)
        far = np.iinfo(np.int64).max
        near, source = np.full(size, far), np.full(size, -1)
        todo = np.ones(size, bool)
        comp = x["comp"][rows]
        left, right = [], []
        free: list[int] = []
        while todo.any():
            if free:
                k, edge = free.pop(), False
                if not todo[k]:
                    continue
            else:
                k = int(np.where(todo, near, far).argmin())
                edge = near[k] < far
                if not todo[k]:
                    k = int(todo.argmax())
                    edge = False
            todo[k] = False
            if edge:
                left.append(source[k])
                right.append(start + k)
            free += np.flatnonzero(todo & (comp == comp[k])).tolist() if edge or not free else []
            rest = np.flatnonzero(todo)
            rest = rest[self.bound(x, np.full(len(rest), start + k), rows[rest])]
            apart = self.distance(x, np.full(len(rest), start + k), rows[rest])
            closer = apart < near[rest]
            near[rest[closer]], source[rest[closer]] = apart[closer], start + k
        return np.array(left, int), np.array(right, int)


def _candidates(shared: DataFrame, comps: DataFrame | None, percent: int, forest: bool, chunk: int) -> DataFrame:
    """a < b: candidate pairs of classes in different components, each once."""
    n = parallelism(shared.sparkSession)
    rows = shared.withColumn("comp", F.col("rep")) if comps is None else shared.join(comps.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("component_id", "rep")).drop("component_id")
    short = rows.where(F.col("m") <= chunk).select("tok", "rep", "n", "pos", "bits", "comp", *BEFORE, F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"))
    long = rows.where(F.col("m") > chunk)
    spread = F.ceil(F.col("m") / chunk).cast("int")
    own = F.pmod(F.xxhash64("rep"), spread).cast("int")
    if forest:
        long = long.select("tok", "rep", "n", "pos", "bits", "comp", *BEFORE, own.alias("i"), own.alias("j"), F.lit(0).alias("side"))
    else:
        # a long list within one component has nothing left to verify
        open_ = long.groupBy("tok").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("tok")
        long = long.join(open_, "tok").withColumn("own", own).withColumn("o", F.explode(F.sequence(F.lit(0), spread - 1)))
        long = long.select("tok", "rep", "n", "pos", "bits", "comp", *BEFORE, F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), F.when(F.col("own") > F.col("o"), 1).otherwise(0).alias("side"))
    dealt = short.union(long).repartition(n, "tok", "i", "j").sortWithinPartitions("tok", "i", "j", "n", "rep")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    @frugal
    def find(batches):
        lists = Lists(percent, forest)
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table):
            x = {c: table.column(c).to_numpy() for c in ("tok", "rep", "n", "pos", "comp", "i", "j", "side")}
            new = np.zeros(len(x["tok"]), bool)
            for c in ("tok", "i", "j"):
                new[1:] |= x[c][1:] != x[c][:-1]
            x["list"], x["off"] = np.cumsum(new), x["i"] == x["j"]
            for c in ("n", "pos"):
                x[c] = x[c].astype(np.int64)
            x["before"] = [table.column(c).to_numpy() for c in BEFORE]
            x["bits"] = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(-1, 4)
            left, right = lists.pairs(x)
            a, b = x["rep"][left], x["rep"][right]
            a, b = np.minimum(a, b), np.maximum(a, b)
            order = np.lexsort((b, a))  # lists that share many sets share their pairs
            a, b = a[order], b[order]
            once = np.ones(len(a), bool)
            once[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            return pa.RecordBatch.from_arrays([pa.array(a[once]), pa.array(b[once])], schema=schema)

        def cut(table: pa.Table) -> int:
            """Where the last list of a table begins."""
            last = [table.column(c)[table.num_rows - 1].as_py() for c in ("tok", "i", "j")]
            same = np.ones(table.num_rows, bool)
            for c, v in zip(("tok", "i", "j"), last):
                same &= table.column(c).to_numpy() == v
            return table.num_rows - int(same.sum())

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            at = cut(table)
            if at:
                yield done(table.slice(0, at))
                held = table.slice(at).combine_chunks().to_batches()
        if held:
            yield done(pa.Table.from_batches(held))

    return dealt.mapInArrow(find, "a long, b long").distinct()


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs that their long bitmaps allow to link; a bitmap has one bit where the set has 64."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    @frugal
    def sift(batches):
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n", "m", "x", "y"))):
                keep.append(n + m - least_apart(x, y) >= 2 * needed(n, m, percent))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], schema=schema).filter(pa.array(keep, pa.bool_()))

    own = pairs.join(classes.select(F.col("rep").alias("a"), "n", F.col("long").alias("x")), "a").join(classes.select(F.col("rep").alias("b"), F.col("n").alias("m"), F.col("long").alias("y")), "b")
    return own.select("a", "b", "n", "m", "x", "y").mapInArrow(sift, "a long, b long")


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, apart (size of the symmetric difference), total (of both sizes) of the pairs."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("apart", pa.int64()), ("total", pa.int64())])

    @frugal
    def measure(batches):
        for batch in batches:
            apart, total = [], []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                total.append(len(s) + len(t))
                apart.append(total[-1] - 2 * len(np.intersect1d(s, t, assume_unique=True)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(apart, pa.int64()), pa.array(total, pa.int64())], schema=schema)

    with_sets = pairs.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("set").alias("y")), "b")
    return with_sets.select("a", "b", "x", "y").mapInArrow(measure, "a long, b long, apart long, total long")


def _links(apart, total, percent: int):
    """Whether sets of `total` members together link that differ in `apart`: 100 * common >= percent * union."""
    return 100 * (total - apart) >= percent * (total + apart)


class _Sets:
    """Sets of classes, read from the texts when they are first wanted."""

    def __init__(self, rows: DataFrame, base: DataFrame, classes: DataFrame, k: int):
        self.rows, self.base, self.classes, self.k, self.known = rows, base, classes, k, None

    def of(self, reps: DataFrame) -> DataFrame:
        """rep, set of these classes."""
        spark = reps.sparkSession
        missing = reps if self.known is None else written(reps.join(self.known.select("rep"), "rep", "left_anti"), "missing")
        n = missing.count()
        if not n and self.known is None:
            return reps.withColumn("set", F.lit(b""))
        if n:
            wanted = written(self.classes.join(missing, "rep").select("rep", "k1", "k2"), "wanted")
            own, bits = self.rows, max(FILTER[0], (16 * n).bit_length())
            if self.known is not None or bits > FILTER[1]:  # few, or too many for the filter: one document of each class is picked by a join
                holders = self.base.join(wanted, ["k1", "k2"]).groupBy("rep").agg(F.min("doc_id").alias("holder")).select("holder").distinct()
                own = self.rows.join(holders, F.col("doc_id").eqNullSafe(F.col("holder")), "left_semi")
            more = written(_members(own, wanted, self.k, min(bits, FILTER[1])), "members", (parallelism(spark), "rep"))
            first, self.known = self.known is None, more if self.known is None else self.known.union(more)
            free_shuffles(spark)
            if first:
                return more
        return self.known.join(reps, "rep", "left_semi")


def _members(rows: DataFrame, wanted: DataFrame, k: int, n_bits: int) -> DataFrame:
    """rep, set of the wanted classes, from the texts; a filter of 2 ** n_bits bits keeps most other sets from being sent."""
    mask = (1 << n_bits) - 1
    at = F.explode(F.array(*(F.shiftrightunsigned("k1", 64 // FILTER_HASHES * i).bitwiseAND(mask) for i in range(FILTER_HASHES))))
    words = wanted.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    found = words.toArrow()
    table = np.zeros(1 << n_bits - 6, np.int64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    sent = rows.sparkSession.sparkContext.broadcast(table)

    @frugal
    def some_sets(batches):
        bits = sent.value.view(np.uint64)
        for batch in batches:
            for part in slices(batch):
                out: tuple[list, list, list] = ([], [], [])
                for text in bytes_of(part):
                    s = shingle_set(text, k)
                    if not len(s):
                        continue
                    k1, k2 = set_key(s)
                    places = [(k1 & (1 << 64) - 1) >> 64 // FILTER_HASHES * i & mask for i in range(FILTER_HASHES)]
                    if all(int(bits[p >> 6]) >> (p & 63) & 1 for p in places):
                        for column, value in zip(out, (k1, k2, s.tobytes())):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.binary()))], names=["k1", "k2", "set"])

    found = rows.select("text").mapInArrow(some_sets, "k1 long, k2 long, set binary").join(wanted, ["k1", "k2"])
    return found.groupBy("rep").agg(F.first("set").alias("set"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()


def _derived(pairs: DataFrame, comps: DataFrame, sets: _Sets, percent: int) -> DataFrame:
    """a, b: links among pairs of different groups, from the leaders' distances where they decide, else from the sets.

    A pair whose leaders link is left out: its groups are one by then.
    """
    led = comps.select(F.col("id").alias("a"), F.col("component_id").alias("la"))
    asked = pairs.join(led, "a", "left").join(led.select(F.col("a").alias("b"), F.col("la").alias("lb")), "b", "left")
    asked = written(asked.select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb")), "asked")
    heads = asked.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
    own = asked.where("la <> a").select(F.col("la").alias("a"), F.col("a").alias("b")).union(asked.where("lb <> b").select("lb", "b")).distinct()
    known = heads.union(own).distinct()
    known = written(_measured(known, sets.of(written(_ends(known), "ends"))), "known")
    from_heads = known.select(F.col("a").alias("l1"), F.col("b").alias("l2"), F.col("apart").alias("dl"), F.col("total").alias("tl"))
    first = known.select(F.col("a").alias("la"), F.col("b").alias("a"), F.col("apart").alias("da"))
    second = known.select(F.col("a").alias("lb"), F.col("b").alias("b"), F.col("apart").alias("db"))
    sized = sets.classes.select("rep", "n")
    told = asked.withColumns({"l1": F.least("la", "lb"), "l2": F.greatest("la", "lb")}).join(from_heads, ["l1", "l2"]).where(~_links(F.col("dl"), F.col("tl"), percent))
    told = told.where("a <> la or b <> lb").join(first, ["la", "a"], "left").join(second, ["lb", "b"], "left")
    told = told.join(sized.select(F.col("rep").alias("a"), F.col("n").alias("na")), "a").join(sized.select(F.col("rep").alias("b"), F.col("n").alias("nb")), "b")
    slack, total = F.coalesce("da", F.lit(0)) + F.coalesce("db", F.lit(0)), F.col("na") + F.col("nb")
    told = told.select("a", "b", (F.col("dl") + slack).alias("most"), F.greatest(F.col("dl") - slack, F.lit(0)).alias("least"), total.alias("total"))
    told = written(told.where(_links(F.col("least"), F.col("total"), percent)), "open")
    sure = _links(F.col("most"), F.col("total"), percent)
    open_ = told.where(~sure).select("a", "b")
    verified = _measured(open_, sets.of(written(_ends(open_), "ends")))
    hit = _links(F.col("apart"), F.col("total"), percent)
    return known.where(hit).select("a", "b").union(told.where(sure).select("a", "b")).union(verified.where(hit).select("a", "b"))


def jaccard_components(df: DataFrame, k: int = SHINGLE, percent: int = PERCENT, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included) of every row."""
    with scratch() as keep:
        return keep(written(_components(id_text(df, id_col, text_col), k, percent, chunk), "jaccard"))


def _components(rows: DataFrame, k: int, percent: int, chunk: int) -> DataFrame:
    spark = rows.sparkSession
    order = spark.sparkContext.broadcast(sketch(rows, k))

    @frugal
    def describe(batches):
        ranked = order.value
        for batch in batches:
            for part in slices(batch):
                out: dict[str, list] = {c: [] for c in ("k1", "k2", "n", "bits", "long", "prefix")}
                for text in bytes_of(part):
                    s = shingle_set(text, k)
                    n = len(s)
                    key = set_key(s) if n else (None, None)
                    first = s[ranked.order(s)[: prefix_length(n, percent)]] if n else s
                    for c, v in zip(out, (*key, n, bitmap(s), long_bitmap(s), first.view(np.int64))):
                        out[c].append(v)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(v, t) for v, t in zip(out.values(), types))], names=["doc_id", *out])

    described = written(rows.mapInArrow(describe, "doc_id long, k1 long, k2 long, n long, bits binary, long binary, prefix array<long>"), "sets")
    heavy = described.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("least"), F.first("bits").alias("bits"), F.first("long").alias("long"), F.first("prefix").alias("prefix"))
    heavy = written(heavy.withColumn("rep", F.monotonically_increasing_id()), "classes")
    base = written(described.select("doc_id", "n", "k1", "k2"), "keys")
    drop_written(described)
    free_shuffles(spark)
    frequent = heavy.select(F.explode("prefix").alias("tok")).groupBy("tok").agg(F.count("*").alias("m")).where("m > 1")
    entries = heavy.select("rep", F.posexplode("prefix").alias("pos", "tok")).join(frequent, "tok")
    order_of = Window.partitionBy("rep").orderBy("pos")
    entries = entries.withColumns({c: F.coalesce(F.lag("tok", k).over(order_of), F.lit(0)) for k, c in enumerate(BEFORE, 1)})
    shared = written(entries.join(heavy.select("rep", F.col("n").cast("int").alias("n"), "bits"), "rep"), "lists")
    classes = written(heavy.select("rep", "k1", "k2", "least", "n", "long"), "classes", (parallelism(spark), "rep"))
    drop_written(heavy)
    free_shuffles(spark)

    # short lists whole, and a forest of each longer one
    sets = _Sets(rows, base, classes, k)
    tried = written(_candidates(shared, None, percent, True, chunk), "pairs")
    likely = written(_likely(tried, classes, percent), "likely")
    measured = _measured(likely, sets.of(written(_ends(likely), "ends")))
    links = written(measured.where(_links(F.col("apart"), F.col("total"), percent)).select("a", "b"), "links")
    comps = written(components(links), "components")
    # what is left of the longer lists: pairs across groups
    more = _candidates(shared.where(F.col("m") > min(SMALL, chunk)), comps, percent, False, chunk).join(tried, ["a", "b"], "left_anti")
    more = written(_likely(written(more, "pairs"), classes, percent), "likely")
    if not more.isEmpty():
        comps = written(components(links.union(written(_derived(more, comps, sets, percent), "links"))), "components")

    group = classes.select("rep", "k1", "k2", "least").join(comps.withColumnRenamed("id", "rep"), "rep", "left").withColumn("group", F.coalesce("component_id", "rep")).drop("component_id")
    names = group.groupBy("group").agg(F.min("least").alias("component_id"))
    named = group.join(names, "group").select("k1", "k2", "component_id")
    out = base.select("doc_id", "n", "k1", "k2").join(named, ["k1", "k2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))

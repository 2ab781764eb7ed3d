"""Operator 6: near-duplicate embeddings by a forest of random-projection trees with spill overlap.

Equal vectors of one label become one representative first, so a vector that a third of all rows share costs
one row.  Each tree splits recursively by a random direction at a random quantile near the middle; rows close to
the split go to both sides (spill).  The margin is never cut: where it would hold more than a bounded share of a
node's rows in each direction tried, as in a large group of distinct but linked vectors, the node stays one leaf.
The trees are fitted on a sample of representatives, a 64th of them but no fewer than SAMPLE[0] and no more than
SAMPLE[1], and every representative is routed through every tree.  Within a leaf rows meet those of their own label only.

Leaves are compared in two steps.  First only an 8-bit code of each unit vector goes to its leaves, with the length of
its rounding error; two codes whose product lies below the threshold by more than both errors cannot belong to a link,
so this loses nothing.  Vectors that have a candidate in a leaf go there themselves, and are compared exactly, in double
precision; pairs at or above the threshold link.

A pair that meets in several leaves counts in the lowest one only: each row carries the list of its leaves with
candidates.  A leaf sends per-vector counts and a spanning forest of its links, never its pairs.  A leaf and label of more
than `cell` rows, counted, is dealt as a grid of chunk pairs, so that no task gets an unbounded leaf.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component, and rows with a null
label, link with nothing, and so do vectors of different lengths; rows with one vec_id count as vectors of their own
that share an id; a null vec_id has a null component and is kept, and lends no id to a component; a cosine equal to the
threshold links; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import frugal
from strandline.operators.components import components
from strandline.storage import parallelism, scratch, written


THRESHOLD = 0.93
TREES, LEAF, CELL = 8, 256, 4096
SAMPLE, MIN_SAMPLE_LEAF = (32_768, 262_144), 16
SPILL, SPILL_SHARE, TRIES = 0.5, 0.15, 16


class Tree:
    """Arrays of nodes: direction, threshold, margin, children; a leaf has a number and an estimated share of the rows."""

    def __init__(self, unit: np.ndarray, depth: int, rng: np.random.Generator, threshold: float, first_leaf: int, leaf_share: float):
        self.nodes: list[tuple] = []
        self.shares: list[float] = []
        self.first_leaf, self.total = first_leaf, max(1, len(unit))
        self._leaf_share, self._rng = leaf_share, rng
        self._gap = SPILL * math.sqrt(max(0.0, 2 - 2 * threshold) / max(1, unit.shape[1]))
        self._grow(unit, depth)

    def _grow(self, rows: np.ndarray, depth: int) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if depth > 0 and len(rows) >= 2 * MIN_SAMPLE_LEAF and len(rows) > self._leaf_share * self.total:
            # a split keeps the whole margin; a node that no direction splits so is a leaf, however large
            for _ in range(TRIES):
                direction = self._rng.standard_normal(rows.shape[1])
                direction /= np.linalg.norm(direction)
                along = rows @ direction
                cut = float(np.quantile(along, self._rng.uniform(0.4, 0.6)))
                left, right = along <= cut + self._gap, along > cut - self._gap
                if np.count_nonzero(left & right) <= SPILL_SHARE * len(rows) and not left.all() and not right.all():
                    self.nodes[at] = (direction, cut, self._gap, self._grow(rows[left], depth - 1), self._grow(rows[right], depth - 1))
                    return at
        self.nodes[at] = (self.first_leaf + len(self.shares),)
        self.shares.append(len(rows) / self.total)
        return at

    def route(self, unit: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(leaf, rows) for each leaf that some row reaches."""
        out, todo = [], [(0, np.arange(len(unit)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if len(self.nodes[node]) == 1:
                out.append((self.nodes[node][0], rows))
                continue
            direction, cut, margin, left, right = self.nodes[node]
            along = unit[rows] @ direction
            todo += [(left, rows[along <= cut + margin]), (right, rows[along > cut - margin])]
        return out


def fit_forest(sample: np.ndarray, n_rows: int, threshold: float, trees: int, leaf: int, seed: int = 17) -> list[Tree]:
    rng, first, out = np.random.default_rng(seed), 0, []
    depth = max(0, math.ceil(math.log2(max(1, n_rows) / leaf))) if n_rows > leaf else 0
    for _ in range(trees):
        tree = Tree(sample, depth, rng, threshold, first, leaf / max(1, n_rows))
        first += len(tree.shares)
        out.append(tree)
    return out


def _doubles(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def compared(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosine of each row of x and each row of y reaches the threshold."""
    norms = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)
    return (x @ y.T) / norms >= threshold


def _forest_of(links: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the links between row and column ids connect, fewer than there are ids."""
    ids, where = np.unique(np.concatenate((rows, cols)), return_inverse=True)
    r, c = where[: len(rows)], where[len(rows) :]
    root = np.arange(len(ids))
    some_r, some_c = np.flatnonzero(links.any(axis=1)), np.flatnonzero(links.any(axis=0))
    inner = links[np.ix_(some_r, some_c)]
    far = len(ids)
    while True:
        by_col = np.where(inner, root[r[some_r]][:, None], far).min(axis=0) if len(some_r) else np.zeros(0, int)
        new = root.copy()
        np.minimum.at(new, c[some_c], by_col)
        by_row = np.where(inner, new[c[some_c]][None, :], far).min(axis=1) if len(some_c) else np.zeros(0, int)
        np.minimum.at(new, r[some_r], by_row)
        if (new == root).all():
            return [(int(ids[i]), int(ids[k])) for i, k in enumerate(root) if i != k]
        root = new


def coded(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit codes of unit vectors, the step of each, and a bound of the rounding error's length."""
    step = np.abs(unit).max(axis=1) / 127
    codes = np.round(unit / step[:, None]).astype(np.int8)
    return codes, step, np.linalg.norm(unit - codes * step[:, None], axis=1) + 1e-6


def with_candidates(codes: np.ndarray, step: np.ndarray, error: np.ndarray, sides: np.ndarray, diagonal: bool, threshold: float, block: int = 1024) -> np.ndarray:
    """Which rows of a cell may link with another one."""
    x = codes.astype(np.float32) * step.astype(np.float32)[:, None]
    # |a.b - c.d| <= |a - c| |b| + |c| |b - d|, and float32 sums are off by less than 1e-4
    least = threshold - 1e-4
    found = np.zeros(len(x), bool)
    first = np.arange(len(x)) if diagonal else np.flatnonzero(sides == 0)
    second = first if diagonal else np.flatnonzero(sides == 1)
    for i in range(0, len(first), block):
        a = first[i : i + block]
        for j in range(i if diagonal else 0, len(second), block):
            b = second[j : j + block]
            near = x[a] @ x[b].T + error[a][:, None] + error[b] * (1 + error[a][:, None]) >= least
            if diagonal and i == j:
                near &= ~np.eye(len(a), dtype=bool)
            found[a] |= near.any(axis=1)
            found[b] |= near.any(axis=0)
    return found


def cell_links(ids, sides, labels, copies, leaves, x, leaf: int, diagonal: bool, threshold: float, block: int = 1024):
    """Links within one cell: counts per vector and edges.  sides: chunk of each row, 0 or 1 (all 0 on the diagonal)."""
    counts: dict[int, int] = {}
    edges: list[tuple[int, int]] = []
    order = np.lexsort((ids, labels))
    for same in np.split(order, np.flatnonzero(np.diff(labels[order])) + 1):
        first = same if diagonal else same[sides[same] == 0]
        second = same if diagonal else same[sides[same] == 1]
        for i in range(0, len(first), block):
            a = first[i : i + block]
            for j in range(i if diagonal else 0, len(second), block):
                b = second[j : j + block]
                links = compared(x[a], x[b], threshold)
                if diagonal and i == j:
                    links &= ~np.tri(len(a), dtype=bool)  # each pair once, none with itself
                if not links.any():
                    continue
                edges += _forest_of(links, ids[a], ids[b])
                # pairs that share a lower leaf count there
                some_a, some_b = np.flatnonzero(links.any(axis=1)), np.flatnonzero(links.any(axis=0))
                at: dict[int, tuple[list[int], list[int]]] = {}
                for side, some, part in ((0, some_a, a), (1, some_b, b)):
                    for k in some:
                        for lower in leaves[part[k]]:
                            if lower < leaf:
                                at.setdefault(lower, ([], []))[side].append(k)
                for rows, cols in at.values():
                    if rows and cols:
                        links[np.ix_(rows, cols)] = False
                for part, n in ((a, links @ copies[b]), (b, copies[a] @ links)):
                    for k in np.flatnonzero(n):
                        counts[int(ids[part[k]])] = counts.get(int(ids[part[k]]), 0) + int(n[k])
    return counts, edges


def embedding_dedup(df: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF, cell: int = CELL, sample: tuple[int, int] = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    with scratch() as keep:
        return keep(written(_deduplicated(df, threshold, trees, leaf, cell, sample, id_col, vector_col, label_col), "embeddings"))


def _deduplicated(df: DataFrame, threshold: float, trees: int, leaf: int, cell: int, sample: tuple[int, int], id_col: str, vector_col: str, label_col: str) -> DataFrame:
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("x"), F.col(f"`{label_col}`").cast("string").alias("label"))
    sound = F.coalesce(F.col("label").isNotNull() & (F.size("x") > 0) & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("x", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("key", F.when(sound, F.xxhash64("label", "x")))
    # the representative of a vector is named by a row number of its own: ids may repeat or be null
    reps = rows.where("key is not null").groupBy("key", "label", "x").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    reps = written(reps.withColumn("rep", F.monotonically_increasing_id()).withColumn("dim", F.size("x")), "vectors")

    sizes = {r["dim"]: r["n"] for r in reps.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    found = [_links(reps.where(F.col("dim") == dim), dim, n, threshold, trees, leaf, cell, sample) for dim, n in sorted(sizes.items())]
    counts = edges = None
    if found:
        links = found[0]
        for more in found[1:]:
            links = links.union(more)
        links = written(links, "links")
        counts = links.where("other is null").groupBy("rep").agg(F.sum("n").alias("n"))
        edges = links.where("other is not null")
        linked = components(edges, "rep", "other")
    if counts is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    # components of representatives, named by their smallest vec_id
    named = reps.select("rep", "key", "label", "x", "copies", "least").join(counts, "rep", "left").join(linked.withColumnRenamed("id", "rep"), "rep", "left").withColumn("group", F.coalesce("component_id", "rep"))
    names = named.groupBy("group").agg(F.min("least").alias("component_id"))
    named = named.drop("component_id").join(names, "group").select("key", "label", "x", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    out = rows.join(named, ["key", "label", "x"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _links(reps: DataFrame, dim: int, n_rows: int, threshold: float, trees: int, leaf: int, cell: int, sample: tuple[int, int]) -> DataFrame:
    """rep, other, n: counts of links (other is null) and edges of the leaves' spanning forests."""
    spark = reps.sparkSession
    wanted = min(sample[1], max(sample[0], n_rows // 64))
    share = min(1.0, wanted / n_rows)
    picked = reps.where(F.pmod(F.xxhash64("key", "rep"), F.lit(1 << 20)) < share * (1 << 20)).select("x").limit(2 * wanted).toArrow()
    fitted = _doubles(picked.column("x").combine_chunks(), dim)
    fitted /= np.linalg.norm(fitted, axis=1, keepdims=True) if len(fitted) else 1.0
    sent = spark.sparkContext.broadcast(fit_forest(fitted, n_rows, threshold, trees, leaf))

    coded_schema = pa.schema([("leaf", pa.int32()), ("label", pa.string()), ("rep", pa.int64()), ("code", pa.binary()), ("step", pa.float64()), ("error", pa.float64())])

    @frugal
    def route(batches):
        forest = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = _doubles(part.column("x"), dim)
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                reached = [pair for tree in forest for pair in tree.route(unit)]
                k = np.concatenate([members for _, members in reached])
                codes, step, error = coded(unit)
                raw = pa.array([c.tobytes() for c in codes], pa.binary())
                take = pa.array(k)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([n for n, _ in reached], [len(m) for _, m in reached]), pa.int32()), part.column("label").take(take), part.column("rep").take(take), raw.take(take), pa.array(step[k]), pa.array(error[k])], schema=coded_schema)

    routed = reps.select("rep", "label", "x").repartition(parallelism(spark), "rep").mapInArrow(route, "leaf int, label string, rep long, code binary, step double, error double")
    routed = written(routed, "codes")
    # leaves with one row of a label have nothing to compare; large ones are dealt as a grid of chunk pairs
    sizes = routed.groupBy("leaf", "label").agg(F.count("*").alias("m")).where("m > 1").withColumn("g", F.ceil(F.col("m") / cell).cast("int"))
    own = F.pmod(F.xxhash64("rep"), F.col("g")).cast("int")
    dealt = routed.join(sizes, ["leaf", "label"]).withColumn("own", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    dealt = dealt.select("leaf", "label", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), (F.col("own") > F.col("o")).cast("int").alias("side"), "rep", "code", "step", "error")

    def candidates(key: tuple, group: pa.Table) -> pa.Table:
        codes = np.frombuffer(b"".join(group.column("code").to_pylist()), np.int8).reshape(-1, dim)
        found = with_candidates(codes, group.column("step").to_numpy(), group.column("error").to_numpy(), group.column("side").to_numpy(), key[2] == key[3], threshold)
        return group.select(["leaf", "i", "j", "side", "rep"]).filter(pa.array(found))

    likely = dealt.groupBy("leaf", "label", "i", "j").applyInArrow(candidates, "leaf int, i int, j int, side int, rep long")
    at = written(likely.groupBy("rep").agg(F.collect_list(F.struct("leaf", "i", "j", "side")).alias("cells")), "candidates")
    vectors = reps.select("rep", "label", "copies", "x").join(at, "rep").withColumn("leaves", F.array_distinct(F.transform("cells", lambda c: c["leaf"])))
    cells = vectors.select("rep", "label", "copies", "x", "leaves", F.inline("cells"))
    out_schema = pa.schema([("rep", pa.int64()), ("other", pa.int64()), ("n", pa.int64())])

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        number, i, j = (key[k].as_py() for k in (0, 2, 3))
        group = group.combine_chunks()
        ids = group.column("rep").to_numpy()
        x = group.column("x").combine_chunks()
        x = _doubles(x.chunk(0) if isinstance(x, pa.ChunkedArray) else x, dim)
        counts, edges = cell_links(ids, group.column("side").to_numpy(), np.zeros(len(ids), np.int64), group.column("copies").to_numpy(), group.column("leaves").to_pylist(), x, number, i == j, threshold)
        rep = [*counts, *(a for a, _ in edges)]
        other = [None] * len(counts) + [b for _, b in edges]
        n = [*counts.values(), *([0] * len(edges))]
        return pa.table([pa.array(v, pa.int64()) for v in (rep, other, n)], schema=out_schema)

    return cells.groupBy("leaf", "label", "i", "j").applyInArrow(compare, "rep long, other long, n long")

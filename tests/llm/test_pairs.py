"""Operators 2, 5, 6, 7 and 8 and the pipeline: each against a brute-force version on small fixtures."""

import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import decontamination, embedding_dedup, jaccard_join, preference_format, substring_dedup
from strandline.llm.shingles import mixed
from tests.llm.conftest import ODD


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("clash"))


# 2: substring dedup ----------------------------------------------------------------------------------------


def plain_dedup(rows, width):
    first = {}
    for i, text in rows:
        words = (text or "").encode().split()
        for k in range(len(words) - width + 1) if i is not None else ():
            key = tuple(words[k : k + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - width + 1) if i is not None else ():
            if first[tuple(words[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out.append((i, len(words), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(words, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def dedup(df, **options):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in substring_dedup.substring_dedup(df, **options).collect()), key=repr)


def test_substring_dedup(spark, near_copies, odd, empty):
    assert dedup(frame(spark, near_copies)) == plain_dedup(near_copies, 13)
    assert dedup(frame(spark, near_copies), width=4, blocks=3, buckets=5) == plain_dedup(near_copies, 4)
    assert dedup(odd) == plain_dedup(ODD, 13)
    assert dedup(empty) == []


def test_factors():
    """Earliest and best addresses of six windows of three words: the longer run is taken, and the parse jumps."""
    doc, pos = np.array([1, 1, 9, 2, 2, 1]), np.array([4, 5, 0, 7, 9, 0], np.uint32)
    removed, factors = substring_dedup.parsed(9, doc, pos, doc, pos, 8, 3)
    assert factors == [(0, 4, 1, 4), (4, 3, 2, 9)] and removed.all()
    best, at = np.array([3, 3, 3, 3, 2, 9]), np.array([0, 1, 2, 3, 9, 0], np.uint32)
    assert substring_dedup.parsed(9, np.where(doc == 9, 3, doc), np.where(doc == 9, 2, pos).astype(np.uint32), best, at, 8, 3)[1] == [(0, 6, 3, 0)]
    assert substring_dedup.parsed(1, doc, pos, best, at, 8, 3)[1] == []


@pytest.mark.parametrize("dealt", [{}, {"blocks": 1, "buckets": 1}, {"blocks": 7, "buckets": 3}])
def test_one_long_match_is_one_factor(spark, dealt):
    """Document 1 holds the beginning, document 2 all of it: document 3 is one factor of 30 words, not two."""
    words = [f"w{i}" for i in range(30)]
    rows = [(1, " ".join(words[:14])), (2, " ".join(words)), (3, " ".join(words)), (4, " ".join(words[5:25] + ["x"] + words[3:20]))]
    got = {r["doc_id"]: (r["n_factors"], r["n_removed"]) for r in substring_dedup.substring_dedup(frame(spark, rows), **dealt).collect()}
    assert got == {1: (0, 0), 2: (1, 14), 3: (1, 30), 4: (2, 37)}


def test_rows_without_an_id_go_to_no_block(spark):
    text = " ".join(f"w{i}" for i in range(20))
    got = substring_dedup.substring_dedup(frame(spark, [(None, text)] * 50 + [(1, text), (2, text)])).collect()
    assert sorted((repr(r["doc_id"]), r["n_words"], r["n_removed"]) for r in got) == sorted([("None", 20, 0)] * 50 + [("1", 20, 0), ("2", 20, 20)])


def test_choice_with_equal_first_hashes():
    n = lambda *x: np.array(x)
    doc, pos = n(8, 3, 6, 4), n(0, 1, 2, 3).astype(np.uint32)
    found = substring_dedup.chosen(n(5, 5, 5, 5).astype(np.uint64), n(1, 2, 1, 2).astype(np.uint32), doc, pos, doc, pos, n(9, 1, 2, 1).astype(np.uint32))
    assert [x.tolist() for x in found] == [[6, 3, 6, 3], [2, 1, 2, 1], [8, 3, 8, 3], [0, 1, 0, 1], [9, 1, 9, 1]]


# 5: decontamination ----------------------------------------------------------------------------------------


def plain_matches(docs, items, k=5, least=0.8):
    words = lambda t: decontamination.words_of((t or "").encode())
    grams = lambda w: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)] if w else [])
    out = set()
    for (i, text), (j, item) in itertools.product(docs, items):
        w, b = words(text), grams(words(item))
        m = len(words(item))
        for s in range(max(1, len(w) - m + 1)) if b and w else ():
            a = grams(w[s : s + m])
            low = sum((a & b).values())
            if low / (sum(a.values()) + sum(b.values()) - low) >= least:
                out.add((i, j))
    return out


def test_decontamination(spark, odd, empty):
    rng = random.Random(8)
    draw = lambda n: [rng.choice("abcdefghijklmnopqrst") + rng.choice("aeiou") for _ in range(n)]
    items = [(j, " ".join(draw(n))) for j, n in enumerate([1, 3, 4, 5, 6, 20, 20, 45, 60])] + [(20, None), (21, ""), (None, " ".join(draw(30))), (5, " ".join(draw(20)))]
    docs = []
    for i in range(60):
        text = draw(rng.randrange(0, 120))
        item = rng.choice(items)[1] or ""
        piece = item.split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            if piece:
                piece[rng.choice([0, -1, rng.randrange(len(piece))])] = "zz"
        at = rng.randrange(len(text) + 1)
        docs.append((i, (" ".join(text[:at]) + ", " + " ".join(piece).upper() + ". " + " ".join(text[at:])) if i % 3 else " ".join(piece)))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("label", F.lit(1))
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.decontamination(frame(spark, docs), bench).collect()}
    want = plain_matches(docs, items)
    assert got == want and len(want) > 20
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.decontamination(frame(spark, docs), bench, max_items=3).collect()} == want
    for options in ({}, {"max_items": 3}):
        kept = {r["doc_id"] for r in decontamination.uncontaminated(frame(spark, docs), bench, **options).collect()}
        assert kept == {i for i, _ in docs} - {i for i, _ in want}
    assert decontamination.decontamination(odd, bench.limit(0)).count() == 0
    assert decontamination.decontamination(empty, bench).count() == 0
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.decontamination(odd, bench).collect()} == plain_matches(ODD[:7] + ODD[9:], items)
    assert decontamination.uncontaminated(odd, bench).count() == len(ODD) == decontamination.uncontaminated(odd, bench.limit(0)).count()


def test_multi_index_holds_all_within_the_radius():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 256, (400, 8), dtype=np.uint8)
    index = decontamination.MultiIndex(prints, decontamination.RADIUS)
    for n in range(200):
        bits = np.unpackbits(prints[n])
        bits[rng.choice(64, rng.integers(decontamination.RADIUS + 3), replace=False)] ^= 1
        asked = np.packbits(bits)
        apart = np.unpackbits(prints ^ asked, axis=1).sum(axis=1)
        _, items, found = index.within(asked[None, :])
        assert items.tolist() == np.flatnonzero(apart <= decontamination.RADIUS).tolist() and found.tolist() == apart[items].tolist()


def test_recall_of_fingerprints():
    """Windows just similar enough (0.8 to 0.82) to an item: all but one in a thousand lie within the radius."""
    rng = np.random.default_rng(6)
    missed = tried = 0
    for _ in range(4000):
        n = int(rng.integers(20, 200))
        differing = int(n * 0.2 / 1.8)  # of n shingles on either side: n - d in common gives (n - d) / (n + d)
        item = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        window = np.r_[item[differing:], rng.integers(0, 1 << 63, differing, dtype=np.uint64)]
        a, b = (decontamination.window_fingerprints(mixed(h), np.array([0]), n)[0] for h in (item, window))
        tried += 1
        missed += int(np.unpackbits(a ^ b).sum()) > decontamination.RADIUS
    assert missed <= 0.001 * tried


def test_repeated_items_are_dealt_like_others(spark):
    same = spark.createDataFrame([(i, "one and the same benchmark item of ten words here") for i in range(40)], "item_id long, text string")
    parts = list(decontamination._slices(same, "item_id", "text", 10, 1 << 20))
    assert sum(map(len, parts)) == 40 and max(map(len, parts)) < 40 and len(parts) > 3


# 6: embeddings ---------------------------------------------------------------------------------------------


def plain_links(rows, threshold=0.93):
    sound = lambda v, lab: v is not None and lab is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)
    n, parent = len(rows), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * n
    for i, j in itertools.combinations(range(n), 2):
        (_, v, a), (_, w, b) = rows[i], rows[j]
        if sound(v, a) and sound(w, b) and a == b and len(v) == len(w):
            v, w = np.array(v), np.array(w)
            if v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= threshold:
                links[i] += 1
                links[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    ids = {}
    for i, (vec, _, _) in enumerate(rows):
        if vec is not None:
            ids[root(i)] = min(ids.get(root(i), vec), vec)
    return sorted(((vec, links[i], ids.get(root(i)) if vec is not None else None) for i, (vec, _, _) in enumerate(rows)), key=repr)


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    rows, centres = [], rng.standard_normal((8, dim))
    for i in range(n):
        c = centres[rng.integers(8)] + rng.standard_normal(dim) * rng.choice([0.0, 0.2, 0.3, 2.0])
        rows.append((int(n - i), [float(np.float32(x)) for x in c], int(rng.integers(3))))
    return rows


@pytest.mark.parametrize("options", [{}, {"leaf": 16, "cell": 40, "trees": 12}])
def test_embeddings(spark, options):
    rows = vectors(300, 12, 4)
    rows += [(1000, rows[0][1], rows[0][2]), (1000, rows[0][1], rows[0][2]), (1001, None, 1), (1002, [], 1), (1003, [0.0] * 12, 1), (1004, [math.nan] * 12, 1), (1005, [None] + [1.0] * 11, 1), (1006, rows[0][1], None), (None, rows[0][1], rows[0][2]), (1007, [1.0, 2.0], 1), (1008, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit("clash"))
    got = embedding_dedup.embedding_dedup(df, **options).collect()
    want = plain_links(rows)
    found = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=repr)
    if options:
        assert sum(n for _, n, _ in found) >= 0.9 * sum(n for _, n, _ in want) and all(a[0] == b[0] and a[1] <= b[1] for a, b in zip(found, want))
    else:
        assert found == want
    assert all(r["kept"] == (r["vec_id"] is None or r["vec_id"] == r["component_id"]) for r in got)


def test_large_group_of_distinct_linked_vectors():
    """A third of 100,000 rows within cosine 0.94 of one another: each linked pair must meet in some leaf."""
    rng = np.random.default_rng(3)
    n, group, dim = 100_000, 33_333, 64
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x = unit(rng.standard_normal((n, dim)))
    x[:group] = unit(unit(rng.standard_normal(dim)) + unit(rng.standard_normal((group, dim))) * rng.uniform(0.13, 0.24, (group, 1)))
    probes = rng.choice(group, 100, replace=False)
    linked = x[probes] @ x.T >= embedding_dedup.THRESHOLD
    met = np.zeros_like(linked)
    for tree in embedding_dedup.fit_forest(x[rng.random(n) < embedding_dedup.SAMPLE[0] / n], n, embedding_dedup.THRESHOLD, embedding_dedup.TREES, embedding_dedup.LEAF):
        for _, rows in tree.route(x):
            met[np.ix_(np.isin(probes, rows), rows)] = True
    assert (met & linked).sum() >= 0.999 * linked.sum()


@pytest.mark.parametrize("dim", [1, 2, 12, 64, 300])
def test_codes_lose_no_link(dim):
    """Rows that link with another one are among those with candidates, on the diagonal and between chunks."""
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((20, dim))[rng.integers(0, 20, 400)] + rng.standard_normal((400, dim)) * rng.choice([0.1, 0.25, 0.4, 1.0], (400, 1))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.93) & ~np.eye(400, dtype=bool)
    sides = rng.integers(0, 2, 400)
    assert (embedding_dedup.with_candidates(*embedding_dedup.coded(unit), sides, True, 0.93, 64) >= linked.any(axis=1)).all()
    across = linked & (sides[:, None] != sides)
    assert (embedding_dedup.with_candidates(*embedding_dedup.coded(unit), sides, False, 0.93, 64) >= across.any(axis=1)).all()


def test_no_embeddings(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.embedding_dedup(none).count() == 0
    bad = spark.createDataFrame([(1, None, 2), (2, [0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(tuple(r) for r in embedding_dedup.embedding_dedup(bad).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


# 7: Jaccard join -------------------------------------------------------------------------------------------


def plain_groups(rows, k, percent):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    ids = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            ids[root(i)] = min(ids.get(root(i), doc), doc)
    return sorted(((doc, len(s), ids[root(i)] if doc is not None else None) for i, ((doc, _), s) in enumerate(zip(rows, sets))), key=repr)


@pytest.mark.parametrize(("k", "percent", "chunk"), [(3, 90, 4096), (5, 80, 4096), (2, 50, 4096), (2, 50, 3), (1, 60, 10)])
def test_jaccard(spark, near_copies, k, percent, chunk):
    got = jaccard_join.jaccard_components(frame(spark, near_copies), k, percent, chunk)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_groups(near_copies, k, percent)


def test_jaccard_of_odd_rows(odd, empty):
    assert sorted((tuple(r) for r in jaccard_join.jaccard_components(odd, 3, 90).collect()), key=repr) == plain_groups(ODD, 3, 90)
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_each_candidate_pair_comes_once(spark, near_copies, monkeypatch):
    """Per round as many rows as pairs, no pair in both rounds, and every link among them or within a group."""
    rounds, plain = [], jaccard_join._candidates

    def watched(*args):
        rounds.append([tuple(r) for r in plain(*args).collect()])
        return plain(*args)

    monkeypatch.setattr(jaccard_join, "_candidates", watched)
    assert sorted((tuple(r) for r in jaccard_join.jaccard_components(frame(spark, near_copies), 2, 50).collect()), key=repr) == plain_groups(near_copies, 2, 50)
    assert all(len(set(pairs)) == len(pairs) and all(a < b for a, b in pairs) for pairs in rounds) and rounds[0]


def test_near_copies_meet_in_few_lists():
    """A group of near copies shares some twenty listed tokens a pair; the candidates before distinct() are few a pair, whatever the partitions."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(w if rng.random() > 0.01 else f"x{rng.random()}" for w in base)) for i in range(60)]
    got = []
    plain = jaccard_join.Lists.pairs

    def counted(self, x):
        left, right = plain(self, x)
        got.append((len(left), set(zip(np.minimum(x["rep"][left], x["rep"][right]).tolist(), np.maximum(x["rep"][left], x["rep"][right]).tolist()))))

    sets = [jaccard_join.shingle_set(t.encode(), 5) for _, t in rows]
    counts: dict[int, int] = {}
    for s in sets:
        for h in s.tolist():
            counts[h] = counts.get(h, 0) + 1
    entries = []
    for rep, s in enumerate(sets):
        first = sorted(s.tolist(), key=lambda h: (counts[h], h))[: jaccard_join.prefix_length(len(s), 80)]
        listed = [h for h in first if counts[h] > 1]
        entries += [(h, len(s), rep, first.index(h), [*reversed(listed[max(0, k - 3) : k]), 0, 0, 0][:3]) for k, h in enumerate(listed)]
    entries.sort()
    col = lambda k: np.array([e[k] for e in entries])
    tok = np.array([e[0] for e in entries], np.uint64)
    x = {"list": np.cumsum(np.r_[True, tok[1:] != tok[:-1]]), "n": col(1), "rep": col(2), "pos": col(3), "comp": col(2), "off": np.ones(len(entries), bool), "side": np.zeros(len(entries), int), "bits": np.frombuffer(b"".join(jaccard_join.bitmap(sets[e[2]]) for e in entries), np.uint64).reshape(-1, 4), "before": [np.array([e[4][k] for e in entries], np.uint64) for k in range(3)]}
    for forest in (True, False):
        counted(jaccard_join.Lists(80, forest), x)
    without = dict(x, before=[np.zeros(len(entries), np.uint64)])
    counted(jaccard_join.Lists(80, False), without)
    (_, _), (rows_all, pairs_all), (rows_plain, pairs_plain) = got
    links = {(a, b) for a, b in itertools.combinations(range(60), 2) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    assert links <= pairs_all <= pairs_plain and len(links) > 100 and rows_all < 3 * len(pairs_all) and rows_plain > 2 * rows_all


def test_blocks_skip_by_position_and_lose_nothing():
    rng = np.random.default_rng(5)
    n = np.sort(rng.integers(20, 60, 300))
    pos = (rng.random(300) * jaccard_join.prefix_length(60, 80)).astype(np.int64) % n
    x = {"n": n, "pos": pos, "comp": np.arange(300), "off": np.ones(300, bool), "side": np.zeros(300, int), "bits": np.zeros((300, 4), np.uint64), "before": [rng.integers(0, 40, 300) for _ in range(3)]}
    lists = jaccard_join.Lists(80, False)
    i, j = lists._blocks(x, 0, 300)
    a, b = np.triu_indices(300, 1)
    keep = lists.bound(x, a, b)
    assert sorted(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist())) == list(zip(a[keep].tolist(), b[keep].tolist())) and 0 < keep.sum() < len(a)


def test_links_from_leaders_distances(spark):
    """Sets of one leader that link, that do not, and that only their sets can tell."""
    sets = {1: range(100), 2: range(1, 101), 3: range(30, 130), 4: range(31, 131), 5: range(12, 112), 6: range(14, 114), 7: range(15, 115)}
    pack = lambda m: np.array(sorted(m), np.uint64).tobytes()
    known = jaccard_join._Sets(None, None, spark.createDataFrame([(r, len(m)) for r, m in sets.items()], "rep long, n long"), 1)
    known.known = spark.createDataFrame([(r, pack(m)) for r, m in sets.items()], "rep long, set binary")
    comps = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5), (7, 5)], "id long, component_id long")
    pairs = [(1, 3), (2, 4), (1, 5), (2, 5), (2, 6), (2, 7)]
    got = {tuple(r) for r in jaccard_join._derived(spark.createDataFrame(pairs, "a long, b long"), comps, known, 80).collect()}
    linked = lambda a, b: 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b]))
    group = {r["id"]: r["component_id"] for r in comps.collect()}
    assert {(a, b) for a, b in got if group[a] != group[b]} == {(a, b) for a, b in pairs if linked(a, b)} == {(2, 5)}
    assert all(linked(a, b) for a, b in got)


def test_prefixes_and_bounds():
    for n, m in itertools.product(range(1, 60), repeat=2):
        least = jaccard_join.needed(n, m, 80)
        assert 100 * least >= 80 * (n + m - least) and 100 * (least - 1) < 80 * (n + m - least + 1)


# 8: preference formatting ----------------------------------------------------------------------------------


def test_preference_format(spark):
    turn = lambda r, t: (r, t)
    a = [turn("system", "s"), turn("user", "u"), turn("assistant", "good"), turn("user", "é"), turn("assistant", "ok")]
    b = [turn("system", "s"), turn("user", "u"), turn("assistant", "bad")]
    rows = [(1, a, b), (2, a, a), (3, [], b), (4, None, None), (None, a, b), (5, [turn(None, None)], [turn(None, None), turn("assistant", None)])]
    pairs = spark.createDataFrame(rows, "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>").withColumn("prompt", F.lit("clash"))
    got = {r["pair_id"]: r for r in preference_format.preference_format(pairs).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    assert got[1]["n_prompt_turns"] == 2 and got[1]["prompt"] == "<|system|>\ns<|end|>\n<|user|>\nu<|end|>\n"
    for side, replies in (("chosen", ["good<|end|>\n", "ok<|end|>\n"]), ("rejected", ["bad<|end|>\n"])):
        spans = [tuple(map(int, s.split(":"))) for s in got[1][f"{side}_mask"].split(",")]
        assert [got[1][side][s:e] for s, e in spans] == replies
    assert (got[2]["n_prompt_turns"], got[2]["chosen"], got[2]["rejected"], got[2]["chosen_mask"]) == (5, "", "", "")
    assert got[3]["prompt"] == "" and got[3]["chosen"] == "" and got[4]["rejected"] == ""
    assert got[5]["n_prompt_turns"] == 1 and got[5]["rejected"] == "<|assistant|>\n<|end|>\n"


def test_preference_query_is_its_sql(spark):
    import duckdb

    rows = [(0, 1, "user", "b"), (0, 0, "user", "a"), (0, 2, "assistant", "x"), (1, 0, None, "a"), (1, 1, "assistant", None), (2, 0, "user", "q"), (2, 0, "user", "q"), (4, 0, "assistant", "z"), (None, 0, "user", "n"), (5, None, "assistant", "w"), (7, 0, "user", ""), (7, 1, "assistant", "r"), (7, 2, "user", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = preference_format.preference_format(preference_format.swapped_replies(preference_format.conversations(df.withColumn("turns", F.lit(1))))).toPandas()
    conversations = df.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = con.execute(preference_format.ORACLE_SQL).df()
    assert sorted(map(repr, got[list(want.columns)].values.tolist())) == sorted(map(repr, want.values.tolist()))
    assert preference_format.conversations(df.limit(0)).count() == 0


def test_no_python_in_the_native_operator(spark):
    from strandline.llm.queries import op8_preference_format

    plan = op8_preference_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# pipeline --------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import public_tokenizers

    import corpus_pipeline
    from strandline.llm.byte_bpe import ByteBpe, load_ranks
    from strandline.llm.secret_scan import redacted

    sf = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{sf}/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in source.collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    langs = {r["doc_id"] for r in corpus_pipeline.language_id(spark, source, sf).collect()}
    assert {i for i, t in docs if any(c.isalpha() for c in t)} >= langs and len(langs) >= 0.95 * len(docs)
    kept = [(i, t) for i, t in docs if i in langs]
    groups = plain_groups(kept, 5, 80)
    kept = [(i, t) for i, t in kept if i in {doc for doc, _, g in groups if g == doc}]
    leaks = {i for i, t in kept for _, item in items if item in t}
    bpe = ByteBpe(load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    want = {i: bpe.encode(redacted(t)) for i, t in kept if i not in leaks}
    got = {r["doc_id"]: bytes(r["ids"]) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and leaks


def test_stages_keep_the_columns(spark, odd):
    import corpus_pipeline

    docs = odd.withColumn("lang", F.lit("en"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == odd.columns


def test_stages_on_odd_and_empty_tables(spark, odd, empty):
    """What stays of null, empty, blank, repeated, long and foreign texts, null ids, and rows that share an id; stage by stage."""
    import corpus_pipeline

    sf, stage = "/root/testdata/sf0.001", dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((r["doc_id"] for r in df.collect()), key=repr)
    whole = ids(odd)
    fox = [i for i, t in ODD if t == ODD[0][1]]
    lettered = [i for i, t in ODD if t and any(c.isalpha() for c in t)]
    langs = corpus_pipeline.language_id(spark, odd.withColumn("_found", F.lit("clash")), sf)
    assert "_found" in langs.columns and set(ids(langs)) <= set(lettered) and {i for i in fox if i} <= set(ids(langs))
    assert ids(stage["jaccard_join"](spark, odd, sf)) == sorted((i for i, t in ODD if i != 2), key=repr)
    assert ids(stage["decontamination"](spark, odd, sf)) == whole
    clean = stage["secret_scan"](spark, odd, sf)
    assert ids(clean) == whole and sorted((r["n_chars"] for r in clean.collect()), key=repr) == sorted((len(t) if t is not None else None for _, t in ODD), key=repr)
    assert stage["secret_scan"](spark, odd.drop("n_chars"), sf).columns == odd.drop("n_chars").columns
    assert ids(stage["byte_bpe"](spark, odd, sf)) == whole
    for f in stage.values():
        assert f(spark, empty, sf).count() == 0


def test_pipeline_decodes(spark):
    """The last stage's digest is that of the bytes that the ids stand for, which are the text's."""
    import corpus_pipeline

    texts = {1: "plain words", 2: "Ünïcödé 漢字 \U0001f600", 3: "", 4: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["decoded_sha256"] for r in corpus_pipeline.byte_level_bpe(spark, docs, "").collect()}
    assert got == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in texts.items()}

"""The registered queries, with production parameters, on the smallest tables: against their SQL, a library or brute force."""

import glob
import hashlib
import itertools
import os

import numpy as np
import pytest

from strandline.llm import queries
from tests.llm.test_pairs import plain_matches
from tests.llm.test_scans import LIBRARY, RANKS, plain_base, plain_spans, tokenizers_files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def run(spark, name):
    return queries.queries()[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = sorted(repr(sorted(zip(names, row))) for row in found.fetchall())
    assert sorted(repr(sorted(r.asDict().items())) for r in run(spark, name)) == want and want


def test_all_ten_are_there():
    assert [int(name[2:].split("_")[0]) for name in queries.queries()] == list(range(1, 11))


def test_token_counts(spark, docs):
    got = run(spark, "op1_token_counts")
    assert {r["doc_id"]: r[1] for r in got} == {i: LIBRARY(t or "") for i, t in docs.items()} and len(got) == len(docs)


def test_licenses(spark, docs):
    got = run(spark, "op3_license_scan")
    assert {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got} == {i: plain_base(t) for i, t in docs.items()}
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 and r["labels"] == ",".join(sorted(set(r["labels"].split(",")))) for r in got)


def test_secrets(spark, docs):
    for r in run(spark, "op4_secret_scan"):
        base = plain_spans(docs[r["doc_id"]] or "")
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == kind for _, _, k in base) for kind in ("assign", "access", "hex"))
        listed = ",".join(f"{k}:{s}:{e}" for s, e, k in base)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest() and set(filter(None, listed.split(","))) <= set(r["spans"].split(","))


def test_benchmark_items(spark, docs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = [(i, t) for i, t in docs.items() if t]
    grams = {j: {tuple(w) for w in zip(*(t.lower().split()[k:] for k in range(5)))} for j, t in items}
    likely = [(i, t) for i, t in holds if any(len(g & {tuple(w) for w in zip(*(t.lower().split()[k:] for k in range(5)))}) >= 3 or len(g) < 3 for g in grams.values())]
    assert {(r["doc_id"], r["item_id"]) for r in run(spark, "op5_decontamination")} == plain_matches(likely, items)


def test_byte_bpe(spark, docs):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=tokenizers_files.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    for r in run(spark, "op9_byte_bpe"):
        text = docs[r["doc_id"]] or ""
        ids = np.asarray(library.encode_ordinary(text), "<u4")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_links_of_a_fixture_that_has_them(spark, tmp_path):
    """op6 as registered, on 3,000 vectors in 64 dimensions with groups about the threshold: recall of links, and no false one."""
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((300, 64))
    x = (centres[rng.integers(0, 300, 3000)] + rng.standard_normal((3000, 64)) * rng.choice([0.0, 0.15, 0.25, 0.3], (3000, 1))).astype(np.float32)
    labels = rng.integers(0, 2, 3000)
    spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, labels))], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.93) & (labels[:, None] == labels) & ~np.eye(3000, dtype=bool)
    got = {r["vec_id"]: r for r in queries.op6_embedding_dedup(spark, str(tmp_path)).collect()}
    n = np.array([got[i]["n_links"] for i in range(3000)])
    assert (n <= linked.sum(axis=1)).all() and n.sum() >= 0.99 * linked.sum() > 3000
    for i, j in itertools.islice(zip(*np.nonzero(linked)), 0, None, 7):
        if n[i] == linked[i].sum():
            assert got[i]["component_id"] == got[j]["component_id"]

"""The driver's contract, and each query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from strandline import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def same(rows: list[dict]) -> list[str]:
    return sorted(repr([r[c] for c in sorted(r)]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = [r.asDict() for r in queries.QUERIES[name](spark, SF).collect()]
    if name in queries.SQL:
        found = duck.execute(queries.SQL[name])
        names = [d[0] for d in found.description]
        assert same(got) == same([dict(zip(names, row)) for row in found.fetchall()])
        assert not got or set(got[0]) == set(names)
    else:
        assert len(got) > 0


@pytest.mark.parametrize("items", [["abc def", "xyz"], ["abc", "123"]])
def test_vector_matches_without_letters(spark, tmp_path, items):
    """A text without letters has a zero vector, whose cosine is NaN in SQL."""
    documents = [(0, "abc abd", "en", "s0", 7), (50, "1234 5678", "en", "s1", 9), (100, "xyy " * 200, "en", "s2", 800), (150, "", "en", "s3", 0)]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(queries.SQL["k1_vector_matches"]).fetchall()
    got = queries.QUERIES["k1_vector_matches"](spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and len(got) == 4


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() == 1


def test_rest_stands_alone():
    """Nothing outside the training-data subpackage imports it, save the entry's guard."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for path in glob.glob(f"{root}/strandline/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            with open(path, encoding="utf-8") as source:
                assert "strandline.llm" not in source.read(), path

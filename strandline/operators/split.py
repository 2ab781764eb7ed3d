"""Family-aware split and the query sets of a run."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.sources.tables import concat_sets, exists, first_by_id, load_set, save_table

PARTITIONS = ("confidential", "benign")
SPLIT = "family_id string, partition string, dataset string, seed long"


def _half_even(n: int, ratio: float) -> int:
    return int(round(n * ratio))


def ranked_split(docs: DataFrame, dataset: str, seed: int = 42, ratio: float = 0.5) -> DataFrame:
    """family_id, partition, dataset, seed: families in order of a seeded hash, the first share confidential.

    The hash of the last confidential family is found by counting families by hash prefix, so that no single task
    has to sort them all.
    """
    if not 0 < ratio < 1:
        raise ValueError(f"ratio must lie between 0 and 1: {ratio}")
    families = docs.select("family_id").where("family_id is not null").distinct().withColumn("h", F.md5(F.concat(F.lit(f"{seed}|"), "family_id")))
    n = families.count()
    take = _half_even(n, ratio)
    cut = _nth_hash(families, take) if take else ""
    part = F.when(F.col("h") <= cut, "confidential").otherwise("benign") if take else F.lit("benign")
    return families.select("family_id", part.alias("partition"), F.lit(dataset).alias("dataset"), F.lit(seed).cast("long").alias("seed"))


def _nth_hash(families: DataFrame, n: int) -> str:
    """n-th smallest hash, by narrowing a prefix until few hashes share it."""
    prefix, left = "", n
    while True:
        own = families.where(F.col("h").startswith(prefix)) if prefix else families
        size = len(prefix) + 3
        groups = own.groupBy(F.substring("h", 1, size).alias("p")).count().orderBy("p").collect()  # at most 4096 rows
        for g in groups:
            if left <= g["count"]:
                prefix, few = g["p"], g["count"] <= 10_000
                break
            left -= g["count"]
        if few or len(prefix) >= 30:
            return sorted(r["h"] for r in families.where(F.col("h").startswith(prefix)).select("h").collect())[left - 1]


def shuffled_split(docs: DataFrame, dataset: str, seed: int = 42, ratio: float = 0.5) -> DataFrame:
    """The same by numpy's seeded shuffle of the sorted families, which the driver holds: for splits that must repeat a published order."""
    if not 0 < ratio < 1:
        raise ValueError(f"ratio must lie between 0 and 1: {ratio}")
    families = np.array(sorted(r[0] for r in docs.select("family_id").where("family_id is not null").distinct().collect()))
    np.random.default_rng(seed).shuffle(families)
    confidential = set(families[: _half_even(len(families), ratio)].tolist())
    rows = [(f, "confidential" if f in confidential else "benign", dataset, seed) for f in families.tolist()]
    return docs.sparkSession.createDataFrame(rows, SPLIT)


def make_split(spark: SparkSession, prepared: str, splits: str, dataset: str, original: str, seed: int = 42, ratio: float = 0.5, overwrite: bool = False, shuffled: bool = False) -> DataFrame:
    """A stored split, made if there is none; the file's name carries set, seed and ratio."""
    path = f"{splits.rstrip('/')}/{original}__s{seed}__r{ratio:g}.parquet"
    if overwrite or not exists(spark, path):
        save_table((shuffled_split if shuffled else ranked_split)(load_set(spark, prepared, original), dataset, seed, ratio), path)
    return spark.read.schema(SPLIT).parquet(path)


def in_partition(docs: DataFrame, split: DataFrame, partition: str) -> DataFrame:
    """Documents whose family lies in a partition (F1)."""
    if partition not in PARTITIONS:
        raise ValueError(f"no such partition: {partition}")
    return docs.join(split.where(F.col("partition") == partition).select("family_id").distinct(), "family_id", "left_semi").select(docs.columns)


def uncovered(docs: DataFrame, split: DataFrame) -> DataFrame:
    """Families that the split lacks."""
    return docs.select("family_id").distinct().join(split.select("family_id"), "family_id", "left_anti")


def assert_covered(docs: DataFrame, split: DataFrame, name: str, strict: bool = False) -> None:
    """Raise or warn if a family is absent from the split (F2)."""
    missing = [r[0] for r in uncovered(docs, split).orderBy("family_id").limit(5).collect()]
    if missing:
        message = f"{name}: families absent from the split, such as {missing}"
        if strict:
            raise ValueError(message)
        print(f"WARNING {message}")


@dataclass(frozen=True)
class QuerySets:
    """Registered originals, leaks, and benign queries."""

    reference: DataFrame
    positive: DataFrame
    benign: DataFrame

    @property
    def queries(self) -> DataFrame:
        return self.positive.unionByName(self.benign)


def query_sets(original: DataFrame, variants: DataFrame | None, split: DataFrame, include_originals: bool = False, strict: bool = False) -> QuerySets:
    """Apply a split: variants of confidential families are positives, the whole benign side is benign."""
    assert_covered(original, split, "originals", strict)
    if variants is None:
        variants = original.limit(0)
    else:
        assert_covered(variants, split, "variants", strict)
    positive = [in_partition(variants, split, "confidential")]
    if include_originals:
        positive.append(in_partition(original, split, "confidential"))
    benign = [in_partition(original, split, "benign"), in_partition(variants, split, "benign")]
    return QuerySets(in_partition(original, split, "confidential"), first_by_id(positive), first_by_id(benign))


def stored_query_sets(spark: SparkSession, prepared: str, split: DataFrame, original: str, variants: list[str], include_originals: bool = False, strict: bool = False) -> QuerySets:
    return query_sets(load_set(spark, prepared, original), concat_sets(spark, prepared, variants) if variants else None, split, include_originals, strict)

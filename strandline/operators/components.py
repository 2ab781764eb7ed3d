"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is two aggregations with map-side combine and a join on the vertex; adaptive execution splits skewed
join partitions.  A step's edges are written to the shared folder, so the lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.storage import drop_written, free_shuffles, written


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component_id (smallest id reachable) of every id with an edge to another one.

    Edges may repeat and stand in either direction; nulls and loops are ignored; no edges give no rows.
    """
    distinct = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    now = written(edges.where(distinct).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.union(lowest).distinct(), "edges")
        drop_written(large)
        drop_written(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    free_shuffles(edges.sparkSession)
    own = now.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return own.union(now.select("v", "v")).distinct()

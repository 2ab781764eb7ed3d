"""Top-k rows per query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_by_query(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query with their rank; equal scores in order of reference id.

    The filter on the row number lets Spark keep k rows per query and partition before the shuffle.
    """
    order = Window.partitionBy("query_doc_id").orderBy(F.desc("score"), "ref_doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_doc_id", "query_family_id", "ref_doc_id", "ref_family_id", "score", "rank")

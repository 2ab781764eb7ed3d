"""Variants against their originals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.lexical import METRICS, with_lexical_metrics


def pairwise(originals: DataFrame, variants: DataFrame, edit: bool = True) -> DataFrame:
    """One row of metrics for each variant whose original is there."""
    source = originals.select(F.col("doc_id").alias("source_doc_id"), F.coalesce("text", F.lit("")).alias("_ref"))
    joined = variants.select("doc_id", "source_doc_id", "family_id", "variant_type", "variant_level", F.coalesce("text", F.lit("")).alias("_hyp")).join(source, "source_doc_id")
    return with_lexical_metrics(joined, "_ref", "_hyp", edit).select("doc_id", "source_doc_id", "family_id", "variant_type", "variant_level", *(m for m in METRICS if edit or m != "norm_edit_distance"))


def summary(pairs: DataFrame) -> DataFrame:
    """Mean of each metric and number of documents by variant type and level; null levels are a group."""
    return pairs.groupBy("variant_type", "variant_level").agg(*(F.avg(m).alias(m) for m in METRICS if m in pairs.columns), F.count("*").alias("n_docs"))

"""Evaluation of match tables: sweeps over all thresholds, areas, attribution, errors by family.

The sweep groups queries by score first and accumulates over score ranges: each range's total comes from a table of
at most RANGES rows, so neither the sort nor the running sums pass through a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.text import safe_ratio
from strandline.operators.matching import apply_threshold
from strandline.storage import written

RANGES = 64
FALLBACK = 0.5
F1_EPSILON = 1e-12


def manifest(positive: DataFrame, benign: DataFrame) -> DataFrame:
    """query_doc_id, is_positive, target_family_id: the truth per query."""
    yes = positive.select(F.col("doc_id").alias("query_doc_id"), F.lit(True).alias("is_positive"), F.col("family_id").alias("target_family_id"))
    return yes.unionByName(benign.select(F.col("doc_id").alias("query_doc_id"), F.lit(False).alias("is_positive"), F.lit(None).cast("string").alias("target_family_id")))


def scored(truth: DataFrame, matches: DataFrame, confidence: str = "confidence") -> DataFrame:
    """Truth with each query's score; no match, a null or NaN counts as 0."""
    own = matches.select("query_doc_id", F.col(confidence).cast("double").alias("score"))
    return truth.join(own, "query_doc_id", "left").withColumn("score", F.coalesce(F.nanvl("score", F.lit(0.0)), F.lit(0.0)))


def curve(rows: DataFrame, label: str = "is_positive", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """For each distinct score: pos and neg with it, tp and fp at or above it, and the totals p and n (per group of `by`)."""
    by = by or []
    grouped = rows.groupBy(*by, F.col(score).alias("threshold")).agg(F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg"))
    if by:
        up = Window.partitionBy(*by).orderBy(F.desc("threshold"))
        whole = Window.partitionBy(*by)
        return grouped.select(*by, "threshold", "pos", "neg", F.sum("pos").over(up).alias("tp"), F.sum("neg").over(up).alias("fp"), F.sum("pos").over(whole).alias("p"), F.sum("neg").over(whole).alias("n"))
    grouped = written(grouped, "scores")
    bounds = sorted(set(grouped.approxQuantile("threshold", [i / RANGES for i in range(1, RANGES)], 0.002)))
    part = F.size(F.filter(F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<double>"), lambda b: b <= F.col("threshold")))
    grouped = grouped.withColumn("part", part)
    totals = grouped.groupBy("part").agg(F.sum("pos").alias("pp"), F.sum("neg").alias("pn"))
    above = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)  # over at most RANGES rows
    everything = Window.partitionBy(F.lit(0))
    offsets = totals.select("part", F.coalesce(F.sum("pp").over(above), F.lit(0)).alias("tp0"), F.coalesce(F.sum("pn").over(above), F.lit(0)).alias("fp0"), F.sum("pp").over(everything).alias("p"), F.sum("pn").over(everything).alias("n"))
    up = Window.partitionBy("part").orderBy(F.desc("threshold"))
    return grouped.join(F.broadcast(offsets), "part").select("threshold", "pos", "neg", (F.col("tp0") + F.sum("pos").over(up)).alias("tp"), (F.col("fp0") + F.sum("neg").over(up)).alias("fp"), "p", "n")


def sweep(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Best F1 with its threshold (the lowest of equals), precision and recall; average precision; ROC area; share of positives.

    All but the share are null unless both classes occur.  One row (per group of `by`).
    """
    precision, recall = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")), safe_ratio(F.col("tp"), F.col("p"))
    f1 = 2 * precision * recall / (precision + recall + F.lit(F1_EPSILON))
    best = F.max(F.struct(f1.alias("f1"), (-F.col("threshold")).alias("t"), precision.alias("p"), recall.alias("r")))
    both = (F.first("p") > 0) & (F.first("n") > 0)
    ap = F.sum(safe_ratio(F.col("pos"), F.col("p")) * precision)
    auc = F.sum(F.col("pos") * (F.col("n") - F.col("fp") + F.col("neg") / 2)) / F.nullif(F.first("p") * F.first("n"), F.lit(0))
    row = points.groupBy(*(by or [])).agg(best.alias("b"), both.alias("both"), ap.alias("ap"), auc.alias("auc"), safe_ratio(F.first("p"), F.first("p") + F.first("n")).alias("positive_ratio"))

    def known(c: Column) -> Column:
        return F.when(F.col("both"), c)

    return row.select(*(by or []), known(-F.col("b.t")).alias("best_threshold"), known(F.col("b.f1")).alias("best_f1"), known(F.col("b.p")).alias("best_precision"), known(F.col("b.r")).alias("best_recall"), known(F.col("ap")).alias("pr_auc"), known(F.col("auc")).alias("roc_auc"), "positive_ratio")


def roc_points(points: DataFrame) -> DataFrame:
    """threshold, fpr, tpr (M4)."""
    return points.select("threshold", safe_ratio(F.col("fp"), F.col("n")).alias("fpr"), safe_ratio(F.col("tp"), F.col("p")).alias("tpr"))


def per_query(truth: DataFrame, matches: DataFrame, threshold: float | Column) -> DataFrame:
    """Truth with thresholded predictions."""
    return truth.join(apply_threshold(matches, threshold).drop("query_family_id"), "query_doc_id", "left").withColumn("pred_detected", F.coalesce("pred_detected", F.lit(False)))


def counts(evaluated: DataFrame) -> DataFrame:
    """Confusion counts, precision, recall, F1, accuracy and attribution accuracies: one row (A2 to A4)."""
    pos, det = F.col("is_positive"), F.col("pred_detected")
    right = pos & det & F.coalesce(F.col("pred_family_id") == F.col("target_family_id"), F.lit(False))
    row = evaluated.agg(F.count_if(pos & det).alias("tp"), F.count_if(~pos & det).alias("fp"), F.count_if(~pos & ~det).alias("tn"), F.count_if(pos & ~det).alias("fn"), F.count_if(right).alias("right"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    p, r = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    return row.select(
        "tp", "fp", "tn", "fn", p.alias("precision"), r.alias("recall"), safe_ratio(2 * p * r, p + r).alias("f1"), safe_ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        safe_ratio(F.col("right"), tp + fn).alias("family_acc_on_all_positive"), safe_ratio(F.col("right"), tp).alias("family_acc_on_detected_positive"),
    )


def evaluate(truth: DataFrame, matches: DataFrame, threshold: float | None = None) -> tuple[dict, DataFrame]:
    """(metrics, per-query table); without a threshold that of the best F1, or FALLBACK if a class is missing (M5)."""
    best = sweep(curve(scored(truth, matches))).first()
    best = best.asDict() if best else dict.fromkeys(("best_threshold", "best_f1", "best_precision", "best_recall", "pr_auc", "roc_auc", "positive_ratio"))
    used = threshold if threshold is not None else best["best_threshold"] if best["best_threshold"] is not None else FALLBACK
    rows = written(per_query(truth, matches, float(used)), "evaluated")
    got = counts(rows).first().asDict()
    detection = {k: got[k] for k in ("tp", "fp", "tn", "fn", "precision", "recall", "f1", "accuracy")}
    return {
        "threshold": float(used),
        "detection": detection,
        "detection_best": {k: best[k] for k in ("best_threshold", "best_f1", "best_precision", "best_recall")},
        "attribution": {k: got[k] for k in ("family_acc_on_all_positive", "family_acc_on_detected_positive")},
        "separability": {k: best[k] for k in ("pr_auc", "roc_auc", "positive_ratio")},
    }, rows


def errors_by_family(evaluated: DataFrame) -> DataFrame:
    """Detection of each family, attribution of its detected queries, and how many benign queries it attracts."""
    pos, det = F.col("is_positive"), F.col("pred_detected")
    right = det & F.coalesce(F.col("pred_family_id") == F.col("target_family_id"), F.lit(False))
    own = evaluated.where(pos).groupBy(F.col("target_family_id").alias("family_id")).agg(F.count("*").alias("n_positive_total"), F.count_if(det).alias("n_positive_detected"), F.count_if(right).alias("n_attribution_correct"))
    lured = evaluated.where(~pos & det & F.col("pred_family_id").isNotNull()).groupBy(F.col("pred_family_id").alias("family_id")).agg(F.count("*").alias("n_false_attraction"))
    names = ["n_positive_total", "n_positive_detected", "n_attribution_correct", "n_false_attraction"]
    joined = own.join(lured, "family_id", "full").select("family_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in names))
    rated = joined.withColumns({"detection_rate": safe_ratio(F.col("n_positive_detected"), F.col("n_positive_total")), "attribution_rate": safe_ratio(F.col("n_attribution_correct"), F.col("n_positive_detected"))})
    return rated.orderBy(F.desc("n_positive_total"), F.desc("n_false_attraction"), "family_id")


def false_positives(evaluated: DataFrame) -> DataFrame:
    """Flagged benign queries, the most confident first."""
    columns = [c for c in ("query_doc_id", "query_family_id", "pred_doc_id", "pred_family_id", "confidence") if c in evaluated.columns]
    return evaluated.where(~F.col("is_positive") & F.col("pred_detected")).select(columns).orderBy(F.desc("confidence"), "query_doc_id")

"""The figure of ROC curves, one panel per dataset, as SVG."""

from __future__ import annotations

from html import escape
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.plans.evaluation import curve, roc_points
from strandline.plans.report import COLUMNS, PANELS, ROWS, metrics_table, roc_table, run_of

#: Size of a panel in pixels, and the steps per axis that it can show; a curve's points are thinned to those.
SIDE, MARGIN, STEPS = 320, 48, 640
#: Line styles of the rows in order: colour and dash pattern, so that curves differ without colour too (fixed values).
STYLES = [("#0b5fa5", ""), ("#c2571a", "6 3"), ("#2a7f3f", "2 3"), ("#7a3d9c", "8 3 2 3"), ("#555555", "1 2")]


def thinned(points: DataFrame) -> DataFrame:
    """fpr, tpr: the highest tpr within each visible step of fpr, at most STEPS + 1 rows; a straight run keeps its ends."""
    step = F.floor(F.col("fpr") * STEPS)
    return points.groupBy(step.alias("step")).agg(F.min("fpr").alias("fpr"), F.max("tpr").alias("tpr")).orderBy("step").select("fpr", "tpr")


def panel(title: str, curves: list[tuple[str, float, list[tuple[float, float]], tuple[str, str]]], left: float) -> str:
    """One panel: axes, diagonal, a polyline and a legend line with the area for each curve."""
    x = lambda v: round(left + MARGIN + v * SIDE, 2)
    y = lambda v: round(MARGIN + (1 - v) * SIDE, 2)
    out = [f'<rect x="{x(0)}" y="{y(1)}" width="{SIDE}" height="{SIDE}" fill="none" stroke="#999"/>', f'<line x1="{x(0)}" y1="{y(0)}" x2="{x(1)}" y2="{y(1)}" stroke="#ccc"/>']
    out += [f'<text x="{x(0.5)}" y="{MARGIN - 16}" text-anchor="middle">{escape(title)}</text>', f'<text x="{x(0.5)}" y="{y(0) + 34}" text-anchor="middle">False positive rate</text>']
    for v in (0, 0.5, 1):
        out.append(f'<text x="{x(v)}" y="{y(0) + 16}" text-anchor="middle">{v:g}</text><text x="{x(0) - 8}" y="{y(v) + 4}" text-anchor="end">{v:g}</text>')
    for i, (label, area, points, (colour, dash)) in enumerate(curves):
        line = " ".join(f"{x(a)},{y(b)}" for a, b in [(0.0, 0.0), *points, (1.0, 1.0)])
        at = y(0) - 14 - 16 * (len(curves) - 1 - i)
        out.append(f'<polyline points="{line}" fill="none" stroke="{colour}" stroke-width="2" stroke-dasharray="{dash}"/>')
        out.append(f'<line x1="{x(0.42)}" y1="{at - 4}" x2="{x(0.5)}" y2="{at - 4}" stroke="{colour}" stroke-width="2" stroke-dasharray="{dash}"/><text x="{x(0.52)}" y="{at}">{escape(label)} ({area:.3f})</text>')
    return "".join(out)


def roc_figure(spark: SparkSession, artifacts: str, path: str, panels: tuple[str, ...] = PANELS, rows: list[tuple[str, str, str | None]] = ROWS) -> dict[str, dict[str, float]]:
    """Draw the panels that have runs to `path`; areas by panel and label."""
    runs, titles = metrics_table(spark, artifacts).cache(), dict(COLUMNS)
    areas: dict[str, dict[str, float]] = {}
    for r in roc_table(spark, artifacts, panels, rows).collect():
        areas.setdefault(r["panel"], {})[r["label"]] = r["roc_auc"]
    drawn = []
    for name in (p for p in panels if p in areas):
        curves = []
        for (label, method, part), style in zip(rows, STYLES * len(rows)):
            if label in areas[name]:
                scores = spark.read.parquet(f"{artifacts}/runs/{run_of(runs, name, method, part)}/per_query_eval.parquet").select("is_positive", F.coalesce("confidence", F.lit(0.0)).alias("score"))
                curves.append((label, areas[name][label], [(r["fpr"], r["tpr"]) for r in thinned(roc_points(curve(scores))).collect()], style))
        drawn.append(panel(titles.get(name, name), curves, len(drawn) * (SIDE + 2 * MARGIN)))
    width, height = max(1, len(drawn)) * (SIDE + 2 * MARGIN), SIDE + 2 * MARGIN
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="11">{"".join(drawn)}</svg>', encoding="utf-8")
    return areas

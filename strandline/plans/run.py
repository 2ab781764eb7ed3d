"""A whole run: split, query sets, method, evaluation, artifacts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from strandline.operators.matching import METHODS, REGISTER
from strandline.operators.split import make_split, stored_query_sets
from strandline.plans.config import RunConfig
from strandline.plans.evaluation import errors_by_family, evaluate, false_positives, manifest
from strandline.sources.tables import save_json, save_table
from strandline.storage import written


@contextmanager
def timer() -> Iterator[dict]:
    """Seconds of a block; lazy plans cost nothing, so the block must hold an action (X11)."""
    out = {"sec": 0.0}
    began = time.perf_counter()
    try:
        yield out
    finally:
        out["sec"] = time.perf_counter() - began


def save_run(folder: str, truth: DataFrame, matches: DataFrame, timing: dict, method: str, counts: dict, dataset: str | None = None, variant_sets=(), include_originals: bool | None = None) -> dict:
    """Evaluate and write the artifacts."""
    metrics, rows = evaluate(truth, matches)
    metrics |= {"method": method, "dataset": dataset, "variant_sets": list(variant_sets), "include_original_as_positive": include_originals, "timing_sec": dict(timing), "counts": dict(counts)}
    tables = {"matches": matches, "query_manifest": truth, "per_query_eval": rows, "errors_by_family": errors_by_family(rows), "fp_pairs": false_positives(rows)}
    for name, table in tables.items():
        save_table(table, f"{folder}/{name}.parquet")
    save_json(metrics, f"{folder}/metrics.json")
    return metrics


def run(spark: SparkSession, cfg: RunConfig, method: Callable[..., DataFrame] | None = None, tag: str = "") -> dict:
    """Execute one experiment and return its metrics."""
    own, method = method is None, method or METHODS[cfg.method]
    folder = cfg.folder(tag)
    save_json(cfg.as_dict(), f"{folder}/config.json")
    with timer() as total:
        split = make_split(spark, cfg.prepared_dir, cfg.splits_dir, cfg.dataset, cfg.original, cfg.split_seed, cfg.split_ratio)
        save_table(split, f"{folder}/splits_used.parquet")
        sets = stored_query_sets(spark, cfg.prepared_dir, split, cfg.original, list(cfg.variants), cfg.include_original_as_positive, strict=True)
        truth = written(manifest(sets.positive, sets.benign), "truth")
        with timer() as build:  # a method without a registration of its own takes none
            reference = written(REGISTER[cfg.method](sets.reference, **cfg.method_params), "reference") if own and cfg.method in REGISTER else sets.reference
        with timer() as inference:
            matches = written(method(reference, sets.queries, **cfg.method_params), "matches")
    sizes = {r["is_positive"]: r["count"] for r in truth.groupBy("is_positive").count().collect()}
    counts = {"n_ref_docs": sets.reference.count(), "n_query_docs": sum(sizes.values()), "n_positive": sizes.get(True, 0), "n_benign": sizes.get(False, 0)}
    timing = {"inference_total_sec": inference["sec"], "build_sec": build["sec"], "total_sec": total["sec"]}
    return save_run(folder, truth, matches, timing, cfg.method, counts, cfg.dataset, cfg.variants, cfg.include_original_as_positive)

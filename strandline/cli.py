"""Command line: prepare, run, table, corpus, figure, vary, quality."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandline.operators.lexical_pairs import pairwise, summary
from strandline.plans.config import RunConfig, configs
from strandline.plans.figure import roc_figure
from strandline.plans.report import corpus_table, result_tables, roc_table, stacked
from strandline.plans.run import run
from strandline.plans.translations import prepare_translations
from strandline.plans.variation import Variation, prepare_variants
from strandline.plans.versions import prepare_versions
from strandline.session import build, ship
from strandline.sources.tables import concat_sets, load_set, load_yaml, prepare_keyphrases, read_splits, read_works, save_csv, save_table


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandline")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *options: tuple) -> None:
        p = sub.add_parser(name)
        for flags, kw in options:
            p.add_argument(flags, **kw)

    prepared, artifacts, csv = ("--prepared", {"default": "data/prepared"}), ("--artifacts", {"default": "artifacts"}), ("--csv", {})
    add("prepare", ("kind", {"choices": ["keyphrases", "translations", "versions"]}), ("source", {"nargs": "+", "help": "file, or sentence pairs, mapping and metadata (each split=path,...)"}), prepared, ("--trust-pickle", {"action": "store_true"}))
    add("run", ("config", {}), ("--tag", {"default": ""}))
    add("table", artifacts, csv)
    add("corpus", prepared, artifacts, ("--model", {"default": "hashed"}), ("--window", {"type": int}), csv)
    add("figure", artifacts, csv, ("--svg", {"default": "artifacts/figures/roc.svg"}))
    add("vary", ("dataset", {}), ("original", {}), ("function", {"help": "module:name of list[str] -> list[str]"}), prepared, ("--lex", {"type": int, "default": 60}), ("--order", {"type": int, "default": 60}), ("--seed", {"type": int, "default": 42}), ("--batch", {"type": int, "default": 1}), ("--limit", {"type": int}))
    add("quality", ("original", {}), ("variants", {"nargs": "+"}), prepared, ("--out", {}))
    return top


def _table(text: str) -> dict[str, str]:
    return dict(part.split("=", 1) for part in text.split(","))


def run_all(spark: SparkSession, runs: list[RunConfig], tag: str = "") -> list[str]:
    """Every run of a matrix; the names of those that failed, which the others don't wait for."""
    failed = []
    for cfg in runs:
        try:
            m = run(spark, cfg, tag=tag)
            print(cfg.ident(), m["detection_best"]["best_f1"], m["attribution"]["family_acc_on_all_positive"])
        except Exception as e:  # noqa: BLE001  whatever stops one run
            failed.append(cfg.ident())
            print(f"FAILED {cfg.ident()}: {type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}", file=sys.stderr)
    return failed


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = ship(build("strandline"))
    if a.command == "prepare":
        if a.kind == "keyphrases":
            print(prepare_keyphrases(spark, a.source[0], a.prepared))
        elif a.kind == "translations":
            print(*prepare_translations(read_works(spark, a.source[0], a.trust_pickle), a.prepared), sep="\n")
        else:
            print(prepare_versions(*(read_splits(spark, _table(s)) for s in a.source), a.prepared))
    elif a.command == "run":
        return 1 if run_all(spark, configs(load_yaml(a.config)), a.tag) else 0
    elif a.command == "vary":
        module, _, name = a.function.partition(":")
        docs = load_set(spark, a.prepared, a.original)
        docs = docs.orderBy("doc_id").limit(a.limit) if a.limit else docs
        how = Variation(a.lex, a.order, seed=a.seed)
        print(prepare_variants(docs, a.prepared, a.dataset, getattr(importlib.import_module(module), name), how, a.batch))
    elif a.command == "quality":
        pairs = pairwise(load_set(spark, a.prepared, a.original), concat_sets(spark, a.prepared, a.variants))
        if a.out:
            save_table(pairs, a.out)
        summary(pairs).orderBy("variant_type", F.asc_nulls_first("variant_level")).show(truncate=False)
    else:
        out = stacked(result_tables(spark, a.artifacts)) if a.command == "table" else corpus_table(spark, a.prepared, a.artifacts, a.model, window=a.window) if a.command == "corpus" else roc_table(spark, a.artifacts)
        if a.command == "figure":
            roc_figure(spark, a.artifacts, a.svg)
        out.show(100, truncate=False)
        if a.csv:
            save_csv(out, a.csv)
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""Result tables from run artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.text import model_slug
from strandline.plans.config import DATASETS
from strandline.plans.evaluation import curve, sweep
from strandline.sources.tables import concat_sets, exists, load_set

#: Rows (label, method, part of the run's tag or None), columns (dataset, label) and metrics of the result table (fixed values).
ROWS = [("Vector (Qwen3 0.6B)", "vector", "qwen3"), ("Vector (Granite 97M)", "vector", "granite"), ("Vector (BGE 109M)", "vector", "bge"), ("BM25", "bm25", None), ("Fuzzy hash", "fuzzy", None)]
COLUMNS = [("krapivin", "Krapivin paraphrase"), ("par3", "PAR3 translation"), ("casimir_raw", "CASIMIR revision"), ("casimir_dedup", "CASIMIR revision (dedup)")]
METRICS = {"best_f1": "Best-F1 under an oracle threshold", "attribution": "Source-attribution accuracy"}
PANELS = ("par3", "casimir_raw")

SCHEMA = """method string, dataset string, variant_sets array<string>, include_original_as_positive boolean,
detection struct<f1:double>, detection_best struct<best_f1:double,best_threshold:double,best_precision:double,best_recall:double>,
attribution struct<family_acc_on_all_positive:double,family_acc_on_detected_positive:double>, separability struct<roc_auc:double,pr_auc:double>,
timing_sec struct<inference_total_sec:double,build_sec:double>, counts struct<n_ref_docs:long,n_query_docs:long>"""
FLAT = """method string, dataset string, variant_sets string, inclorig boolean, run_ident string, run_tag string, best_f1 double, best_threshold double, best_precision double,
best_recall double, attribution double, attribution_on_detected double, f1 double, roc_auc double, pr_auc double, inference_sec double, registration_sec double, n_ref_docs long, n_query_docs long"""


def metrics_table(spark: SparkSession, artifacts: str) -> DataFrame:
    """One flat row for each `runs/<ident>/<tag>/metrics.json`, in order of path."""
    try:
        raw = spark.read.schema(SCHEMA).json(f"{artifacts}/runs/*/*/metrics.json", multiLine=True)
    except Exception as e:  # no run yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], FLAT)
    parts = F.split(F.col("_metadata.file_path"), "/")
    flat = raw.select(
        "method", "dataset", F.array_join(F.coalesce("variant_sets", F.array().cast("array<string>")), "|").alias("variant_sets"), F.col("include_original_as_positive").alias("inclorig"),
        F.element_at(parts, -3).alias("run_ident"), F.element_at(parts, -2).alias("run_tag"), "detection_best.best_f1", "detection_best.best_threshold", "detection_best.best_precision",
        "detection_best.best_recall", F.col("attribution.family_acc_on_all_positive").alias("attribution_all"), F.col("attribution.family_acc_on_detected_positive").alias("attribution_on_detected"),
        "detection.f1", "separability.roc_auc", "separability.pr_auc", F.col("timing_sec.inference_total_sec").alias("inference_sec"), F.col("timing_sec.build_sec").alias("registration_sec"),
        "counts.n_ref_docs", "counts.n_query_docs",
    ).withColumnRenamed("attribution_all", "attribution")
    return flat.orderBy("run_ident", "run_tag")


def on_axis(runs: DataFrame, dataset: str, variant_sets: tuple[str, ...] | None = None, include_originals: bool = False) -> DataFrame:
    """Runs of one experiment: its dataset, variants and whether originals count as positives."""
    wanted = "|".join(variant_sets if variant_sets is not None else DATASETS[dataset][1])
    return runs.where((F.col("dataset") == dataset) & (F.col("variant_sets") == wanted) & F.col("inclorig").eqNullSafe(F.lit(include_originals)))


def tagged(runs: DataFrame, part: str | None) -> DataFrame:
    """Runs whose tag contains a part, in either case; a null tag doesn't."""
    return runs if not part else runs.where(F.coalesce(F.lower("run_tag").contains(part.lower()), F.lit(False)))


def result_table(runs: DataFrame, value: str = "best_f1", rows: list[tuple[str, str, str | None]] = ROWS, columns: list[tuple[str, str]] = COLUMNS, include_originals: bool = False, variant_sets: dict[str, tuple[str, ...]] | None = None, digits: int = 3) -> DataFrame:
    """label and one column for each dataset that has runs; raises if a cell matches more than one run.

    Cells come from one join of the runs with the small tables of rows and columns, then a pivot over known columns.
    """
    spark, variant_sets = runs.sparkSession, variant_sets or {}
    present = {r[0] for r in runs.select("dataset").where("dataset is not null").distinct().collect()}
    shown = [(key, label) for key, label in columns if key in present]
    row_spec = spark.createDataFrame([(i, label, method, (part or "").lower()) for i, (label, method, part) in enumerate(rows)], "pos int, label string, method string, part string")
    col_spec = spark.createDataFrame([(key, label, "|".join(variant_sets.get(key) or DATASETS[key][1])) for key, label in shown], "dataset string, column string, variant_sets string")
    own = runs.where(F.col(value).isNotNull() & F.col("inclorig").eqNullSafe(F.lit(include_originals)))
    cells = own.join(F.broadcast(col_spec), ["dataset", "variant_sets"]).join(F.broadcast(row_spec), "method").where((F.col("part") == "") | F.coalesce(F.lower("run_tag").contains(F.col("part")), F.lit(False)))
    unclear = cells.groupBy("label", "column").agg(F.collect_set(F.concat_ws("/", "run_ident", "run_tag")).alias("runs")).where(F.size("runs") > 1).limit(1).collect()
    if unclear:
        r = unclear[0]
        raise ValueError(f"cell {r['label']!r} x {r['column']!r} matches {len(r['runs'])} runs: {sorted(r['runs'])}")
    names = [label for _, label in shown]
    table = row_spec.select("pos", "label").join(cells.select("label", "column", value), "label", "left").groupBy("pos", "label").pivot("column", names or ["-"]).agg(F.bround(F.first(value), digits))
    return table.orderBy("pos").select("label", *(f"`{n}`" for n in names))


def result_tables(spark: SparkSession, artifacts: str, **options) -> dict[str, DataFrame]:
    """The blocks of the result table by caption (M9)."""
    runs = metrics_table(spark, artifacts).cache()
    return {caption: result_table(runs, value, **options) for value, caption in METRICS.items()}


def stacked(tables: dict[str, DataFrame]) -> DataFrame:
    """Captioned tables as one, for CSV."""
    out = None
    for caption, t in tables.items():
        own = t.select(F.lit(caption).alias("metric"), "*")
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def corpus_table(spark: SparkSession, prepared: str, artifacts: str, model: str, dtype: str = "float32", window: int | None = None) -> DataFrame:
    """dataset, original_set, docs, variants, over_window_pct of each dataset whose sets are there."""
    cache = f"{artifacts}/embeddings/{model_slug(model)}"
    rows = []
    for dataset, (original, variants) in DATASETS.items():
        try:
            docs = load_set(spark, prepared, original).count()
            n = concat_sets(spark, prepared, list(variants)).count()
        except FileNotFoundError:
            continue
        path = f"{cache}/{original}__L{window}__{dtype}.parquet"
        over = None
        if window is not None and exists(spark, path):
            r = spark.read.parquet(path).agg(F.count("*").alias("n"), F.count_if(F.col("n_windows") > 1).alias("over")).first()
            over = 100.0 * r["over"] / r["n"] if r["n"] else None
        rows.append((dataset, original, docs, n, over))
    return spark.createDataFrame(rows, "dataset string, original_set string, docs long, variants long, over_window_pct double")


def prorated_cost(costs: DataFrame, members: DataFrame, used: DataFrame) -> DataFrame:
    """set_name, seconds: each set's encoding time in proportion to its documents that a run used.

    costs: set_name, sec.  members: set_name, doc_id.  used: doc_id.
    """
    share = members.join(used.select("doc_id").distinct().withColumn("_used", F.lit(1)), "doc_id", "left").groupBy("set_name").agg((F.count("_used") / F.count("*")).alias("share"))
    return costs.join(share, "set_name").select("set_name", (F.col("sec") * F.col("share")).alias("seconds"))


def run_of(runs: DataFrame, dataset: str, method: str, part: str | None) -> str | None:
    """ident/tag of the one run of a cell; None if there is none, an error if there are several."""
    found = [f"{r['run_ident']}/{r['run_tag']}" for r in on_axis(tagged(runs.where(F.col("method") == method), part), dataset).select("run_ident", "run_tag").distinct().limit(3).collect()]
    if len(found) > 1:
        raise ValueError(f"{dataset}, {method}: {found}")
    return found[0] if found else None


def roc_table(spark: SparkSession, artifacts: str, panels: tuple[str, ...] = PANELS, rows: list[tuple[str, str, str | None]] = ROWS) -> DataFrame:
    """panel, label, roc_auc of every run of the figure (M12, M13); runs with one class only are left out."""
    runs = metrics_table(spark, artifacts).cache()
    out = spark.createDataFrame([], "panel string, label string, roc_auc double")
    for panel in panels:
        for label, method, part in rows:
            at = run_of(runs, panel, method, part)
            if at is not None:
                scores = spark.read.parquet(f"{artifacts}/runs/{at}/per_query_eval.parquet").select("is_positive", F.coalesce("confidence", F.lit(0.0)).alias("score"))
                out = out.union(sweep(curve(scores)).where("roc_auc is not null").select(F.lit(panel), F.lit(label), "roc_auc"))
    return out

"""The canonical document table, prepared sets, and readers of raw records (S1 to S12, S16, S17; P1 to P3)."""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterable
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from strandline.functions.text import clean, record_text, word_count

REQUIRED = ("doc_id", "dataset", "family_id", "text")
DOCS = StructType(
    [StructField(c, StringType(), c not in REQUIRED) for c in REQUIRED]
    + [StructField("version_index", LongType()), StructField("variant_type", StringType()), StructField("variant_level", StringType()), StructField("variant_seed", LongType()), StructField("source_doc_id", StringType())]
    + [StructField("num_chars", IntegerType()), StructField("num_words", IntegerType()), StructField("meta_json", StringType())]
)
COLUMNS = [f.name for f in DOCS]
DEFAULTS = {"variant_type": "original", "meta_json": "{}"}


def require(df: DataFrame, names: Iterable[str], what: str = "table") -> DataFrame:
    """Raise if a column is missing."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks the columns {missing}")
    return df


def normalize_docs(df: DataFrame, check: bool = True) -> DataFrame:
    """The twelve canonical columns in order: defaults for absent ones, lengths from the text.

    check: count repeated ids now and raise, naming at most ten.
    """
    require(df, REQUIRED, "docs")

    def column(f: StructField) -> Column:
        c = F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)
        if f.name == "meta_json" and f.name in df.columns and not isinstance(df.schema[f.name].dataType, StringType):
            c = F.when(c.isNotNull(), F.to_json(c, {"ignoreNullFields": "false"}))
        c = c.cast(f.dataType)
        return (F.coalesce(c, F.lit(DEFAULTS[f.name])) if f.name in DEFAULTS else c).alias(f.name)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    made = {"text": text, "num_chars": F.length(text).cast("int"), "num_words": word_count(text)}
    out = df.select(*(made[f.name].alias(f.name) if f.name in made else column(f) for f in DOCS))
    if check:
        repeated = [r["doc_id"] for r in out.groupBy("doc_id").count().where("count > 1").orderBy("doc_id").limit(10).collect()]
        if repeated:
            raise ValueError(f"repeated doc_id: {repeated}")
    return out


def set_path(folder: str, name: str) -> str:
    return f"{str(folder).rstrip('/')}/{name}.parquet"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store it names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def load_set(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A prepared set."""
    path = set_path(folder, name)
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.schema(DOCS).parquet(path)


def save_set(df: DataFrame, folder: str, name: str) -> str:
    """Normalise and write."""
    path = set_path(folder, name)
    normalize_docs(df).write.mode("overwrite").parquet(path)
    return path


def save_table(df: DataFrame, path: str) -> str:
    """A plain Parquet table."""
    df.write.mode("overwrite").parquet(str(path))
    return str(path)


def save_csv(df: DataFrame, path: str) -> str:
    """A report as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(str(path), header=True)
    return str(path)


def save_json(data, path: str | Path) -> Path:
    """A small object as JSON; Unicode stays."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(data, ensure_ascii=False, indent=2, default=str), encoding="utf-8")
    return path


def load_yaml(path: str | Path) -> dict:
    """A small specification."""
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def first_by_id(parts: list[DataFrame]) -> DataFrame:
    """Union of document tables; of rows with one doc_id the one of the first table stays, within a table the first by content."""
    ordered = reduce(DataFrame.unionByName, (p.withColumn("_set", F.lit(i)) for i, p in enumerate(parts)))
    rest = [c for c in parts[0].columns if c != "doc_id"]
    pick = Window.partitionBy("doc_id").orderBy("_set", *rest)
    return ordered.withColumn("_nth", F.row_number().over(pick)).where("_nth = 1").drop("_nth", "_set")


def concat_sets(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """Several prepared sets as one."""
    if not names:
        raise ValueError("no sets to concatenate")
    return normalize_docs(first_by_id([load_set(spark, folder, n) for n in names]), check=False)


RECORD = "name string, title string, abstract string, fulltext string, keywords string"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON array, or of one JSON object per line.

    The first character that is not white space decides; either form is parsed by the executors.
    """
    head = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    if not head:
        return spark.createDataFrame([], RECORD)
    array = head[0]["value"].lstrip().startswith("[")
    return spark.read.json(path, multiLine=array)


def keyphrase_docs(records: DataFrame, dataset: str = "krapivin", source: str = "") -> DataFrame:
    """Canonical documents of keyphrase records (B3); records without a name or a text are skipped."""
    from strandline.functions.text import col_or, doc_id, family_id, meta_json

    got = records.select(*(clean(col_or(records, c)).alias(c) for c in ("name", "title", "abstract", "fulltext", "keywords")))
    got = got.withColumn("text", record_text(F.col("title"), F.col("abstract"), F.col("fulltext"))).where((F.col("name") != "") & (F.col("text") != ""))
    family = family_id(F.lit(dataset), F.col("name"))
    docs = got.select(
        doc_id(family, F.lit("orig")).alias("doc_id"),
        F.lit(dataset).alias("dataset"),
        family.alias("family_id"),
        "text",
        F.lit("original").alias("variant_type"),
        meta_json(raw_name=F.col("name"), title=F.col("title"), keywords=F.col("keywords"), source_path=F.lit(str(source))).alias("meta_json"),
    )
    if docs.isEmpty():
        raise ValueError(f"{source}: no record has both a name and a text; the columns are {sorted(records.columns)}")
    return normalize_docs(docs, check=False)


def prepare_keyphrases(spark: SparkSession, path: str, folder: str, dataset: str = "krapivin") -> str:
    """Read records and write the set `<dataset>_original`."""
    return save_set(keyphrase_docs(read_records(spark, path), dataset, path), folder, f"{dataset}_original")


WORKS = "work_id string, gt_paras array<string>, source_paras array<string>, translators map<string,array<string>>"


def read_works(spark: SparkSession, path: str, trust_pickle: bool = False) -> DataFrame:
    """Translation works (S9): Parquet or JSON of WORKS, or, if trusted, a pickled dictionary read by the driver."""
    if str(path).endswith((".pkl", ".pickle")):
        if not trust_pickle:
            raise ValueError("a pickle can run any code; pass trust_pickle=True for a file you trust")
        with open(path, "rb") as file:
            data = pickle.load(file)  # noqa: S301
        rows = [(w, d["gt_paras"], d["source_paras"], {k: t["translator_paras"] for k, t in d["translator_data"].items()}) for w, d in data.items()]
        return spark.createDataFrame(rows, WORKS)
    return spark.read.schema(WORKS).json(path, multiLine=False) if str(path).endswith((".json", ".jsonl")) else spark.read.schema(WORKS).parquet(path)


def read_splits(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Files of several splits as one table, with the split's name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (spark.read.parquet(p).withColumn("split", F.lit(s)) for s, p in paths.items()))

"""Versions of papers from sentence pairs: texts, forums, dates, duplicate forums, revision sets."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.text import clean, col_or, doc_id, family_id, listlike_of, meta_json, number_or_last, paperhash, revision_key, sentence_type, short_hash, stripped
from strandline.operators.near_duplicates import TAU, resolve_duplicates
from strandline.sources.tables import normalize_docs, save_set, save_table
from strandline.storage import written

ORDER = ("page", "num_section", "num_paragraph", "num_sentence", "pair_index", "side", "sentence_id")


def side_sentences(pairs: DataFrame, side: int) -> DataFrame:
    """One side of the sentence pairs as rows of titles, abstracts and paragraphs."""

    def raw(name: str) -> Column:
        return col_or(pairs, name)

    at = {"page": raw(f"page-sentence-{side}"), **{c: raw(f"{c}-sentence-{side}") for c in ("num_section", "num_paragraph", "num_sentence")}}
    rows = pairs.select(
        clean(raw(f"id_version_{side}")).alias("version_id"),
        clean(raw(f"id-sentence-{side}")).alias("sentence_id"),
        clean(raw(f"text-sentence-{side}")).alias("text"),
        sentence_type(raw(f"type-sentence-{side}")).alias("sentence_type"),
        *(c.cast("string").alias(f"_{name}") for name, c in at.items()),
        *(number_or_last(c.cast("string")).alias(name) for name, c in at.items()),
        number_or_last(raw("sentence-pair-index").cast("string")).alias("pair_index"),
        F.lit(side).alias("side"),
    )
    rows = rows.where((F.col("version_id") != "") & (F.col("text") != "") & F.col("sentence_type").isin("title", "abstract", "p"))
    rows = rows.where(~((F.col("sentence_type") == "abstract") & (F.lower("text") == "abstract")))
    made = F.concat_ws("::", "version_id", *(F.coalesce(f"_{name}", F.lit("<NA>")) for name in at), short_hash(F.col("text")))
    return rows.withColumn("sentence_id", F.when(F.col("sentence_id") == "", made).otherwise(F.col("sentence_id"))).drop(*(f"_{name}" for name in at))


def version_sentences(pairs: DataFrame) -> DataFrame:
    """Both sides, each sentence of a version once, the first in document order."""
    both = side_sentences(pairs, 1).unionByName(side_sentences(pairs, 2))
    first = Window.partitionBy("version_id", "sentence_id").orderBy(*ORDER, "text")
    return both.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def version_texts(pairs: DataFrame) -> DataFrame:
    """version_id, text, num_sent_rows: sentences in document order, a header before each run of abstract sentences."""
    order = Window.partitionBy("version_id").orderBy(*ORDER)
    rows = version_sentences(pairs).withColumns({"prev": F.lag("sentence_type").over(order), "nth": F.row_number().over(order)})
    starts = (F.col("sentence_type") == "abstract") & (F.coalesce("prev", F.lit("")) != "abstract")
    piece = F.when(starts, F.concat(F.lit("Abstract\n"), "text")).otherwise(F.col("text"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", piece.alias("t")))), lambda x: x["t"]), "\n\n")
    return rows.groupBy("version_id").agg(stripped(text).alias("text"), F.count("*").alias("num_sent_rows")).where("text <> ''")


def _in_order(df: DataFrame) -> DataFrame:
    return df.withColumn("_ord", F.monotonically_increasing_id())


def forum_links(mapping: DataFrame) -> DataFrame:
    """version_id, forum_from_mapping: a forum's references and the forum itself; the first mention counts."""
    rows = _in_order(mapping).select("_ord", clean(F.col("id_forum")).alias("forum"), listlike_of(mapping, "references").alias("refs"))
    own = rows.where("forum <> ''").select("_ord", F.lit(-1).alias("pos"), F.col("forum").alias("version_id"), "forum")
    named = rows.select("_ord", F.posexplode("refs").alias("pos", "version_id"), "forum")
    all_ = own.union(named.select("_ord", "pos", "version_id", "forum"))
    return all_.groupBy("version_id").agg(F.min(F.struct("_ord", "pos", "forum")).alias("f")).select("version_id", F.col("f.forum").alias("forum_from_mapping"))


def version_meta(texts: DataFrame, mapping: DataFrame, metadata: DataFrame) -> DataFrame:
    """version_id, text, forum_id, version_ts, num_sent_rows (B12, J4 to J6): forum by metadata, else mapping, else the version itself."""
    ts = F.coalesce(col_or(metadata, "cdate").cast("string").try_cast("double"), col_or(metadata, "tcdate").cast("string").try_cast("double"))
    meta = metadata.select(clean(F.col("id")).alias("version_id"), clean(F.col("forum")).alias("from_meta"), ts.alias("version_ts"))
    joined = texts.join(meta, "version_id", "left").join(forum_links(mapping), "version_id", "left")
    forum = F.coalesce(F.nullif("from_meta", F.lit("")), F.nullif("forum_from_mapping", F.lit("")), "version_id")
    return joined.select("version_id", "text", forum.alias("forum_id"), "version_ts", "num_sent_rows")


def forum_signals(texts: DataFrame, mapping: DataFrame, metadata: DataFrame) -> DataFrame:
    """forum_id, text, date, paperhash, split of each forum that has a text."""
    rows = _in_order(mapping).select("_ord", clean(F.col("id_forum")).alias("forum_id"), listlike_of(mapping, "references").alias("refs"), col_or(mapping, "split").cast("string").alias("split"))
    rows = rows.where("forum_id <> ''")
    named = rows.select("_ord", "forum_id", F.posexplode("refs").alias("pos", "version_id"))
    clean_texts = texts.select(clean(F.col("version_id")).alias("version_id"), "text")
    first = named.join(clean_texts.select("version_id"), "version_id", "left_semi").groupBy("forum_id").agg(F.min(F.struct("_ord", "pos", "version_id")).alias("f")).select("forum_id", F.col("f.version_id").alias("version_id"))
    bodies = first.join(clean_texts, "version_id").select("forum_id", "text")
    splits = rows.groupBy("forum_id").agg(F.max(F.struct("_ord", "split")).alias("s")).select("forum_id", F.col("s.split").alias("split"))
    meta = _in_order(metadata).withColumn("forum_id", clean(F.col("forum"))).where("forum_id <> ''")

    def least(name: str) -> Column:
        return F.min(col_or(meta, name).cast("string").try_cast("double"))

    ph = paperhash(col_or(meta, "content"))
    facts = meta.withColumn("_ph", ph).groupBy("forum_id").agg(F.coalesce(least("tcdate"), least("cdate"), least("pdate")).cast("long").alias("date"), F.min(F.when(F.col("_ph") != "", F.struct("_ord", "_ph"))).alias("h"))
    return bodies.join(facts, "forum_id", "left").join(splits, "forum_id", "left").select("forum_id", "text", "date", F.coalesce("h._ph", F.lit("")).alias("paperhash"), "split")


def assemble(meta: DataFrame, kept: DataFrame | None, splits: DataFrame, dataset: str = "casimir") -> DataFrame:
    """Canonical documents, versions numbered within each forum by time (nulls last), then id."""
    rows = meta if kept is None else meta.join(kept.select("forum_id"), "forum_id", "left_semi")
    order = Window.partitionBy("forum_id").orderBy(F.asc_nulls_last("version_ts"), "version_id")
    rows = rows.withColumn("version_index", F.row_number().over(order)).join(splits.select("forum_id", "split"), "forum_id", "left")
    family = family_id(F.lit(dataset), F.col("forum_id"))
    later = F.col("version_index") > 1
    docs = rows.select(
        doc_id(family, revision_key(F.col("version_index"))).alias("doc_id"),
        F.lit(dataset).alias("dataset"),
        family.alias("family_id"),
        "text",
        F.col("version_index").cast("long").alias("version_index"),
        F.when(later, "revision").otherwise("original").alias("variant_type"),
        F.when(later, doc_id(family, F.lit("v1"))).alias("source_doc_id"),
        meta_json(forum_id=F.col("forum_id"), raw_version_id=F.col("version_id"), split=F.col("split"), version_ts=F.col("version_ts"), num_sent_rows=F.col("num_sent_rows")).alias("meta_json"),
    )
    return normalize_docs(docs, check=False)


def build_versions(pairs: DataFrame, mapping: DataFrame, metadata: DataFrame, tau: float = TAU) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents without duplicate forums, drop log, all documents)."""
    texts = written(version_texts(pairs), "texts")
    meta = version_meta(texts, mapping, metadata)
    signals = written(forum_signals(texts, mapping, metadata), "signals")
    kept, log = resolve_duplicates(signals, tau)
    return assemble(meta, kept, signals), log, assemble(meta, None, signals)


def revision_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(first versions, later versions, latest versions) of families with two versions or more."""
    last = docs.groupBy("family_id").agg(F.max("version_index").alias("_last")).where("_last >= 2")
    work = docs.join(last, "family_id")
    columns = docs.columns
    return tuple(work.where(c).select(columns) for c in ("version_index = 1", "version_index > 1", "version_index > 1 and version_index = _last"))


def prepare_versions(pairs: DataFrame, mapping: DataFrame, metadata: DataFrame, folder: str, tau: float = TAU, prefix: str = "casimir") -> dict[str, int]:
    """Write both branches and the drop log; documents per set."""
    deduplicated, log, raw = build_versions(pairs, mapping, metadata, tau)
    spark: SparkSession = pairs.sparkSession
    out = {}
    for branch, docs in (("dedup", deduplicated), ("raw", raw)):
        for suffix, part in zip(("v1_only", "revisions", "latest_only"), revision_sets(docs)):
            path = save_set(part, folder, f"{prefix}_{branch}_{suffix}")
            out[f"{prefix}_{branch}_{suffix}"] = spark.read.parquet(path).count()
    path = save_table(log, f"{folder}/{prefix}_dedup_dropped_forums.parquet")
    return out | {"dropped_forums": spark.read.parquet(path).count()}

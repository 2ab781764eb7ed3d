"""Works and their translations as canonical documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import language_name, language_of, meta_json, paragraphs_joined
from strandline.sources.tables import normalize_docs, save_set

VOLUME = r"_(\d+)_"


def merged_volumes(works: DataFrame) -> DataFrame:
    """Volumes of one work (`<base>_<n>_<rest>`) as one, in order of volume, with the translators of all of them (B5).  Others stay."""
    base = F.regexp_extract("work_id", r"^(.*?)_\d+_", 1)
    rows = works.withColumns({"_vol": F.regexp_extract("work_id", VOLUME, 1), "_base": base})
    none = F.array().cast("array<string>")
    volume = F.struct(F.col("_vol").try_cast("long").alias("n"), "work_id", "gt_paras", "source_paras", F.map_entries("translators").alias("t"))
    grouped = rows.where("_vol <> ''").groupBy("_base").agg(F.sort_array(F.collect_list(volume)).alias("v"))
    many = grouped.where(F.size("v") > 1)
    keys = F.array_sort(F.array_distinct(F.flatten(F.transform("v", lambda x: F.transform(x["t"], lambda e: e["key"])))))

    def paras(k):
        return F.flatten(F.transform("v", lambda x: F.coalesce(F.try_element_at(F.map_from_entries(x["t"]), k), none)))

    merged = many.select(
        F.concat_ws("_", "_base", language_of(F.element_at("v", 1)["work_id"])).alias("work_id"),
        F.flatten(F.transform("v", lambda x: F.coalesce(x["gt_paras"], none))).alias("gt_paras"),
        F.flatten(F.transform("v", lambda x: F.coalesce(x["source_paras"], none))).alias("source_paras"),
        F.map_from_arrays(keys, F.transform(keys, paras)).alias("translators"),
    )
    return rows.join(many.select("_base"), (rows["_base"] == many["_base"]) & (rows["_vol"] != ""), "left_anti").select(works.columns).unionByName(merged)


def translation_docs(works: DataFrame, merge: bool = True, dataset: str = "par3") -> tuple[DataFrame, DataFrame]:
    """(machine translations, human translations) of each work; translators are numbered in order of name."""
    rows = merged_volumes(works) if merge else works
    none = F.array().cast("array<string>")
    lang = language_of(F.col("work_id"))
    keys = F.array_sort(F.map_keys("translators"))
    facts = {"lang": lang, "lang_name": language_name(lang), "n_paragraphs": F.size(F.coalesce("gt_paras", none)), "n_translators": F.size(keys)}
    machine = rows.select(
        F.concat("work_id", F.lit("__gt")).alias("doc_id"), F.lit(dataset).alias("dataset"), F.col("work_id").alias("family_id"), paragraphs_joined(F.coalesce("gt_paras", none)).alias("text"),
        F.lit(0).cast("long").alias("version_index"), F.lit("original").alias("variant_type"), meta_json(**facts, role=F.lit("machine_translation")).alias("meta_json"),
    )
    each = rows.select("*", F.posexplode(keys).alias("_at", "tk")).withColumn("text", paragraphs_joined(F.coalesce(F.try_element_at("translators", F.col("tk")), none))).where("text <> ''")
    human = each.select(
        F.concat_ws("__", "work_id", "tk").alias("doc_id"), F.lit(dataset).alias("dataset"), F.col("work_id").alias("family_id"), "text",
        (F.col("_at") + 1).cast("long").alias("version_index"), F.lit("human_translation").alias("variant_type"), F.col("tk").alias("variant_level"),
        F.concat("work_id", F.lit("__gt")).alias("source_doc_id"), meta_json(**facts, translator=F.col("tk"), role=F.lit("human_translation")).alias("meta_json"),
    )
    return normalize_docs(machine, check=False), normalize_docs(human, check=False)


def prepare_translations(works: DataFrame, folder: str, dataset: str = "par3") -> list[str]:
    """The six sets: merged and by volume, machine, human, and the first translator's."""
    out = []
    for suffix, merge in (("", True), ("_split", False)):
        machine, human = translation_docs(works, merge, dataset)
        for name, docs in ((f"{dataset}_gt{suffix}", machine), (f"{dataset}_human{suffix}", human), (f"{dataset}_human_t1{suffix}", human.where("variant_level = 'translator_1'"))):
            out.append(save_set(docs, folder, name))
    return out

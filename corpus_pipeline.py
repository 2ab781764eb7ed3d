"""Corpus pipeline: language ID, near-duplicates, benchmark decontamination, secrets, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; run() writes each
stage's result as Parquet in the shared folder and reads it again for the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.byte_bpe import byte_bpe
from strandline.llm.decontamination import uncontaminated
from strandline.llm.jaccard_join import jaccard_components
from strandline.llm.language_id import UNDETERMINED, predicted, train
from strandline.llm.secret_scan import redact_secrets
from strandline.storage import drop_written, written

#: A text whose best language reaches no higher score is rejected as having none.
LEAST_SCORE = 0.25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters, without text, or without a language; the model learns from the labelled ones.

    Null, empty and letterless texts go; repeated rows stay or go together; rows without a label are judged like the
    others; with no labelled row at all no language is known and every row goes; an empty table stays empty.
    """
    verdict = f"_found_{uuid.uuid4().hex}"  # no column of the caller's has this name
    found = docs.withColumn(verdict, predicted(F.col("text"), train(docs), spark))
    return found.where((F.col(f"{verdict}.lang_pred") != UNDETERMINED) & (F.col(f"{verdict}.score") >= LEAST_SCORE)).drop(verdict)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (5-word shingles, similarity 0.8) the document with the smallest doc_id stays.

    Null and wordless texts are in no group and stay, and so do rows with a null doc_id, which cannot be named.  Rows that
    repeat a doc_id are one document: all of them stay or, where one of them has a smaller partner, go.
    """
    groups = jaccard_components(docs)
    gone = groups.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and wordless texts stay, as all do where the benchmark is empty."""
    return uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay, with n_chars (if there is one) of the new text; null texts stay null."""
    out = redact_secrets(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers, as binary) and the SHA-256 of the bytes they decode to.

    One row for each row; null and empty texts have no ids.
    """
    import public_tokenizers

    out = byte_bpe(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("byte_bpe", byte_level_bpe),
]

#: SQL can express neither the language model nor the tokenizer; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_written(before)
        before = docs
    return docs

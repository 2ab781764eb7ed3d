"""One query per operator, with production parameters, over whole tables; and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.substring_dedup import substring_dedup

    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.secret_scan import secret_scan

    found = secret_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.decontamination import decontamination

    return decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.embedding_dedup import embedding_dedup

    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op8_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.preference_format import conversations, preference_format, swapped_replies

    return preference_format(swapped_replies(conversations(table(spark, sf_dir, "conversations"))))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from strandline.llm.byte_bpe import byte_bpe

    out = byte_bpe(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def held_out(doc_id: Column) -> Column:
    """Whether a document must not be learnt from: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.language_id import identify, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [f for name, f in globals().items() if name.startswith("op")]
    return {f.__name__: f for f in sorted(own, key=lambda f: int(f.__name__[2:].split("_")[0]))}


#: Words of a text, and lower-casing of A-Z only.
_WORDS = "list_filter(regexp_split_to_array(coalesce({0}, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL_2 = f"""WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS pos, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i+12], ' '))) AS win FROM d WHERE len(w) >= 13),
k AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY win) AS first FROM s) WHERE first < doc_id),
g AS (SELECT DISTINCT doc_id, pos + j AS pos FROM k, range(0, 13) AS r(j)),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM d),
r AS (SELECT p.doc_id, count(*) AS n_words, count(g.pos) AS n_removed, coalesce(string_agg(p.word, ' ' ORDER BY p.pos) FILTER (WHERE g.pos IS NULL), '') AS kept FROM p LEFT JOIN g ON g.doc_id = p.doc_id AND g.pos = p.pos GROUP BY p.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)"""

SQL_6 = """WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach(id, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, reach.r FROM reach JOIN l ON l.a = reach.id), c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.id AS vec_id, coalesce(n.n, 0) AS n_links, component_id, c.id = component_id AS kept FROM c LEFT JOIN n ON n.a = c.id"""

SQL_7 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
sh AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s FROM d),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id), few AS (SELECT doc_id, s FROM (SELECT *, count(*) OVER (PARTITION BY s) AS df FROM sh) WHERE df > 1),
ov AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM few a JOIN few b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM ov JOIN sz x ON x.doc_id = a JOIN sz y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
reach(id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, reach.r FROM reach JOIN l ON l.a = reach.id)
SELECT id AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN sz ON sz.doc_id = id GROUP BY id"""


def oracle_sql() -> dict[str, str]:
    from strandline.llm import preference_format

    return {"op2_substring_dedup": SQL_2, "op6_embedding_dedup": SQL_6, "op7_jaccard_join": SQL_7, "op8_preference_format": preference_format.ORACLE_SQL}

"""One query per operator family over the shared tables, each with DuckDB SQL where SQL can express it.

Queries run over whole tables.  A search takes the rows whose id is divisible by 50 as its queries, against all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import text as tx
from strandline.operators import lexical_pairs, matching, near_duplicates, split
from strandline.operators.components import components
from strandline.plans import evaluation, report, translations, variation, versions
from strandline.sources import tables
from strandline.storage import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as canonical documents; a source is a family."""
    d = table(spark, sf_dir, "documents")
    return tables.normalize_docs(d.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("corpus").alias("dataset"), F.col("source").alias("family_id"), "text"), check=False)


# ---- normalisation ------------------------------------------------------------------------------------------

WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"
TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
SQUASH = "regexp_replace(lower(strip_accents({0})), '[^a-z0-9]', '', 'g')"


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'corpus' AS dataset, source AS family_id, md5(text) AS text_md5, CAST(NULL AS BIGINT) AS version_index, 'original' AS variant_type,
  CAST(length(text) AS INTEGER) AS num_chars, CAST(len({WORDS}) AS INTEGER) AS num_words, '{{}}' AS meta_json FROM documents""")
def p1_normalize_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", "dataset", "family_id", F.md5("text").alias("text_md5"), "version_index", "variant_type", "num_chars", "num_words", "meta_json")


@query("""WITH s AS (SELECT page_id, regexp_replace(replace(lower(trim(url)), ' ', '_'), '[^a-zA-Z0-9_@.\\-:]+', '', 'g') AS k FROM pages)
SELECT page_id, 'web_pages:' || k AS family_id, 'web_pages:' || k || ':v' || page_id AS doc_id FROM s""")
def p4_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = tx.family_id(F.lit("Web Pages"), F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", family.alias("family_id"), tx.doc_id(family, tx.revision_key(F.col("page_id"))).alias("doc_id"))


@query("SELECT page_id, md5(trim(regexp_replace(html, '\\s+', ' ', 'g'))) AS clean_md5 FROM pages")
def p10_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(tx.clean(F.col("html"))).alias("clean_md5"))


@query("SELECT event_id, coalesce(trim(json_extract_string(props, '$.k')), '') AS k, json_extract_string(props, '$.none') IS NULL AS absent FROM events")
def p13_json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", tx.clean(F.get_json_object("props", "$.k")).alias("k"), (tx.paperhash(F.col("props")) == "").alias("absent"))


@query("SELECT doc_id, substr(md5(text), 1, 16) AS h FROM documents")
def p15_short_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.short_hash(F.col("text")).alias("h"))


@query(f"SELECT doc_id, md5({SQUASH.format('text')}) AS squashed_md5, length({SQUASH.format('text')}) AS n FROM documents")
def p17_squash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", tx.squash("text").alias("s"))
    return d.select("doc_id", F.md5("s").alias("squashed_md5"), F.length("s").cast("long").alias("n"))


@query(f"""SELECT doc_id, CAST(len(list_distinct(CASE WHEN length(s) = 0 THEN [] WHEN length(s) < 20 THEN [s] ELSE list_transform(range(1, length(s) - 18), lambda i: substr(s, i, 20)) END)) AS BIGINT) AS n_shingles
FROM (SELECT doc_id, {SQUASH.format('text')} AS s FROM documents)""")
def p18_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tx.shingles()("text")).cast("long").alias("n_shingles"))


@query(f"""WITH l AS (SELECT doc_id, {SQUASH.format("list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1]")} AS k FROM documents)
SELECT doc_id, CASE WHEN length(k) >= 25 AND NOT regexp_matches(k, '{"|".join(tx.TITLE_BOILERPLATE)}') THEN k END AS title_key FROM l""")
def p20_title_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.title_key(F.col("text")).alias("title_key"))


@query("""WITH w AS (SELECT doc_id, source || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '_' || lang END AS work FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'unknown' ELSE right(work, 2) END AS code,
  CASE WHEN doc_id % 3 = 0 THEN 'unknown' ELSE CASE right(work, 2) WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' WHEN 'fr' THEN 'French' ELSE right(work, 2) END END AS language FROM w""")
def p21_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = F.concat("source", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("_"), "lang")))
    code = tx.language_of(work)
    return table(spark, sf_dir, "documents").select("doc_id", code.alias("code"), tx.language_name(code).alias("language"))


@query("SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda p: trim(p)), lambda p: p <> ''), chr(10))) AS text_md5 FROM documents")
def p23_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.paragraphs_joined(F.split("text", "\n"))).alias("text_md5"))


@query(f"SELECT doc_id, len({TOKENS}) AS n_tokens, len(list_distinct({TOKENS})) AS n_distinct FROM documents")
def p25_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tx.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query(f"""SELECT doc_id, CAST(len(list_distinct(CASE WHEN len(t) < 3 THEN [] ELSE list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i+2], ' ')) END)) AS BIGINT) AS n_trigrams
FROM (SELECT doc_id, {TOKENS} AS t FROM documents)""")
def p26_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.tokens(F.col("text")).alias("t")).select("doc_id", F.size(F.array_distinct(tx.ngrams(F.col("t"), 3))).cast("long").alias("n_trigrams"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) + 1e-12 AS norm FROM v)
SELECT vec_id, round(e[1] / norm, 9) AS first, round(e[len(e)] / norm, 9) AS last FROM n""")
def p36_l2_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", matching.l2_normalised(F.col("embedding")).alias("u")).select("vec_id", F.round(F.element_at("u", 1), 9).alias("first"), F.round(F.element_at("u", -1), 9).alias("last"))


@query(f"""WITH w AS (SELECT doc_id, len({WORDS}) AS n FROM documents)
SELECT doc_id, CAST(CASE WHEN n <= 64 THEN 1 ELSE ceil((n - 2) / 62.0) END AS BIGINT) AS n_windows, CAST(CASE WHEN n <= 64 THEN n ELSE (n - 3) % 62 + 1 END AS BIGINT) AS last_size, n > 64 AS overflow FROM w""")
def p37_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", tx.words(F.col("text")).alias("t")).withColumn("w", tx.windows(F.col("t"), 64))
    return d.select("doc_id", F.size("w").cast("long").alias("n_windows"), F.size(F.element_at("w", -1)).cast("long").alias("last_size"), (F.size("t") > 64).alias("overflow"))


# ---- sets, splits -------------------------------------------------------------------------------------------


@query("""SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN lang = 'en' THEN 'first' ELSE 'second' END AS dataset, source AS family_id FROM documents""")
def s7_concat_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir)
    english = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").cast("string").alias("doc_id"))
    first = docs.join(english, "doc_id", "left_semi").withColumn("dataset", F.lit("first"))
    return tables.first_by_id([first.select(docs.columns), docs.withColumn("dataset", F.lit("second"))]).select("doc_id", "dataset", "family_id")


RANKED = """r AS (SELECT family_id, row_number() OVER (ORDER BY md5('42|' || family_id)) AS n, count(*) OVER () AS total FROM (SELECT DISTINCT {0} AS family_id FROM {1})),
sp AS (SELECT family_id, CASE WHEN n <= round_even(total * 0.5, 0) THEN 'confidential' ELSE 'benign' END AS partition FROM r)"""


@query(f"WITH {RANKED.format('c_name', 'customer')} SELECT family_id, partition, 'customers' AS dataset, CAST(42 AS BIGINT) AS seed FROM sp")
def b1_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.ranked_split(table(spark, sf_dir, "customer").select(F.col("c_name").alias("family_id")), "customers")


def _families(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(originals, variants, split): four documents in a row are a family, the first its original."""
    d = table(spark, sf_dir, "documents").withColumn("family_id", F.concat(F.lit("f"), F.floor(F.col("doc_id") / 4).cast("long")))
    docs = tables.normalize_docs(d.select("family_id", F.col("doc_id").cast("string").alias("doc_id"), F.lit("corpus").alias("dataset"), "text", F.concat(F.floor(F.col("doc_id") / 4).cast("long") * 4).cast("string").alias("source_doc_id")), check=False)
    first = F.col("doc_id").cast("long") % 4 == 0
    originals = docs.where(first).withColumn("source_doc_id", F.lit(None).cast("string"))
    return originals, docs.where(~first), split.ranked_split(originals, "corpus")


@query(f"""WITH {RANKED.format("'f' || (doc_id // 4)", 'documents WHERE doc_id % 4 = 0')},
d AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'f' || (doc_id // 4) AS family_id, doc_id % 4 = 0 AS original FROM documents)
SELECT doc_id, family_id, CASE WHEN partition = 'benign' THEN 'benign' WHEN original THEN 'reference' ELSE 'positive' END AS role FROM d JOIN sp USING (family_id)""")
def b2_query_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = split.query_sets(*_families(spark, sf_dir))
    roles = [df.select("doc_id", "family_id", F.lit(role).alias("role")) for df, role in ((s.reference, "reference"), (s.positive, "positive"), (s.benign, "benign"))]
    return roles[0].union(roles[1]).union(roles[2])


@query("SELECT DISTINCT d.doc_id AS family_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def f2_uncovered_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.uncovered(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("family_id")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("family_id")))


# ---- similarity joins ---------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT CAST(l_orderkey AS VARCHAR) AS q, CAST(l_partkey AS VARCHAR) AS p, CAST(l_suppkey AS VARCHAR) AS f, round(l_extendedprice, -3) AS s FROM lineitem),
b AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, p, f) AS n FROM r)
SELECT CAST(o_orderkey AS VARCHAR) AS query_doc_id, CAST(o_custkey AS VARCHAR) AS query_family_id, p AS pred_doc_id, f AS pred_family_id, coalesce(s, 0.0) AS confidence
FROM orders LEFT JOIN b ON b.q = CAST(o_orderkey AS VARCHAR) AND n = 1""")
def a1_best_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    retrieved = table(spark, sf_dir, "lineitem").select(s("l_orderkey").alias("query_doc_id"), s("l_partkey").alias("ref_doc_id"), s("l_suppkey").alias("ref_family_id"), F.round("l_extendedprice", -3).alias("score"))
    queries = table(spark, sf_dir, "orders").select(s("o_orderkey").alias("doc_id"), s("o_custkey").alias("family_id"))
    return matching.best_matches(queries, retrieved)


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT CAST(q.vec_id AS VARCHAR) AS query_doc_id, CAST(q.label AS VARCHAR) AS query_family_id, CAST(r.vec_id AS VARCHAR) AS ref_doc_id, CAST(r.label AS VARCHAR) AS ref_family_id, round(list_cosine_similarity(q.e, r.e), 6) AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_doc_id ORDER BY score DESC, ref_doc_id) AS INTEGER) AS rank FROM s)
SELECT query_doc_id, query_family_id, ref_doc_id, ref_family_id, score, rank FROM k WHERE rank <= 3""")
def j9_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("doc_id"), F.col("label").cast("string").alias("family_id"), "embedding", "vec_id")
    return matching.nearest(v, v.where("vec_id % 50 = 0"), k=3, exclude_self=True).withColumn("score", F.round("score", 6))


_TERMS = "list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 2 AND w NOT IN ({0}))".format(", ".join(f"'{w}'" for w in matching.STOP_WORDS))
#: BM25 of {queries} against {reference}, both with id, fam and text: k has the rank of each pair with a positive score.
BM25_OF = (
    "qw AS (SELECT id AS q, unnest(" + _TERMS + ") AS term FROM {queries}), qt AS (SELECT q, term, count(*) AS qtf FROM qw GROUP BY ALL), rw AS (SELECT id AS r, fam AS rf, unnest(" + _TERMS + ") AS term FROM {reference}),\n"
    "tf AS (SELECT r, rf, term, count(*) AS tf FROM rw GROUP BY ALL), dl AS (SELECT r, sum(tf) AS dl FROM tf GROUP BY r), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), nn AS (SELECT count(*) AS n FROM {reference}), av AS (SELECT sum(dl) / (SELECT n FROM nn) AS avgdl FROM dl),\n"
    "wt AS (SELECT tf.term, tf.r, tf.rf, ln(1 + (nn.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf / (tf.tf + 1.5 * (1 - 0.75 + 0.75 * dl.dl / av.avgdl)) AS w FROM tf JOIN dl USING (r) JOIN df USING (term), nn, av),\n"
    "sc AS (SELECT q, r, rf, round(sum(qtf * w), 6) AS score FROM qt JOIN wt USING (term) GROUP BY q, r, rf), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, r) AS rank FROM sc WHERE score > 0)"
)
BM25 = BM25_OF.format(queries="(SELECT CAST(doc_id AS VARCHAR) AS id, source AS fam, text FROM documents)", reference="(SELECT CAST(item_id AS VARCHAR) AS id, 'item' || item_id AS fam, text FROM benchmark)")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("doc_id"), F.concat(F.lit("item"), "item_id").alias("family_id"), "text")


@query(f"""WITH {BM25} SELECT CAST(d.doc_id AS VARCHAR) AS query_doc_id, d.source AS query_family_id, k.r AS pred_doc_id, 'item' || k.r AS pred_family_id, coalesce(k.score, 0.0) AS confidence
FROM documents d LEFT JOIN k ON k.q = CAST(d.doc_id AS VARCHAR) AND k.rank = 1""")
def j10_bm25_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.bm25_matches(_items(spark, sf_dir), corpus(spark, sf_dir), ascii_only=True)


@query()
def j11_fuzzy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, asked = corpus(spark, sf_dir), F.col("doc_id").cast("long") % 50 == 0
    return matching.fuzzy_matches(docs, docs.where(asked), exclude_self=True)


# ---- near-duplicates ----------------------------------------------------------------------------------------

#: Classes of equal sets are named by their smallest id; pairs run between those, and from them to their members.
PAIRS = f"""sq AS (SELECT CAST(doc_id AS VARCHAR) AS d, {SQUASH.format('text')} AS s FROM documents),
sh AS (SELECT d, hash(unnest(list_distinct(CASE WHEN length(s) = 0 THEN [] WHEN length(s) < 20 THEN [s] ELSE list_transform(range(1, length(s) - 18), lambda i: substr(s, i, 20)) END))) AS h FROM sq),
sz AS (SELECT d, count(*) AS n, sum(h) AS x FROM sh GROUP BY d), cl AS (SELECT d, n, min(d) OVER (PARTITION BY n, x) AS c FROM sz),
own AS (SELECT sh.* FROM sh JOIN cl USING (d) WHERE d = c), inv AS (SELECT h FROM own GROUP BY h HAVING count(*) > 1), few AS (SELECT own.* FROM own JOIN inv USING (h)),
ov AS (SELECT a.d AS a, b.d AS b, count(*) AS k FROM few a JOIN few b ON a.h = b.h AND a.d < b.d GROUP BY ALL),
pr AS (SELECT ov.a, ov.b, k / (x.n + y.n - k) AS jaccard FROM ov JOIN sz x ON x.d = ov.a JOIN sz y ON y.d = ov.b WHERE k / (x.n + y.n - k) >= 0.25
  UNION ALL SELECT c, d, 1.0 FROM cl WHERE d <> c)"""


@query(f"WITH {PAIRS} SELECT a, b, round(jaccard, 9) AS jaccard FROM pr")
def j12_near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir).select(F.col("doc_id").alias("forum_id"), "text")
    return near_duplicates.near_duplicate_texts(docs).withColumn("jaccard", F.round("jaccard", 9))


@query(f"""WITH sq AS (SELECT doc_id, {SQUASH.format('text')} AS s FROM documents),
f AS (SELECT * FROM sq ORDER BY CAST(doc_id AS VARCHAR) LIMIT 2000), c AS (SELECT count(*) * 0.005 AS cut FROM f),
sh AS (SELECT doc_id, unnest(list_distinct(CASE WHEN length(s) = 0 THEN [] WHEN length(s) < 20 THEN [s] ELSE list_transform(range(1, length(s) - 18), lambda i: substr(s, i, 20)) END)) AS h FROM f),
d AS (SELECT h, count(*) AS df FROM sh GROUP BY h)
SELECT d.df AS df, count(*) AS n_shingles FROM d, c WHERE c.cut >= 5 AND d.df >= c.cut GROUP BY d.df""")
def a9_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir).select(F.col("doc_id").alias("forum_id"), "text")
    return near_duplicates.boilerplate(docs, near_duplicates.shingle_rows(docs)).groupBy("df").agg(F.count("*").alias("n_shingles"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, CAST(first AS VARCHAR) AS component_id FROM (
  SELECT doc_id, min(CAST(doc_id AS VARCHAR)) OVER (PARTITION BY md5(text)) AS first, count(*) OVER (PARTITION BY md5(text)) AS n FROM documents) WHERE n > 1""")
def a14_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir).withColumnRenamed("doc_id", "forum_id")
    return components(near_duplicates.key_edges(docs, F.md5("text")))


@query(f"""WITH RECURSIVE {PAIRS}, tk AS (SELECT CAST(doc_id AS VARCHAR) AS d, {SQUASH.format("list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1]")} AS k FROM documents),
ti AS (SELECT d, CASE WHEN length(k) >= 25 AND NOT regexp_matches(k, '{"|".join(tx.TITLE_BOILERPLATE)}') THEN k END AS title FROM tk),
ed AS (SELECT a, b FROM pr UNION SELECT min(d) OVER (PARTITION BY title), d FROM ti WHERE title IS NOT NULL),
both_ AS (SELECT a, b FROM ed WHERE a <> b UNION SELECT b, a FROM ed WHERE a <> b),
reach(d, r) AS (SELECT d, d FROM ti UNION SELECT both_.b, reach.r FROM reach JOIN both_ ON both_.a = reach.d),
gr AS (SELECT d, min(r) AS g FROM reach GROUP BY d),
m AS (SELECT gr.d, gr.g, doc.n_chars, ti.title, count(*) OVER (PARTITION BY g) AS size, row_number() OVER (PARTITION BY g ORDER BY doc.n_chars DESC, gr.d DESC) AS nth FROM gr JOIN ti USING (d) JOIN documents doc ON CAST(doc.doc_id AS VARCHAR) = gr.d),
kp AS (SELECT g, d AS rep, title AS rep_title FROM m WHERE nth = 1),
dr AS (SELECT m.*, kp.rep, kp.rep_title FROM m JOIN kp USING (g) WHERE m.size > 1 AND m.d <> kp.rep),
cm AS (SELECT dr.d, count(*) AS k FROM dr JOIN sh x ON x.d = dr.d JOIN sh y ON y.d = dr.rep AND y.h = x.h GROUP BY dr.d)
SELECT dr.d AS dropped_forum_id, dr.rep AS kept_forum_id, dr.size AS group_size, round(coalesce(cm.k / (x.n + y.n - cm.k), 0), 9) AS jaccard_to_kept,
  coalesce(dr.title = dr.rep_title, false) AS same_title_as_kept, false AS same_paperhash_as_kept
FROM dr LEFT JOIN cm ON cm.d = dr.d LEFT JOIN sz x ON x.d = dr.d LEFT JOIN sz y ON y.d = dr.rep""")
def b15_resolve_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    forums = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("forum_id"), "text", F.lit("").alias("paperhash"), F.col("n_chars").alias("date"))
    _, log = near_duplicates.resolve_duplicates(forums, share=2.0)  # no shingle is boilerplate
    return log.withColumn("jaccard_to_kept", F.round("jaccard_to_kept", 9))


# ---- evaluation ---------------------------------------------------------------------------------------------


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Truth: toxic documents are positive.  Matches: the length as confidence, a family by the id."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id").withColumn("q", F.col("doc_id").cast("string"))
    truth = d.select(F.col("q").alias("query_doc_id"), (F.col("toxic") == 1).alias("is_positive"), F.when(F.col("toxic") == 1, F.col("source")).alias("target_family_id"))
    found = d.where("doc_id % 11 <> 0").select(F.col("q").alias("query_doc_id"), F.col("source").alias("query_family_id"), F.col("q").alias("pred_doc_id"), F.concat(F.lit("src"), F.col("doc_id") % 20).alias("pred_family_id"), F.col("n_chars").cast("double").alias("confidence"))
    return truth, found


JUDGED = """d AS (SELECT CAST(doc_id AS VARCHAR) AS q, toxic = 1 AS pos, source, lang, n_chars, CASE WHEN doc_id % 11 <> 0 THEN CAST(n_chars AS DOUBLE) END AS conf, 'src' || (doc_id % 20) AS fam FROM documents JOIN labels USING (doc_id)),
t AS (SELECT coalesce(conf, 0) AS threshold, count(*) FILTER (WHERE pos) AS p0, count(*) FILTER (WHERE NOT pos) AS n0 FROM d GROUP BY 1),
c AS (SELECT threshold, p0, n0, CAST(sum(p0) OVER (ORDER BY threshold DESC) AS BIGINT) AS tp, CAST(sum(n0) OVER (ORDER BY threshold DESC) AS BIGINT) AS fp, CAST(sum(p0) OVER () AS BIGINT) AS p, CAST(sum(n0) OVER () AS BIGINT) AS n FROM t)"""


@query(f"""WITH {JUDGED}, f AS (SELECT *, tp / (tp + fp) AS pr, tp / p AS re FROM c), g AS (SELECT *, 2 * pr * re / (pr + re + 1e-12) AS f1 FROM f),
b AS (SELECT * FROM g ORDER BY f1 DESC, threshold LIMIT 1)
SELECT b.threshold AS best_threshold, round(b.f1, 9) AS best_f1, round(b.pr, 9) AS best_precision, round(b.re, 9) AS best_recall, round((SELECT sum(p0 / p * pr) FROM g), 9) AS pr_auc,
  round((SELECT sum(p0 * (n - fp + n0 / 2)) / (max(p) * max(n)) FROM g), 9) AS roc_auc, round(b.p / (b.p + b.n), 9) AS positive_ratio FROM b""")
def m1_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = evaluation.sweep(evaluation.curve(evaluation.scored(*_judged(spark, sf_dir))))
    return row.select("best_threshold", *(F.round(c, 9).alias(c) for c in row.columns if c != "best_threshold"))


@query(f"WITH {JUDGED} SELECT threshold, round(fp / n, 9) AS fpr, round(tp / p, 9) AS tpr FROM c")
def m4_roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.roc_points(evaluation.curve(evaluation.scored(*_judged(spark, sf_dir)))).select("threshold", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


EVALUATED = f"{JUDGED}, e AS (SELECT *, coalesce(conf >= 700, false) AS det, CASE WHEN conf >= 700 THEN fam END AS pf FROM d)"


@query(f"""WITH {EVALUATED}, k AS (SELECT count(*) FILTER (WHERE pos AND det) AS tp, count(*) FILTER (WHERE NOT pos AND det) AS fp, count(*) FILTER (WHERE NOT pos AND NOT det) AS tn, count(*) FILTER (WHERE pos AND NOT det) AS fn, count(*) FILTER (WHERE pos AND det AND pf = source) AS ok FROM e)
SELECT tp, fp, tn, fn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1, round((tp + tn) / (tp + fp + tn + fn), 9) AS accuracy,
  round(ok / (tp + fn), 9) AS family_acc_on_all_positive, round(ok / tp, 9) AS family_acc_on_detected_positive FROM k""")
def a2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = evaluation.counts(evaluation.per_query(*_judged(spark, sf_dir), 700.0))
    return row.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in row.dtypes))


@query(f"""WITH {EVALUATED}, o AS (SELECT source AS family_id, count(*) AS a, count(*) FILTER (WHERE det) AS b, count(*) FILTER (WHERE det AND pf = source) AS c FROM e WHERE pos GROUP BY 1),
l AS (SELECT pf AS family_id, count(*) AS f FROM e WHERE NOT pos AND det AND pf IS NOT NULL GROUP BY 1), j AS (SELECT family_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(c, 0) AS c, coalesce(f, 0) AS f FROM o FULL JOIN l USING (family_id))
SELECT family_id, a AS n_positive_total, b AS n_positive_detected, c AS n_attribution_correct, f AS n_false_attraction, round(CASE WHEN a = 0 THEN 0 ELSE b / a END, 9) AS detection_rate, round(CASE WHEN b = 0 THEN 0 ELSE c / b END, 9) AS attribution_rate FROM j""")
def m6_errors_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.errors_by_family(evaluation.per_query(*_judged(spark, sf_dir), 700.0))
    return rows.withColumns({c: F.round(c, 9) for c in ("detection_rate", "attribution_rate")})


@query(f"WITH {EVALUATED} SELECT q AS query_doc_id, q AS pred_doc_id, pf AS pred_family_id, conf AS confidence FROM e WHERE NOT pos AND det")
def m7_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.false_positives(evaluation.per_query(*_judged(spark, sf_dir), 700.0))


@query(f"""WITH {JUDGED}, tl AS (SELECT lang, n_chars AS threshold, count(*) FILTER (WHERE pos) AS p0, count(*) FILTER (WHERE NOT pos) AS n0 FROM d GROUP BY 1, 2),
cl AS (SELECT lang, sum(p0) OVER w AS tp, sum(n0) OVER w AS fp, sum(p0) OVER (PARTITION BY lang) AS p, sum(n0) OVER (PARTITION BY lang) AS n FROM tl WINDOW w AS (PARTITION BY lang ORDER BY threshold DESC)),
b AS (SELECT lang, max(2 * (tp / (tp + fp)) * (tp / p) / (tp / (tp + fp) + tp / p + 1e-12)) FILTER (WHERE p > 0 AND n > 0) AS f1 FROM cl GROUP BY lang)
SELECT label, CASE WHEN label = 'BM25' THEN (SELECT round_even(f1, 3) FROM b WHERE lang = 'en') END AS "Krapivin paraphrase", CASE WHEN label = 'BM25' THEN (SELECT round_even(f1, 3) FROM b WHERE lang = 'fr') END AS "PAR3 translation",
  CASE WHEN label = 'BM25' THEN (SELECT round_even(f1, 3) FROM b WHERE lang = 'de') END AS "CASIMIR revision" FROM (VALUES {", ".join(f"('{label}')" for label, _, _ in report.ROWS)}) AS v(label)""")
def m8_result_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", (F.col("toxic") == 1).alias("is_positive"), F.col("n_chars").cast("double").alias("score"))
    best = evaluation.sweep(evaluation.curve(d, by=["lang"]), ["lang"])
    name = F.create_map(*(F.lit(x) for kv in {"en": "krapivin", "fr": "par3", "de": "casimir_raw"}.items() for x in kv))
    wanted = F.create_map(*(F.lit(x) for k, (_, v) in report.DATASETS.items() for x in (k, "|".join(v))))
    runs = best.withColumn("dataset", F.try_element_at(name, F.col("lang"))).where("dataset is not null")
    runs = runs.select("dataset", F.lit("bm25").alias("method"), F.try_element_at(wanted, F.col("dataset")).alias("variant_sets"), F.lit(False).alias("inclorig"), F.lit("r").alias("run_ident"), F.lit("default").alias("run_tag"), "best_f1")
    return report.result_table(written(runs, "runs"), "best_f1")


# ---- dataset building ---------------------------------------------------------------------------------------


def _sentence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive turns of a conversation as the two sides of a pair; a conversation is a version."""
    c = table(spark, sf_dir, "conversations")
    nxt = Window.partitionBy("conv_id").orderBy("turn")
    both = c.withColumns({"t2": F.lead("text").over(nxt), "r2": F.lead("role").over(nxt)})
    kind = lambda r: F.when(F.col(r) == "system", "Title").when(F.col(r) == "user", "abstract").when(F.col(r) == "assistant", "Paragraph")
    version = F.concat(F.lit("v"), "conv_id")
    return both.select(
        version.alias("id_version_1"), F.concat(F.lit("s"), "turn").alias("id-sentence-1"), F.col("text").alias("text-sentence-1"), kind("role").alias("type-sentence-1"), F.col("turn").alias("num_sentence-sentence-1"),
        version.alias("id_version_2"), F.when(F.col("t2").isNotNull(), F.concat(F.lit("s"), F.col("turn") + 1)).alias("id-sentence-2"), F.col("t2").alias("text-sentence-2"), kind("r2").alias("type-sentence-2"),
        (F.col("turn") + 1).alias("num_sentence-sentence-2"), F.col("turn").alias("sentence-pair-index"),
    )


@query("""WITH r AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations WHERE role IN ('system', 'user', 'assistant')),
k AS (SELECT * FROM r WHERE t <> '' AND NOT (role = 'user' AND lower(t) = 'abstract')), l AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM k)
SELECT 'v' || conv_id AS version_id, md5(string_agg(CASE WHEN role = 'user' AND prev IS DISTINCT FROM 'user' THEN 'Abstract' || chr(10) ELSE '' END || t, chr(10) || chr(10) ORDER BY turn)) AS text_md5, count(*) AS num_sent_rows FROM l GROUP BY conv_id""")
def b10_version_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.version_texts(_sentence_pairs(spark, sf_dir)).select("version_id", F.md5("text").alias("text_md5"), "num_sent_rows")


def _order_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, mapping, metadata): an order is a version, its customer the forum; a third of the orders lack metadata."""
    o = table(spark, sf_dir, "orders").withColumns({"v": F.concat(F.lit("o"), "o_orderkey"), "f": F.concat(F.lit("c"), "o_custkey")})
    texts = o.where("o_orderstatus <> 'O'").select(F.col("v").alias("version_id"), F.col("o_orderpriority").alias("text"), F.lit(1).cast("long").alias("num_sent_rows"))
    mapping = o.groupBy("f").agg(F.to_json(F.transform(F.reverse(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey", "v")))), lambda x: x["v"])).alias("references"), F.max("o_orderstatus").alias("split"))
    day = F.unix_timestamp("o_orderdate").cast("string")
    metadata = o.where("o_orderkey % 3 <> 0").select(F.col("v").alias("id"), F.col("f").alias("forum"), F.when(F.col("o_orderkey") % 2 == 0, day).alias("cdate"), day.alias("tcdate"), F.to_json(F.struct(F.concat(F.lit("h"), "o_custkey").alias("paperhash"))).alias("content"))
    return texts, mapping.withColumnRenamed("f", "id_forum"), metadata


@query("SELECT 'o' || o_orderkey AS version_id, 'c' || o_custkey AS forum_from_mapping FROM orders UNION ALL SELECT DISTINCT 'c' || o_custkey, 'c' || o_custkey FROM orders")
def b11_forum_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.forum_links(_order_versions(spark, sf_dir)[1])


NUMBERED = """x AS (SELECT 'o' || o_orderkey AS v, 'c' || o_custkey AS f, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(epoch(o_orderdate) AS BIGINT) END AS ts FROM orders WHERE o_orderstatus <> 'O'),
y AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY ts NULLS LAST, v) AS n, count(*) OVER (PARTITION BY f) AS last FROM x)"""


@query(f"""WITH {NUMBERED} SELECT 'casimir:' || f || ':v' || n AS doc_id, 'casimir:' || f AS family_id, n AS version_index, CASE WHEN n = 1 THEN 'original' ELSE 'revision' END AS variant_type,
  CASE WHEN n > 1 THEN 'casimir:' || f || ':v1' END AS source_doc_id, v AS raw_version_id FROM y""")
def b17_number_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, mapping, metadata = _order_versions(spark, sf_dir)
    docs = versions.assemble(versions.version_meta(texts, mapping, metadata), None, mapping.select(F.col("id_forum").alias("forum_id"), "split"))
    return docs.select("doc_id", "family_id", "version_index", "variant_type", "source_doc_id", F.get_json_object("meta_json", "$.raw_version_id").alias("raw_version_id"))


@query(f"""WITH {NUMBERED} SELECT s AS set_name, 'casimir:' || f || ':v' || n AS doc_id FROM y, (VALUES ('v1_only'), ('revisions'), ('latest_only')) AS z(s)
WHERE last >= 2 AND ((s = 'v1_only' AND n = 1) OR (s = 'revisions' AND n > 1) OR (s = 'latest_only' AND n = last))""")
def b19_revision_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, mapping, metadata = _order_versions(spark, sf_dir)
    docs = versions.assemble(versions.version_meta(texts, mapping, metadata), None, mapping.select(F.col("id_forum").alias("forum_id"), "split"))
    parts = [p.select(F.lit(s).alias("set_name"), "doc_id") for s, p in zip(("v1_only", "revisions", "latest_only"), versions.revision_sets(docs))]
    return parts[0].union(parts[1]).union(parts[2])


@query("""WITH b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderstatus <> 'O'),
m AS (SELECT o_custkey, CAST(min(epoch(o_orderdate)) AS BIGINT) AS date FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1), s AS (SELECT o_custkey, max(o_orderstatus) AS split FROM orders GROUP BY 1)
SELECT 'c' || b.o_custkey AS forum_id, b.o_orderpriority AS text, m.date AS date, CASE WHEN m.o_custkey IS NULL THEN '' ELSE 'h' || m.o_custkey END AS paperhash, s.split AS split
FROM b JOIN s ON s.o_custkey = b.o_custkey LEFT JOIN m ON m.o_custkey = b.o_custkey WHERE b.n = 1""")
def b16_forum_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.forum_signals(*_order_versions(spark, sf_dir))


@query("""SELECT 'krapivin:paper_' || doc_id AS family_id, 'krapivin:paper_' || doc_id || ':orig' AS doc_id,
  md5(source || chr(10) || chr(10) || 'Abstract' || chr(10) || lang || chr(10) || chr(10) || trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS text_md5 FROM documents""")
def b3_keyphrase_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "documents").select(F.concat(F.lit("Paper "), "doc_id").alias("name"), F.col("source").alias("title"), F.col("lang").alias("abstract"), F.col("text").alias("fulltext"))
    return tables.keyphrase_docs(records).select("family_id", "doc_id", F.md5("text").alias("text_md5"))


def _works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three conversations in a row are the volumes of a work: users' turns are the machine translation, assistants' the first translator's."""
    c = table(spark, sf_dir, "conversations")
    said = lambda role: F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"])
    w = c.groupBy("conv_id").agg(said("user").alias("gt_paras"), said("system").alias("source_paras"), said("assistant").alias("a"))
    name = F.concat(F.lit("work"), F.floor(F.col("conv_id") / 3).cast("long"), F.lit("_"), F.col("conv_id") % 3 + 1, F.lit("_x_fr"))
    one = F.create_map(F.lit("translator_1"), F.col("a"))
    translators_ = F.when(F.col("conv_id") % 3 == 0, one).otherwise(F.map_concat(one, F.create_map(F.lit("translator_2"), F.col("source_paras"))))  # none in the first volume
    return w.select(name.alias("work_id"), "gt_paras", "source_paras", translators_.alias("translators"))


@query("""WITH p AS (SELECT conv_id // 3 AS w, conv_id % 3 AS v, conv_id, turn, role, trim(text) AS t FROM conversations WHERE trim(text) <> ''),
g AS (SELECT DISTINCT conv_id // 3 AS w, count(DISTINCT conv_id) OVER (PARTITION BY conv_id // 3) AS dummy, conv_id FROM conversations),
k AS (SELECT w, count(*) AS n, min(conv_id % 3) + 1 AS only FROM (SELECT DISTINCT conv_id // 3 AS w, conv_id FROM conversations) GROUP BY w),
x AS (SELECT k.w, CASE WHEN k.n > 1 THEN 'work' || k.w || '_fr' ELSE 'work' || k.w || '_' || k.only || '_x_fr' END AS id FROM k),
t AS (SELECT w, CASE role WHEN 'user' THEN '__gt' WHEN 'assistant' THEN '__translator_1' ELSE '__translator_2' END AS suffix, string_agg(t, chr(10) ORDER BY v, turn) AS txt FROM p WHERE role IN ('user', 'assistant') OR (role = 'system' AND v > 0) GROUP BY 1, 2)
SELECT x.id || '__gt' AS doc_id, x.id AS family_id, CAST(0 AS BIGINT) AS version_index, 'original' AS variant_type, md5(coalesce(txt, '')) AS text_md5 FROM x LEFT JOIN t ON t.w = x.w AND suffix = '__gt'
UNION ALL SELECT x.id || suffix, x.id, CAST(right(suffix, 1) AS BIGINT), 'human_translation', md5(txt) FROM x JOIN t USING (w) WHERE suffix <> '__gt'""")
def b6_translation_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    machine, human = translations.translation_docs(_works(spark, sf_dir))
    return machine.union(human).select("doc_id", "family_id", "version_index", "variant_type", F.md5("text").alias("text_md5"))


# ---- variation ----------------------------------------------------------------------------------------------


@query(f"""SELECT CAST(doc_id AS VARCHAR) || '__dipper_lex60_order60_s42' AS doc_id, CAST(doc_id AS VARCHAR) AS source_doc_id, 'lex60_order60' AS variant_level, md5(lower(text)) AS text_md5, CAST(len({WORDS}) AS INTEGER) AS num_words FROM documents""")
def b22_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = variation.variants(corpus(spark, sf_dir), lambda texts: [t.lower() for t in texts], batch=16, timed=False)
    return made.select("doc_id", "source_doc_id", "variant_level", F.md5("text").alias("text_md5"), "num_words")


def _turn_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each turn as a variant of the one before it in its conversation."""
    c = table(spark, sf_dir, "conversations")
    name = lambda t: F.concat_ws("/", F.col("conv_id"), t)
    originals = c.select(name(F.col("turn")).alias("doc_id"), "text")
    variants = c.select(name(F.col("turn")).alias("doc_id"), name(F.col("turn") - 1).alias("source_doc_id"), F.col("conv_id").cast("string").alias("family_id"), F.lit("reply").alias("variant_type"), F.col("role").alias("variant_level"), "text")
    return originals, variants


def _grams(t: str, n: int) -> str:
    return f"CASE WHEN len({t}) < {n} THEN CAST([] AS VARCHAR[]) ELSE list_transform(range(1, len({t}) - {n - 2}), lambda i: array_to_string({t}[i:i+{n - 1}], ' ')) END"


LEXICAL = (
    "tk AS (SELECT conv_id, turn, role, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM conversations), pq AS (SELECT h.conv_id, h.turn, h.role, h.t AS h, r.t AS r FROM tk h JOIN tk r ON r.conv_id = h.conv_id AND r.turn = h.turn - 1), gr AS (SELECT *, "
    + ", ".join(f"{_grams(x, n)} AS {x}{n}" for x in "hr" for n in (1, 2, 3, 4))
    + " FROM pq), cm AS (SELECT *, "
    + ", ".join(f"coalesce(list_sum(list_transform(list_intersect(list_distinct(h{n}), r{n}), lambda g: least(len(list_filter(h{n}, lambda x: x = g)), len(list_filter(r{n}, lambda x: x = g))))), 0) AS c{n}" for n in (1, 2, 3, 4))
    + " FROM gr), lx AS (SELECT conv_id || '/' || turn AS doc_id, conv_id || '/' || (turn - 1) AS source_doc_id, CAST(conv_id AS VARCHAR) AS family_id, 'reply' AS variant_type, role AS variant_level, "
    + ", ".join(f"CASE WHEN len(h{n}) = 0 THEN 0 ELSE len(list_intersect(list_distinct(h{n}), r{n})) / len(list_distinct(h{n})) END AS ngram_overlap_{n}" for n in (1, 2, 3))
    + ", CASE WHEN len(h) < 4 THEN 0 ELSE CASE WHEN len(h) > len(r) THEN 1 ELSE exp(1 - len(r) / len(h)) END * exp(("
    + " + ".join(f"ln(CASE WHEN c{n} = 0 THEN 0.1 ELSE c{n} END / greatest(len(h{n}), 1))" for n in (1, 2, 3, 4))
    + ") / 4) END AS bleu, CASE WHEN len(h) + len(r) = 0 THEN 0 ELSE len(list_intersect(list_distinct(h), r)) / len(list_distinct(list_concat(h, r))) END AS jaccard_tokens FROM cm)"
)
_LEXICAL_ROUNDED = ", ".join(f"round(CAST({m} AS DOUBLE), 9) AS {m}" for m in ("ngram_overlap_1", "ngram_overlap_2", "ngram_overlap_3", "bleu", "jaccard_tokens"))


@query(f"WITH {LEXICAL} SELECT doc_id, source_doc_id, family_id, variant_type, variant_level, {_LEXICAL_ROUNDED} FROM lx")
def b21_pairwise_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = lexical_pairs.pairwise(*_turn_pairs(spark, sf_dir), edit=False)
    return pairs.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in pairs.dtypes))


@query(
    f"WITH {LEXICAL} SELECT variant_type, variant_level, "
    + ", ".join(f"round(avg({m}), 9) AS {m}" for m in ("ngram_overlap_1", "ngram_overlap_2", "ngram_overlap_3", "bleu", "jaccard_tokens"))
    + ", count(*) AS n_docs FROM lx GROUP BY ALL"
)
def a16_lexical_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lexical_pairs.summary(lexical_pairs.pairwise(*_turn_pairs(spark, sf_dir), edit=False))
    return rows.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes))


from strandline import queries_stored  # noqa: E402, F401  registers more queries

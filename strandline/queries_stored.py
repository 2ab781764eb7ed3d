"""Queries of sources, sinks, prepared sets, runs and reports: each writes into the shared folder and reads what it wrote.

They register with the queries of strandline.queries.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import text as tx
from strandline.operators import lexical_pairs, matching, near_duplicates
from strandline.plans import evaluation, report, translations, variation, versions
from strandline.plans.config import DATASETS, RunConfig
from strandline.plans.run import save_run
from strandline.queries import BM25_OF, JUDGED, NUMBERED, RANKED, SQUASH, TOKENS, WORDS, _families, _items, _judged, _order_versions, _sentence_pairs, _turn_pairs, _works, corpus, query, table
from strandline.sources import tables
from strandline.storage import fresh_folder

# ---- sources and sinks --------------------------------------------------------------------------------------


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, source AS family_id, 'original' AS variant_type, CAST(length(text) AS INTEGER) AS num_chars, CAST(len({WORDS}) AS INTEGER) AS num_words, md5(text) AS text_md5 FROM documents""")
def s1_prepared_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as a prepared set, with two columns too many, and read again."""
    folder = fresh_folder(spark, "prepared")
    d = table(spark, sf_dir, "documents")
    tables.save_set(d.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("corpus").alias("dataset"), F.col("source").alias("family_id"), "text", "lang", F.lit(7).alias("num_words")), folder, "docs")
    return tables.load_set(spark, folder, "docs").select("doc_id", "family_id", "variant_type", "num_chars", "num_words", F.md5("text").alias("text_md5"))


@query("SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ALL")
def s16_csv_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report as Parquet, then as CSV, read back by its header."""
    folder = fresh_folder(spark, "report")
    totals = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    tables.save_csv(spark.read.parquet(tables.save_table(totals, f"{folder}/totals.parquet")), f"{folder}/totals.csv")
    return spark.read.csv(f"{folder}/totals.csv", header=True, schema="flag string, status string, n long, quantity double")


@query("""SELECT 'krapivin:page_' || page_id AS family_id, 'krapivin:page_' || page_id || ':orig' AS doc_id, 'original' AS variant_type,
  md5(trim(regexp_replace(html, '\\s+', ' ', 'g'))) AS text_md5, 'Page ' || page_id AS raw_name FROM pages""")
def s8_json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as JSON lines, read as keyphrase records, prepared as a set."""
    folder = fresh_folder(spark, "records")
    table(spark, sf_dir, "pages").select(F.concat(F.lit("Page "), "page_id").alias("name"), F.lit("").alias("title"), F.lit(" ").alias("abstract"), F.col("html").alias("fulltext")).write.json(f"{folder}/pages.jsonl")
    name = tables.prepare_keyphrases(spark, f"{folder}/pages.jsonl", folder)
    docs = spark.read.schema(tables.DOCS).parquet(name)
    return docs.select("family_id", "doc_id", "variant_type", F.md5("text").alias("text_md5"), F.get_json_object("meta_json", "$.raw_name").alias("raw_name"))


@query("""WITH s AS (SELECT conv_id // 3 AS w, conv_id % 3 AS v, role, count(*) FILTER (WHERE text IS NOT NULL) AS n FROM conversations GROUP BY ALL), c AS (SELECT DISTINCT conv_id // 3 AS w, conv_id % 3 AS v FROM conversations)
SELECT 'work' || c.w || '_' || (c.v + 1) || '_x_fr' AS work_id, coalesce(u.n, 0) AS n_gt, coalesce(y.n, 0) AS n_source, coalesce(a.n, 0) AS n_first
FROM c LEFT JOIN s u ON (u.w, u.v, u.role) = (c.w, c.v, 'user') LEFT JOIN s y ON (y.w, y.v, y.role) = (c.w, c.v, 'system') LEFT JOIN s a ON (a.w, a.v, a.role) = (c.w, c.v, 'assistant')""")
def s9_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works as JSON lines, read with their schema."""
    path = f"{fresh_folder(spark, 'works')}/works.jsonl"
    _works(spark, sf_dir).write.json(path)
    size = lambda c: F.greatest(F.size(c), F.lit(0)).cast("long")
    return tables.read_works(spark, path).select("work_id", size("gt_paras").alias("n_gt"), size("source_paras").alias("n_source"), size(F.try_element_at("translators", F.lit("translator_1"))).alias("n_first"))


@query("SELECT o_orderstatus AS split, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def s10_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each split, read as one table that names the split."""
    folder = fresh_folder(spark, "splits")
    orders = table(spark, sf_dir, "orders")
    paths = {s: tables.save_table(orders.where(F.col("o_orderstatus") == s).drop("o_comment"), f"{folder}/{s}.parquet") for s in ("F", "O", "P")}
    return tables.read_splits(spark, paths).groupBy("split").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""WITH u AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, 0 AS s, lang AS mark FROM documents WHERE lang = 'en' UNION ALL SELECT CAST(doc_id AS VARCHAR), 1, source FROM documents)
SELECT doc_id, arg_min(mark, s) AS family_id FROM u GROUP BY doc_id""")
def u1_stored_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stored sets as one; of equal ids the first set's row stays."""
    folder = fresh_folder(spark, "prepared")
    d = table(spark, sf_dir, "documents")
    base = [F.col("doc_id").cast("string").alias("doc_id"), F.lit("corpus").alias("dataset")]
    tables.save_set(d.where("lang = 'en'").select(*base, F.col("lang").alias("family_id"), "text"), folder, "first")
    tables.save_set(d.select(*base, F.col("source").alias("family_id"), "text"), folder, "second")
    return tables.concat_sets(spark, folder, ["first", "second"]).select("doc_id", "family_id")


# ---- column functions ---------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN chr(9) || ' ' || chr(10) WHEN 3 THEN '  ' || source || chr(10) ELSE lang END AS t FROM documents)
SELECT doc_id, md5(coalesce(regexp_replace(t, '^\\s+|\\s+$', '', 'g'), '')) AS stripped_md5, CASE WHEN trim(coalesce(regexp_replace(t, '^\\s+|\\s+$', '', 'g'), '')) = '' THEN ' ' ELSE t END AS guarded, t IS NULL AS missing, 'none' AS absent FROM t""")
def p41_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null, empty, blank and padded texts: stripped, guarded, missing or not, and a column that is not there."""
    n = F.col("doc_id") % 5
    t = F.when(n == 0, F.lit(None).cast("string")).when(n == 1, "").when(n == 2, "\t \n").when(n == 3, F.concat(F.lit("  "), "source", F.lit("\n"))).otherwise(F.col("lang"))
    d = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return d.select("doc_id", F.md5(tx.stripped(F.col("t"))).alias("stripped_md5"), tx.guarded(F.col("t")).alias("guarded"), tx.is_missing(F.col("t")).alias("missing"), tx.col_or(d, "nowhere", "none").alias("absent"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source || '|b' WHEN 1 THEN source || '|x y' WHEN 2 THEN '' ELSE source END AS items FROM documents""")
def p12_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lists, Python lists with None and tuples, and what is no list."""
    n, s = F.col("doc_id") % 4, F.col("source")
    raw = F.when(n == 0, F.concat(F.lit('["'), s, F.lit('", " b ", "", null]'))).when(n == 1, F.concat(F.lit("['"), s, F.lit("', None, ' x  y ']"))).when(n == 2, F.concat(F.lit("('"), s, F.lit("',)"))).otherwise(F.concat(F.lit("[None, '"), s, F.lit("']")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.listlike(raw), "|").alias("items"))


@query(f"""SELECT doc_id, md5(coalesce(array_to_string(list_sort(list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]))), '|'), '')) AS trigrams_md5
FROM (SELECT doc_id, {TOKENS} AS t FROM documents)""")
def p26_trigram_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct trigrams themselves, as one digest a document."""
    grams = F.array_sort(F.array_distinct(tx.ngrams(F.col("t"), 3)))
    return table(spark, sf_dir, "documents").select("doc_id", tx.tokens(F.col("text")).alias("t")).select("doc_id", F.md5(F.array_join(grams, "|")).alias("trigrams_md5"))


@query(f"""WITH s AS (SELECT doc_id, {SQUASH.format('text')} AS s FROM documents), h AS (SELECT doc_id, unnest(list_distinct(CASE WHEN length(s) = 0 THEN [] WHEN length(s) < 20 THEN [s] ELSE list_transform(range(1, length(s) - 18), lambda i: substr(s, i, 20)) END)) AS h FROM s),
d AS (SELECT h, count(*) AS df, min(doc_id) AS first, max(doc_id) AS last FROM h GROUP BY h) SELECT df, first, last, count(*) AS n FROM d WHERE df > 1 GROUP BY ALL""")
def p18_shared_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents share how many shingles: codes stand for contents."""
    return near_duplicates.shared_shingles(table(spark, sf_dir, "documents"))


#: Token edit distance row by row: each token of one side brings its costs against the other's tokens; a row is a prefix minimum.
_EDIT = """tk AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM conversations), pq AS (SELECT h.conv_id, h.turn, h.t AS h, r.t AS r FROM tk h JOIN tk r ON r.conv_id = h.conv_id AND r.turn = h.turn - 1),
ed AS (SELECT conv_id, turn, h, r, list_reduce(list_transform(h, lambda x: list_transform(r, lambda y: CAST(CASE WHEN x = y THEN 0 ELSE 1 END AS BIGINT))),
  lambda p, c: list_transform(range(0, len(p)), lambda j: j + list_min(list_transform(range(0, j + 1), lambda k: CASE WHEN k = 0 THEN p[1] + 1 ELSE least(p[k + 1] + 1, p[k] + c[k]) END - k))), range(0, len(r) + 1)) AS last FROM pq)"""


@query(f"WITH {_EDIT} SELECT conv_id || '/' || turn AS doc_id, conv_id || '/' || (turn - 1) AS source_doc_id, round(CASE WHEN greatest(len(h), len(r)) = 0 THEN 0 ELSE last[len(last)] / greatest(len(h), len(r)) END, 9) AS norm_edit_distance FROM ed")
def p29_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_pairs.pairwise(*_turn_pairs(spark, sf_dir)).select("doc_id", "source_doc_id", F.round("norm_edit_distance", 9).alias("norm_edit_distance"))


@query("""SELECT source, 'bm25__' || source || '__s' || (length(source) % 3 + 42) || CASE WHEN source LIKE '%1' THEN '__r0.3' ELSE '' END || '__var' || left(sha1(source || '_a|' || source || '_b'), 8) || CASE WHEN source LIKE '%2' THEN '__inclorig' ELSE '' END AS ident,
  'artifacts/runs/' || 'bm25__' || source || '__s' || (length(source) % 3 + 42) || CASE WHEN source LIKE '%1' THEN '__r0.3' ELSE '' END || '__var' || left(sha1(source || '_a|' || source || '_b'), 8) || CASE WHEN source LIKE '%2' THEN '__inclorig' ELSE '' END || '/default' AS folder
FROM (SELECT DISTINCT source FROM documents)""")
def s20_run_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and folders of runs that differ in set, seed, ratio, variants and originals."""
    names = [r[0] for r in table(spark, sf_dir, "documents").select("source").distinct().collect()]  # one run for each source
    cfg = [(s, RunConfig("krapivin", "bm25", original_set=s, variant_sets=(f"{s}_a", f"{s}_b"), split_seed=len(s) % 3 + 42, split_ratio=0.3 if s.endswith("1") else 0.5, include_original_as_positive=s.endswith("2"))) for s in names]
    return spark.createDataFrame([(s, c.ident(), c.folder()) for s, c in cfg], "source string, ident string, folder string")


# ---- vectors ------------------------------------------------------------------------------------------------

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Windows of a text (64 tokens), the letters of each, their sum and its length; texts of both sides.
_LETTER_VECTORS = f"""tx AS (SELECT 'd' AS side, CAST(doc_id AS VARCHAR) AS id, source AS fam, text, {WORDS} AS t FROM documents WHERE doc_id % 50 = 0 UNION ALL SELECT 'r', CAST(item_id AS VARCHAR), 'item' || item_id, text, {WORDS} FROM benchmark),
wn AS (SELECT side, id, fam, unnest(CASE WHEN len(t) <= 64 THEN [text] ELSE list_transform(range(0, CAST(ceil((len(t) - 2) / 62.0) AS BIGINT)), lambda i: array_to_string(t[2 + i * 62 : least(1 + (i + 1) * 62, len(t) - 1)], ' ')) END) AS w FROM tx),
lt AS (SELECT side, id, fam, list_transform(string_split('{','.join(_LETTERS)}', ','), lambda c: CAST(length(w) - length(replace(w, c, '')) AS DOUBLE)) AS v FROM wn),
un AS (SELECT side, id, fam, unnest(range(1, 27)) AS k, unnest(v) AS x FROM lt), mn AS (SELECT side, id, fam, k, avg(x) AS x FROM un GROUP BY ALL),
vc AS (SELECT side, id, fam, list(x ORDER BY k) AS v, count(*) AS n FROM mn GROUP BY ALL)"""


def _letters(texts: list[str]):
    import numpy as np

    return np.array([[t.count(c) for c in _LETTERS] for t in texts], np.float64).reshape(-1, len(_LETTERS))


@query(f"""WITH {_LETTER_VECTORS}, sc AS (SELECT q.id AS q, q.fam AS qf, r.id AS r, r.fam AS rf, round(list_cosine_similarity(q.v, r.v), 6) AS s FROM vc q JOIN vc r ON q.side = 'd' AND r.side = 'r'),
b AS (SELECT *, max(s) OVER (PARTITION BY q) AS top FROM sc) SELECT q AS query_doc_id, qf AS query_family_id, round(max(s), 4) AS confidence FROM b GROUP BY ALL""")
def k1_vector_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letter counts as the encoder, windows of 64 tokens: each query's best similarity (K1 to K4, K9; ties leave the reference open).

    Texts without letters have no cosine: NaN.
    """
    docs = corpus(spark, sf_dir)
    found = matching.vector_matches(_items(spark, sf_dir), docs.where(F.col("doc_id").cast("long") % 50 == 0), encode=_letters, limit=64, dtype="float64", undefined=float("nan"))
    return found.select("query_doc_id", "query_family_id", F.round(F.round("confidence", 6), 4).alias("confidence"))


@query(f"""WITH w AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, source AS family_id, len({WORDS}) AS n FROM documents)
SELECT doc_id, family_id, CAST(CASE WHEN n <= 64 THEN 1 ELSE ceil((n - 2) / 62.0) END AS BIGINT) AS n_windows, CAST(26 AS BIGINT) AS dim, 0 AS n_without FROM w""")
def k5_encoded_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a set, kept by set, model and window, and read the second time."""
    cache, docs = fresh_folder(spark, "cache"), corpus(spark, sf_dir)
    matching.encoded_set(spark, docs, cache, "docs", "letters/v1", _letters, 64)
    got = matching.encoded_set(spark, docs.limit(0), cache, "docs", "letters/v1", _letters, 64)  # from the files
    matching.assert_vectors(docs, got)
    missing = docs.join(got, "doc_id", "left_anti").count()
    return got.select("doc_id", "family_id", F.col("n_windows").cast("long").alias("n_windows"), F.size("embedding").cast("long").alias("dim"), F.lit(missing).cast("int").alias("n_without"))


# ---- near-duplicates and versions ---------------------------------------------------------------------------


@query(f"""WITH sq AS (SELECT doc_id, {SQUASH.format('text')} AS s FROM documents), sh AS (SELECT doc_id, unnest(list_distinct(CASE WHEN length(s) = 0 THEN [] WHEN length(s) < 20 THEN [s] ELSE list_transform(range(1, length(s) - 18), lambda i: substr(s, i, 20)) END)) AS h FROM sq),
f AS (SELECT doc_id FROM documents ORDER BY CAST(doc_id AS VARCHAR) LIMIT 2000), c AS (SELECT count(*) * 0.02 AS cut FROM f), bp AS (SELECT h FROM sh SEMI JOIN f USING (doc_id), c WHERE c.cut >= 1 GROUP BY h, c.cut HAVING count(*) >= c.cut)
SELECT CAST(doc_id AS VARCHAR) AS forum_id, count(*) AS n FROM sh ANTI JOIN bp USING (h) GROUP BY doc_id""")
def b13_without_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles of each document that are no boilerplate."""
    docs = corpus(spark, sf_dir).select(F.col("doc_id").alias("forum_id"), "text")
    rows = near_duplicates.shingle_rows(docs)
    common = near_duplicates.boilerplate(docs, rows, share=0.02, least=1)
    return rows.join(common, "h", "left_anti").groupBy("forum_id").agg(F.count("*").alias("n"))


@query(f"""WITH {NUMBERED}, z AS (SELECT 'casimir:' || f || ':v' || n AS doc_id, 'casimir:' || f AS family_id, n FROM y WHERE CAST(substr(f, 2) AS BIGINT) % 2 = 0) SELECT * FROM z""")
def f6_kept_forums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of the forums that stay only."""
    texts, mapping, metadata = _order_versions(spark, sf_dir)
    kept = mapping.select(F.col("id_forum").alias("forum_id")).where(F.substring("forum_id", 2, 20).cast("long") % 2 == 0)
    docs = versions.assemble(versions.version_meta(texts, mapping, metadata), kept, mapping.select(F.col("id_forum").alias("forum_id"), "split"))
    return docs.select("doc_id", "family_id", F.col("version_index").alias("n"))


@query("""SELECT 'v' || conv_id || '::<NA>::<NA>::<NA>::' || turn || '::' || substr(md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 1, 16) AS sentence_id, 'v' || conv_id AS version_id FROM conversations
WHERE role IN ('system', 'user', 'assistant') AND trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' AND NOT (role = 'user' AND lower(trim(text)) = 'abstract')""")
def p39_made_sentence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of sentences that come without one."""
    pairs = _sentence_pairs(spark, sf_dir).withColumn("id-sentence-1", F.lit(""))
    return versions.side_sentences(pairs, 1).select("sentence_id", "version_id")


_SETS = """SELECT set_name, count(doc_id) AS n FROM (VALUES ('v1_only'), ('revisions'), ('latest_only')) AS z(set_name)
LEFT JOIN y ON y.last >= 2 AND ((set_name = 'v1_only' AND n = 1) OR (set_name = 'revisions' AND n > 1) OR (set_name = 'latest_only' AND n = last)) GROUP BY 1"""


@query(f"WITH {NUMBERED}, d AS (SELECT *, v AS doc_id FROM y) {_SETS.replace('JOIN y ON y.last', 'JOIN d ON d.last')}")
def b20_stored_revision_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three revision sets written and read again, with their sizes."""
    texts, mapping, metadata = _order_versions(spark, sf_dir)
    docs = versions.assemble(versions.version_meta(texts, mapping, metadata), None, mapping.select(F.col("id_forum").alias("forum_id"), "split"))
    folder, names = fresh_folder(spark, "prepared"), ("v1_only", "revisions", "latest_only")
    for name, part in zip(names, versions.revision_sets(docs)):
        tables.save_set(part, folder, name)
    sizes = [tables.load_set(spark, folder, name).agg(F.count("doc_id").alias("n")).select(F.lit(name).alias("set_name"), "n") for name in names]
    return sizes[0].union(sizes[1]).union(sizes[2])


@query("""WITH p AS (SELECT conv_id // 3 AS w, conv_id, role, trim(text) AS t FROM conversations), s AS (SELECT w, conv_id, count(*) FILTER (WHERE role = 'assistant' AND t <> '') AS a, count(*) FILTER (WHERE role = 'system' AND t <> '' AND conv_id % 3 > 0) AS y FROM p GROUP BY ALL), m AS (SELECT w, sum(a) AS a, sum(y) AS y FROM s GROUP BY w)
SELECT 'par3_gt' AS set_name, count(*) AS n FROM m UNION ALL SELECT 'par3_human', coalesce(sum((a > 0)::INT + (y > 0)::INT), 0)::BIGINT FROM m UNION ALL SELECT 'par3_human_t1', count(*) FILTER (WHERE a > 0) FROM m
UNION ALL SELECT 'par3_gt_split', count(*) FROM s UNION ALL SELECT 'par3_human_split', coalesce(sum((a > 0)::INT + (y > 0)::INT), 0)::BIGINT FROM s UNION ALL SELECT 'par3_human_t1_split', count(*) FILTER (WHERE a > 0) FROM s""")
def b7_translation_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six sets of translations, written, with their sizes."""
    folder = fresh_folder(spark, "prepared")
    translations.prepare_translations(_works(spark, sf_dir), folder)
    names = [f"par3_{kind}{suffix}" for suffix in ("", "_split") for kind in ("gt", "human", "human_t1")]
    sizes = [tables.load_set(spark, folder, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("set_name"), "n") for n in names]
    out = sizes[0]
    for more in sizes[1:]:
        out = out.union(more)
    return out


# ---- variation ----------------------------------------------------------------------------------------------


@query(f"""SELECT CAST(doc_id AS VARCHAR) || '__dipper_lex40_order20_s7' AS doc_id, CAST(doc_id AS VARCHAR) AS source_doc_id, 'lex40_order20' AS variant_level, CAST(7 AS BIGINT) AS variant_seed, md5('again ' || text) AS text_md5, CAST(len({WORDS}) + 1 AS INTEGER) AS num_words FROM documents""")
def b23_stored_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set of variants written under its name and read again."""
    folder, how = fresh_folder(spark, "prepared"), variation.Variation(40, 20, seed=7)
    name = variation.prepare_variants(corpus(spark, sf_dir), folder, "corpus", lambda texts: [f"again {t}" for t in texts], how, batch=8)
    return tables.load_set(spark, folder, name).select("doc_id", "source_doc_id", "variant_level", "variant_seed", F.md5("text").alias("text_md5"), "num_words")


_NOUN = "list_filter(string_split(regexp_replace(text, '[^a-z]+', ' ', 'g'), ' '), lambda w: w <> '')"


@query(f"""WITH w AS (SELECT doc_id, {_NOUN} AS w FROM documents), k AS (SELECT doc_id, w, CAST(ceil(len(w) / 5.0) AS BIGINT) AS s FROM w)
SELECT doc_id, s AS n_sentences, CAST(ceil(s / 3.0) AS BIGINT) AS n_windows, md5(coalesce(array_to_string(w, ' '), '')) AS words_md5 FROM k""")
def x3_windowed_rewriting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut into sentences of five words, rewritten three sentences at a time with what came before as context."""
    import re

    @F.pandas_udf("n_sentences long, n_windows long, words_md5 string")
    def rewrite(texts: pd.Series) -> pd.DataFrame:
        import hashlib

        out = []
        for t in texts:
            words = [w for w in re.sub("[^a-z]+", " ", t).split(" ") if w]
            text = " ".join("X" + " ".join(words[i : i + 5]) + "." for i in range(0, len(words), 5))
            calls: list[int] = []

            def echo(asked: list[str], calls=calls) -> list[str]:
                calls.append(len(asked))
                return [re.search("<sent> (.*) </sent>", a)[1] for a in asked]

            made = variation.rewritten([text], echo, variation.Variation())[0]
            plain = " ".join(s.removeprefix("X").removesuffix(".") for s in variation.sentences(made))
            out.append((len(variation.sentences(text)), len(calls), hashlib.md5(plain.encode()).hexdigest()))
        return pd.DataFrame(out, columns=["n_sentences", "n_windows", "words_md5"])

    return table(spark, sf_dir, "documents").select("doc_id", rewrite("text").alias("r")).select("doc_id", "r.*")


# ---- runs and reports ---------------------------------------------------------------------------------------

#: Evaluation by language, each a run: English as krapivin, French as par3, German as casimir_raw.
_RUNS = {"en": "krapivin", "fr": "par3", "de": "casimir_raw"}
_BY_LANG = f"""{JUDGED}, tl AS (SELECT lang, coalesce(conf, 0) AS threshold, count(*) FILTER (WHERE pos) AS p0, count(*) FILTER (WHERE NOT pos) AS n0 FROM d WHERE lang IN ('en', 'fr', 'de') GROUP BY 1, 2),
cl AS (SELECT lang, threshold, p0, n0, sum(p0) OVER w AS tp, sum(n0) OVER w AS fp, sum(p0) OVER (PARTITION BY lang) AS p, sum(n0) OVER (PARTITION BY lang) AS n FROM tl WINDOW w AS (PARTITION BY lang ORDER BY threshold DESC)),
gl AS (SELECT *, CASE WHEN p > 0 AND n > 0 THEN 2 * (tp / (tp + fp)) * (tp / p) / (tp / (tp + fp) + tp / p + 1e-12) END AS f1 FROM cl),
bl AS (SELECT lang, max(f1) AS best_f1, coalesce(arg_min(threshold, threshold) FILTER (WHERE f1 = (SELECT max(f1) FROM gl x WHERE x.lang = gl.lang)), 0.5) AS used, CASE WHEN max(p) > 0 AND max(n) > 0 THEN sum(p0 * (n - fp + n0 / 2)) / (max(p) * max(n)) END AS roc_auc FROM gl GROUP BY lang),
rn AS (SELECT CASE bl.lang WHEN 'en' THEN 'krapivin' WHEN 'fr' THEN 'par3' ELSE 'casimir_raw' END AS dataset, bl.best_f1, bl.roc_auc, bl.used, count(*) AS n_query, count(*) FILTER (WHERE pos AND coalesce(conf, 0) >= used AND conf IS NOT NULL) AS tp, count(*) FILTER (WHERE pos) AS np,
  count(*) FILTER (WHERE pos AND conf >= used AND fam = source) AS ok FROM bl JOIN d USING (lang) GROUP BY ALL)"""


def _stored_runs(spark: SparkSession, sf_dir: str) -> str:
    """Artifacts of three runs."""
    folder = fresh_folder(spark, "artifacts").removeprefix("file:")
    truth, matches = _judged(spark, sf_dir)
    langs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("query_doc_id"), "lang")
    for lang, dataset in _RUNS.items():
        cfg = RunConfig(dataset, "bm25", artifacts_dir=folder)
        own = langs.where(F.col("lang") == lang).select("query_doc_id")
        t, m = truth.join(own, "query_doc_id", "left_semi"), matches.join(own, "query_doc_id", "left_semi")
        save_run(cfg.folder(), t, m, {"inference_total_sec": 1.5, "build_sec": 0.5}, "bm25", {"n_ref_docs": 1, "n_query_docs": t.count()}, dataset, cfg.variants, False)
    return folder


@query(f"""WITH {_BY_LANG} SELECT dataset, 'bm25' AS method, 'default' AS run_tag, round(best_f1, 9) AS best_f1, round(roc_auc, 9) AS roc_auc, round(CASE WHEN np = 0 THEN 0 ELSE ok / np END, 9) AS attribution, CAST(0.5 AS DOUBLE) AS registration_sec, CAST(1.5 AS DOUBLE) AS inference_sec, n_query AS n_query_docs FROM rn""")
def s13_run_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs evaluated and written, and their metrics scanned."""
    runs = report.metrics_table(spark, _stored_runs(spark, sf_dir))
    return runs.select("dataset", "method", "run_tag", F.round("best_f1", 9).alias("best_f1"), F.round("roc_auc", 9).alias("roc_auc"), F.round("attribution", 9).alias("attribution"), "registration_sec", "inference_sec", "n_query_docs")


@query(f"""WITH {_BY_LANG} SELECT m.metric, v.label, CASE WHEN v.label = 'BM25' THEN (SELECT round_even(CASE m.metric WHEN 'Best-F1 under an oracle threshold' THEN best_f1 WHEN 'Source-attribution accuracy' THEN CASE WHEN np = 0 THEN 0 ELSE ok / np END END, 3) FROM rn WHERE dataset = 'krapivin') END AS "Krapivin paraphrase",
  CASE WHEN v.label = 'BM25' THEN (SELECT round_even(CASE m.metric WHEN 'Best-F1 under an oracle threshold' THEN best_f1 WHEN 'Source-attribution accuracy' THEN CASE WHEN np = 0 THEN 0 ELSE ok / np END END, 3) FROM rn WHERE dataset = 'par3') END AS "PAR3 translation",
  CASE WHEN v.label = 'BM25' THEN (SELECT round_even(CASE m.metric WHEN 'Best-F1 under an oracle threshold' THEN best_f1 WHEN 'Source-attribution accuracy' THEN CASE WHEN np = 0 THEN 0 ELSE ok / np END END, 3) FROM rn WHERE dataset = 'casimir_raw') END AS "CASIMIR revision"
FROM (VALUES ('Best-F1 under an oracle threshold'), ('Source-attribution accuracy')) AS m(metric), (VALUES {", ".join(f"('{label}')" for label, _, _ in report.ROWS)}) AS v(label)""")
def u7_stacked_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result table's blocks, stacked for CSV."""
    return report.stacked(report.result_tables(spark, _stored_runs(spark, sf_dir)))


@query(f"""WITH {_BY_LANG} SELECT dataset AS panel, 'BM25' AS label, round(roc_auc, 9) AS roc_auc FROM rn WHERE dataset IN ('par3', 'casimir_raw') AND roc_auc IS NOT NULL""")
def m13_roc_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROC areas by panel from the stored per-query tables (M11 to M13, S18's numbers)."""
    return report.roc_table(spark, _stored_runs(spark, sf_dir)).withColumn("roc_auc", F.round("roc_auc", 9))


@query("""WITH m AS (SELECT n_name AS set_name, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey), u AS (SELECT DISTINCT o_custkey FROM orders)
SELECT set_name, round(100.0 * count(o_custkey) / count(*), 9) AS seconds FROM m LEFT JOIN u ON o_custkey = c_custkey GROUP BY 1""")
def a19_prorated_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set's encoding time in proportion to the documents that a run used."""
    members = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("set_name"), F.col("c_custkey").alias("doc_id"))
    costs = members.select("set_name").distinct().withColumn("sec", F.lit(100.0))
    return report.prorated_cost(costs, members, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"))).withColumn("seconds", F.round("seconds", 9))


@query(f"""WITH w AS (SELECT doc_id, len({WORDS}) AS n FROM documents WHERE doc_id % 4 = 0) SELECT 'krapivin' AS dataset, 'krapivin_original' AS original_set, count(*) AS docs, (SELECT count(*) FROM documents WHERE doc_id % 4 <> 0) AS variants, round(100.0 * count(*) FILTER (WHERE n > 64) / count(*), 9) AS over_window_pct FROM w""")
def a20_corpus_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the stored sets and the share of documents over the window."""
    folder = fresh_folder(spark, "corpus")
    originals, variants, _ = _families(spark, sf_dir)
    original, (name,) = DATASETS["krapivin"]
    tables.save_set(originals, folder, original)
    tables.save_set(variants, folder, name)
    matching.encoded_set(spark, tables.load_set(spark, folder, original), folder, original, "letters", _letters, 64)
    return report.corpus_table(spark, folder, folder, "letters", window=64).withColumn("over_window_pct", F.round("over_window_pct", 9))


#: The flagship in SQL: split by families, BM25 of the variants and the benign side against the confidential originals.
_RUN = f"""{RANKED.format("'f' || (doc_id // 4)", 'documents WHERE doc_id % 4 = 0')}, fd AS (SELECT CAST(doc_id AS VARCHAR) AS id, 'f' || (doc_id // 4) AS fam, doc_id % 4 = 0 AS original, text, partition FROM documents JOIN sp ON sp.family_id = 'f' || (doc_id // 4)),
{BM25_OF.format(reference="(SELECT id, fam, text FROM fd WHERE partition = 'confidential' AND original)", queries="(SELECT id, fam, text FROM fd WHERE partition = 'benign' OR NOT original)")},
js AS (SELECT fd.id, fd.fam, fd.partition = 'confidential' AS pos, coalesce(k.score, 0) AS conf, k.rf FROM fd LEFT JOIN k ON k.q = fd.id AND k.rank = 1 WHERE fd.partition = 'benign' OR NOT fd.original),
ts AS (SELECT conf AS threshold, count(*) FILTER (WHERE pos) AS p0, count(*) FILTER (WHERE NOT pos) AS n0 FROM js GROUP BY 1),
cs AS (SELECT threshold, p0, n0, sum(p0) OVER (ORDER BY threshold DESC) AS tp, sum(n0) OVER (ORDER BY threshold DESC) AS fp, sum(p0) OVER () AS p, sum(n0) OVER () AS n FROM ts),
gs AS (SELECT *, tp / (tp + fp) AS pr, tp / p AS re, 2 * (tp / (tp + fp)) * (tp / p) / (tp / (tp + fp) + tp / p + 1e-12) AS f1 FROM cs), bs AS (SELECT * FROM gs ORDER BY f1 DESC, threshold LIMIT 1)"""


@query(f"""WITH {_RUN} SELECT round(b.threshold, 5) AS best_threshold, round(b.f1, 6) AS best_f1, round(b.pr, 6) AS best_precision, round(b.re, 6) AS best_recall, round((SELECT sum(p0 / p * pr) FROM gs), 4) AS pr_auc,
  round((SELECT sum(p0 * (n - fp + n0 / 2)) / (max(p) * max(n)) FROM gs), 4) AS roc_auc, round(b.p / (b.p + b.n), 6) AS positive_ratio FROM bs b""")
def run_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: split, query sets, BM25 and evaluation, as one row of metrics."""
    from strandline.operators import split

    s = split.query_sets(*_families(spark, sf_dir))
    matches = matching.bm25_matches(s.reference, s.queries, ascii_only=True)
    row = evaluation.sweep(evaluation.curve(evaluation.scored(evaluation.manifest(s.positive, s.benign), matches)))
    digits = {"best_threshold": 5, "pr_auc": 4, "roc_auc": 4}
    return row.select(*(F.round(c, digits.get(c, 6)).alias(c) for c in row.columns))


@query(f"""WITH {RANKED.format("'f' || (doc_id // 4)", 'documents WHERE doc_id % 4 = 0')}, fd AS (SELECT doc_id % 4 = 0 AS original, partition FROM documents JOIN sp ON sp.family_id = 'f' || (doc_id // 4))
SELECT 'krapivin' AS dataset, 'bm25' AS method, 'matrix' AS run_tag, count(*) FILTER (WHERE partition = 'confidential' AND original) AS n_ref_docs, count(*) FILTER (WHERE partition = 'benign' OR NOT original) AS n_query_docs, true AS ran, 1 AS failed FROM fd""")
def x10_run_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix of two whole runs from stored sets, the first of which fails and stops nothing."""
    from strandline.cli import run_all

    folder = fresh_folder(spark, "matrix").removeprefix("file:")
    originals, variants, _ = _families(spark, sf_dir)
    original, (name,) = DATASETS["krapivin"]
    tables.save_set(originals, folder, original)
    tables.save_set(variants, folder, name)
    base = {"prepared_dir": folder, "splits_dir": f"{folder}/splits", "artifacts_dir": folder}
    cfg = RunConfig("krapivin", "bm25", **base, method_params={"ascii_only": True})
    failed = run_all(spark, [RunConfig("par3", "bm25", **base), cfg], "matrix")
    runs = report.metrics_table(spark, folder)
    return runs.select("dataset", "method", "run_tag", "n_ref_docs", "n_query_docs", (F.col("inference_sec") > 0).alias("ran"), F.lit(len(failed)).cast("int").alias("failed"))




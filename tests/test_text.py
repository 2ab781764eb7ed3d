"""Normalisation, identifiers, lexical metrics and fuzzy hashes on hand-made values."""

import itertools
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.functions import fuzzy, lexical, text


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", make(F.col("v")).alias("r"))
    return [r["r"] for r in rows.orderBy("i").collect()]


def test_clean_and_counts(spark):
    values = [None, "", "  a  b\r\nc ", "x"]
    assert column(spark, values, text.clean) == ["", "", "a b c", "x"]
    assert column(spark, values, text.word_count) == [0, 0, 3, 1]
    assert column(spark, [None, "", " \t", "é f "], text.stripped) == ["", "", "", "é f"]
    assert column(spark, [None, " \n", "a"], text.guarded) == [" ", " ", "a"]
    assert column(spark, ["nan", "x", None, "1.5"], text.is_missing) == [True, False, True, False]


def test_identifiers(spark):
    values = [" A b\tC ", "Étude: n°1", "a@b.c-d", ""]
    want = ["a_bc", "tude:_n1", "a@b.c-d", ""]
    assert column(spark, values, text.sanitize) == want
    assert [text.sanitized(v) for v in values] == want
    assert column(spark, ["P 1"], lambda c: text.doc_id(text.family_id(F.lit("Set A"), c), text.revision_key(F.lit(2)))) == ["set_a:p_1:v2"]
    assert text.model_slug("a/b:c@d") == "a__b_c_d"


def test_listlike_and_json(spark):
    assert column(spark, ['["a", " b ", ""]', "['x','y']", "nonsense", None, ""], text.listlike) == [["a", "b"], ["x", "y"], [], [], []]
    assert column(spark, ["['a', None, ' b  c ']", "('a',)", "[('x', 'y')]", "[None]", "['a'"], text.listlike) == [["a", "b c"], [], ["('x', 'y')"], [], []]
    assert column(spark, ['{"paperhash": " h  1 "}', "{", None, "[]"], text.paperhash) == ["h 1", "", "", ""]
    assert column(spark, ["Article-Title", "PARAGRAPH", "Footnote", None, "title"], text.sentence_type) == ["title", "p", "footnote", "", "title"]
    assert column(spark, [1], lambda c: text.meta_json(a=c, b=F.lit(None).cast("string")), "int") == ['{"a":1,"b":null}']
    assert column(spark, ["3", "x", None], text.number_or_last) == [3.0, 1e15, 1e15]


def test_languages_and_parts(spark):
    assert column(spark, ["book_ru", "book_1_x_zz", "book"], text.language_of) == ["ru", "zz", "unknown"]
    assert column(spark, ["ru", "zz"], text.language_name) == ["Russian", "zz"]
    assert column(spark, [[" a ", None, "", "b"]], text.paragraphs_joined, "array<string>") == ["a\nb"]
    parts = [("T", "A", "B"), ("", "A", ""), ("T", "", "B"), ("", "", "")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(parts)], "i int, t string, a string, b string")
    got = [r["x"] for r in rows.select("i", text.record_text(F.col("t"), F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()]
    assert got == ["T\n\nAbstract\nA\n\nB", "Abstract\nA", "T\n\nB", ""]


def test_squash_and_shingles(spark):
    assert column(spark, ["ﬁne Café 12!", None, "漢字"], text.squash) == ["fine" + "cafe12", "", ""]
    assert len(text.shingle_codes("abc")) == 1 and len(text.shingle_codes("")) == 0
    assert len(text.shingle_codes("a" * 50)) == 1 and len(text.shingle_codes("abcdefghijklmnopqrstuvwxyz")) == 7
    a, b = "the quick brown fox jumps over the lazy dog".replace(" ", ""), "the quick brown fox jumps over the lazy cat".replace(" ", "")
    plain = lambda s: {s[i : i + 20] for i in range(len(s) - 19)}
    assert len(set(text.shingle_codes(a)) & set(text.shingle_codes(b))) == len(plain(a) & plain(b))


def test_title_keys(spark):
    values = ["\n \nA Sufficiently Long Title of a Paper\nbody", "Short\nA Sufficiently Long Title of a Paper", "Anonymous Authors, Paper under Review at a Venue", None, "   "]
    assert column(spark, values, text.title_key) == ["asufficientlylongtitleofapaper", None, None, None, None]


def test_windows(spark):
    toks = [list(map(str, range(n))) for n in (0, 3, 5, 6, 12)]
    got = column(spark, toks, lambda c: text.windows(c, 5), "array<string>")
    assert got[:3] == [[t] for t in toks[:3]]
    assert got[3] == [["1", "2", "3"], ["4"]]
    assert list(itertools.chain(*got[4])) == toks[4][1:-1] and [len(w) for w in got[4]] == [3, 3, 3, 1]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=90), st.lists(st.sampled_from("abc"), max_size=90))
def test_edit_distance(a, b):
    assert lexical.edit_distance(a, b) == plain_distance(a, b)


def test_bleu_by_hand():
    assert lexical.bleu_of("a b c d".split(), "a b c".split()) == 0.0
    assert lexical.bleu_of("a b c d e".split(), "a b c d e".split()) == pytest.approx(1.0)
    got = lexical.bleu_of("a b c d e f".split(), "a b x d e".split())
    want = math.exp(1 - 6 / 5) * math.exp((math.log(4 / 5) + math.log(2 / 4) + math.log(0.1 / 3) + math.log(0.1 / 2)) / 4)
    assert got == pytest.approx(want)


def test_lexical_columns(spark):
    rows = spark.createDataFrame([(1, "The cat sat on the mat", "the cat sat"), (2, "", ""), (3, "a b c d", "a b c d"), (4, "a", "")], "i int, r string, h string")
    got = {r["i"]: r for r in lexical.with_lexical_metrics(rows, "r", "h").collect()}
    assert (got[1]["ngram_overlap_1"], got[1]["ngram_overlap_3"], got[1]["bleu"]) == (1.0, 1.0, 0.0)
    assert got[1]["jaccard_tokens"] == pytest.approx(3 / 5) and got[1]["norm_edit_distance"] == pytest.approx(0.5)
    assert all(got[2][m] == 0.0 for m in lexical.METRICS)
    assert got[3]["bleu"] == pytest.approx(1.0) and got[4]["norm_edit_distance"] == 1.0
    assert set(rows.columns) <= set(lexical.with_lexical_metrics(rows, "r", "h").columns)


def test_fuzzy_hashes():
    rng = random.Random(4)
    base = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(900))
    edited = base[:2000] + "something else entirely" + base[2050:]
    other = " ".join("".join(rng.choice("qrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(900))
    a, b, c = map(fuzzy.fuzzy_hash, (base, edited, other))
    assert fuzzy.fuzzy_compare(a, a) == 100 and fuzzy.fuzzy_compare(a, b) > 50 and fuzzy.fuzzy_compare(a, c) == 0
    assert fuzzy.fuzzy_hash("") is None and fuzzy.fuzzy_hash(None) is None and fuzzy.fuzzy_compare(None, a) == 0
    assert fuzzy.fuzzy_compare(a, b) == fuzzy.fuzzy_compare(b, a)
    size, one, two = a.split(":")
    assert int(size) % 3 == 0 and len(one) <= 64 and len(two) <= 32


def plain_rolling(data):
    window, h1, h2, h3, out = [0] * 7, 0, 0, 0, []
    for n, c in enumerate(data):
        h2 = h2 - h1 + 7 * c & 0xFFFFFFFF
        h1 = h1 + c - window[n % 7] & 0xFFFFFFFF
        window[n % 7] = c
        h3 = (h3 << 5 & 0xFFFFFFFF) ^ c
        out.append(h1 + h2 + h3 & 0xFFFFFFFF)
    return out


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=200))
def test_rolling_hash(data):
    assert fuzzy.rolling(data).tolist() == plain_rolling(data)

"""Lexical metrics of a reference text and a rewritten one."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from strandline.functions.text import ngrams, safe_ratio, tokens

BLEU_ORDER, BLEU_EPSILON = 4, 0.1
METRICS = ("ngram_overlap_1", "ngram_overlap_2", "ngram_overlap_3", "bleu", "norm_edit_distance", "jaccard_tokens")


def ngram_overlap(ref: Column, hyp: Column, n: int) -> Column:
    """Share of the distinct n-grams of hyp that ref has too; 0 if hyp has none.  Both are token arrays."""
    of_hyp = F.array_distinct(ngrams(hyp, n))
    return safe_ratio(F.size(F.array_intersect(of_hyp, ngrams(ref, n))), F.size(of_hyp))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 if both are empty."""
    return safe_ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def bleu_of(ref: list[str], hyp: list[str], order: int = BLEU_ORDER, epsilon: float = BLEU_EPSILON) -> float:
    """BLEU with clipped precisions up to `order`; no common n-gram counts as epsilon; 0 if hyp is shorter than `order`."""
    if len(hyp) < order:
        return 0.0
    total = 0.0
    for n in range(1, order + 1):
        h, r = (Counter(zip(*(t[i:] for i in range(n)))) for t in (hyp, ref))
        total += math.log((sum((h & r).values()) or epsilon) / (len(hyp) - n + 1))
    brevity = 1.0 if len(hyp) > len(ref) else math.exp(1 - len(ref) / len(hyp))
    return brevity * math.exp(total / order)


@F.pandas_udf(DoubleType())
def bleu(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """bleu_of (P30): with arrays only, clipped counts would take time with the square of a text's length."""
    return pd.Series([bleu_of(list(a), list(b)) for a, b in zip(ref, hyp)])


def edit_distance(a: list[str], b: list[str]) -> int:
    """Levenshtein distance of two token lists by Myers' bit vectors over Python integers."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    at: dict[str, int] = {}
    for i, t in enumerate(b):
        at[t] = at.get(t, 0) | 1 << i
    m, last = len(b), 1 << len(b) - 1
    full = (1 << m) - 1
    plus, minus, score = full, 0, m
    for t in a:
        eq = at.get(t, 0)
        d0 = ((eq & plus) + plus ^ plus) | eq | minus
        up, down = minus | ~(d0 | plus) & full, d0 & plus
        score += bool(up & last) - bool(down & last)
        up, down = up << 1 | 1, down << 1
        plus, minus = (down | ~(d0 | up)) & full, d0 & up & full
    return score


@F.pandas_udf(DoubleType())
def norm_edit_distance(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """Token edit distance over the longer length; 0 if both are empty."""
    return pd.Series([edit_distance(list(a), list(b)) / max(len(a), len(b)) if len(a) or len(b) else 0.0 for a, b in zip(ref, hyp)])


def with_lexical_metrics(df: DataFrame, ref: str, hyp: str, edit: bool = True) -> DataFrame:
    """df with all metrics of two text columns (P31).  Tokens and n-grams are columns of their own, computed once."""
    df = df.withColumns({"_a": tokens(F.col(ref)), "_b": tokens(F.col(hyp))})
    df = df.withColumns({f"_{c}{n}": F.array_distinct(ngrams(F.col(f"_{c}"), n)) for c in "ab" for n in (1, 2, 3)})
    out = {f"ngram_overlap_{n}": safe_ratio(F.size(F.array_intersect(f"_b{n}", f"_a{n}")), F.size(f"_b{n}")) for n in (1, 2, 3)} | {"bleu": bleu("_a", "_b")}
    if edit:
        out["norm_edit_distance"] = norm_edit_distance("_a", "_b")
    df = df.withColumns(out | {"jaccard_tokens": jaccard(F.col("_a1"), F.col("_b1"))})
    return df.drop("_a", "_b", *(f"_{c}{n}" for c in "ab" for n in (1, 2, 3)))

"""Rewritten variants of documents by an injected rewriting function."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from strandline.functions.text import meta_json, word_count
from strandline.sources.tables import normalize_docs, save_set

#: Diversities a rewriting model of this kind takes (fixed values).
DIVERSITIES = (0, 20, 40, 60, 80, 100)
_SENTENCE_END = re.compile(r"(?<=[.!?])[\"')\]]*\s+(?=[\"'(\[]?[^\W\d_a-z]|[\"'(\[]?\d)")


@dataclass(frozen=True)
class Variation:
    """Strength of rewriting and size of what one call sees."""

    lex: int = 60
    order: int = 60
    sentences: int = 3
    max_tokens: int = 512
    seed: int = 42

    def __post_init__(self) -> None:
        for name in ("lex", "order"):
            if getattr(self, name) not in DIVERSITIES:
                raise ValueError(f"{name} must be one of {DIVERSITIES}, not {getattr(self, name)}")

    @property
    def level(self) -> str:
        return f"lex{self.lex}_order{self.order}"

    @property
    def control(self) -> str:
        """The model's codes are the inverse of the diversities."""
        return f"lexical = {100 - self.lex}, order = {100 - self.order}"


def sentences(text: str) -> list[str]:
    """Sentences of a text with its white space collapsed."""
    flat = " ".join(text.split())
    return [s for s in _SENTENCE_END.split(flat) if s]


def fitted(control: str, before: list[str], window: str, budget: int, count: Callable[[str], int]) -> str:
    """control, as many of the latest sentences before as fit the budget, and the window; sentences are never cut.

    More sentences never count less, so the number is found by doubling and halving: the work follows the budget, not
    the length of what came before.
    """

    def text(n: int) -> str:
        parts = [control, " ".join(before[len(before) - n :]).strip(), window]
        return " ".join(p for p in parts if p)

    low, high = 0, 1
    while high <= len(before) and count(text(high)) <= budget:
        low, high = high, 2 * high
    high = min(high, len(before) + 1)
    while high - low > 1:
        middle = (low + high) // 2
        if count(text(middle)) <= budget:
            low = middle
        else:
            high = middle
    return text(low)


def rewritten(texts: list[str], rewrite: Callable[[list[str]], list[str]], how: Variation, count: Callable[[str], int] = lambda s: len(s.split())) -> list[str]:
    """Window after window of each text, all texts in step; what has been rewritten is the context of what follows."""
    todo = [sentences(t) for t in texts]
    done: list[list[str]] = [[] for _ in texts]
    context: list[list[str]] = [[] for _ in texts]
    for at in range(0, max(map(len, todo), default=0), how.sentences):
        live = [i for i, s in enumerate(todo) if at < len(s)]
        asked = [fitted(how.control, context[i], f"<sent> {' '.join(todo[i][at : at + how.sentences])} </sent>", how.max_tokens, count) for i in live]
        for i, out in zip(live, rewrite(asked)):
            done[i].append(out)
            context[i] += sentences(out)
    return [" ".join(d).strip() for d in done]


def variants(originals: DataFrame, rewrite: Callable[[list[str]], list[str]], how: Variation = Variation(), batch: int = 1, timed: bool = True) -> DataFrame:
    """Canonical variants: rewrite maps a list of whole texts to rewritten ones, `batch` texts a call."""
    step = max(1, int(batch))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out, sec = [], []
            for at in range(0, len(pdf), step):
                texts = pdf["text"].iloc[at : at + step].tolist()
                began = time.perf_counter()
                out += list(rewrite(texts))
                sec += [round((time.perf_counter() - began) / len(texts), 1) if timed else 0.0] * len(texts)
            yield pdf.assign(para=out, sec=sec)

    rows = originals.select("doc_id", "dataset", "family_id", F.coalesce("text", F.lit("")).alias("text"))
    made = rows.mapInPandas(run, StructType([*rows.schema, StructField("para", StringType()), StructField("sec", DoubleType())]))
    docs = made.select(
        F.concat("doc_id", F.lit(f"__dipper_{how.level}_s{how.seed}")).alias("doc_id"), "dataset", "family_id", F.col("para").alias("text"), F.lit("dipper").alias("variant_type"),
        F.lit(how.level).alias("variant_level"), F.lit(how.seed).cast("long").alias("variant_seed"), F.col("doc_id").alias("source_doc_id"),
        meta_json(lex=F.lit(how.lex), order=F.lit(how.order), sec=F.col("sec"), in_words=word_count(F.col("text")), out_words=word_count(F.col("para"))).alias("meta_json"),
    )
    return normalize_docs(docs, check=False)


def prepare_variants(originals: DataFrame, folder: str, dataset: str, rewrite: Callable[[list[str]], list[str]], how: Variation = Variation(), batch: int = 1) -> str:
    """Write the set `<dataset>_original_dipper_lex<L>_order<O>_s<seed>`."""
    name = f"{dataset}_original_dipper_{how.level}_s{how.seed}"
    save_set(variants(originals, rewrite, how, batch), folder, name)
    return name

"""Operator 10: language identification of words, spans and documents.

A word's script (by code point ranges) narrows the languages to those that training saw in that script for at
least one in a hundred of the language's own words (`min_share`), however few its documents are; where no language
has so many, to all that training saw there.
Each word has a score per candidate: the sum of log probabilities of its character n-grams (1 to 3, with
word edges).  Viterbi over the words, with a penalty for each switch of language, labels the words; runs of
one label are the spans of mixed-language text.  A document's language is the label with the most letters;
its score is the share of letters so labelled times the mean probability of the label among its words.

Training may use a bounded sample: at most about `sample_docs` labelled documents for each language, taken by
a hash of the text (whole texts).  Counting runs on the executors, into a fixed number of buckets of hashed n-grams.

Defined results: null text, or text without a letter, is `und` with score 0; a language with no training
text is never predicted; without any labelled row everything is `und`; of languages with equally many letters the
first by name is it; texts of any length are read whole; repeated rows give repeated rows; an empty table gives an
empty table.  Identifier, source and language columns never enter a prediction.
"""

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import frugal, id_text, release, slices, texts_of
from strandline.llm.shingles import mixed

#: Starts of ranges of letters and their scripts (fixed values); letters between a range's end and the next start are 'other'.
SCRIPTS = [
    (0x0041, 0x02AF, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"), (0x0530, 0x058F, "armenian"),
    (0x0590, 0x05FF, "hebrew"), (0x0600, 0x077F, "arabic"), (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"),
    (0x0B80, 0x0BFF, "tamil"), (0x0E00, 0x0E7F, "thai"), (0x10A0, 0x10FF, "georgian"), (0x1100, 0x11FF, "hangul"),
    (0x1E00, 0x1EFF, "latin"), (0x1F00, 0x1FFF, "greek"), (0x3040, 0x309F, "kana"), (0x30A0, 0x30FF, "kana"),
    (0x3400, 0x4DBF, "han"), (0x4E00, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"), (0xF900, 0xFAFF, "han"),
]
_STARTS = np.array([s for s, _, _ in SCRIPTS])
_ENDS = np.array([e for _, e, _ in SCRIPTS])
_NAMES = np.array([n for _, _, n in SCRIPTS])
#: Words are runs of letters (Unicode category L); digits, fractions and roman numerals are none.
LETTERS = regex.compile(r"\p{L}+")
UNDETERMINED = "und"
#: Buckets of hashed n-grams, the longest n-gram, and bytes of text whose words are scored at once.
BUCKETS, LONGEST = 1 << 17, 3
TEXT_BYTES = 8 << 20
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words (with word edges from 2 letters on), the word of each, and each word's first letter."""
    code = np.frombuffer(("\n" + "".join(f"<{w}>\n" for w in words)).encode("utf-32-le"), np.uint32).astype(np.uint64)
    breaks = code == 10
    word = np.cumsum(breaks) - 1
    first = code[np.flatnonzero(breaks)[:-1] + 2].astype(np.int64)
    buckets, owners = [], []
    h = np.zeros(len(code), np.uint64)
    ok = np.ones(len(code), bool)
    for n in range(LONGEST):
        h = h[: len(code) - n] + code[n:] * _STEPS[n]
        ok = ok[: len(code) - n] & ~breaks[n:]
        some = ok if n else ok & (code != 60) & (code != 62)
        at = np.flatnonzero(some)
        buckets.append((mixed(h[at] + np.uint64(n)) >> np.uint64(64 - 17)).astype(np.int64))
        owners.append(word[at])
    return np.concatenate(buckets), np.concatenate(owners), first


def scripts_of(first: np.ndarray) -> np.ndarray:
    """Names of the scripts of letters."""
    i = np.searchsorted(_STARTS, first, side="right") - 1
    return np.where((i >= 0) & (first <= _ENDS[i]), _NAMES[i], "other")


class LanguageModel:
    """Log probabilities of hashed n-grams for each language, with add-one smoothing, and the languages of each script."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: dict[str, list[str]], switch: float = 8.0):
        self.languages, self.switch = languages, switch
        self.table = np.log((counts + 1.0) / (counts.sum(axis=0) + len(counts)))
        self.masks = {s: np.array([0.0 if lang in known else -1e6 for lang in languages]) for s, known in scripts.items()}

    def scores(self, words: list[str]) -> np.ndarray:
        """Log scores of lower-cased words, less each word's greatest; a script that training never saw says nothing."""
        k = len(self.languages)
        if not words or not k:
            return np.zeros((len(words), k))
        buckets, owners, first = ngrams(words)
        out = np.stack([np.bincount(owners, weights=self.table[buckets, lang], minlength=len(words)) for lang in range(k)], axis=1)
        names = scripts_of(first)
        for name in np.unique(names):
            some = names == name
            out[some] = out[some] + self.masks[name] if name in self.masks else 0.0
        return out - out.max(axis=1, keepdims=True)

    def label(self, texts: list[np.ndarray], words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Viterbi labels (indices of languages) of the words of each text, and each label's probability by its word alone.

        A text comes as the numbers of its words in `words`.

        All texts advance together, the longest first, so that each step is a few array operations; with one
        penalty for all switches the best predecessor is the same language or the best one of the step before.
        """
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        lengths = [len(texts[i]) for i in order]
        out = [(np.zeros(0, np.int64), np.zeros(0))] * len(texts)
        if not lengths or not lengths[0] or not self.languages:
            return out
        k = len(self.languages)
        flat = self.scores(words).astype(np.float32)[np.concatenate([texts[i] for i in order])]
        starts = np.concatenate(([0], np.cumsum(lengths)))
        active = [bisect.bisect_left(lengths, -t, key=lambda n: -n) for t in range(lengths[0])]  # texts longer than t
        best = flat[starts[: active[0]]].copy()
        stay = np.ones((starts[-1], k), bool)
        top_before = np.zeros(starts[-1], np.int8 if k < 128 else np.int64)
        at_end: list[int] = [0] * active[0]
        for t in range(1, lengths[0]):
            n = active[t]
            for i in range(n, active[t - 1]):
                at_end[i] = int(best[i].argmax())
            prev = best[:n]
            top = prev.argmax(axis=1)
            jump = prev[np.arange(n), top] - self.switch
            rows = starts[:n] + t
            keep = prev >= jump[:, None]
            stay[rows], top_before[rows] = keep, top
            best = np.where(keep, prev, jump[:, None]) + flat[rows]
        for i in range(active[-1]):
            at_end[i] = int(best[i].argmax())
        state = np.array(at_end)
        labels = np.zeros(starts[-1], np.int64)
        for t in range(lengths[0] - 1, -1, -1):
            n = active[t]
            rows = starts[:n] + t
            labels[rows] = state[:n]
            if t:
                now = state[:n]
                state[:n] = np.where(stay[rows, now], now, top_before[rows])
        sure = np.exp(flat[np.arange(len(labels)), labels]) / np.exp(flat).sum(axis=1)
        for j, i in enumerate(order):
            out[i] = labels[starts[j] : starts[j + 1]], sure[starts[j] : starts[j + 1]]
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, str]]:
        """Language, score and spans (language:words, comma-joined) of each text."""
        number: dict[str, int] = {}
        numbered = []
        for t in texts:
            found = LETTERS.findall(t.lower()) if t else []
            numbered.append(np.fromiter((number.setdefault(w, len(number)) for w in found), np.int32, len(found)))
        words = list(number)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out = []
        for own, (lab, sure) in zip(numbered, self.label(numbered, words)):
            if not len(lab):
                out.append((UNDETERMINED, 0.0, ""))
                continue
            letters = sizes[own]
            by = np.bincount(lab, weights=letters, minlength=len(self.languages))
            k = int(by.argmax())
            cuts = np.flatnonzero(np.diff(lab)) + 1
            spans = ",".join(f"{self.languages[lab[s]]}:{e - s}" for s, e in zip(np.r_[0, cuts], np.r_[cuts, len(lab)]))
            out.append((self.languages[k], round(float(by[k] / letters.sum() * sure[lab == k].mean()), 6), spans))
        return out


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_docs: int = 1500, min_share: float = 0.01, switch: float = 8.0) -> LanguageModel:
    """A model from labelled rows (others are ignored).

    sample_docs bounds the sample: at most about so many documents of each language, by a hash of their text.
    The driver receives BUCKETS counts for each language and one row for each script and language.
    """
    rows = labelled.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModel([], np.zeros((BUCKETS, 0)), {}, switch)
    share = F.coalesce(*(F.when(F.col("lang") == lang, F.lit(min(1.0, sample_docs / n))) for lang, n in sizes.items()))
    sample = rows.where((F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / F.lit(float(1 << 20))) < share)

    @frugal
    def count(batches):
        for batch in batches:
            for part in slices(batch):
                found: dict[str, dict[str, int]] = {}
                for text, lang in zip(texts_of(part), part.column("lang").to_pylist()):
                    seen = found.setdefault(lang, {})
                    for word in LETTERS.findall(text.lower()):
                        seen[word] = seen.get(word, 0) + 1
                for lang, seen in found.items():
                    if seen:
                        times = np.fromiter(seen.values(), np.int64, len(seen))
                        buckets, owners, first = ngrams(list(seen))
                        counts = np.bincount(buckets, weights=times[owners], minlength=BUCKETS).astype(np.int64)
                        names = scripts_of(first)
                        for name in np.unique(names):
                            yield row(lang, str(name), int(times[names == name].sum()), None)
                        yield row(lang, None, 0, counts.tobytes())

    def row(lang: str, script: str | None, n: int, counts: bytes | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"lang": lang, "script": script, "n": n, "counts": counts}], schema=fields)

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(BUCKETS, np.int64)
        for counts in table.column("counts").to_pylist():
            if counts is not None:
                total += np.frombuffer(counts, np.int64)
        own = {"lang": key[0].as_py(), "script": key[1].as_py(), "n": sum(table.column("n").to_pylist()), "counts": total.tobytes() if key[1].as_py() is None else None}
        return pa.Table.from_pylist([own], schema=fields)

    fields = pa.schema([("lang", pa.string()), ("script", pa.string()), ("n", pa.int64()), ("counts", pa.binary())])
    schema = "lang string, script string, n long, counts binary"
    rows_of = sample.mapInArrow(count, schema).groupBy("lang", "script").applyInArrow(add, schema).collect()
    languages = sorted({r["lang"] for r in rows_of if r["script"] is None})
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)), {}, switch)
    counts = {r["lang"]: np.frombuffer(r["counts"], np.int64) for r in rows_of if r["script"] is None}
    by_script: dict[str, dict[str, int]] = {}
    for r in rows_of:
        if r["script"] is not None:
            by_script.setdefault(r["script"], {})[r["lang"]] = r["n"]
    # a share of the language's own words: other languages' samples don't decide where it is known
    totals = {lang: sum(by.get(lang, 0) for by in by_script.values()) for lang in languages}
    scripts = {s: sorted(lang for lang, n in by.items() if n >= min_share * totals[lang]) or sorted(by) for s, by in by_script.items()}
    return LanguageModel(languages, np.stack([counts[lang] for lang in languages], axis=1).astype(float), scripts, switch)


def _sent(model: LanguageModel, spark: SparkSession):
    """A function that gives the model on an executor: BUCKETS numbers for each language, whatever the input."""
    sent = spark.sparkContext.broadcast(model)
    return lambda: sent.value


def identify(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, spans of every row."""
    load = _sent(model, df.sparkSession)

    @frugal
    def predict(batches):
        own = load()
        for batch in batches:
            for part in slices(batch, size=TEXT_BYTES):
                lang, score, spans = zip(*own.predict(texts_of(part)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(spans, pa.string())], names=["doc_id", "lang_pred", "score", "spans"])

    return id_text(df, id_col, text_col).mapInArrow(predict, "doc_id long, lang_pred string, score double, spans string")


def predicted(text: Column, model: LanguageModel, spark: SparkSession) -> Column:
    """lang_pred and score of a text, as a struct; for filters that keep all columns."""
    load = _sent(model, spark)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = load()
        try:
            for texts in batches:
                found = [own.predict(texts.iloc[i : i + 1000].tolist()) for i in range(0, len(texts), 1000)]
                yield pd.DataFrame([(lang, score) for part in found for lang, score, _ in part], columns=["lang_pred", "score"])
        finally:
            release()

    return predict(text)

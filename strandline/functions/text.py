"""Text normalisation and identifiers as column expressions; Python only where Spark has no built-in (squash, shingles)."""

from __future__ import annotations

import ast
import unicodedata
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Unicode white space; plain \s misses the no-break space and its kin.
SPACES = r"(?U)\s+"
#: Sentence types by their raw names (fixed values); other names stay in lower case.
SENTENCE_TYPES = {"title": "title", "article-title": "title", "abstract": "abstract", "paragraph": "p", "p": "p"}
#: Squashed first lines that hold one of these are not titles (fixed values), nor are shorter ones than TITLE_MIN.
TITLE_BOILERPLATE = (
    "anonymousauthor",
    "paperunderdoubleblindreview",
    "underreviewasaconferencepaper",
    "underreviewattheiclr",
    "formattinginstructions",
    "editors",
    "abstract",
    "conferencepaperaticlr",
)
TITLE_MIN = 25
SHINGLE = 20


def col_or(df: DataFrame, name: str, default=None) -> Column:
    """A column that may be absent."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(default)


def is_missing(c: Column) -> Column:
    """Null or not a number."""
    return c.isNull() | F.coalesce(F.isnan(c.try_cast("double")) & (F.lower(F.trim(c.cast("string"))) == "nan"), F.lit(False))


def clean(c: Column) -> Column:
    """White space runs become one blank, ends are trimmed, null becomes empty."""
    return F.coalesce(F.trim(F.regexp_replace(c.cast("string"), SPACES, " ")), F.lit(""))


def stripped(c: Column) -> Column:
    """Without white space at the ends; null becomes empty."""
    return F.coalesce(F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", ""), F.lit(""))


def guarded(c: Column) -> Column:
    """Blank or null text becomes one blank, for encoders that refuse empty input."""
    return F.when(stripped(c) == "", F.lit(" ")).otherwise(c)


def words(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACES), lambda w: w != "")


def word_count(c: Column) -> Column:
    """Number of white-space separated words."""
    return F.size(words(c)).cast("int")


def sanitize(c: Column) -> Column:
    """Trim, lower-case, blanks to underscores, and drop all but letters, digits and _ @ . - :."""
    return F.regexp_replace(F.replace(F.lower(stripped(c)), F.lit(" "), F.lit("_")), r"[^a-zA-Z0-9_@.\-:]+", "")


def sanitized(s: str) -> str:
    """The same of a Python string, for paths."""
    kept = s.strip().lower().replace(" ", "_")
    return "".join(ch for ch in kept if ch.isascii() and (ch.isalnum() or ch in "_@.-:"))


def family_id(dataset: Column, key: Column) -> Column:
    return F.concat_ws(":", sanitize(dataset), sanitize(key))


def doc_id(family: Column, key: Column) -> Column:
    return F.concat_ws(":", sanitize(family), sanitize(key))


def revision_key(n: Column) -> Column:
    return F.concat(F.lit("v"), n.cast("string"))


def model_slug(name: str) -> str:
    return name.replace("/", "__").replace(":", "_").replace("@", "_")


def meta_json(**fields: Column) -> Column:
    """A JSON object that keeps null fields."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())), {"ignoreNullFields": "false"})


def meta_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit("{}"))


@F.pandas_udf(ArrayType(StringType()))
def _literal_list(texts: pd.Series) -> pd.Series:
    """Items of a Python list literal as text, without None; null for anything else."""

    def items(t: str | None) -> list[str] | None:
        try:
            found = ast.literal_eval(t.strip()) if t else None
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return None
        return [str(x) for x in found if x is not None and x == x] if isinstance(found, list) else None

    return texts.map(items)


def listlike(c: Column) -> Column:
    """Cleaned non-empty strings of an array, or of a JSON or Python list literal; else none.

    JSON is parsed by the JVM; Python sees only what is no JSON list.
    """
    text = c.cast("string")
    parsed = F.from_json(text, ArrayType(StringType()))
    other = _literal_list(F.when(parsed.isNull() & F.ltrim(text).startswith("["), text))
    return F.filter(F.transform(F.coalesce(parsed, other, F.array().cast("array<string>")), clean), lambda x: x != "")


def listlike_of(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    if kind.startswith("array"):
        return F.filter(F.transform(F.coalesce(F.col(f"`{name}`"), F.array().cast(kind)), lambda x: clean(x)), lambda x: x != "")
    return listlike(F.col(f"`{name}`"))


def paperhash(content: Column) -> Column:
    """Field `paperhash` of a JSON object, cleaned; empty if there is none."""
    return clean(F.get_json_object(content.cast("string"), "$.paperhash"))


def sentence_type(c: Column) -> Column:
    """Canonical sentence type."""
    key = F.lower(clean(c))
    return F.coalesce(reduce(lambda w, kv: w.when(key == kv[0], kv[1]), list(SENTENCE_TYPES.items())[1:], F.when(key == "title", "title")), key)


def short_hash(c: Column, length: int = 16) -> Column:
    """First characters of the MD5 in hexadecimal."""
    return F.substring(F.md5(c), 1, length)


def number_or_last(c: Column) -> Column:
    """A number, or 10^15, which sorts last, where there is none."""
    return F.coalesce(c.try_cast("double"), F.lit(1e15))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / F.nullif(b, F.lit(0)).cast("double"))


def language_of(work: Column) -> Column:
    """Two-letter suffix of a work's id, else `unknown`."""
    code = F.regexp_extract(work, r"_([a-z]{2})$", 1)
    return F.when(code == "", F.lit("unknown")).otherwise(code)


#: Names of languages by code (fixed values).
LANGUAGE_NAMES = {
    "cs": "Czech", "de": "German", "es": "Spanish", "fa": "Persian", "fr": "French", "hu": "Hungarian", "it": "Italian", "ja": "Japanese",
    "nl": "Dutch", "no": "Norwegian", "pl": "Polish", "pt": "Portuguese", "ru": "Russian", "sv": "Swedish", "ta": "Tamil", "zh": "Chinese",
}


def language_name(code: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv))
    return F.coalesce(F.try_element_at(names, code), code)


def paragraphs_joined(paras: Column) -> Column:
    """Trimmed non-empty paragraphs, one to a line."""
    return F.array_join(F.filter(F.transform(paras, stripped), lambda p: p != ""), "\n")


def record_text(title: Column, abstract: Column, body: Column) -> Column:
    """Title, abstract under its header, and body, with blank lines between the parts that there are."""
    empty = F.array().cast("array<string>")
    parts = F.concat(F.when(title != "", F.array(title, F.lit(""))).otherwise(empty), F.when(abstract != "", F.array(F.lit("Abstract"), abstract, F.lit(""))).otherwise(empty), F.when(body != "", F.array(body)).otherwise(empty))
    return stripped(F.array_join(parts, "\n"))


def tokens(c: Column) -> Column:
    """Runs of a-z and 0-9 after lower-casing (P25)."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([a-z0-9]+)"), 1)


def ngrams(toks: Column, n: int) -> Column:
    """Consecutive n tokens joined by blanks; none if there are fewer."""
    empty = F.array().cast("array<string>")
    return F.when(F.size(toks) >= n, F.transform(F.sequence(F.lit(1), F.size(toks) - (n - 1)), lambda i: F.array_join(F.slice(toks, i, n), " "))).otherwise(empty)


def windows(toks: Column, limit: int) -> Column:
    """Token windows: the whole list if it fits, else the inner tokens in pieces of limit - 2, the last one shorter."""
    inner, step = F.slice(toks, 2, F.greatest(F.size(toks) - 2, F.lit(0))), limit - 2
    pieces = F.transform(F.sequence(F.lit(0), F.ceil(F.size(inner) / F.lit(step)).cast("int") - 1), lambda i: F.slice(inner, i * step + 1, F.lit(step)))
    return F.when(F.size(toks) <= limit, F.array(toks)).otherwise(pieces)


def squash_bytes(s: str | None) -> bytes:
    """Compatibility decomposition, ASCII letters and digits only, in lower case."""
    return unicodedata.normalize("NFKD", s or "").encode("ascii", "ignore").translate(_LOWER, _NOT_ALNUM)


def squash_text(s: str | None) -> str:
    return squash_bytes(s).decode()


_LOWER = bytes(range(256)).lower()
_NOT_ALNUM = bytes(b for b in range(256) if not chr(b).isalnum() or b > 0x7F)


@F.pandas_udf(StringType())
def squash(texts: pd.Series) -> pd.Series:
    """squash_text (P17); Spark has no Unicode normalisation of its own."""
    return texts.map(squash_text)


def shingle_codes(s: str, k: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit codes of the k-character slices of a squashed text; a shorter one is a slice by itself."""
    raw = np.frombuffer(s.encode("ascii"), np.uint8).astype(np.uint64)
    if not len(raw):
        return np.zeros(0, np.int64)
    n = max(1, len(raw) - k + 1)
    h = np.full(n, np.uint64(min(k, len(raw))))
    for j in range(min(k, len(raw))):
        h = h * np.uint64(0x100000001B3) + raw[j : j + n]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.unique(h ^ (h >> np.uint64(29))).view(np.int64)


def _polynomials(raw: np.ndarray, k: int) -> np.ndarray:
    """The polynomial of shingle_codes over each k values in a row, from those over half as many."""
    base, power, size, out, have = 0x100000001B3, raw, 1, None, 0

    def joined(first: np.ndarray, n: int, second: np.ndarray) -> np.ndarray:
        """Of n values each after those of first; one new array only, as large ones are slow to come by."""
        made = np.multiply(first[: len(second)], np.uint64(pow(base, n, 1 << 64)))
        return np.add(made, second, out=made)

    while size <= k:
        if k & size:
            out = power if out is None else joined(power[: len(raw) - size - have + 1], have, out[size:])
            have += size
        if 2 * size <= k:
            power = joined(power[:-size], size, power[size:])
        size *= 2
    return out + np.uint64(k * pow(base, k, 1 << 64) % (1 << 64))


def shingle_places(texts: list[str | None], k: int = SHINGLE, ranges: int = 1, i: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all shingles of some texts, repeated ones too, and the number of the text that each stands in.

    Of `ranges` parts that shingles fall into by their content, part i only.
    """
    return squashed_places([squash_bytes(t) for t in texts], k, ranges, i)


def squashed_places(squashed: list[bytes], k: int = SHINGLE, ranges: int = 1, i: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """shingle_places of texts that are squashed already."""
    lengths = np.array([len(s) for s in squashed], np.int64)
    low, high = (np.uint64((j << 64) // ranges - (j > i)) for j in (i, i + 1))
    within = lambda h: h - low <= high - low
    short = np.flatnonzero((lengths > 0) & (lengths < k))
    codes = np.concatenate([np.zeros(0, np.uint64), *(shingle_codes(squashed[j].decode(), k).view(np.uint64) for j in short)])
    own = within(codes)
    codes, owners = codes[own], short[own]
    raw = np.frombuffer(b"".join(squashed), np.uint8).astype(np.uint64)
    if len(raw) < k:
        return codes, owners
    ends = np.cumsum(lengths)
    h = _polynomials(raw, k)
    at = np.flatnonzero(within(h))
    owner = np.repeat(np.arange(len(ends)), np.diff(np.searchsorted(at, ends), prepend=0))
    inside = at + k <= ends[owner]
    h, owner = h[at[inside]], owner[inside]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.concatenate([codes, h ^ (h >> np.uint64(29))]), np.concatenate([owners, owner])


def shingles(k: int = SHINGLE):
    """Column function from text to array<long>: the codes of its squashed text's shingles."""

    @F.pandas_udf("array<long>")
    def codes(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: shingle_codes(squash_text(t), k))

    return codes


def title_key(text: Column) -> Column:
    """Squashed first non-blank line; null if it is short or boilerplate (P20).  Later lines are not tried."""
    line = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?U)\S[^\n]*", 0)  # what stands before isn't squashed into the key
    key = squash(line)
    bad = reduce(lambda a, b: a | b, (key.contains(x) for x in TITLE_BOILERPLATE))
    return F.when((F.length(key) >= TITLE_MIN) & ~bad, key)

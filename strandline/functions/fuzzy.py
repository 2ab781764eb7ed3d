"""Context-triggered piecewise hashes ("fuzzy hashes") and their comparison, from the published scheme (Kornblum 2006).

A rolling hash over the last 7 bytes cuts the input where it is -1 modulo the block size; each piece gives one
of 64 characters from the low six bits of an FNV hash.  A signature is `blocksize:pieces:pieces at twice the size`.
Signatures compare only at equal or doubled block sizes, and only if they share 7 characters in a row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

#: Parameters of the scheme (fixed values).
WINDOW, LEAST_BLOCK, LENGTH = 7, 3, 64
FNV_START, FNV_PRIME = 0x28021967, 0x01000193
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

# The low six bits of the FNV hash depend on themselves and the next byte only.
_NEXT = [[(s * FNV_PRIME ^ b) & 63 for b in range(256)] for s in range(64)]


def rolling(data: bytes) -> np.ndarray:
    """The rolling hash after each byte."""
    n = len(data)
    c = np.zeros(n + WINDOW, np.uint64)
    c[WINDOW:] = np.frombuffer(data, np.uint8)
    plain, weighted, shifted = (np.zeros(n, np.uint64) for _ in range(3))
    for age in range(WINDOW):  # age 0 is the newest byte
        own = c[WINDOW - age : WINDOW - age + n]
        plain += own
        weighted += own * np.uint64(WINDOW - age)
        shifted ^= own << np.uint64(5 * age)
    return (plain + weighted + (shifted & np.uint64(0xFFFFFFFF))) & np.uint64(0xFFFFFFFF)


def _pieces(data: bytes, ends: np.ndarray, limit: int) -> str:
    """One character for each piece, the rest of the data in the last one."""
    cuts = ends[: limit - 1].tolist()
    out, start = [], 0
    for cut in [*cuts, None]:
        state = FNV_START & 63
        for b in data[start:] if cut is None else data[start : cut + 1]:
            state = _NEXT[state][b]
        if cut is not None:
            out.append(ALPHABET[state])
            start = cut + 1
    return "".join(out), start, state


def fuzzy_hash(text: str | bytes | None) -> str | None:
    """Signature of a text; None if it is empty."""
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    if not data:
        return None
    h = rolling(data)
    block = LEAST_BLOCK
    while block * LENGTH < len(data):
        block *= 2
    while True:
        ends = np.flatnonzero(h % np.uint64(block) == block - 1)
        if block > LEAST_BLOCK and min(len(ends), LENGTH - 1) < LENGTH // 2:
            block //= 2
            continue
        break
    signature = []
    for size, limit in ((block, LENGTH), (block * 2, LENGTH // 2)):
        ends = np.flatnonzero(h % np.uint64(size) == size - 1)
        chars, start, state = _pieces(data, ends, limit)
        if h[-1] != 0:
            chars += ALPHABET[state]
        signature.append(chars)
    return f"{block}:{signature[0]}:{signature[1]}"


def _short_runs(s: str) -> str:
    """At most three equal characters in a row."""
    return "".join(ch for i, ch in enumerate(s) if s[max(0, i - 3) : i] != ch * 3)


def _weighted_distance(a: str, b: str) -> int:
    """Edit distance where a replacement costs 2: what is left besides a longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            keep = row[j]
            row[j] = before + 1 if x == y else max(row[j], row[j - 1])
            before = keep
    return len(a) + len(b) - 2 * row[-1]


def _score(a: str, b: str, block: int) -> int:
    grams = {a[i : i + WINDOW] for i in range(len(a) - WINDOW + 1)}
    if not any(b[i : i + WINDOW] in grams for i in range(len(b) - WINDOW + 1)):
        return 0
    score = _weighted_distance(a, b) * LENGTH // (len(a) + len(b))
    score = 100 - 100 * score // LENGTH
    # a match of short signatures at a small block size says less
    return min(score, block // LEAST_BLOCK * min(len(a), len(b))) if block < (99 + WINDOW) // WINDOW * LEAST_BLOCK else score


def fuzzy_compare(a: str | None, b: str | None) -> int:
    """Similarity of two signatures, 0 to 100."""
    if not a or not b:
        return 0
    (m, a1, a2), (n, b1, b2) = ((int(p[0]), _short_runs(p[1]), _short_runs(p[2])) for p in (a.split(":"), b.split(":")))
    if m == n:
        return 100 if a1 == b1 and a2 == b2 else max(_score(a1, b1, m), _score(a2, b2, 2 * m))
    if m == 2 * n:
        return _score(a1, b2, m)
    return _score(a2, b1, n) if n == 2 * m else 0


@F.pandas_udf(StringType())
def signature(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: fuzzy_hash(t) if t else None)


@F.pandas_udf(IntegerType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([fuzzy_compare(x, y) for x, y in zip(a, b)], dtype="int32")


@F.pandas_udf(ArrayType(StringType()))
def comparable_keys(signatures: pd.Series) -> pd.Series:
    """Block size and each 7 characters in a row of a signature: two signatures score above 0 only if they share one."""

    def keys(s: str | None) -> list[str]:
        if not s:
            return []
        size, one, two = s.split(":")
        out = {f"{n}:{p[i : i + WINDOW]}" for n, p in ((int(size), _short_runs(one)), (2 * int(size), _short_runs(two))) for i in range(len(p) - WINDOW + 1)}
        # equal short signatures score 100 without such a run
        return sorted(out | {f"={size}:{_short_runs(one)}:{_short_runs(two)}"})

    return signatures.map(keys)

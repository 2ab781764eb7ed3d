"""Operator 4: secrets, with multipart credential linking.

Base kinds (assign, access, hex) are found by themselves.  Parts of credentials are collected besides:
identifiers (access identifiers, `user = x`), secrets (assignments, long tokens) and endpoints (URLs with a
host, `host = x`); the names may have a prefix and a suffix (`DB_HOST = x`).  An interval join by sorted starts links parts whose spans lie within one scope (a
paragraph, and no further apart than `reach` code points).  A weak candidate, one that alone is too vague to
report, becomes a span only when a part of a complementary kind is linked to it.

Spans are code points, end exclusive: kind:start:end.  Order: by start, then kind as listed in KINDS.

Every expression reads a run of characters once, so the time is linear in the text, whatever its length or its
characters: runs are taken possessively, a URL is read from its sign outwards, and the assignments' blanks cannot
stretch over one another.

Defined results: null text counts as empty; empty text has no spans; of spans with one start and kind the shorter
comes first; repeated rows give repeated rows; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import frugal, id_text, slices, texts_of

#: Kinds in the order in which spans with one start are listed; the first three are base kinds (fixed values).
KINDS = ("assign", "access", "hex", "pem", "token", "weak_user", "weak_secret", "weak_endpoint", "weak_token")
RANK = {k: i for i, k in enumerate(KINDS)}
#: The base kinds' expressions and lengths (fixed values).  re.ASCII keeps either-case letters to A-Z and a-z.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of 16 or more is what [0-9a-f]+ gives, less the shorter runs
ASSIGN_MIN, ACCESS_MIN = 12, 18
ASSIGN_KEYS = ("passw", "secret", "token", "api")
#: Further strong kinds: private key blocks, and tokens that carry their issuer's prefix.
PEM = re.compile(r"-----(BEGIN|END) ((?:[A-Z]+ )*PRIVATE KEY(?: BLOCK)?)-----")
#: Lines of a key whose END line is missing: headers and base64, the last line of any length.
PEM_BODY = re.compile(r"""(?:(?:\s|\\[nr])*+(?:(?:Proc-Type|DEK-Info)[^\n]*+|[A-Za-z0-9+/]{16,}+={0,2}(?=[\x20\t]*(?:[\r\n\\"'`,<]|\Z))))*+(?:(?:[\r\n]|\\[nr])++[A-Za-z0-9+/]++={0,2}(?=[\x20\t]*(?:[\r\n\\"'`,<]|\Z)))?""")
TOKEN = re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk_live_[A-Za-z0-9]{16,}+)")
TOKEN_KEYS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk_live_")
#: Three-part tokens, read from their dots: parts of maximal runs of the alphabet and dots.
JWT_RUN, JWT_LEAST = re.compile(r"[A-Za-z0-9_.-]++"), 10
#: Weak candidates.  A key word may be part of a longer name (DB_HOST, aws_secret_access_key, privateKey), at a sign or a change of case.
_FROM = r"(?:(?<![A-Za-z0-9])|(?-i:(?<=[a-z0-9])(?=[A-Z])))"
_ON = r"""(?:[_.-][A-Za-z0-9_.-]{0,64}|[0-9][A-Za-z0-9_.-]{0,64}|(?-i:(?<=[a-z])[A-Z][A-Za-z0-9_.-]{0,64}))?["']?\x20*[:=]\x20*["']?"""
WEAK_USER = re.compile(_FROM + r"(?:user(?:name)?|login|client_id|account)" + _ON + r"([A-Za-z0-9._@-]{3,})", re.IGNORECASE | re.ASCII)
WEAK_SECRET = re.compile(_FROM + r"(?:key|pass(?:w(?:or)?d|phrase)?|pwd|auth|credential|secret|token)(?![_.-]?id\b)" + _ON + r"([A-Za-z0-9+/_.=-]{8,})", re.IGNORECASE | re.ASCII)
WEAK_ENDPOINT = re.compile(_FROM + r"(?:host|endpoint|server|region)" + _ON + r"""([A-Za-z0-9.:/_-]{4,})""", re.IGNORECASE | re.ASCII)
#: URLs: the sign is looked for first, then the scheme before it, then the rest after it.
URL_REST, SCHEME = re.compile(r"""[^\s"'<>]+"""), re.compile(r"[A-Za-z][A-Za-z0-9+.-]*\Z")
SCHEME_MOST = 64
#: A long token that stands free; it must also be mixed() to count.
WEAK_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])")
TOKEN_BITS = 3.7
WEAK_KEYS = ("user", "login", "client_id", "account", "key", "pass", "pwd", "auth", "credential", "host", "endpoint", "server", "region", "secret", "token")
#: Which part of a credential a kind is.  A bare run of hexadecimal digits is none: git hashes and digests are such.
PART = {"assign": "secret", "access": "id", "hex": None, "pem": "secret", "token": "secret", "weak_user": "id", "weak_secret": "secret", "weak_endpoint": "endpoint", "weak_token": "secret"}
#: Parts that make a weak one of the key's part worth a report.
COMPLEMENT = {"id": ("secret",), "secret": ("id", "endpoint"), "endpoint": ("secret",)}

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base kind that pass its length."""
    out: list[Span] = []
    low = text.lower()
    if any(k in low for k in ASSIGN_KEYS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], RANK[s[2]]))


def mixed(token: str) -> bool:
    """Whether a token has digits, small and capital letters, and the entropy of a random one."""
    n, seen = len(token), Counter(token)
    kinds = [sum(c for ch, c in seen.items() if test(ch)) for test in (str.isdigit, str.islower, str.isupper)]
    if kinds[0] < 1 or kinds[1] < 2 or kinds[2] < 2:
        return False
    return -sum(c / n * math.log2(c / n) for c in seen.values()) >= TOKEN_BITS


def pem_spans(text: str) -> list[Span]:
    """Private key blocks: from BEGIN to the END line, or to the end of the base64 lines where the next line of dashes is another."""
    marks = list(PEM.finditer(text))
    out: list[Span] = []
    for m, after in zip(marks, [*marks[1:], None]):
        if m[1] == "BEGIN":
            closed = after is not None and after[1] == "END" and after[2] == m[2]
            out.append((m.start(), after.end() if closed else PEM_BODY.match(text, m.end()).end(), "pem"))
    return out


def jwt_spans(text: str) -> list[Span]:
    """Three parts of JWT_LEAST characters or more, joined by dots, the first from an eyJ at a word's start on; leftmost, without overlap."""
    out: list[Span] = []
    for m in JWT_RUN.finditer(text):
        if "eyJ" not in m[0]:
            continue
        at, starts = m.start(), []
        for part in m[0].split("."):
            starts.append((at, part))
            at += len(part) + 1
        i = 0
        while i + 2 < len(starts):
            (at, part), after = starts[i], starts[i + 1 : i + 3]
            k = part.find("eyJ")
            while k > 0 and (part[k - 1].isalnum() or part[k - 1] == "_"):
                k = part.find("eyJ", k + 1)
            if k >= 0 and len(part) - k >= 3 + JWT_LEAST and all(len(p) >= JWT_LEAST for _, p in after):
                out.append((at + k, after[1][0] + len(after[1][1]), "token"))
                i += 3
            else:
                i += 1
    return out


def url_spans(text: str) -> list[Span]:
    """URLs: at each :// the scheme's letters before it (64 at most) and what follows up to a blank or a quote."""
    out: list[Span] = []
    at = text.find("://")
    while at >= 0:
        rest = URL_REST.match(text, at + 3)
        end = at + 3
        if rest:
            before = text[max(0, at - SCHEME_MOST) : at]
            own = SCHEME.search(before, max((i + 1 for i, ch in enumerate(before) if not (ch.isascii() and (ch.isalnum() or ch in "+.-"))), default=0))
            if own:
                out.append((at - len(own[0]), rest.end(), "weak_endpoint"))
                end = rest.end()
        at = text.find("://", end)
    return out


def _merged(spans: list[Span]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e, _ in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def linked(text: str, strong: list[Span], weak: list[Span], reach: int) -> list[Span]:
    """Weak candidates that a complementary part joins within their paragraph and `reach`.

    The join goes by sorted starts: for each weak candidate a binary search finds the nearest parts of each
    complementary kind before and after it, so its work is n log n whatever the number of parts.
    """
    breaks = [m.start() for m in re.finditer(r"\n\s*\n", text)]
    # a weak candidate within a strong span says nothing new
    covered = _merged(strong)
    begins = [s for s, _ in covered]

    def inside(span: Span) -> bool:
        i = bisect_right(begins, span[0])
        return bool(i) and covered[i - 1][1] >= span[1]

    weak = [w for w in weak if not inside(w)]
    parts: dict[str, list[tuple[int, int]]] = {"id": [], "secret": [], "endpoint": []}
    for s, e, kind in strong + weak:
        if PART[kind]:
            parts[PART[kind]].append((s, e))
    tops: dict[str, tuple[list[int], list[int]]] = {}
    for name, spans in parts.items():
        spans.sort()
        ends, top = [], 0
        for _, e in spans:
            ends.append(top := max(top, e))
        tops[name] = ([s for s, _ in spans], ends)

    def near(span: Span, name: str) -> bool:
        starts, ends = tops[name]
        i = bisect_left(starts, span[0])
        scope = bisect_right(breaks, span[0])
        if i and span[0] - ends[i - 1] <= reach and bisect_left(breaks, ends[i - 1]) >= scope:
            return True
        return i < len(starts) and starts[i] - span[1] <= reach and bisect_right(breaks, starts[i]) == scope

    return [w for w in weak if any(near(w, name) for name in COMPLEMENT[PART[w[2]]])]


def secret_spans(text: str | None, reach: int = 200) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans (base ones included)."""
    text = text or ""
    base = base_spans(text)
    strong = list(base)
    if "PRIVATE KEY" in text:
        strong += pem_spans(text)
    if any(k in text for k in TOKEN_KEYS):
        strong += [(m.start(), m.end(), "token") for m in TOKEN.finditer(text)]
    if "eyJ" in text:
        strong += jwt_spans(text)
    weak: list[Span] = []
    if "=" in text or ":" in text:
        low = text.lower()
        if any(k in low for k in WEAK_KEYS):
            for kind, pattern in (("weak_user", WEAK_USER), ("weak_secret", WEAK_SECRET), ("weak_endpoint", WEAK_ENDPOINT)):
                weak += [(m.start(), m.end(), kind) for m in pattern.finditer(text)]
    if "://" in text:
        weak += url_spans(text)
    if any(PART[k] in ("id", "endpoint") for _, _, k in strong + weak):
        # a token within a name's value or a URL is no token of its own
        covered = _merged(weak)
        begins = [s for s, _ in covered]
        for m in WEAK_TOKEN.finditer(text):
            i = bisect_right(begins, m.start())
            if not (i and covered[i - 1][1] > m.start()) and mixed(m[0]):
                weak.append((m.start(), m.end(), "weak_token"))
    if weak:
        strong += linked(text, strong, weak, reach)
    return base, sorted(set(strong), key=lambda s: (s[0], RANK[s[2]], s[1]))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def secret_scan(df: DataFrame, reach: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts of the base kinds, base_spans and spans as kind:start:end, comma-joined."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_spans", pa.string()), ("spans", pa.string())])

    @frugal
    def scan(batches):
        for batch in batches:
            for part in slices(batch):
                rows = []
                for i, text in zip(part.column("doc_id").to_pylist(), texts_of(part)):
                    base, spans = secret_spans(text, reach)
                    kinds = [k for _, _, k in base]
                    rows.append({"doc_id": i, "n_assign": kinds.count("assign"), "n_access": kinds.count("access"), "n_hex": kinds.count("hex"), "base_spans": listed(base), "spans": listed(spans)})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return id_text(df, id_col, text_col).mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string")


def redacted(text: str | None, mark: str = "[SECRET]", reach: int = 200) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by a mark; null stays null."""
    if not text:
        return text
    spans = _merged(secret_spans(text, reach)[1])
    if not spans:
        return text
    out, at = [], 0
    for s, e in spans:
        out += [text[at:s], mark]
        at = e
    return "".join(out) + text[at:]


def redact_secrets(df: DataFrame, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """The same table with every secret in text_col replaced by a mark.  Other columns stay as they are."""

    @F.pandas_udf("string")
    def replace(texts):
        return texts.map(lambda t: redacted(t, mark))

    return df.withColumn(text_col, replace(F.col(f"`{text_col}`").cast("string")))

"""Operator 2: words of passages that an earlier document holds, by a relative Lempel-Ziv parse.

Words are runs of bytes other than ASCII white space.  The reference is every document with a smaller doc_id,
cut into blocks of documents.  Each block indexes its windows of 13 consecutive words by a 96-bit hash.  Where the
blocks' indexes meet, each window gets two addresses (document, position): its earliest one, and the one from which
the repeated text runs on the longest, over all blocks.  A document is then parsed greedily: at a position whose window
an earlier document holds, the factor is the longer of the two runs of words that the addresses of the windows from
there on spell out in one reference document (13 words or more); the parse jumps by its length.  Windows across a
factor's boundary are looked up by themselves, so that no repeated window is lost between two factors.  The words of
all factors and of the repeated windows across their boundaries are removed: which words go depends on the earliest
addresses only.  A factor is the longest match where one of its window's two addresses begins it.

How the work is dealt: documents go to blocks of about BLOCK_BYTES of text by a hash of doc_id (one shuffle of the text,
used three times).  A block sends one packed row to each bucket of hashes; it names each distinct window once, so a
passage that a third of all documents hold costs a bucket one entry per block.  It first sends 32 bits of each window,
and the bucket answers with one bit: whether another block has them too.  Only for windows with that bit do hashes and
addresses follow, and only where another block has a better address does an answer come back.  Buckets hold the windows of
about BUCKET_BYTES of text.

Defined results: null text counts as empty: 0 words, kept_sha256 of the empty string; a document with fewer than
13 words has no window; rows with the same doc_id count as one document, so that they remove nothing from one
another, and each gives a row; rows with a null doc_id are no reference, go to no block and stay whole; a long text is
parsed whole, in one block; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import bytes_of, frugal, id_text, slices
from strandline.llm.shingles import mixed
from strandline.storage import parallelism

WINDOW = 13
#: Text of a block, and text whose windows a bucket holds.
BLOCK_BYTES, BUCKET_BYTES = 6 << 20, 48 << 20
_FAR = np.iinfo(np.int64).max


def window_hashes(words: list[bytes], width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes, of 64 and of 32 bits, of each window of consecutive words."""
    from xxhash import xxh3_64_intdigest

    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    g = mixed(h ^ np.uint64(0x5851F42D4C957F2D))
    a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for j in range(width):
        a = a * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
        b = b * np.uint64(0xD1342543DE82EF95) + g[j : j + n]
    return mixed(a), (mixed(b) >> np.uint64(32)).astype(np.uint32)


class Block:
    """Windows of a block's documents, which come in order of doc_id."""

    def __init__(self, ids: list[int | None], texts: list[bytes | None], width: int):
        order = sorted((i for i in range(len(ids)) if ids[i] is not None), key=lambda i: ids[i])
        self.ids, self.width = ids, width
        self.words = [(t or b"").split() for t in texts]
        own = {i: window_hashes(self.words[i], width) for i in order}
        self.at = {}
        start = 0
        for i in order:
            self.at[i] = (start, start + len(own[i][0]))
            start += len(own[i][0])
        self.h1 = np.concatenate([own[i][0] for i in order]) if order else np.zeros(0, np.uint64)
        self.h2 = np.concatenate([own[i][1] for i in order]) if order else np.zeros(0, np.uint32)
        self.doc = np.concatenate([np.full(len(own[i][0]), ids[i], np.int64) for i in order]) if order else np.zeros(0, np.int64)
        self.pos = np.concatenate([np.arange(len(own[i][0]), dtype=np.uint32) for i in order]) if order else np.zeros(0, np.uint32)

        order = np.lexsort((self.h2, self.h1))  # stable: documents and positions stay in order
        a, b = self.h1[order], self.h2[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        #: Index of the first occurrence of each distinct window, by hash, and the number of each window's group.
        self.firsts = order[new]
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1

    def best(self, elsewhere: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each distinct window the occurrence from which repeated windows run on the longest, and how many do.

        elsewhere: which distinct windows other blocks may hold too.
        """
        n = len(self.h1)
        repeated = (elsewhere | (np.bincount(self.group, minlength=len(self.firsts)) > 1))[self.group]
        ends = np.empty(n, np.int64)
        for start, end in self.at.values():
            ends[start:end] = end
        stop = np.where(repeated, n, np.arange(n))
        onward = np.minimum(np.minimum.accumulate(stop[::-1])[::-1], ends) - np.arange(n) if n else np.zeros(0, np.int64)
        # only a window with several occurrences has a choice
        some = np.flatnonzero((np.bincount(self.group, minlength=len(self.firsts)) > 1)[self.group])
        order = some[np.lexsort((some, -onward[some], self.group[some]))]
        lead = np.ones(len(order), bool)
        lead[1:] = self.group[order][1:] != self.group[order][:-1]
        best = self.firsts.copy()
        best[self.group[order[lead]]] = order[lead]
        return best, onward[best].astype(np.uint32)


def _by_bucket(block: Block, n_buckets: int):
    """(bucket, numbers, 32-bit prints) of the block's distinct windows; a bucket is a range of first hashes."""
    h1 = block.h1[block.firsts]
    bounds = np.searchsorted(h1, (np.arange(1, n_buckets, dtype=np.float64) * (2.0**64 / n_buckets)).astype(np.uint64)) if n_buckets > 1 else []
    cuts = np.concatenate(([0], bounds, [len(h1)])).astype(np.int64)
    for k in np.flatnonzero(np.diff(cuts)):
        yield int(k), np.arange(cuts[k], cuts[k + 1]), (h1[cuts[k] : cuts[k + 1]] & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is among the sorted known ones."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def _packed(values: np.ndarray) -> bytes:
    """Differences of consecutive values, compressed; the number of bytes stands first."""
    raw = np.diff(values, prepend=values.dtype.type(0)).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(raw: bytes, dtype: type) -> np.ndarray:
    return np.cumsum(np.frombuffer(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True), dtype), dtype=dtype)


#: Columns of packed windows: hashes, earliest address, and best address with the windows that run on from there.
_ADDRESSES = {"doc": np.int64, "pos": np.uint32, "best_doc": np.int64, "best_pos": np.uint32, "run": np.uint32}


def _windows(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Hashes and addresses of all rows of packed windows."""
    hashes = [np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("h1", np.uint64), ("h2", np.uint32))]
    addresses = [np.concatenate([np.zeros(0, t), *(_unpacked(x, t) for x in table.column(c).to_pylist())]) for c, t in _ADDRESSES.items()]
    return *hashes, *addresses


def _table(columns: dict[str, list], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def chosen(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, pos: np.ndarray, best_doc: np.ndarray, best_pos: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each entry the earliest address among the entries with its hashes, and the one that runs on the longest (of equals the earliest)."""
    order = np.lexsort((pos, doc, h2, h1))
    a, b = h1[order], h2[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    first = order[new]
    order = np.lexsort((best_pos, best_doc, -run.astype(np.int64), group))
    lead = np.ones(len(order), bool)
    lead[1:] = group[order][1:] != group[order][:-1]
    best = order[lead]
    return doc[first][group], pos[first][group], best_doc[best][group], best_pos[best][group], run[best][group]


def _runs(doc: np.ndarray, pos: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window the line that its address lies on (document, position less window number), and where its run along the line ends."""
    n = len(doc)
    line = pos.astype(np.int64) - np.arange(n)
    new = np.ones(n, bool)
    new[1:] = (doc[1:] != doc[:-1]) | (line[1:] != line[:-1]) | ~valid[1:] | ~valid[:-1]
    ends = np.append(np.flatnonzero(new)[1:], n)
    return line, ends[np.cumsum(new) - 1]


def parsed(doc_id: int, doc: np.ndarray, pos: np.ndarray, best_doc: np.ndarray, best_pos: np.ndarray, n_words: int, width: int) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """Removed words (a mask) and the factors (start, words, reference document, reference position) of the greedy parse."""
    known = doc < doc_id
    at = np.flatnonzero(known)
    if not len(at):
        return np.zeros(n_words, bool), []
    edges = np.zeros(n_words + 1, np.int64)
    edges[at] += 1
    edges[at + width] -= 1  # windows have different starts, so no index repeats
    choices = []
    for d, p, valid in ((doc, pos, known), (best_doc, best_pos, best_doc < doc_id)):
        choices.append((d, p, valid, *_runs(d, p, valid)))

    def reach(own: int, i: int) -> int:
        """Where the run of words along a choice's line ends, on whichever choice's addresses it goes on."""
        d, line = int(choices[own][0][i]), int(choices[own][3][i])
        end, side = int(choices[own][4][i]), 1 - own
        while end < len(doc):
            other = choices[side]
            if not (other[2][end] and other[0][end] == d and other[3][end] == line):
                break
            end, side = int(other[4][end]), 1 - side
        return end

    factors, i = [], 0
    while True:
        k = int(np.searchsorted(at, i))
        if k == len(at):
            break
        i = int(at[k])
        end, own = max(((reach(c, i), -c) for c in (0, 1) if choices[c][2][i]))
        d, p = choices[-own][0][i], choices[-own][1][i]
        factors.append((i, end - i + width - 1, int(d), int(p)))
        i += factors[-1][1]
    return np.cumsum(edges[:-1]) > 0, factors


def substring_dedup(df: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None, buckets: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, n_factors, kept (bytes of the words that stay, joined by one blank) of every row.

    blocks, buckets: into how many parts documents and hashes are dealt; by the bytes of text, and no fewer than the shuffle partitions, by default.
    """
    spark = df.sparkSession
    n = parallelism(spark)
    every = id_text(df, id_col, text_col)
    size = every.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks, n_buckets = blocks or max(n, -(-size // BLOCK_BYTES)), buckets or max(n, -(-size // BUCKET_BYTES))
    rows = every.where("doc_id is not null")
    docs = rows.select("doc_id", F.col("text").cast("binary").alias("text"), F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)).cast("int").alias("block")).repartition(max(n, n_blocks), "block")

    offered = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("prints", pa.binary())])
    shared = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary())])
    packed = [(c, pa.binary()) for c in ("h1", "h2", *_ADDRESSES)]
    asked = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), *packed])
    told = pa.schema([("block", pa.int32()), *packed])
    columns = ", ".join(f"{c} binary" for c, _ in packed)

    def opened(group: pa.Table) -> Block:
        return Block(group.column("doc_id").to_pylist(), group.column("text").to_pylist(), width)

    def offer(key: tuple, group: pa.Table) -> pa.Table:
        out = {name: [] for name in offered.names}
        for k, _, prints in _by_bucket(opened(group), n_buckets):
            for name, value in zip(offered.names, (k, key[0].as_py(), _packed(np.unique(prints)))):
                out[name].append(value)
        return _table(out, offered)

    def meet(key: tuple, group: pa.Table) -> pa.Table:
        own = [_unpacked(x, np.uint32) for x in group.column("prints").to_pylist()]
        found, n = np.unique(np.concatenate(own), return_counts=True)
        twice = found[n > 1]
        out = {name: [] for name in shared.names}
        for block, prints in zip(group.column("block").to_pylist(), own):
            bits = _within(prints, twice)
            if bits.any():
                for name, value in zip(shared.names, (block, key[0].as_py(), np.packbits(bits).tobytes())):
                    out[name].append(value)
        return _table(out, shared)

    def ask(key: tuple, group: pa.Table, bits: pa.Table) -> pa.Table:
        out = {name: [] for name in asked.names}
        if group.num_rows and bits.num_rows:
            block = opened(group)
            known = dict(zip(bits.column("bucket").to_pylist(), bits.column("bits").to_pylist()))
            number = group.column("block")[0].as_py()
            elsewhere, sent = np.zeros(len(block.firsts), bool), []
            for k, some, prints in _by_bucket(block, n_buckets):
                if k in known:
                    own = np.unique(prints)
                    own = own[np.unpackbits(np.frombuffer(known[k], np.uint8), count=len(own)).astype(bool)]
                    some = some[_within(prints, own)]
                    elsewhere[some] = True
                    sent.append((k, some))
            best, run = block.best(elsewhere)
            for k, some in sent:
                some = some[np.argsort(block.firsts[some])]  # in order of address, which packs well
                first, lead = block.firsts[some], best[some]
                addresses = (block.doc[first], block.pos[first], block.doc[lead], block.pos[lead], run[some])
                for name, value in zip(asked.names, (k, number, block.h1[first].tobytes(), block.h2[first].tobytes(), *map(_packed, addresses))):
                    out[name].append(value)
        return _table(out, asked)

    def answer(group: pa.Table) -> pa.Table:
        h1, h2, *own = _windows(group)
        found = chosen(h1, h2, *own)
        better = np.logical_or.reduce([x != y for x, y in zip(found[:4], own)])
        ends = np.cumsum([len(x) // 8 for x in group.column("h1").to_pylist()])
        out = {name: [] for name in told.names}
        for block, start, end in zip(group.column("block").to_pylist(), [0, *ends[:-1]], ends):
            other = start + np.flatnonzero(better[start:end])
            if len(other):
                for name, value in zip(told.names, (block, h1[other].tobytes(), h2[other].tobytes(), *(_packed(x[other]) for x in found))):
                    out[name].append(value)
        return _table(out, told)

    def remove(docs_of: pa.Table, answers: pa.Table) -> pa.Table:
        block = opened(docs_of)
        ids = block.ids
        h1, h2, *answered = _windows(answers)
        if len(block.h1):
            # the block's own addresses, then the answers, which are better where there are any
            first = block.firsts
            lead, _ = block.best(np.zeros(len(first), bool))
            own = [block.doc[first], block.pos[first], block.doc[lead], block.pos[lead]]
            hit = np.flatnonzero(_within(block.h1[first], np.unique(h1)))
            if len(hit):
                both = [np.concatenate((x[hit], y)) for x, y in zip((block.h1[first], block.h2[first], *own, np.zeros(len(first), np.uint32)), (h1, h2, *answered))]
                for x, found in zip(own, chosen(*both)):
                    x[hit] = found[: len(hit)]
            best_of = [x[block.group] for x in own]
        out = {"doc_id": ids, "n_words": [], "n_removed": [], "n_factors": [], "kept": []}
        for i, words in enumerate(block.words):
            start, end = block.at.get(i, (0, 0))
            removed, factors = parsed(ids[i], *(x[start:end] for x in best_of), len(words), width) if end > start else (np.zeros(len(words), bool), [])
            out["n_words"].append(len(words))
            out["n_removed"].append(int(removed.sum()))
            out["n_factors"].append(len(factors))
            out["kept"].append(b" ".join(words if not factors else [w for w, gone in zip(words, removed.tolist()) if not gone]))
        return pa.table([pa.array(out["doc_id"], pa.int64()), *(pa.array(out[c], pa.int64()) for c in ("n_words", "n_removed", "n_factors")), pa.array(out["kept"], pa.binary())], names=list(out))

    prints = docs.groupBy("block").applyInArrow(offer, "bucket int, block int, prints binary").repartition(n_buckets, "bucket")
    bits = prints.groupBy("bucket").applyInArrow(meet, "block int, bucket int, bits binary")
    requests = docs.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(ask, f"bucket int, block int, {columns}")
    answers = requests.repartition(n_buckets, "bucket").groupBy("bucket").applyInArrow(answer, f"block int, {columns}")
    out = docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(remove, OUT)
    return out.union(every.where("doc_id is null").mapInArrow(_whole, OUT))


OUT = "doc_id long, n_words long, n_removed long, n_factors long, kept binary"


@frugal
def _whole(batches):
    """Rows that no document removes anything from."""
    for batch in batches:
        for part in slices(batch):
            words = [(t or b"").split() for t in bytes_of(part)]
            none = [0] * len(words)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array([b" ".join(w) for w in words], pa.binary())], names=["doc_id", "n_words", "n_removed", "n_factors", "kept"])

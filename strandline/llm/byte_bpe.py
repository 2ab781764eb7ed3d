"""Operator 9: byte-level BPE by a sentencepiece model that is serialised directly from a rank file.

Each byte is mapped to one printable character, each vocabulary entry to the string of its bytes'
characters; a piece's score is its negative rank, so sentencepiece merges in order of rank, leftmost first.
Normalisation is identity and nothing is added to the text.  Pre-tokens are encoded one by one, each
distinct one once in a while; as in the rank file's own library, a pre-token that is an entry is that entry.
Decoding looks up each id's bytes.

Defined results: null text counts as empty; empty text has no ids; a text of any length is encoded whole, a long pre-token
without being kept; of merges with one rank the leftmost comes first; repeated rows give repeated rows; null ids are kept;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandline.llm.common import Bounded, frugal, id_text, slices, texts_of

#: Pre-tokens whose ids a Python worker keeps; longer ones are encoded each time.
CACHE_WORDS, CACHE_CHARS = 150_000, 64


def load_ranks(path: str) -> dict[bytes, int]:
    """Entries and ranks of a file whose lines hold an entry in base64 and its rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(entry): int(rank) for entry, rank in (line.split() for line in file if line.strip())}


def byte_characters() -> list[str]:
    """A character for each byte: itself where it is a printable one, else one from U+0100 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer: bytes, varint or 32-bit float."""

    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 0x7F:
            out.append(n & 0x7F | 0x80)
            n >>= 7
        return bytes([*out, n])

    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value)


def serialised_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model of the entries in order of rank, with one unknown piece after them.

    Field numbers and type codes are those of sentencepiece's public model format.
    """
    pieces, trainer, normalizer, piece, score, kind = 1, 2, 3, 1, 2, 3
    normal, unknown, bpe = 1, 2, 2
    chars = byte_characters()
    entries = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in entries] != list(range(len(entries))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    out = [_field(pieces, _field(piece, "".join(map(chars.__getitem__, entry)).encode()) + _field(score, float(-rank)) + _field(kind, normal)) for entry, rank in entries]
    out.append(_field(pieces, _field(piece, b"<unk>") + _field(score, 0.0) + _field(kind, unknown)))
    # trainer: 3 model_type, 4 vocab_size, 40 unk_id, 41 bos_id, 42 eos_id, 43 pad_id; absent ids are -1
    absent = (1 << 64) - 1
    out.append(_field(trainer, _field(3, bpe) + _field(4, len(entries) + 1) + _field(40, len(entries)) + _field(41, absent) + _field(42, absent) + _field(43, absent)))
    # normalizer: 1 name, 3 add_dummy_prefix, 4 remove_extra_whitespaces, 5 escape_whitespaces
    out.append(_field(normalizer, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised_model(ranks))
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.entries = [entry for entry, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.chars = {b: c for b, c in enumerate(byte_characters())}
        self.cache = Bounded(self.encode_word, CACHE_WORDS)

    def encode_word(self, word: str) -> bytes:
        """Ids of one pre-token as little-endian unsigned 32-bit integers."""
        raw = word.encode("utf-8")
        whole = self.ranks.get(raw)
        ids = [whole] if whole is not None else self.model.encode(raw.decode("latin-1").translate(self.chars), out_type=int)
        return np.asarray(ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        known = self.cache
        return b"".join(known[w] if len(w) < CACHE_CHARS else self.encode_word(w) for w in self.find(text or ""))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.entries.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def byte_bpe(df: DataFrame, ranks: str | dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit, as binary) and, with decode, the decoded bytes.

    The driver reads the rank file (its size doesn't depend on the data) and sends it to the executors once.
    """
    sent = df.sparkSession.sparkContext.broadcast(load_ranks(ranks) if isinstance(ranks, str) else dict(ranks))

    @frugal
    def encode(batches):
        bpe = ByteBpe(sent.value, pattern)
        for batch in batches:
            for part in slices(batch):
                ids = [bpe.encode(t) for t in texts_of(part)]
                columns = [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                names = ["doc_id", "n_tokens", "ids"]
                if decode:
                    columns.append(pa.array([bpe.decode(x) for x in ids], pa.binary()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return id_text(df, id_col, text_col).mapInArrow(encode, "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decode)

"""Operator 1: token counts of a unigram tokenizer without building the tokens.

The tokenizer is the unigram model over a given vocabulary of scored pieces, with text cut before each
blank (the blank is part of the word that follows).  An Aho-Corasick automaton enumerates, for each end
position, every piece that ends there, the longest first; dynamic programming carries only the best score
and the number of pieces.  A candidate replaces the best one only when its score is strictly greater, so of
equal scores the longest last piece stays, as in the tokenizer.  A character without a piece costs the
lowest score less 10 and counts as one unknown piece for each run, or as its UTF-8 bytes when the
vocabulary has all byte pieces.

Defined results: null text counts as empty; empty text has 0 tokens; a text of any length is counted whole, a word of any
length in time linear in it; repeated rows give repeated rows; null ids are kept; an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from strandline.llm.common import Bounded, frugal, id_text, slices, texts_of

#: The mark that stands for a blank in the pieces, and what an unknown character costs below the lowest score.
BLANK, UNKNOWN_PENALTY = "▁", 10.0
#: Words whose counts a Python worker keeps; longer words are counted each time.
CACHE_WORDS, CACHE_CHARS = 150_000, 64


def load_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores, by id, of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class PieceCounter:
    """Counts the pieces of the best segmentation of a text."""

    def __init__(self, pieces: list[tuple[str, float]], unknown_id: int = 0):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(pieces):
            if piece:
                self.automaton.add_word(piece, (len(piece), score, i == unknown_id))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        names = {piece for piece, _ in pieces}
        self.by_bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        self.cache = Bounded(self.count_word, CACHE_WORDS)

    def count_word(self, word: str) -> int:
        """Pieces of one word, which begins with the blank's mark."""
        n = len(word)
        score, count, known = [0.0] * (n + 1), [0] * (n + 1), [True] * (n + 1)
        reached = 0  # ends at or before it have their best score
        single = False

        def unknown(end: int) -> None:
            """The last character of word[:end] as an unknown piece; it is the shortest candidate, so it comes last."""
            at = score[end - 1] + self.unknown
            if score[end] is None or at > score[end]:
                score[end], known[end] = at, False
                if self.by_bytes:
                    count[end] = count[end - 1] + len(word[end - 1].encode("utf-8", "surrogatepass"))
                else:
                    count[end] = count[end - 1] + (1 if known[end - 1] else 0)

        for k in range(1, n + 1):
            score[k] = None
        for last, (length, value, is_unknown) in self.automaton.iter(word):
            end = last + 1
            while reached < end - 1:  # ends that no piece, or no single character, has reached
                reached += 1
                if not single:
                    unknown(reached)
                single = False
            start = end - length
            at = score[start] + value
            if score[end] is None or at > score[end]:
                score[end], count[end], known[end] = at, count[start] + 1, not is_unknown
            single = single or length == 1
        while reached < n:
            reached += 1
            if not single:
                unknown(reached)
            single = False
        return count[n]

    def count(self, text: str | None) -> int:
        """Pieces of a whole text.  Each distinct short word is segmented once in a while, others each time."""
        if not text:
            return 0
        text = text.replace(BLANK, " ")
        if text[0] == " ":
            text = text[1:]
        words, known = text.split(" "), self.cache
        if len(text) < CACHE_CHARS:
            return sum(map(known.__getitem__, map(BLANK.__add__, words)))
        return sum(known[BLANK + w] if len(w) < CACHE_CHARS else self.count_word(BLANK + w) for w in words)


def token_counts(df: DataFrame, vocabulary: str | list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens of every row.  vocabulary: path of a sentencepiece model file, or scored pieces by id.

    The driver reads the vocabulary (its size doesn't depend on the data) and sends it to the executors once.
    """
    pieces = load_pieces(vocabulary) if isinstance(vocabulary, str) else list(vocabulary)
    sent = df.sparkSession.sparkContext.broadcast(pieces)

    @frugal
    def count(batches):
        counter = PieceCounter(sent.value)
        for batch in batches:
            for part in slices(batch):
                n = [counter.count(t) for t in texts_of(part)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return id_text(df, id_col, text_col).mapInArrow(count, "doc_id long, n_tokens long")

"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the pieces that end at each place of a word; dynamic programming
carries the best score and the number of pieces, and no path. Tie rules are those of the ``tokenizers``
library's unigram model: scores are added from left to right, a later candidate must be strictly better
(so the piece that starts first wins), a character that is no piece by itself may be unknown at the
smallest score less ``UNKNOWN``, and neighbouring unknowns are one.
Words are cut at Unicode white space and begin with the mark; a word's count is remembered.

The public vocabularies at hand are all of merge rules; none has unigram scores, and tokenizers aren't trained here. So
the default pieces are those of the public 32k vocabulary with the log-probabilities of Zipf's law over their
ranks (the file's order is that of the merges, the more frequent first). Control pieces are left out, since text
is never one; what no piece covers counts by its bytes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leafworks.llm._base import CHUNK_BYTES, slices

MARK, UNKNOWN = "\u2581", 10.0
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Words whose counts a task remembers, and the longest of them.
REMEMBERED, LONGEST = 300_000, 64


def default_pieces() -> list[tuple[str, float]]:
    """Pieces of the public 32k vocabulary and their log-probabilities by rank; piece 0 is the unknown one.
    Control pieces are left out."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = [i for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_unknown(i)]
    ranked = [i for i in ids if not model.is_byte(i)]
    whole = math.log(sum(1 / r for r in range(1, len(ranked) + 1)))
    known = [(model.id_to_piece(i), -math.log(r) - whole) for r, i in enumerate(ranked, 1)]
    least = known[-1][1]
    return [(model.id_to_piece(model.unk_id()), least), *known, *((model.id_to_piece(i), least) for i in ids if model.is_byte(i))]


class Counter:
    """Token counts of words under ``pieces`` (text, score); ``pieces[unknown]`` stands for what has none.

    ``byte_fallback``: an unknown stretch counts its UTF-8 bytes, if all their pieces are there.
    """

    def __init__(self, pieces: list[tuple[str, float]], unknown: int = 0, byte_fallback: bool = False):
        self.find = ahocorasick.Automaton()
        for text, score in pieces:
            if text:  # of equal pieces the last one counts
                self.find.add_word(text, (len(text), score))
        self.empty = not len(self.find)
        if not self.empty:
            self.find.make_automaton()
        self.single = {text for text, _ in pieces if len(text) == 1}
        self.least = min((score for _, score in pieces), default=0.0) - UNKNOWN
        have = {text for text, _ in pieces}
        self.bytes = {b for b in range(256) if f"<0x{b:02X}>" in have} if byte_fallback else set()
        self.known: dict[str, int] = {}

    def stretch(self, text: str) -> int:
        raw = text.encode()
        return len(raw) if self.bytes and self.bytes.issuperset(raw) else 1

    def word(self, word: str) -> int:
        """Tokens of ``word`` (with its mark)."""
        if word in self.known:
            return self.known[word]
        n = len(word)
        best: list[float] = [0.0] * (n + 1)
        count = [0] * (n + 1)
        open_ = [-1] * (n + 1)  # where the unknown stretch that ends here began
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        if not self.empty:
            for end, found in self.find.iter(word):
                matches[end].append(found)  # longest first
        for end in range(n):
            top, at = None, 0
            for length, score in matches[end]:
                value = best[end + 1 - length] + score
                if top is None or value > top:
                    top, at = value, end + 1 - length
            if word[end] not in self.single:
                value = best[end] + self.least
                if top is None or value > top:
                    top, at = value, -1
            best[end + 1] = top
            if at >= 0:
                count[end + 1] = count[at] + 1
            else:
                began = open_[end] if open_[end] >= 0 else end
                open_[end + 1] = began
                count[end + 1] = count[began] + self.stretch(word[began : end + 1])
        if n <= LONGEST:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = count[n]
        return count[n]

    def text(self, text: str) -> int:
        known, one = self.known, self.word
        total = 0
        for w in SPACE.split(text):
            if w:
                w = MARK + w
                n = known.get(w)
                total += one(w) if n is None else n
        return total


def token_counts(docs: DataFrame, pieces: list[tuple[str, float]] | None = None, byte_fallback: bool = False) -> DataFrame:
    """``(doc_id, n_tokens)`` of every row of ``docs(doc_id, text)``, of whole texts.

    Null, empty and blank texts have 0 tokens; ids may be null or repeated, each row is counted; an empty
    table gives an empty table. ``pieces`` (default: the public 32k vocabulary, by rank) is bounded
    by the vocabulary and travels as a broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces if pieces is not None else default_pieces())
    ids = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value, byte_fallback=byte_fallback)
        for batch in slices(batches, "text", CHUNK_BYTES):
            counts = np.fromiter((counter.text(x or "") for x in batch.column("text").to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts)], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {ids}, n_tokens bigint")

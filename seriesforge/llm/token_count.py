"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton of the vocabulary enumerates every piece that ends at a
place of the text; dynamic programming keeps only the best score and its number of
tokens for each place. Rules are those of the unigram model of the ``tokenizers``
library: starts are taken in order and a later one wins only by a strictly higher
score; a character without a piece of its own costs the lowest score less 10; such
characters count as their UTF-8 bytes (byte fallback).

A text is normalised as the vocabulary expects: a space becomes U+2581, and one is
put before a text that isn't empty. No piece joins two words or holds a line end,
and scores are whole numbers, so a text's best score and count are the sums over
its words, exactly; the counts of short words are kept in a cache of bounded size.

Cases: null and empty texts have no tokens and score 0; every other column is
ignored; repeated rows are counted one by one; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _arrow

SPACE_MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHED_WORDS, CACHED_BYTES = 400_000, 48
_MARK = SPACE_MARK.encode()
_WORD = re.compile(rb"\n| +[^ \n]*|[^ \n]+")


def sentencepiece_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Counts tokens of texts under one vocabulary."""

    def __init__(self, vocabulary: Iterable[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        scores = {}
        for piece, score in vocabulary:
            scores.setdefault(piece, score)
        for piece, score in scores.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(scores.values()) - UNKNOWN_PENALTY
        joins = any((SPACE_MARK in p.lstrip(SPACE_MARK) or (p.strip(SPACE_MARK) and p.endswith(SPACE_MARK)) or "\n" in p) for p in scores)
        self.by_word = not joins and all(float(s).is_integer() for s in scores.values())
        self.cache: dict[bytes, tuple[int, float]] = {}

    def best(self, text: str) -> tuple[int, float]:
        """(tokens, score) of a normalised text by the dynamic programme."""
        n = len(text)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        at = -1  # the last place that is settled
        ends: list[tuple[int, float]] = []
        place = 0

        def settle(end: int, pieces: list[tuple[int, float]]) -> None:
            top, tokens, single = None, 0, False
            for length, value in pieces:  # the longest first: starts in order
                got = score[end - length] + value
                single |= length == 1
                if top is None or got > top:
                    top, tokens = got, count[end - length] + 1
            if not single:
                got = score[end - 1] + self.unknown
                if top is None or got > top:
                    top, tokens = got, count[end - 1] + len(text[end - 1].encode("utf-8", "surrogatepass"))
            score[end], count[end] = top, tokens

        for last, piece in self.automaton.iter(text):
            if last != at:
                if at >= 0:
                    settle(at + 1, ends)
                for place in range(at + 1, last):
                    settle(place + 1, [])
                at, ends = last, []
            ends.append(piece)
        if at >= 0:
            settle(at + 1, ends)
        for place in range(at + 1, n):
            settle(place + 1, [])
        return count[n], score[n]

    def count(self, text: bytes) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        if not self.by_word:
            return self.best(SPACE_MARK + text.decode("utf-8", "replace").replace(" ", SPACE_MARK))
        tokens, total, cache = 0, 0.0, self.cache
        # a mark in the text itself is the same letter as a space
        for word in _WORD.findall(b" " + text.replace(_MARK, b" ")):
            got = cache.get(word)
            if got is None:
                got = self.best(word.decode("utf-8", "replace").replace(" ", SPACE_MARK))
                if len(word) <= CACHED_BYTES:
                    if len(cache) >= CACHED_WORDS:
                        cache.clear()
                    cache[word] = got
            tokens += got[0]
            total += got[1]
        return tokens, total


_COUNTERS: dict[str, Counter] = {}


def _counter(vocabulary: list[tuple[str, float]], digest: str) -> Counter:
    """A worker keeps its counter and cache from task to task."""
    if digest not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[digest] = Counter(vocabulary)
    return _COUNTERS[digest]


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]]) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, score (the best segmentation's), for whole texts."""

    digest = hashlib.sha256(repr(vocabulary).encode()).hexdigest()

    def run(batches):
        counter = _counter(vocabulary, digest)
        for batch in batches:
            for lo, hi, buf, offs in _arrow.chunks(batch.column("text")):
                raw = buf.tobytes()
                got = [counter.count(raw[a:b]) for a, b in zip(offs[:-1], offs[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.float64())], names=["doc_id", "n_tokens", "score"])

    return docs.select("doc_id", "text").mapInArrow(_arrow.tidy(run), "doc_id long, n_tokens long, score double")


def query(spark, sf_dir: str, vocabulary_path: str | None = None) -> DataFrame:
    import public_tokenizers

    vocabulary = sentencepiece_vocabulary(vocabulary_path or public_tokenizers.path("piece_bpe_32k.model"))
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary)

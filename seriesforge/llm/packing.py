"""Order-preserving packing of token streams into fixed windows by dynamic programming.

Documents keep the order of their rows; the tokens of a partition form one stream.
Windows are cut at document ends, at sentence ends, or, where a sentence is long,
at set steps inside it. The programme minimises padding plus a penalty for each cut
inside a document (truncation), with the cheapest transition for each place found
by a monotone queue over the places within one window before it:
best(i) = min over j of best(j) + (window - (i - j)) + penalty(i).
What is left at a partition's end is cut to powers of two, which need no padding.

No shuffle: each partition packs its own rows; a sequence id is the partition
number above 2**32 plus a running number, so a task that is run again gives the
same rows.

Cases: a null or empty text is one end-of-document token; a null id stays null; repeated rows are packed
one by one; an empty table gives no piece; further columns are ignored. A text is
never cut short: each token lies in exactly one piece.
"""

from __future__ import annotations

import functools
import os
import zlib
from array import array
from collections import deque
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import _arrow

WINDOW, END_ID = 2048, 1
SENTENCE_PENALTY, FORCED_PENALTY, FORCED_STEP = 2, 12, 16
BLOCK = 1 << 19  # tokens for which the programme runs at once
CACHED_WORDS, CACHED_STEMS = 1_400_000, 1_200_000
_TAIL = b".,%#&$*|;:!?"  # ASCII marks that never join the letters before them


class WordTokenizer:
    """Ids of whole texts through a tokenizer that splits at white space and between letters and punctuation.

    Words, and their letters without the punctuation that follows, are looked up in two caches of bounded size;
    only new letter runs go to the tokenizer, many at once.
    """

    def __init__(self, path: str, cached_words: int = CACHED_WORDS, cached_stems: int = CACHED_STEMS):
        from tokenizers import Tokenizer

        self.cached_words, self.cached_stems = cached_words, cached_stems

        # batches are small, and a task has one core: threads would cost more than they give
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values()) + 1
        self.word_end, self.sentence_end = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
        for token, i in vocabulary.items():
            text = token.removesuffix("</w>")
            self.word_end[i] = token.endswith("</w>")
            self.sentence_end[i] = bool(text) and text.rstrip("\"')")[-1:] in (".", "!", "?")
        self.stems: dict[bytes, bytes] = {}
        self._reset()

    def _reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.first = bytearray(), array("q", [0])

    def _encode(self, stems: list[bytes]) -> None:
        runs, single = [], []
        for stem in stems:
            (runs if stem.isalpha() or stem.decode("utf-8", "replace").isalpha() else single).append(stem)  # of bytes: A-Z and a-z only
        groups = [runs[i : i + 256] for i in range(0, len(runs), 256)]
        for group, got in zip(groups, self.tokenizer.encode_batch_fast([b" ".join(g).decode("utf-8", "replace") for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, dtype="<u4")
            ends = np.flatnonzero(self.word_end[ids]) + 1
            if len(ends) != len(group):  # not one run of letters each, after all
                single += group
                continue
            raw, at = ids.tobytes(), 0
            for stem, end in zip(group, (ends * 4).tolist(), strict=True):
                self.stems[stem] = raw[at:end]
                at = end
        for stem, got in zip(single, self.tokenizer.encode_batch_fast([s.decode("utf-8", "replace") for s in single], add_special_tokens=False), strict=True):
            self.stems[stem] = np.array(got.ids, dtype="<u4").tobytes()

    def _learn(self, words: list[bytes]) -> None:
        stems_of, tails = [], []
        for word in words:
            stem = word.rstrip(_TAIL)
            if stem.isalpha() or stem and stem[-1] > 0x7F and stem.decode("utf-8", "replace")[-1].isalpha() or stem[-1:].isalpha():
                stems_of.append(stem.lower())  # of bytes: A-Z only
                tails.append(word[len(stem) :])
            else:
                stems_of.append(word)
                tails.append(b"")
        if len(self.stems) > self.cached_stems:
            self.stems.clear()
        needed = set(stems_of)
        needed.update(tails)
        needed.discard(b"")
        self._encode(list(needed.difference(self.stems)))
        ids = list(map(self.stems.get, stems_of))
        ends = [self.stems[t] if t else b"" for t in tails]
        n = len(self.first) - 1
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) + np.fromiter(map(len, ends), np.int64, len(ends))
        self.flat += b"".join(chain.from_iterable(zip(ids, ends, strict=True)))
        self.first.frombytes((self.first[-1] + np.cumsum(sizes // 4)).tobytes())
        self.known.update(zip(words, range(n, n + len(words)), strict=True))

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        split = [t.split() for t in texts]  # of bytes: at space and U+0009 to U+000D
        words = list(chain.from_iterable(split))
        if len(self.known) > self.cached_words:
            self._reset()
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            self._learn(list({words[i] for i in missing}))
            at[missing] = [self.known[words[i]] for i in missing]
        first = np.frombuffer(self.first, np.int64)
        begin = first[at]
        size = first[at + 1] - begin
        edges = np.concatenate(([0], np.cumsum(size)))
        flat = np.frombuffer(self.flat, "<u4")[np.repeat(begin - edges[:-1], size) + np.arange(edges[-1])]
        ends = edges[np.cumsum([len(ws) for ws in split])] if split else []
        return np.split(flat, ends[:-1]) if split else []


@functools.lru_cache(1)
def word_tokenizer(path: str, cached_words: int = CACHED_WORDS, cached_stems: int = CACHED_STEMS) -> WordTokenizer:
    """A worker keeps its tokenizer and caches from task to task, until it gets one of another operator."""
    return WordTokenizer(path, cached_words, cached_stems)


_arrow.KEPT["packing"] = word_tokenizer


def cuts(places: np.ndarray, penalty: np.ndarray, window: int) -> list[int]:
    """Numbers of the places (rising, the first is 0; steps of at most ``window``) at which to cut.

    The last cut is the cheapest place less than one window before the end; what follows is left over.
    """
    n = len(places)
    at, cost = places.tolist(), penalty.tolist()
    total, back = at[:1] * n, [0] * n  # best(i) + place(i)
    queue = deque([0])  # places whose total rises
    for i in range(1, n):
        least = at[i] - window
        while at[queue[0]] < least:
            queue.popleft()
        back[i] = j = queue[0]
        total[i] = value = total[j] + window + cost[i]  # more than the first one's, which so stays
        while total[queue[-1]] >= value:
            queue.pop()
        queue.append(i)
    first = int(np.searchsorted(places, at[-1] - window, side="right"))
    last = min(range(min(first, n - 1), n), key=total.__getitem__)
    out = []
    while last:
        out.append(last)
        last = back[last]
    return out[::-1]


def _powers_of_two(n: int, most: int) -> list[int]:
    return [most] * (n // most) + [1 << b for b in reversed(range(most.bit_length())) if n % most >> b & 1]


class Packer:
    """Takes documents in order; gives (doc number, start, piece ids, length of document, sequence, offset)."""

    def __init__(self, window: int, sentence_end: np.ndarray):
        self.window, self.sentence_end = window, sentence_end
        self.sequence, self.size = 0, 0
        self.docs: list[tuple[object, int, np.ndarray, int]] = []  # key, ids gone before, ids, all ids

    def add(self, key: object, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append((key, 0, ids, len(ids)))
        self.size += len(ids)
        if self.size >= BLOCK:
            yield from self._emit(self._ends())

    def _ends(self) -> list[int]:
        """Places to cut the stream at, all but what is left over."""
        stream = np.concatenate([d[2] for d in self.docs])
        kind = np.full(len(stream) + 1, -1, dtype=np.int8)
        kind[1:][self.sentence_end[np.minimum(stream, len(self.sentence_end) - 1)]] = SENTENCE_PENALTY
        kind[np.cumsum([len(d[2]) for d in self.docs])] = 0
        kind[0] = 0
        places = np.flatnonzero(kind >= 0)
        gaps = np.diff(np.append(places, len(stream)))
        many = np.maximum(gaps - 1, 0) // FORCED_STEP  # further places in each gap
        nth = np.arange(1, many.sum() + 1) - np.repeat(np.cumsum(many) - many, many)
        kind[np.repeat(places, many) + nth * FORCED_STEP] = FORCED_PENALTY
        places = np.flatnonzero(kind >= 0)
        return places[cuts(places, kind[places], self.window)].tolist()

    def _emit(self, ends: list[int]) -> Iterator[tuple]:
        at, begin, k = 0, 0, 0  # place in the stream, begin of the sequence, number of the end
        left = []
        for key, gone, ids, total in self.docs:
            taken = 0
            while taken < len(ids) and k < len(ends):
                step = min(len(ids) - taken, ends[k] - at)
                if step:
                    yield key, gone + taken, ids[taken : taken + step], total, self.sequence, at - begin
                taken += step
                at += step
                if at == ends[k]:
                    begin = at
                    k += 1
                    self.sequence += 1
            if taken < len(ids):
                left.append((key, gone + taken, ids[taken:], total))
        self.docs = left
        self.size = sum(len(d[2]) for d in left)

    def close(self) -> Iterator[tuple]:
        while self.size > self.window:
            yield from self._emit(self._ends())
        yield from self._emit(np.cumsum(_powers_of_two(self.size, self.window)).tolist())


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, make: Callable[[str], WordTokenizer] = word_tokenizer, with_ids: bool = True) -> DataFrame:
    """docs(doc_id, text) -> a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and the ids."""

    def run(batches):
        tokenizer = make(tokenizer_path)
        packer = Packer(window, tokenizer.sentence_end)
        base = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []

        def table():
            ids = [np.ascontiguousarray(r[2], "<u4").tobytes() for r in rows]
            columns = [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([len(r[2]) for r in rows], pa.int64()),
                pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                pa.array([r[3] for r in rows], pa.int64()),
                pa.array([base + r[4] for r in rows], pa.int64()),
                pa.array([r[5] for r in rows], pa.int64()),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
                names.append("ids")
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for lo, hi, buf, offs in _arrow.chunks(batch.column("text")):
                raw = buf.tobytes()
                keys = batch.column("doc_id")[lo:hi].to_pylist()
                for key, ids in zip(keys, tokenizer.ids([raw[a:b] for a, b in zip(offs[:-1], offs[1:], strict=True)]), strict=True):
                    rows.extend(packer.add(key, np.append(ids, np.uint32(end_id))))
                if rows:
                    yield table()
        rows.extend(packer.close())
        yield table()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select("doc_id", "text").mapInArrow(_arrow.tidy(run, "packing"), schema + (", ids binary" if with_ids else ""))


def query(spark, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, tokenizer_path or public_tokenizers.path("word_bpe_49k.json"), with_ids=False)

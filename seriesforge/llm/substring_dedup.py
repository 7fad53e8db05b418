"""Substring dedup: words covered by a 20-word window that also starts earlier are removed.

1. Anchors. Of the 8-word runs in a window the one with the least hash is its
   anchor, so equal windows have equal anchors, and neighbouring windows mostly share
   one. Anchors are counted over all documents (with partial counts in each task);
   those seen once can't lie in a repeated window.
2. Passages. The windows of one anchor occurrence form a passage of 20 to 32 words.
   Passages with a recurring anchor are sent, once for each batch of rows and equal text, to the
   shard of their anchor. Recurring anchors are kept in a blocked Bloom filter of
   bounded size; a false hit only sends a passage for nothing. Around an anchor with very many
   occurrences most windows differ, as what surrounds a common line does: there the windows
   are counted themselves, a passage is a run of windows that recur, and each task sends it once.
3. Automata. A shard takes its passages anchor by anchor, and compiles an Aho-Corasick automaton
   (pyahocorasick) of all their windows, words being its letters, with the first place of each; some
   ``SHARD`` passages share an automaton. The passages are streamed through it: a passage's first
   occurrence gets a mask of the windows that start earlier elsewhere. (An anchor with one passage
   needs none: equal windows have equal anchors, so all that repeats is the whole passage.)
4. Every occurrence in every document is joined with its passage's result: all
   windows of a later occurrence are repeats, those of the first as the mask says. A passage
   is one row, however many windows it has.

Places are ordered by (doc_id, word number). Cuts belong to a row's id and text (its
64-bit hash and size), so rows with one id, or none, don't get each other's. Cases: a
null text has no words; a null id comes before all others; rows with one id are one
place in that order, so they aren't earlier than each other; texts of under 20 words are kept whole; empty tables
give an empty result; further columns are ignored, or kept (dedup_texts replaces a column n_removed).
A task holds the different passages of one anchor; around a common anchor, only those that recur.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _arrow
from ._session import release

WINDOW, ANCHOR = 20, 8
#: Occurrences from which the windows of an anchor are counted themselves.
COMMON = 128
#: Passages of an automaton, about, and those of common anchors that a task keeps before it sends them.
SHARD, HELD = 500, 20_000
#: Blocks of 64 bytes in a filter, at most: 32 MB.
MOST_BLOCKS = 1 << 19
_NULL_ID = -(1 << 63)
#: Helper columns beside the caller's own: the id, and what tells texts of one id apart.
_PLACE, _TEXT = "place", ("text_hash", "text_size")
_COVERS = ("starts", "masks", "mores")


def _text_key() -> dict[str, Column]:
    return dict(zip(_TEXT, (F.xxhash64("text"), F.octet_length("text")), strict=True))


class Runs:
    """The passages of a chunk: first word, number of windows, anchor hash, row."""

    def __init__(self, values: np.ndarray, word_offs: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR):
        places, rows = _arrow.gram_rows(word_offs, window)
        a = _arrow.gram_hashes(values, anchor)
        best, off = a[places].copy(), np.zeros(len(places), dtype=np.int64)
        for s in range(1, window - anchor + 1):
            other = a[places + s]
            less = other < best
            best[less] = other[less]
            off[less] = s
        at = places + off
        new = np.ones(len(places), dtype=bool)
        if len(places):
            new[1:] = (at[1:] != at[:-1]) | (rows[1:] != rows[:-1])
        begin = np.flatnonzero(new)
        self.first, self.row, self.anchor = places[begin], rows[begin], best[begin]
        self.windows = np.diff(np.append(begin, len(places)))
        self.start = self.first - word_offs[:-1][self.row] if len(begin) else self.first

    def keep(self, these: np.ndarray) -> None:
        for k in ("first", "row", "anchor", "windows", "start"):
            setattr(self, k, getattr(self, k)[these])

    def windows_of(self, these: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first word of each window of these runs, and its run."""
        run = np.repeat(np.flatnonzero(these), self.windows[these])
        many = self.windows[these]
        return self.first[run] + np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many), run

    def narrow(self, common: np.ndarray, values: np.ndarray, hot) -> None:
        """Runs of common anchors become runs of windows that recur."""
        at, run = self.windows_of(common)
        at, run = (x[hot.test(digests(values, at, np.full(len(at), WINDOW))[0])] for x in (at, run))
        new = np.ones(len(at), dtype=bool)
        new[1:] = (run[1:] != run[:-1]) | (at[1:] != at[:-1] + 1)
        begin = np.flatnonzero(new)
        of, rest = run[begin], np.flatnonzero(~common)
        start = self.start[of] + at[begin] - self.first[of]
        parts = {"first": at[begin], "start": start, "windows": np.diff(np.append(begin, len(at))), "row": self.row[of], "anchor": self.anchor[of], "common": np.ones(len(of), bool)}
        self.common = np.zeros(len(self.first), bool)
        merged = {k: np.concatenate([getattr(self, k)[rest], x]) for k, x in parts.items()}
        order = np.argsort(merged["first"], kind="stable")
        for k, x in merged.items():
            setattr(self, k, x[order])


def digests(values: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each run of words."""
    power, inverse = _arrow._power_tables(len(values) + 1)
    out = []
    for v in (values, _arrow.mix64(values ^ np.uint64(0xA0761D6478BD642F))):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v * power[: len(v)])])
        out.append(_arrow.mix64((total[first + length] - total[first]) * inverse[first] + length.astype(np.uint64)))
    return out[0], out[1]


class Filter:
    """A blocked Bloom filter of 64-bit hashes; the bits come from the hash itself."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def test(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), dtype=bool)
        at = np.arange(len(h))
        for i in range(8):
            key = h[at]
            block = (key & np.uint64(len(self.bits) - 1)).astype(np.int64)
            at = at[(self.bits[block, i] >> ((key >> np.uint64(16 + 6 * i)) & np.uint64(63))) & np.uint64(1) > 0]
        out[at] = True
        return out


def bloom(hashes: DataFrame, most_blocks: int = MOST_BLOCKS) -> Filter:
    """The filter of the column h; its size follows the count up to a fixed bound."""
    n = hashes.count()
    blocks = 1 << min(most_blocks.bit_length() - 1, max(6, (n * 16 // 512).bit_length()))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("h", 16 + 6 * i).bitwiseAND(F.lit(63)).cast("int"))
    rows = hashes.select(F.col("h").bitwiseAND(F.lit(blocks - 1)).cast("int").alias("block"), *(bit(i).alias(f"w{i}") for i in range(8)))
    got = rows.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8))).toPandas()  # at most `blocks` rows
    bits = np.zeros((blocks, 8), dtype=np.uint64)
    bits[got["block"].to_numpy()] = got[[f"w{i}" for i in range(8)]].to_numpy().astype(np.int64).view(np.uint64)
    return Filter(bits)


def _chunks(batches) -> Iterator[tuple]:
    for batch in batches:
        for lo, hi, buf, offs in _arrow.chunks(batch.column("text")):
            starts, ends, word_offs = _arrow.words(buf, offs)
            yield batch, lo, hi, buf, starts, ends, word_offs, _arrow.word_hashes(buf, starts, ends)


def _anchors(batches):
    for *_, word_offs, values in _chunks(batches):
        h, n = np.unique(Runs(values, word_offs).anchor, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])


def _common_windows(common):
    """The windows of common anchors, counted."""

    def run(batches):
        for *_, word_offs, values in _chunks(batches):
            runs = Runs(values, word_offs)
            at, _ = runs.windows_of(common.value.test(runs.anchor))
            h, n = np.unique(digests(values, at, np.full(len(at), WINDOW))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return run


def _ids(batch, lo: int, hi: int) -> np.ndarray:
    return batch.column("doc_id")[lo:hi].fill_null(_NULL_ID).to_numpy(zero_copy_only=False)


def _found_passages(batches, recurring, common, hot):
    for batch, lo, hi, buf, starts, ends, word_offs, values in _chunks(batches):
        runs = Runs(values, word_offs)
        runs.keep(recurring.value.test(runs.anchor))
        runs.narrow(common.value.test(runs.anchor), values, hot.value)
        if len(runs.first):
            length = runs.windows + WINDOW - 1
            yield batch, lo, hi, buf, starts, ends, runs, length, *digests(values, runs.first, length), _ids(batch, lo, hi)[runs.row]


_PASSAGE = {"k": pa.int64(), "d1": pa.int64(), "d2": pa.int64(), "doc_id": pa.int64(), "start": pa.int32(), "n": pa.int64(), "passage": pa.binary()}


def _passages(recurring, common, hot):
    """Each different passage of a chunk once, with its first place and number; those of common anchors once a task, or nearly."""

    def run(batches):
        held: dict[tuple, list] = {}

        def table(rows):
            columns = list(zip(*rows, strict=True)) or [[]] * len(_PASSAGE)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PASSAGE.values(), strict=True)], names=list(_PASSAGE))

        def flush():
            rows = [(*key, *place, n, text) for key, (place, n, text) in held.items()]
            held.clear()
            return table(rows)

        for _, _, _, buf, starts, ends, runs, length, d1, d2, ids in _found_passages(batches, recurring, common, hot):
            order = np.lexsort((runs.start, ids, d2, d1))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (d1[order][1:] != d1[order][:-1]) | (d2[order][1:] != d2[order][:-1])
            at = np.flatnonzero(new)
            pick, n = order[at], np.diff(np.append(at, len(order)))
            a, b = starts[runs.first[pick]], ends[runs.first[pick] + length[pick] - 1]
            raw = buf.tobytes()
            texts = [b" ".join(raw[x:y].split()) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            columns = [runs.anchor[pick].view(np.int64), d1[pick].view(np.int64), d2[pick].view(np.int64), ids[pick], runs.start[pick], n]
            often = runs.common[pick]
            for i in np.flatnonzero(often).tolist():
                k, one, two, doc, start, many = (int(c[i]) for c in columns)
                got = held.setdefault((k, one, two), [(doc, start), 0, texts[i]])
                got[0], got[1] = min(got[0], (doc, start)), got[1] + many
            sent = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*columns, texts], _PASSAGE.values(), strict=True)], names=list(_PASSAGE))
            yield sent.filter(pa.array(~often)) if often.any() else sent
            if len(held) > HELD:
                yield flush()
        if held:
            yield flush()

    return run


def _occurrences(recurring, common, hot):
    """Every occurrence of a passage in every row."""

    def run(batches):
        for batch, lo, hi, *_, runs, _, d1, d2, ids in _found_passages(batches, recurring, common, hot):
            # a word that is repeated on and on gives one row
            same = np.zeros(len(d1), dtype=bool)
            same[1:] = (d1[1:] == d1[:-1]) & (d2[1:] == d2[:-1]) & (runs.row[1:] == runs.row[:-1]) & (runs.first[1:] == runs.first[:-1] + 1) & (runs.windows[1:] == 1) & (runs.windows[:-1] == 1)
            at = np.flatnonzero(~same)
            more = np.diff(np.append(at, len(d1))) - 1
            text = {c: batch.column(c)[lo:hi].fill_null(0).to_numpy(zero_copy_only=False)[runs.row[at]] for c in _TEXT}
            columns = {"d1": d1[at].view(np.int64), "d2": d2[at].view(np.int64), "doc_id": ids[at], **text, "start": runs.start[at].astype(np.int32), "windows": runs.windows[at].astype(np.int32), "more": more.astype(np.int32)}
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns.values())], names=list(columns))

    return run


class Shard:
    """Passages (of whole anchors) and the automaton of their windows; tells which windows start earlier elsewhere."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.automaton = ahocorasick.Automaton()
        self.letters: dict[bytes, str] = {}
        self.texts: list[tuple[str, tuple[int, int]]] = []

    def add(self, words: list[bytes], place: tuple[int, int]) -> None:
        """A passage with its first place. A letter is a word; there are a million from U+E000 on."""
        text = "".join([self.letters.setdefault(w, chr(0xE000 + len(self.letters))) for w in words])
        self.texts.append((text, place))
        doc, start = place
        for b in range(len(text) - self.window + 1):
            key, here = text[b : b + self.window], (doc, start + b)
            known = self.automaton.get(key, None)
            if known is None or here < known:
                self.automaton.add_word(key, here)

    def masks(self) -> list[int]:
        """For each passage, the bits of its windows that the automaton finds with an earlier first place."""
        if not self.texts:
            return []
        self.automaton.make_automaton()
        out = []
        for text, (doc, start) in self.texts:
            mask = 0
            for end, first in self.automaton.iter(text):
                b = end - self.window + 1
                if first < (doc, start + b):
                    mask |= 1 << b
            out.append(mask)
        return out


def _confirm(batches):
    """Rows sorted by (k, d1, d2) -> a row for each passage that has a repeat: its first place and mask."""
    classes: list[list] = []  # k, d1, d2, first place, n, passage
    begin = 0  # of the last anchor's

    def close(end: int):
        """The table of the first ``end`` classes, which are all of their anchors."""
        keys = [c[0] for c in classes[:end]]
        several = [(i > 0 and keys[i - 1] == k) or (i + 1 < end and keys[i + 1] == k) for i, k in enumerate(keys)]
        shard = Shard()
        for c, these in zip(classes, several, strict=False):
            if these:
                shard.add(c[5].split(b" "), c[3])
        masks = iter(shard.masks())
        # a passage that has its anchor for itself shares no window with another one
        rows = [(c[1], c[2], *c[3], m) for c, these in zip(classes, several, strict=False) if (m := next(masks) if these else 0) or c[4] > 1]
        del classes[:end]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["d1", "d2", "first_doc", "first_start", "mask"])

    for batch in batches:
        for k, d1, d2, doc, start, n, text in zip(*(batch.column(c).to_pylist() for c in _PASSAGE), strict=True):
            if classes and classes[-1][:3] == [k, d1, d2]:
                classes[-1][3] = min(classes[-1][3], (doc, start))
                classes[-1][4] += n
                continue
            if classes and classes[-1][0] != k:
                begin = len(classes)
                if begin >= SHARD:
                    yield close(begin)
                    begin = 0
            classes.append([k, d1, d2, (doc, start), n, text])
    yield close(len(classes))


def covers(docs: DataFrame, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """doc_id, text_hash, text_size, cuts(start, mask, more): the repeated windows of each id and text that has any (null ids as the least long).

    Equal rows give equal cuts, which are kept once. Bit b of a mask stands for the window at start + b; ``more`` further windows follow the first one.
    """
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession

    def often(run, least: int) -> DataFrame:
        return docs.mapInArrow(_arrow.tidy(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).checkpoint()

    counted = often(_anchors, 2)
    recurring, common = (spark.sparkContext.broadcast(bloom(counted.where(F.col("n") >= n).select("h"), most_blocks)) for n in (2, COMMON))
    hot = spark.sparkContext.broadcast(bloom(often(_common_windows(common), 2).select("h"), most_blocks))
    release(spark)
    dealt = int(spark.conf.get("spark.sql.shuffle.partitions"))
    passages = docs.mapInArrow(_arrow.tidy(_passages(recurring, common, hot)), "k long, d1 long, d2 long, doc_id long, start int, n long, passage binary")
    results = passages.repartition(dealt, "k").sortWithinPartitions("k", "d1", "d2").mapInArrow(_arrow.tidy(_confirm), "d1 long, d2 long, first_doc long, first_start int, mask int")
    occurrences = docs.withColumns(_text_key()).mapInArrow(_arrow.tidy(_occurrences(recurring, common, hot)), "d1 long, d2 long, doc_id long, text_hash long, text_size int, start int, windows int, more int")
    is_first = (F.col("doc_id") == F.col("first_doc")) & (F.col("start") == F.col("first_start"))
    every = F.expr("shiftleft(1, windows) - 1")
    found = occurrences.join(results, ["d1", "d2"]).select("doc_id", *_TEXT, "start", F.when(is_first, F.col("mask")).otherwise(every).alias("mask"), "more")
    found = found.where((F.col("mask") != 0) | (F.col("more") > 0))
    return found.groupBy("doc_id", *_TEXT).agg(F.collect_set(F.struct("start", "mask", "more")).alias("cuts"))


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and the length of each row's list (0 for null)."""
    lengths = np.array([0 if n is None else n for n in pa.compute.list_value_length(col).to_pylist()], dtype=np.int64)
    return col.flatten().to_numpy(zero_copy_only=False), lengths


def removed_words(word_offs: np.ndarray, starts: np.ndarray, masks: np.ndarray, mores: np.ndarray, rows: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Whether each word of a chunk is covered."""
    n = int(word_offs[-1])
    edge = np.zeros(n + 1, dtype=np.int64)
    base, last = word_offs[:-1][rows] + starts, word_offs[1:][rows]

    def cover(begin, size, end):
        return np.bincount(np.minimum(begin, end), minlength=n + 1) - np.bincount(np.minimum(begin + size, end), minlength=n + 1)

    for b in range(window - ANCHOR + 1):
        these = (masks >> b & 1) > 0
        edge += cover(base[these] + b, window, last[these])
    longer = mores > 0
    edge += cover(base[longer] + 1, mores[longer] + window - 1, last[longer])
    return np.cumsum(edge)[:n] > 0


def _cut(batches, covers: list[str]):
    for batch in batches:
        flat = {c: _lists(batch.column(name)) for c, name in zip(_COVERS, covers, strict=True)}
        edges = np.concatenate(([0], np.cumsum(flat["starts"][1])))
        for lo, hi, buf, offs in _arrow.chunks(batch.column("text")):
            _, _, word_offs = _arrow.words(buf, offs)
            part = slice(edges[lo], edges[hi])
            rows = np.repeat(np.arange(hi - lo), flat["starts"][1][lo:hi])
            gone = removed_words(word_offs, *(flat[c][0][part].astype(np.int64) for c in _COVERS), rows)
            raw = buf.tobytes()
            kept, removed = [], []
            for i in range(hi - lo):
                words = raw[offs[i] : offs[i + 1]].split()
                drop = gone[word_offs[i] : word_offs[i + 1]]
                removed.append(int(drop.sum()))
                kept.append(b" ".join([w for w, d in zip(words, drop.tolist(), strict=True) if not d] if removed[-1] else words))
            yield batch, lo, hi, np.diff(word_offs), removed, kept


def _with_covers(docs: DataFrame, most_blocks: int) -> tuple[DataFrame, list[str]]:
    """docs with the cuts of each row, and the names of the columns that hold them."""
    own = "_"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    keys, names = [own + c for c in (_PLACE, *_TEXT)], [own + c for c in _COVERS]
    found = covers(docs, most_blocks)
    found = found.select(*(F.col(c).alias(k) for c, k in zip(("doc_id", *_TEXT), keys, strict=True)), *(F.col(f"cuts.{c}").alias(k) for c, k in zip(("start", "mask", "more"), names, strict=True)))
    keyed = docs.withColumns(dict(zip(keys, (F.coalesce("doc_id", F.lit(_NULL_ID).cast("long")), *_text_key().values()), strict=True)))
    return keyed.join(found, keys, "left").drop(*keys), names


def removals(docs: DataFrame, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs(doc_id, text)."""

    def run(batches):
        for batch, lo, hi, n_words, removed, kept in _cut(batches, names):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[lo:hi], pa.array(n_words), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    covered, names = _with_covers(docs.select("doc_id", "text"), most_blocks)
    return covered.mapInArrow(_arrow.tidy(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup_texts(docs: DataFrame, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """docs with all their columns; text holds the kept words where words were removed, and n_removed is added."""

    def run(batches):
        for batch, lo, hi, _, removed, kept in _cut(batches, names):
            own = batch.column("text")[lo:hi]
            text = pa.array([own[i].as_py() if not removed[i] else kept[i].decode("utf-8", "replace") for i in range(hi - lo)], own.type)
            columns = {c: batch.column(c)[lo:hi] for c in columns_kept} | {"text": text}
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(removed, pa.int64())], names=[*columns, "n_removed"])

    docs = docs.drop("n_removed")
    columns_kept = docs.columns
    covered, names = _with_covers(docs, most_blocks)
    return covered.mapInArrow(_arrow.tidy(run), T.StructType([*docs.schema.fields, T.StructField("n_removed", T.LongType())]))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)
),
placed AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS nth FROM win),
gone AS (SELECT DISTINCT doc_id, i + j AS k FROM placed, (SELECT unnest(range(20)) AS j) WHERE nth > 1),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d),
kept AS (
  SELECT words.doc_id, count(*) AS n_words, count(gone.k) AS n_removed, string_agg(word, ' ' ORDER BY words.k) FILTER (gone.k IS NULL) AS left_over
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.k = words.k GROUP BY words.doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(left_over, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    return removals(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

A word is a run of letters and digits, A-Z lower-cased. A document contains an item
of n words if some stretch of it has an edit distance (in words) of at most
``floor(max_share * n)`` to the item.

1. Seeds. If d edits are allowed and the item is cut in d + 1 pieces, a stretch
   within d edits holds one piece unchanged. Only places where the first words of a
   piece occur (found by hash, behind a bit table) start a window; nothing that can
   match is lost, and windows needn't be embedded at every word.
2. CGK. A window of the item's size and the item take the same random walk: at each
   step a symbol is written, and a hash of step and symbol says whether the walk
   moves on. Edit distance becomes Hamming distance between the two walks.
3. LSH. Each walk is sampled at a few random steps, several times; a window and an
   item with an equal sample are a candidate. ``WALKS * DRAWS`` samples of ``BITS``
   symbols meet most short items; the longer an item and the more it is edited, the
   fewer, so a window that they miss isn't given up.
4. Such a window is checked from its seed upwards: k neighbouring pieces may have
   k - 1 edits, and if they have no more, neither has one of their halves. So the
   seed's pair of pieces is compared first, then the four around it, and so on; most
   chance seeds end at the first, and no match is lost, whatever its length.
5. The edit distance is computed exactly over the window widened by d words on
   either side, with free ends, by a bit-parallel programme.

The benchmark is read in blocks of bounded size; each block is one pass over the
documents, which aren't shuffled.

Cases: null or empty texts and items contain and match nothing; an item without an id
is searched like others and reported with a null item_id; items with fewer
than ``MIN_EDITED`` words must occur unchanged; repeated items are reported one by one, repeated
documents too; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _arrow

MAX_SHARE, MIN_EDITED = 0.2, 5
WALKS, DRAWS, BITS = 6, 4, 3
BLOCK_BYTES = 4 << 20
_STEPS = 3  # steps of a walk for each word of an item

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_VALUE = _arrow.LOWER.copy()
_VALUE[~_WORD] = 0


def word_values(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and each row's offset into them."""
    clean = np.where(_WORD[buf], buf, np.uint8(0x20))
    starts, ends, word_offs = _arrow.words(clean, offs)
    return _arrow.word_hashes(clean, starts, ends, _VALUE), word_offs


def allowed(n: int, max_share: float = MAX_SHARE) -> int:
    return int(max_share * n) if n >= MIN_EDITED else 0


def edit_distance(item: np.ndarray, text: np.ndarray) -> int:
    """The least edit distance between the item and any stretch of the text (one bit a word of the item)."""
    n = len(item)
    masks: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    best = n
    for w in text.tolist():
        eq = masks.get(w, 0)
        across = (((eq & up) + up) ^ up) | eq | down
        gain = down | (full & ~(across | up))
        loss = up & across
        score += bool(gain & top) - bool(loss & top)
        gain = gain << 1 & full
        loss = loss << 1 & full
        straight = eq | down
        up = loss | (full & ~(straight | gain))
        down = gain & straight
        best = min(best, score)
    return best


def walks(rows: np.ndarray, walk: int) -> np.ndarray:
    """The CGK walk of each row of word hashes: steps x rows."""
    n = rows.shape[1]
    padded = np.concatenate([rows, np.zeros((len(rows), 1), np.uint64)], axis=1)
    keys = np.random.default_rng(101 + walk).integers(1, 1 << 63, _STEPS * n, dtype=np.uint64) | np.uint64(1)
    out = np.empty((_STEPS * n, len(rows)), dtype=np.uint64)
    at, line = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
    for step, key in enumerate(keys):
        symbol = padded[line, at]
        out[step] = symbol
        at += ((symbol * key) >> np.uint64(63)).astype(np.int64)
        np.minimum(at, n, out=at)
    return out


def samples(rows: np.ndarray) -> Iterator[np.ndarray]:
    """For each walk and draw, a hash of the sampled symbols of each row."""
    steps = _STEPS * rows.shape[1]
    for walk in range(WALKS):
        symbols = walks(rows, walk)
        rng = np.random.default_rng(977 + walk)
        for _ in range(DRAWS):
            # the last steps of most walks are padding
            chosen = rng.choice(max(1, steps * 3 // 5), size=BITS)
            got = np.zeros(len(rows), dtype=np.uint64)
            for c in chosen:
                got = got * np.uint64(0xC2B2AE3D27D4EB4F) + symbols[c]
            yield _arrow.mix64(got)


@dataclass(frozen=True)
class Index:
    """Seeds and samples of a block of items."""

    ids: pa.Array
    words: list[np.ndarray]
    edits: np.ndarray
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # words in a seed: bit table, hashes, items, offsets
    signatures: dict[int, np.ndarray]  # item size: draws x items of that size
    members: dict[int, np.ndarray]


def build_index(ids: list[int | None], texts: list[str], max_share: float = MAX_SHARE) -> Index:
    values, offs = word_values(*_arrow.string_buffer(pa.array(texts, pa.large_string())))
    words = [values[a:b] for a, b in zip(offs[:-1], offs[1:], strict=True)]
    edits = np.array([allowed(len(w), max_share) for w in words], dtype=np.int64)
    found: dict[int, list[tuple[int, int, int]]] = {}
    for i, (w, d) in enumerate(zip(words, edits.tolist(), strict=True)):
        if not len(w):
            continue
        pieces = d + 1
        q = len(w) // pieces
        for p in range(pieces):
            at = p * len(w) // pieces
            seed = w[at : at + (q if d else len(w))]
            found.setdefault(len(seed), []).append((int(_arrow.gram_hashes(seed, len(seed))[0]), i, at))
    seeds = {}
    for q, rows in found.items():
        rows.sort()
        hashes = np.array([r[0] for r in rows], dtype=np.uint64)
        table = np.zeros(1 << 20, dtype=bool)
        table[(hashes >> np.uint64(44)).astype(np.int64)] = True
        seeds[q] = table, hashes, np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    sizes = np.array([len(w) for w in words])
    members = {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes) if n}
    signatures = {n: np.array(list(samples(np.array([words[i] for i in m])))) for n, m in members.items()}
    return Index(pa.array(ids, pa.int64()), words, edits, seeds, signatures, members)


def climbs(item: np.ndarray, d: int, text: np.ndarray, start: int, place: int) -> bool:
    """Whether the parts of the item around the seed at ``place`` are near enough to the text; True for every match."""
    n, pieces = len(item), d + 1
    piece = -(-place * pieces // n)
    lo, hi, parts = 0, pieces, []
    while hi - lo > 1:
        middle = (lo + hi) // 2
        lo, hi = (lo, middle) if piece < middle else (middle, hi)
        parts.append((lo, hi))
    for lo, hi in parts[::-1]:
        a, b, edits = lo * n // pieces, hi * n // pieces, hi - lo - 1
        if edits and edit_distance(item[a:b], text[max(0, start + a - edits) : start + b + edits]) > edits:
            return False
    return True


def _windows(values: np.ndarray, word_offs: np.ndarray, index: Index) -> dict[int, np.ndarray]:
    """For each item size, the row, start (word number, maybe before the text's), item and place of windows at seeds."""
    out: dict[int, list[np.ndarray]] = {}
    sizes = np.array([len(w) for w in index.words])
    for q, (table, hashes, items, places) in index.seeds.items():
        g = _arrow.gram_hashes(values, q)
        hit = np.flatnonzero(table[(g >> np.uint64(44)).astype(np.int64)])
        lo, hi = np.searchsorted(hashes, g[hit], "left"), np.searchsorted(hashes, g[hit], "right")
        hit, lo, hi = hit[hi > lo], lo[hi > lo], hi[hi > lo]
        row = np.searchsorted(word_offs, hit, "right") - 1
        inside = hit + q <= word_offs[row + 1]
        hit, lo, hi, row = hit[inside], lo[inside], hi[inside], row[inside]
        many = hi - lo
        seed = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        item = items[seed]
        start = np.repeat(hit, many) - places[seed] - np.repeat(word_offs[row], many)
        for n in np.unique(sizes[item]):
            these = sizes[item] == n
            found = np.column_stack([np.repeat(row, many)[these], start[these], item[these], places[seed][these]])
            out.setdefault(int(n), []).append(found)
    return {n: np.unique(np.concatenate(p), axis=0) for n, p in out.items()}


def matches(buf: np.ndarray, offs: np.ndarray, index: Index) -> dict[tuple[int, int], tuple[int, int]]:
    """(row, item number) -> (edits, first word of the window that was nearest)."""
    values, word_offs = word_values(buf, offs)
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for n, hits in _windows(values, word_offs, index).items():
        step = max(1, (1 << 21) // n)
        for seeded in (hits[i : i + step] for i in range(0, len(hits), step)):
            part, window = np.unique(seeded[:, :2], axis=0, return_inverse=True)
            first, end = word_offs[part[:, 0]], word_offs[part[:, 0] + 1]
            at = first[:, None] + part[:, 1][:, None] + np.arange(n)
            outside = (at < first[:, None]) | (at >= end[:, None])
            rows = values[np.clip(at, 0, len(values) - 1)]
            rows[outside] = 0
            candidates = set()
            for got, known in zip(samples(rows), index.signatures[n], strict=True):
                order = np.argsort(known, kind="stable")
                lo, hi = np.searchsorted(known[order], got, "left"), np.searchsorted(known[order], got, "right")
                for w in np.flatnonzero(hi > lo):
                    candidates.update((int(w), int(index.members[n][order[k]])) for k in range(lo[w], hi[w]))
            for w, (row, start, item, place) in zip(window.ravel().tolist(), seeded.tolist(), strict=True):
                if (w, item) not in candidates and climbs(index.words[item], int(index.edits[item]), values[word_offs[row] : word_offs[row + 1]], start, place):
                    candidates.add((w, item))
            for w, item in sorted(candidates):
                row, start = part[w].tolist()
                d = int(index.edits[item])
                key = (row, item)
                if key in found and found[key][0] == 0:
                    continue
                a, b = int(word_offs[row]), int(word_offs[row + 1])
                text = values[max(a, a + start - d) : min(b, a + start + n + d)]
                edits = edit_distance(index.words[item], text)
                if edits <= d and (key not in found or edits < found[key][0]):
                    found[key] = edits, max(0, start)
    return found


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list[int | None], list[str]]]:
    """The items in blocks of about so many bytes, one at a time on the driver."""
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = total // block_bytes + 1
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).orderBy("item_id", "text").collect()
        yield [r["item_id"] for r in rows], [r["text"] for r in rows]


def contaminated(docs: DataFrame, benchmark: DataFrame, max_share: float = MAX_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, n_edits, n_words (of the item), first_word for each document and item that it contains."""
    out = None
    for ids, texts in _blocks(benchmark, block_bytes):
        index = build_index(ids, texts, max_share)

        def run(batches, index=index):
            for batch in batches:
                for lo, hi, buf, offs in _arrow.chunks(batch.column("text")):
                    found = sorted(matches(buf, offs, index).items())
                    if found:
                        rows = pa.array([k[0] for k, _ in found])
                        yield pa.RecordBatch.from_arrays(
                            [
                                batch.column("doc_id")[lo:hi].take(rows),
                                index.ids.take(pa.array([k[1] for k, _ in found])),
                                pa.array([v[0] for _, v in found], pa.int64()),
                                pa.array([len(index.words[k[1]]) for k, _ in found], pa.int64()),
                                pa.array([v[1] for _, v in found], pa.int64()),
                            ],
                            names=["doc_id", "item_id", "n_edits", "n_words", "first_word"],
                        )

        part = docs.select("doc_id", "text").mapInArrow(_arrow.tidy(run), "doc_id long, item_id long, n_edits long, n_words long, first_word long")
        out = part if out is None else out.unionByName(part)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, max_share: float = MAX_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs, with all their columns, without the rows that contain an item. No shuffle."""
    for ids, texts in _blocks(benchmark, block_bytes):
        index = build_index(ids, texts, max_share)

        def run(batches, index=index):
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for lo, _, buf, offs in _arrow.chunks(batch.column("text")):
                    keep[[lo + row for row, _ in matches(buf, offs, index)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(_arrow.tidy(run), docs.schema)
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    return contaminated(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))

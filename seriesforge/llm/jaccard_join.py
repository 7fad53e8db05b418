"""N-gram Jaccard join by PartEnum signatures, and the components of its links.

Documents link when their sets of 5-word shingles have a Jaccard similarity of 3/4
or more (100 * intersection >= 75 * union). For sizes a <= b that means a symmetric
difference of at most (a + b) / 7 <= a / 3.

1. Shingles seen in one document only can't be in an intersection. Each batch sends
   32 bits of each of its shingles to the partition that the others pick; those that
   meet an equal one are kept in a blocked Bloom filter of bounded size, with fewer bits
   set for each where they are many. False hits only prune less. A document with more than a quarter of its shingles outside
   can't link with a different text and takes no further part. For the others only
   shingles inside (the domain) need be compared; u, the number outside, counts as difference.
2. Exact copies (equal sets) are one class with its least doc_id as representative.
3. PartEnum. Sizes are cut in bands of ratio 4/3; band j's instance takes the sets of
   band j and those of the next that can link with one of it, which may differ in at most
   k = top / 3 shingles of the domain. At random, the domain is cut in more than k / 2
   parts and each of these in three cells. In some part at most one cell differs, so each
   choice of two cells of a part gives a signature, the hash of the set's shingles in them,
   and sets that link have one in common. There are some parts more than needed, as a
   choice without shingles gives no signature; a set with too few parts in two cells
   or more to be sure of a common signature is ``sparse`` and goes to step 5.
4. In a signature's group all are compared with the member of least (u, doc_id), the likeliest
   original: at first each set with the best of its partners only, then those that are still
   in different components. (Sets are dealt by their least hash, so most of a group is in one
   batch, and only the batch's best member goes on to the group of the whole table.)
5. What is left: sets in groups that still hold several components, and sparse sets. Among
   them a shingle counts only if it comes in sets of different components. That leaves
   few sets; those that link share one of their rarest such shingles (the prefix of
   n - ceil(3n / 4) + 1, rarest first). The sets of a prefix shingle are compared by their
   counts in 64 buckets, whose differences sum up to no more than the symmetric difference,
   in blocks of ``BLOCK`` rows at most; nothing but possible links leaves the task.
6. Possible links of steps 4 and 5 are made distinct, and decided on the whole sets.

Cases: a null text, or one without words, has the empty set and links with nothing;
with fewer than five words the whole sequence is the only shingle; rows with one id
are one vertex (the last stage keeps a row for each); a null id is its own component (null);
empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _arrow
from ._session import Tables, release
from .components import components
from .simhash import partition_keys
from .substring_dedup import MOST_BLOCKS

SHINGLE = 5
#: Counts of a set by the top bits of its shingles.
BUCKETS = 64
#: Rows of a prefix shingle that are compared in one go.
BLOCK = 512
#: Bits of a filter's block that a shingle sets at most.
PROBES = 8
_HALF, _PROBE = np.uint64(32), np.uint64(0xD1342543DE82EF95)


def shingles(buf: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their rows, sorted by row and hash."""
    starts, ends, word_offs = _arrow.words(buf, offs)
    h = _arrow.word_hashes(buf, starts, ends, _arrow.LOWER)
    places, rows = _arrow.gram_rows(word_offs, k)
    grams = _arrow.gram_hashes(h, k)[places]
    counts = np.diff(word_offs)
    short = [np.flatnonzero(counts == n) for n in range(1, k)]  # the whole sequence, with its length
    extra = [_arrow.gram_hashes(h, n)[word_offs[:-1][r]] ^ np.uint64(0x9FB21C651E98DF25 * n & (1 << 64) - 1) if len(r) else np.zeros(0, np.uint64) for n, r in enumerate(short, 1)]
    grams, rows = np.concatenate([grams, *extra]), np.concatenate([rows, *short])
    order = np.lexsort((grams, rows))
    grams, rows = grams[order], rows[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
    return grams[new], rows[new]


def _part(h: np.ndarray, n) -> np.ndarray:
    return ((h >> _HALF) * np.asarray(n, np.uint64)) >> _HALF


def _bloom_key(part: np.ndarray, low: np.ndarray) -> np.ndarray:
    return _arrow.mix64((part.astype(np.uint64) << _HALF) | low.astype(np.uint64))


def _dealt(h: np.ndarray, n: int) -> pa.RecordBatch:
    """A row for each partition: the low halves of its hashes, each twice at most."""
    h = np.sort(h)
    third = np.zeros(len(h), dtype=bool)
    third[2:] = h[2:] == h[:-2]
    h = h[~third]
    edges = np.searchsorted(_part(h, n), np.arange(n + 1))
    low = (h & np.uint64(0xFFFFFFFF)).astype("<u4")
    full = np.flatnonzero(np.diff(edges))
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([low[edges[p] : edges[p + 1]].tobytes() for p in full], pa.binary())], names=["part", "low"])


def _dealt_shingles(n: int):
    def run(batches):
        for batch in batches:
            for _, _, buf, offs in _arrow.chunks(batch.column("text"), 2 << 20):
                yield _dealt(shingles(buf, offs)[0], n)

    return run


class Shared:
    """A blocked Bloom filter in slices, one for each partition of the shingles, each of its own size and number of probes."""

    def __init__(self, n_parts: int, slices: list[tuple[int, int, bytes]]):
        self.blocks, self.probes = np.ones(n_parts, dtype=np.uint64), np.ones(n_parts, dtype=np.int64)
        self.base = np.zeros(n_parts, dtype=np.int64)
        bits, at = [np.zeros((1, 8), dtype=np.uint64)], 1
        for part, probes, raw in sorted(slices):
            own = np.frombuffer(raw, dtype="<u8").reshape(-1, 8)
            self.blocks[part], self.base[part], self.probes[part] = len(own), at, probes
            bits.append(own)
            at += len(own)
        self.bits = np.concatenate(bits)

    def test(self, h: np.ndarray) -> np.ndarray:
        part = _part(h, len(self.blocks)).astype(np.int64)
        key = _bloom_key(part, h & np.uint64(0xFFFFFFFF))
        block = self.base[part] + _part(key << _HALF, self.blocks[part]).astype(np.int64)
        key, probes = key * _PROBE, self.probes[part]
        out = np.zeros(len(h), dtype=bool)
        at = np.arange(len(h))
        for i in range(PROBES):
            found = _bit(key[at], i) & self.bits[block[at], _word(key[at], i)] > 0
            out[at[found & (probes[at] == i + 1)]] = True
            at = at[found & (probes[at] > i + 1)]
            if not len(at):
                break
        return out


def _word(key: np.ndarray, i: int) -> np.ndarray:
    """The word of a block for a key's probe i."""
    return ((key >> np.uint64(61)).astype(np.int64) + i) & 7


def _bit(key: np.ndarray, i: int) -> np.ndarray:
    return np.uint64(1) << ((key >> np.uint64(55 - 6 * i)) & np.uint64(63))


def _slice(key: np.ndarray, most: int) -> tuple[int, np.ndarray]:
    """The filter's probes and blocks for the keys: 12 bits a key, within a fixed bound.

    With fewer bits a key there are fewer probes, so that about half of the bits are set: with 2 bits a key a test still
    drops three of five others, where eight probes would set all bits and drop none.
    """
    blocks = max(1, min(most, -(-len(key) * 12 // 512)))
    probes = max(1, min(PROBES, round(blocks * 512 / max(len(key), 1) * np.log(2))))
    bits = np.zeros((blocks, 8), dtype=np.uint64)
    block = _part(key << _HALF, blocks).astype(np.int64)
    key = key * _PROBE
    for i in range(probes):
        np.bitwise_or.at(bits, (block, _word(key, i)), _bit(key, i))
    return probes, bits


def _shared(most: int):
    """The slice of shingles that came at least twice; a task may hold several partitions."""

    def run(batches):
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for part, low in zip(batch.column("part").to_pylist(), batch.column("low"), strict=True):
                held.setdefault(part, []).append(np.frombuffer(low.as_buffer(), "<u4"))
        for part, lows in held.items():
            low = np.sort(np.concatenate(lows))
            twice = np.zeros(len(low), dtype=bool)
            twice[1:] = low[1:] == low[:-1]
            found = np.unique(low[twice])
            if len(found):
                probes, bits = _slice(_bloom_key(np.full(len(found), part), found), most)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([probes], pa.int32()), pa.array([bits.astype("<u8").tobytes()], pa.binary())], names=["part", "probes", "bits"])

    return run


def _counts(h: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Rows of bucket counts, 255 at most (which keeps differences within the true ones)."""
    place = rows * BUCKETS + (h >> np.uint64(58)).astype(np.int64)
    return np.minimum(np.bincount(place, minlength=n_rows * BUCKETS), 255).astype(np.uint8).reshape(n_rows, BUCKETS)


def _nodes(shared):
    """doc_id, n, u, two digests of the set, and for documents that may link the domain's part of the set, its bucket counts and its least hash."""

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offs in _arrow.chunks(batch.column("text")):
                h, rows = shingles(buf, offs)
                inside = shared.value.test(h)
                edges = np.searchsorted(rows, np.arange(hi - lo + 1))
                n = np.diff(edges)
                seen = np.concatenate(([0], np.cumsum(inside)))
                u = n - (seen[edges[1:]] - seen[edges[:-1]])
                digest = []
                for seed in (0x2545F4914F6CDD1D, 0xDA942042E4DD58B5):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_arrow.mix64(h ^ np.uint64(seed)))])
                    digest.append((total[edges[1:]] - total[edges[:-1]]).view(np.int64))
                may = ((n > 0) & (4 * u <= n)).tolist()
                kept = h[inside]
                counts = _counts(kept, rows[inside], hi - lo)
                spans = list(zip(seen[edges[:-1]].tolist(), seen[edges[1:]].tolist(), may, strict=True))
                columns = {
                    "doc_id": batch.column("doc_id")[lo:hi],
                    "n": pa.array(n),
                    "u": pa.array(u),
                    "d1": pa.array(digest[0]),
                    "d2": pa.array(digest[1]),
                    "elements": pa.array([kept[a:b].tobytes() if ok else None for a, b, ok in spans], pa.binary()),
                    "counts": pa.array([c.tobytes() if ok else None for c, ok in zip(counts, may, strict=True)], pa.binary()),
                    "least": pa.array([int(kept[a].view(np.int64)) if ok and b > a else None for a, b, ok in spans], pa.int64()),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _tops(most: int = 1 << 40) -> np.ndarray:
    """The largest size of each band."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, 4 * (out[-1] + 1) // 3))
    return np.array(out)


TOPS = _tops()


def parts_of_band(j: np.ndarray) -> np.ndarray:
    """Parts of a band's instance: a fifth and two more than the allowed differences need."""
    return 6 * (TOPS[j] // 3 // 2 + 1) // 5 + 2


def signatures(elements: np.ndarray, offs: np.ndarray, n: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, their rows, whether each row is sparse)."""
    signs, rows_of, sparse = [], [], np.zeros(len(n), dtype=bool)
    own = np.searchsorted(TOPS, n)
    row_of = np.repeat(np.arange(len(n)), np.diff(offs))
    mixed = _arrow.mix64(elements ^ np.uint64(0x8BB84B93962EACC9))
    for lower in (0, 1):
        j = np.maximum(own - lower, 0)
        # differences inside the domain: a third of the smaller set, and two sevenths of the larger one
        differ = (2 * n // 7 if lower else n // 3) - u
        takes = (own >= lower) & (differ >= 0) & ((lower == 0) | (3 * n <= 4 * TOPS[j]))
        these = takes[row_of]
        rows, e = row_of[these], elements[these]
        seed = _arrow.mix64(j.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
        x = _arrow.mix64(e ^ seed[rows])
        part = ((x >> _HALF) * parts_of_band(j)[rows].astype(np.uint64)) >> _HALF
        cell = ((x & np.uint64(0xFFFFFFFF)) * np.uint64(3)) >> _HALF
        key = (rows.astype(np.uint64) << np.uint64(40)) | (part << np.uint64(2)) | cell
        order = np.argsort(key)
        key = key[order]
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        key = key[begin]
        sums = np.add.reduceat(mixed[these][order], begin) if len(begin) else np.zeros(0, np.uint64)
        whole = key >> np.uint64(2)
        new = np.concatenate(([True], whole[1:] != whole[:-1])) if len(key) else np.zeros(0, bool)
        at, whole = np.cumsum(new) - 1, whole[new]
        cells, full = np.zeros((len(whole), 3), np.uint64), np.zeros((len(whole), 3), np.int64)
        in_part = (key & np.uint64(3)).astype(np.int64)
        cells[at, in_part] = sums
        full[at, in_part] = 1
        row = (whole >> np.uint64(38)).astype(np.int64)
        base = seed[row] + (whole & np.uint64((1 << 38) - 1)) * np.uint64(4)
        for left_out in range(3):
            some = full.sum(axis=1) > full[:, left_out]
            total = cells.sum(axis=1, dtype=np.uint64) - cells[:, left_out]
            signs.append(_arrow.mix64(total ^ _arrow.mix64(base + np.uint64(left_out)))[some])
            rows_of.append(row[some])
        sure = np.bincount(row[full.sum(axis=1) > 1], minlength=len(n))
        sparse |= takes & (sure <= differ // 2)
    return np.concatenate(signs), np.concatenate(rows_of), sparse


def _signed(batches):
    """(sign, v, u, null) for the best member of a batch's group; (any, v, u, pivot) for its other members, and (any, v, u, v) for a sparse set."""
    for batch in batches:
        elements, offs = _binary_elements(batch.column("elements"))
        v, n, u = (_arrow.ints(batch.column(c)) for c in ("v", "n", "u"))
        sign, row, sparse = signatures(elements, offs, n, u)
        rank = np.empty(len(v), dtype=np.int64)
        rank[np.lexsort((v, u))] = np.arange(len(v))
        order = np.lexsort((rank[row], sign))
        sign, row = sign[order], row[order]
        first = np.concatenate(([True], sign[1:] != sign[:-1])) if len(sign) else np.zeros(0, bool)
        best = row[first]
        pivot = best[np.cumsum(first) - 1][~first] if len(sign) else row
        pairs = np.unique(np.column_stack([v[row[~first]], v[pivot]]), axis=0)
        pairs = np.concatenate([pairs[pairs[:, 0] != pairs[:, 1]], np.column_stack([v[sparse], v[sparse]])])
        anywhere = _arrow.mix64(pairs[:, 0].view(np.uint64) * np.uint64(3) + pairs[:, 1].view(np.uint64)) if len(pairs) else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([sign[first], anywhere]).view(np.int64)),
                pa.array(np.concatenate([v[best], pairs[:, 0]])),
                pa.array(np.concatenate([u[best], np.zeros(len(pairs), np.int64)]).astype(np.int32)),
                pa.array(np.concatenate([np.zeros(len(best), np.int64), pairs[:, 1]]), mask=np.arange(len(best) + len(pairs)) < len(best)),
            ],
            names=["sign", "v", "u", "pivot"],
        )


def _binary_elements(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    col = col.cast(pa.large_binary())
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.copy().view("<u8") if len(raw) else np.zeros(0, np.uint64), (offs - offs[0]) // 8


def _verified(batches):
    """Of pairs with both sets: those whose similarity is 3/4 or more."""
    for batch in batches:
        (left, left_offs), (right, right_offs) = (_binary_elements(batch.column(c)) for c in ("ea", "eb"))
        a, b = _arrow.ints(batch.column("na")), _arrow.ints(batch.column("nb"))
        rows = np.concatenate([np.repeat(np.arange(len(a)), np.diff(o)) for o in (left_offs, right_offs)])
        both = np.concatenate([left, right])
        order = np.lexsort((both, rows))
        same = (both[order][1:] == both[order][:-1]) & (rows[order][1:] == rows[order][:-1])
        common = np.bincount(rows[order][1:][same], minlength=len(a))
        keep = 100 * common >= 75 * (a + b - common)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _side(sets: DataFrame, v: str, columns: list[str]) -> DataFrame:
    return sets.select(F.col("v").alias(v), *(F.col(c).alias(c + v) for c in columns))


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among pairs(a, b)."""
    full = pairs.select("a", "b").join(_side(sets, "a", ["n", "elements"]), "a").join(_side(sets, "b", ["n", "elements"]), "b")
    return full.selectExpr("a", "b", "na", "nb", "elementsa AS ea", "elementsb AS eb").mapInArrow(_arrow.tidy(_verified), "a long, b long")


def _bucket_counts(col: pa.Array) -> np.ndarray:
    col = col.cast(pa.large_binary())
    raw = np.frombuffer(col.buffers()[2], np.uint8) if len(col) else np.zeros(0, np.uint8)
    first = col.offset and int(np.frombuffer(col.buffers()[1], np.int64)[col.offset])
    return raw[first : first + len(col) * BUCKETS].reshape(-1, BUCKETS)


def _near(n1, u1, c1, n2, u2, c2):
    """Whether sizes, shingles outside and bucket counts allow a link."""
    apart = np.abs(c1.astype(np.int16) - c2.astype(np.int16)).sum(axis=1)
    return (4 * np.minimum(n1, n2) >= 3 * np.maximum(n1, n2)) & (7 * (u1 + u2 + apart) <= n1 + n2)


def _near_pairs(batches):
    for batch in batches:
        n1, u1, n2, u2 = (_arrow.ints(batch.column(c)) for c in ("na", "ua", "nb", "ub"))
        keep = _near(n1, u1, _bucket_counts(batch.column("countsa")), n2, u2, _bucket_counts(batch.column("countsb")))
        yield batch.select(["a", "b", "ub"]).filter(pa.array(keep))


def _possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs(a, b) that may link, with b's u."""
    columns = ["n", "u", "counts"]
    full = pairs.select("a", "b").join(_side(sets, "a", columns), "a").join(_side(sets, "b", columns), "b")
    return full.select("a", "b", "ub", "na", "ua", "nb", "countsa", "countsb").mapInArrow(_arrow.tidy(_near_pairs), "a long, b long, ub long")


def _rows_of_shingles(batches):
    """A row (e, v, d1, n, label) for each shingle of the domain in a set."""
    for batch in batches:
        elements, offs = _binary_elements(batch.column("elements"))
        row = np.repeat(np.arange(batch.num_rows), np.diff(offs))
        for at in range(0, max(len(row), 1), 1 << 18):
            these = pa.array(row[at : at + (1 << 18)])
            yield pa.RecordBatch.from_arrays([pa.array(elements[at : at + (1 << 18)].view(np.int64)), *(batch.column(c).take(these) for c in ("v", "d1", "n", "label"))], names=["e", "v", "d1", "n", "label"])


def _compared(batches):
    """Rows sorted by (e, i, j) -> pairs of different labels that may link; between blocks i and j if they differ.

    Counts go with the shingles outside the whole domain (u); those that no other component has (outside) are a bound of their own.
    """
    names = ["v", "own", "n", "u", "outside", "label"]
    held: list[tuple] = []

    def pairs(group: dict, counts: np.ndarray, across: bool):
        order = np.lexsort((group["n"], group["own"])) if across else np.argsort(group["n"], kind="stable")
        v, own, n, u, outside, label = (group[c][order] for c in names)
        counts = counts[order]
        for x in range(len(v) - 1):
            # of a block the sizes rise, so partners are a stretch of rows
            lo, hi = (int(np.searchsorted(own, own[x], "right")), len(v)) if across else (x + 1, len(v))
            hi = lo + int(np.searchsorted(3 * n[lo:hi], 4 * n[x], "right"))
            y = np.arange(lo, hi)[(label[lo:hi] != label[x]) & (7 * (outside[lo:hi] + outside[x]) <= n[lo:hi] + n[x])]
            if len(y):
                y = y[_near(n[x], u[x], counts[x : x + 1], n[y], u[y], counts[y])]
                yield from zip(np.minimum(v[x], v[y]).tolist(), np.maximum(v[x], v[y]).tolist(), strict=True)

    def close():
        got, across = {c: np.concatenate([h[1][c] for h in held]) for c in names}, held[0][0][1] != held[0][0][2]
        counts = np.concatenate([h[2] for h in held])
        held.clear()
        return pairs(got, counts, across) if len(got["v"]) > 1 and got["label"].min() < got["label"].max() else ()

    def table(found):
        found = np.array(sorted(found), dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    for batch in batches:
        keys = np.column_stack([_arrow.ints(batch.column(c)) for c in ("e", "i", "j")])
        values, counts = {c: _arrow.ints(batch.column(c)) for c in names}, _bucket_counts(batch.column("counts"))
        edges = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1), [True]))) if len(keys) else np.zeros(1, int)
        found: set[tuple] = set()
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            key = tuple(keys[lo].tolist())
            if held and held[0][0] != key:
                found.update(close())
            held.append((key, {c: x[lo:hi] for c, x in values.items()}, counts[lo:hi]))
        yield table(found)
    if held:
        yield table(set(close()))


def _left_over(rest: DataFrame, block: int) -> DataFrame:
    """Pairs (a, b) of different labels that may link among rest(v, d1, n, u, label, counts, elements)."""
    every = rest.select("v", "d1", "n", "label", "elements").mapInArrow(_arrow.tidy(_rows_of_shingles), "e long, v long, d1 long, n long, label long")
    met = every.groupBy("e").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("df")).where("low < high").select("e", "df")
    one = W.partitionBy("v", "d1")
    met = every.drop("label").join(met, "e").withColumn("inside", F.count(F.lit(1)).over(one))
    met = met.where("4 * (n - inside) <= n").withColumn("place", F.row_number().over(one.orderBy("df", "e")))
    prefix = met.where(F.col("place") <= F.col("inside") - F.ceil(F.col("n") * 3 / 4) + 1).select("e", "v", "d1", "df", (F.col("n") - F.col("inside")).alias("outside"))
    rows = prefix.join(rest.select("v", "d1", "n", "u", "label", "counts"), ["v", "d1"])
    blocks = F.ceil(F.col("df") / block).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("v"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("e", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "v", "own", "n", "u", "outside", "label", "counts")
    return rows.repartition("e", "i", "j").sortWithinPartitions("e", "i", "j").mapInArrow(_arrow.tidy(_compared), "a long, b long").distinct()


def linked_components(docs: DataFrame, most_blocks: int = MOST_BLOCKS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    tables = Tables(spark)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = partition_keys(spark, n_parts)

    dealt = docs.mapInArrow(_arrow.tidy(_dealt_shingles(n_parts)), "part int, low binary").repartition(n_parts, F.get(F.lit(keys), F.col("part")))
    slices = dealt.mapInArrow(_arrow.tidy(_shared(max(1, most_blocks // n_parts))), "part int, probes int, bits binary").collect()  # most_blocks * 64 bytes at most
    shared = spark.sparkContext.broadcast(Shared(n_parts, [(r["part"], r["probes"], bytes(r["bits"])) for r in slices]))
    del dealt, slices
    release(spark)
    nodes = tables.keep(docs.mapInArrow(_arrow.tidy(_nodes(shared)), "doc_id long, n long, u long, d1 long, d2 long, elements binary, counts binary, least long"))

    known = nodes.where("n > 0 AND doc_id IS NOT NULL")
    classes = tables.keep(known.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("v")))
    sets = known.where("elements IS NOT NULL").join(classes.select(F.col("v").alias("doc_id"), "d1", "d2", "n"), ["doc_id", "d1", "d2", "n"], "left_semi")
    sets = sets.select(F.col("doc_id").alias("v"), "d1", "d2", "n", "u", "elements", "counts", "least").dropDuplicates(["v", "d1", "d2"])
    # sets of one least hash lie together; where they are many, in several stretches
    many = known.groupBy("least").agg(F.ceil(F.count(F.lit(1)) / block).alias("stretches")).where("stretches > 1")
    sets = sets.join(many, "least", "left").withColumn("stretch", F.coalesce(F.pmod(F.xxhash64("d1"), F.col("stretches")), F.lit(0)))
    sets = tables.keep(sets.repartition("least", "stretch").sortWithinPartitions("least", "stretch").drop("stretches", "stretch"))
    release(spark)

    signed = sets.select("v", "n", "u", "elements").mapInArrow(_arrow.tidy(_signed), "sign long, v long, u int, pivot long")
    group = W.partitionBy("sign").orderBy("u", "v").rowsBetween(W.unboundedPreceding, W.currentRow)
    stars = signed.withColumn("best", F.first("v").over(group)).where("pivot IS NOT NULL OR v <> best")
    stars = tables.keep(stars.select(F.col("v").alias("a"), F.coalesce("pivot", "best").alias("b")).distinct())
    release(spark)
    possible = tables.keep(_possible(stars.where("a <> b"), sets))
    tried = tables.keep(possible.groupBy("a").agg(F.min(F.struct("ub", "b")).alias("best")).select("a", "best.b"))
    links = tables.keep(_verify(tried, sets))

    def labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        for c in ("a", "b"):
            pairs = pairs.join(labels.select(F.col("v").alias(c), F.col("label").alias(f"l{c}")), c, "left").withColumn(f"l{c}", F.coalesce(f"l{c}", c))
        return pairs

    def labels_of(links: DataFrame) -> DataFrame:
        return components(links).select(F.col("node").alias("v"), F.col("component").alias("label"))

    apart = labelled(possible.select("a", "b").join(tried, ["a", "b"], "left_anti"), labels_of(links)).where("la <> lb")
    more = tables.keep(_verify(tables.keep(apart.select("a", "b")), sets))
    links = links.unionByName(more)
    labels = labels_of(links)

    # Sets of groups that hold several components (the pivots of such groups, theirs, and all that were compared with them), and sparse sets.
    bad = labelled(stars.where("a <> b"), labels).where("la <> lb").select(F.col("b").alias("v"))
    above = stars.join(bad.withColumnRenamed("v", "a"), "a", "left_semi").select(F.col("b").alias("v"))
    for _ in range(2):
        bad = tables.keep(bad.unionByName(above).distinct())
        above = stars.join(bad.withColumnRenamed("v", "b"), "b", "left_semi").select(F.col("a").alias("v"))
    rest = tables.keep(bad.unionByName(above).unionByName(stars.where("a = b").select(F.col("a").alias("v"))).distinct())
    if not rest.isEmpty():
        rest = sets.join(rest, "v", "left_semi").join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
        links = links.unionByName(_verify(tables.keep(_left_over(rest, block)), sets))
    links = tables.keep(links)
    tables.drop(sets)

    found = tables.keep(classes.join(labels_of(links), "v", "left").select("d1", "d2", "n", F.coalesce("label", "v").alias("component_id")))
    out = nodes.select("doc_id", "n", "d1", "d2").join(found, ["d1", "d2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
),
sets AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4
  )
),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
meets AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM meets JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
),
reach AS (SELECT doc_id AS node, doc_id AS other FROM d UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least AS component_id
FROM d LEFT JOIN sizes ON sizes.doc_id = d.doc_id
JOIN (SELECT node, min(other) AS least FROM reach GROUP BY node) r ON r.node = d.doc_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    return linked_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Document fingerprints: SimHash with weighted votes, and search by permuted block tables.

A term is a pair of neighbouring words (one word if there is only one). Each
occurrence votes with the byte length of its words on each of 128 signed bits, so
frequent terms and long words weigh more; a bit is set if its sum is above zero.

``neighbours`` finds every fingerprint within a Hamming radius: the bits are cut in
blocks, and as at most ``radius`` blocks can differ, some choice of the other blocks
is equal; each choice is a table (a permutation that puts these blocks first), and
all tables are one equi-join with an exact check behind it. Fingerprints are made
distinct before the join, so copies cost nothing.

The edited text of the contract needs the next document in descending order of id.
Bounds of id ranges with about equal rows are taken from ``SAMPLE`` rows of least hash; the
last row of a range needs the first of the range below, which is sent to it as well, and
then each range, sorted, holds every neighbour it needs: one shuffle of the texts. Bounds are
pairs of id and text hash, so rows that share an id, or have none, are split, too.

Cases: a null text is empty; a text without words has the fingerprint 0; rows with
equal ids follow one another by the hash of their texts; a null id comes after all others; a single
document is its own neighbour; rows equal in id and text are in one range; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _arrow
from ._session import Tables

BITS, SAMPLE = 128, 8192
TERM_WORDS = 2
RADIUS, BLOCKS = 3, 5


def fingerprints(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of 16 bytes for each text."""
    starts, ends, word_offs = _arrow.words(buf, offs)
    h = _arrow.word_hashes(buf, starts, ends)
    size = (ends - starts).astype(np.float32)
    out = np.zeros((len(offs) - 1, BITS // 8), dtype=np.uint8)
    if not len(h):
        return out
    pair, pair_size = _arrow.gram_hashes(h, TERM_WORDS), size[:-1] + size[1:]
    for i, (lo, hi) in enumerate(zip(word_offs[:-1].tolist(), word_offs[1:].tolist(), strict=True)):
        if hi == lo:
            continue
        sums, total = np.zeros(BITS, dtype=np.float64), 0.0
        for at in range(lo, max(hi - 1, lo + 1), 1 << 14):  # a long text in steps
            to = min(at + (1 << 14), hi - 1)
            terms, weights = (pair[at:to], pair_size[at:to]) if hi - lo > 1 else (h[lo:hi], size[lo:hi])
            both = np.column_stack([terms, _arrow.mix64(terms ^ np.uint64(0x5851F42D4C957F2D))])
            sums += weights @ np.unpackbits(both.view(np.uint8), axis=1).astype(np.float32)
            total += float(weights.sum())
        out[i] = np.packbits(2 * sums > total)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits, row by row."""
    return 1 - np.unpackbits(a ^ b, axis=1).sum(axis=1) / BITS


def _edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def partition_keys(spark: SparkSession, n: int) -> list[int]:
    """An int for each of n hash partitions that lands in just this partition."""
    found: dict[int, int] = {}
    size = max(64, 4 * n)
    while len(found) < n:
        rows = spark.range(size).select(F.col("id").cast("int").alias("id")).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("id"))
        found = {r["p"]: r["id"] for r in rows.collect()}  # at most n rows
        size *= 4
    return [found[p] for p in range(n)]


def _place(bounds: list, key: Column, literal) -> Column:
    """How many of the sorted bounds aren't above the key: among every m-th of them, then among m."""
    if not bounds:
        return F.lit(0)
    m = max(1, int(len(bounds) ** 0.5))
    coarse = F.size(F.filter(F.array(*map(literal, bounds[m - 1 :: m])), lambda b: b <= key))
    fine = F.slice(F.array(*map(literal, bounds)), coarse * m + 1, F.lit(m))
    return coarse * m + F.size(F.filter(fine, lambda b: b <= key))


def _parts(docs: DataFrame, n: int) -> DataFrame:
    """docs(doc_id, text) with ``hash``, ``part`` and ``guest``; a part's guest comes after its own rows."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    key = F.struct(F.col("doc_id").isNotNull().cast("int").alias("a"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("b"), F.col("hash").alias("c"))
    literal = lambda k: F.struct(F.lit(k[0]).cast("int").alias("a"), F.expr(f"CAST('{k[1]}' AS BIGINT)").alias("b"), F.expr(f"CAST('{k[2]}' AS BIGINT)").alias("c"))
    some = docs.select("doc_id", "hash", key.alias("key")).orderBy(F.xxhash64("hash", "doc_id"), "doc_id", "hash").limit(SAMPLE)
    some = sorted(tuple(r["key"]) for r in some.collect())
    bounds = sorted({some[len(some) * i // n] for i in range(1, n)}) if len(some) >= n else []
    placed = docs.select("doc_id", "text", "hash", key.alias("key")).withColumn("part", _place(bounds, F.col("key"), literal))
    if not bounds:
        return placed.select("doc_id", "text", "hash", "part", F.lit(False).alias("guest")).unionByName(_first_row(placed))
    tops = {r["part"]: tuple(r["top"]) for r in placed.select("part", "key").groupBy("part").agg(F.max("key").alias("top")).collect()}  # at most n rows
    full = sorted(tops)  # parts that have rows; a top goes to the next of them
    above = {p: full[(i + 1) % len(full)] for i, p in enumerate(full)}
    is_top = F.get(F.array(*(literal(tops.get(p, (2, 0, 0))) for p in range(len(bounds) + 1))), F.col("part")) == F.col("key")
    guest = F.when(is_top, F.get(F.lit([above.get(p, -1) for p in range(len(bounds) + 1)]), F.col("part")))
    copies = F.array(F.struct(F.col("part"), F.lit(False).alias("guest")), F.struct(guest.alias("part"), F.lit(True).alias("guest")))
    return placed.select("doc_id", "text", "hash", F.explode(F.filter(copies, lambda x: x["part"].isNotNull())).alias("to")).select("doc_id", "text", "hash", "to.part", "to.guest")


def _first_row(placed: DataFrame) -> DataFrame:
    """The guest of a table that is one part: its own first row."""
    top = placed.orderBy(F.col("key").desc()).limit(1)
    return top.select("doc_id", "text", "hash", "part", F.lit(True).alias("guest"))


def _followed(batches) -> Iterator[tuple[list, list[str], list[str]]]:
    """Runs of (ids, texts, texts of the next documents) of rows sorted by part and descending id."""
    last, size = None, 0
    ids, texts, after = [], [], []
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in ("part", "guest", "doc_id", "text")), strict=True):
            text = row[3] or ""
            if last is not None and last[0] == row[0] and not last[1]:
                ids.append(last[2])
                texts.append(last[3])
                after.append(text)
                size += len(last[3])
                if size >= _arrow.CHUNK_BYTES // 2:
                    yield ids, texts, after
                    ids, texts, after, size = [], [], [], 0
            last = (row[0], row[1], row[2], text)
    yield ids, texts, after


def fingerprint_documents(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for docs(doc_id, text)."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for ids, texts, after in _followed(batches):
            edited = [_edited(t, a) for t, a in zip(texts, after, strict=True)]
            own, changed, following = (fingerprints(*_arrow.string_buffer(pa.array(part, pa.large_string()))) if part else np.zeros((0, BITS // 8), np.uint8) for part in (texts, edited, _only_new(texts, after)))
            following = _next_rows(texts, after, own, following)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
                    pa.array([x.tobytes().hex() for x in own], pa.string()),
                    pa.array([x.tobytes().hex() for x in changed], pa.string()),
                    pa.array(likeness(own, changed)),
                    pa.array(likeness(own, following)),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    parts = _parts(docs.select("doc_id", "text"), n)
    dealt = parts.repartition(n, F.get(F.lit(partition_keys(spark, n)), F.col("part"))).sortWithinPartitions("part", "guest", F.col("doc_id").desc_nulls_last(), F.col("hash").desc(), "text")
    return dealt.select("part", "guest", "doc_id", "text").mapInArrow(_arrow.tidy(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _only_new(texts: list[str], after: list[str]) -> list[str]:
    """The next texts that aren't the text of the following row of the run."""
    return [a for i, a in enumerate(after) if i + 1 == len(texts) or a is not texts[i + 1]]


def _next_rows(texts: list[str], after: list[str], own: np.ndarray, new: np.ndarray) -> np.ndarray:
    out, k = np.zeros_like(own), 0
    for i, a in enumerate(after):
        if i + 1 < len(texts) and a is texts[i + 1]:
            out[i] = own[i + 1]
        else:
            out[i] = new[k]
            k += 1
    return out


def neighbours(prints: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Every pair (query_fingerprint, fingerprint, distance) of distinct hex fingerprints within the radius."""
    if not radius < blocks:
        raise ValueError("there must be more blocks than the radius")
    nibbles = BITS // 4
    edges = [nibbles * i // blocks for i in range(blocks + 1)]
    tables = list(combinations(range(blocks), blocks - radius))

    def keys(df: DataFrame, name: str) -> DataFrame:
        one = df.where(F.col("fingerprint").isNotNull()).select(F.col("fingerprint").alias(name)).distinct()
        block = [F.substring(name, a + 1, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        choice = F.array(*(F.struct(F.lit(i).alias("table"), F.concat(*(block[b] for b in t)).alias("key")) for i, t in enumerate(tables)))
        return one.select(name, F.explode(choice).alias("to")).select(name, "to.table", "to.key")

    half = lambda c, i: F.conv(F.substring(c, 1 + 16 * i, 16), 16, -10).cast("long")
    distance = F.bit_count(half("query_fingerprint", 0).bitwiseXOR(half("fingerprint", 0))) + F.bit_count(half("query_fingerprint", 1).bitwiseXOR(half("fingerprint", 1)))
    found = keys(queries, "query_fingerprint").join(keys(prints, "fingerprint"), ["table", "key"]).select("query_fingerprint", "fingerprint", distance.alias("distance"))
    return found.where(F.col("distance") <= radius).distinct()


def with_neighbours(fingerprinted: DataFrame, every: int = 50, radius: int = RADIUS) -> DataFrame:
    """Adds n_near: for the queries (ids divisible by ``every``) the number of other rows within the radius, else null."""
    rows = Tables(fingerprinted.sparkSession).keep(fingerprinted)
    asks = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    weights = rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))
    near = neighbours(rows, rows.where(asks), radius).join(weights, "fingerprint").groupBy("query_fingerprint").agg((F.sum("n") - 1).alias("n_near"))
    queries = rows.where(asks).join(near.withColumnRenamed("query_fingerprint", "fingerprint"), "fingerprint", "left")
    return rows.where(~asks).withColumn("n_near", F.lit(None).cast("long")).unionByName(queries)


def query(spark, sf_dir: str) -> DataFrame:
    return with_neighbours(fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")))

"""The training split of the contracts, and bounded samples of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the third of the documents that nothing is learned from; a null id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))


def bounded_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows with the smallest hash of the key: the same rows however the table is split."""
    return rows.orderBy(F.xxhash64(key), key).limit(n)

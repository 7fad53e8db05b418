"""The write entry: a request's rows as stored samples and catalog rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import TENANT, QueryError
from ..operators.catalog import lookup_ids
from ..operators.dedup import dedup_samples, drop_expired
from .samples import prepare_write, write_samples

TTL_S = 365 * 86_400


def write_request(
    rows: DataFrame, series: DataFrame, path: str, now_ms: int, tenant: str | None = None, tenant_label: str = TENANT,
    virtual: tuple[str, ...] = (), ttl_s: int = TTL_S, most_future_ms: int | None = None, read_only: bool = False,
) -> DataFrame:
    """Writes rows(labels, ts_ms, value, is_stale) and returns the catalog rows of series that ``series`` hasn't.

    The tenant's label is set and virtual labels go; rows of one label set are one series and of
    equal times one stays, a number before NaN; samples beyond their time to live go, as do those
    later than ``most_future_ms`` from now, if it is set. All samples are one write, so a request is
    stored as a whole or not at all; if it is sent again, its rows are merged on read.
    """
    if read_only:
        raise QueryError("the store is read-only")
    prepared = drop_expired(prepare_write(rows, tenant, tenant_label, virtual).withColumn("ttl_s", F.lit(ttl_s)), now_ms)
    if most_future_ms is not None:
        prepared = prepared.where(F.col("ts_ms") <= now_ms + most_future_ms)
    ids, new = lookup_ids(prepared.select("labels", "ttl_s"), series, now_ms)
    samples = prepared.join(ids.select("labels_key", "series_id"), "labels_key").select("series_id", "ts_ms", "value", "is_stale")
    write_samples(dedup_samples(samples), path)
    return new

"""The series catalog: lookups, ids, weekly shards, expiry, dumps and consistency checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..model import QueryError, labels_key

SHARD_HOURS = 168
GLOBAL_SHARD = -1


def shard_of(ts_ms: Column) -> Column:
    """The week of a time: hours since the epoch at the week's start, as the index numbers them."""
    hours = F.floor(ts_ms / F.lit(3_600_000)).cast("int")
    return hours - F.pmod(hours, F.lit(SHARD_HOURS))


def shard_start_ms(shard: Column) -> Column:
    return shard.cast("long") * 3_600_000


def label_values(series: DataFrame, name: str) -> DataFrame:
    if not name or "|" in name:
        raise QueryError(f"invalid label name {name!r}")
    return series.select(F.try_element_at("labels", F.lit(name)).alias("value")).where("value IS NOT NULL AND value <> ''").distinct().orderBy("value")


def label_names(series: DataFrame) -> DataFrame:
    return series.select(F.explode(F.map_keys("labels")).alias("name")).distinct().orderBy("name")


def with_samples(series: DataFrame, samples: DataFrame, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Series with a sample in the range: a semi join, so no sample leaves its scan but the id."""
    chosen = samples
    if start_ms is not None:
        chosen = chosen.where(F.col("ts_ms") >= start_ms)
    if end_ms is not None:
        chosen = chosen.where(F.col("ts_ms") <= end_ms)
    return series.join(chosen.select("series_id"), "series_id", "left_semi")


def in_shards(series: DataFrame, series_shard: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Series that have a sample somewhere in a week that the range touches."""
    low, high = shard_of(F.lit(start_ms)), shard_of(F.lit(end_ms))
    return series.join(series_shard.where(F.col("shard").between(low, high)).select("series_id"), "series_id", "left_semi")


def all_ids(series_shard: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    low, high = shard_of(F.lit(start_ms)), shard_of(F.lit(end_ms))
    return series_shard.where(F.col("shard").between(low, high)).select("series_id").distinct()


def shard_members(samples: DataFrame) -> DataFrame:
    """(series_id, shard) of every sample, each once."""
    return samples.select("series_id", shard_of(F.col("ts_ms")).alias("shard")).distinct()


def lookup_ids(requests: DataFrame, series: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """Ids for requests(labels, ttl_s): those known and new ones above the greatest.

    Returns (ids of all requests, the new catalog rows). Requests of one label set are merged and the
    larger ttl counts. New ids are numbered by the order of keys, in stretches of keys: the count of each
    stretch comes to the driver, not its rows.
    """
    keyed = requests.withColumn("labels_key", labels_key(F.col("labels")))
    merged = keyed.groupBy("labels_key").agg(F.any_value("labels").alias("labels"), F.max("ttl_s").alias("ttl_s"))
    known = series.select("labels_key", "series_id")
    fresh = merged.join(known, "labels_key", "left_anti")
    top = series.agg(F.coalesce(F.max("series_id"), F.lit(0))).first()[0]
    numbered = number_rows(fresh, "labels_key", top + 1)
    rows = numbered.select("series_id", "labels", "labels_key", (F.lit(now_ms) + F.col("ttl_s").cast("long") * 1000).alias("expires_at_ms"))
    ids = merged.join(known.unionByName(rows.select("labels_key", "series_id")), "labels_key").select("labels_key", "series_id", "ttl_s")
    return ids, rows


#: Stretches of keys that are numbered apart, and keys from which their bounds are taken.
STRETCHES, BOUND_KEYS = 64, 4096


def number_rows(df: DataFrame, key: str, first: int) -> DataFrame:
    """Adds dense series_id values in the order of a unique key, without one task that sees all rows.

    The bounds of the stretches are fixed values, taken from the keys of least hash, so ids
    are the same however often the plan or a part of it runs.
    """
    some = sorted(r[0] for r in df.select(key).orderBy(F.xxhash64(key), key).limit(BOUND_KEYS).collect())
    step = max(1, len(some) // STRETCHES)
    bounds = some[step::step]
    stretch = F.size(F.filter(F.lit(bounds), lambda b: b <= F.col(key))) if bounds else F.lit(0)
    placed = df.withColumn("stretch", stretch)
    counts = {r["stretch"]: r["count"] for r in placed.groupBy("stretch").count().collect()}
    begin = [first + sum(counts.get(p, 0) for p in range(s)) for s in range(len(bounds) + 1)]
    place = F.row_number().over(W.partitionBy("stretch").orderBy(key))
    return placed.withColumn("series_id", F.get(F.lit(begin), F.col("stretch")).cast("long") + place - 1).drop("stretch")


def refresh_expiry(series: DataFrame, written: DataFrame, now_ms: int) -> DataFrame:
    """Later expiry for series that were written: written(series_id, ttl_s)."""
    last = written.groupBy("series_id").agg((F.lit(now_ms) + F.max("ttl_s").cast("long") * 1000).alias("renewed"))
    return series.join(last, "series_id", "left").withColumn("expires_at_ms", F.greatest("expires_at_ms", "renewed")).drop("renewed")


def expire(series: DataFrame, now_ms: int) -> DataFrame:
    return series.where(F.col("expires_at_ms").isNull() | (F.col("expires_at_ms") > now_ms))


def delete_ids(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The table (series, samples or shard members) without the ids."""
    return table.join(ids.select("series_id").distinct(), "series_id", "left_anti")


def drop_old_shards(series_shard: DataFrame, now_ms: int, ttl_ms: int) -> DataFrame:
    """Members of weeks that ended within the time to live."""
    return series_shard.where(shard_start_ms(F.col("shard")) + SHARD_HOURS * 3_600_000 + ttl_ms > now_ms)


# -- dumps and summaries


def dump(series: DataFrame) -> DataFrame:
    """metricID, labels, expirationDate: the rows of the CSV dump."""
    expiry = F.date_format(F.timestamp_millis("expires_at_ms"), "yyyy-MM-dd'T'HH:mm:ss'Z'") if "expires_at_ms" in series.columns else F.lit("")
    return series.select(F.col("series_id").alias("metricID"), F.col("labels_key").alias("labels"), F.coalesce(expiry, F.lit("")).alias("expirationDate"))


def dump_by_expiration(series: DataFrame, day_ms: int) -> DataFrame:
    return dump(series.where((F.col("expires_at_ms") >= day_ms) & (F.col("expires_at_ms") < day_ms + 86_400_000)))


def dump_by_shard(series: DataFrame, series_shard: DataFrame, shard: int) -> DataFrame:
    return dump(series.join(series_shard.where(F.col("shard") == shard).select("series_id"), "series_id", "left_semi"))


def posting_members(series: DataFrame, series_shard: DataFrame) -> DataFrame:
    """(shard, name, value, series_id): the inverted index, derived; a row for each member, so no posting is gathered."""
    return series.join(series_shard, "series_id").select("shard", F.explode("labels").alias("name", "value"), "series_id")


def postings(series: DataFrame, series_shard: DataFrame) -> DataFrame:
    """(shard, name, value, n): the size of each posting."""
    return posting_members(series, series_shard).groupBy("shard", "name", "value").agg(F.count(F.lit(1)).alias("n"))


def dump_by_posting(series: DataFrame, name: str, value: str | None = None) -> DataFrame:
    has = F.try_element_at("labels", F.lit(name))
    return dump(series.where(has.isNotNull() if value is None else has == value))


def info_global(series: DataFrame, series_shard: DataFrame) -> DataFrame:
    """Numbers of series and shards, and the series of each shard."""
    per_shard = series_shard.groupBy("shard").agg(F.count(F.lit(1)).alias("n_series"))
    return per_shard.unionByName(series.agg(F.lit(GLOBAL_SHARD).alias("shard"), F.count(F.lit(1)).alias("n_series")))


def info_by_id(series: DataFrame, series_shard: DataFrame, series_id: int) -> DataFrame:
    shards = series_shard.where(F.col("series_id") == series_id).groupBy("series_id").agg(F.array_sort(F.collect_set("shard")).alias("shards"))
    return series.where(F.col("series_id") == series_id).join(shards, "series_id", "left")


# -- consistency


def verify(series: DataFrame, series_shard: DataFrame, samples: DataFrame, now_ms: int) -> DataFrame:
    """(check, series_id, shard, detail) for everything that doesn't fit together; empty if all is well."""
    none = F.lit(None)

    def found(df: DataFrame, check: str, shard=none, detail=none) -> DataFrame:
        return df.select(F.lit(check).alias("check"), "series_id", shard.cast("int").alias("shard"), detail.cast("string").alias("detail"))

    expected = shard_members(samples)
    duplicated = series.groupBy("labels_key").agg(F.count(F.lit(1)).alias("n"), F.min("series_id").alias("series_id")).where("n > 1")
    twice = series.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = [
        found(series_shard.join(series, "series_id", "left_anti"), "id without labels", F.col("shard")),
        found(samples.select("series_id").distinct().join(series, "series_id", "left_anti"), "samples without labels"),
        found(series.where(F.size("labels") == 0), "empty labels"),
        found(duplicated, "labels with several ids", detail=F.col("labels_key")),
        found(twice, "id with several label sets", detail=F.col("n")),
        found(expected.join(series_shard, ["series_id", "shard"], "left_anti"), "missing in shard", F.col("shard")),
        found(series_shard.join(expected, ["series_id", "shard"], "left_anti"), "extra in shard", F.col("shard")),
    ]
    if "expires_at_ms" in series.columns:
        parts.append(found(series.where(F.col("expires_at_ms") <= now_ms), "already expired", detail=F.col("expires_at_ms")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def repaired(series: DataFrame, samples: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """Catalog and shard members rebuilt from what is consistent."""
    kept = expire(series, now_ms) if "expires_at_ms" in series.columns else series
    one = kept.where(F.size("labels") > 0).groupBy("labels_key").agg(F.min("series_id").alias("series_id"))
    kept = kept.join(one, ["labels_key", "series_id"], "left_semi")
    return kept, shard_members(samples.join(kept.select("series_id"), "series_id", "left_semi"))

"""The driver's queries of catalog, storage, limits, virtual labels and flushes, with their SQL.

Most look at a store whose series are the users of the events table, with the user's number as the id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .model import LABELS, QueryContext, QueryError, Store, labels_key, with_labels
from .operators import catalog, mutable, rollup
from .operators.dedup import drop_expired, flush_time_s, hot_over_cold
from .operators.store import within
from .queries import DAY, END, HOUR, ORACLES, START, _flat, _mutable, _other, _with_tenant
from .sources import samples as S
from .sources.events import events_store
from .streaming.ingest import flush

MS = "epoch_us(ts) // 1000"
WEEK = "(epoch_us(ts) // 3600000000 // 168 * 168)::int"


def users_store(spark: SparkSession, sf_dir: str) -> Store:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    labels = F.create_map(F.lit("__name__"), F.lit("events"), F.lit("user_id"), F.col("series_id").cast("string")).cast(LABELS)
    series = rows.select(F.col("user_id").alias("series_id")).distinct().withColumn("labels", labels)
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    samples = rows.select(F.col("user_id").alias("series_id"), ms.alias("ts_ms"), "value", F.lit(False).alias("is_stale"))
    return Store(series=series, samples=samples, merged=True)


USER = "'__name__=\"events\",user_id=\"' || user_id || '\"'"
USERS = "u AS (SELECT DISTINCT user_id FROM events)"


def _kind(divisor: int, *rests: int):
    return F.pmod(F.col("series_id"), F.lit(divisor)).isin(*rests)


# -- consistency


@_other(
    "verify",
    f"""WITH {USERS}, m AS (SELECT DISTINCT user_id, {WEEK} AS shard FROM events), i AS (SELECT user_id, user_id % 10 AS r FROM u)
SELECT 'id without labels' AS "check", user_id AS series_id, shard, '-' AS detail FROM m WHERE user_id % 10 = 0
UNION ALL SELECT 'samples without labels', user_id, -1, '-' FROM i WHERE r = 0
UNION ALL SELECT 'empty labels', user_id, -1, '-' FROM i WHERE r = 1
UNION ALL SELECT 'labels with several ids', min(user_id), -1, '' FROM i WHERE r = 1 HAVING count(*) > 1
UNION ALL SELECT 'id with several label sets', user_id, -1, '2' FROM i WHERE r = 2
UNION ALL SELECT 'missing in shard', user_id, shard, '-' FROM m WHERE user_id % 10 = 3
UNION ALL SELECT 'extra in shard', user_id, 0, '-' FROM i WHERE r = 4
UNION ALL SELECT 'already expired', user_id, -1, '{END - 1}' FROM i WHERE r = 5""",
)
def _verify(spark, sf_dir):
    """A store with one fault for each last digit of the user's number."""
    store = users_store(spark, sf_dir)
    series = store.series.where(~_kind(10, 0)).drop("labels_key")
    second = series.where(_kind(10, 2)).withColumn("labels", F.map_concat("labels", F.create_map(F.lit("x"), F.lit("y")).cast(LABELS)))
    series = with_labels(series.unionByName(second), F.when(_kind(10, 1), F.create_map().cast(LABELS)).otherwise(F.col("labels")))
    series = series.withColumn("expires_at_ms", F.when(_kind(10, 5), F.lit(END - 1)).otherwise(F.lit(END + 1)))
    members = catalog.shard_members(store.samples)
    extra = store.series.where(_kind(10, 4)).select("series_id", F.lit(0).alias("shard"))
    found = catalog.verify(series, members.where(~_kind(10, 3)).unionByName(extra), store.samples, END)
    return found.withColumns({"shard": F.coalesce("shard", F.lit(-1)), "detail": F.coalesce("detail", F.lit("-"))})


@_other("verify_sound", "SELECT '' AS \"check\", 0::bigint AS series_id, 0 AS shard, '' AS detail WHERE false")
def _sound(spark, sf_dir):
    store = events_store(spark, sf_dir)
    return catalog.verify(store.series, catalog.shard_members(store.samples), store.samples, END)


@_other("repaired", f"SELECT DISTINCT user_id AS series_id, {WEEK} AS shard FROM events WHERE user_id % 10 NOT IN (1, 5)")
def _repaired(spark, sf_dir):
    store = users_store(spark, sf_dir)
    series = with_labels(store.series, F.when(_kind(10, 1), F.create_map().cast(LABELS)).otherwise(F.col("labels")))
    series = series.withColumn("expires_at_ms", F.when(_kind(10, 5), F.lit(END - 1)).otherwise(F.lit(END + 1)))
    return catalog.repaired(series, store.samples, END)[1]


# -- catalog


@_other("all_ids", f"SELECT DISTINCT user_id AS series_id FROM events WHERE {WEEK} BETWEEN {START // (168 * HOUR) * 168} AND {(START + 8 * DAY) // (168 * HOUR) * 168}")
def _all(spark, sf_dir):
    return catalog.all_ids(catalog.shard_members(users_store(spark, sf_dir).samples), START, START + 8 * DAY)


@_other("lookup_ids_known", f"WITH {USERS} SELECT {USER} AS labels, CASE WHEN user_id % 2 = 0 THEN user_id ELSE m + row_number() OVER (PARTITION BY user_id % 2 ORDER BY {USER}) END AS series_id, CASE WHEN user_id % 3 = 0 THEN 90 ELSE 60 END AS ttl_s FROM u, (SELECT max(user_id) AS m FROM u WHERE user_id % 2 = 0)")
def _lookup(spark, sf_dir):
    """Even users have ids, odd ones get new ones above; a third of the label sets are requested twice."""
    store = users_store(spark, sf_dir)
    asked = store.series.select("labels", F.lit(60).alias("ttl_s")).unionByName(store.series.where(_kind(3, 0)).select("labels", F.lit(90).alias("ttl_s")))
    ids, _ = catalog.lookup_ids(asked, store.series.where(_kind(2, 0)), 0)
    return ids.select(F.col("labels_key").alias("labels"), "series_id", "ttl_s")


@_other("expiry", f"WITH {USERS} SELECT user_id AS series_id, CASE WHEN user_id % 3 = 0 THEN {END + 120_000} WHEN user_id % 2 = 0 THEN {END + 1} ELSE 0 END AS expires_at_ms FROM u WHERE user_id % 3 = 0 OR user_id % 4 <> 1")
def _expiry(spark, sf_dir):
    """Writes renew every third series; what has expired goes, what never expires stays."""
    when = F.when(_kind(2, 0), F.lit(END + 1)).when(_kind(4, 1), F.lit(END - 1))
    series = users_store(spark, sf_dir).series.withColumn("expires_at_ms", when)
    written = series.where(_kind(3, 0)).select("series_id", F.explode(F.array(F.lit(60), F.lit(120))).alias("ttl_s"))
    return catalog.expire(catalog.refresh_expiry(series, written, END), END).select("series_id", F.coalesce("expires_at_ms", F.lit(0)).alias("expires_at_ms"))


@_other("delete_ids", f"SELECT user_id AS series_id, count(*) AS n FROM events WHERE user_id % 3 <> 1 GROUP BY user_id")
def _deleted(spark, sf_dir):
    store = users_store(spark, sf_dir)
    return catalog.delete_ids(store.samples, store.series.where(_kind(3, 1))).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))


@_other("drop_old_shards", f"SELECT DISTINCT user_id AS series_id, {WEEK} AS shard FROM events WHERE {WEEK}::bigint * 3600000 + {168 * HOUR} + {7 * DAY} > {END}")
def _old_shards(spark, sf_dir):
    return catalog.drop_old_shards(catalog.shard_members(users_store(spark, sf_dir).samples), END, 7 * DAY)


@_other("dump_by_expiration", f"WITH {USERS} SELECT user_id AS \"metricID\", {USER} AS labels, strftime(make_timestamp({START}000 + user_id * 3600000000), '%Y-%m-%dT%H:%M:%SZ') AS \"expirationDate\" FROM u WHERE user_id * {HOUR} >= {DAY} AND user_id * {HOUR} < {2 * DAY}")
def _dump_day(spark, sf_dir):
    series = users_store(spark, sf_dir).series.withColumn("expires_at_ms", F.lit(START) + F.col("series_id") * HOUR)
    return catalog.dump_by_expiration(series, START + DAY)


@_other("dump_by_shard", f"SELECT DISTINCT user_id AS \"metricID\", {USER} AS labels, '' AS \"expirationDate\" FROM events WHERE {WEEK} = {START // (168 * HOUR) * 168}")
def _dump_shard(spark, sf_dir):
    store = users_store(spark, sf_dir)
    return catalog.dump_by_shard(store.series, catalog.shard_members(store.samples), START // (168 * HOUR) * 168)


@_other("dump_by_posting", f"WITH {USERS} SELECT user_id AS \"metricID\", {USER} AS labels, '' AS \"expirationDate\" FROM u WHERE user_id = 7")
def _dump_posting(spark, sf_dir):
    return catalog.dump_by_posting(users_store(spark, sf_dir).series, "user_id", "7")


@_other("posting_members", f"SELECT DISTINCT {WEEK} AS shard, name, CASE name WHEN 'user_id' THEN user_id::varchar ELSE 'events' END AS value, user_id AS series_id FROM events, (SELECT unnest(['__name__', 'user_id']) AS name)")
def _members(spark, sf_dir):
    store = users_store(spark, sf_dir)
    return catalog.posting_members(store.series, catalog.shard_members(store.samples))


@_other("info_global", f"SELECT {WEEK} AS shard, count(DISTINCT user_id) AS n_series FROM events GROUP BY 1 UNION ALL SELECT -1, count(DISTINCT user_id) FROM events")
def _info(spark, sf_dir):
    store = users_store(spark, sf_dir)
    return catalog.info_global(store.series, catalog.shard_members(store.samples))


@_other("info_by_id", f"SELECT user_id AS series_id, {USER} AS labels, string_agg(DISTINCT {WEEK}, ',' ORDER BY {WEEK}) AS shards FROM events WHERE user_id = 7 GROUP BY user_id")
def _info_id(spark, sf_dir):
    store = users_store(spark, sf_dir)
    found = catalog.info_by_id(store.series, catalog.shard_members(store.samples), 7)
    return found.select("series_id", F.col("labels_key").alias("labels"), F.array_join(F.col("shards").cast("array<string>"), ",").alias("shards"))


@_other("csv_dump", f"WITH {USERS} SELECT user_id AS \"metricID\", {USER} AS labels, '' AS \"expirationDate\" FROM u")
def _csv(spark, sf_dir):
    return catalog.dump(users_store(spark, sf_dir).series)


# -- limits and errors


def _refused(spark: SparkSession, tries: dict) -> DataFrame:
    """(case, refused): whether each query is refused, when planned or when run."""
    rows = []
    for name, run in tries.items():
        try:
            run().write.format("noop").mode("overwrite").save()
            rows.append((name, False))
        except QueryError:
            rows.append((name, True))
        except Exception as e:  # raised by a task
            if "many-to-many" not in str(e) and "invalid label name" not in str(e):
                raise
            rows.append((name, True))
    return spark.createDataFrame(rows, "case string, refused boolean")


@_other("limits", f"""WITH n AS (SELECT count(DISTINCT event_type) AS s, count(*) FILTER ({MS} > {END - DAY} AND {MS} <= {END}) AS p FROM events)
SELECT 'series below' AS "case", s > 4 AS refused FROM n UNION ALL SELECT 'series at', s > s FROM n UNION ALL SELECT 'series of two selectors', s + 1 > s FROM n
UNION ALL SELECT 'points below', p > p - 1 FROM n UNION ALL SELECT 'points at', p > p FROM n UNION ALL SELECT 'points of two selectors', p + p > p FROM n UNION ALL SELECT 'no limit', false""")
def _limits(spark, sf_dir):
    """Selectors of one query count together; 0 is no limit."""
    store = events_store(spark, sf_dir)
    s, p = store.series.count(), within(store.samples, END - DAY, END).count()
    one, two = "sum_over_time(events[1d])", 'sum_over_time(events[1d]) + on(event_type) sum_over_time(events{event_type=~".+"}[1d])'
    run = lambda q, **c: lambda: Engine(store, QueryContext(**c)).query(q, END)
    return _refused(spark, {
        "series below": run(one, max_series=4), "series at": run(one, max_series=s), "series of two selectors": run(two, max_series=s),
        "points below": run(one, max_points=p - 1), "points at": run(one, max_points=p), "points of two selectors": run(two, max_points=p), "no limit": run(two),
    })


@_other("refusals", """SELECT unnest(['many to many', 'duplicate after on', 'matches everything', 'bad label name', 'one to one']) AS "case", unnest([true, true, true, true, false]) AS refused""")
def _refusals(spark, sf_dir):
    engine = Engine(events_store(spark, sf_dir, ("event_type", "user_id")), QueryContext(lookback_ms=7 * DAY))
    run = lambda q: lambda: engine.query(q, END)
    bad = spark.createDataFrame([({"a|b": "c"}, 1)], "labels map<string,string>, ts_ms long")
    return _refused(spark, {
        "many to many": run("events * on(event_type) events"), "duplicate after on": run("events * on(event_type) group_left events"), "matches everything": run('{event_type=~".*"}'),
        "bad label name": lambda: S.prepare_write(bad), "one to one": run("sum by(event_type) (events) * on(event_type) sum by(event_type) (events)"),
    })


# -- virtual labels

for _name, _op, _where in (("mutable_neq", "!=", "event_type NOT IN ('click', 'view')"), ("mutable_re", "=~", "event_type IN ('click', 'view', 'purchase')"), ("mutable_nre", "!~", "event_type IN ('view', 'purchase')")):

    @_other(_name, f"SELECT DISTINCT '__account_id=\"t\",__name__=\"events\",event_type=\"' || event_type || '\"' AS labels FROM events WHERE {_where}")
    def _matched(spark, sf_dir, op=_op):
        value = {"!=": "a", "=~": "[ab]", "!~": "a"}[op]
        engine = Engine(_with_tenant(spark, events_store(spark, sf_dir)), QueryContext(tenant="t"))
        found = engine.series([f'events{{group{op}"{value}"}}'])
        return found.select(labels_key(F.map_filter("labels", lambda k, _: k != "group")).alias("labels"))


@_other("mutable_label_values", "SELECT unnest(['a', 'b']) AS value")
def _virtual_values(spark, sf_dir):
    return Engine(_with_tenant(spark, events_store(spark, sf_dir)), QueryContext(tenant="t")).label_values("group")


@_other("mutable_label_names", "SELECT unnest(['__account_id', '__name__', 'event_type', 'group']) AS name")
def _virtual_names(spark, sf_dir):
    return Engine(_with_tenant(spark, events_store(spark, sf_dir)), QueryContext(tenant="t")).label_names()


@_other("mutable_changes", """SELECT * FROM (VALUES ('t', 'group', 'a', 'event_type', 'error'), ('t', 'group', 'c', 'event_type', 'signup'), ('t', 'group', 'c', 'event_type', 'view'))
  AS v(tenant, label_name, label_value, associated_label_name, associated_label_value)""")
def _changes(spark, sf_dir):
    """Values replaced, added and deleted, a name added and deleted; as CSV rows, read back once."""
    values = spark.createDataFrame([("t", "group", "a", ["error"]), ("t", "group", "c", ["view", "signup"])], mutable.VALUES)
    name = spark.createDataFrame([("t", "team", "user_id")], mutable.NAMES)
    gone = spark.createDataFrame([("t", "group", "b")], "tenant string, name string, value string")
    m = _mutable(spark).replace_values(values).delete_values(gone).replace_names(name).delete_names(name.select("tenant", "name"))
    return mutable.MutableLabels.from_csv_rows(m.to_csv_rows()).to_csv_rows()


# -- samples


@_other("hot_over_cold", f"""WITH h AS (SELECT user_id, {MS} AS t, value + 1 AS v FROM events WHERE user_id % 3 = 0 AND {MS} > {END - 5 * DAY}),
  f AS (SELECT user_id, min(t) AS first FROM h GROUP BY user_id)
SELECT e.user_id AS series_id, {MS} AS ts_ms, value FROM events e LEFT JOIN f USING (user_id) WHERE first IS NULL OR {MS} < first UNION ALL SELECT user_id, t, v FROM h""")
def _hot(spark, sf_dir):
    cold = users_store(spark, sf_dir).samples
    hot = cold.where(_kind(3, 0) & (F.col("ts_ms") > END - 5 * DAY)).withColumn("value", F.col("value") + 1)
    return hot_over_cold(cold, hot).select("series_id", "ts_ms", "value")


@_other("partition_scan", f"SELECT user_id AS series_id, {MS} AS ts_ms, value FROM events WHERE {MS} > {START} AND {MS} <= {START + 6 * DAY}")
def _pruned(spark, sf_dir):
    samples = users_store(spark, sf_dir).samples
    return within(samples.withColumn("base_day5", S.base_day5(F.col("ts_ms"))), START, START + 6 * DAY).select("series_id", "ts_ms", "value")


@_other("fixed_exchange", f"SELECT {USER} AS labels, {MS} AS ts_ms, value FROM events WHERE {MS} BETWEEN {START} AND {END}")
def _fixed(spark, sf_dir):
    store = users_store(spark, sf_dir)
    return S.from_fixed(S.to_fixed(store.samples, store.series), START, END).select(F.col("labels_key").alias("labels"), "ts_ms", "value")


@_other("nan_policy", f"SELECT {USER} AS labels, {MS} AS ts_ms, value FROM events WHERE event_id % 4 <> 0")
def _nan(spark, sf_dir):
    store = users_store(spark, sf_dir)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    samples = rows.select(F.col("user_id").alias("series_id"), ms.alias("ts_ms"), F.when(F.col("event_id") % 4 == 0, float("nan")).otherwise(F.col("value")).alias("value"), F.lit(False).alias("is_stale"))
    return S.from_fixed(S.to_fixed(samples, store.series, "drop_nan")).select(F.col("labels_key").alias("labels"), "ts_ms", "value")


@_other("json_import", f"SELECT {USER} AS labels, {MS} + 5 AS ts_ms, value FROM events")
def _json(spark, sf_dir):
    """Query results as JSON text, one for each series, read as samples; a label is left out and times are moved."""
    store = users_store(spark, sf_dir)
    point = F.array(F.format_string("%d.%03d", F.floor(F.col("ts_ms") / 1000), F.col("ts_ms") % 1000), F.col("value").cast("string"))
    points = store.samples.groupBy("series_id").agg(F.collect_list(point).alias("values")).join(store.series, "series_id")
    metric = F.map_concat("labels", F.create_map(F.lit("job"), F.lit("x")).cast(LABELS))
    text = points.select(F.to_json(F.struct(F.struct(F.array(F.struct(metric.alias("metric"), "values")).alias("result")).alias("data"))).alias("j"))
    parsed = text.select(F.from_json("j", S.QUERY_RESULT).alias("r")).select("r.*")
    return S.from_query_json(parsed, ("job",), 5).select(F.col("labels_key").alias("labels"), "ts_ms", "value")


@_other("write_prepared", f"SELECT '__account_id=\"me\",__name__=\"events\",user_id=\"' || user_id || '\"' AS labels, {MS} AS ts_ms, value FROM events WHERE {MS} + 864000000 > {END}")
def _prepared(spark, sf_dir):
    """Labels as a write stores them (tenant set, virtual and empty ones dropped), without what its time to live ends."""
    store = users_store(spark, sf_dir)
    added = F.create_map(F.lit("__account_id"), F.lit("other"), F.lit("group"), F.lit("a"), F.lit("none"), F.lit("")).cast(LABELS)
    rows = store.samples.join(store.series.select("series_id", F.map_concat("labels", added).alias("labels")), "series_id")
    written = drop_expired(S.prepare_write(rows, "me", "__account_id", ("group",)).withColumn("ttl_s", F.lit(864_000)), END)
    return written.select(F.col("labels_key").alias("labels"), "ts_ms", "value")


_LATER = "(first // 1000 + 86400)"
_FLUSH = f"""h AS (SELECT user_id, {MS} AS t, value AS v FROM events WHERE {MS} > {START} AND {MS} <= {START + 3 * DAY}), f AS (SELECT user_id, min(t) AS first, count(*) AS n FROM h GROUP BY user_id),
  d AS (SELECT user_id, {_LATER} - ({_LATER} + user_id % 86400) % 86400 AS due_s, n FROM f)"""


@_other("flush_time", f"WITH {_FLUSH} SELECT user_id AS series_id, due_s FROM d")
def _flush_time(spark, sf_dir):
    first = within(users_store(spark, sf_dir).samples, START, START + 3 * DAY).groupBy("series_id").agg(F.min("ts_ms").alias("first"))
    return first.select("series_id", flush_time_s(F.col("series_id"), F.floor(F.col("first") / 1000), 86_400).alias("due_s"))


@_other("flush", f"WITH {_FLUSH} SELECT user_id AS series_id, t AS ts_ms, v AS value, (due_s <= {START // 1000 + 2 * 86_400} AND t <= {START + DAY}) AS written FROM h JOIN d USING (user_id)")
def _flush(spark, sf_dir):
    """What a flush after two days writes, and what stays in the buffer: each sample is in one of them."""
    written: list[DataFrame] = []
    hot = within(users_store(spark, sf_dir).samples, START, START + 3 * DAY)
    left = flush(hot, "", START // 1000 + 2 * 86_400, 86_400, write=lambda df, _: written.append(df))
    columns = ("series_id", "ts_ms", "value")
    return written[0].select(*columns, F.lit(True).alias("written")).unionByName(left.select(*columns, F.lit(False).alias("written")))


# -- rollups


@_other("rollup_forced", f"WITH b AS (SELECT event_type AS k, epoch_us(ts) // 300000000 * 300000 AS ts, avg(value) AS m FROM events GROUP BY ALL) SELECT 'event_type=\"' || k || '\"' AS labels, {END} AS step_ms, round(sum(m), 6) AS value FROM b WHERE ts > {END} - {DAY} AND ts <= {END} GROUP BY k")
def _forced(spark, sf_dir):
    """One step reads raw samples, unless the request asks for the rollup."""
    store = events_store(spark, sf_dir)
    rolled = Store(series=store.series, samples=store.samples, rollup=rollup.rollup(store.samples), rollup_until_ms=END - DAY // 2)
    return _flat(Engine(rolled, QueryContext(force_rollup=True)).query("sum_over_time(events[1d])", END))


@_other("rollup_force_raw", ORACLES["sum_over_time"])
def _raw(spark, sf_dir):
    store = events_store(spark, sf_dir)
    rolled = Store(series=store.series, samples=store.samples, merged=True, rollup=rollup.rollup(store.samples), rollup_until_ms=END)
    return _flat(Engine(rolled, QueryContext(force_raw=True)).query_range("sum_over_time(events[1d])", START, END, DAY))


@_other("rollup_with_function", f"SELECT user_id AS series_id, {MS} // 3600000 * 3600000 AS ts_ms, max(value) AS value FROM events GROUP BY ALL")
def _with_function(spark, sf_dir):
    return rollup.with_function(users_store(spark, sf_dir).samples, "rate", HOUR).select("series_id", "ts_ms", "value")


@_other("rollup_selected_days", f"SELECT user_id AS series_id, {MS} // 300000 * 300000 AS bucket_ms, {MS} // {DAY} * {DAY} AS day_ms, min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg, count(*)::double AS cnt FROM events WHERE user_id % 5 = 1 AND {MS} >= {START} AND {MS} < {START + 3 * DAY} GROUP BY ALL")
def _days(spark, sf_dir):
    """Whole days again, for the series that matchers choose."""
    store = users_store(spark, sf_dir)
    return rollup.rollup_days(store.samples, START + HOUR, START + 2 * DAY + HOUR, store.series.where(_kind(5, 1))).withColumn("avg", F.round("avg", 6))


@_other("rollup_merge", f"SELECT user_id AS series_id, {MS} // {DAY} * {DAY} AS bucket_ms, min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg, count(*)::double AS cnt FROM events GROUP BY ALL")
def _merge(spark, sf_dir):
    """Two parts of each bucket as one."""
    samples = users_store(spark, sf_dir).samples
    parts = [rollup.rollup(samples.where(c), DAY) for c in (F.col("ts_ms") % 2 == 0, F.col("ts_ms") % 2 == 1)]
    return rollup.merge(parts[0].unionByName(parts[1])).withColumn("avg", F.round("avg", 6))

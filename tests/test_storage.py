import json
import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from helpers import T0, at, over, store
from pyspark.sql import functions as F

from seriesforge import queries
from seriesforge.engine import Engine, clamp_range
from seriesforge.model import LABELS, QueryContext, QueryError, Store, labels_key
from seriesforge.operators import catalog, dedup, rollup
from seriesforge.operators.mutable import MutableLabels
from seriesforge.plans.matchers import Matcher
from seriesforge.sources import samples as S
from seriesforge.sources.write import write_request
from seriesforge.sources.wide import from_wide, to_wide
from seriesforge.streaming.ingest import flush, start_rollup

NAN = math.nan
SCHEMA = "series_id long, ts_ms long, value double, is_stale boolean"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, float(v), len(r) > 3) for r in rows for i, t, v in [r[:3]]], SCHEMA)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_rollup_fixture(spark):
    got = rollup.rollup(frame(spark, [(1, 100_000 * k, 100 * (k + 1)) for k in range(5)]), 200_000)
    assert rows(got, "bucket_ms", "min", "max", "avg", "cnt") == [(0, 100, 200, 150, 2), (200_000, 300, 400, 350, 2), (400_000, 500, 500, 500, 1)]


def test_rollup_nan_rules(spark):
    got = rollup.rollup(frame(spark, [(1, 0, NAN, "stale"), (2, 0, NAN), (2, 1, 5), (2, 2, NAN, "stale"), (3, 0, NAN)]))
    by_id = {r["series_id"]: r for r in got.collect()}
    assert set(by_id) == {2, 3}
    assert (by_id[2]["min"], by_id[2]["max"], by_id[2]["cnt"]) == (5, 5, 2) and math.isnan(by_id[2]["avg"])
    assert math.isnan(by_id[3]["min"]) and math.isnan(by_id[3]["max"]) and by_id[3]["cnt"] == 1


def test_rollup_days_and_merge(spark):
    s = frame(spark, [(1, 0, 1), (1, 86_399_999, 3), (1, 86_400_000, 9), (2, 5, 7)])
    assert rows(rollup.rollup_days(s, 10, 10), "series_id", "bucket_ms", "day_ms") == [(1, 0, 0), (1, 86_100_000, 0), (2, 0, 0)]
    assert rows(rollup.rollup_shard(s, 0, 0, 2), "series_id") == [(2,)]
    assert not rollup.due_days(0, 86_400_000 + 8 * 3_600_000) and rollup.due_days(0, 86_400_001 + 8 * 3_600_000)
    halves = rollup.rollup(s.where("ts_ms < 10")).unionByName(rollup.rollup(frame(spark, [(1, 20, 4)])))
    assert rows(rollup.merge(halves).where("series_id = 1"), "min", "max", "avg", "cnt") == [(1, 4, 2.5, 2)]


def test_rollup_equals_raw(spark):
    points = [(T0 - T0 % 300_000 + 10_000 * k, (k * 13) % 31) for k in range(360)]
    raw = store(spark, ({"__name__": "cpu"}, points))
    end = points[-1][0] - points[-1][0] % 300_000
    rolled = Store(series=raw.series, samples=raw.samples, rollup=rollup.rollup(raw.samples), rollup_until_ms=end - 900_000)
    for f in ("min", "max", "count", "avg"):
        a = over(raw, f"{f}_over_time(cpu[30m])", end - 600_000, end - 300_000, 300_000)
        b = over(rolled, f"{f}_over_time(cpu[30m])", end - 600_000, end - 300_000, 300_000)
        assert set(a) == set(b)
        if f in ("min", "max"):
            assert all(abs(a[k] - b[k]) <= 1 for k in a)
    forced = at(rolled, "max_over_time(cpu[30m])", end, force_rollup=True)
    assert forced and at(rolled, "max_over_time(cpu[30m])", end, force_rollup=True, force_raw=True) == at(raw, "max_over_time(cpu[30m])", end)


def test_dedup_last_number(spark):
    df = spark.createDataFrame([(1, 0, 1.0, False, 1), (1, 0, 2.0, False, 2), (1, 0, NAN, False, 3), (1, 5, NAN, False, 1)], SCHEMA + ", seq int")
    got = {r["ts_ms"]: r["value"] for r in dedup.dedup_samples(df, "seq").collect()}
    assert got[0] == 2.0 and math.isnan(got[5])


def test_flush_times(spark):
    got = spark.range(1).select(dedup.flush_time_s(F.lit(7), F.lit(1000), 900)).first()[0]
    assert got == 1900 - (1900 + 7) % 900


def test_ttl(spark):
    df = frame(spark, [(1, 0, 1), (1, 5000, 2)]).withColumn("ttl_s", F.lit(5))
    assert rows(dedup.drop_expired(df, 7000), "ts_ms") == [(5000,)]
    assert dedup.drop_expired(df.withColumn("ttl_s", F.lit(0)), 10**12).count() == 2


@pytest.fixture(scope="module")
def virtual(spark):
    names = spark.createDataFrame([("1234", "group", "instance"), ("1234", "environment", "instance"), ("5678", "group", "instance")], "tenant string, name string, associated_name string")
    values = spark.createDataFrame(
        [("1234", "group", "group1", ["server1", "server2", "server3"]), ("1234", "group", "group2", ["server2", "server3"]), ("1234", "group", "group3", ["server4"]), ("1234", "environment", "prod", ["server4"]), ("5678", "group", "group10", ["server10", "server11"])],
        "tenant string, name string, value string, associated_values array<string>",
    )
    return MutableLabels(names, values)


@pytest.mark.parametrize(("given", "want"), [
    (Matcher("group", "=", "group1"), Matcher("instance", "=~", "server1|server2|server3")),
    (Matcher("group", "!=", "group3"), Matcher("instance", "!~", "server4")),
    (Matcher("group", "=~", "group(1|2)"), Matcher("instance", "=~", "server1|server2|server3|server2|server3")),
    (Matcher("group", "!~", "group1"), Matcher("instance", "=~", "server2|server3|server4")),
    (Matcher("other", "=", "x"), Matcher("other", "=", "x")),
])
def test_virtual_matchers(virtual, given, want):
    assert virtual.rewrite([given], "1234") == [want]
    assert virtual.rewrite([given], None) == [given]


def test_virtual_queries(spark, virtual):
    s = store(spark, *(({"__name__": "m", "__account_id": "1234", "instance": f"server{i}"}, [(T0, i)]) for i in range(1, 6)))
    s.mutable = virtual
    e = Engine(s, QueryContext(tenant="1234"))
    got = {r["labels"]["instance"]: dict(r["labels"]) for r in e.query('m{group=~"group2|group3"}', T0).collect()}
    assert set(got) == {"server2", "server3", "server4"}
    assert got["server2"]["group"] == "group1" and "environment" not in got["server2"]
    assert got["server4"]["group"] == "group3" and got["server4"]["environment"] == "prod"
    assert e.query('m{group="none"}', T0).count() == 0
    assert [r[0] for r in e.label_values("group").collect()] == ["group1", "group2", "group3"]
    assert {"group", "environment", "instance"} <= {r[0] for r in e.label_names().collect()}


def test_virtual_changes(spark, virtual):
    again = MutableLabels.from_csv_rows(virtual.to_csv_rows())
    assert rows(again.names, "tenant", "name", "associated_name") == rows(virtual.names, "tenant", "name", "associated_name")
    assert again.sets("1234", "group") == virtual.sets("1234", "group")
    new = virtual.replace_values(spark.createDataFrame([("1234", "group", "group1", ["x"])], virtual.values.schema))
    assert new.sets("1234", "group")["group1"] == ["x"]
    with pytest.raises(Exception, match="empty"):
        virtual.replace_values(spark.createDataFrame([("1234", "group", "", ["x"])], virtual.values.schema)).values.collect()
    assert "group1" not in virtual.delete_values(spark.createDataFrame([("1234", "group", "group1")], "tenant string, name string, value string")).sets("1234", "group")
    assert virtual.delete_names(spark.createDataFrame([("1234", "group")], "tenant string, name string")).name_map("1234") == {"environment": "instance"}


def test_label_text(spark):
    df = spark.createDataFrame([({"b": 'q"\\\n', "a": "1", "c": ""},), ({},)], "labels map<string,string>")
    assert [r[0] for r in df.select(labels_key(F.col("labels"))).collect()] == ['a="1",b="q\\"\\\\\\n"', ""]


def test_catalog(spark):
    s = store(spark, ({"__name__": "m", "a": "1"}, [(0, 1)]), ({"__name__": "m", "a": "2", "b": "x"}, [(8 * 86_400_000, 1)]))
    shards = catalog.shard_members(s.samples)
    assert rows(shards, "series_id", "shard") == [(1, 0), (2, 168)]
    assert rows(catalog.in_shards(s.series, shards, 0, 3_600_000), "series_id") == [(1,)]
    assert rows(catalog.all_ids(shards, 0, 9 * 86_400_000), "series_id") == [(1,), (2,)]
    assert [r[0] for r in Engine(s).label_values("a", [Matcher("b", "=", "")]).collect()] == ["1"]
    assert [r[0] for r in Engine(s).label_names().collect()] == ["__name__", "a", "b"]
    for bad in ("", "a|b"):
        with pytest.raises(QueryError):
            Engine(s).label_values(bad)
    assert rows(Engine(s).series(["m", 'm{a="1"}'], 0, 10), "series_id") == [(1,)]
    asked = spark.createDataFrame([({"__name__": "m", "a": "1"}, 60), ({"__name__": "m", "a": "3"}, 60), ({"__name__": "m", "a": "3", "z": ""}, 90), ({"__name__": "l"}, 60)], "labels map<string,string>, ttl_s int")
    ids, new = catalog.lookup_ids(asked, s.series, 1000)
    assert rows(ids, "labels_key", "series_id", "ttl_s") == [('__name__="l"', 3, 60), ('__name__="m",a="1"', 1, 60), ('__name__="m",a="3"', 4, 90)]
    assert rows(new, "series_id", "expires_at_ms") == [(3, 61_000), (4, 91_000)]
    assert rows(catalog.expire(new, 61_000), "series_id") == [(4,)]
    renewed = catalog.refresh_expiry(new, spark.createDataFrame([(3, 100)], "series_id long, ttl_s int"), 1000)
    assert rows(renewed, "series_id", "expires_at_ms") == [(3, 101_000), (4, 91_000)]
    assert rows(catalog.delete_ids(s.series, spark.createDataFrame([(1,)], "series_id long")), "series_id") == [(2,)]
    assert rows(catalog.drop_old_shards(shards, 8 * 86_400_000, 86_400_000), "shard") == [(168,)]
    assert rows(catalog.postings(s.series, shards), "shard", "name", "value", "n")[0] == (0, "__name__", "m", 1)
    assert rows(catalog.dump(new), "metricID", "expirationDate") == [(3, "1970-01-01T00:01:01Z"), (4, "1970-01-01T00:01:31Z")]
    assert catalog.dump_by_posting(s.series, "b").count() == 1 and catalog.dump_by_shard(s.series, shards, 0).count() == 1 and catalog.dump_by_expiration(new, 0).count() == 2
    assert rows(catalog.info_global(s.series, shards), "shard", "n_series") == [(-1, 2), (0, 1), (168, 1)]
    assert catalog.info_by_id(s.series, shards, 2).first()["shards"] == [168]
    assert catalog.verify(s.series, shards, s.samples, 0).count() == 0
    broken = catalog.verify(s.series.where("series_id = 1"), shards.where("series_id = 2"), s.samples, 0)
    assert {r["check"] for r in broken.collect()} == {"id without labels", "samples without labels", "missing in shard"}
    kept, fixed = catalog.repaired(s.series, s.samples, 0)
    assert catalog.verify(kept, fixed, s.samples, 0).count() == 0
    assert clamp_range(0, 10**15) == (31_536_000_000, 32_503_680_000_000)


def test_wide_and_fixed_round_trip(spark, tmp_path):
    s = store(spark, ({"__name__": "m", "q": 'a"b'}, [(0, 1), (5, NAN)]), ({"__name__": "n"}, [(5, 2), (9, NAN, True)]))
    wide = to_wide(s.samples, s.series)
    wide.write.parquet(str(tmp_path / "w"))
    back = from_wide(spark.read.parquet(str(tmp_path / "w")))
    assert sorted((r["labels_key"], r["ts_ms"]) for r in back.collect()) == [('__name__="m",q="a\\"b"', 0), ('__name__="m",q="a\\"b"', 5), ('__name__="n"', 5), ('__name__="n"', 9)]
    assert to_wide(s.samples, s.series, "drop_all").count() == 2 and to_wide(s.samples, s.series, "drop_stale").count() == 2
    assert from_wide(spark.read.parquet(str(tmp_path / "w")), start_ms=6).count() == 1
    with pytest.raises(QueryError):
        from_wide(spark.createDataFrame([(0, 1)], "timestamp long, `{a=\"b\"}` int"))
    fixed = S.to_fixed(s.samples, s.series)
    fixed.write.parquet(str(tmp_path / "f"))
    assert S.from_fixed(spark.read.parquet(str(tmp_path / "f")), end_ms=5).count() == 3
    assert S.export_batches(0, 25, 10) == [(0, 10), (10, 20), (20, 25)]


@pytest.fixture(scope="module")
def repeated_events(spark, tmp_path_factory):
    """A folder with events of one type and time; one row is there twice."""
    path = tmp_path_factory.mktemp("repeated")
    day = 1_704_160_000_000_000
    events = [(1, day, "click", 10.0), (2, day, "click", 30.0), (3, day + 1, "click", 20.0), (4, day, "view", 5.0), (5, day + 1000, "click", 7.0), (6, day + 7000, "error", 1.0), (6, day + 7000, "error", 1.0)]
    frame = spark.createDataFrame(events, "event_id long, us long, event_type string, value double")
    frame.selectExpr("event_id", "timestamp_micros(us) AS ts", "event_id AS user_id", "event_type", "value").coalesce(1).write.parquet(str(path / "events.parquet"))
    return str(path)


def by_sql(name, path):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet/*.parquet'")
    found = c.sql(queries.ORACLES[name])
    return found.columns, sorted(found.fetchall(), key=repr)


def by_spark(name, path, spark):
    found = queries.QUERIES[name](spark, path)
    return found.columns, sorted((tuple(r) for r in found.collect()), key=repr)


def test_long_from_wide_of_repeated_times(spark, repeated_events):
    assert by_spark("long_from_wide", repeated_events, spark) == by_sql("long_from_wide", repeated_events)


def test_merged_read_of_repeated_times(spark, repeated_events):
    assert by_spark("merged_read", repeated_events, spark) == by_sql("merged_read", repeated_events)


def test_points_of_one_time(spark):
    cold = spark.createDataFrame([(1, 0, 1.0, False, "a"), (1, 0, 2.0, False, "b"), (1, 0, NAN, False, "a"), (1, 9, 3.0, False, "a")], SCHEMA + ", point string")
    s = Store(series=spark.createDataFrame([(1, {"__name__": "m"})], "series_id long, labels map<string,string>"), samples=cold)
    assert rows(Engine(s).read(["m"], 0, 9), "ts_ms", "value") == [(0, 1), (0, 2), (9, 3)]
    s.hot = spark.createDataFrame([(1, 5, 7.0, False, "a"), (1, 5, 8.0, False, "a"), (1, 5, 4.0, False, "b")], cold.schema)
    assert rows(Engine(s).read(["m"], 0, 9), "ts_ms", "value") == [(0, 1), (0, 2), (5, 4), (5, 8)]
    s.hot = s.hot.drop("point")  # told apart in one part only: merged by time
    assert rows(Engine(s).read(["m"], 0, 9), "ts_ms", "value") == [(0, 2), (5, 8)]


def test_wide_export_of_repeated_times(spark, repeated_events):
    assert by_spark("wide_export", repeated_events, spark) == by_sql("wide_export", repeated_events)
    s = store(spark, ({"__name__": "m"}, [(0, 2), (0, 3), (0, 1), (5, 2), (5, NAN)]), ({"__name__": "n"}, [(0, 4)]))
    for samples in (s.samples.orderBy("value"), s.samples.orderBy(F.desc("value"))):
        first, second = to_wide(samples.coalesce(1), s.series).orderBy("timestamp").collect()
        assert tuple(first) == (0, 3, 4) and math.isnan(second[1]) and second[2] is None


def test_stale_bits_and_write(spark, tmp_path):
    bits = np.array([0x3FF0000000000000, 0x7FF8000000000001, S.STALE_BITS], "<u8")
    pq.write_table(pa.table({"ts_ms": [0, 1, 2], "value": bits.view("<f8")}), tmp_path / "s.parquet")
    assert [r["is_stale"] for r in S.mark_stale(spark.read.parquet(str(tmp_path / "s.parquet"))).orderBy("ts_ms").collect()] == [False, False, True]
    ingest = spark.createDataFrame([({"__name__": "m", "e": "", "group": "g", "__account_id": "9"},)], "labels map<string,string>")
    assert S.prepare_write(ingest, "7", virtual=("group",)).first()["labels_key"] == '__account_id="7",__name__="m"'
    with pytest.raises(Exception, match="invalid label"):
        S.prepare_write(spark.createDataFrame([({"a|b": "c"},)], "labels map<string,string>")).collect()
    S.write_samples(frame(spark, [(1, 0, 1), (1, 6 * 86_400_000, 2)]), str(tmp_path / "p"))
    stored = S.read_samples(spark, str(tmp_path / "p"))
    assert rows(stored, "ts_ms", "base_day5") == [(0, 0), (6 * 86_400_000, 5 * 86_400_000)]
    base = store(spark, ({"__name__": "m"}, [(0, 0)]))
    assert at(Store(series=base.series, samples=stored), "m", 6 * 86_400_000) == {'__name__="m"': 2.0}
    S.write_rollup(rollup.rollup(stored), str(tmp_path / "r"))
    S.write_rollup(rollup.rollup(stored), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2


def test_query_json(spark, tmp_path):
    body = {"status": "success", "data": {"resultType": "matrix", "result": [{"metric": {"__name__": "m", "x": "y"}, "values": [[1.5, "2"], [2, "NaN"], [3, "+Inf"]]}, {"metric": {"a": "b"}, "value": [4, "5"]}]}}
    (tmp_path / "q.json").write_text(json.dumps(body))
    got = S.read_query_json(spark, str(tmp_path / "q.json"), ignore_labels=("x",), add_ms=1000).orderBy("ts_ms").collect()
    assert [(r["labels_key"], r["ts_ms"]) for r in got] == [('__name__="m"', 2500), ('__name__="m"', 3000), ('__name__="m"', 4000), ('a="b"', 5000)]
    assert got[0]["value"] == 2.0 and math.isnan(got[1]["value"]) and got[2]["value"] == math.inf


def test_streaming_rollup_equals_batch(spark, tmp_path):
    rows_ = [(i % 3, T0 + 40_000 * i, float(i % 7)) for i in range(200)]
    base = spark.createDataFrame(rows_, "series_id long, ts_ms long, value double").select("series_id", F.timestamp_millis("ts_ms").alias("ts"), "value", F.lit(False).alias("is_stale"))
    base.write.parquet(str(tmp_path / "in"))
    last = spark.createDataFrame([(9, T0 + 10**9, 0.0)], "series_id long, ts_ms long, value double").select("series_id", F.timestamp_millis("ts_ms").alias("ts"), "value", F.lit(False).alias("is_stale"))
    stream = lambda: spark.readStream.schema(base.schema).parquet(str(tmp_path / "in"))
    start_rollup(stream(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    last.write.mode("append").parquet(str(tmp_path / "in"))  # moves the watermark past all others
    start_rollup(stream(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    batch = rollup.rollup(base.select("series_id", F.unix_millis("ts").alias("ts_ms"), "value", "is_stale"))
    columns = ("series_id", "bucket_ms", "min", "max", "avg", "cnt")
    assert rows(spark.read.parquet(str(tmp_path / "out")), *columns) == rows(batch, *columns)


def test_flush(spark, tmp_path):
    hot = spark.createDataFrame([(1, 1000 * k, float(k), False, k) for k in range(10)] + [(1, 0, 99.0, False, 50)], SCHEMA + ", seq long")
    left = flush(hot, str(tmp_path / "cold"), now_s=2000, batch_s=1995)
    assert rows(S.read_samples(spark, str(tmp_path / "cold")), "ts_ms", "value")[0] == (0, 99.0)
    assert rows(left, "ts_ms") == [(t,) for t in (6000, 7000, 8000, 9000)]


def test_two_flushes_equal_one(spark, tmp_path):
    """A sample reaches the cold store once; a flush that is run again is merged on read."""
    hot = spark.createDataFrame([(1, 1000 * k, float(k), False, k) for k in range(10)], SCHEMA + ", seq long")
    left = flush(hot, str(tmp_path / "cold"), now_s=2000, batch_s=1995)
    left = spark.createDataFrame(left.collect(), hot.schema)
    assert flush(left, str(tmp_path / "cold"), now_s=5000, batch_s=1995).count() == 0
    stored = S.read_samples(spark, str(tmp_path / "cold"))
    assert rows(stored, "ts_ms") == [(1000 * k,) for k in range(10)]
    flush(left, str(tmp_path / "cold"), now_s=5000, batch_s=1995)
    base = store(spark, ({"__name__": "m"}, [(0, 0)]))
    assert at(Store(series=base.series, samples=S.read_samples(spark, str(tmp_path / "cold"))), "count_over_time(m[1h])", 10_000) == {"": 10.0}


def test_write_request(spark, tmp_path):
    now, path = 10**12, str(tmp_path / "w")
    known = spark.createDataFrame([(7, {"__name__": "m", "a": "1", "__account_id": "t"})], "series_id long, labels map<string,string>").withColumn("labels_key", labels_key(F.col("labels")))
    one, two, three = {"__name__": "m", "a": "1", "group": "g"}, {"__name__": "m", "a": "1"}, {"__name__": "m", "a": "2", "__account_id": "other"}
    request = spark.createDataFrame([(one, now, 1.0, False), (two, now, NAN, False), (two, now - 5000, 2.0, False), (three, now, 3.0, False), (three, now - 10**7, 4.0, False), (three, now + 10**7, 5.0, False)], "labels map<string,string>, ts_ms long, value double, is_stale boolean")
    with pytest.raises(QueryError):
        write_request(request, known, path, now, read_only=True)
    new = write_request(request, known, path, now, tenant="t", virtual=("group",), ttl_s=3600, most_future_ms=1000)
    assert rows(new, "series_id", "labels_key", "expires_at_ms") == [(8, '__account_id="t",__name__="m",a="2"', now + 3_600_000)]
    assert rows(S.read_samples(spark, path), "series_id", "ts_ms", "value") == [(7, now - 5000, 2.0), (7, now, 1.0), (8, now, 3.0)]
    series = known.select("series_id", "labels").unionByName(new.select("series_id", "labels"))
    got = Engine(Store(series=series, samples=S.read_samples(spark, path)), QueryContext(tenant="t")).read(['m{a="1"}'], now - 5000, now)
    assert rows(got, "series_id", "ts_ms", "value") == [(7, now - 5000, 2.0), (7, now, 1.0)]


def test_numbers_are_dense_and_stable(spark):
    keys = spark.createDataFrame([(f"k{i * 7919 % 10007:05d}",) for i in range(5000)], "labels_key string").repartition(7)
    first, again = (rows(catalog.number_rows(keys.repartition(n), "labels_key", 100), "labels_key", "series_id") for n in (3, 11))
    assert first == again and [r[1] for r in first] == list(range(100, 5100))


def test_entry_and_oracles(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_labels_type():
    assert LABELS.simpleString() == "map<string,string>"


def test_posting_members(spark):
    """The ids of each posting, one row each; postings has their numbers."""
    series = spark.createDataFrame([(1, {"__name__": "m", "a": "1"}), (2, {"__name__": "m", "b": "x"})], "series_id long, labels map<string,string>")
    shards = spark.createDataFrame([(1, 0), (2, 0), (2, 168)], "series_id long, shard int")
    want = [(0, "__name__", "m", 1), (0, "__name__", "m", 2), (0, "a", "1", 1), (0, "b", "x", 2), (168, "__name__", "m", 2), (168, "b", "x", 2)]
    assert rows(catalog.posting_members(series, shards), "shard", "name", "value", "series_id") == want
    assert rows(catalog.postings(series, shards), "shard", "name", "value", "n") == [(0, "__name__", "m", 2), (0, "a", "1", 1), (0, "b", "x", 1), (168, "__name__", "m", 1), (168, "b", "x", 1)]

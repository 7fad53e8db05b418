import math

import pytest
from helpers import T0, at, store

from seriesforge.model import QueryError

NAN, INF = math.nan, math.inf


@pytest.fixture(scope="module")
def demo(spark):
    rows = [("a", "x", 10), ("a", "y", 4), ("b", "x", 7), ("b", "y", NAN)]
    cpus = [({"__name__": "cpus", "inst": i}, [(T0, n)]) for i, n in (("a", 2), ("b", 5))]
    return store(spark, *(({"__name__": "mem", "inst": i, "type": t}, [(T0 - 1000, v)]) for i, t, v in rows), *cpus)


def close(a, b):
    return (math.isnan(a) and math.isnan(b)) or math.isclose(a, b)


def same(got, want):
    return set(got) == set(want) and all(close(got[k], want[k]) for k in want)


def test_aggregations(demo):
    assert same(at(demo, "sum by(inst) (mem)"), {'inst="a"': 14, 'inst="b"': NAN})
    assert same(at(demo, "max(mem)"), {"": 10}) and same(at(demo, "min(mem)"), {"": 4})
    assert same(at(demo, "count without(type) (mem)"), {'inst="a"': 2, 'inst="b"': 2})
    assert same(at(demo, "group by(nothing) (mem)"), {"": 1})
    assert same(at(demo, 'stdvar(mem{inst="a"})'), {"": 9}) and same(at(demo, 'stddev(mem{inst="a"})'), {"": 3})
    assert same(at(demo, "quantile(0.5, cpus)"), {"": 3.5})
    assert at(demo, "sum(nothing)") == {}
    assert same(at(demo, "topk(2, mem)"), {'__name__="mem",inst="a",type="x"': 10, '__name__="mem",inst="b",type="x"': 7})
    assert same(at(demo, "bottomk by(inst) (1, mem)"), {'__name__="mem",inst="a",type="y"': 4, '__name__="mem",inst="b",type="x"': 7})
    assert same(at(demo, 'count_values("v", mem)'), {'v="10"': 1, 'v="4"': 1, 'v="7"': 1, 'v="NaN"': 1})
    assert same(at(demo, "avg(max by(type) (mem))"), {"": 7.0})
    assert same(at(demo, "sum by(type) (mem) - sum by(type) (mem)"), {'type="x"': 0, 'type="y"': NAN})


def test_float_text(spark):
    values = [1e20, 0.1, 1.5e-7, -0.25, INF, 123456789.0]
    s = store(spark, *(({"__name__": "m", "i": str(i)}, [(T0, v)]) for i, v in enumerate(values)))
    keys = {k.split('v="')[1][:-1] for k in at(s, 'count_values("v", m)')}
    assert {"0.1", "0.00000015", "-0.25", "+Inf", "123456789"} <= keys


def test_arithmetic(demo):
    assert same(at(demo, "1 * 2 + 4 / 6 - 10 % 2 ^ 2"), {"": 2 + 4 / 6 - 2})
    assert same(at(demo, "-1 ^ 2"), {"": -1}) and same(at(demo, "0x3d"), {"": 61})
    assert same(at(demo, "cpus / 0"), {'inst="a"': INF, 'inst="b"': INF}) and same(at(demo, "-cpus / 0"), {'inst="a"': -INF, 'inst="b"': -INF})
    assert same(at(demo, "0 / 0"), {"": NAN}) and same(at(demo, "cpus % 0"), {'inst="a"': NAN, 'inst="b"': NAN})
    assert same(at(demo, "2 ^ cpus"), {'inst="a"': 4, 'inst="b"': 32}) and same(at(demo, "cpus * NaN"), {'inst="a"': NAN, 'inst="b"': NAN})
    assert same(at(demo, "1 - time()"), {"": 1 - T0 / 1000})
    assert same(at(demo, "cpus * scalar(sum(cpus))"), {'inst="a"': 14, 'inst="b"': 35})
    assert same(at(demo, "scalar(cpus) + 1"), {"": NAN})


def test_comparisons(demo):
    assert same(at(demo, "cpus > 3"), {'__name__="cpus",inst="b"': 5}) and same(at(demo, "3 < bool cpus"), {'inst="a"': 0, 'inst="b"': 1})
    assert same(at(demo, "3 < cpus"), {'__name__="cpus",inst="b"': 5})
    assert len(at(demo, "mem == mem")) == 3 and len(at(demo, "mem != mem")) == 1  # NaN is no equal of NaN
    assert same(at(demo, "mem > bool 0"), {'inst="a",type="x"': 1, 'inst="a",type="y"': 1, 'inst="b",type="x"': 1, 'inst="b",type="y"': 0})
    with pytest.raises(QueryError):
        at(demo, "1 > 2")


def test_matching(demo):
    assert same(at(demo, 'mem{type="x"} / on(inst) cpus'), {'inst="a"': 5, 'inst="b"': 7 / 5})
    assert same(at(demo, 'mem{type="x"} / ignoring(type) cpus'), {'inst="a"': 5, 'inst="b"': 7 / 5})
    assert same(at(demo, 'mem / on(inst) group_left cpus'), {'inst="a",type="x"': 5, 'inst="a",type="y"': 2, 'inst="b",type="x"': 7 / 5, 'inst="b",type="y"': NAN})
    assert same(at(demo, 'cpus * on(inst) group_right mem{type="x"}'), {'inst="a",type="x"': 20, 'inst="b",type="x"': 35})
    assert same(at(demo, 'cpus * on(inst) group_left(type) mem{type="x"}'), {'inst="a",type="x"': 20, 'inst="b",type="x"': 35})
    assert same(at(demo, 'mem / on(inst, type, __name__) mem'), {'inst="a",type="x"': 1, 'inst="a",type="y"': 1, 'inst="b",type="x"': 1, 'inst="b",type="y"': NAN})
    for bad in ("mem / on(inst) cpus", "cpus / on(inst) mem", "cpus / on(inst) group_left mem"):
        with pytest.raises(Exception, match="many-to-many"):
            at(demo, bad)


def test_sets(demo):
    assert set(at(demo, 'mem and on(inst) cpus{inst="a"}')) == {'__name__="mem",inst="a",type="x"', '__name__="mem",inst="a",type="y"'}
    assert set(at(demo, 'cpus unless cpus{inst="a"}')) == {'__name__="cpus",inst="b"'}
    assert same(at(demo, 'cpus{inst="a"} or cpus'), at(demo, "cpus"))


def test_functions(demo, spark):
    s = store(spark, *(({"__name__": "m", "i": str(i)}, [(T0, v)]) for i, v in enumerate((-2.5, 2.5, 0, NAN, INF))))
    f = lambda q: [at(s, q).get(f'i="{i}"') for i in range(5)]
    for q, want in {
        "round(m)": (-2, 3, 0, NAN, INF), "floor(m)": (-3, 2, 0, NAN, INF), "ceil(m)": (-2, 3, 0, NAN, INF), "abs(m)": (2.5, 2.5, 0, NAN, INF),
        "ln(m)": (NAN, math.log(2.5), -INF, NAN, INF), "sqrt(m)": (NAN, math.sqrt(2.5), 0, NAN, INF), "sgn(m)": (-1, 1, 0, NAN, 1),
        "clamp(m, 0, 1)": (0, 1, 0, NAN, 1), "clamp_min(m, 1)": (1, 2.5, 1, NAN, INF), "clamp_max(m, 1)": (-2.5, 1, 0, NAN, 1),
    }.items():
        assert all(close(a, b) for a, b in zip(f(q), want, strict=True)), (q, f(q))
    assert at(s, "clamp(m, 1, 0)") == {}
    assert same(at(demo, "timestamp(cpus)"), {'inst="a"': T0 / 1000, 'inst="b"': T0 / 1000})
    assert set(at(demo, "timestamp(mem)").values()) == {T0 / 1000 - 1} and set(at(demo, "timestamp(mem * 1)").values()) == {T0 / 1000}
    assert at(demo, "vector(1.23)") == {"": 1.23}
    # 2023-11-14 22:13:20 UTC, a Tuesday
    for q, want in {"minute()": 13, "hour()": 22, "day_of_week()": 2, "day_of_month()": 14, "days_in_month()": 30, "month()": 11, "year()": 2023, "day_of_year()": 318}.items():
        assert at(demo, q) == {"": want}, q
    assert at(demo, "absent(cpus)") == {} and at(demo, 'absent(nothing{a="b",c=~"d"})') == {'a="b"': 1.0}


def test_labels(demo):
    replace = lambda *a: set(at(demo, 'label_replace(cpus{inst="a"}, ' + ", ".join(f'"{x}"' for x in a) + ")"))
    assert replace("d", "v-$1", "inst", "(.*)") == {'__name__="cpus",d="v-a",inst="a"'}
    assert replace("d", "v-$1", "inst", "b(.*)") == {'__name__="cpus",inst="a"'}
    assert replace("inst", "v-$1", "missing", "(.*)") == {'__name__="cpus",inst="v-"'}
    assert replace("inst", "v-$1", "missing", "x(.*)") == {'__name__="cpus",inst="a"'}
    assert replace("inst", "", "missing", ".*") == {'__name__="cpus"'}
    assert replace("d", "${1}z", "inst", "(a)") == {'__name__="cpus",d="az",inst="a"'}
    for bad in (("inst", "v", "src", "(.*"), ("~bad", "", "src", "(.*)")):
        with pytest.raises(QueryError):
            replace(*bad)
    assert set(at(demo, 'label_join(cpus{inst="a"}, "n", "-", "inst", "x", "inst")')) == {'__name__="cpus",inst="a",n="a--a"'}
    with pytest.raises(QueryError):
        at(demo, 'label_join(cpus, "~bad", "-", "inst")')


def test_histogram_quantile(spark):
    def s(*buckets):
        return store(spark, *(({"__name__": "h", "le": le}, [(T0, n)]) for le, n in buckets))

    full = s(("0.1", 10), ("0.5", 30), ("1", 40), ("+Inf", 40))
    assert math.isclose(at(full, "histogram_quantile(0.5, h)")[""], 0.1 + 0.4 * (20 - 10) / 20)
    assert math.isclose(at(full, "histogram_quantile(0.1, h)")[""], 0.1 * 4 / 10)
    assert at(full, "histogram_quantile(1, h)")[""] == 1.0
    assert at(s(("0.1", 10), ("+Inf", 20)), "histogram_quantile(0.9, h)")[""] == 0.1
    assert math.isnan(at(s(("0.1", 10), ("1", 20)), "histogram_quantile(0.9, h)")[""])
    assert at(full, "histogram_quantile(2, h)")[""] == INF and at(full, "histogram_quantile(-1, h)")[""] == -INF
    assert at(store(spark, ({"__name__": "h"}, [(T0, 1)])), "histogram_quantile(0.9, h)") == {}

"""Compiles a PromQL tree to DataFrames over a store and a grid of steps.

Vectors are (labels, labels_key, step_ms, value). Scalars are functions of the step
column where possible (literals, time()), so they fold into column expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import histogram, ieee, labels as label_functions, panes, ranges
from ..functions.scalar import DATES, MATH, clamp
from ..model import INF, LABELS, NAME, NAN, Grid, QueryContext, QueryError, Store, drop_labels, keep_labels, label, labels_key, with_labels
from ..operators.expand import expand, with_previous
from ..operators.store import Budget, read_samples, select_series, selected_points
from . import parser as P
from . import pointwise

VECTOR = ("labels", "labels_key", "step_ms", "value")


@dataclass(frozen=True)
class Scalar:
    """A value for each step: a function of the step column, or a frame of (step_ms, value)."""

    of: Callable[[Column], Column] | None = None
    frame: DataFrame | None = None
    literal: float | None = None


def _literal(x: float) -> Scalar:
    return Scalar(of=lambda _: F.lit(float(x)), literal=float(x))


class Evaluator:
    def __init__(self, store: Store, grid: Grid, context: QueryContext = QueryContext()):
        self.store, self.grid, self.context = store, grid, context
        self.spark: SparkSession = store.series.sparkSession
        self.selected: dict[tuple, DataFrame] = {}
        self.chosen: dict[tuple, DataFrame] = {}
        self.budget = Budget(context)

    # -- entry

    def result(self, tree) -> DataFrame:
        """The vector of the whole expression; a scalar or string is one row a step without labels."""
        if isinstance(tree, P.Selector) and tree.range_ms is not None:
            raise QueryError("the result can't be a range")
        got = self.eval(tree)
        if isinstance(got, P.String):
            return self.steps().select(F.create_map().cast(LABELS).alias("labels"), F.lit("").alias("labels_key"), "step_ms", F.lit(got.value).alias("value"))
        return self.vector_of(got) if isinstance(got, Scalar) else got

    def steps(self) -> DataFrame:
        return self.spark.range(self.grid.count).select((F.lit(self.grid.start_ms) + F.col("id") * self.grid.step_ms).alias("step_ms"))

    def vector_of(self, s: Scalar) -> DataFrame:
        rows = self.steps().withColumn("value", s.of(F.col("step_ms")).cast("double")) if s.of else s.frame
        return rows.select(F.create_map().cast(LABELS).alias("labels"), F.lit("").alias("labels_key"), "step_ms", "value")

    def eval(self, node):
        match node:
            case P.Number(value):
                return _literal(value)
            case P.String():
                return node
            case P.Selector() if node.range_ms is None:
                return self.instant(node)
            case P.Unary(_, expr):
                return self.negative(self.eval(expr))
            case P.Binary():
                return self.binary(node)
            case P.Aggregate():
                return self.aggregate(node)
            case P.Call():
                return self.call(node)
            case P.Subquery():
                raise QueryError("a subquery needs a function over its range")
            case _:
                raise QueryError("a range can't be used here")

    # -- selectors

    def series(self, sel: P.Selector) -> DataFrame:
        """The selector's series; equal selectors share one frame."""
        if sel.matchers not in self.chosen:
            self.chosen[sel.matchers] = select_series(self.store, sel.matchers, self.context, self.budget)
        return self.chosen[sel.matchers]

    def source(self, sel: P.Selector, function: str, grid: Grid, range_ms: int) -> DataFrame:
        """Samples of a selector that some step may use, with the labels' id."""
        key = (sel.matchers, function if self.store.rollup is not None else "", grid, range_ms, sel.offset_ms)
        if key not in self.selected:
            series = self.series(sel)
            low, high = grid.start_ms - sel.offset_ms - range_ms, grid.last_ms - sel.offset_ms
            points = read_samples(self.store, low, high, function, grid.step_ms if grid.count > 1 else 0, self.context)
            self.selected[key] = selected_points(points, series, self.budget)
        return self.selected[key]

    def at_grid(self, node) -> tuple[Grid, bool]:
        """The grid to evaluate a selector on, and whether its one step stands for all."""
        if node.at is None:
            return self.grid, False
        at = {"start": self.grid.start_ms, "end": self.grid.end_ms}.get(node.at, node.at)
        return Grid(at, at), True

    def spread(self, df: DataFrame, fixed: bool) -> DataFrame:
        """A result at a fixed time counts at every step."""
        if not fixed:
            return df
        n, start, step = self.grid.count, self.grid.start_ms, self.grid.step_ms
        return df.withColumn("step_ms", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.lit(start) + k.cast("long") * F.lit(step))))

    def windows(self, sel: P.Selector, function: str, range_ms: int) -> tuple[DataFrame, bool, Callable | None]:
        """Rows by series and step, whether one step stands for all, and the aggregate to use if the rows are panes."""
        grid, fixed = self.at_grid(sel)
        samples = self.source(sel, function, grid, range_ms)
        if range_ms and sel.range_ms is not None:
            samples = samples.where("NOT is_stale")
            pane = panes.pane_ms(function, grid, range_ms)
            if pane:
                samples = panes.to_panes(samples, function, grid, sel.offset_ms, pane)
                return expand(samples, grid, range_ms, sel.offset_ms), fixed, panes.PANED[function].whole
        return self.prepared(expand(samples, grid, range_ms, sel.offset_ms), function), fixed, None

    def prepared(self, rows: DataFrame, function: str) -> DataFrame:
        """The rows of windows with the columns that the function's aggregate sees."""
        if function in ranges.NEEDS_PREVIOUS:
            return with_previous(rows)
        return ranges.distances(rows) if function in ranges.NEEDS_DISTANCES else rows

    def named(self, df: DataFrame, sel: P.Selector, keep_name: bool) -> DataFrame:
        """series ids to labels."""
        series = self.series(sel)
        out = df.join(series.select("series_id", "labels", "labels_key"), "series_id")
        out = out if keep_name else with_labels(out, drop_labels(F.col("labels"), NAME))
        return out.select(*VECTOR)

    def instant(self, sel: P.Selector, value: str = "value") -> DataFrame:
        """The last sample within the lookback; a stale one ends the series."""
        rows, fixed, _ = self.windows(sel, "", self.context.lookback_ms)
        last = rows.groupBy("series_id", "step_ms").agg(F.max_by(F.struct("ts_ms", "value", "is_stale"), "ts_ms").alias("s"))
        picked = (F.col("s.ts_ms").cast("double") / 1000.0) if value == "ts" else F.col("s.value")
        return self.spread(self.named(last.where("NOT s.is_stale").select("series_id", "step_ms", picked.alias("value")), sel, value != "ts"), fixed)

    def over_range(self, node, function: str, aggregate: Callable[[ranges.Window], Column]) -> DataFrame:
        keep_name = function in ranges.KEEPS_NAME
        if isinstance(node, P.Subquery):
            return self.over_subquery(node, function, aggregate, keep_name)
        if not isinstance(node, P.Selector) or node.range_ms is None:
            raise QueryError(f"{function} needs a range")
        rows, fixed, of_panes = self.windows(node, function, node.range_ms)
        w = ranges.Window(node.range_ms, F.col("at_ms"))
        out = rows.groupBy("series_id", "step_ms").agg((of_panes or aggregate)(w).alias("value")).where("value IS NOT NULL")
        return self.spread(self.named(out, node, keep_name), fixed)

    def over_subquery(self, node: P.Subquery, function: str, aggregate, keep_name: bool) -> DataFrame:
        grid, fixed = self.at_grid(node)
        step = node.step_ms or 60_000
        low = grid.start_ms - node.offset_ms - node.range_ms
        first = (low // step + 1) * step  # aligned, and after the open end
        end = grid.last_ms - node.offset_ms
        inner = Evaluator(self.store, Grid(first, max(first, end), step), self.context)
        got = inner.result(node.expr)
        got = got.where(F.col("step_ms") <= end) if first > end else got
        samples = got.select("labels", F.col("labels_key").alias("series_id"), F.col("step_ms").alias("ts_ms"), "value")
        rows = self.prepared(expand(samples, grid, node.range_ms, node.offset_ms), function)
        out = rows.groupBy("series_id", "step_ms").agg(aggregate(ranges.Window(node.range_ms, F.col("at_ms"))).alias("value"), F.any_value("labels").alias("labels")).where("value IS NOT NULL")
        out = with_labels(out, F.col("labels") if keep_name else drop_labels(F.col("labels"), NAME)).select(*VECTOR)
        return self.spread(out, fixed)

    # -- operators

    def negative(self, x):
        if isinstance(x, Scalar):
            if x.literal is not None:
                return _literal(-x.literal)
            return Scalar(of=lambda s: -x.of(s)) if x.of else Scalar(frame=x.frame.withColumn("value", -F.col("value")))
        return with_labels(x.withColumn("value", -F.col("value")), drop_labels(F.col("labels"), NAME)).select(*VECTOR)

    def columns(self, node, sel: P.Selector) -> DataFrame:
        """An expression over one selector's values."""
        rows, fixed, _ = self.windows(sel, "", self.context.lookback_ms)
        last = rows.groupBy("series_id", "step_ms").agg(F.max_by(F.struct("ts_ms", "value", "is_stale"), "ts_ms").alias("s")).where("NOT s.is_stale")
        series = with_labels(self.series(sel).select("series_id", "labels"), drop_labels(F.col("labels"), NAME))
        found = self.spread(last, fixed).join(series, "series_id")
        base = found.select("labels", "labels_key", "step_ms", F.col("s.value").alias("value"), (F.col("s.ts_ms").cast("double") / 1000.0).alias("ts"))
        df, value = pointwise.evaluate(base, node, _fold)
        return df.select("labels", "labels_key", "step_ms", value.alias("value"))

    def binary(self, node: P.Binary):
        sel = pointwise.selector_of(node, _fold)
        if sel is not None:
            return self.columns(node, sel)
        left, right = self.eval(node.left), self.eval(node.right)
        scalars = isinstance(left, Scalar), isinstance(right, Scalar)
        comparison = node.op in P.COMPARISONS
        if any(isinstance(x, P.String) for x in (left, right)):
            raise QueryError("no operators for strings")
        if node.op in P.SET_OPS:
            if any(scalars):
                raise QueryError(f"{node.op} is for vectors")
            return self.set_operation(node, left, right)
        if all(scalars):
            if comparison and not node.bool_:
                raise QueryError("comparisons of scalars need bool")
            return self.scalars(node, left, right)
        if any(scalars):
            return self.with_scalar(node, left, right, comparison)
        return self.matched(node, left, right, comparison)

    def _op(self, node: P.Binary, a: Column, b: Column) -> Column:
        if node.op in P.COMPARISONS:
            return ieee.compare(node.op, a, b).cast("double")
        return ieee.arithmetic(node.op, a, b)

    def scalars(self, node: P.Binary, left: Scalar, right: Scalar) -> Scalar:
        if left.of and right.of:
            return Scalar(of=lambda s: self._op(node, left.of(s), right.of(s)))
        both = self.steps()
        for name, x in (("l", left), ("r", right)):
            both = both.withColumn(name, x.of(F.col("step_ms"))) if x.of else both.join(x.frame.select("step_ms", F.col("value").alias(name)), "step_ms", "left")
        return Scalar(frame=both.select("step_ms", self._op(node, F.coalesce("l", F.lit(NAN)), F.coalesce("r", F.lit(NAN))).alias("value")))

    def beside(self, vector: DataFrame, s: Scalar) -> tuple[DataFrame, Column]:
        """The vector with the scalar's value as a column beside it."""
        if s.of:
            return vector, s.of(F.col("step_ms"))
        side = s.frame.select("step_ms", F.col("value").alias("scalar"))  # at most a row a step
        return vector.join(side, "step_ms", "left"), F.coalesce("scalar", F.lit(NAN))

    def with_scalar(self, node: P.Binary, left, right, comparison: bool) -> DataFrame:
        vector, s, flipped = (right, left, True) if isinstance(left, Scalar) else (left, right, False)
        df, other = self.beside(vector, s)
        a, b = (other, F.col("value")) if flipped else (F.col("value"), other)
        if comparison and not node.bool_:
            return df.where(ieee.compare(node.op, a, b)).select(*VECTOR)
        out = df.withColumn("value", self._op(node, a, b))
        return with_labels(out, drop_labels(F.col("labels"), NAME)).select(*VECTOR)

    def match_key(self, m: P.Matching, labels: Column) -> Column:
        if m.on:
            return F.concat_ws("\0", *(label(labels, n) for n in sorted(m.labels))) if m.labels else F.lit("")
        return labels_key(drop_labels(labels, NAME, *m.labels))

    def set_operation(self, node: P.Binary, left: DataFrame, right: DataFrame) -> DataFrame:
        keyed = [x.withColumn("match", self.match_key(node.matching, F.col("labels"))) for x in (left, right)]
        by = ["match", "step_ms"]
        if node.op == "and":
            return keyed[0].join(keyed[1].select(*by), by, "left_semi").select(*VECTOR)
        if node.op == "unless":
            return keyed[0].join(keyed[1].select(*by), by, "left_anti").select(*VECTOR)
        return keyed[0].select(*VECTOR).unionByName(keyed[1].join(keyed[0].select(*by), by, "left_anti").select(*VECTOR))

    def matched(self, node: P.Binary, left: DataFrame, right: DataFrame, comparison: bool) -> DataFrame:
        """Vector matching: the side that may have one series a group is reduced to it, with an error for more."""
        m = node.matching
        by = ["match", "step_ms"]
        keyed = [x.withColumn("match", self.match_key(m, F.col("labels"))) for x in (left, right)]

        def single(df: DataFrame, side: str) -> DataFrame:
            return df.groupBy(*by).agg(F.count(F.lit(1)).alias(f"{side}_n"), F.any_value("labels").alias(f"{side}_labels"), F.any_value("value").alias(f"{side}_value"))

        def many(df: DataFrame, side: str) -> DataFrame:
            return df.select(*by, F.lit(1).alias(f"{side}_n"), F.col("labels").alias(f"{side}_labels"), F.col("value").alias(f"{side}_value"))

        sides = [many(keyed[0], "l") if m.card == "left" else single(keyed[0], "l"), many(keyed[1], "r") if m.card == "right" else single(keyed[1], "r")]
        joined = sides[0].join(sides[1], by)
        l, r = F.col("l_value"), F.col("r_value")
        unique = F.when((F.col("l_n") > 1) | (F.col("r_n") > 1), F.raise_error(F.lit("found duplicate series for a match group: many-to-many matching not allowed")).cast("double"))
        filtering = comparison and not node.bool_
        value = (F.col("r_value") if m.card == "right" else l) if filtering else self._op(node, l, r)
        out = joined.withColumn("value", F.coalesce(unique, value))
        if filtering:
            out = out.where(F.coalesce(unique.isNotNull(), F.lit(False)) | ieee.compare(node.op, l, r))
        labels = F.col("r_labels" if m.card == "right" else "l_labels")
        if not filtering:
            labels = drop_labels(labels, NAME)
        if m.card == "one":
            labels = keep_labels(labels, *(n for n in m.labels if n != NAME or filtering)) if m.on else drop_labels(labels, *m.labels) if m.labels else labels
        elif m.include:
            other = F.col("l_labels" if m.card == "right" else "r_labels")
            labels = F.map_concat(drop_labels(labels, *m.include), keep_labels(other, *m.include))
        return with_labels(out, labels).select(*VECTOR)

    # -- aggregations

    def group_labels(self, node: P.Aggregate) -> Column:
        if node.without:
            return drop_labels(F.col("labels"), NAME, *node.grouping)
        return keep_labels(F.col("labels"), *node.grouping)

    def aggregate(self, node: P.Aggregate) -> DataFrame:
        df = self.eval(node.expr)
        if not isinstance(df, DataFrame):
            raise QueryError(f"{node.op} needs a vector")
        grouped = df.withColumn("group", self.group_labels(node))
        grouped = grouped.withColumn("group_key", labels_key(F.col("group")) if node.without or node.grouping else F.lit(""))
        if node.op in ("topk", "bottomk", "limitk"):
            k = self.constant(node.param, node.op)
            value = F.col("value")
            order = {"topk": [F.isnan(value), value.desc()], "bottomk": [F.isnan(value), value.asc()], "limitk": []}[node.op]
            w = W.partitionBy("group_key", "step_ms").orderBy(*order, "labels_key")
            return grouped.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= int(k)).select(*VECTOR)
        if node.op == "limit_ratio":
            ratio = max(-1.0, min(1.0, self.constant(node.param, node.op)))
            place = F.pmod(F.xxhash64("labels_key"), F.lit(1_000_000)) / 1e6
            return grouped.where(place < ratio if ratio >= 0 else place >= 1 + ratio).select(*VECTOR)
        if node.op == "count_values":
            name = self.text(node.param)
            label_functions.check_name(name)
            grouped = grouped.withColumn("group", F.map_concat(drop_labels(F.col("group"), name), F.create_map(F.lit(name), ieee.format_float(F.col("value")))))
            grouped = grouped.withColumn("group_key", labels_key(F.col("group")))
        value = {
            "sum": lambda: F.sum("value"),
            "avg": lambda: F.avg("value"),
            "min": lambda: ieee.nan_min(F.col("value")),
            "max": lambda: ieee.nan_max(F.col("value")),
            "count": lambda: F.count("value").cast("double"),
            "count_values": lambda: F.count("value").cast("double"),
            "stddev": lambda: F.stddev_pop("value"),
            "stdvar": lambda: F.var_pop("value"),
            "group": lambda: F.max(F.lit(1.0)),
            "quantile": lambda: ranges.quantile(self.constant(node.param, "quantile"), F.col("value")),
        }[node.op]()
        out = grouped.groupBy("group_key", "step_ms").agg(F.any_value("group").alias("labels"), value.alias("value"))
        return out.select("labels", F.col("group_key").alias("labels_key"), "step_ms", "value")

    def constant(self, node, what: str) -> float:
        """A parameter that must be known when planning."""
        got = _fold(node)
        if got is None:
            raise QueryError(f"{what} needs a constant")
        return got

    def text(self, node) -> str:
        if not isinstance(node, P.String):
            raise QueryError("a string is expected")
        return node.value

    # -- functions

    def call(self, node: P.Call):
        name, args = node.func, node.args
        if name in ("holt_winters", "double_exponential_smoothing"):
            self.arity(node, 3)
            factors = [self.constant(a, name) for a in args[1:]]
            if not all(0 < f < 1 for f in factors):
                raise QueryError("smoothing and trend factors must be between 0 and 1")
            return self.over_range(args[0], name, ranges.double_exponential(*factors))
        if name == "quantile_over_time":
            self.arity(node, 2)
            phi = self.constant(args[0], name)
            return self.over_range(args[1], name, lambda _: ranges.quantile(phi))
        if name == "predict_linear":
            self.arity(node, 2)
            seconds = self.constant(args[1], name)
            return self.over_range(args[0], name, lambda w: ranges.predict_linear(w, F.lit(seconds)))
        if name in ranges.FUNCTIONS:
            self.arity(node, 1)
            return self.over_range(args[0], name, ranges.FUNCTIONS[name])
        if name == "absent_over_time":
            self.arity(node, 1)
            return self.absent(args[0], self.over_range(args[0], "present_over_time", ranges.FUNCTIONS["present_over_time"]))
        if name == "absent":
            self.arity(node, 1)
            return self.absent(args[0], self.eval(args[0]))
        if name in DATES:
            self.arity(node, 0, 1)
            if not args:
                return self.vector_of(Scalar(of=lambda s: DATES[name](s.cast("double") / 1000.0)))
            return self.changed(args[0], DATES[name])
        if name in MATH:
            self.arity(node, 1)
            return self.changed(args[0], MATH[name])
        simple = getattr(self, f"call_{name}", None)
        if simple is None:
            raise QueryError(f"unknown function {name}")
        return simple(node)

    def arity(self, node: P.Call, *allowed: int) -> None:
        if len(node.args) not in allowed:
            raise QueryError(f"wrong number of arguments for {node.func}")

    def vector(self, node) -> DataFrame:
        got = self.eval(node)
        if not isinstance(got, DataFrame):
            raise QueryError("a vector is expected")
        return got

    def scalar(self, node) -> Scalar:
        got = self.eval(node)
        if not isinstance(got, Scalar):
            raise QueryError("a scalar is expected")
        return got

    def changed(self, node, f: Callable[[Column], Column]) -> DataFrame:
        out = self.vector(node).withColumn("value", f(F.col("value")).cast("double"))
        return with_labels(out, drop_labels(F.col("labels"), NAME)).select(*VECTOR)

    def absent(self, node, got: DataFrame) -> DataFrame:
        """1 at the steps without any element; labels from the equality matchers."""
        equal = [m for m in node.matchers if m.op == "=" and m.name != NAME] if isinstance(node, P.Selector) else []
        once = {m.name: m.value for m in equal if m.value and sum(o.name == m.name for o in node.matchers) == 1}
        labels = F.create_map(*(F.lit(x) for kv in once.items() for x in kv)).cast(LABELS)
        missing = self.steps().join(got.select("step_ms").distinct(), "step_ms", "left_anti")
        return with_labels(missing.withColumn("value", F.lit(1.0)), labels).select(*VECTOR)

    def call_time(self, node):
        self.arity(node, 0)
        return Scalar(of=lambda s: s.cast("double") / 1000.0)

    def call_pi(self, node):
        self.arity(node, 0)
        return _literal(3.141592653589793)

    def call_vector(self, node):
        self.arity(node, 1)
        return self.vector_of(self.scalar(node.args[0]))

    def call_scalar(self, node):
        """The value of a vector of one element, else NaN."""
        self.arity(node, 1)
        one = self.vector(node.args[0]).groupBy("step_ms").agg(F.when(F.count(F.lit(1)) == 1, F.max("value")).otherwise(NAN).alias("value"))
        return Scalar(frame=self.steps().join(one, "step_ms", "left").select("step_ms", F.coalesce("value", F.lit(NAN)).alias("value")))

    def call_timestamp(self, node):
        """Of a plain selector the sample's own time, else the step's."""
        self.arity(node, 1)
        if isinstance(node.args[0], P.Selector) and node.args[0].range_ms is None:
            return with_labels(self.instant(node.args[0], "ts"), drop_labels(F.col("labels"), NAME)).select(*VECTOR)
        out = self.vector(node.args[0]).withColumn("value", F.col("step_ms").cast("double") / 1000.0)
        return with_labels(out, drop_labels(F.col("labels"), NAME)).select(*VECTOR)

    def call_round(self, node):
        self.arity(node, 1, 2)
        to = self.constant(node.args[1], "round") if len(node.args) > 1 else 1.0
        return self.changed(node.args[0], lambda v: ieee.round_to(v, to))

    def clamped(self, node, low, high):
        df = self.vector(node.args[0])
        bounds = []
        for i, n in enumerate((low, high)):
            if n is None:
                bounds.append(None)
                continue
            df, c = self.beside(df, self.scalar(n))
            df = df.withColumn(f"bound{i}", c).drop("scalar")
            bounds.append(F.col(f"bound{i}"))
        if low is not None and high is not None:
            df = df.where(~(bounds[0] > bounds[1]) | F.isnan(bounds[0]) | F.isnan(bounds[1]))
        out = df.withColumn("value", clamp(F.col("value"), *bounds))
        return with_labels(out, drop_labels(F.col("labels"), NAME)).select(*VECTOR)

    def call_clamp(self, node):
        self.arity(node, 3)
        return self.clamped(node, node.args[1], node.args[2])

    def call_clamp_min(self, node):
        self.arity(node, 2)
        return self.clamped(node, node.args[1], None)

    def call_clamp_max(self, node):
        self.arity(node, 2)
        return self.clamped(node, None, node.args[1])

    def call_label_replace(self, node):
        self.arity(node, 5)
        return with_labels(self.vector(node.args[0]), label_functions.label_replace(F.col("labels"), *map(self.text, node.args[1:]))).select(*VECTOR)

    def call_label_join(self, node):
        if len(node.args) < 3:
            raise QueryError("wrong number of arguments for label_join")
        target, separator, *sources = map(self.text, node.args[1:])
        return with_labels(self.vector(node.args[0]), label_functions.label_join(F.col("labels"), target, separator, sources)).select(*VECTOR)

    def call_histogram_quantile(self, node):
        self.arity(node, 2)
        phi = self.constant(node.args[0], "histogram_quantile")
        return histogram.histogram_quantile(self.vector(node.args[1]), F.lit(phi))

    def sorted_by(self, node, *order: Column) -> DataFrame:
        return self.vector(node.args[0]).orderBy("step_ms", *order)

    def call_sort(self, node):
        self.arity(node, 1)
        return self.sorted_by(node, F.isnan("value"), F.col("value").asc())

    def call_sort_desc(self, node):
        self.arity(node, 1)
        return self.sorted_by(node, F.isnan("value"), F.col("value").desc())

    def call_sort_by_label(self, node):
        return self.sorted_by(node, *(label(F.col("labels"), self.text(a)) for a in node.args[1:]), F.col("labels_key"))

    def call_sort_by_label_desc(self, node):
        return self.sorted_by(node, *(label(F.col("labels"), self.text(a)).desc() for a in node.args[1:]), F.col("labels_key").desc())


def _fold(node) -> float | None:
    """The value of a constant expression."""
    import math

    match node:
        case P.Number(v):
            return v
        case P.Unary(_, e):
            v = _fold(e)
            return None if v is None else -v
        case P.Binary(op, l, r) if op in "+-*/%^":
            a, b = _fold(l), _fold(r)
            if a is None or b is None:
                return None
            try:
                return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: math.fmod(a, b), "^": lambda: a**b}[op]()
            except (ZeroDivisionError, ValueError, OverflowError):
                return (INF if a > 0 else -INF if a < 0 else NAN) if op == "/" else NAN
        case P.Call("pi", ()):
            return math.pi
    return None

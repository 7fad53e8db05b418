"""Virtual (mutable) labels: per tenant, a label whose values stand for sets of values of a real label."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import QueryError, with_labels
from ..plans.matchers import Matcher, quoted_alternation

NAMES = "tenant string, name string, associated_name string"
VALUES = "tenant string, name string, value string, associated_values array<string>"


class NoValues(QueryError):
    """A virtual matcher that stands for nothing: the result is empty."""


@dataclass
class MutableLabels:
    """names(tenant, name, associated_name) and values(tenant, name, value, associated_values): small dimensions."""

    names: DataFrame
    values: DataFrame

    def name_map(self, tenant: str) -> dict[str, str]:
        return {r["name"]: r["associated_name"] for r in self.names.where(F.col("tenant") == tenant).collect()}

    def sets(self, tenant: str, name: str) -> dict[str, list[str]]:
        return {r["value"]: list(r["associated_values"] or []) for r in self.values.where((F.col("tenant") == tenant) & (F.col("name") == name)).collect()}

    def rewrite(self, matchers: Sequence[Matcher], tenant: str | None) -> list[Matcher]:
        """Virtual matchers as matchers on the real label; without a tenant nothing is virtual.

        ``=~`` and ``!~`` both become a positive match of the values that they select.
        """
        if not tenant:
            return list(matchers)
        real, out = self.name_map(tenant), []
        for m in matchers:
            if m.name not in real:
                out.append(m)
                continue
            sets = self.sets(tenant, m.name)
            if m.op in ("=", "!="):
                values = sets.get(m.value, [])
                op = "=~" if m.op == "=" else "!~"
            else:
                values = [v for value in sorted(sets) if m.test(value) for v in sets[value]]
                op = "=~"
            if not values:
                raise NoValues(f"no value for {m}")
            out.append(Matcher(real[m.name], op, quoted_alternation(values)))
        return out

    def decorate(self, series: DataFrame, tenant: str) -> DataFrame:
        """Adds virtual labels to (.., labels); stored labels of such names go; the first value wins."""
        names = self.names.where(F.col("tenant") == tenant)
        virtual = [r["name"] for r in names.collect()]
        if not virtual:
            return series
        mapped = self.values.where(F.col("tenant") == tenant).join(names.select("name", "associated_name"), "name")
        flat = mapped.select("name", "associated_name", "value", F.explode("associated_values").alias("real"))
        first = flat.groupBy("associated_name", "real", "name").agg(F.min("value").alias("value"))
        by_real = first.groupBy("associated_name", "real").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("added"))
        own = F.map_filter("labels", lambda k, _: ~k.isin(*virtual))
        out = series.withColumn("labels", own)
        for r in names.select("associated_name").distinct().collect():
            side = by_real.where(F.col("associated_name") == r["associated_name"]).select(F.col("real"), "added")
            key = F.try_element_at("labels", F.lit(r["associated_name"]))
            out = out.join(side, key == F.col("real"), "left").withColumn("labels", F.when(F.col("added").isNotNull(), F.map_concat("labels", "added")).otherwise(F.col("labels"))).drop("real", "added")
        return with_labels(out, F.col("labels"))

    def label_values(self, tenant: str, name: str) -> list[str]:
        return sorted(self.sets(tenant, name))

    # -- changes: new tables, to be written by the caller

    def replace_values(self, rows: DataFrame) -> MutableLabels:
        """Sets associated values; rows without a tenant, name, value or values are refused when read."""
        bad = (F.coalesce("tenant", F.lit("")) == "") | (F.coalesce("name", F.lit("")) == "") | (F.coalesce("value", F.lit("")) == "") | (F.size("associated_values") < 1)
        checked = rows.withColumn("tenant", F.when(bad, F.raise_error(F.lit("empty tenant, name, value or values"))).otherwise(F.col("tenant")))
        kept = self.values.join(rows.select("tenant", "name", "value"), ["tenant", "name", "value"], "left_anti")
        return MutableLabels(self.names, kept.unionByName(checked.select(*kept.columns)))

    def delete_values(self, keys: DataFrame) -> MutableLabels:
        return MutableLabels(self.names, self.values.join(keys, ["tenant", "name", "value"], "left_anti"))

    def replace_names(self, rows: DataFrame) -> MutableLabels:
        kept = self.names.join(rows.select("tenant", "name"), ["tenant", "name"], "left_anti")
        return MutableLabels(kept.unionByName(rows.select(*kept.columns)), self.values)

    def delete_names(self, keys: DataFrame) -> MutableLabels:
        return MutableLabels(self.names.join(keys, ["tenant", "name"], "left_anti"), self.values.join(keys, ["tenant", "name"], "left_anti"))

    def to_csv_rows(self) -> DataFrame:
        """tenant, label_name, label_value, associated_label_name, associated_label_value: a row for each real value."""
        flat = self.values.join(self.names, ["tenant", "name"]).select("tenant", F.col("name").alias("label_name"), F.col("value").alias("label_value"), F.col("associated_name").alias("associated_label_name"), F.explode("associated_values").alias("associated_label_value"))
        return flat

    @staticmethod
    def from_csv_rows(rows: DataFrame) -> MutableLabels:
        names = rows.select("tenant", F.col("label_name").alias("name"), F.col("associated_label_name").alias("associated_name")).distinct()
        values = rows.groupBy("tenant", F.col("label_name").alias("name"), F.col("label_value").alias("value")).agg(F.array_sort(F.collect_set("associated_label_value")).alias("associated_values"))
        return MutableLabels(names, values)

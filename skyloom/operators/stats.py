"""Statistics of series and of their segments."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.text import finite

METRICS = ("start", "end", "min", "max", "sum", "count", "average", "total")


def value_stats(value: str, order: str | Column) -> dict[str, Column]:
    """Aggregates of a column's finite values; start and end by the order, total is their difference."""
    own = finite(F.col(f"`{value}`").cast("double"))
    by = F.when(own.isNotNull(), F.col(order) if isinstance(order, str) else order)
    start, end = F.min_by(own, by), F.max_by(own, by)
    return {
        "start": start, "end": end, "min": F.min(own), "max": F.max(own), "sum": F.sum(own),
        "count": F.count(own), "average": F.avg(own), "total": end - start,
    }


def range_stats(rows: DataFrame, value: str, keys: Sequence[str], order: str, start: Column, end: Column) -> DataFrame:
    """The statistics of a column over start <= order <= end, one row a key."""
    inside = rows.where((F.col(order) >= start) & (F.col(order) <= end))
    return inside.groupBy(*keys).agg(*[c.alias(k) for k, c in value_stats(value, order).items()])


def segment_stats(rows: DataFrame, spec: dict[str, Sequence[str]], keys: Sequence[str], order: str | Column) -> DataFrame:
    """One row a segment: for each field its metrics, as columns ``field.metric``."""
    out = [value_stats(f, order)[m].alias(f"{f}.{m}") for f, metrics in spec.items() for m in metrics]
    return rows.groupBy(*keys).agg(*out)


def modes(rows: DataFrame, value: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """keys, start, end, most_frequent, n_distinct: of equal counts, the value that reached it first."""
    w = Window.partitionBy(*keys, value).orderBy(*order)
    at = rows.withColumn("__n", F.row_number().over(w)).withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    known = F.col(value).isNotNull()
    return at.groupBy(*keys).agg(
        F.min_by(value, F.when(known, F.col("__i"))).alias("start"),
        F.max_by(value, F.when(known, F.col("__i"))).alias("end"),
        F.max_by(value, F.when(known, F.struct(F.col("__n"), -F.col("__i")))).alias("most_frequent"),
        F.count_distinct(value).alias("n_distinct"),
    )


def categorical_stats(value: str, at: Column) -> dict[str, Column]:
    """Aggregates start, end and most_frequent of a name column, blanks as absent; ``at`` is a struct (times so far, -row)
    that ``counted`` adds."""
    known = F.nullif(F.col(f"`{value}`"), F.lit(""))
    by = F.when(known.isNotNull(), at)
    return {"start": F.min_by(known, F.when(known.isNotNull(), -at["i"])), "end": F.max_by(known, F.when(known.isNotNull(), -at["i"])), "mostFrequent": F.max_by(known, by)}


def counted(rows: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with struct ``name``: how often the row's value came so far in its segment, and minus the row's number."""
    n = F.row_number().over(Window.partitionBy(*keys, F.col(f"`{value}`")).orderBy(*order))
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn(name, F.struct(n.alias("n"), (-i).alias("i")))


def wide(rows: DataFrame, values: dict[str, Sequence[str]], names: dict[str, Sequence[str]], keys: Sequence[str], order: Sequence[str], constants: dict[str, object] | None = None) -> DataFrame:
    """A row a segment with a column ``field.metric`` for each metric that a schema names, and constant columns.

    ``values`` and ``names`` map number and name fields to their metrics; fields that the rows lack give nulls.
    """
    own = {f: m for f, m in names.items() if f in rows.columns}
    for k, f in enumerate(own):
        rows = counted(rows, f, keys, order, f"__c{k}")
    out = []
    for f, metrics in values.items():
        found = value_stats(f, F.struct(*order)) if f in rows.columns else {}
        out += [found.get(m, F.first(F.lit(None).cast("double"))).alias(f"{f}.{m}") for m in metrics]
    for f, metrics in names.items():
        found = categorical_stats(f, F.col(f"__c{list(own).index(f)}")) if f in own else {}
        out += [found.get(m, F.first(F.lit(None).cast("string"))).alias(f"{f}.{m}") for m in metrics]
    return rows.groupBy(*keys).agg(*out).withColumns({k: F.lit(v) for k, v in (constants or {}).items()})


def distinct_or_scalar(rows: DataFrame, column: str) -> DataFrame:
    """values (distinct, sorted) and single (the only one, if there is just one) of a column."""
    return rows.agg(F.sort_array(F.collect_set(column)).alias("values")).select("values", F.when(F.size("values") == 1, F.get("values", F.lit(0))).alias("single"))


def by_field(legs: DataFrame, keys: Sequence[str], leg: str, fields: Sequence[str]) -> DataFrame:
    """keys, field, series: the values of each field over the legs in order, as array<struct<leg, value>>; absent ones are null."""
    long = legs.unpivot([*keys, leg], list(fields), "field", "value")
    return long.groupBy(*keys, "field").agg(F.array_sort(F.collect_list(F.struct(F.col(leg).alias("leg"), "value"))).alias("series"))


def interval_extras(value: str, at: Column, left: Column, right: Column, running: Column) -> dict[str, Column]:
    """Aggregates of an interval's rows beyond ``value_stats``: the median, where the least and the greatest value lie
    (``at``, the first of equals), the greatest difference between the two tanks, and whether the engine runs in most rows.
    """
    v = finite(F.col(value))
    first = lambda sign: F.min(F.when(v.isNotNull(), F.struct((sign * v).alias("v"), at.alias("at"))))["at"]
    ran, stood = F.count_if(running), F.count_if(~running)
    return {"median": F.median(v), "min_at": first(1), "max_at": first(-1), "imbalance": F.max(F.abs(finite(left) - finite(right))), "running": F.when(ran + stood > 0, ran > stood)}


def weighted_mean(value: str, weight: str) -> Column:
    known = F.when(F.col(value).isNotNull(), F.col(weight))
    return F.sum(F.col(value) * F.col(weight)) / F.sum(known)


def ratio(numerator: str, denominator: str) -> Column:
    """Ratio of sums; null when nothing is below."""
    return F.sum(numerator) / F.nullif(F.sum(denominator), F.lit(0.0))


def bounds(lat: str, lon: str, within: Column | None = None) -> list[Column]:
    """Bounding box of the valid positions (of those ``within``), as aggregates."""
    ok = (F.col(lon) > -180) & (within if within is not None else F.lit(True))
    return [f(F.when(ok, F.col(c))).alias(f"{n}_{c}") for c in (lat, lon) for n, f in (("min", F.min), ("max", F.max))]


class Folded:
    """A fold as a state machine for ``series.fold``."""

    def __init__(self, zero, merge):
        self.now, self.merge = zero, merge

    def add(self, value) -> None:
        self.now = self.merge(self.now, value)

    def result(self):
        return self.now


def folded(rows: DataFrame, value: Column, keys: Sequence[str], order: Sequence[str], zero: object, merge: Callable[[object, object], object], kind: str = "long", name: str = "folded") -> DataFrame:
    """A fold (``merge`` of the value so far and the next one) over each key's values in order, however many a key has."""
    from skyloom.operators.series import fold

    return fold(rows.withColumn("__v", value), ["__v"], keys, order, name, kind, lambda: Folded(zero, merge))

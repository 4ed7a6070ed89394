"""Operators on ordered series: a table with key columns, columns that order each key's rows, and values.

``key`` and ``order`` are lists of column names; the order should be total within a key, so that results
do not depend on how Spark places rows. Windows run per key, and one key's rows are one recorder log
(some hours at 1 Hz), which fits a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def by(key: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(*key).orderBy(*order)


def upto(key: Sequence[str], order: Sequence[str]) -> Window:
    return by(key, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def numbered(rows: DataFrame, key: Sequence[str], order: Sequence[str], name: str = "row_idx") -> DataFrame:
    """Row numbers from 0."""
    return rows.withColumn(name, F.row_number().over(by(key, order)) - 1)


def changed(columns: Sequence[str], key: Sequence[str], order: Sequence[str]) -> Column:
    """Whether any column differs from the row before (nulls are equal); the first row of a key does."""
    w = by(key, order)
    differs = ~F.struct(*columns).eqNullSafe(F.lag(F.struct(*columns)).over(w))
    return (F.row_number().over(w) == 1) | differs


def value_changes(rows: DataFrame, columns: Sequence[str], key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows where a value changes; columns that the table lacks are passed over, none gives no rows."""
    own = [c for c in columns if c in rows.columns]
    if not own:
        return rows.limit(0)
    return rows.withColumn("__changed", changed(own, key, order)).where("__changed").drop("__changed")


def legs(rows: DataFrame, columns: Sequence[str], key: Sequence[str], order: Sequence[str], name: str = "leg_idx") -> DataFrame:
    """``rows`` with the number, from 0, of the run of equal values that each belongs to."""
    flagged = rows.withColumn("__new", changed(columns, key, order).cast("int"))
    return flagged.withColumn(name, F.sum("__new").over(upto(key, order)) - 1).drop("__new")


def intervals(rows: DataFrame, ts: str, seconds: int, name: str = "start") -> DataFrame:
    """``rows`` with the start of the tumbling interval, aligned to whole multiples of its width."""

    return rows.withColumn(name, F.window(ts, f"{seconds} seconds")["start"])


def dense_intervals(rows: DataFrame, ts: str, key: Sequence[str], seconds: int) -> DataFrame:
    """key, start of every interval from a key's first to its last, empty ones too."""
    ends = intervals(rows, ts, seconds).groupBy(*key).agg(F.min("start").alias("__a"), F.max("start").alias("__b"))
    return ends.select(*key, F.explode(F.sequence("__a", "__b", F.expr(f"INTERVAL {seconds} SECONDS"))).alias("start"))


def leg_ends(legs: DataFrame, key: Sequence[str], start: str, last: str, name: str = "end", order: Sequence[str] = ()) -> DataFrame:
    """A leg ends where the next starts; the last one at column ``last``. ``order`` parts legs of equal starts."""
    return legs.withColumn(name, F.coalesce(F.lead(start).over(by(key, [start, *order])), F.col(last)))


def between(rows: DataFrame, ts: str, start: Column, end: Column) -> DataFrame:
    """start <= ts < end."""
    return rows.where((F.col(ts) >= start) & (F.col(ts) < end))


def drop_missing(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows where all of those columns that exist hold finite values."""
    kinds = dict(rows.dtypes)
    for c in columns:
        if c in kinds:
            fine = F.col(c).isNotNull()
            rows = rows.where(fine & ~F.isnan(c) & (F.abs(c) != float("inf")) if kinds[c] in ("double", "float") else fine)
    return rows


def drop_head(rows: DataFrame, match: Column, key: Sequence[str], order: Sequence[str], run: int = 1) -> DataFrame:
    """Rows from the run-th of the first ``run`` consecutive matches on; a key without such a run goes."""
    w = by(key, order)
    at = rows.withColumn("__n", F.row_number().over(w)).withColumn("__m", F.coalesce(match, F.lit(False)))
    at = at.withColumn("__broken", F.coalesce(F.max(F.when(~F.col("__m"), F.col("__n"))).over(upto(key, order)), F.lit(0)))
    at = at.withColumn("__first", F.min(F.when(F.col("__m") & (F.col("__n") - F.col("__broken") >= run), F.col("__n"))).over(Window.partitionBy(*key)))
    return at.where(F.col("__n") >= F.col("__first")).drop("__n", "__m", "__broken", "__first")


def drop_tail(rows: DataFrame, match: Column, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows up to the last match; a key without a match stays whole."""
    at = rows.withColumn("__n", F.row_number().over(by(key, order)))
    at = at.withColumn("__last", F.max(F.when(match, F.col("__n"))).over(Window.partitionBy(*key)))
    return at.where(F.col("__last").isNull() | (F.col("__n") <= F.col("__last"))).drop("__n", "__last")


def head_from(rows: DataFrame, order: str, first: Column) -> DataFrame:
    """Rows from ``first`` on."""
    return rows.where(F.col(order) >= first)


def without_first(rows: DataFrame, k: int, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows but for the first k of each key."""
    return numbered(rows, key, order, "__n").where(F.col("__n") >= k).drop("__n")


def at_row(rows: DataFrame, i: int, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The i-th row of each key, from 0."""
    return numbered(rows, key, order, "__n").where(F.col("__n") == i).drop("__n")


def first_last(value: str, order: Sequence[str], match: Column | None = None) -> tuple[Column, Column]:
    """Aggregates: the value at the first and at the last row that matches (any row, without a match)."""
    at = F.struct(*order) if match is None else F.when(match, F.struct(*order))
    return F.min_by(value, at), F.max_by(value, at)


def nearest_to(rows: DataFrame, target: Column, value: str, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key whose value is nearest to a target, the first on ties."""
    best = F.min_by(F.struct(*rows.columns), F.when(F.col(value).isNotNull(), F.struct(F.abs(F.col(value) - target), *order)))
    return rows.groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(best.alias("__row")).select("__row.*").where(F.coalesce(*key).isNotNull())


def series_of(rows: DataFrame, field: str, ts: str, start: Column, end: Column, key: Sequence[str]) -> DataFrame:
    """key, ts, elapsed (seconds from the start) and value of a field's finite values within start and end, both closed."""
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    own = drop_missing(rows, [field]).where((F.col(ts) >= start) & (F.col(ts) <= end))
    return own.select(*key, ts, (seconds(F.col(ts)) - seconds(start)).alias("elapsed"), F.col(f"`{field}`").alias("value"))


def paired(a: DataFrame, b: DataFrame, key: Sequence[str], ts: str) -> DataFrame:
    """key, ts, x, y of two series (key, ts, value) at the times that both have."""
    return a.select(*key, ts, F.col("value").alias("x")).join(b.select(*key, ts, F.col("value").alias("y")), [*key, ts])


def first_present(rows: DataFrame, names: Sequence[str]) -> Column:
    """The first of the columns that the table has (a choice of schema, not of rows); null if it has none."""
    return next((F.col(f"`{n}`") for n in names if n in rows.columns), F.lit(None).cast("double"))


def scan(rows: DataFrame, columns: Sequence[str], key: Sequence[str], order: Sequence[str], name: str, kind: str, state, delay: int = 0) -> DataFrame:
    """``rows`` with what a state machine says of each, for states that depend on all rows before.

    ``state()`` makes a machine for a key: ``add`` takes a row's values of ``columns``, and its list ``out`` grows by
    one; what lies more than ``delay`` back is final. Rows pass sorted by key and order, batch by batch, so a
    task holds one batch and ``delay`` rows, however long a key's series is.
    """
    placed = rows.withColumn("__key", F.to_json(F.struct(*key))).repartition(*key).sortWithinPartitions(*key, *order)
    types = {"string": pa.string(), "int": pa.int32()}
    wanted = [*rows.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, machine, current = None, None, None

        def ready(n: int) -> Iterator[pa.RecordBatch]:
            nonlocal held
            done = held.slice(0, n).append_column(name, pa.array(machine.out[:n], types[kind]))
            del machine.out[:n]
            held = held.slice(n)
            yield from done.select(wanted).combine_chunks().to_batches()

        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("__key")).to_pylist()
            begin = 0
            while begin < len(keys):
                end = begin + 1
                while end < len(keys) and keys[end] == keys[begin]:
                    end += 1
                part = pa.Table.from_batches([batch.slice(begin, end - begin)])
                if keys[begin] != current:
                    if held is not None:
                        yield from ready(held.num_rows)
                    held, machine, current = None, state(), keys[begin]
                for values in zip(*[part.column(c).to_pylist() for c in columns], strict=True):
                    machine.add(*values)
                held = part if held is None else pa.concat_tables([held, part])
                if held.num_rows > delay:
                    yield from ready(held.num_rows - delay)
                begin = end
        if held is not None:
            yield from ready(held.num_rows)

    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.StringType() if kind == "string" else T.IntegerType())])
    return placed.mapInArrow(run, schema)


def fold(rows: DataFrame, columns: Sequence[str], key: Sequence[str], order: Sequence[str], name: str, kind: str, state) -> DataFrame:
    """key and what a state machine says of all the key's rows in order; a row a key.

    ``state()`` makes a machine for a key: ``add`` takes a row's values of ``columns``, ``result`` gives the value (``kind``: its type). Rows
    pass sorted, batch by batch, so a key of any length takes the memory of one batch and its machine.
    """
    placed = rows.select(*key, *order, *[c for c in columns if c not in (*key, *order)]).withColumn("__key", F.to_json(F.struct(*key))).repartition(*key).sortWithinPartitions(*key, *order)
    schema = T.StructType([*rows.select(*key).schema.fields, T.StructField(name, T._parse_datatype_string(kind))])
    types = [f.type for f in to_arrow_schema(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, machine, own = None, None, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*own, pa.array([machine.result()], types[-1])], schema.names)

        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("__key")).to_pylist()
            values = zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns], strict=True)
            for i, (k, v) in enumerate(zip(keys, values, strict=True)):
                if k != current:
                    if machine is not None:
                        yield told()
                    current, machine = k, state()
                    own = [batch.column(batch.schema.get_field_index(c)).slice(i, 1).cast(t) for c, t in zip(key, types, strict=False)]
                machine.add(*v)
        if machine is not None:
            yield told()

    return placed.mapInArrow(run, schema)


def every(rows: DataFrame, k: int, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Every k-th row of a key, from its first."""
    return numbered(rows, key, order, "__n").where(F.pmod("__n", F.lit(k)) == 0).drop("__n")


def first_rows(rows: DataFrame, n: int, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    return numbered(rows, key, order, "__n").where(F.col("__n") < n).drop("__n")


def last_epoch(rows: DataFrame, ts: str, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Repeated seconds keep their first row; when the clock steps back, everything before goes."""
    w = by(key, order)
    at = rows.withColumn("__back", F.coalesce((F.col(ts) < F.lag(ts).over(w)).cast("int"), F.lit(0)))
    at = at.withColumn("__epoch", F.sum("__back").over(upto(key, order)))
    at = at.withColumn("__last", F.max("__epoch").over(Window.partitionBy(*key))).where("__epoch = __last")
    at = at.withColumn("__k", F.row_number().over(Window.partitionBy(*key, ts).orderBy(*order))).where("__k = 1")
    return at.drop("__back", "__epoch", "__last", "__k")


def running_total(value: Column, key: Sequence[str], order: Sequence[str], per: float = 3600.0) -> Column:
    """Sum of a rate an hour over rows a second apart, nulls as 0."""
    return F.sum(F.coalesce(value, F.lit(0.0)) / per).over(upto(key, order))


def integral(value: Column, ts: str, key: Sequence[str], order: Sequence[str], most_s: float = 10.0, per: float = 3600.0) -> Column:
    """Sum of a rate times the seconds since the row before, each step at most ``most_s``; 0 at the first row.

    Nested windows are not allowed, so ``step_s`` is to be added first by ``with_steps``.
    """
    return F.sum(F.coalesce(value, F.lit(0.0)) * F.col("step_s") / per).over(upto(key, order))


def with_steps(rows: DataFrame, ts: str, key: Sequence[str], order: Sequence[str], most_s: float = 10.0) -> DataFrame:
    """``rows`` with step_s, the seconds since the row before, within 0 and ``most_s``."""
    t = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    gap = t - F.lag(t).over(by(key, order))
    return rows.withColumn("step_s", F.coalesce(F.least(F.greatest(gap, F.lit(0.0)), F.lit(most_s)), F.lit(0.0)))


def centred_mean(value: str, key: Sequence[str], order: Sequence[str], half: int = 7) -> Column:
    return F.avg(value).over(by(key, order).rowsBetween(-half, half))


def merged_runs(rows: DataFrame, label: str, key: Sequence[str], order: Sequence[str], keep: Column) -> DataFrame:
    """key, run, label, first and last row, n: runs of a label; those that ``keep`` (over n) refuses join the one before.

    The first run of a key always stays; neighbours that become equal are one run.
    """
    runs = legs(numbered(rows, key, order, "__i"), [label], key, order, "__run")
    runs = runs.groupBy(*key, "__run").agg(F.first(label).alias(label), F.min("__i").alias("first"), F.max("__i").alias("last"), F.count("*").alias("n"))
    kept = F.when((F.col("__run") == 0) | keep, F.col(label))
    runs = runs.withColumn("__label", F.last(kept, ignorenulls=True).over(upto(key, ["__run"])))
    runs = legs(runs, ["__label"], key, ["__run"], "run")
    return runs.groupBy(*key, "run").agg(F.first("__label").alias(label), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))


def distance_run(rows: DataFrame, lat: str, lon: str, key: Sequence[str], order: Sequence[str], name: str = "distance") -> DataFrame:
    """``rows`` with the distance flown up to each, over rows with a position."""
    from skyloom.functions.geo import distance_nm

    w = by(key, order).rowsBetween(Window.unboundedPreceding, -1)
    fix = F.when(F.col(lat).isNotNull() & F.col(lon).isNotNull(), F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon")))
    at = rows.withColumn("__p", F.last(fix, ignorenulls=True).over(w))
    step = F.coalesce(distance_nm(F.col("__p.lat"), F.col("__p.lon"), F.col(lat), F.col(lon)), F.lit(0.0))
    return at.withColumn("__d", step).withColumn(name, F.sum("__d").over(upto(key, order))).drop("__p", "__d")

"""Flight phases of a log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.text import finite
from skyloom.operators.series import by, centred_mean, distance_run, legs, merged_runs, numbered, scan

#: Rows that a label looks back over, rows it needs at least, and its thresholds.
REACH, LEAST, FLYING, CHANGE = 20, 15, 35.0, 50.0


class Phases:
    """Labels the rows of a log: Ground, Climb, Cruise or Descent.

    A label needs ``LEAST`` rows since the last change, else the one before stays. It looks back over ``REACH`` rows
    at most; when it changes, as many rows before the current one are given the new label too, and the look-back starts anew
    at the current row. Comparisons with missing values do not hold.
    """

    def __init__(self):
        self.out: list[str] = []
        self.altitudes: list[float | None] = []
        self.last: str | None = None

    def add(self, speed: float | None, altitude: float | None) -> None:
        self.altitudes = [*self.altitudes[1 - REACH :], altitude]
        missing = float("nan")
        if len(self.altitudes) < LEAST:
            now = self.last or "Ground"
        elif (missing if speed is None else speed) > FLYING:
            first = self.altitudes[0]
            gain = missing if altitude is None or first is None else altitude - first
            now = "Climb" if gain > CHANGE else "Descent" if gain < -CHANGE else "Cruise"
        else:
            now = "Ground"
        if self.last is not None and now != self.last:
            back = min(len(self.altitudes), len(self.out))
            self.out[len(self.out) - back :] = [now] * back
            self.altitudes = [altitude]
        self.out.append(now)
        self.last = now


def labels(speed: Sequence[float | None], altitude: Sequence[float | None]) -> list[str]:
    phases = Phases()
    for s, a in zip(speed, altitude, strict=True):
        phases.add(s, a)
    return phases.out


def with_phase(rows: DataFrame, speed: str, altitude: str, key: Sequence[str], order: Sequence[str], name: str = "phase") -> DataFrame:
    """``rows`` with the phase of each."""
    return scan(rows, [speed, altitude], key, order, name, "string", Phases, delay=REACH)


def vertical_segments(rows: DataFrame, altitude: str, key: Sequence[str], order: Sequence[str], fpm: float = 200.0, least: int = 20) -> DataFrame:
    """Runs of climb, level and descent by the smoothed rate over rows a second apart; short ones join the run before."""
    w = by(key, order)
    at = rows.withColumn("__alt", centred_mean(altitude, key, order))
    at = at.withColumn("__rate", (F.col("__alt") - F.lag("__alt").over(w)) * 60)
    label = F.when(F.col("__rate") > fpm, "climb").when(F.col("__rate") < -fpm, "descent").otherwise("level")
    return merged_runs(at.withColumn("label", label), "label", key, order, F.col("n") >= least)


def top_of_climb_and_descent(rows: DataFrame, altitude: str, speed: str, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """key, cruise (95th percentile of the altitude while faster than 40), toc and tod row numbers."""
    at = numbered(rows, key, order).where(F.col(speed) > 40)
    cruise = at.groupBy(*key).agg(F.percentile(altitude, 0.95).alias("cruise"))
    joined = at.join(cruise, list(key))
    return joined.groupBy(*key, "cruise").agg(
        F.min(F.when(F.col(altitude) >= F.col("cruise") - 500, F.col("row_idx"))).alias("toc"),
        F.max(F.when(F.col(altitude) >= F.col("cruise") - 1500, F.col("row_idx"))).alias("tod"),
    )


def waypoint_events(rows: DataFrame, waypoint: str, key: Sequence[str], order: Sequence[str], distance: str | None = None) -> DataFrame:
    """A row for each run of a waypoint that is not blank: its last row number, and the closest distance."""
    at = legs(numbered(rows, key, order), [waypoint], key, order, "event")
    at = at.where(F.coalesce(F.col(waypoint), F.lit("")) != "")
    out = at.groupBy(*key, "event").agg(F.first(waypoint).alias(waypoint), F.max("row_idx").alias("row_idx"), (F.min(distance) if distance else F.lit(None).cast("double")).alias("closest"))
    return out.withColumn("event", F.row_number().over(Window.partitionBy(*key).orderBy("row_idx")))


def hottest(columns: Sequence[str]) -> tuple[Column, Column, Column]:
    """Highest and lowest of the columns, and the number (from 1, as text) of the first highest; "" without values."""
    values = F.array(*columns)
    top = F.array_max(values)
    return top, F.array_min(values), F.coalesce(F.array_position(values, top).cast("string"), F.lit(""))


def segment_metrics(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Duration, fuel, path, altitudes, rate and mean speeds of each segment of rows (elapsed, fuel_burn, lat, lon, alt, ias, tas, gs).

    Segments of fewer than two rows have nulls.
    """
    at = distance_run(rows, "lat", "lon", keys, order, "__path")
    first, last = (lambda c: F.min_by(c, F.struct(*order))), (lambda c: F.max_by(c, F.struct(*order)))
    out = at.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), (last("elapsed") - first("elapsed")).alias("duration_s"), (last("fuel_burn") - first("fuel_burn")).alias("fuel_gal"),
        F.max("__path").alias("dist_nm"), first("alt").alias("alt_start"), last("alt").alias("alt_end"),
        *[F.avg(finite(F.col(c))).alias(f"avg_{c}") for c in ("ias", "tas", "gs")],
    )
    out = out.withColumn("rate_fpm", F.when(F.col("duration_s") > 0, (F.col("alt_end") - F.col("alt_start")) / (F.col("duration_s") / 60)))
    return out.select(*keys, "n_rows", *[F.when(F.col("n_rows") >= 2, F.col(c)).alias(c) for c in out.columns if c not in (*keys, "n_rows")])


def active_only(segments: DataFrame, label: str, keys: Sequence[str], order: str) -> DataFrame:
    """The segments of one label as one: sums, means weighted by duration, first and last altitude, rate of the gains."""
    own = segments.where((F.col("label") == label) & (F.col("duration_s") > 0))
    weighted = lambda c: F.sum(F.col(c) * F.col("duration_s")) / F.sum(F.when(F.col(c).isNotNull(), F.col("duration_s")))
    gain = F.sum(F.col("alt_end") - F.col("alt_start"))
    return own.groupBy(*keys).agg(
        F.sum("duration_s").alias("duration_s"), F.coalesce(F.sum("fuel_gal"), F.lit(0.0)).alias("fuel_gal"), F.coalesce(F.sum("dist_nm"), F.lit(0.0)).alias("dist_nm"),
        F.min_by("alt_start", order).alias("alt_start"), F.max_by("alt_end", order).alias("alt_end"), (gain / (F.sum("duration_s") / 60)).alias("rate_fpm"),
        *[weighted(f"avg_{c}").alias(f"avg_{c}") for c in ("ias", "tas", "gs")],
    )

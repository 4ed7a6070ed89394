"""Structured Streaming forms: interval statistics with late data, sessions, stateful parsing and segments, incremental catalogues."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from math import asin, cos, radians, sin, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skyloom.functions.geo import RADIUS_NM
from skyloom.sources.keyed import KeyedTable, Partial

#: Stands for an absent time where times are whole microseconds.
NEVER = -(2**63)


def interval_stats(samples: DataFrame, ts: str, value: str, key: Sequence[str], seconds: int, late: str = "10 minutes") -> DataFrame:
    """Count, least, greatest and mean of a value for each key and interval; rows later than ``late`` are dropped."""
    out = samples.withWatermark(ts, late).groupBy(F.window(ts, f"{seconds} seconds"), *key)
    out = out.agg(F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("average"))
    return out.select(*key, F.col("window.start").alias("start"), "count", "min", "max", "average")


def sessions(samples: DataFrame, ts: str, key: Sequence[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Start, end and rows of each key's spells without a longer gap."""
    out = samples.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), *key).agg(F.count("*").alias("n"))
    return out.select(*key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


class Parser:
    """What parsing carries from row to row of a log: the clock, the last position, and the sums of the run of rows since the clock last stepped back."""

    def __init__(self, last: float | None = None, epoch: int = 0, lat: float | None = None, lon: float | None = None, distance: float = 0.0, used: float = 0.0, most_s: float = 10.0):
        self.last, self.epoch, self.lat, self.lon, self.distance, self.used, self.most_s = last, epoch, lat, lon, distance, used, most_s

    def add(self, t: float, lat: float | None, lon: float | None, rate: float | None) -> bool:
        """Takes a row; whether it stands: a repeated second is passed over."""
        if self.last is not None and t == self.last:
            return False
        if self.last is not None and t < self.last:
            self.__init__(None, self.epoch + 1, most_s=self.most_s)
        if self.last is not None and rate is not None:
            self.used += rate * min(t - self.last, self.most_s) / 3600
        self.last = t
        if lat is not None and lon is not None:
            if self.lat is not None:
                a, b = sin(radians(lat - self.lat) / 2), sin(radians(lon - self.lon) / 2)
                self.distance += 2 * RADIUS_NM * asin(sqrt(min(1.0, a * a + cos(radians(self.lat)) * cos(radians(lat)) * b * b)))
            self.lat, self.lon = lat, lon
        return True

    def state(self) -> tuple:
        return self.last, self.epoch, self.lat, self.lon, self.distance, self.used


def parsed(samples: DataFrame, key: str, order: str, ts: str, lat: str, lon: str, rate: str, most_s: float = 10.0) -> DataFrame:
    """key, order, ts, epoch, distance, used: the samples of a stream with the distance flown and the fuel used so far.

    Samples of a log come in its order, in as many batches as may be; within a batch they are sorted. A second that repeats keeps its first
    row. When the clock steps back a new epoch begins and the sums start again; what counts in the end are the rows of a log's last epoch, as
    ``series.last_epoch`` keeps them. Steps longer than ``most_s`` seconds count as so long; rates are an hour; rows without a time are passed over.
    The state of a log is seven numbers.
    """
    own = samples.select(key, order, ts, *[F.col(c).cast("double").alias(n) for c, n in ((lat, "__lat"), (lon, "__lon"), (rate, "__rate"))]).where(F.col(ts).isNotNull())
    own = own.withColumn("__t", F.unix_micros(F.col(ts).cast("timestamp")) / 1e6)
    known = lambda v: None if pd.isna(v) else float(v)

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parser = Parser(*state.get, most_s=most_s) if state.exists else Parser(most_s=most_s)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        told = []
        for i, (t, a, b, r) in enumerate(zip(rows["__t"], rows["__lat"], rows["__lon"], rows["__rate"], strict=True)):
            if parser.add(t, known(a), known(b), known(r)):
                told.append((i, parser.epoch, parser.distance, parser.used))
        state.update(parser.state())
        kept = rows[[key, order, ts]].iloc[[t[0] for t in told]]
        yield kept.assign(epoch=pd.Series([t[1] for t in told], kept.index, "int32"), distance=[t[2] for t in told], used=[t[3] for t in told])

    out = T.StructType([*own.select(key, order, ts).schema.fields, T.StructField("epoch", T.IntegerType()), T.StructField("distance", T.DoubleType()), T.StructField("used", T.DoubleType())])
    return own.groupBy(key).applyInPandasWithState(run, out, "last double, epoch int, lat double, lon double, distance double, used double", "append", GroupStateTimeout.NoTimeout)


def segments(samples: DataFrame, key: str, order: str, ts: str, value: str) -> DataFrame:
    """key, segment (from 0), value, start, end, n: the runs of equal values of a stream, told again in each batch in which they grow.

    The last segment of a key is open until its value changes; write them with ``keep`` by key and segment. Values are text, nulls a value.
    """
    # Times pass Python as whole microseconds, an absent one as the least number: to turn a column of times takes longer than the rest of a log.
    own = samples.select(key, order, F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(NEVER)).alias("__ts"), F.col(value).cast("string").alias("__v"))
    kind = T.StructType([own.schema[key], *T._parse_datatype_string("segment long, value string, start long, end long, n long").fields])

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        rows = parts[0] if len(parts) == 1 else pd.concat(parts)
        if not rows[order].is_monotonic_increasing:
            rows = rows.sort_values(order, kind="stable")
        times, values = rows["__ts"].to_numpy("int64"), rows["__v"].to_numpy(object)
        codes = pd.factorize(values)[0]  # -1 for nulls
        first = np.flatnonzero(np.diff(codes, prepend=-2))
        told = [None if c < 0 else v for c, v in zip(codes[first], values[first], strict=True)]
        start, n = times[first], np.diff(first, append=len(rows))
        number, now, since, before = state.get if state.exists else (-1, None, None, 0)
        if number >= 0 and told[0] == now:
            start[0], n[0] = since, n[0] + before
        else:
            number += 1
        segment = number + np.arange(len(first))
        state.update((int(segment[-1]), told[-1], int(start[-1]), int(n[-1])))
        yield pd.DataFrame({key: [name[0]] * len(first), "segment": segment, "value": told, "start": start, "end": times[np.append(first[1:], len(rows)) - 1], "n": n})

    out = own.groupBy(key).applyInPandasWithState(run, kind, "segment long, value string, start long, n long", "update", GroupStateTimeout.NoTimeout)
    return out.select(key, "segment", "value", *[F.timestamp_micros(F.nullif(F.col(c), F.lit(NEVER))).alias(c) for c in ("start", "end")], "n")


def keep(stream: DataFrame, path: str, key: str | Sequence[str], checkpoint: str) -> StreamingQuery:
    """Writes a stream's rows so that each key has the rows of its last batch; a batch that runs twice changes nothing."""

    def batch(rows: DataFrame, number: int) -> None:
        table = KeyedTable(rows.sparkSession, path, key)
        if number > (table.mark(checkpoint) if table.mark(checkpoint) is not None else -1):
            table.replace(rows, {checkpoint: number})

    return stream.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(batch).start()


def refresh(samples: DataFrame, path: str, key: str | Sequence[str], checkpoint: str, partials: Mapping[str, Partial]) -> StreamingQuery:
    """Takes what is new in a source into a catalogue of partial aggregates by key, then stops.

    A batch reads its own rows and the stored partials of the buckets that its keys lie in, however much came before. The number of the
    last batch is committed with its rows, so a batch that runs twice counts once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        table = KeyedTable(rows.sparkSession, path, key)
        if number > (table.mark(checkpoint) if table.mark(checkpoint) is not None else -1):
            own = rows.groupBy(*table.key).agg(*[first.alias(n) for n, (first, _) in partials.items()])
            table.merge(own, {n: again(n) for n, (_, again) in partials.items()}, {checkpoint: number})

    return samples.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(batch).start()

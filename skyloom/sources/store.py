"""Stored tables: replacing a key's rows, catalogue exports."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom import fields
from skyloom.sources.keyed import KeyedTable, exists, opened


def replace_by_key(rows: DataFrame, path: str, key: str | Sequence[str]) -> None:
    """Writes ``rows`` so that the keys among them replace what was stored for them and no other key changes."""
    KeyedTable(rows.sparkSession, path, key).replace(rows)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The table, with the columns of all its parts."""
    return opened(spark, path).table()


def as_text(rows: DataFrame, ts: str) -> DataFrame:
    """Every column as text, the time in ISO 8601 and in UTC first."""
    rest = [c for c in rows.columns if c != ts]
    zone = F.to_utc_timestamp(ts, F.current_timezone()) if dict(rows.dtypes)[ts] == "timestamp" else F.col(ts)
    return rows.select(F.date_format(zone, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(ts), *[F.col(f"`{c}`").cast("string").alias(c) for c in rest])


def export_csv(flights: DataFrame, path: str, columns: Sequence[str] = ()) -> None:
    """Writes the named columns of the flights (all without names) as CSV with a header; the executors write in parallel."""
    (flights.select(*columns) if columns else flights).write.mode("overwrite").option("header", True).csv(path)


def export_files(rows: DataFrame, folder: str, name: str, text: str) -> int:
    """Writes each row's text as a file of its own below a folder, by its name, and gives their number; the executors write in parallel, and what was there goes."""
    from skyloom.sources.logscan import located

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, where = located(folder)
        system.create_dir(where, recursive=True)
        for batch in batches:
            for own, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_output_stream(f"{where}/{own}") as out:
                    out.write((body or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], ["n"])

    return rows.where(F.col(name).isNotNull()).select(name, text).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


class Aggregates:
    """A store of interval aggregates, one row an interval and log, that opens only for the version and interval it was made with."""

    def __init__(self, spark: SparkSession, path: str, seconds: int = 60, version: int = 1):
        self.spark, self.path, self.seconds = spark, path, seconds
        own = spark.createDataFrame([(version, seconds)], "version int, seconds int")
        if not exists(spark, f"{path}/config"):
            own.write.parquet(f"{path}/config")
        found = spark.read.parquet(f"{path}/config").orderBy(F.desc("version")).first()
        if (found["version"], found["seconds"]) != (version, seconds):
            raise ValueError(f"the store has version {found['version']} and intervals of {found['seconds']} s")

    def upsert(self, samples: DataFrame, takeoff: DataFrame | None = None, log: str = "LogFileName", ts: str = "ts") -> None:
        """Replaces the stored intervals of the logs among ``samples``; those before a log's ``takeoff`` (log, start), and logs
        without one, are left out."""
        replace_by_key(interval_table(samples, self.seconds, takeoff, log, ts), f"{self.path}/intervals", log)

    def table(self) -> DataFrame:
        return stored(self.spark, f"{self.path}/intervals")

    def remove(self, logs: Sequence[str] | DataFrame, log: str = "LogFileName") -> None:
        """Drops the intervals of some logs, named one by one or by a frame's column ``log``; those that are not there change nothing."""
        names = logs.select(f"`{log}`") if isinstance(logs, DataFrame) else self.spark.createDataFrame([(name,) for name in logs], f"`{log}` string")
        KeyedTable(self.spark, f"{self.path}/intervals", log).delete(names)


def interval_table(samples: DataFrame, seconds: int = 60, takeoff: DataFrame | None = None, log: str = "LogFileName", ts: str = "ts") -> DataFrame:
    """log, Date and the ``field.metric`` columns of what is stored of each interval."""
    from skyloom.operators import series, stats

    if takeoff is not None:
        samples = samples.join(takeoff.select(log, F.col("start").alias("__from")), log).where(F.col(ts) >= F.col("__from")).drop("__from")
    rows = series.intervals(samples, ts, seconds, "Date")
    return stats.wide(rows, fields.STORED_VALUES, fields.STORED_NAMES, [log, "Date"], [ts])


def cached(spark: SparkSession, folder: str, signature: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, written below ``folder`` under a digest of ``signature`` (parameters, file names and sizes) and read
    from there when it is asked for again."""
    path = f"{folder}/{hashlib.md5(signature.encode()).hexdigest()}"
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

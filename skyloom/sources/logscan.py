"""Recorder logs as a Spark data source that reads only what is asked for: some columns, the first or last lines, or every n-th line.

Logs are cut into byte ranges, so that a long one is read by several tasks; a line belongs to the range that it begins in.
Rows carry the byte at which their line begins, which orders a log's rows as line numbers do. The files are opened by the
executors through ``pyarrow.fs``, so a path may name a local or a shared file system.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skyloom.functions.text import number, timestamp
from skyloom.operators.series import last_epoch
from skyloom.sources.logs import CATEGORICAL

#: Bytes of a range, of what is read at a time, and of the preamble (metadata, units, header) at most.
RANGE, BUFFER, PREAMBLE = 64 << 20, 1 << 20, 1 << 20
#: Bytes of short logs that one task reads together, and what opening one counts for.
TOGETHER, OPENING = 16 << 20, 1 << 18
#: Rows of a batch.
ROWS = 8192
TIMES = ("Lcl Date", "Lcl Time", "UTCOfst")


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Part(InputPartition):
    """Ranges (path, first and last byte) that one task reads."""

    ranges: list[tuple[str, int, int]]


class LogSource(DataSource):
    """Options: ``path`` (a file or a folder and what is below it), ``columns`` (joined by line ends), ``every`` (lines whose number
    it divides), ``head`` (first lines, the preamble's among them), ``tail`` (last bytes), ``range`` (bytes of a task)."""

    @classmethod
    def name(cls) -> str:
        return "recorder_log"

    def columns(self) -> list[str]:
        return [c for c in self.options.get("columns", "").split("\n") if c]

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("path", T.StringType()), T.StructField("at", T.LongType()), *[T.StructField(c, T.StringType()) for c in self.columns()]])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return LogReader(self.options, self.columns())


class LogReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.path, self.columns = options["path"], columns
        self.every, self.tail, self.range = int(options.get("every", 1)), int(options.get("tail", 0)), int(options.get("range", RANGE))
        self.head = int(options["head"]) if "head" in options else None

    def _files(self) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
        system, where = located(self.path)
        found = system.get_file_info(where)
        found = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(where, recursive=True))
        return system, sorted((f for f in found if f.type == fs.FileType.File and re.match(r"^log_.*\.csv$", f.base_name)), key=lambda f: f.path)

    def partitions(self) -> list[Part]:
        """Long logs are cut, short ones are read together."""
        cut = []
        for f in self._files()[1]:
            if self.every > 1 or self.head is not None:  # lines are counted from the first one
                cut.append((f.path, 0, f.size))
            elif self.tail:
                cut.append((f.path, max(0, f.size - self.tail), f.size))
            else:
                cut += [(f.path, a, min(f.size, a + self.range)) for a in range(0, f.size, self.range)]
        out: list[Part] = []
        room = 0
        for one in cut:
            cost = one[2] - one[1] + OPENING
            if not out or cost > room:
                out.append(Part([]))
                room = TOGETHER
            out[-1].ranges.append(one)
            room -= cost
        return out or [Part([])]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        for path, begin, end in part.ranges:
            yield from self._range(path, begin, end)

    def _range(self, path: str, begin: int, end: int) -> Iterator[pa.RecordBatch]:
        names = ["path", "at", *self.columns]
        with located(self.path)[0].open_input_file(path) as file:
            start, width, places = self._preamble(file)
            if not places:
                return
            rows: list[list] = []
            for number_, at, line in self._lines(file, max(start, begin), end, start):
                if number_ is not None and number_ % self.every:
                    continue
                cells = next(csv.reader([line], skipinitialspace=True), [])
                if len(cells) == width:
                    rows.append([at, *[cells[p].strip() if p is not None else None for p in places]])
                    if len(rows) == ROWS:
                        yield self._batch(path, rows, names)
                        rows = []
            if rows:
                yield self._batch(path, rows, names)

    def _preamble(self, file: pa.NativeFile) -> tuple[int, int, list[int | None]]:
        """Where the rows begin, the number of cells of the header, and the wanted columns' places, the last of equal names."""
        first = file.read_at(min(PREAMBLE, file.size()), 0).split(b"\n", 3)
        if len(first) < 3:
            return 0, 0, []
        header = [c.strip() for c in next(csv.reader([first[2].decode("utf-8", "replace").rstrip("\r")], skipinitialspace=True), [])]
        place = {c: i for i, c in enumerate(header)}
        return sum(len(x) + 1 for x in first[:3]), len(header), [place.get(c) for c in self.columns]

    def _lines(self, file: pa.NativeFile, begin: int, end: int, start: int) -> Iterator[tuple[int | None, int, str]]:
        """Number (where lines are counted), first byte and text of the lines that begin in a range."""
        counted = self.every > 1 or self.head is not None
        number_, at, rest = 3, begin, b""
        if begin > start:  # the line that runs into the range is the one before's
            at, rest = begin - 1, b""
        place, skip = at, begin > start
        while at < end:
            data = file.read_at(BUFFER, place)
            place += len(data)
            pieces = (rest + data).split(b"\n")
            rest = pieces.pop()
            if not data and rest:
                pieces, rest = [rest], b""
            for piece in pieces:
                if at >= end or (self.head is not None and number_ >= self.head):
                    return
                if not skip and piece.strip():
                    yield (number_ if counted else None), at, piece.decode("utf-8", "replace").rstrip("\r")
                skip = False
                at += len(piece) + 1
                number_ += 1
            if not data:
                return

    def _batch(self, path: str, rows: list[list], names: list[str]) -> pa.RecordBatch:
        parts = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.repeat(path, len(rows)), pa.array(parts[0], pa.int64()), *[pa.array(p, pa.string()) for p in parts[1:]]], names)


def cells(spark: SparkSession, path: str, columns: Sequence[str], **options: int) -> DataFrame:
    """path, at and the named columns of the logs as they stand, nulls in logs that lack a column."""
    spark.dataSource.register(LogSource)
    return spark.read.format("recorder_log").options(path=path, columns="\n".join(columns), **options).load()


def samples(spark: SparkSession, path: str, columns: Sequence[str], **options: int) -> DataFrame:
    """path, row_idx (the byte a line begins at), ts and the named columns, numbers but for ``CATEGORICAL`` ones.

    As ``logs.samples``: rows whose number of cells differs from the header's go, numbers that do not parse are null, repeated seconds and
    what precedes a clock step backwards go. Options: every, head, tail, range.
    """
    rows = cells(spark, path, [*TIMES, *columns], **options)
    at = timestamp(*[F.col(c) for c in TIMES])
    out = rows.select("path", F.col("at").alias("row_idx"), at.alias("ts"), *[(F.coalesce(F.col(c), F.lit("")) if c in CATEGORICAL else number(F.col(c))).alias(c) for c in columns])
    return last_epoch(out.where("ts IS NOT NULL"), "ts", ["path"], ["row_idx"])


def peeked(spark: SparkSession, path: str, head: int = 5000, tail: int = 32 << 10, lat: str = "Latitude", lon: str = "Longitude") -> DataFrame:
    """path, first and last (struct date, time, lat, lon): the first position in a log's ``head`` lines after the preamble, and the last one in its ``tail``
    bytes; null where there is none. The rest of a log is not read."""
    fix = F.struct(F.col(TIMES[0]).alias("date"), F.col(TIMES[1]).alias("time"), number(F.col(lat)).alias("lat"), number(F.col(lon)).alias("lon"))

    def end(pick, **options: int) -> DataFrame:
        rows = cells(spark, path, [TIMES[0], TIMES[1], lat, lon], **options).withColumn("fix", fix).where("fix.lat IS NOT NULL AND fix.lon IS NOT NULL")
        return rows.groupBy("path").agg(pick("fix", "at").alias("fix"))

    first, last = end(F.min_by, head=head + 3), end(F.max_by, tail=tail)
    return first.withColumnRenamed("fix", "first").join(last.withColumnRenamed("fix", "last"), "path", "full")

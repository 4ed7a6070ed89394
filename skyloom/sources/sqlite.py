"""Tables of a SQLite file as a Spark data source: the wanted columns alone, read by several tasks in ranges of row numbers.

The file is opened for reading only, by the executors, so it lies where they can open it. Tables without row numbers are read by one task.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a batch.
ROWS = 8192


def opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file:')}?mode=ro", uri=True)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@dataclass
class Part(InputPartition):
    begin: int | None
    end: int | None


class SqliteSource(DataSource):
    """Options: ``path``, ``table``, ``columns`` (joined by line ends; all by default), ``parts`` (tasks)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> T.StructType:
        with opened(self.options["path"]) as db:
            known = {r[1]: r[2].upper() for r in db.execute(f"PRAGMA table_info({quoted(self.options['table'])})")}
        wanted = [c for c in self.options.get("columns", "").split("\n") if c] or list(known)
        missing = [c for c in wanted if c not in known]
        if missing:
            raise ValueError(f"{self.options['table']} has no columns {missing}")

        def kind(declared: str) -> T.DataType:
            if "INT" in declared:
                return T.LongType()
            return T.DoubleType() if any(x in declared for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")) else T.BinaryType() if "BLOB" in declared else T.StringType()

        return T.StructType([T.StructField(c, kind(known[c])) for c in wanted])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(dict(self.options), schema)


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.path, self.table, self.parts, self.kind = options["path"], options["table"], int(options.get("parts", 8)), schema

    def partitions(self) -> list[Part]:
        with opened(self.path) as db:
            try:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:  # a table without row numbers
                return [Part(None, None)]
        if low is None:
            return [Part(0, 0)]
        step = -(-(high - low + 1) // self.parts)
        return [Part(a, min(high, a + step - 1)) for a in range(low, high + 1, step)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.kind)
        names = ", ".join(quoted(f.name) for f in self.kind.fields)
        where, values = ("", ()) if part.begin is None else (" WHERE rowid BETWEEN ? AND ?", (part.begin, part.end))
        # What a column holds that is not of its declared type is null, as SQLite allows any.
        own = {T.LongType(): int, T.DoubleType(): (int, float), T.StringType(): str, T.BinaryType(): bytes}
        with opened(self.path) as db:
            rows = db.execute(f"SELECT {names} FROM {quoted(self.table)}{where}", values)
            while batch := rows.fetchmany(ROWS):
                cells = zip(*batch, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([v if isinstance(v, own[f.dataType]) else None for v in c], t.type) for c, f, t in zip(cells, self.kind.fields, schema, strict=True)], schema=schema)


def table(spark: SparkSession, path: str, name: str, columns: Sequence[str] = (), parts: int = 8) -> DataFrame:
    """The named columns (all without names) of a table of a SQLite file."""
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_table").options(path=path, table=name, columns="\n".join(columns), parts=parts).load()


def airports(spark: SparkSession, path: str, name: str = "airports") -> DataFrame:
    """ident, lat, lon of a database of airports, for ``joins.nearest_of_all`` and ``joins.resolved``; rows without a position go."""
    rows = table(spark, path, name, ["ident", "latitude_deg", "longitude_deg"])
    return rows.select("ident", F.col("latitude_deg").alias("lat"), F.col("longitude_deg").alias("lon")).where("ident IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")


def nav_model(spark: SparkSession, path: str, names: Sequence[str] = ("airports", "fixes", "navaids")) -> DataFrame:
    """ident, lat, lon, navaid of the points of a navigation database, from those of the named tables that it has."""
    with opened(path) as db:
        known = {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
    found = [airports(spark, path, n).withColumn("navaid", F.lit(n == "navaids")) for n in names if n in known]
    if not found:
        raise ValueError(f"{path} has none of the tables {list(names)}")
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return out

"""Recorder logs: three lines of preamble, then a row a second of blank-padded cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom import fields
from skyloom.functions.text import file_kind, number, timestamp
from skyloom.operators.series import last_epoch

#: Columns whose cells are names, not numbers.
CATEGORICAL = ("AtvWpt", "HSIS", "NAV1", "NAV2", "COM1", "COM2", "AfcsOn", "GPSfix", "RollM", "PitchM", "Lcl Date", "Lcl Time", "UTCOfst")


def cells(line: Column) -> Column:
    """The cells of a line: parted by commas, blanks around them dropped; cells in quotes may hold commas, and quotes twice."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',([\x20\t]*"(?:[^"]|"")*"[^,]*|[^,]*)'), F.lit(1))
    plain = lambda c: F.when(c.startswith('"'), F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c)
    return F.transform(raw, lambda c: plain(F.trim(c)))


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, lines of the logs in a folder and below, by their names; a log is read whole, as one row."""
    read = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return read.where(file_kind(F.element_at(F.split("path", "/"), -1)) == "log").select("path", F.split("value", "\r?\n").alias("lines"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no (from 0), line, cells of the logs in a folder."""
    rows = files(spark, path).select("path", F.posexplode("lines").alias("line_no", "line")).where("line <> ''")
    return rows.withColumn("cells", cells(F.col("line")))


def listed(spark: SparkSession, path: str) -> DataFrame:
    """path, name, kind (log, report, system) of the recorder's files in a folder and below, each once."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return found.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("kind", file_kind(F.col("name"))).where("kind IS NOT NULL").distinct()


def metadata(rows: DataFrame) -> DataFrame:
    """path, meta map<string,string> of the first lines."""
    first = rows.where("line_no = 0 AND line LIKE '#%'")
    keys, values = (F.regexp_extract_all("line", F.lit(r'([A-Za-z_]+)="([^"]*)"'), F.lit(i)) for i in (1, 2))
    return first.select("path", F.map_from_arrays(keys, values).alias("meta"))


def columns(rows: DataFrame) -> DataFrame:
    """path, position, field, unit, kind (ignored, name, number) of each log's columns, by its units and header lines."""
    own = rows.where("line_no IN (1, 2)").groupBy("path").agg(F.max(F.when(F.col("line_no") == 1, F.col("cells"))).alias("u"), F.max(F.when(F.col("line_no") == 2, F.col("cells"))).alias("h"))
    at = own.select("path", F.posexplode(F.arrays_zip(F.col("h").alias("field"), F.col("u").alias("unit"))).alias("position", "c")).select("path", "position", "c.field", "c.unit")
    at = at.where("field IS NOT NULL")
    named = [f for f, (_, _, k) in fields.FIELDS.items() if k == "name"]
    told = F.coalesce("unit", F.lit(""))
    kind = F.when(F.col("field").isin(named), "name").when(told.rlike("^(#yyy|hh:)"), "ignored").when(told.isin("ident", "enum"), "name").otherwise("number")
    return at.withColumn("kind", kind)


def samples(spark: SparkSession, path: str, columns: list[str], every: int = 1, most_lines: int | None = None) -> DataFrame:
    """path, row_idx, ts and the named columns of each log; logs that lack a column have nulls in it.

    Columns are found by each log's own header line, so logs of different layouts read together; where one
    comes twice the last counts. Rows whose number of cells differs from the header's go; numbers that do not
    parse are null; repeated seconds and what precedes a clock step backwards go. ``every`` keeps the lines
    whose number it divides, ``most_lines`` the first lines, the preamble's among them.
    """
    wanted = ["Lcl Date", "Lcl Time", "UTCOfst", *columns]
    header = files(spark, path).where(F.size("lines") > 2).withColumn("header", cells(F.get("lines", F.lit(2))))
    place = lambda c: F.array_max(F.transform("header", lambda x, i: F.when(x == c, i)))
    placed = header.select("path", "lines", F.size("header").alias("n"), F.array(*[place(c) for c in wanted]).alias("at"))
    rows = placed.select("path", "n", "at", F.posexplode("lines").alias("line_no", "line")).where((F.col("line_no") > 2) & (F.col("line") != "") & (F.col("line_no") % every == 0))
    if most_lines is not None:
        rows = rows.where(F.col("line_no") < most_lines)
    rows = rows.withColumn("cells", cells(F.col("line"))).where(F.size("cells") == F.col("n"))
    cell = lambda k: F.when(F.get("at", F.lit(k)).isNotNull(), F.get("cells", F.get("at", F.lit(k))))
    out = rows.select(
        "path", F.col("line_no").alias("row_idx"), timestamp(cell(0), cell(1), cell(2)).alias("ts"),
        *[(F.coalesce(cell(k), F.lit("")) if c in CATEGORICAL else number(cell(k))).alias(c) for k, c in enumerate(columns, 3)],
    )
    return last_epoch(out.where("ts IS NOT NULL"), "ts", ["path"], ["row_idx"])


def end_fixes(rows: DataFrame, key: str = "path", order: str = "row_idx", lat: str = "Latitude", lon: str = "Longitude") -> DataFrame:
    """key, first and last (struct ts, lat, lon) of the rows with a position."""
    fix = F.struct(F.col("ts"), F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    return rows.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(key).agg(F.min_by(fix, order).alias("first"), F.max_by(fix, order).alias("last"))


def airports(spark: SparkSession, path: str) -> DataFrame:
    """The airport table of a CSV file, heliports left out."""
    rows = spark.read.option("header", True).csv(path).where("type <> 'heliport'")
    return rows.select("ident", "name", F.col("latitude_deg").cast("double").alias("lat"), F.col("longitude_deg").cast("double").alias("lon"))


def runways(spark: SparkSession, path: str, airports: DataFrame) -> DataFrame:
    """ident, length_ft, width_ft, surface, lighted, closed of the runways of known airports, from a CSV file."""
    rows = spark.read.option("header", True).csv(path)
    own = rows.select(F.col("airport_ident").alias("ident"), F.col("length_ft").try_cast("double").alias("length_ft"), F.col("width_ft").try_cast("double").alias("width_ft"), "surface", *[(F.col(c) == "1").alias(c) for c in ("lighted", "closed")])
    return own.join(airports.select("ident"), "ident", "left_semi")


def fixes(spark: SparkSession, path: str) -> DataFrame:
    """ident, lat, lon of the named points of a CSV file (ident, latitude_deg, longitude_deg), for ``joins.resolved``; rows without a position go."""
    rows = spark.read.option("header", True).csv(path)
    own = rows.select(F.upper(F.trim("ident")).alias("ident"), F.col("latitude_deg").try_cast("double").alias("lat"), F.col("longitude_deg").try_cast("double").alias("lon"))
    return own.where("ident <> '' AND abs(lat) <= 90 AND abs(lon) <= 180").distinct()

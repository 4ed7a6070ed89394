"""Reports of the installed avionics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KIND = "info map<string,string>, aircraftIdentifier string, airframeName string, systemId string"


@F.pandas_udf(T.StringType())
def _text(content: pd.Series) -> pd.Series:
    """Reports are small files in the Mac's old encoding, which Spark does not decode."""
    return content.map(lambda b: bytes(b).decode("mac_roman"))


def reports(spark: SparkSession, path: str) -> DataFrame:
    """path, info, aircraftIdentifier, airframeName, systemId of report CSV files (names on the second line, values on the third).

    Files of three lines or fewer give nothing; zeros before a system id are dropped.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", _text("content").alias("value"))
    lines = rows.select("path", F.filter(F.split("value", "\r\n|\r|\n"), lambda x: x != "").alias("l")).where(F.size("l") > 3)
    parts = lambda i: F.transform(F.split(F.get("l", F.lit(i)), ","), lambda c: F.btrim(c, F.lit('" ')))
    both = lines.select("path", F.arrays_zip(parts(1).alias("k"), parts(2).alias("v")).alias("z"))
    info = both.select("path", F.map_from_entries(F.filter("z", lambda e: e["k"].isNotNull() & (e["k"] != ""))).alias("info"))
    return info.select("path", "info", F.col("info")["Aircraft Identifier"].alias("aircraftIdentifier"), F.col("info")["Airframe Name"].alias("airframeName"), F.regexp_replace(F.col("info")["System ID"], "^0+", "").alias("systemId"))


def systems(spark: SparkSession, path: str) -> DataFrame:
    """The same of system JSON files."""
    return spark.read.schema(KIND).option("multiLine", True).json(path)

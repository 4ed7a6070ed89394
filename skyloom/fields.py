"""The recorder's fields: their order, unit and kind, what is shown of them, and what is stored of each interval."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.text import finite
from skyloom.functions.units import UNITS, converted

#: Order, unit in the log and kind of each known column.
FIELDS: dict[str, tuple[int, str, str]] = {
    "AtvWpt": (1, "ident", "name"), "Distance": (2, "nm", "number"), "AltInd": (4, "ft", "number"), "AltMSL": (5, "ft msl", "number"),
    "AltGPS": (6, "ft wgs", "number"), "BaroA": (7, "inch", "number"), "AltB": (8, "ft Baro", "number"), "OAT": (10, "deg C", "number"), "IAS": (11, "kt", "number"),
    "TAS": (12, "kt", "number"), "GndSpd": (13, "kt", "number"), "VSpd": (20, "fpm", "number"), "VSpdG": (21, "fpm", "number"), "HDG": (22, "deg", "number"),
    "TRK": (23, "deg", "number"), "CRS": (24, "deg", "number"), "WptBrg": (30, "deg", "number"), "FQtyT": (30, "gals", "number"), "WndDr": (31, "deg", "number"),
    "FQtyL": (31, "gals", "number"), "WndSpd": (32, "kt", "number"), "FQtyR": (32, "gals", "number"), "WndDirect": (33, "kt", "number"),
    "FTotalizerT": (33, "gals", "number"), "WndCross": (34, "kt", "number"), "WptDst": (35, "nm", "number"), "HSIS": (40, "enum", "name"), "NAV1": (41, "MHz", "name"),
    "NAV2": (42, "MHz", "name"), "COM1": (43, "MHz", "name"), "COM2": (44, "MHz", "name"), "AfcsOn": (45, "bool", "name"), "GPSfix": (46, "enum", "name"),
    "E1 FFlow": (100, "gph", "number"), "E1 MAP": (101, "Hg", "number"), "E1 RPM": (102, "rpm", "number"), "E1 %Pwr": (103, "%", "number"),
    "E1 OilT": (104, "deg F", "number"), "E1 OilP": (105, "psi", "number"), "E1 TIT1": (110, "deg F", "number"), "E1 TIT2": (111, "deg F", "number"),
    "E1 CHTMax": (120, "deg F", "number"), "E1 CHTMin": (121, "deg F", "number"), "E1 CHTMaxIdx": (122, "enum", "name"), "E1 CHT1": (130, "deg F", "number"),
    "E1 CHT2": (131, "deg F", "number"), "E1 CHT3": (132, "deg F", "number"), "E1 CHT4": (133, "deg F", "number"), "E1 CHT5": (134, "deg F", "number"),
    "E1 CHT6": (135, "deg F", "number"), "E1 EGTMax": (150, "deg F", "number"), "E1 EGTMin": (151, "deg F", "number"), "E1 EGTMaxIdx": (152, "enum", "name"),
    "E1 EGT1": (160, "deg F", "number"), "E1 EGT2": (161, "deg F", "number"), "E1 EGT3": (162, "deg F", "number"), "E1 EGT4": (163, "deg F", "number"),
    "E1 EGT5": (164, "deg F", "number"), "E1 EGT6": (165, "deg F", "number"), "E1 Torq": (170, "ft lbs", "number"), "E1 NG": (171, "%", "number"),
    "E1 ITT": (172, "deg C", "number"), "E1 FPres": (175, "psi", "number"), "HCDI": (200, "fsd", "number"), "VCDI": (201, "fsd", "number"),
    "MagVar": (202, "deg", "number"), "volt1": (203, "volts", "number"), "volt2": (204, "volts", "number"), "amp1": (205, "amps", "number"),
    "Pitch": (206, "deg", "number"), "Roll": (207, "deg", "number"), "LatAc": (208, "G", "number"), "NormAc": (209, "G", "number"), "E2 FFlow": (700, "gph", "number"),
    "E2 MAP": (701, "Hg", "number"), "E2 RPM": (702, "rpm", "number"), "E2 Torq": (703, "ft lbs", "number"), "E2 NG": (704, "%", "number"),
    "E2 ITT": (705, "deg C", "number"), "E2 %Pwr": (706, "%", "number"), "E2 FPres": (707, "psi", "number"), "E2 OilT": (708, "deg F", "number"),
    "E2 OilP": (708, "psi", "number"), "RollM": (800, "enum", "name"), "PitchM": (801, "enum", "name"), "RollC": (802, "deg", "number"), "PichC": (803, "deg", "number"),
    "HAL": (804, "mt", "number"), "VAL": (805, "mt", "number"), "HPLwas": (806, "mt", "number"), "HPLfd": (807, "mt", "number"), "VPLwas": (808, "mt", "number"),
    "Latitude": (900, "degrees", "number"), "Longitude": (901, "degrees", "number"),
}

#: A log's unit to the name that ``units.UNITS`` has for it; other units are plain numbers.
LOG_UNITS = {
    "%": "percent", "Hg": "inHg", "inch": "inHg", "deg": "degree", "degrees": "degree", "fsd": "degree", "deg C": "degC", "deg F": "degF", "fpm": "fpm", "ft": "ft",
    "ft msl": "ft", "ft Baro": "ft", "ft wgs": "ft", "gals": "gallon", "gph": "gph", "kt": "kt", "nm": "nm", "psi": "psi", "rpm": "rpm",
}
#: Unit that a field is shown in, where it is not the log's own.
SHOWN = {"BaroA": "hPa", "VSpd": "kt", "OAT": "degC"}
#: Fields whose leg is told by its greatest, its last or its first value; all other numbers by their mean.
GREATEST = {"AltInd", "AltGPS", "AltMSL", "AltB", "LatAc", "NormAc", "E1 TIT1", "E1 TIT2", "E1 ITT", "E2 ITT", "E1 EGTMax", "E1 CHTMax", "E1 EGTMin", "E1 CHTMin", *(f"E1 {k}{i}" for k in ("CHT", "EGT") for i in range(1, 7))}
LAST = {"FQtyL", "FQtyR", "FQtyT", "FTotalizerT", "WptDst", "Distance", "Elapsed"}
FIRST = {"Latitude", "Longitude", "AtvWpt", "NAV1", "NAV2", "COM1", "COM2", "UTCOfst", "Lcl Date", "Lcl Time", "E1 EGTMaxIdx", "E1 CHTMaxIdx", "AfcsOn", "LogFileName", "FltPhase"}
#: The log field that tells how a figure of a flight's summary is shown.
SUMMARY_FIELDS = {
    "FuelStart": "FQtyT", "FuelEnd": "FQtyT", "FuelUsed": "FQtyT", "FuelTotalizer": "FTotalizerT", "GpH": "E1 FFlow", "NmpG": "Distance",
    "Distance": "Distance", "Altitude": "AltMSL", "Hobbs": "Lcl Time", "Flying": "Lcl Time", "Moving": "Lcl Time", "GroundSpeed": "GndSpd",
}
_ENDS = ("max", "min")
#: What is stored of each interval, of number fields and of name fields.
STORED_VALUES = {
    "Distance": ("total",), "Latitude": ("start",), "Longitude": ("start",), **{f: ("average",) for f in ("AltMSL", "OAT", "IAS", "TAS", "GndSpd", "volt1", "volt2")},
    "amp1": _ENDS, "FQtyT": ("start",), "FTotalizerT": ("total",), **{f: ("average", *_ENDS) for f in ("E1 FFlow", "E1 MAP", "E1 RPM")}, "E1 OilP": _ENDS, "E1 OilT": _ENDS,
    "E1 EGTMax": _ENDS, **{f"E1 {k}{i}": _ENDS for k in ("EGT", "CHT") for i in range(1, 7)},
}
STORED_NAMES = {**{f: ("mostFrequent",) for f in ("AfcsOn", "RollM", "PitchM")}, "E1 EGTMaxIdx": ("end",), "E1 CHTMaxIdx": ("end",)}


def order(field: str) -> int:
    return FIELDS[field][0] if field in FIELDS else 9999


def unit(field: str) -> str | None:
    """The name in ``units.UNITS`` of the unit that a field is logged in; None for plain numbers."""
    return LOG_UNITS.get(FIELDS[field][1]) if field in FIELDS else None


def kind(field: str, logged_unit: str = "") -> str:
    """ignored, name or number, by the log's units cell, unless the dictionary says that the field is a name."""
    if field in FIELDS and FIELDS[field][2] == "name":
        return "name"
    if logged_unit.startswith(("#yyy", "hh:")):
        return "ignored"
    return "name" if logged_unit in ("ident", "enum") else "number"


def metric(field: str) -> str:
    """The statistic that stands for a leg's values of a field."""
    return "max" if field in GREATEST else "end" if field in LAST else "start" if field in FIRST else "average"


def ordered(fields: Iterable[str]) -> list[str]:
    return sorted(dict.fromkeys(fields), key=lambda f: (order(f), f))


def united(*field_sets: Iterable[str]) -> list[str]:
    """The fields of all sets, each once, in the dictionary's order."""
    return ordered(f for fields in field_sets for f in fields)


def dictionary(spark: SparkSession) -> DataFrame:
    """field, order, unit, kind of the known fields."""
    return spark.createDataFrame([(k, *v) for k, v in FIELDS.items()], "field string, `order` int, unit string, kind string")


def imported(spark: SparkSession, path: str) -> DataFrame:
    """A dictionary from CSV (field, order, unit, description, unit_description, type): the rows with an order, as whole numbers."""
    rows = spark.read.option("header", True).csv(path)
    return rows.withColumn("order", F.col("order").try_cast("int")).where(F.col("order").isNotNull())


def shown(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``rows`` with the fields in the units that they are shown in."""
    out = {}
    for f in fields:
        own = unit(f)
        target = SHOWN.get(f, own)
        if f in rows.columns and own and target and UNITS[own][0] == UNITS[target][0]:
            out[f] = converted(F.col(f"`{f}`"), own, target)
    return rows.withColumns(out)


def leg_value(stats: dict[str, Column], field: str) -> Column:
    """The one statistic of a field, of those of ``stats.value_stats``, that a leg shows."""
    return stats[metric(field)]


def frame(rows: DataFrame, what: str, index: Sequence[str], wanted: Sequence[str] = (), every: bool = True) -> DataFrame:
    """The recorder's columns of one sort beside ``index``: "number", "name" or "position".

    Numbers are finite or null; with ``wanted``, rows where one of those is null go, and without ``every`` only those
    columns stay. Names are text. A position is a struct of both coordinates, null unless both are numbers.
    """
    if what == "position":
        lat, lon = (finite(F.col(c).cast("double")) for c in ("Latitude", "Longitude"))
        rows = rows.select(*index, F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon"))).alias("position"))
        return rows.where("position IS NOT NULL") if wanted else rows
    own = ordered(c for c in rows.columns if c in FIELDS and kind(c) == what and c not in index)
    shape = (lambda c: finite(F.col(f"`{c}`").cast("double"))) if what == "number" else (lambda c: F.col(f"`{c}`").cast("string"))
    keep = own if every or not wanted else [c for c in own if c in wanted]
    rows = rows.select(*index, *[shape(c).alias(c) for c in own])
    if what == "number":
        rows = rows.dropna(subset=[f"`{c}`" for c in own if c in wanted]) if set(wanted) & set(own) else rows
    return rows.select(*index, *[F.col(f"`{c}`") for c in keep])

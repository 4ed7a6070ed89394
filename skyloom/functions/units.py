"""Display units: conversion between units of one quantity as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame

#: Unit to (quantity, factor, offset); value * factor + offset is in the quantity's SI unit.
UNITS = {
    "m": ("length", 1.0, 0.0), "km": ("length", 1000.0, 0.0), "ft": ("length", 0.3048, 0.0), "nm": ("length", 1852.0, 0.0), "mile": ("length", 1609.344, 0.0),
    "mps": ("speed", 1.0, 0.0), "kt": ("speed", 1852 / 3600, 0.0), "mph": ("speed", 0.44704, 0.0), "kph": ("speed", 1 / 3.6, 0.0), "fpm": ("speed", 0.00508, 0.0),
    "degC": ("temperature", 1.0, 273.15), "degF": ("temperature", 5 / 9, 459.67 * 5 / 9), "K": ("temperature", 1.0, 0.0),
    "Pa": ("pressure", 1.0, 0.0), "hPa": ("pressure", 100.0, 0.0), "psi": ("pressure", 6894.757293168, 0.0), "inHg": ("pressure", 3386.389, 0.0),
    "liter": ("volume", 0.001, 0.0), "gallon": ("volume", 0.003785411784, 0.0),
    "lph": ("flow", 0.001 / 3600, 0.0), "gph": ("flow", 0.003785411784 / 3600, 0.0),
    "second": ("time", 1.0, 0.0), "minute": ("time", 60.0, 0.0), "hour": ("time", 3600.0, 0.0),
    "kg": ("mass", 1.0, 0.0), "lb": ("mass", 0.45359237, 0.0),
    "rpm": ("rotation", 1.0, 0.0), "percent": ("share", 1.0, 0.0), "degree": ("angle", 1.0, 0.0),
}


def converted(value: Column, source: str, target: str) -> Column:
    """``value`` in another unit of the same quantity; null stays null. Other pairs are refused."""
    if source == target:
        return value
    (quantity, a, b), (other, c, d) = UNITS[source], UNITS[target]
    if quantity != other:
        raise ValueError(f"{source} and {target} measure different things")
    return value * (a / c) + (b - d) / c


def displayed(rows: DataFrame, units: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``rows`` with the columns that ``units`` names (column to recorded and shown unit) converted; absent ones are ignored."""
    from pyspark.sql import functions as F

    return rows.withColumns({c: converted(F.col(f"`{c}`"), *pair) for c, pair in units.items() if c in rows.columns})

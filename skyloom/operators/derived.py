"""Columns computed from a recorder row's others: a table of named calculations, and calculations over the last rows.

A calculation reads finite inputs (others are null) and runs on tables that have all of them; those of a table run
in the order of ``CALCULATIONS``, so later ones may read what earlier ones write.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.geo import crosswind, wind_along
from skyloom.functions.text import finite
from skyloom.operators.phase import hottest, with_phase
from skyloom.operators.series import by, running_total


@dataclass(frozen=True)
class Calculation:
    """``add(rows, key, order)`` gives ``rows`` with the columns ``outputs``, computed from ``inputs``."""

    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    add: Callable[[DataFrame, Sequence[str], Sequence[str]], DataFrame]


def of_row(inputs: Sequence[str], outputs: Sequence[str], f: Callable[..., Sequence[Column]]) -> Calculation:
    """A calculation within the row: ``f`` takes the inputs' columns and gives one column for each output."""

    def add(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
        found = f(*[finite(F.col(f"`{c}`").cast("double")) for c in inputs])
        return rows.withColumns(dict(zip(outputs, found, strict=True)))

    return Calculation(tuple(inputs), tuple(outputs), add)


def of_series(inputs: Sequence[str], output: str, f: Callable[..., Column]) -> Calculation:
    """A calculation that also reads the rows before: ``f`` takes the inputs' columns, key and order, and gives a window column."""

    def add(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
        return rows.withColumn(output, f(*[finite(F.col(f"`{c}`").cast("double")) for c in inputs], key, order))

    return Calculation(tuple(inputs), (output,), add)


def _cylinders(name: str, n: int = 6) -> Calculation:
    """Highest and lowest of an engine's cylinders, and the number of the first highest."""
    return of_row([f"E1 {name}{i + 1}" for i in range(n)], [f"E1 {name}{m}" for m in ("Max", "Min", "MaxIdx")], lambda *t: hottest(t))


CALCULATIONS: dict[str, Calculation] = {
    "fuel": of_row(["FQtyL", "FQtyR"], ["FQtyT"], lambda left, right: [left + right]),
    "exhaust": _cylinders("EGT"),
    "heads": _cylinders("CHT"),
    "wind": of_row(["WndDr", "WndSpd", "CRS"], ["WndCross", "WndDirect"], lambda d, s, c: [crosswind(s, d, c), wind_along(s, d, c)]),
    "totalizer": of_series(["E1 FFlow"], "FTotalizerT", running_total),
    "phase": Calculation(("IAS", "AltMSL"), ("FltPhase",), lambda rows, key, order: with_phase(rows, "IAS", "AltMSL", key, order, "FltPhase")),
}


def derived(rows: DataFrame, key: Sequence[str], order: Sequence[str], calculations: Sequence[Calculation] | None = None) -> DataFrame:
    """``rows`` with the outputs of all calculations whose inputs the table has; an output of the same name is replaced."""
    for c in CALCULATIONS.values() if calculations is None else calculations:
        if set(c.inputs) <= set(rows.columns):
            rows = c.add(rows, key, order)
    return rows


def rolled(rows: DataFrame, columns: Sequence[str], n: int, key: Sequence[str], order: Sequence[str], name: str, f: Callable[..., Column]) -> DataFrame:
    """``rows`` with what ``f`` says of the last ``n`` rows of the key, this one included.

    ``f`` takes an array for each column, oldest first, nulls kept; fewer than ``n`` at a key's beginning. Labels that
    also depend on the label before are state machines: ``series.scan``.
    """
    window = by(key, order).rowsBetween(1 - n, 0)
    held = [F.transform(F.collect_list(F.struct(F.col(f"`{c}`").alias("v"))).over(window), lambda s: s["v"]) for c in columns]
    return rows.withColumn(name, f(*held))

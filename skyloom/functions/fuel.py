"""Fuel of two tanks as structs left, right (gallons) of columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions import units

#: Kilograms a litre of avgas, and litres a gallon.
AVGAS, LITRES = 0.71, 3.785411784


def tanks(left: Column, right: Column) -> Column:
    return F.struct(left.cast("double").alias("left"), right.cast("double").alias("right"))


def halves(total: Column) -> Column:
    """When only the total is known each tank has half of it."""
    return tanks(total / 2, total / 2)


def each(f: Callable[..., Column], *fuels: Column) -> Column:
    """f on the left tanks and on the right tanks."""
    return tanks(f(*[x["left"] for x in fuels]), f(*[x["right"] for x in fuels]))


def total(fuel: Column) -> Column:
    return fuel["left"] + fuel["right"]


def plus(a: Column, b: Column) -> Column:
    return each(lambda x, y: x + y, a, b)


def minus(a: Column, b: Column) -> Column:
    return each(lambda x, y: x - y, a, b)


def positive(fuel: Column) -> Column:
    """Never negative; what one tank lacks the other one gives, as far as it reaches."""
    left, right, both = fuel["left"], fuel["right"], F.greatest(total(fuel), F.lit(0.0))
    zero = F.lit(0.0)
    own = lambda mine, other: F.when((mine < 0) & (other > 0), zero).when((mine > 0) & (other < 0), both).otherwise(F.greatest(mine, zero))
    return tanks(own(left, right), own(right, left))


def converted(fuel: Column, source: str, target: str) -> Column:
    return each(lambda x: units.converted(x, source, target), fuel)


def rounded(fuel: Column, rule: Callable[[Column], Column] = F.ceil, source: str = "gallon", target: str | None = None) -> Column:
    """Each tank rounded by a rule (up by default), in another unit if one is named."""
    return each(lambda x: rule(x).cast("double"), converted(fuel, source, target or source))


def most_of(a: Column, b: Column) -> Column:
    """Tank by tank the greater; null where either is."""
    return each(lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.greatest(x, y)), a, b)


def least_of(a: Column, b: Column) -> Column:
    return each(lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.least(x, y)), a, b)


def less(a: Column, b: Column) -> Column:
    """Fuels compare by their totals, as do ``same`` and ``within``."""
    return total(a) < total(b)


def same(a: Column, b: Column) -> Column:
    return total(a) == total(b)


def within(a: Column, b: Column, most: Column | float) -> Column:
    return F.abs(total(a) - total(b)) < most


def almost_zero(fuel: Column, most: float = 2.0**-26) -> Column:
    return F.abs(total(fuel)) < most


def capped(fuel: Column, most: Column, least: Column) -> Column:
    """Tank by tank at most ``most``, but at least ``least``."""
    return each(lambda x, m, low: F.greatest(F.least(x, m), low), fuel, most, least)


def mass_kg(fuel: Column) -> Column:
    return total(fuel) * LITRES * AVGAS


def endurance_s(fuel: Column, gallons_an_hour: Column) -> Column:
    return total(fuel) / gallons_an_hour * 3600


def analysed(rows: DataFrame, current: Column, used: Column, target: Column, added: Column, totalizer_start: Column, most: Column, gph: Column, name: str = "analysis") -> DataFrame:
    """``rows`` with a struct of what a refuelling means: for the gauges and for the totaliser, with endurances in seconds.

    What several results need is a column of its own first, so that it is worked out once a row.
    """
    own = rows.withColumns({"__current": current, "__used": used, "__target": target, "__added": added, "__start": totalizer_start, "__most": most, "__gph": gph})
    c = lambda n: F.col(f"__{n}")
    own = own.withColumns({"__counted": positive(minus(c("start"), c("used"))), "__missing": positive(minus(c("target"), c("current")))})
    own = own.withColumns({
        "__wanted": capped(plus(c("current"), c("missing")), c("most"), c("current")),
        "__filled": capped(plus(c("current"), c("added")), c("most"), c("current")), "__filled_counted": capped(plus(c("counted"), c("added")), c("most"), c("counted")),
    })
    own = own.withColumns({"__t_most": total(c("most")), **{f"__t_{n}": total(c(n)) for n in ("current", "counted", "wanted", "filled", "filled_counted")}})
    t = lambda n: F.col(f"__t_{n}")
    lasts, kilograms = (lambda x: x / c("gph") * 3600), (lambda x: x * LITRES * AVGAS)
    out = {
        "current": t("current"), "current_totalizer": t("counted"),
        "target": t("wanted"), "target_add": t("wanted") - t("current"), "target_add_totalizer": t("wanted") - t("counted"),
        "target_save": t("most") - t("wanted"), "target_save_kg": kilograms(t("most") - t("wanted")),
        "added_total": t("filled"), "added_fuel": t("filled") - t("current"),
        "added_save": t("most") - t("filled"), "added_save_kg": kilograms(t("most") - t("filled")),
        "added_total_totalizer": t("filled_counted"), "added_fuel_totalizer": t("filled_counted") - t("counted"),
        "added_save_totalizer": t("most") - t("filled_counted"), "added_save_kg_totalizer": kilograms(t("most") - t("filled_counted")),
        "endurance": lasts(t("current")), "endurance_totalizer": lasts(t("counted")),
        "added_endurance": lasts(t("filled")), "added_endurance_totalizer": lasts(t("filled_counted")),
        "target_endurance": lasts(t("wanted")), "lost_endurance": lasts(t("most") - t("filled")),
        "lost_endurance_totalizer": lasts(t("most") - t("filled_counted")), "target_lost_endurance": lasts(t("most") - t("wanted")),
    }
    return own.withColumn(name, F.struct(*[v.alias(k) for k, v in out.items()])).select(*rows.columns, name)


#: The lines of a fuel planning table: title, by the gauges, by the totaliser, kind (gallon, kg, second).
PLANNING = (
    ("Current", "current", "current_totalizer", "gallon"), ("Current Endurance", "endurance", "endurance_totalizer", "second"),
    ("Target", "target", "target", "gallon"), ("Target Required", "target_add", "target_add_totalizer", "gallon"), ("Target Save", "target_save", "target_save", "gallon"),
    ("Target Mass Save", "target_save_kg", "added_save_kg_totalizer", "kg"), ("Target Endurance", "target_endurance", "target_endurance", "second"), ("Target Lost", "target_lost_endurance", "target_lost_endurance", "second"),
    ("Added", "added_fuel", "added_fuel_totalizer", "gallon"), ("New Total", "added_total", "added_total_totalizer", "gallon"), ("New Save", "added_save", "added_save_totalizer", "gallon"),
    ("New Mass Save", "added_save_kg", "added_save_kg_totalizer", "kg"), ("New Endurance", "added_endurance", "added_endurance_totalizer", "second"), ("Lost Endurance", "lost_endurance", "lost_endurance_totalizer", "second"),
)


def planning_table(rows: DataFrame, key: str, name: str = "analysis") -> DataFrame:
    """key, line (from 0), title, gauges, totalizer, unit: the lines of the planning table of each row that ``analysed`` gives."""
    lines = [F.struct(F.lit(i).alias("line"), F.lit(t).alias("title"), F.col(f"{name}.{a}").alias("gauges"), F.col(f"{name}.{b}").alias("totalizer"), F.lit(u).alias("unit")) for i, (t, a, b, u) in enumerate(PLANNING)]
    return rows.select(key, F.inline(F.array(*lines)))


def next_totalizer_start(start: Column, used: Column, added: Column, target: Column) -> Column:
    """What the totaliser shows at the next start; nothing known means the target was filled."""
    left = F.coalesce(start, F.lit(0.0)) - F.coalesce(used, F.lit(0.0)) + F.coalesce(added, F.lit(0.0))
    return F.when(left > 0, left).otherwise(target)


def valid_added(added: Column, end: Column, most: Column) -> Column:
    return (added + end >= end) & (added + end < most)

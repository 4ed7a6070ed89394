"""Planned routes from HTML tables and placed words."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions import geo, text

#: The labels of a plan's fuel table.
FUEL_LABELS = ("Taxi", "Destination", "Alternate Fuel", "Final Reserve", "Additional", "Min required", "Extra", "Total", "Landing")


def table_cells(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, table_no, row_no, cells of every row of a page's tables, both numbered from 0, tags and entities removed.

    Rows outside of tables are of none. A table in a table ends the outer one's rows.
    """
    at = pages.select(key, F.posexplode(_tables(F.col(html))).alias("table_no", "table"))
    at = at.select(key, "table_no", F.posexplode(_rows(F.col("table"))).alias("row_no", "row"))
    return at.select(key, "table_no", "row_no", F.transform(_cells(F.col("row")), _plain).alias("cells"))


def _tables(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)<table[^>]*>(.*?)(?=</table|<table|$)"), F.lit(1))


def _rows(table: Column) -> Column:
    return F.regexp_extract_all(table, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))


def _cells(row: Column) -> Column:
    return F.regexp_extract_all(row, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))


def _plain(cell: Column) -> Column:
    """A cell's text, tags and entities removed."""
    text = F.replace(F.replace(F.regexp_replace(cell, r"<[^>]*>", " "), F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def first_table(rows: DataFrame, key: str, test: Column, least: int = 1) -> DataFrame:
    """The rows of each page's first table in which ``least`` rows or more meet a test."""
    met = rows.groupBy(key, "table_no").agg(F.count_if(test).alias("__n")).where(F.col("__n") >= least)
    own = met.groupBy(key).agg(F.min("table_no").alias("table_no"))
    return rows.join(own, [key, "table_no"])


COORDINATE = r"^[NS]\d{4}(\.\d+)?/[EW]\d{5}(\.\d+)?$"
#: Where the columns of a printed plan begin, in points from the left edge.
COLUMNS = (("name", 0), ("awy", 130), ("wind", 165), ("hdg", 212), ("tas", 242), ("dist", 268), ("fuelrem", 296), ("fuelused", 326), ("flow", 362), ("time1", 392), ("time2", 416), ("time3", 452))
#: The words of a printed plan's header lines.
HEADINGS = ("AWY", "WIND", "MAG", "KT", "DIST", "FUEL", "G", "TIMES", "REMARKS", "WAYPOINT", "ALT", "DIR/SPD", "HDG", "TAS", "LEG", "REM", "USED", "FLOW", "ETE", "ETA", "COORDINATES", "MSA", "OAT/ISA", "CRS", "GS", "ACTL", "ATE", "ATA")


def words_to_rows(words: DataFrame, key: list[str], bins: dict[str, tuple[float, float]], height: float = 3.0) -> DataFrame:
    """Rows of a printed table from placed words (top, x0, text): lines by height, columns by ranges of x0."""
    at = words.withColumn("line", F.round(F.col("top") / height).cast("int"))
    cell = lambda low, high: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("x0").between(low, high), F.struct("x0", "text")))), lambda x: x["text"]), " ")
    return at.groupBy(*key, "line").agg(*[cell(*b).alias(name) for name, b in bins.items()])


def printed_waypoints(words: DataFrame, key: str, page: str = "page", height: float = 3.0) -> DataFrame:
    """key, seq and the planned figures of the waypoints of a printed plan, from its placed words (page, top, x0, text).

    The words of a plan are brought into one row, which ``printed_plans`` reads.
    """
    own = words.where("text IS NOT NULL AND top IS NOT NULL AND x0 IS NOT NULL")
    own = own.groupBy(key).agg(F.collect_list(F.struct(F.col(page).alias("page"), "top", "x0", "text")).alias("__words"))
    return printed_plans(own, key, "__words", height)


def printed_plans(plans: DataFrame, key: str, words: str, height: float = 3.0) -> DataFrame:
    """key, seq and the planned figures of the waypoints of printed plans, from an array of each one's placed words (page, top, x0, text).

    Pages with three coordinates at least are read. Words at about one height are a line; ``COLUMNS`` part it into cells, of
    which the first word counts; lines that hold words of ``HEADINGS`` alone are passed over. A waypoint has a line with its name and
    figures, then one with its coordinate, altitude, wind, course, ground speed, distance and time left, then further ones with its safe
    altitude, temperature and navaid. The figures are named as in ``waypoints``. A plan is read where it is: its words are neither
    rows of their own nor shuffled or sorted with others'.
    """
    known = F.filter(words, lambda x: x["text"].isNotNull() & x["top"].isNotNull() & x["x0"].isNotNull() & ~F.upper(x["text"]).isin(*HEADINGS))
    own = F.sort_array(F.transform(known, lambda x: F.struct(x["page"].alias("page"), F.round(x["top"] / height).cast("int").alias("line"), x["x0"].alias("x0"), x["text"].alias("text"))))
    same = lambda x, y, *names: reduce(and_, [x[n].eqNullSafe(y[n]) for n in names])
    pages = _runs(own, lambda all_, x, i: (i == 0) | ~same(x, F.get(all_, i - 1), "page"))
    pages = F.filter(pages, lambda p: F.size(F.filter(p, lambda x: x["text"].rlike(COORDINATE))) >= 3)
    lines = _runs(F.flatten(pages), lambda all_, x, i: (i == 0) | ~same(x, F.get(all_, i - 1), "page", "line"))
    # A waypoint begins with the line before its coordinate's.
    points = _runs(lines, lambda all_, _, i: _cell(F.get(all_, i + 1), "name").rlike(COORDINATE))
    points = F.filter(points, lambda p: _cell(F.get(p, F.lit(0)), "name").isNotNull())
    rows = plans.select(key, F.posexplode(points).alias("__at", "__lines"))
    heads, places = ("name", "awy", "wind", "hdg", "tas", "dist", "fuelrem", "fuelused", "flow", "time1", "time2"), ("name", "awy", "wind", "hdg", "tas", "dist", "time1")
    rest = lambda c: F.filter(F.transform(F.filter("__lines", lambda _, i: i >= 2), lambda x: _cell(x, c)), lambda x: x.isNotNull())
    rows = rows.select(
        key, (F.col("__at") + 1).alias("seq"), *[_cell(F.get("__lines", F.lit(0)), c).alias(f"__head_{c}") for c in heads], *[_cell(F.get("__lines", F.lit(1)), c).alias(f"__place_{c}") for c in places],
        *[rest(c).alias(f"__rest_{c}") for c in ("name", "awy", "wind")],
    )
    head, place = (lambda c: F.col(f"__head_{c}")), (lambda c: F.col(f"__place_{c}"))
    later = lambda c, value: F.get(F.filter(F.transform(f"__rest_{c}", value), lambda x: x.isNotNull()), F.lit(0))
    number, pair = text.number, text.pair
    navaid = later("name", lambda x: F.when((F.upper(x) == x) & x.rlike("[A-Z]"), x))
    spot, name = geo.coordinate(place("name")), head("name")
    return rows.select(
        key, "seq", name.alias("name"), place("name").alias("coord_raw"), navaid.alias("navaid"), head("awy").alias("airway"), number(place("awy")).alias("altitude_ft"), later("awy", number).alias("msa"),
        head("wind").alias("wind_comp_raw"), pair(place("wind"))["first"].alias("wind_dir"), pair(place("wind"))["second"].alias("wind_speed"),
        later("wind", lambda x: pair(x)["first"]).alias("oat"), later("wind", lambda x: pair(x)["second"]).alias("isa_dev"),
        number(head("hdg")).alias("mag_hdg"), number(place("hdg")).alias("crs"), number(head("tas")).alias("tas"), number(place("tas")).alias("gs"), number(head("dist")).alias("dist_leg"), number(place("dist")).alias("dist_rem"),
        number(head("fuelrem")).alias("fuel_rem"), number(head("fuelused")).alias("fuel_used"), number(head("flow")).alias("flow"),
        text.seconds(head("time1")).alias("leg_time_s"), text.seconds(place("time1")).alias("ete_remaining_s"), text.seconds(head("time2")).alias("eta_elapsed_s"),
        spot["lat"].alias("lat"), spot["lon"].alias("lon"), (name.startswith("-") & name.endswith("-")).alias("is_pseudo"),
    )


def _cell(line: Column, column: str) -> Column:
    """The first word of a printed line (words sorted by x0) in one of ``COLUMNS``; the first of these takes what lies left of it, too."""
    i = [name for name, _ in COLUMNS].index(column)
    low = lambda x: x["x0"] >= COLUMNS[i][1] if i else F.lit(True)
    high = lambda x: x["x0"] < COLUMNS[i + 1][1] if i + 1 < len(COLUMNS) else F.lit(True)
    return F.get(F.filter(line, lambda x: low(x) & high(x)), F.lit(0))["text"]


def _runs(rows: Column, begins: Callable[[Column, Column, Column], Column]) -> Column:
    """An array cut before each element that begins a run (told by the array, the element and its place); what comes before the first run is left out.

    The array is bound to a name, so that it is made once.
    """
    starts = lambda all_: F.array_compact(F.transform(all_, lambda x, i: F.when(begins(all_, x, i), i)))
    cut = lambda all_, at: F.transform(at, lambda s, k: F.slice(all_, s + 1, F.coalesce(F.get(at, k + 1), F.size(all_)) - s))
    return F.flatten(F.transform(F.array(rows), lambda all_: F.flatten(F.transform(F.array(starts(all_)), lambda at: cut(all_, at)))))


def _tokens(cell: Column) -> Column:
    return F.filter(F.split(F.coalesce(cell, F.lit("")), r"\s+"), lambda t: t != "")


def _coordinate(tokens: Column) -> Column:
    return F.get(F.filter(tokens, lambda t: t.rlike(COORDINATE)), F.lit(0))


def waypoints(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, seq and the planned figures of each row that names a coordinate, of a page's first table with three such rows.

    Cells: name, coordinate and navaid; -; airway, altitude, safe altitude; wind; headings; speeds; distances; fuel left;
    fuel used; flow; times; elapsed time. What is absent or a dash is null. A page is read where it is, without a shuffle, and not beyond
    the table that is found.
    """
    at = lambda tokens, i: F.get(tokens, F.lit(i))
    placed = lambda table: F.filter(F.transform(_rows(table), _cells), lambda c: _coordinate(_tokens(_plain(F.get(c, F.lit(0))))).isNotNull())
    three = lambda table: F.get(F.filter(F.array(placed(table)), lambda rows: F.size(rows) >= 3), F.lit(0))
    first = F.aggregate(_tables(F.col(html)), F.lit(None).cast("array<array<string>>"), lambda found, table: F.coalesce(found, three(table)))
    rows = pages.select(key, F.posexplode(first).alias("__at", "cells"))
    rows = rows.select(key, (F.col("__at") + 1).alias("seq"), *[_tokens(_plain(F.get("cells", F.lit(i)))).alias(f"__{i}") for i in (0, *range(2, 12))])
    rows = rows.withColumn("coord_raw", _coordinate(F.col("__0")))
    name = at(F.col("__0"), 0)
    rest = F.filter(F.slice(F.col("__0"), 2, 20), lambda t: (t != F.col("coord_raw")) & (F.upper(t) == t) & t.rlike("[A-Z]"))
    route = F.col("__2")
    airway = at(route, 0).rlike("[A-Za-z]")
    numbers = F.when(airway, F.slice(route, 2, 9)).otherwise(route)
    number = lambda cell, i: text.number(at(F.col(f"__{cell}"), i))
    pair = lambda i: text.pair(at(F.col("__3"), i))
    place = geo.coordinate(F.col("coord_raw"))
    return rows.select(
        key, "seq", name.alias("name"), place["lat"].alias("lat"), place["lon"].alias("lon"), "coord_raw",
        (name.startswith("-") & name.endswith("-")).alias("is_pseudo"), F.get(rest, F.lit(0)).alias("navaid"), F.when(airway, at(route, 0)).alias("airway"),
        text.number(at(numbers, 0)).alias("altitude_ft"), text.number(at(numbers, 1)).alias("msa"), F.when(~at(F.col("__3"), 0).isin("-", "--"), at(F.col("__3"), 0)).alias("wind_comp_raw"),
        pair(1)["first"].alias("wind_dir"), pair(1)["second"].alias("wind_speed"), pair(2)["first"].alias("oat"), pair(2)["second"].alias("isa_dev"),
        number(4, 0).alias("mag_hdg"), number(4, 1).alias("crs"), number(5, 0).alias("tas"), number(5, 1).alias("gs"), number(6, 0).alias("dist_leg"), number(6, 1).alias("dist_rem"),
        number(7, 0).alias("fuel_rem"), number(8, 0).alias("fuel_used"), number(9, 0).alias("flow"),
        text.seconds(at(F.col("__10"), 0)).alias("leg_time_s"), text.seconds(at(F.col("__10"), 1)).alias("ete_remaining_s"), text.seconds(at(F.col("__11"), 0)).alias("eta_elapsed_s"),
    )


def plain_lines(html: Column) -> Column:
    """The lines of a page's text, tags and blank lines left out."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", "\n"), "&nbsp;", " "), "&amp;", "&")
    return F.filter(F.transform(F.split(plain, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def header_date(line: Column) -> Column:
    """The date of a header such as (Jun 07, 2026)."""
    found = lambda i: F.regexp_extract(line, r"\(([A-Z][a-z]{2})\s+(\d{1,2}),\s*(\d{4})\)", i)
    return F.try_to_date(F.concat_ws(" ", found(1), found(2), found(3)), "MMM d yyyy")


def summaries(pages: DataFrame, key: str, html: str, header: str = r"(\w{4})\s*(?:-|to)\s*(\w{4})\s*(\S+)?") -> DataFrame:
    """key, departure, destination, aircraft, date, route, ete_total_s, dist_total_nm, avg_tas, cruise_alt_ft, avg_wind of each page.

    ``header`` is the pattern of the line with a date: departure, destination, aircraft.
    """
    page = pages.select(key, plain_lines(F.col(html)).alias("l"))
    dated = F.get(F.filter("l", lambda x: x.rlike(r"\([A-Z][a-z]{2}\s+\d{1,2},\s*\d{4}\)")), F.lit(0))
    after = lambda label: F.get("l", F.array_position("l", F.lit(label)).cast("int"))
    labelled = lambda label: F.coalesce(F.regexp_extract(F.get(F.filter("l", lambda x: x.rlike(f"^{label}\\s{{2,}}")), F.lit(0)), rf"^{label}\s{{2,}}(.*)$", 1), F.when(F.array_contains("l", label), after(label)))
    found = lambda value, pattern, i=1: F.nullif(F.regexp_extract(value, pattern, i), F.lit(""))
    ete = labelled("ETE")
    return page.select(
        key, *[found(dated, header, i).alias(n) for i, n in ((1, "departure"), (2, "destination"), (3, "aircraft"))], header_date(dated).alias("date"),
        F.when(F.array_contains("l", "Route"), after("Route")).alias("route"),
        (found(ete, r"(\d+)h(\d+)m").cast("long") * 3600 + found(ete, r"(\d+)h(\d+)m", 2).cast("long") * 60).alias("ete_total_s"),
        found(labelled("Distance"), r"([\d.]+)\s*NM").try_cast("double").alias("dist_total_nm"), found(labelled("Avg TAS"), r"(\d+)\s*kt").try_cast("double").alias("avg_tas"),
        found(F.replace(labelled("Altitude"), F.lit(","), F.lit("")), r"(\d+)").try_cast("int").alias("cruise_alt_ft"), labelled("Avg Wind").alias("avg_wind"),
    )


def fuel_plan(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, label, gal, time_s of the rows of a page's fuel table, the first with a row named Taxi."""
    first = F.coalesce(F.get("cells", F.lit(0)), F.lit(""))
    rows = first_table(table_cells(pages, key, html), key, first == "Taxi")
    label = F.coalesce(*[F.when(first.startswith(k), F.lit(k)) for k in FUEL_LABELS])
    own = rows.select(key, label.alias("label"), text.number(F.get("cells", F.lit(1))).alias("gal"), text.seconds(F.get("cells", F.lit(2))).alias("time_s"))
    return own.where("label IS NOT NULL AND gal IS NOT NULL")

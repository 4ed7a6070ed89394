"""Places and points: what lies within a distance, and what is nearest at any distance."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.geo import RADIUS_NM, distance_nm
from skyloom.functions.text import finite
from skyloom.session import materialised

#: Places of a leaf that are compared one by one, leaves of a tree, and sampled places that it is split by.
LEAF, LEAVES, SAMPLE = 256, 4096, 100_000
#: Points that one task compares with a leaf.
POINTS = 50_000


class Grid:
    """Cells on the sphere, so large that what lies within a reach of a point is in at most two bands and two columns of each.

    Bands of latitude are twice the reach high. Each is cut, around the globe, into columns twice as wide as the reach is
    in longitude at the band's far edge; near the poles a band is one cell.
    """

    def __init__(self, reach_nm: float):
        self.reach = math.degrees(reach_nm / RADIUS_NM) * 1.001
        self.height = max(2 * self.reach, 0.05)
        self.bands = math.ceil(180 / self.height)

    def _band(self, lat: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(self.bands - 1), F.floor((lat + 90) / self.height))).cast("int")

    def table(self, rows: DataFrame, y: str) -> DataFrame:
        """A row a band: its number of columns, and the reach in degrees of longitude at its widest in the band. At most 3,600 rows."""
        out = []
        for band in range(self.bands):
            far = max(abs(band * self.height - 90 - self.reach), abs((band + 1) * self.height - 90 + self.reach))
            aside = 180.0 if far + self.reach >= 90 else math.degrees(math.asin(min(1.0, math.sin(math.radians(self.reach)) / math.cos(math.radians(far)))))
            n = int(180 // aside)
            out.append((band, aside, n if n >= 3 else 1))
        return F.broadcast(rows.sparkSession.createDataFrame(out, f"{y} int, __aside double, __n int"))

    def _column(self, lon: Column) -> Column:
        return F.pmod(F.floor((lon + 180) / 360 * F.col("__n")), F.col("__n")).cast("int")

    def cells(self, rows: DataFrame, lat: str, lon: str, y: str, x: str) -> DataFrame:
        """``rows`` with the cell of their position."""
        out = rows.withColumn(y, self._band(F.col(lat))).join(self.table(rows, y), y)
        return out.withColumn(x, self._column(F.col(lon))).drop("__aside", "__n")

    def around(self, rows: DataFrame, lat: str, lon: str, y: str, x: str) -> DataFrame:
        """``rows`` once for each cell, at most four but at the poles, in which a point within reach of theirs may lie."""
        bands = F.array_distinct(F.array(self._band(F.col(lat) - self.reach), self._band(F.col(lat) + self.reach)))
        out = rows.withColumn(y, F.explode(bands)).join(self.table(rows, y), y)
        ends = F.array(*[self._column(F.col(lon) + sign * F.col("__aside")) for sign in (-1, 1)])
        return out.withColumn(x, F.explode(F.array_distinct(ends))).drop("__aside", "__n")


def nearest_within(points: DataFrame, places: DataFrame, lat: str, lon: str, point_key: Sequence[str], place: str, most_nm: float = 6.0) -> DataFrame:
    """``points`` with the place (lat, lon) nearest on the sphere, null where none is within ``most_nm``; ties go to the first by name.

    Of places at one position the first alone is met."""
    grid = Grid(most_nm)
    there = places.select(place, finite(F.col("lat")).alias("__lat"), finite(F.col("lon")).alias("__lon")).where("__lat IS NOT NULL AND __lon IS NOT NULL")
    there = there.groupBy("__lat", "__lon").agg(F.min(place).alias(place))
    at = points.select(*point_key, finite(F.col(lat)).alias("__a"), finite(F.col(lon)).alias("__b")).where("__a IS NOT NULL AND __b IS NOT NULL")
    pairs = grid.cells(at, "__a", "__b", "__y", "__x").join(grid.around(there, "__lat", "__lon", "__y", "__x"), ["__y", "__x"])
    pairs = pairs.withColumn("__d", distance_nm(F.col("__a"), F.col("__b"), F.col("__lat"), F.col("__lon"))).where(F.col("__d") <= most_nm)
    best = pairs.groupBy(*point_key).agg(F.min(F.struct("__d", F.col(place))).alias("__best"))
    return points.join(best.select(*point_key, F.col(f"__best.{place}").alias(place)), list(point_key), "left")


class Tree(NamedTuple):
    """A plane cut in two again and again: the dimension and value of each cut, and the nodes below it (negative: leaf)."""

    dimension: np.ndarray
    value: np.ndarray
    below: np.ndarray

    @staticmethod
    def of(points: np.ndarray, leaves: int) -> Tree:
        """Cuts at medians, the wider side first, until there are ``leaves`` parts or the points are all the same."""
        cuts: list[list] = []
        n_leaves = 0

        def grow(own: np.ndarray, share: int) -> int:
            nonlocal n_leaves
            spread = np.ptp(own, axis=0) if len(own) else np.zeros(2)
            if share < 2 or not spread.any():
                n_leaves += 1
                return -n_leaves
            k = int(spread.argmax())
            middle = np.median(own[:, k])
            left = own[:, k] < middle
            if not left.any():  # more than half lie on the least value
                middle = own[own[:, k] > middle, k].min()
                left = own[:, k] < middle
            at = len(cuts)
            cuts.append([k, middle, 0, 0])
            cuts[at][2:] = grow(own[left], share // 2), grow(own[~left], share - share // 2)
            return at

        grow(points, leaves)
        table = np.array(cuts, float).reshape(-1, 4)
        return Tree(table[:, 0].astype(int), table[:, 1], table[:, 2:].astype(int))

    def leaf(self, points: np.ndarray) -> np.ndarray:
        """The number of each point's leaf, from 0."""
        node = np.full(len(points), 0 if len(self.value) else -1)
        while (inner := node >= 0).any():
            n = node[inner]
            own = points[inner]
            node[inner] = self.below[n, (own[np.arange(len(own)), self.dimension[n]] >= self.value[n]).astype(int)]
        return -1 - node


def reach_of(points: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances, points by boxes (low, high of both dimensions): the least there can be, and one within which there is a place.

    Every side of a box that is drawn tightly around places touches one.
    """
    low, high = boxes[:, :2], boxes[:, 2:]
    p = points[:, None, :]
    gap = np.maximum(np.maximum(low - p, p - high), 0)
    near = np.where(np.abs(p - low) <= np.abs(p - high), np.abs(p - low), np.abs(p - high)) ** 2
    far = np.maximum(np.abs(p - low), np.abs(p - high)) ** 2
    return (gap**2).sum(2), np.minimum(near[..., 0] + far[..., 1], far[..., 0] + near[..., 1])


def worthwhile(points: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(point, box) pairs of which the box may hold the point's nearest place."""
    least, sure = reach_of(points, boxes)
    return np.nonzero(least <= sure.min(1, keepdims=True) * (1 + 1e-9) + 1e-300)


def nearest_of(points: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point the number of the nearest place, the first of equals, and the squared distance.

    Many places are cut into boxes of at most about ``LEAF`` first, and a point meets those that are worth it.
    """
    best, at = np.full(len(points), np.inf), np.full(len(points), len(places))
    tree = Tree.of(places, -(-len(places) // LEAF))
    leaf = tree.leaf(places)
    order = np.argsort(leaf, kind="stable")
    begins = np.flatnonzero(np.diff(leaf[order], prepend=-1))
    members = np.split(order, begins[1:])
    boxes = np.array([[*places[m].min(0), *places[m].max(0)] for m in members])
    step = max(1, (1 << 20) // len(members))
    for a in range(0, len(points), step):
        who, box = worthwhile(points[a : a + step], boxes)
        by_box = np.argsort(box, kind="stable")
        for b, own in zip(*(lambda s: (box[by_box][s], np.split(who[by_box], s[1:])))(np.flatnonzero(np.diff(box[by_box], prepend=-1))), strict=True):
            there = members[b]
            for c in range(0, len(own), 4096):
                i = a + own[c : c + 4096]
                d = (points[i, :1] - places[there, 0]) ** 2 + (points[i, 1:] - places[there, 1]) ** 2
                k = d.argmin(1)
                found, number = d[np.arange(len(i)), k], there[k]
                better = (found < best[i]) | ((found == best[i]) & (number < at[i]))
                best[i[better]], at[i[better]] = found[better], number[better]
    return at, best


def nearest_of_all(points: DataFrame, places: DataFrame, lat: str, lon: str, point_key: Sequence[str], place: str, leaf: int = LEAF, chunk: int = POINTS) -> DataFrame:
    """``points`` with the place of the least squared distance in degrees, however far; ties go to the first by name.

    A tree cut at the medians of a sample of the places parts them into leaves, whose tight boxes (at most ``LEAVES``) are known
    everywhere. Each distinct position is sent to the leaves whose box is nearer than the best upper bound that
    any box gives, which are a few however far they are; a leaf that many positions visit meets them in several tasks. Points and
    places without finite coordinates stay without; places without a name are no places.
    """
    there = places.select(F.col(place).alias("place"), finite(F.col("lat")).alias("y"), finite(F.col("lon")).alias("x")).where("place IS NOT NULL AND y IS NOT NULL AND x IS NOT NULL")
    at = points.select(finite(F.col(lat)).alias("__a"), finite(F.col(lon)).alias("__b")).where("__a IS NOT NULL AND __b IS NOT NULL").distinct()
    kind = there.schema["place"].dataType
    n = there.count()
    if not n:
        return points.withColumn(place, F.lit(None).cast(kind))
    sample = there if n <= SAMPLE else there.sample(SAMPLE / n, seed=1)
    tree = Tree.of(np.array(sample.select("y", "x").collect(), float).reshape(-1, 2), min(LEAVES, -(-n // leaf)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2)], axis=1)
            yield batch.append_column("leaf", pa.array(tree.leaf(own), pa.int64()))

    there = there.mapInArrow(placed, f"place {kind.simpleString()}, y double, x double, leaf long")
    found = sorted(there.groupBy("leaf").agg(F.min("y"), F.min("x"), F.max("y"), F.max("x")).collect())  # a row a leaf
    numbers, boxes = np.array([r[0] for r in found]), np.array([r[1:] for r in found])

    def visiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1)], axis=1)
            step = max(1, (1 << 20) // len(boxes))
            for k in range(0, len(own), step):
                i, b = worthwhile(own[k : k + step], boxes)
                yield pa.RecordBatch.from_arrays([pa.array(own[k + i, 0]), pa.array(own[k + i, 1]), pa.array(numbers[b], pa.int64())], ["__a", "__b", "leaf"])

    visits = materialised(at.mapInArrow(visiting, "__a double, __b double, leaf long"))
    parts = visits.groupBy("leaf").agg(F.ceil(F.count("*") / chunk).alias("parts"))  # a row a leaf
    visits = visits.join(F.broadcast(parts), "leaf").withColumn("part", F.pmod(F.xxhash64("__a", "__b"), F.col("parts")))
    met = there.join(F.broadcast(parts), "leaf").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))

    def search(own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values("place", kind="stable")
        i, d = nearest_of(own[["__a", "__b"]].to_numpy(), known[["y", "x"]].to_numpy())
        return pd.DataFrame({"__a": own["__a"], "__b": own["__b"], "d": d, "place": known["place"].to_numpy()[i]})

    pairs = visits.groupBy("leaf", "part").cogroup(met.select("leaf", "part", "place", "y", "x").groupBy("leaf", "part"))
    best = pairs.applyInPandas(search, f"__a double, __b double, d double, place {kind.simpleString()}")
    best = best.groupBy("__a", "__b").agg(F.min(F.struct("d", "place"))["place"].alias(place))
    return points.join(best, (F.col(lat) == F.col("__a")) & (F.col(lon) == F.col("__b")), "left").drop("__a", "__b")

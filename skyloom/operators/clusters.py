"""Groups of similar tracks, and the fixes that they are named after."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.functions.geo import RADIUS_NM

#: Bytes of distance vectors that a task keeps.
CACHE = 64 << 20
#: Flights of a group that is linked together with others.
FEW = 64
#: Rows of a track that are passed over together, and places of fixes that a flight is measured to together.
PIECE, LOT = 64, 1024


class Chain:
    """Complete linkage up to a distance by nearest-neighbour chains: memory for a few vectors, not for pairs.

    A chain goes from a cluster to its nearest one until two are each other's nearest; those join. Joining moves no cluster closer to
    another, so the rest of the chain stays right, and a cluster whose nearest lies beyond the bound is done.
    Distances from one cluster to all others are one vector; that of a joined cluster is the greater of both.
    """

    def __init__(self, x: np.ndarray, most: float, cache: int = CACHE):
        self.x, self.most = x, most
        self.owner, self.alive = np.arange(len(x)), np.ones(len(x), bool)
        self.members = [[i] for i in range(len(x))]
        self.vectors: dict[int, np.ndarray] = {}
        self.room = max(8, cache // (8 * max(1, len(x))))

    def vector(self, slot: int) -> np.ndarray:
        if slot in self.vectors:
            return self.vectors[slot]
        far = np.zeros(len(self.x))
        for i in self.members[slot]:
            np.maximum(far, np.sqrt(((self.x - self.x[i]) ** 2).mean(1)), out=far)
        out = np.zeros(len(self.x))
        np.maximum.at(out, self.owner, far)
        out[~self.alive] = out[slot] = np.inf
        while len(self.vectors) >= self.room:
            del self.vectors[next(iter(self.vectors))]
        self.vectors[slot] = out
        return out

    def close(self, slot: int) -> None:
        self.alive[slot] = False
        self.vectors.pop(slot, None)
        for v in self.vectors.values():
            v[slot] = np.inf

    def join(self, a: int, b: int) -> None:
        both = np.maximum(self.vector(a), self.vector(b))
        self.close(b)
        self.owner[self.members[b]] = a
        self.members[a] += self.members[b]
        for slot, v in self.vectors.items():
            if slot != a:
                v[a] = max(v[a], both[slot])
        both[[a, b]] = np.inf
        self.vectors[a] = both

    def run(self) -> np.ndarray:
        """The least member of each row's cluster."""
        chain: list[int] = []
        first = 0
        while first < len(self.x):
            if not chain:
                if not self.alive[first]:
                    first += 1
                    continue
                chain.append(first)
            top = chain[-1]
            v = self.vector(top)
            nearest = int(v.argmin())
            if len(chain) > 1 and v[chain[-2]] <= v[nearest]:
                nearest = chain[-2]
            if not v[nearest] <= self.most:
                self.close(chain.pop())
            elif len(chain) > 1 and nearest == chain[-2]:
                del chain[-2:]
                self.join(min(top, nearest), max(top, nearest))
            else:
                chain.append(nearest)
        return self.owner


def complete_linkage(profiles: list[np.ndarray], most: float) -> list[int]:
    """Cluster numbers, the largest first and of equals the one of the first profile: the closest two clusters join while all their
    members are within ``most`` (RMS). Profiles that hold numbers that are not finite stay alone."""
    if not len(profiles):
        return []
    x = np.array(profiles, float).reshape(len(profiles), -1)
    fine = np.flatnonzero(np.isfinite(x).all(1))
    owner = np.arange(len(x))
    owner[fine] = fine[Chain(x[fine], most).run()]
    slots, sizes = np.unique(owner, return_counts=True)
    rank = np.empty(len(slots), int)
    rank[np.lexsort((slots, -sizes))] = np.arange(len(slots))
    return rank[np.searchsorted(slots, owner)].tolist()


def linked(x: np.ndarray, most: float) -> np.ndarray:
    """The least member of each row's cluster, for many groups of equally many profiles at once (group, profile, place).

    All groups join their closest two clusters, the first by number of equally close ones, until none are within ``most``.
    """
    n = x.shape[1]
    with np.errstate(all="ignore"):
        far = np.sqrt(((x[:, :, None] - x[:, None]) ** 2).sum(3) / x.shape[2])
    far[:, *np.tril_indices(n)] = np.inf
    far[np.isnan(far)] = np.inf
    owner = np.tile(np.arange(n), (len(x), 1))
    at = np.arange(len(x))
    for _ in range(n - 1):
        best = far[at].reshape(len(at), -1).argmin(1)
        a, b = best // n, best % n
        close = far[at, a, b] <= most
        at, a, b = at[close], a[close], b[close]
        if not len(at):
            break
        owner[at] = np.where(owner[at] == b[:, None], a[:, None], owner[at])
        full = np.minimum(far[at], far[at].transpose(0, 2, 1))
        k = np.arange(len(at))
        both = np.maximum(full[k, a], full[k, b])
        both[k, b] = np.inf
        both[k, a] = np.inf
        full[k, a], full[k, :, a] = both, both
        full[k, b], full[k, :, b] = np.inf, np.inf
        full[:, *np.tril_indices(n)] = np.inf
        far[at] = full
    return owner


def numbered(owner: np.ndarray) -> np.ndarray:
    """Cluster numbers of ``linked`` groups: the largest first, of equals the one of the first profile."""
    sizes = (owner[:, :, None] == np.arange(owner.shape[1])).sum(1)
    rank = np.argsort(np.argsort(-sizes, axis=1, kind="stable"), axis=1, kind="stable")
    return np.take_along_axis(rank, owner, 1)


def blocks(profiles: DataFrame, group: str, most_nm: float, name: str = "block") -> DataFrame:
    """``profiles`` with parts of a group between which no two profiles are within ``most_nm``.

    The mean difference of two profiles, whatever sign each place has, is at most their RMS. So rows in the order of
    such a mean are parted where it leaps by more, once for each of three patterns of signs.
    """
    rows = profiles.withColumn(name, F.lit("").cast("string"))
    places = F.sequence(F.lit(0), F.size("offsets") - 1)
    signs = [lambda k, n: F.lit(1.0), lambda k, n: F.when(k * 2 < n, 1.0).otherwise(-1.0), lambda k, n: F.when(k % 2 == 0, 1.0).otherwise(-1.0)]
    for sign in signs:
        total = F.aggregate(F.when(F.size("offsets") > 0, places).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda a, k: a + F.get("offsets", k) * sign(k, F.size("offsets")))  # noqa: B023
        w = Window.partitionBy(group, name).orderBy("__m")
        rows = rows.withColumn("__m", total / F.size("offsets"))
        rows = rows.withColumn("__leap", F.coalesce((F.col("__m") - F.lag("__m").over(w) > most_nm * (1 + 1e-9)).cast("int"), F.lit(0)))
        rows = rows.withColumn("__part", F.sum("__leap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        rows = rows.withColumn(name, F.concat(name, F.lit("/"), F.col("__part").cast("string"))).drop("__m", "__leap", "__part")
    return rows


def clustered(profiles: DataFrame, group: str, key: str, most_nm: float = 12.0) -> DataFrame:
    """``profiles`` (group, key, offsets) with the cluster of each flight within its group, from 0 for the largest.

    Groups of ``FEW`` flights at most are linked many at once. Others are cut into ``blocks``, each of which is one task's: it holds its profiles
    and some vectors of their number, not their pairs, and takes time in their square. Of equally large clusters the one of the first key comes first.
    """
    sized = profiles.withColumn("__n", F.count("*").over(Window.partitionBy(group)))
    few, many = (sized.where(test).drop("__n") for test in (F.col("__n") <= FEW, F.col("__n") > FEW))
    return _few_clustered(few, group, key, most_nm).unionByName(_many_clustered(many, group, key, most_nm))


def _few_clustered(profiles: DataFrame, group: str, key: str, most_nm: float) -> DataFrame:
    columns = [key, "offsets", *[c for c in profiles.columns if c not in (group, key, "offsets")]]
    rows = profiles.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("__rows"))
    rows = rows.select(group, "__rows", F.col("__rows.offsets").cast("array<array<double>>").alias("__x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            counts = np.asarray(pc.list_value_length(at("__x")))
            own = at("__x").flatten()
            widths = np.asarray(pc.fill_null(pc.list_value_length(own), -1))
            x = np.full((len(own), max(0, widths.max(initial=0))), np.nan)
            fill = np.maximum(widths, 0)
            values = np.asarray(own.flatten().to_numpy(zero_copy_only=False), float)
            x[np.repeat(np.arange(len(own)), fill), np.arange(len(values)) - np.repeat(np.cumsum(fill) - fill, fill)] = values
            begins = np.cumsum(counts) - counts
            wide = np.maximum.reduceat(widths, begins) if len(own) else widths
            x[widths != np.repeat(wide, counts)] = np.nan
            number = np.zeros(len(own), np.int32)
            for n, width in {*zip(counts.tolist(), wide.tolist(), strict=True)}:
                here = np.flatnonzero((counts == n) & (wide == width))
                step = max(1, (4 << 20) // (n * n * max(1, width)))
                for lot in range(0, len(here), step):
                    index = begins[here[lot : lot + step], None] + np.arange(n)
                    number[index] = numbered(linked(x[index, : max(0, width)], most_nm))
            told = pa.ListArray.from_arrays(pa.array(np.append(begins, len(own)), pa.int32()), pa.array(number, pa.int32()))
            yield pa.RecordBatch.from_arrays([at(group), at("__rows"), told], [group, "__rows", "cluster"])

    kind = T.StructType([*rows.select(group, "__rows").schema.fields, T.StructField("cluster", T.ArrayType(T.IntegerType()))])
    out = rows.mapInArrow(run, kind).select(group, F.explode(F.arrays_zip("__rows", "cluster")).alias("__z")).select(group, "__z.__rows.*", "__z.cluster")
    return out.select(*profiles.columns, "cluster")


def _many_clustered(profiles: DataFrame, group: str, key: str, most_nm: float) -> DataFrame:
    kind = profiles.schema[key].dataType
    rows = blocks(profiles, group, most_nm, "__block")

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(key, kind="stable").reset_index(drop=True)
        x = [np.asarray(o, float) if o is not None else np.full(1, np.nan) for o in own["offsets"]]
        width = max(map(len, x))
        number = complete_linkage([v if len(v) == width else np.full(width, np.nan) for v in x], most_nm)
        first = own[key].groupby(np.array(number)).transform("first")
        return own.assign(__first=first)

    out = T.StructType([*rows.schema.fields, T.StructField("__first", kind)])
    # A block of one flight is a cluster as it is.
    rows = rows.withColumn("__n", F.count("*").over(Window.partitionBy(group, "__block")))
    alone = rows.where("__n = 1").drop("__n").withColumn("__first", F.col(key))
    found = rows.where("__n > 1").drop("__n").groupBy(group, "__block").applyInPandas(run, out).unionByName(alone)
    size = F.count("*").over(Window.partitionBy(group, "__block", "__first"))
    order = Window.partitionBy(group).orderBy(F.desc("__size"), "__first", "__block")
    return found.withColumn("__size", size).withColumn("cluster", F.dense_rank().over(order) - 1).select(*profiles.columns, "cluster")


def by_date(flights: DataFrame, keys: list[str], start: str, order: list[str]) -> DataFrame:
    """``flights`` with nth, their place (from 1) within their cluster (``keys``) by date."""
    return flights.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(start, *order)))


def approach(lat: np.ndarray, lon: np.ndarray, fix_lat: np.ndarray, fix_lon: np.ndarray) -> np.ndarray:
    """The least distance in nautical miles from each fix to a track's rows.

    The rows are cut into pieces, each within a ball around its middle; a fix is measured to the rows of those pieces alone that
    may hold its nearest.
    """

    def unit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        p, q = np.radians(a), np.radians(b)
        return np.stack([np.cos(p) * np.cos(q), np.cos(p) * np.sin(q), np.sin(p)], axis=1)

    order = np.lexsort((lon, np.floor(lat * 5)))
    lat, lon = lat[order], lon[order]
    own, fixes = unit(lat, lon), unit(fix_lat, fix_lon)
    begins = np.arange(0, len(own), PIECE)
    middles = np.add.reduceat(own, begins) / np.diff(np.append(begins, len(own)))[:, None]
    radii = np.maximum.reduceat(np.sqrt(((own - np.repeat(middles, np.diff(np.append(begins, len(own))), axis=0)) ** 2).sum(1)), begins)
    out = np.full(len(fixes), np.inf)
    for at in range(0, len(fixes), 1024):
        far = np.sqrt(((fixes[at : at + 1024, None] - middles[None]) ** 2).sum(2))
        who, piece = np.nonzero(far - radii <= (far + radii).min(1, keepdims=True) + 1e-12)
        for p in np.unique(piece):
            i = at + who[piece == p]
            a, b = slice(begins[p], begins[p] + PIECE), radians_apart
            out[i] = np.minimum(out[i], b(lat[None, a], lon[None, a], fix_lat[i, None], fix_lon[i, None]).min(1))
    return out * RADIUS_NM


def radians_apart(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    a, b = np.sin(np.radians(lat2 - lat1) / 2), np.sin(np.radians(lon2 - lon1) / 2)
    return 2 * np.arcsin(np.sqrt(np.minimum(1.0, a * a + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * b * b)))


def fix_distances(tracks: DataFrame, fixes: DataFrame, group: str) -> DataFrame:
    """group, cluster, fix, navaid, mean: how near a cluster's flights come to each fix of their corridor, on average.

    ``tracks``: group, cluster, flight, lat, lon (thinned out). ``fixes``: group, fix, navaid, lat, lon, those
    within the corridor's box. Places are measured once, however many fixes have them, in lots of about ``LOT`` a corridor: a task takes one flight's
    rows and a lot at a time, and of each batch of rows sums for each cluster and place are shuffled.
    """
    here = tracks.where("lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)")
    here = here.groupBy(group, "cluster", "flight").agg(F.collect_list(F.struct("lat", "lon")).alias("t"))
    there = fixes.where("lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)")
    places = there.select(group, F.col("lat").alias("__a"), F.col("lon").alias("__b")).distinct()
    lots = places.groupBy(group).agg(F.ceil(F.count("*") / LOT).alias("__lots"))
    lot = F.pmod(F.xxhash64("__a", "__b"), F.col("__lots"))
    places = places.join(lots, group).groupBy(group, lot.alias("__lot")).agg(F.collect_list(F.struct(F.col("__a").alias("lat"), F.col("__b").alias("lon"))).alias("f"))
    both = here.join(places, group).select(group, "cluster", F.col("t.lat").alias("a"), F.col("t.lon").alias("b"), F.col("f.lat").alias("c"), F.col("f.lon").alias("d"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            lists = [at(n) for n in "abcd"]
            near = [approach(*(np.asarray(c[i].values.to_numpy(zero_copy_only=False), float) for c in lists)).tolist() for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([at(group), at("cluster"), lists[2], lists[3], pa.array(near, pa.list_(pa.float64()))], [group, "cluster", "c", "d", "near"])

    doubles = T.ArrayType(T.DoubleType())
    kind = T.StructType([*both.select(group, "cluster").schema.fields, *[T.StructField(n, doubles) for n in ("c", "d", "near")]])
    rows = both.mapInArrow(run, kind).select(group, "cluster", F.explode(F.arrays_zip("c", "d", "near")).alias("x"))
    means = rows.groupBy(group, "cluster", F.col("x.c").alias("lat"), F.col("x.d").alias("lon")).agg(F.avg("x.near").alias("__mean"))
    # Fixes that are told twice count with each of their places.
    found = there.select(group, "fix", "navaid", "lat", "lon").join(means, [group, "lat", "lon"])
    return found.groupBy(group, "cluster", "fix", "navaid").agg(F.avg("__mean").alias("mean"))


def labelled(distances: DataFrame, group: str, near_nm: float = 8.0, apart_nm: float = 6.0) -> DataFrame:
    """group, cluster, label: the fix that tells a cluster from the others of its group, by ``fix_distances``.

    A fix suits a cluster that comes within ``near_nm`` of it while every other one stays ``apart_nm`` farther
    off. Clusters choose in order of their numbers; navaids go before other fixes, then the greatest lead,
    then the name; a fix is given once. Without a suitable one the nearest fix within reach serves, or else the number.
    """
    w = Window.partitionBy(group, "fix")
    least = F.min(F.struct("mean", "cluster")).over(w)
    second: Column = F.get(F.sort_array(F.collect_list("mean").over(w)), F.lit(1))
    others = F.when(least["cluster"] == F.col("cluster"), second).otherwise(least["mean"])
    rows = distances.withColumn("lead", others - F.col("mean"))
    # Only suitable fixes and each cluster's nearest one reach the choice.
    nearest = F.row_number().over(Window.partitionBy(group, "cluster").orderBy("mean", "fix")) == 1
    rows = rows.withColumn("suits", (F.col("mean") <= near_nm) & (F.col("lead").isNull() | (F.col("lead") >= apart_nm))).withColumn("nearest", nearest).where("suits OR nearest")

    def choose(own: pd.DataFrame) -> pd.DataFrame:
        given: set[str] = set()
        out = []
        for cluster, mine in own.groupby("cluster", sort=True):
            free = mine[mine["suits"] & ~mine["fix"].isin(given)].sort_values(["navaid", "lead", "fix"], ascending=[False, False, True], na_position="last", kind="stable")
            if len(free):
                label = free["fix"].iloc[0]
                given.add(label)
            else:
                best = mine[mine["nearest"]].iloc[0]
                label = best["fix"] if best["mean"] <= near_nm else f"Group {cluster + 1}"
            out.append((own[group].iloc[0], cluster, label))
        return pd.DataFrame(out, columns=[group, "cluster", "label"]).astype({"cluster": "int32"})

    kind = T.StructType([distances.schema[group], T.StructField("cluster", T.IntegerType()), T.StructField("label", T.StringType())])
    return rows.groupBy(group).applyInPandas(choose, kind)

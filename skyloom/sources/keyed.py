"""Tables kept by key: replacing, deleting and merging keys without touching the others.

Rows lie in a fixed number of buckets by the hash of their key, which stays in the files with its type. A manifest
names the folders that hold each bucket. A change writes new folders for the buckets it touches and then one new manifest,
by a rename that fails if another writer came first, so readers see all of a change or nothing of it, and a
job that dies leaves only folders that no manifest names. ``vacuum`` removes those; ``compact`` joins a bucket's folders.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.session import materialised, remove


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where) and fs.getFileStatus(where).isDirectory()


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, where = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


#: Tasks and files that a bucket of a stream's batch is split over at most.
SPLITS = 4


class KeyedTable:
    """A table below ``path`` by its ``key`` columns; the key and the number of buckets are those it was made with.

    Keys may be of any type that hashes, text that looks like numbers too, and may hold nulls; the types of the first rows stay. Columns may
    come and go between changes; those that a part lacks are null.
    """

    def __init__(self, spark: SparkSession, path: str, key: str | Sequence[str], buckets: int = 64):
        self.spark, self.path = spark, path
        own = self._manifest()
        self.key = [key] if isinstance(key, str) else list(key)
        if own and own["key"] != self.key:
            raise ValueError(f"the table at {path} is kept by {own['key']}")
        self.buckets = own["buckets"] if own else buckets

    def _versions(self) -> list[int]:
        return [int(n[:-5]) for n in _names(self.spark, f"{self.path}/manifest") if n.endswith(".json") and not n.startswith((".", "_"))]

    def _manifest(self, version: int | None = None) -> dict | None:
        """A manifest, the last one by default, with its number: a change is committed under the next, so that of two only one goes through."""
        if version is None:
            known = self._versions()
            if not known:
                return None
            version = known[-1]
        fs, where = _at(self.spark, f"{self.path}/manifest/{version:012d}.json")
        stream = fs.open(where)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode()) | {"number": version}
        finally:
            stream.close()

    def _commit(self, number: int, parts: Mapping[str, Sequence[str]], schema: T.StructType, marks: Mapping[str, object]) -> None:
        body = json.dumps({"key": self.key, "buckets": self.buckets, "parts": {b: list(p) for b, p in parts.items() if p}, "schema": schema.jsonValue(), "marks": dict(marks)})
        fs, draft = _at(self.spark, f"{self.path}/manifest/_{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(body.encode())
        out.close()
        _, final = _at(self.spark, f"{self.path}/manifest/{number:012d}.json")
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"the table at {self.path} was changed meanwhile; try again")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def _read(self, own: dict, buckets: Sequence[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(own["schema"])
        paths = [f"{self.path}/data/{p}/bucket={b}" for b, parts in own["parts"].items() for p in parts if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _typed(self, rows: DataFrame, own: dict | None) -> DataFrame:
        """``rows`` with the columns' types of the table, and its columns first."""
        if not own:
            return rows
        known = {f.name: f.dataType for f in T.StructType.fromJson(own["schema"]).fields}
        return rows.select(*[F.col(f"`{c}`").cast(known[c]).alias(c) if c in known else F.col(f"`{c}`") for c in rows.columns])

    def _write(self, rows: DataFrame, part: str) -> list[str]:
        """Writes a part and names the buckets it has; hot buckets are split over tasks and files.

        A stream's batches run without adaptive execution, which alone knows how to rebalance: there each bucket is split in ``SPLITS``, lest every
        task write a file of every bucket.
        """
        spread = rows.select("*", self._bucket())
        if rows.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true":
            spread = spread.hint("rebalance", F.col("bucket"))
        else:
            hashed = [F.col(f"`{f.name}`") for f in rows.schema.fields if not any(w in f.dataType.simpleString() for w in ("map<", "variant"))]
            spread = spread.repartition(F.col("bucket"), F.pmod(F.xxhash64(*hashed), F.lit(SPLITS)))
        spread.write.partitionBy("bucket").parquet(f"{self.path}/data/{part}")
        return [n.partition("=")[2] for n in _names(self.spark, f"{self.path}/data/{part}") if n.startswith("bucket=")]

    def table(self) -> DataFrame:
        """All rows; without any change so far there is no table."""
        own = self._manifest()
        if not own:
            raise ValueError(f"there is no table at {self.path}")
        return self._read(own)

    def mark(self, name: str) -> object:
        """What the last change said of a name."""
        return (self._manifest() or {"marks": {}})["marks"].get(name)

    def replace(self, rows: DataFrame, marks: Mapping[str, object] | None = None) -> None:
        """The keys among ``rows`` get those rows in place of what they had; no other key changes.

        Rows are computed once. What the touched buckets hold of other keys is written anew beside them.
        """
        own = self._manifest()
        number = own["number"] + 1 if own else 1
        part = f"v{number}-{uuid.uuid4().hex[:8]}"
        rows = self._typed(rows, own)
        touched = self._write(rows, part)
        fields = [f for f in (T.StructType.fromJson(own["schema"]).fields if own else [])]
        fields += [T.StructField(f.name, f.dataType) for f in rows.schema.fields if f.name not in {o.name for o in fields}]
        schema = T.StructType(fields)
        parts = dict(own["parts"]) if own else {}
        if touched and own:
            keys = self.spark.read.schema(rows.schema).parquet(*[f"{self.path}/data/{part}/bucket={b}" for b in touched]).select(*self.key)
            parts |= self._without(own, touched, keys, part)
        for b in touched:
            parts[b] = [part, *(parts.get(b, []) if own else [])]
        self._commit(number, parts, schema, (own["marks"] if own else {}) | dict(marks or {}))

    def _without(self, own: dict, touched: Sequence[str], keys: DataFrame, part: str) -> dict[str, list[str]]:
        """The touched buckets' rows of other keys, written as a part of their own."""
        held = [b for b in touched if b in own["parts"]]
        if not held:
            return {}
        gone = keys.distinct().select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(self.key)])
        old = self._read(own, held)
        same = [old[k].eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(self.key)]
        left = self._write(old.join(gone, same, "left_anti"), f"{part}-kept")
        return {b: [f"{part}-kept"] if b in left else [] for b in held}

    def delete(self, keys: DataFrame) -> None:
        """Removes the rows of keys (the key columns); unknown ones change nothing."""
        own = self._manifest()
        if not own:
            return
        number = own["number"] + 1
        keys = materialised(self._typed(keys.select(*self.key), own).distinct())
        touched = [str(r.bucket) for r in keys.select(self._bucket()).distinct().collect()]  # at most a row a bucket
        self._commit(number, own["parts"] | self._without(own, touched, keys, f"v{number}-{uuid.uuid4().hex[:8]}"), T.StructType.fromJson(own["schema"]), own["marks"])

    def merge(self, rows: DataFrame, merged: Mapping[str, Column], marks: Mapping[str, object] | None = None) -> None:
        """Aggregates ``rows`` with what is stored of their keys; only the buckets of those keys are read.

        ``merged`` gives the aggregate of each column over old and new rows of a key, such as the sum of sums.
        """
        own = self._manifest()
        rows = materialised(self._typed(rows, own))
        if own:
            touched = [str(r.bucket) for r in rows.select(self._bucket()).distinct().collect()]
            keys = rows.select(*self.key).distinct().select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(self.key)])
            old = self._read(own, touched)
            known = old.join(keys, [old[k].eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(self.key)], "left_semi")
            rows = rows.unionByName(known, allowMissingColumns=True)
        self.replace(rows.groupBy(*self.key).agg(*[c.alias(n) for n, c in merged.items()]), marks)

    def compact(self) -> None:
        """Gives each bucket of several parts one."""
        own = self._manifest()
        many = [b for b, p in own["parts"].items() if len(p) > 1] if own else []
        if many:
            number = own["number"] + 1
            part = f"v{number}-{uuid.uuid4().hex[:8]}"
            self._write(self._read(own, many), part)
            self._commit(number, own["parts"] | {b: [part] for b in many}, T.StructType.fromJson(own["schema"]), own["marks"])

    def vacuum(self, keep: int = 1) -> None:
        """Removes manifests but the last ``keep``, and the folders that none of those names; no writer may be at work."""
        known = self._versions()
        named = {p for v in known[-keep:] for parts in self._manifest(v)["parts"].values() for p in parts}
        for v in known[:-keep]:
            remove(self.spark, f"{self.path}/manifest/{v:012d}.json")
        for part in _names(self.spark, f"{self.path}/data"):
            if part not in named:
                remove(self.spark, f"{self.path}/data/{part}")


def opened(spark: SparkSession, path: str) -> KeyedTable:
    """The table at ``path``, by the key it was made with."""
    table = KeyedTable.__new__(KeyedTable)
    table.spark, table.path = spark, path
    own = table._manifest()
    if not own:
        raise ValueError(f"there is no table at {path}")
    table.key, table.buckets = own["key"], own["buckets"]
    return table


#: A partial aggregate: what it is over a batch's rows, and over stored and new partials (by column name).
Partial = tuple[Column, Callable[[str], Column]]


def partials(**columns: tuple[str, str]) -> dict[str, Partial]:
    """Partial aggregates by name: (function, column) with count, sum, min or max.

    Others follow from them when the table is read: a mean is a sum by a count.
    """
    made = {"count": (F.count, F.sum), "sum": (F.sum, F.sum), "min": (F.min, F.min), "max": (F.max, F.max)}
    return {name: (made[f][0](c), made[f][1]) for name, (f, c) in columns.items()}

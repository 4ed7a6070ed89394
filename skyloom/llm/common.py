"""Pieces that the training-data operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.session import materialised as materialised

#: The characters that part words (space, tab to carriage return).
BLANKS = " \t\n\x0b\x0c\r"
#: Tasks that read a sample.
SAMPLE_TASKS = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; empty for null.

    Texts whose words are parted by single spaces and line ends, as most are, take the literal split,
    which is twice as fast as the pattern and gives the same words.
    """
    inner = F.btrim(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" ")), F.lit(BLANKS))
    other = F.contains(inner, F.lit("  "))
    for c in "\t\x0b\x0c\r":
        other = other | F.contains(inner, F.lit(c))
    return (
        F.when(inner == "", F.array().cast("array<string>"))
        .when(other, F.split(inner, "[\\x20\\x09-\\x0D]+"))
        .otherwise(F.split(inner, " "))
    )


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def bounded_sample(rows: DataFrame, columns: Sequence[str], most: int) -> DataFrame:
    """At most ``most`` of the distinct rows of ``columns``, those with the smallest hashes.

    Rows that repeat in all columns count once, so neither copies of an id nor rows without one fill or
    empty the sample; the choice depends on the values alone, so reruns agree. The rows are written once.
    Only models are fitted on such samples.
    """
    whole = 2**64
    (name,) = unique_names(rows, ["hash"])
    rows = rows.select(*columns).withColumn(name, F.xxhash64(*columns, F.lit(11)))
    reach = whole if (n := rows.count()) <= most else whole * 3 * most // (2 * n)
    while True:
        # Hashes are compared with their whole range: a coarser scale would leave no rows of very many.
        near = rows if reach >= whole else rows.where(F.col(name) < F.lit(reach - whole // 2))
        # Copies meet before anything is shuffled, so what is written is bounded by the reach.
        near = materialised(near.dropDuplicates([name]).repartition(SAMPLE_TASKS))
        hashes = sorted(r[0] for r in near.select(name).collect()) if near.count() <= 8 * most else None
        if hashes is None:
            reach //= 4
        elif len(hashes) < most and reach < whole:
            reach = min(whole, reach * 8)
        else:
            break
    if len(hashes) > most:
        near = near.where(F.col(name) < hashes[most])
    return near.drop(name)


def running(rows: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with the sums, over all rows earlier in a total order, of the given columns.

    The rows are parted by ranges of the order; sums run within a range, then over one row a range.
    """
    part, n = unique_names(rows, ["part", "parts"])
    cut = materialised(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    totals = cut.groupBy(part).agg(*[F.sum(c).alias(f"{k}_total") for k, c in sums.items()])
    across = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(part).alias(n), *[F.coalesce(F.sum(f"{k}_total").over(across), F.lit(0)).alias(f"{k}_before") for k in sums])
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = cut.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{k}_inside") for k, c in sums.items()])
    joined = own.join(F.broadcast(totals), F.col(part) == F.col(n))  # a row a partition
    return joined.select(*rows.columns, *[(F.col(f"{k}_before") + F.col(f"{k}_inside")).alias(k) for k in sums])


def join_by_size(rows: DataFrame, table: DataFrame, on: Sequence[str], size: str, hot: int = 100_000, biggest: int | None = None) -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each key and the number of ``rows`` that hold it.

    Keys that more than ``hot`` rows hold are joined where their rows are, so that none fills a task; of
    such keys there is at most one for each ``hot`` rows, which bounds what is broadcast. Where no key is hot
    (``biggest`` is the greatest number, if it is known) a plain join does.
    """
    if biggest is None:
        biggest = table.agg(F.max(size)).first()[0] or 0
    if biggest <= hot:
        return rows.join(table, list(on))
    few, many = table.where(F.col(size) <= hot), table.where(F.col(size) > hot)
    rest = rows.join(F.broadcast(many.select(*on)), list(on), "left_anti")
    return rest.join(few, list(on)).unionByName(rows.join(F.broadcast(many), list(on)))


def unique_names(frame: DataFrame, wanted: Sequence[str]) -> list[str]:
    """Names for helper columns that clash with none of the frame's columns."""
    taken = {c.lower() for c in frame.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out

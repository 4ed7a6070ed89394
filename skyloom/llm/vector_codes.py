"""Vector code compression: product codes of integer vectors, with codebooks refined by exact arithmetic.

Components become whole numbers, floor(scale * x), and vectors are cut into equal parts. A part's codebook starts
as that part of the vectors with the smallest ids; each round assigns every part to its nearest entry and replaces
an entry by the mean, rounded down, of what was assigned to it.

Assignment screens by one float32 matrix product a batch. Each product lies in an interval that holds the exact
value whatever the order of the sums: rounding both factors and w products and sums moves it by at most
(w + 4) * 2^-24 times the product of both norms, widened once more for the few operations in doubles.
Entries whose interval overlaps the best one are measured again in int64 (in unbounded integers where components are
so large that int64 could overflow), and equal distances go to the lower index, so codes are exact.

Only the codebooks (entries times dimensions) and their sums pass through the driver. The vectors are read once for
each round, once for the first entries and once for the final codes; write them first if they are dear to compute.

Defined results: rows whose vector is null or holds null or non-finite components are dropped; shorter vectors are padded with
zeros to the longest, and all to a multiple of the number of parts; rows without an id are coded but sort last among the
first entries; rows that repeat an id count each, ordered by their vectors; fewer rows than entries give as many entries;
errors beyond the range of a long are given as its end; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import join_by_size, materialised

#: Rows that are screened at a time: a bound for what ties with every entry.
ROWS = 1024
LONG = 2**63 - 1
#: Bound of the relative rounding error of a float32 operation, and a wider one than a double's.
SINGLE, DOUBLE = 2.0**-24, 2.0**-48


def usable(vectors: DataFrame, vector_col: str) -> DataFrame:
    """The rows whose vector has no null and no component that is not finite."""
    fine = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf"))
    return vectors.where(F.col(vector_col).isNotNull() & F.forall(F.col(vector_col), fine))


def whole(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of a batch of vectors, padded: int64, or Python's integers where those could overflow."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims))
    out[np.arange(dims) < sizes[:, None]] = flat
    if safe(np.abs(out).max(initial=0.0) * scale, dims):
        return np.floor(out * scale).astype(np.int64)
    # Beyond 2^53 every double is a whole number.
    return np.array([[int(np.floor(x * scale)) if abs(x) < 2.0**53 else int(x) * scale for x in row] for row in out.tolist()], dtype=object).reshape(out.shape)


def safe(most: float, dims: int) -> bool:
    """Whether squared distances of components up to ``most`` fit int64."""
    return 4.0 * (most + 1) ** 2 * dims < 2.0**62


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of the nearest entry for each row, the lower one of equals, and its exact squared distance."""
    index, error = np.zeros(len(x), np.int64), np.zeros(len(x), x.dtype if x.dtype == book.dtype else object)
    for at in range(0, len(x), ROWS):
        rows, cols = np.nonzero(close(x[at : at + ROWS], book))
        apart = x[at + rows] - book[cols]
        d = (apart * apart).sum(1)
        begins = np.flatnonzero(np.diff(rows, prepend=-1))  # every row has an entry whose interval is the best
        best = np.minimum.reduceat(d, begins) if len(d) else d
        ties = np.flatnonzero(d == np.repeat(best, np.diff(np.append(begins, len(d)))))
        first = ties[np.flatnonzero(np.diff(rows[ties], prepend=-1))]
        index[at : at + ROWS], error[at : at + ROWS] = cols[first], best
    return index, error


def close(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Which entries can be a row's nearest: those whose interval of |c|^2 - 2 x c reaches below the least upper end."""
    wide, wide_book = as_doubles(x), as_doubles(book)
    with np.errstate(over="ignore", invalid="ignore"):
        product = (wide.astype(np.float32) @ wide_book.astype(np.float32).T).astype(np.float64)
        norms, own = np.sqrt((wide * wide).sum(1)), (wide_book * wide_book).sum(1)
        score = own - 2 * product
        error = 2.02 * (x.shape[1] + 4) * SINGLE * norms[:, None] * np.sqrt(own) + DOUBLE * x.shape[1] * (own + 2 * np.abs(product)) + 1e-6
        least = (score + error).min(1)
        # What overflows compares false, and so is measured exactly.
        return ~(score - error > least[:, None])


def as_doubles(x: np.ndarray) -> np.ndarray:
    """The nearest doubles, infinite beyond their range."""
    if x.dtype != object:
        return x.astype(np.float64)
    return np.array([float(v) if abs(v) < 2**1023 else (np.inf if v > 0 else -np.inf) for v in x.ravel().tolist()]).reshape(x.shape)


def _assigned(batch: pa.RecordBatch, column: str, books: list[np.ndarray], dims: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Parts, indexes and errors by part of a batch."""
    x = whole(batch.column(batch.schema.get_field_index(column)), dims, scale)
    for part, book in zip(np.split(x, len(books), axis=1), books, strict=True):
        if part.dtype != book.dtype:
            part, book = part.astype(object), book.astype(object)
        yield part, *nearest(part, book)


def _sums(rows: DataFrame, column: str, books: list[np.ndarray], dims: int, scale: int) -> dict[int, tuple[int, list[int]]]:
    """Count and sums of what is assigned to each entry (part * entries + index)."""
    entries, width = len(books[0]), dims // len(books)
    keep = {"key": pa.int32(), "n": pa.int64(), "sums": pa.string()}

    def told(found: dict[int, list]) -> Iterator[pa.RecordBatch]:
        if found:
            parts = [list(found), [v[0] for v in found.values()], [",".join(map(str, v[1])) for v in found.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(p, t) for p, t in zip(parts, keep.values(), strict=True)], list(keep))

    def take(found: dict[int, list], key: int, n: int, sums: list[int]) -> None:
        own = found.setdefault(key, [0, [0] * width])
        own[0] += n
        own[1] = [a + b for a, b in zip(own[1], sums, strict=True)]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for p, (part, index, _) in enumerate(_assigned(batch, column, books, dims, scale)):
                order = np.argsort(index, kind="stable")
                begins = np.flatnonzero(np.diff(index[order], prepend=-1))
                ends = np.append(begins[1:], len(order))
                for e, a, b in zip(index[order][begins].tolist(), begins.tolist(), ends.tolist(), strict=True):
                    take(found, p * entries + e, b - a, part[order[a:b]].sum(0).tolist())
        yield from told(found)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                take(found, r["key"], r["n"], [int(s) for s in r["sums"].split(",")])
        yield from told(found)

    kind = "key int, n long, sums string"
    return {r.key: (r.n, [int(s) for s in r.sums.split(",")]) for r in rows.select(column).mapInArrow(local, kind).repartition("key").mapInArrow(merged, kind).collect()}


def codebooks(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> list[np.ndarray]:
    """The refined codebook of each part; empty books for an empty table."""
    rows = usable(vectors, vector_col).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 1
    dims = -(-longest // parts) * parts
    first = rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    x = whole(pa.array([r.v for r in first], pa.list_(pa.float64())), dims, scale)
    books = np.split(x, parts, axis=1)
    for _ in range(rounds if len(x) else 0):
        books = [b.copy() for b in books]
        for key, (n, sums) in _sums(rows, "v", books, dims, scale).items():
            p, e = divmod(key, len(x))
            entry = [s // n for s in sums]
            if books[p].dtype != object and not safe(max(map(abs, entry)), dims):
                books[p] = books[p].astype(object)
            books[p][e] = entry
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components as decimals, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encoded(vectors: DataFrame, books: list[np.ndarray], id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 1024) -> DataFrame:
    """id, label, code (two hex digits a part; more where a book has over 256 entries) and error of each usable row."""
    dims = sum(b.shape[1] for b in books)
    digits = max(2, len(f"{max(1, len(books[0])) - 1:x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = [""] * len(batch), [0] * len(batch)
            for _, index, error in _assigned(batch, "v", books, dims, scale):
                codes = [c + f"{i:0{digits}x}" for c, i in zip(codes, index.tolist(), strict=True)]
                errors = [a + b for a, b in zip(errors, error.tolist(), strict=True)]
            told = pa.array([min(e, LONG) for e in errors], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), told], ["id", "label", "code", "error"])

    rows = usable(vectors, vector_col).select(F.col(id_col).cast("long").alias("id"), F.to_json(F.struct(F.col(label_col).alias("x"))).alias("label"), F.col(vector_col).alias("v"))
    return rows.mapInArrow(run, "id long, label string, code string, error long")


def compressed(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 1024) -> DataFrame:
    """vec_id, code, error, label_error (summed over the rows of the same label, nulls together), codebooks_sha256."""
    books = codebooks(vectors, parts, entries, rounds, id_col, vector_col, scale)
    rows = materialised(encoded(vectors, books, id_col, vector_col, label_col, scale))
    total = F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(LONG).cast("decimal(20,0)")).cast("long")
    labels = rows.groupBy("label").agg(total.alias("label_error"), F.count("*").alias("n"))
    joined = join_by_size(rows, labels, ["label"], "n")
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """The same rows where all vectors are equally long, a multiple of the parts, and ids do not repeat."""
    d = "list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT rid, part, min(struct_pack(d, e)) AS best FROM (SELECT v.rid, v.part, b.e, {d} AS d FROM cut v JOIN b{k} b USING (part)) GROUP BY rid, part)")
        if k < rounds:
            steps.append(f"""u{k} AS (SELECT part, e, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT part, best.e AS e, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM a{k} JOIN cut USING (rid, part)) GROUP BY ALL),
m{k} AS (SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS x FROM u{k} GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m USING (part, e))""")
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS rid, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (SELECT rid, part, x[part * (len(x) // {parts}) + 1 : (part + 1) * (len(x) // {parts})] AS x FROM v, range({parts}) AS r(part)),
b0 AS (SELECT part, rid AS e, x FROM cut WHERE rid < {entries}),
{",".join(steps)},
done AS (SELECT rid, lower(string_agg(lpad(to_hex(best.e), 2, '0'), '' ORDER BY part)) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) FROM b{rounds}) AS codebooks_sha256 FROM done JOIN v USING (rid)"""

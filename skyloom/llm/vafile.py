"""Exact top-k inner products with vector-approximation files.

Vectors become integers, floor(scale * x). They are packed into blocks of bounded size; each block
carries, for every dimension, its range and one byte a vector that names the cell of the value. A query
has for each dimension a table of the most that a cell can add to its score. As such a table is linear in
the cell's number, the sums of its entries over all vectors are one product of the query's steps with
the bytes. Exact vectors are read in the order of these bounds until the k-th best score, carried from
block to block, is above the next bound; blocks whose best bound is below it are not read at all.

Blocks of vectors and of queries are dealt into groups of bounded bytes, and each group of vectors meets
each group of queries in one task. Where the queries fit one group, as a hundredth of the vectors
mostly does, vectors are shuffled once, and queries once for each group of vectors.

Defined results: rows without an id, without a vector, or with null or non-finite components take no
part; shorter vectors are padded with zeros to the longest; empty vectors score 0 with all; equal scores
rank by the smaller id; rows that repeat an id are candidates each, and queries each with results of
their own, but no candidates for each other; large components are multiplied as unbounded integers, and
scores beyond the range of a long are given, and rank, as its nearest end; no other rows give fewer than
k, or no, results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import materialised

BLOCK = 2048
QUERY_BLOCK = 256
CELLS = 256
#: Bytes of packed vectors (of queries) that one task holds at a time.
GROUP_BYTES = 64 << 20
LONG = 2**63 - 1
#: Components up to this size, and sums of products up to this size, are exact in machine integers.
SAFE, SAFE_SUM = 2.0**31 - 1, 2.0**62


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id long and v array<double> of the rows that take part."""
    x = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    fine = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf"))
    ok = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(F.col(vector_col), fine)
    return vectors.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("v"))


def pack(ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, scale: int = 1024) -> dict[str, bytes]:
    """A block: ids, row numbers, exact vectors, each dimension's lowest value and cell width, and the cells.

    Exact vectors are integers; where a block's do not fit 32 bits they stay as they came, unscaled.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        # Scaling by a power of two and rounding down are exact in doubles, up to where they turn infinite.
        whole = np.floor(vectors * scale)
        low = whole.min(0)
        width = np.maximum(1.0, np.ceil((whole.max(0) - low + 1) / CELLS))
        # Where doubles are coarser than 1 the division may round up to the end of the range; without a range all share a cell.
        cells = np.clip(np.nan_to_num((whole - low) // width, nan=0.0), 0, CELLS - 1).astype(np.uint8)
    small = len(vectors) and np.abs(whole).max(initial=0.0) <= SAFE
    return {
        "ids": ids.astype("<i8").tobytes(), "rows": rows.astype("<i8").tobytes(), "exact": (whole.astype("<i4") if small else vectors.astype("<f8")).tobytes(), "small": bool(small),
        "low": low.astype("<f8").tobytes(), "width": width.astype("<f8").tobytes(), "cells": cells.tobytes(),
    }


def unpacked(block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, row numbers and exact vectors of a packed block."""
    ids = np.frombuffer(block.ids, "<i8")
    return ids, np.frombuffer(block.rows, "<i8"), np.frombuffer(block.exact, "<i4" if block.small else "<f8").reshape(len(ids), -1)


def integers(vector: np.ndarray, scale: int) -> list[int]:
    """floor(scale * x) without bounds; vectors of integers are such already."""
    if vector.dtype.kind == "i":
        return vector.tolist()
    return [int(np.floor(x * scale)) if abs(x) < 2.0**53 else int(x) * scale for x in vector.tolist()]


def products(vectors: np.ndarray, query: np.ndarray, scale: int = 1024) -> np.ndarray:
    """Exact inner products with a query, cut to the range of a long; doubles are unscaled, as in ``pack``."""
    if vectors.dtype.kind == query.dtype.kind == "i":
        most = float(np.abs(query.astype(np.float64)).max(initial=0.0)) * float(np.abs(vectors.astype(np.float64)).max(initial=0.0)) * max(1, len(query))
        if most < SAFE_SUM:
            return vectors.astype(np.int64) @ query.astype(np.int64)
    asked = integers(query, scale)
    sums = [sum(a * x for a, x in zip(asked, integers(v, scale), strict=True)) for v in vectors]
    return np.array([max(-LONG - 1, min(LONG, s)) for s in sums], np.int64)


class Best:
    """The k best candidates so far of each query of a block, and how many exact vectors were read."""

    def __init__(self, block, k: int, scale: int = 1024):
        self.ids, self.rows, self.queries = unpacked(block)
        with np.errstate(over="ignore"):
            self.asked = self.queries.astype(np.float64) if block.small else np.floor(self.queries * scale)
        self.k, self.scale = k, scale
        self.found = [np.zeros(0, np.int64) for _ in self.ids]
        self.scores = [np.zeros(0, np.int64) for _ in self.ids]
        self.read = 0

    def scan(self, block, cells: np.ndarray) -> None:
        """Takes in a block of vectors; ``cells`` are its bytes as doubles."""
        ids, _, exact = unpacked(block)
        low, width = (np.frombuffer(x, "<f8") for x in (block.low, block.width))
        with np.errstate(over="ignore", invalid="ignore"):
            # The most that cell c of dimension d adds is q * (low + c * width), and q * (width - 1) more where q > 0.
            steps = self.asked * width
            base = self.asked @ low + np.maximum(self.asked, 0.0) @ (width - 1)
            bounds = base[:, None] + steps @ cells.T
            # The sums are rounded; the bound stays one with this much added.
            bounds += (1.0 + np.abs(self.asked) @ (np.abs(low) + CELLS * width))[:, None] * 1e-9 + 1
        bounds[~np.isfinite(bounds)] = np.inf  # what overflows on the way bounds nothing, so the exact vector is read
        np.maximum(bounds, -float(LONG), out=bounds)  # as scores are cut to the range of a long
        for q, own in enumerate(self.ids):
            bound = bounds[q]
            others = ids != own
            at = np.flatnonzero(others & (bound >= self.scores[q][-1]) if len(self.scores[q]) == self.k else others)
            if len(at):
                self._read(q, at[np.argsort(-bound[at], kind="stable")], bound, ids, exact)

    def _read(self, q: int, order: np.ndarray, bound: np.ndarray, ids: np.ndarray, exact: np.ndarray) -> None:
        found, scores = self.found[q], self.scores[q]
        at = 0
        while at < len(order) and (len(scores) < self.k or scores[-1] <= bound[order[at]]):
            part = order[at : at + self.k]
            at += self.k
            self.read += len(part)
            found = np.concatenate([found, ids[part]])
            scores = np.concatenate([scores, products(exact[part], self.queries[q], self.scale)])
            best = np.lexsort((found, -1 - scores))[: self.k]
            found, scores = found[best], scores[best]
        self.found[q], self.scores[q] = found, scores

    def frame(self) -> pd.DataFrame:
        n = [len(f) for f in self.found]
        return pd.DataFrame({"query_row": np.repeat(self.rows, n), "query_id": np.repeat(self.ids, n), "vec_id": np.concatenate(self.found), "score": np.concatenate(self.scores)})


def _packed(rows: DataFrame, blocks: int, dims: int, per_group: int, scale: int) -> DataFrame:
    """One row a block: its group (``per_group`` blocks each) and the parts of ``pack``."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        vectors = np.zeros((len(group), dims))
        for i, v in enumerate(group["v"]):
            vectors[i, : len(v)] = v
        return pd.DataFrame([{"part": group["block"].iloc[0] // per_group, **pack(group["vec_id"].to_numpy(np.int64), group["row"].to_numpy(np.int64), vectors, scale)}])

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInPandas(run, "part int, ids binary, rows binary, exact binary, small boolean, low binary, width binary, cells binary")


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose id is divisible by ``every``."""
    rows = materialised(usable(vectors, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()))
    asked = F.col("vec_id") % every == 0
    n, n_asked, dims = rows.agg(F.count("*"), F.count(F.when(asked, 1)), F.greatest(F.lit(1), F.coalesce(F.max(F.size("v")), F.lit(1)))).first()
    blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-n_asked // QUERY_BLOCK))
    # A vector takes up to nine bytes a dimension, and eight more once its cells are doubles, a block at a time.
    per_group, queries_a_group = (max(1, group_bytes // (size * dims * 16)) for size in (BLOCK, QUERY_BLOCK))
    per_group = min(per_group, max(1, blocks // (2 * rows.sparkSession.sparkContext.defaultParallelism)))
    groups, query_groups = -(-blocks // per_group), -(-query_blocks // queries_a_group)
    both = lambda frame, name, copies: frame.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    stored = both(_packed(rows, blocks, dims, per_group, scale).withColumnRenamed("part", "g"), "h", query_groups)
    queries = both(_packed(rows.where(asked), query_blocks, dims, queries_a_group, scale).withColumnRenamed("part", "h"), "g", groups)

    def run(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        best = [Best(block, k, scale) for block in asked.itertuples(index=False)]
        for block in own.itertuples(index=False):
            cells = np.frombuffer(block.cells, np.uint8).reshape(-1, dims).astype(np.float64)
            for b in best:
                b.scan(block, cells)
        empty = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_row", "query_id", "vec_id", "score")})
        return pd.concat([b.frame() for b in best], ignore_index=True) if best else empty

    pairs = queries.groupBy("g", "h").cogroup(stored.groupBy("g", "h"))
    found = pairs.applyInPandas(run, "query_row long, query_id long, vec_id long, score long")
    # Each task drops what cannot be among its k best of a query before anything is shuffled.
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(k: int = 10, every: int = 100, scale: int = 1024) -> str:
    return f"""
WITH v AS (SELECT row_number() OVER () AS rid, vec_id::BIGINT AS vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % {every} = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""

"""Approximate nearest neighbours by multi-index hashing.

Directions of a bounded sample teach rotations whose signs are binary codes: the sample's principal axes, turned
so that signs lose the least (iterative quantisation), from several starts until there are ``BITS`` bits. Codes are cut into
bytes. Each block of rows holds for every byte an index of the rows by its value. By the pigeonhole
principle a code within radius r = m s + a of another differs in at most s bits in one of the first a + 1 of the m bytes, or in
at most s - 1 in one of the others; so probing those values retrieves every code within r, which whole codes verify.
The verified rows are measured in doubles on the original vectors.

The radius follows the k-th distance: the sample tells, for pairs up to a distance, the number of differing bits that
all but a share of 1 - ``KEPT`` of them stay within. A query probes wider and wider until it has k rows, then as far as
the distance of the k-th asks for, and carries that distance from block to block; where the sample says nothing
the radius is the whole code, which is an exact search.

Blocks of rows and of queries are dealt into groups of bounded bytes, and each group of rows meets each group of queries
in one task, so rows are shuffled once for each group of queries.

Defined results: rows without an id, without a vector, with a zero vector, or with null or non-finite components take no part;
shorter vectors are padded with zeros to the longest; distances beyond the range of doubles are infinite, and no square overflows or
vanishes before; equal distances rank by the smaller id; rows that repeat an id are candidates each, and queries each with
results of their own, but no candidates for each other; no other rows give fewer than k, or no, results; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import bounded_sample, materialised

#: Rows that teach the rotations and radii; a parameter of ``fit``.
FIT_ROWS = 4096
BITS = 128
#: Share of the sample's pairs that the radius for their distance retrieves.
KEPT = 0.98
BLOCK = 4096
QUERY_BLOCK = 256
#: Bytes of vectors (of queries) that one task holds at a time.
GROUP_BYTES = 64 << 20
BYTE_BITS = np.array([bin(v).count("1") for v in range(256)], np.uint8)
#: By number of bits: the masks that differ from 0 in at most so many.
MASKS = [np.flatnonzero(BYTE_BITS <= s).astype(np.uint8) for s in range(9)]


class Codes(NamedTuple):
    """What was learned: the centre of directions, the rotations side by side, and the radius by distance."""

    centre: np.ndarray
    turn: np.ndarray
    distances: np.ndarray
    radii: np.ndarray

    def radius(self, distance: float) -> int:
        at = int(np.searchsorted(self.distances, distance))
        return int(self.radii[at]) if at < len(self.radii) else self.turn.shape[1]

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """The codes of vectors, a byte for eight bits."""
        return np.packbits((directions(vectors) - self.centre) @ self.turn > 0, axis=1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id long and v array<double> of the rows that take part."""
    x = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    fine = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("v"))
    return rows.where(F.forall("v", fine) & F.exists("v", lambda e: e != 0))


def padded(vectors: pd.Series | list, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def directions(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; powers of two keep squares within range."""
    shift = np.frexp(np.abs(vectors).max(1, initial=0.0))[1]
    near = np.ldexp(vectors, -shift[:, None])
    return near / np.maximum(np.sqrt((near * near).sum(1, keepdims=True)), 1e-300)


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in doubles."""
    with np.errstate(over="ignore"):
        apart = vectors - query
    top = np.abs(apart).max(1, initial=0.0)
    if ((top < 1e150) & ((top > 1e-150) | (top == 0))).all():
        return np.sqrt((apart * apart).sum(1))
    shift = np.where(np.isfinite(top), np.frexp(top)[1], 0)
    apart = np.ldexp(apart, -shift[:, None])
    return np.ldexp(np.sqrt((apart * apart).sum(1)), shift)


def learned(x: np.ndarray, bits: int = BITS, kept: float = KEPT, seed: int = 5) -> Codes:
    """Rotations and radii of a sample."""
    rng = np.random.default_rng(seed)
    unit = directions(x)
    centre = unit.mean(0) if len(x) else np.zeros(x.shape[1])
    around = unit - centre
    width = min(bits, x.shape[1])
    axes = np.linalg.eigh(around.T @ around)[1][:, ::-1][:, :width]
    flat, turns = around @ axes, []
    while sum(t.shape[1] for t in turns) < bits:
        turn = np.linalg.qr(rng.normal(size=(width, width)))[0]
        for _ in range(30 if len(x) else 0):
            u, _, v = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
            turn = (u @ v).T
        turns.append(axes @ turn)
    codes = Codes(centre, np.concatenate(turns, axis=1)[:, :bits], np.zeros(0), np.zeros(0))
    packed = codes.encode(x)
    d, h = [], []
    for i in range(0, len(x), max(1, len(x) // 512)):
        others = np.arange(len(x)) != i
        d.append(distances(x[others], x[i]))
        h.append(BYTE_BITS[packed[others] ^ packed[i]].sum(1))
    if len(x) < 2:
        return codes
    d, h = np.concatenate(d), np.concatenate(h)
    order = np.argsort(d, kind="stable")
    ends, n = [], 500
    while n < len(order):
        ends.append(n)
        n = n * 5 // 4
    ends.append(len(order))
    radii = np.maximum.accumulate([int(np.quantile(h[order[:e]], kept, method="higher")) + 1 for e in ends])
    return codes._replace(distances=d[order[np.array(ends) - 1]], radii=np.minimum(radii, bits))


def fit(rows: DataFrame, dims: int, most: int = FIT_ROWS) -> Codes:
    """Learns from at most ``most`` distinct vectors; ``rows`` as ``usable`` gives them."""
    sample = sorted(tuple(r.v) for r in bounded_sample(rows.select("v"), ["v"], most).collect())
    return learned(padded(sample, dims))


class Index:
    """The rows of a block by the bytes of their codes."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, codes: np.ndarray):
        self.vectors, self.ids, self.codes = vectors, ids, codes
        self.rows = np.argsort(codes, axis=0, kind="stable").T.astype(np.int64)
        values = np.arange(257)
        self.starts = np.array([np.searchsorted(codes[r, j], values) for j, r in enumerate(self.rows)])

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code differs in at most ``radius`` bits."""
        wide, more = divmod(radius, len(code))
        hit = np.zeros(len(self.ids), bool)
        for j, value in enumerate(code):
            reach = min(8, wide if j <= more else wide - 1)
            if reach < 0:
                break
            probes = MASKS[reach] ^ value
            at, n = self.starts[j, probes], self.starts[j, probes.astype(np.int64) + 1] - self.starts[j, probes]
            before = np.cumsum(n) - n
            hit[self.rows[j, np.repeat(at - before, n) + np.arange(n.sum())]] = True
        found = np.flatnonzero(hit)
        return found[BYTE_BITS[self.codes[found] ^ code].sum(1) <= radius]


class Nearest:
    """The k nearest rows so far of each query of a block, and how many rows were measured."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, learned: Codes, k: int):
        self.ids, self.rows, self.vectors, self.learned, self.k = ids, rows, vectors, learned, k
        self.codes = learned.encode(vectors)
        self.found = [np.zeros(0, np.int64) for _ in ids]
        self.scores = [np.zeros(0) for _ in ids]
        self.read = 0

    def scan(self, index: Index) -> None:
        bits = self.learned.turn.shape[1]
        for q, own in enumerate(self.ids):
            done = np.zeros(len(index.ids), bool)
            radius = self._radius(q, bits)
            reach = radius if radius is not None else self.codes.shape[1] - 1
            while True:
                new = index.within(self.codes[q], reach)
                new = new[(index.ids[new] != own) & ~done[new]]
                done[new] = True
                self._take(q, index.ids[new], distances(index.vectors[new], self.vectors[q]))
                asked = self._radius(q, bits)
                if reach >= (bits if asked is None else asked):
                    break
                reach = asked if asked is not None else min(bits, reach + self.codes.shape[1])

    def _radius(self, q: int, bits: int) -> int | None:
        """How far the codes of rows as near as the k-th may lie; None while there are fewer than k."""
        return min(bits, self.learned.radius(self.scores[q][-1])) if len(self.scores[q]) == self.k else None

    def _take(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        self.read += len(ids)
        found, scores = np.concatenate([self.found[q], ids]), np.concatenate([self.scores[q], scores])
        best = np.lexsort((found, scores))[: self.k]
        self.found[q], self.scores[q] = found[best], scores[best]

    def frame(self) -> pd.DataFrame:
        n = [len(f) for f in self.found]
        return pd.DataFrame({"query_row": np.repeat(self.rows, n), "query_id": np.repeat(self.ids, n), "vec_id": np.concatenate(self.found), "score": np.concatenate(self.scores)})


def _packed(rows: DataFrame, blocks: int, dims: int, per_group: int, codes: Codes) -> DataFrame:
    """One row a block: its group (``per_group`` blocks each), ids, row numbers, vectors and codes."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        x = padded(group["v"], dims)
        parts = {"ids": group["vec_id"].to_numpy("<i8").tobytes(), "rows": group["row"].to_numpy("<i8").tobytes(), "exact": x.astype("<f8").tobytes(), "codes": codes.encode(x).tobytes()}
        return pd.DataFrame([{"part": group["block"].iloc[0] // per_group, **parts}])

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInPandas(run, "part int, ids binary, rows binary, exact binary, codes binary")


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", most: int = FIT_ROWS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row whose id is divisible by ``every``."""
    rows = materialised(usable(vectors, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()))
    asked = F.col("vec_id") % every == 0
    n, n_asked, dims = rows.agg(F.count("*"), F.count(F.when(asked, 1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    codes = fit(rows, dims, most)
    blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-n_asked // QUERY_BLOCK))
    per_group, queries_a_group = (max(1, group_bytes // (size * dims * 16)) for size in (BLOCK, QUERY_BLOCK))
    per_group = min(per_group, max(1, blocks // (2 * rows.sparkSession.sparkContext.defaultParallelism)))
    groups, query_groups = -(-blocks // per_group), -(-query_blocks // queries_a_group)
    both = lambda frame, name, copies: frame.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    stored = both(_packed(rows, blocks, dims, per_group, codes).withColumnRenamed("part", "g"), "h", query_groups)
    queries = both(_packed(rows.where(asked), query_blocks, dims, queries_a_group, codes).withColumnRenamed("part", "h"), "g", groups)

    def unpacked(block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids = np.frombuffer(block.ids, "<i8")
        return ids, np.frombuffer(block.rows, "<i8"), np.frombuffer(block.exact, "<f8").reshape(len(ids), -1), np.frombuffer(block.codes, np.uint8).reshape(len(ids), -1)

    def run(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        best = [Nearest(*unpacked(block)[:3], codes, k) for block in asked.itertuples(index=False)]
        for block in own.itertuples(index=False):
            ids, _, exact, packed = unpacked(block)
            index = Index(exact, ids, packed)
            for b in best:
                b.scan(index)
        empty = pd.DataFrame({"query_row": np.zeros(0, np.int64), "query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        return pd.concat([b.frame() for b in best], ignore_index=True) if best else empty

    pairs = queries.groupBy("g", "h").cogroup(stored.groupBy("g", "h"))
    found = pairs.applyInPandas(run, "query_row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query_row").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

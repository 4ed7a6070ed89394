"""SimHash near-duplicates found by the generalised pigeonhole principle.

Fingerprints of 64 bits link when they differ in ``distance`` bits at most. The bits are grouped into
partitions of correlated bits; each partition i gets its own threshold t_i, with the sum of the
thresholds ``distance - m + 1`` for m partitions: a linked pair then agrees within t_i on at least one
partition. A dynamic programme picks the thresholds with the least estimated number of probes and
candidates, from a bounded sample of fingerprints; the choice affects cost alone, never the links.

A partition with threshold t is probed under the keys of every way to leave out t of its bits, so two
fingerprints share a key just if they differ within the left-out bits. Keys that hold many distinct
fingerprints are probed anew with a part of the remaining bits added (again by the pigeonhole), until
every group is small; groups then report a spanning forest of their links, not all pairs.

Defined results: null and wordless texts have fingerprint zero and link with it; rows with a null id
join no component of their own and take the id of their component, if any; equal fingerprints are one
node whose copies cost nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import bounded_sample, join_by_size, materialised, unique_names
from skyloom.llm.components import components

BITS = 64
#: Fingerprints that the plan is estimated from, at most about.
PLAN_SAMPLE = 20_000
#: Distinct fingerprints that are compared with each other in one group, at most.
GROUP = 4096


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 hashes of a text's word shingles, as an unsigned integer."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode().lower().split()  # bytes: A-Z alone are lowered, space and \t to \r alone part words
    if not found:
        return 0
    if len(found) < shingle:
        hashes = [xxh64_intdigest(b" ".join(found), seed)]
    else:
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        joined = b" ".join(found)
        hashes = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[: len(found) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[k : k + (1 << 16)], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * counts > len(hashes)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """id and fp (the fingerprint's bits as a signed long) of each row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["id", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def as_bits(values: np.ndarray) -> np.ndarray:
    """One row of 64 zeros and ones for each value, lowest bit first."""
    return np.unpackbits(np.ascontiguousarray(values, "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlated_partitions(bits: np.ndarray, m: int) -> list[list[int]]:
    """The bit positions in m groups of near-equal size; each grows by the bit most correlated with it."""
    centred = bits - bits.mean(0) if len(bits) else np.zeros((1, BITS))
    scale = np.sqrt((centred**2).sum(0))
    scale[scale == 0] = 1
    near = np.abs(centred.T @ centred) / np.outer(scale, scale)
    left, groups = set(range(BITS)), []
    for k in range(m):
        want = len(left) // (m - k)
        first = min(left, key=lambda b: (-near[b, sorted(left)].sum(), b))
        group = [first]
        left.discard(first)
        while len(group) < want:
            best = min(left, key=lambda b: (-near[b, group].sum(), b))
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def allocate(costs: list[dict[int, float]], total: int) -> list[int]:
    """Thresholds, one of each dict's keys, that sum to ``total`` at the least summed cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in costs:
        grown: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, c in options.items():
                if used + t not in grown or cost + c < grown[used + t][0]:
                    grown[used + t] = (cost + c, [*chosen, t])
        best = grown
    return best[total][1]


def plan(sample: np.ndarray, n: int, distance: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition to probe, for n distinct fingerprints of which ``sample`` are some."""
    bits = as_bits(sample).astype(np.float64)
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in range(1, distance + 3):
        groups = correlated_partitions(bits, m)
        costs = []
        for group in groups:
            keys = bits[:, group].astype(np.int64) @ (1 << np.arange(len(group), dtype=np.int64)) if len(sample) else np.zeros(0, np.int64)
            options = {-1: 0.0}
            for t in range(distance + 1):
                probes = n * comb(len(group), t)
                pairs = 0.0
                # A key that leaves out t bits, averaged over a few choices of them.
                ways = list(combinations(range(len(group)), t))
                shown = ways[:: max(1, len(ways) // 8)][:8]
                for out in shown:
                    mask = ~np.int64(sum(1 << b for b in out))
                    sizes = np.unique(keys & mask, return_counts=True)[1].astype(np.float64)
                    seen = float((sizes * (sizes - 1)).sum()) / 2
                    even = len(sample) * (len(sample) - 1) / 2.0 ** (len(group) - t + 1)  # what rare keys would give
                    pairs += max(seen, even) * len(ways) / len(shown)
                grow = (n / max(1, len(sample))) ** 2
                options[t] = probes + 0.05 * pairs * grow
            costs.append(options)
        total = distance - m + 1
        if total < -m:
            continue
        chosen = allocate(costs, total)
        cost = sum(c[t] for c, t in zip(costs, chosen, strict=True))
        probed = [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0]
        if best is None or cost < best[0]:
            best = (cost, probed)
    return best[1]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def first_masks(partitions: list[tuple[list[int], int]]) -> list[int]:
    """The masks of the keys: for threshold t, every way to leave out t of the partition's bits."""
    return [_mask(group) & ~_mask(list(out)) for group, t in partitions for out in combinations(group, t)]


def finer(mask: int, distance: int) -> list[int]:
    """Masks with one of distance + 1 parts of the remaining bits added: a linked pair agrees on one of them."""
    rest = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | _mask(rest[k :: distance + 1]) for k in range(distance + 1)]


def spanning_links(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Pairs that connect just what the links among distinct ``values`` connect: a breadth-first forest."""
    values = np.asarray(values, np.int64)
    left, out = np.arange(len(values)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count((values[left] ^ values[at]).view(np.uint64)) <= distance
            if near.any():
                new = left[near]
                left = left[~near]
                queue.extend(new.tolist())
                out += [(int(values[at]), int(v)) for v in values[new]]
    return out


def links(distinct: DataFrame, distance: int, group: int = GROUP) -> DataFrame:
    """(a, b): verified links between the distinct fingerprints ``fp`` that connect all that link."""
    spark = distinct.sparkSession
    n = distinct.count()
    sample = np.sort(bounded_sample(distinct, ["fp"], PLAN_SAMPLE).toPandas()["fp"].to_numpy(np.int64))
    masks = first_masks(plan(sample, n, distance))
    keyed, found = distinct, None
    many = None
    while masks:
        # Long mask tables (a probe with t = 2 has thousands) are exploded from one literal array.
        numbered = F.posexplode(F.array(*[F.lit(_signed(m)).cast("long") for m in masks])) if many is None else None
        if many is None:
            rows = keyed.select("fp", numbered.alias("path", "mask"))
        else:
            rows = keyed.join(F.broadcast(many), "path").select("fp", F.col("child").alias("path"), "mask")  # a row a mask: a few hundred bytes
        rows = rows.select("path", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        sizes = materialised(rows.groupBy("path", "key").agg(F.count("*").alias("size")).where("size > 1"))
        biggest = sizes.agg(F.max("size")).first()[0] or 0
        rows = join_by_size(rows, sizes, ["path", "key"], "size", biggest=biggest)
        small = rows.where(F.col("size") <= group).groupBy("path", "key").agg(F.collect_list("fp").alias("fps")).select("fps")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                pairs = [p for fps in batch["fps"] for p in spanning_links(fps, distance)]
                yield pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")

        part = small.mapInPandas(run, "a long, b long")
        found = part if found is None else found.unionByName(part)
        if biggest <= group:
            break
        keyed = materialised(rows.where(F.col("size") > group).select("path", "fp"))
        # Crowded paths alone go on: their children are a few rows for each.
        crowded = {r[0] for r in keyed.select("path").distinct().collect()}
        children = [(p, c) for p, m in enumerate(masks) if p in crowded for c in finer(m, distance)]
        many = spark.createDataFrame([(p, i, _signed(c)) for i, (p, c) in enumerate(children)], "path int, child int, mask long")
        masks = [c for _, c in children]
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """id, fingerprint (16 hex digits), component_id (the smallest id reachable) and n_copies of each row's fingerprint."""
    prints = materialised(fingerprints(docs, id_col, text_col, shingle, seed))
    distinct = materialised(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n_copies")))
    found = components(links(distinct.select("fp"), distance))
    with_root = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = with_root.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = with_root.join(least, "root").select("fp", "component_id", "n_copies")
    # One fingerprint may hold a third of all rows.
    out = join_by_size(prints, of_print, ["fp"], "n_copies", biggest=distinct.agg(F.max("n_copies")).first()[0] or 0)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_copies")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component; of rows that repeat an id, one.

    Only ids and fingerprints are shuffled, then the ids that stay meet the texts. Rows without an id
    name no component and are kept, one for each text.
    """
    groups = near_duplicates(docs, id_col, text_col, distance, shingle, seed)
    (name,) = unique_names(docs, ["kept"])
    names = groups.where(F.col(id_col) == F.col("component_id")).groupBy(F.col(id_col).alias(name)).agg(F.count("*").alias("times"))
    names = materialised(names)
    once, more = (names.where(test).select(name) for test in ("times = 1", "times > 1"))
    out = docs.join(once, F.col(id_col) == F.col(name), "left_semi")
    if not more.isEmpty():
        out = out.unionByName(docs.join(more, F.col(id_col) == F.col(name), "left_semi").dropDuplicates([id_col]))
    return out.unionByName(docs.where(F.col(id_col).isNull()).dropDuplicates([text_col]))

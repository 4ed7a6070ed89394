"""Source divergence audit: how far the word frequencies of each source lie from every other source's and from its language's.

Counts come from one pass in which each task sums its own documents, then meet by term. For pairs of sources the terms
are split. With b the frequency that a term without occurrences has in a source, and z(s, t) what such a term adds
to the pair (s, t), every kept term starts as z, all of them together as V z. A term that many sources hold
is laid out in a dense tile of terms by sources, and the tile adds f - z for each pair. A term that few sources
hold adds corrections along its postings alone: f(p, b) - z for those that only s holds, summed by equal p, f(b, p) - z for
those that only t holds, and for the pairs that both hold what the two have missed, f(p, q) - f(p, b) - f(b, q) + z. Both
sums are whole numbers of 64 bits, so they add up exactly in any order.

Tiles hold a bounded number of terms; sources are met in blocks of ``SOURCES``, so neither a language nor a source ever fills a task.
The result has a row for each ordered pair of a language's sources, as it is asked for.

Defined results: null texts, languages and sources count as empty ones; a group without terms has the frequencies
of no occurrences; a language without kept terms has pairs of value 0 and no terms; texts need not be ASCII, only A to Z are
folded; repeated rows count each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import join_by_size, materialised

SCALE = 1_000_000_000
#: Counters of a task, before they are handed on.
ENTRIES = 500_000
#: Postings of a tile, and sources of a block.
POSTINGS, SOURCES = 400_000, 1024
#: Cells of a dense piece, and pairs that are corrected at a time.
CELLS = 1 << 20
#: Lower case for A to Z, blanks for the other ASCII characters but a to z.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n, docs: how often and in how many documents a group has a term; parts of it, to be summed."""
    names = ["lang", "source", "term", "n", "docs"]
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])

    def told(found: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (a, b), (n, own) in found.items():
            if n:
                terms = list(n)
                yield pa.RecordBatch.from_arrays([pa.repeat(a, len(terms)), pa.repeat(b, len(terms)), pa.array(terms, pa.binary()), pa.array(n.values(), pa.int64()), pa.array([own[t] for t in terms], pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for value, a, b in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                terms = value.as_py().translate(FOLD).split()
                n, own = found.setdefault((a, b), (Counter(), Counter()))
                size -= len(n)
                n.update(terms)
                own.update(set(terms))
                size += len(n)
                if size > ENTRIES:
                    yield from told(found)
                    found, size = {}, 0
        yield from told(found)

    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = docs.select(blank(text).cast("binary").alias("text"), blank(lang).alias("lang"), blank(source).alias("source"))
    return rows.mapInArrow(run, "lang string, source string, term binary, n long, docs long").select(*[F.col(c).cast("string") if c == "term" else c for c in names])


def kept_terms(docs: DataFrame, least: int = 3, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, term, total, sources, ns: the terms in at least ``least`` documents of a language, with the sources that hold them and how often."""
    parts = counts(docs, text, lang, source).repartition("lang", "term")
    own = parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # At most one entry a source; the shuffle by term serves both groupings.
    terms = own.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("held"))
    return terms.where(F.col("docs") >= least).select("lang", "term", "total", F.col("held.source").alias("sources"), F.col("held.n").alias("ns"))


def frequency(n: Column, size: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (size + terms))."""
    return F.call_function("div", (n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), (size + terms).cast("decimal(20,0)")) + 1


def frequencies(n: np.ndarray, size: np.ndarray, terms: int) -> np.ndarray:
    """The same of counts that belong to groups of the given sizes."""
    if n.max(initial=0) < 9 * 10**9:
        return 1 + (n + 1) * SCALE // np.maximum(1, size + terms)
    return np.array([1 + (a + 1) * SCALE // max(1, b + terms) for a, b in zip(n.tolist(), np.broadcast_to(size, n.shape).tolist(), strict=True)], np.int64)


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def dense(tile: np.ndarray, other: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Sums of f - z over the terms (rows) of two tiles, for each pair of their columns."""
    out = np.zeros((tile.shape[1], other.shape[1]), np.int64)
    step = max(1, CELLS // max(1, other.shape[1]))
    for at in range(0, len(tile), step):
        for s in range(tile.shape[1]):
            out[s] += apart(tile[at : at + step, s : s + 1], other[at : at + step]).sum(0)
    return out - len(tile) * z


def sparse(terms: int, a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray], base_a: np.ndarray, base_b: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Corrections to z from postings (term, source, p), sorted by term, of both sides."""
    out = np.zeros(z.shape, np.int64)
    for side, (_, source, p) in enumerate((a, b)):
        held, n = np.unique(np.stack([source, p]), axis=1, return_counts=True)
        step = max(1, CELLS // max(1, len(base_a) + len(base_b)))
        for at in range(0, held.shape[1], step):
            s, q, times = held[0, at : at + step], held[1, at : at + step], n[at : at + step, None]
            if side:
                np.add.at(out.T, s, (apart(base_a, q[:, None]) - z.T[s]) * times)
            else:
                np.add.at(out, s, (apart(q[:, None], base_b) - z[s]) * times)
    begins = np.searchsorted(b[0], np.arange(terms + 1))
    n = np.diff(begins)[a[0]]  # postings of the other side that share a posting's term
    at, ends = 0, np.cumsum(n)
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, "right")))
        own, many = np.arange(at, to), n[at:to]
        i = np.repeat(own, many)
        j = np.repeat(begins[a[0][own]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        s, t, p, q = a[1][i], b[1][j], a[2][i], b[2][j]
        np.add.at(out, (s, t), apart(p, q) - apart(p, base_b[t]) - apart(base_a[s], q) + z[s, t])
        at = to
    return out


def tile_sums(rows: pa.Table, groups: pa.Table, share: float) -> pa.Table:
    """lang, source, item, value: the sums of one tile of terms over the pairs of two blocks of sources.

    ``rows``: sources and ns of each term. ``groups``: source, block, size (all words), terms (V), sources (of the language),
    left and right (whether it belongs to the left, or right, block), first (whether the tile carries V z).
    """
    kind = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    if not len(groups):
        return kind.empty_table()
    col = lambda name: groups.column(name).to_numpy()
    v, in_all, size = int(col("terms")[0]), int(col("n_sources")[0]), col("size").astype(np.int64)
    left, right = np.flatnonzero(col("left")), np.flatnonzero(col("right"))
    base = frequencies(np.zeros(len(size), np.int64), size, v)
    z = apart(base[left][:, None], base[right])
    out = z * v if col("first")[0] else np.zeros_like(z)
    if len(rows):
        lists = rows.column("sources").combine_chunks()
        held = np.diff(lists.offsets.to_numpy())
        names = pc.index_in(lists.flatten(), groups.column("source").combine_chunks()).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        term, n = np.repeat(np.arange(len(held)), held), rows.column("ns").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        term, n, names = term[names >= 0], n[names >= 0], names[names >= 0]  # others belong to blocks that do not meet here
        p = frequencies(n, size[names], v)
        place_a, place_b = np.full(len(size), -1), np.full(len(size), -1)
        place_a[left], place_b[right] = np.arange(len(left)), np.arange(len(right))
        heavy = held > share * in_all
        step = max(1, 4 * CELLS // max(1, len(size)))
        for at in range(0, heavy.sum(), step):
            chosen = np.flatnonzero(heavy)[at : at + step]
            row = np.full(len(held), -1)
            row[chosen] = np.arange(len(chosen))
            own = row[term] >= 0
            tile = np.repeat(base[None, :], len(chosen), axis=0)
            tile[row[term[own]], names[own]] = p[own]
            out += dense(tile[:, left], tile[:, right], z)
        light = ~heavy[term]
        sides = [(term[o], place[names[o]], p[o]) for place in (place_a, place_b) for o in [light & (place[names] >= 0)]]
        out += sparse(len(held), *sides, base[left], base[right], z)
    source = groups.column("source").to_numpy()
    a, b = np.repeat(source[left], len(right)), np.tile(source[right], len(left))
    keep = a != b
    lang = pa.repeat(groups.column("lang")[0], int(keep.sum()))
    return pa.table([lang, pa.array(a[keep], pa.string()), pa.array(b[keep], pa.string()), pa.array(out.ravel()[keep], pa.int64())], schema=kind)


def group_sizes(docs: DataFrame, terms: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, size, held (terms it holds), terms (V), total, n_sources and number (from 0) of every group."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    groups = docs.select(blank(lang), blank(source)).toDF("lang", "source").distinct()
    sizes = terms.select("lang", F.explode(F.arrays_zip("sources", "ns")).alias("h")).groupBy("lang", F.col("h.sources").alias("source")).agg(F.sum("h.ns").alias("size"), F.count("*").alias("held"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    found = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *map(zero, ("size", "held", "terms", "total")))
    w = Window.partitionBy("lang")
    return found.withColumn("n_sources", F.count("*").over(w)).withColumn("number", F.row_number().over(w.orderBy("source")) - 1)


def pairs(terms: DataFrame, groups: DataFrame, share: float = 0.25, postings: int = POSTINGS, block: int = SOURCES) -> DataFrame:
    """lang, source, item, value: the distance of each source from every other one of its language."""
    last = lambda n: F.expr(f"sequence(0L, greatest(0L, {n} - 1))")
    langs = groups.groupBy("lang").agg(F.max("terms").alias("terms"), F.max("n_sources").alias("n_sources"), F.sum("held").alias("held"))
    langs = langs.withColumn("tiles", F.ceil(F.col("held") / postings)).withColumn("blocks", F.ceil(F.col("n_sources") / block))
    own = groups.withColumn("block", F.floor(F.col("number") / block))
    met = own.join(langs.select("lang", "tiles", "blocks"), "lang").withColumn("tile", F.explode(last("tiles"))).withColumn("other", F.explode(last("blocks")))
    met = met.select("*", F.explode(F.array_distinct(F.array(F.struct(F.col("block").alias("a"), F.col("other").alias("b")), F.struct(F.col("other").alias("a"), F.col("block").alias("b"))))).alias("m"))
    met = met.select("lang", "tile", F.col("m.a").alias("a"), F.col("m.b").alias("b"), "source", "size", "terms", "n_sources", (F.col("block") == F.col("m.a")).alias("left"), (F.col("block") == F.col("m.b")).alias("right"), (F.col("tile") == 0).alias("first"))
    tiled = join_by_size(terms, langs.where("terms > 0").select("lang", "terms", "tiles", "blocks"), ["lang"], "terms")
    tile = F.when(F.col("tiles") > 1, F.pmod(F.xxhash64("term"), F.greatest(F.lit(1), F.col("tiles")))).otherwise(0).cast("long")
    # With more than one block a term goes to each pair of blocks, where the others' postings are passed over.
    tiled = tiled.select("lang", tile.alias("tile"), "sources", "ns", F.explode(last("blocks")).alias("a"), "blocks").withColumn("b", F.explode(last("blocks"))).drop("blocks")

    def run(rows: pa.Table, own: pa.Table) -> pa.Table:
        return tile_sums(rows, own, share)

    by = ["lang", "tile", "a", "b"]
    sums = tiled.groupBy(*by).cogroup(met.groupBy(*by)).applyInArrow(run, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(20,0)")).cast("long").alias("value"))


def leading_terms(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: the terms that a source holds more often than its language, by how much."""
    postings = terms.select("lang", "term", "total", F.explode(F.arrays_zip("sources", "ns")).alias("h")).select("lang", "term", "total", F.col("h.sources").alias("source"), F.col("h.ns").alias("n"))
    sizes = groups.select("lang", "source", "size", "held", "terms", F.col("total").alias("words"))
    rows = join_by_size(postings, sizes.where("held > 0"), ["lang", "source"], "held")
    p, q = frequency(F.col("n"), F.col("size"), F.col("terms")), frequency(F.col("total"), F.col("words"), F.col("terms"))
    rows = rows.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    return rows.select("lang", "source", "item", F.expr("((p - q) * (p - q)) div q").alias("value"))


def audit(docs: DataFrame, least: int = 3, most_terms: int = 200, share: float = 0.25, text: str = "text", lang: str = "lang", source: str = "source", postings: int = POSTINGS, block: int = SOURCES) -> DataFrame:
    """lang, source, part (pair, term), item, value, rank: every other source by distance, and the leading terms up to ``most_terms``.

    Terms that more than ``share`` of a language's sources hold are laid out densely; the results do not depend on it.
    """
    terms = materialised(kept_terms(docs, least, text, lang, source))
    groups = materialised(group_sizes(docs, terms, lang, source))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(w).alias("rank"))
    return ranked(pairs(terms, groups, share, postings, block), "pair").unionByName(ranked(leading_terms(terms, groups), "term").where(F.col("rank") <= most_terms))


def oracle(least: int = 3, most_terms: int = 200) -> str:
    f = "((p - q) * (p - q)) // q"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents),
t AS MATERIALIZED (SELECT rid, lang, source, unnest(words) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= {least}),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(total) AS words FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(words, 0) AS words, coalesce((SELECT sum(n) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0) AS size FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN v USING (lang)),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (coalesce(c.n, 0) + 1)::HUGEINT * {SCALE} // (g.size + g.v)::HUGEINT AS p, 1 + (k.total + 1)::HUGEINT * {SCALE} // (g.words + g.v)::HUGEINT AS q
 FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum({f.replace("p", "a.p").replace("q", "b.p")}) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT x.lang, x.source, y.source AS item, coalesce(value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pair ON pair.lang = x.lang AND pair.source = x.source AND pair.item = y.source),
term AS (SELECT lang, source, term AS item, ({f})::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM every
UNION ALL SELECT lang, source, 'term', item, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM term) WHERE rank <= {most_terms}"""

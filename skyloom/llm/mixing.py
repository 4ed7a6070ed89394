"""Mixing sources to target weights with fixed-length token blocks, in native column expressions.

The documents of a source, laid end to end in the order of a digest of each row, are cut into blocks of
``BLOCK`` words. Each slot of an output shard draws its source by a pseudorandom number against the
cumulative shares, which makes the counts of each shard multinomial; no draw knows of another, so a
source's total strays from its target by about the square root of its number of blocks. The j-th slot of
a source takes the block that the source's pseudorandom permutation puts at j modulo its number of
blocks, in pass j divided by it. Blocks join slots by (source, index).

The permutation swaps an index with its mirror image about a random key, or not, in each of several
rounds: a bijection for any number of blocks. Random bits are squares modulo a prime, so that any
engine draws the same.

Defined results: a null text has size 0; null is a source of its own and comes last; a source of size 0
has target 0 and gives nothing; ids may have any type and size, may be null and may repeat; repeated rows
are documents each, laid side by side; an empty table gives an empty result; other columns are ignored.
A slot beyond pass ``MOST_PASSES`` is dropped, so no document gives more than that many times its size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import materialised, running, unique_names, words

BLOCK = 32
SHARD = 1024
WEIGHTS = (1, 2, 3)
MOST_PASSES = 3
#: Documents of a source are laid end to end bucket by bucket; about so many rows share a bucket.
BUCKET_ROWS = 20_000
#: Shards whose counts are summed together before sums run over a source's shards.
SHARD_GROUP = 1024
PRIME = 2147483647
ROWS_A_TASK = 50_000
#: Rows of the table of shares that are broadcast at most (some 40 bytes each).
SHARES = 500_000
#: Round keys of the permutation and of the draws.
ROUND_KEYS = (1640531527, 97654321, 1299709, 715225739, 433494437, 217645177, 1073676287, 32452843)
DRAW_KEYS = (1500450271, 982451653)


def _square(x: Column, key: int) -> Column:
    """(x mod p)^2 + key, mod p; squares of residues below 2^31 fit a long."""
    r = x % PRIME
    return (r * r + F.lit(key).cast("long")) % PRIME


def permuted(index: Column, size: Column, source: Column, keys: tuple[int, ...] = ROUND_KEYS) -> Column:
    """Where the permutation of 0 .. size - 1 that belongs to a source's number puts ``index``.

    A fold binds each round's value; as nested expressions the rounds would double in size each time.
    """

    def one_round(x: Column, key: Column) -> Column:
        mirror = ((key * (source + 1)) % PRIME - x + size) % size
        top = F.greatest(x, mirror) % PRIME
        mixed = (top * top + key) % PRIME
        return F.when((mixed * mixed + source) % PRIME % 2 == 1, mirror).otherwise(x)

    return F.aggregate(F.array(*[F.lit(k).cast("long") for k in keys]), index.cast("long"), one_round)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size and twin (a digest of those and the text) of each row, written down once."""
    cols = [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source")]
    return materialised(docs.select(*cols, F.size(words(F.col(text_col))).cast("long").alias("size"), _twin(id_col, text_col, source_col).alias("twin")))


def _twin(id_col: str, text_col: str, source_col: str) -> Column:
    told = lambda c: F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n"))
    return F.md5(F.concat_ws("|", told(id_col), told(source_col), F.coalesce(F.col(text_col), F.lit(""))))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """source, source_size, number (from 0 by code point, null last), target, of a table (source, size).

    The sources share all sizes by weight; those whose share is above ``most`` times their size stop
    there and the rest is shared anew. Ordered by that ratio, the capped sources come first, and a
    running sum tells where sharing stops. Sources may be many: sums run over ranges of them.
    """
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = running(rows, [F.asc_nulls_last("source")], {"number": F.lit(1).cast("long")})
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod("number", F.lit(len(weights))) + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    rows = materialised(running(rows, [F.asc("ratio"), F.asc("number")], {"caps": F.col("cap"), "weights": F.col("weight").cast("long")}))
    size, weight = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    rest, rest_weight = F.lit(size) - F.col("caps"), F.lit(weight) - F.col("weights")
    # The first source whose share of what is left stays within its cap ends the capping.
    stop = F.struct("ratio", "number", (rest / rest_weight).alias("level"))
    level = rows.agg(F.min(F.when(rest * F.col("weight") <= F.col("cap") * rest_weight, stop)).alias("stop")).select("stop.level").first()[0]
    rows = rows.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level).cast("double")))
    return rows.select("source", "source_size", "number", "target")


def laid_out(rows: DataFrame) -> DataFrame:
    """The rows of ``sized`` with ``start``, their first word's place in their source.

    Equal rows are counted first and lie side by side. Sums run within buckets of bounded size, by the
    digest, then over a source's bucket totals.
    """
    rows = materialised(rows.groupBy("source", "doc_id", "size", "twin").agg(F.count("*").alias("copies")))
    buckets = max(64, rows.count() // BUCKET_ROWS)
    rows = rows.withColumn("bucket", F.conv(F.substring("twin", 1, 8), 16, 10).cast("long") % buckets)
    inside = Window.partitionBy("source", "bucket").orderBy("twin", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    words_of = F.col("size") * F.col("copies")
    totals = rows.groupBy("source", "bucket").agg(F.sum(words_of).alias("total"))
    totals = totals.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("total").over(across), F.lit(0)).alias("before"))
    rows = rows.withColumn("inside", F.coalesce(F.sum(words_of).over(inside), F.lit(0)))
    joined = rows.join(totals, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    laid = materialised(joined.withColumn("start", F.col("before") + F.col("inside")).drop("s", "b", "before", "inside", "bucket"))
    # Many copies of one row are made in several tasks, a run of them in each.
    runs = laid.where("copies > 1").withColumn("run", F.explode(F.expr(f"sequence(0L, (copies - 1) div {ROWS_A_TASK})"))).repartition("twin", "run")
    more = runs.withColumn("copy", F.explode(F.expr(f"sequence(run * {ROWS_A_TASK}, least(copies, (run + 1) * {ROWS_A_TASK}) - 1)")))
    return laid.where("copies = 1").drop("copies").unionByName(more.withColumn("start", F.col("start") + F.col("copy") * F.col("size")).drop("copies", "run", "copy"))


def _tasks(rows: int) -> int:
    """Tasks for a step that makes ``rows`` rows of few: the few would else be gathered into one task."""
    return max(8, min(100_000, rows // ROWS_A_TASK))


def shard_counts(sources: DataFrame, block: int = BLOCK, shard: int = SHARD) -> tuple[DataFrame, int]:
    """(shard, number, n_blocks, count of slots) of each shard and source that it drew, and the number of all slots.

    Each slot draws a number below ``PRIME``; the source is the one whose range of cumulative shares holds
    it. Ranges are cut at the borders of even cells, so that a slot meets its cell's few ranges by equality.
    """
    able = sources.where("source_size > 0").withColumn("n_blocks", F.ceil(F.col("source_size") / block).cast("long"))
    able = materialised(running(able.withColumn("share", F.col("target") * F.col("n_blocks") / F.col("source_size")), [F.asc("number")], {"before": F.col("share")}))
    n_sources, total = able.agg(F.count("*"), F.max(F.col("before") + F.col("share"))).first()
    n, total = round(total or 0.0), total or 1.0
    point = lambda x: F.floor(x / F.lit(total) * PRIME).cast("long")
    cells = max(1024, 2 * n_sources)
    cell = lambda x: F.expr(f"{x} * {cells} div {PRIME}L")
    ranges = able.select("number", "n_blocks", point(F.col("before")).alias("low"), point(F.col("before") + F.col("share")).alias("high")).where("high > low")
    ranges = ranges.withColumn("cell", F.explode(F.sequence(cell("low"), cell("(high - 1)"))))
    slots = sources.sparkSession.range(0, -(-n // shard), 1, _tasks(n)).withColumnRenamed("id", "shard")
    slots = slots.select("shard", F.explode(F.expr(f"sequence(shard * {shard}, least({n}L, (shard + 1) * {shard}) - 1)")).alias("slot"))
    slots = slots.select("shard", reduce(_square, DRAW_KEYS, F.col("slot") * 48271 + 11).alias("drawn")).select("shard", "drawn", cell("drawn").alias("cell"))
    ranges = F.broadcast(ranges) if cells + n_sources <= SHARES else ranges.hint("merge")
    drawn = slots.join(ranges, "cell").where("drawn >= low AND drawn < high")
    return drawn.groupBy("shard", "number", "n_blocks").agg(F.count("*").alias("count")), n


def slots(sources: DataFrame, block: int = BLOCK, shard: int = SHARD, most: int = MOST_PASSES) -> DataFrame:
    """shard, number, pass, index: the block that each output slot takes. ``sources`` is a table of ``targets``.

    A source's slots are numbered through its shards: sums run within groups of shards, then over the groups.
    """
    counts, n = shard_counts(sources, block, shard)
    counts = materialised(counts.withColumn("group", F.expr(f"shard div {SHARD_GROUP}")))
    inside = Window.partitionBy("number", "group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("number").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = counts.groupBy("number", "group").agg(F.sum("count").alias("all"))
    groups = groups.select("number", "group", F.coalesce(F.sum("all").over(across), F.lit(0)).alias("before"))
    rows = counts.withColumn("inside", F.coalesce(F.sum("count").over(inside), F.lit(0))).join(groups, ["number", "group"])
    rows = rows.select("shard", "number", "n_blocks", "count", (F.col("before") + F.col("inside")).alias("first")).repartition(_tasks(n), "number", "shard")
    rows = rows.withColumn("j", F.explode(F.expr("sequence(first, first + count - 1)")))
    rows = rows.withColumn("pass", F.expr("CAST(j div n_blocks AS INT)")).where(F.col("pass") < most)
    return rows.select("shard", "number", "pass", permuted(F.col("j") % F.col("n_blocks"), F.col("n_blocks"), F.col("number")).alias("index"))


def pieces(laid: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """number, index, start, doc_id, twin, size, from, len: the words of each document in each block of its source."""
    rows = laid.join(sources.select(F.col("source").alias("s"), "number"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    rows = rows.where("size > 0").repartition(_tasks(total // block), "number", "start")
    rows = rows.withColumn("index", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    low = F.greatest(F.col("index") * block, F.col("start"))
    high = F.least((F.col("index") + 1) * block, F.col("start") + F.col("size"))
    return rows.select("number", "index", "start", "doc_id", "twin", "size", (low - F.col("start")).alias("from"), (high - low).alias("len"))


def mixed_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """id, size, source_size, target (of its source) and taken (words that the mix takes) of each row."""
    rows = sized(docs, id_col, text_col, source_col)
    sources = materialised(targets(rows.select("source", "size"), weights))
    laid = materialised(laid_out(rows))
    times = slots(sources).groupBy("number", "index").agg(F.count("*").alias("times"))
    # Generated rows are many more than planning expects: without the hint it would broadcast them.
    taken = pieces(laid, sources).join(times.hint("merge"), ["number", "index"]).groupBy("number", "start").agg(F.sum(F.col("len") * F.col("times")).alias("taken"))
    out = laid.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    # An empty row shares its start with the next one, and gives nothing.
    taken = taken.select(F.col("number").alias("n"), F.col("start").alias("at"), "taken")
    out = out.join(taken, (F.col("number") == F.col("n")) & (F.col("start") == F.col("at")) & (F.col("size") > 0), "left")
    return out.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix as documents: for each row and pass that give words one row with the columns of ``docs``.

    A pass that takes all of a text leaves it as it is; else the words taken stay in their order, parted
    by single spaces. A column ``n_chars``, if there is one, is set anew.
    """
    rows = sized(docs, id_col, text_col, source_col)
    sources = materialised(targets(rows.select("source", "size"), weights))
    laid = laid_out(rows)
    # Generated rows are many more than planning expects: without the hints it would broadcast them.
    ranges = pieces(laid, sources).join(slots(sources).select("number", "index", "pass").hint("merge"), ["number", "index"])
    ranges = ranges.groupBy("twin", "number", "start", "pass", "size").agg(F.sort_array(F.collect_list(F.struct("from", "len"))).alias("ranges"), F.sum("len").alias("n"))
    twin, n_chars, helper, n, size = unique_names(docs, ["twin", "n_chars", "ranges", "n", "size"])
    ranges = ranges.select(F.col("twin").alias(twin), F.col("ranges").alias(helper), F.col("n").alias(n), F.col("size").alias(size))
    # Rows that are twins in id, source and text have ranges of their own; one of them stands for all.
    whole = docs.withColumn(twin, _twin(id_col, text_col, source_col)).dropDuplicates([twin])
    found = whole.join(ranges.hint("merge"), twin)
    # The outer transform binds the words, so that a text is split once and not for each range.
    taken = F.transform(F.array(words(F.col(text_col))), lambda w: F.array_join(F.flatten(F.transform(helper, lambda r: F.slice(w, (r["from"] + 1).cast("int"), r["len"].cast("int")))), " "))
    text = F.when(F.col(n) == F.col(size), F.col(text_col)).otherwise(F.get(taken, F.lit(0)))
    found = found.withColumn(text_col, text)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def oracle(block: int = BLOCK, shard: int = SHARD, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> str:
    p = PRIME
    square = lambda x, k: f"((({x}) % {p}) * (({x}) % {p}) + {k}) % {p}"
    rounds = []
    for i, k in enumerate(ROUND_KEYS):
        x = f"x{i}"
        rounds.append(f"""r{i} AS (SELECT * EXCLUDE ({x}, m, z), CASE WHEN ((z * z + number) % {p}) % 2 = 1 THEN m ELSE {x} END AS x{i + 1} FROM (
  SELECT *, ((greatest({x}, m) % {p}) * (greatest({x}, m) % {p}) + {k}) % {p} AS z FROM (
    SELECT *, (({k} * (number + 1)) % {p} - {x} + n_blocks) % n_blocks AS m FROM {f"r{i - 1}" if i else "j0"})))""")
    chosen = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    told = lambda c: f"coalesce('v' || {c}, 'n')"
    return rf"""
WITH d AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
        md5({told("doc_id")} || '|' || {told("source")} || '|' || coalesce(text, '')) AS twin FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST)::BIGINT - 1 AS number FROM d GROUP BY source),
w AS (SELECT *, CASE number % {len(weights)} {chosen} END AS weight, source_size * {most} AS cap FROM s),
v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
        (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest_weight FROM w),
l AS (SELECT rest / rest_weight AS level FROM v WHERE rest * weight <= cap * rest_weight ORDER BY cap / weight, number LIMIT 1),
t AS (SELECT source, source_size, number, least(cap::DOUBLE, weight * level) AS target FROM v, l),
a AS (SELECT *, (ceil(source_size / {block}))::BIGINT AS n_blocks FROM t WHERE source_size > 0),
u AS (SELECT *, target * n_blocks / source_size AS share, coalesce(sum(target * n_blocks / source_size) OVER (ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a),
g AS (SELECT max(before + share) AS total, round_even(max(before + share), 0)::BIGINT AS n FROM u),
c AS (SELECT number, n_blocks, floor(before / total * {p})::BIGINT AS low, floor((before + share) / total * {p})::BIGINT AS high FROM u, g),
q AS (SELECT slot // {shard} AS shard, {square(square("slot * 48271 + 11", DRAW_KEYS[0]), DRAW_KEYS[1])} AS drawn FROM (SELECT unnest(range(n)) AS slot FROM g)),
h AS (SELECT shard, number, n_blocks, count(*) AS n FROM q JOIN c ON drawn >= low AND drawn < high GROUP BY ALL),
f AS (SELECT *, (sum(n) OVER (PARTITION BY number ORDER BY shard ROWS UNBOUNDED PRECEDING) - n)::BIGINT AS first FROM h),
j AS (SELECT number, n_blocks, first + unnest(range(n)) AS j FROM f),
j0 AS (SELECT number, n_blocks, j % n_blocks AS x0 FROM j WHERE j // n_blocks < {most}),
{", ".join(rounds)},
times AS (SELECT number, x{len(ROUND_KEYS)} AS idx, count(*) AS times FROM r{len(ROUND_KEYS) - 1} GROUP BY ALL),
dd AS (SELECT doc_id, source, size, twin, count(*) AS copies FROM d GROUP BY ALL),
k AS (SELECT *, ('0x' || substr(twin, 1, 8))::BIGINT % nb AS bucket FROM dd, (SELECT greatest(64, count(*) // {BUCKET_ROWS}) AS nb FROM dd)),
o1 AS (SELECT doc_id, number, source_size, target, size, copies,
        (sum(size * copies) OVER (PARTITION BY number ORDER BY bucket, twin, doc_id, size ROWS UNBOUNDED PRECEDING) - size * copies)::BIGINT AS start
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
o2 AS (SELECT * EXCLUDE (start, copies), start + size * unnest(range(copies)) AS start FROM o1),
o AS (SELECT *, row_number() OVER () AS rid FROM o2),
y AS (SELECT rid, start, size, number, unnest(range(start // {block}, (start + size - 1) // {block} + 1)) AS idx FROM o WHERE size > 0),
z AS (SELECT rid, sum((least((idx + 1) * {block}, start + size) - greatest(idx * {block}, start)) * times)::BIGINT AS taken FROM y JOIN times USING (number, idx) GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM o LEFT JOIN z USING (rid)"""

"""Quality rules: a threshold table compiled into one projection of native column expressions.

``text_counts`` computes, per row and without any shuffle or user function, the counts that the rules
are about; ``RULES`` is the threshold table; ``verdict`` compiles it into a boolean column. Ratios are
compared as integer products, so every engine decides them alike.

Defined results: a null text counts as an empty one; an empty text has zero for every count and fails
the base rule; rows with the same id are judged separately; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import words

SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it for as was with be by on are this or an at from which not "
    "le la les de des du et en un une que qui dans pour par sur est au ce il pas ne avec "
    "der die das und ist von mit den dem ein eine zu auf nicht im sich für als auch es "
    "el los las del y a se por con para una lo como más su al no o"
).split()


@dataclass(frozen=True)
class Rule:
    """scale * numerator must be at least (at most) bound * denominator."""

    name: str
    numerator: str
    denominator: str
    at_least: bool
    bound: int
    scale: int = 1000


#: The threshold table. Ratios in thousandths.
RULES = (
    Rule("mean word not short", "word_chars", "n_words", True, 2000),
    Rule("mean word not long", "word_chars", "n_words", False, 15000),
    Rule("symbols per word", "n_symbols", "n_words", False, 100),
    Rule("stop words per word", "n_stop_words", "n_words", True, 60),
    Rule("repeated lines per line", "n_dup_lines", "n_lines", False, 500),
)


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop_words, n_upper, n_repeat_words.

    Repeated three-word windows are found by sorting the windows of a row next to their equals, so the
    work per text is n log n and nothing leaves the row.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    base = base.select("id", "t", words(F.col("t")).alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"))
    n = F.size("w")
    windows = F.when(
        n >= 4,
        F.sort_array(F.arrays_zip(F.slice("w", 1, n - 2).alias("a"), F.slice("w", 2, n - 2).alias("b"), F.slice("w", 3, n - 2).alias("c"), F.sequence(F.lit(0), n - 3).alias("i"))),
    )
    base = base.select(
        "id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("w", lambda x: x.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.length(F.regexp_replace("t", "[^A-Z]+", "")).cast("long").alias("n_upper"),
        windows.alias("s"),
    )
    m = F.size("s")
    same = lambda a, b: (a["a"] == b["a"]) & (a["b"] == b["b"]) & (a["c"] == b["c"])
    pairs = F.zip_with(F.slice("s", 1, m - 1), F.slice("s", 2, m - 1), lambda a, b: F.when(same(a, b), F.array(a["i"], b["i"])))
    at = F.when(m > 1, F.flatten(F.filter(pairs, lambda p: p.isNotNull())))
    base = base.select(*[c for c in base.columns if c != "s"], at.alias("p"))
    shifted = lambda k: F.transform("p", lambda x: x + k)
    covered = F.when(F.size("p") > 0, F.size(F.array_union(F.array_union("p", shifted(1)), shifted(2)))).otherwise(0)
    counts = F.struct(*[c for c in base.columns if c not in ("p", "id")], covered.cast("long").alias("n_repeat_words"))
    # A generator of one row: filters on the counts stay above it, so they never compute them once more.
    return base.select(F.col("id").alias(id_col), F.inline(F.array(counts)))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean expression over the columns of ``text_counts``."""
    tests = []
    for r in rules:
        left, right = F.lit(r.scale) * F.col(r.numerator), F.lit(r.bound) * F.col(r.denominator)
        tests.append(left >= right if r.at_least else left <= right)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` for each row of ``docs``."""
    counts = text_counts(docs, id_col, text_col)
    return counts.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words",
        base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"),
    )


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The same result in SQL, over the table ``documents``."""
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    tests = " AND ".join(f"{r.scale} * {r.numerator} {'>=' if r.at_least else '<='} {r.bound} * {r.denominator}" for r in rules)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t,
        list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
tri AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM tri) WHERE c >= 2),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
c AS (SELECT doc_id, len(ws)::BIGINT AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
        len(ls)::BIGINT AS n_lines, len(list_filter(ws, lambda x: x IN ({stop})))::BIGINT AS n_stop_words
      FROM w LEFT JOIN cov USING (rid)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM c)
SELECT *, (NOT base_failed AND {tests}) AS kept FROM b"""

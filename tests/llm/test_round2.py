"""Whole queries against brute force, and the cases that data of other shapes bring."""

import hashlib
import random
import time
from collections import Counter
from math import exp, log

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyloom.llm import common, langid, mixing, pii, quality_rank, quality_rules, queries, simhash, toxicity, vafile


def texts_of(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def test_samples_are_bounded_and_fair_when_ids_repeat_or_lack(spark):
    three = spark.range(200_000).select((F.col("id") % 3).alias("id"), F.lit("same").alias("text"))
    assert sorted(r.id for r in common.bounded_sample(three, ["id", "text"], 1000).collect()) == [0, 1, 2]
    own = spark.range(60_000).select(F.lit(None).cast("long").alias("id"), F.col("id").cast("string").alias("text"))
    for most in (500, 20_000, 59_000):
        found = [r.text for r in common.bounded_sample(own, ["id", "text"], most).collect()]
        assert len(found) == len(set(found)) == most
    assert sorted(map(tuple, common.bounded_sample(own, ["id", "text"], 500).collect())) == sorted(map(tuple, common.bounded_sample(own.repartition(7), ["id", "text"], 500).collect()))
    assert common.bounded_sample(own.limit(0), ["id", "text"], 10).count() == 0


def test_running_sums_over_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 5).alias("v"))
    found = common.running(rows, [F.asc("k")], {"before": F.col("v"), "n": F.lit(1).cast("long")}).toPandas().sort_values("k")
    assert (found["n"] == found["k"]).all() and (found["before"] == found["v"].cumsum() - found["v"]).all()


def test_hot_keys_join_like_others(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("x"))
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("x").alias("m"))
    found, plain = common.join_by_size(rows, table, ["k"], "n", hot=100), rows.join(table, "k")
    assert sorted(map(tuple, found.select("k", "x", "n", "m").collect())) == sorted(map(tuple, plain.select("k", "x", "n", "m").collect()))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_mixing_takes_ids_of_any_kind_and_any_number_of_sources(kind, spark):
    ids = [10**18, None, 7, 7, 10**16] if kind == "long" else ["abc", None, "", "7", "7"]
    rows = [(i, "w " * (40 + k), None if k == 3 else f"s{k % 2}") for k, i in enumerate(ids)] * 30 + [(ids[2], None, "none")]
    frame = spark.createDataFrame(rows, f"doc_id {kind}, text string, source string")
    found = mixing.mixed_sizes(frame).toPandas()
    assert len(found) == len(rows) and (found["taken"] <= 3 * found["size"]).all() and (found["taken"] >= 0).all()
    assert found["taken"].sum() > 0 and mixing.mixed_texts(frame).columns == frame.columns
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x "), 64).alias("text"), F.concat(F.lit("site"), "id").alias("source"))
    assert mixing.mixed_sizes(many).agg(F.count("*").alias("n"), F.max(F.col("taken") / F.col("size")).alias("r")).first()[0:1] == (3000,)


def test_each_shard_draws_multinomial_counts(spark):
    sizes = spark.createDataFrame([("a", 3_000_000), ("b", 3_000_000), ("c", 3_000_000)], "source string, size long")
    counts, n = mixing.shard_counts(mixing.targets(sizes), shard=256)
    counts = counts.toPandas()
    whole = counts[counts["shard"] < n // 256]
    shares = {0: 1 / 6, 1: 2 / 6, 2: 3 / 6}
    for number, p in shares.items():
        own = whole[whole["number"] == number]["count"]
        sd = (256 * p * (1 - p)) ** 0.5
        assert abs(own.mean() - 256 * p) < 5 * sd / len(own) ** 0.5 and 0.85 < own.std() / sd < 1.15
    assert whole.groupby("shard")["count"].sum().eq(256).all()


def test_large_components_repeated_queries_and_empty_vectors(spark):
    kind = "vec_id long, embedding array<double>"
    found = vafile.top_k(spark.createDataFrame([(100, [1.0, 2.0]), (1, [200000.0, 1.0]), (2, [1.0, 1.0]), (3, [1e20, -1e20]), (4, [float("inf"), 1.0])], kind)).orderBy("rank").collect()
    # (1e20 - 2e20) * 2^20 lies below the range of a long.
    assert [(r.vec_id, r.score) for r in found] == [(1, 1024 * 1024 * 200002), (2, 1024 * 1024 * 3), (3, -(2**63))]
    twice = vafile.top_k(spark.createDataFrame([(100, [1.0]), (100, [-1.0])] + [(i, [float(i)]) for i in range(1, 13)], kind)).toPandas()
    assert twice["rank"].tolist().count(1) == 2 and len(twice) == 20
    assert sorted(twice[twice["rank"] == 1]["vec_id"]) == [1, 12] and not (twice["vec_id"] == 100).any()
    assert [(r.vec_id, r.score) for r in vafile.top_k(spark.createDataFrame([(100, []), (5, [])], kind)).collect()] == [(5, 0)]
    assert vafile.top_k(spark.createDataFrame([], kind)).count() == 0
    clash = spark.createDataFrame([(100, [1.0], 1, 2, "x"), (1, [2.0], 1, 2, "x")], kind + ", row long, g long, h string")
    assert vafile.top_k(clash).count() == 1


@pytest.mark.parametrize("group_bytes", [1, 64 << 20])
def test_every_group_of_vectors_meets_every_group_of_queries(group_bytes, spark, monkeypatch):
    monkeypatch.setattr(vafile, "BLOCK", 32)
    monkeypatch.setattr(vafile, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 5)).round(1)
    rows = spark.createDataFrame([(i, [float(v) for v in own]) for i, own in enumerate(x)], "vec_id long, embedding array<double>")
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in vafile.top_k(rows, every=20, group_bytes=group_bytes).collect()}
    whole = np.floor(1024 * x).astype(np.int64)
    for q in range(0, 600, 20):
        best = sorted((-int(s), i) for i, s in enumerate(whole @ whole[q]) if i != q)[:10]
        assert [found[q, k + 1] for k in range(10)] == [(i, -s) for s, i in best]


def test_few_exact_vectors_are_read():
    rng = np.random.default_rng(9)
    x = np.floor(1024 * rng.normal(size=(4096, 16)) / 4)
    block = lambda ids: type("B", (), vafile.pack(ids, ids, x[ids]))
    best = vafile.Best(block(np.arange(0, 4096, 64)), 10)
    for part in np.arange(4096).reshape(4, 1024):
        own = block(part)
        best.scan(own, np.frombuffer(own.cells, np.uint8).reshape(-1, 16).astype(float))
    assert best.read < 0.02 * 4096 * 64


def test_segments_of_a_million_scores_in_linear_time():
    began = time.perf_counter()
    assert len(toxicity.segments([1.0, -2.0] * 500_000)) == 500_000
    assert len(toxicity.segments([2.0, -1.0] * 500_000)) == 1
    rng = random.Random(3)
    toxicity.segments([rng.uniform(-1, 1) for _ in range(1_000_000)])
    assert time.perf_counter() - began < 30


def test_toxicity_scores_by_hand(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for i, text in texts_of(spark, sf_dir).items():
        values = [model.scores.get(t, model.other) for t in toxicity.tokens(text)]
        if len(values) > 400:
            continue
        sums = np.concatenate([[0.0], np.cumsum(values)])
        best = max((sums[b] - sums[a] for a in range(len(values)) for b in range(a + 1, len(values) + 1)), default=0.0)
        own = [model.surprise(s, len(values)) for s, _, _ in toxicity.segments(values)]
        assert abs(max((s for s, _, _ in toxicity.segments(values)), default=0.0) - max(best, 0.0)) < 1e-9
        sure = log(1 + max(own) + sum(x - model.significant for x in sorted(own)[:-1] if x > model.significant)) if own else 0.0
        assert abs(found[i] - 1 / (1 + exp(-model.slope * sure - model.intercept))) < 1e-9


def test_training_texts_are_one_of_each_class_of_near_duplicates(spark, sf_dir):
    texts = sorted(texts_of(spark, sf_dir).items())
    rows = [(i, t, i % 2) for i, t in texts if t is not None] + [(i + 10**6, f"{t} ", i % 2) for i, t in texts[:40] if t is not None]
    frame = spark.createDataFrame(rows, "id long, text string, toxic int")
    of = {r.id: r.component_id for r in simhash.near_duplicates(frame, "id", "text").collect()}
    least = {}
    for i, text, toxic in sorted(rows):
        least.setdefault((of[i], toxic), (text, toxic))
    found = sorted(tuple(r) for r in toxicity.one_a_class(common.materialised(frame)).collect())
    assert found == sorted(least.values()) and len(found) < len(rows)
    assert toxicity.one_a_class(common.materialised(frame.limit(0))).count() == 0


def test_token_counts_are_those_of_the_scan(spark):
    rows = spark.createDataFrame([("Ünï ÜNÏ x_y ٣ İstanbul ß", 1), ("x y", 0), ("x", 0)] * 20, "text string, toxic int")
    table = toxicity.token_table(rows)
    found = Counter(t for text, _ in [("Ünï ÜNÏ x_y ٣ İstanbul ß", 1), ("x y", 0), ("x", 0)] for t in set(toxicity.tokens(text)))
    assert all(n == 20 * found[t] for t, n in zip(table["token"], table["n"], strict=True)) and table.attrs["n"] == 20 * sum(found.values())


def test_ranking_scores_by_hand(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality_rank.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = {r.doc_id: r.score for r in quality_rank.score(docs, model).collect()}
    stop = set(quality_rules.STOP_WORDS)
    for i, text in texts_of(spark, sf_dir).items():
        text = text or ""
        ws = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
        lines = [x for x in text.split("\n") if x.strip(common.BLANKS)]
        at = Counter(zip(ws, ws[1:], ws[2:], strict=False))
        cover = {k + d for k, g in enumerate(zip(ws, ws[1:], ws[2:], strict=False)) if at[g] > 1 for d in range(3)}
        n, chars, upper, stops = max(1, len(ws)), sum(map(len, ws)), sum("A" <= c <= "Z" for c in text), sum(w in stop for w in ws)
        mean, ratio = chars / n, lambda a, b: min((a / b) ** 0.5, 3.0)
        x = {
            "length": min(np.log1p(len(ws)) / 4, 3), "short": max(0, 1 - len(ws) / 50), "long_words": min(max(mean - 6, 0) / 4, 3), "short_words": min(max(4 - mean, 0), 3),
            "symbols": ratio(sum(c in quality_rules.SYMBOLS for c in text), n), "stop_words": ratio(stops, n), "no_stop_words": max(0, 1 - stops / n / 0.08),
            "upper": ratio(upper, max(chars, 1)), "mostly_upper": max(0, upper / max(chars, 1) - 0.3), "dup_lines": ratio(len(lines) - len(set(lines)), max(1, len(lines))),
            "repeats": ratio(len(cover), n), "mostly_repeats": max(0, len(cover) / n - 0.3),
        }
        strength = sum(w * x[k] for k, w in model.weights.items())
        assert abs(found[i] - 1 / (1 + exp(-(model.slope * (strength - model.cut) + log(0.3 / 0.7))))) < 1e-6


def test_languages_by_a_plain_softmax(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(docs, labelled=~langid.held_out())
    found = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    for i, text in texts_of(spark, sf_dir).items():
        if not text or not any(map(str.isalpha, text)):
            assert found[i].lang_pred == "und" and found[i].score == 0
            continue
        kept = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else "\0" for c in text)
        kept = "\0" + "\0".join(p for p in kept.split("\0") if p) + "\0" if kept.strip("\0") else "\0"
        rows = []
        for order in langid.ORDERS:
            for at in range(len(kept) - order + 1):
                h = order * 40503
                for c in kept[at : at + order]:
                    h = ((h ^ ord(c)) * 0x9E3779B1) & 0xFFFFFFFF
                rows.append(h >> 18)
        x = (model.scores[rows].mean(0) + model.bias) / model.temperature
        p = np.exp(x - x.max()) / np.exp(x - x.max()).sum()
        assert found[i].lang_pred == model.languages[int(p.argmax())] and abs(found[i].score - p.max()) < 1e-6


def test_near_duplicate_query_against_all_pairs(spark, sf_dir):
    from xxhash import xxh64_intdigest

    prints = {}
    for i, text in texts_of(spark, sf_dir).items():
        found = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
        own = [b" ".join(found[k : k + 3]) for k in range(max(1, len(found) - 2))] if found else []
        hashes = [xxh64_intdigest(s, 42) for s in own]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {i: i for i in prints}
    moved = True
    while moved:
        moved = False
        for i in prints:
            for j in prints:
                if root[j] < root[i] and (prints[i] ^ prints[j]).bit_count() <= 2:
                    root[i], moved = root[j], True
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.queries()["op8_simhash"](spark, sf_dir).collect()}
    assert found == {i: (f"{prints[i]:016x}", root[i]) for i in prints}


def test_only_crowded_paths_are_refined(spark):
    rng = random.Random(11)
    centre = rng.getrandbits(63)
    values = {centre ^ sum(1 << b for b in rng.sample(range(20), rng.randrange(6))) for _ in range(400)} | {rng.getrandbits(63) for _ in range(300)}
    found = {tuple(sorted(r)) for r in simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), 2, group=30).collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in found)


@pytest.fixture(scope="module")
def trained(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_a_trained_field_finds_planted_mentions_and_little_else(spark, trained):
    planted = hits = extra = 0
    for text in texts_of(spark, "/root/testdata/sf0.1").values():
        base = pii.base_spans(text or "")
        for kind, a, b in base[:1]:
            own = text[a:b]
            bare = "".join(c for c in own if c.isdigit()) if kind in ("card", "phone") else own.partition("@")[0] + "@" if kind == "email" else None
            if bare is None or len(bare) < 7 and kind != "email":
                continue
            whole = f"{text} {'and so on ' * 30}as said {'12 ' * (kind == 'card')}{bare} again."
            at = whole.rindex(bare)
            if any(x < at + len(bare) and y > at for _, x, y in pii.base_spans(whole)):
                continue
            planted += 1
            more = pii.further_spans(whole, pii.base_spans(whole), trained)
            hits += (kind, at, at + len(bare)) in more
            extra += sum(s[1] < len(text) for s in more)
    print(f"planted {planted}, found {hits}, further {extra}")
    assert planted >= 100 and hits >= 0.9 * planted and extra <= 0.05 * hits


def test_marginals_of_a_trained_field_on_a_tree(trained):
    text = "see +1 (171) 555-2028 or 4952935900253052 x 77 and later on, much later: 1715552028"
    tokens = [t for t in pii.candidates(text, [])]
    chain, skip = pii.edges(tokens)
    local = np.array([trained.unary[pii.features(t, text[t.start - 1 : t.start] or " ")].sum(0) for t in tokens])
    total = np.zeros((len(tokens), 5))
    for states in np.ndindex(*[5] * len(tokens)):
        w = np.exp(sum(local[i, s] for i, s in enumerate(states)) + sum(trained.chain[states[i], states[j]] for i, j in chain) + sum(trained.skip * (states[i] == states[j]) for i, j in skip))
        for i, s in enumerate(states):
            total[i, s] += w
    assert np.allclose(pii.beliefs(text, tokens, trained), total / total.sum(1, keepdims=True), atol=5e-3)


def test_training_climbs_the_pseudo_likelihood(trained):
    rng = np.random.default_rng(1)
    lessons = [([[0, 1 + int(k)], [0, 1 + int(k)]], [int(k), int(k)], [], [(0, 1)]) for k in rng.integers(0, 5, 200)] + [([[0, 1 + int(k)]], [0], [], []) for k in rng.integers(0, 5, 200)]
    model = pii.train(lessons)
    assert model.skip > 1 and model.unary.shape == (pii.FEATURES, 5)


def test_base_spans_of_the_query_by_plain_patterns(spark, sf_dir):
    from test_llm import plain_base

    order = {k: i for i, k in enumerate(pii.KINDS)}
    found = {r.doc_id: r for r in queries.queries()["op2_pii"](spark, sf_dir).collect()}
    for i, text in texts_of(spark, sf_dir).items():
        spans = sorted(plain_base(text or ""), key=lambda s: (order[s[0]], s[1]))
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert found[i].base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [found[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]


def test_pipeline_stages_on_awkward_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as p

    rows = [(1, None, "en", "a", 0, 9), (2, "", "en", None, 0, 9), (3, "the cat " * 30, None, "a", 240, 9), (3, "the cat " * 30, None, "a", 240, 9), (None, "a dog ran over the hill " * 9, "en", "b", 1, 9)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, twin int"
    for name, own in (("some", rows), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame(own, kind).write.parquet(str(folder / "documents.parquet"))
        found = p.run(spark, str(folder))
        assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(found.columns)
        assert found.count() <= 3 * len(own)

"""Every operator on the awkward cases, and against brute force."""

import hashlib
import random
import re
from itertools import pairwise

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from skyloom.llm import bpe, components, langid, licences, mixing, pii, quality_rank, quality_rules, queries, simhash, toxicity, vafile

PROSE = "the cat and the dog ran to the hill with a red ball and it was good "
COLUMNS = "doc_id long, text string, lang string, source string, n_words long, fp long, kept boolean, words string, s string"
LONG = " ".join(f"w{i % 5000}" for i in range(60_000))


@pytest.fixture(scope="module")
def awkward(spark):
    texts = [None, "", " \n\t ", "one", "Ä ß 😀 €", PROSE * 6, PROSE * 6, PROSE * 6 + "x", LONG, "a@b.co 1.2.3.4", "12345", "#*$%&|<>"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", 1, 2, True, "w", "s") for i, t in enumerate(texts)]
    rows += [(5, PROSE * 6, "en", "s", 1, 2, True, "w", "s"), (None, "no id at all", "en", "s", 1, 2, True, "w", "s"), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(12)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_awkward_rows_have_a_row_each_and_empty_tables_none(spark, awkward, labels):
    model = langid.fit(awkward, labelled=~langid.held_out())
    found = pii.fit(awkward)
    bad, good = toxicity.fit(awkward, labels), quality_rank.fit(awkward, labels)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    each = [
        quality_rules.quality_rules, lambda d: pii.find(d, found), lambda d: toxicity.score(d, bad), lambda d: quality_rank.score(d, good), mixing.mixed_sizes,
        lambda d: langid.identify(d, model), simhash.near_duplicates, lambda d: bpe.round_trip(d, path, public_tokenizers.PATTERN), lambda d: pii.redacted(d, found),
    ]
    for operator in each:
        assert operator(awkward).count() == awkward.count()
        assert operator(awkward.limit(0)).count() == 0
    assert licences.scan(awkward).count() == 0 and licences.scan(awkward.limit(0)).count() == 0
    assert mixing.mixed_texts(awkward).columns == awkward.columns and mixing.mixed_texts(awkward.limit(0)).count() == 0
    assert simhash.one_of_each(awkward).columns == awkward.columns and simhash.one_of_each(awkward.limit(0)).count() == 0
    assert langid.accepted(awkward, model).columns == awkward.columns
    nothing = awkward.limit(0)
    assert langid.identify(awkward, langid.fit(nothing)).where("lang_pred <> 'und'").count() == 0
    assert toxicity.score(awkward, toxicity.fit(nothing, labels.limit(0))).where("score > 0.01").count() == 0
    assert quality_rank.score(awkward, quality_rank.fit(nothing, labels.limit(0))).where("score <> 0.5").count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_give_what_their_sql_gives(name, spark, sf_dir, same_as_sql):
    same_as_sql(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name])


def test_filters_on_rule_results(awkward):
    assert quality_rules.quality_rules(awkward).where("kept OR base_failed").count() >= 1


def plain_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_are_those_of_the_plain_patterns():
    rng = random.Random(2)
    parts = ["1", "2", "55", "0", "4", "-", ".", " ", "@", "a", "b.c", "+", "(", ")", "é", "4952935900253052", "\n", "x@y.z", "999"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 24)))
        assert plain_base(text) == pii.base_spans(text)


def test_skip_edges_carry_a_label_to_a_later_mention():
    model = pii.Field(skip=8.0)
    model.unary[0, 0] = 1.0
    text = "Call +1 (171) 555-2028 now. " + "word " * 50 + "Then 1715552028 again, 7654321 never."
    more = pii.further_spans(text, pii.base_spans(text), model)
    assert [text[a:b] for _, a, b in more] == ["1715552028"]
    assert "555" not in pii.redact(text, model) and pii.redact("", model) == "" and pii.redact(None, model) is None


def test_loopy_beliefs_are_exact_on_a_tree():
    rng = np.random.default_rng(0)
    model = pii.Field(rng.normal(size=(pii.FEATURES, 5)), rng.normal(size=(5, 5)), 2.0)
    text = "11 22 1234567 and much later in the text 99 1234567"
    tokens = pii.candidates(text, [])
    chain, skip = pii.edges(tokens)
    local = np.array([model.unary[pii.features(t, text[t.start - 1 : t.start] or " ")].sum(0) for t in tokens])
    total = np.zeros((len(tokens), 5))
    for states in np.ndindex(*[5] * len(tokens)):
        w = np.exp(sum(local[i, s] for i, s in enumerate(states)) + sum(model.chain[states[i], states[j]] for i, j in chain) + sum(2.0 * (states[i] == states[j]) for i, j in skip))
        for i, s in enumerate(states):
            total[i, s] += w
    assert np.allclose(pii.beliefs(text, tokens, model), total / total.sum(1, keepdims=True), atol=1e-3)


def brute_segments(scores):
    out = []

    def rec(a, b):
        best = max(((sum(scores[i:j]), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        if best and best[0] > 0:
            out.append(best[2:])
            rec(a, best[2])
            rec(best[3], b)

    rec(0, len(scores))
    return sorted(out)


def test_maximal_segments_against_their_definition():
    rng = random.Random(1)
    for _ in range(400):
        scores = [rng.uniform(-1, 1) for _ in range(rng.randrange(0, 18))]
        assert sorted((a, b) for _, a, b in toxicity.segments(scores)) == brute_segments(scores)


def auc(score, truth):
    ranks = np.argsort(np.argsort(score)) + 1.0
    n1, n0 = truth.sum(), (1 - truth).sum()
    return (ranks[truth == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


@pytest.mark.parametrize(("name", "label", "least"), [("op3_toxicity", "toxic", 0.9), ("op4_quality_rank", "quality", 0.98)])
def test_held_out_ranking(name, label, least, spark):
    folder = "/root/testdata/sf0.1"
    found = queries.queries()[name](spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas()
    assert auc(found["score"].to_numpy(), found[label].to_numpy()) >= least
    assert found["score"].between(0, 1).all()


def test_language_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    found = queries.queries()["op7_language_id"](spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert found.where("lang = lang_pred").count() >= 0.97 * found.count()


def test_windows_of_a_long_text_count_every_gram_once(monkeypatch):
    text = "Abc déf, ghi  jkl " * 40
    whole = sorted(np.concatenate(list(langid.grams(text))).tolist())
    monkeypatch.setattr(langid, "WINDOW", 37)
    assert sorted(np.concatenate(list(langid.grams(text))).tolist()) == whole


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_of_random_graphs_and_a_long_path(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + list(pairwise(range(1000, 1040)))
    found = {r.node: r.root for r in components.components(spark.createDataFrame([*edges, (7, 7), edges[0]], "a long, b long")).collect()}
    assert found == union_find([e for e in edges if e[0] != e[1]])


def test_links_of_dense_groups_against_all_pairs(spark):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    flipped = [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(500)]
    values = np.unique(np.array(flipped + [rng.getrandbits(64) for _ in range(200)], np.uint64))
    pairs = [(int(a), int(b)) for i, a in enumerate(values.view(np.int64)) for b in values.view(np.int64)[i + 1 :][np.bitwise_count(values[i + 1 :] ^ values[i]) <= 2]]
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    found = [tuple(r) for r in simhash.links(frame, 2, group=40).collect()]
    assert union_find(found) == union_find(pairs)
    assert {tuple(sorted(p)) for p in found} <= {tuple(sorted(p)) for p in pairs}


def test_fingerprint_bit_by_bit():
    from xxhash import xxh64_intdigest

    text = "The QUICK brown Ünï fox fox fox fox jumps\x0bover the\x1clazy dog"
    words = text.encode().lower().split()
    hashes = [xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    expected = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) == expected and simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("A b") == xxh64_intdigest(b"a b", 42)


def test_thresholds_of_least_cost():
    costs = [{-1: 0.0, 0: 5.0, 1: 9.0}, {-1: 0.0, 0: 1.0, 1: 2.0}, {-1: 0.0, 0: 1.0, 1: 7.0}]
    assert simhash.allocate(costs, 0) == [-1, 1, 0]


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 97, 1000):
        found = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3).cast("long")).alias("x")).toPandas()["x"]
        assert sorted(found) == list(range(n))


def test_mixture_meets_its_targets(spark):
    found = mixing.mixed_sizes(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    assert (found["taken"] <= 3 * found["size"]).all()
    by = found.groupby("target").agg(taken=("taken", "sum"), n=("source_size", "nunique"))
    wanted = by.index * by["n"]
    # Counts of slots are drawn: four standard deviations, and a block at a source's end.
    assert (abs(by["taken"] - wanted) < 4 * mixing.BLOCK * (wanted / mixing.BLOCK) ** 0.5 + mixing.BLOCK).all()


def test_mixture_caps_small_sources(spark):
    rows = spark.createDataFrame([(1, "a " * 10, "tiny"), (2, "b " * 1000, "x"), (3, "c " * 1000, "y")], "doc_id long, text string, source string")
    found = {r.doc_id: r for r in mixing.mixed_sizes(rows).collect()}
    assert found[1].target == 30 and found[1].taken <= 30
    assert abs(found[2].target - 1980 * 2 / 5) < 1e-9 and abs(found[3].target - 1980 * 3 / 5) < 1e-9


def test_top_k_with_ties_bad_rows_and_uneven_lengths(spark):
    rng = np.random.default_rng(5)
    vectors = {i: [float(x) for x in rng.normal(size=6).round(1)] for i in range(700)}
    rows = [(i, v) for i, v in vectors.items()] + [(800, None), (900, [float("nan")] * 6), (901, [None] * 6), (None, vectors[0]), (1000, vectors[0][:3])]
    vectors[1000] = vectors[0][:3]
    found = {}
    for r in vafile.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = {i: [int(np.floor(1024 * float(np.float32(x)))) for x in v] + [0] * (6 - len(v)) for i, v in vectors.items()}
    for q in range(0, 1001, 100):
        if q in whole:
            best = sorted(((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q))[:10]
            assert sorted(found[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_token_ids_are_those_of_the_reference_library(spark, awkward):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    own = bpe.codec(path, public_tokenizers.PATTERN)
    rng = random.Random(6)
    ranges = [(32, 127), (0, 32), (160, 0x600), (0x900, 0xE00), (0x3000, 0xA000), (0x1F300, 0x1F700), (0x16E00, 0x17000), (0x32000, 0x33500)]
    for _ in range(1500):
        text = "".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(30))
        ids = own.encode(text)
        assert ids == other.encode_ordinary(text) and own.decode(ids).decode() == text
    encoded = bpe.encode(awkward, path, public_tokenizers.PATTERN, with_offsets=True)
    for r in bpe.decode(encoded, path, public_tokenizers.PATTERN).join(awkward, "doc_id").where("doc_id <> 5").collect():
        assert r.data.decode() == (r.text or "")
    smile = encoded.where("doc_id = 4").first()
    assert smile.starts[0] == 0 and smile.ends[-1] == 7
    digest = bpe.round_trip(awkward, path, public_tokenizers.PATTERN).where("doc_id = 0").first()
    assert digest.n_tokens == 0 and digest.ids_sha256 == hashlib.sha256(b"").hexdigest() == digest.decoded_sha256


def test_pipeline_against_its_parts(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).toPandas(), docs.schema)
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert docs.where("n_chars <> length(text)").count() == 0
    assert not [r for r in docs.collect() if plain_base(r.text)]
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    expected = sorted((r.doc_id, len(other.encode_ordinary(r.text)), hashlib.sha256(r.text.encode()).hexdigest()) for r in docs.collect())
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in p.run(spark, sf_dir).collect()) == expected


def licences_of(spark, *texts):
    found = {}
    for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("dice").collect():
        found[r.doc_id] = r
    return found


def test_licence_wordings_from_outside_the_templates(spark):
    # As projects word them, or as the test data do.
    lines = {
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "This project is released under the GNU Lesser General Public License v2.1": "LGPL-2.1",
        "This site is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "CC-BY-SA-4.0",
        "# SPDX-License-Identifier: BSD-3-Clause": "SPDX-BSD-3-Clause",
        "Distributed under the MIT License": "MIT",
    }
    bsd = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        * Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        * Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution.
        * Neither the name of Google Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific
        prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT OWNER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
        INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
        DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE
        OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
    found = licences_of(spark, *[f"{PROSE}\n{line}\n{PROSE}" for line in lines], bsd)
    assert all(found[i].licence.startswith(name) for i, name in enumerate(lines.values()))
    assert "BSD-3-Clause-text" in {r.licence for r in licences.scan(spark.createDataFrame([(1, bsd)], "doc_id long, text string")).collect()}


def test_licences_across_lines_and_within_long_ones(spark):
    import textwrap

    notice = "\n".join(f"# {x}" for x in textwrap.wrap(licences.TEMPLATES["Apache-2.0-notice"], 72))
    filler = "\n".join(" ".join(f"v{i}x{j}" for j in range(12)) for i in range(300))
    texts = [f"# Copyright 2020 Someone\n\n{notice}\n\n{filler}", f"{filler}\n{notice}\n{filler}\n{notice}", f"{filler.replace(chr(10), ' ')} Licensed under CC BY-SA 4.0. {PROSE}"]
    found = licences_of(spark, *texts)
    assert found[0].licence == "Apache-2.0-notice" and found[0].line == 3 and found[0].n_passages == 1 and found[0].dice > 0.99
    assert found[1].licence == "Apache-2.0-notice" and found[1].line == 301 and found[1].n_passages == 2
    assert found[2].licence == "CC-BY-SA-4.0-short" and found[2].line == 1 and found[2].dice == 1.0
    assert len(licences_of(spark, f"{filler}\nSPDX-License-Identifier: Unheard-Of-1.0\n{filler}")) == 0


@pytest.mark.parametrize(("local", "n"), [(0.0, 100), (1.0, 100), (1.0, 1500)])
def test_a_label_reaches_all_mentions_of_a_long_text(local, n):
    model = pii.Field(skip=8.0)
    model.unary[0, 0] = local
    text = "Call +1 (171) 555-2028 now. " + "".join(f"Then {'word ' * 20}1715552028 again. " for _ in range(n))
    more = pii.further_spans(text, pii.base_spans(text), model)
    assert [text[a:b] for _, a, b in more] == ["1715552028"] * n
    assert "555" not in pii.redact(text, model)


def test_messages_settle_along_a_chain_of_unseen_mentions():
    model = pii.Field(skip=8.0)
    model.unary[9, 4] = 12.0  # only the first mention, an odd form, tells its kind
    tokens = pii.candidates("1.7.1.5552028 " + "word 1715552028 " * 40, [])
    assert (pii.beliefs("1.7.1.5552028 " + "word 1715552028 " * 40, tokens, model).argmax(1) == 4).all()


def test_only_whole_text_copies_teach_once(spark):
    header, footer = "The notes of the harbour office, volume number two. ", " This page is published under the terms of the office, as ever."
    own = [header + " ".join(f"w{i}x{j}" for j in range(80)) + footer for i in range(30)]
    near = own[0].replace("w0x40 ", "w0x40  ")
    rows = [(i + 10, t, 0) for i, t in enumerate(own)] + [(5, own[0], 0), (6, near, 0), (7, near, 1), (5, own[1], 0)]
    kept = sorted((r.text, r.toxic) for r in toxicity.one_a_class(spark.createDataFrame(rows, "id long, text string, toxic int")).collect())
    assert kept == sorted([(t, 0) for t in own] + [(near, 1)])

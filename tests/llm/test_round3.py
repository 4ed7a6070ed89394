"""The operators of round 3 against brute force, and the cases that data of other shapes bring."""

import hashlib
import random
import re
import time
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest

from skyloom.llm import divergence, hashed_index, licences, pii, queries, toxicity, vafile, vector_codes

VECTORS = "vec_id long, embedding array<double>, label int, code string, rank int, id int, v int, row int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "c", 1, 2, 3, 4) for i, v, label in rows], VECTORS)


@pytest.fixture(scope="module")
def awkward(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=7)], int(i % 3)) for i in range(300)]
    rows += [(300 + i, [1.0] * 7, None) for i in range(150)]  # a third are copies
    rows += [(None, [1.0] * 7, 1), (500, None, 1), (501, [1.0, None], 1), (502, [float("nan")] * 7, 1), (503, [float("inf"), 0.0], 1), (504, [], 1), (505, [0.0] * 7, 1), (600, [0.5], 2), (600, [0.5, 0.25], 2), (700, [-0.0] * 3, None)]
    return vectors(spark, rows), rows


def usable(rows):
    return [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]


# Nearest neighbours


def nearest(rows, k=10):
    rows = [(i, v) for i, v, _ in usable(rows) if i is not None and any(v)]
    dims = max((len(v) for _, v in rows), default=1)
    x, ids = hashed_index.padded([v for _, v in rows], dims), np.array([i for i, _ in rows])
    out = []
    for i, v in zip(ids, x, strict=True):
        if i % 100 == 0:
            d = np.array([np.sqrt(sum((a - b) ** 2 for a, b in zip(v, w, strict=True))) for w in x])
            at = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out.append((int(i), [(int(ids[j]), float(d[j])) for j in at]))
    return out


def test_nearest_neighbours_are_found_and_measured(spark, awkward):
    frame, rows = awkward
    found = hashed_index.nearest(frame).toPandas()
    expected = nearest(rows)
    hits = total = 0
    for i in {i for i, _ in expected}:
        own = found[found.query_id == i].sort_values(["rank", "score"])
        told = [e for j, e in expected if j == i]
        assert len(own) == sum(map(len, told)) and own["rank"].max() == 10
        best = Counter(v for e in told for v, _ in e)
        hits, total = hits + sum((Counter(own.vec_id) & best).values()), total + len(own)
        if len(told) == 1:
            assert own.score.is_monotonic_increasing and list(own["rank"]) == list(range(1, 11))
    assert hits >= 0.9 * total
    copies = found[found.query_id == 300].sort_values("rank")
    assert list(copies.vec_id) == list(range(301, 311)) and (copies.score == 0).all()
    assert hashed_index.nearest(frame.limit(0)).count() == 0
    few = vectors(spark, [(100, [1.0, 2.0], 0), (3, [1.0, 1.0], 0), (2, [2.0, 2.0], 0)])
    assert [tuple(r) for r in hashed_index.nearest(few).orderBy("rank").collect()] == [(100, 1, 2, 1.0), (100, 2, 3, 1.0)]
    assert hashed_index.nearest(few.limit(1)).count() == 0


def test_recall_of_the_query(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    expected = {i: [v for v, _ in e] for i, e in nearest([(r.vec_id, [float(x) for x in r.embedding], None) for r in table.collect()])}
    found = queries.queries()["op11_hashed_index"](spark, sf_dir).toPandas()
    assert len(found) == 10 * len(expected)
    hits = sum(len(set(found[found.query_id == i].vec_id) & set(e)) for i, e in expected.items())
    assert hits >= 0.9 * 10 * len(expected)


def test_probing_retrieves_every_code_within_a_radius():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 256, (400, 16)).astype(np.uint8)
    codes[200:] = codes[:200] ^ np.packbits(rng.random((200, 128)) < 0.1, axis=1)
    index = hashed_index.Index(np.zeros((400, 1)), np.arange(400), codes)
    for radius in (0, 3, 15, 16, 17, 30, 47, 60, 128):
        for i in (0, 17, 250):
            bits = np.unpackbits(codes ^ codes[i], axis=1).sum(1)
            assert sorted(index.within(codes[i], radius)) == sorted(np.flatnonzero(bits <= radius))


def test_index_measures_few_rows_where_neighbours_are_near():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(100, 32))
    x = np.concatenate([c + 0.05 * rng.normal(size=(40, 32)) for c in centres])
    codes = hashed_index.learned(x)
    search = hashed_index.Nearest(np.arange(5) * 100, np.arange(5), x[::100][:5], codes, 10)
    search.scan(hashed_index.Index(x, np.arange(len(x)), codes.encode(x)))
    assert search.read < 5 * 200
    for q, found in enumerate(search.found):
        d = hashed_index.distances(x, x[100 * q])
        d[100 * q] = np.inf
        assert len(set(found) & set(np.argsort(d)[:10])) >= 9


def test_distances_neither_overflow_nor_vanish():
    x = np.array([[3e300, 0.0], [0.0, 4e300], [3e-300, 0.0], [0.0, 0.0]])
    assert np.allclose(hashed_index.distances(x, np.zeros(2)), [3e300, 4e300, 3e-300, 0], rtol=1e-15)
    assert np.isclose(hashed_index.distances(x[:1], x[1])[0], 5e300, rtol=1e-15)
    assert hashed_index.distances(np.array([[1.7e308]]), np.array([-1.7e308]))[0] == np.inf


# Divergence


def audit(rows, least=3, most=200):
    groups, docs, words = {}, {}, {}
    for text, lang, source in ((t or "", a or "", b or "") for t, a, b in rows):
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", folded)
        groups.setdefault(lang, {}).setdefault(source, Counter()).update(terms)
        docs.setdefault(lang, Counter()).update(set(terms))
        words.setdefault(lang, Counter()).update(terms)
    out = []
    for lang, own in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        p_of = lambda n: {t: 1 + 10**9 * (n[t] + 1) // (sum(n[k] for k in kept) + len(kept)) for t in kept}  # noqa: B023, E731
        p, q = {s: p_of(n) for s, n in own.items()}, p_of(words[lang])
        for s in own:
            f = lambda a, b, t: (a[t] - b[t]) ** 2 // b[t]
            pair = [(-sum(f(p[s], p[o], t) for t in kept), o.encode()) for o in own if o != s]
            term = [(-f(p[s], q, t), t.encode()) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:most])):
                out += [(lang, s, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


def corpus():
    rng = random.Random(4)
    common = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = []
    for i in range(400):
        source = "hot" if i % 3 == 0 else f"s{i % 11}"
        own = [f"{source}x{chr(97 + k)}".translate({48 + d: 97 + d for d in range(10)}) for k in range(8)]
        rows.append((" ".join(rng.choices(common, k=20) + rng.choices(own, k=5)).title(), ["en", "de", None][i % 3 if i % 5 else 0], source if i % 17 else None))
    return rows + [(None, "fr", "a"), ("", "fr", "b"), ("1 2 3 #", None, "c"), ("Straße ÄÖ straße STRASSE", "de", "s1"), ("Straße", "de", "s2"), ("straße ÄÖ", "de", "s3"), ("word " * 50_000, "en", "long"), (None, None, None)] + [("same words here", "it", "x")] * 4


@pytest.mark.parametrize("how", [{}, {"share": 0.0}, {"share": 1.0, "postings": 100}, {"block": 3, "postings": 150, "share": 0.3}])
def test_divergence_of_awkward_rows(how, spark):
    rows = corpus()
    frame = spark.createDataFrame([(*r, 1, "t", 2, 3) for r in rows], "text string, lang string, source string, term int, item string, n int, p int")
    assert sorted(map(tuple, divergence.audit(frame, **how).collect())) == audit(rows)


def test_divergence_of_empty_tables_and_many_terms(spark):
    kind = "text string, lang string, source string"
    assert divergence.audit(spark.createDataFrame([], kind)).count() == 0
    many = [(" ".join(f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)), "en", "a")] * 3 + [("taa " * 50, "en", "b")]
    found = sorted(map(tuple, divergence.audit(spark.createDataFrame(many, kind)).collect()))
    assert found == audit(many) and sum(r[1:3] == ("a", "term") for r in found) == 200


def test_frequencies_of_very_many_words():
    n = np.array([10**13, 0, 5])
    assert divergence.frequencies(n, np.array([10**15] * 3), 7).tolist() == [1 + 10**9 * (x + 1) // (10**15 + 7) for x in n.tolist()]


def test_divergence_by_sql(spark, sf_dir, same_as_sql):
    same_as_sql(queries.queries()["op12_divergence"](spark, sf_dir), queries.oracle_sql()["op12_divergence"])


# Vector codes


def codes(rows, entries, parts=4, rounds=4):
    rows = usable(rows)
    longest = max((len(v) for _, v, _ in rows), default=1) or 1
    width = -(-longest // parts)
    down = lambda x: int(np.floor(x * 1024)) if abs(x) < 2**53 else int(x) * 1024
    x = [[down(c) for c in v] + [0] * (parts * width - len(v)) for _, v, _ in rows]
    first = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0, rows[r][1]))[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(x[r], p) for r in first] for p in range(parts)]
    assign = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(cut(v, p), c, strict=True)), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            of = [assign(v, p)[1] for v in x]
            own = [[cut(v, p) for v, e in zip(x, of, strict=True) if e == k] for k in range(len(books[p]))]
            new.append([[sum(c) // len(o) for c in zip(*o, strict=True)] if o else b for o, b in zip(own, books[p], strict=True)])
        books = new
    done = [[assign(v, p) for p in range(parts)] for v in x]
    errors = [sum(d for d, _ in a) for a in done]
    of = Counter()
    for (_, _, label), e in zip(rows, errors, strict=True):
        of[label] += e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    cap = lambda v: min(v, 2**63 - 1)
    return sorted(((i, "".join(f"{e:02x}" for _, e in a), cap(e), cap(of[label]), sha) for (i, _, label), a, e in zip(rows, done, errors, strict=True)), key=repr)


@pytest.mark.parametrize("entries", [256, 20])
def test_codes_of_awkward_rows(entries, spark, awkward):
    frame, rows = awkward
    found = sorted(map(tuple, vector_codes.compressed(frame, entries=entries).collect()), key=repr)
    assert found == codes(rows, entries)
    assert vector_codes.compressed(frame.limit(0)).count() == 0


def test_codes_of_extreme_and_close_components(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([1e300, -1e300, 1.7e308, 1e6, 1e6 + 2**-10, 0.0, 3e12]) for _ in range(8)], i % 2) for i in range(60)]
    rows += [(100 + i, [16384 + rng.randrange(-2, 3) / 1024 for _ in range(8)], None) for i in range(200)]
    for own in (rows, rows[60:]):
        assert sorted(map(tuple, vector_codes.compressed(vectors(spark, own), entries=30).collect()), key=repr) == codes(own, 30)


def test_screening_keeps_every_nearest_entry():
    rng = np.random.default_rng(2)
    for most in (3, 10**3, 10**6, 10**8):
        x, book = rng.integers(-most, most + 1, (500, 16)), rng.integers(-most, most + 1, (256, 16))
        book[128:] = book[:128]  # every entry twice
        index, error = vector_codes.nearest(x, book)
        d = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (index == d.argmin(1)).all() and (error == d.min(1)).all()
        assert vector_codes.close(x, book).sum() < len(x) * 256 / 4 or most == 3


def test_codes_by_sql(spark, sf_dir, same_as_sql):
    same_as_sql(queries.queries()["op13_vector_codes"](spark, sf_dir), queries.oracle_sql()["op13_vector_codes"])


# Exact search


def test_exact_search_with_extreme_components(spark):
    rows = [(100, [1e300, 1.0], 0)] + [(i + 1, [float(i - 20), 0.0], 0) for i in range(40)] + [(50, [-1e300, 0.0], 0), (60, [1.7e308, -1.7e308], 0), (200, [1.7e308, 1.6e308], 0)]
    whole = {i: [int(np.floor(x * 1024)) if abs(x) < 2**53 else int(x) * 1024 for x in v] for i, v, _ in rows}
    cut = lambda s: max(-(2**63), min(2**63 - 1, s))
    expected = []
    for q in (100, 200):
        scores = sorted((-cut(sum(a * b for a, b in zip(whole[q], v, strict=True))), i) for i, v in whole.items() if i != q)[:10]
        expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert sorted(map(tuple, vafile.top_k(vectors(spark, rows)).collect())) == expected
    block = SimpleNamespace(**vafile.pack(np.arange(2), np.arange(2), np.array([[1e308, 1.0], [-1e308, 2.0]])))
    assert not block.small and vafile.integers(vafile.unpacked(block)[2][0], 1024) == [int(1e308) * 1024, 1024]


# Licences


def plain_runs(own, k, pairs):
    """All windows of a template's runs, one after another."""
    mine, m, t, most = own.pairs[k], own.sizes[k], own.threshold, own.longest(k)
    gain = lambda a, b: 2 * len(set(pairs[a : b + 1]) & mine) - t * len(set(pairs[a : b + 1]))
    begin, out = 0, []
    while begin < len(pairs):
        best, top, gate = None, t * m - 1e-9, len(pairs)
        for r in range(begin, len(pairs)):
            if r + 1 - most > gate:
                break
            for a in range(max(begin, r + 1 - most), min(r, gate) + 1):
                if (g := gain(a, r)) > top + 1e-9 * bool(best):
                    top, best = g, (a, r)
            gate = min(gate, best[1]) if best else gate
        if not best:
            break
        held = set(pairs[best[0] : best[1] + 1])
        if not own.marks[k] or held & own.marks[k]:
            out.append((len(held & mine), 2.0 * len(held & mine) / (len(held) + m), *best))
        begin = best[1] + 1
    return out


def test_runs_of_random_texts_by_all_windows():
    rng = random.Random(9)
    texts = {"one": "a b c d e f g h i j", "two": "a b c x y z d e f q r s", "three": "m n a b m n"}
    own = licences.Templates(texts, 0.8)
    found = 0
    for _ in range(400):
        words = []
        while len(words) < rng.randrange(5, 60):
            if rng.random() < 0.5:
                part = texts[rng.choice(list(texts))].split()
                words += [w for w in part if rng.random() < 0.95] * rng.choice([1, 1, 2])
            else:
                words += rng.choices("abcdefmnxyq", k=rng.randrange(1, 6))
        pairs = list(zip(words, words[1:], strict=False))
        for k in texts:
            hits = [i for i, b in enumerate(pairs) if b in own.pairs[k]]
            mine = list(own._own_runs(k, pairs, hits)) if hits else []
            expected = plain_runs(own, k, pairs)
            assert [r[2:] for r in mine] == [r[2:] for r in expected] and np.allclose([r[:2] for r in mine], [r[:2] for r in expected])
            found += len(mine)
        kept = own.runs(words)
        assert all(b <= c for (_, _, _, b), (_, _, c, _) in zip(kept, kept[1:], strict=False))
    assert found > 200


def test_runs_in_repetitive_texts_take_time_in_proportion():
    own = licences.Templates(licences.TEMPLATES, licences.THRESHOLD)
    name = max((k for k, n in own.sizes.items() if n < 200), key=own.sizes.get)
    words = licences.tokens(licences.TEMPLATES[name])
    near = words[: len(words) // 2] + words[len(words) // 2 + 1 :]
    times = []
    for n in (100_000, 400_000):
        began = time.perf_counter()
        found = own.runs((near * (n // len(near) + 1))[:n])
        times.append(time.perf_counter() - began)
        assert abs(len(found) - n / len(near)) <= n / len(near) / 10
    assert times[1] < 8 * times[0] and times[1] < 60


# Bounds of fitting samples


def test_pii_samples_stop_at_the_bound_and_toxicity_fails_beyond_it(spark):
    docs = spark.createDataFrame([(i, f"call +1 (171) 555-20{i:02d} or 17155520{i:02d} " * (1 + i % 3)) for i in range(60)], "doc_id long, text string")
    for most in (10, 200, 10**6):
        assert pii.fit(docs, most_tokens=most).unary.shape == (pii.FEATURES, 5)
    rows = spark.createDataFrame([(f"good w{i} bad{i % 2}", i % 2) for i in range(200)], "text string, toxic int")
    assert len(toxicity.token_table(rows)) >= 2
    with pytest.raises(ValueError, match="tokens are evidence"):
        toxicity.token_table(rows, 1)
    with pytest.raises(ValueError, match="near copies"):
        toxicity.fit(docs, docs, most=toxicity.MOST_ROWS + 1)


def test_numbers_that_are_split_otherwise_are_one_candidate(spark):
    text = "pay with 4952 9359 0025 3052 or call +1 (171) 555-2028; later 171 555 2028 and 1 171 5552028 but not 171 555 2029, 12 34 or 2028 555 171"
    base = pii.base_spans(text)
    assert [k for k, _, _ in base] == ["card", "phone"]
    own = {t.text: (t.observed, t.key) for t in pii.candidates(text, base)}
    assert own["4952 9359 0025 3052"] == (3, "0253052") and own["+1 (171) 555-2028"] == (4, "5552028")
    assert own["171 555 2028"] == (0, "5552028") == own["1 171 5552028"] and own["555"] == (0, "") and "12 34" not in own
    rng = random.Random(12)
    docs = []
    for i in range(300):
        number = f"{rng.randrange(100, 999)}{rng.randrange(10**6, 10**7)}"
        docs.append((i, f"call +1 ({number[:3]}) {number[3:6]}-{number[6:]} today, order {rng.randrange(10**4)} of {rng.randrange(1900, 2030)} with {rng.randrange(100)} {rng.randrange(1000)} pieces; again {number[:3]} {number[3:6]} {number[6:]} please", number))
    frame = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.find(frame, pii.fit(frame)).collect()}
    more = {i: [t[s.start : s.end] for s in found[i] if not s.base] for i, t, _ in docs}
    assert sum(any(re.sub("[^0-9]", "", m) == n for m in more[i]) for i, _, n in docs) >= 290
    assert sum(len(m) for m in more.values()) <= 310


def test_long_rows_of_numbers_take_time_in_proportion():
    text = "call +1 (171) 555-2028; " + "171 555 2029 " * 20_000
    began = time.perf_counter()
    assert len(pii.candidates(text, pii.base_spans(text))) == 60_001
    assert time.perf_counter() - began < 20


def test_pipeline_rows_by_brute_force_stage_by_stage(spark, sf_dir, tmp_path):
    import corpus_pipeline as p
    import public_tokenizers
    import tiktoken
    from skyloom.llm import bpe, langid, mixing, simhash

    written = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for i, (_, stage) in enumerate(p.STAGES):
        stage(spark, written[-1], sf_dir).write.parquet(str(tmp_path / str(i)))
        written.append(spark.read.parquet(str(tmp_path / str(i))))
    docs, told, single, plain, mixed, tokens = [f.toPandas() for f in written]
    columns = list(docs.columns)
    by_id = lambda frame: frame.set_index("doc_id").sort_index()

    # Language: what is rejected goes, the rest is as it was.
    model = langid.fit(written[0], labelled=~langid.held_out())
    gone = {r.doc_id for r in langid.identify(written[0], model).where("rejected").collect()}
    assert set(told.doc_id) == set(docs.doc_id) - gone and list(told.columns) == columns
    assert by_id(told).equals(by_id(docs).loc[sorted(told.doc_id)])

    # Near duplicates: all pairs of fingerprints.
    prints = {i: simhash.fingerprint(t) for i, t in zip(told.doc_id, told.text, strict=True)}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if bin((prints[a] ^ prints[b]) & (2**64 - 1)).count("1") <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert set(single.doc_id) == {find(i) for i in ids} and by_id(single).equals(by_id(told).loc[sorted(single.doc_id)])

    # Personal data: every text on its own.
    found = pii.fit(written[2])
    expected = {i: pii.redact(t, found) for i, t in zip(single.doc_id, single.text, strict=True)}
    assert dict(zip(plain.doc_id, plain.text, strict=True)) == expected
    assert any("[email]" in t for t in expected.values()) and list(plain.n_chars) == [len(t) for t in plain.text]

    # Mixing: each row's words are words of its document in their order, as many as the mix takes.
    words = {i: t.split() for i, t in zip(plain.doc_id, plain.text, strict=True)}
    taken = Counter()
    for i, t in zip(mixed.doc_id, mixed.text, strict=True):
        own, rest = t.split(), iter(words[i])
        taken[i] += len(own)
        assert own and all(w in rest for w in own)
    sizes = {r.doc_id: r.taken for r in mixing.mixed_sizes(written[3]).collect()}
    assert all(taken[i] == n <= 3 * len(words[i]) for i, n in sizes.items()) and set(taken) <= set(sizes)

    # Tokens: another tokenizer.
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rows = []
    for i, t in zip(mixed.doc_id, mixed.text, strict=True):
        own = other.encode_ordinary(t)
        rows.append((i, len(own), hashlib.sha256(",".join(map(str, own)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    same = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(tokens[same].itertuples(index=False, name=None)) == sorted(rows)
    assert sorted(map(tuple, p.run(spark, sf_dir).select(*same).collect())) == sorted(rows)

"""Personal data by fixed patterns and a skip-chain conditional random field.

Patterns give the base spans: e-mail addresses, IPv4 addresses, card numbers (Luhn), phone numbers. A
random field then labels the remaining tokens that hold a digit or an @. Its potentials: log-linear
token features; a chain between neighbours; skip edges between occurrences, however far apart, of the
same or a similar token (equal address name, equal digits or equal last seven digits), each linked to
the next one and to the nearest that a base span covers, so that belief does not fade with the number of
mentions between. Base spans are observed. Loopy sum-product messages pass until they settle (with a bound
of ``ROUNDS`` and four for each token), so what is labelled once in a document is labelled wherever it turns
up again; tokens whose belief in one entity reaches ``SURE`` become further spans. All weights are trained
together, by pseudo-likelihood, on a bounded sample of documents whose base spans serve as labels; each span
is mentioned once more there in a bare form that no pattern matches, so that the skip weight is learnt.

Defined results: null texts are empty ones; spans count code points, end exclusive; base spans stay as
they are, further spans never overlap them; rows are handled one by one and whole, so repeated rows
repeat their results; an empty table gives an empty result and a field that adds no spans.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import bounded_sample, materialised

KINDS = ("email", "ip", "card", "phone")
#: Documents that the weights are fitted on, at most, and tokens of theirs; parameters of ``fit``.
FIT_ROWS = 4000
FIT_TOKENS = 400_000
SURE = 0.8
#: Rounds of messages, at most, besides those that grow with the tokens.
ROUNDS = 20

Span = tuple[str, int, int]

_at = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_name = re.compile(r"[A-Za-z0-9._%+-]+")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_sign = re.compile(r"[0-9@]")
_number = re.compile(r"[0-9()+.-]*[0-9][0-9()+.-]*")
_edge = "\"'.,;:!?()[]{}<>|"
_blank = " \t\n\x0b\x0c\r"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    """The @ and what follows is sought first; the name is the run of its characters before, after the last match."""
    done = 0
    for m in _at.finditer(text):
        low = m.start()
        while low > done and _name.match(text[low - 1]):
            low -= 1
        if low < m.start():
            done = m.end()
            yield "email", low, done


def base_spans(text: str) -> list[Span]:
    """The spans of the patterns, by kind in the order of ``KINDS``, then by start."""
    out = list(_emails(text)) if "@" in text else []
    if not _sign.search(text):
        return out
    out += [("ip", *m.span()) for m in _ip.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _card.finditer(text):
        if 16 <= len(own := _digits(m[0])) <= 19 and luhn(own):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _phone.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


@dataclass(frozen=True)
class Token:
    start: int
    end: int
    text: str
    observed: int  # label of the base span that covers it, 0 for none
    key: str


def candidates(text: str, base: list[Span]) -> list[Token]:
    """The blank-parted tokens with a digit or an @, without punctuation around them; those of one number are one, by ``whole_numbers``."""
    spans = sorted((a, b, KINDS.index(k) + 1) for k, a, b in base)
    out, end, j, reach = [], 0, 0, []
    owners: list[tuple[int, int, int] | None] = []
    for m in _sign.finditer(text):
        if m.start() < end:
            continue
        low = m.start()
        while low > end and text[low - 1] not in _blank:
            low -= 1
        end = m.end()
        while end < len(text) and text[end] not in _blank:
            end += 1
        word = text[low:end]
        inner = word.strip(_edge)
        if not inner:
            continue
        a = low + len(word) - len(word.lstrip(_edge))
        b = a + len(inner)
        while j < len(spans) and spans[j][0] < b:
            reach.append(spans[j])
            j += 1
        reach = [s for s in reach if s[1] > a]
        digits = _digits(inner)
        key = inner.partition("@")[0].lower() if "@" in inner else digits[-7:] if len(digits) >= 7 else ""
        out.append(Token(a, b, inner, reach[0][2] if reach else 0, key))
        owners.append(reach[0] if reach else None)
    return whole_numbers(text, out, owners)


def whole_numbers(text: str, tokens: list[Token], owners: list[tuple[int, int, int] | None]) -> list[Token]:
    """Tokens that make up one number joined: those of one base span, and runs of others, a blank apart, that spell a base span's number
    however they part it (all of it, or what follows a prefix such as a country's)."""
    joined_: list[Token] = []
    for t, own, before in zip(tokens, owners, [None, *owners], strict=False):
        if own is not None and own is before and "@" not in joined_[-1].text + t.text:
            a = joined_[-1].start
            digits = _digits(text[a : t.end])
            joined_[-1] = Token(a, t.end, text[a : t.end], t.observed, digits[-7:] if len(digits) >= 7 else "")
        else:
            joined_.append(t)
    known: dict[str, list[str]] = {}
    for t in joined_:
        if t.observed and t.key and "@" not in t.text:
            known.setdefault(t.key, []).append(_digits(t.text))
    if not known:
        return joined_
    out, i = [], 0
    while i < len(joined_):
        t, reach = joined_[i], i
        digits = _digits(t.text)
        k = i
        while not joined_[k].observed and _number.fullmatch(joined_[k].text) and k + 1 < len(joined_):
            after = joined_[k + 1]
            if after.observed or not _number.fullmatch(after.text) or after.start - joined_[k].end > 2 or text[joined_[k].end : after.start].strip(" ()"):
                break
            digits += _digits(after.text)
            k += 1
            if len(digits) > 19:
                break
            if any(d.endswith(digits) for d in known.get(digits[-7:], ())):
                reach = k
        if reach > i:
            end = joined_[reach].end
            t = Token(t.start, end, text[t.start : end], 0, _digits(text[t.start : end])[-7:])
        out.append(t)
        i = reach + 1
    return out


FEATURES = 16


def features(token: Token, before: str) -> list[int]:
    """Indexes of the features that hold for a token; ``before`` is the character in front of it."""
    word = token.text.replace(" ", "")
    n = sum("0" <= c <= "9" for c in word)
    out = [0, 1 + min(6, n // 3)]
    if "@" in word:
        out.append(8)
    if word.count(".") == 3:
        out.append(9)
    elif "." in word:
        out.append(10)
    if "-" in word or "(" in word:
        out.append(11)
    if before in "+(":
        out.append(12)
    if n * 2 < len(word):
        out.append(13)
    if n == len(word):
        out.append(14 if 16 <= n <= 19 else 15)
    return out


@dataclass
class Field:
    """Weights of the random field: features x labels, chain labels x labels, agreement on a skip edge."""

    unary: np.ndarray = field(default_factory=lambda: np.zeros((FEATURES, len(KINDS) + 1)))
    chain: np.ndarray = field(default_factory=lambda: np.zeros((len(KINDS) + 1,) * 2))
    skip: float = 0.0


def edges(tokens: list[Token]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between tokens a blank or two apart, and skip edges between next occurrences of a key."""
    chain = [(i, i + 1) for i in range(len(tokens) - 1) if tokens[i + 1].start - tokens[i].end <= 3]
    neighbours = set(chain)
    last: dict[str, int] = {}
    skip = []
    for i, t in enumerate(tokens):
        if t.key:
            if t.key in last and (last[t.key], i) not in neighbours:
                skip.append((last[t.key], i))
            last[t.key] = i
    return chain, skip


def ties(tokens: list[Token], known: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Skip edges between tokens that no base span covers and the nearest one of their key that is, but for ``known`` edges."""
    places: dict[str, list[int]] = {}
    for i, t in enumerate(tokens):
        if t.key and t.observed:
            places.setdefault(t.key, []).append(i)
    out = []
    for i, t in enumerate(tokens):
        if not t.observed and (own := places.get(t.key)):
            at = bisect(own, i)
            j = min(own[max(0, at - 1) : at + 1], key=lambda j: abs(i - j))
            pair = (min(i, j), max(i, j))
            if pair not in known:
                out.append(pair)
    return out


def beliefs(text: str, tokens: list[Token], model: Field) -> np.ndarray:
    """Marginals (tokens x labels) by loopy sum-product with damping."""
    labels = len(KINDS) + 1
    local = np.array([model.unary[features(t, text[t.start - 1 : t.start] or " ")].sum(0) for t in tokens])
    for i, t in enumerate(tokens):
        if t.observed:
            # So low that no number of messages from other mentions outweighs what is observed.
            local[i] = -1e9
            local[i, t.observed] = 0.0
    chain, skip = edges(tokens)
    skip += ties(tokens, {*chain, *skip})
    pairs = chain + skip
    if not pairs:
        out = np.exp(local - local.max(1, keepdims=True))
        return out / out.sum(1, keepdims=True)
    agree = np.exp(model.skip * np.eye(labels))
    tables = np.array([np.exp(model.chain)] * len(chain) + [agree] * len(skip))
    source = np.array([p[0] for p in pairs] + [p[1] for p in pairs])
    target = np.array([p[1] for p in pairs] + [p[0] for p in pairs])
    tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
    messages = np.full((len(source), labels), 1.0 / labels)
    for _ in range(ROUNDS + 4 * len(tokens)):
        total = local.copy()
        np.add.at(total, target, np.log(messages + 1e-300))
        rest = total[source] - np.log(messages[back] + 1e-300)
        rest = np.exp(rest - rest.max(1, keepdims=True))
        new = np.einsum("ij,ijk->ik", rest, tables)
        new /= new.sum(1, keepdims=True)
        moved = np.abs(new - messages).max()
        messages = 0.5 * messages + 0.5 * new
        if moved < 1e-4:
            break
    total = local.copy()
    np.add.at(total, target, np.log(messages + 1e-300))
    out = np.exp(total - total.max(1, keepdims=True))
    return out / out.sum(1, keepdims=True)


def further_spans(text: str, base: list[Span], model: Field) -> list[Span]:
    """Spans that the field adds: runs of neighbouring tokens with one sure label."""
    tokens = candidates(text, base)
    if all(t.observed for t in tokens):
        return []
    sure = beliefs(text, tokens, model)
    out: list[Span] = []
    covered = sorted((a, b) for _, a, b in base)
    j = 0
    for t, p in zip(tokens, sure, strict=True):
        label = int(p.argmax())
        while j < len(covered) and covered[j][1] <= t.start:
            j += 1
        if t.observed or not label or p[label] < SURE or j < len(covered) and covered[j][0] < t.end:
            continue
        kind = KINDS[label - 1]
        between = any(a < t.start and b > out[-1][2] for a, b in covered[max(0, j - 1) : j + 1]) if out else False
        if out and out[-1][0] == kind and t.start - out[-1][2] <= 2 and not between:
            out[-1] = (kind, out[-1][1], t.end)
        else:
            out.append((kind, t.start, t.end))
    return out


Lesson = tuple[list[list[int]], list[int], list[tuple[int, int]], list[tuple[int, int]]]


def lesson(text: str) -> Lesson | None:
    """(features, labels, chain edges, skip edges) that a document teaches; None without candidates.

    Base spans give the labels; other tokens are of no kind, but for those that repeat what a base span
    holds: their label is hidden (-1). In their place each labelled token is mentioned once more without its
    context and punctuation, tied to it by a skip edge, so that the field learns mentions that no pattern matches.
    """
    base = base_spans(text)
    own = candidates(text, base)
    if not own:
        return None
    chain, skip = edges(own)
    known = {t.key: i for i, t in enumerate(own) if t.observed and t.key}
    marks = [t.observed if t.observed or t.key not in known else -1 for t in own]
    feats = [features(t, text[t.start - 1 : t.start] or " ") for t in own]
    for key, i in known.items():
        t = own[i]
        whole = next((d for _, a, b in base if a <= t.start < b and (d := _digits(text[a:b])).endswith(key)), "")
        bare = t.text.partition("@")[0] + "@" if "@" in t.text else whole or _digits(t.text)
        skip.append((i, len(feats)))
        feats.append(features(Token(0, len(bare), bare, 0, key), " "))
        marks.append(t.observed)
    return feats, marks, chain, skip


def train(found: list[Lesson], steps: int = 600, rate: float = 0.05, ridge: float = 1e-4) -> Field:
    """All weights of the field together, by its pseudo-likelihood: the chance of each known label, given the
    token's features and the labels of its neighbours on chain and skip edges. Adam steps in numpy."""
    labels = len(KINDS) + 1
    model = Field()
    y = np.array([m for _, marks, _, _ in found for m in marks], np.int64)
    if not (y > 0).any():
        model.unary[0, 0] = 20.0
        return model
    x = np.zeros((len(y), FEATURES))
    left, right, same = (np.zeros((len(y), labels)) for _ in range(3))
    at = 0
    for feats, marks, chain, skip in found:
        for i, own in enumerate(feats):
            x[at + i, own] = 1
        for pairs, to, back in ((chain, left, right), (skip, same, same)):
            for i, j in pairs:
                if marks[i] >= 0:
                    to[at + j, marks[i]] += 1
                if marks[j] >= 0:
                    back[at + i, marks[j]] += 1
        at += len(feats)
    shown = (y >= 0)[:, None]
    truth = np.eye(labels)[np.maximum(y, 0)]
    w = np.zeros(FEATURES * labels + labels * labels + 1)
    cut = FEATURES * labels, FEATURES * labels + labels * labels
    mean, spread = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        unary, chained = w[: cut[0]].reshape(FEATURES, labels), w[cut[0] : cut[1]].reshape(labels, labels)
        z = x @ unary + left @ chained + right @ chained.T + w[-1] * same
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = (p - truth) * shown / shown.sum()
        slope = np.concatenate([(x.T @ d).ravel(), (left.T @ d + d.T @ right).ravel(), [(d * same).sum()]]) + ridge * w
        mean, spread = 0.9 * mean + 0.1 * slope, 0.999 * spread + 0.001 * slope**2
        w = w - rate * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-9)
    return Field(w[: cut[0]].reshape(FEATURES, labels), w[cut[0] : cut[1]].reshape(labels, labels), float(w[-1]))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = FIT_ROWS, most_tokens: int = FIT_TOKENS) -> Field:
    """A field fitted on a bounded sample of documents. Texts stay in the tasks; their feature numbers are
    gathered in the order of the documents' hashes, up to the first document with which there would be more than ``most_tokens`` tokens
    (a document that has more on its own is passed over), so long and short documents are as likely to be in the sample."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = bounded_sample(rows, ["id", "text"], most)
    sample = sample.select(F.xxhash64("id", "text").alias("h"), "text")
    kind = "h long, feats array<array<int>>, marks array<int>, chain array<array<int>>, skip array<array<int>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(h, *own) for h, text in zip(batch["h"], batch["text"], strict=True) if text and (own := lesson(text))]
            yield pd.DataFrame(out, columns=["h", "feats", "marks", "chain", "skip"])

    lessons = materialised(sample.mapInPandas(run, kind))
    # A text may hold very many tokens.
    sizes = sorted((r.h, r.n) for r in lessons.select("h", F.size("marks").alias("n")).collect())
    taken, total = [], 0
    for h, n in sizes:
        if n > most_tokens:
            continue
        if total + n > most_tokens:
            break
        taken.append(h)
        total += n
    rows = lessons.where(F.col("h").isin(taken)).collect() if len(taken) < len(sizes) else lessons.collect()
    return train([(list(map(list, r.feats)), list(r.marks), list(map(tuple, r.chain)), list(map(tuple, r.skip))) for r in sorted(rows, key=lambda r: r.h)])


def joined(spans: list[Span]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1], s[2])))


def find(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, spans array<struct<kind, start, end, base>>, base_digest (SHA-256 of the joined base spans) and joined spans of each row."""
    rows = docs.select(id_col, text_col)
    kind = rows.schema[id_col].dataType.simpleString()
    one = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, digests, texts = [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                more = further_spans(text, base, model)
                spans.append([{"kind": k, "start": a, "end": b, "base": True} for k, a, b in base] + [{"kind": k, "start": a, "end": b, "base": False} for k, a, b in more])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                texts.append(joined(base + more))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(one)), pa.array(digests, pa.string()), pa.array(texts, pa.string())], [id_col, "spans", "base_digest", "joined"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, spans array<struct<kind: string, start: int, end: int, base: boolean>>, base_digest string, joined string")


def redact(text: str | None, model: Field) -> str | None:
    """The text with every span replaced by its kind in brackets; spans that overlap are replaced as one."""
    if not text:
        return text
    base = base_spans(text)
    spans = sorted((a, b, k) for k, a, b in base + further_spans(text, base, model))
    out, done = [], 0
    for i, (a, b, k) in enumerate(spans):
        if a >= done or i == 0:
            out += [text[done:a], f"[{k}]"]
            done = b
        else:
            done = max(done, b)
    return "".join([*out, text[done:]])


def redacted(docs: DataFrame, model: Field, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data replaced in the text; a column ``n_chars``, if there is one, is set anew."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([redact(t, model) for t in batch], dtype=object)

    out = docs.withColumn(text_col, run(F.col(text_col)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)

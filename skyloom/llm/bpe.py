"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file lists byte strings by rank. ``tokenizers`` wants a vocabulary of characters and a list of
merges, so each byte gets a printable character, each token becomes a string of such characters, and
each way to make a token from two shorter ones becomes a merge with the rank of its result. A text is
cut by the pattern, each piece is encoded by itself, and pieces seen before come from a table of
bounded size. Decoding maps ids to bytes through the reversed byte table; characters that were split
over several ids join again because bytes are joined before they are read as UTF-8.

Defined results: a null text counts as an empty one and has no ids; ids that the vocabulary lacks are
refused on decoding; rows with the same id are encoded separately; texts are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

#: Pieces that a worker remembers at most.
MOST_PIECES = 300_000

#: Code points that Unicode calls letters or numbers only after version 16. The pattern's
#: classes are those of version 16, while the regex module knows later ones.
LATER = {
    "L": "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 "
    "10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA "
    "18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 "
    "1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E "
    "2CEA2-2CEAD 323B0-33479 3D000-3FC3F",
    "N": "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6",
}

#: Texts of code points below this only are cut by the quicker re module.
NARROW = 0x250


def byte_table() -> dict[int, str]:
    """A printable character for each byte: itself where it is printable, else the next unused code point from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: chr(b if b in plain else next(spare)) for b in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def with_classes(pattern: str, classes: dict[str, str]) -> str:
    """The pattern with its escapes ``\\p{L}``, ``\\p{N}`` and ``\\s`` spelled by class bodies, and ``\\S`` by their complement."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        width = 5 if pattern.startswith("\\p{", at) else 2 if pattern[at] == "\\" else 1
        token = pattern[at : at + width]
        if token == "\\S":
            token = f"[^{classes['s']}]"
        elif width > 1 and (body := classes.get(token[-2] if width == 5 else token[1])):
            token = body if inside else f"[{body}]"
        elif token in "[]":
            inside = token == "["
        out.append(token)
        at += width
    return "".join(out)


def splitters(pattern: str) -> tuple[Callable[[str], list[str]], Callable[[str], list[str]]]:
    """Functions that cut a text into the pattern's pieces: for narrow texts, for any text."""
    import regex

    def spans(codes: list[int]) -> str:
        return "".join(f"\\U{c:08X}" for c in codes)

    narrow = {k: spans([c for c in range(NARROW) if regex.match(rf"\p{{{k}}}", chr(c))]) for k in "LN"}
    wide = {k: rf"[\p{{{k}}}--[" + "".join("-".join(f"\\U{int(x, 16):08X}" for x in part.split("-")) for part in LATER[k].split()) + "]]" for k in "LN"}
    blanks = {"s": spans([c for c in range(NARROW) if regex.match(r"\s", chr(c))])}
    any_text = regex.compile(with_classes(pattern, wide | {"s": r"\s"}), regex.V1).findall
    return re.compile(with_classes(pattern, narrow | blanks)).findall, any_text


class Codec:
    """Encodes and decodes by one rank file."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer, models

        ranks = read_ranks(path)
        chars = byte_table()
        spelled = {token: "".join(map(chars.__getitem__, token)) for token in ranks}
        merges = [
            (spelled[token[:k]], spelled[token[k:]])
            for token in sorted(ranks, key=ranks.__getitem__)
            for k in range(1, len(token))
            if token[:k] in ranks and token[k:] in ranks
        ]
        self.ranks = ranks
        self.tokenizer = Tokenizer(models.BPE({spelled[t]: r for t, r in ranks.items()}, merges))
        self.chars = [chars[b] for b in range(256)]
        self.token_bytes = {r: t for t, r in ranks.items()}
        self.narrow, self.wide = splitters(pattern)
        self.is_wide = re.compile(f"[^\\x00-{chr(NARROW - 1)}]").search
        self.known: dict[str, tuple[int, ...]] = {}

    def pieces(self, text: str) -> list[str]:
        return self.wide(text) if self.is_wide(text) else self.narrow(text)

    def _learn(self, pieces: list[str]) -> None:
        chars, ranks, rest = self.chars, self.ranks, []
        for piece in pieces:
            data = piece.encode()
            if (whole := ranks.get(data)) is not None:
                self.known[piece] = (whole,)
            else:
                rest.append((piece, "".join([chars[b] for b in data])))
        for (piece, _), found in zip(rest, self.tokenizer.encode_batch_fast([x for _, x in rest], add_special_tokens=False), strict=True):
            self.known[piece] = tuple(found.ids)

    def encode(self, text: str) -> list[int]:
        pieces = self.pieces(text)
        if len(self.known) > MOST_PIECES:
            self.known.clear()
        if new := set(pieces).difference(self.known):
            self._learn(sorted(new))
        return list(chain.from_iterable(map(self.known.__getitem__, pieces)))

    def offsets(self, text: str, ids: list[int]) -> list[tuple[int, int]]:
        """For each id the code points it covers; ids that share a split character cover it both."""
        data = text.encode()
        starts: list[int] = []  # code point of each byte
        point = -1
        for b in data:
            point += b & 0xC0 != 0x80
            starts.append(point)
        out, at = [], 0
        for i in ids:
            n = len(self.token_bytes[i])
            out.append((starts[at], starts[at + n - 1] + 1))
            at += n
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_offsets: bool = False) -> DataFrame:
    """id, ids array<int>, and with ``with_offsets`` starts and ends (code points, end exclusive)."""
    rows = docs.select(id_col, text_col)
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            ids = [own.encode(t) for t in texts]
            cols = [batch.column(0), pa.array(ids, pa.list_(pa.int32()))]
            names = [id_col, "ids"]
            if with_offsets:
                spans = [own.offsets(t, i) for t, i in zip(texts, ids, strict=True)]
                cols += [pa.array([[s[k] for s in row] for row in spans], pa.list_(pa.int32())) for k in (0, 1)]
                names += ["starts", "ends"]
            yield pa.RecordBatch.from_arrays(cols, names)

    more = ", starts array<int>, ends array<int>" if with_offsets else ""
    return rows.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>{more}")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, data binary: the bytes of the ids, joined before they are read as text. Null ids: none."""
    rows = encoded.select(id_col, ids_col)
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            data = [own.decode(i or []) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], [id_col, "data"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256: encodes, decodes what it encoded, and keeps the digests.

    Both directions run in one pass, so ids and bytes of whole documents never leave the worker.
    """
    rows = docs.select(id_col, text_col)
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            counts, ids_hex, data_hex = [], [], []
            for value in batch.column(1):
                ids = own.encode(value.as_py() or "")
                counts.append(len(ids))
                ids_hex.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                data_hex.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex), pa.array(data_hex)], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Byte-level BPE over whole corpora without replaying merges.

A text is split by the tokenizer's pattern. A piece's bytes are read as Latin-1 characters,
so that one Aho-Corasick automaton over the vocabulary finds every token occurring in it.
The encoder then walks the piece from the longest token at each position; two adjacent
tokens are kept only if they are compatible, that is, if the merges turn their joined bytes
into just these two tokens. When a position cannot be continued, it is marked dead and the
walk backs up to the next shorter prefix token. Each position is marked at most once, so
the walk is linear in the piece; compatibility is memoised. A sequence whose adjacent pairs
are all compatible is the one the merges produce, hence the ids are exact.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _class(ok) -> str:
    """The members of a character class, as ranges, from the rule ``ok``."""
    codes = [c for c in range(0x110000) if ok(chr(c))]
    starts = [c for c, before in zip(codes, [-2, *codes]) if c != before + 1]
    ends = [c for c, after in zip(codes, [*codes[1:], -2]) if after != c + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True))


@lru_cache(maxsize=1)
def splitter():
    """The public split pattern of the byte-level vocabularies, which is
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

    Runs that are ASCII up to an ASCII neighbour take the first, cheap alternatives; they
    match what the general ones would.
    """
    letter = _class(lambda c: unicodedata.category(c)[0] == "L")
    number = _class(lambda c: unicodedata.category(c)[0] == "N")
    space = _class(lambda c: c.isspace() and not "\x1c" <= c <= "\x1f")
    plain = r"(?![^\x00-\x7f])"
    return re.compile(
        "'s|'t|'re|'ve|'m|'ll|'d"
        rf"| ?+[A-Za-z]++{plain}| ?+[0-9]++{plain}| ?+[!-/:-@\[-`{{-~]++(?![^ -~\t-\r])"
        rf"| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    ).findall


#: Default place of the vocabulary files; always a parameter.
VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_PIECES = 300_000  # cached pieces and pairs per Python worker; a full cache starts anew
_CACHED = 48  # characters of the longest piece that is cached


class BytePairEncoder:
    """Exact ids of a byte-level BPE given as token ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.size = {r: len(t) for t, r in ranks.items()}
        self.bytes = {r: t for t, r in ranks.items()}
        self.trie = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.trie.add_word(token.decode("latin-1"), rank)
        self.trie.make_automaton()
        self.shorter = {r: self._prefix(t) for t, r in ranks.items()}
        self.split = splitter()
        self.pieces: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def _prefix(self, token: bytes) -> int | None:
        return next((self.ranks[token[:i]] for i in range(len(token) - 1, 0, -1) if token[:i] in self.ranks), None)

    def _merge(self, data: bytes) -> list[int]:
        """The merges replayed on a few bytes; used for pairs of tokens only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= _PIECES:
                self.pairs.clear()
            known = self.pairs[left, right] = self._merge(self.bytes[left] + self.bytes[right]) == [left, right]
        return known

    def piece(self, text: str) -> tuple[int, ...]:
        data = text.encode("utf-8")
        if (whole := self.ranks.get(data)) is not None:
            return (whole,)
        n, size, shorter = len(data), self.size, self.shorter
        longest: list[int] = [-1] * n
        for end, rank in self.trie.iter(data.decode("latin-1")):
            at = end + 1 - size[rank]
            if longest[at] < 0 or size[rank] > size[longest[at]]:
                longest[at] = rank
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while True:
            end = at + size[token]
            if not dead[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                if end == n:
                    return tuple(out)
                at, token = end, longest[end]
                continue
            while (cut := shorter[token]) is None:
                dead[at] = 1
                token = out.pop()
                at -= size[token]
            token = cut

    def _ids(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = array("i", self.piece(piece)).tobytes()
            if len(piece) <= _CACHED:
                if len(self.pieces) >= _PIECES:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as native 32-bit integers, one after the other."""
        pieces = self.split(text)
        try:
            return b"".join(map(self.pieces.get, pieces))
        except TypeError:  # a piece that isn't cached
            return b"".join(map(self._ids, pieces))

    def count(self, text: str) -> int:
        return len(self.encode(text)) // 4


@lru_cache(maxsize=2)
def load(path: str) -> BytePairEncoder:
    """The encoder of a rank file, once per Python worker."""
    with open(path, "rb") as f:
        return BytePairEncoder({base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())})


def _rows(col: pa.Array) -> Iterator[str]:
    for i in range(0, len(col), 256):
        yield from col.slice(i, 256).to_pylist()


def encode_texts(df: DataFrame, id_col: str, text_col: str, vocab: str = VOCAB) -> DataFrame:
    """``[<id_col>, ids]``: the token ids of every row's whole text, without special tokens.

    An empty text and a null text both give an empty list; a null id is kept as null,
    repeated rows give repeated rows, an empty table none. Strings of special tokens in a
    text are ordinary text. Texts of any length are encoded whole. Other columns of the
    table, whatever their names, are not read. No shuffle.
    """
    src = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    kind = src.schema["i"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load(vocab)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):  # bounds the ids held at once
                part = b.slice(lo, 1024)
                ids = [enc.encode(t) if t else b"" for t in _rows(part.column(1))]
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["i", "ids"])

    return src.mapInArrow(run, f"i {kind}, ids array<int>").select(F.col("i").alias(id_col), "ids")


def count_tokens(df: DataFrame, id_col: str, text_col: str, vocab: str = VOCAB) -> DataFrame:
    """``[<id_col>, n_tokens]`` of every row; null and empty texts have 0 tokens."""
    src = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    kind = src.schema["i"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load(vocab)
        for b in batches:
            n = pa.array([enc.count(t) if t else 0 for t in _rows(b.column(1))], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n], ["i", "n_tokens"])

    return src.mapInArrow(run, f"i {kind}, n_tokens bigint").select(F.col("i").alias(id_col), "n_tokens")

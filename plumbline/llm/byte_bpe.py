"""Byte-level BPE in linear time: longest matches, backtracking, memoised seams.

The vocabulary is a rank file: tokens are bytes, lower ranks merge first. A
sequence of tokens is what BPE makes of its bytes exactly if every two adjacent
tokens are what BPE makes of theirs. So a piece is encoded from the left by the
longest token that starts at a place and is compatible with the one before; if
none is, the token before is replaced by a shorter one. A prefix has only one
encoding, hence a place found dead stays dead and every place is left once.
Longest tokens come from an Aho-Corasick automaton; it works on characters, so
bytes are mapped to Latin-1.

Texts are split by a pattern first and pieces are encoded apart; a piece that is
a token is that token. Encoded pieces and compatible pairs are remembered in
tables of bounded size.

Cases: a null or empty text has no tokens. Repeated rows are encoded alike.
Input columns named like a result are replaced.
"""

from __future__ import annotations

import base64
import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StringType, StructField

from plumbline.llm.common import add_columns, texts_of

PIECES = 500_000
SEAMS = 1_000_000
# White space as Unicode has it; the regex library's own class adds four control characters.
_SPACE = {r"\s": r"\p{White_Space}", r"\S": r"\P{White_Space}"}
_ENCODERS: dict[str, "Encoder"] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def splitter(pattern: str) -> regex.Pattern:
    inside = pattern
    for old, new in _SPACE.items():
        inside = inside.replace(f"[^{old}", f"[^{new}").replace(old, new)
    return regex.compile(inside)


class _Memo(dict):
    """Values computed on demand; emptied when full."""

    def __init__(self, compute, size):
        self.compute, self.size = compute, size

    def __missing__(self, key):
        if len(self) >= self.size:
            self.clear()
        value = self[key] = self.compute(key)
        return value


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.find = splitter(pattern).findall
        # Tokens that merges cannot reach stand only for a whole piece.
        reached = {t: r for t, r in ranks.items() if len(t) == 1 or self.merged(t) == [r]}
        self.automaton = ahocorasick.Automaton()
        for token, rank in reached.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.sizes = {rank: len(token) for token, rank in reached.items()}
        self.shorter = {
            rank: next((reached[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in reached), None)
            for token, rank in reached.items()
        }
        self.compatible = _Memo(self._compatible, SEAMS)
        self.pieces = _Memo(self._piece, PIECES)

    def merged(self, data: bytes) -> list[int]:
        """BPE as defined: merge the lowest rank, leftmost first, until none is left."""
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min(
                (ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)
            )
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _compatible(self, pair: tuple[int, int]) -> bool:
        left, right = pair
        return self.merged(self.tokens[left] + self.tokens[right]) == [left, right]

    def backtrack(self, data: bytes) -> list[int]:
        n, sizes, shorter, compatible = len(data), self.sizes, self.shorter, self.compatible
        longest = [None] * n
        found = [0] * n
        for end, (size, rank) in self.automaton.iter(data.decode("latin-1")):
            start = end - size + 1
            if size > found[start]:
                found[start], longest[start] = size, rank
        out, at, dead = [], 0, bytearray(n + 1)
        token = longest[0] if n else None
        while at < n:
            while token is not None:
                if not dead[at + sizes[token]] and (not out or compatible[out[-1], token]):
                    break
                token = shorter[token]
            if token is None:
                if not out:
                    raise ValueError("the vocabulary does not cover all bytes")
                dead[at] = 1
                last = out.pop()
                at -= sizes[last]
                token = shorter[last]
            else:
                out.append(token)
                at += sizes[token]
                token = longest[at] if at < n else None
        return out

    def _piece(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.ranks.get(data)
        ids = [whole] if whole is not None else self.backtrack(data)
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoder(ranks: dict[bytes, int], pattern: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    sample = repr((len(ranks), pattern, sorted(ranks.items(), key=lambda x: x[1])[-50:]))
    key = hashlib.sha256(sample.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(ranks, pattern)
    return _ENCODERS[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256, decoded_sha256 and, if wanted, the ids themselves."""
    shared = docs.sparkSession.sparkContext.broadcast((read_ranks(ranks_path), pattern))
    fields = [
        StructField("n_tokens", LongType()),
        StructField("ids_sha256", StringType()),
        StructField("decoded_sha256", StringType()),
        *([StructField("ids", BinaryType())] if with_ids else []),
    ]

    def compute(batch):
        own = encoder(*shared.value)
        counts, ids_sha, decoded_sha, kept = [], [], [], []
        for text in texts_of(batch, "text"):
            ids = own.encode(text.decode("utf-8", "replace"))
            counts.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            decoded_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
            if with_ids:
                kept.append(ids)
        columns = [pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
        return columns + ([pa.array(kept, pa.binary())] if with_ids else [])

    return add_columns(docs, fields, compute)

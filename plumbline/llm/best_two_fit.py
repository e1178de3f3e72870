"""Packing documents into sequences of a fixed size: greedy fill, then two for one.

A sequence is filled with the longest piece that still fits, again and again.
Then its shortest piece is given back and two unpacked pieces take its place if
together they leave a smaller gap.

Only lengths matter for that, and there are at most ``size`` different ones. So
the plan is made on the counts per length: a pattern of lengths is repeated while
every one of its lengths lasts, which gives the same sequences as filling them
one by one. Patterns number a few per length, whatever the number of documents.
Every piece then looks up its place by its rank among the pieces of its length;
ranks are counted in buckets, so a length that many pieces share is spread out.

Cases: a null or empty text is the end token alone. Repeated rows are packed as
often as they occur, a null id like any other. Longer documents are cut into
pieces of ``size`` tokens. No documents give no rows.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from plumbline.llm.common import ship, texts_of
from plumbline.operators.ordering import running_totals
from plumbline.session import written_table

SIZE = 2048
END = 0
WORDS = 200_000
BUCKET_ROWS = 50_000
_GROUP = 4 << 20
# Texts of a batch are copied and encoded this many at a time.
_ROWS = 500
_SPACE = re.compile(rb"[ \t-\r]")
# Lead bytes of combining marks that letters A-Z compose with.
_MARKS = re.compile(rb"[\xcc\xcd]")
_PLAIN = re.compile("([a-zà-öø-ÿ]+)([.,]?)")


class Words:
    """A tokenizer and a table of the words it has encoded, one per Python worker and file."""

    _known: dict[str, "Words"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.ids: dict[bytes, bytes] = {}
        letters = [chr(c) for c in range(256) if _PLAIN.fullmatch(chr(c))]
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in letters})
        self.ends = {c: self.tokenizer.encode(c, add_special_tokens=False).ids for c in ".,"} | {"": []}

    @classmethod
    def of(cls, path: str) -> "Words":
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def learn(self, words: list[bytes]) -> None:
        """Encode new words. Those of small letters, with a stop or comma at most, are single
        pieces of the tokenizer's own splitting and need only its merges."""
        merges, rest = self.tokenizer.model.tokenize, []
        for word in words:
            plain = _PLAIN.fullmatch(word.decode("utf-8", "replace"))
            if plain:
                ids = [t.id for t in merges(plain[1].translate(self.letters))] + self.ends[plain[2]]
                self.ids[word] = np.array(ids, "<u4").tobytes()
            else:
                rest.append(word)
        for i in range(0, len(rest), 10_000):
            some = rest[i : i + 10_000]
            texts = [w.decode("utf-8", "replace") for w in some]
            for word, found in zip(some, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                self.ids[word] = np.array(found.ids, "<u4").tobytes()


def parts_of(text: bytes) -> Iterator[bytes]:
    """A text in parts of bounded size, cut at white space."""
    at = 0
    while len(text) - at > _GROUP:
        space = _SPACE.search(text, at + _GROUP)
        if not space:
            break
        yield text[at : space.start()]
        at = space.end()
    yield text[at:]


def encode_parts(parts: list[bytes], path: str) -> list[bytes]:
    """Ids as little-endian unsigned 32-bit integers.

    The tokenizer drops white space and no token reaches across it, so words are
    encoded once and remembered. It puts letters into lower case itself, after
    composing them; where there are no combining marks, that may be done before.
    """
    table = Words.of(path)
    known = table.ids
    words = [(p if _MARKS.search(p) else p.lower()).split() for p in parts]
    if len(known) > WORDS:
        known.clear()
    found = [list(map(known.get, w)) for w in words]
    table.learn([*{w for row, ids in zip(words, found) if None in ids for w, x in zip(row, ids) if x is None}])
    return [b"".join(map(known.__getitem__, w) if None in ids else ids) for w, ids in zip(words, found)]


def encode(texts: list[bytes], path: str) -> Iterator[bytes]:
    """The ids of each text, encoded in groups of bounded size."""
    group, n = [], 0
    for text in texts:
        if len(text) > _GROUP:
            yield from encode_parts(group, path)
            group, n = [], 0
            yield b"".join(encode_parts([part], path)[0] for part in parts_of(text))
            continue
        group.append(text)
        n += len(text)
        if n > _GROUP:
            yield from encode_parts(group, path)
            group, n = [], 0
    yield from encode_parts(group, path)


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document with its end token, cut at ``size``."""
    ship(docs.sparkSession)
    end = np.array([END], "<u4").tobytes()

    def run(batches):
        for batch in (b.slice(at, _ROWS) for b in batches for at in range(0, b.num_rows, _ROWS)):
            rows = []
            for key, ids in zip(batch.column("doc_id").to_pylist(), encode(texts_of(batch, "text"), tokenizer)):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    rows.append((key, k, at // 4, len(part) // 4, zlib.crc32(part)))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*rows) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


class _Stock:
    """Unpacked pieces by length."""

    def __init__(self, counts: dict[int, int]):
        self.left = {k: n for k, n in counts.items() if n > 0}
        self.lengths = sorted(self.left)

    def take(self, length: int, n: int) -> None:
        self.left[length] = self.left.get(length, 0) - n
        if not self.left[length]:
            del self.left[length]
            self.lengths.pop(bisect.bisect_left(self.lengths, length))

    def give(self, length: int, n: int) -> None:
        if length not in self.left:
            bisect.insort(self.lengths, length)
        self.left[length] = self.left.get(length, 0) + n

    def longest(self, room: int) -> int:
        at = bisect.bisect_right(self.lengths, room)
        return self.lengths[at - 1] if at else 0

    def two(self, room: int) -> tuple[int, int]:
        """The two pieces that fill ``room`` best, the longer first; zeros if there are none."""
        lengths = np.array(self.lengths[: bisect.bisect_right(self.lengths, room)], np.int64)
        if not len(lengths):
            return 0, 0
        at = np.searchsorted(lengths, room - lengths, side="right") - 1
        alone = (at >= 0) & (lengths[at] == lengths)
        for i in np.flatnonzero(alone):
            if self.left[int(lengths[i])] < 2:
                at[i] -= 1
        sums = np.where(at >= 0, lengths + lengths[at], 0)
        best = int(np.argmax(sums))
        if not sums[best]:
            return 0, 0
        a, b = int(lengths[best]), int(lengths[at[best]])
        return max(a, b), min(a, b)


def pattern(stock: _Stock, size: int) -> dict[int, int]:
    """Lengths of the next sequence and how often each occurs in it; taken from the stock."""
    used: dict[int, int] = {}
    gap = size
    while length := stock.longest(gap):
        n = min(gap // length, stock.left[length])
        stock.take(length, n)
        used[length] = used.get(length, 0) + n
        gap -= n * length
    if gap and used:
        small = min(used)
        a, b = stock.two(gap + small)
        if a + b > small:
            used[small] -= 1
            stock.give(small, 1)
            for x in (a, b):
                stock.take(x, 1)
                used[x] = used.get(x, 0) + 1
    return {k: n for k, n in used.items() if n}


def plan(counts: dict[int, int], size: int = SIZE) -> np.ndarray:
    """Rows (length, first rank, repeats, first sequence, offset), sorted by length and rank.

    The pieces of that length from the first rank on go to ``repeats`` sequences
    in turn, once each; a further use in the same sequences follows in rank.
    """
    stock, rank, rows, sequence = _Stock(counts), dict.fromkeys(counts, 0), [], 0
    while stock.left:
        used = pattern(stock, size)
        # The same choices come again as long as every length used lasts.
        more = min(stock.left.get(k, 0) // n for k, n in used.items())
        for k, n in used.items():
            if more:
                stock.take(k, n * more)
        offset = 0
        for k, n in sorted(used.items(), reverse=True):
            rows.append((k, rank[k], more + 1, sequence, offset))
            rank[k] += n * (more + 1)
            offset += n * k
        sequence += more + 1
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``."""
    cut = written_table(pieces(docs, tokenizer, size), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    slots = plan(counts, size)
    shared = docs.sparkSession.sparkContext.broadcast(slots)
    buckets = -(-sum(counts.values()) // BUCKET_ROWS) or 1
    order = ["doc_id", "piece", "start", "ids_crc32"]
    ranked = running_totals(
        cut, ["length"], order, F.pmod(F.xxhash64(*order), F.lit(buckets)), {"rank": F.lit(1).cast("long")}
    )

    def run(batches):
        rows = shared.value
        keys = (rows[:, 0] << 48) + rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 48) + rank - 1, side="right") - 1
            _, first, repeats, sequence, offset = rows[at].T
            place = rank - 1 - first
            columns = [batch.column(c) for c in names] + [
                pa.array(sequence + place % repeats), pa.array(offset + place // repeats * length)
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    names = cut.columns
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select(*names, "rank").mapInArrow(run, schema)

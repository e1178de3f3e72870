"""Language-model scores from a weighted backoff automaton.

States are contexts of up to ``ORDER - 1`` tokens that the training texts hold. A
state has an arc for every token seen after it and a failure arc to the state of
the context without its first token. With c the count of a context, n that of the
context with the token, and m a fixed weight, the arc weighs
(n + m * lower) / (c + m), where ``lower`` is the weight of the same token's arc one
state down, and the failure arc weighs m / (c + m). The lowest state gives known
tokens their share of the training tokens and keeps for the one class of unknown
tokens the share of tokens seen once. All probabilities of a state add up to 1.

One walk from left to right carries the state: a token takes its arc or fails to
shorter contexts until one has it, and the logarithms add up. As the state after
a token is the longest known context that ends there, the walk over a block of
texts runs on arrays.

The automaton grows with the corpus, so it is never held whole. Texts are dealt
into blocks. A block sends its different n-grams with their training counts to
shards by hash range; a shard adds up all blocks and answers each with the totals
of its n-grams, in the same order. That is the part of the automaton which the
block's texts can reach. Counts leave a block added up, so a very common n-gram
costs a row per block at most.

Cases: a null or empty text is the end token alone. A null id counts as the empty
text when the fold is chosen. Repeated rows count and are scored as often as they
occur. Without training texts every token is unknown and has probability 1.

N-grams are compared by 64-bit hashes. Both passes must see the rows in the same
partitions, as they do over stored files; if not, the checksums of blocks differ
and the job fails. ``documents`` that are not stored should be written first.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import ship, texts_of
from plumbline.session import written_table

ORDER = 3
# Weight of the lower state, in tokens, for contexts of one token and of two; chosen on held-out texts.
WEIGHTS = (3000.0, 5.0)
FOLDS, HELD_OUT = 5, 1
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 12 << 20
_END = xxhash.xxh64_intdigest(b"", 1)
_BEGIN = xxhash.xxh64_intdigest(b"", 2)
_NARROW = 6
_ROWS = 500

ASKED = "shard int, block long, grams int, n long, checksum long, keys binary, counts binary"
ANSWERED = (
    "block long, grams int, shard int, checksum long, counts binary, tokens long, types long, singles long"
)
SCORED = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
    "base_score double, score double"
)


@dataclass
class Totals:
    """Training tokens, their distinct number, and those seen once."""

    tokens: int
    types: int
    singles: int


def folded(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, text)"""
    number = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (number % FOLDS == HELD_OUT).alias("held_out"),
        F.col("text").cast("binary").alias("text"),
    )


def _mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = left * np.uint64(0x9E3779B97F4A7C15) + right
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def marked_tokens(text: bytes) -> np.ndarray:
    """Hashes of a text's tokens, led by the begin mark; its words are not kept."""
    words = text.lower().split()
    out = np.empty(len(words) + 2, np.uint64)
    out[0], out[-1] = _BEGIN, _END
    out[1:-1] = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=0), words), np.uint64, len(words))
    return out


class Grams:
    """The n-grams of some texts: ``keys[k]`` sorted, ``at[k]`` the place of each token's own.

    Tokens lie one after the other, each text led by a begin mark. ``ok[k]`` tells
    where an n-gram of k tokens lies within one text.
    """

    def __init__(self, texts: list[bytes], order: int = ORDER):
        parts = [marked_tokens(t) for t in texts]
        sizes = np.array([len(p) for p in parts], np.int64)
        tokens = np.concatenate(parts)
        del parts
        self.starts = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
        place = np.arange(len(tokens)) - np.repeat(self.starts, sizes)
        self.sizes, self.real = sizes, place > 0
        self.ok, self.keys, self.at = {}, {}, {}
        gram = tokens
        for k in range(1, order + 1):
            if k > 1:
                gram = _mix(np.r_[gram[:1], gram[:-1]], tokens)
            self.ok[k] = self.real & (place >= k - 1)
            self.keys[k], inside = np.unique(gram[self.ok[k]], return_inverse=True)
            self.at[k] = np.zeros(len(tokens), np.int32)
            self.at[k][self.ok[k]] = inside

    def counts(self, k: int, wanted: np.ndarray) -> np.ndarray:
        """How often each n-gram of k tokens occurs in the wanted texts."""
        weight = (np.repeat(wanted, self.sizes) & self.ok[k])[self.ok[k]]
        return np.bincount(self.at[k][self.ok[k]][weight], minlength=len(self.keys[k]))


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences in as few bytes as they need."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    rest = steps[1:]
    width = _NARROW if not len(rest) or int(rest.max()) < 1 << 8 * _NARROW else 8
    narrow = rest.view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + steps[:1].tobytes() + narrow.tobytes()


def unpacked_keys(data: bytes) -> np.ndarray:
    width = data[0]
    rest = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(rest) + 1, 8), np.uint8)
    steps[1:, :width] = rest
    steps[0] = np.frombuffer(data, np.uint8, count=8, offset=1)
    return np.cumsum(steps.reshape(-1).view("<u8"), dtype=np.uint64)


def packed_counts(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype("<u8").tobytes(), 1)


def unpacked_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), "<u8").astype(np.int64)


def checksum(texts: list[bytes]) -> int:
    """The same for the same texts in any order."""
    return sum(map(zlib.crc32, texts)) * 1_000_003 % (1 << 40) + len(texts)


def _blocks(batches, block_bytes):
    """(block, ids, held_out, texts) of bounded size, numbered within the partition."""
    base, number = TaskContext.get().partitionId() << 24, 0
    ids, held, texts, size = [], [], [], 0
    for part in (b.slice(at, _ROWS) for b in batches for at in range(0, b.num_rows, _ROWS)):
        for key, out, text in zip(
            part.column("doc_id").to_pylist(), part.column("held_out").to_pylist(), texts_of(part, "text")
        ):
            ids.append(key)
            held.append(out)
            texts.append(text)
            size += len(text)
            if size >= block_bytes:
                yield base + number, ids, held, texts
                ids, held, texts, size, number = [], [], [], 0, number + 1
    if texts:
        yield base + number, ids, held, texts


def asked(docs: DataFrame, shards: int, order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The different n-grams of each block with their training counts, a row per shard."""
    bounds = np.array([(i << 64) // shards for i in range(1, shards)], np.uint64)

    def run(batches):
        for block, _, held, texts in _blocks(batches, block_bytes):
            grams, train, check = Grams(texts, order), ~np.array(held, bool), checksum(texts)
            for k in range(1, order + 1):
                keys, counts = grams.keys[k], grams.counts(k, train)
                cuts = np.r_[0, np.searchsorted(keys, bounds), len(keys)].tolist()
                rows = [
                    (s, block, k, b - a, check, packed_keys(keys[a:b]), packed_counts(counts[a:b]))
                    for s, (a, b) in enumerate(zip(cuts, cuts[1:]))
                    if b > a
                ]
                if not rows:
                    continue
                types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(zip(*rows), types)],
                    names=[c.split()[0] for c in ASKED.split(", ")],
                )

    return docs.mapInArrow(run, ASKED)


def answered(asks: DataFrame) -> DataFrame:
    """For each block and shard the training totals of its n-grams, in the order asked."""

    def add_up(group: pa.Table) -> pa.Table:
        rows, out = group.to_pylist(), []
        for k in sorted({r["grams"] for r in rows}):
            own = [r for r in rows if r["grams"] == k]
            keys, inside = np.unique(np.concatenate([unpacked_keys(r["keys"]) for r in own]), return_inverse=True)
            totals = np.zeros(len(keys), np.int64)
            np.add.at(totals, inside, np.concatenate([unpacked_counts(r["counts"]) for r in own]))
            at = 0
            for i, r in enumerate(own):
                mine = totals[inside[at : at + r["n"]]]
                at += r["n"]
                # The totals of single tokens go with the first answer of the shard.
                sums = [totals.sum(), (totals > 0).sum(), (totals == 1).sum()] if k == 1 and not i else [0, 0, 0]
                out.append((r["block"], k, r["shard"], r["checksum"], packed_counts(mine), *map(int, sums)))
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.Table.from_arrays(
            [pa.array(list(c), t) for c, t in zip(zip(*out), types)],
            names=[c.split()[0] for c in ANSWERED.split(", ")],
        )

    return asks.groupBy("shard").applyInArrow(add_up, ANSWERED)


def walk(
    grams: Grams, totals: dict[int, np.ndarray], corpus: Totals, weights: tuple[float, ...] = WEIGHTS
) -> np.ndarray:
    """log10 probability of every token along the automaton; 0 at begin marks."""
    order = len(grams.keys)
    # The zero at the end stands for places without an n-gram of that length.
    count = {k: np.append(totals[k], 0)[np.where(grams.ok[k], grams.at[k], -1)] for k in totals}
    # A begin mark is a context as often as texts end.
    ends = int(totals[1][np.searchsorted(grams.keys[1], np.uint64(_END))]) if len(grams.keys[1]) else 0
    context = {1: np.where(grams.real, count[1], ends)} | {k: count[k] for k in range(2, order)}
    unseen = (corpus.singles + 1) / (corpus.tokens + 2) if corpus.tokens else 1.0
    # Arcs of the lowest state.
    arc = np.where(count[1] > 0, (1 - unseen) * count[1] / max(corpus.tokens, 1), unseen)
    logs = np.log10(arc)
    for k in range(2, order + 1):
        # The state of k - 1 tokens that the walk is in before each token; 0 if there is none.
        seen = np.where(grams.ok[k], np.r_[0, context[k - 1][:-1]], 0)
        failure = weights[k - 2] / (seen + weights[k - 2])
        taken = count[k] > 0
        arc = np.where(taken, (count[k] + weights[k - 2] * arc) / (seen + weights[k - 2]), failure * arc)
        logs = np.where(taken, np.log10(arc), logs + np.log10(failure))
    return np.where(grams.real, logs, 0.0)


def scored(
    docs: DataFrame, answers: DataFrame, corpus: Totals, order: int, weights: tuple[float, ...], block_bytes: int
) -> DataFrame:
    def deal(batches):
        for block, ids, held, texts in _blocks(batches, block_bytes):
            for at in range(0, len(ids), 1000):
                part = slice(at, at + 1000)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block] * len(ids[part]), pa.int64()),
                        pa.array(ids[part], pa.int64()),
                        pa.array(held[part], pa.bool_()),
                        pa.array([zlib.compress(t, 6) for t in texts[part]], pa.binary()),
                    ],
                    names=["block", "doc_id", "held_out", "packed"],
                )

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = [zlib.decompress(x) for x in left.column("packed").to_pylist()]
        grams = Grams(texts, order)
        rows = sorted(right.select(["grams", "shard", "checksum", "counts"]).to_pylist(), key=lambda r: r["shard"])
        totals = {
            k: np.concatenate([unpacked_counts(r["counts"]) for r in rows if r["grams"] == k] or [np.zeros(0, np.int64)])
            for k in range(1, order + 1)
        }
        if {r["checksum"] for r in rows} != {checksum(texts)} or any(
            len(totals[k]) != len(grams.keys[k]) for k in totals
        ):
            raise RuntimeError("documents were not in the same partitions twice; write them to files first")
        known = np.where(grams.real, totals[1][grams.at[1]], 0)
        base = np.log10((known + 0.5) / (corpus.tokens + 0.5 * (corpus.types + 1)))
        sums = [
            np.add.reduceat(x, grams.starts)
            for x in ((known > 0).astype(np.int64), np.where(grams.real, base, 0.0), walk(grams, totals, corpus, weights))
        ]
        return pa.Table.from_arrays(
            [
                left.column("doc_id"), left.column("held_out"), pa.array(grams.sizes - 1), pa.array(sums[0]),
                pa.array(np.full(len(texts), corpus.tokens, np.int64)), pa.array(sums[1]), pa.array(sums[2]),
            ],
            names=[c.split()[0] for c in SCORED.split(", ")],
        )

    dealt = docs.mapInArrow(deal, "block long, doc_id long, held_out boolean, packed binary")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, SCORED)


def score_documents(
    docs: DataFrame,
    order: int = ORDER,
    weights: tuple[float, ...] = WEIGHTS,
    block_bytes: int = BLOCK_BYTES,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Scores of all texts by a model of those that are not held out."""
    ship(docs.sparkSession)
    own = folded(docs)
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    answers = written_table(answered(asked(own, max(1, -(-size // shard_bytes)), order, block_bytes)), "gram-counts")
    sums = answers.agg(F.sum("tokens"), F.sum("types"), F.sum("singles")).first()
    corpus = Totals(*[x or 0 for x in sums])
    return scored(own, answers.select("block", "grams", "shard", "checksum", "counts"), corpus, order, weights, block_bytes)

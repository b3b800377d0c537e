"""Masked pseudo-likelihood by a bidirectional window network, trained in numpy.

Tokens are words and single other signs, lower-cased and known by a hash of their characters. Those that make up
``OWN_SHARE`` of all tokens of the corpus or more, and the ``VOCABULARY`` most frequent ones in any case (``MOST`` at
most), have numbers of their own; the rest share ``BUCKETS`` hashed numbers. The network sees ``SIDE`` tokens on either
side of a position, never the token itself: their embeddings go through a hidden layer, from which it predicts the
token's class among ``CLASSES`` (of like frequency), and then, by a vector for each token, the token within its class. A
token of a bucket has its part of the bucket's probability: the rare tokens are hashed into ``CELLS`` cells, and each
token of a cell has an equal share of the cell's count, which is the token's own count unless it shares the cell; one
count in each bucket is kept for tokens never seen. log p(token | both sides) is the sum of these; a document's score is
the sum over all its tokens.

Counts are taken over all documents. Texts are cut into tokens once more and written as numbers; scoring and training read
those. Training takes every position once: pieces of the texts are dealt by their hashes to shards of like size, whose
number follows the corpus's tokens alone, and shards to rounds. In a round every shard trains a copy of the network,
its pieces in the order of their hashes, and the copies' steps (and the learner's paces) are averaged block by block on
the executors before the next round starts. So the result does not hang on how the table is split or ordered, and more
text means more rounds, up to ROUNDS, and then more copies in each. What is gathered grows with the corpus, what the
driver holds does not.

Defined cases: a null, empty or blank text has no tokens, score 0 and a null mean; very long texts go in stretches, cut
between tokens; repeated rows are scored one by one; a null doc_id is carried through; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import bounded_batches, materialize
from cairn.llm.suffix_dedup import mix

VOCABULARY = 4000
#: Tokens of at least this share of the corpus have numbers of their own, MOST of them at most.
OWN_SHARE = 2e-5
MOST = 12_000
BUCKETS = 95
#: Each cell is of one bucket.
CELLS = BUCKETS * 44_000
CLASSES = 32
SIDE = 3
WIDTH = 16
HIDDEN = 16
#: Rounds at most; tokens of a shard while there are fewer rounds, and beyond; copies of a round at most, beyond which
#: shards grow instead.
ROUNDS = 24
SMALL_SHARD, SHARD = 1 << 16, 1 << 20
COPIES = 4096
#: Tokens of a piece of a long text.
PIECE = 1 << 16
RATE = 0.1
#: Tokens of one step, and characters that are cut into tokens at a time.
STEP = 16384
STRETCH = 1 << 18
#: Tokens that one task counts before it passes them on, and numbers of a block of parameters or cells.
HELD_TOKENS = 4_000_000
BLOCK = 1 << 14
#: Where the seen tokens stand from the first of them on.
PLACES = (*range(SIDE), *range(SIDE + 1, 2 * SIDE + 1))
U64 = np.uint64
BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """By code point: 0 white space, 1 part of a word, 2 another sign."""
    out = np.full(0x110000, 2, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalnum() or c == "_":
            out[i] = 1
        elif c.isspace():
            out[i] = 0
    return out


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, U64), np.full(n, pow(BASE, -1, 1 << 64), U64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


def _cut(points: np.ndarray) -> np.ndarray:
    """The hashes of the tokens in a stretch of code points: a polynomial of the characters, from running sums."""
    kind = kinds()[points]
    word = kind == 1
    start = kind == 2
    start[0] |= word[0]
    start[1:] |= word[1:] & ~word[:-1]
    end = kind == 2
    end[-1] |= word[-1]
    end[:-1] |= word[:-1] & ~word[1:]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = powers(max(STRETCH * 2, 1 << (len(points) + 1).bit_length()))
    sums = np.zeros(len(points) + 1, U64)
    np.cumsum(mix(points.astype(U64) * U64(0xD1342543DE82EF95) + U64(1)) * up[: len(points)], out=sums[1:])
    return mix((sums[e] - sums[s]) * down[s])


def tokens(text: str | None) -> np.ndarray:
    """The hashes of the text's tokens."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out, at = [np.zeros(0, U64)], 0
    while at < len(points):
        end = min(at + STRETCH, len(points))
        while end < len(points) and kinds()[points[end - 1]] == 1 and kinds()[points[end]] == 1:  # to the end of the word
            end += 1
        out.append(_cut(points[at:end]))
        at = end
    return np.concatenate(out) if len(out) != 2 else out[1]


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, n) over all documents, by the tokens' hashes; each task adds up what it has before anything moves."""

    def batch(held):
        token, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], ["token", "n"])

    def run(batches):
        held, size = [np.zeros(0, U64)], 0
        for b in batches:
            for t in b.column(0):
                held.append(tokens(t.as_py()))
                size += len(held[-1])
                if size > HELD_TOKENS:
                    yield batch(held)
                    held, size = [np.zeros(0, U64)], 0
        yield batch(held)

    own = docs.select(F.col("text").cast("string")).mapInArrow(run, "token long, n long")
    return own.groupBy("token").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """Numbers 1.. by falling count; 0 stands beyond a document's ends."""

    words: np.ndarray  # hashes, ascending
    own: np.ndarray  # their numbers
    bucket: np.ndarray  # the buckets' numbers
    counts: np.ndarray  # by number - 1
    first: np.ndarray  # the first number of each class, and one past the last
    cells: np.ndarray  # by cell, the log of a rare token's count

    def __post_init__(self) -> None:
        self.class_of = np.zeros(len(self.counts) + 1, np.uint8)
        self.is_bucket = np.zeros(len(self.counts) + 1, bool)
        self.is_bucket[self.bucket] = True
        self.class_of[1:] = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        mass = np.add.reduceat(self.counts, self.first[:-1] - 1)
        self.log_class = np.log(mass / mass.sum())
        self.log_within = np.log(self.counts / np.repeat(mass, np.diff(self.first)))

    def numbers(self, own: np.ndarray) -> np.ndarray:
        """The numbers of tokens given by their hashes."""
        at = np.minimum(np.searchsorted(self.words, own), len(self.words) - 1)
        return np.where(self.words[at] == own, self.own[at], self.bucket[own % U64(BUCKETS)]).astype(np.int32)

    def rare_logs(self, own: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """For each token the log of its part of its bucket's probability; 0 for one with a number of its own."""
        out = np.zeros(len(own))
        rare = np.flatnonzero(self.is_bucket[numbers])
        out[rare] = self.cells[cell_of(own[rare])] - np.log(self.counts[numbers[rare] - 1])
        return out


def cell_of(own: np.ndarray) -> np.ndarray:
    return (own % U64(CELLS)).astype(np.int64)


def lexicon(counts: DataFrame, size: int | None = None) -> Lexicon:
    """From counts of the whole corpus; the words (MOST at most), BUCKETS sums and CELLS numbers come to the driver."""
    if size is None:
        total = counts.agg(F.sum("n")).first()[0] or 0
        size = min(MOST, max(VOCABULARY, counts.where(F.col("n") >= OWN_SHARE * total).count() if total else 0))
    top = counts.orderBy(F.desc("n"), "token").limit(size).toArrow()
    words, n = top.column("token").to_numpy().view(U64), top.column("n").to_numpy()
    sent = counts.sparkSession.sparkContext.broadcast(np.sort(words))

    def rare(batches):
        for b in batches:
            own, n, known = b.column(0).to_numpy().view(U64), b.column(1).to_numpy(), sent.value
            at = np.searchsorted(known, own)
            left = np.append(known, U64(0))[at] != own
            left |= at == len(known)
            cell = cell_of(own[left])
            yield pa.RecordBatch.from_arrays([pa.array(cell // BLOCK), pa.array(cell % BLOCK), pa.array(cell % BUCKETS), pa.array(n[left])], ["block", "cell", "bucket", "n"])

    others = counts.select("token", "n").mapInArrow(rare, "block long, cell long, bucket long, n long")
    each = materialize(others.groupBy("block", "cell", "bucket").agg(F.sum("n").alias("n"), F.count("*").alias("types")), "cells")  # CELLS rows at most
    cells = np.zeros(CELLS, np.float32)
    share = np.ones(BUCKETS)  # one each, so that an unseen token has some chance

    def log_block(table):
        cell = table.column("cell").to_numpy()
        mass, types = (np.bincount(cell, table.column(c).to_numpy(), BLOCK) for c in ("n", "types"))
        out = np.log(np.maximum(mass, 1) / np.maximum(types, 1)).astype(np.float32)
        return pa.table([pa.array([table.column("block")[0].as_py()], pa.int64()), pa.array([out.tobytes()], pa.binary())], ["block", "logs"])

    for r in each.groupBy("block").applyInArrow(log_block, "block long, logs binary").toLocalIterator():
        at = r["block"] * BLOCK
        cells[at : at + BLOCK] = np.frombuffer(r["logs"], np.float32)[: CELLS - at]
    for r in each.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        share[r["bucket"]] += r["n"]
    every = np.concatenate([n, share])
    by = np.argsort(-every, kind="stable")
    number = np.empty(len(by), np.int64)
    number[by] = np.arange(1, len(by) + 1)
    every = every[by]
    # Classes of nearly equal mass of the root of the count, by falling count.
    mass = np.cumsum(np.sqrt(every))
    class_of = np.minimum(CLASSES - 1, (CLASSES * (mass - mass[0] * 0.5) / mass[-1]).astype(int))
    first = np.append(np.flatnonzero(np.concatenate([[True], class_of[1:] != class_of[:-1]])), len(every)) + 1
    order = np.argsort(words)
    return Lexicon(words[order], number[: len(words)][order], number[len(words) :], every, first, cells)


class Network:
    """Embeddings, hidden layer, classes and tokens, all in one flat array."""

    def __init__(self, words: Lexicon, flat: np.ndarray | None = None) -> None:
        n, c = len(words.counts), len(words.first) - 1
        shapes = [(n + 1, WIDTH), (2 * SIDE * WIDTH, HIDDEN), (HIDDEN,), (HIDDEN, c), (c,), (n, HIDDEN), (n,)]
        sizes = [int(np.prod(s)) for s in shapes]
        fresh = flat is None
        if fresh:
            flat = np.zeros(sum(sizes), np.float32)
        self.flat, self.parts, at = flat, [], 0
        for s, size in zip(shapes, sizes):
            self.parts.append(flat[at : at + size].reshape(s))
            at += size
        if fresh:
            rng = np.random.default_rng(11)
            self.parts[0][1:] = rng.normal(0, 0.3, (n, WIDTH))
            self.parts[1][:] = rng.normal(0, (2 * SIDE * WIDTH) ** -0.5, shapes[1])
            self.parts[4][:] = words.log_class
            self.parts[6][:] = words.log_within

    def hidden(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids: numbers with SIDE further ones at both ends. Their embeddings, and the inner positions' hidden layer."""
        n = len(ids) - 2 * SIDE
        seen = self.parts[0][ids]
        z = np.broadcast_to(self.parts[2], (n, HIDDEN)).copy()
        for k, o in enumerate(PLACES):
            z += seen[o : o + n] @ self.parts[1][k * WIDTH : (k + 1) * WIDTH]
        return seen, np.tanh(z, out=z)


def by_class(class_of: np.ndarray):
    """The order by class, and (class, first, last + 1) of each in it."""
    order = np.argsort(class_of, kind="stable")
    counts = np.bincount(class_of)
    ends = np.cumsum(counts)
    return order, [(c, int(ends[c] - counts[c]), int(ends[c])) for c in np.flatnonzero(counts).tolist()]


def log_likelihoods(ids: np.ndarray, words: Lexicon, net: Network) -> np.ndarray:
    """log p(number | both sides) of each inner position of ids; 0 where the number is 0."""
    _, _, _, out, out_bias, vectors, bias = net.parts
    _, h = net.hidden(ids)
    own = ids[SIDE : len(ids) - SIDE]
    cls = words.class_of[own]
    y = h @ out + out_bias
    y -= y.max(axis=1, keepdims=True)
    total = y[np.arange(len(own)), cls]
    total -= np.log(np.exp(y, out=y).sum(axis=1))
    order, runs = by_class(cls)
    sorted_h, sorted_own = h[order], own[order]
    for c, s, e in runs:
        a, b = words.first[c] - 1, words.first[c + 1] - 1
        if b - a > 1:
            y = sorted_h[s:e] @ vectors[a:b].T + bias[a:b]
            y -= y.max(axis=1, keepdims=True)
            at = np.maximum(sorted_own[s:e] - 1 - a, 0)
            part = y[np.arange(e - s), at]
            total[order[s:e]] += part - np.log(np.exp(y, out=y).sum(axis=1))
    return np.where(own > 0, total, 0.0)


class Learner:
    """Steps of AdaGrad on the mean log-loss; its paces are one flat array, to be carried on."""

    def __init__(self, words: Lexicon, net: Network, paces: np.ndarray | None = None) -> None:
        self.words, self.net = words, net
        shapes = [p.shape[:1] if i in (0, 5) else p.shape for i, p in enumerate(net.parts)]
        sizes = [int(np.prod(s)) for s in shapes]
        self.paces = np.full(sum(sizes), 1e-8, np.float32) if paces is None else paces
        ends = np.cumsum(sizes)
        self.seen = [self.paces[e - n : e].reshape(s) for s, n, e in zip(shapes, sizes, ends)]

    def move(self, i: int, rows, gradient: np.ndarray) -> None:
        part, seen = self.net.parts[i], self.seen[i]
        square = gradient * gradient
        if i in (0, 5):  # one pace for each token
            seen[rows] += square.mean(axis=1)
            part[rows] -= RATE * gradient / np.sqrt(seen[rows])[:, None]
        else:
            seen[rows] += square
            part[rows] -= RATE * gradient / np.sqrt(seen[rows])

    def step(self, ids: np.ndarray) -> None:
        words, net = self.words, self.net
        _, inner, _, out, out_bias, vectors, bias = net.parts
        seen, h = net.hidden(ids)
        own = ids[SIDE : len(ids) - SIDE]
        real = own > 0
        n = max(1, int(real.sum()))
        cls = words.class_of[own]
        rows = np.arange(len(own))
        y = h @ out + out_bias
        y -= y.max(axis=1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(axis=1, keepdims=True)
        y[rows, cls] -= 1
        y *= (real / np.float32(n)).astype(np.float32)[:, None]
        dh = y @ out.T
        d_out, d_out_bias = h.T @ y, y.sum(axis=0)
        order, runs = by_class(cls)
        sorted_h, sorted_own, sorted_real = h[order], own[order], real[order]
        dh_within = np.zeros_like(sorted_h)
        for c, s, e in runs:
            a, b = words.first[c] - 1, words.first[c + 1] - 1
            if b - a > 1:
                y = sorted_h[s:e] @ vectors[a:b].T + bias[a:b]
                y -= y.max(axis=1, keepdims=True)
                np.exp(y, out=y)
                y /= y.sum(axis=1, keepdims=True)
                y[np.arange(e - s), np.maximum(sorted_own[s:e] - 1 - a, 0)] -= 1
                y *= (sorted_real[s:e] / np.float32(n)).astype(np.float32)[:, None]
                dh_within[s:e] = y @ vectors[a:b]
                self.move(5, slice(a, b), y.T @ sorted_h[s:e])
                self.move(6, slice(a, b), y.sum(axis=0))
        dh[order] += dh_within
        dz = dh * (1 - h * h)
        back, d_inner = np.zeros_like(seen), np.empty_like(inner)
        for k, o in enumerate(PLACES):
            part = slice(k * WIDTH, (k + 1) * WIDTH)
            d_inner[part] = seen[o : o + len(own)].T @ dz
            back[o : o + len(own)] += dz @ inner[part].T
        by = np.argsort(ids.astype(np.uint16), kind="stable")
        begin = np.flatnonzero(np.concatenate([[True], ids[by][1:] != ids[by][:-1]]))
        which, sums = ids[by][begin], np.add.reduceat(back[by], begin, axis=0)
        some = which > 0  # what stands beyond the ends stays 0
        self.move(0, which[some], sums[some])
        self.move(1, slice(None), d_inner)
        self.move(2, slice(None), dz.sum(axis=0))
        self.move(3, slice(None), d_out)
        self.move(4, slice(None), d_out_bias)


def stretches(texts: list[np.ndarray], step: int = STEP):
    """The numbers of several texts, SIDE zeros between them, in stretches of about ``step`` inner positions with their
    surroundings. Yields (stretch, where its first inner position stands in all)."""
    gap = np.zeros(SIDE, np.int32)
    whole = np.concatenate([gap, *(x for t in texts for x in (t, gap))])
    for at in range(0, max(0, len(whole) - 2 * SIDE), step):
        yield whole[at : at + step + 2 * SIDE], at


def coded(docs: DataFrame, words: Lexicon) -> DataFrame:
    """(doc_id, key, n_tokens, rare, numbers) for every row of docs, written: a hash of the row, the number of its tokens,
    the sum of their parts of buckets' probabilities as logs, and their numbers, two bytes each."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(words)

    def run(batches):
        lexicon = sent.value
        for b in batches:
            rare, numbers, n = [], [], []
            for t in b.column(2):
                own = tokens(t.as_py())
                found = lexicon.numbers(own)
                n.append(len(own))
                rare.append(float(lexicon.rare_logs(own, found).sum()))
                numbers.append(found.astype(np.uint16).tobytes())
            columns = [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(rare, pa.float64()), pa.array(numbers, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n_tokens", "rare", "numbers"])

    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text, F.col("doc_id").cast("long")).alias("key"), text)
    return materialize(own.mapInArrow(run, "doc_id long, key long, n_tokens long, rare double, numbers binary"), "coded")


def read_numbers(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint16).astype(np.int32)


def rounds_of(total: int) -> tuple[int, int]:
    """Rounds, and shards of each, for a corpus of so many tokens."""
    rounds = min(ROUNDS, max(1, -(-total // SMALL_SHARD)))
    return rounds, min(COPIES, max(1, -(-total // (SHARD * rounds))))


def shards(numbered: DataFrame, rounds: int, copies: int) -> DataFrame:
    """(round, shard, key, numbers): the pieces of all texts, written by round, those of a shard together."""

    def run(batches):
        for b in batches:
            keys, pieces = [], []
            for key, numbers in zip(b.column(0).to_pylist(), b.column(1)):
                raw = numbers.as_buffer()
                for i, at in enumerate(range(0, raw.size, 2 * PIECE)):
                    keys.append((key + i * BASE) % (1 << 64))
                    pieces.append(raw.slice(at, min(2 * PIECE, raw.size - at)).to_pybytes())
            own = mix(np.array(keys, U64))
            place = own % U64(rounds * copies)
            columns = [(place % U64(rounds)).astype(np.int32), (place // U64(rounds)).astype(np.int32), (own >> U64(1)).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(pieces, pa.binary())], ["round", "shard", "key", "numbers"])

    pieces = numbered.select("key", "numbers").mapInArrow(run, "round int, shard int, key long, numbers binary")
    return materialize(pieces.repartition("round", "shard"), "shards", "round")


def train_round(own: DataFrame, words: Broadcast, net: Network, paces: np.ndarray, copies: int) -> tuple[Network, np.ndarray]:
    """own: (shard, key, numbers) of one round; words: a lexicon, which may be without cells. Each shard trains a copy; the new network and paces are the old ones and
    the copies' mean steps, weighted by positions."""
    flat = np.concatenate([net.flat, paces])
    sent = own.sparkSession.sparkContext.broadcast(flat)
    size = len(net.flat)
    starts = range(0, len(flat), BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, flat = words.value, sent.value
        moved = flat.copy()
        learner = Learner(lexicon, Network(lexicon, moved[:size]), moved[size:])
        seen, held, waiting = 0, [], 0

        def learn():
            for ids, _ in stretches(held):
                learner.step(ids)

        for b in batches:
            for numbers in b.column("numbers"):
                held.append(read_numbers(numbers))
                waiting += len(held[-1])
                if waiting >= 8 * STEP:
                    learn()
                    seen, held, waiting = seen + waiting, [], 0
        learn()
        seen += waiting
        steps = [((moved[s : s + BLOCK].astype(np.float64) - flat[s : s + BLOCK]) * seen).astype(np.float32).tobytes() for s in starts]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(starts)), pa.int32()), pa.array([float(seen)] * len(starts)), pa.array(steps, pa.binary())], ["block", "seen", "moved"])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # of one block
        block, seen, total = 0, 0.0, 0.0
        for b in batches:
            for at, n, step in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                block, seen = at, seen + n
                total = total + np.frombuffer(step.as_buffer(), np.float32).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([(total / seen).astype(np.float32).tobytes()], pa.binary())], ["block", "moved"])

    ordered = own.repartition(2 * copies, "shard").sortWithinPartitions("shard", "key")
    trained = ordered.select("shard", "numbers").groupBy("shard").applyInArrow(run, "block int, seen double, moved binary")
    for r in trained.groupBy("block").applyInArrow(mean, "block int, moved binary").toLocalIterator():  # one network in all
        moved = np.frombuffer(r["moved"], np.float32)
        flat[r["block"] * BLOCK : r["block"] * BLOCK + len(moved)] += moved
    sent.destroy()  # a round's copies of the network don't stay on the executors
    return Network(words.value, flat[:size]), flat[size:]


def train_coded(numbered: DataFrame, words: Lexicon) -> Network:
    total = numbered.agg(F.sum("n_tokens")).first()[0] or 0
    rounds, copies = rounds_of(total)
    own = shards(numbered, rounds, copies)
    net = Network(words)
    paces = Learner(words, net).paces
    sent = numbered.sparkSession.sparkContext.broadcast(replace(words, cells=words.cells[:0]))
    for number in range(rounds):
        net, paces = train_round(own.where(F.col("round") == number), sent, net, paces, copies)
    return net


def train(docs: DataFrame, words: Lexicon) -> Network:
    """The network after all rounds, which take every position of every document once."""
    bounded_batches(docs.sparkSession)
    return train_coded(coded(docs, words), words)


def pseudo_likelihood(docs: DataFrame, model: tuple[Lexicon, Network] | None = None) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) for every row of docs; trained on docs if no model is given."""
    spark = docs.sparkSession
    bounded_batches(spark)
    words = lexicon(materialize(token_counts(docs), "token-counts")) if model is None else model[0]
    numbered = coded(docs, words)
    flat = (train_coded(numbered, words) if model is None else model[1]).flat
    sent = spark.sparkContext.broadcast((replace(words, cells=words.cells[:0]), flat))  # of fixed size

    def run(batches):
        lexicon, flat = sent.value
        net = Network(lexicon, flat)
        for b in batches:
            held = [read_numbers(x) for x in b.column(3)]
            sums = np.zeros(len(held))
            begin = np.cumsum([0, *(len(x) + SIDE for x in held)])  # of each text among the inner positions
            for ids, at in stretches(held):
                own = np.concatenate([[0.0], np.cumsum(log_likelihoods(ids, lexicon, net))])
                first, last = np.searchsorted(begin, [at, at + len(own) - 1], "right")
                for i in range(first - 1, min(last, len(held))):
                    a, z = np.clip([begin[i] - at, begin[i] + len(held[i]) - at], 0, len(own) - 1)
                    sums[i] += own[z] - own[a]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sums + b.column(2).to_numpy(), pa.float64())], ["doc_id", "n_tokens", "log_likelihood"])

    own = numbered.select("doc_id", "n_tokens", "rare", "numbers")
    scored = own.mapInArrow(run, "doc_id long, n_tokens long, log_likelihood double")
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return scored.select("doc_id", "n_tokens", "log_likelihood", mean.alias("mean_log_likelihood"))

"""Benchmark decontamination by CGK random walks, bit-sampling LSH and exact edit distance.

Texts and items become words (runs of letters and digits, lower-cased). An item of m words is leaked by a window of
words whose word edit distance to it is at most floor((1 - similarity) * m). Windows of an item's size are embedded by
the CGK random walk, which copies the current word and moves on or stays as a shared random bit of (step, word) says:
edit distance becomes Hamming distance. Repeated bit sampling finds candidates: each of several tables samples a few
steps of one of ``WALKS`` walks, and a window is a candidate of the items in its cell. Half of the walks go backward from
the windows' ends, as edits at a window's beginning throw the forward ones off. Candidates are verified by an exact edit
distance that may begin and end anywhere in the window's surroundings.

An item of over ``LONG`` words is looked for by the blocks of at most so many words that it is cut into: one of them has
no more than its share of the edits, so no length is too long for the walks.

Windows that no item can match are not embedded: within e edits a window of m words keeps m - e words and m - 1 - 2 e
pairs of neighbours of the item, so it holds at least so many words and pairs that occur in the benchmark at all. This
says nothing about which item it is and drops no window that the verification would keep.

The sampled steps and tables follow from ``recall``: an item at the largest distance, by substitutions, insertions and
deletions alike, is found with that probability, a closer one with more. Items are handled in groups of at most
``GROUP_ITEMS`` items and ``GROUP_WORDS`` words (an item with more words is a group of its own), so what is sent to the
executors is bounded; more items mean more passes over the documents.

Defined cases: null or wordless texts and items are never leaked; items shorter than five words are only found
unchanged; repeated rows of documents are judged one by one; repeated items count once by (item_id, text); null ids
are carried through; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import bounded_batches

SIMILARITY = 0.8
RECALL = 0.999
GROUP_ITEMS = 20_000
GROUP_WORDS = 2_000_000
LONG = 64
#: Walks of each direction.
WALKS = 16
#: Steps of a walk that one table samples at most, and tables at most: as many steps as the recall leaves.
SAMPLED = 3
MAX_TABLES = 512
TRIALS = 400
#: Classes of words with bits of their own at each step.
CLASSES = 1021
#: Blocks within this ratio of size share their tables.
BAND = 1.25
#: Windows that are embedded at a time, characters that are cut into words at a time, and words searched at a time.
WINDOWS = 512
STRETCH = 1 << 20
BATCH_WORDS = 1 << 20
WORD = re.compile(r"[^\W_]+")
BREAK = re.compile(r"[\W_]")
ODD = np.array([0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9], np.uint64)


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def stretches(text: str | None, size: int = STRETCH) -> Iterator[str]:
    """The text cut between words into stretches of about ``size`` characters."""
    at, text = 0, text or ""
    while at < len(text):
        m = BREAK.search(text, at + size)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


def allowed(m: int, similarity: float = SIMILARITY) -> int:
    """Edits that an item of m words may have."""
    return 0 if m < 5 else int((1 - similarity) * m + 1e-9)


def blocks_of(m: int, e: int) -> list[tuple[int, int, int]]:
    """(start, words, edits) of the blocks by which an item is looked for: one of them has at most that many edits."""
    n = -(-m // LONG)
    cuts = [m * i // n for i in range(n + 1)]
    return [(a, b - a, e // n) for a, b in zip(cuts, cuts[1:])]


def walk_bits() -> np.ndarray:
    """The shared random bits of each walk, by step and class of words."""
    return np.random.default_rng(7).integers(0, 2, (2 * LONG, WALKS, CLASSES)).astype(np.int8)


def walks(ids: np.ndarray, starts: np.ndarray, bits: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The CGK embeddings of what stands in ids from each start on, by each walk: the words copied at the given steps
    (ascending), as steps x walks x starts. ids goes on for as many words as there are steps.

    bits[t, w, c]: whether walk w moves on after copying a word of class c at step t.
    """
    kinds = (ids % bits.shape[2]).astype(np.intp)
    place = np.repeat(starts[None].astype(np.intp), bits.shape[1], axis=0)
    row = (np.arange(bits.shape[1]) * bits.shape[2])[:, None]
    out, k, at = np.empty((len(steps), *place.shape), ids.dtype), 0, np.empty_like(place)
    for t in range(int(steps[-1]) + 1 if len(steps) else 0):
        if steps[k] == t:
            np.take(ids, place, out=out[k], mode="clip")
            k += 1
        np.take(kinds, place, out=at, mode="clip")
        at += row
        place += np.take(bits[t].reshape(-1), at)
    return out


def edited(rng: np.random.Generator, m: int, e: int, width: int) -> np.ndarray:
    """The words 1 to m after e edits, a third of each kind, and strange words up to width. The edits' places are random in
    two of three cases and side by side in the third, often at an end."""
    kinds, places = rng.integers(0, 3, e), np.sort(rng.choice(m, e, replace=False))
    if rng.integers(0, 3) == 0:
        places = np.arange(e) + rng.choice([0, m - e, rng.integers(0, m - e + 1)])
    own = np.arange(1, m + 1)
    own[places[kinds == 0]] = rng.integers(m + 1, 1 << 20, (kinds == 0).sum())
    own[places[kinds == 1]] = -1
    own = np.insert(own, places[kinds == 2], rng.integers(m + 1, 1 << 20, (kinds == 2).sum()))
    return np.concatenate([own[own > 0], rng.integers(m + 1, 1 << 20, width)])[:width]


@lru_cache(maxsize=None)
def agreement(m: int, e: int, within: int) -> np.ndarray:
    """walks (of both directions) x trials: the share of the first 2 * ``within`` steps that outlive e edits of a block of m
    words, measured on ``TRIALS`` invented blocks: walks drift apart more than the edits alone say."""
    rng, width = np.random.default_rng(11), 4 * LONG
    own = [np.arange(1, m + 1), *(edited(rng, m, e, m + e) for _ in range(TRIALS))]
    agree = []
    for turn in (1, -1):
        rows = rng.integers(m + 1, 1 << 20, (TRIALS + 1, width))
        rows[0] = 0
        for row, ws in zip(rows, own):
            ws = ws[(ws <= m) | (np.arange(len(ws)) <= np.flatnonzero(ws <= m)[-1])][::turn]  # without strangers at the end
            row[: len(ws)] = ws
        codes = walks(rows.reshape(-1), np.arange(TRIALS + 1) * width, walk_bits(), np.arange(2 * within))
        agree.append((codes[:, :, 1:] == codes[:, :, :1]).mean(axis=0))
    return np.concatenate(agree)


@lru_cache(maxsize=None)
def tables_for(sizes: tuple[tuple[int, int], ...], recall: float = RECALL) -> tuple[int, int]:
    """(steps sampled for a table, tables of each direction) that find blocks of each of the (words, edits) with the given probability, by
    steps that the walk of the shortest one makes before its end. As many steps are sampled as ``MAX_TABLES`` allow."""
    within = min(m for m, _ in sizes)
    agree = [agreement(m, e, within) for m, e in sizes if e]
    for sampled in range(min(SAMPLED, 2 * within), 0, -1):
        for each in range(1, MAX_TABLES // WALKS + 1):
            if all(np.prod((1 - a**sampled) ** each, axis=0).mean() <= 1 - recall for a in agree):
                return sampled, WALKS * each if agree else 1
    return 1, MAX_TABLES


def edit_anywhere(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edits that turn some stretch of text into item, and the stretch's end."""
    if not len(text):
        return len(item), 0
    step = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, w in enumerate(item, 1):
        nxt = np.empty_like(row)
        nxt[0] = i
        nxt[1:] = np.minimum(row[:-1] + (text != w), row[1:] + 1)
        row = np.minimum.accumulate(nxt - step) + step
    end = int(row.argmin())
    return int(row[end]), end


def cells(codes: np.ndarray, steps: np.ndarray, picks: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """codes: steps x walks x rows. rows x tables: one number for what each table samples of each of the rows."""
    tables = np.arange(len(picks))
    out = np.zeros((len(picks), len(rows)), np.uint64)
    for i in range(picks.shape[1]):
        own = codes[np.searchsorted(steps, picks[:, i])[:, None], (tables % codes.shape[1])[:, None], rows]
        out = (out ^ own.astype(np.uint64)) * ODD[i]
        out ^= out >> np.uint64(29)
    return (out * ODD[3] + tables[:, None].astype(np.uint64)).T


@dataclass
class Band:
    """Blocks of like size, which share their tables."""

    sizes: tuple[tuple[int, int], ...]  # words and edits that occur
    items: np.ndarray  # item and offset of each block
    picks: np.ndarray  # tables x sampled steps
    keys: np.ndarray  # cells in order
    owner: np.ndarray  # the block of each

    def needs(self) -> tuple[int, int, int]:
        """Words of the longest window; least words and pairs of the benchmark in any window that matches."""
        return max(m + e for m, e in self.sizes), min(m - e for m, e in self.sizes), min(max(0, m - 1 - 2 * e) for m, e in self.sizes)


class Side:
    """The tables of one direction; rows are the items' word numbers in that direction."""

    def __init__(self, rows: list[np.ndarray], similarity: float, recall: float) -> None:
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for k, row in enumerate(rows):
            for a, size, e in blocks_of(len(row), allowed(len(row), similarity)):
                found.setdefault((size, e), []).append((k, a))
        self.pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *(r[:-1] << 32 | r[1:] for r in rows)]))
        self.bits = walk_bits()
        rng = np.random.default_rng(13)
        grouped: list[list[tuple[int, int]]] = []
        for size in sorted(found):
            # Short blocks, and those that may have no edits, share with their equals only.
            if grouped and size[0] <= grouped[-1][0][0] * BAND and size[0] > 8 and size[1] and grouped[-1][0][1]:
                grouped[-1].append(size)
            else:
                grouped.append([size])
        self.bands, steps = [], set()
        for sizes in grouped:
            sampled, tables = tables_for(tuple(sizes), recall)
            # After twice its length a walk has mostly passed the block's end.
            picks = np.stack([np.sort(rng.choice(2 * sizes[0][0], sampled, replace=False)) for _ in range(tables)])
            steps |= set(picks.reshape(-1).tolist())
            own = [b for size in sizes for b in found[size]]
            lengths = [size[0] for size in sizes for _ in found[size]]
            whole = np.zeros((len(own), 4 * LONG), np.int64)
            for row, (k, a), m in zip(whole, own, lengths):
                row[:m] = rows[k][a : a + m]
            at = np.unique(picks)
            parts = [np.arange(i, min(i + WINDOWS, len(own))) for i in range(0, len(own), WINDOWS)]
            keys = np.concatenate([cells(walks(whole.reshape(-1), p * 4 * LONG, self.bits, at), at, picks, np.arange(len(p))) for p in parts]).reshape(-1)
            by = np.argsort(keys, kind="stable")
            self.bands.append(Band(tuple(sizes), np.array(own, np.int64), picks, keys[by], by // tables))
        self.steps = np.array(sorted(steps), np.int64)

    def windows(self, ids: np.ndarray, count: int) -> list[np.ndarray]:
        """For each band the first ``count`` starts in ids of windows with enough words and pairs of the benchmark."""
        n = len(ids)
        pair = ids[:-1] << 32 | ids[1:]
        some = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        known = np.zeros(n + 1, np.int32)
        at = np.searchsorted(self.pairs, pair[some])
        known[some + 1] = np.append(self.pairs, -1)[at] == pair[some]
        known, single = np.cumsum(known), np.concatenate([[0], np.cumsum(ids > 0)])

        def enough(starts, longest, words, pairs):
            end = np.minimum(starts + longest, n)
            held = single[end] - single[starts] >= words
            if pairs:
                held &= known[np.maximum(end - 1, starts)] - known[starts] >= pairs
            return held

        out = []
        for band in self.bands:
            starts = np.arange(min(count, n))
            starts = starts[enough(starts, *band.needs())]
            held = np.zeros(len(starts), bool)
            for m, e in band.sizes:
                held |= enough(starts, m + e, m - e, max(0, m - 1 - 2 * e))
            out.append(starts[held])
        return out

    def candidates(self, ids: np.ndarray) -> np.ndarray:
        """(item, start) of each item that a table proposes for a window in ids; start is where the whole item would be."""
        out = [np.zeros((0, 2), np.int64)]
        for first in range(0, len(ids), BATCH_WORDS):
            near = ids[first : first + BATCH_WORDS + 2 * LONG].astype(np.int64)
            out += [found + [0, first] for found in self._proposed(near)]
        return np.unique(np.concatenate(out), axis=0)

    def _proposed(self, ids: np.ndarray) -> Iterator[np.ndarray]:
        padded = np.concatenate([ids, np.zeros(2 * LONG, np.int64)])
        starts = self.windows(ids, BATCH_WORDS)
        every = np.unique(np.concatenate([np.zeros(0, np.int64), *starts]))
        for at in range(0, len(every), WINDOWS):  # one walk serves all bands
            part = every[at : at + WINDOWS]
            codes = walks(padded, part, self.bits, self.steps)
            for band, own in zip(self.bands, starts):
                own = own[np.searchsorted(own, part[0]) : np.searchsorted(own, part[-1], "right")]
                if not len(own):
                    continue
                cell = cells(codes, self.steps, band.picks, np.searchsorted(part, own))
                lo = np.searchsorted(band.keys, cell)
                row, table = np.nonzero(np.append(band.keys, np.uint64(0))[lo] == cell)
                lo = lo[row, table]
                count = np.searchsorted(band.keys, cell[row, table], "right") - lo
                place = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
                hit = np.unique(np.repeat(row, count) * len(band.items) + band.owner[place])
                item = band.items[hit % len(band.items)]
                yield np.stack([item[:, 0], own[hit // len(band.items)] - item[:, 1]], axis=1)


@dataclass
class Index:
    """What the executors need to find the items of one group."""

    items: list[tuple[int | None, list[str]]]
    similarity: float
    recall: float
    vocabulary: dict[str, int] = field(default_factory=dict)
    rows: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        for _, ws in self.items:
            self.rows.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws], np.int64))
        self.sides = [Side(self.rows, self.similarity, self.recall), Side([r[::-1] for r in self.rows], self.similarity, self.recall)]

    def candidates(self, ids: np.ndarray) -> np.ndarray:
        """(item, start) of each item that a table proposes for a window in ids; start is where the whole item would be."""
        lengths = np.array([len(r) for r in self.rows])
        ahead, back = self.sides[0].candidates(ids), self.sides[1].candidates(ids[::-1])
        back[:, 1] = len(ids) - back[:, 1] - lengths[back[:, 0]]
        return np.unique(np.concatenate([ahead, back]), axis=0)

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(text, item, edits, first word) for each leaked item of each text, with the fewest edits, then leftmost."""
        get = self.vocabulary.get
        own = [np.concatenate([np.zeros(0, np.int32), *(np.fromiter((get(w, 0) for w in words(part)), np.int32) for part in stretches(t))]) for t in texts]
        out, first = [], 0
        while first < len(own):  # many short texts are searched together, a word that is in no item between them
            last, n = first, 0
            while last < len(own) and (last == first or n + len(own[last]) < BATCH_WORDS):
                n += len(own[last]) + 1
                last += 1
            ids = np.concatenate([x for t in own[first:last] for x in (t, np.zeros(1, np.int32))])
            ends = np.cumsum([len(t) + 1 for t in own[first:last]])
            found = self.candidates(ids)
            # A proposed start may lie before its text: the word that it was proposed for tells the text.
            for k in np.unique(found[:, 0]).tolist():
                row, e = self.rows[k], allowed(len(self.rows[k]), self.similarity)
                out += self._verified(k, row, e, found[found[:, 0] == k, 1], ends, own, first)
            first = last
        return sorted(out)

    def _verified(self, k: int, row: np.ndarray, e: int, starts: np.ndarray, ends: np.ndarray, own: list, first: int) -> list[tuple]:
        """The texts among own that hold the item near one of the starts; starts near each other are verified at once."""
        m, best = len(row), {}
        at = 0
        while at < len(starts):
            until = int(np.searchsorted(starts, starts[at] + m + e, "right"))
            low, high = int(starts[at]) - e, int(starts[until - 1]) + m + 2 * e
            for i in range(int(np.searchsorted(ends, max(low, 0), "right")), min(len(ends) - 1, int(np.searchsorted(ends, max(high, 0), "right"))) + 1):
                begin = int(ends[i]) - len(own[first + i]) - 1
                a = max(0, low - begin)
                edits, end = edit_anywhere(row, own[first + i][a : max(0, high - begin)])
                if edits <= e and (i not in best or edits < best[i][0]):
                    best[i] = (edits, max(0, a + end - m))
            at = until
        return [(first + i, k, *b) for i, b in best.items()]

def item_groups(benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> Iterator[Index]:
    """The items by groups, each as the index that one pass over the documents takes; the driver holds one at a time."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL").distinct()
    held, size = [], 0
    for r in items.orderBy("item_id", "text").toLocalIterator():
        if ws := words(r["text"]):
            if held and (len(held) == GROUP_ITEMS or size + len(ws) > GROUP_WORDS):
                yield Index(held, similarity, recall)
                held, size = [], 0
            held.append((r["item_id"], ws))
            size += len(ws)
    if held:
        yield Index(held, similarity, recall)


def contamination(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(doc_id, item_id, window_start, edits, similarity): one row for each leaked item of each document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, item_id long, window_start long, edits int, similarity double"

    def pass_over(index: Index) -> DataFrame:
        sent = spark.sparkContext.broadcast(index)  # bounded by GROUP_ITEMS and GROUP_WORDS

        def run(batches):
            for b in batches:
                docs, rows = b.column(0).to_pylist(), []
                for i, k, edits, start in sent.value.find(b.column(1).to_pylist()):
                    item, ws = sent.value.items[k]
                    rows.append((docs[i], item, start, edits, 1 - edits / len(ws)))
                columns = list(zip(*rows)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "window_start", "edits", "similarity"])

        return own.mapInArrow(run, schema)

    passes = [pass_over(g) for g in item_groups(benchmark, similarity, recall)]
    return reduce(DataFrame.union, passes) if passes else spark.createDataFrame([], schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The rows of docs whose text holds no item; no join, each row is judged where it is."""
    spark = docs.sparkSession
    bounded_batches(spark)
    at = docs.columns.index("text")
    for index in item_groups(benchmark, similarity, recall):
        sent = spark.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[f[0] for f in sent.value.find(b.column(at).to_pylist())]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

"""Substring deduplication by seeds and their extension.

A window is ``LENGTH`` consecutive words of one document. A word goes if a window that covers it also starts in a
document with a smaller doc_id; windows are judged on the input.

1. Seeds. Of each window the least hash of its ``SEED``-word strings (the leftmost, if equal) is its anchor, so that equal
   windows have equal anchors at equal places, and neighbouring windows mostly share one: one seed for about five words.
2. Join. Seeds are added up over all documents: the smallest and the largest doc_id, and the smallest and the largest
   hash of what lies around, that is of all words of the windows that have this anchor. A seed of one document alone
   joins nothing. The others are joined with their places.
3. Extension. Where all surroundings of a seed are equal, each match extends both ways over all of its windows. Where
   they differ, each place is extended by the 0 to LENGTH - SEED words on its left that leave the rest on its right: the
   strings of LENGTH words so made are added up by two hashes (128 bits), with the smallest doc_id of each.
4. Maximal repeats. The windows that a smaller doc_id has too are joined to runs; a run cannot be made longer.

No pairs of documents are made: a string that n documents share gives n rows. Sums by seed and by string are begun before
rows move; the join on seeds has each seed once on one side, so that Spark can split the other. Long texts are cut into
pieces of ``PIECE`` words that overlap by LENGTH - 1 words.

Defined cases: a null or empty text, or one without a word, has no words and keeps the empty text; texts under LENGTH words stay
whole; rows that repeat a doc_id, with the same or other texts, count as that document and are returned one by one; a
null doc_id comes after all others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import bounded_batches, materialize

LENGTH = 13
SEED = 5
PIECE = 100_000
#: Bytes hashed at a time.
CHUNK = 1 << 20
LAST_ID = (1 << 63) - 1
U64 = np.uint64
#: Odd multipliers of the two hashes of strings of words.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(32))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(29))


_held: dict = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    if base not in _held or len(_held[base][0]) < n:
        up, down = np.full(max(n, CHUNK + 1), base, U64), np.full(max(n, CHUNK + 1), pow(base, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        _held[base] = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
    return _held[base]


class Strings:
    """Hashes of any stretch of a sequence of values, from prefix sums."""

    def __init__(self, values: np.ndarray, base: int) -> None:
        up, self.down = powers(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64))


def byte_values(which: int) -> np.ndarray:
    return np.random.default_rng(which).integers(1, 1 << 63, 256, np.int64).astype(U64) * U64(2) + U64(1)


BYTES = [byte_values(1), byte_values(2)]


class Words:
    """The words of some pieces of texts one after the other, and the hashes of stretches of them."""

    def __init__(self, pieces: list[bytes]) -> None:
        data = np.frombuffer(b"\n".join([*pieces, b""]), np.uint8)
        space = np.concatenate([[True], SPACE[data]])
        turn = np.flatnonzero(space[1:] != space[:-1])
        start, end = turn[::2], turn[1::2]
        size = np.array([len(p) + 1 for p in pieces])
        self.piece = np.repeat(np.arange(len(pieces)), size)[start]
        self.strings = [Strings(Strings(v[data], b).of(start, end), b) for v, b in zip(BYTES, BASES)]
        self.first = np.searchsorted(self.piece, np.arange(len(pieces)))  # of each piece

    def windows(self, length: int) -> np.ndarray:
        """Those within one piece."""
        n = len(self.piece) - length + 1
        return np.flatnonzero(self.piece[: max(0, n)] == self.piece[length - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def anchors(self, length: int, seed: int) -> tuple[np.ndarray, ...]:
        """(piece, first window, last window, seed's hash, hash of what lies around), windows counted within the piece."""
        w = self.windows(length)
        if not len(w):
            return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, U64, U64))
        at = np.arange(len(self.piece) - seed + 1)
        value = self.strings[0].of(at, at + seed)
        width, have = length - seed + 1, 1
        while have < width:  # the leftmost least of the next ``have`` places, then of more
            step = min(have, width - have)
            one, two = at[:-step], at[step:]
            at = np.where(value[one] <= value[two], one, two)
            have += step
        a, piece = at[w], self.piece[w]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (piece[1:] != piece[:-1])]))
        last = np.concatenate([new[1:], [len(w)]]) - 1
        first, last, a, piece = w[new], w[last], a[new], piece[new]
        around = self.strings[1].of(first, last + length)
        return piece, first - self.first[piece], last - self.first[piece], value[a], around


def pieces(texts: list[bytes | None], length: int, piece: int = PIECE):
    """(index of the text, number of its first word, bytes)."""
    for i, text in enumerate(texts):
        if not text:
            continue
        if len(text) <= piece:
            yield i, 0, text
            continue
        words = text.split()
        for at in range(0, max(1, len(words) - length + 1), piece):
            yield i, at, b" ".join(words[at : at + piece + length - 1])


def chunks(texts: list[bytes | None], length: int, piece: int = PIECE):
    """Lists of pieces of about CHUNK bytes together."""
    held, size = [], 0
    for p in pieces(texts, length, piece):
        held.append(p)
        size += len(p[2])
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def found_in(texts: list[bytes | None], length: int, seed: int, piece: int) -> list[np.ndarray]:
    """Of all anchors: index of the text, first and last window, the two hashes."""
    out: list[list[np.ndarray]] = [[] for _ in range(5)]
    for part in chunks(texts, length, piece):
        of, first, last, value, around = Words([p[2] for p in part]).anchors(length, seed)
        text, base = (np.array([p[k] for p in part], np.int64) for k in (0, 1))
        for o, x in zip(out, (text[of], first + base[of], last + base[of], value.view(np.int64), around.view(np.int64))):
            o.append(x)
    return [np.concatenate(o) if o else np.zeros(0, np.int64) for o in out]


def own_texts(docs: DataFrame) -> DataFrame:
    """(doc, name, text): doc is LAST_ID where doc_id is null, name tells apart texts of one doc_id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), F.xxhash64(text).alias("name"), text.cast("binary").alias("text"))


def seed_rows(texts: DataFrame, length: int, seed: int, piece: int, places: bool) -> DataFrame:
    """A row for each anchor: (doc, seed, around), or with places (doc, name, seed, first, last)."""

    def run(batches):
        for b in batches:
            text, first, last, value, around = found_in(b.column("text").to_pylist(), length, seed, piece)
            doc, name = (b.column(c).to_numpy()[text] for c in ("doc", "name"))
            if places:
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(name), pa.array(value), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["doc", "name", "seed", "first", "last"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(value), pa.array(around)], ["doc", "seed", "around"])

    return texts.mapInArrow(run, "doc long, name long, seed long, first int, last int" if places else "doc long, seed long, around long")


def shared_seeds(texts: DataFrame, length: int, seed: int, piece: int) -> DataFrame:
    """(seed, least, alike): seeds of more than one doc_id, the smallest one, and whether all surroundings are equal."""
    rows = seed_rows(texts, length, seed, piece, False)
    sums = rows.groupBy("seed").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.min("around").alias("one"), F.max("around").alias("two"))
    return sums.where("least < most").select("seed", "least", (F.col("one") == F.col("two")).alias("alike"))


def matched_places(texts: DataFrame, shared: DataFrame, length: int, seed: int, piece: int) -> DataFrame:
    """(doc, name, sure, open): of each text the stretches of windows (first, last) that are repeats, and those to extend
    step by step."""
    joined = seed_rows(texts, length, seed, piece, True).join(shared, "seed").where("NOT alike OR least < doc")
    span = F.struct("first", "last")
    return joined.groupBy("doc", "name").agg(F.collect_set(F.when(F.col("alike"), span)).alias("sure"), F.collect_set(F.when(~F.col("alike"), span)).alias("open"))


def extended(texts: DataFrame, matches: DataFrame, length: int, piece: int) -> DataFrame:
    """(doc, name, one, two, at): every window of the open stretches by its two hashes."""
    schema = "doc long, name long, one long, two long, at int"

    def run(batches):
        for b in batches:
            texts, open_ = b.column("text").to_pylist(), b.column("open").to_pylist()
            docs, names = b.column("doc").to_numpy(), b.column("name").to_numpy()
            for part in chunks(texts, length, piece):
                words = Words([p[2] for p in part])
                of, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for k, (i, base, _) in enumerate(part):
                    end = words.first[k + 1] if k + 1 < len(part) else len(words.piece)
                    n = end - words.first[k] - length + 1
                    spans = np.array([(s["first"], s["last"] + 1) for s in open_[i]], np.int64).reshape(-1, 2) - base
                    spans = np.clip(spans, 0, max(0, n))
                    size = spans[:, 1] - spans[:, 0]
                    at.append(np.repeat(spans[:, 0] - np.cumsum(size) + size, size) + np.arange(size.sum()))
                    of.append(np.full(size.sum(), k))
                of, at = np.concatenate(of), np.concatenate(at)
                text, base = (np.array([p[k] for p in part], np.int64)[of] for k in (0, 1))
                start = at + words.first[of]
                one, two = (s.of(start, start + length).view(np.int64) for s in words.strings)
                yield pa.RecordBatch.from_arrays([pa.array(docs[text]), pa.array(names[text]), pa.array(one), pa.array(two), pa.array((at + base).astype(np.int32))], ["doc", "name", "one", "two", "at"])

    some = matches.where(F.size("open") > 0).select("doc", "name", "open")
    return texts.join(some, ["doc", "name"]).mapInArrow(run, schema)


def repeated_windows(windows: DataFrame) -> DataFrame:
    """(doc, name, more): of each text the open windows that a smaller doc_id has too."""
    least = windows.groupBy("one", "two").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most")
    least = materialize(least, "least")  # so that both sides are dealt out for the join, and Spark can split a common string
    hit = windows.join(least, ["one", "two"]).where("least < doc")
    return hit.groupBy("doc", "name").agg(F.collect_set("at").alias("more"))


RESULT = "doc_id long, kept_text string, n_words long, n_removed long, repeats array<struct<start: int, end: int>>"


def cut(text: bytes, sure: list, more: list, length: int) -> tuple[bytes, int, int, list[dict]]:
    """What is left of a text, its words, the removed ones, and the maximal repeats as (start, end) in words."""
    words = text.split()
    first = np.array([s["first"] for s in sure] + more, np.int64)
    if not len(first):
        return b" ".join(words), len(words), 0, []
    end = np.array([s["last"] for s in sure] + more, np.int64) + length
    depth = np.bincount(first, minlength=len(words) + 1) - np.bincount(end, minlength=len(words) + 1)
    keep = np.cumsum(depth[:-1]) == 0
    turn = np.flatnonzero(np.diff(np.concatenate([[True], keep, [True]]).astype(np.int8)))
    spans = [{"start": a, "end": z} for a, z in turn.reshape(-1, 2).tolist()]
    return b" ".join(compress(words, keep.tolist())), len(words), int(len(words) - keep.sum()), spans


def without_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, piece: int = PIECE) -> DataFrame:
    """(doc_id, kept_text, n_words, n_removed, repeats) for every row of docs; kept words are joined by one space."""
    if not 1 <= seed <= length:
        raise ValueError("a seed has at least one word and fits into the window")
    bounded_batches(docs.sparkSession)
    texts = own_texts(docs)
    shared = materialize(shared_seeds(texts, length, seed, piece), "seeds")
    matches = materialize(matched_places(texts, shared, length, seed, piece), "matches")
    windows = materialize(extended(texts, matches, length, piece), "windows")
    more = repeated_windows(windows)
    marks = matches.select("doc", "name", "sure").join(more, ["doc", "name"], "full")

    def run(batches):
        for b in batches:
            texts, sure, more = (b.column(c).to_pylist() for c in ("text", "sure", "more"))
            rows = [cut(t, s or [], m or [], length) for t, s, m in zip(texts, sure, more)]
            kept, n, removed, spans = (list(x) for x in zip(*rows)) if rows else ([], [], [], [])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            arrays = [b.column("doc"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "kept_text", "n_words", "n_removed", "repeats"])

    result = texts.join(materialize(marks, "marks"), ["doc", "name"], "left").mapInArrow(run, RESULT)
    return result.withColumn("doc_id", F.when(F.col("doc_id") != LAST_ID, F.col("doc_id")))


def digest(kept: Column) -> Column:
    return F.sha2(kept.cast("binary"), 256)


#: Every window by its words, the smallest doc_id of each, and the words that repeated windows cover.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, words, unnest(range(1, len(words) - {LENGTH - 2})) AS i FROM d WHERE len(words) >= {LENGTH}),
s AS (SELECT doc_id, i, md5(array_to_string(words[i : i + {LENGTH - 1}], ' ')) AS g FROM w),
f AS (SELECT g, min(doc_id) AS least FROM s GROUP BY g HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + {LENGTH})) AS k FROM s JOIN f USING (g) WHERE least < doc_id),
gone AS (SELECT doc_id, list(k) AS gone FROM hit GROUP BY doc_id),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS kept FROM each ANTI JOIN hit USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

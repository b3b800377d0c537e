"""Language identification with a blended-spectrum string kernel.

A text's features are the presences of its character 1- to 3-grams, each known by its exact number. The kernel of two
texts is the number of grams that both hold over the root of the product of the numbers that each holds. Landmark texts
give the Nyström map x -> K(x, landmarks) K(landmarks, landmarks)^(-1/2); one ridge regression for each language, that
language against the rest, is fitted on the mapped training rows. Both are linear in the presences of the landmarks'
grams, so scoring is one product of a batch's sparse presences with the matrix (grams x languages).

The landmarks are the basis of the map: a fixed number of excerpts of ``TRAIN_CHARS`` characters, as many of each of the
``LANGUAGES`` most frequent languages, drawn by a hash of doc_id and text over the whole table. The regressions are fitted
on every labelled row and its whole text, in pieces of ``TRAIN_CHARS`` characters that share the text's weight: tasks add
up the pieces' products in whole numbers, so that the model does not hang on how rows are dealt, and what they add up to
is of fixed size. Scoring reads every whole text, one over twice ``STRETCH`` characters stretch by stretch with the
outputs' mean.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; with no labelled rows everything is
``und`` with score 0; a null doc_id is never in the training set's other fold (its hash is null) and is not trained on;
rows that repeat are trained on and predicted one by one; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import bounded_batches, materialize

LANGUAGES = 256
TRAIN_CHARS = 4096
STRETCH = 1 << 16
LANDMARKS = 192
RIDGE = 1e-3
UNKNOWN = "und"
#: The gate's texts go in pieces of this length, and it is calibrated on held-out prefixes of these lengths.
PIECE = 1024
LENGTHS = tuple(1 << k for k in range(3, 11))
#: Share of the held-out texts of each length that the gate may reject by what they show.
REJECTED = 0.001
#: Scores and nearnesses are counted in steps of one over this.
GRID = 1 << 20
#: Least score and nearness as they are taken to be before any text is seen, and for how many texts that counts.
PRIOR = (0.3, 0.1)
PRIOR_TEXTS = 1000
#: Landmarks that a text is nearest to.
NEAREST = 20
LETTER = re.compile(r"[^\W\d_]")
#: Pieces whose products are added up at a time, bits of a part of a whole number, and numbers of a block of sums.
HELD_PIECES = 1024
PART = 16
BLOCK = 1 << 11
#: Bits of one character in a gram's number.
BITS = np.int64(21)


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # the landmarks' gram numbers, ascending
    marks: np.ndarray  # grams x landmarks, 0 or 1; a last row of zeros stands for all other grams
    scale: np.ndarray  # by landmark, one over the root of its number of grams
    weights: np.ndarray  # landmarks x languages, the Nyström map included
    bias: np.ndarray

    def __post_init__(self) -> None:
        self.by_gram = (self.marks * self.scale) @ self.weights if len(self.languages) else self.weights


def grams(text: str) -> np.ndarray:
    """The numbers of the text's different 1- to 3-grams, ascending."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    two = points[:-1] | points[1:] << BITS
    three = two[:-1] | points[2:] << (2 * BITS)
    keys = np.concatenate([points, two, three])
    keys.sort()
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def has_letter(text: str | None) -> bool:
    """Whether a character of category L is there; numbers such as superscripts don't count."""
    m = LETTER.search(text) if text else None
    return m is not None and (m[0].isalpha() or any(map(str.isalpha, text)))


def rows_of(known: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Where each gram stands among the known ones; the place after the last for all others."""
    at = np.searchsorted(known, own)
    return np.where(np.append(known, -1)[at] == own, at, len(known))


class Landmarks:
    """The landmarks' grams, and the Nyström map from kernel values with them."""

    def __init__(self, chosen: list[np.ndarray]) -> None:
        self.grams = np.unique(np.concatenate(chosen))
        self.marks = np.zeros((len(self.grams) + 1, len(chosen)), np.uint16)  # a landmark has fewer grams than 1 << 16
        for i, own in enumerate(chosen):
            self.marks[np.searchsorted(self.grams, own), i] = 1
        self.scale = 1 / np.sqrt([float(len(own)) for own in chosen])
        values, vectors = np.linalg.eigh(np.stack([self.kernel(own) for own in chosen]))
        keep = values > 1e-6 * max(values.max(), 1e-12)
        self.root = vectors[:, keep] / np.sqrt(values[keep])

    def kernel(self, own: np.ndarray) -> np.ndarray:
        return kernel(self.grams, self.marks, self.scale, own)


def kernel(known: np.ndarray, marks: np.ndarray, scale: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Of a text's grams with each landmark."""
    at = rows_of(known, own)
    return np.add.reduce(marks[at[at < len(known)]], axis=0, dtype=marks.dtype) * scale / np.sqrt(len(own))


def solve(languages: list[str], basis: Landmarks, square: np.ndarray, sums: np.ndarray, weights: np.ndarray, ridge: float) -> Model:
    """The regressions from the weighted sums over all training rows of products of their kernel values (landmarks x
    landmarks), of the values (languages x landmarks) and of the weights (by language)."""
    root, n = basis.root, basis.root.shape[1]
    by_language = np.hstack([sums @ root, weights[:, None]])
    total = np.empty((n + 1, n + 1))
    total[:n, :n] = root.T @ square @ root
    total[-1] = total[:, -1] = by_language.sum(axis=0)
    penalty = ridge * np.eye(n + 1)
    penalty[-1, -1] = 1e-9
    w = np.linalg.solve(total + penalty, (2 * by_language - by_language.sum(axis=0)).T)  # 1 for its own rows, -1 for others
    return Model(languages, basis.grams, basis.marks, basis.scale, root @ w[:-1], w[-1])


def fit(rows: list[np.ndarray], names: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """rows: the training texts' grams, dealt so that any leading part has all languages in equal shares."""
    languages = sorted(set(names))
    basis = Landmarks(rows[: max(landmarks, 2 * len(languages))])
    values = np.stack([basis.kernel(own) for own in rows])
    own = np.array(names)[None] == np.array(languages)[:, None]
    share = own / own.sum(axis=1, keepdims=True)  # each language weighs the same
    return solve(languages, basis, (values * share.sum(axis=0)[:, None]).T @ values, share @ values, share.sum(axis=1), ridge)


def untaught() -> Model:
    return Model([], np.zeros(0, np.int64), np.zeros((1, 0), np.uint16), np.zeros(0), np.zeros((0, 0)), np.zeros(0))


def cut(text: str, piece: int) -> list[str]:
    """The text cut into pieces of ``piece`` characters, the last one up to twice as long."""
    n = max(1, len(text) // piece)
    return [text[i * piece : (i + 1) * piece if i < n - 1 else len(text)] for i in range(n)]


def outputs(model: Model, texts: list[str], chars: int = 1 << 18) -> np.ndarray:
    """texts x languages: the regressions' values, for a long text their mean over its stretches."""
    out = np.zeros((len(texts), len(model.languages)))
    held, owner, share, size = [], [], [], 0

    def flush():
        sizes = np.array([len(g) for g in held])
        at = np.cumsum(sizes) - sizes
        sums = np.add.reduceat(model.by_gram[rows_of(model.grams, np.concatenate(held))], at, axis=0)
        np.add.at(out, owner, (sums / np.sqrt(sizes)[:, None] + model.bias) * np.array(share)[:, None])

    for i, t in enumerate(texts):
        parts = cut(t, STRETCH)
        for p in parts:
            held.append(grams(p))
            owner.append(i)
            share.append(1 / len(parts))
            size += len(p)
            if size >= chars:
                flush()
                held, owner, share, size = [], [], [], 0
    if held:
        flush()
    return out


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text: (1 + the winning regression's value) / 2, held within 0 and 1."""
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    known = [i for i, t in enumerate(texts) if has_letter(t)] if model.languages else []
    if known:
        f = outputs(model, [texts[i] for i in known])
        for i, j, v in zip(known, f.argmax(axis=1).tolist(), f.max(axis=1).tolist()):
            names[i] = model.languages[j]
            scores[i] = min(1.0, max(0.0, (1 + v) / 2))
    return names, scores


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled(docs: DataFrame, held: bool) -> DataFrame:
    """(lang, text, draw) of the rows of one fold that have a language and a letter; draw: a hash of doc_id and text."""
    own = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
    fold = held_out(F.col("doc_id"))
    own = own.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold if held else ~fold) & F.regexp_like("text", F.lit(r"\p{L}")))
    return own.select("lang", "text", F.xxhash64("doc_id", "text").alias("draw"))


def drawn(rows: DataFrame, each: int, counts: DataFrame) -> DataFrame:
    """At most ``each`` different rows of each language of counts, those with the least hashes.

    First a share that follows from a language's count is taken where the rows are, then they are ordered.
    """
    share = (F.lit(float(1 << 30)) * F.least(F.lit(1.0), F.lit(2.0 * each + 20) / F.col("n"))).cast("long")
    own = rows.join(F.broadcast(counts.select("lang", share.alias("share"))), "lang").where(F.pmod("draw", F.lit(1 << 30)) < F.col("share"))
    own = own.groupBy("lang", "draw").agg(F.first("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    return own.withColumn("place", place).where(F.col("place") <= each)


def parts_of(values: np.ndarray) -> np.ndarray:
    """The sum over rows of products of numbers from 0 to 1 that are taken in steps of 2^-2PART: as whole numbers the products
    of their upper halves, of upper with lower ones, and of lower halves."""
    steps = np.minimum(np.rint(values * float(1 << 2 * PART)), (1 << 2 * PART) - 1).astype(np.int64)
    high, low = (steps >> PART).astype(float), (steps & ((1 << PART) - 1)).astype(float)  # products and sums below 2^53
    across = high.T @ low
    return np.stack([high.T @ high, across + across.T, low.T @ low]).astype(np.int64)


def moments(rows: DataFrame, basis: Landmarks, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """rows: lang, text. The weighted sums over all rows that ``solve`` takes, a row's weight one over its language's count.

    A task adds up what it has before anything moves; the sums are of whole numbers, equal however rows are dealt.
    """
    spark = rows.sparkSession
    place = {lang: i for i, lang in enumerate(counts)}
    sent = spark.sparkContext.broadcast((basis, place, counts))  # of fixed size
    n = len(basis.scale)

    def run(batches):
        own, place, counts = sent.value
        square, sums = np.zeros((3, n, n), np.int64), np.zeros((len(place), n), np.int64)
        held = []

        def add():
            if held:
                square[:] += parts_of(np.stack(held))
            held.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                pieces = cut(text, TRAIN_CHARS)
                weight = (counts[lang] * len(pieces)) ** -0.5
                for p in pieces:
                    k = own.kernel(grams(p))
                    sums[place[lang]] += np.rint(k * (float(1 << 2 * PART) / len(pieces))).astype(np.int64)
                    held.append(k * weight)
                    if len(held) == HELD_PIECES:
                        add()
        add()
        flat = np.concatenate([square.ravel(), sums.ravel()])
        blocks = [flat[s : s + BLOCK].tobytes() for s in range(0, len(flat), BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], ["block", "sums"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # of one block
        block, out = 0, 0
        for b in batches:
            for block, own in zip(b.column(0).to_pylist(), b.column(1)):
                out = out + np.frombuffer(own.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["block", "sums"])

    added = rows.select("lang", "text").mapInArrow(run, "block int, sums binary").groupBy("block").applyInArrow(total, "block int, sums binary")
    flat = np.zeros(3 * n * n + len(place) * n, np.int64)
    for r in added.toLocalIterator():
        flat[r["block"] * BLOCK :][: len(r["sums"]) // 8] = np.frombuffer(r["sums"], np.int64)
    sent.unpersist()
    high, across, low = flat[: 3 * n * n].reshape(3, n, n).astype(float)
    one = float(1 << PART)
    each = np.array(list(counts.values()), float)[:, None]
    return (high + across / one + low / one**2) / one**2, flat[3 * n * n :].reshape(-1, n) / one**2 / each


def train(docs: DataFrame, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fit on every row that has a language and isn't held out; what comes to the driver are the landmarks and sums."""
    bounded_batches(docs.sparkSession)
    own = labelled(docs, False)
    # LANGUAGES rows at most, so they may be broadcast.
    found = own.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not found:
        return untaught()
    counts = docs.sparkSession.createDataFrame(found, "lang string, n long")
    most = max(landmarks, 2 * len(found))
    start = F.pmod("draw", F.greatest(F.lit(1), F.length("text") - TRAIN_CHARS)) + 1
    rows = drawn(own, -(-most // len(found)), counts).select("place", "lang", F.substring("text", start.cast("int"), F.lit(TRAIN_CHARS)).alias("text"))
    dealt = sorted((r["place"], r["lang"], r["text"]) for r in rows.collect())[:most]
    basis = Landmarks([grams(r[2]) for r in dealt])
    by_language = {r["lang"]: r["n"] for r in sorted(found)}
    square, sums = moments(own.where(F.col("lang").isin(list(by_language))), basis, by_language)
    return solve(list(by_language), basis, square, sums, np.ones(len(by_language)), ridge)


def language_id(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs; the model is trained on docs if none is given."""
    spark = docs.sparkSession
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(train(docs) if model is None else model)  # of fixed size, a few MB

    def run(batches):
        for b in batches:
            names, scores = predict(held.value, b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    own = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def annotate(docs: DataFrame, lang: str, score: str, model: Model | None = None) -> DataFrame:
    """docs with two more columns, the predicted language and its score; no join, each row keeps its own."""
    spark = docs.sparkSession
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(train(docs) if model is None else model)
    schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            names, scores = predict(held.value, b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, lang, score])

    return docs.mapInArrow(run, schema)


def claims(model: Model, text: str) -> tuple[str, float, float]:
    """Language, score and nearness, each from the mean over the text's pieces, so that they don't fall with its length.

    Nearness is the mean kernel with the NEAREST nearest landmarks; it tells strange texts apart where the outputs, whose
    sum is fixed, cannot: with one language the score is always 1.
    """
    f, near = np.zeros(len(model.languages)), 0.0
    own = cut(text, PIECE)
    for t in own:
        k = kernel(model.grams, model.marks, model.scale, grams(t))
        f += k @ model.weights + model.bias
        near += float(np.partition(k, -min(NEAREST, len(k)))[-NEAREST:].mean())
    best = int(f.argmax())
    return model.languages[best], (1 + float(f[best]) / len(own)) / 2, near / len(own)


def calibrate(docs: DataFrame, model: Model) -> dict[int, tuple[float, float]]:
    """For each of LENGTHS the least score and nearness that the gate lets pass, from every held-out labelled row.

    What the held-out texts of a length show is weighed with PRIOR by their number, by one rule for any number of them, none
    included, so that a table's size changes a threshold little by little. Both measures are counted in steps of 1 / GRID,
    so that the quantiles are exact to a step and come from counts whose number is bounded.
    """
    own = labelled(docs, True).where(F.col("lang").isin(model.languages)).select("text")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            prefixes = [t[:n] for t in b.column(0).to_pylist() for n in LENGTHS if t and len(t) >= n and has_letter(t[:n])]
            shown = np.array([claims(sent.value, t)[1:] for t in prefixes]).reshape(-1, 2)
            steps = np.floor(shown * GRID).astype(np.int64)
            kinds = np.repeat([0, 1], len(prefixes))
            yield pa.RecordBatch.from_arrays([pa.array(list(map(len, prefixes)) * 2, pa.int32()), pa.array(kinds, pa.int32()), pa.array(steps.T.ravel())], ["length", "kind", "step"])

    counted = materialize(own.mapInArrow(run, "length int, kind int, step long").groupBy("length", "kind", "step").count(), "gate")
    group = Window.partitionBy("length", "kind")
    upto = F.sum("count").over(group.orderBy("step")).alias("upto")
    placed = counted.select("length", "kind", "step", upto, F.sum("count").over(group).alias("n")).withColumn("at", (F.col("n") - 1) * REJECTED)
    least = lambda place: F.min(F.when(F.col("upto") > place, F.col("step")))
    found = placed.groupBy("length", "kind").agg(F.first("n").alias("n"), F.first("at").alias("at"), least(F.floor("at")).alias("low"), least(F.ceil("at")).alias("high")).collect()
    shown, n = {k: np.zeros(2) for k in LENGTHS}, dict.fromkeys(LENGTHS, 0)
    for r in found:  # two for each length
        n[r["length"]] = r["n"]
        shown[r["length"]][r["kind"]] = (r["low"] + (r["at"] % 1) * (r["high"] - r["low"])) / GRID
    return {k: weighed(n[k], shown[k]) for k in LENGTHS}


def weighed(n: int, shown: np.ndarray) -> tuple[float, float]:
    """The quantiles that n texts show, with PRIOR for PRIOR_TEXTS further ones."""
    out = (n * shown + PRIOR_TEXTS * np.array(PRIOR)) / (n + PRIOR_TEXTS)
    return float(out[0]), float(out[1])


def thresholds(found: list[tuple[float, float]]) -> tuple[float, float]:
    return weighed(len(found), np.quantile(np.array(found), REJECTED, axis=0) if found else np.zeros(2))


def passes(gate: dict[int, tuple[float, float]], length: int, score: float, near: float) -> bool:
    """Held against the length next below, as both measures rise with it; shorter texts against the shortest."""
    at = max((n for n in gate if n <= length), default=min(gate))
    return score >= gate[at][0] and near >= gate[at][1]


def claimed(docs: DataFrame, lang: str, model: Model) -> DataFrame:
    """The rows of docs that a language claims, with one more column, that language."""
    spark = docs.sparkSession
    bounded_batches(spark)
    held = spark.sparkContext.broadcast((model, calibrate(docs, model)))
    schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType())])
    at = docs.columns.index("text")

    def run(batches):
        own, gate = held.value
        for b in batches:
            texts = b.column(at).to_pylist()
            found = [claims(own, t) if has_letter(t) else None for t in texts]
            keep = [i for i, c in enumerate(found) if c and passes(gate, len(texts[i]), c[1], c[2])]
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in b.columns), pa.array([found[i][0] for i in keep], pa.string())], [*b.schema.names, lang])

    return docs.mapInArrow(run, schema)

"""Filtered exact top-k over chunks or any table of vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.ranks import numbered
from cairn.functions.vector import distance, score
from cairn.schema import SearchOptions
from cairn.shared import written

TIES = ("store_key", "path", "chunk_index")
DEFAULT_K = 10
TOOL_K = 5


def effective_k(k: int | None) -> int:
    """What a caller's k means: none 5, 0 or less 10."""
    return TOOL_K if k is None else k if k > 0 else DEFAULT_K


def filtered(chunks: DataFrame, options: SearchOptions) -> DataFrame:
    """Equality filters that reach the scan; an empty option filters nothing."""
    wanted = {"source": options.source, "chunk_type": options.chunk_type, "language": options.language}
    return reduce(lambda df, kv: df.where(F.col(kv[0]) == kv[1]), [kv for kv in wanted.items() if kv[1]], chunks)


def nearest(rows: DataFrame, query: list[float], k: int, metric: str = "l2", vector: str = "vector", ties: tuple[str, ...] = TIES, digits: int | None = None) -> DataFrame:
    """The k rows of least distance with columns distance and score, without their vectors. Rows whose vector is null, of
    another size than the question or holds null or NaN have no distance and are left out."""
    d = distance(F.col(vector), F.lit([float(x) for x in query]), metric)
    ranked = rows.withColumn("distance", d if digits is None else F.round(d, digits) + 0.0).drop(vector)
    ranked = ranked.where(F.col("distance").isNotNull() & ~F.isnan("distance"))
    return ranked.orderBy("distance", *ties).limit(k).withColumn("score", score(F.col("distance")))


def nearest_batched(rows: DataFrame, query: list[float], k: int, vector: str = "vector", key: str = "vec_id") -> DataFrame:
    """(key, distance) of the k nearest by squared L2: a matrix product a batch, k rows a batch left to be ordered. Rows
    that ``nearest`` leaves out are left out here too."""
    q = np.array(query, np.float64)

    def run(batches):
        for b in batches:
            m = np.asarray(b.column(1).flatten(), np.float64).reshape(len(b), -1) if len(b) else np.zeros((0, len(q)))
            d = ((m - q) ** 2).sum(axis=1)
            ids = b.column(0).to_numpy()
            top = np.lexsort((ids, d))[:k]
            yield pa.RecordBatch.from_arrays([pa.array(ids[top]), pa.array(d[top])], [key, "distance"])

    usable = (F.size(vector) == len(q)) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x))
    found = rows.where(F.coalesce(usable, F.lit(False))).select(F.col(key).cast("long"), vector).mapInArrow(run, f"{key} long, distance double")
    return found.orderBy("distance", key).limit(k)


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the rows whose vector is there and holds no null or NaN."""
    own = df.where(F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)))
    return own.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))


def by_width(ids: pa.ChunkedArray | pa.Array, vectors: pa.ChunkedArray | pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of the vectors of each size."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    size = np.diff(vectors.offsets.to_numpy())
    start = vectors.offsets.to_numpy()[:-1]
    flat, ids = vectors.values.to_numpy(zero_copy_only=False), ids.to_numpy()
    return {int(w): (ids[size == w], flat[start[size == w][:, None] + np.arange(w)]) for w in np.unique(size)}


class Best:
    """The k least (distance, id) of each of some questions, from rows that come batch by batch."""

    QUESTIONS, ROWS = 512, 1024

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.length = (vectors**2).sum(1)
        self.d, self.near = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def offer(self, ids: np.ndarray, rows: np.ndarray, which: np.ndarray | None = None) -> None:
        """which: numbers of the questions that these rows may matter to; all, if none are given. A matrix product tells
        which rows could be among the k, up to its rounding; their distances are made from differences."""
        which = np.arange(len(self.ids)) if which is None else which
        for r in range(0, len(ids), self.ROWS):
            part, own = rows[r : r + self.ROWS], ids[r : r + self.ROWS]
            length = (part**2).sum(1)
            for q in range(0, len(which), self.QUESTIONS):
                at = which[q : q + self.QUESTIONS]
                about = self.length[at, None] + length - 2 * (self.vectors[at] @ part.T)
                slack = 1e-9 * (self.length[at, None] + length) + 1e-12
                own_id = self.ids[at, None] == own
                high = np.where(own_id, np.inf, about + slack)
                most = self.d[at, -1:]
                if high.shape[1] >= self.k:
                    most = np.minimum(most, np.partition(high, self.k - 1)[:, self.k - 1 : self.k])
                i, j = np.nonzero((about - slack <= most) & ~own_id)
                if len(i):
                    self._take(at[i], own[j], self._exact(at[i], part, j))

    def _exact(self, question: np.ndarray, rows: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(question))
        for a in range(0, len(question), 65_536):
            out[a : a + 65_536] = ((self.vectors[question[a : a + 65_536]] - rows[j[a : a + 65_536]]) ** 2).sum(1)
        return out

    def _take(self, question: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        some = np.unique(question)
        question = np.concatenate([question, np.repeat(some, self.k)])
        ids, d = np.concatenate([ids, self.near[some].ravel()]), np.concatenate([d, self.d[some].ravel()])
        by = np.lexsort((ids, d, question))
        question, ids, d = question[by], ids[by], d[by]
        first = np.searchsorted(question, some)
        kept = first[:, None] + np.arange(self.k)  # each has k at least
        self.near[some], self.d[some] = ids[kept], d[kept]

    def told(self, key: str) -> pa.RecordBatch:
        q, i = np.nonzero(np.isfinite(self.d))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(self.near[q, i]), pa.array(self.d[q, i])], ["query_id", key, "distance"])


def question_blocks(asked: DataFrame, block: int) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """asked: id, v. Blocks of at most ``block`` questions, by their size."""
    placed = written(numbered(asked, ["id"]).withColumn("block", F.expr(f"place div {block}")).select("id", "v", "block"), "asked")
    for b in range(-(-placed.count() // block)):
        table = placed.where(F.col("block") == b).select("id", "v").toArrow()
        yield by_width(table.column("id"), table.column("v"))


def ranked(found: DataFrame, k: int, key: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest_to_all(rows: DataFrame, asked: DataFrame, k: int, vector: str = "vector", key: str = "vec_id", block: int = 16_384) -> DataFrame:
    """(query_id, key, distance, rank): the k rows nearest by squared L2 of every row of asked, itself left out; ties by key.

    Questions go to the tasks in blocks of at most ``block``, one pass over rows for each. Rows stay where they are; a task
    holds a block, a batch of rows and k rows a question, and only those k are shuffled.
    """
    own = usable(rows, key, vector)
    found = [own.sparkSession.createDataFrame([], f"query_id long, {key} long, distance double")]
    for questions in question_blocks(usable(asked, key, vector), block):

        def run(batches, questions=questions):
            best = {w: Best(ids, m, k) for w, (ids, m) in questions.items()}
            for b in batches:
                for w, (ids, m) in by_width(b.column("id"), b.column("v")).items():
                    if w in best:
                        best[w].offer(ids, m)
            yield from (x.told(key) for x in best.values())

        found.append(own.mapInArrow(run, found[0].schema))
    return ranked(reduce(DataFrame.union, found), k, key)


def search(chunks: DataFrame, query: list[float], options: SearchOptions = SearchOptions(), metric: str = "l2") -> DataFrame:
    """Filter, then rank: every row given back satisfies the filters."""
    return nearest(filtered(chunks, options), query, options.k if options.k > 0 else DEFAULT_K, metric)


def list_sources(chunks: DataFrame) -> DataFrame:
    """(source, source_version, store_key, chunk_count), in order; reads these three columns only."""
    keys = ["source", "source_version", "store_key"]
    return chunks.groupBy(*keys).agg(F.count("*").alias("chunk_count")).orderBy(*keys)

"""Exact nearest neighbours that read only the files that can hold them.

Vectors are stored by cell: each goes to the nearest of some centres, which are fitted on a bounded sample. A cell has its
centre c, the greatest distance r of its vectors from it, and their number. No vector of a cell is nearer to a question q
than |q - c| - r, so once k vectors at most t away are known, cells with a greater bound need not be read. Every row is in
a cell, and the result is that of a scan of all.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.search import Best, by_width, nearest, question_blocks, ranked, usable
from cairn.shared import written

#: Vectors that the centres are fitted on, rounds of that, and the most centres: what comes to the driver is bounded by these.
SAMPLE = 20_000
ROUNDS = 8
MOST_CELLS = 4096
ROWS_A_CELL = 2000
#: Relative slack of bounds, far above the rounding of a distance.
SLACK = 1e-9


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, up to rounding."""
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T, 0)


def centres_of(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres by Lloyd's rounds; the first are drawn with a fixed seed."""
    rng = np.random.default_rng(7)
    out = sample[rng.permutation(len(sample))[:cells]].copy()
    for _ in range(rounds):
        own = np.concatenate([squares(sample[i : i + 2048], out).argmin(1) for i in range(0, len(sample), 2048)])
        sums, n = np.zeros_like(out), np.bincount(own, minlength=len(out))
        np.add.at(sums, own, sample)
        out[n > 0] = sums[n > 0] / n[n > 0, None]
    return out


class CellIndex:
    """A table of vectors of one size under path: rows by cell, and the cells."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        meta = spark.read.parquet(f"{self.path}/cells").orderBy("cell").toArrow()  # at most MOST_CELLS rows
        self.cells = meta.column("cell").to_numpy()
        self.centre = np.array(meta.column("centre").to_pylist(), float).reshape(len(self.cells), -1 if len(self.cells) else 0)
        self.radius, self.count = meta.column("radius").to_numpy(), meta.column("n").to_numpy()
        self.read: list[int] = []  # cells that each search has read, for reports

    @classmethod
    def build(cls, rows: DataFrame, path: str, vector: str = "embedding", key: str = "vec_id", cells: int | None = None, sample: int = SAMPLE) -> CellIndex:
        """Rows without a usable vector are left out; vectors of another size than most are an error."""
        spark = rows.sparkSession
        own = written(usable(rows, key, vector), "vectors")
        sizes = own.groupBy(F.size("v").alias("w")).count().collect()
        if len(sizes) > 1:
            raise ValueError(f"vectors of {len(sizes)} sizes; index each by itself")
        n = sizes[0]["count"] if sizes else 0
        cells = max(1, min(cells or -(-n // ROWS_A_CELL), MOST_CELLS, n))
        # A draw of a little more than the sample, cut to it.
        drawn = own.sample(min(1.0, 1.2 * sample / max(n, 1)), 7).limit(sample).toArrow() if n else None
        found = next(iter(by_width(drawn.column("id"), drawn.column("v")).values()))[1] if n and len(drawn) else np.zeros((1, sizes[0]["w"] if sizes else 1))
        centres = centres_of(found, cells)

        def assign(batches):
            for b in batches:
                ids, m = next(iter(by_width(b.column("id"), b.column("v")).values())) if len(b) else (np.zeros(0, np.int64), np.zeros((0, centres.shape[1])))
                cell = np.concatenate([np.zeros(0, np.int64), *(squares(m[i : i + 1024], centres).argmin(1) for i in range(0, len(m), 1024))]).astype(np.int64)
                far = np.sqrt(((m - centres[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(cell), pa.array(far)], ["id", "v", "cell", "far"])

        placed = own.mapInArrow(assign, "id long, v array<double>, cell long, far double")
        placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path.rstrip('/')}/rows")
        stored = spark.read.schema("id long, v array<double>, far double, cell long").parquet(f"{path.rstrip('/')}/rows")
        kept = {r["cell"]: r for r in stored.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n")).collect()}
        meta = [(int(c), centres[c].tolist(), float(r["radius"]), int(r["n"])) for c, r in sorted(kept.items())]
        spark.createDataFrame(meta, "cell long, centre array<double>, radius double, n long").coalesce(1).write.parquet(f"{path.rstrip('/')}/cells")
        return cls(spark, path)

    def rows(self, cells: np.ndarray) -> DataFrame:
        """Rows of these cells; the others' files are not read."""
        schema = "id long, v array<double>, far double, cell long"
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows").where(F.col("cell").isin([int(c) for c in cells]))

    def bounds(self, questions: np.ndarray) -> np.ndarray:
        """No vector of the cell is nearer than that (a distance, not squared), for each question and cell."""
        away = np.sqrt(((questions[:, None] - self.centre[None]) ** 2).sum(2)) if len(questions) * self.centre.size < 1e7 else np.sqrt(squares(questions, self.centre)) - 1e-6 * (1 + np.sqrt((questions**2).sum(1)))[:, None]
        return np.maximum(away * (1 - SLACK) - self.radius * (1 + SLACK) - 1e-12, 0)

    def first(self, bounds: np.ndarray, k: int) -> np.ndarray:
        """Of one question the places of the cells of least bounds that hold k rows beside itself."""
        by = np.argsort(bounds, kind="stable")
        return by[: np.searchsorted(np.cumsum(self.count[by]), k + 1) + 1]

    def search(self, query: list[float], k: int, key: str = "vec_id") -> DataFrame:
        """(key, distance, score) of the k nearest by squared L2, as ``nearest`` gives them over all rows."""
        q = np.array([query], float)
        if not len(self.cells) or q.shape[1] != self.centre.shape[1]:
            self.read = []
            return self.spark.createDataFrame([], f"{key} long, distance double, score double")
        low = self.bounds(q)[0]
        at = self.first(low, k)
        shown = lambda c: nearest(self.rows(self.cells[c]).select(F.col("id").alias(key), "v"), query, k, "l2", "v", (key,))
        known = written(shown(at), "near")
        most = known.agg(F.max("distance"), F.count("*")).first()
        t = most[0] if most[1] >= k else np.inf
        more = np.setdiff1d(np.flatnonzero(low * low <= t * (1 + SLACK) + 1e-12), at)
        self.read = [len(at) + len(more)]
        both = known.unionByName(shown(more)) if len(more) else known
        return both.orderBy("distance", key).limit(k)

    def search_all(self, asked: DataFrame, k: int, vector: str = "embedding", key: str = "vec_id", block: int = 2048) -> DataFrame:
        """(query_id, key, distance, rank), as ``nearest_to_all`` gives them over all rows."""
        schema = f"query_id long, {key} long, distance double"
        found = [self.spark.createDataFrame([], schema)]
        self.read = []
        for questions in question_blocks(usable(asked, key, vector), block):
            ids, m = questions.get(self.centre.shape[1], (None, None))
            if ids is None or not len(self.cells):
                continue
            low = self.bounds(m)
            wanted = np.zeros(low.shape, bool)
            for i, row in enumerate(low):
                wanted[i, self.first(row, k)] = True
            near = self._pass(ids, m, wanted, k, key, schema)
            best = ranked(near, k, key).groupBy("query_id").agg(F.max("distance").alias("t"), F.count("*").alias("n")).toArrow()  # a row a question
            full = {q: t for q, t, n in zip(*(best.column(c).to_pylist() for c in ("query_id", "t", "n"))) if n >= k}
            t = np.array([full.get(int(q), np.inf) for q in ids])
            rest = (low * low <= t[:, None] * (1 + SLACK) + 1e-12) & ~wanted
            found += [near, self._pass(ids, m, rest, k, key, schema)]
            self.read += (wanted | rest).sum(1).tolist()
        return ranked(reduce(DataFrame.union, found), k, key)

    def _pass(self, ids: np.ndarray, m: np.ndarray, wanted: np.ndarray, k: int, key: str, schema: str) -> DataFrame:
        """What each question finds in the cells that it wants; written, as it is read twice."""
        cells = np.flatnonzero(wanted.any(0))
        by_cell = {int(self.cells[c]): np.flatnonzero(wanted[:, c]) for c in cells}

        def run(batches):
            best = Best(ids, m, k)
            for b in batches:
                if not len(b):
                    continue
                own = b.column("cell").to_numpy()
                (rows, v), = by_width(b.column("id"), b.column("v")).values()
                for c in np.unique(own):
                    best.offer(rows[own == c], v[own == c], by_cell[int(c)])
            yield best.told(key)

        return written(self.rows(self.cells[cells]).select("id", "v", "cell").mapInArrow(run, schema), "found")

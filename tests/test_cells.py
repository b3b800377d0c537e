"""Search by cells gives the rows of a scan, and reads fewer cells where vectors lie in groups."""

from __future__ import annotations

import numpy as np
import pytest

from cairn.operators import search
from cairn.operators.cells import CellIndex


def grouped(spark, n=1200, dims=6, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, dims)) * 20
    v = np.round(middle[rng.integers(0, 12, n)] + rng.normal(size=(n, dims)), 2)
    v[::40] = v[0]  # a third of nothing new: equal vectors tie by id
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(5), v


def plain(v, asked, k):
    out = []
    for q in asked:
        d = ((v - v[q]) ** 2).sum(1)
        by = [i for i in np.lexsort((np.arange(len(v)), d)) if i != q][:k]
        out += [(q, int(i), r, round(float(d[i]), 9)) for r, i in enumerate(by, 1)]
    return sorted(out)


def told(df):
    return sorted((r["query_id"], r["vec_id"], r["rank"], round(r["distance"], 9)) for r in df.collect())


@pytest.mark.parametrize("block", [3, 2048])
def test_all_against_all(spark, tmp_path, block):
    rows, v = grouped(spark)
    asked = rows.where("vec_id % 100 = 0")
    index = CellIndex.build(rows, f"file://{tmp_path}/i", cells=30)
    want = plain(v, range(0, 1200, 100), 5)
    assert told(index.search_all(asked, 5, block=block)) == want == told(search.nearest_to_all(rows, asked, 5, "embedding", block=block))
    assert len(index.read) == 12 and sum(index.read) < 0.5 * 12 * len(index.cells)
    again = CellIndex(spark, f"file://{tmp_path}/i")
    assert told(again.search_all(asked, 5)) == want and again.count.sum() == 1200


def test_one_question(spark, tmp_path):
    rows, v = grouped(spark, seed=5)
    index = CellIndex.build(rows, f"file://{tmp_path}/i", cells=40)
    for q in ([0.0] * 6, v[7].tolist(), (v[9] + 0.3).tolist()):
        got = [tuple(r) for r in index.search(q, 7).select("vec_id", "distance").collect()]
        assert got == [tuple(r) for r in search.nearest(rows, q, 7, "l2", "embedding", ("vec_id",)).select("vec_id", "distance").collect()]
    assert index.read[0] < len(index.cells)
    assert len(index.search(v[0].tolist(), 5000).collect()) == 1200 and index.read == [len(index.cells)]
    plan = index.rows(index.cells[:2])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan


def test_defined_cases(spark, tmp_path):
    schema = "vec_id long, embedding array<double>"
    odd = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, [1.0, 2.0]), (1, [1.0, 2.0])], schema)
    index = CellIndex.build(odd, f"file://{tmp_path}/a")
    assert told(index.search_all(odd, 3)) == told(search.nearest_to_all(odd, odd, 3, "embedding"))
    assert index.search([1.0], 3).collect() == []
    with pytest.raises(ValueError, match="2 sizes"):
        CellIndex.build(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], schema), f"file://{tmp_path}/b")
    none = CellIndex.build(odd.limit(0), f"file://{tmp_path}/c")
    assert none.search_all(odd, 3).collect() == [] and none.search([1.0], 2).collect() == []
    assert search.nearest_to_all(odd.limit(0), odd, 3, "embedding").collect() == [] == search.nearest_to_all(odd, odd.limit(0), 3, "embedding").collect()


def test_flat_search_holds_little(spark):
    """A partition of many rows: what a task holds follows the block and the batch."""
    import tracemalloc

    rng = np.random.default_rng(1)
    rows, questions = rng.normal(size=(60_000, 16)), rng.normal(size=(700, 16))
    best = search.Best(np.arange(700) - 1000, questions, 4)
    tracemalloc.start()
    for i in range(0, 60_000, 10_000):
        best.offer(np.arange(i, i + 10_000), rows[i : i + 10_000])
    assert tracemalloc.get_traced_memory()[1] < 80e6
    tracemalloc.stop()
    d = ((questions[5] - rows) ** 2).sum(1)
    assert best.near[5].tolist() == np.argsort(d)[:4].tolist()

"""Places and running sums by ranges equal those of one sorted list, hot keys and nulls included."""

from __future__ import annotations

import random
from itertools import groupby

from pyspark.sql import functions as F

from cairn.functions.ranks import numbered, running


def test_numbered(spark):
    r = random.Random(1)
    rows = [(r.choice([None, 1, 2, 2, 2, 7]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, i int").repartition(7)
    got = sorted(map(tuple, numbered(df, ["k", "i"]).select("place", "k", "i").collect()))
    assert got == [(n, *row) for n, row in enumerate(sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1])))]
    tied = numbered(df, ["k"])
    assert sorted(p for p, in tied.select("place").collect()) == list(range(500)) and tied.orderBy("place").select("k").collect() == df.orderBy("k").select("k").collect()
    assert numbered(df.limit(0), ["k"]).collect() == []


def test_hot_key_is_dealt_over_ranges(spark):
    df = spark.range(8000).withColumn("k", F.lit(1))
    spread = numbered(df, ["k"]).groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) > 4 and max(n for _, n in spread) < 4000


def test_running(spark):
    r = random.Random(2)
    rows = [(r.choice([None, "a", "a", "a", "b"]), i if i % 50 else None, r.randrange(9)) for i in range(400)]
    rows = list({(k, x): (k, x, v) for k, x, v in rows}.values())
    df = spark.createDataFrame(rows, "k string, x int, v long").repartition(5)
    got = {(a, b): (c, d) for a, b, c, d in running(df, ["k"], ["x"], {"s": "v", "n": F.lit(1)}).select("k", "x", "s", "n").collect()}
    order = lambda row: (row[0] is not None, row[0] or "", row[1] is not None, row[1] or 0)
    want = {}
    for k, own in groupby(sorted(rows, key=order), key=lambda row: row[0]):
        total = 0
        for n, (_, x, v) in enumerate(own, 1):
            total += v
            want[k, x] = (total, n)
    assert got == want
    wide = running(df, ["k"], ["x"], {"s": "v"}, {"top": "v"})
    tops, totals = {}, {}
    for k, x, v in sorted(rows, key=order):
        tops[k, x] = max([v, *[w for (a, b), w in tops.items() if a == k]])
        totals[k] = totals.get(k, 0) + v
    assert {(r["k"], r["x"]): (r["top"], r["s_all"]) for r in wide.collect()} == {(k, x): (tops[k, x], totals[k]) for k, x, _ in rows}
    assert running(df.limit(0), ["k"], ["x"], {"s": "v"}).collect() == []
    assert running(df, [], ["k", "x"], {"s": "v"}).agg(F.max("s")).first()[0] == sum(v for *_, v in rows)


def test_statistics_of_one_large_key(spark):
    """Each as numpy has it; no window is over a whole key."""
    import numpy as np

    from cairn.functions import stats

    df = spark.range(60_000).select(F.lit("m").alias("m"), F.expr("cast((id * 7919) % 30011 - 15000 as double) / 7").alias("v"), (F.col("id") % 3 == 0).alias("x"), F.format_string("n%05d", "id").alias("name"))
    v = np.array([r[0] for r in df.select("v").collect()])
    x = np.arange(60_000) % 3 == 0
    got = stats.descriptive(df, "v", "m").first()
    assert np.allclose([got[c] for c in ("median", "p25", "p75", "mean", "std", "n")], [*np.percentile(v, [50, 25, 75]), v.mean(), v.std(ddof=1), 60_000])
    assert stats.descriptive(df, "v").first()["median"] == got["median"]
    order = np.sort(v[~x])
    net = np.searchsorted(order, v[x]).sum() - (len(order) - np.searchsorted(order, v[x], "right")).sum()
    assert abs(stats.cliffs_delta(df, "v", F.col("x"), "m").first()["delta"] - net / (x.sum() * (~x).sum())) < 1e-12
    d = v[v != 0]
    sizes, of, n = np.unique(np.abs(d), return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[of]
    w = stats.signed_ranks(df, "v", "m").first()
    assert (w["w_plus"], w["w_minus"], w["ties"], w["n"]) == (rank[d > 0].sum(), rank[d < 0].sum(), float((n**3 - n).sum()), len(d))
    tests = df.select("name", (F.abs("v") / 10**7).alias("p"))
    p = np.abs(v) / 10**7
    by = np.lexsort((np.arange(60_000), p))
    want = np.minimum(np.maximum.accumulate(p[by] * (60_000 - np.arange(60_000))), 1)
    found = {r["name"]: r["p_corrected"] for r in stats.holm(tests, "p", "name").collect()}
    assert np.allclose([found[f"n{i:05d}"] for i in by], want)

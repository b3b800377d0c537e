"""Paired non-parametric statistics as DataFrame plans.

Each takes a long table and grouping columns, so all metrics of a run are one plan. What needs an order (quantiles, ranks,
Holm's steps) is taken from running sums over ranges of the different values, so that a key of any size is spread over
tasks; only the Hodges-Lehmann estimate holds a key's differences in one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.ranks import running, same


EXACT = "decimal(38,0)"


def quantiles(values: DataFrame, value: str, shares: dict[str, float], *keys: str) -> DataFrame:
    """(keys..., names...): quantiles by linear interpolation, from the places of the different values."""
    v = F.col(value).cast("double").alias("v")
    counted = values.where(F.col(value).isNotNull()).select(*keys, v).groupBy(*keys, "v").agg(F.count("*").alias("c"))
    placed = running(counted, keys, ["v"], {"upto": "c"})
    out = []
    for name, share in shares.items():
        place = (F.col("upto_all") - 1) * F.lit(share)
        low = F.floor(place)
        at = lambda k: F.min(F.when(F.col("upto") > k, F.col("v")))
        out += [at(low).alias(f"{name}_a"), at(F.least(low + 1, F.col("upto_all") - 1)).alias(f"{name}_b"), F.max(place - low).alias(f"{name}_w")]
    found = placed.groupBy(*keys).agg(*out)
    return found.select(*keys, *[F.when(F.col(f"{n}_w") == 0, F.col(f"{n}_a")).otherwise(F.col(f"{n}_a") * (1 - F.col(f"{n}_w")) + F.col(f"{n}_b") * F.col(f"{n}_w")).alias(n) for n in shares])


def descriptive(values: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys..., median, p25, p75, mean, std, n); std is 0 for a single value. No task holds a key's values."""
    v = F.col(value)
    sums = values.groupBy(*keys).agg(F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.count(v).alias("n"))
    found = quantiles(values, value, {"median": 0.5, "p25": 0.25, "p75": 0.75}, *keys)
    joined = sums.join(found, same(sums, found, keys) if keys else F.lit(True), "left")
    return joined.select(*[sums[k] for k in keys], "median", "p25", "p75", "mean", "std", "n")


def cliffs_label(delta: Column) -> Column:
    size = F.abs(delta)
    return F.when(size < 0.147, "negligible").when(size < 0.330, "small").when(size < 0.474, "medium").otherwise("large")


def cliffs_delta(values: DataFrame, value: str, is_x: Column, *keys: str) -> DataFrame:
    """(keys..., delta, effect): (#x>y - #x<y) / (n_x n_y), from ranks, so no pair is ever formed.

    values holds both samples; is_x tells the first one. An empty sample gives 0 and negligible.
    """
    own = values.select(*keys, F.col(value).alias("v"), is_x.alias("x"))
    at = own.groupBy(*keys, "v").agg(F.count_if("x").alias("nx"), F.count_if(~F.col("x")).alias("ny"))
    at = running(at, keys, ["v"], {"upto": "ny"})
    more, less = F.col("upto") - F.col("ny"), F.col("upto_all") - F.col("upto")
    net = F.col("nx").cast(EXACT) * (more - less).cast(EXACT)
    summed = at.groupBy(*keys).agg(F.sum(net.cast(EXACT)).alias("d"), F.sum("nx").alias("n1"), F.sum("ny").alias("n2"))
    delta = F.coalesce(F.try_divide(F.col("d").cast("double"), F.col("n1").cast("double") * F.col("n2").cast("double")), F.lit(0.0))
    return summed.select(*keys, delta.alias("delta"), cliffs_label(delta).alias("effect"))


def walsh_quantiles(values: np.ndarray, shares: tuple[float, ...]) -> list[float]:
    """Quantiles, by linear interpolation, of the averages of all pairs i <= j of the values, without forming them: how many
    averages are at most x is counted over the sorted values, and x is found by halving."""
    d = np.sort(np.asarray(values, float))
    n = len(d)
    total = n * (n + 1) // 2

    def at_most(x: float) -> tuple[int, float]:
        """How many averages are at most x, and the greatest of them."""
        last = np.searchsorted(d, 2 * x - d, "right")  # j with d_i + d_j <= 2 x, up to rounding
        last -= (last > 0) & ((d + d[np.maximum(last - 1, 0)]) / 2 > x)
        count = np.maximum(last - np.arange(n), 0)
        some = count > 0
        return int(count.sum()), float(((d[some] + d[last[some] - 1]) / 2).max()) if some.any() else -math.inf

    def ranked(k: int) -> float:
        """The k-th least average, from 0."""
        low, high = d[0], d[-1]
        for _ in range(200):
            mid = low + (high - low) / 2
            if not low < mid < high:
                break
            low, high = (low, mid) if at_most(mid)[0] > k else (mid, high)
        return at_most(low)[1] if at_most(low)[0] > k else at_most(high)[1]

    out = []
    for share in shares:
        place = share * (total - 1)
        below = int(place)
        a, b = ranked(below), ranked(min(below + 1, total - 1))
        out.append(a + (place - below) * (b - a))
    return out


def hodges_lehmann(diffs: DataFrame, diff: str, *keys: str) -> DataFrame:
    """(keys..., median_difference, ci_low, ci_high) from the Walsh averages of paired differences; a key's differences are
    one task's, their averages are never formed."""
    names = ("median_difference", "ci_low", "ci_high")
    own = diffs.select(*keys, F.col(diff).cast("double").alias("d")).where("d IS NOT NULL")
    schema = T.StructType([*own.schema.fields[:-1], *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        found = walsh_quantiles(rows.column("d").to_numpy(), (0.5, 0.025, 0.975))
        return pa.table([*(pa.array([k.as_py()], k.type) for k in key), *(pa.array([v]) for v in found)], [*keys, *names])

    return own.groupBy(*keys).applyInArrow(run, schema)


def signed_ranks(diffs: DataFrame, diff: str, *keys: str) -> DataFrame:
    """(keys..., n, w_plus, w_minus, ties): zero differences dropped, equal sizes share their mean rank."""
    own = diffs.where(F.col(diff) != 0).select(*keys, (F.col(diff) > 0).alias("up"), F.abs(F.col(diff)).alias("a"))
    sizes = own.groupBy(*keys, "a").agg(F.count("*").alias("c"), F.count_if("up").alias("up"))
    sizes = running(sizes, keys, ["a"], {"upto": "c"})
    twice = (2 * F.col("upto") - F.col("c") + 1).cast(EXACT)  # twice the mean rank
    half = lambda n: F.sum((n.cast(EXACT) * twice).cast(EXACT)).cast("double") / 2
    c = F.col("c").cast(EXACT)
    ties = F.sum(F.when(F.col("c") > 1, (c * (F.col("c") * F.col("c") - 1).cast(EXACT)).cast(EXACT)).otherwise(F.lit(0).cast(EXACT)))
    return sizes.groupBy(*keys).agg(F.sum("c").alias("n"), half(F.col("up")).alias("w_plus"), half(F.col("c") - F.col("up")).alias("w_minus"), ties.cast("double").alias("ties"))


def wilcoxon_p(n: int, w: float, ties: float) -> float:
    """Two-sided: exact for up to 50 differences without ties, else by the normal curve with the tie correction."""
    if n < 1:
        return 1.0
    if n <= 50 and not ties:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            for s in range(len(ways) - 1, r - 1, -1):
                ways[s] += ways[s - r]
        return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return 1.0 if not spread else math.erfc(abs(w - n * (n + 1) / 4) / spread / math.sqrt(2))


def wilcoxon(diffs: DataFrame, diff: str, *keys: str) -> DataFrame:
    """(keys..., W, p); keys whose differences are all zero are absent."""
    p = F.udf(wilcoxon_p, "double")  # one row for each key
    ranks = signed_ranks(diffs, diff, *keys).withColumn("W", F.least("w_plus", "w_minus"))
    return ranks.select(*keys, "W", p("n", "W", "ties").alias("p"))


def holm(tests: DataFrame, p: str, name: str, *keys: str, alpha: float = 0.05) -> DataFrame:
    """tests with p_corrected and significant: the step-down correction within keys; ties in p go by name."""
    placed = running(tests, keys, [p, name], {"cairn_place": F.lit(1)})
    raised = F.col(p) * (F.col("cairn_place_all") - F.col("cairn_place") + 1)
    out = running(placed.drop("p_corrected", "significant"), keys, [p, name], {}, {"p_corrected": raised}).drop("cairn_place", "cairn_place_all")
    out = out.withColumn("p_corrected", F.least("p_corrected", F.lit(1.0)))
    return out.withColumn("significant", F.col("p_corrected") <= alpha)

"""Places and running sums in an order, exact and without a task that holds a whole group.

Rows are dealt out by ranges of the order; what a range adds to those after it is one short row. A group of any size is
thus spread over as many tasks as there are ranges.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.shared import written

#: monotonically_increasing_id() has the task's number above this many bits.
ROW_BITS = 33


def ranges(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "place") -> DataFrame:
    """df with each row's place in the order, from 0; rows that are equal in it have any order among themselves, and are
    dealt out evenly too. What comes to the driver is one number for each range."""
    spark, n = df.sparkSession, ranges(df.sparkSession)
    tie = df.withColumn("cairn_tie", F.monotonically_increasing_id())
    dealt = tie.repartitionByRange(n, *order, "cairn_tie").sortWithinPartitions(*order, "cairn_tie").drop("cairn_tie")
    kept = written(dealt.withColumn("cairn_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("cairn_at", ROW_BITS)
    sizes = {r[0]: r[1] for r in kept.groupBy(part.alias("part")).count().collect()}  # at most n rows
    before, starts = 0, []
    for i in range(max(sizes, default=-1) + 1):
        starts.append((i, before))
        before += sizes.get(i, 0)
    offsets = F.broadcast(spark.createDataFrame(starts, "cairn_part int, cairn_start long"))
    own = kept.withColumn("cairn_part", part.cast("int")).join(offsets, "cairn_part")
    return own.withColumn(name, F.col("cairn_start") + (F.col("cairn_at") - F.shiftleft(part, ROW_BITS))).drop("cairn_part", "cairn_at", "cairn_start")


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """The keys of both are equal, or null in both."""
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], sums: dict[str, str | Column], greatest: dict[str, str | Column] | None = None) -> DataFrame:
    """df with running sums (and running greatest values) within each group of keys, the own row included: name -> column;
    beside each sum, in name_all, that of the whole group. Rows of a group should differ in the order: equal ones are taken
    in any order. The sums are of whole numbers or decimals, so that they are exact."""
    none = not keys
    keys = list(keys) or ["cairn_group"]
    own = df.withColumn("cairn_group", F.lit(0)) if none else df
    kinds = [("s", F.sum, name, c) for name, c in sums.items()] + [("m", F.max, name, c) for name, c in (greatest or {}).items()]
    values = {f"cairn_{k}{i}": F.col(c) if isinstance(c, str) else c for i, (k, _, _, c) in enumerate(kinds)}
    folds = dict(zip(values, (f for _, f, _, _ in kinds)))
    own = own.withColumns(values).repartitionByRange(ranges(df.sparkSession), *keys, *order)
    own = written(own.withColumn("cairn_part", F.spark_partition_id()), "running")
    parts = own.groupBy(*keys, "cairn_part").agg(*[fold(v).alias(v) for v, fold in folds.items()])  # a row for each range
    group = Window.partitionBy(*keys)
    before = group.orderBy("cairn_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, "cairn_part", *[fold(v).over(before).alias(f"{v}_before") for v, fold in folds.items()], *[F.sum(v).over(group).alias(f"{v}_all") for v in values if v.startswith("cairn_s")])
    within = Window.partitionBy(*keys, "cairn_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = own.select(*dict.fromkeys([*df.columns, *keys]), "cairn_part", *[fold(v).over(within).alias(v) for v, fold in folds.items()])
    joined = own.join(parts, same(own, parts, [*keys, "cairn_part"]))
    out = []
    for v, (kind, _, name, _) in zip(values, kinds):
        if kind == "s":
            out += [(own[v] + F.coalesce(parts[f"{v}_before"], F.lit(0))).alias(name), parts[f"{v}_all"].alias(f"{name}_all")]
        else:
            out.append(F.greatest(own[v], parts[f"{v}_before"]).alias(name))
    return joined.select(*[own[c] for c in df.columns], *out)

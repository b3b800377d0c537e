"""Paired comparison of two conditions over all metrics, as one DataFrame plan and a small report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import stats

METRICS = ("total_cost_usd", "input_tokens", "output_tokens", "duration_ms", "num_turns", "index_calls", "total_calls")
QUALITY = ("composite_quality", "fact_score", "structure_score")


def paired(trials: DataFrame, treated: str, control: str, metrics: tuple[str, ...]) -> DataFrame:
    """(task_id, repetition, metric, x, y): complete pairs in long form. Warm-ups (repetition 0) are left out; of several
    trials of one cell the last by trial_order stands; missing values count as 0."""
    own = trials.where("repetition > 0")
    cell = own.groupBy("task_id", "repetition", "condition").agg(F.max_by(F.struct(*metrics), "trial_order").alias("m"))
    side = lambda c, name: cell.where(F.col("condition") == c).select("task_id", "repetition", F.col("m").alias(name))
    both = side(treated, "x").join(side(control, "y"), ["task_id", "repetition"])
    value = lambda s, m: F.coalesce(F.col(f"{s}.{m}").cast("double"), F.lit(0.0))
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), value("x", m).alias("x"), value("y", m).alias("y")) for m in metrics])
    return both.select("task_id", "repetition", F.inline(rows))


def incomplete(trials: DataFrame, conditions: int = 2) -> DataFrame:
    """Cells of (task_id, repetition) that lack a condition."""
    return trials.where("repetition > 0").groupBy("task_id", "repetition").agg(F.count_distinct("condition").alias("n")).where(F.col("n") < conditions)


def compare(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row for each metric: both sides' statistics, W, p, Cliff's delta, Hodges-Lehmann, and Holm's correction."""
    sides = stats.descriptive(pairs, "x", "metric").withColumnsRenamed({k: f"x_{k}" for k in ("median", "p25", "p75", "mean", "std", "n")})
    sides = sides.join(stats.descriptive(pairs, "y", "metric").withColumnsRenamed({k: f"y_{k}" for k in ("median", "p25", "p75", "mean", "std", "n")}), "metric")
    diffs = pairs.select("metric", (F.col("x") - F.col("y")).alias("d"))
    both = pairs.select("metric", F.explode(F.array(F.struct(F.lit(True).alias("first"), F.col("x").alias("v")), F.struct(F.lit(False).alias("first"), F.col("y").alias("v")))).alias("s")).select("metric", "s.*")
    out = sides.join(stats.wilcoxon(diffs, "d", "metric"), "metric", "left").withColumn("p", F.coalesce("p", F.lit(1.0)))
    out = out.join(stats.cliffs_delta(both, "v", F.col("first"), "metric"), "metric").join(stats.hodges_lehmann(diffs, "d", "metric"), "metric")
    return stats.holm(out, "p", "metric", alpha=alpha)


STATISTICS = ("median", "p25", "p75", "mean", "std", "n")


def by_task(trials: DataFrame, treated: str, control: str) -> DataFrame:
    """(task_id, mean_engagement, treated_*, control_*) over complete pairs: the treated trials' engagement, and the
    statistics of both sides' quality, a missing one counting as 0."""
    pairs = paired(trials, treated, control, ("engagement", "composite_quality"))
    engaged = pairs.where("metric = 'engagement'").groupBy("task_id").agg(F.round(F.avg("x"), 4).alias("mean_engagement"))
    quality = pairs.where("metric = 'composite_quality'")
    side = lambda c, name: stats.descriptive(quality, c, "task_id").withColumnsRenamed({k: f"{name}_{k}" for k in STATISTICS})
    return engaged.join(side("x", "treated"), "task_id").join(side("y", "control"), "task_id")


def summary(trials: DataFrame, treated: str) -> DataFrame:
    """One row over all trials that aren't warm-ups: their number, the engaged share of treated ones, total cost."""
    mine = F.col("condition") == treated
    engaged = F.coalesce(F.try_divide(F.count_if(mine & (F.col("index_calls") > 0)).cast("double"), F.count_if(mine).cast("double")), F.lit(0.0))
    return trials.where("repetition > 0").agg(F.count("*").alias("trials"), engaged.alias("engaged_share"), F.round(F.sum("total_cost_usd"), 2).alias("total_cost_usd"))

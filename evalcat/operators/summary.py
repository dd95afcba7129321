"""Aggregations over result, call and step tables.

Every grouped aggregate here is a plain ``groupBy().agg`` (partial + final
aggregation, so a hot group is pre-aggregated map-side before the shuffle).
Medians are the one exception: ``percentile`` would merge all values of a
group in one buffer, so exact medians go through ``ranking.exact_medians``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalcat.operators.ranking import exact_medians

GROUP = ["provider", "model"]


def _count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def recount_runs(results: DataFrame, run_cols: Sequence[str] = ("run_id",)) -> DataFrame:
    """completed = all rows of the run, errors = rows with status error."""
    return results.groupBy(*run_cols).agg(
        F.count(F.lit(1)).alias("completed"),
        _count_if(F.col("status") == "error").alias("errors"),
    )


def avg_score_by_model(results: DataFrame, group_cols: Sequence[str] = GROUP) -> DataFrame:
    """Mean score (error rows count as 0) and n per provider/model."""
    return results.groupBy(*group_cols).agg(
        F.avg(F.coalesce(F.col("score"), F.lit(0.0))).alias("mean_score"),
        F.count(F.lit(1)).alias("n"),
    )


def summarize_models(
    results: DataFrame,
    group_cols: Sequence[str] = GROUP,
    num_partitions: int | None = None,
) -> DataFrame:
    """D3 + D4: per-group n, error counts (text rule and status rule), score
    sum, token sums (nulls skipped, empty sum 0), exact medians of latency,
    ttft, tps and calls (null when the group has none), score percent =
    100 * sum(score) / sum(weight) (null on zero weight)."""
    group_cols = list(group_cols)
    totals = results.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"),
        _count_if(F.coalesce(F.col("output"), F.lit("")).startswith("ERROR")).alias("errors"),
        _count_if(F.col("status") == "error").alias("status_errors"),
        F.sum(F.coalesce(F.col("score"), F.lit(0.0))).alias("score_sum"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).cast("long").alias("sum_input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).cast("long").alias("sum_output_tokens"),
        F.sum(F.coalesce(F.col("weight"), F.lit(1.0))).alias("_wsum"),
    )
    totals = totals.withColumn(
        "score_pct",
        F.when(F.col("_wsum") != 0, F.lit(100.0) * F.col("score_sum") / F.col("_wsum")),
    ).drop("_wsum")
    medians = exact_medians(
        results,
        group_cols,
        {
            "median_latency_ms": "latency_ms",
            "median_ttft_ms": "ttft_ms",
            "median_tps": "tps",
            "median_calls": "num_llm_calls",
        },
        num_partitions=num_partitions,
    )
    return totals.join(medians, group_cols, "left")


def aggregate_calls(calls: DataFrame, key_cols: Sequence[str] = ("result_id",)) -> DataFrame:
    """Per-row metrics over its LLM calls: token and latency sums
    (null when all null), median ttft and tps (null when none), call count.
    Rows without calls get nothing here; left-join from the result table to
    obtain the all-null row."""
    key_cols = list(key_cols)
    sums = calls.groupBy(*key_cols).agg(
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("latency_ms").alias("latency_ms"),
        F.count(F.lit(1)).alias("num_llm_calls"),
    )
    med = exact_medians(calls, key_cols, {"ttft_ms": "ttft_ms", "tps": "tps"})
    return sums.join(med, key_cols, "left")

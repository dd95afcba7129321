"""Deployment and pod operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalcat.functions import catalog as K


def parse_pod_lines(df: DataFrame, line_col: str = "line") -> DataFrame:
    """Whitespace table lines -> name, ready, total, status, restarts,
    age; lines with fewer than 3 fields are skipped, a missing or non-numeric
    ready/total counts as 0."""
    parts = F.split(F.trim(F.col(line_col)), r"\s+")
    rt = F.split(F.get(parts, 1), "/")
    out = df.withColumn("_p", parts).where(F.size("_p") >= 3)
    return out.select(
        *[c for c in df.columns if c != line_col],
        F.get(F.col("_p"), 0).alias("name"),
        F.coalesce(F.get(rt, 0).try_cast("int"), F.lit(0)).alias("ready"),
        F.coalesce(F.get(rt, 1).try_cast("int"), F.lit(0)).alias("total"),
        F.get(F.col("_p"), 2).alias("status"),
        F.coalesce(F.get(F.col("_p"), 3), F.lit("0")).alias("restarts"),
        F.coalesce(F.get(F.col("_p"), 4), F.lit("")).alias("age"),
    )


def latest_pods(pods: DataFrame, ts_col: str = "polled_at", seq_col: str = "seq") -> DataFrame:
    """I5 (batch form): latest line per (deployment, kind) among cache and
    default pods; ``max_by`` is a partial aggregate."""
    k = pods.withColumn("kind", K.classify_pod("name")).where(F.col("kind") != "other")
    return k.groupBy("deployment", "kind").agg(
        F.max_by(F.struct("name", "ready", "total", "status"), F.struct(ts_col, seq_col)).alias("_p")
    ).select("deployment", "kind", "_p.*")


def deployment_status_table(deployments: DataFrame, pods: DataFrame) -> DataFrame:
    """B15 per deployment from its latest cache and default pod lines."""
    lp = latest_pods(pods)
    wide = lp.groupBy("deployment").agg(
        F.max(F.when(F.col("kind") == "cache", F.col("ready"))).alias("cache_ready"),
        F.max(F.when(F.col("kind") == "cache", F.col("total"))).alias("cache_total"),
        F.max(F.when(F.col("kind") == "default", F.col("ready"))).alias("default_ready"),
        F.max(F.when(F.col("kind") == "default", F.col("total"))).alias("default_total"),
    )
    j = deployments.join(wide, "deployment", "left")
    return j.withColumn(
        "status", K.deployment_status("cache_ready", "cache_total", "default_ready", "default_total")
    )


def deployment_models(deployments: DataFrame, bundles: DataFrame) -> DataFrame:
    """C20: deployment -> bundle -> model names (case-insensitive order);
    deployments(deployment, bundle), bundles(name, models array)."""
    b = bundles.select(F.col("name").alias("bundle"), F.explode("models").alias("model"))
    j = deployments.join(b, "bundle", "inner")
    return j.orderBy("deployment", F.lower("model"), "model")


def with_template(bundles: DataFrame, templates: DataFrame) -> DataFrame:
    """Bundles next to the template they reference (inner join)."""
    return bundles.join(templates, "template", "inner")

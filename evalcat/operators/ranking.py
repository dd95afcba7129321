"""Positional operators that stay distributed and skew-safe.

Two things in this library need a row's position in a sort order: the dense
ordinal of an example (file order / id order) and exact medians. The obvious
Spark forms both funnel data into one task: a window without ``partitionBy``
moves the whole table into one partition, and ``percentile`` merges every
value of a group into one aggregation buffer, so a group holding a third of
the rows lands on a single executor.

Both are computed here from one range-partitioned sort instead:

1. ``repartitionByRange(n, group..., order...)`` + ``sortWithinPartitions``.
   Range bounds are sampled on the full key, so a hot group is cut across many
   partitions by its order value.
2. Each row gets ``_pid`` (partition id) and ``_li`` (index inside the sorted
   partition, taken from ``monotonically_increasing_id``).
   The sorted table is written once so both uses below see the same
   partition bounds, and nothing stays cached.
3. A tiny table ``(pid, group) -> first _li, count`` (one row per partition and
   group present in it) gives every (pid, group) slice the number of rows of
   that group in earlier partitions: a running sum over a table whose size is
   partitions + groups, not rows.
4. Joining it back yields ``rank = offset + _li - first`` for every row. AQE
   turns that join into a broadcast once the offsets stage has run and its
   measured size is under the adaptive broadcast threshold; with very many
   groups it stays a shuffle join.

Nothing is collected and no group is gathered into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalcat.operators.inference import materialize


def _as_cols(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _num_partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return int(num_partitions)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def sorted_positions(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str | Column],
    rank_col: str = "_rank",
    count_col: str | None = None,
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``rank_col``: 0-based position of each row inside its group in the
    given order (ties are broken arbitrarily but ranks stay dense and unique).
    When ``count_col`` is set, also add the group's row count."""
    group_cols = list(group_cols)
    n = _num_partitions(df, num_partitions)
    keys = [*_as_cols(group_cols), *_as_cols(order_cols)]
    pid = F.spark_partition_id()
    t = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_pid", pid)
        .withColumn(
            "_li", F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), 33)
        )
    )
    # One copy of the sorted table, written to the shared folder, for both the
    # offset table and the join below: a second evaluation would re-sample the
    # range bounds (the sampler is seeded by RDD id) and shift partitions.
    t = materialize(t, "positions")
    g = t.groupBy("_pid", *group_cols).agg(
        F.min("_li").alias("_first"), F.count(F.lit(1)).alias("_cnt")
    )
    w = Window.partitionBy(*group_cols).orderBy("_pid")
    g = g.withColumn(
        "_off",
        F.coalesce(
            F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ),
    )
    if count_col:
        g = g.withColumn("_n", F.sum("_cnt").over(Window.partitionBy(*group_cols)))
    g = g.drop("_cnt")
    right = g.select(
        F.col("_pid").alias("_g_pid"),
        *[F.col(c).alias(f"_g_{i}") for i, c in enumerate(group_cols)],
        "_first",
        "_off",
        *(["_n"] if count_col else []),
    )
    # No static hint: with AQE the offsets side is measured after its stage
    # runs and the join becomes a broadcast when it is below
    # spark.sql.adaptive.autoBroadcastJoinThreshold (one row per slice, so
    # usually tiny); with many groups it stays a shuffle join.
    cond = F.col("_pid") == F.col("_g_pid")
    for i, c in enumerate(group_cols):
        cond = cond & t[c].eqNullSafe(F.col(f"_g_{i}"))
    out = t.join(right, cond, "inner").withColumn(
        rank_col, F.col("_off") + F.col("_li") - F.col("_first")
    )
    if count_col:
        out = out.withColumnRenamed("_n", count_col)
    drop = ["_pid", "_li", "_g_pid", "_first", "_off"] + [
        f"_g_{i}" for i in range(len(group_cols))
    ]
    return out.drop(*drop)


def with_row_index(
    df: DataFrame,
    order_cols: Sequence[str | Column],
    name: str = "ordinal",
    start: int = 0,
    num_partitions: int | None = None,
) -> DataFrame:
    """Global dense index in ``order_cols`` order (zipWithIndex semantics)
    without a single-partition window. Give a unique order for stable ids."""
    out = sorted_positions(df, [], order_cols, rank_col=name, num_partitions=num_partitions)
    if start:
        out = out.withColumn(name, F.col(name) + F.lit(start))
    return out


#: Rows up to which a group's values meet in one aggregation buffer.
GATHERED = 10_000


def exact_quantiles(
    df: DataFrame,
    group_cols: Sequence[str],
    value_cols: dict[str, str | Column],
    q: float = 0.5,
    num_partitions: int | None = None,
    gathered: int = GATHERED,
) -> DataFrame:
    """Exact linear-interpolated quantile (``percentile``/``quantile_cont``
    semantics, nulls skipped) of several value columns per group.

    Groups are counted first. Those of at most ``gathered`` rows are answered
    by ``percentile``, all columns in one exchange. Only the rows of larger
    groups, if there are any, are sorted as described above, so no buffer
    grows with a group. ``value_cols`` maps output name -> input column.
    Groups where a value has no non-null entry get null for it. Returns
    group_cols + output names."""
    group_cols = list(group_cols)
    value = lambda c: (F.col(c) if isinstance(c, str) else c).cast("double")
    gather = lambda rows: rows.groupBy(*group_cols).agg(*[F.percentile(value(c), float(q)).alias(name) for name, c in value_cols.items()])
    if not group_cols:
        return _sorted_quantiles(df, group_cols, value_cols, q, num_partitions)
    counts = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > gathered)
    large = materialize(counts.select(*[F.col(c).alias(f"_l_{i}") for i, c in enumerate(group_cols)]), "large-groups")
    if large.isEmpty():
        return gather(df)
    same = F.lit(True)
    for i, c in enumerate(group_cols):
        same = same & df[c].eqNullSafe(F.col(f"_l_{i}"))
    small = gather(df.join(large, same, "left_anti"))
    return small.unionByName(_sorted_quantiles(df.join(large, same, "left_semi"), group_cols, value_cols, q, num_partitions))


def _sorted_quantiles(df: DataFrame, group_cols: list[str], value_cols: dict[str, str | Column], q: float, num_partitions: int | None) -> DataFrame:
    """``exact_quantiles`` in one sort of all values, for groups of any size."""
    names = list(value_cols)
    long = df.select(
        *group_cols,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("_metric"),
                        (F.col(c) if isinstance(c, str) else c).cast("double").alias("_v"),
                    )
                    for name, c in value_cols.items()
                ]
            )
        ).alias("_m"),
    ).select(*group_cols, "_m._metric", "_m._v").where(F.col("_v").isNotNull())
    keys = [*group_cols, "_metric"]
    ranked = sorted_positions(
        long, keys, ["_v"], rank_col="_rank", count_col="_n", num_partitions=num_partitions
    )
    pos = F.lit(float(q)) * (F.col("_n") - 1)
    lo = F.floor(pos)
    hi = F.ceil(pos)
    picked = ranked.where((F.col("_rank") == lo) | (F.col("_rank") == hi))
    per_metric = picked.groupBy(*keys).agg(
        F.min("_v").alias("_lo"),
        F.max("_v").alias("_hi"),
        F.first(pos - lo).alias("_frac"),
    )
    per_metric = per_metric.withColumn(
        "_q", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac")
    )
    return per_metric.groupBy(*group_cols).agg(
        *[F.max(F.when(F.col("_metric") == name, F.col("_q"))).alias(name) for name in names]
    )


def exact_medians(
    df: DataFrame,
    group_cols: Sequence[str],
    value_cols: dict[str, str | Column],
    num_partitions: int | None = None,
) -> DataFrame:
    return exact_quantiles(df, group_cols, value_cols, 0.5, num_partitions)

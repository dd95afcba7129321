"""Tables of Parquet partitions that are rewritten or dropped one by one (A13,
I2): what a change touches is named by literal partition values, so only these
folders are listed, read and written; the rest of the table is never seen.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalcat.operators.inference import materialize

#: Partitions of one change that are named one by one; beyond it the whole
#: table is listed and joined with them.
NAMED = 10_000
_ESCAPED = re.compile(r"[\x00-\x1f\x7f\"#%'*/:=?\\{\[\]^]")


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store Spark reads."""
    fs, place = _file_system(spark, path)
    return fs.exists(place)


def partition_path(target: str, values: dict) -> str:
    """The folder of a partition, named as Spark's writers name it."""
    text = lambda v: "__HIVE_DEFAULT_PARTITION__" if v is None or v == "" else _ESCAPED.sub(lambda m: f"%{ord(m.group()):02X}", str(v))
    return "/".join([target.rstrip("/"), *(f"{c}={text(v)}" for c, v in values.items())])


def touched(rows: DataFrame, cols: Sequence[str]) -> list[dict] | None:
    """The partitions that rows lie in; None if they are more than ``NAMED``."""
    found = rows.select(*cols).distinct().limit(NAMED + 1).collect()
    return [r.asDict() for r in found] if len(found) <= NAMED else None


def read_touched(spark: SparkSession, target: str, rows: DataFrame, cols: Sequence[str], schema) -> DataFrame:
    """The table's rows in the partitions that ``rows`` touch."""
    table = spark.read.schema(schema)
    named = touched(rows, cols)
    if named is None:
        same = rows.select(*cols).distinct()
        return table.parquet(target).join(same, list(cols), "left_semi")
    paths = [p for p in (partition_path(target, v) for v in named) if path_exists(spark, p)]
    return table.option("basePath", target).parquet(*paths) if paths else spark.createDataFrame([], schema)


def replace_touched(spark: SparkSession, target: str, rows: DataFrame, cols: Sequence[str], before: DataFrame) -> None:
    """Write ``rows`` in place of the partitions that they and ``before`` (what
    was read) touch; one that is left without rows is dropped."""
    left = rows.select(*[F.col(c).alias(f"_{c}") for c in cols]).distinct()
    same: Column = F.lit(True)
    for c in cols:
        same = same & before[c].eqNullSafe(F.col(f"_{c}"))
    # found out before the files they are read from are replaced
    gone = materialize(before.select(*cols).distinct().join(left, same, "left_anti"), "gone-partitions")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*cols).parquet(target)
    for values in gone.toLocalIterator():
        drop_partition(spark, target, values.asDict())


def drop_partition(spark: SparkSession, target: str, values: dict) -> bool:
    """Remove a partition and all below it; False if there is none."""
    fs, place = _file_system(spark, partition_path(target, values))
    return fs.exists(place) and fs.delete(place, True)


def delete_runs(spark: SparkSession, targets: Sequence[str], runs: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """Drop runs (experiment_id, run_id) from all tables partitioned by
    these two. Returns runs with ``outcome``: active (kept), deleted or
    not_found. Names of runs are all that passes through the driver."""
    keys = ["experiment_id", "run_id"]
    named = runs.select(*keys).distinct()
    alive = (active.select(*keys) if active is not None else named.limit(0)).distinct().withColumn("_alive", F.lit(True))
    done = []
    for r in named.join(alive, keys, "left").toLocalIterator():
        if r["_alive"]:
            outcome = "active"
        else:
            dropped = [drop_partition(spark, t, {k: r[k] for k in keys}) for t in targets]
            outcome = "deleted" if any(dropped) else "not_found"
        done.append((r["experiment_id"], r["run_id"], outcome))
    return spark.createDataFrame(done, "experiment_id string, run_id string, outcome string")


def delete_experiments(spark: SparkSession, targets: Sequence[str], experiments: DataFrame) -> int:
    """Drop experiments with all their runs, whatever their state (the
    folder above them goes with all below it). Returns how many had any."""
    names = experiments.select("experiment_id").distinct().toLocalIterator()
    return sum(any([drop_partition(spark, t, {"experiment_id": r[0]}) for t in targets]) for r in names)

"""Query registry: ``register(name, sql)`` records a Spark builder
``(spark, sf_dir) -> DataFrame`` and, when the operator is SQL-expressible,
the DuckDB SQL that computes the same table from the same parquet views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}

_MODULES = (
    "evalcat.plans.q_results",
    "evalcat.plans.q_examples",
    "evalcat.plans.q_catalog",
    "evalcat.plans.q_ops",
    "evalcat.plans.q_codeeval",
    "evalcat.plans.q_chunks",
    "evalcat.plans.q_streaming",
    "evalcat.plans.q_sources",
    "evalcat.plans.q_more",
)


def register(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column of a report to ``digits`` places so sums
    whose addition order differs between engines compare equal. The oracle
    SQL applies ``round(x, digits)`` to the same columns."""
    return df.select(
        *[
            F.round(F.col(f.name), digits).alias(f.name)
            if isinstance(f.dataType, (DoubleType, FloatType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def load_all() -> None:
    import importlib

    for m in _MODULES:
        importlib.import_module(m)

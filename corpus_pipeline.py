"""Training-corpus pipeline over ``documents``.

Stages, each written as Parquet and read again as the next one's documents:
quality classifier (documents scored below 0.3 go), toxicity (0.7 and more go),
near duplicates (one document of each class stays), benchmark decontamination
(documents that hold a benchmark item go), best-fit packing (the result: a row
per piece with its place in a sequence). All but the last return the columns of
``documents``. Nulls, empty texts, repeated rows, empty tables and extra columns
are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalcat.llm import decontaminate, near_dup, quality, queries, toxicity
from evalcat.llm.common import staged
from evalcat.session import read_table


def _filtered(docs: DataFrame, score, labels: DataFrame, column: str, keeps) -> DataFrame:
    """Rows whose score passes; ``column`` doesn't hide one of ``docs``."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.col("doc_id"), F.col("text"))
    return score(packed, labels).where(keeps(F.col(column))).select("own.*")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _filtered(docs, quality.score, read_table(spark, sf_dir, "labels"), "quality_score", lambda s: s >= 0.3)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _filtered(docs, toxicity.score, read_table(spark, sf_dir, "labels"), "toxicity_score", lambda s: s < 0.7)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.deduplicated(docs, threshold=0.8)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, read_table(spark, sf_dir, "benchmark"), threshold=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.packed(docs)


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: Trained models and tokenizers are no SQL. tests/llm/test_operators.py runs the stages on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

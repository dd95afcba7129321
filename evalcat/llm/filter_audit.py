"""Filter interaction audit by contractions of contingency tensors.

Each document has one outcome (pass 0, fail 1) for each of k filters. Spark
counts documents per part and combination of outcomes; a part's counts, shaped
2 x 2 x ... x 2 (an axis for each filter), hold all that any order of the
filters needs. For a step of an order an axis of an earlier filter selects
"pass", the step's own "fail", a later one "all"; ``einsum`` contracts the
tensors of many parts with the selections of all steps of all orders at once.
Only these small tensors reach Python, never documents.

Filters of ``document_cells`` (null text: empty; words: runs of other characters
than U+0020 and U+0009 to U+000D, case-sensitive), a document fails
  A with under 200 words;
  B if 100 * distinct words < 50 * words;
  C if 100 * letters A to Z > 2 * code points;
  D if it holds one of # $ % & * |
  E if a smaller doc_id of the table has an equal text.

E takes no join on texts: equal texts agree in A to D, so documents are counted
by (digest, part, labels) with their smallest id, partial counts first, and a
digest's smallest id is taken over these few rows.

Edge cases: a null source is part ''. Rows of one doc_id are documents of their
own; equal texts of one id aren't smaller than each other. A null doc_id is
never smaller and never has a smaller one (passes E), and has no labels. Of
several label rows of an id one that says 1 is enough. An empty text has no
words: it fails A, passes B, C, D. An empty table gives no rows. Other columns
of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """Outcomes of the filters that see one text only."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    count = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": count < 200,
        "B": F.size(F.array_distinct(words)) * F.lit(100).cast("long") < count * F.lit(50).cast("long"),
        "C": capitals * F.lit(100).cast("long") > F.length(text) * F.lit(2).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def document_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, cell, n, good, toxic): documents per part and combination of
    outcomes. Filter i of ``FILTERS`` has bit 2^(4 - i) of ``cell``: the last
    axis varies fastest."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("t"))
    bits = sum((F.when(fails, F.lit(1 << (len(FILTERS) - 1 - FILTERS.index(k)))).otherwise(F.lit(0)) for k, fails in text_failures(F.col("t")).items()), F.lit(0))
    rows = base.select("id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), bits.alias("bits"))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("of")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    rows = rows.join(marks, F.col("id") == F.col("of"), "left").select("id", "part", "digest", "bits", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    kind = ["digest", "bits", "part", "good", "toxic"]
    ids = rows.groupBy(*kind, "id").agg(F.count(F.lit(1)).alias("n"))
    least = ids.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.min("id").alias("least"), F.min_by("n", "id").alias("at_least"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("no_id")
    )
    first = F.col("least") == F.min("least").over(Window.partitionBy("digest"))
    kept = F.col("no_id") + F.when(first, F.col("at_least")).otherwise(F.lit(0))
    split = least.withColumn("kept", kept).select(
        "part", "good", "toxic", F.explode(F.array(F.struct(F.col("bits").alias("cell"), F.col("kept").alias("n")), F.struct((F.col("bits") + 1).alias("cell"), (F.col("n") - F.col("kept")).alias("n")))).alias("c")
    )
    some = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("c.n"))), F.lit(0)).alias(c)
    return split.where("c.n > 0").groupBy("part", F.col("c.cell").alias("cell")).agg(F.sum("c.n").alias("n"), some("good"), some("toxic"))


def selections(k: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """All orders of k filters, and for each step of each (order by order) the
    k x 2 selection of axes: earlier pass, own fail, later all."""
    orders = list(permutations(range(k)))
    picks = np.ones((len(orders), k, k, 2), np.int64)
    for o, order in enumerate(orders):
        for step, axis in enumerate(order):
            picks[o, step:, axis] = [1, 0]
            picks[o, step, axis] = [0, 1]
    return orders, picks.reshape(-1, k, 2)


def contracted(tensors: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """(parts, 2, ..., 2) counts and (s, k, 2) selections to (parts, s) sums."""
    k = picks.shape[1]
    axes = "abcdefgh"[:k]
    terms = ",".join([f"p{axes}", *(f"s{a}" for a in axes)])
    return np.einsum(f"{terms}->ps", tensors, *(picks[:, i] for i in range(k)), optimize=True)


def audit(cells: DataFrame, names: str = FILTERS) -> DataFrame:
    """cells (part, cell, n, good, toxic) of filters ``names`` to a row per
    part, order and step: part, filter_order, step (from 1), kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley (all counts)."""
    k = len(names)
    fields = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, picks = selections(k)
        axis = np.array(orders).ravel()
        texts = np.repeat(["".join(names[i] for i in o) for o in orders], k)
        steps = np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders))
        after = picks.copy()
        after[np.arange(len(axis)), axis] = [1, 0]
        fails = np.ones((k, k, 2), np.int64)
        fails[np.arange(k), np.arange(k)] = [0, 1]
        only = np.tile(np.array([1, 0]), (k, k, 1))
        only[np.arange(k), np.arange(k)] = [0, 1]
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                counts = np.zeros((part.num_rows, 3, 2**k), np.int64)
                for i, row in enumerate(part.column("cells").to_pylist()):
                    for c in row:
                        counts[i, :, c["cell"]] = c["n"], c["good"], c["toxic"]
                n, good, toxic = (counts[:, j].reshape(-1, *[2] * k) for j in range(3))
                removed = contracted(n, picks)
                shapley = np.stack([removed[:, axis == a].sum(axis=1) for a in range(k)], axis=1)
                out = (contracted(n, after), removed, contracted(n, fails)[:, axis] - removed, contracted(n, only)[:, axis], contracted(good, picks), contracted(toxic, picks), shapley[:, axis])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(part.column("part").to_pylist(), len(axis)).tolist(), pa.string()), pa.array(np.tile(texts, part.num_rows).tolist(), pa.string()),
                     pa.array(np.tile(steps, part.num_rows)), *(pa.array(x.ravel()) for x in out)],
                    names=["part", "filter_order", "step", *fields],
                )

    # at most 2^k entries a part
    packed = cells.groupBy("part").agg(F.collect_list(F.struct("cell", "n", "good", "toxic")).alias("cells"))
    return packed.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{f} long" for f in fields))

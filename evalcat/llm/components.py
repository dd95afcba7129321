"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalcat.llm.common import sized_partitions, staged

#: Edges that one task contracts.
EDGES = 10_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root): nodes of these edges whose component has a smaller node, with the smallest."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low, new = np.minimum(root[a], root[b]), root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def _contracted(edges: DataFrame, parts: int) -> DataFrame:
    """The same components, by the stars of ``parts`` parts of the edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if got:
            u, v = stars(*(np.concatenate(x) for x in zip(*got)))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return edges.repartition(parts).mapInArrow(run, "u long, v long")


def _directed(edges: DataFrame) -> DataFrame:
    """(u, v) with u > v, each once."""
    return edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u long, v long), any direction, repeats and loops allowed.
    Returns (node, root): every node of an edge whose component has a smaller
    node, with the smallest; roots themselves have no row.

    Each task contracts its share of the edges first; if one has all of them,
    which are few then, this is the result. Else, in rounds: all neighbours above a node move to its smallest neighbour
    (large star), then all below (small star). A node's neighbours only meet in
    a partial ``min`` and in a join whose hot keys the planner may split. Ends
    when the edges are stars: rounds grow with the logarithm of a component's
    diameter. Rounds are written to the shared folder."""
    edges = edges.select("u", "v")
    parts = sized_partitions(edges.count(), EDGES)
    contracted = _contracted(edges, parts)
    if parts == 1:
        return staged(contracted.select(F.col("u").alias("node"), F.col("v").alias("root")), "components")
    now = staged(_directed(contracted), "edges", parts=parts)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # repeats go with the second half's
        large = staged(large.where(F.col("u") != F.col("v")), "edges", parts=2 * parts)
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(low, F.col("u") == F.col("k")).select("v", "m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = staged(_directed(small.unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v")))), "edges", parts=parts)
        ends = now.select(F.col("u").alias("k"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("v").alias("k"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        # no node has two above it in its star, or is both below one and above another
        if ends.groupBy("k").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up > 0 AND down > 0").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))

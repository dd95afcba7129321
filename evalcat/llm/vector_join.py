"""Near-duplicate vectors by an epsilon grid order join.

Cosine >= t of unit vectors is Euclidean distance <= e = sqrt(2 - 2t). Vectors
are projected on their leading principal axes (a projection only shortens
distances, so a distance > e there proves one), sorted by the cells of width e
of that grid, and cut into blocks of the sequence with a bounding box each. A
tree of intervals of the sequence is joined with itself from the root down:
a pair of intervals whose boxes are more than e apart is dropped with all below
it, else its halves go on. Pairs of blocks that are left meet in tasks, which
recurse in the same way down to small leaves and compare these in double
precision (a single-precision product first rules out what is clearly below).

A task returns, per vector and pair of blocks, the number of links and the
smallest vector of its component in that pair: never the pairs of vectors.
Equal vectors are one class, with their number, before the join.

The principal axes are fitted on ``axis_sample`` vectors (those with the
smallest hashes): any axes give the same result, they only decide how much is
skipped.

Vectors of another length are joined by themselves, length by length.

Edge cases: vectors that are null, zero, hold null or non-finite components or
are the only one of their length link with nothing and are their own component. Rows with equal ids are vectors of
their own and link like any others. A null id stays null, takes part, and a
component's id is its smallest non-null one. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalcat.llm.common import arrow_rows, sized_partitions, staged, with_rid
from evalcat.llm.components import connected_components
from evalcat.operators.ranking import with_row_index

BLOCK, LEAF, AXES, FAN = 2048, 256, 4, 8


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, without overflow."""
    x = rows.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, width)


def _usable(v):
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(v.isNotNull() & F.forall(v, good) & F.exists(v, lambda x: x != 0), F.lit(False))


def principal_axes(vectors: DataFrame, width: int, sample: int) -> np.ndarray:
    """width x AXES, orthonormal."""
    rows = vectors.orderBy(F.xxhash64("cid")).limit(max(AXES, min(sample, 20_000_000 // width))).select("v").toArrow()
    x = unit(_matrix(rows.column(0).combine_chunks(), width))
    return np.linalg.eigh(np.cov(x.T) + 0.0 * np.eye(width))[1][:, ::-1][:, :AXES] if width > 1 and len(x) > 1 else np.eye(width)[:, :AXES]


def blocks_in_grid_order(vectors: DataFrame, width: int, axes: np.ndarray, eps: float, block: int, n: int) -> DataFrame:
    """(block, cids, mults, data, lo, hi): runs of the grid order."""
    k = axes.shape[1]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                y = unit(_matrix(b.column("v"), width)) @ axes
                cells = np.floor(y / eps).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(cells[:, i]) for i in range(k))], names=["cid", "mult", "v", *(f"c{i}" for i in range(k))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def made():
            t = pa.Table.from_batches(held).combine_chunks()
            for s in range(0, t.num_rows, block):
                part = t.slice(s, block).combine_chunks().to_batches()[0]
                raw = _matrix(part.column("v"), width)
                y = unit(raw) @ axes
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], t) for x, t in (
                        (part.column("cid").to_numpy().astype("<i8").tobytes(), pa.binary()),
                        (part.column("mult").to_numpy().astype("<i8").tobytes(), pa.binary()),
                        (np.ascontiguousarray(raw).tobytes(), pa.binary()), (raw.dtype.str, pa.string()),
                        (y.min(axis=0).tolist(), pa.list_(pa.float64())), (y.max(axis=0).tolist(), pa.list_(pa.float64())),
                    )],
                    names=["cids", "mults", "data", "kind", "lo", "hi"],
                )

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= block:
                whole = size - size % block
                t = pa.Table.from_batches(held).combine_chunks()
                rest = t.slice(whole).combine_chunks().to_batches()
                held = t.slice(0, whole).to_batches()
                yield from made()
                held, size = rest, size - whole
        if held:
            yield from made()

    kind = dict(vectors.dtypes)["v"]
    cells = [f"c{i}" for i in range(k)]
    on_grid = staged(vectors.mapInArrow(project, f"cid long, mult long, v {kind}, " + ", ".join(f"{c} int" for c in cells)), "vectors")
    runs = on_grid.repartitionByRange(n, *cells, "cid").sortWithinPartitions(*cells, "cid").drop(*cells)
    blocks = runs.mapInArrow(cut, "cids binary, mults binary, data binary, kind string, lo array<double>, hi array<double>")
    return staged(blocks.withColumn("place", F.monotonically_increasing_id()), "vector-blocks", codec="none")


def _apart(a: str, b: str, k: int):
    """Squared distance of two boxes."""
    gap = lambda i: F.greatest(F.lit(0.0), F.col(f"{a}lo")[i] - F.col(f"{b}hi")[i], F.col(f"{b}lo")[i] - F.col(f"{a}hi")[i])
    return sum((gap(i) * gap(i) for i in range(k)), F.lit(0.0))


def interval_pairs(boxes: DataFrame, count: int, eps: float, k: int) -> DataFrame:
    """boxes (block dense from 0, lo, hi). Joins the tree of sequence intervals
    with itself from the root; (a, b), a <= b: pairs of blocks not provably
    apart."""
    depth = 0
    while FAN**depth < count:
        depth += 1
    pairs = boxes.sparkSession.createDataFrame([(0, 0)], "a long, b long")
    for level in range(depth - 1, -1, -1):
        own = boxes.groupBy(F.expr(f"block div {FAN**level}").alias("node")).agg(
            F.array(*[F.min(F.col("lo")[i]) for i in range(k)]).alias("lo"), F.array(*[F.max(F.col("hi")[i]) for i in range(k)]).alias("hi")
        )
        side = lambda p: own.select(F.expr(f"node div {FAN}").alias(f"{p}up"), F.col("node").alias(p), F.col("lo").alias(f"{p}lo"), F.col("hi").alias(f"{p}hi"))
        down = pairs.select(F.col("a").alias("pa"), F.col("b").alias("pb")).join(side("a"), F.col("pa") == F.col("aup")).join(side("b"), F.col("pb") == F.col("bup"))
        pairs = staged(down.where((F.col("a") <= F.col("b")) & (_apart("a", "b", k) <= eps * eps * (1 + 1e-9) + 1e-12)).select("a", "b"), "interval-pairs")
    return pairs


def join_pair(x: np.ndarray, y: np.ndarray | None, axes: np.ndarray, threshold: float, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i in x, j in y; y None: within x, i < j) of unit vectors
    with cosine >= threshold, by recursion over intervals of both."""
    own = y is None
    y = x if own else y
    eps2 = max(0.0, 2 - 2 * threshold) * (1 + 1e-9) + 1e-12
    slack = 1e-5 + 2e-6 * x.shape[1]
    x32, y32 = x.astype(np.float32), y.astype(np.float32)

    def boxes(z):
        p = z @ axes
        starts = np.arange(0, len(z), leaf)
        return np.minimum.reduceat(p, starts), np.maximum.reduceat(p, starts)

    (xl, xh), (yl, yh) = boxes(x), boxes(y)
    found = []

    def go(a0, a1, b0, b1):
        if own and b1 <= a0:
            return
        gap = np.maximum(0, np.maximum(xl[a0:a1].min(0) - yh[b0:b1].max(0), yl[b0:b1].min(0) - xh[a0:a1].max(0)))
        if gap @ gap > eps2:
            return
        if a1 - a0 == 1 and b1 - b0 == 1:
            if own and b0 < a0:
                return
            i, j = np.nonzero(x32[a0 * leaf : a1 * leaf] @ y32[b0 * leaf : b1 * leaf].T >= threshold - slack)
            i, j = i + a0 * leaf, j + b0 * leaf
            if own:
                i, j = i[i < j], j[i < j]
            good = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
            found.append((i[good], j[good]))
        elif a1 - a0 >= b1 - b0:
            m = (a0 + a1) // 2
            go(a0, m, b0, b1)
            go(m, a1, b0, b1)
        else:
            m = (b0 + b1) // 2
            go(a0, a1, b0, m)
            go(a0, a1, m, b1)

    go(0, len(xl), 0, len(yl))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def smallest_linked(n: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Per node the smallest id of its component of the edges (i, j)."""
    rank = np.empty(n, np.int64)
    order = np.argsort(ids, kind="stable")
    rank[order] = np.arange(n)
    label = rank.copy()
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = np.minimum(label, label[order[label]])
        if (label == before).all():
            return ids[order[label]]


def _linked(pairs: DataFrame, blocks: DataFrame, width: int, axes: np.ndarray, threshold: float) -> DataFrame:
    """(cid, links, root) per vector with links, pair of blocks by pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                side = lambda p: (np.frombuffer(r[p + "cids"], "<i8"), np.frombuffer(r[p + "mults"], "<i8"), unit(np.frombuffer(r[p + "data"], r["kind"]).reshape(-1, width)))  # noqa: E731,B023
                ids, mults, x = side("a")
                if r["a"] == r["b"]:
                    i, j = join_pair(x, None, axes, threshold)
                else:
                    ids_b, mults_b, y = side("b")
                    i, j = join_pair(x, y, axes, threshold)
                    j = j + len(ids)
                    ids, mults = np.concatenate([ids, ids_b]), np.concatenate([mults, mults_b])
                if len(i):
                    links = np.bincount(i, weights=mults[j], minlength=len(ids)) + np.bincount(j, weights=mults[i], minlength=len(ids))
                    some = np.flatnonzero(links)
                    root = smallest_linked(len(ids), i, j, ids)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(root[some])], names=["cid", "links", "root"])

    side = lambda p: blocks.select(F.col("block").alias(p), *[F.col(c).alias(p + c) for c in ("cids", "mults", "data")], *(["kind"] if p == "a" else []))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    with arrow_rows(pairs.sparkSession, 4):
        return staged(rows.mapInArrow(run, "cid long, links long, root long"), "vector-links")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, block: int = BLOCK, axis_sample: int = 10_000) -> DataFrame:
    """(id, n_links, component_id, kept) per row: other vectors with cosine >=
    ``threshold``, the smallest id reachable by links, and whether it is the
    row's own."""
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = staged(with_rid(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"))), "vector-rows")
    usable = rows.where(_usable(F.col("v")))
    # lengths of embeddings, of which a table has few
    widths = [r["w"] for r in usable.groupBy(F.size("v").alias("w")).count().where("count > 1").orderBy(F.desc("count"), F.desc("w")).collect()]
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    lone = rows.select("rid", "id", F.col("rid").alias("root"), F.lit(0).cast("long").alias("n_links"))
    if widths:
        lone = lone.join(usable.where(F.size("v").isin(widths)).select("rid"), "rid", "left_anti")
    for width in widths:
        own = usable.where(F.size("v") == width)
        classes = staged(own.groupBy("v").agg(F.min("rid").alias("cid"), F.count(F.lit(1)).alias("mult")), "vector-classes")
        count = classes.count()
        axes = principal_axes(classes, width, axis_sample)
        n = sized_partitions(count, 4 * block)
        blocks = blocks_in_grid_order(classes.select("cid", "mult", "v"), width, axes, max(eps, 1e-6), block, n)
        order = staged(with_row_index(blocks.select("place", "lo", "hi"), ["place"], "block", num_partitions=1), "block-order")
        blocks = blocks.drop("lo", "hi").join(order.select("place", "block"), "place")
        pairs = interval_pairs(order, order.count(), eps, axes.shape[1])
        found = _linked(pairs, blocks, width, axes, threshold)
        links = found.groupBy("cid").agg(F.sum("links").alias("links"))
        roots = connected_components(found.select(F.col("cid").alias("u"), F.col("root").alias("v")))
        member = own.select("rid", "id", "v").join(classes, "v").select("rid", "id", "cid", "mult")
        member = member.join(links, "cid", "left").join(roots, F.col("cid") == F.col("node"), "left")
        member = member.select("rid", "id", F.coalesce("root", "cid").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
        lone = lone.unionByName(member)
    lone = staged(lone, "vector-members")
    smallest = lone.groupBy("root").agg(F.min("id").alias("component_id"))
    return lone.join(smallest, "root").select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))

"""Best-fit packing of tokenized documents into fixed-size sequences.

Hierarchical residual packing. Pieces are dealt by hash into groups of about
``per_task``; each group is packed by best fit (longest first, into the bin with
the least room that still holds it). Bins with at most ``tolerance`` free
tokens, and all others once one group is left, are sequences. The underfull
bins go to the next level as items: groups merge, and best fit runs again over
bins, so the tree has about log(groups) levels and no task ever gets more than
a few times ``per_task`` rows. A level that merges next to nothing ends the
climb, so a table whose bins can't be merged isn't gathered in one task.

Only (child, parent, offset) rows leave a level; final places come from joining
the levels, and token ids are never shuffled.

Edge cases: a null text is empty; an empty document is the end id alone; a
repeated row is a document of its own (``item_id`` tells rows apart); a null
doc_id stays null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalcat.llm.common import sized_partitions, staged, text_rows, with_rid

CAPACITY = 4096
_PIECES = "doc_id long, piece int, start long, length long, ids binary"


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents: (doc_id, piece, start, length, ids), ids as
    little-endian unsigned 32-bit integers. Only documents of more than
    ``capacity`` ids (end id included) are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from evalcat.llm.textcache import in_slices
        from evalcat.llm.tokens import coder

        code = coder(tokenizer)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in in_slices(texts):
                ids, lens = code(texts[a:b])
                rows, at = [], 0
                for doc, n in zip(doc_ids[a:b], lens.tolist()):
                    own = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    rows += [(doc, k, s, min(capacity, n + 1 - s), own[s : s + capacity].tobytes()) for k, s in enumerate(range(0, n + 1, capacity))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    return text_rows(docs).mapInArrow(run, _PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in it of each item; ``sizes`` in descending order. Bins
    are kept by free room; a big integer's bits tell which rooms exist."""
    bins, places = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = made = 0
    for i, size in enumerate(sizes.tolist()):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, made
            made += 1
        bins[i], places[i] = b, capacity - room
        left = room - size
        if left:
            if not by_room[left]:
                rooms |= 1 << left
            by_room[left].append(b)
    return bins, places


def _level(items: DataFrame, level: int, groups: int, capacity: int, tolerance: int) -> DataFrame:
    """items (child, size) -> (child, parent, at, filled, closed)."""

    def pack(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "child"], ascending=[False, True])
        size = rows["size"].to_numpy()
        bins, at = best_fit(size, capacity)
        filled = np.bincount(bins, weights=size).astype(np.int64)[bins]
        # unique over levels and groups: 5 + 33 + 25 bits
        parent = (np.int64(level) << 58) + (np.int64(key[0]) << 25) + bins
        return pd.DataFrame({"child": rows["child"], "parent": parent, "at": at, "filled": filled, "closed": filled >= capacity - tolerance})

    group = F.pmod(F.xxhash64(F.col("child"), F.lit(level)), F.lit(groups))
    out = items.select("child", "size", group.alias("g")).groupBy("g").applyInPandas(pack, "child long, parent long, at long, filled long, closed boolean")
    return staged(out, f"pack-{level}")


def pack_items(items: DataFrame, capacity: int = CAPACITY, per_task: int = 4096, tolerance: int = 8) -> DataFrame:
    """items: (item_id long, unique; length long, 1 to ``capacity``). Returns
    (item_id, sequence_id, offset). Full items are sequences without any
    shuffle."""
    full = items.where(F.col("length") >= capacity).select("item_id", (-F.col("item_id") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    todo = items.where(F.col("length") < capacity).select(F.col("item_id").alias("child"), F.col("length").alias("size"))
    left, level, levels = todo.count(), 0, []
    while left:
        groups = sized_partitions(left, per_task)
        packed = _level(todo, level, groups, capacity, tolerance)
        levels.append(packed)
        todo = packed.where(~F.col("closed") & (F.col("at") == 0)).select(F.col("parent").alias("child"), F.col("filled").alias("size"))
        before, left, level = left, todo.count(), level + 1
        if groups == 1 or left > 0.98 * before:
            break
    placed = None
    for packed in levels:
        step = packed.select("child", "parent", "at")
        if placed is None:
            placed = step.select(F.col("child").alias("item_id"), F.col("parent").alias("sequence_id"), F.col("at").alias("offset"))
        else:
            placed = placed.join(step, F.col("sequence_id") == F.col("child"), "left").select(
                "item_id", F.coalesce("parent", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("at", F.lit(0))).alias("offset")
            )
    return full if placed is None else full.unionByName(placed)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """(pieces with ``item_id`` and ids, places). ``sequences`` joins them."""
    pieces = staged(with_rid(tokenize(docs, tokenizer, end_id, capacity), "item_id"), "pieces")
    return pieces, pack_items(pieces.select("item_id", "length"), capacity)


def sequences(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences themselves. A group is
    one sequence, so it holds at most its capacity."""
    rows = pieces.join(places, "item_id").select("sequence_id", F.struct("offset", "ids").alias("p"))
    return rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list("p")).alias("p")).select(
        "sequence_id",
        F.aggregate("p", F.lit(0).cast("long"), lambda n, p: n + F.shiftright(F.octet_length(p["ids"]), 2).cast("long")).alias("length"),
        F.aggregate("p", F.lit(b""), lambda s, p: F.concat(s, p["ids"])).alias("ids"),
    )

"""Benchmark passages in documents, by SimHash windows and exact similarity.

For an item of n words every run of n words of a document is a window. Windows
and items are weighted multisets of five-word shingles; each has a 64-bit
SimHash. Fingerprints are cut into PARTS; two within RADIUS bits differ by at
most RADIUS // PARTS bits in some part, so tables that list, per part and value,
the items that near it give every item within RADIUS of a window, without
exception. Those are compared exactly: weighted Jaccard >= threshold.

A window is only fingerprinted if at least LEAST of its shingles occur in some
item: weights lie between FLOOR and 1 a time, so no other can reach the
threshold. Nothing of a document leaves its task but its leaks.

Items are taken to the tasks in blocks of at most BLOCK_ITEMS, chosen by hash;
documents are read once for each block, so any number of items will do. Weights
follow from all items: a shingle of one item weighs 1, so only the shingles that
several items hold, with their numbers of items, go along with every block.

Edge cases: null texts are empty; items without words match nothing; an item of
fewer than five words has one shingle, all of them; repeated items and rows are
each reported; null ids stay null; an empty benchmark leaves documents without
leaks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE, RADIUS, PARTS, FLOOR = 5, 20, 8, 0.75
BLOCK_ITEMS = 20_000
LEAKS = "array<struct<item_id:bigint,similarity:double,start_word:int,words:int,distance:int>>"
U = np.uint64


def _signs(shingles: np.ndarray) -> np.ndarray:
    """A row of 64 signs per shingle."""
    bits = np.unpackbits(np.ascontiguousarray(shingles, "<u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.float32) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1)


class Items:
    """A block of items, ready to be matched."""

    def __init__(self, rows: list[tuple[int | None, str]], common: tuple[np.ndarray, np.ndarray, int] | None = None):
        """common: ``common_shingles`` of all items, if these aren't all."""
        from evalcat.llm.textcache import shingle_hashes, word_hashes

        words, lens = word_hashes([t for _, t in rows])
        self.groups: dict[int, dict] = {}
        shingles, n = shingle_hashes(words, lens, SHINGLE)
        ends = np.cumsum(n)
        sets = [shingles[e - k : e] for e, k in zip(ends.tolist(), n.tolist())]
        seen = Counter(s for one in sets for s in set(one.tolist()))
        self.known = np.array(sorted(seen), np.uint64)
        if common is None:
            often = sorted(s for s, k in seen.items() if k > 1)
            common = np.array(often, np.uint64), np.array([seen[s] for s in often], np.int64), len(rows)
        self.common, count, total = common[0], common[1], max(2, common[2])
        self.weight = FLOOR + (1 - FLOOR) * np.log(total / count) / np.log(total)
        for (item, _), size, own in zip(rows, lens.tolist(), sets):
            if size:
                g = self.groups.setdefault(size, {"ids": [], "sets": [], "marks": []})
                w = self.weights(own)
                g["ids"].append(item)
                g["sets"].append(weighted(own, w))
                g["marks"].append(_packed((_signs(own) * w[:, None]).sum(axis=0, keepdims=True))[0])
        for g in self.groups.values():
            g["marks"] = np.array(g["marks"], np.uint8)
            value = np.arange(256, dtype=np.uint8)
            # near[part][value]: items whose part is within RADIUS // PARTS bits of the value
            g["near"] = [np.bitwise_count(value[:, None] ^ g["marks"][:, p][None, :]) <= RADIUS // PARTS for p in range(PARTS)]

    def weights(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.common):
            return np.ones(len(shingles))
        at = np.minimum(np.searchsorted(self.common, shingles), len(self.common) - 1)
        return np.where(self.common[at] == shingles, self.weight[at], 1.0)

    def hits(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(shingles), bool)
        at = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
        return self.known[at] == shingles


def common_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of more than one of all items (item_id, text), sorted, and how
    many items hold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from evalcat.llm.textcache import in_slices, shingle_hashes, word_hashes

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in in_slices(texts):
                shingles, n = shingle_hashes(*word_hashes(texts[a:b]), SHINGLE)
                ends = np.cumsum(n)
                own = [np.unique(shingles[e - k : e]) for e, k in zip(ends.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64))], names=["s"])

    got = rows.select("text").mapInArrow(run, "s long").groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1").toArrow()
    shingles, count = got["s"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(shingles)
    return shingles[order], count[order]


def weighted(shingles: np.ndarray, weights: np.ndarray) -> dict[int, float]:
    out: dict[int, float] = {}
    for s, w in zip(shingles.tolist(), weights.tolist()):
        out[s] = out.get(s, 0.0) + w
    return out


def weighted_jaccard(a: dict[int, float], b: dict[int, float]) -> float:
    both = sum(min(w, b[s]) for s, w in a.items() if s in b)
    either = sum(a.values()) + sum(b.values()) - both
    return both / either if either else 0.0


def leaks_of(words: np.ndarray, items: Items, threshold: float) -> list[tuple]:
    """(item_id, similarity, start_word, words, distance): of each item the
    best window, the first of equal ones."""
    from evalcat.llm.textcache import shingle_hashes

    best: dict[tuple[int, int], tuple] = {}
    ready: dict[int, tuple] = {}
    for size, g in items.groups.items():
        if size > len(words):
            continue
        wide = min(size, SHINGLE)
        if wide not in ready:
            s, _ = shingle_hashes(words, np.array([len(words)]), wide)
            ready[wide] = (s, items.weights(s), np.concatenate([[0], np.cumsum(items.hits(s))]), None)
        s, w, hit, sums = ready[wide]
        n = size - wide + 1
        starts = np.flatnonzero(hit[n:] - hit[: len(hit) - n] >= max(1, int(np.ceil(threshold * FLOOR * n - 1e-9))))
        if not len(starts):
            continue
        if sums is None:
            sums = np.concatenate([np.zeros((1, 64)), np.cumsum(_signs(s) * w[:, None], axis=0, dtype=np.float64)])
            ready[wide] = (s, w, hit, sums)
        marks = _packed(np.round(sums[starts + n] - sums[starts], 9))
        maybe = np.zeros((len(starts), len(g["ids"])), bool)
        for p in range(PARTS):
            maybe |= g["near"][p][marks[:, p]]
        i, j = np.nonzero(maybe)
        distance = np.bitwise_count(marks[i] ^ g["marks"][j]).sum(axis=1)
        for a, b, d in zip(i.tolist(), j.tolist(), distance.tolist()):
            if d <= RADIUS:
                at = int(starts[a])
                sim = weighted_jaccard(weighted(s[at : at + n], w[at : at + n]), g["sets"][b])
                if sim >= threshold and sim > best.get((size, b), (0, 0.0))[1]:
                    best[size, b] = (g["ids"][b], sim, at, size, d)
    return [best[k] for k in sorted(best)]


def with_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``docs`` with a column ``leaks``: the items found in each document. A
    column of that name is replaced."""
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c != "leaks"]
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.lit(None).cast(LEAKS).alias("leaks"))
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.count()
    blocks = max(1, -(-total // block_items))
    common = spark.sparkContext.broadcast((*common_shingles(rows), total)) if blocks > 1 else None
    for block in range(blocks):
        # about block_items rows, whatever the benchmark's size
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text")
        items = [(r["item_id"], r["text"]) for r in own.collect()]
        if not items:
            continue
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            from evalcat.llm.textcache import in_slices, shingle_hashes, word_hashes

            items = Items(shared.value, common and common.value)
            small = {k for k in items.groups if k < SHINGLE}
            for batch in batches:
                texts, found = batch.column(1).to_pylist(), []
                for a, b in in_slices(texts):
                    words, lens = word_hashes(texts[a:b])
                    hit = np.zeros(b - a, bool)
                    for wide in {SHINGLE, *small}:
                        s, n = shingle_hashes(words, lens, wide)
                        hit[np.repeat(np.arange(b - a), n)[items.hits(s)]] = True
                    ends = np.cumsum(lens)
                    for i in range(b - a):
                        found.append(leaks_of(words[ends[i] - lens[i] : ends[i]], items, threshold) if hit[i] else [])
                before = batch.column(2).to_pylist()
                fields = ("item_id", "similarity", "start_word", "words", "distance")
                both = pa.array([[*(x or []), *(dict(zip(fields, f)) for f in y)] for x, y in zip(before, found)], batch.schema.field("leaks").type)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), both], schema=batch.schema)

        out = out.mapInArrow(run, out.schema)
    return out.select(*[F.col("row")[c].alias(c) for c in kept], F.coalesce("leaks", F.array().cast(LEAKS)).alias("leaks"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` without documents that hold a benchmark item."""
    own = docs.columns
    marked = with_leaks(docs.withColumnRenamed("leaks", "_own_leaks") if "leaks" in own else docs, benchmark, threshold)
    clean = marked.where(F.size("leaks") == 0).drop("leaks")
    return clean.withColumnRenamed("_own_leaks", "leaks") if "leaks" in own else clean

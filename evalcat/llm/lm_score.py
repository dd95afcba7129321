"""Language-model scores of documents: stupid backoff over n-gram counts.

Counted are all n-grams of 1 to ``order`` words of all documents; a document is
scored by the counts of all others (its own are taken off), so a text isn't
likely for having been counted. With c the counts left and ctx the words before,
S(w | ctx) = c(ctx w) / c(ctx) if c(ctx w) > 0, else ALPHA * S(w | shorter ctx);
S(w) = c(w) / N, for an unseen word 1 / (N + 1), N the words of the others.

The join is by hash: documents are dealt into blocks of rows; a block asks once
for each n-gram it has (its hash, how often it has it), whatever number of its
documents do. Its requests are sorted, cut by the hashes' leading bits into
parts and travel as one packed row per part (gaps of hashes, then counts). One
shuffle by part adds up the counts of all blocks and answers in the order of the
requests, so answers need no hashes. Parts grow in number with the words, so
each holds about PART_GRAMS n-grams whatever the input. A second shuffle brings
answers and texts of a block together, where scores are summed per document.

``docs`` must read alike each time, in rows and order, as any table of files does
(stage others first); a block whose counts differ between reads is an error.

Edge cases: a null text is empty; a text without words has no score (null) and
0 words; repeated rows count and are scored each; a null doc_id stays null; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalcat.llm.common import sized_partitions, text_rows

ORDER, ALPHA, BLOCK_BITS, PART_GRAMS = 2, 0.4, 13, 1 << 21
_SALT = np.uint64(0x51ED270B)


def grams(words: np.ndarray, lens: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n-gram that ends at each word, 0 where there is none, and
    whether there is one."""
    from evalcat.llm.textcache import MULT, mixed

    place = np.arange(len(words)) - np.repeat(np.cumsum(lens) - lens, lens)
    full = place >= n - 1
    out = np.zeros(len(words), np.uint64)
    for k in range(n):
        out[n - 1 :] = mixed((out[n - 1 :] + words[k : len(words) - n + 1 + k]) * MULT + np.uint64(n) * _SALT) if len(words) >= n else 0
    return np.where(full, out, 0).astype(np.uint64), full


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes: mostly small ones take little
    more than a byte."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def unpacked(blob: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(pa.decompress(blob, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel()


def _counted(parts: list[tuple[np.ndarray, np.ndarray]], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a block in ascending order and how often it has them."""
    held = [g[full] for p in parts for g, full in (grams(*p, n) for n in range(1, order + 1))]
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)


def _asked(batches: Iterator[pa.RecordBatch], order: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (place, text) in place order -> (part, block, n, gaps, counts), a
    row per part that the block has n-grams in."""
    from evalcat.llm.textcache import in_slices, word_hashes

    held: list[tuple[np.ndarray, np.ndarray]] = []
    now = None

    def made(block):
        h, c = _counted(held, order)
        part = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        ends = np.append(starts[1:], len(h))
        gaps = [packed(np.diff(h[s:e], prepend=np.uint64(0))) for s, e in zip(starts, ends)]
        counts = [packed(c[s:e]) for s, e in zip(starts, ends)]
        return pa.RecordBatch.from_arrays(
            [pa.array(part[starts]), pa.array(np.full(len(starts), block, np.int64)), pa.array(ends - starts, pa.int64()), pa.array(gaps, pa.binary()), pa.array(counts, pa.binary())],
            names=["part", "block", "n", "gaps", "counts"],
        )

    for batch in batches:
        blocks, texts = batch.column(0).to_numpy() >> BLOCK_BITS, batch.column(1).to_pylist()
        edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(texts)]
        for s, e in zip(edges, edges[1:]):
            if s == e:
                continue
            if now is not None and blocks[s] != now and held:
                yield made(now)
                held = []
            now = int(blocks[s])
            held += [word_hashes(texts[s + a : s + b]) for a, b in in_slices(texts[s:e])]
    if held:
        yield made(now)


def _answered(asked: pa.Table) -> pa.Table:
    """All requests of a part -> (block, part, n, totals): the counts in all, in
    the order of the requests."""
    n = asked.column("n").to_numpy()
    h = np.concatenate([np.cumsum(unpacked(g, k), dtype=np.uint64) for g, k in zip(asked.column("gaps").to_pylist(), n.tolist())])
    c = np.concatenate([unpacked(x, k) for x, k in zip(asked.column("counts").to_pylist(), n.tolist())])
    order = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.diff(h[order], prepend=~h[order[:1]]))
    sums = np.add.reduceat(c[order], first)
    total = np.empty(len(h), np.uint64)
    total[order] = np.repeat(sums, np.diff(np.append(first, len(h))))
    ends = np.cumsum(n)
    blobs = [packed(total[e - k : e]) for e, k in zip(ends.tolist(), n.tolist())]
    return pa.table([asked.column("block"), asked.column("part"), asked.column("n"), pa.array(blobs, pa.binary())], names=["block", "part", "n", "totals"])


def score_block(texts: list[str], total: np.ndarray, words_in_all: int, order: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(sum of log scores, words) per text; total: counts in all of the block's
    distinct n-grams, in ascending order of their hashes."""
    from evalcat.llm.textcache import in_slices, word_hashes

    parts = [word_hashes(texts[a:b]) for a, b in in_slices(texts)]
    keys, here = _counted(parts, order)
    if len(keys) != len(total) or (total < here).any():
        raise ValueError("the documents changed between two reads")
    tables = dict.fromkeys(range(1, order + 1), (keys, total))
    got = [score_slice(*p, tables, words_in_all, order, alpha) for p in parts]
    return np.concatenate([np.zeros(0), *got]), np.concatenate([np.zeros(0, np.int64), *[p[1] for p in parts]])


def score_slice(words: np.ndarray, lens: np.ndarray, tables: dict, words_in_all: int, order: int, alpha: float) -> np.ndarray:
    """Sums of log scores of texts, given the counts of all their n-grams."""
    doc = np.repeat(np.arange(len(lens)), lens)
    left = {}
    for n in range(1, order + 1):
        g, full = grams(words, lens, n)
        keys, total = tables[n]
        if not len(keys):
            left[n] = (np.zeros(len(words), np.int64),)
            continue
        at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
        # times the n-gram occurs in the document itself
        pair = doc * np.int64(len(keys) + 1) + np.where(full, at, len(keys))
        _, inverse, own = np.unique(pair, return_inverse=True, return_counts=True)
        left[n] = (np.where(full, total[at] - own[inverse], 0),)
    others = words_in_all - lens[doc]
    unigram = np.where(left[1][0] > 0, left[1][0], 1) / np.where(left[1][0] > 0, others, others + 1)
    best, done = np.log(unigram), np.zeros(len(words), bool)
    place = np.arange(len(words)) - (np.cumsum(lens) - lens)[doc]
    backoffs = np.minimum(place, order - 1) * np.log(alpha)  # if all longer ones are unseen
    best = best + backoffs
    for n in range(order, 1, -1):
        c = left[n][0]
        context = np.zeros(len(words), np.int64)
        context[1:] = left[n - 1][0][:-1]  # the (n-1)-gram that ends one word before
        use = (c > 0) & ~done
        steps = np.minimum(place, order - 1) - (n - 1)
        best[use] = np.log(c[use] / context[use]) + steps[use] * np.log(alpha)
        done |= use
    return np.bincount(doc, best, len(lens))


def lm_scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, words, log_score, mean_log_score) per row."""
    rows = text_rows(docs).withColumn("place", F.monotonically_increasing_id())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from evalcat.llm.textcache import in_slices, word_hashes

        total = 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            total += sum(int(word_hashes(texts[a:b])[1].sum()) for a, b in in_slices(texts))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["n"])

    words_in_all = rows.select("text").mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0
    bits = (sized_partitions(words_in_all * order, PART_GRAMS) - 1).bit_length()
    asked = rows.select("place", "text").mapInArrow(lambda b: _asked(b, order, bits), "part long, block long, n long, gaps binary, counts binary")
    answers = asked.groupBy("part").applyInArrow(_answered, "block long, part long, n long, totals binary")

    def score(key, docs_: pa.Table, answers_: pa.Table) -> pa.Table:
        answers_ = answers_.sort_by("part")
        some = zip(answers_.column("totals").to_pylist(), answers_.column("n").to_pylist())
        counts = np.concatenate([np.zeros(0, np.uint64), *[unpacked(t, k) for t, k in some]]).astype(np.int64)
        total, lens = score_block(docs_.column("text").to_pylist(), counts, words_in_all, order, alpha)
        none = lens == 0
        return pa.table([docs_.column("doc_id"), pa.array(lens, pa.int64()), pa.array(total, mask=none), pa.array(total / np.maximum(lens, 1), mask=none)], names=["doc_id", "words", "log_score", "mean_log_score"])

    blocks = rows.select("doc_id", "text", F.shiftright("place", BLOCK_BITS).alias("block"))
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, "doc_id long, words long, log_score double, mean_log_score double")

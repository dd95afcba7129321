"""Near-duplicate documents by improved consistent weighted sampling.

A document is its weighted set of five-word shingles: times in it, times a
smoothed inverse document frequency. Document frequencies are counted over all
documents in BUCKETS hashed counters; a shingle whose bucket holds less than
COMMON of all documents weighs 1 per occurrence, one in every document FLOOR.
Buckets beyond that share are few whatever the corpus: at most (mean shingles
of a document) / COMMON, so they are the only thing broadcast.

Each of BANDS x ROWS samples picks one (shingle, level) of a document with
improved consistent weighted sampling: two documents pick the same with
probability equal to their weighted Jaccard similarity. For a weight of 1 the
sample's key is a plain hash; from it follow, by inverse transforms, the Gamma
and uniform variables of the general case, so other weights stay consistent.

Documents that agree on all samples of a band share a bucket. In each bucket
one document is compared with every other (weighted Jaccard, whole texts): linear
in the bucket. Then, in rounds, each bucket whose members are of several classes
picks a pivot from the class with the most of them and compares it with the
members of all others: a group of near copies on both sides of the threshold
comes together in a few rounds, each linear in what is left of it. Rounds end
when one finds no link, or after PIVOTS. Weighted Jaccard distance is a metric,
so of two members that are still of two classes only those can be linked whose
distances from the first document differ by at most 1 - threshold. And two
documents have in common at most what either shares with any open member: of
near copies with edits of their own, this tells which are still near enough; it
holds in each of CELLS cells of the hashes too, which sees what one lacks there.
Exactly the pairs that these bounds allow are compared as well. No link between bucket mates that changes a class is lost, and copies are
never expanded into pairs. Equal texts are one class before any of this.

Edge cases: a null text is empty; equal texts are one class, empty ones too;
a text without words is like no other text; one of fewer than five words has one
shingle, all of them; a null doc_id stays null and sorts last; repeated rows are
rows of one class, one of which is kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalcat.llm.common import arrow_rows, sized_partitions, staged
from evalcat.llm.components import connected_components

SHINGLE, BANDS, ROWS, PIVOTS, CELLS = 5, 14, 4, 3, 128
#: Documents to a task where steps write: small tables aren't dealt to more tasks than they need.
DOCS = 4000
BUCKETS, COMMON, FLOOR = 1 << 19, 0.01, 0.75
U = np.uint64
_rng = np.random.default_rng(20)
_XOR = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_MUL = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) | U(1)


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in ascending order, how often each
    occurs in it, and how many distinct ones each text has."""
    from evalcat.llm.textcache import shingle_hashes, word_hashes

    words, lens = word_hashes(texts)
    shingles, n = shingle_hashes(words, lens, SHINGLE)
    doc = np.repeat(np.arange(len(texts)), n)
    order = np.lexsort((shingles, doc))
    s, d = shingles[order], doc[order]
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(first)
    times = np.diff(np.append(at, len(s)))
    return s[at], times, np.bincount(d[at], minlength=len(texts))


def bucket_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> U(40)).astype(np.int64) & (BUCKETS - 1)


def common_buckets(texts: DataFrame, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets in ascending order, weight of their shingles) of all buckets
    that hold at least COMMON of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from evalcat.llm.textcache import in_slices

        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            t = batch.column(0).to_pylist()
            for a, b in in_slices(t):
                s, _, n = shingle_sets(t[a:b])
                # a document counts once per bucket
                keys = np.unique(np.repeat(np.arange(b - a), n) * BUCKETS + bucket_of(s))
                total += np.bincount(keys % BUCKETS, minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    counts = texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    got = counts.where(F.col("n") > max(2.0, COMMON * count)).collect()
    got.sort(key=lambda r: r["bucket"])
    share = np.array([r["n"] / max(1, count) for r in got])
    return np.array([r["bucket"] for r in got], np.int64), FLOOR + (1 - FLOOR) * np.clip(np.log(1 / np.maximum(share, 1e-12)) / np.log(1 / COMMON), 0, 1)


def weighted_sets(texts: list[str], common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles, weights, and how many each text has."""
    s, times, n = shingle_sets(texts)
    weight = times.astype(np.float64)
    if len(common[0]):
        bucket = bucket_of(s)
        at = np.minimum(np.searchsorted(common[0], bucket), len(common[0]) - 1)
        weight *= np.where(common[0][at] == bucket, common[1][at], 1.0)
    return s, weight, n


def sample_keys(s: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """The k-th sample's keys of weighted shingles; the smallest of a document
    is its sample."""
    from evalcat.llm.textcache import mixed

    key = (s ^ _XOR[k]) * _MUL[k]
    other = np.flatnonzero(weight != 1.0)
    if len(other):
        uniform = lambda h: ((h >> U(11)).astype(np.float64) + 0.5) / 2.0**53
        h = key[other]
        a = -np.log1p(-uniform(h))
        c = a - np.log(uniform(mixed(h)))  # Gamma(2, 1), given that a = c * exp(-z)
        z = np.log(c / a)
        r = z - np.log(uniform(mixed(mixed(h) + U(1))))  # Gamma(2, 1), given that z = r * (1 - beta)
        beta = 1 - z / r
        t = np.floor(np.log(weight[other]) / r + beta)
        least = np.where(t == 0, a, c * np.exp(-r * (t - beta + 1)))
        moved = (-np.expm1(-least) * 2.0**64).clip(0, 2.0**64 - 4096).astype(np.uint64)
        key[other] = np.where(t == 0, h, moved)
    return key


def band_hashes(texts: list[str], common) -> tuple[np.ndarray, np.ndarray]:
    """(indices of texts with words, a row of BANDS hashes for each)."""
    from evalcat.llm.textcache import mixed

    s, weight, n = weighted_sets(texts, common)
    some = np.flatnonzero(n)
    out = np.zeros((len(some), BANDS), np.uint64)
    if len(some):
        starts = (np.cumsum(n) - n)[some]
        for k in range(BANDS * ROWS):
            b = k // ROWS
            out[:, b] = mixed(out[:, b] + np.minimum.reduceat(sample_keys(s, weight, k), starts) + U(b))
    return some, out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two (ascending shingles, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    either = float(a[1].sum() + b[1].sum()) - both
    return both / either if either else 0.0


def _texts_of(rids: DataFrame, texts: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    # hinted, so that it is the same plan at every size
    return staged(texts.select("rid", "text").hint("shuffle_merge").join(rids.select("rid").distinct(), "rid", "left_semi"), name, parts=parts)


def _compared(pairs: DataFrame, texts: DataFrame, common, parts: int | None = None) -> DataFrame:
    """pairs (a, b and any other columns) with their similarity; texts (rid, text)."""
    kept = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ta, tb = (batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))
            of = {**dict(zip(a, ta)), **dict(zip(b, tb))}
            ids = list(of)
            s, w, n = weighted_sets(list(of.values()), common)
            ends = np.cumsum(n)
            at = {i: (s[e - k : e], w[e - k : e]) for i, e, k in zip(ids, ends.tolist(), n.tolist())}
            scores = pa.array([similarity(at[x], at[y]) for x, y in zip(a, b)], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), scores], names=[*kept, "similarity"])

    side = lambda p: texts.select(F.col("rid").alias(p), F.col("text").alias(f"t{p}")).hint("shuffle_merge")
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select(*kept, "ta", "tb")
    with arrow_rows(pairs.sparkSession, 1000):
        return staged(rows.mapInArrow(run, pairs.schema.add("similarity", "double")), "compared", parts=parts)


def links(texts: DataFrame, first: DataFrame, count: int, threshold: float) -> DataFrame:
    """texts (rid, text), ``count`` rows; first (rid): one row of each distinct
    text, the others have no part in it. Returns (a, b, similarity), a < b:
    links whose components are the near-duplicate classes."""
    common = common_buckets(texts.select("text"), count)
    parts = sized_partitions(count, DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from evalcat.llm.textcache import in_slices

        for batch in batches:
            rid, t = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in in_slices(t):
                some, bands = band_hashes(t[a:b], common)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(rid[a:b][some], BANDS)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(some))), pa.array(bands.ravel().view(np.int64))],
                    names=["rid", "band", "hash"],
                )

    members = texts.select("rid", "text").mapInArrow(run, "rid long, band int, hash long")
    members = staged(members.join(first.hint("shuffle_merge"), "rid", "left_semi"), "bands", parts=parts)
    # which document of a bucket is compared with the others depends on the band: what one leaves apart, another often joins
    buckets = members.groupBy("band", "hash").agg(F.min_by("rid", F.struct(F.xxhash64("rid", F.col("band") % 4), "rid")).alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    shared = staged(members.join(buckets, ["band", "hash"]), "bucket-members", parts=parts)
    pairs = shared.where(F.col("rid") != F.col("rep")).groupBy(F.least("rep", "rid").alias("a"), F.greatest("rep", "rid").alias("b"))
    pairs = pairs.agg(F.collect_list(F.struct("band", "hash", "rid")).alias("members"))
    stars = _compared(pairs, _texts_of(shared, texts, "compared-texts", parts), common, parts)
    found = stars.where(F.col("similarity") >= threshold).select("a", "b", "similarity")
    if stars.where(F.col("similarity") < threshold).isEmpty():
        return found
    # what the stars leave open, see above
    scored = stars.select(F.explode("members").alias("m"), "similarity").select("m.*", "similarity")
    # the compared one itself is in its bucket, too
    scored = scored.unionByName(shared.where(F.col("rid") == F.col("rep")).select("band", "hash", "rid", F.lit(1.0).alias("similarity")))
    tried = stars.select("a", "b")
    # buckets that are one class by now need nothing more
    known = _open_members(scored, found, parts)
    texts = _texts_of(known, texts, "open-texts", parts)
    shared_cells = _shared_weights(None, texts, common)
    known = staged(known.join(shared_cells.drop("cells"), "rid"), "weighed-members", parts=parts)
    for i in range(PIVOTS):
        # the least edited of a class, roughly, links the most
        best = F.struct(F.round(F.col("shared") / F.col("weight"), 1 if i else 3).alias("r"), F.xxhash64("rid", F.lit(i)).alias("h"), "rid")
        pivots = known.groupBy("band", "hash", "root").agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("rid", "weight", "shared"), best).alias("p"))
        pivots = pivots.groupBy(F.col("band").alias("p_band"), F.col("hash").alias("p_hash")).agg(F.max_by(F.struct("p.rid", "p.weight", "p.shared", "root"), F.struct("n", "root")).alias("p"))
        met = known.join(pivots, (F.col("band") == F.col("p_band")) & (F.col("hash") == F.col("p_hash"))).where((F.col("root") != F.col("p.root")) & _can_reach("", "p.", threshold))
        pairs = staged(met.select(F.least("rid", "p.rid").alias("a"), F.greatest("rid", "p.rid").alias("b")).distinct(), "pivot-pairs", parts=parts)
        more = _compared(pairs, texts, common, parts).where(F.col("similarity") >= threshold)
        tried = tried.unionByName(pairs)
        if more.isEmpty():
            break
        found = found.unionByName(more)
        known = _open_members(known.drop("root"), found, parts)
    # what no pivot has joined: pair by pair, if all bounds allow a link. The cells are in the join's condition, so that only such pairs are made
    some = F.col("shared") >= F.col("weight") * (threshold - 1e-9)
    known = known.where(some).join(_small_cells(shared_cells), "rid")
    other = known.select(*[F.col(c).alias(f"x_{c}") for c in ("band", "hash", "rid", "similarity", "root", "weight", "shared", "unit", "cells")])
    near = F.abs(F.col("similarity") - F.col("x_similarity")) <= 1 - threshold + 1e-9
    may = (F.col("root") != F.col("x_root")) & (F.col("rid") < F.col("x_rid")) & near & _can_reach("", "x_", threshold)
    may = F.when(may, _can_share("", "x_", threshold)).otherwise(False)
    open_ = known.join(other, (F.col("band") == F.col("x_band")) & (F.col("hash") == F.col("x_hash")) & may)
    rest = open_.select(F.col("rid").alias("a"), F.col("x_rid").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    return found.unionByName(_compared(staged(rest, "open-pairs", parts=parts), texts, common, parts).where(F.col("similarity") >= threshold))


def _can_reach(p: str, q: str, threshold: float):
    """Whether two documents can be that similar: they have no more in common
    than either shares with any document."""
    both = F.least(F.col(f"{p}shared"), F.col(f"{q}shared"))
    return both >= (F.col(f"{p}weight") + F.col(f"{q}weight") - both) * (threshold - 1e-9)


def _small_cells(shared: DataFrame) -> DataFrame:
    """(rid, unit, cells): cells as small numbers of units, rounded up."""
    unit = F.greatest(F.array_max("cells") / 126, F.lit(1e-9))
    return shared.select("rid", unit.alias("unit"), F.transform("cells", lambda c: F.ceil(c / unit).cast("tinyint")).alias("cells"))


def _can_share(p: str, q: str, threshold: float):
    """The same cell by cell: in none have they more in common than either shares there."""
    least = lambda x, y: F.least(x * F.col(f"{p}unit"), y * F.col(f"{q}unit"))
    both = F.aggregate(F.zip_with(f"{p}cells", f"{q}cells", least), F.lit(0.0), lambda x, y: x + y)
    # named once, so that it isn't worked out ahead of the cheaper conditions
    return both * (1 + threshold) >= (F.col(f"{p}weight") + F.col(f"{q}weight")) * (threshold - 1e-6)


def _shared_weights(rids: DataFrame | None, texts: DataFrame, common) -> DataFrame:
    """(rid, weight, shared, cells): of each of these documents (None: of all
    texts) the weight of its shingles, of those that any other of these documents has, and of the latter
    in each of CELLS cells of the hashes. Shingles meet by hash in parts of some
    hundred documents' worth, packed."""
    some = texts if rids is None else _texts_of(rids, texts, "open-texts")
    parts = sized_partitions(some.count(), 500)
    # a part is some cells, or a cell some parts
    each = -(-parts // CELLS)
    parts = parts if each == 1 else CELLS * each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from evalcat.llm.textcache import in_slices

        for batch in batches:
            rid, t = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in in_slices(t):
                s, w, n = weighted_sets(t[a:b], common)
                part = (s >> U(20)) % U(CELLS * each) % U(parts)
                order = np.argsort(part, kind="stable")
                used, starts = np.unique(part[order], return_index=True)
                ends = pa.array(np.append(starts, len(order)).astype(np.int32))
                listed = lambda x: pa.ListArray.from_arrays(ends, pa.array(x[order]))  # noqa: E731,B023
                yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), listed(s.view(np.int64)), listed(np.repeat(rid[a:b], n)), listed(w)], names=["part", "shingles", "rids", "weights"])

    def count(t: pa.Table) -> pa.Table:
        s, rid, w = (t.column(c).combine_chunks().flatten().to_numpy() for c in ("shingles", "rids", "weights"))
        order = np.argsort(s, kind="stable")
        first = np.r_[True, s[order][1:] != s[order][:-1]]
        alone = np.empty(len(s), bool)
        alone[order] = first & np.r_[first[1:], True]
        cell = (s.view(U) >> U(20)) % U(CELLS * each) // U(each)
        own = np.lexsort((cell, rid))
        starts = np.flatnonzero(np.r_[True, (rid[own][1:] != rid[own][:-1]) | (cell[own][1:] != cell[own][:-1])])
        total = lambda x: np.add.reduceat(x[own], starts)
        return pa.table({"rid": rid[own][starts], "cell": cell[own][starts].astype(np.int32), "weight": total(w), "shared": total(np.where(alone, 0.0, w))})

    packed = some.select("rid", "text").mapInArrow(run, "part long, shingles array<long>, rids array<long>, weights array<double>")
    sums = packed.groupBy("part").applyInArrow(count, "rid long, cell int, weight double, shared double")
    cells = sums.repartition("rid").groupBy("rid", "cell").agg(F.sum("weight").alias("weight"), F.sum("shared").alias("shared"))
    shared_in = F.map_from_entries(F.collect_list(F.struct("cell", "shared")))
    weights = cells.groupBy("rid").agg(F.sum("weight").alias("weight"), F.sum("shared").alias("shared"), shared_in.alias("m"))
    listed = F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
    return staged(weights.select("rid", "weight", "shared", listed.alias("cells")), "shared-weights", parts=parts)


def _open_members(scored: DataFrame, found: DataFrame, parts: int) -> DataFrame:
    """Members with their component (``root``) of those buckets whose members
    are of several."""
    roots = connected_components(found.select(F.col("a").alias("u"), F.col("b").alias("v")))
    known = scored.join(roots, F.col("rid") == F.col("node"), "left").drop("node").withColumn("root", F.coalesce("root", "rid"))
    several = known.groupBy("band", "hash").agg(F.min("root").alias("l"), F.max("root").alias("m")).where("l < m").select("band", "hash")
    return staged(known.join(several, ["band", "hash"], "left_semi"), "open-members", parts=parts)


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(rows, classes). rows: ``rid`` and ``row``, a struct of all columns of
    ``docs``; classes: (rid, doc_id, class_id, kept), class_id the smallest
    doc_id of the class, kept true for the first row (doc_id, row) of each."""
    rows = staged(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "documents")
    count = rows.count()
    parts = sized_partitions(count, DOCS)
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    keyed = staged(rows.select("rid", F.col("row.doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("key")), "text-keys")
    equal = staged(keyed.groupBy("key").agg(F.min("rid").alias("cid")), "equal-texts", parts=parts)
    found = links(rows.select("rid", text.alias("text")), equal.select(F.col("cid").alias("rid")), count, threshold)
    roots = connected_components(found.select(F.col("a").alias("u"), F.col("b").alias("v")))
    member = keyed.join(equal, "key").join(roots, F.col("cid") == F.col("node"), "left").select("rid", "doc_id", F.coalesce("root", "cid").alias("root"))
    member = staged(member, "class-members", parts=parts)
    first = member.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "rid")).alias("first"))
    classes = member.join(first, "root").select("rid", "doc_id", F.col("first.doc_id").alias("class_id"), (F.col("first.rid") == F.col("rid")).alias("kept"))
    return rows, classes


def deduplicated(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one row of each class."""
    rows, classes = near_duplicates(docs, threshold)
    kept = staged(classes.where("kept").select("rid"), "kept-rows")
    return rows.hint("shuffle_merge").join(kept, "rid", "left_semi").select("row.*")

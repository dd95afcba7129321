"""Documents as files of token ids: frequency-ranked, byte-aligned codes.

Every id is replaced by its rank among all ids of the corpus (0: most frequent;
ties by id) and written in one to four bytes, lowest first. A separate stream
of control bytes holds the byte counts, two bits each, four to a byte; so
neither stream has branches and both are read by numpy: a table of 256 x 4 byte
counts turns control bytes into lengths, their prefix sums into places, and up
to four gathers into ranks.

A file is a run of blocks of whole documents in ascending doc_id order (nulls
first, ties in any order); files follow each other in the order of
``manifest.file_no``. Block: six little-endian int64 (documents, ids, control
bytes, data bytes, two zeros), then doc ids (int64), a null flag byte each, id
counts (int64), control bytes, data bytes. The rank table is a Parquet table
beside the files.

Texts are range-sorted once by (doc_id, row), so a doc_id that repeats a
million times is cut over tasks; ids are staged in that order and each run of
them becomes one file, written by one task to a name of its own. A lost or
repeated task leaves a file that no manifest names.

Edge cases: a null or empty text is the end id alone; repeated rows are kept;
an empty table gives an empty manifest.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalcat.llm.common import scratch, staged, store_of, text_rows

#: Ids in a block, but for a longer document.
BLOCK = 1 << 19
_LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes)."""
    r = np.asarray(ranks, "<u4")
    extra = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    four = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    four[: len(r)] = extra
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    keep = np.arange(4) <= extra[:, None]
    return control.astype(np.uint8).tobytes(), r.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    lens = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    ends = np.cumsum(lens, dtype=np.int64)
    begins = ends - lens
    raw = np.frombuffer(data, np.uint8)
    out = raw[begins].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(lens > k)
        out[longer] |= raw[begins[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(part, seq, doc_id, n, ids): ids as little-endian unsigned integers of
    16 bits if the vocabulary allows, else 32; (part, seq) is the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from evalcat.llm.textcache import in_slices
        from evalcat.llm.tokens import coder

        code = coder(tokenizer)
        for batch in batches:
            order, doc_ids, texts = (c.to_pylist() for c in batch.columns)
            for a, b in in_slices(texts):
                ids, lens = code(texts[a:b])
                ends = np.cumsum(lens)
                all_ids = np.insert(ids, ends, end_id).astype("<u4")
                ends = np.cumsum(lens + 1).tolist()
                blobs = [all_ids[s:e].tobytes() for s, e in zip([0, *ends], ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(order[a:b], pa.int64()), pa.array(doc_ids[a:b], pa.int64()), pa.array(lens + 1, pa.int64()), pa.array(blobs, pa.binary())],
                    names=["place", "doc_id", "n", "ids"],
                )

    rows = text_rows(docs).withColumn("rid", F.monotonically_increasing_id())
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "rid").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "rid")
    coded = ranged.select(F.monotonically_increasing_id().alias("place"), "doc_id", "text").mapInArrow(run, "place long, doc_id long, n long, ids binary")
    return staged(coded, "token-ids")


def rank_table(coded: DataFrame) -> DataFrame:
    """(id, n, rank): counts over all documents. Tasks count before the
    shuffle; the table has at most one row per id of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                got = np.bincount(np.frombuffer(blob.as_buffer(), "<u4"))
                if len(got) > len(total):
                    total = np.concatenate([total, np.zeros(len(got) - len(total), np.int64)])
                total[: len(got)] += got
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    counts = coded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "id")) - 1)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Write ``docs`` and return (manifest, ranks). manifest: (file_no, path,
    documents, ids), file_no dense from 0 in document order."""
    spark = docs.sparkSession
    folder = path or scratch(spark, "token-files")
    coded = encode_documents(docs, tokenizer, end_id)
    ranks = staged(rank_table(coded), "token-ranks")
    # a rank per id of the vocabulary: bounded by the tokenizer, not by the data
    pairs = np.array([(r["id"], r["rank"]) for r in ranks.collect()], np.int64).reshape(-1, 2)
    rank_of = np.zeros(int(pairs[:, 0].max()) + 1 if len(pairs) else 1, np.uint32)
    rank_of[pairs[:, 0]] = pairs[:, 1]
    shared = spark.sparkContext.broadcast(rank_of)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        out, made, block, size, nxt = None, [], [], 0, None

        def flush():
            nonlocal block, size
            if not block:
                return
            control, data = encode_ranks(table[np.concatenate([np.frombuffer(b, "<u4") for _, _, b in block])])
            out.write(np.array([len(block), size, len(control), len(data), 0, 0], "<i8").tobytes())
            out.write(np.array([d or 0 for d, _, _ in block], "<i8").tobytes())
            out.write(np.array([d is None for d, _, _ in block], np.uint8).tobytes())
            out.write(np.array([n for _, n, _ in block], "<i8").tobytes())
            out.write(control)
            out.write(data)
            made[-1][2] += len(block)
            made[-1][3] += size
            block, size = [], 0

        for batch in batches:
            for place, doc, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if place != nxt:  # another run of documents: a file of its own
                    flush()
                    if out:
                        out.close()
                    store, base = store_of(folder)
                    store.create_dir(base)
                    name = f"{uuid.uuid4().hex}.tok"
                    out = store.open_output_stream(f"{base}/{name}", buffer_size=1 << 20)
                    made.append([place, f"{folder}/{name}", 0, 0])
                block.append((doc, n, ids))
                size += n
                nxt = place + 1
                if size >= BLOCK:
                    flush()
        flush()
        if out:
            out.close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], names=["place", "path", "documents", "ids"])

    files = staged(coded.mapInArrow(write, "place long, path string, documents long, ids long"), "token-manifest")
    # one row per file, not per document
    manifest = files.withColumn("file_no", F.row_number().over(Window.orderBy("place")) - 1).select("file_no", "path", "documents", "ids")
    return staged(manifest, "token-manifest"), ranks


def read_token_files(spark: SparkSession, manifest: DataFrame, ranks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids): start counts the ids of all documents
    before; ids as little-endian unsigned 32-bit integers. One task reads a
    file, block by block."""
    pairs = np.array([(r["rank"], r["id"]) for r in ranks.collect()], np.int64).reshape(-1, 2)
    id_of = np.zeros(len(pairs), "<u4")
    id_of[pairs[:, 0]] = pairs[:, 1]
    shared = spark.sparkContext.broadcast(id_of)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns)):
                store, name = store_of(path)
                with store.open_input_stream(name, buffer_size=1 << 20) as src:
                    while head := src.read(48):
                        docs, ids, controls, bytes_, _, _ = np.frombuffer(head, "<i8").tolist()
                        doc_ids = np.frombuffer(src.read(8 * docs), "<i8")
                        nulls = np.frombuffer(src.read(docs), np.uint8).astype(bool)
                        lens = np.frombuffer(src.read(8 * docs), "<i8")
                        got = table[decode_ranks(src.read(controls), src.read(bytes_), ids)]
                        ends = np.cumsum(lens)
                        blobs = [got[s:e].tobytes() for s, e in zip((ends - lens).tolist(), ends.tolist())]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(doc_ids, pa.int64(), mask=nulls), pa.array(base + ends - lens, pa.int64()), pa.array(lens, pa.int64()), pa.array(blobs, pa.binary())],
                            names=["doc_id", "start", "n_tokens", "ids"],
                        )
                        base += ids

    base = F.coalesce(F.sum("ids").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("path", base.alias("base"))
    return files.repartition(max(1, manifest.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")

"""Places of rows in files, from counts per split and prefix sums.

A text file is scanned in splits, each by one task and in order. How many rows
a split has is counted in a first scan; summing these counts over the splits
before it (a table of one row per split) gives every split its offset, and a
second scan adds the place within the split. Rows are neither sorted nor
shuffled for it.

CSV records may go on over line ends inside quotes, and so over the ends of
splits. Whether a split begins inside quotes depends on all before it; so the
first scan computes for either case what state a split leaves behind and how
many records begin in it. These maps of two states compose over the splits like
prefix sums. The second scan then reads the records of each split; the few that
lie over the end of a split come in pieces, which are put together by file.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalcat.operators.inference import materialize

#: Splits up to which their offsets are broadcast (some 100 bytes each);
#: beyond it the planner joins them as it likes.
BROADCAST_SPLITS = 200_000


def text_splits(spark: SparkSession, path: str) -> DataFrame:
    """(value, _file, _start, _at): lines (ended by \\n alone), their split and
    a number that counts them within its task."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))


def _small(splits: DataFrame) -> tuple[DataFrame, bool]:
    """Splits for a join, and whether they are broadcast: they are counted first."""
    splits = materialize(splits, "splits")
    small = splits.count() <= BROADCAST_SPLITS
    return F.broadcast(splits) if small else splits, small


def _before(col: str, within: list[str]) -> Column:
    w = Window.partitionBy(*within).orderBy("_file", "_start") if within else Window.orderBy("_file", "_start")
    return F.coalesce(F.sum(col).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def offsets(rows: DataFrame, at: str = "_at") -> DataFrame:
    """(_f, _s, _off): what to add to ``at`` for a row's place, from 0, among
    ``rows`` in the order of files and lines."""
    counts = rows.groupBy("_file", "_start").agg(F.min(at).alias("_first"), F.count(F.lit(1)).alias("_n"))
    return _small(counts.select(F.col("_file").alias("_f"), F.col("_start").alias("_s"), (_before("_n", []) - F.col("_first")).alias("_off")))[0]


def with_place(rows: DataFrame, offs: DataFrame, name: str, at: str = "_at") -> DataFrame:
    """Add the 0-based place that ``offsets`` gives."""
    joined = rows.join(offs, (F.col("_file") == F.col("_f")) & (F.col("_start") == F.col("_s")))
    return joined.withColumn(name, F.col(at) + F.col("_off")).drop("_f", "_s", "_off")


# --------------------------------------------------------------------------- #
# CSV
# --------------------------------------------------------------------------- #
def ends_quoted(line: str, quoted: bool) -> bool:
    """Whether a line that begins inside quotes or at the start of a record
    ends inside quotes. A quote opens only at the start of a field; inside,
    two stand for one."""
    i, fresh = 0, True
    while True:
        if quoted:
            i = line.find('"', i)
            if i < 0:
                return True
            if line[i + 1 : i + 2] == '"':
                i += 2
                continue
            quoted, fresh, i = False, False, i + 1
        elif fresh and line[i : i + 1] == '"':
            quoted, i = True, i + 1
        else:
            i = line.find(",", i) + 1
            if i == 0:
                return False
            fresh = True


def _split_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str], bool]]:
    """((file, start), lines, whether the split ends with them) in order."""
    key, last = None, []
    for b in batches:
        files, starts, values = (b.column(c).to_pylist() for c in ("_file", "_start", "value"))
        a = 0
        while a < len(values):
            e = a
            while e < len(values) and files[e] == files[a] and starts[e] == starts[a]:
                e += 1
            if key is not None:
                yield key, last, key != (files[a], starts[a])
            key, last = (files[a], starts[a]), values[a:e]
            a = e
    if key is not None:
        yield key, last, True


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split: the state after it and the records begun in it, had it begun outside or inside quotes."""
    state, begun = [False, True], [0, 0]
    for (file, start), lines, ends in _split_runs(batches):
        for line in lines:
            full = line not in ("", "\r")
            for case in (0, 1):
                begun[case] += full and not state[case]
            if '"' in line:
                state = [ends_quoted(line, s) for s in state]
        if ends:
            yield pa.RecordBatch.from_pylist([{"_file": file, "_start": start, "out": state[0], "ins": state[1], "n_out": begun[0], "n_ins": begun[1]}], schema=_MAPS)
            state, begun = [False, True], [0, 0]


_MAPS = pa.schema([("_file", pa.string()), ("_start", pa.int64()), ("out", pa.bool_()), ("ins", pa.bool_()), ("n_out", pa.int64()), ("n_ins", pa.int64())])
_RECORDS = pa.schema([("_file", pa.string()), ("_start", pa.int64()), ("seq", pa.int64()), ("kind", pa.string()), ("cells", pa.list_(pa.string())), ("piece", pa.string())])


def _cells(lines: list[str]) -> list[str]:
    """The cells of one record given by its lines."""
    csv.field_size_limit(2**62)
    return next(csv.reader([f"{x}\n" for x in lines[:-1]] + [lines[-1]]), [])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of splits. Kinds: record; tail (begun, not ended in the split),
    head (ended in it, begun before) and mid (neither)."""

    def begins(bs):
        for b in bs:
            for f, s, q in zip(*(b.column(c).to_pylist() for c in ("_file", "_start", "quoted"))):
                opened[f, s] = q
            yield b

    opened: dict = {}
    quoted, head, held, seq, out, fresh = False, False, [], 0, [], True
    for (file, start), lines, ends in _split_runs(begins(batches)):
        if fresh:
            quoted = head = opened.pop((file, start))
            held, seq, fresh = [], 0, False
        put = lambda kind, cells=None, piece=None: out.append({"_file": file, "_start": start, "seq": -1 if kind in ("head", "mid") else seq, "kind": kind, "cells": cells, "piece": piece})  # noqa: E731,B023
        for line in lines:
            if not quoted and not held and line in ("", "\r"):
                continue
            held.append(line)
            quoted = ends_quoted(line, quoted) if '"' in line else quoted
            if not quoted:
                if head:
                    put("head", piece="\n".join(held))
                else:
                    put("record", cells=_cells(held))
                    seq += 1
                head, held = False, []
        if ends:
            if held:
                put("mid" if head else "tail", piece="\n".join(held))
            fresh = True
        if len(out) >= 2000 or ends:
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_RECORDS)
            out = []


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [{**r, "cells": _cells(r.pop("text").split("\n"))} for r in b.to_pylist()]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("_file", pa.string()), ("_start", pa.int64()), ("seq", pa.int64()), ("cells", pa.list_(pa.string()))]))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _row, cells): every record of the CSV file(s), quoted line ends
    included, with its place among the records of its file (0: the header).
    Blank lines are no records. Files are read in splits."""
    lines = text_splits(spark, path)
    maps = lines.drop("_at").mapInArrow(_maps, "_file string, _start long, out boolean, ins boolean, n_out long, n_ins long")
    earlier = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    fixed, swaps = F.col("out") == F.col("ins"), F.col("out") & ~F.col("ins")
    seen = maps.withColumn("_run", F.coalesce(F.sum(fixed.cast("int")).over(earlier), F.lit(0))).withColumn("_base", F.coalesce(F.last(F.when(fixed, F.col("out")), ignorenulls=True).over(earlier), F.lit(False)))
    in_run = Window.partitionBy("_file", "_run").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    flips = F.coalesce(F.sum((swaps & ~fixed).cast("int")).over(in_run), F.lit(0))
    states = seen.withColumn("quoted", F.col("_base") != (flips % 2 == 1))
    states = states.withColumn("_n", F.when(F.col("quoted"), F.col("n_ins")).otherwise(F.col("n_out"))).withColumn("_off", _before("_n", ["_file"]))
    states, small = _small(states.select(F.col("_file").alias("_f"), F.col("_start").alias("_s"), "quoted", "_off"))
    at_split = (F.col("_file") == F.col("_f")) & (F.col("_start") == F.col("_s"))
    marked = lines.join(states.drop("_off"), at_split)
    if not small:  # a join that moves lines loses their order
        marked = marked.repartition("_file", "_start").sortWithinPartitions("_file", "_start", "_at")
    found = marked.select("value", "_file", "_start", "quoted").mapInArrow(_records, "_file string, _start long, seq long, kind string, cells array<string>, piece string")
    whole = found.where("kind = 'record'").select("_file", "_start", "seq", "cells")
    pieces = found.where("kind <> 'record'").select("_file", "_start", "seq", "kind", "piece")
    # of a split, a head comes before a tail
    order = ["_start", F.col("seq")]
    chain = F.sum(F.when(F.col("kind") == "tail", 1).otherwise(0)).over(Window.partitionBy("_file").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    chains = pieces.withColumn("chain", chain).groupBy("_file", "chain").agg(
        F.min_by("_start", F.struct("_start", "seq")).alias("_start"), F.max("seq").alias("seq"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_start", "seq", "piece"))), lambda p: p["piece"]), "\n").alias("text"),
    )
    mended = chains.select("_file", "_start", "seq", "text").mapInArrow(_joined, "_file string, _start long, seq long, cells array<string>")
    return whole.unionByName(mended).join(states.drop("quoted"), at_split).select("_file", (F.col("_off") + F.col("seq")).alias("_row"), "cells")

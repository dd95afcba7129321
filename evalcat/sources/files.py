"""File scans and sinks (SURVEY A1, A2, A5, A6, A8, A9, A11, A12, A14-A16,
A18).

Row order in a file matters to the reference (first N examples, result ids),
so every scan that needs it attaches an explicit ``ordinal``: places in files
come from counts per split (``positions``), without sorting rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalcat.functions.scoring import is_finite, num_text
from evalcat.functions.text import strip
from evalcat.operators import examples as EX
from evalcat.operators.inference import materialize
from evalcat.operators.ranking import with_row_index
from evalcat.operators.runs import latest_runs
from evalcat.sources.positions import csv_records, offsets, text_splits, with_place

# Fixed value: the result table's column order.
RESULT_COLUMNS = (
    "result_id", "status", "provider", "model", "example_id", "output", "score", "weight",
    "score_reason", "input_tokens", "output_tokens", "latency_ms", "ttft_ms", "tps", "num_llm_calls",
)
RESULT_SCHEMA = T.StructType(
    [
        T.StructField("result_id", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("example_id", T.LongType()),
        T.StructField("output", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("score_reason", T.StringType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("ttft_ms", T.DoubleType()),
        T.StructField("tps", T.DoubleType()),
        T.StructField("num_llm_calls", T.LongType()),
    ]
)

_CSV_READ = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"', "mode": "PERMISSIVE"}
_CSV_WRITE = {
    "header": "true",
    "escape": '"',
    "quote": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "emptyValue": "",
    "nullValue": "",
    "lineSep": "\n",
}


# --------------------------------------------------------------------------- #
# examples (A1, A2, A18)
# --------------------------------------------------------------------------- #
def read_examples(spark: SparkSession, path: str, mode: str = "failfast") -> DataFrame | tuple[DataFrame, DataFrame]:
    """A1/A2: example rows with a file-order ``ordinal``. A name ending in
    ``.jsonl`` (any case) is JSON lines; anything else is CSV.

    A row that can't be taken (a line that isn't JSON, B2 validation; in CSV an
    ``example_id`` that is no whole number or a ``weight`` that is no number)
    fails the load with the first such error in file order
    (``mode="failfast"``), or, with ``mode="quarantine"``, (good, bad)
    DataFrames are returned where bad carries ``line_no`` (CSV: the record's
    number, the header being 0) and ``error``. Blank lines are skipped."""
    read = _read_jsonl if path.lower().endswith(".jsonl") else _read_csv_examples
    good, bad = read(spark, path)
    if mode == "quarantine":
        return good, bad
    first = bad.agg(F.min_by("error", "line_no")).first()[0]
    if first is not None:
        raise ValueError(first)
    return good


@contextmanager
def _last_key_wins(spark: SparkSession):
    """While plans with a JSON parser are built: of equal keys the last counts."""
    key = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _read_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    raw = text_splits(spark, path)
    line_of = offsets(raw)
    lines = raw.where(strip(F.col("value")) != "")
    with _last_key_wins(spark):
        parsed = lines.withColumn("_v", F.try_parse_json(strip(F.col("value"))))
        checked = parsed.withColumn("_error", F.when(F.col("_v").isNotNull(), EX.validation_error(F.col("_v"))))
    ok = checked.where(F.col("_v").isNotNull() & F.col("_error").isNull()).withColumn("_ok", F.monotonically_increasing_id())
    good = with_place(with_place(ok, line_of, "line_no"), offsets(ok, "_ok"), "ordinal", "_ok").withColumn("line_no", F.col("line_no") + 1)
    good = EX.normalize_examples(good.drop("_file", "_start", "_at", "_ok", "_error"), "value")
    bad = with_place(checked.where(F.col("_v").isNull() | F.col("_error").isNotNull()), line_of, "line_no").withColumn("line_no", F.col("line_no") + 1)
    error = F.coalesce("_error", F.concat(F.lit("JSONL line "), F.col("line_no").cast("string"), F.lit(": invalid JSON")))
    return good, bad.select("line_no", error.alias("error"), "value")


def _read_csv_examples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    records = materialize(csv_records(spark, path), "csv-records")
    # a row per file
    heads = records.where("_row = 0").select(F.col("_file").alias("_f"), F.col("cells").alias("_names"))
    rows = records.where("_row > 0").join(heads, F.col("_file") == F.col("_f"))
    cell = lambda name: F.get("cells", F.array_position("_names", F.lit(name)).cast("int") - 1)
    weight_text = F.coalesce(cell("weight"), F.lit(""))
    example_id = _whole(F.coalesce(cell("example_id"), F.lit("")))
    weight = F.when(strip(weight_text) == "", F.lit(1.0)).otherwise(_number(weight_text))
    files = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    counts = records.groupBy("_file").agg((F.max("_row")).alias("n"))
    before = counts.select(F.col("_file").alias("_g"), F.coalesce(F.sum("n").over(files), F.lit(0)).alias("_before"))
    typed = rows.join(before, F.col("_file") == F.col("_g")).select(
        (F.col("_before") + F.col("_row")).alias("line_no"),
        example_id.alias("example_id"),
        F.array(
            F.struct(
                F.lit("user").alias("role"),
                F.coalesce(cell("prompt"), F.lit("")).alias("content"),
                F.lit(None).cast("string").alias("tool_calls"),
                F.lit(None).cast("string").alias("tool_call_id"),
                F.lit(None).cast("string").alias("name"),
            )
        ).alias("messages"),
        F.lit(None).cast("string").alias("system_prompt"),
        F.coalesce(cell("expected_output"), F.lit("")).alias("expected_output"),
        weight.alias("weight"),
        F.when(example_id.isNull(), F.concat(F.lit("CSV record "), (F.col("_before") + F.col("_row")).cast("string"), F.lit(": example_id is no whole number")))
        .when(weight.isNull(), F.concat(F.lit("CSV record "), (F.col("_before") + F.col("_row")).cast("string"), F.lit(": weight is no number")))
        .alias("error"),
        F.array_join("cells", ",", "").alias("value"),
    )
    lost = typed.where("error IS NOT NULL").select("line_no", "error", "value")
    good = typed.where("error IS NULL").drop("error", "value")
    if lost.isEmpty():
        good = good.withColumn("ordinal", F.col("line_no") - 1)
    else:  # quarantined rows leave gaps: only then are the others counted anew
        good = with_row_index(good, ["line_no"], "ordinal")
    return good.drop("line_no"), lost


def count_examples(spark: SparkSession, path: str) -> int:
    """Number of example rows (a quoted multi-line cell is one row)."""
    df = read_examples(spark, path)
    return (df[0] if isinstance(df, tuple) else df).count()


# --------------------------------------------------------------------------- #
# results (A5, A6, A12)
# --------------------------------------------------------------------------- #
#: Text that reads as a whole number, or as a number, once blanks around it
#: and single underscores between digits are gone.
_WHOLE = r"^[+-]?\d+$"
_PLAIN = r"^[+-]?\d+(\.\d+)?$"  # has nothing to be cleaned of
_NUMBER = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|nan|inf|infinity)$"


def _digits(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"(?<=\d)_(?=\d)", "")


def _whole(c: Column) -> Column:
    return F.when(_digits(c).rlike(_WHOLE), _digits(c).try_cast("long"))


def _number(c: Column) -> Column:
    return F.when(_digits(c).rlike(_NUMBER), _digits(c).try_cast("double"))


_RESULT_NUMBERS = ("result_id", "example_id", "score", "weight", "input_tokens", "output_tokens", "latency_ms", "ttft_ms", "tps", "num_llm_calls")


def read_results(spark: SparkSession, path: str, mode: str = "failfast") -> DataFrame | tuple[DataFrame, DataFrame]:
    """A5: result CSV(s) read by header NAME (never by position) as text,
    then typed with the reference's defaults: blank status -> completed;
    missing/blank/non-finite/unreadable weight -> 1.0; blank score -> 0; blank,
    unreadable or non-finite metric -> null; missing trailing cells -> "".

    A result_id or example_id that is no whole number, or a score that is no
    number, can't be taken: ``mode="failfast"`` raises when such a row is read
    (no pass of its own), ``"quarantine"`` returns (good, bad with ``error``)."""
    df = spark.read.options(**_CSV_READ).csv(path)
    for c in RESULT_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    extra = [c for c in df.columns if c not in RESULT_COLUMNS]  # e.g. partition columns
    txt = {c: F.coalesce(F.col(c), F.lit("")) for c in RESULT_COLUMNS}
    bare = lambda c: F.col(f"_bare_{c}")
    num = lambda c: F.col(f"_num_{c}")
    # each text is trimmed once and each number read once, in a projection of its own
    rows = df.withColumns({f"_bare_{c}": F.when((txt[c] == "") | txt[c].rlike(_PLAIN), txt[c]).otherwise(_digits(txt[c])) for c in _RESULT_NUMBERS})
    read = {c: F.when(bare(c).rlike(_WHOLE), bare(c).try_cast("long")) if c.endswith("_id") else F.when(bare(c).rlike(_NUMBER), bare(c).try_cast("double")) for c in _RESULT_NUMBERS}
    rows = rows.withColumns({f"_num_{c}": F.when(txt[c] == "", F.lit(0.0)).otherwise(n) if c == "score" else n for c, n in read.items()})
    wrong = lambda c: F.when(num(c).isNull(), F.concat(F.lit(f"{c} is not a number: "), txt[c]))
    error = F.coalesce(*[wrong(c) for c in ("result_id", "example_id", "score")])
    good = rows.where(error.isNull()) if mode == "quarantine" else rows
    finite = lambda c: F.when(is_finite(num(c)), num(c))
    typed = good.select(
        (num("result_id") if mode == "quarantine" else F.when(error.isNull(), num("result_id")).otherwise(F.raise_error(error).cast("long"))).alias("result_id"),
        F.when(txt["status"] == "", F.lit("completed")).otherwise(txt["status"]).alias("status"),
        txt["provider"].alias("provider"),
        txt["model"].alias("model"),
        num("example_id").alias("example_id"),
        txt["output"].alias("output"),
        num("score").alias("score"),
        F.coalesce(finite("weight"), F.lit(1.0)).alias("weight"),
        F.nullif(txt["score_reason"], F.lit("")).alias("score_reason"),
        finite("input_tokens").cast("long").alias("input_tokens"),
        finite("output_tokens").cast("long").alias("output_tokens"),
        finite("latency_ms").alias("latency_ms"),
        finite("ttft_ms").alias("ttft_ms"),
        finite("tps").alias("tps"),
        finite("num_llm_calls").cast("long").alias("num_llm_calls"),
        *extra,
    )
    if mode != "quarantine":
        return typed
    return typed, rows.withColumn("error", error).where("error IS NOT NULL").select(*df.columns, "error")


def results_as_text(results: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """A6 cell rendering: the 15 columns in fixed order, numbers as JS-style
    text (H11), null metrics and reasons as "" (``keep`` columns pass
    through unchanged, e.g. partition columns)."""
    cols = []
    for c in RESULT_COLUMNS:
        if c in ("status", "provider", "model", "output", "score_reason"):
            cols.append(F.coalesce(F.col(c), F.lit("")).alias(c))
        else:
            cols.append(num_text(F.col(c)).alias(c))
    return results.select(*cols, *keep)


def write_results(results: DataFrame, path: str, partition_cols: Sequence[str] = ()) -> None:
    """Result CSV sink: fixed column order, sorted by result_id, quotes
    only where needed with doubled quotes, leading/trailing whitespace
    preserved, null -> empty cell; optionally partitioned by run keys.

    Rows are dealt out by ranges of (run keys, result_id): a run lies in the
    files of one task or of a few that follow each other, and the numbers in
    the file names keep its order over them. They are dealt as they are, so that
    as many tasks as there are ranges write the text, whatever files they come from."""
    extra = [c for c in partition_cols if c in results.columns]
    dealt = results.repartitionByRange(*extra, "result_id").sortWithinPartitions(*extra, "result_id")
    w = results_as_text(dealt, extra).write.mode("overwrite").options(**_CSV_WRITE)
    if extra:
        w = w.partitionBy(*extra)
    w.csv(path)


def export_results(results: DataFrame, runs: DataFrame, experiment_id: str, run_id: str | None, path: str) -> None:
    """Write the named run's results, or the latest run's."""
    if run_id is None:
        latest = latest_runs(runs.where(F.col("experiment_id") == experiment_id)).select("experiment_id", "run_id")
        chosen = results.join(latest, ["experiment_id", "run_id"], "left_semi")
    else:
        chosen = results.where((F.col("experiment_id") == experiment_id) & (F.col("run_id") == run_id))
    write_results(chosen.drop("experiment_id", "run_id"), path)


# --------------------------------------------------------------------------- #
# run metadata, experiments, scorers
# --------------------------------------------------------------------------- #
RUN_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("started_at", T.StringType()),
        T.StructField("finished_at", T.StringType()),
        T.StructField("resumed_at", T.ArrayType(T.StringType())),
        T.StructField("total", T.LongType()),
        T.StructField("completed", T.LongType()),
        T.StructField("errors", T.LongType()),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)


def read_runs(spark: SparkSession, pattern: str) -> DataFrame:
    """Run metadata JSON documents (one per file); unreadable files are
    skipped. The experiment id is the folder two levels up (…/<exp>/runs/
    <run>/run.json); timestamps become TIMESTAMP."""
    df = spark.read.schema(RUN_SCHEMA).option("multiLine", "true").option("mode", "PERMISSIVE").json(pattern)
    df = df.withColumn("_path", F.col("_metadata.file_path")).where(
        F.col("_corrupt_record").isNull() & F.col("run_id").isNotNull()
    )
    ts = lambda c: F.to_timestamp(F.col(c))
    return df.select(
        F.regexp_extract("_path", r"/([^/]+)/runs/[^/]+/[^/]+$", 1).alias("experiment_id"),
        "run_id",
        "status",
        ts("started_at").alias("started_at"),
        ts("finished_at").alias("finished_at"),
        F.transform(F.coalesce("resumed_at", F.array().cast("array<string>")), lambda x: F.to_timestamp(x)).alias("resumed_at"),
        "total",
        "completed",
        "errors",
    )


def read_json_dir(
    spark: SparkSession, folder: str, schema: T.StructType, key: str = "id", glob: str = "*.json"
) -> DataFrame:
    """One JSON document per ``*.json`` file; hidden files are skipped
    (Spark ignores names starting with ``.``), malformed files are skipped,
    the ``key`` is forced to the file stem, rows sorted by key."""
    fields = schema.fields + [T.StructField("_corrupt_record", T.StringType())]
    df = (
        spark.read.schema(T.StructType(fields))
        .option("multiLine", "true")
        .option("mode", "PERMISSIVE")
        .option("pathGlobFilter", glob)
        .json(folder)
    )
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    df = df.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    return df.withColumn(key, stem).orderBy(key)


def start_runs(runs: DataFrame, root: str, experiments: DataFrame | None = None, snapshots: str | None = None, results: str | None = None) -> None:
    """Lay down new runs: one metadata document per (experiment_id,
    run_id) with status running, no finish, no resumes, the task total and
    zero counters, written under ``root/experiment_id=<e>/run_id=<r>/``.
    ``runs`` has experiment_id, run_id, started_at (ISO text) and total.

    With ``experiments`` (experiment_id, definition JSON text) each run's
    definition of now is kept under ``snapshots``, and with ``results`` each
    run has a result file there with nothing but its header, both by
    experiment and run like the metadata."""
    keys = ["experiment_id", "run_id"]
    if experiments is not None:
        kept = runs.select(*keys).join(experiments.select("experiment_id", F.col("definition").alias("value")), "experiment_id")
        kept.select("value", *keys).write.partitionBy(*keys).text(snapshots)
    if results is not None:
        runs.select(F.lit(",".join(RESULT_COLUMNS)).alias("value"), *keys).write.partitionBy(*keys).text(results)
    meta = runs.select(
        "experiment_id",
        "run_id",
        F.to_json(
            F.struct(
                F.col("run_id"),
                F.lit("running").alias("status"),
                F.col("started_at"),
                F.lit(None).cast("string").alias("finished_at"),
                F.array().cast("array<string>").alias("resumed_at"),
                F.col("total").cast("long").alias("total"),
                F.lit(0).cast("long").alias("completed"),
                F.lit(0).cast("long").alias("errors"),
            ),
            {"ignoreNullFields": "false"},
        ).alias("value"),
    )
    meta.write.mode("overwrite").partitionBy("experiment_id", "run_id").text(f"{root.rstrip('/')}/meta")


def read_run_table(spark: SparkSession, root: str) -> DataFrame:
    """A8 for the partitioned layout written by :func:`start_runs`: one
    metadata document per line; unreadable documents are skipped."""
    schema = T.StructType([f for f in RUN_SCHEMA.fields if f.name != "run_id"])
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").json(f"{root.rstrip('/')}/meta")
    return raw.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


# --------------------------------------------------------------------------- #
# catalog inputs
# --------------------------------------------------------------------------- #
def read_inventory(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """``{"items": [...]}`` documents flattened to one row per item."""
    reader = spark.read.option("multiLine", "true")
    if schema is not None:
        reader = reader.schema(schema)
    doc = reader.json(path)
    return doc.select(F.explode("items").alias("item")).select("item.*")


def read_ws_table(spark: SparkSession, path: str, min_fields: int = 3, header_first: str = "NAME") -> DataFrame:
    """Whitespace-separated listings (``kubectl get`` style): split on
    runs of blanks; lines with fewer than ``min_fields`` fields and the
    header line are skipped. Returns ``fields`` plus the line."""
    t = spark.read.text(path)
    parts = F.split(F.trim(F.col("value")), r"\s+")
    return (
        t.select(F.col("value").alias("line"), parts.alias("fields"))
        .where((F.size("fields") >= min_fields) & (F.get(F.col("fields"), 0) != header_first))
    )


def read_artifacts(spark: SparkSession, folder: str, must_contain: Sequence[str]) -> DataFrame:
    """Whole-text files keeping those that contain every marker,
    sorted by file name."""
    df = spark.read.text(folder, wholetext=True)
    cond = F.lit(True)
    for m in must_contain:
        cond = cond & F.col("value").contains(m)
    return (
        df.select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_name").alias("name"),
            F.col("value").alias("text"),
        )
        .where(cond)
        .orderBy("name")
    )

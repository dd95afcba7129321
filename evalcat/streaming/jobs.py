"""Structured Streaming jobs.

Sources are any streaming DataFrames (files landing in a results folder,
Kafka, ...). Sinks write to the shared checkpoint folder or to user paths;
every query keeps its own checkpoint location so a restarted job resumes
exactly where it stopped (I4).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalcat.functions import catalog as K
from evalcat.functions import scoring as S
from evalcat.operators.deployments import parse_pod_lines
from evalcat.operators.runs import RUN_EVENT_STATUS, upsert_latest
from evalcat.session import ensure_checkpoint_dir
from evalcat.sources.partitions import path_exists, read_touched


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([base, "evalcat-streams", *parts, uuid.uuid4().hex])


def stage_files(df: DataFrame, n_files: int) -> tuple[str, T.StructType]:
    """Write a batch DataFrame as ``n_files`` parquet files (a file source
    that a stream can consume one file per trigger). Used to replay tables
    as streams in tests and registered queries."""
    path = scratch_path(df.sparkSession, "source")
    df.repartition(n_files).write.parquet(path)
    return path, df.schema


@contextmanager
def state_on_disk(spark: SparkSession):
    """Streaming queries started while it holds keep their state in RocksDB, on
    the executors' disks and in bounded memory, not in the executors' heaps."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def replay(df: DataFrame, chunk_col: str, chunks: int, start) -> None:
    """Let ``df`` arrive in ``chunks`` parts (``chunk_col`` 0, 1, ...), each
    written by as many tasks as its rows need. After each part ``start(stream)``
    must start the query, with one checkpoint location for all parts: so it
    stops and starts again from its checkpoint between them."""
    spark = df.sparkSession
    path = scratch_path(spark, "source")
    arriving = scratch_path(spark, "arriving")
    df.write.partitionBy(chunk_col).parquet(arriving)
    rest = T.StructType([f for f in df.schema.fields if f.name != chunk_col])
    for i in range(chunks):
        part = f"{arriving}/{chunk_col}={i}"
        if path_exists(spark, part):
            spark.read.schema(rest).parquet(part).write.mode("append").parquet(path)
            start(spark.readStream.schema(rest).parquet(path)).awaitTermination()


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def drain_to_table(stream: DataFrame, mode: str = "complete", path: str | None = None) -> DataFrame:
    """Run a streaming query over everything available (availableNow) into a
    Parquet table in the shared checkpoint folder and return that table.
    Append mode uses the file sink (exactly-once via its commit log);
    complete mode rewrites the table from each micro-batch's full result in
    ``foreachBatch``. Update mode only has the changed rows, so it can't
    rewrite a table and is refused. Results never pass through the driver."""
    if mode not in ("append", "complete"):
        raise ValueError(f"mode {mode!r}: only append and complete keep the whole table")
    spark = stream.sparkSession
    target = path or scratch_path(spark, "sink")
    w = stream.writeStream.option("checkpointLocation", scratch_path(spark, "ckpt")).trigger(availableNow=True)
    if mode == "append":
        q = w.outputMode("append").format("parquet").option("path", target).start()
    else:
        def overwrite(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(target)

        q = w.outputMode(mode).foreachBatch(overwrite).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)



# --------------------------------------------------------------------------- #
# I1 live run counters
# --------------------------------------------------------------------------- #
def progress_stream(results: DataFrame, run_cols: Sequence[str] = ("experiment_id", "run_id")) -> DataFrame:
    """Per run: completed rows, error rows, label of the latest finished
    task (``provider/model #example_id``). A row counts when it finishes."""
    label = S.task_label("provider", "model", "example_id")
    return results.groupBy(*run_cols).agg(
        F.count(F.lit(1)).alias("completed"),
        F.count(F.when(F.col("status") == "error", 1)).alias("errors"),
        F.max_by(label, F.struct("finished_at", "result_id")).alias("current_label"),
    )


# --------------------------------------------------------------------------- #
# I2 idempotent upsert sink
# --------------------------------------------------------------------------- #
def upsert_sink(
    stream: DataFrame,
    target: str,
    keys: Sequence[str] = ("provider", "model", "example_id"),
    seq_col: str = "write_seq",
    partition_cols: Sequence[str] = ("experiment_id", "run_id"),
    checkpoint: str | None = None,
):
    """Merge each micro-batch into a partitioned Parquet table, last
    write per key winning (E6). Only partitions touched by the batch are
    listed, read and rewritten (dynamic partition overwrite); a batch id already committed is
    skipped, so replays after a failure are idempotent."""
    spark = stream.sparkSession
    keys, partition_cols = list(keys), list(partition_cols)
    commits = f"{target.rstrip('/')}_commits"
    ckpt = checkpoint or scratch_path(spark, "ckpt")

    def merge(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        done = path_exists(s, commits) and not s.read.parquet(commits).where(F.col("batch_id") == batch_id).isEmpty()
        if done or batch.isEmpty():
            return
        best = upsert_latest(batch, [*partition_cols, *keys], seq_col)
        if path_exists(s, target):  # any other trouble with it fails the batch: prior rows must not be overwritten unread
            existing = read_touched(s, target, batch, partition_cols, batch.schema)
            best = upsert_latest(existing.unionByName(best), [*partition_cols, *keys], seq_col)
        best.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_cols).parquet(target)
        s.createDataFrame([(batch_id,)], "batch_id long").write.mode("append").parquet(commits)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", ckpt)


# --------------------------------------------------------------------------- #
# I3 orphan reaper (event-time timers)
# --------------------------------------------------------------------------- #
def reap_orphans_stream(events: DataFrame, watermark: str, grace_seconds: int = 15) -> DataFrame:
    """I3 (stream): run lifecycle events (create, resume, heartbeat,
    complete, abort, interrupt). A run's activity is an event-time session
    that stays open while events keep arriving within ``grace_seconds`` of
    each other; when the watermark (how late an event may be) closes a session, the run's outcome is
    emitted: the terminal status if the session ended with a terminal event,
    otherwise ``interrupted`` (orphaned: no live owner for the grace period),
    finished at the session end. Native session windows: no per-run Python,
    state is evicted as sessions close. Output mode append."""
    terminal = F.create_map(
        F.lit("complete"), F.lit("completed"), F.lit("abort"), F.lit("aborted"),
        F.lit("interrupt"), F.lit("interrupted"),
    )
    sessions = (
        events.withWatermark("ts", watermark)
        .groupBy("experiment_id", "run_id", F.session_window("ts", f"{int(grace_seconds)} seconds").alias("s"))
        .agg(F.max_by("event", F.struct("ts", "seq")).alias("last_event"), F.max("ts").alias("last_ts"))
    )
    ended = terminal[F.col("last_event")].isNotNull()
    return sessions.select(
        "experiment_id",
        "run_id",
        F.when(ended, terminal[F.col("last_event")]).otherwise(F.lit("interrupted")).alias("status"),
        F.when(ended, F.col("last_ts")).otherwise(F.col("s.end")).alias("finished_at"),
        F.col("s.start").alias("session_start"),
    )


# --------------------------------------------------------------------------- #
# I5 deployment monitor
# --------------------------------------------------------------------------- #
def deployment_stream(pod_lines: DataFrame) -> DataFrame:
    """Per deployment, the latest cache and default pod line seen so far
    and the resulting status (B15). pod_lines(deployment, polled_at, seq,
    line); complete/update mode."""
    pods = parse_pod_lines(pod_lines, "line").withColumn("kind", K.classify_pod("name"))
    order = F.struct("polled_at", "seq")
    cache = F.col("kind") == "cache"
    dflt = F.col("kind") == "default"
    agg = pods.groupBy("deployment").agg(
        F.max_by(F.when(cache, F.struct("ready", "total")), F.when(cache, order)).alias("c"),
        F.max_by(F.when(dflt, F.struct("ready", "total")), F.when(dflt, order)).alias("d"),
        F.max("polled_at").alias("last_poll"),
    )
    return agg.select(
        "deployment",
        K.deployment_status(F.col("c.ready"), F.col("c.total"), F.col("d.ready"), F.col("d.total")).alias("status"),
        (K.deployment_status(F.col("c.ready"), F.col("c.total"), F.col("d.ready"), F.col("d.total")) == "Deployed").alias(
            "finished"
        ),
    )


# --------------------------------------------------------------------------- #
# I7 run state machine
# --------------------------------------------------------------------------- #
def run_state_stream(events: DataFrame) -> DataFrame:
    """I7 (stream): fold lifecycle events into run metadata incrementally
    (status of the last event, start, number of resumes, last terminal
    time). Streaming-safe aggregates only."""
    status = F.create_map(*[F.lit(x) for kv in RUN_EVENT_STATUS.items() for x in kv])
    terminal = F.col("event").isin("complete", "abort", "interrupt")
    return events.groupBy("experiment_id", "run_id").agg(
        F.max_by(status[F.col("event")], F.struct("ts", "seq")).alias("status"),
        F.min(F.when(F.col("event") == "create", F.col("ts"))).alias("started_at"),
        F.count(F.when(F.col("event") == "resume", 1)).alias("n_resumes"),
        F.max(F.when(terminal, F.col("ts"))).alias("finished_at"),
    )


# --------------------------------------------------------------------------- #
# I1, I3, I7 live runs: state by buckets of keys, with event-time timers
# --------------------------------------------------------------------------- #
#: Runs are dealt to so many buckets by a hash of their keys. A bucket has one
#: state, so that Python is called once for a bucket and not once for a run.
LIVE_BUCKETS = 4096
#: The runs of a bucket and its waiting events, as Arrow streams, and the first time at which a running one is an orphan.
LIVE_STATE = "runs binary, pending binary, orphan_at long"
_LIVE_RUN = pa.schema([
    ("experiment_id", pa.string()), ("run_id", pa.string()), ("status", pa.string()), ("started", pa.int64()), ("resumed", pa.list_(pa.int64())), ("finished", pa.int64()),
    ("total", pa.int64()), ("completed", pa.int64()), ("errors", pa.int64()), ("label", pa.string()), ("last", pa.int64()), ("version", pa.int64()),
])
_LIVE_EVENT = pa.schema([
    ("experiment_id", pa.string()), ("run_id", pa.string()), ("ts_us", pa.int64()), ("seq", pa.int64()), ("event", pa.string()), ("total", pa.int64()), ("failed", pa.bool_()), ("label", pa.string()),
])
_LIVE_ROWS = "status string, started long, resumed array<long>, finished long, total long, completed long, errors long, label string, version long"


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(data)).read_all()


def fold_run(run: dict | None, events: list[tuple], until: int, grace: int) -> dict | None:
    """Fold one run's events (ts, seq, event, total, failed, label; in order,
    none after ``until``) into its state; None: no such run yet. Times are
    microseconds. See ``live_runs`` for the rules."""

    def reap(now: int) -> None:
        if run["status"] == "running" and now - run["last"] >= grace:
            run.update(status="interrupted", finished=run["last"] + grace)

    for ts, _, event, total, failed, label in events:
        if event == "create":
            run = {"status": "running", "started": ts, "resumed": [], "finished": None, "total": total, "completed": 0, "errors": 0, "label": None}
        elif run is None:
            continue
        else:
            reap(ts)
            if event == "row":
                run.update(completed=run["completed"] + 1, errors=run["errors"] + bool(failed), label=label)
            elif event == "resume":
                # rows that failed are done anew, the others are carried over
                run.update(status="running", resumed=[*run["resumed"], ts], total=total, completed=run["completed"] - run["errors"], errors=0, label=None)
            elif event in RUN_EVENT_STATUS:
                run.update(status=RUN_EVENT_STATUS[event], finished=ts)
        run["last"] = ts
    if run is not None:
        reap(until)
    return run


def _live_bucket(grace: int):
    def step(key, frames, state):
        import numpy as np
        import pandas as pd

        kept, waiting, orphan_at = state.get if state.exists else (_packed(_LIVE_RUN.empty_table()), _packed(_LIVE_EVENT.empty_table()), None)
        pending = pa.concat_tables([_unpacked(waiting), *(pa.Table.from_pandas(f[_LIVE_EVENT.names], schema=_LIVE_EVENT, preserve_index=False) for f in frames)])
        until = state.getCurrentWatermarkMs() * 1000
        late = pending.column("ts_us").to_numpy()
        is_due = late <= until
        due: dict[tuple, list[tuple]] = {}
        if is_due.any():
            for e, r, *event in zip(*pending.filter(pa.array(is_due)).to_pydict().values()):
                due.setdefault((e, r), []).append(tuple(event))
            pending = pending.filter(pa.array(~is_due))
        if due or orphan_at is not None and until >= orphan_at:
            runs = {(e, r): (dict(zip(_LIVE_RUN.names[2:-1], rest[:-1])), rest[-1]) for e, r, *rest in zip(*_unpacked(kept).to_pydict().values())}
            orphans = [k for k, (run, _) in runs.items() if run["status"] == "running" and until - run["last"] >= grace and k not in due]
            changed = []
            for k in [*due, *orphans]:
                before, version = runs.get(k, (None, 0))
                run = fold_run(dict(before) if before else None, sorted(due.get(k, ()), key=lambda e: e[:3]), until, grace)
                if run is not None and run != before:
                    runs[k] = run, version + 1
                    changed.append(k)
            last = [run["last"] for run, _ in runs.values() if run["status"] == "running"]
            orphan_at = min(last) + grace if last else None
            columns = {c: [run[c] for run, _ in runs.values()] for c in _LIVE_RUN.names[2:-1]}
            kept = _packed(pa.table({"experiment_id": [e for e, _ in runs], "run_id": [r for _, r in runs], **columns, "version": [v for _, v in runs.values()]}, schema=_LIVE_RUN))
            if changed:
                rows = [(*k, *(runs[k][0][c] for c in _LIVE_RUN.names[2:-2]), runs[k][1]) for k in changed]
                out = pd.DataFrame(rows, columns=[*_LIVE_RUN.names[:-2], "version"])
                yield out.astype({c: "Int64" for c in ("started", "finished", "total", "completed", "errors", "version")})
        state.update((bytes(kept), _packed(pending), orphan_at))
        timers = ([int(np.min(late[~is_due]))] if len(pending) else []) + ([orphan_at] if orphan_at is not None else [])
        if timers:
            # the first millisecond that isn't before the timer, and after the watermark
            state.setTimeoutTimestamp(max(-(-min(timers) // 1000), until // 1000 + 1))

    return step


def live_runs(events: DataFrame, watermark: str, grace_seconds: int = 15) -> DataFrame:
    """I1, I3, I7 (stream): a change log of run states. events(experiment_id,
    run_id, event, ts timestamp, seq, total, failed, label) may come in any
    order; an event may be late by ``watermark``, and later ones are dropped
    (Spark counts them in numRowsDroppedByWatermark).

    An event waits in its run's state until the watermark reaches it and is
    then applied in the order of (ts, seq, event):
    create: a new run, running, no rows, ``total`` tasks; row: one task is done
    (``failed``: with an error), ``label`` is the current one; resume: running
    again, one more resume time, a new ``total``, failed rows don't count any
    more; complete, abort, interrupt: that status and end. Before a create
    they are without effect. A running run without an event for
    ``grace_seconds`` is interrupted at the end of these (an event-time timer
    of its key). Each change is one row; the highest ``version`` of a run is
    its state at the watermark (``latest_states``). Output mode update.

    Runs are kept in LIVE_BUCKETS states by a hash of their keys, each with the
    runs of its bucket and their events of the last ``watermark`` only: a task
    has one bucket at a time in memory."""
    keys = ("experiment_id", "run_id")
    rows = events.withWatermark("ts", watermark).select(
        F.pmod(F.xxhash64(*keys), F.lit(LIVE_BUCKETS)).cast("int").alias("bucket"), *[F.col(k).cast("string").alias(k) for k in keys],
        "ts", F.unix_micros("ts").alias("ts_us"), F.col("seq").cast("long").alias("seq"), "event", F.col("total").cast("long").alias("total"), "failed", "label",
    )
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    out = f"experiment_id string, run_id string, {_LIVE_ROWS}"
    log = rows.groupBy("bucket").applyInPandasWithState(_live_bucket(grace_seconds * 1_000_000), out, LIVE_STATE, "update", "EventTimeTimeout")
    log = log.withColumns({k: F.col(k).cast(kinds[k]) for k in keys})
    return log.select(
        "experiment_id", "run_id", "status", F.timestamp_micros("started").alias("started_at"), F.transform("resumed", F.timestamp_micros).alias("resumed_at"),
        F.timestamp_micros("finished").alias("finished_at"), "total", "completed", "errors", F.col("label").alias("current_label"), "version",
    )


def append_log(log: DataFrame, target: str, checkpoint: str):
    """Start writing a change log (update mode) to a table, once for each
    micro-batch: a batch that is done again takes the place of its first try."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return log.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def latest_states(log: DataFrame, keys: Sequence[str] = ("experiment_id", "run_id")) -> DataFrame:
    """The last state of each run in a change log."""
    rest = [c for c in log.columns if c not in (*keys, "version", "batch")]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("s")).select(*keys, "s.*")

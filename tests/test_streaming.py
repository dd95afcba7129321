import datetime as dt
import pathlib

from pyspark.sql import functions as F

from evalcat.operators.summary import recount_runs
from evalcat.sources import partitions as P
from evalcat.streaming import jobs as J


def _results(spark, n=200):
    return spark.range(n).select(
        F.concat(F.lit("exp"), (F.col("id") % 2).cast("string")).alias("experiment_id"),
        F.concat(F.lit("run"), (F.col("id") % 3).cast("string")).alias("run_id"),
        (F.col("id") + 1).alias("result_id"),
        F.lit("p").alias("provider"),
        F.concat(F.lit("m"), (F.col("id") % 4).cast("string")).alias("model"),
        (F.col("id") % 50).alias("example_id"),
        F.when(F.col("id") % 7 == 0, "error").otherwise("completed").alias("status"),
        F.timestamp_seconds(F.col("id") * 10).alias("finished_at"),
        F.col("id").cast("double").alias("score"),
        F.col("id").alias("write_seq"),
    )


def test_progress_stream_equals_batch(spark):
    res = _results(spark)
    path, schema = J.stage_files(res, 5)
    live = J.drain_to_table(J.progress_stream(J.file_stream(spark, path, schema)), "complete")
    batch = recount_runs(res, ["experiment_id", "run_id"])
    got = {(r.experiment_id, r.run_id): (r.completed, r.errors) for r in live.collect()}
    want = {(r.experiment_id, r.run_id): (r.completed, r.errors) for r in batch.collect()}
    assert got == want


def test_upsert_sink_idempotent_and_restartable(spark):
    res = _results(spark)
    path, schema = J.stage_files(res, 4)
    target = J.scratch_path(spark, "t")
    ckpt = J.scratch_path(spark, "c")
    # first run consumes one file, then stops; the restart resumes from the checkpoint (I4)
    q1 = J.upsert_sink(J.file_stream(spark, path, schema, files_per_trigger=1), target, checkpoint=ckpt)
    q1.trigger(once=True).start().awaitTermination()
    q2 = J.upsert_sink(J.file_stream(spark, path, schema, files_per_trigger=1), target, checkpoint=ckpt)
    q2.trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(target)
    keys = ["experiment_id", "run_id", "provider", "model", "example_id"]
    assert out.count() == res.select(*keys).distinct().count()
    best = res.groupBy(*keys).agg(F.max("write_seq").alias("w"))
    j = out.join(best, keys).where(F.col("write_seq") != F.col("w"))
    assert j.count() == 0


def test_reaper_stream(spark):
    t0 = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame(
        [
            ("e", "done", "create", t0, 0), ("e", "done", "complete", t0 + dt.timedelta(seconds=5), 1),
            ("e", "lost", "create", t0, 0),
            ("e", "late", "create", t0 + dt.timedelta(seconds=100), 0),
        ],
        "experiment_id string, run_id string, event string, ts timestamp, seq int",
    )
    path, schema = J.stage_files(ev, 1)
    out = J.drain_to_table(J.reap_orphans_stream(J.file_stream(spark, path, schema), "0 seconds", grace_seconds=15), "append")
    got = {r.run_id: r.status for r in out.collect()}
    assert got.get("done") == "completed"
    # the watermark (100 s) passed lost's deadline (15 s) -> interrupted; late is still inside its window
    assert got.get("lost") == "interrupted" and "late" not in got


def test_deployment_stream(spark):
    lines = spark.createDataFrame(
        [
            ("d1", dt.datetime(2024, 1, 1, 0, 0, 0), 1, "inf-d1-cache-0   0/1   Pending   0   1m"),
            ("d1", dt.datetime(2024, 1, 1, 0, 0, 5), 2, "inf-d1-cache-0   1/1   Running   0   2m"),
            ("d1", dt.datetime(2024, 1, 1, 0, 0, 5), 3, "inf-d1-q-default-n-0   2/2   Running   0   2m"),
            ("d2", dt.datetime(2024, 1, 1, 0, 0, 5), 4, "inf-d2-q-default-n-0   1/2   Running   0   2m"),
        ],
        "deployment string, polled_at timestamp, seq long, line string",
    )
    path, schema = J.stage_files(lines, 2)
    out = J.drain_to_table(J.deployment_stream(J.file_stream(spark, path, schema)), "complete")
    assert {r.deployment: (r.status, r.finished) for r in out.collect()} == {"d1": ("Deployed", True), "d2": ("Deploying", False)}


def test_live_runs_out_of_order_late_and_restarted(spark):
    """Three parts with a restart between them; watermark of 100 s."""
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    rows = [
        # run a: parts out of order, a failed row redone after a resume
        (1, "a", "create", 0, 0, 4, None, None), (0, "a", "row", 2, 1, None, True, "p/m #1"), (0, "a", "row", 5, 2, None, False, "p/m #2"),
        (1, "a", "interrupt", 9, 3, None, None, None), (2, "a", "resume", 250, 4, 6, None, None), (1, "a", "row", 252, 5, None, False, "p/m #1"), (2, "a", "complete", 260, 6, None, None, None),
        # run b: orphaned after its first row, then rows again without a resume
        (0, "b", "create", 0, 0, 9, None, None), (0, "b", "row", 10, 1, None, False, "x"), (1, "b", "row", 40, 2, None, True, "y"),
        # run c: no create
        (0, "c", "row", 1, 0, None, False, "z"), (0, "c", "complete", 2, 1, None, None, None),
        # run d: alive at the watermark, what follows is not there yet
        (2, "d", "create", 290, 0, 2, None, None), (2, "d", "row", 304, 1, None, False, "u"), (2, "d", "complete", 306, 2, None, None, None),
        # run e: its second row comes 100 s after the watermark went by
        (0, "e", "create", 1, 0, 2, None, None), (0, "e", "row", 3, 1, None, False, "v"), (2, "e", "row", 4, 2, None, False, "lost"),
        # others: they move the watermark
        (0, "z", "create", 90, 0, 1, None, None), (1, "z", "complete", 300, 1, None, None, None), (2, "z", "row", 405, 2, None, False, "w"),
    ]
    ev = spark.createDataFrame(
        [(p, "exp", r, e, at(s), q, n, f, x) for p, r, e, s, q, n, f, x in rows],
        "part int, experiment_id string, run_id string, event string, ts timestamp, seq int, total int, failed boolean, label string",
    )
    target, ckpt = J.scratch_path(spark, "log"), J.scratch_path(spark, "ckpt")
    J.replay(ev, "part", 3, lambda s: J.append_log(J.live_runs(s, "100 seconds", grace_seconds=15), target, ckpt))
    log = spark.read.parquet(target)
    got = {r.run_id: r for r in J.latest_states(log).collect()}
    assert set(got) == {"a", "b", "d", "e", "z"}
    state = lambda r: (got[r].status, got[r].started_at, got[r].resumed_at, got[r].finished_at, got[r].total, got[r].completed, got[r].errors, got[r].current_label)
    assert state("a") == ("completed", at(0), [at(250)], at(260), 6, 2, 0, "p/m #1")
    assert state("b") == ("interrupted", at(0), [], at(25), 9, 2, 1, "y")
    assert state("d") == ("running", at(290), [], None, 2, 1, 0, "u")
    assert state("e") == ("interrupted", at(1), [], at(18), 2, 1, 0, "v")
    assert state("z") == ("completed", at(90), [], at(300), 1, 0, 0, None)
    # every run's versions count from 1 without gaps
    versions = log.groupBy("run_id").agg(F.max("version").alias("m"), F.count("*").alias("n")).collect()
    assert all(r.m == r.n for r in versions)


def test_fold_run_applies_rules_in_order():
    sec = 1_000_000
    run = J.fold_run(None, [(0, 0, "complete", None, None, None), (sec, 0, "create", 3, None, None), (2 * sec, 0, "row", None, True, "l")], 3 * sec, 15 * sec)
    assert (run["status"], run["total"], run["completed"], run["errors"], run["label"]) == ("running", 3, 1, 1, "l")
    run = J.fold_run(run, [], 17 * sec, 15 * sec)
    assert (run["status"], run["finished"]) == ("interrupted", 17 * sec)
    run = J.fold_run(run, [(20 * sec, 1, "resume", 5, None, None)], 21 * sec, 15 * sec)
    assert (run["status"], run["total"], run["completed"], run["errors"], run["label"], run["resumed"]) == ("running", 5, 0, 0, None, [20 * sec])


def test_upsert_reads_touched_partitions_only(spark):
    """A partition that no batch touches may be unreadable."""
    target, src = J.scratch_path(spark, "t"), J.scratch_path(spark, "s")
    res = _results(spark)
    one = res.where("experiment_id = 'exp0' AND run_id = 'run1'")
    res.write.partitionBy("experiment_id", "run_id").parquet(target)
    broken = pathlib.Path(target.removeprefix("file:")) / "experiment_id=exp1" / "run_id=run0"
    (broken / "part-broken.parquet").write_text("no parquet")
    one.withColumn("score", F.lit(-1.0)).withColumn("write_seq", F.col("write_seq") + 1000).write.parquet(src)
    J.upsert_sink(spark.readStream.schema(one.schema).parquet(src), target).trigger(availableNow=True).start().awaitTermination()
    back = spark.read.schema(one.schema).option("basePath", target).parquet(f"{target}/experiment_id=exp0")
    assert {r.run_id: r.m for r in back.groupBy("run_id").agg(F.max("score").alias("m")).collect()}["run1"] == -1.0
    assert back.where("run_id = 'run1'").count() == one.select("provider", "model", "example_id").distinct().count()


def test_delete_runs_and_experiments(spark):
    target, meta = J.scratch_path(spark, "t"), J.scratch_path(spark, "m")
    names = [("e/1", "a:b", 1), ("e/1", "c", 2), ("e/1", "busy", 3), ("x", "a:b", 4), ("x", "d", 5)]
    df = spark.createDataFrame(names, "experiment_id string, run_id string, v int")
    for t in (target, meta):
        df.write.partitionBy("experiment_id", "run_id").parquet(t)
    doomed = spark.createDataFrame([("e/1", "a:b"), ("e/1", "busy"), ("e/1", "none"), ("e/1", "a:b")], "experiment_id string, run_id string")
    busy = spark.createDataFrame([("e/1", "busy")], "experiment_id string, run_id string")
    out = {(r.run_id, r.outcome) for r in P.delete_runs(spark, [target, meta], doomed, busy).collect()}
    assert out == {("a:b", "deleted"), ("busy", "active"), ("none", "not_found")}
    for t in (target, meta):
        assert sorted(r.v for r in spark.read.parquet(t).collect()) == [2, 3, 4, 5]
    assert P.delete_experiments(spark, [target, meta], spark.createDataFrame([("x",), ("nope",)], "experiment_id string")) == 1
    assert sorted(r.v for r in spark.read.parquet(target).collect()) == [2, 3]


def test_partitions_left_empty_are_dropped(spark):
    target = J.scratch_path(spark, "t")
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "k string, v int")
    df.write.partitionBy("k").parquet(target)
    change = spark.createDataFrame([("a",), ("b",), ("new",)], "k string")
    before = P.read_touched(spark, target, change, ["k"], "v int, k string")
    assert sorted(r.v for r in before.collect()) == [1, 2, 3]
    P.replace_touched(spark, target, before.where("v = 2"), ["k"], before)
    assert sorted(r.v for r in spark.read.parquet(target).collect()) == [2, 4]
    assert not P.path_exists(spark, P.partition_path(target, {"k": "b"}))


def test_live_runs_share_states_by_bucket(spark, monkeypatch):
    """Python is called for buckets of runs, not for each; ids that are numbers or null stay so."""
    monkeypatch.setattr(J, "LIVE_BUCKETS", 3)
    t0 = dt.datetime(2024, 1, 1)
    big = 2**60 + 1
    rows = [(big + i if i else None, i, k, t0 + dt.timedelta(seconds=s + i), s, None if k != "create" else 5, k == "row" and i % 2 == 0, None) for i in range(40) for k, s in (("create", 0), ("row", 2), ("row", 4), ("abort", 9))]
    rows = [(e, r, k, t, q, n, f if k == "row" else None, x) for e, r, k, t, q, n, f, x in rows] + [(0, -1, "create", t0 + dt.timedelta(days=1), 0, 1, None, None)]
    ev = spark.createDataFrame(rows, "experiment_id long, run_id int, event string, ts timestamp, seq int, total int, failed boolean, label string")
    path, schema = J.stage_files(ev, 2)
    target = J.scratch_path(spark, "log")
    q = J.append_log(J.live_runs(spark.readStream.schema(schema).parquet(path), "10 seconds"), target, J.scratch_path(spark, "ckpt"))
    q.awaitTermination()
    assert max(op["numRowsTotal"] for p in q.recentProgress for op in p["stateOperators"]) <= 3
    got = {(r.experiment_id, r.run_id): (r.status, r.total, r.completed, r.errors) for r in J.latest_states(spark.read.parquet(target)).collect()}
    assert got == {(big + i if i else None, i): ("aborted", 5, 2, 2 * (i % 2 == 0)) for i in range(40)}


def test_state_on_disk(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    t0 = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([("e", f"r{i}", "create", t0 + dt.timedelta(seconds=i), 0) for i in range(60)], "experiment_id string, run_id string, event string, ts timestamp, seq int")
    path, schema = J.stage_files(ev, 2)
    target = J.scratch_path(spark, "sink")
    closed = J.reap_orphans_stream(J.file_stream(spark, path, schema, 2), "10 seconds", grace_seconds=15)
    with J.state_on_disk(spark):
        q = closed.writeStream.option("checkpointLocation", J.scratch_path(spark, "ckpt")).option("path", target).format("parquet").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.conf.get(key, None) == before
    assert any("rocksdb" in m for p in q.recentProgress for op in p["stateOperators"] for m in op["customMetrics"])
    # the watermark is 49 s: sessions that end by then are closed
    assert sorted(r.run_id for r in spark.read.parquet(target).collect()) == sorted(f"r{i}" for i in range(35))

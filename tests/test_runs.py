import datetime as dt

from pyspark.sql import functions as F

from evalcat.operators import runs as R
from evalcat.operators import summary
from evalcat.operators.ranking import exact_medians, with_row_index


def test_grid_ids_and_resume(spark):
    ex = spark.createDataFrame([(10, 0), (20, 1), (30, 2)], "example_id long, ordinal long")
    models = [{"provider": "p", "model": "a"}, {"provider": "p", "model": "b"}]
    grid = R.task_grid(ex, models)
    got = sorted((r.result_id, r.model, r.example_id) for r in grid.collect())
    assert got == [(1, "a", 10), (2, "a", 20), (3, "a", 30), (4, "b", 10), (5, "b", 20), (6, "b", 30)]
    prior = spark.createDataFrame(
        [
            (9, "completed", "p", "a", 10, "old a10"),   # carried, renumbered to 1
            (8, "error", "p", "a", 20, "ERROR: x"),      # redone
            (7, "completed", "p", "gone", 10, "old"),    # model left the grid: pruned
        ],
        "result_id long, status string, provider string, model string, example_id long, output string",
    )
    carried = R.carry_completed(prior, models, ex)
    assert [(r.result_id, r.output) for r in carried.collect()] == [(1, "old a10")]
    pending = sorted(r.result_id for r in R.pending_tasks(carried, models, ex).collect())
    assert pending == [2, 3, 4, 5, 6]
    assert sorted(r.model for r in R.prune_prior(prior, models, ex).collect()) == ["a", "a"]


def test_aggregate_calls_edges(spark):
    calls = spark.createDataFrame(
        [(1, None, None, 10.0, 1.0, None), (1, None, None, 20.0, 3.0, None), (2, 5, 7, 1.0, 2.0, 4.0)],
        "result_id long, input_tokens long, output_tokens long, latency_ms double, ttft_ms double, tps double",
    )
    res = spark.createDataFrame([(1,), (2,), (3,)], "result_id long")
    got = {r.result_id: r for r in res.join(summary.aggregate_calls(calls), "result_id", "left").collect()}
    assert got[1].input_tokens is None and got[1].latency_ms == 30.0 and got[1].ttft_ms == 2.0 and got[1].tps is None
    assert got[1].num_llm_calls == 2
    assert got[3].num_llm_calls is None and got[3].latency_ms is None


def test_exact_median_skewed_matches_pandas(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(7)
    hot = pd.DataFrame({"g": "hot", "v": rng.normal(size=5000)})
    cold = pd.DataFrame({"g": [f"c{i % 40}" for i in range(400)], "v": rng.integers(0, 9, 400).astype(float)})
    pdf = pd.concat([hot, cold])
    pdf.loc[pdf.sample(frac=0.05, random_state=1).index, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.when(F.isnan("v"), None).otherwise(F.col("v")))
    got = {r.g: r.m for r in exact_medians(df, ["g"], {"m": "v"}, num_partitions=16).collect()}
    want = pdf.groupby("g")["v"].median()
    assert set(got) == set(want.index)
    for g, m in want.items():
        assert abs(got[g] - m) < 1e-12


def test_row_index_dense(spark):
    df = spark.range(0, 1000).withColumn("k", (F.col("id") * 7919) % 1000)
    idx = with_row_index(df, ["k"], "ord", num_partitions=7)
    rows = idx.select("k", "ord").collect()
    assert sorted(r.ord for r in rows) == list(range(1000))
    assert all(r.ord == r.k for r in rows)


def test_reap_orphans(spark):
    now = dt.datetime(2024, 1, 1, 0, 1, 0)
    runs = spark.createDataFrame(
        [
            ("e", "r14", "running", now - dt.timedelta(seconds=14), None),
            ("e", "r16", "running", now - dt.timedelta(seconds=16), None),
            ("e", "r60", "running", now - dt.timedelta(seconds=60), None),
            ("e", "rnull", "running", None, None),
            ("e", "done", "completed", now - dt.timedelta(seconds=99), now),
        ],
        "experiment_id string, run_id string, status string, started_at timestamp, finished_at timestamp",
    )
    active = spark.createDataFrame([("e", "r60")], "experiment_id string, run_id string")
    out = {r.run_id: r.status for r in R.reap_orphans(runs, F.lit(now).cast("timestamp"), active).collect()}
    assert out == {"r14": "running", "r16": "interrupted", "r60": "running", "rnull": "interrupted", "done": "completed"}


def test_latest_upsert_next_id(spark):
    runs = spark.createDataFrame(
        [("e1", "a", "completed", dt.datetime(2024, 1, 1)), ("e1", "b", "running", dt.datetime(2024, 1, 2)),
         ("e2", "c", "completed", dt.datetime(2024, 1, 1))],
        "experiment_id string, run_id string, status string, started_at timestamp",
    )
    assert {r.experiment_id: r.run_id for r in R.latest_runs(runs).collect()} == {"e1": "b", "e2": "c"}
    assert [r.run_id for r in R.resumable_runs(runs).collect()] == ["b"]
    rows = spark.createDataFrame([("p", "m", 1, "x", 1), ("p", "m", 1, "y", 2), ("p", "m", 2, "z", 1)],
                                 "provider string, model string, example_id long, output string, write_seq long")
    assert sorted((r.example_id, r.output) for r in R.upsert_latest(rows).collect()) == [(1, "y"), (2, "z")]
    ids = spark.createDataFrame([(1,), (2,), (4,)], "id long")
    assert R.next_id(ids).first()[0] == 3
    assert R.next_id(spark.createDataFrame([(2,)], "id long")).first()[0] == 1


def test_run_state_fold(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    ev = spark.createDataFrame(
        [("e", "r", "create", t(0), 0), ("e", "r", "complete", t(5), 1), ("e", "r", "resume", t(9), 2)],
        "experiment_id string, run_id string, event string, ts timestamp, seq int",
    )
    r = R.run_state(ev).first()
    assert r.status == "running" and r.started_at == t(0) and r.resumed_at == [t(9)] and r.finished_at == t(5)


def test_resume_with_five_thousand_models(spark):
    """More models than are broadcast, one of them listed twice; the plans of
    a resume hold no product of models and examples."""
    ex = spark.range(0, 7).select((F.col("id") * 10).alias("example_id"), F.col("id").alias("ordinal"))
    models = spark.range(0, 5000).select(
        F.concat(F.lit("p"), (F.col("id") % 2).cast("string")).alias("provider"), F.concat(F.lit("m"), F.least("id", F.lit(4998)).cast("string")).alias("model"), F.col("id").alias("model_index")
    ).withColumn("provider", F.when(F.col("model_index") >= 4998, "p0").otherwise(F.col("provider")))
    grid = R.task_grid(ex, models)
    assert grid.count() == 35_000 and grid.select("result_id").distinct().count() == 35_000
    assert R.task_grid(ex, []).count() == 0
    prior = spark.createDataFrame(
        [(1, "completed", "p0", "m4998", 20, "twice"), (2, "completed", "p1", "m1", 60, "x"), (3, "error", "p1", "m1", 0, "y"), (4, "completed", "p1", "m1", 65, "no example"), (5, "completed", "p0", "m1", 0, "no model")],
        "result_id long, status string, provider string, model string, example_id long, output string",
    )
    carried = R.carry_completed(prior, models, ex)
    assert sorted((r.result_id, r.output) for r in carried.collect()) == [(1 * 7 + 6 + 1, "x"), (4998 * 7 + 2 + 1, "twice"), (4999 * 7 + 2 + 1, "twice")]
    pending = R.pending_tasks(carried, models, ex)
    whole = grid.select("result_id").exceptAll(carried.select("result_id"))
    assert pending.select("result_id").exceptAll(whole).count() == 0 and pending.count() == 35_000 - 3
    assert sorted(r.result_id for r in R.prune_prior(prior, models, ex).collect()) == [1, 2, 3]
    for plan in (carried, R.prune_prior(prior, models, ex)):
        text = plan._jdf.queryExecution().toString()
        assert not any(x in text for x in ("Cartesian", "NestedLoop", "Generate"))


def test_row_index_leaves_nothing_cached(spark):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    with_row_index(spark.range(50), ["id"], "ord").count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before

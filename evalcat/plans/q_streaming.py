"""Registered streaming queries: each replays a view of the test tables as a
file stream (one file per trigger), drains it, and returns the sink's table.
Their oracles are the batch SQL of the same quantity (stream == batch)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalcat.plans.adapters import V1_SQL, V6_PODS_SQL, V7_SQL, V9_SQL, v1_results, v6_pods, v9_run_log
from evalcat.plans.q_ops import _EVENTS_SQL, _run_events
from evalcat.plans.registry import register
from evalcat.streaming import jobs as J

N_FILES = 8
FILES_PER_TRIGGER = 4  # two micro-batches: state carries across triggers


@register(
    "i1_progress_stream",
    f"WITH v1 AS ({V1_SQL})"
    + """
SELECT experiment_id, run_id, count(*) AS completed, count(*) FILTER (WHERE status = 'error') AS errors,
       arg_max(provider || '/' || model || ' #' || CAST(example_id AS VARCHAR), (finished_at, result_id)) AS current_label
FROM v1 GROUP BY experiment_id, run_id
""",
)
def i1_progress_stream(spark, sf_dir):
    v = v1_results(spark, sf_dir).select(
        "experiment_id", "run_id", "result_id", "provider", "model", "example_id", "status", "finished_at"
    )
    path, schema = J.stage_files(v, N_FILES)
    return J.drain_to_table(J.progress_stream(J.file_stream(spark, path, schema, FILES_PER_TRIGGER)), "complete")


@register(
    "i2_upsert_sink",
    f"WITH v1 AS ({V1_SQL})"
    + """
SELECT experiment_id, run_id, provider, model, user_id AS example_id,
       arg_max(result_id, result_id) AS result_id, arg_max(score, result_id) AS score
FROM v1 GROUP BY experiment_id, run_id, provider, model, user_id
""",
)
def i2_upsert_sink(spark, sf_dir):
    v = v1_results(spark, sf_dir).select(
        "experiment_id", "run_id", "provider", "model", F.col("user_id").alias("example_id"), "result_id", "score",
        F.col("result_id").alias("write_seq"),
    )
    path, schema = J.stage_files(v, N_FILES)
    target = J.scratch_path(spark, "results")
    q = J.upsert_sink(J.file_stream(spark, path, schema, FILES_PER_TRIGGER), target).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(target).select("experiment_id", "run_id", "provider", "model", "example_id", "result_id", "score")


@register(
    "i5_deployment_stream",
    f"WITH pods AS ({V6_PODS_SQL})"
    + """
, parsed AS (SELECT deployment, polled_at, seq, parts[1] AS name,
                    coalesce(TRY_CAST(string_split(parts[2], '/')[1] AS INTEGER), 0) AS ready,
                    coalesce(TRY_CAST(string_split(parts[2], '/')[2] AS INTEGER), 0) AS total,
                    CASE WHEN contains(parts[1], '-cache-') THEN 'cache' WHEN contains(parts[1], '-q-default-n-') THEN 'default'
                         ELSE 'other' END AS kind
             FROM (SELECT *, regexp_split_to_array(trim(line), '\\s+') AS parts FROM pods) WHERE len(parts) >= 3)
, latest AS (SELECT deployment, kind, arg_max(ready, (polled_at, seq)) AS ready, arg_max(total, (polled_at, seq)) AS total
             FROM parsed WHERE kind <> 'other' GROUP BY deployment, kind)
, s AS (
  SELECT d.deployment,
         CASE WHEN cp.total IS NULL AND dp.total IS NULL THEN 'Not Deployed'
              WHEN coalesce(cp.ready = cp.total, false) AND coalesce(dp.ready = dp.total, false) THEN 'Deployed'
              ELSE 'Deploying' END AS status
  FROM (SELECT DISTINCT deployment FROM parsed) d
  LEFT JOIN latest cp ON cp.deployment = d.deployment AND cp.kind = 'cache'
  LEFT JOIN latest dp ON dp.deployment = d.deployment AND dp.kind = 'default')
SELECT deployment, status, status = 'Deployed' AS finished FROM s
""",
)
def i5_deployment_stream(spark, sf_dir):
    path, schema = J.stage_files(v6_pods(spark, sf_dir), N_FILES)
    return J.drain_to_table(J.deployment_stream(J.file_stream(spark, path, schema, FILES_PER_TRIGGER)), "complete")


@register(
    "i7_run_state_stream",
    f"WITH runs AS ({V7_SQL})"
    + _EVENTS_SQL
    + """
SELECT experiment_id, run_id,
       arg_max(CASE event WHEN 'create' THEN 'running' WHEN 'resume' THEN 'running' WHEN 'complete' THEN 'completed'
                          WHEN 'abort' THEN 'aborted' ELSE 'interrupted' END, (ts, seq)) AS status,
       CAST(epoch(min(ts) FILTER (WHERE event = 'create')) AS BIGINT) AS started_epoch,
       count(*) FILTER (WHERE event = 'resume') AS n_resumes,
       CAST(epoch(max(ts) FILTER (WHERE event IN ('complete', 'abort', 'interrupt'))) AS BIGINT) AS finished_epoch
FROM ev GROUP BY experiment_id, run_id
""",
)
def i7_run_state_stream(spark, sf_dir):
    path, schema = J.stage_files(_run_events(spark, sf_dir), N_FILES)
    st = J.drain_to_table(J.run_state_stream(J.file_stream(spark, path, schema, FILES_PER_TRIGGER)), "complete")
    return st.select(
        "experiment_id",
        "run_id",
        "status",
        F.unix_timestamp("started_at").alias("started_epoch"),
        "n_resumes",
        F.unix_timestamp("finished_at").alias("finished_epoch"),
    )


@register(
    "i3_reap_orphans_stream",
    f"WITH runs AS ({V7_SQL})"
    + _EVENTS_SQL
    + """
, e2 AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY experiment_id, run_id ORDER BY ts, seq) IS NULL
                          OR epoch(ts) - epoch(lag(ts) OVER (PARTITION BY experiment_id, run_id ORDER BY ts, seq)) >= 15
                        THEN 1 ELSE 0 END AS new_s FROM ev)
, e3 AS (SELECT *, sum(new_s) OVER (PARTITION BY experiment_id, run_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS sid FROM e2)
, s AS (SELECT experiment_id, run_id, sid, arg_max(event, (ts, seq)) AS last_event, max(ts) AS last_ts,
               max(ts) + INTERVAL 15 SECOND AS send FROM e3 GROUP BY experiment_id, run_id, sid)
, closed AS (SELECT *, CASE last_event WHEN 'complete' THEN 'completed' WHEN 'abort' THEN 'aborted'
                                       WHEN 'interrupt' THEN 'interrupted' END AS term
             FROM s WHERE send <= (SELECT max(ts) FROM ev) - INTERVAL 2 DAY)
, outc AS (SELECT experiment_id, run_id, sid, coalesce(term, 'interrupted') AS status,
                  CASE WHEN term IS NOT NULL THEN last_ts ELSE send END AS fin FROM closed)
SELECT experiment_id, run_id, arg_max(status, (fin, sid)) AS status, CAST(epoch(max(fin)) AS BIGINT) AS finished_epoch
FROM outc GROUP BY experiment_id, run_id
""",
)
def i3_reap_orphans_stream(spark, sf_dir):
    """I3 (stream): lifecycle events arrive in two parts, each in no order,
    and some up to two days late; each closed activity session yields an
    outcome (terminal status, or interrupted when the grace period passed
    without one); the report keeps each run's latest outcome. The oracle
    sessionizes the same events in SQL (gaps of 15 s or more start a new
    session) and keeps the sessions the final watermark has closed."""
    ev = _run_events(spark, sf_dir)
    arrival = F.timestamp_seconds(F.unix_timestamp("ts") + F.pmod(F.xxhash64("run_id", "seq"), F.lit(2 * 86400)))
    target, checkpoint = J.scratch_path(spark, "sink"), J.scratch_path(spark, "ckpt")

    def start(stream):
        closed = J.reap_orphans_stream(stream, "2 days", grace_seconds=15)
        with J.state_on_disk(spark):  # a part's sessions are all open until the watermark passes it
            return closed.writeStream.option("checkpointLocation", checkpoint).option("path", target).format("parquet").trigger(availableNow=True).start()

    J.replay(ev.withColumn("part", (arrival >= F.lit("1995-01-01").cast("timestamp")).cast("int")), "part", 2, start)
    closed = spark.read.parquet(target)
    # one outcome per closed activity session; report each run's latest outcome
    latest = closed.groupBy("experiment_id", "run_id").agg(
        F.max_by(F.struct("status", "finished_at"), F.struct("finished_at", "session_start")).alias("o")
    )
    return latest.select("experiment_id", "run_id", "o.status", F.unix_timestamp("o.finished_at").alias("finished_epoch"))


@register(
    "i1_i3_i7_live_runs",
    f"WITH log AS ({V9_SQL})"
    + """
, ev AS (SELECT * FROM log WHERE NOT lost AND ts <= (SELECT max(ts) FROM log WHERE NOT lost) - INTERVAL 30 DAY)
, begun AS (SELECT experiment_id, run_id, min(ts) AS t0 FROM ev WHERE event = 'create' GROUP BY ALL)
, e AS (SELECT ev.*, t0, sum(CASE WHEN event <> 'row' THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS seg,
               coalesce(lead(ts) OVER w, (SELECT max(ts) FROM log WHERE NOT lost) - INTERVAL 30 DAY) AS nxt
        FROM ev JOIN begun USING (experiment_id, run_id) WHERE ts >= t0 WINDOW w AS (PARTITION BY experiment_id, run_id ORDER BY ts, seq))
, s AS (SELECT experiment_id, run_id, t0, seg, arg_min(event, (ts, seq)) AS head, min(ts) AS head_ts, arg_min(total, (ts, seq)) AS head_total,
               count(*) FILTER (event = 'row') AS n, count(*) FILTER (event = 'row' AND failed) AS bad, arg_max(label, (ts, seq)) FILTER (event = 'row') AS label,
               min(ts + INTERVAL 15 SECOND) FILTER (nxt - ts >= INTERVAL 15 SECOND) AS reaped
        FROM e GROUP BY ALL)
, m AS (SELECT *, max(seg) OVER w AS last_seg, coalesce(max(seg) FILTER (head IN ('create', 'resume')) OVER w, 0) AS run_seg FROM s WINDOW w AS (PARTITION BY experiment_id, run_id))
SELECT experiment_id, run_id,
       max(CASE WHEN seg = last_seg THEN CASE head WHEN 'complete' THEN 'completed' WHEN 'abort' THEN 'aborted' WHEN 'interrupt' THEN 'interrupted'
                                                   ELSE CASE WHEN reaped IS NOT NULL THEN 'interrupted' ELSE 'running' END END END) AS status,
       CAST(epoch(min(t0)) AS BIGINT) AS started_epoch,
       coalesce(string_agg(CAST(CAST(epoch(head_ts) AS BIGINT) AS VARCHAR), ',' ORDER BY head_ts) FILTER (head = 'resume'), '') AS resumed,
       CAST(epoch(max(CASE WHEN head IN ('create', 'resume') THEN reaped ELSE head_ts END)) AS BIGINT) AS finished_epoch,
       CAST(max(CASE WHEN seg = run_seg THEN head_total END) AS BIGINT) AS total,
       CAST(sum(CASE WHEN seg < run_seg THEN n - bad ELSE n END) AS BIGINT) AS completed,
       CAST(coalesce(sum(bad) FILTER (seg >= run_seg), 0) AS BIGINT) AS errors,
       arg_max(label, seg) FILTER (seg >= run_seg AND label IS NOT NULL) AS current_label
FROM m GROUP BY experiment_id, run_id
""",
)
def i1_i3_i7_live_runs(spark, sf_dir):
    """I1, I3, I7 (stream): counters with total, statuses, resume times and
    reaped orphans of all runs, as of the watermark. The log arrives in three
    parts with a restart between them, out of order by up to 20 days; events
    that come after the watermark of 30 days are lost."""
    target, checkpoint = J.scratch_path(spark, "log"), J.scratch_path(spark, "ckpt")
    log = v9_run_log(spark, sf_dir).drop("lost")
    J.replay(log, "part", 3, lambda stream: J.append_log(J.live_runs(stream, "30 days", grace_seconds=15), target, checkpoint))
    states = J.latest_states(spark.read.parquet(target))
    return states.select(
        "experiment_id", "run_id", "status", F.unix_timestamp("started_at").alias("started_epoch"),
        F.array_join(F.transform("resumed_at", lambda t: F.unix_timestamp(t).cast("string")), ",").alias("resumed"),
        F.unix_timestamp("finished_at").alias("finished_epoch"), "total", "completed", "errors", "current_label",
    )

"""Registered queries over V3 (calls), V6 (deployments), V7 (runs), V8
(vectors) and the analyst workload (D23) on the TPC-H-style tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalcat.functions import catalog as K
from evalcat.functions import scoring as S
from evalcat.functions import text as X
from evalcat.functions.codeeval import all_close
from evalcat.operators import catalog as C
from evalcat.operators import runs, summary
from evalcat.operators.calls import call_timing, first_usable
from evalcat.operators.deployments import deployment_status_table, parse_pod_lines
from evalcat.plans.adapters import (
    V3_SQL,
    V6_BUNDLES_SQL,
    V6_PODS_SQL,
    V7_SQL,
    V8_SQL,
    v3_calls,
    v6_bundles,
    v6_pods,
    v7_runs,
    v8_vectors,
)
from evalcat.plans.registry import register, round_doubles
from evalcat.session import read_table
from evalcat.sources import partitions as PART
from evalcat.streaming.jobs import scratch_path

V3 = f"WITH calls AS ({V3_SQL})\n"
V6 = f"WITH bundles AS ({V6_BUNDLES_SQL}), pods AS ({V6_PODS_SQL})\n"
V7 = f"WITH runs AS ({V7_SQL})\n"
V8 = f"WITH vectors AS ({V8_SQL})\n"


# ------------------------------------------------------------------ calls
@register(
    "d5_j5_aggregate_calls",
    V3
    + """
SELECT o.o_orderkey AS result_id,
       CAST(sum(c.input_tokens) AS BIGINT) AS input_tokens, CAST(sum(c.output_tokens) AS BIGINT) AS output_tokens,
       round(sum(c.latency_ms), 6) AS latency_ms,
       round(quantile_cont(c.ttft_ms, 0.5), 6) AS ttft_ms, round(quantile_cont(c.tps, 0.5), 6) AS tps,
       CASE WHEN count(c.result_id) = 0 THEN NULL ELSE count(c.result_id) END AS num_llm_calls
FROM orders o LEFT JOIN calls c ON o.o_orderkey = c.result_id
GROUP BY o.o_orderkey
""",
)
def d5_j5_aggregate_calls(spark, sf_dir):
    """Per result row metrics over its calls; results with no calls
    come out all-null (count too)."""
    calls = v3_calls(spark, sf_dir)
    per = summary.aggregate_calls(calls, ["result_id"])
    res = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("result_id"))
    return round_doubles(res.join(per, "result_id", "left")).select(
        "result_id", "input_tokens", "output_tokens", "latency_ms", "ttft_ms", "tps", "num_llm_calls"
    )


@register(
    "h13_call_timing",
    V3
    + """
SELECT result_id, call_no,
       round(CASE WHEN call_no % 2 = 0 THEN l_tax * 1000.0 ELSE (l_discount - 0.0) * 1000.0 END, 6) AS ttft_ms,
       round(CASE WHEN call_no % 3 = 0 THEN (l_tax + 1) * 1000.0 ELSE (l_discount + l_tax + 0.5 - 0.0) * 1000.0 END, 6) AS latency_ms,
       round(CASE WHEN call_no % 5 = 0 THEN CAST(l_partkey % 50 AS DOUBLE)
                  WHEN output_tokens IS NOT NULL AND output_tokens <> 0 AND (l_discount + l_tax + 0.5) > l_discount
                    THEN output_tokens / ((l_discount + l_tax + 0.5) - l_discount) END, 6) AS tps
FROM calls
""",
)
def h13_call_timing(spark, sf_dir):
    c = v3_calls(spark, sf_dir)
    usage = F.struct(
        F.when(F.col("call_no") % 2 == 0, F.col("l_tax")).alias("time_to_first_token"),
        F.when(F.col("call_no") % 3 == 0, F.col("l_tax") + 1).alias("total_latency"),
        F.when(F.col("call_no") % 5 == 0, (F.col("l_partkey") % 50).cast("double")).alias(
            "completion_tokens_after_first_per_sec"
        ),
        F.col("output_tokens").alias("completion_tokens"),
    )
    t = call_timing(usage, F.lit(0.0), F.col("l_discount"), F.col("l_discount") + F.col("l_tax") + 0.5)
    return round_doubles(
        c.select("result_id", "call_no", t["ttft_ms"].alias("ttft_ms"), t["latency_ms"].alias("latency_ms"), t["tps"].alias("tps"))
    )


@register(
    "e5_first_usable",
    """
SELECT l_orderkey AS result_id,
       coalesce(arg_min(CASE WHEN l_returnflag = 'R' THEN NULL ELSE 'code ' || CAST(l_partkey AS VARCHAR) END,
                        (l_linenumber, l_partkey, l_returnflag)),
                arg_max(CASE WHEN l_returnflag = 'R' THEN '' ELSE 'code ' || CAST(l_partkey AS VARCHAR) END,
                        (l_linenumber, l_partkey, l_returnflag))) AS code
FROM lineitem WHERE l_linenumber <= 3 GROUP BY l_orderkey
""",
)
def e5_first_usable(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    attempts = li.select(
        F.col("l_orderkey").alias("result_id"),
        # attempt order; the test table repeats line numbers, so break ties
        F.struct("l_linenumber", "l_partkey", "l_returnflag").alias("attempt"),
        F.col("l_linenumber").alias("attempt_no"),
        F.when(F.col("l_returnflag") == "R", F.lit("")).otherwise(F.concat(F.lit("code "), F.col("l_partkey").cast("string"))).alias("code"),
    )
    return first_usable(attempts, ["result_id"], "attempt", "code", max_attempts=3, attempt_no_col="attempt_no")


# ------------------------------------------------------------------ runs
@register(
    "e2_latest_runs",
    V7 + "SELECT experiment_id, arg_max(run_id, (started_at, run_id)) AS run_id, "
    "arg_max(status, (started_at, run_id)) AS status FROM runs GROUP BY experiment_id",
)
def e2_latest_runs(spark, sf_dir):
    r = v7_runs(spark, sf_dir).select("experiment_id", "run_id", "status", "started_at")
    return runs.latest_runs(r).select("experiment_id", "run_id", "status")


@register(
    "e2_resumable_runs",
    V7
    + """
SELECT * FROM (SELECT experiment_id, arg_max(run_id, (started_at, run_id)) AS run_id,
                      arg_max(status, (started_at, run_id)) AS status FROM runs GROUP BY experiment_id)
WHERE status <> 'completed'
""",
)
def e2_resumable_runs(spark, sf_dir):
    r = v7_runs(spark, sf_dir).select("experiment_id", "run_id", "status", "started_at")
    return runs.resumable_runs(r).select("experiment_id", "run_id", "status")


@register("f1_runs_newest", V7 + "SELECT experiment_id, run_id, status FROM runs ORDER BY started_at DESC, run_id DESC")
def f1_runs_newest(spark, sf_dir):
    r = v7_runs(spark, sf_dir)
    return runs.runs_newest(r).select("experiment_id", "run_id", "status")


def _dur_sql(a: str, b: str) -> str:
    ms = f"((epoch({b}) - epoch({a})) * 1000)"
    secs = f"CAST(floor({ms} / 1000 + 0.5) AS BIGINT)"
    h, m, s = f"({secs} // 3600)", f"(({secs} % 3600) // 60)", f"({secs} % 60)"
    return (
        f"CASE WHEN {a} IS NULL OR {b} IS NULL OR {ms} < 0 THEN '—' "
        f"WHEN {h} > 0 THEN printf('%dh %dm %ds', {h}, {m}, {s}) "
        f"WHEN {m} > 0 THEN printf('%dm %ds', {m}, {s}) ELSE printf('%ds', {s}) END"
    )


@register(
    "h15_h16_run_ids",
    V7
    + f"""
SELECT experiment_id, run_id,
       CAST(epoch(strptime(run_id, '%Y-%m-%dT%H-%M-%S-%gZ')) AS BIGINT) AS parsed_epoch,
       regexp_replace(run_id, '^(\\d{{4}})-(\\d{{2}})-(\\d{{2}})T(\\d{{2}})-(\\d{{2}})-(\\d{{2}})-(\\d{{3}})Z$', '\\1-\\2-\\3 \\4:\\5:\\6 UTC') AS display,
       {_dur_sql('started_at', 'finished_at')} AS duration
FROM runs
""",
)
def h15_h16_run_ids(spark, sf_dir):
    r = v7_runs(spark, sf_dir)
    return r.select(
        "experiment_id",
        "run_id",
        F.unix_timestamp(S.parse_run_id("run_id")).alias("parsed_epoch"),
        S.run_id_display("run_id").alias("display"),
        S.duration_text("started_at", "finished_at").alias("duration"),
    )


_NOW = "1998-06-01 00:00:00"


@register(
    "i3_reap_orphans",
    V7
    + f"""
, active AS (SELECT r.experiment_id, r.run_id FROM runs r JOIN customer c ON r.o_custkey = c.c_custkey WHERE c.c_acctbal > 9000)
SELECT r.experiment_id, r.run_id,
       CASE WHEN r.status = 'running' AND a.run_id IS NULL
                 AND (r.started_at IS NULL OR epoch(TIMESTAMP '{_NOW}') - epoch(r.started_at) >= 15)
            THEN 'interrupted' ELSE r.status END AS status,
       CAST(epoch(CASE WHEN r.status = 'running' AND a.run_id IS NULL
                 AND (r.started_at IS NULL OR epoch(TIMESTAMP '{_NOW}') - epoch(r.started_at) >= 15)
            THEN TIMESTAMP '{_NOW}' ELSE r.finished_at END) AS BIGINT) AS finished_epoch
FROM runs r LEFT JOIN active a ON r.experiment_id = a.experiment_id AND r.run_id = a.run_id
""",
)
def i3_reap_orphans(spark, sf_dir):
    r = v7_runs(spark, sf_dir)
    cust = read_table(spark, sf_dir, "customer").where(F.col("c_acctbal") > 9000)
    active = r.join(cust, r["o_custkey"] == cust["c_custkey"], "left_semi").select("experiment_id", "run_id")
    out = runs.reap_orphans(
        r.select("experiment_id", "run_id", "status", "started_at", "finished_at"),
        F.lit(_NOW).cast("timestamp"),
        active,
    )
    return out.select("experiment_id", "run_id", "status", F.unix_timestamp("finished_at").alias("finished_epoch"))


_EVENTS_SQL = """
, ev AS (
  SELECT experiment_id, run_id, 'create' AS event, started_at AS ts, 0 AS seq FROM runs
  UNION ALL
  SELECT r.experiment_id, r.run_id, 'resume', r.started_at + to_seconds(l.l_linenumber * 60), l.l_linenumber
  FROM runs r JOIN lineitem l ON r.o_orderkey = l.l_orderkey WHERE l.l_linenumber > 1
  UNION ALL
  SELECT experiment_id, run_id, CASE status WHEN 'completed' THEN 'complete' WHEN 'aborted' THEN 'abort' ELSE 'interrupt' END,
         finished_at, 100 FROM runs WHERE status <> 'running')
"""


def _run_events(spark, sf_dir):
    r = v7_runs(spark, sf_dir)
    li = read_table(spark, sf_dir, "lineitem").where(F.col("l_linenumber") > 1)
    create = r.select("experiment_id", "run_id", F.lit("create").alias("event"), F.col("started_at").alias("ts"), F.lit(0).alias("seq"))
    resume = r.join(li, r["o_orderkey"] == li["l_orderkey"]).select(
        "experiment_id",
        "run_id",
        F.lit("resume").alias("event"),
        F.timestamp_seconds(F.unix_timestamp("started_at") + F.col("l_linenumber") * 60).alias("ts"),
        F.col("l_linenumber").alias("seq"),
    )
    term = r.where(F.col("status") != "running").select(
        "experiment_id",
        "run_id",
        F.when(F.col("status") == "completed", "complete").when(F.col("status") == "aborted", "abort").otherwise("interrupt").alias("event"),
        F.col("finished_at").alias("ts"),
        F.lit(100).alias("seq"),
    )
    return create.unionByName(resume).unionByName(term)


@register(
    "i7_run_state",
    V7
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
def i7_run_state(spark, sf_dir):
    st = runs.run_state(_run_events(spark, sf_dir))
    return st.select(
        "experiment_id",
        "run_id",
        "status",
        F.unix_timestamp("started_at").alias("started_epoch"),
        F.size("resumed_at").cast("long").alias("n_resumes"),
        F.unix_timestamp("finished_at").alias("finished_epoch"),
    )


@register(
    "d1_recount_meta",
    V7
    + """
SELECT r.experiment_id, r.run_id, coalesce(count(l.l_orderkey), 0) AS completed,
       coalesce(count(l.l_orderkey) FILTER (WHERE l.l_returnflag = 'R'), 0) AS errors
FROM runs r LEFT JOIN lineitem l ON r.o_orderkey = l.l_orderkey GROUP BY r.experiment_id, r.run_id
""",
)
def d1_recount_meta(spark, sf_dir):
    r = v7_runs(spark, sf_dir).select("experiment_id", "run_id", "o_orderkey")
    li = read_table(spark, sf_dir, "lineitem")
    res = r.join(li, r["o_orderkey"] == li["l_orderkey"]).select(
        "experiment_id", "run_id", F.when(F.col("l_returnflag") == "R", "error").otherwise("completed").alias("status")
    )
    return runs.recount_meta(r.drop("o_orderkey"), res)


@register(
    "d17_next_id",
    """
WITH used AS (SELECT DISTINCT o_custkey AS v FROM orders WHERE o_custkey >= 1)
SELECT min(v) AS next_id FROM (SELECT v + 1 AS v FROM used UNION SELECT 1)
WHERE v NOT IN (SELECT v FROM used)
""",
)
def d17_next_id(spark, sf_dir):
    return runs.next_id(read_table(spark, sf_dir, "orders"), "o_custkey")


@register(
    "a13_drop_run",
    """
WITH r AS (SELECT 'exp ' || CAST(user_id % 20 AS VARCHAR) AS experiment_id, 'run:' || CAST(event_id % 7 AS VARCHAR) AS run_id, event_id, event_type FROM events),
doomed AS (SELECT experiment_id, run_id FROM r GROUP BY ALL HAVING count(*) FILTER (WHERE event_type = 'error') % 3 = 0),
active AS (SELECT experiment_id, run_id FROM r GROUP BY ALL HAVING max(event_id) % 2 = 0)
SELECT experiment_id, run_id, count(*) AS n, coalesce((SELECT 'active' FROM doomed d WHERE d.experiment_id = r.experiment_id AND d.run_id = r.run_id), '') AS outcome
FROM r WHERE (NOT EXISTS (SELECT 1 FROM doomed d WHERE d.experiment_id = r.experiment_id AND d.run_id = r.run_id)
   OR EXISTS (SELECT 1 FROM active a WHERE a.experiment_id = r.experiment_id AND a.run_id = r.run_id))
  AND experiment_id NOT IN (SELECT 'exp ' || CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey = 1)
GROUP BY experiment_id, run_id
""",
)
def a13_drop_run(spark, sf_dir):
    """Results partitioned by experiment and run; runs with a number of
    errors that three divides are dropped unless they are active, then the
    experiments of a region's nations with all their runs. What is left is
    read from the table."""
    e = read_table(spark, sf_dir, "events")
    r = e.select(
        F.concat(F.lit("exp "), (F.col("user_id") % 20).cast("string")).alias("experiment_id"),
        F.concat(F.lit("run:"), (F.col("event_id") % 7).cast("string")).alias("run_id"),
        "event_id", "event_type",
    )
    target = scratch_path(spark, "results")
    r.repartition("experiment_id", "run_id").write.partitionBy("experiment_id", "run_id").parquet(target)
    per_run = r.groupBy("experiment_id", "run_id").agg(F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"), F.max("event_id").alias("last"))
    outcome = PART.delete_runs(spark, [target], per_run.where("errors % 3 = 0"), per_run.where("last % 2 = 0"))
    region = read_table(spark, sf_dir, "nation").where("n_regionkey = 1")
    PART.delete_experiments(spark, [target], region.select(F.concat(F.lit("exp "), F.col("n_nationkey").cast("string")).alias("experiment_id")))
    left = spark.read.schema(r.schema).parquet(target).groupBy("experiment_id", "run_id").agg(F.count(F.lit(1)).alias("n"))
    return left.join(outcome, ["experiment_id", "run_id"], "left").select("experiment_id", "run_id", "n", F.coalesce("outcome", F.lit("")).alias("outcome"))


# ------------------------------------------------------------------ deployments
@register(
    "a15_b14_pod_lines",
    V6
    + """
SELECT seq, parts[1] AS name,
       coalesce(TRY_CAST(string_split(parts[2], '/')[1] AS INTEGER), 0) AS ready,
       coalesce(TRY_CAST(string_split(parts[2], '/')[2] AS INTEGER), 0) AS total,
       parts[3] AS status, coalesce(parts[4], '0') AS restarts, coalesce(parts[5], '') AS age,
       CASE WHEN contains(parts[1], '-cache-') THEN 'cache' WHEN contains(parts[1], '-q-default-n-') THEN 'default'
            ELSE 'other' END AS kind
FROM (SELECT seq, regexp_split_to_array(trim(line), '\\s+') AS parts FROM pods) WHERE len(parts) >= 3
""",
)
def a15_b14_pod_lines(spark, sf_dir):
    p = parse_pod_lines(v6_pods(spark, sf_dir), "line")
    return p.select("seq", "name", "ready", "total", "status", "restarts", "age", K.classify_pod("name").alias("kind"))


@register(
    "b15_i5_deployment_status",
    V6
    + """
, parsed AS (SELECT deployment, polled_at, seq, parts[1] AS name,
                    coalesce(TRY_CAST(string_split(parts[2], '/')[1] AS INTEGER), 0) AS ready,
                    coalesce(TRY_CAST(string_split(parts[2], '/')[2] AS INTEGER), 0) AS total,
                    CASE WHEN contains(parts[1], '-cache-') THEN 'cache' WHEN contains(parts[1], '-q-default-n-') THEN 'default'
                         ELSE 'other' END AS kind
             FROM (SELECT *, regexp_split_to_array(trim(line), '\\s+') AS parts FROM pods) WHERE len(parts) >= 3)
, latest AS (SELECT deployment, kind, arg_max(ready, (polled_at, seq)) AS ready, arg_max(total, (polled_at, seq)) AS total
             FROM parsed WHERE kind <> 'other' GROUP BY deployment, kind)
SELECT 'd' || CAST(c.c_custkey AS VARCHAR) AS deployment,
       CASE WHEN cp.total IS NULL AND dp.total IS NULL THEN 'Not Deployed'
            WHEN coalesce(cp.ready = cp.total, false) AND coalesce(dp.ready = dp.total, false) THEN 'Deployed'
            ELSE 'Deploying' END AS status
FROM customer c
LEFT JOIN latest cp ON cp.deployment = 'd' || CAST(c.c_custkey AS VARCHAR) AND cp.kind = 'cache'
LEFT JOIN latest dp ON dp.deployment = 'd' || CAST(c.c_custkey AS VARCHAR) AND dp.kind = 'default'
""",
)
def b15_i5_deployment_status(spark, sf_dir):
    deps = read_table(spark, sf_dir, "customer").select(F.concat(F.lit("d"), F.col("c_custkey").cast("string")).alias("deployment"))
    pods = parse_pod_lines(v6_pods(spark, sf_dir), "line")
    return deployment_status_table(deps, pods).select("deployment", "status")


@register(
    "b12_b17_d18_bundle_validity",
    V6
    + """
SELECT is_valid, count(*) AS n FROM (
  SELECT coalesce(conditions[1].reason = 'ValidationSucceeded' OR conditions[1].status = 'True', false) AS is_valid FROM bundles)
GROUP BY is_valid
""",
)
def b12_b17_d18_bundle_validity(spark, sf_dir):
    b = C.bundle_status(v6_bundles(spark, sf_dir))
    return C.count_by(b, "is_valid")


@register(
    "b12_b17_ready_bundles",
    V6
    + """
SELECT name, coalesce(conditions[1].status, 'Unknown') AS cond_status, coalesce(conditions[1].reason, '') AS cond_reason
FROM bundles WHERE coalesce(conditions[1].reason = 'ValidationSucceeded' OR conditions[1].status = 'True', false)
""",
)
def b12_b17_ready_bundles(spark, sf_dir):
    b = C.only_ready(C.bundle_status(v6_bundles(spark, sf_dir)), "is_valid")
    return b.select("name", "cond_status", "cond_reason")


@register(
    "b13_error_lines",
    V6
    + """
, msgs AS (
  SELECT name, coalesce(nullif(list_filter(conditions, lambda c: c.reason = 'ValidationFailed'
                                  OR (c.status = 'False' AND coalesce(c.message, '') <> ''))[1].message, ''),
                        array_to_string(list_filter(list_transform(conditions, lambda c: c.message), lambda m: coalesce(m, '') <> ''), chr(10))) AS msg
  FROM bundles)
SELECT name, CAST(generate_subscripts(lines, 1) - 1 AS INTEGER) AS line_no, unnest(lines) AS line
FROM (SELECT name, CASE WHEN coalesce(msg, '') <> '' THEN list_filter(list_transform(string_split(msg, chr(10)), lambda x: trim(x)), lambda x: length(x) > 0)
                        ELSE list_transform(conditions, lambda c: c.type || ': ' || c.reason || ' \u2014 ' || c.message) END AS lines
      FROM msgs JOIN bundles USING (name))
""",
)
def b13_error_lines(spark, sf_dir):
    return C.error_lines(v6_bundles(spark, sf_dir))


@register(
    "c20_deployment_models",
    V6
    + """
, deps AS (SELECT CASE WHEN starts_with(name, 'b-') THEN 'bd-' || substr(name, 3) ELSE 'bd-' || name END AS deployment, name AS bundle
           FROM bundles WHERE c_custkey IN (SELECT o_custkey FROM orders))
SELECT d.deployment, m AS model
FROM deps d JOIN (SELECT name, unnest(models) AS m FROM bundles) b ON d.bundle = b.name
""",
)
def c20_deployment_models(spark, sf_dir):
    from evalcat.operators.deployments import deployment_models

    b = v6_bundles(spark, sf_dir)
    o = read_table(spark, sf_dir, "orders")
    deps = b.join(o, b["c_custkey"] == o["o_custkey"], "left_semi").select(
        K.deployment_name("name").alias("deployment"), F.col("name").alias("bundle")
    )
    return deployment_models(deps, b).select("deployment", "model")


@register(
    "c21_pods_of",
    V6
    + """
SELECT d.deployment, p.seq FROM (SELECT DISTINCT 'd' || CAST(c_custkey AS VARCHAR) AS deployment FROM customer) d
JOIN pods p ON starts_with(p.line, 'inf-' || d.deployment || '-')
""",
)
def c21_pods_of(spark, sf_dir):
    deps = read_table(spark, sf_dir, "customer").select(F.concat(F.lit("d"), F.col("c_custkey").cast("string")).alias("deployment"))
    pods = parse_pod_lines(v6_pods(spark, sf_dir).withColumnRenamed("deployment", "_owner"), "line")
    return C.pods_of(deps, pods).select("deployment", "seq")


@register(
    "c25_with_template",
    V6
    + """
, templates AS (SELECT DISTINCT 'bt-' || lower(c_mktsegment) AS template, c_mktsegment AS segment FROM customer WHERE c_acctbal > 0)
SELECT b.name, t.segment FROM bundles b JOIN templates t ON b.template = t.template
""",
)
def c25_with_template(spark, sf_dir):
    from evalcat.operators.deployments import with_template

    c = read_table(spark, sf_dir, "customer").where(F.col("c_acctbal") > 0)
    templates = c.select(F.concat(F.lit("bt-"), F.lower("c_mktsegment")).alias("template"), F.col("c_mktsegment").alias("segment")).distinct()
    return with_template(v6_bundles(spark, sf_dir), templates).select("name", "segment")


@register(
    "e7_h42_tail_logs",
    """
SELECT source, seq, left(regexp_replace(text, '\\s+', ' ', 'g'), 110) AS line FROM (
  SELECT 'pod-' || CAST(l_orderkey AS VARCHAR) AS source, l_linenumber AS seq,
         'step ' || CAST(l_linenumber AS VARCHAR) || chr(9) || ' qty  ' || CAST(l_quantity AS VARCHAR) || chr(10) || 'ship ' || l_returnflag AS text,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_quantity DESC, l_returnflag DESC) AS rn
  FROM lineitem) WHERE rn <= 5
""",
)
def e7_h42_tail_logs(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    logs = li.select(
        F.concat(F.lit("pod-"), F.col("l_orderkey").cast("string")).alias("source"),
        F.col("l_linenumber").alias("seq"),
        F.concat(
            F.lit("step "), F.col("l_linenumber").cast("string"), F.lit("\t qty  "), F.col("l_quantity").cast("string"),
            F.lit("\nship "), F.col("l_returnflag"),
        ).alias("text"),
        F.col("l_quantity").alias("_q"),
        F.col("l_returnflag").alias("_f"),
    )
    t = C.tail(logs.withColumn("_o", F.struct("seq", "_q", "_f")), "source", "_o", 5)
    return t.select("source", "seq", X.squash("text", 110).alias("line"))


# ------------------------------------------------------------------ vectors
@register(
    "h36_h40_vectors",
    V8
    + """
SELECT vec_id,
       len(a) = len(b2) AND coalesce(len(list_filter(list_zip(a, b2), lambda p: NOT (abs(p[1] - p[2]) <= 1e-8 + 1e-5 * abs(p[2])))) = 0, false) AS close,
       '[' || CAST(len(a) AS VARCHAR) || ']' AS size_label,
       array_to_string(list_transform(a[1:8], lambda x: printf('%.4f', x)), ', ') AS preview
FROM (SELECT *, CASE WHEN label = 9 THEN b[1:len(b) - 1] ELSE b END AS b2 FROM vectors)
""",
)
def h36_h40_vectors(spark, sf_dir):
    v = v8_vectors(spark, sf_dir)
    b2 = F.when(F.col("label") == 9, F.slice("b", 1, F.size("b") - 1)).otherwise(F.col("b"))
    pv = K.vector_preview(F.col("a"), 8)
    return v.select(
        "vec_id",
        all_close(F.col("a"), b2).alias("close"),
        pv["size_label"].alias("size_label"),
        pv["preview"].alias("preview"),
    )


# ------------------------------------------------------------------ D23 analyst workload
@register(
    "d23_workload_top_nation",
    """
SELECT n.n_name, count(*) AS n_customers FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
GROUP BY n.n_name ORDER BY n_customers DESC, n.n_name LIMIT 1
""",
)
def d23_workload_top_nation(spark, sf_dir):
    c, n = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "nation")
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"])
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("n_customers")).orderBy(F.desc("n_customers"), "n_name").limit(1)


@register("d23_workload_total_count", "SELECT count(*) AS n_lineitems FROM lineitem")
def d23_workload_total_count(spark, sf_dir):
    return read_table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("n_lineitems"))


@register(
    "d23_workload_top_brands",
    "SELECT p_brand, count(*) AS n_parts FROM part GROUP BY p_brand ORDER BY n_parts DESC, p_brand LIMIT 5",
)
def d23_workload_top_brands(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    return p.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_parts")).orderBy(F.desc("n_parts"), "p_brand").limit(5)


@register(
    "d23_workload_top_nations",
    """
SELECT c.c_name, round(sum(o.o_totalprice), 2) AS total_spent FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
GROUP BY c.c_name ORDER BY sum(o.o_totalprice) DESC, c.c_name LIMIT 5
""",
)
def d23_workload_top_nations(spark, sf_dir):
    """Top 5 customers by spend (two-table sum): aggregate orders by key
    first (partial aggregation), then join the small result to names."""
    o, c = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer")
    spend = o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("_s"))
    j = spend.join(c, spend["o_custkey"] == c["c_custkey"])
    top = j.groupBy("c_name").agg(F.sum("_s").alias("_s")).orderBy(F.desc("_s"), "c_name").limit(5)
    return top.select("c_name", F.round("_s", 2).alias("total_spent"))


@register(
    "d23_workload_distinct_nations",
    "SELECT count(DISTINCT c.c_nationkey) AS n_countries FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey",
)
def d23_workload_distinct_nations(spark, sf_dir):
    o, c = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer")
    buyers = c.join(o.select("o_custkey").distinct(), c["c_custkey"] == o["o_custkey"], "left_semi")
    return buyers.agg(F.count_distinct("c_nationkey").alias("n_countries"))


@register(
    "d23_workload_filtered_join_count",
    "SELECT count(*) AS n_large FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE p.p_type = 'LARGE'",
)
def d23_workload_filtered_join_count(spark, sf_dir):
    li, p = read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "part")
    large = p.where(F.col("p_type") == "LARGE").select("p_partkey")
    return li.join(large, li["l_partkey"] == large["p_partkey"], "left_semi").agg(F.count(F.lit(1)).alias("n_large"))

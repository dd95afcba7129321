"""Registered queries for the remaining single-purpose rules: JSON
extraction (H5), scorer defaults and lookup (B6, C7), command errors (H44),
first map entry (H52), request options (H38), run lay-down and export (A8,
A11, A12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalcat.functions import catalog as K
from evalcat.functions import scoring as S
from evalcat.functions import text as X
from evalcat.functions.text import strip_sql
from evalcat.operators import examples as EX
from evalcat.operators import inference as INF
from evalcat.operators import runs as R
from evalcat.plans.adapters import V1_SQL, v1_results
from evalcat.plans.registry import register
from evalcat.session import read_table
from evalcat.sources import files as SRC
from evalcat.streaming.jobs import scratch_path

V1 = f"WITH v1 AS ({V1_SQL})\n"


def _texts(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    t = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("resp: "), "props", F.lit(" done")))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit("  "), "props", F.lit(" trailing")))
        .otherwise(F.concat(F.lit("no object here "), F.col("event_id").cast("string")))
    )
    return e.select("event_id", t.alias("t"))


@register(
    "h5_extract_json",
    f"""
WITH x AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'resp: ' || props || ' done'
                                WHEN 1 THEN '  ' || props || ' trailing'
                                ELSE 'no object here ' || CAST(event_id AS VARCHAR) END AS t FROM events)
SELECT event_id, CASE WHEN starts_with({strip_sql('t')}, '{{') THEN {strip_sql('t')}
                      ELSE nullif(regexp_extract({strip_sql('t')}, '\\{{[^{{}}]*\\}}', 0), '') END AS candidate
FROM x
""",
)
def h5_extract_json(spark, sf_dir):
    """H5: whole stripped text when it starts with ``{``, else the first
    balanced object (string-aware), else null."""
    return _texts(spark, sf_dir).select("event_id", S.extract_json(F.col("t")).alias("candidate"))


#: max_score and temperature as they stand in scorer files, and what they come to.
_TOPS = [("0", 5), ("7.9", 7), ('"4"', 5), ("3", 3), ("null", 5), ("-2", 5), ("true", 1), ("[1]", 5)]
_HEATS = [("0.5", 0.5), ('"0.5"', 0.0), ("null", 0.0), ("1", 1.0), ("true", 1.0)]


@register(
    "b6_normalize_scorers",
    f"""
SELECT p_partkey,
       CASE p_partkey % 3 WHEN 0 THEN p_name ELSE 'file-' || CAST(p_partkey AS VARCHAR) END AS name,
       CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand END AS provider_name,
       {[top for _, top in _TOPS]}[p_partkey % {len(_TOPS)} + 1] AS max_score,
       CAST({[heat for _, heat in _HEATS]}[p_partkey % {len(_HEATS)} + 1] AS DOUBLE) AS temperature
FROM part
""",
)
def b6_normalize_scorers(spark, sf_dir):
    """A scorer file per part: numbers, texts of digits, booleans, nulls
    and lists as max_score and temperature; empty and missing names."""
    p = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    pick = lambda texts: F.get(F.array(*[F.lit(t) for t, _ in texts]), (k % len(texts)).cast("int"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    name = F.when(k % 3 == 0, F.concat(F.lit('"name": '), quoted(F.col("p_name")), F.lit(", "))).when(k % 3 == 1, F.lit('"name": "", ')).otherwise(F.lit(""))
    provider = F.when(k % 4 == 0, F.lit("null")).otherwise(quoted(F.col("p_brand")))
    text = F.concat(F.lit("{"), name, F.lit('"provider_name": '), provider, F.lit(', "max_score": '), pick(_TOPS), F.lit(', "temperature": '), pick(_HEATS), F.lit("}"))
    s = p.select("p_partkey", EX.read_scorer(text, F.concat(F.lit("file-"), k.cast("string"))).alias("s"))
    return s.select("p_partkey", "s.name", "s.provider_name", "s.max_score", "s.temperature")


@register(
    "c7_with_scorer",
    V1
    + """
, scorers AS (SELECT 'judge-' || CAST(r_regionkey AS VARCHAR) AS name FROM region)
, t AS (SELECT result_id, model,
               CASE user_id % 4 WHEN 0 THEN 'judge-' || CAST(user_id % 7 AS VARCHAR)
                                WHEN 2 THEN 'judge-' || CAST(user_id % 7 AS VARCHAR) END AS scorer_name,
               CASE WHEN user_id % 4 IN (2, 3) THEN 'inline-' || model END AS inline_name
        FROM v1)
SELECT t.result_id,
       coalesce(t.inline_name, s.name) AS scorer,
       CASE WHEN coalesce(t.inline_name, s.name) IS NULL AND t.scorer_name IS NULL
              THEN 'Experiment uses an LLM judge but neither "scorer.definition" nor "scorer.scorer_name" is set'
            WHEN coalesce(t.inline_name, s.name) IS NULL
              THEN 'Scorer "' || t.scorer_name || '" not found in data/scorers/' END AS scorer_error
FROM t LEFT JOIN scorers s ON t.scorer_name = s.name
""",
)
def c7_with_scorer(spark, sf_dir):
    """Inline definition first, else the named scorer, else an error."""
    r = v1_results(spark, sf_dir)
    k = F.col("user_id") % 4
    tasks = r.select(
        "result_id",
        F.when(k.isin(0, 2), F.concat(F.lit("judge-"), (F.col("user_id") % 7).cast("string"))).alias("scorer_name"),
        F.when(k.isin(2, 3), F.struct(F.concat(F.lit("inline-"), F.col("model")).alias("name"))).alias("scorer_def"),
    )
    scorers = read_table(spark, sf_dir, "region").select(F.concat(F.lit("judge-"), F.col("r_regionkey").cast("string")).alias("name"))
    out = R.with_scorer(tasks, scorers)
    return out.select("result_id", F.col("scorer.name").alias("scorer"), "scorer_error")


@register(
    "h44_command_error",
    """
WITH x AS (
  SELECT event_id,
         CASE event_id % 4
           WHEN 0 THEN 'Error from server (Forbidden): err="denied for ' || CAST(user_id AS VARCHAR) || '" extra'
           WHEN 1 THEN 'Unable to connect: dial tcp 10.0.0.' || CAST(user_id % 255 AS VARCHAR) || ':443: connect: connection refused'
                       || chr(10) || 'retry'
           WHEN 2 THEN '  first line ' || CAST(event_id AS VARCHAR) || chr(10) || 'second'
           ELSE 'I/O Timeout waiting ' || event_type END AS t
  FROM events)
SELECT event_id,
       coalesce(nullif(regexp_extract(__S__, 'err="([^"]+)"', 1), ''),
                nullif(regexp_extract(__S__, '(?i)(dial tcp[^\\n]+|connection refused[^\\n]+|i/o timeout[^\\n]*)', 1), ''),
                split_part(__S__, chr(10), 1)) AS detail
FROM x
""".replace("__S__", strip_sql("t")),
)
def h44_command_error(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    k = F.col("event_id") % 4
    t = (
        F.when(k == 0, F.concat(F.lit('Error from server (Forbidden): err="denied for '), F.col("user_id").cast("string"), F.lit('" extra')))
        .when(k == 1, F.concat(F.lit("Unable to connect: dial tcp 10.0.0."), (F.col("user_id") % 255).cast("string"),
                               F.lit(":443: connect: connection refused\nretry")))
        .when(k == 2, F.concat(F.lit("  first line "), F.col("event_id").cast("string"), F.lit("\nsecond")))
        .otherwise(F.concat(F.lit("I/O Timeout waiting "), F.col("event_type")))
    )
    return e.select("event_id", X.command_error(t).alias("detail"))


@register(
    "h52_first_entry",
    """
SELECT p_brand, list_sort(list_distinct(list(p_name)))[1] AS first_key
FROM part WHERE p_type <> 'ECONOMY' GROUP BY p_brand
""",
)
def h52_first_entry(spark, sf_dir):
    """The first entry (key order) of a per-resource map; resources
    with an empty map (every part ECONOMY) are skipped."""
    p = read_table(spark, sf_dir, "part").where(F.col("p_type") != "ECONOMY")
    keys = p.groupBy("p_brand").agg(F.array_sort(F.collect_set("p_name")).alias("k"))
    m = keys.select("p_brand", F.map_from_arrays("k", F.transform("k", lambda x: F.length(x))).alias("m"))
    return m.where(F.size("m") > 0).select("p_brand", K.first_entry_key("m").alias("first_key"))


@register(
    "h38_request_kwargs",
    """
WITH x AS (SELECT p_partkey, CAST(p_size AS DOUBLE) / 50 AS temperature,
                  CASE WHEN p_size % 3 = 0 THEN p_partkey END AS seed,
                  CASE p_size % 4 WHEN 0 THEN '0.9' END AS top_p,
                  CASE p_size % 4 WHEN 1 THEN '1' END AS temp_override
           FROM part)
SELECT p_partkey,
       coalesce(temp_override, CAST(temperature AS VARCHAR)) AS temperature,
       CAST(seed AS VARCHAR) AS seed, top_p,
       1 + CASE WHEN seed IS NULL THEN 0 ELSE 1 END + CASE WHEN top_p IS NULL THEN 0 ELSE 1 END AS n_options
FROM x
""",
)
def h38_request_kwargs(spark, sf_dir):
    """Temperature, integer seed, then extra options that override."""
    p = read_table(spark, sf_dir, "part")
    extras = (
        F.when(F.col("p_size") % 4 == 0, F.lit('{"top_p": "0.9"}'))
        .when(F.col("p_size") % 4 == 1, F.lit('{"temperature": "1"}'))
    )
    m = INF.request_kwargs_map(
        F.col("p_size").cast("double") / 50,
        F.when(F.col("p_size") % 3 == 0, F.col("p_partkey")),
        extras,
    )
    return p.select(
        "p_partkey",
        m["temperature"].alias("temperature"),
        m["seed"].alias("seed"),
        m["top_p"].alias("top_p"),
        F.size(m).alias("n_options"),
    )


@register(
    "a11_a8_start_and_read_runs",
    V1
    + """
SELECT experiment_id, run_id, 'running' AS status, count(*) AS total, CAST(0 AS BIGINT) AS completed,
       CAST(0 AS BIGINT) AS errors, 0 AS n_resumed, '{"id":"' || experiment_id || '"}' AS definition, CAST(0 AS BIGINT) AS n_results
FROM v1 GROUP BY experiment_id, run_id
""",
)
def a11_a8_start_and_read_runs(spark, sf_dir):
    """A11 lays down one running run per (experiment, run) with its task
    total, a snapshot of its experiment and an empty result file; A8 and A5
    read them back."""
    r = v1_results(spark, sf_dir)
    runs = r.groupBy("experiment_id", "run_id").agg(
        F.count(F.lit(1)).alias("total"), F.date_format(F.min("finished_at"), S.ISO_FORMAT).alias("started_at")
    )
    root = scratch_path(spark, "runs")
    snapshots, results = scratch_path(spark, "snapshots"), scratch_path(spark, "results")
    experiments = runs.select("experiment_id").distinct().withColumn("definition", F.to_json(F.struct(F.col("experiment_id").alias("id"))))
    SRC.start_runs(runs, root, experiments, snapshots, results)
    keys = ["experiment_id", "run_id"]
    kept = spark.read.text(snapshots).withColumnRenamed("value", "definition")
    rows = SRC.read_results(spark, results).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    back = SRC.read_run_table(spark, root).join(kept, keys).join(rows, keys, "left")
    return back.select(
        *keys, "status", "total", "completed", "errors", F.size("resumed_at").alias("n_resumed"), "definition", F.coalesce("n", F.lit(0)).alias("n_results")
    )


@register(
    "a12_export_latest_run",
    V1
    + """
, latest AS (SELECT experiment_id, arg_max(run_id, (started, run_id)) AS run_id
             FROM (SELECT experiment_id, run_id, min(finished_at) AS started FROM v1 GROUP BY ALL) GROUP BY experiment_id)
SELECT result_id, status, provider, model, example_id, output, score, weight, score_reason, input_tokens, output_tokens,
       latency_ms, ttft_ms, tps, num_llm_calls
FROM v1 WHERE experiment_id = 'exp0' AND run_id = (SELECT run_id FROM latest WHERE experiment_id = 'exp0')
""",
)
def a12_export_latest_run(spark, sf_dir):
    """Results stored per (experiment, run) partition; the latest run
    of an experiment is exported through the A6 sink and read back (A5)."""
    r = v1_results(spark, sf_dir)
    store = scratch_path(spark, "results_store")
    SRC.write_results(r.select(*SRC.RESULT_COLUMNS, "experiment_id", "run_id"), store, ["experiment_id", "run_id"])
    results = SRC.read_results(spark, store)  # partition columns come back from the paths
    runs = r.groupBy("experiment_id", "run_id").agg(F.min("finished_at").alias("started_at"))
    out = scratch_path(spark, "export")
    SRC.export_results(results, runs, "exp0", None, out)
    return SRC.read_results(spark, out)


@register(
    "a9_read_experiments",
    "SELECT n_name AS name, CAST(n_regionkey AS BIGINT) AS concurrency FROM nation WHERE n_nationkey % 7 <> 0",
)
def a9_read_experiments(spark, sf_dir):
    """A folder of experiment JSON documents, one per file (every
    seventh one is malformed and must be skipped); ids come from the file
    stems, rows are sorted by id."""
    n = read_table(spark, sf_dir, "nation")
    doc = F.when(
        F.col("n_nationkey") % 7 == 0, F.concat(F.lit('{"name": "'), F.col("n_name"), F.lit('", broken'))
    ).otherwise(F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("concurrency"))))
    folder = scratch_path(spark, "experiments")
    n.select(F.col("n_nationkey").alias("k"), doc.alias("value")).repartition("k").write.partitionBy("k").text(folder)
    schema = "id string, name string, concurrency long"
    from pyspark.sql.types import _parse_datatype_string

    # Spark's text writer names files *.txt, so the document filter is *.txt here
    ex = SRC.read_json_dir(spark, folder, _parse_datatype_string(schema), key="id", glob="*.txt")
    return ex.select("name", "concurrency")

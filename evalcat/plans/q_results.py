"""Registered queries over V1 (evaluation results derived from ``events``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalcat.functions import scoring as S
from evalcat.functions import text as X
from evalcat.operators import runs, summary
from evalcat.operators.ranking import with_row_index
from evalcat.plans.adapters import V1_SQL, v1_results
from evalcat.plans.registry import register, round_doubles
from evalcat.session import read_table

V1 = f"WITH v1 AS ({V1_SQL})\n"


@register(
    "d3_d4_summarize_models",
    V1
    + """
SELECT provider, model,
       count(*) AS n,
       count(*) FILTER (WHERE starts_with(coalesce(output, ''), 'ERROR')) AS errors,
       count(*) FILTER (WHERE status = 'error') AS status_errors,
       round(sum(coalesce(score, 0)), 6) AS score_sum,
       CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS sum_input_tokens,
       CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS sum_output_tokens,
       round(CASE WHEN sum(coalesce(weight, 1)) <> 0
                  THEN 100 * sum(coalesce(score, 0)) / sum(coalesce(weight, 1)) END, 6) AS score_pct,
       round(quantile_cont(latency_ms, 0.5), 6) AS median_latency_ms,
       round(quantile_cont(ttft_ms, 0.5), 6) AS median_ttft_ms,
       round(quantile_cont(tps, 0.5), 6) AS median_tps,
       round(quantile_cont(CAST(num_llm_calls AS DOUBLE), 0.5), 6) AS median_calls
FROM v1 GROUP BY provider, model
""",
)
def d3_d4_summarize_models(spark, sf_dir):
    return round_doubles(summary.summarize_models(v1_results(spark, sf_dir)))


@register(
    "d1_recount_runs",
    V1
    + """
SELECT experiment_id, run_id, count(*) AS completed,
       count(*) FILTER (WHERE status = 'error') AS errors
FROM v1 GROUP BY experiment_id, run_id
""",
)
def d1_recount_runs(spark, sf_dir):
    return summary.recount_runs(v1_results(spark, sf_dir), ["experiment_id", "run_id"])


@register(
    "d2_avg_score_by_model",
    V1
    + """
SELECT provider, model, round(avg(coalesce(score, 0)), 6) AS mean_score, count(*) AS n
FROM v1 GROUP BY provider, model
""",
)
def d2_avg_score_by_model(spark, sf_dir):
    return round_doubles(summary.avg_score_by_model(v1_results(spark, sf_dir)))


@register(
    "b8_error_predicates",
    V1
    + """
SELECT provider, model,
       count(*) FILTER (WHERE status = 'error') AS status_errors,
       count(*) FILTER (WHERE starts_with(output, 'ERROR')) AS text_errors,
       count(*) FILTER (WHERE status = 'error' AND NOT starts_with(output, 'ERROR')) AS judge_errors
FROM v1 GROUP BY provider, model
""",
)
def b8_error_predicates(spark, sf_dir):
    r = v1_results(spark, sf_dir)
    by_status = F.col("status") == "error"
    by_text = F.col("output").startswith("ERROR")
    return r.groupBy("provider", "model").agg(
        F.count(F.when(by_status, 1)).alias("status_errors"),
        F.count(F.when(by_text, 1)).alias("text_errors"),
        F.count(F.when(by_status & ~by_text, 1)).alias("judge_errors"),
    )


@register(
    "b10_filter_values",
    V1 + "SELECT result_id, model, status FROM v1 WHERE model IN ('m1', 'm3') AND status IN ('completed')",
)
def b10_filter_values(spark, sf_dir):
    r = v1_results(spark, sf_dir)
    return r.where(F.col("model").isin("m1", "m3") & F.col("status").isin("completed")).select(
        "result_id", "model", "status"
    )


@register(
    "d14_distinct_values",
    V1
    + """
SELECT 'provider' AS column_name, provider AS value FROM v1 GROUP BY provider
UNION ALL SELECT 'model', model FROM v1 GROUP BY model
UNION ALL SELECT 'status', status FROM v1 GROUP BY status
""",
)
def d14_distinct_values(spark, sf_dir):
    r = v1_results(spark, sf_dir)
    parts = [r.select(F.lit(c).alias("column_name"), F.col(c).alias("value")).distinct() for c in ("provider", "model", "status")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register(
    "d15_check_run",
    V1
    + """
SELECT count(*) AS total_rows,
       count(*) FILTER (WHERE starts_with(output, 'ERROR')) AS total_errors,
       round(sum(score), 6) AS total_score,
       count(DISTINCT provider || '/' || model) AS n_models,
       count(DISTINCT example_id) AS n_examples,
       count(*) FILTER (WHERE starts_with(output, 'ERROR')) > 0 AS fail_errors,
       sum(score) <= 0 AS fail_score,
       count(*) <> count(DISTINCT provider || '/' || model) * count(DISTINCT example_id) AS fail_row_count
FROM v1
""",
)
def d15_check_run(spark, sf_dir):
    """Run-level totals and failure rules in ONE global aggregate (the
    per-model table's sums are the table's sums; distinct counts are
    shuffled by key, never gathered)."""
    r = v1_results(spark, sf_dir)
    totals = r.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count(F.when(F.col("output").startswith("ERROR"), 1)).alias("total_errors"),
        F.round(F.sum("score"), 6).alias("total_score"),
        F.count_distinct(F.concat("provider", F.lit("/"), "model")).alias("n_models"),
        F.count_distinct("example_id").alias("n_examples"),
    )
    return totals.select(
        "total_rows",
        "total_errors",
        "total_score",
        "n_models",
        "n_examples",
        (F.col("total_errors") > 0).alias("fail_errors"),
        (F.col("total_score") <= 0).alias("fail_score"),
        (F.col("total_rows") != F.col("n_models") * F.col("n_examples")).alias("fail_row_count"),
    )


@register(
    "d21_logical_scores",
    V1
    + """
SELECT user_id AS logical_id, round(sum(score), 6) AS score, round(sum(weight), 6) AS weight, count(*) AS parts
FROM v1 GROUP BY user_id
""",
)
def d21_logical_scores(spark, sf_dir):
    r = v1_results(spark, sf_dir)
    return round_doubles(
        r.groupBy(F.col("user_id").alias("logical_id")).agg(
            F.sum("score").alias("score"), F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("parts")
        )
    )


@register(
    "d22_duplicates",
    V1
    + """
SELECT provider, model, user_id, count(*) AS n FROM v1
GROUP BY provider, model, user_id HAVING count(*) > 1
""",
)
def d22_duplicates(spark, sf_dir):
    r = v1_results(spark, sf_dir)
    return (
        r.groupBy("provider", "model", "user_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
    )


@register(
    "e6_upsert_latest",
    V1
    + """
SELECT provider, model, user_id, arg_max(result_id, example_id) AS result_id,
       arg_max(score, example_id) AS score, arg_max(status, example_id) AS status
FROM v1 GROUP BY provider, model, user_id
""",
)
def e6_upsert_latest(spark, sf_dir):
    r = v1_results(spark, sf_dir).select(
        "provider", "model", "user_id", "result_id", "score", "status", F.col("example_id").alias("write_seq")
    )
    return runs.upsert_latest(r, ["provider", "model", "user_id"], "write_seq").drop("write_seq")


# ------------------------------------------------------------------ resume
_GRID_SQL = """
, models AS (
  SELECT provider, model, row_number() OVER (ORDER BY provider, model) - 1 AS model_index
  FROM (SELECT DISTINCT 'p' || CAST(n_nationkey % 3 AS VARCHAR) AS provider, 'm' || CAST(n_nationkey % 4 AS VARCHAR) AS model FROM nation))
, examples AS (
  SELECT example_id, row_number() OVER (ORDER BY example_id) - 1 AS ordinal FROM v1)
, grid AS (
  SELECT m.model_index * (SELECT count(*) FROM examples) + e.ordinal + 1 AS result_id,
         m.model_index, m.provider, m.model, e.example_id
  FROM models m CROSS JOIN examples e)
"""


def _grid(spark, sf_dir):
    """Prior rows, the models of the experiment (of which some prior rows'
    model is none) and the examples."""
    r = v1_results(spark, sf_dir)
    nation = read_table(spark, sf_dir, "nation")
    names = nation.select(
        F.concat(F.lit("p"), (F.col("n_nationkey") % 3).cast("string")).alias("provider"), F.concat(F.lit("m"), (F.col("n_nationkey") % 4).cast("string")).alias("model")
    ).distinct()
    models = with_row_index(names, ["provider", "model"], "model_index")
    return r, models, with_row_index(r.select("example_id"), ["example_id"], "ordinal")


@register("c1_task_grid_v1", V1 + _GRID_SQL + "SELECT result_id, model_index, provider, model, example_id FROM grid")
def c1_task_grid_v1(spark, sf_dir):
    _, models, examples = _grid(spark, sf_dir)
    return runs.task_grid(examples, models).select("result_id", "model_index", "provider", "model", "example_id")


@register(
    "c2_carry_completed",
    V1
    + _GRID_SQL
    + """
SELECT g.result_id, g.provider, g.model, g.example_id, p.score, p.output, p.result_id AS prior_result_id
FROM grid g JOIN (SELECT * FROM v1 WHERE status = 'completed') p
  ON g.provider = p.provider AND g.model = p.model AND g.example_id = p.example_id
""",
)
def c2_carry_completed(spark, sf_dir):
    r, models, examples = _grid(spark, sf_dir)
    prior = r.withColumn("prior_result_id", F.col("result_id"))
    return runs.carry_completed(prior, models, examples).select(
        "result_id", "provider", "model", "example_id", "score", "output", "prior_result_id"
    )


@register(
    "c3_pending_tasks",
    V1
    + _GRID_SQL
    + """
SELECT g.result_id, g.provider, g.model, g.example_id FROM grid g
WHERE NOT EXISTS (SELECT 1 FROM v1 p WHERE p.status = 'completed' AND p.provider = g.provider
                  AND p.model = g.model AND p.example_id = g.example_id)
""",
)
def c3_pending_tasks(spark, sf_dir):
    r, models, examples = _grid(spark, sf_dir)
    return runs.pending_tasks(runs.carry_completed(r, models, examples), models, examples).select("result_id", "provider", "model", "example_id")


@register(
    "c4_prune_prior",
    V1
    + _GRID_SQL
    + """
SELECT p.result_id, p.provider, p.model, p.example_id, p.status FROM v1 p
WHERE EXISTS (SELECT 1 FROM grid g WHERE p.provider = g.provider AND p.model = g.model
              AND p.example_id = g.example_id)
""",
)
def c4_prune_prior(spark, sf_dir):
    r, models, examples = _grid(spark, sf_dir)
    return runs.prune_prior(r, models, examples).select("result_id", "provider", "model", "example_id", "status")


@register(
    "g1_i4_resume_merge",
    V1
    + _GRID_SQL
    + """
, carried AS (
  SELECT g.result_id, g.provider, g.model, g.example_id, p.output, p.score, 'carried' AS origin
  FROM grid g JOIN (SELECT * FROM v1 WHERE status = 'completed') p
    ON g.provider = p.provider AND g.model = p.model AND g.example_id = p.example_id)
, fresh AS (
  SELECT g.result_id, g.provider, g.model, g.example_id,
         'regenerated ' || g.model || ' #' || CAST(g.example_id AS VARCHAR) AS output,
         CAST(0 AS DOUBLE) AS score, 'new' AS origin
  FROM grid g WHERE NOT EXISTS (SELECT 1 FROM v1 p WHERE p.status = 'completed'
    AND p.provider = g.provider AND p.model = g.model AND p.example_id = g.example_id))
SELECT * FROM carried UNION ALL SELECT * FROM fresh
""",
)
def g1_i4_resume_merge(spark, sf_dir):
    r, models, examples = _grid(spark, sf_dir)
    kept = runs.carry_completed(r, models, examples)
    carried = kept.select(
        "result_id", "provider", "model", "example_id", "output", "score", F.lit("carried").alias("origin")
    )
    fresh = runs.pending_tasks(kept, models, examples).select(
        "result_id",
        "provider",
        "model",
        "example_id",
        F.concat(F.lit("regenerated "), "model", F.lit(" #"), F.col("example_id").cast("string")).alias("output"),
        F.lit(0.0).alias("score"),
        F.lit("new").alias("origin"),
    )
    return runs.merge_rows(carried, fresh)


# ------------------------------------------------------------------ providers
_PROVIDERS_SQL = """
, providers AS (SELECT 'p' || CAST(r_regionkey + 1 AS VARCHAR) AS name,
                       'https://api.example/' || lower(r_name) || '/v1/' AS api_url FROM region)
"""


def _providers(spark, sf_dir):
    reg = read_table(spark, sf_dir, "region")
    return reg.select(
        F.concat(F.lit("p"), (F.col("r_regionkey") + 1).cast("string")).alias("name"),
        F.concat(F.lit("https://api.example/"), F.lower("r_name"), F.lit("/v1/")).alias("api_url"),
    )


@register(
    "c5_with_provider",
    V1
    + _PROVIDERS_SQL
    + """
SELECT t.result_id, t.provider, p.api_url,
       CASE WHEN p.name IS NULL THEN 'Provider "' || t.provider || '" not found in providers.json' END AS provider_error
FROM v1 t LEFT JOIN providers p ON t.provider = p.name
""",
)
def c5_with_provider(spark, sf_dir):
    t = v1_results(spark, sf_dir).select("result_id", "provider")
    return runs.with_provider(t, _providers(spark, sf_dir))


@register(
    "c6_missing_providers",
    V1
    + _PROVIDERS_SQL
    + """
SELECT DISTINCT provider AS name FROM v1 WHERE provider NOT IN (SELECT name FROM providers)
""",
)
def c6_missing_providers(spark, sf_dir):
    models = v1_results(spark, sf_dir).select("provider")
    return runs.missing_providers(models, _providers(spark, sf_dir))


@register(
    "g5_needed_providers",
    V1 + "SELECT DISTINCT provider AS name FROM v1",
)
def g5_needed_providers(spark, sf_dir):
    return runs.needed_providers(v1_results(spark, sf_dir).select("provider"))


@register(
    "h14_normalize_url",
    """
SELECT page_id,
       CASE WHEN ends_with(regexp_replace(url, '/+$', ''), '/chat/completions') THEN regexp_replace(url, '/+$', '')
            ELSE regexp_replace(url, '/+$', '') || '/chat/completions' END AS endpoint,
       CASE WHEN ends_with(regexp_replace(url, '/v1/chat/completions/?$', ''), '/')
            THEN regexp_replace(url, '/v1/chat/completions/?$', '')
            ELSE regexp_replace(url, '/v1/chat/completions/?$', '') || '/' END AS api_base
FROM pages
""",
)
def h14_normalize_url(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages")
    return p.select("page_id", X.normalize_url("url").alias("endpoint"), X.api_base_url("url").alias("api_base"))


# ------------------------------------------------------------------ scalar formatting over V1
@register(
    "h9_h11_h12_number_text",
    V1
    + """
SELECT result_id,
       round_even((score * weight / 3) * 100, 0) / 100 AS rounded,
       CASE WHEN latency_ms IS NULL OR NOT isfinite(latency_ms) THEN ''
            WHEN latency_ms = floor(latency_ms) THEN CAST(CAST(latency_ms AS BIGINT) AS VARCHAR)
            ELSE CAST(latency_ms AS VARCHAR) END AS latency_text,
       CASE WHEN tps IS NULL THEN '' WHEN tps = floor(tps) THEN CAST(CAST(tps AS BIGINT) AS VARCHAR)
            ELSE CAST(tps AS VARCHAR) END AS tps_text,
       TRY_CAST(CAST(output_tokens AS VARCHAR) AS DOUBLE) AS tokens_num
FROM v1
""",
)
def h9_h11_h12_number_text(spark, sf_dir):
    r = v1_results(spark, sf_dir)
    return r.select(
        "result_id",
        S.round_score(F.col("score") * F.col("weight") / 3).alias("rounded"),
        S.num_text("latency_ms").alias("latency_text"),
        S.num_text("tps").alias("tps_text"),
        S.num_or_null(F.col("output_tokens").cast("string")).alias("tokens_num"),
    )


@register(
    "h17_h41_h46_progress_labels",
    V1
    + """
SELECT result_id,
       provider || '/' || model || ' #' || CAST(example_id AS VARCHAR) AS label,
       round(CASE WHEN num_llm_calls - 1 = 0 THEN 100 ELSE CAST(result_id % 50 AS DOUBLE) / (num_llm_calls - 1) * 100 END, 6) AS pct,
       NULLIF(output_tokens % 5, 0) AS nonzero_tokens
FROM v1
""",
)
def h17_h41_h46_progress_labels(spark, sf_dir):
    r = v1_results(spark, sf_dir)
    return round_doubles(
        r.select(
            "result_id",
            S.task_label("provider", "model", "example_id").alias("label"),
            S.percent_done(F.col("result_id") % 50, F.col("num_llm_calls") - 1).alias("pct"),
            S.zero_to_null(F.col("output_tokens") % 5).alias("nonzero_tokens"),
        )
    )


@register(
    "h42_squash_outputs",
    V1 + "SELECT result_id, left(regexp_replace(output, '\\s+', ' ', 'g'), 140) AS preview FROM v1",
)
def h42_squash_outputs(spark, sf_dir):
    r = v1_results(spark, sf_dir)
    return r.select("result_id", X.squash("output", 140).alias("preview"))


@register(
    "f7_order_summary",
    V1
    + """
SELECT provider || '/' || model AS grp, count(*) AS n, round(sum(score), 6) AS score
FROM v1 GROUP BY provider, model ORDER BY grp
""",
)
def f7_order_summary(spark, sf_dir):
    r = v1_results(spark, sf_dir)
    return round_doubles(
        r.groupBy(F.concat("provider", F.lit("/"), "model").alias("grp"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"))
        .orderBy("grp")
    )


@register("f2_order_results", V1 + "SELECT result_id, example_id, score FROM v1 ORDER BY result_id")
def f2_order_results(spark, sf_dir):
    return runs.order_results(v1_results(spark, sf_dir).select("result_id", "example_id", "score"))


@register(
    "f5_sort_by_latency",
    V1 + "SELECT result_id, ttft_ms FROM v1 ORDER BY ttft_ms DESC NULLS LAST",
)
def f5_sort_by_latency(spark, sf_dir):
    return runs.sort_by(v1_results(spark, sf_dir).select("result_id", "ttft_ms"), "ttft_ms", descending=True)

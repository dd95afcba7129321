"""Registered queries: response-chunk folding, tool-call helpers and the
model-call surface with deterministic stand-in callables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalcat.functions import scoring as S
from evalcat.operators import chunks as CH
from evalcat.operators import inference as INF
from evalcat.plans.adapters import V1_SQL, V2_SQL, v1_results, v2_examples
from evalcat.plans.q_examples import _score_sql
from evalcat.plans.registry import register
from evalcat.session import read_table

# ---------------------------------------------------------------- chunks from conversations
_CHUNKS_SQL = """
WITH chunks AS (
  SELECT conv_id AS result_id, 1 AS call_no, turn AS seq, CAST(turn AS DOUBLE) * 0.25 + 0.1 AS ts,
         CASE WHEN role = 'system' THEN '' ELSE text END AS content,
         CASE WHEN turn % 3 = 2 THEN '{"prompt_tokens": ' || CAST(length(text) AS VARCHAR) || ', "completion_tokens": '
                                     || CAST(turn AS VARCHAR) || '}' END AS usage,
         CASE WHEN turn % 3 = 0 THEN NULL ELSE turn % 2 END AS tool_index,
         CASE WHEN turn <= 1 THEN 'call_' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) ELSE '' END AS tool_id,
         CASE WHEN turn <= 1 THEN 'run_sql' END AS tool_name,
         CASE WHEN role = 'assistant' THEN text END AS tool_args
  FROM conversations)
"""


def _chunks(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    t = F.col("turn")
    return c.select(
        F.col("conv_id").alias("result_id"),
        F.lit(1).alias("call_no"),
        t.alias("seq"),
        (t.cast("double") * 0.25 + 0.1).alias("ts"),
        F.when(F.col("role") == "system", F.lit("")).otherwise(F.col("text")).alias("content"),
        F.when(
            t % 3 == 2,
            F.concat(F.lit('{"prompt_tokens": '), F.length("text").cast("string"), F.lit(', "completion_tokens": '),
                     t.cast("string"), F.lit("}")),
        ).alias("usage"),
        F.when(t % 3 == 0, F.lit(None).cast("long")).otherwise(t % 2).alias("tool_index"),
        F.when(t <= 1, F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), t.cast("string"))).otherwise(F.lit("")).alias("tool_id"),
        F.when(t <= 1, F.lit("run_sql")).alias("tool_name"),
        F.when(F.col("role") == "assistant", F.col("text")).alias("tool_args"),
    )


@register(
    "d19_fold_chunks",
    _CHUNKS_SQL
    + """
SELECT result_id, call_no, string_agg(coalesce(content, ''), '' ORDER BY seq) AS text,
       arg_max(usage, seq) AS usage,
       min(ts) FILTER (WHERE coalesce(content, '') <> '' OR tool_args IS NOT NULL OR coalesce(tool_id, '') <> '') AS first_token_ts,
       max(ts) AS last_ts
FROM chunks GROUP BY result_id, call_no
""",
)
def d19_fold_chunks(spark, sf_dir):
    return CH.fold_chunks(_chunks(spark, sf_dir))


@register(
    "d20_fold_tool_calls",
    _CHUNKS_SQL
    + """
SELECT result_id, call_no, coalesce(tool_index, 0) AS tool_index,
       coalesce(arg_max(tool_id, CASE WHEN coalesce(tool_id, '') <> '' THEN seq END), '') AS id,
       coalesce(arg_max(tool_name, CASE WHEN coalesce(tool_name, '') <> '' THEN seq END), '') AS name,
       string_agg(coalesce(tool_args, ''), '' ORDER BY seq) AS arguments
FROM chunks WHERE tool_args IS NOT NULL OR coalesce(tool_id, '') <> ''
GROUP BY result_id, call_no, coalesce(tool_index, 0)
""",
)
def d20_fold_tool_calls(spark, sf_dir):
    return CH.fold_tool_calls(_chunks(spark, sf_dir))


@register(
    "f6_cap_rows",
    "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50",
)
def f6_cap_rows(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return CH.cap_rows(d, [F.desc("n_chars"), F.asc("doc_id")], 50)


@register(
    "f9_list_model_ids",
    "SELECT id FROM (SELECT CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 11 = 0 THEN '' ELSE p_name END AS id FROM part) "
    "WHERE id IS NOT NULL AND id <> '' ORDER BY id",
)
def f9_list_model_ids(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    ids = p.select(
        F.when(F.col("p_size") % 7 == 0, F.lit(None).cast("string"))
        .when(F.col("p_size") % 11 == 0, F.lit(""))
        .otherwise(F.col("p_name"))
        .alias("id")
    )
    return CH.list_model_ids(ids)


_BODY_SQL = """
WITH b AS (
  SELECT event_id,
         CASE event_type
           WHEN 'error' THEN '{"error": {"message": "quota ' || CAST(user_id AS VARCHAR) || '"}}'
           WHEN 'click' THEN '{"error": "bad key ' || CAST(user_id AS VARCHAR) || '"}'
           WHEN 'view' THEN '{"message": "moved ' || CAST(user_id AS VARCHAR) || '"}'
           WHEN 'purchase' THEN '{"choices": [{"message": {"content": "bought ' || CAST(user_id AS VARCHAR) || '"}}]}'
           ELSE 'plain text ' || CAST(event_id AS VARCHAR) END AS body
  FROM events)
"""


def _bodies(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    u = F.col("user_id").cast("string")
    body = (
        F.when(F.col("event_type") == "error", F.concat(F.lit('{"error": {"message": "quota '), u, F.lit('"}}')))
        .when(F.col("event_type") == "click", F.concat(F.lit('{"error": "bad key '), u, F.lit('"}')))
        .when(F.col("event_type") == "view", F.concat(F.lit('{"message": "moved '), u, F.lit('"}')))
        .when(F.col("event_type") == "purchase", F.concat(F.lit('{"choices": [{"message": {"content": "bought '), u, F.lit('"}}]}')))
        .otherwise(F.concat(F.lit("plain text "), F.col("event_id").cast("string")))
    )
    return e.select("event_id", body.alias("body"))


@register(
    "h45_h50_api_bodies",
    _BODY_SQL
    + """
, j AS (SELECT event_id, body, json_valid(body) AS ok FROM b)
SELECT event_id,
       coalesce(CASE WHEN ok THEN json_extract_string(body, '$.error.message') END,
                CASE WHEN ok AND json_type(body, '$.error') = 'VARCHAR' THEN json_extract_string(body, '$.error') END,
                CASE WHEN ok THEN json_extract_string(body, '$.message') END, body) AS api_error,
       CASE WHEN (CASE WHEN ok THEN json_extract_string(body, '$.error.message') END) IS NULL
            THEN coalesce(CASE WHEN ok THEN json_extract_string(body, '$.choices[0].message.content') END,
                          CASE WHEN ok THEN json_extract_string(body, '$.choices[0].text') END, '') END AS text,
       CASE WHEN ok THEN json_extract_string(body, '$.error.message') END AS error
FROM j
""",
)
def h45_h50_api_bodies(spark, sf_dir):
    b = _bodies(spark, sf_dir)
    r = CH.response_text(F.col("body"))
    return b.select("event_id", CH.api_error(F.col("body")).alias("api_error"), r["text"].alias("text"), r["error"].alias("error"))


@register(
    "h49_build_messages",
    """
SELECT conv_id,
       (CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END) + count(*) + 1 + 2 AS n_messages,
       CASE WHEN conv_id % 2 = 0 THEN 'system,' ELSE '' END || string_agg(role, ',' ORDER BY turn) || ',assistant,tool,tool' AS roles
FROM conversations GROUP BY conv_id
""",
)
def h49_build_messages(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    conv = c.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("t")
    )
    msgs = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    sysp = F.when(F.col("conv_id") % 2 == 0, F.lit("You answer with SQL.")).otherwise(F.lit(""))
    built = CH.build_messages(sysp, msgs, F.lit("calling the tool"), F.array(F.lit('{"rows": []}'), F.lit('{"error": "x"}')))
    return conv.select(
        "conv_id",
        F.size(built).cast("long").alias("n_messages"),
        F.array_join(F.transform(built, lambda m: m["role"]), ",").alias("roles"),
    )


# ---------------------------------------------------------------- model-call surface
def _echo_model(system_prompt: str, messages: list[dict]):
    """Deterministic stand-in for a provider call (tests and registered
    queries): fails on prompts whose length is a multiple of 7, echoes even
    lengths, answers with the first word otherwise; reports one call."""
    content = messages[-1]["content"] if messages else ""
    if len(content) % 7 == 0:
        raise RuntimeError("provider timeout")
    text = content if len(content) % 2 == 0 else "Answer: " + content.split(" ")[0]
    return text, [{"input_tokens": len(content), "output_tokens": len(text), "latency_ms": 1.0, "ttft_ms": 0.5, "tps": None}]


@register(
    "j1_b9_generate_and_score",
    f"WITH v2 AS ({V2_SQL})"
    + """
, g AS (SELECT example_id, expected_output, weight,
               CASE WHEN length(prompt) % 7 = 0 THEN NULL WHEN length(prompt) % 2 = 0 THEN prompt
                    ELSE 'Answer: ' || split_part(prompt, ' ', 1) END AS gen
        FROM v2)
SELECT example_id,
       CASE WHEN gen IS NULL THEN 'ERROR: provider timeout' ELSE gen END AS output,
       CASE WHEN gen IS NULL THEN 'error' ELSE 'completed' END AS status,
       CASE WHEN gen IS NULL THEN CAST(0 AS DOUBLE)
            ELSE round_even((__SCORE__) * 100, 0) / 100 END AS score,
       CAST(CASE WHEN gen IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_calls
FROM g
""".replace("__SCORE__", _score_sql("expected_output", "gen", "weight")),
)
def j1_b9_generate_and_score(spark, sf_dir):
    ex = v2_examples(spark, sf_dir).select(
        "example_id",
        "system_prompt",
        "expected_output",
        "weight",
        F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))).alias("messages"),
    )
    gen = INF.materialize(INF.generate(ex, _echo_model, concurrency=8), "j1_generate")
    scored = INF.score_outputs(gen)
    return scored.select("example_id", "output", "status", "score", F.size("calls").cast("long").alias("n_calls"))


def _echo_judge(prompt: str) -> str:
    """Deterministic stand-in judge: strict JSON for most prompts, prose with
    a number for every fifth length, an error for every eleventh."""
    n = len(prompt)
    if n % 11 == 0:
        raise RuntimeError("judge unavailable")
    if n % 5 == 0:
        return f"I would say {n % 9} out of 5"
    return '{"score": %d, "score_reason": "len %d"}' % (n % 6, n)


_RENDERED_SQL = (
    "replace(replace(replace(replace(" + "'" + S.DEFAULT_JUDGE_PROMPT.replace("'", "''") + "'"
    + ", '{prompt}', output), '{output}', output), '{expected_output}', 'n/a'), '{max_score}', '5')"
)


@register(
    "j2_h6_judge_scores",
    f"WITH v1 AS ({V1_SQL}), r AS (SELECT result_id, weight, output, result_id % 13 = 0 AS no_output, result_id % 17 = 0 AS no_judge, length({_RENDERED_SQL}) AS n FROM v1)"
    + """
, s AS (SELECT *, no_output OR no_judge OR n % 11 = 0 AS bad,
        CASE WHEN no_output OR no_judge OR n % 11 = 0 THEN NULL WHEN n % 5 = 0 THEN 'I would say ' || CAST(n % 9 AS VARCHAR) || ' out of 5'
             ELSE '{"score": ' || CAST(n % 6 AS VARCHAR) || ', "score_reason": "len ' || CAST(n AS VARCHAR) || '"}' END AS judge_text FROM r)
SELECT result_id, judge_text,
       CASE WHEN no_output THEN 'ERROR: timeout'
            WHEN no_judge THEN output || chr(10) || chr(10) || '[JUDGE ERROR: Judge provider "gone" not found in providers.json]'
            WHEN n % 11 = 0 THEN output || chr(10) || chr(10) || '[JUDGE ERROR: judge unavailable]' ELSE output END AS output,
       CASE WHEN bad THEN 'error' ELSE 'completed' END AS status,
       CASE WHEN bad THEN CAST(0 AS DOUBLE)
            WHEN n % 5 = 0 THEN round_even(least(CAST(5 AS DOUBLE), CAST(n % 9 AS DOUBLE)) / 5 * weight * 100, 0) / 100
            ELSE round_even(CAST(n % 6 AS DOUBLE) / 5 * weight * 100, 0) / 100 END AS score,
       CASE WHEN bad THEN NULL WHEN n % 5 = 0 THEN '[unparseable judge response] ' || judge_text
            ELSE 'len ' || CAST(n AS VARCHAR) END AS score_reason
FROM s
""",
)
def j2_h6_judge_scores(spark, sf_dir):
    """J2 + H6 + H7: look up the judge's provider, render the judge prompt,
    call the (stand-in) judge on what was generated, parse strictly with the
    number fallback, isolate judge errors (B9). Every 13th generation failed
    and isn't judged, every 17th row names a provider that isn't configured.
    The stand-in is deterministic, so the oracle recomputes its verdicts."""
    failed, lost = F.col("result_id") % 13 == 0, F.col("result_id") % 17 == 0
    r = v1_results(spark, sf_dir).select("result_id", "output", "weight", "provider", F.col("output").alias("prompt"))
    r = r.withColumn("gen_error", F.when(failed, F.lit("timeout"))).withColumn("max_score", F.lit(5)).withColumn("expected_output", F.lit("n/a"))
    providers = r.select(F.col("provider").alias("name")).distinct()
    r = INF.with_judge_provider(r.withColumn("judge_provider", F.when(lost, F.lit("gone")).otherwise(F.col("provider"))), providers)
    r = r.withColumn(
        "judge_prompt", S.render_prompt(F.lit(S.DEFAULT_JUDGE_PROMPT), F.col("prompt"), F.col("output"), F.col("expected_output"), F.col("max_score"))
    )
    judged = INF.materialize(INF.judge(r, _echo_judge, "judge_prompt", concurrency=8), "j2_judge")
    return INF.score_outputs(judged, judged=True).select("result_id", "judge_text", "output", "status", "score", "score_reason")


@register(
    "j4_h43_answer_queries",
    """
WITH q AS (SELECT n_nationkey AS k,
                  CASE WHEN n_nationkey % 5 = 4 THEN 'DROP TABLE customer -- ' || n_name
                       ELSE 'SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_nationkey = ' || CAST(n_nationkey AS VARCHAR)
                            || ' GROUP BY c_mktsegment ORDER BY n DESC, c_mktsegment' END AS sql
           FROM nation),
seg AS (SELECT c_nationkey AS k, c_mktsegment AS s, count(*) AS n FROM customer GROUP BY ALL)
SELECT q.sql,
       CASE WHEN q.k % 5 = 4 THEN '{"error": "only SELECT queries are allowed"}'
            ELSE '{"rows": [' || coalesce((SELECT string_agg('{"c_mktsegment": "' || s || '", "n": ' || CAST(n AS VARCHAR) || '}', ', '
                                                             ORDER BY n DESC, s) FROM seg WHERE seg.k = q.k), '') || ']}' END AS answer
FROM q
""",
)
def j4_h43_answer_queries(spark, sf_dir):
    """J4 + H43 + F6: model-written SQL over registered views, answers capped
    at 50 rows as JSON. The tool queries are derived per nation."""
    for t in ("nation", "customer", "orders"):
        read_table(spark, sf_dir, t).createOrReplaceTempView(t)
    n = read_table(spark, sf_dir, "nation")
    q = n.select(
        F.when(
            F.col("n_nationkey") % 5 == 4,
            F.concat(F.lit("DROP TABLE customer -- "), F.col("n_name")),
        )
        .otherwise(
            F.concat(
                F.lit("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_nationkey = "),
                F.col("n_nationkey").cast("string"),
                F.lit(" GROUP BY c_mktsegment ORDER BY n DESC, c_mktsegment"),
            )
        )
        .alias("sql")
    )
    return INF.answer_queries(spark, q, "sql", cap=50)


def _j6_sql() -> str:
    from evalcat.operators.codeeval import PROMPT_TEMPLATE
    from evalcat.plans.adapters import V4_SQL

    nl2 = "chr(10) || chr(10)"
    quoted = PROMPT_TEMPLATE.replace("'", "''")
    pre, rest = quoted.split("{problem_steps_str}")
    mid, rest = rest.split("{next_step_str}")
    mid2, post = rest.split("{dependencies}")

    def row(context: str) -> str:
        """What a step comes to: n is the length of system prompt and prompt."""
        prompt = f"'{pre}' || {context} || '{mid}' || s.about || {nl2} || s.function_header || {nl2} || s.return_line || '{mid2}' || s.required_dependencies || '{post}'"
        n = f"length(s.system_prompt || {prompt})"
        return (
            f"CASE WHEN s.given_code IS NOT NULL THEN s.given_code WHEN {n} % 17 = 0 THEN NULL WHEN {n} % 3 = 0 THEN chr(10) "
            f"ELSE 'def f():' || chr(10) || '    return ' || CAST({n} AS VARCHAR) || chr(10) END AS code, "
            f"CASE WHEN s.given_code IS NOT NULL THEN 0 WHEN {n} % 17 <> 0 AND {n} % 3 = 0 THEN 3 ELSE 1 END AS attempts, "
            f"CASE WHEN s.given_code IS NULL AND {n} % 17 = 0 THEN 'provider timeout' END AS error"
        )

    return f"""
WITH RECURSIVE steps AS (
  SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY step_idx) - 1 AS k, CASE WHEN length(problem_id) % 2 = 0 THEN 'You write code.' ELSE '' END AS system_prompt,
         step_description_prompt || CASE WHEN step_background <> '' THEN {nl2} || 'Background:' || chr(10) || step_background ELSE '' END AS about
  FROM ({V4_SQL})),
r AS (
  SELECT problem_id, k, step_idx, code, attempts, error, about || {nl2} || code AS ctx FROM (SELECT s.problem_id, s.k, s.step_idx, s.about, {row("''")} FROM steps s WHERE s.k = 0)
  UNION ALL
  SELECT problem_id, k, step_idx, code, attempts, error, before || {nl2} || '------' || {nl2} || about || {nl2} || code AS ctx
  FROM (SELECT s.problem_id, s.k, s.step_idx, s.about, r.ctx AS before, {row("r.ctx")}
        FROM r JOIN steps s ON s.problem_id = r.problem_id AND s.k = r.k + 1 WHERE r.error IS NULL))
SELECT 'stand-in' AS model, problem_id, step_idx, code, CAST(attempts AS BIGINT) AS attempts, error FROM r
"""


@register("j6_generate_steps", _j6_sql())
def j6_generate_steps(spark, sf_dir):
    """Step-wise generation, a round for each step, with a stand-in model
    that answers blank for every third length of system prompt and prompt
    (exercising the retries) and fails for every 17th."""
    from evalcat.plans.adapters import v4_steps

    steps = v4_steps(spark, sf_dir).withColumn("model", F.lit("stand-in"))
    steps = steps.withColumn("system_prompt", F.when(F.length("problem_id") % 2 == 0, F.lit("You write code.")).otherwise(F.lit("")))

    def model(system_prompt: str, messages: list[dict]) -> str:
        n = len(system_prompt) + len(messages[-1]["content"])
        if n % 17 == 0:
            raise RuntimeError("provider timeout")
        return "```python\n\n```" if n % 3 == 0 else "```python\ndef f():\n    return %d\n```" % n

    return INF.generate_steps(steps, model, retries=2)

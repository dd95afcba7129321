"""Registered queries over V2 (examples from ``documents``) and raw JSON
example rows composed from ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalcat.functions import scoring as S
from evalcat.functions import text as X
from evalcat.functions.text import strip_sql
from evalcat.operators import examples as EX
from evalcat.operators import runs
from evalcat.operators.ranking import with_row_index
from evalcat.plans.adapters import V2_SQL, v2_examples
from evalcat.plans.registry import register, round_doubles
from evalcat.session import read_table

V2 = f"WITH v2 AS ({V2_SQL})\n"


def _weight_sql(w: str) -> str:
    return f"CASE WHEN {w} IS NOT NULL AND isfinite({w}) THEN {w} ELSE CAST(1 AS DOUBLE) END"


def _score_sql(exp: str, out: str, w: str) -> str:
    se, so = strip_sql(f"coalesce({exp}, '')"), strip_sql(f"coalesce({out}, '')")
    needle = strip_sql(f"substr({se}, 10)")
    frac = r"'(\d+)\s*/\s*(\d+)'"
    num = f"regexp_extract({so}, {frac}, 1)"
    den = f"regexp_extract({so}, {frac}, 2)"
    ww = _weight_sql(w)
    return f"""CASE
      WHEN starts_with(lower({se}), 'contains:') THEN
        CASE WHEN strpos({so}, {needle}) > 0 OR {needle} = '' THEN {ww} ELSE CAST(0 AS DOUBLE) END
      WHEN starts_with(lower({se}), 'ratio:') THEN
        CASE WHEN {num} = '' THEN CAST(0 AS DOUBLE)
             WHEN CAST({den} AS DOUBLE) = 0 THEN {ww}
             ELSE greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE))) * {ww} END
      ELSE CASE WHEN {so} = {se} THEN {ww} ELSE CAST(0 AS DOUBLE) END END"""


@register(
    "h1_h2_h3_h4_heuristic_scores",
    V2
    + f"""
SELECT example_id,
       {_weight_sql('weight')} AS weight_used,
       round_even(({_score_sql('expected_output', 'output', 'weight')}) * 100, 0) / 100 AS score
FROM v2
""",
)
def h1_h2_h3_h4_heuristic_scores(spark, sf_dir):
    e = v2_examples(spark, sf_dir)
    return e.select(
        "example_id",
        S.finite_weight("weight").alias("weight_used"),
        S.round_score(S.heuristic_score("expected_output", "output", "weight")).alias("score"),
    )


@register(
    "h1_exact_match_rate",
    V2
    + f"""
SELECT lang, count(*) AS n,
       count(*) FILTER (WHERE {strip_sql('output')} = {strip_sql('expected_output')}) AS exact_hits,
       round(sum({_score_sql('expected_output', 'output', 'weight')}), 6) AS score_sum
FROM v2 GROUP BY lang
""",
)
def h1_exact_match_rate(spark, sf_dir):
    e = v2_examples(spark, sf_dir)
    return round_doubles(
        e.groupBy("lang").agg(
            F.count(F.lit(1)).alias("n"),
            F.count(F.when(X.strip("output") == X.strip("expected_output"), 1)).alias("exact_hits"),
            F.sum(S.heuristic_score("expected_output", "output", "weight")).alias("score_sum"),
        )
    )


@register(
    "h10_strip",
    "SELECT doc_id, length(" + strip_sql("text") + ") AS stripped_len, length(text) AS raw_len FROM documents",
)
def h10_strip(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        F.length(X.strip("text")).cast("long").alias("stripped_len"),
        F.length("text").cast("long").alias("raw_len"),
    )


_JUDGE_TPL = "Q: {prompt}\nA: {output}\nRef: {expected_output}\nScore 0..{max_score}"


@register(
    "h7_render_prompt",
    V2
    + """
SELECT example_id,
       replace(replace(replace(replace('Q: {prompt}' || chr(10) || 'A: {output}' || chr(10) || 'Ref: {expected_output}' || chr(10) || 'Score 0..{max_score}',
         '{prompt}', prompt || ' {output}'), '{output}', output), '{expected_output}', expected_output),
         '{max_score}', CAST(1 + example_id % 9 AS VARCHAR)) AS rendered
FROM v2
""",
)
def h7_render_prompt(spark, sf_dir):
    e = v2_examples(spark, sf_dir)
    # the prompt carries a literal "{output}", which the next replacement fills
    p = F.concat(F.col("prompt"), F.lit(" {output}"))
    return e.select(
        "example_id",
        S.render_prompt(F.lit(_JUDGE_TPL), p, F.col("output"), F.col("expected_output"), F.col("example_id") % 9 + 1).alias(
            "rendered"
        ),
    )


@register(
    "b5_resolve_system_prompt",
    V2
    + """
SELECT example_id,
       CASE WHEN system_prompt IS NOT NULL THEN system_prompt
            WHEN (CASE example_id % 3 WHEN 0 THEN 'global' WHEN 1 THEN '' ELSE 'Model says ' || source END) NOT IN ('', 'global')
              THEN 'Model says ' || source
            ELSE coalesce(CASE WHEN example_id % 2 = 0 THEN 'Experiment default' END, '') END AS system_prompt_used
FROM v2
""",
)
def b5_resolve_system_prompt(spark, sf_dir):
    e = v2_examples(spark, sf_dir)
    model_prompt = (
        F.when(F.col("example_id") % 3 == 0, F.lit("global"))
        .when(F.col("example_id") % 3 == 1, F.lit(""))
        .otherwise(F.concat(F.lit("Model says "), "source"))
    )
    exp_prompt = F.when(F.col("example_id") % 2 == 0, F.lit("Experiment default"))
    return e.select("example_id", EX.resolve_system_prompt("system_prompt", model_prompt, exp_prompt).alias("system_prompt_used"))


@register(
    "b4_e9_complete_rows",
    V2
    + f"""
SELECT row_number() OVER (ORDER BY example_id) AS new_id, example_id
FROM v2 WHERE length({strip_sql('prompt')}) > 0 AND length({strip_sql('expected_output')}) > 0
""",
)
def b4_e9_complete_rows(spark, sf_dir):
    e = v2_examples(spark, sf_dir)
    done = EX.complete_rows(e, "prompt", "expected_output").select("example_id", F.col("example_id").alias("ord"))
    return EX.number_rows(done, "ord", "new_id").select("new_id", "example_id")


@register(
    "b3_limit_examples",
    """
SELECT doc_id AS example_id FROM (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM documents)
WHERE ordinal < 100
""",
)
def b3_limit_examples(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("example_id"))
    ex = with_row_index(d, ["example_id"], "ordinal")
    return EX.limit_examples(ex, 100).select("example_id")


@register(
    "b7_valid_name",
    "SELECT p_partkey, regexp_full_match(replace(p_name, ' ', '_'), '[A-Za-z0-9._-]+') AS valid_name, "
    "regexp_full_match(p_brand, '[A-Za-z0-9._-]+') AS valid_brand FROM part",
)
def b7_valid_name(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    return p.select(
        "p_partkey",
        EX.valid_name(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("valid_name"),
        EX.valid_name("p_brand").alias("valid_brand"),
    )


_REGION_MODELS_SQL = """
, models AS (SELECT 'p' || CAST(r_regionkey % 2 AS VARCHAR) AS provider, lower(r_name) AS model,
                    row_number() OVER (ORDER BY r_regionkey) - 1 AS model_index FROM region)
, ex AS (SELECT example_id, row_number() OVER (ORDER BY example_id) - 1 AS ordinal FROM v2)
"""


@register(
    "c1_e1_task_grid",
    V2
    + _REGION_MODELS_SQL
    + """
SELECT m.model_index * (SELECT count(*) FROM ex) + ex.ordinal + 1 AS result_id,
       m.model_index, m.provider, m.model, ex.example_id
FROM models m CROSS JOIN ex
""",
)
def c1_e1_task_grid(spark, sf_dir):
    reg = read_table(spark, sf_dir, "region")
    models = reg.select(
        F.concat(F.lit("p"), (F.col("r_regionkey") % 2).cast("string")).alias("provider"),
        F.lower("r_name").alias("model"),
        F.col("r_regionkey").alias("model_index"),
    )
    ex = with_row_index(v2_examples(spark, sf_dir).select("example_id"), ["example_id"], "ordinal")
    return runs.task_grid(ex, models).select("result_id", "model_index", "provider", "model", "example_id")


@register(
    "c8_results_with_examples",
    V2
    + """
SELECT e.event_id + 1 AS result_id, v2.example_id, v2.lang, e.event_type
FROM events e JOIN v2 ON e.event_id = v2.example_id
""",
)
def c8_results_with_examples(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("result_id"), F.col("event_id").alias("example_id"), "event_type"
    )
    ex = v2_examples(spark, sf_dir).select("example_id", "lang")
    return runs.results_with_examples(ev, ex).select("result_id", "example_id", "lang", "event_type")


@register("a18_count_examples", "SELECT count(*) AS n_examples FROM documents")
def a18_count_examples(spark, sf_dir):
    return EX.count_examples(read_table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- raw JSON rows
def _raw_rows(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    conv = c.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t")
    )
    msgs = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    bad_roles = F.transform(
        "t",
        lambda x: F.struct(
            F.when(x["role"] == "assistant", F.lit("bot")).otherwise(x["role"]).alias("role"),
            x["text"].alias("content"),
        ),
    )
    first = F.get("t", 0)["text"]
    last = F.try_element_at("t", F.lit(-1))["text"]
    k = F.col("conv_id") % 7
    cid = F.col("conv_id").alias("example_id")
    value = (
        F.when(k == 0, F.to_json(F.struct(cid, msgs.alias("messages"), last.alias("expected_output"), F.lit(2).alias("weight"))))
        .when(k == 1, F.to_json(F.struct(cid, first.alias("prompt"), F.lit(5).alias("system_prompt"), F.lit(True).alias("weight"))))
        .when(k == 2, F.to_json(F.struct(cid, first.alias("prompt"), msgs.alias("messages"))))
        .when(k == 3, F.to_json(F.struct(cid, F.lit("x").alias("note"))))
        .when(k == 4, F.to_json(F.struct(cid, bad_roles.alias("messages"), F.lit("sys").alias("system_prompt"))))
        .when(k == 5, F.to_json(F.struct(cid, F.array().cast("array<string>").alias("messages"))))
        .otherwise(F.to_json(F.struct(first.alias("prompt"), F.lit(1.5).alias("weight"))))
    )
    return conv.select(F.col("conv_id"), value.alias("value"))


_RAW_SQL = """
WITH conv AS (
  SELECT conv_id,
         list(json_object('role', role, 'content', text) ORDER BY turn) AS msgs,
         list(json_object('role', CASE WHEN role = 'assistant' THEN 'bot' ELSE role END, 'content', text) ORDER BY turn) AS bad,
         arg_min(text, turn) AS first_text, arg_max(text, turn) AS last_text
  FROM conversations GROUP BY conv_id),
raw AS (
  SELECT conv_id, CAST(CASE conv_id % 7
    WHEN 0 THEN json_object('example_id', conv_id, 'messages', to_json(msgs), 'expected_output', last_text, 'weight', 2)
    WHEN 1 THEN json_object('example_id', conv_id, 'prompt', first_text, 'system_prompt', 5, 'weight', true)
    WHEN 2 THEN json_object('example_id', conv_id, 'prompt', first_text, 'messages', to_json(msgs))
    WHEN 3 THEN json_object('example_id', conv_id, 'note', 'x')
    WHEN 4 THEN json_object('example_id', conv_id, 'messages', to_json(bad), 'system_prompt', 'sys')
    WHEN 5 THEN json_object('example_id', conv_id, 'messages', to_json([]::JSON[]))
    ELSE json_object('prompt', first_text, 'weight', 1.5) END AS JSON) AS v
  FROM conv),
parsed AS (
  SELECT conv_id, v,
         TRY_CAST(json_extract(v, '$.example_id') AS BIGINT) AS eid,
         coalesce(json_type(v, '$.prompt') = 'VARCHAR', false) AS has_prompt,
         coalesce(json_type(v, '$.messages') NOT IN ('NULL'), false) AS has_msgs,
         CAST(json_extract(v, '$.messages') AS JSON[]) AS m
  FROM raw),
checked AS (
  SELECT *,
    list_filter(list_transform(range(coalesce(len(m), 0)), lambda i:
      CASE WHEN json_type(m[i + 1]) <> 'OBJECT' THEN 'row ' || eid || ': messages[' || i || '] must be an object'
           WHEN coalesce(json_type(m[i + 1], '$.role') = 'VARCHAR'
                  AND json_extract_string(m[i + 1], '$.role') IN ('system', 'user', 'assistant', 'tool'), false) = false
             THEN 'row ' || eid || ': messages[' || i || '].role must be system|user|assistant|tool'
           WHEN coalesce(json_type(m[i + 1], '$.content') = 'VARCHAR', false) = false
             THEN 'row ' || eid || ': messages[' || i || '].content must be a string' END),
      lambda e: e IS NOT NULL) AS msg_errors
  FROM parsed)
SELECT conv_id,
  CASE WHEN eid IS NULL THEN '"example_id" is required'
       WHEN has_prompt AND has_msgs THEN 'row ' || eid || ': set either "prompt" or "messages", not both'
       WHEN NOT has_prompt AND NOT has_msgs THEN 'row ' || eid || ': either "prompt" or "messages" is required'
       WHEN has_msgs AND coalesce(len(m), 0) = 0 THEN 'row ' || eid || ': "messages" must be a non-empty array'
       WHEN has_msgs THEN msg_errors[1] END AS error,
  eid AS example_id,
  CASE WHEN has_msgs THEN len(m) ELSE 1 END AS n_messages,
  CASE WHEN has_msgs THEN json_extract_string(m[1], '$.role') ELSE 'user' END AS first_role,
  CASE WHEN json_type(v, '$.system_prompt') = 'VARCHAR' THEN json_extract_string(v, '$.system_prompt') END AS system_prompt,
  CASE WHEN json_type(v, '$.expected_output') = 'VARCHAR' THEN json_extract_string(v, '$.expected_output') ELSE '' END AS expected_output,
  CASE WHEN json_type(v, '$.weight') = 'BOOLEAN'
         THEN CASE WHEN json_extract_string(v, '$.weight') = 'true' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
       WHEN json_type(v, '$.weight') IN ('BIGINT', 'UBIGINT', 'DOUBLE')
         THEN CAST(json_extract_string(v, '$.weight') AS DOUBLE)
       ELSE CAST(1 AS DOUBLE) END AS weight
FROM checked
"""


@register("b1_b2_validate_examples", _RAW_SQL)
def b1_b2_validate_examples(spark, sf_dir):
    raw = EX.parse_raw(_raw_rows(spark, sf_dir))
    checked = raw.withColumn("error", EX.validation_error(F.col("_v")))
    norm = EX.normalize_examples(checked)
    return norm.select(
        "conv_id",
        "error",
        "example_id",
        F.size("messages").cast("long").alias("n_messages"),
        F.get("messages", 0)["role"].alias("first_role"),
        "system_prompt",
        "expected_output",
        "weight",
    )


@register(
    "h8_transcript",
    """
SELECT conv_id,
       CASE WHEN count(*) = 1 AND arg_min(role, turn) = 'user' THEN arg_min(text, turn)
            ELSE string_agg(role || ': ' || text, chr(10) ORDER BY turn) END AS transcript
FROM conversations GROUP BY conv_id
""",
)
def h8_transcript(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    conv = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return conv.select("conv_id", S.transcript("m").alias("transcript"))


@register(
    "h37_h48_detect_and_serialise",
    """
WITH conv AS (SELECT conv_id, to_json(list(json_object('role', role, 'content', text) ORDER BY turn)) AS arr,
                     arg_min(text, turn) AS first_text
              FROM conversations GROUP BY conv_id)
SELECT conv_id,
       coalesce(json_type(arr) = 'ARRAY' AND json_array_length(arr) > 0
                AND len(list_filter(CAST(arr AS JSON[]), lambda m: NOT coalesce(json_type(m, '$.role') = 'VARCHAR'
                    AND json_type(m, '$.content') = 'VARCHAR', false))) = 0, false) AS as_messages,
       CASE WHEN json_valid(first_text) THEN json_type(first_text) = 'ARRAY' ELSE false END AS plain_is_messages,
       json_extract_string(json_object('example_id', conv_id, 'prompt', first_text, 'expected_output', 'n/a'), '$.prompt') = first_text AS json_ok
FROM conv
""",
)
def h37_h48_detect_and_serialise(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    conv = c.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("t")
    )
    arr = F.to_json(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))))
    line = EX.example_json(F.col("conv_id"), F.get("t", 0)["content"], F.lit("n/a"))
    back = F.from_json(line, "example_id long, prompt string, expected_output string")
    return conv.select(
        "conv_id",
        EX.detect_messages(arr).alias("as_messages"),
        EX.detect_messages(F.get("t", 0)["content"]).alias("plain_is_messages"),
        ((back["example_id"] == F.col("conv_id")) & (back["prompt"] == F.get("t", 0)["content"])).alias("json_ok"),
    )

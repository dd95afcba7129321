"""Model-call surface.

The model and judge are user callables; Spark only decides where they run.
Tasks are partitioned as their data are. Within a task a window of at most
``concurrency`` calls is in flight, across batches, and answers come out in the
order of the rows: a slow call holds back what follows it, but never more than
a window of rows. Failures become data (status/error columns), never task
failures, so one bad row never reruns a partition's worth of paid calls. A task
that is repeated reads its rows again and returns all of them again.

A DataFrame holding generated outputs is nondeterministic: evaluating it twice
would call the model twice. :func:`materialize` writes it once to the shared
checkpoint folder and reads it back before anything else touches it.
"""

from __future__ import annotations

import json
import uuid
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalcat.functions import scoring as S
from evalcat.functions import text as TX
from evalcat.operators import codeeval as C
from evalcat.session import ensure_checkpoint_dir

CALL_TYPE = T.StructType(
    [
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("ttft_ms", T.DoubleType()),
        T.StructField("tps", T.DoubleType()),
    ]
)

Generator = Callable[[str, list[dict]], Any]

# Tool queries are model-written SQL texts, one driver-submitted job each.
MAX_TOOL_QUERIES = 10_000


def _messages(value) -> list[dict]:
    if value is None:
        return []
    out = []
    for m in value:
        d = m.asDict() if hasattr(m, "asDict") else dict(m)
        out.append({k: v for k, v in d.items() if v is not None})
    return out


def _split(result) -> tuple[str, list[dict]]:
    if isinstance(result, tuple):
        text, calls = result
        return "" if text is None else str(text), list(calls or [])
    return "" if result is None else str(result), []


def in_window(call: Callable, items: Iterable, window: int) -> Iterator[tuple[Any, str | None]]:
    """(result, None) or (None, error text) of ``call(item)``, in the order of
    the items, with at most ``window`` calls started and not yet handed out."""

    def attempt(item):
        try:
            return call(item), None
        except Exception as err:  # a failed call is an outcome
            return None, str(err) or type(err).__name__

    with ThreadPoolExecutor(max_workers=max(1, window)) as pool:
        flying = deque()
        for item in items:
            if len(flying) >= max(1, window):
                yield flying.popleft().result()
            flying.append(pool.submit(attempt, item))
        while flying:
            yield flying.popleft().result()


def _called(batches: Iterator[pd.DataFrame], columns: list[str], call: Callable, window: int) -> Iterator[tuple[pd.DataFrame, list]]:
    """Batches with the outcomes of ``call(row values)`` for their rows. The
    window runs on over the ends of batches."""
    frames: deque[pd.DataFrame] = deque()

    def rows():
        for pdf in batches:
            frames.append(pdf)
            yield from zip(*(pdf[c] for c in columns))

    done: list = []
    for outcome in in_window(call, rows(), window):
        done.append(outcome)
        while frames and len(done) >= len(frames[0]):
            pdf = frames.popleft()
            yield pdf, done[: len(pdf)]
            done = done[len(pdf) :]
    while frames:  # empty batches at the end
        yield frames.popleft(), []


def generate(
    tasks: DataFrame,
    fn: Generator,
    concurrency: int = 4,
    system_col: str = "system_prompt",
    messages_col: str = "messages",
    setup_error_col: str = "provider_error",
) -> DataFrame:
    """Run ``fn(system_prompt, messages)`` once per task row, with at most
    ``concurrency`` calls in flight in a task. ``fn`` returns text or (text,
    [call dicts]). Adds ``output``, ``gen_error`` and ``calls`` (ARRAY<call
    struct>); an exception becomes gen_error. A row whose ``setup_error_col``
    (if there is one, as from ``with_provider``) isn't null makes no call: its
    text is the error."""
    schema = T.StructType(
        tasks.schema.fields
        + [
            T.StructField("output", T.StringType()),
            T.StructField("gen_error", T.StringType()),
            T.StructField("calls", T.ArrayType(CALL_TYPE)),
        ]
    )
    names = [f.name for f in CALL_TYPE.fields]
    columns = [system_col, messages_col, *([setup_error_col] if setup_error_col in tasks.columns else [])]

    def call(row):
        system, messages, *setup = row
        if setup and isinstance(setup[0], str):
            raise RuntimeError(setup[0])
        text, calls = _split(fn(system or "", _messages(messages)))
        return text, [{k: c.get(k) for k in names} for c in calls]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, done in _called(batches, columns, call, concurrency):
            yield pdf.assign(
                output=pd.Series([r[0] if r else None for r, _ in done], dtype=object, index=pdf.index),
                gen_error=pd.Series([e for _, e in done], dtype=object, index=pdf.index),
                calls=pd.Series([r[1] if r else [] for r, _ in done], dtype=object, index=pdf.index),
            )

    return tasks.mapInPandas(run, schema)


def with_judge_provider(tasks: DataFrame, providers: DataFrame, provider_col: str = "judge_provider") -> DataFrame:
    """Adds ``judge_setup_error``: why a row can't be judged (no scorer, as
    C7 found, or a judge provider that isn't configured), else null."""
    known = providers.select(F.col("name").alias("_judge_name")).distinct()
    name = F.coalesce(F.col(provider_col), F.lit(""))
    out = tasks.join(known, name == F.col("_judge_name"), "left")
    missing = F.when(F.col("_judge_name").isNull(), F.format_string('Judge provider "%s" not found in providers.json', name))
    scorer = F.col("scorer_error") if "scorer_error" in tasks.columns else F.lit(None).cast("string")
    return out.withColumn("judge_setup_error", F.coalesce(scorer, missing)).drop("_judge_name")


def judge(df: DataFrame, fn: Callable[[str], str], prompt_col: str = "judge_prompt", concurrency: int = 4) -> DataFrame:
    """Call the judge on each rendered prompt, with at most
    ``concurrency`` calls in flight in a task; adds judge_text and judge_error
    (an exception becomes judge_error). A row whose generation failed
    (``gen_error``) isn't judged: both are null. One with a
    ``judge_setup_error`` makes no call, and has that as its error."""
    schema = T.StructType(
        df.schema.fields + [T.StructField("judge_text", T.StringType()), T.StructField("judge_error", T.StringType())]
    )
    checks = [c for c in ("gen_error", "judge_setup_error") if c in df.columns]

    def call(row):
        prompt, *rest = row
        found = {c: v for c, v in zip(checks, rest) if isinstance(v, str)}
        if "gen_error" in found:
            return None
        if found:
            raise RuntimeError(found["judge_setup_error"])
        return str(fn(prompt))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, done in _called(batches, [prompt_col, *checks], call, concurrency):
            yield pdf.assign(
                judge_text=pd.Series([r for r, _ in done], dtype=object, index=pdf.index), judge_error=pd.Series([e for _, e in done], dtype=object, index=pdf.index)
            )

    return df.mapInPandas(run, schema)


def score_outputs(df: DataFrame, judged: bool = False) -> DataFrame:
    """Row-level failure isolation and final scoring.

    generation error -> output "ERROR: msg", score 0, status error (no
    scoring); judge error -> output + "\\n\\n[JUDGE ERROR: msg]", score 0,
    status error; otherwise the heuristic score (or the parsed judge score
    when ``judged``), rounded half-even to 2 places."""
    gen_failed = F.col("gen_error").isNotNull()
    if judged:
        verdict = S.parse_judge(F.col("judge_text"), F.col("max_score"), F.col("weight"))
        jerr = F.col("judge_error")
        score = verdict["score"]
        reason = verdict["score_reason"]
    else:
        jerr = F.lit(None).cast("string")
        score = S.heuristic_score(F.col("expected_output"), F.col("output"), F.col("weight"))
        reason = F.lit(None).cast("string")
    out = df.withColumn("_jerr", F.when(~gen_failed, jerr))
    return out.select(
        *[c for c in df.columns if c not in ("output", "gen_error")],
        F.when(gen_failed, F.concat(F.lit("ERROR: "), F.col("gen_error")))
        .when(F.col("_jerr").isNotNull(), F.concat(F.col("output"), F.lit("\n\n[JUDGE ERROR: "), F.col("_jerr"), F.lit("]")))
        .otherwise(F.col("output"))
        .alias("output"),
        F.when(gen_failed | F.col("_jerr").isNotNull(), F.lit("error")).otherwise(F.lit("completed")).alias("status"),
        S.round_score(F.when(gen_failed | F.col("_jerr").isNotNull(), F.lit(0.0)).otherwise(score)).alias("score"),
        F.when(gen_failed | F.col("_jerr").isNotNull(), F.lit(None).cast("string"))
        .otherwise(reason)
        .alias("score_reason"),
    )


def materialize(df: DataFrame, name: str | None = None) -> DataFrame:
    """Write a nondeterministic result (generated outputs) once to the shared
    checkpoint folder and read it back, cutting the lineage so no later
    action re-calls the model. Every call writes a path of its own, which
    ``name`` only labels. Survives executor loss: the written files are
    the source of truth."""
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/evalcat-materialized/{name or 'out'}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def request_kwargs_map(temperature: Column, seed: Column, extras_json: Column) -> Column:
    """H38 as a Column: MAP<STRING,STRING> of request options: temperature
    (default 0), the seed when set, then the extra options, which override
    (a map filter + concat, so duplicate keys never raise)."""
    base = F.create_map(F.lit("temperature"), F.coalesce(temperature, F.lit(0.0)).cast("string"))
    seeded = F.when(
        seed.isNotNull(), F.map_concat(base, F.create_map(F.lit("seed"), seed.cast("long").cast("string")))
    ).otherwise(base)
    extras = F.coalesce(F.from_json(extras_json, "map<string,string>"), F.create_map().cast("map<string,string>"))
    keep = F.map_filter(seeded, lambda k, v: ~F.array_contains(F.map_keys(extras), k))
    return F.map_concat(keep, extras)


def generate_steps(
    steps: DataFrame,
    fn: Generator,
    retries: int = 2,
    group_cols: tuple[str, ...] = ("model", "problem_id"),
    concurrency: int = 4,
    with_background: bool = True,
) -> DataFrame:
    """Generate the sub-steps of every (model, problem) in order, all
    problems one step a round. steps: group_cols, step_idx,
    step_description_prompt, step_background, function_header, return_line,
    given_code, required_dependencies, and optionally system_prompt.

    The frontier of a round is each open problem's next step and the context
    its earlier steps left. The prompt is H22's; the answer's last code block
    (H18, H19) is the step's code; an answer without code is asked for again,
    ``retries`` times at most, and the last one stands. A given code is taken
    as it is, without a call (attempts 0). A call that fails ends its problem:
    that step has the error and no code, later steps have no row.

    Answers and frontier are written to the shared folder in every round, so a
    lost executor repeats the calls of its unfinished tasks only, and plans
    don't grow with the rounds. Rounds: as many as the longest problem has
    steps.

    Returns group_cols, step_idx, code, attempts, error."""
    keys = list(group_cols)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("step_idx")) - 1
    todo = steps if "system_prompt" in steps.columns else steps.withColumn("system_prompt", F.lit(""))
    todo = materialize(
        todo.select(
            *keys, "step_idx", "system_prompt", "given_code", place.alias("_round"), F.coalesce("required_dependencies", F.lit("")).alias("_needs"),
            C.step_description(F.col("step_description_prompt"), F.col("step_background"), with_background).alias("_about"),
            C.next_step("function_header", "return_line", "step_description_prompt", "step_background", with_background).alias("_next"),
        ),
        "steps",
    )
    rounds = (todo.agg(F.max("_round")).first()[0] or -1) + 1 if not todo.isEmpty() else 0
    blank = F.length(TX.strip(F.col("code"))) == 0
    given = F.length(F.coalesce("given_code", F.lit(""))) > 0
    result = [*keys, "step_idx", "code", "attempts", "error"]
    frontier = materialize(todo.select(*keys, F.lit("").alias("_context")).distinct(), "frontier")
    out = todo.limit(0).select(*keys, "step_idx", F.lit("").alias("code"), F.lit(0).cast("long").alias("attempts"), F.lit("").alias("error"))
    for i in range(rounds):
        now = todo.where(F.col("_round") == i).join(frontier, keys)
        prompt = C.fill_prompt(F.col("_context"), F.col("_next"), F.col("_needs"))
        asked = now.where(~given).withColumn("messages", F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))))
        taken = now.where(given).select(*keys, "step_idx", F.col("given_code").alias("code"), F.lit(0).cast("long").alias("attempts"), F.lit(None).cast("string").alias("error"))
        done = [taken]
        for attempt in range(1, retries + 2):
            answers = generate(asked.select(*keys, "step_idx", "system_prompt", "messages"), fn, concurrency)
            read = answers.select(
                *keys, "step_idx", "system_prompt", "messages", TX.last_code_block("output").alias("code"), F.lit(attempt).cast("long").alias("attempts"), F.col("gen_error").alias("error")
            )
            read = materialize(read, f"answers-{i}-{attempt}")
            again = F.lit(attempt <= retries) & F.col("error").isNull() & blank
            done.append(read.where(~again | again.isNull()).select(*result))
            asked = read.where(again)
            if attempt > retries or asked.isEmpty():
                break
        step = done[0]
        for d in done[1:]:
            step = step.unionByName(d)
        step = materialize(step, f"step-{i}")
        out = out.unionByName(step)
        if i + 1 < rounds:
            more = now.select(*keys, "_context", "_about").join(step.where("error IS NULL").select(*keys, "code"), keys)
            sep = F.when(F.col("_context") == "", F.lit("")).otherwise(F.concat(F.lit("\n\n"), F.lit(C.STEP_SEP), F.lit("\n\n")))
            frontier = materialize(more.select(*keys, F.concat("_context", sep, "_about", F.lit("\n\n"), F.coalesce("code", F.lit(""))).alias("_context")), "frontier")
    return out


def answer_queries(
    spark: SparkSession, queries: DataFrame, sql_col: str = "sql", cap: int = 50, parallel_jobs: int = 8
) -> DataFrame:
    """Run each distinct generated SQL text over the registered views,
    cap its answer at ``cap`` rows, and return (sql, answer JSON) with errors
    as data. Only read-only SELECT/WITH statements are executed. The loop
    is over distinct query texts (a small set); each query runs as its own
    distributed Spark job and only its capped answer reaches the driver."""
    distinct = queries.select(sql_col).distinct()
    n = distinct.count()
    if n > MAX_TOOL_QUERIES:
        raise ValueError(f"{n} distinct tool queries; run them in smaller sets")
    texts = [r[0] for r in distinct.collect()]

    def answer(q: str) -> tuple[str, str]:
        head = (q or "").lstrip().split(None, 1)[0].lower() if (q or "").strip() else ""
        if head not in ("select", "with"):
            return q, json.dumps({"error": "only SELECT queries are allowed"})
        try:
            res = spark.sql(q).limit(cap).collect()
            return q, json.dumps({"rows": [r.asDict(recursive=True) for r in res]}, default=str)
        except Exception as err:
            return q, json.dumps({"error": str(err).splitlines()[0]})

    # independent jobs: submit them concurrently so the cluster runs them side by side
    with ThreadPoolExecutor(max_workers=max(1, min(parallel_jobs, len(texts) or 1))) as pool:
        rows = list(pool.map(answer, texts))
    schema = T.StructType([T.StructField(sql_col, T.StringType()), T.StructField("answer", T.StringType())])
    return spark.createDataFrame(rows, schema)

import threading
import time

import pandas as pd
from pyspark.sql import functions as F

from evalcat.operators import codeeval as C
from evalcat.operators import inference as INF
from evalcat.operators import runs


def _tasks(spark):
    return spark.createDataFrame(
        [(1, "", [("user", "ok")], "ok", 1.0), (2, "sys", [("user", "boom")], "x", 1.0), (3, None, [("user", "hello world")], "contains: world", 2.0)],
        "example_id long, system_prompt string, messages array<struct<role:string,content:string>>, expected_output string, weight double",
    )


def test_generate_isolates_failures(spark):
    def model(system_prompt, messages):  # defined here so it pickles by value
        text = messages[-1]["content"]
        if text == "boom":
            raise RuntimeError("provider 500")
        return text, [{"input_tokens": 3, "output_tokens": 1, "latency_ms": 2.0, "ttft_ms": 1.0, "tps": None}]

    out = INF.score_outputs(INF.materialize(INF.generate(_tasks(spark), model, concurrency=2)))
    got = {r.example_id: (r.output, r.status, r.score, len(r.calls)) for r in out.collect()}
    assert got[1] == ("ok", "completed", 1.0, 1)
    assert got[2] == ("ERROR: provider 500", "error", 0.0, 0)
    assert got[3] == ("hello world", "completed", 2.0, 1)


def test_judge_errors_keep_output(spark):
    df = spark.createDataFrame(
        [(1, "out", None, "p1", 5, 1.0), (2, "out2", None, "p2", 5, 1.0)],
        "example_id long, output string, gen_error string, judge_prompt string, max_score int, weight double",
    )

    def judge(p):
        if p == "p2":
            raise RuntimeError("judge down")
        return '{"score": 5, "score_reason": "good"}'

    out = INF.score_outputs(INF.judge(df, judge), judged=True)
    got = {r.example_id: (r.output, r.status, r.score, r.score_reason) for r in out.collect()}
    assert got[1] == ("out", "completed", 1.0, "good")
    assert got[2] == ("out2\n\n[JUDGE ERROR: judge down]", "error", 0.0, None)


def test_request_kwargs(spark):
    df = spark.createDataFrame([(0.2, None, None), (None, 7, '{"temperature": 1, "top_p": 0.5}')], "t double, s long, e string")
    got = [r[0] for r in df.select(INF.request_kwargs_map(F.col("t"), F.col("s"), F.col("e"))).collect()]
    assert got == [{"temperature": "0.2"}, {"temperature": "1", "seed": "7", "top_p": "0.5"}]


def test_answer_queries_guard(spark):
    spark.range(3).createOrReplaceTempView("t3")
    q = spark.createDataFrame([("SELECT id FROM t3 ORDER BY id",), ("DELETE FROM t3",), ("SELECT nope FROM t3",)], "sql string")
    got = {r.sql: r.answer for r in INF.answer_queries(spark, q).collect()}
    assert got["SELECT id FROM t3 ORDER BY id"] == '{"rows": [{"id": 0}, {"id": 1}, {"id": 2}]}'
    assert "only SELECT" in got["DELETE FROM t3"]
    assert got["SELECT nope FROM t3"].startswith('{"error"')


STEPS = (
    "model string, problem_id string, step_idx long, step_description_prompt string, step_background string, function_header string, "
    "return_line string, given_code string, required_dependencies string, system_prompt string"
)


def test_generate_steps_rounds(spark):
    """Prompts, given code, retries, and a failure that ends its problem only."""
    row = lambda p, i, given=None, bg="": ("m", p, i, f"d{p}{i}", bg, f"h{i}", f"r{i}", given, "import numpy", "sys")
    steps = spark.createDataFrame([row("a", 0, bg=" note "), row("a", 1, "given code"), row("a", 2), row("bad", 0), row("bad", 1), row("void", 3), row("void", 7)], STEPS)

    def fn(system, messages):  # defined here so it pickles by value
        text = messages[-1]["content"]
        assert system == "sys" and len(messages) == 1
        if "dbad0" in text:
            raise RuntimeError("provider 500")
        if "dvoid3" in text and "dvoid7" not in text:
            return "```python\nimport os\n```"  # no code but an import: blank
        return "no\n```python\n```\n```python\nimport re\ncode %d %d\n```" % (len(text), text.count("------"))

    got = {(r.problem_id, r.step_idx): r for r in INF.generate_steps(steps, fn, retries=2).collect()}
    assert set(got) == {("a", 0), ("a", 1), ("a", 2), ("bad", 0), ("void", 3), ("void", 7)}
    fill = lambda context, asked: C.PROMPT_TEMPLATE.format(problem_steps_str=context, next_step_str=asked, dependencies="import numpy")
    first = fill("", "da0\n\nBackground:\nnote\n\nh0\n\nr0")
    code = f"\ncode {len(first)} 0\n"
    assert (got["a", 0].code, got["a", 0].attempts, got["a", 0].error) == (code, 1, None)
    assert (got["a", 1].code, got["a", 1].attempts) == ("given code", 0)
    context = f"da0\n\nBackground:\nnote\n\n{code}\n\n------\n\nda1\n\ngiven code"
    assert got["a", 2].code == f"\ncode {len(fill(context, 'da2' + chr(10) * 2 + 'h2' + chr(10) * 2 + 'r2'))} 1\n"
    assert (got["bad", 0].code, got["bad", 0].error) == (None, "provider 500")
    assert got["void", 3].attempts == 3 and got["void", 3].code.strip() == "" and got["void", 3].error is None
    assert got["void", 7].attempts == 1
    assert INF.generate_steps(steps.limit(0), fn).count() == 0


def test_window_keeps_order_and_bounds_calls():
    lock, flying, most = threading.Lock(), [0], [0]

    def call(i):
        with lock:
            flying[0] += 1
            most[0] = max(most[0], flying[0])
        time.sleep(0.02 if i % 5 == 0 else 0.001)
        with lock:
            flying[0] -= 1
        if i % 7 == 3:
            raise ValueError(f"no {i}")
        return i

    taken = []

    def items():
        for i in range(60):
            taken.append(i)
            yield i

    got = []
    for r in INF.in_window(call, items(), 4):
        got.append(r)
        assert len(taken) - len(got) <= 4  # never reads far ahead of what it hands out
    assert got == [(None, f"no {i}") if i % 7 == 3 else (i, None) for i in range(60)]
    assert 2 <= most[0] <= 4


def test_window_runs_on_over_batches_and_repeats_whole():
    frames = [pd.DataFrame({"x": list(range(n))}) for n in (3, 0, 1, 8, 0)]
    for _ in range(2):  # a repeated task returns every row again
        out = list(INF._called(iter(frames), ["x"], lambda r: r[0] * 2, 5))
        assert [len(f) for f, _ in out] == [3, 0, 1, 8, 0] and [r for _, d in out for r, _ in d] == [x * 2 for n in (3, 0, 1, 8) for x in range(n)]


def test_no_call_without_provider_or_output(spark):
    tasks = _tasks(spark).withColumn("provider", F.when(F.col("example_id") == 1, "gone").otherwise("p"))
    providers = spark.createDataFrame([("p", "http://x")], "name string, api_url string")
    calls = spark.sparkContext.accumulator(0)

    def model(system, messages):
        calls.add(1)
        return messages[-1]["content"]

    out = INF.materialize(INF.generate(runs.with_provider(tasks, providers), model)).orderBy("example_id").collect()
    assert [r.gen_error for r in out] == ['Provider "gone" not found in providers.json', None, None] and calls.value == 2

    df = spark.createDataFrame(
        [(1, "o1", "boom", "p", 5, 1.0), (2, "o2", None, "gone", 5, 1.0), (3, "o3", None, "p", 5, 1.0), (4, "o4", None, None, 5, 1.0)],
        "example_id long, output string, gen_error string, judge_provider string, max_score int, weight double",
    ).withColumn("judge_prompt", F.lit("rate"))
    judged = spark.sparkContext.accumulator(0)

    def judge(p):
        judged.add(1)
        return '{"score": 4, "score_reason": "ok"}'

    done = INF.materialize(INF.judge(INF.with_judge_provider(df, providers), judge))
    got = {r.example_id: (r.output, r.status, r.score) for r in INF.score_outputs(done, judged=True).collect()}
    assert judged.value == 1
    assert got[1] == ("ERROR: boom", "error", 0.0)
    assert got[2] == ('o2\n\n[JUDGE ERROR: Judge provider "gone" not found in providers.json]', "error", 0.0)
    assert got[3] == ("o3", "completed", 0.8)
    assert got[4][0] == 'o4\n\n[JUDGE ERROR: Judge provider "" not found in providers.json]'

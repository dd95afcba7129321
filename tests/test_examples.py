import json

from pyspark.sql import functions as F

from evalcat.operators import examples as EX


def _raw(spark, objs):
    return spark.createDataFrame([(json.dumps(o) if not isinstance(o, str) else o,) for o in objs], "value string")


def test_validation_errors(spark):
    objs = [
        {"example_id": 1, "prompt": "p", "messages": [{"role": "user", "content": "x"}]},
        {"example_id": 2},
        {"example_id": 3, "messages": []},
        {"example_id": 4, "messages": [{"role": "user", "content": "a"}, {"role": "bot", "content": "b"}]},
        {"example_id": 5, "messages": [{"role": "user", "content": 5}]},
        {"prompt": "no id"},
        {"example_id": 7, "messages": ["text"]},
        {"example_id": 8, "prompt": "fine"},
    ]
    good, bad = EX.validate_examples(_raw(spark, objs))
    errs = [r[0] for r in bad.orderBy(F.get_json_object("value", "$.example_id").cast("int").asc_nulls_first()).select("error").collect()]
    assert errs == [
        '"example_id" is required',
        'row 1: set either "prompt" or "messages", not both',
        'row 2: either "prompt" or "messages" is required',
        'row 3: "messages" must be a non-empty array',
        "row 4: messages[1].role must be system|user|assistant|tool",
        "row 5: messages[0].content must be a string",
        "row 7: messages[0] must be an object",
    ]
    assert [r.example_id for r in good.collect()] == [8]


def test_normalization(spark):
    objs = [
        {"example_id": "7", "prompt": "hi", "system_prompt": 3, "expected_output": 5, "weight": True},
        {"example_id": 8, "messages": [{"role": "system", "content": "s", "name": "n", "tool_calls": [1]}], "system_prompt": "",
         "weight": 2.5, "expected_output": "e"},
    ]
    good, bad = EX.validate_examples(_raw(spark, objs))
    assert bad.count() == 0
    rows = {r.example_id: r for r in good.collect()}
    a, b = rows[7], rows[8]
    assert a.messages[0].role == "user" and a.messages[0].content == "hi"
    assert a.system_prompt is None and a.expected_output == "" and a.weight == 1.0
    assert b.system_prompt == "" and b.weight == 2.5 and b.messages[0].name == "n" and b.messages[0].tool_calls == "[1]"


def test_system_prompt_precedence(spark):
    df = spark.createDataFrame(
        [("", "model", "exp"), (None, "global", "exp"), (None, "", None), (None, "m", "exp"), (None, None, "exp")],
        "r string, m string, e string",
    )
    got = [x[0] for x in df.select(EX.resolve_system_prompt("r", "m", "e")).collect()]
    assert got == ["", "exp", "", "m", "exp"]


def test_limit_and_complete(spark):
    df = spark.createDataFrame([(i, f"p{i}", "" if i % 2 else "e") for i in range(6)], "ordinal long, prompt string, expected_output string")
    assert EX.limit_examples(df, 0).count() == 0
    assert EX.limit_examples(df, 2).count() == 2
    assert EX.limit_examples(df, -1).count() == 6
    assert EX.complete_rows(df).count() == 3


def test_detect_messages(spark):
    df = spark.createDataFrame(
        [('[{"role": "user", "content": "a"}]',), ("[]",), ('[{"role": "user"}]',), ("plain",)], "t string"
    )
    assert [r[0] for r in df.select(EX.detect_messages("t")).collect()] == [True, False, False, False]


def test_read_scorer(spark):
    files = {
        "a": '{"name": "A", "provider_name": "p", "model": "m", "max_score": 7.9, "temperature": 0.5, "judge_prompt": "x"}',
        "b": '{"name": "", "max_score": "4", "temperature": "1"}',
        "c": '{"max_score": 0, "temperature": null, "provider_name": null}',
        "d": '{"max_score": true, "temperature": true, "model": 5}',
        "e": '{"max_score": 1e400}',
    }
    df = spark.createDataFrame(list(files.items()), "f string, t string")
    got = {r.f: tuple(r.s) for r in df.select("f", EX.read_scorer("t", "f").alias("s")).collect()}
    assert got["a"] == ("A", "p", "m", 0.5, "x", 7)
    assert got["b"] == ("b", "", "", 0.0, "", 5)
    assert got["c"] == ("c", "", "", 0.0, "", 5)
    assert got["d"] == ("d", "", "", 1.0, "", 1)
    assert got["e"][-1] == 5

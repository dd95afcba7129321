import csv
import io
import uuid

import pytest
from pyspark.sql import functions as F

from evalcat.sources import files as SRC
from evalcat.sources.positions import csv_records


def _dir(spark):
    from evalcat.session import ensure_checkpoint_dir

    return ensure_checkpoint_dir(spark).rstrip("/") + "/evalcat-tests/" + uuid.uuid4().hex


def test_results_old_file_without_weight(spark, tmp_path):
    p = tmp_path / "results.csv"
    p.write_text(
        "result_id,status,provider,model,example_id,output,score,score_reason,input_tokens,output_tokens,latency_ms,ttft_ms,tps,num_llm_calls\n"
        '1,,p,m,7,"\n\nline, with comma",1,,10,,12.5,,inf,2\n'
        "2,error,p,m,8,ERROR: x,,why,,,,,,\n"
    )
    rows = {r.result_id: r for r in SRC.read_results(spark, str(p)).collect()}
    a, b = rows[1], rows[2]
    assert a.status == "completed" and a.weight == 1.0 and a.output == "\n\nline, with comma"
    assert a.input_tokens == 10 and a.output_tokens is None and a.tps is None and a.num_llm_calls == 2
    assert b.score == 0.0 and b.score_reason == "why" and b.latency_ms is None


def test_results_roundtrip_keeps_leading_newlines(spark):
    df = spark.createDataFrame(
        [(1, "completed", "p", "m", 1, '\n\n  code "quoted"\n', 0.5, 2.0, None, 3, None, 1.0, None, None, 1)],
        SRC.RESULT_SCHEMA,
    )
    path = _dir(spark)
    SRC.write_results(df, path)
    back = SRC.read_results(spark, path).first()
    assert back.output == '\n\n  code "quoted"\n' and back.weight == 2.0 and back.score_reason is None


def test_jsonl_bad_line_number(spark, tmp_path):
    p = tmp_path / "set.JSONL"
    p.write_text('{"example_id": 1, "prompt": "a"}\n\n{"example_id": 2, "prompt": "b"}\nnot json\n')
    with pytest.raises(ValueError, match="JSONL line 4"):
        SRC.read_examples(spark, str(p))
    good, bad = SRC.read_examples(spark, str(p), mode="quarantine")
    assert [(r.example_id, r.ordinal) for r in good.orderBy("ordinal").collect()] == [(1, 0), (2, 1)]
    assert [r.line_no for r in bad.collect()] == [4]


def test_csv_examples(spark, tmp_path):
    p = tmp_path / "set.csv"
    p.write_text('example_id,prompt,expected_output,weight\n1,"multi\nline",x,\n2,b,,2.5\n')
    rows = SRC.read_examples(spark, str(p)).orderBy("ordinal").collect()
    assert [(r.example_id, r.messages[0].content, r.expected_output, r.weight, r.ordinal) for r in rows] == [
        (1, "multi\nline", "x", 1.0, 0), (2, "b", "", 2.5, 1)
    ]


def test_runs_and_experiment_dirs(spark, tmp_path):
    r = tmp_path / "exp1" / "runs" / "2024-01-01T00-00-00-000Z"
    r.mkdir(parents=True)
    (r / "run.json").write_text(
        '{"run_id": "2024-01-01T00-00-00-000Z", "status": "completed", "started_at": "2024-01-01T00:00:00.000Z",'
        ' "finished_at": null, "resumed_at": [], "total": 3, "completed": 3, "errors": 0}'
    )
    bad = tmp_path / "exp1" / "runs" / "broken"
    bad.mkdir()
    (bad / "run.json").write_text("{not json")
    runs = SRC.read_runs(spark, str(tmp_path / "*" / "runs" / "*" / "run.json")).collect()
    assert [(x.experiment_id, x.status, x.total) for x in runs] == [("exp1", "completed", 3)]
    d = tmp_path / "experiments"
    d.mkdir()
    (d / "b.json").write_text('{"id": "other", "name": "B"}')
    (d / "a.json").write_text('{"name": "A"}')
    (d / ".hidden.json").write_text('{"name": "H"}')
    (d / "bad.json").write_text("{oops")
    (d / "notes.txt").write_text("x")
    ex = SRC.read_json_dir(spark, str(d), spark.createDataFrame([], "id string, name string").schema).collect()
    assert [(x.id, x.name) for x in ex] == [("a", "A"), ("b", "B")]


def test_ws_table_and_artifacts(spark, tmp_path):
    p = tmp_path / "pods.txt"
    p.write_text("NAME READY STATUS\ninf-x-cache-1   1/1   Running   0   5m\nshort line\n")
    t = SRC.read_ws_table(spark, str(p)).collect()
    assert [r.fields[:3] for r in t] == [["inf-x-cache-1", "1/1", "Running"]]
    a = tmp_path / "arts"
    a.mkdir()
    (a / "2.yaml").write_text("kind: Bundle\nspec: x")
    (a / "1.yaml").write_text("kind: Bundle\nspec: y")
    (a / "3.yaml").write_text("kind: Other")
    got = [r.name for r in SRC.read_artifacts(spark, str(a), ["kind: Bundle", "spec:"]).collect()]
    assert got == ["1.yaml", "2.yaml"]


def _small_splits(spark, n):
    """Let files be read in splits of about n bytes."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    return lambda: [spark.conf.set(k, v) for k, v in before.items()]


@pytest.mark.parametrize("split", [25, 300, 128 << 20])
def test_csv_records_equal_the_csv_module_in_any_splits(spark, tmp_path, split):
    """Quoted line ends, commas and quotes over the ends of splits; a quote
    inside an unquoted field is a character."""
    cells = ["a", "", 'say ""hi""', "multi\nline\n\nend", "x,y", "\n\n", 'odd"quote', "tail ", "é" * 9, "\n" * 60]
    rows = [["example_id", "prompt", "expected_output", "weight"]]
    rows += [[str(i), cells[i % 10].replace('""', '"'), cells[(i * 7 + 3) % 10].replace('""', '"'), "" if i % 3 else "2.5"] for i in range(40)]
    quote = lambda c: c if not any(x in c for x in ',\n') and not c.startswith('"') else '"' + c.replace('"', '""') + '"'
    text = "\r\n".join(",".join(map(quote, r)) for r in rows[:20]) + "\n\n\n" + "\n".join(",".join(map(quote, r)) for r in rows[20:])
    p = tmp_path / "set.csv"
    p.write_bytes(text.encode())
    want = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    assert len(want) == len(rows)
    back = _small_splits(spark, split)
    try:
        got = {r._row: list(r.cells) for r in csv_records(spark, str(p)).collect()}
        ex = SRC.read_examples(spark, str(p)).orderBy("ordinal").collect()
    finally:
        back()
    assert got == dict(enumerate(want))
    assert [(r.ordinal, r.example_id, r.messages[0].content, r.expected_output) for r in ex] == [(i, i, r[1], r[2]) for i, r in enumerate(want[1:])]


def test_csv_bad_rows(spark, tmp_path):
    p = tmp_path / "set.csv"
    p.write_text('example_id,prompt,weight\n 1_0 ,"a\nb",1e2\n2.5,c,\n3,d,heavy\n+4,e,nan\n,f,\n')
    with pytest.raises(ValueError, match="CSV record 2: example_id"):
        SRC.read_examples(spark, str(p))
    good, bad = SRC.read_examples(spark, str(p), mode="quarantine")
    rows = good.orderBy("ordinal").collect()
    assert [(r.ordinal, r.example_id, r.messages[0].content) for r in rows] == [(0, 10, "a\nb"), (1, 4, "e")] and rows[0].weight == 100.0 and rows[1].weight != rows[1].weight
    assert sorted((r.line_no, r.error.split(": ")[1]) for r in bad.collect()) == [(2, "example_id is no whole number"), (3, "weight is no number"), (5, "example_id is no whole number")]


@pytest.mark.parametrize("split", [16, 128 << 20])
def test_jsonl_first_error_in_file_order_and_last_key(spark, tmp_path, split):
    p = tmp_path / "set.jsonl"
    p.write_text('{"example_id": 1, "prompt": "a", "prompt": "b"}\n  \n\n{"example_id": 2, "prompt": "c\\n"}\n{"example_id": 3}\nnot json\n{"example_id": 4, "prompt": "d"}')
    back = _small_splits(spark, split)
    try:
        with pytest.raises(ValueError, match="row 3: either"):
            SRC.read_examples(spark, str(p))
        good, bad = SRC.read_examples(spark, str(p), mode="quarantine")
        assert [(r.line_no, r.ordinal, r.example_id, r.messages[0].content) for r in good.orderBy("ordinal").collect()] == [(1, 0, 1, "b"), (4, 1, 2, "c\n"), (7, 2, 4, "d")]
        assert sorted((r.line_no, r.error) for r in bad.collect()) == [(5, 'row 3: either "prompt" or "messages" is required'), (6, "JSONL line 6: invalid JSON")]
    finally:
        back()


def test_lines_end_quoted():
    from evalcat.sources.positions import ends_quoted

    cases = {'a,b': (False, False), '"a': (True, False), 'a"b': (False, False), '"a""': (True, False), '"a"",': (True, False), ',"': (True, False), '"a"b"c,': (False, False), '"a", "b': (False, False)}
    for line, (out, _) in cases.items():
        assert ends_quoted(line, False) == out, line
    assert ends_quoted("x", True) and not ends_quoted('x"', True) and ends_quoted('x","y', True)


def test_results_whose_numbers_cannot_be_read(spark, tmp_path):
    p = tmp_path / "results.csv"
    head = "result_id,status,provider,model,example_id,output,score,weight,input_tokens\n"
    p.write_text(head + "9007199254740993,,p,m,9223372036854775807,o,0.5,,7\n2,,p,m,3,o,high,1,x\n3.5,,p,m,3,o,1,1,2\n4,,p,m,,o,1,1,2\n 5 ,,p,m,6,o,1,heavy,2f\n")
    good, bad = SRC.read_results(spark, str(p), mode="quarantine")
    rows = sorted(good.collect(), key=lambda r: r.result_id)
    assert [(r.result_id, r.example_id, r.weight, r.input_tokens) for r in rows] == [(5, 6, 1.0, None), (9007199254740993, 9223372036854775807, 1.0, 7)]
    assert sorted(r.error for r in bad.collect()) == ["example_id is not a number: ", "result_id is not a number: 3.5", "score is not a number: high"]
    with pytest.raises(Exception, match="is not a number"):
        SRC.read_results(spark, str(p)).collect()


def test_results_of_a_run_keep_their_order_over_files(spark):
    rows = spark.range(400).select(
        (400 - F.col("id")).alias("result_id"), F.lit("completed").alias("status"), F.lit("p").alias("provider"), F.lit("m").alias("model"), F.col("id").alias("example_id"),
        F.lit("o").alias("output"), F.lit(1.0).alias("score"), F.lit(1.0).alias("weight"), F.lit(None).cast("string").alias("score_reason"),
        *[F.lit(None).cast("double").alias(c) for c in ("input_tokens", "output_tokens", "latency_ms", "ttft_ms", "tps", "num_llm_calls")],
        F.when(F.col("id") % 3 == 0, "r1").otherwise("r2").alias("run_id"),
    )
    path = _dir(spark)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        SRC.write_results(rows, path, ["run_id"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    back = spark.read.option("header", "true").csv(path).select("run_id", F.col("_metadata.file_name").alias("f"), F.col("result_id").cast("int").alias("i"), F.monotonically_increasing_id().alias("n"))
    for run, want in (("r1", 134), ("r2", 266)):
        got = sorted((r.f, r.n, r.i) for r in back.where(F.col("run_id") == run).collect())
        assert len(got) == want and [i for _, _, i in got] == sorted(i for _, _, i in got)
        assert len({f for f, _, _ in got}) > 1
    assert SRC.read_results(spark, path).count() == 400


def test_results_trim_and_read_each_number_once(spark, tmp_path):
    """Ten number columns: ten cleanings and ten casts in the plan, not some for each use."""
    p = tmp_path / "results.csv"
    p.write_text("result_id,status,provider,model,example_id,output,score,weight,input_tokens,output_tokens,latency_ms,ttft_ms,tps,num_llm_calls\n 1_0,,p,m,+7,o, 5e-1 ,\u2003-2.5,1,2.0,.5,1.,-inf,2\n")
    df = SRC.read_results(spark, str(p))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 10 and plan.count("try_cast") + plan.count("cast(_bare") <= 20
    r = df.first()
    assert (r.result_id, r.example_id, r.score, r.weight, r.input_tokens, r.output_tokens, r.latency_ms, r.ttft_ms, r.tps, r.num_llm_calls) == (10, 7, 0.5, -2.5, 1, 2, 0.5, 1.0, None, 2)
    good, bad = SRC.read_results(spark, str(p), mode="quarantine")
    assert good.count() == 1 and bad.columns == [*spark.read.option("header", "true").csv(str(p)).columns, "score_reason", "error"]

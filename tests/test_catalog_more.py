import pytest
from pyspark.sql import functions as F

from evalcat.functions import scoring as S
from evalcat.operators import catalog as C
from evalcat.operators import codeeval as CO


def test_match_drafts_first_by_list_position(spark):
    mapping = spark.createDataFrame([("D", 0, "d-x"), ("D", 1, "d-y")], "model string, pos int, artifact string")
    mcfg = spark.createDataFrame(
        [("D", 0, "d-x", 0, "4k", "1", "1"), ("D", 1, "d-y", 0, "4k", "1", "2"), ("D", 1, "d-y", 1, "8k", "1", "2"),
         ("T", 0, "t-a", 0, "4k", "1", "1"), ("T", 0, "t-a", 1, "8k", "1", "1"), ("T", 0, "t-a", 2, "16k", "1", "1")],
        "model string, pos int, artifact string, entry_pos int, ss string, bs string, version string",
    )
    targets = spark.createDataFrame([("T", "4k", "1"), ("T", "8k", "1"), ("T", "16k", "1")], "model string, ss string, bs string")
    drafts = spark.createDataFrame([("T", "D")], "model string, draft_model string")
    got = sorted((r.ss, r.artifact, r.version, r.draft_for) for r in C.match_drafts(targets, drafts, mapping, mcfg).collect())
    # 4k: both artifacts offer it, the first in list order wins; 16k: no draft config
    assert got == [("4k", "d-x", "1", "T"), ("8k", "d-y", "2", "T")]
    sel = spark.createDataFrame(
        [("T", "4k", "1", "t-a-sd5", None), ("T", "8k", "1", "t-b-sd5", None), ("D", "4k", "1", "d-x", "T"), ("U", "4k", "1", "u-a", None)],
        "model string, ss string, bs string, artifact string, draft_for string",
    )
    assert [(r.model, r.ss) for r in C.missing_drafts(sel).collect()] == [("T", "8k")]


def test_pods_prefix_join(spark):
    deps = spark.createDataFrame([("d1",), ("d1-x",), ("d2",)], "deployment string")
    pods = spark.createDataFrame([("inf-d1-x-cache-0",), ("inf-d1-cache-1",), ("inf-d22-cache-0",), ("other-d2-0",)], "name string")
    got = sorted((r.deployment, r.name) for r in C.pods_of(deps, pods).collect())
    # d1 prefixes d1-x's pods too, as with the reference's prefix rule; d2 does not match d22
    assert got == [("d1", "inf-d1-cache-1"), ("d1", "inf-d1-x-cache-0"), ("d1-x", "inf-d1-x-cache-0")]


def test_resolve_refs(spark):
    cfg = spark.createDataFrame([("a", 0, "8k", "4"), ("a", 1, "4k", "1"), ("a", 2, "4096", "2")], "artifact string, entry_pos int, ss string, bs string")
    schema = "model string, size_key string, ref string, batch_sizes array<int>"
    refs = spark.createDataFrame(
        [("m", "default", "a:3", [1, 2]), ("m", "16k", "a:1", None), ("m", "32k", "a:2", []), ("m", "4k", "zz:1", None), ("m", "default", "zz:9", [8]), ("m", "2k", "a:4", [3])], schema
    )
    got = sorted((r.version, r.ss, r.artifact, r.bs) for r in C.resolve_refs(refs, cfg).collect())
    # plain references take size and batch size of the first entry; of equal smallest sizes the last names "default"
    assert got == [("1", "8k", "a", "4"), ("2", "8k", "a", "4"), ("3", "4096", "a", "1"), ("3", "4096", "a", "2"), ("4", "2k", "a", "3"), ("9", "default", "zz", "8")]
    with pytest.raises(ValueError, match='"zz" not found'):
        C.resolve_refs(refs, cfg, strict=True)
    with pytest.raises(ValueError, match="bad"):
        C.resolve_refs(refs.unionByName(spark.createDataFrame([("m", "4k", "bad", None)], schema)), cfg)


def test_tail_and_merge(spark):
    logs = spark.createDataFrame([("p", i, f"line {i}") for i in range(8)] + [("q", 0, "only")], "source string, seq int, text string")
    got = sorted((r.source, r.seq) for r in C.tail(logs, "source", "seq", 5).collect())
    assert got == [("p", 3), ("p", 4), ("p", 5), ("p", 6), ("p", 7), ("q", 0)]
    sel = spark.createDataFrame([("m", "4k", "a", "1", "8"), ("m", "4k", "a", "1", "2"), ("m", "4k", "a", "1", "8")],
                                "model string, ss string, artifact string, version string, bs string")
    assert C.merge_batch_sizes(sel).first().batch_sizes == [2, 8]


def test_step_tally_and_ratio_case(spark):
    steps = spark.createDataFrame(
        [("p", 0, "1.1", "given", []), ("p", 1, "1.2", "pass", []), ("p", 2, "1.3", "screen_fail", ["calls disallowed builtin 'open'"]),
         ("p", 3, "1.4", "fail", []), ("p", 4, "1.5", "pass", [])],
        "problem_id string, step_idx int, step_number string, status string, screen_violations array<string>",
    )
    t = CO.tally_steps(steps).first()
    assert (t.passed, t.total) == (2, 4)
    assert t.summary == "FAIL\n2/4 sub-steps passed; failed steps: 1.3 (screen: calls disallowed builtin 'open'), 1.4"
    r = CO.report_steps(steps).first()
    assert (r.n_pass, r.n_total) == (2, 3)
    # recorded case: "FAIL\n6/11 sub-steps passed; ..." scored with ratio: -> 0.55
    df = spark.createDataFrame([("FAIL\n6/11 sub-steps passed; failed steps: 3, 5", "ratio:", 1.0)], "o string, e string, w double")
    assert df.select(S.round_score(S.heuristic_score("e", "o", "w"))).first()[0] == 0.55


def test_prior_context_and_cumulative_code(spark):
    steps = spark.createDataFrame(
        [("p", "import numpy as np", 0, "d0", "bg0", "def f0():", "    return 0", "c0"),
         ("p", "import numpy as np", 1, "d1", "", "def f1():", "    return 1", "c1")],
        "problem_id string, required_dependencies string, step_idx int, step_description_prompt string, step_background string, "
        "function_header string, return_line string, code string",
    )
    rows = {r.step_idx: r for r in CO.cumulative_code(CO.prior_context(steps)).collect()}
    assert rows[0].prior_context == ""
    assert rows[1].prior_context == "d0\n\nBackground:\nbg0\n\nc0"
    assert rows[1].cumulative_code == "import numpy as np\n\nc0\n\nc1"
    prompt = {r.step_idx: r.prompt for r in CO.step_prompts(steps).collect()}[1]
    assert "d0\n\nBackground:\nbg0\n\nc0" in prompt and "d1\n\ndef f1():\n\n    return 1" in prompt


def test_screen_codes(spark):
    codes = {
        "several": "import os, math, numpy as np, scipy.linalg\nfrom urllib.request import urlopen",
        "clean": "# import os\ns = 'eval(open)'\n",
        "relative": "from . import y\nfrom .. import os",
        "calls": "x = open('f')\ny = obj.eval(1)\nz = vars",
        "attribute": "x . __mro__; '__bases__'",
        "prose": "No fences, just words",
        "deep": "-" * 8000 + "1",
        "chain": "x" + ".a" * 20000,
        "empty": "",
    }
    df = spark.createDataFrame([("p", k, c) for k, c in codes.items()] + [("p", "null", None), ("q", "several", "import numpy")], "problem_id string, k string, code string")
    deps = spark.createDataFrame([("p", "import numpy as np, os\nfrom scipy import linalg\nfrom . import z"), ("q", "not a dependency text")], "problem_id string, required_dependencies string")
    declared = CO.declared_modules(deps, ["problem_id"])
    assert sorted((r.problem_id, r.module) for r in declared.collect()) == [("p", "numpy"), ("p", "scipy")]
    got = {(r.problem_id, r.k): r.screen_violations for r in CO.screen_codes(df, declared, ["problem_id", "k"], ["problem_id"]).collect()}
    assert got["p", "several"] == ["imports blocked module 'os'", "imports blocked module 'urllib.request'"]
    assert got["q", "several"] == ["imports module 'numpy' not in allowed dependencies"]
    assert got["p", "clean"] == got["p", "empty"] == got["p", "null"] == []
    assert got["p", "relative"] == ["uses a relative import"]
    assert got["p", "calls"] == ["calls disallowed builtin 'open'", "references disallowed builtin 'open'", "references disallowed builtin 'vars'"]
    assert got["p", "attribute"] == ["accesses disallowed attribute '__mro__'"]
    assert got["p", "prose"][0].startswith("syntax error: ") and len(got["p", "prose"]) == 1
    assert got["p", "deep"] == got["p", "chain"] == ["syntax error: too deeply nested"]
    allowed = {r.problem_id: r.allowed for r in CO.allowed_modules(deps, ["problem_id"]).collect()}
    assert allowed["q"] == sorted(CO.ALLOWED_STDLIB) and allowed["p"] == sorted([*CO.ALLOWED_STDLIB, "numpy", "scipy"])

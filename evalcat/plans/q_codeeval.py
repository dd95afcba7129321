"""Registered queries over V4 (multi-step problems from ``conversations``)
and the document/label split used by fixture lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalcat.functions import codeeval as CE
from evalcat.functions import text as X
from evalcat.functions.text import strip_sql
from evalcat.operators import codeeval as CO
from evalcat.plans.adapters import V4_SQL, v4_steps
from evalcat.plans.registry import register
from evalcat.session import read_table
from evalcat.streaming.jobs import scratch_path

_LIST = lambda xs: "[" + ", ".join("'" + x + "'" for x in xs) + "]"

_CODE_SQL = r"""
, s1 AS (
  SELECT *, regexp_extract_all(response, '(?s)```python\b[ \t]*\r?\n?(.*?)```', 1) AS py,
            regexp_extract_all(response, '(?s)```[ \t]*\r?\n?(.*?)```', 1) AS anyb
  FROM steps)
, s2 AS (SELECT *, CASE WHEN len(py) > 0 THEN py ELSE anyb END AS blocks FROM s1)
, s3 AS (SELECT *, list_filter(blocks, lambda x: length(__STRIP_X__) > 0) AS filled FROM s2)
, s4 AS (
  SELECT *, regexp_replace(CASE WHEN len(blocks) = 0 THEN response WHEN len(filled) > 0 THEN filled[-1] ELSE blocks[-1] END,
                           '(?m)^\s*(import .*|from .*\s+import\s+.*)', '', 'g') AS extracted
  FROM s3)
, coded AS (SELECT * EXCLUDE (py, anyb, blocks, filled), coalesce(given_code, extracted) AS code FROM s4)
"""

# The steps' code after import lines are blanked: prose where the response had
# no fence (turn 2 of 4), else a function by the turn; from the rule, by hand.
_SCREEN_SQL = """
, screened AS (
  SELECT *, CASE WHEN given_code IS NOT NULL THEN [] WHEN step_idx % 4 = 1 THEN ['calls disallowed builtin ''open''', 'references disallowed builtin ''open''']
                 WHEN step_idx % 4 = 2 THEN ['syntax error'] WHEN step_idx % 4 = 3 THEN ['accesses disallowed attribute ''__mro__'''] ELSE [] END AS reasons
  FROM coded)
, statused AS (
  SELECT *, CASE WHEN given_code IS NOT NULL THEN 'given' WHEN len(reasons) > 0 THEN 'screen_fail'
                 WHEN verdict = 'PASS' THEN 'pass' ELSE 'fail' END AS status
  FROM screened)
"""

BASE = f"WITH steps AS ({V4_SQL})\n" + _CODE_SQL.replace("__STRIP_X__", strip_sql("x"))


def _coded(spark, sf_dir):
    s = v4_steps(spark, sf_dir)
    return s.withColumn("code", F.coalesce(F.col("given_code"), X.last_code_block("response")))


def _plain(reasons):
    """Reasons without the parser's own words, which SQL can't know."""
    return F.transform(reasons, lambda r: F.regexp_replace(r, "(?s)^syntax error: .*", "syntax error"))


def _statused(spark, sf_dir):
    c = _coded(spark, sf_dir)
    declared = CO.declared_modules(c.select("problem_id", "required_dependencies").distinct(), ["problem_id"])
    c = CO.screen_codes(c, declared, ["problem_id", "step_idx"], ["problem_id"])
    c = c.withColumn("screen_violations", _plain("screen_violations"))
    status = (
        F.when(F.col("given_code").isNotNull(), F.lit("given"))
        .when(F.size("screen_violations") > 0, F.lit("screen_fail"))
        .when(CE.verdict("verdict")["passed"], F.lit("pass"))
        .otherwise(F.lit("fail"))
    )
    return c.withColumn("status", status)


@register("h18_h19_last_code_block", BASE + "SELECT problem_id, step_idx, code FROM coded")
def h18_h19_last_code_block(spark, sf_dir):
    return _coded(spark, sf_dir).select("problem_id", "step_idx", "code")


#: Code texts of the screen's cases.
_CASES = [
    "import os, math\nx = 1",
    "# import os\ns = 'eval(open)'  # exec(s)\n",
    "from . import y\nfrom urllib.request import urlopen\n",
    "def f(x):\n    return x . __mro__, getattr(x, '__bases__')\n",
    "(" * 300 + "1" + ")" * 300,
    "-" * 8000 + "1",
    "x = input\ny = compile('1', '', 'eval')\n",
    "import numpy.linalg as la, scipy\nif la:\n    import json, foo.bar; import math\n",
]


@register(
    "b18_j3_g6_screen_code",
    BASE
    + _SCREEN_SQL
    + f"""
, made AS (
  SELECT problem_id, step_idx + 100 AS step_idx, required_dependencies AS deps, (length(problem_id) + CAST(problem_id AS BIGINT) + step_idx) % 8 AS k FROM steps)
, allowed AS (SELECT DISTINCT problem_id, array_to_string(list_sort(list_concat({_LIST(CO.ALLOWED_STDLIB)},
    CASE WHEN contains(required_dependencies, 'scipy') THEN ['numpy', 'scipy'] WHEN required_dependencies <> '' THEN ['numpy'] ELSE [] END)), ',') AS allowed FROM steps)
SELECT problem_id, step_idx, array_to_string(reasons, '; ') AS reasons, allowed FROM screened JOIN allowed USING (problem_id)
UNION ALL
SELECT problem_id, step_idx, CASE k
    WHEN 0 THEN 'imports blocked module ''os''' WHEN 1 THEN ''
    WHEN 2 THEN 'imports blocked module ''urllib.request''; uses a relative import'
    WHEN 3 THEN 'accesses disallowed attribute ''__mro__''' WHEN 4 THEN 'syntax error' WHEN 5 THEN 'syntax error'
    WHEN 6 THEN 'calls disallowed builtin ''compile''; references disallowed builtin ''compile''; references disallowed builtin ''input'''
    ELSE array_to_string(list_concat(['imports module ''foo.bar'' not in allowed dependencies'],
           list_concat(CASE WHEN deps = '' THEN ['imports module ''numpy.linalg'' not in allowed dependencies'] ELSE [] END,
                       CASE WHEN contains(deps, 'scipy') THEN [] ELSE ['imports module ''scipy'' not in allowed dependencies'] END)), '; ') END, allowed
FROM made JOIN allowed USING (problem_id)
""",
)
def b18_j3_g6_screen_code(spark, sf_dir):
    """The steps' own code, and beside each step a code of the
    screen's cases (several modules in a line, comments, strings, relative
    imports, nesting beyond the parser's limits)."""
    c = _coded(spark, sf_dir).select("problem_id", F.col("step_idx").cast("long").alias("step_idx"), "required_dependencies", "code")
    case = (F.length("problem_id") + F.col("problem_id").cast("long") + F.col("step_idx")) % len(_CASES)
    made = c.select("problem_id", (F.col("step_idx") + 100).alias("step_idx"), "required_dependencies", F.get(F.array(*[F.lit(x) for x in _CASES]), case.cast("int")).alias("code"))
    problems = c.select("problem_id", "required_dependencies").distinct()
    s = CO.screen_codes(c.unionByName(made), CO.declared_modules(problems, ["problem_id"]), ["problem_id", "step_idx"], ["problem_id"])
    s = s.join(CO.allowed_modules(problems, ["problem_id"]), "problem_id")
    return s.select("problem_id", "step_idx", F.array_join(_plain("screen_violations"), "; ").alias("reasons"), F.array_join("allowed", ",").alias("allowed"))


@register(
    "h20_h47_verdicts",
    BASE
    + r"""
SELECT problem_id, step_idx, verdict = 'PASS' AS passed,
       CASE WHEN verdict = 'PASS' THEN '' WHEN verdict = 'TIMEOUT' THEN 'timed out (no verdict)'
            WHEN starts_with(verdict, 'FAIL') THEN coalesce(nullif(regexp_replace(substr(verdict, 5), '^\n+', ''), ''),
                                                             'assertion failed or runtime error')
            ELSE 'assertion failed or runtime error' END AS error,
       string_split(__STRIP_V__, chr(10))[-1] AS last_line
FROM steps
""".replace("__STRIP_V__", strip_sql("verdict")),
)
def h20_h47_verdicts(spark, sf_dir):
    s = v4_steps(spark, sf_dir)
    v = CE.verdict("verdict")
    return s.select("problem_id", "step_idx", v["passed"].alias("passed"), v["error"].alias("error"), X.last_line("verdict").alias("last_line"))


@register(
    "d6_h21_tally_steps",
    BASE
    + _SCREEN_SQL
    + """
SELECT problem_id, passed, total,
       CASE WHEN n_failed > 0 THEN 'FAIL' || chr(10) || CAST(passed AS VARCHAR) || '/' || CAST(total AS VARCHAR)
                                   || ' sub-steps passed; failed steps: ' || failed
            ELSE 'PASS' || chr(10) || CAST(passed AS VARCHAR) || '/' || CAST(total AS VARCHAR) || ' sub-steps passed' END AS summary
FROM (
  SELECT problem_id, count(*) FILTER (WHERE status = 'pass') AS passed, count(*) AS total,
         count(*) FILTER (WHERE status IN ('fail', 'screen_fail')) AS n_failed,
         string_agg(CASE WHEN status = 'screen_fail' THEN step_number || ' (screen: ' || reasons[1] || ')' ELSE step_number END,
                    ', ' ORDER BY step_idx) FILTER (WHERE status IN ('fail', 'screen_fail')) AS failed
  FROM statused WHERE status <> 'given' GROUP BY problem_id)
""",
)
def d6_h21_tally_steps(spark, sf_dir):
    t = CO.tally_steps(_statused(spark, sf_dir))
    return t.select("problem_id", "passed", "total", "summary")


@register(
    "d7_report_steps",
    BASE
    + _SCREEN_SQL
    + """
SELECT problem_id, count(*) FILTER (WHERE status = 'pass') AS n_pass,
       count(*) FILTER (WHERE status IN ('pass', 'fail')) AS n_total
FROM statused GROUP BY problem_id
""",
)
def d7_report_steps(spark, sf_dir):
    return CO.report_steps(_statused(spark, sf_dir))


def _sql_literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_DESC_SQL = (
    "CASE WHEN length(__STRIP_BG__) > 0 THEN step_description_prompt || chr(10) || chr(10) || 'Background:' || chr(10) "
    "|| __STRIP_BG__ ELSE step_description_prompt END"
).replace("__STRIP_BG__", strip_sql("coalesce(step_background, '')"))


@register(
    "e3_h22_step_prompts",
    BASE
    + f"""
, ctx AS (
  SELECT *, {_DESC_SQL} AS d,
         list({{'i': step_idx, 'd': {_DESC_SQL}, 'c': coalesce(code, '')}})
           OVER (PARTITION BY problem_id ORDER BY step_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior
  FROM coded)
, ctx2 AS (SELECT *, coalesce(flatten(list_transform(list_sort(prior), lambda x: [x.d, x.c, '{CO.STEP_SEP}'])), []) AS parts FROM ctx)
SELECT problem_id, step_idx, prior_context,
       replace(replace(replace({_sql_literal(CO.PROMPT_TEMPLATE)}, '{{problem_steps_str}}', prior_context),
               '{{next_step_str}}', d || chr(10) || chr(10) || function_header || chr(10) || chr(10) || return_line),
               '{{dependencies}}', coalesce(required_dependencies, '')) AS prompt
FROM (SELECT *, array_to_string(parts[1:len(parts) - 1], chr(10) || chr(10)) AS prior_context FROM ctx2)
""",
)
def e3_h22_step_prompts(spark, sf_dir):
    s = CO.step_prompts(_coded(spark, sf_dir), "code")
    return s.select("problem_id", "step_idx", "prior_context", "prompt")


@register(
    "e4_cumulative_code",
    BASE
    + """
SELECT problem_id, step_idx,
       coalesce(required_dependencies, '') || chr(10) || chr(10)
       || array_to_string(list_transform(list_sort(list({'i': step_idx, 'c': coalesce(code, '')})
            OVER (PARTITION BY problem_id ORDER BY step_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), lambda x: x.c),
            chr(10) || chr(10)) AS cumulative_code
FROM coded
""",
)
def e4_cumulative_code(spark, sf_dir):
    return CO.cumulative_code(_coded(spark, sf_dir), "code").select("problem_id", "step_idx", "cumulative_code")


@register(
    "a17_convert_problems",
    f"""
WITH steps AS ({V4_SQL}),
nested AS (SELECT problem_id, count(*) AS n_steps, arg_min(step_number, step_idx) AS first_step,
                  count(given_code) AS n_given, arg_min(step_description_prompt, step_idx) AS description,
                  string_agg(test_cases[1] || chr(10) || 'import refkits', '|' ORDER BY step_idx) AS tests,
                  string_agg(step_background, '|' ORDER BY step_idx) AS backgrounds
           FROM steps GROUP BY problem_id, required_dependencies)
SELECT problem_id, n_steps, first_step, n_given, tests, backgrounds, TRY_CAST(problem_id AS BIGINT) AS example_id,
       {strip_sql('description')} || CASE WHEN CAST(problem_id AS BIGINT) % 2 = 0 THEN chr(10) || chr(10) || 'Input: x' ELSE '' END AS prompt, 'ratio:' AS expected_output
FROM nested
""",
)
def a17_convert_problems(spark, sf_dir):
    """Problems written as fixture lines, their tests without the
    imports of a package, and read back; example rows with the problem's
    input text."""
    steps = v4_steps(spark, sf_dir)
    lined = lambda t: F.concat(F.lit("from refkit.compare import close\n"), t, F.lit("\n\timport refkit as r\nimport refkits\n"))
    steps = steps.withColumn("test_cases", F.transform("test_cases", lined)).withColumn("step_background", F.concat(F.lit(" "), "step_background", F.lit("\n")))
    nested = CO.nest_problems(steps, "refkit")
    path = scratch_path(spark, "fixtures")
    CO.write_fixtures(nested, path)
    flat = spark.read.schema(nested.schema).json(path).select(
        "problem_id",
        F.size("sub_steps").cast("long").alias("n_steps"),
        F.get("sub_steps", 0)["step_number"].alias("first_step"),
        F.size(F.filter("sub_steps", lambda s: s["given_code"].isNotNull())).cast("long").alias("n_given"),
        F.array_join(F.transform("sub_steps", lambda s: F.array_join(s["test_cases"], ",")), "|").alias("tests"),
        F.array_join(F.transform("sub_steps", lambda s: s["step_background"]), "|").alias("backgrounds"),
        F.get("sub_steps", 0)["step_description_prompt"].alias("problem_description_main"),
        F.when(F.col("problem_id").cast("long") % 2 == 0, F.lit(" Input: x ")).otherwise(F.lit(" ")).alias("problem_io"),
    )
    ex = CO.problem_examples(flat)
    return flat.join(ex, F.col("problem_id").try_cast("long") == ex["example_id"], "left").select(
        "problem_id", "n_steps", "first_step", "n_given", "tests", "backgrounds", "example_id", "prompt", "expected_output"
    )


@register(
    "c9_with_problem",
    "SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON CAST(d.doc_id AS VARCHAR) = CAST(l.doc_id AS VARCHAR)",
)
def c9_with_problem(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("problem_id"))
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("problem_id"), "quality", "toxic")
    return CO.with_problem(docs, labels).select("doc_id", "quality", "toxic")


@register(
    "c10_given_code",
    f"""
WITH steps AS ({V4_SQL}),
given AS (SELECT problem_id, step_number, given_code AS code FROM steps WHERE given_code IS NOT NULL)
SELECT s.problem_id, s.step_number, g.code AS given_code FROM steps s
LEFT JOIN given g ON s.problem_id = g.problem_id AND s.step_number = g.step_number
""",
)
def c10_given_code(spark, sf_dir):
    steps = v4_steps(spark, sf_dir)
    given = steps.where(F.col("given_code").isNotNull()).select("problem_id", "step_number", "given_code")
    return CO.with_given_code(steps.select("problem_id", "step_number"), given)


@register(
    "c11_g2_split_concat",
    """
SELECT doc_id AS problem_id, 0 AS split_rank FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT item_id + 1000000, 2 FROM benchmark WHERE item_id + 1000000 NOT IN (SELECT doc_id FROM documents)
""",
)
def c11_g2_split_concat(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("problem_id"))
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("problem_id"))
    dev, test = CO.split_by_ids(docs, labels, "problem_id")
    fb = read_table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1000000).alias("problem_id"))
    out = CO.concat_splits(dev, test, fb, "problem_id")
    return out.select("problem_id", F.col("split_rank").cast("int").alias("split_rank"))

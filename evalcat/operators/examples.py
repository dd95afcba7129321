"""Example-set operators.

Raw example rows arrive as one JSON text per row (a JSONL line, or an inline
object). They are parsed once to VARIANT so type tests ("is this a string?",
"is this numeric?") follow the JSON value's own type, like the reference's
``isinstance`` checks, instead of whatever a fixed schema would coerce to.
All checks are native expressions (``transform``/``filter`` over arrays);
nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalcat.functions.text import strip

# The message roles a dataset row may use.
VALID_ROLES = ("system", "user", "assistant", "tool")

MESSAGE_TYPE = T.StructType(
    [
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("tool_calls", T.StringType()),
        T.StructField("tool_call_id", T.StringType()),
        T.StructField("name", T.StringType()),
    ]
)

_NUMERIC_TYPES = r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|BOOLEAN|DECIMAL.*)$"


def _vtype(v: Column, path: str) -> Column:
    """JSON type name of the value at ``path`` ("STRING", "BIGINT", "OBJECT",
    "ARRAY", "NULL" for JSON null, SQL null when the key is absent)."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _present(v: Column, path: str) -> Column:
    x = F.try_variant_get(v, path, "variant")
    return x.isNotNull() & ~F.is_variant_null(x)


def parse_raw(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """Attach ``_v`` (VARIANT) parsed from the JSON text column."""
    return raw.withColumn("_v", F.try_parse_json(F.col(value_col)))


def validation_error(v: Column) -> Column:
    """B2: first validation error of a raw row, null when the row is valid.
    Messages are checked in order; the error names row id and index."""
    eid = F.try_variant_get(v, "$.example_id", "long")
    rid = F.concat(F.lit("row "), eid.cast("string"), F.lit(": "))
    has_prompt = F.coalesce(_vtype(v, "$.prompt") == "STRING", F.lit(False))
    has_msgs = _present(v, "$.messages")
    msgs = F.try_variant_get(v, "$.messages", "array<variant>")

    def msg_error(m: Column, i: Column) -> Column:
        role = F.try_variant_get(m, "$.role", "string")
        role_ok = F.coalesce((_vtype(m, "$.role") == "STRING") & role.isin(*VALID_ROLES), F.lit(False))
        idx = F.concat(F.lit("messages["), i.cast("string"), F.lit("]"))
        return (
            F.when(~F.coalesce(F.schema_of_variant(m).startswith("OBJECT"), F.lit(False)), F.concat(rid, idx, F.lit(" must be an object")))
            .when(~role_ok, F.concat(rid, idx, F.lit(".role must be system|user|assistant|tool")))
            .when(
                F.coalesce(_vtype(m, "$.content") != "STRING", F.lit(True)),
                F.concat(rid, idx, F.lit(".content must be a string")),
            )
        )

    first_msg_error = F.try_element_at(
        F.filter(F.transform(msgs, msg_error), lambda e: e.isNotNull()), F.lit(1)
    )
    return (
        F.when(v.isNull(), F.lit("invalid JSON"))
        .when(eid.isNull(), F.lit('"example_id" is required'))
        .when(has_prompt & has_msgs, F.concat(rid, F.lit('set either "prompt" or "messages", not both')))
        .when(~has_prompt & ~has_msgs, F.concat(rid, F.lit('either "prompt" or "messages" is required')))
        .when(
            has_msgs & (msgs.isNull() | (F.size(msgs) == 0)),
            F.concat(rid, F.lit('"messages" must be a non-empty array')),
        )
        .when(has_msgs, first_msg_error)
    )


def normalize_examples(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """B1: typed example rows from raw JSON rows (valid rows only; see
    :func:`validate_examples`). prompt -> one user message; a non-string
    system_prompt -> null; non-string expected_output -> ""; numeric weight
    (booleans count) else 1.0. Extra columns of ``raw`` are kept."""
    v = F.col("_v")
    msgs = F.try_variant_get(v, "$.messages", "array<variant>")
    as_msg = lambda m: F.struct(
        F.try_variant_get(m, "$.role", "string").alias("role"),
        F.try_variant_get(m, "$.content", "string").alias("content"),
        F.when(_present(m, "$.tool_calls"), F.to_json(F.try_variant_get(m, "$.tool_calls", "variant"))).alias("tool_calls"),
        F.when(_vtype(m, "$.tool_call_id") == "STRING", F.try_variant_get(m, "$.tool_call_id", "string")).alias("tool_call_id"),
        F.when(_vtype(m, "$.name") == "STRING", F.try_variant_get(m, "$.name", "string")).alias("name"),
    )
    prompt_msg = F.array(
        F.struct(
            F.lit("user").alias("role"),
            F.try_variant_get(v, "$.prompt", "string").alias("content"),
            F.lit(None).cast("string").alias("tool_calls"),
            F.lit(None).cast("string").alias("tool_call_id"),
            F.lit(None).cast("string").alias("name"),
        )
    )
    keep = [c for c in raw.columns if c not in (value_col, "_v")]
    return raw.select(
        *keep,
        F.try_variant_get(v, "$.example_id", "long").alias("example_id"),
        F.when(_present(v, "$.messages"), F.transform(msgs, as_msg)).otherwise(prompt_msg).alias("messages"),
        F.when(_vtype(v, "$.system_prompt") == "STRING", F.try_variant_get(v, "$.system_prompt", "string")).alias(
            "system_prompt"
        ),
        F.when(
            _vtype(v, "$.expected_output") == "STRING", F.try_variant_get(v, "$.expected_output", "string")
        ).otherwise(F.lit("")).alias("expected_output"),
        F.when(
            _vtype(v, "$.weight").rlike(_NUMERIC_TYPES), F.try_variant_get(v, "$.weight", "double")
        ).otherwise(F.lit(1.0)).alias("weight"),
    )


def validate_examples(raw: DataFrame, value_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """B2: split raw rows into (good normalised rows, bad rows with ``error``).
    Strict callers can ``raise_error`` on the bad side instead."""
    parsed = parse_raw(raw, value_col).withColumn("error", validation_error(F.col("_v")))
    good = normalize_examples(parsed.where(F.col("error").isNull()).drop("error"), value_col)
    bad = parsed.where(F.col("error").isNotNull()).drop("_v")
    return good, bad


def limit_examples(examples: DataFrame, n: int | None, ordinal_col: str = "ordinal") -> DataFrame:
    """The first n examples in file order when n >= 0, all otherwise.
    Filters on the ordinal (a plain ``limit`` picks arbitrary rows)."""
    if n is None or n < 0:
        return examples
    return examples.where(F.col(ordinal_col) < n)


def complete_rows(df: DataFrame, prompt_col: str = "prompt", expected_col: str = "expected_output") -> DataFrame:
    """Authored rows with both prompt and expected text non-blank."""
    return df.where(
        (F.length(strip(F.coalesce(F.col(prompt_col), F.lit("")))) > 0)
        & (F.length(strip(F.coalesce(F.col(expected_col), F.lit("")))) > 0)
    )


def resolve_system_prompt(row_prompt, model_prompt, experiment_prompt) -> Column:
    """The row's prompt when set (even ""), else the model's unless blank
    or "global", else the experiment's."""
    rp = F.col(row_prompt) if isinstance(row_prompt, str) else row_prompt
    mp = F.col(model_prompt) if isinstance(model_prompt, str) else model_prompt
    ep = F.col(experiment_prompt) if isinstance(experiment_prompt, str) else experiment_prompt
    model_ok = mp.isNotNull() & (mp != "") & (mp != "global")
    return F.when(rp.isNotNull(), rp).when(model_ok, mp).otherwise(F.coalesce(ep, F.lit("")))


def read_scorer(definition, file_name) -> Column:
    """struct(name, provider_name, model, temperature, judge_prompt,
    max_score) of a scorer's JSON text. max_score not a positive finite JSON
    number -> 5, else truncated; temperature not a JSON number -> 0 (a
    boolean counts as a number, a text of digits doesn't); a missing, empty or
    null text -> "", for the name that of the file."""
    v = F.try_parse_json(F.col(definition) if isinstance(definition, str) else definition)
    number = lambda path: F.when(_vtype(v, path).rlike(_NUMERIC_TYPES), F.when(_vtype(v, path) == "BOOLEAN", F.try_variant_get(v, path, "boolean").cast("double")).otherwise(F.try_variant_get(v, path, "double")))
    text = lambda path: F.coalesce(F.when(_vtype(v, path) == "STRING", F.try_variant_get(v, path, "string")), F.lit(""))
    top = number("$.max_score")
    usable = top.isNotNull() & ~F.isnan(top) & (top > 0) & (top < float("inf"))
    return F.struct(
        F.coalesce(F.nullif(text("$.name"), F.lit("")), F.col(file_name) if isinstance(file_name, str) else file_name).alias("name"),
        text("$.provider_name").alias("provider_name"),
        text("$.model").alias("model"),
        F.coalesce(number("$.temperature"), F.lit(0.0)).alias("temperature"),
        text("$.judge_prompt").alias("judge_prompt"),
        F.when(usable, top.cast("long").cast("int")).otherwise(F.lit(5)).alias("max_score"),
    )


# Fixed value: allowed characters of experiment/scorer names.
NAME_PATTERN = r"^[A-Za-z0-9._-]+$"


def valid_name(col) -> Column:
    """Name whitelist."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.rlike(NAME_PATTERN), F.lit(False))


def number_rows(df: DataFrame, order_col: str = "ordinal", name: str = "example_id") -> DataFrame:
    """Sequential 1-based ids for authored rows in their order
    (distributed index, no single-partition window)."""
    from evalcat.operators.ranking import with_row_index

    return with_row_index(df.drop(name) if name in df.columns else df, [order_col], name, start=1)


def detect_messages(col) -> Column:
    """Text holds a non-empty JSON array whose items all have string
    role and content."""
    arr = F.try_variant_get(F.try_parse_json(F.col(col) if isinstance(col, str) else col), "$", "array<variant>")
    ok = F.forall(
        arr,
        lambda m: F.coalesce((_vtype(m, "$.role") == "STRING") & (_vtype(m, "$.content") == "STRING"), F.lit(False)),
    )
    return F.coalesce(arr.isNotNull() & (F.size(arr) > 0) & ok, F.lit(False))


def example_json(example_id, prompt, expected, weight=None, system_prompt=None) -> Column:
    """One authored row as a JSON line (prompt form)."""
    fields = [
        F.col(example_id).alias("example_id") if isinstance(example_id, str) else example_id.alias("example_id"),
        (F.col(prompt) if isinstance(prompt, str) else prompt).alias("prompt"),
        (F.col(expected) if isinstance(expected, str) else expected).alias("expected_output"),
    ]
    if system_prompt is not None:
        fields.append((F.col(system_prompt) if isinstance(system_prompt, str) else system_prompt).alias("system_prompt"))
    if weight is not None:
        fields.append((F.col(weight) if isinstance(weight, str) else weight).alias("weight"))
    return F.to_json(F.struct(*fields))


def count_examples(examples: DataFrame) -> DataFrame:
    """Number of examples (multi-line quoted cells are one row)."""
    return examples.agg(F.count(F.lit(1)).alias("n_examples"))

"""Streamed-response folding and tool-call message helpers (SURVEY D19, D20,
F6, F9, H43, H45, H49, H50).

A response is a sequence of chunks keyed by (result_id, call_no, seq). The
fold of one response is one value (its text), so the group is one response;
every other quantity (usage, first-token time) is a partial aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["result_id", "call_no"]


def fold_chunks(chunks: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """text = contents concatenated in ``seq`` order; usage = the last
    usage seen; first_token_ts = time of the first chunk with content or a
    tool-call delta."""
    has_content = F.coalesce(F.col("content"), F.lit("")) != ""
    has_tool = F.col("tool_args").isNotNull() | (F.coalesce(F.col("tool_id"), F.lit("")) != "")
    return chunks.groupBy(*key).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("content", F.lit("")).alias("c")))), lambda x: x["c"]),
            "",
        ).alias("text"),
        F.max_by("usage", F.when(F.col("usage").isNotNull(), F.col("seq"))).alias("usage"),
        F.min(F.when(has_content | has_tool, F.col("ts"))).alias("first_token_ts"),
        F.max("ts").alias("last_ts"),
    )


def fold_tool_calls(chunks: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Tool-call deltas per (call, index) (a null index is 0): last
    non-empty id and name, arguments concatenated in order; sorted by index."""
    d = chunks.where(F.col("tool_args").isNotNull() | (F.coalesce(F.col("tool_id"), F.lit("")) != "")).withColumn(
        "tool_index", F.coalesce(F.col("tool_index"), F.lit(0))
    )
    nonempty = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("seq"))
    g = d.groupBy(*key, "tool_index").agg(
        F.max_by("tool_id", nonempty("tool_id")).alias("id"),
        F.max_by("tool_name", nonempty("tool_name")).alias("name"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("tool_args", F.lit("")).alias("a")))), lambda x: x["a"]),
            "",
        ).alias("arguments"),
    )
    return g.select(
        *key,
        "tool_index",
        F.coalesce("id", F.lit("")).alias("id"),
        F.coalesce("name", F.lit("")).alias("name"),
        "arguments",
    ).orderBy(*key, "tool_index")


def cap_rows(df: DataFrame, order: Sequence[Column | str], n: int = 50) -> DataFrame:
    """the first n rows of a tool query answer after an explicit sort
    (the cap is the feature: a tool answer shows at most 50 rows)."""
    return df.orderBy(*order).limit(n)


def list_model_ids(models: DataFrame, id_col: str = "id") -> DataFrame:
    """non-empty string ids, sorted (duplicates kept)."""
    return models.where(F.col(id_col).isNotNull() & (F.col(id_col) != "")).select(id_col).orderBy(id_col)


def rows_json(df: DataFrame) -> DataFrame:
    """One ``{"rows": [...]}`` JSON text of a (capped) answer."""
    return df.agg(F.to_json(F.struct(F.collect_list(F.struct(*df.columns)).alias("rows"))).alias("answer"))


def error_json(message: Column) -> Column:
    """H43 error form: ``{"error": "..."}``."""
    return F.to_json(F.struct(message.alias("error")))


def api_error(body: Column) -> Column:
    """``.error.message``, else ``.error`` when it is text, else
    ``.message``, else the raw body."""
    err_obj_msg = F.get_json_object(body, "$.error.message")
    err = F.get_json_object(body, "$.error")
    err_text = F.when(err.isNotNull() & ~err.startswith("{"), err)
    return F.coalesce(err_obj_msg, err_text, F.get_json_object(body, "$.message"), body)


def response_text(body: Column) -> Column:
    """struct(text, error): first choice's message content, else its
    text, else ""; an ``error.message`` becomes the error."""
    err = F.get_json_object(body, "$.error.message")
    content = F.get_json_object(body, "$.choices[0].message.content")
    text = F.get_json_object(body, "$.choices[0].text")
    return F.struct(
        F.when(err.isNull(), F.coalesce(content, text, F.lit(""))).alias("text"),
        err.alias("error"),
    )


def build_messages(system_prompt: Column, messages: Column, assistant: Column | None = None, tool_results: Column | None = None) -> Column:
    """[system (when non-empty)] + messages [+ assistant turn]
    [+ tool results in order]. Messages are struct(role, content)."""
    sys_msg = F.when(
        F.coalesce(system_prompt, F.lit("")) != "",
        F.array(F.struct(F.lit("system").alias("role"), system_prompt.alias("content"))),
    ).otherwise(F.array().cast("array<struct<role:string,content:string>>"))
    out = F.concat(sys_msg, messages)
    if assistant is not None:
        out = F.concat(out, F.array(F.struct(F.lit("assistant").alias("role"), assistant.alias("content"))))
    if tool_results is not None:
        out = F.concat(out, F.transform(tool_results, lambda t: F.struct(F.lit("tool").alias("role"), t.alias("content"))))
    return out

"""Per-call metric operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalcat.functions.text import strip


def call_timing(usage: Column, t_start: Column, t_first: Column, t_end: Column) -> Column:
    """struct(ttft_ms, latency_ms, tps) of one call. Server-reported
    values (seconds) win over client clocks; client tps = completion tokens
    / (end - first token) only when tokens are non-zero and end > first."""
    s_ttft = usage["time_to_first_token"]
    s_lat = usage["total_latency"]
    s_tps = usage["completion_tokens_after_first_per_sec"]
    tokens = usage["completion_tokens"]
    gen = F.when(t_first.isNotNull() & (t_end > t_first), t_end - t_first)
    ttft = F.when(s_ttft.isNotNull(), s_ttft * 1000.0).when(t_first.isNotNull(), (t_first - t_start) * 1000.0)
    lat = F.when(s_lat.isNotNull(), s_lat * 1000.0).otherwise((t_end - t_start) * 1000.0)
    tps = F.when(s_tps.isNotNull(), s_tps).when(
        tokens.isNotNull() & (tokens != 0) & gen.isNotNull() & (gen > 0), tokens / gen
    )
    return F.struct(ttft.alias("ttft_ms"), lat.alias("latency_ms"), tps.alias("tps"))


def first_usable(
    attempts: DataFrame,
    keys: Sequence[str],
    attempt_col: str,
    code_col: str,
    max_attempts: int = 3,
    attempt_no_col: str | None = None,
) -> DataFrame:
    """E5: of the first ``max_attempts`` attempts (the generator's retry
    limit), the first with non-blank code, else the last one made.
    ``attempt_col`` orders attempts (any orderable type); ``attempt_no_col``
    (default: the same column) is the 1-based attempt number."""
    a = attempts.where(F.col(attempt_no_col or attempt_col) <= max_attempts)
    usable = F.length(strip(F.coalesce(F.col(code_col), F.lit("")))) > 0
    return a.groupBy(*keys).agg(
        F.coalesce(
            F.min_by(F.when(usable, F.col(code_col)), F.when(usable, F.col(attempt_col))),
            F.max_by(F.col(code_col), F.col(attempt_col)),
        ).alias(code_col)
    )

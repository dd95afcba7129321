"""Multi-step code evaluation rules as Column expressions (SURVEY H20-H22,
H36, G6)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalcat.functions.text import strip


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def all_close(a, b, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Element-wise |a - b| <= atol + rtol * |b|; arrays of different
    length are not close (``zip_with`` alone would pad with nulls)."""
    a, b = _c(a), _c(b)
    ok = F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= F.lit(atol) + F.lit(rtol) * F.abs(y)), lambda t: t)
    return F.coalesce((F.size(a) == F.size(b)) & ok, F.lit(False))


def verdict(text) -> Column:
    """Verdict file text -> struct(passed, error)."""
    t = _c(text)
    detail = F.regexp_replace(F.substring(t, 5, 1 << 30), r"^\n+", "")
    return F.struct(
        (t == "PASS").alias("passed"),
        F.when(t == "PASS", F.lit(""))
        .when(t == "TIMEOUT", F.lit("timed out (no verdict)"))
        .when(t.startswith("FAIL"), F.when(detail != "", detail).otherwise(F.lit("assertion failed or runtime error")))
        .otherwise(F.lit("assertion failed or runtime error"))
        .alias("error"),
    )


def tally_text(passed, total, failed_list) -> Column:
    """``PASS\\np/t sub-steps passed`` or
    ``FAIL\\np/t sub-steps passed; failed steps: a, b``."""
    p, t, f = _c(passed), _c(total), _c(failed_list)
    head = F.format_string("%d/%d sub-steps passed", p, t)
    return F.when(F.size(f) > 0, F.concat(F.lit("FAIL\n"), head, F.lit("; failed steps: "), F.array_join(f, ", "))).otherwise(
        F.concat(F.lit("PASS\n"), head)
    )


def step_prompt(context, description, background, header, return_line, with_background: bool = True) -> Column:
    """One sub-step prompt: prior context, the step description, the
    background when enabled and non-blank, then the function header and
    return line, joined by blank lines (empty parts dropped)."""
    bg = F.when(F.lit(with_background) & (F.length(strip(F.coalesce(_c(background), F.lit("")))) > 0), _c(background))
    parts = F.array(_c(context), _c(description), bg, _c(header), _c(return_line))
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), "\n\n")


def allowed_modules(declared, safe, denied) -> Column:
    """(declared U safe) - denied."""
    return F.array_except(F.array_union(_c(declared), _c(safe)), _c(denied))

"""Text helpers as native Column expressions (SURVEY H10, H14, H19, H42, H44,
H45, H47). All run inside whole-stage codegen; no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip()/str.isspace() treat as
# whitespace, which the reference's strip relies on:
# TAB, LF, VT, FF, CR, FS, GS, RS, US, SPACE, NEL, NBSP, OGHAM SPACE MARK,
# EN QUAD .. HAIR SPACE, LINE SEPARATOR, PARAGRAPH SEPARATOR,
# NARROW NBSP, MEDIUM MATHEMATICAL SPACE, IDEOGRAPHIC SPACE.
WS_CODEPOINTS = (
    [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680]
    + list(range(0x2000, 0x200B))
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
WS_CHARS = "".join(chr(c) for c in WS_CODEPOINTS)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(col) -> Column:
    """Unicode strip (Python ``str.strip()`` semantics): trims the
    whitespace set from both ends (``trim`` with a character set touches
    only the ends, unlike a regex over the whole text)."""
    return F.trim(_c(col), F.lit(WS_CHARS))


def strip_sql(expr: str) -> str:
    """The oracle-side twin of :func:`strip`."""
    chars = " || ".join(f"chr({c})" for c in WS_CODEPOINTS)
    return f"trim({expr}, {chars})"


def squash(col, n: int = 140) -> Column:
    """Collapse whitespace runs to one space, then keep the first n chars."""
    return F.substring(F.regexp_replace(_c(col), r"\s+", " "), 1, n)


def last_line(col) -> Column:
    """Last line of a trimmed traceback text ("" for blank input)."""
    return F.try_element_at(F.split(strip(col), "\n"), F.lit(-1))


def normalize_url(col, suffix: str = "/chat/completions") -> Column:
    """H14 (evaluation client form): drop trailing slashes; append ``suffix``
    unless the URL already ends with it."""
    trimmed = F.regexp_replace(_c(col), "/+$", "")
    return F.when(trimmed.endswith(suffix), trimmed).otherwise(F.concat(trimmed, F.lit(suffix)))


def api_base_url(col) -> Column:
    """H14 (catalog CLI form): strip a trailing ``/v1/chat/completions[/]``
    and make sure the result ends with exactly one added ``/`` when missing."""
    base = F.regexp_replace(_c(col), r"/v1/chat/completions/?$", "")
    return F.when(base.endswith("/"), base).otherwise(F.concat(base, F.lit("/")))


def command_error(col) -> Column:
    """Error detail of a failed command's output: the ``err="..."``
    value, else a dial/connection-refused/timeout phrase (any case, to the
    end of its line), else the first line of the trimmed output."""
    c = strip(_c(col))
    quoted = F.regexp_extract(c, r'err="([^"]+)"', 1)
    conn = F.regexp_extract(c, r"(?i)(dial tcp[^\n]+|connection refused[^\n]+|i/o timeout[^\n]*)", 1)
    first = F.split(c, "\n").getItem(0)
    return F.coalesce(F.nullif(quoted, F.lit("")), F.nullif(conn, F.lit("")), first)


def api_error(col) -> Column:
    """Error message of an API body: ``.error`` (string, or its
    ``.message``), else ``.message``, else the raw text."""
    c = _c(col)
    err_msg = F.get_json_object(c, "$.error.message")
    err = F.get_json_object(c, "$.error")
    err_str = F.when(err.isNotNull() & ~err.startswith("{"), err)
    return F.coalesce(err_msg, err_str, F.get_json_object(c, "$.message"), c)


def strip_imports(col) -> Column:
    """Blank out top-level ``import ...`` / ``from ... import ...`` lines
    (multiline regex; leading whitespace before the statement goes too)."""
    return F.regexp_replace(_c(col), r"(?mdU)^\s*(import .*|from .*\s+import\s+.*)", "")


# Line terminators recognised by Python's str.splitlines().
_LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"


def split_lines(col) -> Column:
    """``str.splitlines()``: split on any line break, no trailing empty piece."""
    c = F.regexp_replace(_c(col), f"({_LINE_BREAK})$", "")
    return F.when(_c(col) == "", F.array().cast("array<string>")).otherwise(F.split(c, _LINE_BREAK, -1))


def strip_package_imports(col, package: str) -> Column:
    """H19 (fixture form): drop lines that import ``package``, keep the rest."""
    pat = rf"(?U)^\s*(from|import)\s+{package}\b.*"
    lines = F.filter(split_lines(col), lambda x: ~x.rlike(pat))
    return F.array_join(lines, "\n")


def last_code_block(col) -> Column:
    """The last non-empty fenced block of the response (```python fences
    when there are any, else any fence; if every block is blank the last
    block), else the raw text; then H19 import stripping."""
    c = _c(col)
    py = F.regexp_extract_all(c, F.lit(r"(?sU)```python\b[ \t]*\r?\n?(.*?)```"), 1)
    anyb = F.regexp_extract_all(c, F.lit(r"(?s)```[ \t]*\r?\n?(.*?)```"), 1)
    blocks = F.when(F.size(py) > 0, py).otherwise(anyb)
    filled = F.filter(blocks, lambda x: F.length(strip(x)) > 0)
    script = (
        F.when(F.size(blocks) == 0, c)
        .when(F.size(filled) > 0, F.try_element_at(filled, F.lit(-1)))
        .otherwise(F.try_element_at(blocks, F.lit(-1)))
    )
    return strip_imports(script)

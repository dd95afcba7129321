"""Text quality by a sparse rule ensemble.

Statistics of a text (numpy on batches of texts) feed shallow boosted trees;
every path from a root to a node becomes a rule, a conjunction of threshold
tests; a logistic regression with an L1 penalty keeps few of them; and these are
compiled into one Spark column expression over the statistics.

Labels are only used of rows for which ``crc32(text of doc_id) % 5 != 0``; the
fit takes at most ``fit_rows`` of these, those with the smallest hashes, in one
task, from their statistics; only the rules reach the driver.

Edge cases: a null text is empty; statistics of an empty text are 0 and it gets
a score like any other; a null doc_id isn't held out and has no label; of
several labels of a doc_id the largest counts; repeated rows are each scored;
without labels of both kinds every score is the share of ones (0.5 without
any); an empty table gives an empty result.
"""

from __future__ import annotations

import math
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalcat.llm.common import learned, text_rows

FIT_ROWS = 20_000
Rule = tuple[tuple[str, bool, float], ...]  # (statistic, above, threshold), ...


STATISTICS = (
    "size", "words", "lines", "word_size", "line_size", "distinct_words", "distinct_lines", "long_words", "short_words",
    "capitals", "digits", "marks", "stops", "odd_marks", "bars", "shouts", "blanks",
)
_CAPITAL, _DIGIT, _BLANK, _STOP, _QUOTE, _BAR, _SHOUT, _MARK = range(1, 9)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Kind of each code point; 0: other letters and numbers."""
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        kind = unicodedata.category(c)
        if kind == "Lu":
            out[i] = _CAPITAL
        elif c.isspace():
            out[i] = _BLANK
        elif kind[0] not in "LN":
            out[i] = _MARK
    for kind, marks in ((_DIGIT, "0123456789"), (_STOP, ".,;:?"), (_QUOTE, "'\"()-"), (_BAR, "|"), (_SHOUT, "!")):
        out[[ord(c) for c in marks]] = kind
    return out


def statistics_of(text: str) -> tuple[float, ...]:
    """STATISTICS of a text; a long one is worked on segment by segment."""
    from evalcat.llm.textcache import segments

    kinds = np.zeros(9, np.int64)
    words = long = short = 0
    seen = np.zeros(0, np.int64)
    for part in segments(text):
        kinds += np.bincount(_kinds()[np.frombuffer(part.encode("utf-32-le", "replace"), "<u4")], minlength=9)
        found = part.split()
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        words, long, short = words + len(found), long + int((sizes > 12).sum()), short + int((sizes < 4).sum())
        own = np.fromiter(map(hash, set(found)), np.int64)
        seen = np.union1d(seen, own) if len(seen) else own
    lines = [line for line in text.split("\n") if line]
    per = lambda a, b: a / b if b else 0.0
    n, marks = len(text), int(kinds[_STOP:].sum())
    return (
        math.log1p(n), math.log1p(words), math.log1p(len(lines)), per(n, words), math.log1p(per(n, len(lines))),
        per(len(seen), words), per(len(set(lines)), len(lines)), per(long, words), per(short, words),
        *(per(int(k), n) for k in (kinds[_CAPITAL], kinds[_DIGIT], marks, kinds[_STOP], marks - kinds[_STOP] - kinds[_QUOTE], kinds[_BAR], kinds[_SHOUT], kinds[_BLANK])),
    )


def statistics(text: Column) -> Column:
    """A struct of the STATISTICS of a non-null text. Only the texts go to
    Python; other columns of the row stay where they are."""

    def run(texts: pa.Array) -> pa.Array:
        got = np.array([statistics_of(t) for t in texts.to_pylist()], np.float64).reshape(-1, len(STATISTICS))
        return pa.StructArray.from_arrays([pa.array(column) for column in got.T], names=list(STATISTICS))

    return F.arrow_udf(run, ", ".join(f"{n} double" for n in STATISTICS))(text)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def _tree(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray], depth: int, least: int) -> list[tuple]:
    """Nodes (path, rows, value) of one regression tree on gradients, the root
    left out. A path is a tuple of (column, above, threshold)."""
    out, todo = [], [((), np.arange(len(x)))]
    gain_of = lambda g, h: g * g / (h + 1.0)
    while todo:
        path, rows = todo.pop()
        if path:
            out.append((path, rows, -grad[rows].sum() / (hess[rows].sum() + 1.0)))
        if len(path) == depth:
            continue
        best, g, h = (1e-6, None, None), grad[rows], hess[rows]
        for c, points in enumerate(cuts):
            if not len(points):
                continue
            bin_ = np.searchsorted(points, x[rows, c])  # x <= points[i] iff bin <= i
            gs, hs, ns = (np.cumsum(np.bincount(bin_, w, len(points) + 1))[:-1] for w in (g, h, None))
            gain = gain_of(gs, hs) + gain_of(g.sum() - gs, h.sum() - hs) - gain_of(g.sum(), h.sum())
            gain[(ns < least) | (len(rows) - ns < least)] = 0
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), c, float(points[i]))
        if best[1] is not None:
            above = x[rows, best[1]] > best[2]
            todo += [((*path, (best[1], True, best[2])), rows[above]), ((*path, (best[1], False, best[2])), rows[~above])]
    return out


def boosted_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 40, depth: int = 3, rate: float = 0.3) -> list[Rule]:
    cuts = [np.unique(np.quantile(x[:, c], np.linspace(0.01, 0.99, 64))) for c in range(x.shape[1])]
    f = np.full(len(y), np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        nodes = _tree(x, p - y, p * (1 - p), cuts, depth, max(5, len(y) // 500))
        for path, rows, value in nodes:
            rules[tuple((names[c], above, t) for c, above, t in path)] = None
            if not any(other[: len(path)] == path and len(other) > len(path) for other, _, _ in nodes):
                f[rows] += rate * value
    return list(rules)


def holds(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, above, t in rule:
        out &= (x[:, names.index(name)] > t) == above
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept: accelerated proximal gradient descent."""
    n, k = z.shape
    w = v = np.zeros(k + 1)
    design = np.column_stack([z, np.ones(n)])
    step = 4 * n / max(1e-9, np.linalg.norm(design, 2) ** 2)
    t = 1.0
    for _ in range(steps):
        grad = design.T @ (1 / (1 + np.exp(-(design @ v))) - y) / n
        new = v - step * grad
        new[:k] = np.sign(new[:k]) * np.maximum(0, np.abs(new[:k]) - step * penalty)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w[:k], float(w[k])


def rules_of(y: np.ndarray, x: np.ndarray, penalty: float) -> tuple[list[tuple[Rule, float]], float]:
    """(rules with weights, intercept) of labels and rows of STATISTICS."""
    if y.min() == y.max():
        return [], float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    names = list(STATISTICS)
    rules = boosted_rules(x, y, names)
    z = np.column_stack([holds(r, x, names) for r in rules]).astype(np.float64) if rules else np.zeros((len(y), 0))
    w, b = lasso_logistic(z, y, penalty)
    return [(r, float(v)) for r, v in zip(rules, w) if v], b


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS, penalty: float = 5e-4) -> tuple[list[tuple[Rule, float]], float]:
    """(rules with weights, intercept). docs: doc_id, text; labels: doc_id and
    ``label`` (0 or 1; others don't count)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    known = known.where(~held_out(F.col("doc_id"), 5, 0)).groupBy("doc_id").agg(F.max("y").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id")).limit(fit_rows)  # at most fit_rows rows, two numbers each
    rows = text_rows(docs).join(F.broadcast(known), "doc_id")
    rows = rows.select("doc_id", F.col("y").cast("double").alias("y"), statistics(F.col("text")).alias("stats")).select("doc_id", "y", "stats.*")
    some = rows.orderBy(F.xxhash64("doc_id"), *STATISTICS).limit(fit_rows)
    return learned(some, lambda t: rules_of(t.column("y").to_numpy(), np.column_stack([t.column(n).to_numpy() for n in STATISTICS]), penalty)) or ([], 0.0)


def compiled(model: tuple[list[tuple[Rule, float]], float], stats: dict[str, Column]) -> Column:
    """The model as a column expression over columns of statistics."""
    rules, b = model
    total = F.lit(b)
    for rule, weight in rules:
        test = F.lit(True)
        for name, above, t in rule:
            test = test & (stats[name] > F.lit(t) if above else stats[name] <= F.lit(t))
        total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` with a column quality_score in (0, 1); columns of that name in
    ``docs`` are replaced."""
    model = fit(docs, labels, fit_rows=fit_rows)
    kept = [c for c in docs.columns if c != "quality_score"]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    wide = docs.select(row, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select("row", statistics(F.col("text")).alias("stats"))
    return wide.select(*[F.col("row")[c].alias(c) for c in kept], compiled(model, {n: F.col("stats")[n] for n in STATISTICS}).alias("quality_score"))

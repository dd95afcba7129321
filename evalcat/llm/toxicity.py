"""Toxic text by a subsequence string-kernel support vector machine.

Two strings are alike as far as they share subsequences of ORDER letters, each
occurrence weighing DECAY**(span): gaps and inserted characters lower the
kernel, they don't end it. With ``m`` landmark strings the Nystrom map turns a
string into m features, on which a linear support vector machine is trained by
dual coordinate descent; its weights fold back into one weight per subsequence
(the landmarks' subsequences only), so a string is scored by summing over its
own subsequences and dividing by its norm.

What is scored are runs of characters between blanks, letters only, and runs of
single letters put together; runs beyond WINDOW letters by overlapping windows.
A sentence or document scores as its highest run; a logistic curve fitted on
the training documents turns that into 0 to 1.

Training: sentences of labelled documents. All sentences of a document without
the label are negative. In a toxic document, those are positive which hold a
witness: a run that is many times likelier in toxic documents than elsewhere
(copies of a text count once), and later the run the machine itself scores
highest. Each round
adds the negative sentences' highest runs. At most ``fit_docs`` documents of
either label are used, those with the smallest hashes among rows for which
``crc32(text of doc_id) % 3 != 1``; one task learns from them, and only the
machine reaches the driver.

Edge cases: a null or empty text scores as a text without letters; a null
doc_id isn't held out and has no label; of several labels of a doc_id the
largest counts; repeated rows are each scored; without labels of both kinds
every score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalcat.llm.common import learned, text_rows
from evalcat.llm.quality import held_out

ORDER, DECAY, WINDOW, STEP, LETTERS = 3, 0.6, 24, 8, 64
FIT_DOCS = 3000
_SPELLED = re.compile(r"(?<!\w)(?:[^\W\d_][\W_]{1,3}){3,}[^\W\d_](?!\w)")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
#: The white space of ``textcache.SPACE``.
_BLANKS = re.compile(r"[\s\x00-\x1f\x7f-\x9f]+")
_SENTENCE = re.compile(r"[.!?\n]+\s")


def _letter(c: str) -> int:
    """a to z, or one of 38 codes for any other letter: those of one alphabet
    seldom share one (neighbours never do), accents tell."""
    return ord(c) - 97 if "a" <= c <= "z" else 26 + ord(c) % (LETTERS - 26)


def letters(run: str) -> bytes:
    """A run of characters as small letter codes."""
    return bytes(_letter(c) for c in _NOT_LETTERS.sub("", run.lower()))


def _block(codes: list[bytes]) -> np.ndarray:
    """Strings of one length as rows of letter codes."""
    return np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1).astype(np.int64)


def windows(code: bytes) -> list[bytes]:
    if len(code) <= WINDOW:
        return [code]
    return [code[s : s + WINDOW] for s in range(0, len(code) - WINDOW + STEP, STEP)]


@lru_cache(maxsize=64)
def _places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index triples of a string of n letters and their weights."""
    at = np.array(list(combinations(range(n), ORDER)), np.int64).reshape(-1, ORDER)
    return at, DECAY ** (at[:, -1] - at[:, 0] + 1.0) if len(at) else np.zeros(0)


def _coordinates(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strings of one length (rows of letter codes): per occurrence its
    coordinate, and the weights."""
    at, weight = _places(block.shape[1])
    code = np.zeros((len(block), len(at)), np.int64)
    for k in range(ORDER):
        code = code * LETTERS + block[:, at[:, k]]
    return code, weight


def _norms(code: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """sqrt of each string's kernel with itself: occurrences of one coordinate
    add up before they are squared."""
    order = np.argsort(code, axis=1, kind="stable")
    ranked = np.take_along_axis(code, order, axis=1)
    sums = np.cumsum(weight[order], axis=1)
    last = np.ones(code.shape, bool)
    last[:, :-1] = ranked[:, 1:] != ranked[:, :-1]
    upto = np.where(last, sums, 0.0)
    before = np.maximum.accumulate(np.concatenate([np.zeros((len(code), 1)), upto[:, :-1]], axis=1), axis=1)
    return np.sqrt((np.where(last, sums - before, 0.0) ** 2).sum(axis=1))


def explicit(code: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and normalised values of one string."""
    c, w = _coordinates(_block([code]))
    coords, back = np.unique(c[0], return_inverse=True)
    values = np.bincount(back, w, len(coords)) if len(coords) else np.zeros(0)
    return coords, values / max(1e-12, float(np.sqrt(values @ values)))


def decisions(weights: np.ndarray, codes: list[bytes]) -> np.ndarray:
    """sum of weights over a string's normalised coordinates; 0 for strings
    of fewer than ORDER letters."""
    out = np.zeros(len(codes))
    sizes = np.fromiter(map(len, codes), np.int64, len(codes))
    for n in np.unique(sizes):
        if n < ORDER:
            continue
        of = np.flatnonzero(sizes == n)
        step = max(1, 400_000 // len(_places(int(n))[0]))
        for s in range(0, len(of), step):
            rows = of[s : s + step]
            c, w = _coordinates(_block([codes[i] for i in rows]))
            out[rows] = (weights[c] @ w) / _norms(c, w)
    return out


def run_scores(weights: np.ndarray, runs: list[str]) -> list[list[float]]:
    cut = [windows(letters(r)) for r in runs]
    flat = decisions(weights, [w for c in cut for w in c])
    first = np.cumsum([0, *map(len, cut)])[:-1]
    return np.maximum.reduceat(flat, first)[:, None].tolist() if len(flat) else []


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s]


def runs_of(sentence: str) -> list[str]:
    return [*filter(None, _BLANKS.split(sentence)), *_SPELLED.findall(sentence)]


def kernel(a: list[bytes], b: list[bytes]) -> np.ndarray:
    rows = [explicit(t) for t in b]
    place = np.zeros(LETTERS**ORDER, np.int64)  # 0: in no string of b
    some = np.unique(np.concatenate([c for c, _ in rows])) if rows else np.zeros(0, np.int64)
    place[some] = np.arange(1, len(some) + 1)
    dense = np.zeros((len(b), len(some) + 1))
    for i, (c, v) in enumerate(rows):
        dense[i, place[c]] = v
    out = np.zeros((len(a), len(b)))
    for i, s in enumerate(a):
        c, v = explicit(s)
        out[i] = dense[:, place[c]] @ v
    return out


def machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, passes: int = 30) -> tuple[np.ndarray, float]:
    """Linear support vector machine (hinge loss, cost per row) by dual
    coordinate descent; the last weight belongs to a constant feature."""
    z = np.column_stack([x, np.ones(len(x))])
    a, w, q = np.zeros(len(z)), np.zeros(z.shape[1]), (z * z).sum(axis=1)
    rng = np.random.default_rng(7)
    for _ in range(passes):
        for i in rng.permutation(len(z)):
            old = a[i]
            a[i] = min(cost[i], max(0.0, old - (y[i] * (w @ z[i]) - 1) / q[i]))
            if a[i] != old:
                w += (a[i] - old) * y[i] * z[i]
    return w[:-1], float(w[-1])


def without_copies(texts: list[str]) -> list[str]:
    """Texts that don't share two of their six smallest word triples (by hash)
    with one before: every copy of a text would vouch for all its words."""
    from evalcat.llm.textcache import in_slices, shingle_hashes, word_hashes

    seen, out = set(), []
    for a, b in in_slices(texts):
        words, n = word_hashes(texts[a:b])
        triples, n = shingle_hashes(words, n, 3)
        ends = np.cumsum(n)
        for i in range(a, b):
            low = np.unique(triples[ends[i - a] - n[i - a] : ends[i - a]])[:6].tolist()
            if sum(h in seen for h in low) < 2:
                out.append(texts[i])
                seen.update(low)
    return out


def witnesses(toxic: list[np.ndarray], clean: list[np.ndarray], least: int = 4) -> dict:
    """Strings (by number, each once a document) many times likelier in toxic
    documents than elsewhere, with their numbers of toxic documents."""
    count, seen = (np.bincount(np.concatenate(d)) for d in (toxic, clean))
    seen = np.pad(seen, (0, max(0, len(count) - len(seen))))[: len(count)]
    odds = 8.0 * len(toxic) / max(1, len(clean))
    out = {int(s): int(count[s]) for s in np.flatnonzero((count > 0) & (count >= np.maximum(least, odds * (seen + 2))))}
    return dict(sorted(out.items(), key=lambda kv: (-kv[1], kv[0])))


def train(toxic: list[str], clean: list[str], landmarks: int = 400, rounds: int = 4) -> tuple[np.ndarray, float, float]:
    """(weight per coordinate, slope, offset of the logistic curve)."""
    known: dict[str, list] = {}
    number: dict[bytes, int] = {}
    sets = []  # per document the numbers of the strings in its sentences, in ascending order
    for text in [*toxic, *clean]:
        own = set()
        for sentence in sentences(text):
            for run in runs_of(sentence):
                if run not in known:
                    known[run] = [number.setdefault(w, len(number)) for w in windows(letters(run)) if len(w) >= ORDER]
                own.update(known[run])
        sets.append(np.array(sorted(own), np.int32))
    strings = list(number)
    pos, neg = sets[: len(toxic)], sets[len(toxic) :]
    seeds = witnesses(pos, neg)
    seeds = {strings[i]: n for i, n in seeds.items()}
    clean_runs = np.unique(np.concatenate(neg)).astype(np.int64)
    negatives = dict.fromkeys(strings[i] for i in np.random.default_rng(7).permutation(clean_runs)[:4000])
    positives = dict(seeds)
    weights, b = np.zeros(LETTERS**ORDER), 0.0
    scores = np.zeros(len(strings))
    for _ in range(rounds):
        marks = [*list(positives)[: landmarks // 2], *list(negatives)[: landmarks // 2]]
        if not positives:
            break
        gram = kernel(marks, marks)
        value, vector = np.linalg.eigh(gram)
        keep = value > 1e-6 * value.max()
        root = vector[:, keep] / np.sqrt(value[keep])
        rows = [*positives, *negatives]
        y = np.array([1.0] * len(positives) + [-1.0] * len(negatives))
        cost = np.full(len(y), 20.0)
        w, b = machine(kernel(rows, marks) @ root, y, cost)
        beta, weights = root @ w, np.zeros(LETTERS**ORDER)
        for v, t in zip(beta, marks):
            c, x = explicit(t)
            weights[c] += v * x
        # the highest run of every negative sentence, the best witness of every toxic document
        scores = decisions(weights, strings)
        for i in clean_runs[np.argsort(-scores[clean_runs], kind="stable")[:1500]]:
            negatives.setdefault(strings[i])
        order = dict(zip(negatives, decisions(weights, list(negatives))))
        negatives = dict.fromkeys(sorted(order, key=lambda t: (-order[t], t)))  # the hardest become landmarks
        found = Counter()
        for own in pos:
            if len(own) and scores[own].max() + b > 0:
                found[strings[own[int(scores[own].argmax())]]] += 1
        positives = dict(seeds) | {s: n for s, n in found.items() if n >= 2 and s not in negatives}
    # documents score as their highest sentence; a logistic curve on that
    best = np.array([max(0.0, scores[d].max()) if len(d) else 0.0 for d in sets])
    y = np.array([1.0] * len(pos) + [0.0] * len(neg))
    p, q = np.zeros(2), np.column_stack([best, np.ones(len(best))])
    for _ in range(50):  # Newton with a ridge, so that separable data has a curve too
        m = 1 / (1 + np.exp(-np.clip(q @ p, -30, 30)))
        p = p - np.linalg.solve((q * (m * (1 - m))[:, None]).T @ q + 1e-2 * np.eye(2), q.T @ (m - y) + 1e-2 * p)
    return weights, float(p[0]), float(p[1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", fit_docs: int = FIT_DOCS) -> tuple[np.ndarray, float, float] | None:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    known = known.where(~held_out(F.col("doc_id"), 3, 1)).groupBy("doc_id").agg(F.max("y").alias("y"))
    kinds = []
    for y in (1, 0):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id")).limit(fit_docs)  # bounded
        rows = text_rows(docs).join(F.broadcast(some), "doc_id").select("y", F.xxhash64("doc_id").alias("h"), "text")
        kinds.append(rows.orderBy("h", "text").limit(fit_docs))

    def learn(rows: pa.Table) -> tuple[np.ndarray, float, float] | None:
        rows = sorted(zip(*(rows.column(c).to_pylist() for c in ("h", "text", "y"))))
        texts = [without_copies([t for _, t, y in rows if y == kind]) for kind in (1, 0)]
        return train(*texts) if all(texts) else None

    return learned(kinds[0].unionByName(kinds[1]), learn)


def score(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """``docs`` with a column toxicity_score; a column of that name is
    replaced."""
    kept = [c for c in docs.columns if c != "toxicity_score"]
    columns = [F.col(f"`{c}`") for c in kept]
    model = fit(docs, labels, fit_docs=fit_docs)
    if model is None:
        return docs.select(*columns, F.lit(0.0).alias("toxicity_score"))
    # a fixed number of coordinates
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[tuple]) -> Iterator:
        from evalcat.llm.textcache import ChunkCoder, in_slices

        weights, slope, offset = shared.value
        code = ChunkCoder(lambda runs: run_scores(weights, runs), np.float64, cut="blank_chunks")
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out = np.zeros(len(texts))
            for a, b in in_slices(texts):
                values, n = code(texts[a:b])
                if len(values):
                    some = np.flatnonzero(n)
                    out[a + some] = np.maximum(0.0, np.maximum.reduceat(values, (np.cumsum(n) - n)[some]))
                for i in range(a, b):
                    if spelled := _SPELLED.findall(texts[i]):
                        out[i] = max(out[i], *np.ravel(run_scores(weights, spelled)))
            p = 1 / (1 + np.exp(-np.clip(slope * out + offset, -60, 60)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=["row", "toxicity_score"])

    rows = docs.select(F.struct(*columns).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    scored = rows.mapInArrow(run, rows.select("row").schema.add("toxicity_score", "double"))
    return scored.select(*[F.col("row")[c].alias(c) for c in kept], "toxicity_score")

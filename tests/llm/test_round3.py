"""Neighbour graph, progressive clusters and filter audit against brute force,
and the edge cases of their docstrings."""

import hashlib
import re
from itertools import permutations

import numpy as np
import pytest

from evalcat.llm import filter_audit, neighbours, progressive

VECTORS = "vec_id long, embedding array<float>, rid string, node string"


def _brute_nearest(rows, every, k):
    """rows (id, list): per query row its k nearest (id, score)."""
    good = [(i, np.array(v, np.float64)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for a, (q, x) in enumerate(good):
        if q is not None and q % every == 0:
            found = [(-float(x @ y), i is None, i or 0, b) for b, (i, y) in enumerate(good) if b != a and len(y) == len(x)]
            out.append((q, [(None if none else i, -s) for s, none, i, _ in sorted(found)[:k]]))
    return out


def _answers(df):
    by = {}
    for r in df.collect():
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: [x[1:] for x in sorted(v)] for q, v in by.items()}


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rng = np.random.default_rng(5)
    near = rng.normal(size=(60, 8)).astype(np.float32)
    rows = [(i, near[i].tolist()) for i in range(60)]
    rows += [(100 + i, near[3].tolist()) for i in range(30)]  # copies: ties go to smaller ids
    rows += [(200, None), (220, []), (240, [0.0] * 8), (260, [float("nan")] * 8), (280, [1.0, None] + [0.0] * 6), (300, [float("inf")] + [0.0] * 7)]
    rows += [(320, [1.0, 2.0]), (321, [2.0, 1.0]), (340, [5.0] * 3), (None, near[4].tolist()), (-20, near[5].tolist()), (40, near[6].tolist())]
    return rows, spark.createDataFrame([(i, v, "r", "n") for i, v in rows], VECTORS)


def test_neighbours_of_one_block_are_exact(odd_vectors):
    rows, df = odd_vectors
    want = _brute_nearest(rows, 20, 5)
    got = neighbours.nearest(df, every=20, k=5).collect()
    assert sorted((r["query_id"], r["rank"]) for r in got) == sorted((q, n + 1) for q, f in want for n in range(len(f)))
    key = lambda q, n, i, s: (q, n, i is None, i or 0, round(s, 6))
    assert sorted(key(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(key(q, n + 1, i, s) for q, f in want for n, (i, s) in enumerate(f))
    assert not any(r["query_id"] == 340 for r in got)  # the only one of its length


def test_neighbours_of_an_empty_table(spark):
    assert neighbours.nearest(spark.createDataFrame([], VECTORS)).collect() == []
    assert neighbours.nearest(spark.createDataFrame([(0, None, "", "")], VECTORS)).collect() == []


@pytest.mark.parametrize("lengths", [False, True])
def test_graph_search_has_high_recall(spark, lengths):
    """Blocks far smaller than the table: what is found comes from rounds."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(12, 24))[rng.integers(0, 12, 4000)] * 0.7 + rng.normal(size=(4000, 24))
    if lengths:
        x *= rng.lognormal(0, 0.3, size=(4000, 1))
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = _answers(neighbours.nearest(df, every=40, k=10, block=200, neighbours=10, beam=24, orders=2))
    score = x.astype(np.float64) @ x.astype(np.float64).T
    hits = 0
    for q in range(0, 4000, 40):
        best = [i for i in np.lexsort((np.arange(4000), -score[q])) if i != q][:10]
        hits += len({i for i, _ in got[q]} & set(best))
        assert len(got[q]) == 10 and [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
        assert all(abs(s - score[q, i]) < 1e-9 for i, s in got[q])
    assert hits / 1000 >= 0.9


def test_hadamard_keeps_distances():
    x = np.random.default_rng(1).integers(-2000, 2000, size=(50, 64))
    y = progressive.hadamard(x)
    assert ((y[:1] - y) ** 2).sum(axis=1).tolist() == (64 * ((x[:1] - x) ** 2).sum(axis=1)).tolist()
    assert (y[:, 0] == x.sum(axis=1)).all()


def test_progressive_search_equals_brute_force():
    rng = np.random.default_rng(2)
    c = rng.integers(-900, 900, size=(9, 64))
    c[4] = c[2]  # tie: the smaller number
    x = np.vstack([c[rng.integers(0, 9, 300)] + rng.integers(-400, 400, size=(300, 64)), c, (c[:4] + c[4:8]) // 2, np.full((1, 64), progressive.LARGEST), np.full((1, 64), -progressive.LARGEST)])
    d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    cluster, distance = progressive.nearest(x, c)
    assert cluster.tolist() == d.argmin(axis=1).tolist() and distance.tolist() == d.min(axis=1).tolist()


def _brute_clusters(rows, k, rounds):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) and abs(x) < 16384 for x in v)]
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cents = [v for _, v in order[:k]]
    assign = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents)) for _, v in kept]
    for _ in range(rounds):
        own = [j for _, j in assign()]
        for j in range(len(cents)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                cents[j] = [sum(col) // len(mine) for col in zip(*mine)]
    best = assign() if cents else []
    total = sum(d for d, _ in best)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i is None, i or 0), j, d, sum(e for e, o in best if o == j), total, sha[j]) for (i, _), (d, j) in zip(kept, best))


def test_clusters_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(5, 64))[rng.integers(0, 5, 150)] + 0.5 * rng.normal(size=(150, 64))).astype(np.float32)
    rows = [(i * 3, v) for i, v in enumerate(x.tolist())] + [(7, x[0].tolist()), (7, x[0].tolist()), (None, x[1].tolist()), (8, [0.0] * 64), (10, [3e38] * 64)]
    rows += [(9, None), (11, []), (12, [1.0] * 63), (13, [None] + [0.0] * 63), (14, [float("nan")] * 64), (15, [float("-inf")] * 64)]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, cluster string, distance string")
    got, centroids = progressive.cluster(df, k=8, rounds=10)
    key = lambda r: ((r["vec_id"] is None, r["vec_id"] or 0), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"])
    assert sorted(map(key, got.collect())) == _brute_clusters(rows, 8, 10) and len(centroids) == 8


def test_clusters_of_few_or_no_vectors(spark):
    two = [(1, [0.5] * 64), (2, [-0.25] * 64)]
    schema = "vec_id long, embedding array<double>"
    got, centroids = progressive.cluster(spark.createDataFrame(two, schema), k=8)
    assert len(centroids) == 2 and sorted(r["distance"] for r in got.collect()) == [0, 0]
    for rows in ([], [(None, [1.0] * 64)], [(1, None)]):
        assert progressive.cluster(spark.createDataFrame(rows, schema))[0].collect() == []


def _brute_audit(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    rows = []
    for doc, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        rows.append((source or "", doc, {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in docs),
        }))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        removed_of = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            alive = mine
            for step, name in enumerate(order, 1):
                gone = [r for r in alive if r[2][name]]
                alive = [r for r in alive if not r[2][name]]
                removed_of[name] += len(gone)
                fails = [r for r in mine if r[2][name]]
                out[part, "".join(order), step] = [len(alive), len(gone), len(fails) - len(gone), sum(sum(r[2].values()) == 1 for r in fails), sum(r[1] in good for r in gone), sum(r[1] in toxic for r in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed_of[order[step - 1]])
    return out


def test_audit_against_brute_force(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)] + ["#x", "A|B", "SHOUT", "a b", "c d", "\U0001d400Z"]
    docs = []
    for i in range(160):
        n = int(rng.choice([0, 5, 199, 200, 230]))
        text = " \t\n\x0b\r"[i % 5].join(rng.choice(words[: int(rng.choice([40, 400, 406]))], n))
        docs.append((i, text, ["web", "book", None, ""][i % 4]))
    docs += [(200 + i, docs[i % 7][1], "web") for i in range(40)] + [(5, docs[5][1], "book"), (3, "  ", "odd"), (None, docs[2][1], "web"), (None, None, None), (900, None, "web"), (901, "", "book")]
    docs += [(902, "y" * 300_000, "long"), (903, "Y z " * 50_000, "long")]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 240, 2)] + [(4, 1, 1), (4, 0, None), (None, 1, 1), (9999, 1, 1)]
    df = spark.createDataFrame([(*d, "x", "y", 1) for d in docs], "doc_id long, text string, source string, part string, cell string, n int")
    lab = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, good string")
    got = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in filter_audit.audit(filter_audit.document_cells(df, lab)).collect()}
    assert got == _brute_audit(docs, labels)
    assert filter_audit.audit(filter_audit.document_cells(df.limit(0), lab)).count() == 0
    alone = filter_audit.audit(filter_audit.document_cells(df, lab.limit(0))).agg({"good_lost": "max", "toxic_lost": "max"}).first()
    assert list(alone) == [0, 0]


def test_mixed_group_of_near_copies_has_brute_force_classes(spark):
    """1,500 edited copies of one text, similar to each other on both sides of
    0.8, some sharing an edit: classes equal those of all pairs."""
    from evalcat.llm import near_dup

    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(1500):
        words = list(base)
        for _ in range(int(rng.integers(0, 7))):
            words[int(rng.integers(0, 150))] = f"e{rng.integers(0, 40)}" if i % 3 == 0 else f"u{i}x{rng.integers(0, 999)}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(df)[1].collect()}
    common = near_dup.common_buckets(df.select("text"), len(texts))
    s, w, n = near_dup.weighted_sets(texts, common)
    names, at = np.unique(s, return_inverse=True)
    weights = np.zeros((len(texts), len(names)), np.float32)
    weights[np.repeat(np.arange(len(texts)), n), at] = w
    total = weights.sum(axis=1)
    label = np.arange(len(texts))
    links = []
    for i in range(len(texts)):
        both = np.minimum(weights[i], weights).sum(axis=1)
        links.append(np.flatnonzero(both / (total[i] + total - both) >= 0.8))
    while True:
        low = np.array([label[x].min() for x in links])
        if (low == label).all():
            break
        label = low
    assert [got[i] for i in range(len(texts))] == label.tolist()
    assert 1 < len(set(label.tolist())) < 1400  # both sides are there


def test_cells_bound_what_documents_share(spark, monkeypatch):
    """Near copies with edits of their own: cells never rule out a link, and rule out most pairs that totals can't."""
    from itertools import combinations

    import numpy as np

    from evalcat.llm import near_dup as N

    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(40):
        words = list(base)
        for at in rng.choice(30, 4, replace=False):
            words[at * 5] = f"x{rng.integers(3)}"
        texts.append(" ".join(words))
    none = (np.array([], np.int64), np.array([]))
    s, w, n = N.weighted_sets(texts, none)
    ends = np.cumsum(n)
    sets = [dict(zip(s[e - k : e].tolist(), w[e - k : e].tolist())) for e, k in zip(ends, n)]
    df = spark.createDataFrame(list(enumerate(texts)), "rid long, text string")
    for per in (500, 0.2):  # one part of all cells, then several parts to a cell
        monkeypatch.setattr(N, "sized_partitions", lambda rows, _, per=per: max(1, int(rows / per)))
        rows = {r.rid: r for r in N._shared_weights(df.select("rid"), df, none).collect()}
        for i, own in enumerate(sets):
            elsewhere = {x for j, other in enumerate(sets) if j != i for x in other}
            assert abs(rows[i].weight - sum(own.values())) < 1e-9 and abs(rows[i].shared - sum(v for x, v in own.items() if x in elsewhere)) < 1e-9
            assert len(rows[i].cells) == N.CELLS and abs(sum(rows[i].cells) - rows[i].shared) < 1e-9
        by_total = by_cell = 0
        for i, j in combinations(range(40), 2):
            a, b = rows[i], rows[j]
            real = sum(min(v, sets[j][x]) for x, v in sets[i].items() if x in sets[j])
            total, cells = min(a.shared, b.shared), sum(map(min, a.cells, b.cells))
            assert real <= cells + 1e-9 and cells <= total + 1e-9
            reach = lambda both, a=a, b=b: both >= (a.weight + b.weight - both) * 0.8
            by_total, by_cell = by_total + reach(total), by_cell + reach(cells)
        assert by_cell < by_total / 2

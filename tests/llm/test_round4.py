"""Components and near duplicates over few rows dealt to many partitions."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalcat.llm import components, near_dup


@pytest.fixture
def many_partitions(spark):
    put = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in put}
    for k, v in put.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _watched(monkeypatch, module, made):
    def staged(df, name, *a, _of=module.staged, **k):
        out = _of(df, name, *a, **k)
        made.append((name, len(out.inputFiles())))
        return out

    monkeypatch.setattr(module, "staged", staged)


@pytest.mark.parametrize("per_task", [9, 10_000])
def test_components_of_contracted_parts(spark, monkeypatch, many_partitions, per_task):
    """A chain, a star, loops, repeats and random edges, in many parts or one: smallest nodes as by union-find."""
    rng = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(30)] + [(500, 400 + i) for i in range(20)] + [(7, 7), (900, 900), (3, 2), (2, 3)]
    edges += [(int(a), int(b)) for a, b in rng.integers(1000, 1060, (40, 2))]
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    made = []
    _watched(monkeypatch, components, made)
    monkeypatch.setattr(components, "EDGES", per_task)
    got = components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, top(x)) for x in root if top(x) != x)
    if per_task > len(edges):
        assert made == [("components", 1)]  # few edges: one task, no rounds
    else:
        assert max(n for _, n in made) <= 2 * -(-len(edges) // per_task)
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_few_documents_write_few_files(spark, monkeypatch, many_partitions):
    """No file for each of the shuffle's partitions; near copies come together, others don't."""
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join([*base[:k], f"x{i}", *base[k + 1 :]]) for i, k in enumerate(range(0, 120, 4))]
    texts += [" ".join(f"o{i}x{j}" for j in range(60)) for i in range(60)]
    made = []
    _watched(monkeypatch, near_dup, made)
    rows = near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))[1].collect()
    assert {r.doc_id: r.class_id for r in rows} == {i: 0 if i < 30 else i for i in range(90)}
    assert {"bands", "bucket-members", "compared", "class-members"} <= {name for name, _ in made}
    assert max(n for name, n in made if name not in ("documents", "text-keys")) == 1


def test_small_cells_bound_what_documents_share(spark):
    """Rounded up to small numbers, cells rule out no link, and most pairs that totals can't."""
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(60):
        words = list(base)
        for at in rng.choice(30, 4 if i % 6 else 1, replace=False):
            words[at * 5] = f"x{rng.integers(3)}"
        texts.append(" ".join(words))
    none = (np.array([], np.int64), np.array([]))
    s, w, n = near_dup.weighted_sets(texts, none)
    ends = np.cumsum(n)
    sets = [(s[e - k : e], w[e - k : e]) for e, k in zip(ends, n)]
    df = spark.createDataFrame(list(enumerate(texts)), "rid long, text string")
    shared = near_dup._shared_weights(None, df, none)
    rows = shared.drop("cells").join(near_dup._small_cells(shared), "rid")
    other = rows.select(*[F.col(c).alias(f"x_{c}") for c in rows.columns])
    pairs = rows.join(other, F.col("rid") < F.col("x_rid")).where(near_dup._can_reach("", "x_", 0.8))
    by_total = pairs.count()
    kept = {(r.rid, r.x_rid) for r in pairs.where(near_dup._can_share("", "x_", 0.8)).select("rid", "x_rid").collect()}
    linked = {(i, j) for i, j in combinations(range(60), 2) if near_dup.similarity(sets[i], sets[j]) >= 0.8}
    assert linked and linked <= kept and len(kept) < by_total / 2

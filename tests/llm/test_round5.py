"""What learns from labels does so in a task: the driver gets the model alone."""

import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalcat.llm import common, quality, toxicity


@pytest.fixture
def labelled(spark):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("aeionrtsdlmu"), 6)) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words, 40)) + (" blockhead ### $$$" if i % 4 == 0 else "") + ".", int(i % 4 == 0)) for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int").withColumn("quality", F.col("toxic"))


def test_only_the_model_reaches_the_driver(spark, monkeypatch, labelled):
    """No rows to learn from come to the driver, whatever their number."""
    frame, taken = type(labelled), []

    def never(self, *a, **k):
        raise AssertionError("rows gathered on the driver")

    def collect(self, _of=frame.collect):
        out = _of(self)
        taken.append(len(out))
        return out

    for name in ("toPandas", "toArrow", "toLocalIterator"):
        monkeypatch.setattr(frame, name, never)
    monkeypatch.setattr(frame, "collect", collect)
    assert toxicity.fit(labelled, labelled) is not None and quality.fit(labelled, labelled)[0]
    assert taken == [1, 1]


def test_training_is_in_no_process_of_the_driver(monkeypatch, labelled):
    monkeypatch.setattr(toxicity, "train", lambda toxic, clean: os.getpid())
    assert toxicity.fit(labelled, labelled) != os.getpid()


def test_the_task_learns_what_the_rows_say(labelled):
    rows = labelled.where(~quality.held_out(F.col("doc_id"), 3, 1)).orderBy(F.xxhash64("doc_id"), "text").collect()
    weights, slope, offset = toxicity.train(*(toxicity.without_copies([r.text for r in rows if r.toxic == y]) for y in (1, 0)))
    got = toxicity.fit(labelled, labelled)
    np.testing.assert_allclose(got[0], weights, atol=1e-9)
    np.testing.assert_allclose(got[1:], (slope, offset), rtol=1e-6)


def test_learned_of_no_rows(spark):
    assert common.learned(spark.range(0), lambda t: t.num_rows) is None
    assert common.learned(spark.range(7).repartition(3), lambda t: t.num_rows) == 7


def test_witnesses_against_counting():
    rng = np.random.default_rng(4)
    toxic, clean = ([np.unique(rng.integers(0, most, 6)).astype(np.int32) for _ in range(n)] for most, n in ((40, 60), (25, 90)))
    toxic[3] = clean[5] = np.zeros(0, np.int32)
    count, seen = (Counter(i for d in x for i in d.tolist()) for x in (toxic, clean))
    want = {i: n for i, n in count.items() if n >= max(4, 8.0 * 60 / 90 * (seen[i] + 2))}
    got = toxicity.witnesses(toxic, clean)
    assert got == want and list(got) == sorted(want, key=lambda i: (-want[i], i)) and want

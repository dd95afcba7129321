import json

import pytest

from evalcat.functions import scoring as S
from evalcat.operators import catalog as C
from evalcat.sources import files as SRC


def test_query_tool_dataset_six_rows(spark, tmp_path):
    """A1 + H8: six rows, the sixth multi-turn -> 6 examples, one with 3 messages,
    whose transcript is role-prefixed lines; single-prompt rows keep their text."""
    rows = [
        {"example_id": i, "prompt": f"Question {i} about the catalog?", "expected_output": f"Answer {i}."} for i in range(1, 6)
    ] + [
        {
            "example_id": 6,
            "messages": [
                {"role": "user", "content": "How many items in total?"},
                {"role": "assistant", "content": "There are 3503 items."},
                {"role": "user", "content": "Of those, how many are in the first group?"},
            ],
            "expected_output": "1297.",
        }
    ]
    p = tmp_path / "tool_examples.jsonl"
    p.write_text("\n".join(json.dumps(r) for r in rows) + "\n")
    ex = SRC.read_examples(spark, str(p))
    got = {r.example_id: (len(r.messages), r.t) for r in ex.select("example_id", "messages", S.transcript("messages").alias("t")).collect()}
    assert len(got) == 6
    assert got[1] == (1, "Question 1 about the catalog?")
    assert got[6][0] == 3
    assert got[6][1] == (
        "user: How many items in total?\nassistant: There are 3503 items.\nuser: Of those, how many are in the first group?"
    )


def test_manifest_reference_errors(spark):
    """H35 + C27: a manifest with a malformed reference fails, one with an
    unknown artifact only in strict mode."""
    cfg = spark.createDataFrame([("a", 0, "4k", "1")], "artifact string, entry_pos int, ss string, bs string")
    refs = spark.createDataFrame([("m", "4k", "a:1", None), ("m", "4k", "no-version", None)],
                                 "model string, size_key string, ref string, batch_sizes array<int>")
    for strict in (True, False):
        with pytest.raises(ValueError):
            C.resolve_refs(refs, cfg, strict=strict)
    unknown = spark.createDataFrame([("m", "4k", "zz:2", None)], "model string, size_key string, ref string, batch_sizes array<int>")
    with pytest.raises(ValueError):
        C.resolve_refs(unknown, cfg, strict=True)
    assert C.resolve_refs(unknown, cfg).count() == 0


def test_latest_version_numeric_not_text(spark):
    from evalcat.functions.catalog import latest_version

    df = spark.createDataFrame([(["5", "10"],), (["9", "x", "12abc"],), ([],)], "k array<string>")
    assert [r[0] for r in df.select(latest_version("k")).collect()] == ["10", "12", "1"]

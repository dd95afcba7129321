"""Helpers that need no session: packed numbers and statistics of texts."""

import numpy as np
import pytest

from evalcat.llm import lm_score, quality, textcache


@pytest.mark.parametrize("values", [[], [0], [1, 1, 2, 255, 256], [2**64 - 1, 0, 2**63]])
def test_packed_numbers_round_trip(values):
    got = lm_score.unpacked(lm_score.packed(np.array(values, np.uint64)), len(values))
    assert got.tolist() == values


def test_statistics_of_short_texts():
    assert set(quality.statistics_of("")) == {0.0}
    got = dict(zip(quality.STATISTICS, quality.statistics_of("Ab cd cd 1|!\n\nAb cd cd 1|!")))
    assert got["distinct_words"] == 3 / 8 and got["distinct_lines"] == 0.5
    assert got["bars"] == got["shouts"] == got["digits"] == got["capitals"] == 2 / 26
    assert got["marks"] == got["odd_marks"] == 4 / 26 and got["blanks"] == 8 / 26 and got["stops"] == 0


def test_statistics_dont_depend_on_segments(monkeypatch):
    text = " ".join(f"Word{i % 97}, {i % 13}!" + "\n" * (i % 11 == 0) for i in range(2000))
    whole = quality.statistics_of(text)
    monkeypatch.setattr(textcache, "SEGMENT", 500)
    assert quality.statistics_of(text) == whole

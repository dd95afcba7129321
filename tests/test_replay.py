"""Replay of a recorded evaluation run through the result scan (A5) and the
model summary (D3): the per-model figures must equal the code-completion
names are replaced by neutral ones, outputs shortened (they do not enter
the summary except through the ERROR prefix)."""

import math

from evalcat.operators.summary import summarize_models
from evalcat.sources import files as SRC

ROWS = [
    # result_id, model, example_id, input_tokens, output_tokens, latency_ms, ttft_ms, tps
    (1, "model-a", 1, 91, 78, 598.656177520752, 334.9745273590088, 292.0188035563641),
    (2, "model-a", 2, 89, 91, 747.4188804626465, 521.1184024810791, 397.7013252589359),
    (3, "model-a", 3, 88, 93, 650.6392955780029, 334.9745273590088, 291.4484265034434),
    (4, "model-a", 4, 89, 138, 704.2694091796875, 334.9745273590088, 370.9772508207252),
    (5, "model-a", 5, 82, 88, 346.6498851776123, 120.21064758300781, 384.20903075003554),
    (6, "model-b", 1, 98, 9, 1621.3703155517578, 1564.241647720337, 140.03477244746782),
    (7, "model-b", 2, 98, 1, 1617.9242134094238, 1564.241647720337, 0),
    (8, "model-b", 3, 93, 7, 859.7517013549805, 808.762788772583, 117.67264089627471),
    (9, "model-b", 4, 98, 7, 1621.450662612915, 1564.241647720337, 104.87857571514303),
    (10, "model-b", 5, 87, 2, 890.5792236328125, 839.357852935791, 19.52310112736108),
    (11, "model-c", 1, 110, 7, 121.1400032043457, 98.5419750213623, 265.5098910142114),
    (12, "model-c", 2, 106, 1, 113.60979080200195, 101.31168365478516, 0),
    (13, "model-c", 3, 107, 7, 121.11115455627441, 97.87344932556152, 258.20105472677653),
    (14, "model-c", 4, 108, 7, 118.00265312194824, 94.99382972717285, 260.76952728327774),
    (15, "model-c", 5, 101, 2, 123.54707717895508, 101.04775428771973, 44.44578198349034),
]

# model -> (mean score, median latency, median ttft, median tps, sum in, sum out), as published
EXPECTED = {
    "model-a": (1.0, 650.6, 335.0, 371.0, 439, 488),
    "model-b": (1.0, 1617.9, 1564.2, 104.9, 474, 26),
    "model-c": (1.0, 121.1, 98.5, 258.2, 532, 24),
}


def test_recorded_run_summary(spark, tmp_path):
    header = "result_id,status,provider,model,example_id,output,score,weight,score_reason,input_tokens,output_tokens,latency_ms,ttft_ms,tps,num_llm_calls\n"
    lines = [
        f'{rid},completed,prov,{m},{ex},"\n\nanswer {ex}",1,1,,{i},{o},{lat!r},{tt!r},{tps!r},1\n'
        for rid, m, ex, i, o, lat, tt, tps in ROWS
    ]
    p = tmp_path / "results.csv"
    p.write_text(header + "".join(lines))
    s = {r.model: r for r in summarize_models(SRC.read_results(spark, str(p))).collect()}
    assert set(s) == set(EXPECTED)
    for m, (mean, lat, ttft, tps, sin, sout) in EXPECTED.items():
        r = s[m]
        assert r.n == 5 and r.errors == 0 and math.isclose(r.score_sum / r.n, mean)
        assert round(r.median_latency_ms, 1) == lat and round(r.median_ttft_ms, 1) == ttft and round(r.median_tps, 1) == tps
        assert (r.sum_input_tokens, r.sum_output_tokens) == (sin, sout)
        assert r.median_calls == 1.0 and r.score_pct == 100.0

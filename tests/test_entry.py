import duckdb
import pytest

import __spark_entry__ as entry
from evalcat.session import TABLES

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and "median_latency_ms" in df.columns


def test_oracle_keys_are_registered():
    qs, orc = entry.queries(), entry.oracle_sql()
    assert set(orc) <= set(qs)
    assert len(qs) >= 100


@pytest.mark.parametrize("name", ["d3_d4_summarize_models", "h1_h2_h3_h4_heuristic_scores", "c13_model_configs", "d6_h21_tally_steps"])
def test_flagship_queries_match_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sdf = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(sdf.columns)

    def norm(rows, order):
        return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in order)) for r in rows)

    srows = [r.asDict() for r in sdf.collect()]
    drows = [dict(zip(cols, r)) for r in cur.fetchall()]
    assert norm(srows, cols) == norm(drows, cols)

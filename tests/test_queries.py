"""Contract of the entry file; the full comparison with SQL is tools/verify.py."""

import duckdb
import pytest

import __spark_entry__ as entry

PICKED = ["d1_nano_score", "f4_chain_score", "h2_auroc", "j2_domain_rollup", "k3_sign", "i10_guardrails"]
TABLES = "events conversations labels lineitem customer nation orders documents embeddings pages".split()


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "mean_risk" in df.columns


def test_registry_is_consistent():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 150


@pytest.mark.parametrize("name", PICKED)
def test_against_sql(spark, base, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{base}/{t}.parquet'")
    got = entry.queries()[name](spark, base)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(got.columns)
    norm = lambda r: tuple(round(v, 5) if isinstance(v, float) else v for v in r)
    assert sorted(map(norm, got.select(*cols).collect()), key=str) == sorted(map(norm, cur.fetchall()), key=str)

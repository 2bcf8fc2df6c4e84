"""The driver contract: entry(), queries() and oracle_sql() agree, and a sample of queries
matches its DuckDB oracle on sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from evalspark.sources.tables import TABLES

from .conftest import SF001

SAMPLE = ["pm_summary_by_lang", "pm3_bleu", "ev9_pairwise_winner", "lg9_performance_by_model", "rg2_list_prompts",
          "sa2_stratified_sample", "hs1_moving_average", "tx3_complexity", "si4_similarity_join", "si12_pareto_front",
          "cl5_fill_mode", "vp7_profile_numeric"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "bleu" in df.columns


def test_oracles_are_a_subset():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) > 150


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    s = E.queries()[name](spark, SF001).toPandas()
    o = con.sql(E.oracle_sql()[name]).df()
    assert sorted(s.columns) == sorted(o.columns)
    cols = sorted(s.columns)

    def norm(df):
        out = []
        for rec in df[cols].itertuples(index=False, name=None):
            out.append(tuple(None if (isinstance(v, float) and v != v) else (round(v, 6) if isinstance(v, float) else str(v))
                             for v in rec))
        return sorted(out, key=repr)
    assert norm(s) == norm(o)

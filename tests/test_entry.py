"""Driver contract: entry() runs; every oracle has a query; a fast subset matches DuckDB at sf0.001."""
import duckdb
import pytest

import __spark_entry__ as E
from tabreg.sources.tables import TABLES

from conftest import SF_SMALL

FAST = ["regression_metrics", "describe_numeric", "column_summary", "corr_target", "histogram", "deployment_rank",
        "history_latest", "domain_check", "split_cover", "prep_linear", "quantiles", "dimension_upsert"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"model", "split", "n", "mae", "mse", "rmse", "r2"}
    assert df.count() == 10


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 100


def _norm(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", FAST)
def test_oracle_subset(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    sp = E.queries()[name](spark, SF_SMALL).toPandas()
    dk = con.execute(E.oracle_sql()[name]).fetchdf()
    assert sorted(sp.columns) == sorted(dk.columns)
    cols = sorted(sp.columns)
    a = sorted(tuple(_norm(x) for x in r) for r in sp[cols].astype(object).where(sp[cols].notna(), None).itertuples(index=False))
    b = sorted(tuple(_norm(x) for x in r) for r in dk[cols].astype(object).where(dk[cols].notna(), None).itertuples(index=False))
    assert a == b

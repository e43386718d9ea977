"""Registered queries against their SQL on the small tables.

``TIDEMARK_QUERIES=all`` runs every query; by default one in each family does.
"""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as spark_entry
from tools.check_oracle import TABLES, close, rows_of

FOLDER = Path("/root/testdata/sf0.001")
SAMPLE = """annual_trend_forecast flux_long_to_wide fact_quantiles anti_resume interp_linear obs_rolling obs_interp detrend_deseason mann_kendall mann_kendall_obs
theil_sen composite_comparison bh_adjust cp_split_obs segmented_fit multiple_ols time_series_cv granger_lag1 var_differences bootstrap_trend_band
spectral_coherence segment_flux point_in_polygon quantile_regression filename_fields""".split()
CHOSEN = list(spark_entry.oracle_sql()) if os.environ.get("TIDEMARK_QUERIES") == "all" else SAMPLE

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, db, name):
    df = spark_entry.queries()[name](spark, str(FOLDER))
    cursor = db.execute(spark_entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    got, want = rows_of(df.columns, df.collect()), rows_of(names, cursor.fetchall())
    assert len(got) == len(want) > 0
    for g, w in zip(got, want):
        assert all(close(a, b) for a, b in zip(g, w)), (g, w)


def test_entry_runs(spark):
    assert spark_entry.entry(spark).count() == 25

"""Every query with an equivalent in DuckDB, compared value by value at the smallest scale."""

import duckdb
import pandas as pd
import pytest

from panelweave.catalog.oracles import ORACLES
from panelweave.catalog.queries import QUERIES

MODELS = {"fit_horizons", "forecast_long", "backtest_f1_scores", "fit_forest_baseline"}


def test_every_query_but_the_models_has_an_oracle():
    assert set(QUERIES) - set(ORACLES) == MODELS


def canonical(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        kept = frame[c]
        if kept.dtype.kind == "M" or c in ("month", "date", "day", "fold") and kept.dtype == object:
            frame[c] = pd.to_datetime(kept).astype("datetime64[ns]")
        elif kept.dtype == object or str(kept.dtype).startswith(("Int", "Float", "str")):
            number = pd.to_numeric(kept, errors="coerce")
            frame[c] = number.astype(float) if number.notna().sum() == kept.notna().sum() else kept.astype(object)
        else:
            frame[c] = kept.astype(float)
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in ("orders", "customer", "lineitem", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want) > 0
    pd.testing.assert_frame_equal(canonical(got), canonical(want), check_dtype=False, atol=1e-6)


@pytest.mark.parametrize("name", ["assemble_panel", "history_block", "peer_stats", "threshold_curve"])
def test_plans_stay_in_the_jvm(spark, sf_dir, name):
    text = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "CartesianProduct" not in text and "NestedLoop" not in text

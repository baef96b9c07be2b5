"""Round trips are the identity."""

from panelkit.session import scratch_path
from panelkit.sources import storage
from panelkit.sources import tables as T

from tests.conftest import SF_SMALL


def _rows(df):
    return sorted((r.geo_id, r.year, r.variable, r.value) for r in df.collect())


def test_json_and_parquet_roundtrip(spark):
    panel = T.supplier_year_panel(spark, SF_SMALL)
    p = scratch_path(spark, "t-json")
    storage.save_panel_json(panel, p)
    assert _rows(storage.load_panel_json(spark, p)) == _rows(panel)
    q = scratch_path(spark, "t-parquet")
    storage.save_panel_parquet(panel, q)
    back = storage.load_panel_parquet(spark, q)
    assert _rows(back) == _rows(panel)
    one_year = back.where("year = 1997")
    plan = one_year._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "(year" in plan


def test_load_features_reports_coverage(spark):
    panel = T.customer_year_panel(spark, SF_SMALL)
    p = scratch_path(spark, "t-features")
    storage.save_panel_json(panel, p)
    records, years, missing = storage.load_features(spark, p, ["n_orders", "sum_price"], (1990, 2010))
    present = sorted(r.year for r in years.collect())
    assert present == list(range(1995, 2002))
    assert sorted(r.year for r in missing.collect()) == [y for y in range(1990, 2011) if y not in present]
    assert records.columns == ["geo_id", "year", "n_orders", "sum_price"]
    assert records.count() == panel.select("geo_id", "year").distinct().count()

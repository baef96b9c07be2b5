"""Registered queries: fast ones against their DuckDB oracle at sf0.01, all of
them free of Python UDF nodes, and the entry point."""

import math

import pytest

import __spark_entry__ as E
from panelkit.plans.catalog import all_queries
from tests.conftest import SF_MID, SF_SMALL

FAST = ["summary_stats", "yearly_distribution", "geo_delta_topn", "year_counts", "years_per_geo",
        "longest_run", "consecutive_year_filter", "missing_years", "merge_last_wins", "union_tables",
        "extract_features", "feature_record", "fill_zero", "ratio_feature", "cell_normalise",
        "numeric_validity", "geo_region", "hash_sample", "pairwise_bins", "winsorize", "quantile_clip",
        "histogram50", "kde_curve", "silhouette_score", "silhouette_euclidean", "silhouette_euclidean_score", "elbow_from_starts", "assign_fixed_centroids", "eps_neighbours", "dbscan_labels", "dbscan_grid",
        "cluster_profile", "zscore_outliers", "panel_json_roundtrip"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in recs)


SURVEY_QUERIES = """acs_scan year_from_path panel_json_roundtrip missing_years summary_csv_roundtrip
panel_parquet_roundtrip cell_normalise drop_moe ragged_rows geo_key geo_state geo_region feature_filter
feature_record numeric_validity extract_features flatten_z fill_zero zscore_outliers quantile_clip
consecutive_year_filter standardize_per_year standardize_wide merge_last_wins eps_neighbours year_counts
years_per_geo longest_run summary_stats yearly_distribution geo_delta_topn describe_features
describe_per_year year_feature_moments cluster_profile dbscan_grid winsorize zscore silhouette_samples
hash_sample union_tables histogram50 histogram_clipped30 histogram_by_year kde_curve pairwise_bins
feature_matrix pca_scores kmeans_labels kmeans_centroids assign_fixed_centroids silhouette_score
elbow_curve dbscan_labels dbscan_grid_profile ratio_feature panel_clusters""".split()
ROWS_ONLY = {"pca_scores", "kmeans_labels", "kmeans_centroids", "elbow_curve",
             "dbscan_grid_pca", "panel_clusters"}


def test_every_inventory_query_is_registered():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert set(SURVEY_QUERIES) <= set(q)
    own = all_queries()
    assert set(own) <= set(q)
    assert {name for name, (_fn, sql) in own.items() if not sql} == ROWS_ONLY


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_MID)
    res = duck.sql(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(res.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(list(res.columns), res.fetchall())


def test_no_python_udf_in_plans(spark):
    for name in ["standardize_per_year", "describe_per_year", "cell_normalise", "geo_region", "kde_curve",
                 "silhouette_samples", "histogram_by_year"]:
        plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["geo_id", "year", "variable", "raw_winsorized", "z"]


def test_registry_imports_without_a_session():
    import subprocess
    import sys
    code = ("import sys; sys.path.insert(0, '.'); import __spark_entry__ as E; "
            "from panelkit.plans.catalog import all_queries as a; "
            "print(set(a()) <= set(E.queries()), set(E.oracle_sql()) <= set(E.queries()), "
            "{n for n, (_, s) in a().items() if s} <= set(E.oracle_sql()))")
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120,
                         cwd=__import__("os").path.dirname(E.__file__))
    assert out.returncode == 0, out.stderr[-2000:]
    assert out.stdout.split() == ["True"] * 3

"""The plans are the intended ones (what explain shows)."""

import pytest

from panelkit.plans.catalog import all_queries
from panelkit.plans.inspect import physical_plan, plan_facts

from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def queries():
    return {name: fn for name, (fn, _sql) in all_queries().items()}


def test_no_cartesian_or_python_anywhere(spark, queries):
    skip = {"elbow_curve", "dbscan_grid_pca", "panel_clusters", "kmeans_centroids"}
    for name, fn in queries.items():
        if name in skip:
            continue
        f = plan_facts(fn(spark, SF_SMALL))
        assert f["cartesian"] == 0, name
        # pair work of the spatial partitioning is done on Arrow batches inside tasks
        assert f["python_udf"] == 0 or name in {"eps_neighbours"}, name
        assert f["unreduced_single_partition"] == 0, name


def test_flagship_scores_rows_through_broadcast_only(spark, queries):
    f = plan_facts(queries["standardize_per_year"](spark, SF_SMALL))
    assert f["broadcast_joins"] >= 1 and f["sort_merge_joins"] == 0
    assert f["windows"] == 0 and f["hash_exchanges"] == 0


def test_top_n_is_bounded(spark, queries):
    f = plan_facts(queries["geo_delta_topn"](spark, SF_SMALL))
    assert f["take_ordered"] == 1


def test_scan_reads_only_used_columns(spark, queries):
    f = plan_facts(queries["summary_stats"](spark, SF_SMALL))
    assert f["read_schemas"] and "RoundRobin" not in physical_plan(queries["summary_stats"](spark, SF_SMALL))
    for schema in f["read_schemas"]:
        assert "l_returnflag" not in schema and "l_partkey" not in schema

"""End-to-end run on a derived ACS tree: both clusterers, year filter."""

import pytest

from panelkit.plans.flow import run_flow
from panelkit.plans.queries_io import T1, T2, _acs_tree

from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def tree(spark):
    return _acs_tree(spark, SF_SMALL)


@pytest.mark.parametrize("cluster", ["kmeans", "dbscan"])
def test_run_flow(spark, tree, cluster):
    out = run_flow(spark, tree, year=1997, cluster=cluster, variables=T1 + T2, file_glob="*.txt",
                   k=3, pca_k=3, eps=1.5, min_samples=3)
    wide = out["wide"].count()
    labels = out["labels"]
    assert labels.count() == wide > 0
    assert labels.where("year <> 1997").count() == 0
    assert out["profile"].count() >= 1
    assert set(out["profile"].columns) == {"cluster", *T1, *T2}

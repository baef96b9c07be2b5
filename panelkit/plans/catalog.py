"""All registered queries (importing the modules registers them)."""

from __future__ import annotations

from panelkit.plans import queries, queries_cluster, queries_dist, queries_io  # noqa: F401


def all_queries():
    return dict(queries.REGISTRY)

"""Registered queries of the text operators: name -> (function, DuckDB SQL or None)."""

from __future__ import annotations

from panelkit.llm import queries_model, queries_text, queries_vectors, queries_web


def text_queries() -> dict:
    return {**queries_text.REGISTRY, **queries_model.REGISTRY, **queries_web.REGISTRY, **queries_vectors.REGISTRY}

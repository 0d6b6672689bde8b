"""All registered queries, gathered from the query modules."""

from __future__ import annotations


def _modules():
    from tabspark.plans import q_blend, q_features, q_io, q_model, q_profile

    return [q_features, q_profile, q_blend, q_model, q_io]


def all_queries() -> dict:
    out = {}
    for m in _modules():
        out.update(m.QUERIES)
    return out


def all_sql() -> dict:
    out = {}
    for m in _modules():
        out.update(m.SQL)
    return out

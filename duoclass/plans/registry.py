"""All registered queries and their oracles."""

from __future__ import annotations

from duoclass.plans import q_model, q_order, q_score, q_sources, q_stream


def all_queries() -> dict:
    out = {}
    for mod in _modules():
        out.update(mod.QUERIES)
    return out


def all_oracles() -> dict:
    out = {}
    for mod in _modules():
        out.update(getattr(mod, "ORACLE", {}))
    return out


def _modules():
    return [q_sources, q_score, q_order, q_model, q_stream]

"""All queries of the core, with their SQL where SQL can say the same."""

from __future__ import annotations

import importlib

_MODULES = ["graphloom.queries_general", "graphloom.queries_graph", "graphloom.queries_sample", "graphloom.queries_views"]


def collect(modules=_MODULES):
    queries, sql = {}, {}
    for m in modules:
        mod = importlib.import_module(m)
        queries.update(mod.QUERIES)
        sql.update(mod.SQL)
    return queries, sql

"""Registered queries: each binds one operator to the test tables."""

from __future__ import annotations

import importlib

from caseloom.catalog.registry import ORACLES, QUERIES

MODULES = ("scans", "filters", "scalars", "joins", "aggs", "windows", "topk", "text", "graph", "threads",
           "consensus", "exports", "streams")
for _name in MODULES:
    importlib.import_module(f"caseloom.catalog.{_name}")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)

"""All registered queries, collected from the plan modules."""

from __future__ import annotations

import functools
import importlib

from ..session import ship_package

MODULES = ("geometry", "matching", "signals", "census", "judging", "identities", "scoring", "ledgers",
           "documents", "selection", "association", "live", "registered")

def _shipped(fn):
    """Ship the package to the executors before a query builds its plan."""
    @functools.wraps(fn)
    def run(spark, sf_dir):
        ship_package(spark)
        return fn(spark, sf_dir)
    return run


QUERIES: dict = {}
ORACLE: dict = {}
for _name in MODULES:
    try:
        _m = importlib.import_module(f"trackspark.plans.{_name}")
    except ModuleNotFoundError as exc:
        if exc.name != f"trackspark.plans.{_name}":
            raise
        continue
    QUERIES.update({k: _shipped(f) for k, f in _m.QUERIES.items()})
    ORACLE.update(_m.ORACLE)

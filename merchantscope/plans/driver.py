"""Registry of all driver queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from merchantscope.plans import batch_queries, live_queries, mart_queries, ml_queries
from merchantscope.plans.workbench import Workbench

MODULES = (batch_queries, mart_queries, live_queries, ml_queries)


def all_queries() -> dict[str, Callable[[Workbench], DataFrame]]:
    out: dict[str, Callable[[Workbench], DataFrame]] = {}
    for module in MODULES:
        clash = out.keys() & module.QUERIES.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(module.QUERIES)
    return out

"""Independent SQL for every query that SQL can express (checked with DuckDB)."""

from __future__ import annotations


def all_sql() -> dict[str, str]:
    from oracle import batch, live, marts, ml

    return {**batch.ORACLE, **marts.ORACLE, **live.ORACLE, **ml.ORACLE}

"""The shared stages over the driver tables of a folder."""

from __future__ import annotations

from pyspark.sql import SparkSession

from merchantscope.plans.workbench import Workbench
from starbook.fixtures import StarFixture

_benches: dict[tuple[str, str], Workbench] = {}


def workbench(spark: SparkSession, folder: str) -> Workbench:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _benches:
        _benches[key] = Workbench(spark, StarFixture(spark, folder))
    return _benches[key]


def forget() -> None:
    """Drop the shared stages, so that the next query builds its own."""
    _benches.clear()

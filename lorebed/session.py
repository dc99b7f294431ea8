"""A session with the settings that the operators expect."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession


def session(app: str = "lorebed", master: str | None = None, **settings: str) -> SparkSession:
    """Adaptive execution, UTC and Arrow; sizes are the cluster's to set (``settings`` override everything)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.parquet.aggregatePushdown": "true",
    }
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


class Kept:
    """A value (a small list, a catalog) that is worked out again once it is older than ``seconds``; if that fails, the old one stays."""

    def __init__(self, make: Callable[[], Any], seconds: float, clock: Callable[[], float] = time.monotonic):
        self._make, self._seconds, self._clock = make, seconds, clock
        self._value, self._until = None, None

    def get(self) -> Any:
        if self._until is None or self._clock() >= self._until:
            try:
                self._value = self._make()
            except Exception:
                if self._until is None:
                    raise
            self._until = self._clock() + self._seconds
        return self._value

    def forget(self) -> None:
        self._until = None

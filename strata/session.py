"""Session settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}


def session(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName("strata")
    builder = builder.master(master) if master else builder
    for k, v in {**SETTINGS, **settings}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()

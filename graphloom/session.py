"""A session with the settings the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "graphloom", master: str | None = None, **conf: str) -> SparkSession:
    """UTC and adaptive execution; sizes and parallelism are left to the cluster unless given."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()

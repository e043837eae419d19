"""A session with the settings that the library's results assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "sparkloom", master: str | None = None, **conf: str) -> SparkSession:
    """UTC times and adaptive execution; further settings as keywords with dots as double underscores."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()

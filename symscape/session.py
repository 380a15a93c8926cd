"""A session with the settings that the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "symscape", **more: str) -> SparkSession:
    """On a cluster the master and memory come from spark-submit; only query settings are set here."""
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    return SparkSession.builder.appName(name).config(map=conf | {k.replace("__", "."): v for k, v in more.items()}).getOrCreate()

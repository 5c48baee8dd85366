"""The Spark session with the settings the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tessella", **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(name)
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.sources.partitionOverwriteMode": "dynamic", "spark.sql.execution.arrow.pyspark.enabled": "true", **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()

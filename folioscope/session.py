"""Session settings of the engine."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "folioscope", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive plans and UTC; sizes are left to the cluster unless given in conf."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.sources.partitionOverwriteMode": "dynamic", "spark.sql.mapKeyDedupPolicy": "LAST_WIN"}
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

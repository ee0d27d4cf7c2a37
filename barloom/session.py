"""Session settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution sizes the shuffles and picks broadcast joins from measured sizes;
# UTC keeps dates equal on every machine.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A strategy comparison has more generated classes than the default cache of 100 holds, and
    # every task would compile them again.
    "spark.sql.codegen.cache.maxEntries": "2000",
    # The JVM does not compile methods longer than this, so longer ones run uncompiled.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Metrics aggregate rows that their windows left sorted by key: stream them instead of
    # hashing objects.
    "spark.sql.execution.replaceHashWithSortAgg": "true",
}


def build_session(app: str = "barloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; `conf` overrides them (dots written as `__`)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

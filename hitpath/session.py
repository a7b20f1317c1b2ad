"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Everything here is a default: a setting the cluster already carries wins.
DEFAULTS = {
    # Timestamps are instants; text is rendered and parsed in UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Set the defaults above where the session has no explicit value."""
    explicit = {k for k, _ in spark.sparkContext.getConf().getAll()}
    for key, value in DEFAULTS.items():
        if key not in explicit:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, app: str = "hitpath", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

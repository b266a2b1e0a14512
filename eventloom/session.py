"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Settings that change results or plans. Everything else is left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS_AT_ONCE = 500


def get_session(app_name: str = "eventloom", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session with the library's settings; `conf` uses `__` for `.`."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():  # after the defaults, so that they can be overridden
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def small_batches(df: DataFrame) -> None:
    """Hand whole documents to Python a few hundred at a time, unless the session says otherwise.

    Spark's default of 10,000 rows is meant for short rows; with documents, two workers of an executor would hold some
    hundred megabytes of batches each.
    """
    conf = df.sparkSession.conf
    if conf.get(ARROW_ROWS) == "10000":
        conf.set(ARROW_ROWS, str(ROWS_AT_ONCE))

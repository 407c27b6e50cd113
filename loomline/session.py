"""A session with the settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Characters of a plan's text, which is for readers only.
PLAN_TEXT = 50_000


def session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> None:
    """Sets what the registered queries count on beside the session's own values.

    Kept tables read kept tables, and the text of a plan writes each of them out wherever it is read: megabytes, made anew on the driver
    after each stage. Shuffle files of a finished action are needed no more; else they pile up until the driver's garbage goes.
    """
    spark.conf.set("spark.sql.maxPlanStringLength", str(PLAN_TEXT))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")

"""Spark session with the settings this library is tested with."""
from __future__ import annotations

import os

from pyspark import SparkConf
from pyspark.sql import SparkSession


def get_spark(app: str = "assayframe", cpus: int | str | None = None, memory: str = "8g") -> SparkSession:
    """The running session, or a new one; what the submitter has set is left alone.

    Without a master from the submitter the session runs on this machine.
    """
    given = dict(SparkConf().getAll())  # spark-submit's settings
    builder = SparkSession.builder.appName(app)
    ours = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.showConsoleProgress": "false"}
    if "spark.master" not in given:
        cpus = cpus or os.environ.get("BENCH_CPUS", "8")
        ours |= {"spark.master": f"local[{cpus}]", "spark.driver.memory": memory, "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"}
    for name, value in ours.items():
        if name not in given:
            builder = builder.config(name, value)
    return builder.getOrCreate()

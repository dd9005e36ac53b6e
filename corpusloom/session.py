"""Session defaults for local runs; on a cluster the deployment's settings win."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(name: str = "corpusloom", cores: int | str = "*", **conf) -> SparkSession:
    cpus = os.cpu_count() if cores == "*" else int(cores)
    settings = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session

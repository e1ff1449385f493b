"""Session settings of the engine."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and ANSI semantics. Cluster settings win over these defaults."""
    builder = SparkSession.builder.appName("tessera")
    if master:
        cores = int(master.partition("[")[2].rstrip("]").replace("*", str(os.cpu_count())) or 1)
        builder = builder.master(master).config("spark.sql.shuffle.partitions", str(cores)).config("spark.ui.enabled", "false")
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return builder.config(map=defaults | conf).getOrCreate()

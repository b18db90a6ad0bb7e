"""Session settings."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def reach_package(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it.

    That serves workers that see the same path; elsewhere install the package or
    pass it with ``--py-files``.
    """
    env = spark.sparkContext.environment
    paths = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def build_session(name: str = "tessera", cpus: int | str = "*", shuffle_partitions: int | None = None, **conf: object) -> SparkSession:
    """A session with adaptive execution and the UTC time zone.

    On a cluster the master and memory come from the submit command; here only
    what the engine's results depend on is set.  Keyword arguments are further
    settings, with ``__`` for each dot.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings |= {k.replace("__", "."): str(v) for k, v in conf.items()}
    builder = SparkSession.builder.appName(name).config(map=settings)
    return reach_package(builder.master(f"local[{cpus}]").getOrCreate())

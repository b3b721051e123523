"""Session settings shared by tests, bench and interactive use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | str | None = None, **extra: str) -> SparkSession:
    """A local session with adaptive execution on and UTC time; ``extra`` overrides any setting."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    settings = {
        "spark.master": f"local[{cpus}]",
        "spark.app.name": "clausemill",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in extra.items()}
    return SparkSession.builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """The table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

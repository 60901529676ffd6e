"""Session defaults."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def get_session(app: str = "topicflow", master: str | None = None, **conf) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, wherever the driver was started from."""
    sc = spark.sparkContext
    if getattr(sc, "_topicflow_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="topicflow-package-")
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "topicflow"), "zip", root, "topicflow"))
    sc._topicflow_shipped = True

"""Sessions, and the package's code on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def local_session(threads: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that results depend on."""
    builder = SparkSession.builder.master(f"local[{threads}]").config("spark.sql.session.timeZone", "UTC")
    for key, value in {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"}.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application, so that Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="lexloom-code-"), "lexloom.zip")
        with zipfile.ZipFile(path, "w") as out:
            for folder, _, names in os.walk(top):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.relpath(full, os.path.dirname(top)))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark

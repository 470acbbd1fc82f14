"""Sessions: a local one for tests and benchmarks, and shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session in one JVM with adaptive execution, UTC and no UI."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tessera")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once a Spark context, so that their Python workers can import it."""
    context = spark.sparkContext
    if not getattr(context, "_tessera_shipped", False):
        root = Path(__file__).resolve().parent
        fd, name = tempfile.mkstemp(prefix="tessera-", suffix=".zip")
        os.close(fd)
        with zipfile.ZipFile(name, "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, Path(root.name) / path.relative_to(root))
        context.addPyFile(name)
        context._tessera_shipped = True
    return spark

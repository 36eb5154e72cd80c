"""What a Spark session needs before the library's Python functions run on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once a session, so that their workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_quarry_shipped", False):
        return spark
    home = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(home):
        path = os.path.join(tempfile.mkdtemp(prefix="quarry-ship-"), "quarry.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(home):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(home)))
        context.addPyFile(path)  # Spark serves it to every executor
    context._quarry_shipped = True
    return spark

"""Makes this package importable in the Python workers of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_MARK = "_quarry_shipped"


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the workers, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, _MARK, False):
        return
    setattr(sc, _MARK, True)
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    top = os.path.dirname(home)
    target = os.path.join(tempfile.mkdtemp(prefix="quarry-ship-"), "quarry_sources.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, top))
    sc.addPyFile(target)

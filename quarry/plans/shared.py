"""New folders where driver and executors both see them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"
_own: dict[str, str] = {}  # folders of local applications that name none


def new_folder(spark: SparkSession, label: str) -> str:
    """A path that no other call gets, under ``spark.checkpoint.dir``; only local masters may go without that setting."""
    root = spark.sparkContext.getConf().get(SETTING) or spark.conf.get(SETTING, None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"{SETTING} must name a folder shared by all executors")
        app = spark.sparkContext.applicationId
        root = _own.setdefault(app, "") or _own.update({app: f"file://{tempfile.mkdtemp(prefix='quarry-shared-')}"}) or _own[app]
    return f"{root.rstrip('/')}/quarry/{label}-{uuid.uuid4().hex[:12]}"

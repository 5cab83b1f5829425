"""Shared-folder tables that cut lineage and survive lost executors.

Every intermediate table is Parquet under the folder the cluster names in
``spark.checkpoint.dir``.  Only where that setting is absent *and* the master is
local (tests) does a temporary folder take its place.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
_own: dict[str, str] = {}  # folders of local applications


def shared_root(spark: SparkSession) -> str:
    """Folder that the driver and all executors see."""
    root = spark.sparkContext.getConf().get(SETTING) or spark.conf.get(SETTING, None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"{SETTING} must name a folder shared by all executors")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="quarry-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        root = f"file://{_own[app]}"
    return root.rstrip("/")


class Workspace:
    """Tables of one operator call, each written once and read back."""

    #: Where :func:`recorded` notes the workspaces that are opened.
    record: list[Workspace] | None = None

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.names: set[str] = set()
        if Workspace.record is not None:
            Workspace.record.append(self)
        self.root = f"{shared_root(spark)}/quarry/{label}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` under ``name`` and return a reader of what was written."""
        df.write.option("compression", "zstd").mode("overwrite").parquet(self.path(name))
        self.names.add(name)
        self.sweep()
        return self.read(name, df.schema)

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read
        return (reader.schema(schema) if schema is not None else reader).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        """Delete a table that nothing will read again; without a name, all of them."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.names.discard(name)

    def keep_only(self, *names: str) -> None:
        """Delete all tables but these, which the result still reads."""
        for name in self.names.difference(names):
            self.drop(name)

    def sweep(self) -> None:
        """Let Spark's cleaner see which shuffles are unreachable, so their files go now."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def recorded():
    """The workspaces opened inside, for a caller that knows when their tables are done with."""
    before, Workspace.record = Workspace.record, []
    try:
        yield Workspace.record
    finally:
        Workspace.record = before


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def row_id(*columns: str) -> Column:
    """128 bits that stand for a row."""
    return F.struct(F.xxhash64(*columns).alias("x"), F.xxhash64(F.lit("second"), *columns).alias("y"))

"""Written tables of one call, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_base(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir.  Where it is unset, a local master gets a temporary folder; any other is an error, as its machines share none."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spectrafold.shared.dir", "")
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spectrafold-")
        spark.conf.set("spectrafold.shared.dir", base)
    return base.rstrip("/")


#: Whether a finished query's shuffle files go at once, not when the driver collects its garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """Tables that cut lineage and survive lost executors; they go when they are dropped, at the latest with the session.

    A tidy one also removes the shuffle files of each table as soon as it is written.
    """

    def __init__(self, spark: SparkSession, name: str, tidy: bool = False):
        self.spark = spark
        self.tidy = tidy
        self.root = f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"
        self._marked = False

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _system(self, path: str) -> tuple:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def expire(self) -> None:
        """Lets the folder, which must exist, go when the session's JVM ends."""
        where, system = self._system(self.root)
        self._marked = self._marked or system.deleteOnExit(where)

    def save(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        before = self.spark.conf.get(_TIDY, "false")
        if self.tidy:
            self.spark.conf.set(_TIDY, "true")
        try:
            df.write.mode("overwrite").option("compression", compression).parquet(self.path(name))
        finally:
            if self.tidy:
                self.spark.conf.set(_TIDY, before)
        if not self._marked:
            self.expire()
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Removes the named tables, or the whole folder."""
        for path in map(self.path, names) if names else (self.root,):
            where, system = self._system(path)
            system.delete(where, True)

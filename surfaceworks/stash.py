"""Tables cut out of the lineage: written once to the folder that all executors share, read back from there."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only by a local session that names no spark.checkpoint.dir, as in tests.
LOCAL_DIR = "file:///tmp/checkpoints"
#: Whether shuffle files go when the query that wrote them has ended, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as a full URI; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = spark._jvm.org.apache.hadoop.fs.Path(named or LOCAL_DIR)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def new_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/surfaceworks-{label}-{uuid.uuid4().hex}"


class Stash:
    """Stashed tables of one run of an operator.

    A lost executor costs a re-read, never a recomputation of what came before. ``drop`` removes a
    table that nothing reads any more; the rest goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.n = spark, new_dir(spark, label), 0
        atexit.register(self._remove_all)

    def _remove_all(self) -> None:
        with contextlib.suppress(Exception):  # the JVM may have gone before
            self._delete(self.root)

    def _delete(self, where: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def put(self, df: DataFrame, codec: str = "zstd", tidy: bool = False) -> DataFrame:
        """Run df and give it back as a table; its path is in the attribute ``stash_path``. With ``tidy`` the files of its shuffles go at once."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        with self._tidied() if tidy else contextlib.nullcontext():
            df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.stash_path = path
        return out

    @contextlib.contextmanager
    def _tidied(self):
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            yield
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)

    def drop(self, df: DataFrame) -> None:
        self._delete(df.stash_path)


def held(df: DataFrame, label: str = "table", tidy: bool = False) -> DataFrame:
    """A table that several branches of a plan read, run once. Runs a job."""
    return Stash(df.sparkSession, label).put(df, tidy=tidy)

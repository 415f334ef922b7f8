"""Sinks. Spark's commit protocol makes each write all or nothing; none touches what an earlier run wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _beside(rows: DataFrame, *by: str):
    """A writer that replaces only the folders (by ``by``) that rows has something for."""
    return rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)


def _folder(spark: SparkSession, path: str):
    """(file system, path) in the JVM."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    fs, where = _folder(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def _run(rows: DataFrame, path: str) -> None:
    _beside(rows.repartition("run_date", "server_id"), "run_date", "server_id").json(path, ignoreNullFields=False)


def server_documents(rows: DataFrame, path: str) -> None:
    """One JSON document per server under its date: <path>/runs/run_date=<date>/server_id=<id>/; ``rows`` has run_date and server_id.

    Other dates, and other servers of the same date, stay as they are; a server's document of the same date is replaced.
    """
    _run(rows, f"{path}/runs")


def latest(spark: SparkSession, path: str) -> None:
    """The newest date's documents once more, as <path>/latest, for readers that want no date. Nothing is written if there is no run."""
    dates = [n.removeprefix("run_date=") for n in _names(spark, f"{path}/runs") if n.startswith("run_date=")]
    if dates:
        newest = max(dates)
        rows = spark.read.json(f"{path}/runs/run_date={newest}").withColumn("run_date", F.lit(newest))
        rows.write.mode("overwrite").json(f"{path}/latest", ignoreNullFields=False)


def trial_reports(reports: DataFrame, path: str) -> None:
    """Reports of ``frames.reports``, one JSON document per log; other logs' reports stay."""
    _beside(reports.withColumn("of", F.regexp_extract("log", "([^/]+)$", 1)).repartition("of"), "of").json(path, ignoreNullFields=False)


def query_sets(rows: DataFrame, path: str) -> None:
    """Query sets of the servers that have one, as <path>/queries/run_date=<date>/server_id=<id>/, beside the documents."""
    _run(rows.where("queries is not null"), f"{path}/queries")


def wire_pages(pages: DataFrame, path: str) -> None:
    """Pages (server, page_no, raw), verbatim, one per line in their order, one file for each server; other servers' files stay."""
    out = pages.repartition("server").sortWithinPartitions("server", "page_no")
    _beside(out.select("server", F.col("raw").alias("value")), "server").text(path)


def append_once(rows: DataFrame, path: str, batch: str, again: bool = False) -> bool:
    """Adds rows as a batch, in the folder <path>/batches/<batch>, and commits it as <path>/commits/<batch>; says whether it did.

    A batch that is committed isn't written again, unless ``again``, which replaces it. What a writer left that died
    before its commit isn't read, and is replaced when the batch comes again; of two writers of one batch, one commits.
    """
    spark = rows.sparkSession
    fs, commit = _folder(spark, f"{path}/commits/{batch}")
    if fs.exists(commit):
        if not again:
            return False
        fs.delete(commit, False)
    rows.write.mode("overwrite").parquet(f"{path}/batches/{batch}")
    return fs.createNewFile(commit)


def committed(spark: SparkSession, path: str, schema: StructType | str, but: str | None = None) -> DataFrame | None:
    """The rows of all committed batches but one; None if there are none."""
    batches = [b for b in _names(spark, f"{path}/commits") if b != but]
    return spark.read.schema(schema).parquet(*[f"{path}/batches/{b}" for b in batches]) if batches else None


def append_manifest(rows: DataFrame, path: str, batch: str) -> bool:
    """Adds rows once for each batch id (a run's id, say); read with ``committed``."""
    return append_once(rows, path, batch)


def summary(rows: DataFrame, path: str) -> None:
    """A summary, in one file; readers see the earlier one until the new one is whole, then only that."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def console_line(*columns: Column) -> Column:
    """Values separated by two blanks, absent ones as -."""
    return F.concat_ws("  ", *[F.coalesce(c.cast("string"), F.lit("-")) for c in columns])

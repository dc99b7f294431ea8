"""Jobs of several phases, each written before the next begins, so that a stopped job resumes where it was."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Phase = tuple[str, Callable[[SparkSession, DataFrame | None], DataFrame]]

#: What must run before what in a chain of jobs.
ORDER = {
    "metadata": ["backup"],
    "index": ["metadata"],
    "index_online": ["metadata"],
    "visualise": ["index"],
    "publish": ["index", "index_online"],
}


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def run(spark: SparkSession, folder: str, phases: list[Phase], progress: Callable[[int, int, str], None] | None = None) -> DataFrame:
    """Run phases in order; each one's table at ``folder`` is complete once Spark's commit file is there.

    ``progress`` is told (phases done, phases, name); a job group named by the folder lets ``cancel`` stop it.
    """
    spark.sparkContext.setJobGroup(folder, f"{len(phases)} phases", interruptOnCancel=True)
    last = None
    for k, (name, phase) in enumerate(phases):
        path = f"{folder.rstrip('/')}/{k:02d}-{name}"
        if not _exists(spark, f"{path}/_SUCCESS"):
            phase(spark, last).write.mode("overwrite").parquet(path)
        last = spark.read.parquet(path)
        if progress:
            progress(k + 1, len(phases), name)
    return last


def cancel(spark: SparkSession, folder: str) -> None:
    spark.sparkContext.cancelJobGroup(folder)

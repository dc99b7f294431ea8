"""What the operators of this subpackage share: tables, durable intermediates, session limits."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents that one Arrow batch holds at most, so that a batch of very long texts stays small.
DOCUMENTS_PER_BATCH = 1024

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Lower Spark's default of 10,000 records an Arrow batch; a value that the session names itself stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(DOCUMENTS_PER_BATCH))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset (local tests) a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        context = spark.sparkContext
        if not context.getCheckpointDir():
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="lorebed-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses; it is removed when the interpreter ends."""
    path = f"{shared_dir(spark)}/lorebed/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def durable(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, and what was drawn or numbered once stays as it is.
    """
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, label)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(schema).parquet(path)


def drawn(df: DataFrame, by: Column, size: int) -> DataFrame:
    """About ``size`` rows, or all if there aren't that many: those whose hash ``by`` (a long) is small enough."""
    n = df.count()
    return df.filter(F.shiftrightunsigned(by, 1) < F.lit(int(size / n * (2**63 - 1)))) if n > size else df


def sampled(df: DataFrame, by: Column, size: int) -> DataFrame:
    """The ``size`` rows that are least by a hash that tells rows apart. Only some more than that are ordered, however many tasks there are."""
    return drawn(df, by, 4 * size).orderBy(F.shiftrightunsigned(by, 1), by).limit(size)


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """``df`` marked for broadcast if it was counted to have at most ``most`` (narrow) rows; else as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def written() -> int:
    """How many intermediate tables there are; a mark for ``drop_written``."""
    return len(_written)


def drop_written(since: int = 0, last: int = 0) -> None:
    """Remove the intermediate tables that this process wrote from the mark ``since`` on, but for the ``last`` ones.

    A session that has been stopped can't remove its tables; they then stay for whoever clears the folder.
    """
    end = len(_written) - last
    gone, _written[since:end] = _written[since:end], []
    for spark, path in gone:
        if spark.sparkContext._jsc is None:
            continue
        with contextlib.suppress(Exception):  # what can't be removed is no failure of the job
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


atexit.register(drop_written)

"""Session helpers: the shared folder for cut lineage and intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A keyed table of at most this many rows may be broadcast (ids and small columns only).
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Without the setting, the folder given to ``setCheckpointDir``. A session in one
    process that has neither gets a temporary folder; a cluster without a folder is an
    error, since a machine-local one would be lost.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rebasis-"))
        return spark.sparkContext.getCheckpointDir().rstrip("/")
    raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


def exists(spark: SparkSession, path: str) -> bool:
    """Does ``path`` exist, on whatever file system it names? Lists no files."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier run has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def pin(df: DataFrame) -> DataFrame:
    """Cut lineage reliably; the result survives the loss of executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read it back.

    Unlike :func:`pin` the result keeps column pruning and filter pushdown, and
    directories by the columns ``by``.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, n_rows: int) -> DataFrame:
    """``df`` marked for broadcast if its counted or bounded rows allow it."""
    return F.broadcast(df) if n_rows <= BROADCAST_ROWS else df


def spread(scan: DataFrame, key: str) -> DataFrame:
    """A scan of fewer splits than the cluster has cores, redistributed by ``key``.

    Tables of many files or row groups, as any large one, come back untouched.
    Only for plain scans: their split count is known without running anything.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, key)

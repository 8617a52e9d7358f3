"""Where lineage is cut: the folder of spark.checkpoint.dir, which all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's folder; a folder of our own only in local mode (tests), where it is unset."""
    place, sc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not place:
        got = sc._jsc.sc().getCheckpointDir()
        if got.isEmpty():
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
            got = sc._jsc.sc().getCheckpointDir()
        place = got.get()
    return place.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read again; the files go when the driver's Python ends, the shuffles it took at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    freed(spark)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Delete what frames of ``written`` are read from, once nothing reads them any more."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _remove(df.sparkSession, path)


def freed(spark: SparkSession) -> None:
    """Shuffles of plans that are over go with the driver's objects that hold them."""
    spark.sparkContext._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session has ended; the folder's owner cleans up
        return

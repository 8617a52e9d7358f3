"""Reading inputs and cutting lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset (tests), one of our own."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        sc = spark.sparkContext
        got = sc._jsc.sc().getCheckpointDir()
        if got.isEmpty():
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
            got = sc._jsc.sc().getCheckpointDir()
        place = got.get()
    return place.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: lineage ends here.

    The files outlive a lost executor; they go when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str, name: str) -> DataFrame:
    """As ``written``, dealt by key into buckets: grouping by key reads it without a shuffle. The catalogue forgets it at once."""
    spark = df.sparkSession
    buckets, own = 4 * spark.sparkContext.defaultParallelism, f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{own}"
    df.repartition(buckets, key).write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(own)
    atexit.register(_remove, spark, path)
    out = spark.table(own)
    out.schema  # resolved, so that the frame outlives the entry
    spark.sql(f"DROP TABLE `{own}`")  # with a path of its own its files stay
    return out


def path_of(df: DataFrame) -> str:
    """The folder of a table of ``written``."""
    return df.inputFiles()[0].rsplit("/", 1)[0]


def remove(*frames: DataFrame | None) -> None:
    """Delete the tables that frames of ``written`` are read from; whoever calls it has read them for the last time."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()} if df is not None else ():
            _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session has ended; the folder's owner cleans up
        return


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that further ones can't clash."""
    return df.select(*[df[c] for c in columns])

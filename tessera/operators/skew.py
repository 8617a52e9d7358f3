"""Joins whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import written

#: A key is hot if it has one in SHARE of all rows, so that there are no more than SHARE of them, and LEAST rows.
SHARE, LEAST, SALTS = 2000, 50_000, 32


def join_salted(many: DataFrame, few: DataFrame, key: str, least: int = LEAST, salts: int = SALTS) -> DataFrame:
    """many inner join few on key, where a key may hold a large part of ``many``.

    Rows of hot keys are dealt over ``salts`` shares, and their rows of ``few`` are
    sent to each.  The list of hot keys is broadcast: it has SHARE rows at most.
    """
    counts = many.groupBy(key).agg(F.count("*").alias("__n"))
    counts = written(counts.where(F.col("__n") >= least).unionByName(many.agg(F.lit(None).cast(many.schema[key].dataType).alias(key), F.count("*").alias("__n"))), "hot-keys")
    total = counts.where(f"`{key}` is null").agg(F.max("__n").alias("__total"))
    hot = counts.where(f"`{key}` is not null").join(F.broadcast(total), F.col("__n") * SHARE >= F.col("__total")).select(key, F.lit(True).alias("__hot"))
    if hot.isEmpty():
        return many.join(few, key)
    rest = F.xxhash64(*[c for c in many.columns if c != key]) if len(many.columns) > 1 else F.monotonically_increasing_id()
    one = many.join(F.broadcast(hot), key, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(rest, F.lit(salts)).cast("int")).otherwise(0))
    all_ = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    other = few.join(F.broadcast(hot), key, "left").withColumn("__salt", F.explode(all_))
    return one.drop("__hot").join(other.drop("__hot"), [key, "__salt"]).drop("__salt")

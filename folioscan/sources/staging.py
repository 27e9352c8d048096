"""Tables that several jobs read: written once to the folder that driver and executors share.

A staged table cuts lineage, so a lost executor costs a read, not the work before it, and later plans stay short. It is
left to that folder's own expiry. Nothing is kept in executors' memory for a caller.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []
#: A key is hot when it holds more than this share of the rows; at most 1000 keys can.
HOT = 1e-3


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on a local master where it is unset, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-staged-", dir="/tmp"))
    return _own[0]


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The frame written and read again; ``by``: a column of few values whose filters then read their own files only."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def looked_up(rows: DataFrame, table: DataFrame, key: str, size: str, total: int, spread: Column) -> DataFrame:
    """Inner look-up of one ``table`` row for each row's text key; keys that hold over HOT of ``total`` rows are broadcast (at
    most 1 / HOT of them), so that no task gets all rows of one key. ``size``: the column of the keys' rows in ``table``."""
    kept = [c for c in table.columns if c not in (key, size)]
    hot = F.col(size) > F.lit(total * HOT)
    often = table.filter(hot).select(F.col(key).alias("_often"), F.struct(*kept).alias("_hot"))
    seldom = table.filter(~hot).select(F.col(key).alias("_at"), F.struct(*kept).alias("_cold"))
    met = rows.join(F.broadcast(often), F.col(key) == F.col("_often"), "left")
    met = met.withColumn("_at", F.when(F.col("_often").isNull(), F.col(key)).otherwise(F.concat(F.lit("\x00"), spread.cast("string"))))
    met = met.join(seldom, "_at", "left").withColumn("_found", F.coalesce("_hot", "_cold")).filter("_found is not null")
    return met.select(*rows.columns, *[F.col(f"_found.{c}") for c in kept])

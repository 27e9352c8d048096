"""Helpers that the operators share: shared scratch tables, exact ranks, group look-ups.

Scale notes. Scratch tables go under ``spark.checkpoint.dir``, the folder that driver and
executors share, so a lost executor never loses them. Ranks are made in two levels, so no
window partition grows with the table. A broadcast side always has a bound that follows from
arithmetic (at most ``1 / share`` groups can hold more than ``share`` of the rows).
"""

from __future__ import annotations

import ctypes
import gc
import math
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A group is hot when it holds more than this share of the rows; at most 1000 groups can.
HOT_SHARE = 1e-3
#: Rows that one window partition of a rank holds on average at most; on small tables RANK_ROOT times the root of all rows.
RANK_ROWS, RANK_ROOT = 50_000, 8
#: Bits of a key filter: 16 MB at most, whatever it holds.
FILTER_BITS = 1 << 27

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset and Spark is local, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp"))
    return _own_dir[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder, read again: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Gives the system back what this worker process has freed: Arrow's pool and the C library's heap keep it otherwise, for as long as the
    worker serves later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def lean(run):
    """``run`` over a task's batches; its memory is released when the task ends."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def text_of(col: str = "text") -> Column:
    """Null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ranked(df: DataFrame, by: list[str], order: list[str], key: list[str], total: int, out: str) -> DataFrame:
    """Adds ``out``: a gapless rank from 0 within ``by``, total rows known.

    Rows of a ``by`` group are dealt over cells by a hash of ``key``, which should tell rows apart; a cell's
    rows rank within it, after the rows of the cells before it. Rows that repeat ``order`` rank
    in any order.
    """
    cells = max(1, math.ceil(total / min(RANK_ROWS, 1 + RANK_ROOT * math.isqrt(total))))
    dealt = df.withColumn("_cell", F.pmod(F.xxhash64(*key), F.lit(cells)).cast("int"))
    before = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*by, "_cell").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*by, "_cell").orderBy(*order)
    return dealt.join(starts, [*by, "_cell"]).withColumn(out, F.col("_start") + F.row_number().over(inside) - 1).drop("_start", "_cell")


def resolve(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, spread: Column) -> DataFrame:
    """Left look-up of one ``groups`` row per ``rows.key``, safe for keys that hold most rows.

    Groups with more than HOT_SHARE of the rows (at most 1 / HOT_SHARE of them) are broadcast; their
    rows leave the shuffle's key and are dealt by ``spread`` instead (should that meet another key, the hot group still counts).
    Keys are strings or longs.
    """
    kept = [c for c in groups.columns if c != key]
    packed = groups.select(F.col(key).alias("_key"), F.struct(*kept).alias("_group"), F.col(size).alias("_size"))
    hot = packed.filter(F.col("_size") > F.lit(total * HOT_SHARE)).select(F.col("_key").alias("_hot_key"), F.col("_group").alias("_hot"))
    found = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    away = F.xxhash64(spread, F.lit("~")) if dict(rows.dtypes)[key] == "bigint" else F.concat(F.lit("~"), spread.cast("string"))
    found = found.withColumn("_probe", F.when(F.col("_hot_key").isNull(), F.col(key)).otherwise(away))
    found = found.join(packed.drop("_size").withColumnRenamed("_key", "_probe"), "_probe", "left")
    whole = F.coalesce("_hot", "_group")
    return found.select(*rows.columns, *[whole[c].alias(c) for c in kept])


def key_filter(keys: DataFrame, key: str) -> DataFrame:
    """Bitmap of the keys' hashes in pages of 4 KB; FILTER_BITS bounds its size, so it may be broadcast at any size.

    Keys move by page, 8 bytes each; a page is made where its keys are.
    """
    spots = keys.select(_spot(key).alias("spot")).withColumn("_page", F.bitmap_bucket_number("spot")).repartition("_page")
    return spots.groupBy("_page").agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("_bits"))


def marked(rows: DataFrame, bitmap: DataFrame, key: str, out: str) -> DataFrame:
    """Adds ``out``: false where the key is surely not in the filter. The more keys a filter holds, the more rows it lets
    through; an exact join of those must follow."""
    place = F.bitmap_bit_position(_spot(key))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1
    found = rows.join(F.broadcast(bitmap), F.bitmap_bucket_number(_spot(key)) == F.col("_page"), "left")
    return found.withColumn(out, F.coalesce(bit, F.lit(False))).drop("_page", "_bits")


def _spot(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)) + 1

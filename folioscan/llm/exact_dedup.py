"""Exact deduplication with skew-safe combining, DataFrame functions only.

1. Copies inside a task fold into one row (partial aggregation on digest and full text).
2. Those rows merge per salt, so the copies of one text meet in SALTS tasks, not in one.
3. Salt winners combine per digest and full text.
Full content is the grouping key at every stage, next to the digest. Only digests travel back to the rows:
where a digest holds one text, equal digests are equal texts; where one held several (checked
over the whole table), its rows are compared by text again. Hot groups are looked up by broadcast,
at most 1000 of them by arithmetic.

Defined results: null text counts as empty, so null and empty texts are copies; a null doc_id never wins
against another; rows that repeat doc_id and text are the same document and share one decision;
other columns play no part, whatever their names; very long texts are compared whole; an empty table gives an empty table.
``keep_one`` keeps exactly one whole row of each text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SALTS = 16


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """digest, text, keep_id, group_size: one row for each distinct whole text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), common.text_of(text_col).alias("text")).withColumn("digest", F.sha2("text", 256))
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    local = salted.groupBy("digest", "text", "salt").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    met = local.repartition("digest")  # one exchange serves the grouping by (digest, text) and a window over digest
    return met.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    found = winners(docs, id_col, text_col).withColumn("texts", F.count("*").over(Window.partitionBy("digest")))
    found = common.written(found.withColumn("text", F.when(F.col("texts") > 1, F.col("text"))), "exact-groups")
    rows = docs.select(F.col(id_col).alias("doc_id"), common.text_of(text_col).alias("text")).withColumn("digest", F.sha2("text", 256))
    total = found.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    single = found.filter("texts = 1").drop("text", "texts")
    out = common.resolve(rows.select("doc_id", "digest"), single, "digest", "group_size", total, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    clashing = found.filter("texts > 1").drop("texts")
    if not clashing.isEmpty():  # a digest with several texts: its rows are told apart by whole text
        out = out.filter(F.col("group_size").isNotNull()).unionByName(rows.join(clashing, ["digest", "text"]).drop("text"))
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), F.col("digest").alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The whole row with the largest id of each distinct text, columns as they came."""
    names = docs.columns
    packed = docs.select(common.text_of(text_col).alias("_text"), F.col(id_col).alias("_id"), F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names) if c != text_col]).alias("_row"), F.col(text_col).isNull().alias("_null"))
    packed = packed.withColumn("_digest", F.sha2("_text", 256)).withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    best = F.max_by(F.struct("_row", "_null", "_id"), F.struct("_id", F.xxhash64(F.to_json("_row")))).alias("_best")
    local = packed.groupBy("_digest", "_text", "_salt").agg(best)
    local = local.select("_digest", "_text", F.col("_best._row").alias("_row"), F.col("_best._null").alias("_null"), F.col("_best._id").alias("_id"))
    one = local.groupBy("_digest", "_text").agg(best)
    cells = [F.when(~F.col("_best._null"), F.col("_text")).alias(c) if c == text_col else F.col(f"_best._row.c{k}").alias(c) for k, c in enumerate(names)]
    return one.select(*cells)

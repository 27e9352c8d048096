"""Sharding by vector bin packing.

A group (rows of equal text) is a vector of bytes, tokens and rows, as shares of their totals. Groups go to shards one
after another, largest first, each to the shard where the dot product of its vector with the residual capacity
is highest. That is the step that lowers the sum of squared residuals most, over all three alike. To do that at any size:

* groups above 1 / (shards x FINE) of a total are placed one by one: at most 3 x shards x FINE of them;
* all others first gather in shards x BUNDLES bundles by a hash of their digest, and bundles are placed;
* a group larger than a shard is split into equal parts by a hash of the row, for no law could hold otherwise.

``levelled`` then repairs bytes, the law: of two shards, bundles of nearly equal tokens and rows change places.

So what the driver places is bounded by those parameters, not by the data, and rows find their
shard by two broadcast look-ups of bounded size. Slots are two-level ranks.

Defined results: null text is empty (size 8, no tokens); rows that repeat get slots of their own, in any order; a null doc_id is
a value like any other; an empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FINE, BUNDLES = 100, 200
#: Parts that a group as large as a shard is split into: coarser ones leave tokens and rows uneven.
PARTS = 16
#: Exchanges of bundles that level bytes, at most; the largest relative spread of bytes that needs none.
SWAPS, LEVEL = 2000, 1e-4


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each vector (shares of the totals), largest first: highest dot product with the residual capacity."""
    out = np.zeros(len(vectors), np.int64)
    residual = np.full((shards, vectors.shape[1]), 1.0 / shards)
    for k in np.lexsort((np.arange(len(vectors)), -vectors.sum(1))):
        shard = int((residual * vectors[k]).sum(1).argmax())  # element-wise: no BLAS threads on the driver
        out[k] = shard
        residual[shard] -= vectors[k]
    return out


def levelled(vectors: np.ndarray, to: np.ndarray, shards: int, movable: np.ndarray) -> np.ndarray:
    """Exchanges one movable vector of the fullest shard (by bytes) for one of the emptiest while that narrows their gap;
    of the exchanges that narrow it at least half as much as the best, the one that moves tokens and rows least for it."""
    to, spots = to.copy(), np.flatnonzero(movable)
    for _ in range(SWAPS):
        loads = np.bincount(to, weights=vectors[:, 0], minlength=shards)
        high, low = int(loads.argmax()), int(loads.argmin())
        gap = loads[high] - loads[low]
        a, b = spots[to[spots] == high], spots[to[spots] == low]
        if gap <= LEVEL / shards or not len(a) or not len(b):
            break
        moved = vectors[a][:, None, :] - vectors[b][None, :, :]
        gain = gap - np.abs(gap - 2 * moved[:, :, 0])
        if gain.max() <= 0:
            break
        cost = np.where(gain >= gain.max() / 2, np.abs(moved[:, :, 1:]).sum(2) / np.maximum(gain, 1e-300), np.inf)
        i, j = np.unravel_index(int(cost.argmin()), cost.shape)
        to[a[i]], to[b[j]] = low, high
    return to


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    text = common.text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", (F.octet_length("text") + 8).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.sha2("text", 256).alias("digest"), F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("tokens"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = common.written(rows.withColumn("bundle", F.pmod(F.xxhash64("digest"), F.lit(shards * BUNDLES)).cast("int")), "shard-rows")
    grouped = rows.groupBy("digest", "bundle").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    grouped = common.written(grouped, "shard-groups")
    total = grouped.agg(F.sum("bytes"), F.sum("tokens"), F.sum("rows")).first()
    totals = np.array([float(x or 0) for x in total])
    part = 1.0 / (shards * FINE)
    large = F.lit(False)
    for name, whole in zip(("bytes", "tokens", "rows"), totals, strict=True):
        large = large | (F.col(name) > F.lit(part * whole))
    sums = [F.sum(c).alias(c) for c in ("bytes", "tokens", "rows")]
    singles = grouped.filter(large).select("digest", "bytes", "tokens", "rows").collect()  # at most 3 x shards x FINE
    bundles = grouped.filter(~large).groupBy("bundle").agg(*sums).collect()  # at most shards x BUNDLES
    singles.sort(key=lambda r: r.digest)
    bundles.sort(key=lambda r: r.bundle)
    spark = docs.sparkSession
    share = lambda r: np.array([r.bytes, r.tokens, r.rows]) / np.maximum(totals, 1)
    parts = {r.digest: int(np.ceil(share(r).max() * shards * PARTS)) if share(r).max() * shards > 1 else 1 for r in singles}
    counts = spark.createDataFrame(list(parts.items()), "digest string, parts int")
    rows = rows.join(F.broadcast(counts), "digest", "left").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    split = rows.filter("parts > 1").groupBy("digest", "part").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).collect()  # at most 3 x shards groups, 6 x shards x PARTS parts
    items = [((r.digest, 0), r) for r in singles if parts[r.digest] == 1] + [((r.digest, r.part), r) for r in sorted(split, key=lambda r: (r.digest, r.part))] + [((None, r.bundle), r) for r in bundles]
    vectors = np.array([share(r) for _, r in items]).reshape(-1, 3)
    to = levelled(vectors, place(vectors, shards), shards, np.array([parts.get(digest, 1) == 1 for (digest, _), _ in items], bool))
    places = spark.createDataFrame([(d, k, int(s)) for ((d, k), _), s in zip(items, to, strict=True) if d is not None], "digest string, part int, own_shard int")
    rest = [(k, int(s)) for ((d, k), _), s in zip(items, to, strict=True) if d is None]
    bundle_shards = spark.createDataFrame(rest, "bundle int, bundle_shard int")
    placed = rows.join(F.broadcast(places), ["digest", "part"], "left").join(F.broadcast(bundle_shards), "bundle", "left")
    placed = placed.select("doc_id", "size", "text_crc32", "row", F.coalesce("own_shard", "bundle_shard").alias("shard"))
    slotted = common.ranked(placed, ["shard"], ["doc_id", "text_crc32", "row"], ["row"], int(totals[2]), "slot")
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

"""MinHash fingerprints of whole texts, likeness of fingerprints, near texts by signature bands.

HASHES universal permutations run over a text's word shingles in numpy; the fingerprint is the upper 16 bits of each
minimum in hex. Texts of every length take the same shingles, so that any two can be likened, and equal
texts have equal fingerprints. Bands of the signature meet in Spark, and the Jaccard of all that meet is verified on
whole shingle sets (``ngram_join``): class_id and links.

The next document comes without a global sort: rows are dealt to ranges of (id, hash of text), each range also gets
the first row of the range after it, and a task walks its ranges in order. Text moves once, packed (zstd); the
classes of a range's texts, where a text has a copy or a link, go to the same range.

Defined results: null text is empty; an empty text's fingerprint is all f, like to itself only; ids that repeat go in
order of a hash of the text; a null id comes first; a sole document is its own next; an empty table gives an empty
table; rows that repeat are copies; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, ngram_join, shingles

HASHES = 128
#: Rows of a range on average; ranges are at most RANGES for each shuffle partition, and MOST_RANGES (what the driver holds).
RANGE_ROWS, RANGES, MOST_RANGES = 256, 8, 1 << 15
#: Likeness of near texts, and the chance that the bands of their signatures meet.
THRESHOLD, RECALL = 0.8, 0.999
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: A row of a walk: what it is (0 a class, 1 a text, 2 the text that follows the range), place, content.
DEALT = "bucket int, kind int, at long, tie long, doc_id long, packed binary"
LEAST = -(1 << 63)


def prints(texts: list[str], hashes: int = HASHES) -> np.ndarray:
    """texts x hashes of 16 bits."""
    return printed(shingles.shingle_sets(texts), hashes)


def printed(sets: list[np.ndarray], hashes: int = HASHES) -> np.ndarray:
    return (shingles.signatures(sets, hashes) >> np.uint32(16)).astype(">u2")


class Ranges:
    """Ranges of (at, tie): an id that spans several cuts is parted by its tie."""

    def __init__(self, cuts: list[int]):
        values, n = np.unique(np.array(cuts or [], np.int64), return_counts=True)
        self.at = np.repeat(values, n)
        self.tie = np.array([LEAST + (k << 64) // m for m in n.tolist() for k in range(m)], np.int64)

    def of(self, at: np.ndarray, tie: np.ndarray) -> np.ndarray:
        out = np.searchsorted(self.at, at, side="left")
        end = np.searchsorted(self.at, at, side="right")
        for k in np.unique(out[end > out]):
            own = np.flatnonzero((out == k) & (end > out))
            out[own] = k + np.searchsorted(self.tie[k : end[own[0]]], tie[own], side="right")
        return out.astype(np.int32)


def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of DEALT with set_key, class_id, links in order -> results; a row of kind 2 only serves the row before it."""
    known: dict[bytes, tuple[int | None, int]] = {}

    def done(rows):
        at = [k for k in range(len(rows) - 1) if rows[k][0] == 1]
        if not at:
            return None
        texts = [r[2] for r in rows]
        sets = shingles.shingle_sets(texts)
        own = printed(sets)
        edited = []
        for k in at:
            part = len(texts[k]) // 4
            edited.append(texts[k][: len(texts[k]) - part] + texts[k + 1][:part])
        new = prints(edited)
        classes = [known.get(shingles.set_key(sets[k]), (rows[k][1], 0)) for k in at]
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array([rows[k][1] for k in at], pa.int64()),
            "n_chars": pa.array([len(texts[k]) for k in at], pa.int64()),
            "edited_sha256": [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in edited],
            "fingerprint": [own[k].tobytes().hex() for k in at],
            "edited_fingerprint": [p.tobytes().hex() for p in new],
            "near_edited": (own[at] == new).mean(1),
            "near_next": (own[at] == own[np.array(at) + 1]).mean(1),
            "class_id": pa.array([c for c, _ in classes], pa.int64()),
            "links": pa.array([n for _, n in classes], pa.int64()),
        })

    rows, size, now = [], 0, None
    for batch in batches:
        bucket, kind, _, _, ids, packed, keys, class_ids, links = (c.to_pylist() for c in batch.columns)
        for k in range(len(kind)):
            if bucket[k] != now:  # the last range ended with its extra row
                if (out := done(rows)) is not None:
                    yield out
                rows, size, known, now = [], 0, {}, bucket[k]
            if kind[k] == 0:
                known[keys[k]] = (class_ids[k], links[k])
                continue
            (text,) = ngram_join.unpack([packed[k]])
            rows.append((kind[k], ids[k], text))
            size += len(text)
            if size > shingles.BLOCK:
                if (out := done(rows)) is not None:
                    yield out
                rows, size = rows[-1:], len(text)
    if (out := done(rows)) is not None:
        yield out


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each row's text and of its edited text, and their likeness."""
    return walked(docs, None, id_col, text_col).drop("class_id", "links")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints, and of each row its class_id and links: the signatures' bands meet, all links of a band are verified."""
    sketched = common.written(ngram_join.sketch(docs, THRESHOLD, RECALL, id_col, text_col, HASHES), "print-sketch")
    named = ngram_join.grouped(docs, sketched, THRESHOLD, id_col, text_col)
    rows = sketched.select("doc_id", "digest", "set_key")
    return walked(docs, ngram_join.looked_up(rows, named.filter("copies > 1 or links > 0")).filter("copies is not null"), id_col, text_col)



def walked(docs: DataFrame, classes: DataFrame | None, id_col: str, text_col: str) -> DataFrame:
    """Fingerprints with class_id and links; ``classes``: id, digest, set_key, class_id, links of rows that aren't alone."""
    spark = docs.sparkSession
    at = F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST).cast("long")).alias("at")
    ids = docs.select(at, F.xxhash64(ngram_join.digest_of(text_col)).alias("tie"))
    total = ids.count()
    count = max(1, min(-(-total // RANGE_ROWS), RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_RANGES))
    cuts = ids.agg(F.percentile_approx("at", [k / count for k in range(1, count)] or [0.5], 10 * count)).first()[0] if total else []
    ranges = Ranges(cuts)

    @F.pandas_udf("int")
    def bucket_of(at: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(ranges.of(at.to_numpy(), tie.to_numpy()))

    firsts = ids.groupBy(bucket_of("at", "tie").alias("bucket")).agg(F.min(F.struct("at", "tie")).alias("first")).collect()  # at most MOST_RANGES rows
    firsts = sorted((r.bucket, r.first.at, r.first.tie) for r in firsts)
    serves = {firsts[k][1:]: firsts[k - 1][0] for k in range(len(firsts))}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, tie, text = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            bucket, extra = ranges.of(at, tie), [serves.get(x) for x in zip(at.tolist(), tie.tolist(), strict=True)]
            more = [k for k, b in enumerate(extra) if b is not None]
            to = pa.array([*range(len(at)), *more], pa.int64())
            packed = ngram_join.pack(text.to_pylist())
            columns = [pa.array(np.concatenate([bucket, np.array([extra[k] for k in more], np.int32)])), pa.array([1] * len(at) + [2] * len(more), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns + [c.take(to) for c in (batch.column(0), batch.column(1), batch.column(2), packed)], ["bucket", "kind", "at", "tie", "doc_id", "packed"])

    rows = docs.select(at, F.xxhash64(ngram_join.digest_of(text_col)).alias("tie"), F.col(id_col).cast("long").alias("doc_id"), common.text_of(text_col).alias("text")).mapInArrow(deal, DEALT)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("set_key", "binary"), ("class_id", "long"), ("links", "long"))]
    rows = rows.select("*", *none)
    if classes is not None:
        places = classes.select(F.coalesce("doc_id", F.lit(LEAST).cast("long")).alias("at"), F.xxhash64("digest").alias("tie"), "set_key", "class_id", "links")
        places = places.select(bucket_of("at", "tie").alias("bucket"), "set_key", "class_id", "links").distinct()
        empty = [F.lit(None).cast(t).alias(c) for c, t in (("at", "long"), ("tie", "long"), ("doc_id", "long"), ("packed", "binary"))]
        rows = rows.unionByName(places.select("bucket", F.lit(0).alias("kind"), *empty, "set_key", "class_id", "links"))
    return rows.repartition("bucket").sortWithinPartitions("bucket", "kind", "at", "tie").mapInArrow(walk, OUT + ", class_id long, links long")


def near_pairs(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a, b, jaccard: the links as pairs of their classes' smallest ids; only verified pairs are emitted."""
    return ngram_join.near_pairs(docs, threshold, recall, id_col, text_col, HASHES)

"""N-gram Jaccard self join by MinHash banding, links and connected groups.

1. A text's shingle set gives its class (equal sets are one class: copies never meet as pairs) and its band keys;
   band and row counts follow from the threshold and the target recall.
2. Classes that share a band key meet at the smallest class number of that key, its pivot; a class goes to each pivot
   once, however many bands they share.
3. Only texts of classes that met move: a bitmap of bounded size lets the others stay where they are. They move
   packed (zstd) and are shingled again where they arrive.
4. A pivot's members meet in blocks of at most SIDE x SIDE classes. A block multiplies 0/1 matrices of shingles
   that occur twice, so it has the exact Jaccard of all its pairs without emitting one: it gives each class its
   number of links and only the edges of a spanning forest. A pair that several pivots share counts at the smallest.
5. Groups are the connected components of the verified edges, by smallest-label propagation with
   each round written to the shared folder; it raises after MOST_ROUNDS rounds, and labels at least halve their distance a round.

Scale: a pivot of n members sends each member's packed text to n / SIDE blocks (more where its texts are long, see
PIVOT_SHINGLES). That and the blocks' arithmetic grow with the square of the number of *different* texts that share one
band, since links are exact; copies don't count, and blocks of one pivot run on all executors.

Defined results: null and empty texts have no shingles and form one class among themselves; texts of one to four
words are a single shingle; a link joins two different classes (texts with different shingle sets) with
a Jaccard of at least the threshold; ``links`` counts them for every copy alike; rows that repeat are copies; an id
may carry several texts. Classes are told apart by their shingle sets and named by doc_id only in the result: a null doc_id
is a row like any other but never names a class that has another id. Other columns are carried as they came, whatever their
names; very long texts are joined whole; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, shingles

THRESHOLD, RECALL, SIDE = 0.8, 0.9999, 256
#: Shingles of one side of a block, on average: bounds a block's memory where a pivot's texts are long.
PIVOT_SHINGLES = 1 << 20
MOST_ROUNDS = 60


def sketch(docs: DataFrame, threshold: float, recall: float, id_col: str, text_col: str, most: int = 200) -> DataFrame:
    """doc_id, digest, set_key, size (shingles), bands of every row; narrow. ``most``: hashes of a signature."""
    bands, rows = shingles.choose_bands(threshold, recall, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in shingles.blocks(texts):
                sets = shingles.shingle_sets(texts[a:b])
                keys = shingles.band_hashes(shingles.signatures(sets, bands * rows), bands, rows).view(np.int64)
                listed = [k.tolist() if len(s) else [] for k, s in zip(keys, sets, strict=True)]
                columns = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(map(shingles.set_key, sets), pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(listed, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "set_key", "size", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), digest_of(text_col).alias("digest"), common.text_of(text_col).alias("text")).mapInArrow(common.lean(run), "doc_id long, digest binary, set_key binary, size long, bands array<long>")


def digest_of(text_col: str) -> Column:
    """16 bytes that tell apart the texts of one id."""
    return F.unhex(F.md5(common.text_of(text_col)))


def row_key(doc_id: Column, digest: Column) -> Column:
    """One number for an id and its text; null ids too."""
    return F.xxhash64(F.coalesce(doc_id.cast("long").cast("string"), F.lit("")), digest)


def classes_of(sketched: DataFrame) -> DataFrame:
    """Table of one row per shingle set: set_key, rep (its number), copies, doc_id (smallest) and digest of one of its rows.

    The number is a hash of the set's digest; should two sets ever share one, all are numbered anew.
    """
    row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest"))
    classes = sketched.groupBy("set_key").agg(row.alias("row"), F.count("*").alias("copies"))
    classes = classes.select("set_key", F.xxhash64("set_key").alias("rep"), "copies", F.col("row.doc_id").alias("doc_id"), F.col("row.digest").alias("digest"))
    classes = common.written(classes, "join-classes")
    if not classes.groupBy("rep").count().filter("count > 1").isEmpty():
        classes = common.written(classes.withColumn("rep", F.monotonically_increasing_id()).withColumn("anew", F.lit(True)), "join-classes")
    return classes


def met_at(sketched: DataFrame, classes: DataFrame) -> DataFrame:
    """Table of (pivot, rep, size): classes that share a band with another class, by the bands' smallest classes."""
    if "anew" in classes.columns:
        numbered = sketched.join(classes.select("set_key", "rep"), "set_key")
    else:
        numbered = sketched.withColumn("rep", F.xxhash64("set_key"))
    keyed = numbered.select("rep", "size", F.explode("bands").alias("band"))
    pivots = keyed.groupBy("band").agg(F.min("rep").alias("pivot"), F.max("rep").alias("top"), F.count("*").alias("n")).filter("pivot < top").drop("top")
    pivots = common.written(pivots, "join-pivots")
    total = pivots.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    near = common.marked(keyed, common.key_filter(pivots, "band"), "band", "_near").filter("_near").drop("_near")
    met = common.resolve(near, pivots, "band", "n", total, F.col("rep")).filter("pivot is not null")
    return common.written(met.select("pivot", "rep", "size").distinct(), "join-members")


def pack(texts: list[str]) -> pa.Array:
    made = zstandard.ZstdCompressor(level=3)
    return pa.array([made.compress(t.encode("utf-8", "replace")) for t in texts], pa.binary())


def unpack(packed) -> list[str]:
    made = zstandard.ZstdDecompressor()
    return [made.decompress(p).decode("utf-8") for p in packed]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (set_key, packed)."""
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for a, b in shingles.blocks(texts):
            keys = map(shingles.set_key, shingles.shingle_sets(texts[a:b]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pack(texts[a:b])], ["set_key", "packed"])


def _overlaps(n: int, keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """n x n: how many keys two owners share; every owner has a key once. Keys of a single owner are left out of the product."""
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    value = np.cumsum(np.concatenate([[False], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    twice = (np.bincount(value) > 1)[value] if len(keys) else np.zeros(0, bool)
    value, owner = value[twice], owner[twice]
    out = np.zeros((n, n), np.float32)
    if len(value):
        value = np.cumsum(np.concatenate([[False], value[1:] != value[:-1]]))
        width = max(1, (4 << 20) // n)
        cuts = np.searchsorted(value, np.arange(0, value[-1] + 1 + width, width))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            one = np.zeros((n, min(width, int(value[-1]) + 1 - k * width)), np.float32)
            one[owner[a:b], value[a:b] - k * width] = 1
            out += one @ one.T
    return out


def _labels(near: np.ndarray) -> np.ndarray:
    """Smallest member of each component; ``near`` is symmetric."""
    label, n = np.arange(len(near)), len(near)
    while True:
        new = np.minimum(label, np.where(near, label[None, :], n).min(1, initial=n))
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def verifier(threshold: float, pairs: bool = False):
    """Counts and forest edges of one block, or its near pairs and their likeness; rows: rep, side (0 first, 1 second, 2 both), pivots, packed."""

    def run(members: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values("rep", ignore_index=True)
        reps, sides, pivot, n = members["rep"].to_numpy(), members["side"].to_numpy(), members["pivot"].iloc[0], len(members)
        sets = shingles.shingle_sets(unpack(members["packed"]))
        sizes = np.array([len(s) for s in sets])
        both = _overlaps(n, np.concatenate(sets), np.repeat(np.arange(n), sizes))
        whole = sizes[:, None] + sizes[None, :] - both
        near = (both >= threshold * whole - 1e-4) & ((sides[:, None] != sides[None, :]) | (sides[:, None] == 2))
        np.fill_diagonal(near, False)
        lists = [np.asarray(p) for p in members["pivots"]]
        at, owner = np.concatenate(lists), np.repeat(np.arange(n), [len(p) for p in lists])
        mine = near & (_overlaps(n, at[at < pivot], owner[at < pivot]) == 0)  # else the pair counts at a smaller pivot
        if pairs:
            a, b = np.nonzero(np.triu(mine))
            return pd.DataFrame({"ra": reps[a], "rb": reps[b], "jaccard": (both[a, b] / whole[a, b]).astype(float)})
        counts, label = mine.sum(1), _labels(near)
        linked, child = np.flatnonzero(counts), np.flatnonzero(label != np.arange(n))
        return pd.DataFrame({
            "a": np.concatenate([reps[linked], reps[label[child]]]),
            "b": pd.array([None] * len(linked) + reps[child].tolist(), dtype="Int64"),  # never by way of floats
            "links": np.concatenate([counts[linked], np.zeros(len(child), np.int64)]),
        })

    return run


def blocks(docs: DataFrame, classes: DataFrame, met: DataFrame, id_col: str, text_col: str):
    """Rows (pivot, low, high, side, rep, pivots, packed) grouped by block."""
    spread = met.groupBy("rep").agg(F.array_sort(F.collect_list("pivot")).alias("pivots"))  # at most one a band
    cells = F.greatest(F.ceil(F.count("*") / SIDE), F.ceil(F.sum("size") / PIVOT_SHINGLES))
    large = met.groupBy("pivot").agg(cells.cast("int").alias("cells"), F.count("*").alias("n")).filter("cells > 1")
    parts = common.resolve(met.drop("size"), common.written(large, "join-large"), "pivot", "n", met.count(), F.col("rep"))
    parts = parts.select("pivot", "rep", F.coalesce("cells", F.lit(1)).alias("cells")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("cells")).cast("int"))
    parts = parts.repartition("pivot", "own")  # so that no task makes more than a block's share of a pivot's copies
    parts = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    parts = parts.select("pivot", "rep", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), side.alias("side"))
    wanted = classes.join(spread.hint("merge"), "rep").select("set_key", "rep", "pivots", row_key(F.col("doc_id"), F.col("digest")).alias("row"))
    wanted = common.written(wanted, "join-wanted")
    rows = docs.select(common.text_of(text_col).alias("text"), row_key(F.col(id_col), digest_of(text_col)).alias("row"))
    rows = common.marked(rows, common.key_filter(wanted, "row"), "row", "_near").filter("_near").select("text")
    texts = rows.mapInArrow(common.lean(_packed), "set_key binary, packed binary").dropDuplicates(["set_key"]).join(wanted.hint("merge"), "set_key")
    return parts.join(texts.select("rep", "pivots", "packed").hint("merge"), "rep").groupBy("pivot", "low", "high")


def verified(docs: DataFrame, sketched: DataFrame, classes: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """Table of (a, null, links counted in a block) and (a, b, 0) forest edges between class numbers."""
    met = met_at(sketched, classes)
    return common.written(blocks(docs, classes, met, id_col, text_col).applyInPandas(verifier(threshold), "a long, b long, links long"), "join-links")


def near_pairs(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text", most: int = 200) -> DataFrame:
    """a, b, jaccard: every link, as a pair of its classes' smallest ids. Only verified pairs are emitted, each once."""
    sketched = common.written(sketch(docs, threshold, recall, id_col, text_col, most), "join-sketch")
    classes = classes_of(sketched)
    found = blocks(docs, classes, met_at(sketched, classes), id_col, text_col).applyInPandas(verifier(threshold, True), "ra long, rb long, jaccard double")
    names = classes.select("rep", "doc_id")
    found = found.join(names.select(F.col("rep").alias("ra"), F.col("doc_id").alias("da")), "ra").join(names.select(F.col("rep").alias("rb"), F.col("doc_id").alias("db")), "rb")
    return found.select(F.least("da", "db").alias("a"), F.greatest("da", "db").alias("b"), "jaccard")


def components(edges: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """node, label: smallest node of each connected component; nodes without edges don't occur.

    Every round takes the smallest label among neighbours and then that label's own label, and is written.
    """
    both = common.written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "join-edges")
    total = both.count()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label"), F.count("*").alias("degree"))
    labels = common.written(labels, "join-labels")
    for _ in range(most_rounds):
        ends = labels.select(F.col("node").alias("b"), "label", "degree")
        near = common.resolve(both, ends, "b", "degree", total, F.col("a")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", "degree", "label", F.least("label", "near").alias("new"))
        heads = step.groupBy("new").agg(F.count("*").alias("n"))  # a label that many nodes have is looked up once
        heads = heads.join(labels.select(F.col("node").alias("new"), F.col("label").alias("up")), "new")
        new = F.least("new", "up")
        step = common.resolve(step, heads, "new", "n", total, F.col("node")).select("node", "degree", new.alias("label"), (new < F.col("label")).alias("moved"))
        step = common.written(step, "join-labels")
        labels = step.drop("moved")
        if step.filter("moved").isEmpty():
            return labels.drop("degree")
    raise RuntimeError("components did not settle")


def grouped(docs: DataFrame, sketched: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """Table of one row per class: set_key, group (its number), class_id, text_class, copies, links, digest of the row that names it."""
    classes = classes_of(sketched)
    links = verified(docs, sketched, classes, threshold, id_col, text_col)
    labels = components(links.filter("b is not null"))
    counts = links.filter("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    linked = labels.join(counts, F.col("node") == F.col("a"), "left").select(F.col("node").alias("rep"), F.col("label").alias("group"), "links")
    linked = common.written(classes.select("rep", F.col("doc_id").alias("text_class")).join(linked, "rep"), "join-linked")
    names = linked.groupBy("group").agg(F.min("text_class").alias("class_id"), F.count("*").alias("n"))
    linked = common.resolve(linked, names, "group", "n", linked.count(), F.col("rep")).select("rep", "group", "class_id", "links")
    named = classes.join(linked, "rep", "left").select("set_key", F.coalesce("group", "rep").alias("group"), F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.col("doc_id").alias("text_class"), "copies", F.coalesce("links", F.lit(0)).alias("links"), "digest")
    return common.written(named, "join-named")


def looked_up(rows: DataFrame, named: DataFrame) -> DataFrame:
    """``rows`` (with doc_id and set_key) and the class of each; null where ``named`` lacks it."""
    total = named.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    named = named.select(F.hex("set_key").alias("set_name"), "class_id", "text_class", "copies", "links")
    rows = rows.withColumn("set_name", F.hex("set_key"))
    return common.resolve(rows, named, "set_name", "copies", total, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).drop("set_name")


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, class_id (smallest doc_id of its group), text_class (of equal shingle sets), links."""
    sketched = common.written(sketch(docs, threshold, recall, id_col, text_col), "join-sketch")
    rows = looked_up(sketched.select("doc_id", "set_key"), grouped(docs, sketched, threshold, id_col, text_col))
    return rows.select("doc_id", "class_id", "text_class", "copies", "links")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One whole row of each group, that of the smallest id (null last; of several texts by digest); columns as they came.

    Rows of classes without copy or link stay where they are. The others' keys are in a bitmap of bounded
    size, and only rows that it lets through meet the exact list.
    """
    sketched = common.written(sketch(docs, threshold, recall, id_col, text_col), "join-sketch")
    named = grouped(docs, sketched, threshold, id_col, text_col)
    busy = named.filter("copies > 1 or links > 0")
    best = busy.groupBy("group").agg(F.min(F.struct(F.col("text_class").isNull().alias("none"), "text_class", "digest")).alias("row"))
    id_of = lambda c: F.coalesce(F.col(c).cast("long").cast("string"), F.lit(""))
    best = best.select(id_of("row.text_class").alias("_id"), F.col("row.digest").alias("_digest"), F.lit(True).alias("_stays"))
    met = looked_up(sketched.select("doc_id", "digest", "set_key"), busy).filter("copies is not null").select(id_of("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    met = common.written(met.join(best, ["_id", "_digest"], "left").withColumn("_row", F.xxhash64("_id", "_digest")), "join-met")
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("whole")
    rows = docs.select(whole, digest_of(text_col).alias("_digest"), id_of(id_col).alias("_id")).withColumn("_row", F.xxhash64("_id", "_digest"))
    rows = common.marked(rows, common.key_filter(met, "_row"), "_row", "_maybe").drop("_row")
    maybe = rows.filter("_maybe").join(met.select("_id", "_digest", F.coalesce("_stays", F.lit(False)).alias("_stays")).hint("merge"), ["_id", "_digest"], "left")
    stay = rows.filter("not _maybe").select("whole").unionAll(maybe.filter(F.coalesce("_stays", F.lit(True))).dropDuplicates(["_id", "_digest"]).select("whole"))
    return stay.select(*[F.col(f"whole.c{k}").alias(c) for k, c in enumerate(docs.columns)])

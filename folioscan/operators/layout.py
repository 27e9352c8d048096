"""Labels and their values: n-gram equi-join for labels, range joins on one document for values.

All joins are equi-joins on (doc_id, page_no) with the geometry as residual, and only matched labels enter them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.operators import regions as R
from folioscan.plans import dims

PAGE = ["doc_id", "page_no"]


def label_match(regions: DataFrame, rows: list[tuple] | None = None) -> DataFrame:
    """Best label region of every page, type and field; ``rows``: (type, field, label, priority), all of ``dims`` by default.

    Whole-text equality beats containment, longer phrases beat shorter, then priority, confidence, first region. Where ``regions`` have a
    column document_type, only labels of that type are matched.
    """
    spark = regions.sparkSession
    rows = dims.label_rows() if rows is None else rows
    found = R.grams(regions, [r[2] for r in rows])
    same = F.col("gram") == F.col("label")
    if "document_type" in regions.columns:
        same = same & (F.col("doc_type") == F.col("document_type"))
    found = found.join(F.broadcast(dims.label_dim(spark, rows)), same)
    score = F.when(F.col("norm") == F.col("label"), 10000 - F.col("priority")).otherwise(100 * F.length("label") - F.col("priority"))
    region = F.struct("seq", "left", "top", "right", "bottom", "text", "confidence")
    best = found.groupBy(*PAGE, "doc_type", "field").agg(F.max_by(region, F.struct(score.alias("s"), F.col("confidence"), -F.col("seq"))).alias("b"), F.max(score).alias("score"))
    return best.select(*PAGE, "doc_type", "field", "score", *[F.col(f"b.{c}").alias(f"label_{c}") for c in ("seq", "left", "top", "right", "bottom", "text", "confidence")])


def label_places(labels: DataFrame) -> DataFrame:
    """Distinct label regions: many fields share one, and the range joins need it once."""
    return labels.select(*PAGE, *[f"label_{c}" for c in ("seq", "left", "top", "right", "bottom")]).distinct()


def row_left(labels: DataFrame, regions: DataFrame, prefix: int = 5) -> DataFrame:
    """Adds row_left: the least left edge of the label and short fragments on its row. Labels are found once: they meet their page by one
    outer join."""
    short = F.length(F.regexp_replace("text", "[^A-Za-z0-9]", "")) <= prefix
    other = regions.filter(short).select(*[F.col(c).alias(f"o_{c}") for c in (*PAGE, "seq", "left", "top", "bottom")])
    height = F.greatest(F.col("label_bottom") - F.col("label_top"), F.lit(1))
    overlap = F.least("o_bottom", "label_bottom") - F.greatest("o_top", "label_top")
    fits = (overlap >= height * 0.5) & (F.col("o_left") < F.col("label_left")) & (F.col("o_seq") != F.col("label_seq"))
    places = label_places(labels)
    met = places.join(other, (F.col("doc_id") == F.col("o_doc_id")) & (F.col("page_no") == F.col("o_page_no")) & fits, "left")
    return met.groupBy(*places.columns).agg(F.least("label_left", F.coalesce(F.min("o_left"), "label_left")).alias("row_left"))


def value_below(labels: DataFrame, regions: DataFrame, reach: int = 80, prefix: int = 5) -> DataFrame:
    """Nearest region under each label; label-like texts come last. The label itself may be found.

    One join of labels with their page and one aggregate: the row's left edge, and the few regions of the band below, which are judged
    once that edge is known.
    """
    other = R.label_like(regions).select(*PAGE, *[F.col(c).alias(f"o_{c}") for c in ("seq", "left", "top", "bottom", "text")], "label_like")
    gap = F.col("o_top") - F.col("label_bottom")
    height = F.greatest(F.col("label_bottom") - F.col("label_top"), F.lit(1))
    overlap = F.least("o_bottom", "label_bottom") - F.greatest("o_top", "label_top")
    short = F.length(F.regexp_replace("o_text", "[^A-Za-z0-9]", "")) <= prefix
    beside = (overlap >= height * 0.5) & (F.col("o_left") < F.col("label_left")) & (F.col("o_seq") != F.col("label_seq"))
    under = (gap >= -10) & (gap < reach)
    one = F.struct(F.greatest(gap, F.lit(0)).alias("gap"), F.col("o_left").alias("x"), F.col("o_seq").alias("seq"), F.col("o_text").alias("text"), "label_like")
    met = label_places(labels).join(other, PAGE).filter(under | beside)
    met = met.groupBy(*PAGE, "label_seq", "label_left").agg(F.min(F.when(beside & short, F.col("o_left"))).alias("edge"), F.collect_list(F.when(under, one)).alias("under"))
    dx = lambda r: F.abs(r["x"] - F.least("label_left", F.coalesce("edge", "label_left")))
    cost = lambda r: r["gap"] + dx(r) * 0.3 + F.when(r["label_like"], 500).otherwise(0)
    near = F.transform(F.filter("under", lambda r: dx(r) < 200), lambda r: F.struct(cost(r).alias("c"), r["seq"].alias("seq"), r["text"].alias("text")))
    return met.withColumn("best", F.array_min(near)).filter("best is not null").select(*PAGE, "label_seq", F.col("best.text").alias("below"))


def value_right(labels: DataFrame, regions: DataFrame, reach: int = 450) -> DataFrame:
    """Nearest region to the right on the label's row that is no label."""
    other = R.label_like(regions).select(*PAGE, *[F.col(c).alias(f"o_{c}") for c in ("seq", "left", "top", "bottom", "text")], "label_like")
    gap = F.col("o_left") - F.col("label_right")
    overlap = F.least("o_bottom", "label_bottom") - F.greatest("o_top", "label_top")
    height = F.greatest(F.col("label_bottom") - F.col("label_top"), F.lit(1))
    near = label_places(labels).join(other, PAGE).filter((overlap >= height * 0.4) & (gap >= 0) & (gap < reach) & ~F.col("label_like") & (F.col("o_seq") != F.col("label_seq")))
    return near.groupBy(*PAGE, "label_seq").agg(F.min_by("o_text", F.struct(gap.alias("g"), F.col("o_seq"))).alias("right"))


def label_values(regions: DataFrame, rows: list[tuple] | None = None) -> DataFrame:
    """Matched labels and their value: right of the label, else below; blank is null."""
    return values_at(label_match(regions, rows), regions)


def values_at(labels: DataFrame, regions: DataFrame) -> DataFrame:
    """Adds to label regions: row_left, right, below (nearest texts) and value (trimmed: right, else below; blank is null).

    One join of label regions with their page and one aggregate on the same keys: the row's left edge, the nearest
    region to the right, and the few regions of the band below, which are judged once the left edge is known. A region that is the label of
    several types and fields is met once; they ride along in a list. A page's labels are one row, which meets the document's regions by doc_id
    and keeps its own page's: regions dealt by doc_id stay where they are, as a join on both keys would have them dealt anew.
    """
    other = R.label_like(regions).select(*PAGE, *[F.col(c).alias(f"o_{c}") for c in ("seq", "left", "top", "bottom", "text")], "label_like")
    height = F.greatest(F.col("label_bottom") - F.col("label_top"), F.lit(1))
    overlap = F.least("o_bottom", "label_bottom") - F.greatest("o_top", "label_top")
    elsewhere = F.col("o_seq") != F.col("label_seq")
    prefix = elsewhere & (overlap >= height * 0.5) & (F.col("o_left") < F.col("label_left")) & (F.length(F.regexp_replace("o_text", "[^A-Za-z0-9]", "")) <= 5)
    gap = F.col("o_left") - F.col("label_right")
    beside = elsewhere & (overlap >= height * 0.4) & (gap >= 0) & (gap < 450) & ~F.col("label_like")
    drop = F.col("o_top") - F.col("label_bottom")
    under = F.struct((F.greatest(drop, F.lit(0)) + F.when(F.col("label_like"), 500).otherwise(0)).cast("double").alias("cost"), F.col("o_left").alias("x"), F.col("o_seq").alias("seq"), F.col("o_text").alias("text"))
    kept = [c for c in labels.columns if c not in (*PAGE, "doc_type", "field")]
    keys = [*PAGE, "doc_type", "field"]
    place = [*PAGE, *[f"label_{c}" for c in ("seq", "left", "top", "right", "bottom")]]
    own = [c for c in labels.columns if c not in place]
    labels = labels.groupBy(*place).agg(F.collect_list(F.struct(*own)).alias("_own"))
    labels = labels.groupBy(*PAGE).agg(F.collect_list(F.struct(*place[2:], "_own")).alias("_labels"))
    # a difference, since equal pages would be taken for a key of the join
    met = labels.join(other.withColumnRenamed("page_no", "o_page_no"), "doc_id").filter("page_no - o_page_no = 0")
    # only what may count is kept: the label's row, or the band below it
    met = met.select("*", F.inline("_labels")).drop("_labels").filter((overlap >= height * 0.4) | ((drop >= -10) & (drop < 80)))
    met = met.groupBy(*place).agg(
        F.any_value("_own").alias("_own"),
        F.least(F.min("label_left"), F.coalesce(F.min(F.when(prefix, F.col("o_left"))), F.min("label_left"))).alias("row_left"),
        F.min_by(F.struct("o_text", "o_seq", "o_left"), F.when(beside, F.struct(gap.alias("g"), F.col("o_seq")))).alias("_right"),
        F.collect_list(F.when((drop >= -10) & (drop < 80), under)).alias("under"),
    )
    near = F.filter("under", lambda r: F.abs(r["x"] - F.col("row_left")) < 200)
    best = F.array_min(F.transform(near, lambda r: F.struct((r["cost"] + F.abs(r["x"] - F.col("row_left")) * 0.3).alias("c"), r["seq"].alias("seq"), r["text"].alias("text"))))
    met = met.withColumns({"right": F.col("_right.o_text"), "right_seq": F.col("_right.o_seq"), "right_left": F.col("_right.o_left"), "below": best["text"]})
    found = F.trim(F.coalesce("right", "below"))
    met = met.select(*place, "row_left", "right", "right_seq", "right_left", "below", F.explode("_own").alias("_one")).select("*", "_one.*")
    return met.select(*keys, *kept, "row_left", "right", "right_seq", "right_left", "below", F.when(found != "", found).alias("value"))


def best_values(regions: DataFrame, rows: list[tuple]) -> DataFrame:
    """doc_id and, for every (type, field) of ``rows``, a struct <type>__<field> of its best label over all pages: place, text, values.

    Where ``regions`` have a column document_type, only labels of a document's own type count.
    """
    labels = label_match(regions, rows)
    values = values_at(labels, regions)
    one = F.struct("page_no", "label_seq", "label_left", "label_top", "label_right", "label_bottom", "label_text", "row_left", F.trim("right").alias("right"), "right_seq", "right_left", F.trim("below").alias("below"), "value")
    # a document's few labels are gathered, best first; a field's own is the first of its name
    ranked = F.struct("score", "label_confidence", (-F.col("page_no")).alias("page"), (-F.col("label_seq")).alias("place"), F.concat_ws("__", "doc_type", "field").alias("key"), one.alias("one"))
    docs = values.select("doc_id", ranked.alias("r")).groupBy("doc_id").agg(F.collect_list("r").alias("all"))
    docs = docs.select("doc_id", F.sort_array("all", asc=False).alias("all"))
    keys = dict.fromkeys(f"{t}__{f}" for t, f, _, _ in rows)
    docs = R.step(docs, ["doc_id"], keys=F.col("all.key"), ones=F.col("all.one"))
    return R.step(docs, ["doc_id"], **{k: F.get("ones", F.array_position("keys", k).cast("int") - 1) for k in keys})

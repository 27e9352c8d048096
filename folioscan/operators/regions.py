"""Row-level work on region tables: predicates, reading order, page and document aggregates.

A region: doc_id, page_no, seq, text, left, top, right, bottom, confidence. Ties end in ``seq``. Aggregates
key on doc_id (and page_no), so one exchange serves a chain of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.functions import text as T
from folioscan.plans import dims

TRUSTED = 0.5
BOX = ["left", "top", "right", "bottom"]


def dealt(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows dealt by ``key`` over the session's shuffle partitions: a set number, which adaptive execution keeps, so small
    rows that cost much are worked on in parallel. Left out by the planner where rows already lie so."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def step(rows: DataFrame, kept: list[str], **made: Column) -> DataFrame:
    """Adds columns in a step of its own: the planner doesn't merge it with the next one, so what that reads often is made once, and the
    method that Spark writes for it stays small enough for the JVM to compile."""
    return rows.select(*kept, F.explode(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))).alias("_made")).select(*kept, "_made.*")


def apart(rows: DataFrame, through: str, kept: list[str], **made: Column) -> DataFrame:
    """As ``step``, for many long expressions: the JVM interprets whole-stage code that grows over its limit. ``through``, a kept column, passes a
    lambda that gives it back, and a projection with a lambda is compiled in methods of its own, each a small one."""
    same = F.get(F.transform(F.array(F.col(through)), lambda x: x), F.lit(0)).alias(through)
    return rows.select(*[same if c == through else c for c in kept], *[c.alias(n) for n, c in made.items()])


def trusted(regions: DataFrame, least: float = TRUSTED) -> DataFrame:
    """Regions of sufficient confidence; the filter reaches the scan."""
    return regions.filter(F.col("confidence") >= least)


def targeted(regions: DataFrame, share: float = 0.45) -> DataFrame:
    """Regions in the lower part of their page (stands for recognition on a crop)."""
    height = F.max("bottom").over(Window.partitionBy("doc_id", "page_no"))
    return regions.withColumn("_h", height).filter(F.col("top") >= F.floor(F.lit(share) * F.col("_h"))).drop("_h")


def offset(regions: DataFrame, dx: int, dy: int) -> DataFrame:
    return regions.withColumns({"left": F.col("left") + dx, "right": F.col("right") + dx, "top": F.col("top") + dy, "bottom": F.col("bottom") + dy})


def dedup_regions(regions: DataFrame) -> DataFrame:
    """One reading per box and folded text: the most confident one, at the first one's place."""
    key = Window.partitionBy("doc_id", "page_no", *BOX, "_key")
    rows = regions.withColumn("_key", T.dedup_key(F.col("text")))
    rows = rows.withColumn("_best", F.row_number().over(key.orderBy(F.desc("confidence"), "seq"))).withColumn("_first", F.min("seq").over(key))
    return rows.filter("_best = 1").withColumn("seq", F.col("_first")).drop("_key", "_best", "_first")


def union_passes(passes: list[DataFrame]) -> DataFrame:
    """Recognition passes one after another, numbered anew, then deduplicated."""
    rows = None
    for k, p in enumerate(passes):
        p = p.withColumn("_pass", F.lit(k))
        rows = p if rows is None else rows.unionByName(p)
    order = Window.partitionBy("doc_id", "page_no").orderBy("_pass", "seq")
    return dedup_regions(rows.withColumn("seq", F.row_number().over(order) - 1).drop("_pass"))


def geometry_confidence(regions: DataFrame) -> DataFrame:
    """doc_id, mean_confidence, min_confidence over distinct boxes, each at its best reading."""
    boxes = regions.groupBy("doc_id", *BOX).agg(F.max(F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0))).alias("c"))
    return boxes.groupBy("doc_id").agg(F.avg("c").alias("mean_confidence"), F.min("c").alias("min_confidence"))


def ocr_confidence(regions: DataFrame) -> DataFrame:
    return regions.groupBy("doc_id").agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("ocr_confidence"))


def in_order(cells: Column) -> Column:
    """Aggregate: texts of (page_no, seq, text) structs in order, a blank between."""
    return F.array_join(F.sort_array(F.collect_list(cells))["text"], " ")


def joined_text(regions: DataFrame) -> DataFrame:
    """Texts of a document in order, a blank between."""
    rows = regions.select("doc_id", F.when(F.trim("text") != "", F.struct("page_no", "seq", "text")).alias("cell"))
    return rows.groupBy("doc_id").agg(in_order(F.col("cell")).alias("joined"))


def probe_text(regions: DataFrame, count: int = 12) -> DataFrame:
    """The first texts of each document."""
    ordered = F.array_sort(F.collect_list(F.when(F.trim("text") != "", F.struct("page_no", "seq", F.trim("text").alias("text")))))
    return regions.groupBy("doc_id").agg(F.array_join(F.transform(F.slice(ordered, 1, count), lambda r: r["text"]), "|").alias("probe"))


def non_latin_pages(regions: DataFrame) -> DataFrame:
    """doc_id, page_no, share of characters beyond ASCII, and whether it is over 0.4."""
    beyond = F.sum(F.length(F.regexp_replace("text", r"[\x00-\x7F]", "")))
    share = F.try_divide(beyond.cast("double"), F.sum(F.length("text")))
    return regions.groupBy("doc_id", "page_no").agg(F.bround(share, 6).alias("share"), F.coalesce(share > 0.4, F.lit(False)).alias("non_latin"))


def letter_shares(regions: DataFrame) -> DataFrame:
    """Per region: shares of Devanagari and of letters beyond ASCII."""
    return regions.select("doc_id", "page_no", "seq", F.bround(T.letters_share(F.col("text"), r"ऀ-ॿ"), 6).alias("devanagari"), F.bround(T.letters_share(F.col("text"), r"\x{80}-\x{10FFFF}"), 6).alias("non_ascii"))


def mrz_line(text: Column) -> Column:
    """The text looks like a machine-readable line. Cleaning makes no text longer, so short ones are not cleaned."""
    cleaned = T.clean_mrz(text)
    return (F.length(F.upper(text)) >= 40) & cleaned.rlike("^[A-Z0-9<]{40,44}$") & (F.length(cleaned) - F.length(F.translate(cleaned, "<", "")) >= 5)


def mrz_pages(regions: DataFrame) -> DataFrame:
    """Pages with two or more machine-readable lines in their lower part."""
    page = Window.partitionBy("doc_id", "page_no")
    rows = regions.withColumn("_floor", F.max("bottom").over(page) * 0.6)
    like = (F.col("bottom") >= F.col("_floor")) & mrz_line(F.col("text"))
    return rows.groupBy("doc_id", "page_no").agg((F.count_if(like) >= 2).alias("has_mrz"))


def row_bands(regions: DataFrame) -> DataFrame:
    """Row buckets of 12 and of 20 pixels (half to even)."""
    return regions.select("doc_id", "seq", F.floor(F.col("top") / 12).alias("band12"), F.bround(F.col("top") / 20).cast("long").alias("band20"))


def reading_order(regions: DataFrame) -> DataFrame:
    """Texts by (top, left), in one row per document."""
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "top", "left", "seq", "text")))
    return regions.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda r: r["text"]), "|").alias("reading"))


def _any_word(words: list[str]):
    """Pattern of an upper-case text that holds one of ``words`` whole; longer runs of the same letters don't count. Words go by their
    first letter, so that most places of a text are passed at one look."""
    tails = {}
    for w in words:
        tails.setdefault(w[0], []).append(w[1:])
    return f"[{''.join(sorted(tails))}](?<![A-Z0-9][A-Z0-9])(?:{'|'.join(f'(?<={c})(?:{chr(124).join(t)})' for c, t in tails.items())})(?![A-Z0-9])"


def grams(regions: DataFrame, phrases: list[str], norm=T.norm_label) -> DataFrame:
    """Contiguous word n-grams of each region's normalised text, of the sizes that phrases with the same first word have.

    Containment of a phrase at word boundaries is equality with one of these, so label and keyword search
    is an equi-join with a broadcast dimension. Regions without any phrase's first word are dropped by one cheap pattern
    before they are normalised, and n-grams start at such a word only. All steps are compiled: no lambda over words.
    """
    firsts = {}
    for p in phrases:
        firsts.setdefault(len(p.split(" ")), set()).add(p.split(" ")[0])
    every = sorted(set().union(*firsts.values()))
    rows = regions.filter(F.upper("text").rlike(_any_word(every))).withColumn("norm", norm(F.col("text"))).withColumn("words", F.split("norm", " "))
    rows = rows.select("*", F.posexplode("words").alias("start", "word")).filter(F.col("word").isin(every))
    runs = [F.when(F.col("word").isin(sorted(firsts[n])) & (F.col("start") + n <= F.size("words")), F.array_join(F.slice("words", F.col("start") + 1, F.lit(n)), " ")) for n in sorted(firsts)]
    return rows.withColumn("gram", F.explode(F.array(*runs))).filter("gram is not null").drop("words", "start", "word")


def label_like(regions: DataFrame) -> DataFrame:
    """Adds label_like: the text holds a label's typical word."""
    lone = [h for h in dims.LABEL_HINTS if " " not in h]  # longer ones hold one of these
    return regions.withColumn("label_like", F.upper("text").rlike(_any_word(lone)))

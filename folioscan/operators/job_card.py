"""Rural-employment job cards: labels in many scripts with recognition errors, household fields, the member table.

Labels are scored once for each different text: an index of the labels' words and letter pairs gives each text the few labels
it may be like, and only those reach the edit distance and the Arrow function. Scores are staged, since six steps read them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.functions import likeness
from folioscan.functions import multiscript as M
from folioscan.operators import regions as R
from folioscan.plans import job_card as L
from folioscan.sources.staging import looked_up, staged

PAGE = ["doc_id", "page_no"]
#: Least likeness of a label; of a region that is known to be a label.
NEAR, KNOWN = 0.84, 0.92
DELIMITERS = r"\s*[:=]\s*|\s+[–—-]\s+"
DAY = r"(?i)\b(?:\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}|\d{1,2}\s+(?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)(?:UARY|RUARY|CH|IL|E|Y|UST|TEMBER|OBER|EMBER)?\s+\d{4})\b"
CARD = r"(?<![A-Z0-9])([A-Z]{2}\s*[-–—]\s*[0-9OILSBZGQD]{1,10}(?:\s*[-/–—]\s*[0-9OILSBZGQD]{1,10}){2,7})(?![A-Z0-9])"
#: Full-width forms, which stand for the plain letters, digits and signs 65,248 places before them.
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
NARROW = "".join(chr(ord(c) - 0xFEE0) for c in WIDE)
#: Letters read for digits in a card's number.
LETTERS, DIGITS = "OQDILZSGB", "000112568"


def index_of(aliases: list[tuple[str, str]]) -> list[tuple[str, str, int]]:
    """Rows (kind, key, alias number) by which texts find the labels they may score for, and no others.

    ``run``: a run of words that is the label. ``gram``: two letters of a label that may be met with errors; what keeps its likeness
    keeps most of these. ``size``: a text length at which a label's grams prove nothing (few or repeated ones), so all texts count.
    """
    rows = []
    for k, (_, alias) in enumerate(aliases):
        rows.append(("run", alias, k))
        if len(alias) >= 5:
            rows += [("gram", g, k) for g in sorted(_pairs(alias))]
            rows += [("size", str(m), k) for m in _sizes(len(alias)) if _least(alias, m) <= 0]
    return rows


def _pairs(word: str) -> set[str]:
    return {word[i : i + 2] for i in range(len(word) - 1)}


def _sizes(n: int) -> range:
    """Lengths of texts that may be like a label of n letters."""
    return range(math.ceil(0.65 * n - 1e-9), math.floor(1.45 * n + 1e-9) + 1)


def _edits(n, m):
    """Most edits between a label and a text that is NEAR it: the likeness is at most 1 - edits / (n + m)."""
    return (1 - NEAR) * (n + m)


def _least(alias: str, m: int) -> int:
    """Fewest different pairs of letters that a text of m letters shares with a label it is NEAR; an edit changes two."""
    return len(_pairs(alias)) - 2 * math.floor(_edits(len(alias), m) + 1e-9)


def text_scores(texts: DataFrame, labels: dict[str, list[str]]) -> DataFrame:
    """text, group, score of different texts: one and a bit for equality (whole text or the text before a delimiter), a little less for
    containment, else the likeness of that text and the label; the best label of each group, NEAR or more.

    Texts meet the labels through ``index_of`` in one broadcast join on keys; only labels that share enough grams are compared.
    """
    spark = texts.sparkSession
    aliases = sorted({(g, M.as_label(a)) for g, names in labels.items() for a in names})
    index = F.broadcast(spark.createDataFrame(index_of(aliases), "kind string, key string, alias_no int"))
    table = F.array(*[F.struct(F.lit(g).alias("group"), F.lit(a).alias("alias"), F.lit(len(a)).alias("n"), F.lit(len(_pairs(a))).alias("pairs")) for g, a in aliases])
    rows = R.dealt(texts, "text").withColumns({"whole": M.label_of(F.col("text")), "head": M.label_of(F.split("text", DELIMITERS, 2)[0])}).filter("whole != ''")
    words = F.split("whole", " ")
    sizes = sorted({len(a.split(" ")) for _, a in aliases})
    none = F.array().cast("array<string>")

    def runs(n: int) -> Column:
        """All runs of n words."""
        return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(none)

    held = F.array_append(F.flatten(F.array(*map(runs, sizes))), F.col("head"))
    m = F.length("head")
    grams = F.when(m >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), m - 1), lambda i: F.col("head").substr(i, F.lit(2))))).otherwise(none)
    keyed = lambda kind, keys: F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))
    keys = F.concat(keyed("run", F.array_distinct(held)), keyed("gram", grams), keyed("size", F.array(m.cast("string"))))
    met = rows.select("text", "whole", "head", F.explode(keys).alias("k")).select("text", "whole", "head", "k.*").join(index, ["kind", "key"])
    # a label of another length can't be like the text: its pairs of letters need not be counted
    sized = F.get(F.array(*[F.lit(len(a)) for _, a in aliases]), F.col("alias_no"))
    met = met.filter((F.col("kind") != "gram") | ((m >= 0.65 * sized) & (m <= 1.45 * sized)))
    met = met.groupBy("text", "whole", "head", "alias_no").agg(F.count_if(F.col("kind") == "gram").alias("shared"), F.bool_or(F.col("kind") == "run").alias("held"), F.bool_or(F.col("kind") == "size").alias("any"))
    met = met.withColumn("a", F.get(table, F.col("alias_no"))).select("*", "a.*")
    n = F.col("n")
    enough = F.col("any") | (F.col("shared") >= F.col("pairs") - 2 * F.floor(_edits(n, m) + 1e-9))
    close = (n >= 5) & (m >= 0.65 * n) & (m <= 1.45 * n) & enough & (F.levenshtein("head", "alias") <= _edits(n, m))
    equal = (F.col("whole") == F.col("alias")) | (F.col("head") == F.col("alias"))
    length = F.least(n, F.lit(100)) / 1000
    ratio = likeness.sequence_ratio(F.when(~F.col("held") & close, F.col("head")), F.col("alias"))
    scored = met.filter(F.col("held") | close).withColumn("score", F.when(equal, 1.0 + length).when(F.col("held"), 0.99 + length).otherwise(ratio)).filter(F.col("score") >= NEAR)
    return scored.groupBy("text", "group").agg(F.max("score").alias("score"))


def label_scores(rows: DataFrame, labels: dict[str, list[str]]) -> DataFrame:
    """Adds group and score, a row for every group whose label scores NEAR or more.

    Each different text is judged once, whatever the number of its copies; texts that every document bears are looked up by broadcast.
    """
    counts = staged(rows.filter("text is not null").groupBy("text").agg(F.count("*").alias("copies")), "label-texts")
    scores = text_scores(counts.select("text"), labels).groupBy("text").agg(F.collect_list(F.struct("group", "score")).alias("scores"))
    found = staged(scores.join(counts, "text"), "label-scores")
    total = counts.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    met = looked_up(rows, found, "text", "copies", total, F.col("doc_id"))
    return met.select(*rows.columns, F.inline("scores"))


def of_groups(scores: DataFrame, groups, least: float = NEAR) -> DataFrame:
    return scores.filter(F.col("group").isin(list(groups)) & (F.col("score") >= least))


def best_labels(scores: DataFrame) -> DataFrame:
    """The best label region of every document and field, with the value inside its own text."""
    labels = L.FIELDS | L.ENDS
    scored = of_groups(scores, labels)
    one = F.struct("page_no", "seq", "text", "left", "top", "right", "bottom")
    best = scored.groupBy("doc_id", "group").agg(F.max_by(one, F.struct("score", "confidence", -F.col("page_no"), -F.col("seq"))).alias("b"))
    best = best.select("doc_id", F.col("group").alias("field"), "b.page_no", *[F.col(f"b.{c}").alias(f"label_{c}") for c in ("seq", "text", "left", "top", "right", "bottom")])
    cut = lambda pattern: F.split("label_text", pattern, 2)
    ways = F.array(*[F.struct(F.lit(k).alias("way"), cut(p)[0].alias("text"), F.get(cut(p), F.lit(1)).alias("rest")) for k, p in enumerate((r"\s*[:=]\s*", r"\s+[–—-]\s+"))])
    heads = best.select("doc_id", "field", F.explode(F.filter(ways, lambda w: w["rest"].isNotNull())).alias("w")).select("doc_id", "field", "w.*")
    heads = label_scores(heads, labels).filter(F.col("group") == F.col("field"))
    inline = heads.groupBy("doc_id", "field").agg(F.min_by(F.btrim("rest", F.lit(" :;|")), "way").alias("inline"))
    best = best.join(inline, ["doc_id", "field"], "left")
    kept = best.columns
    best = R.step(best.withColumn("_whole", M.label_of(F.col("label_text"))), kept, _lead=leading_words(F.col("_whole"), F.col("field"), labels))
    sizes = sorted({len(M.as_label(a).split()) for names in labels.values() for a in names})
    behind = F.coalesce(*[F.when(F.col("_lead") == n, F.regexp_replace("label_text", r"^(?:[^\p{L}\p{N}]*[\p{L}\p{N}]+){%d}" % n, "")) for n in sizes])
    best = R.step(best, kept, _rest=F.btrim(behind, F.lit(" :;|–—-")))
    return best.withColumn("inline", F.coalesce(F.when(F.col("inline") != "", F.col("inline")), F.when(F.col("inline").isNull() & (F.col("_rest") != ""), F.col("_rest")))).drop("_rest")


def leading_words(whole: Column, field: Column, labels: dict[str, list[str]]) -> Column:
    """Words of the longest label of a field with which a normal text begins, else 0. One constant pattern a field, longer labels first."""
    longest = lambda names: sorted({M.as_label(a) for a in names}, key=lambda a: (-len(a.split(" ")), a))
    run = F.coalesce(*[F.when(field == f, F.regexp_extract(whole, f"^({'|'.join(longest(names))})(?: |$)", 1)) for f, names in labels.items()])
    return F.when(run != "", F.size(F.split(run, " "))).otherwise(0)


def values(regions: DataFrame, scores: DataFrame) -> DataFrame:
    """doc_id, field, value: inside the label's text, else the nearest text to the right, else below; known labels never count."""
    labels = staged(best_labels(scores), "job-best-labels")  # read twice
    known = of_groups(scores, L.FIELDS, KNOWN).select(*PAGE, "seq").distinct()
    other = regions.join(known, [*PAGE, "seq"], "left_anti").select(*PAGE, *[F.col(c).alias(f"o_{c}") for c in ("seq", "text", "left", "top", "right", "bottom", "confidence")])
    height = F.greatest(F.col("label_bottom") - F.col("label_top"), F.lit(1))
    gap = F.col("o_left") - F.col("label_right")
    beside = (F.least("label_bottom", "o_bottom") - F.greatest("label_top", "o_top") >= height * 0.4) & gap.between(-5, 500)
    drop, dx = F.col("o_top") - F.col("label_bottom"), F.abs(F.col("o_left") - F.col("label_left"))
    under = drop.between(-4, 110) & ((dx <= 220) | (F.least("label_right", "o_right") > F.greatest("label_left", "o_left")))
    cost = F.when(beside, F.greatest(gap, F.lit(0)).cast("double")).otherwise(F.greatest(drop, F.lit(0)) + dx * 0.15)
    met = labels.filter("inline is null").join(other, PAGE).filter((F.col("o_seq") != F.col("label_seq")) & (beside | under))
    near = met.groupBy("doc_id", "field").agg(F.min_by("o_text", F.struct((~beside).cast("int").alias("k"), cost.alias("c"), (-F.col("o_confidence")).alias("p"), F.col("o_seq"))).alias("near"))
    text = F.btrim(F.coalesce("inline", "near"), F.lit(" :;|"))
    return labels.join(near, ["doc_id", "field"], "left").select("doc_id", "field", F.when(text != "", text).alias("value"))


def card_number(c: Column) -> Column:
    """A job card's number in a text: most numeric parts, then the longest; letters read for digits are mended, full-width forms are plain ones."""
    found = F.regexp_extract_all(F.upper(F.translate(c, WIDE, NARROW)), F.lit(CARD), F.lit(1))
    flat = F.transform(found, lambda x: F.regexp_replace(F.translate(x, "–—", "--"), r"\s+", ""))
    mended = F.transform(flat, lambda x: F.concat(F.substring(x, 1, 3), F.translate(F.substring(x, F.lit(4), F.length(x)), LETTERS, DIGITS)))
    ranked = F.transform(mended, lambda x: F.struct(F.size(F.split(x, "[-/]")).alias("parts"), F.length(x).alias("n"), x.alias("number")))
    return F.array_max(ranked)["number"]


def age(c: Column) -> Column:
    """First number of one to three digits, when it is from 18 to 100."""
    n = F.regexp_extract(c, r"\b(\d{1,3})\b", 1).try_cast("int")
    return F.when(n.between(18, 100), n)


def table_headers(scores: DataFrame) -> DataFrame:
    """doc_id, page_no, headers (kind, seq, centre, left, right, bottom): the best row of column headers.

    Each header gathers the headers within 38 pixels of its height, the most confident of a kind, itself on a tie; the row with most kinds
    (a name and an age count twice) that has a name and an age or gender wins, the first on a tie.
    """
    widest = F.coalesce(*[F.when(F.col("group") == g, max(map(len, names))) for g, names in L.HEADERS.items()])
    heads = of_groups(scores, L.HEADERS).groupBy(*PAGE, "seq", "left", "top", "right", "bottom", "confidence").agg(F.max_by("group", F.struct("score", widest)).alias("kind"))
    heads = heads.withColumn("y", (F.col("top") + F.col("bottom")) / 2)
    anchors = heads.select(*PAGE, F.col("seq").alias("anchor"), F.col("kind").alias("own"), F.col("y").alias("at"))
    cell = F.struct("kind", "seq", ((F.col("left") + F.col("right")) / 2).alias("centre"), "left", "right", "bottom")
    rows = anchors.join(heads, PAGE).filter(F.abs(F.col("y") - F.col("at")) <= 38)
    rows = rows.groupBy(*PAGE, "anchor", "kind").agg(F.max_by(cell, F.struct("confidence", (F.col("seq") == F.col("anchor")).cast("int"), -F.col("seq"))).alias("c"))
    rows = rows.groupBy(*PAGE, "anchor").agg(F.array_sort(F.collect_list("c")).alias("headers"))
    has = lambda k: F.exists("headers", lambda h: h["kind"] == k)
    points = F.size("headers") + has("name").cast("int") + has("age").cast("int")
    rows = rows.filter(has("name") & (has("age") | has("gender")))
    return rows.groupBy(*PAGE).agg(F.max_by("headers", F.struct(points, -F.col("anchor"))).alias("headers"))


def table_members(regions: DataFrame, scores: DataFrame) -> DataFrame:
    """doc_id, n (order), serial, name, relation, gender, age of rows under the headers.

    Cells in order of height join the last row while they lie within 18 pixels of its running mean; a cell belongs to
    the header with the nearest centre. Rows need a name and an age or gender.
    """
    heads = table_headers(scores)
    edge = lambda c, f: f(F.transform("headers", lambda h: h[c]))
    heads = heads.withColumns({"floor": edge("bottom", F.array_max), "from_x": edge("left", F.array_min) - 80, "to_x": edge("right", F.array_max) + 220})
    ends = of_groups(scores, ("address", "registration_date", "family_id"), KNOWN).select(*PAGE, F.col("top").alias("end")).distinct()
    stops = heads.select(*PAGE, "floor").join(ends, PAGE).filter(F.col("end") > F.col("floor")).groupBy(*PAGE).agg(F.min("end").alias("end"))
    heads = heads.join(stops, PAGE, "left").withColumn("end", F.least(F.col("floor") + 520, F.coalesce("end", F.col("floor") + 520)))
    titles = of_groups(scores, L.HEADERS).select(*PAGE, "seq").distinct()
    x, y = (F.col("left") + F.col("right")) / 2, (F.col("top") + F.col("bottom")) / 2
    cells = regions.join(titles, [*PAGE, "seq"], "left_anti").join(heads, PAGE).filter((F.col("top") >= F.col("floor") - 3) & (F.col("top") < F.col("end")) & x.between(F.col("from_x"), F.col("to_x")))
    kind = F.array_min(F.transform("headers", lambda h: F.struct(F.abs(h["centre"] - x).alias("d"), h["kind"].alias("kind"))))["kind"]
    one = F.struct(y.cast("double").alias("y"), "left", "seq", kind.alias("kind"), F.trim("text").alias("text"))
    lists = cells.groupBy(*PAGE).agg(F.array_sort(F.collect_list(one)).alias("cells"))
    start = F.struct(F.array().cast("array<struct<row:int,kind:string,text:string>>").alias("out"), F.lit(-1).alias("row"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"))

    def step(acc: Column, c: Column) -> Column:
        same = (acc["n"] > 0) & (F.abs(c["y"] - acc["sum"] / F.greatest(acc["n"], F.lit(1))) <= 18)
        row = F.when(same, acc["row"]).otherwise(acc["row"] + 1)
        out = F.array_append(acc["out"], F.struct(row.alias("row"), c["kind"].alias("kind"), c["text"].alias("text")))
        return F.struct(out.alias("out"), row.alias("row"), F.when(same, acc["sum"] + c["y"]).otherwise(c["y"]).alias("sum"), F.when(same, acc["n"] + 1).otherwise(F.lit(1)).alias("n"))

    rows = lists.select(*PAGE, F.posexplode(F.aggregate("cells", start, step)["out"]).alias("at", "c")).select(*PAGE, "at", "c.*")
    text = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("at", "text")))), lambda t: t["text"]), " ")
    wide = rows.groupBy(*PAGE, "row").agg(*[text(k).alias(k) for k in L.HEADERS])
    held = lambda c: F.when(c != "", c)
    members = wide.select("doc_id", (F.col("page_no") * 1_000_000 + F.col("row")).alias("n"), held(F.regexp_extract("serial", r"\b\d{1,3}\b", 0)).alias("serial"), held(F.col("name")).alias("name"), held(F.col("relation")).alias("relation"), M.gender(F.col("gender")).alias("gender"), age(F.col("age")).alias("age"))
    return members.filter("name is not null and (age is not null or gender is not null)")


def compact_members(regions: DataFrame) -> DataFrame:
    """As ``table_members``, of rows kept as one region with visible separators."""
    parts = F.filter(F.transform(F.split(F.trim("text"), r"\s*[|│]\s*|\t+|\s{2,}"), lambda p: F.btrim(p, F.lit(" .:;-"))), lambda p: p != "")
    rows = regions.withColumn("p", parts).filter(F.size("p") >= 3)
    lead = F.regexp_extract(F.col("p")[0], r"^(\d{1,3})[.)]?$", 1)
    rows = rows.withColumns({"serial": F.when(lead != "", lead), "p": F.when(lead != "", F.slice("p", F.lit(2), F.size("p"))).otherwise(F.col("p"))})
    cells = rows.select("doc_id", "page_no", "seq", "serial", "p", F.posexplode("p").alias("k", "part"))
    number = F.when(F.col("part").rlike(r"(?i)^(?:AGE\s*[:\-]?\s*)?\d{1,3}$"), age(F.col("part")))
    cells = cells.withColumns({"g": M.gender(F.col("part")), "a": number})
    found = cells.groupBy("doc_id", "page_no", "seq", "serial", "p").agg(F.min_by("g", F.when(F.col("g").isNotNull(), F.col("k"))).alias("gender"), F.min_by("a", F.when(F.col("a").isNotNull(), F.col("k"))).alias("age"), F.min(F.when(F.col("g").isNotNull() | F.col("a").isNotNull(), F.col("k"))).alias("first"))
    found = found.filter("first > 0")
    return found.select("doc_id", (F.lit(1 << 40) + F.col("page_no") * 1_000_000 + F.col("seq")).alias("n"), "serial", F.col("p")[0].alias("name"), F.when(F.col("first") > 1, F.get("p", F.lit(1))).alias("relation"), "gender", "age")


def members(regions: DataFrame, scores: DataFrame) -> DataFrame:
    """Table rows, then compact rows; the first of each serial number and normal name of a document."""
    both = table_members(regions, scores).unionByName(compact_members(regions)).withColumn("_name", M.normal_of(F.col("name")))
    order = Window.partitionBy("doc_id", "serial", "_name").orderBy("n")
    return both.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k", "_name")


def extract_job_cards(regions: DataFrame) -> DataFrame:
    """Fifteen household fields of every document, members as an array in order. No identity, bank or voter number is kept."""
    regions = staged(regions, "job-regions")
    scores = staged(label_scores(regions, L.FIELDS | L.ENDS | L.HEADERS), "job-labels")  # as many rows as there are labels
    found = values(regions, scores)
    names = [f for f in (*L.FIELDS, *L.ENDS) if f != "members"]
    wide = found.groupBy("doc_id").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"v_{f}") for f in names])
    order = F.struct("page_no", "seq")
    lone = card_number(F.col("text"))
    reading = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "top", "left", "seq", "text"))), lambda r: r["text"]), " ")
    numbers = regions.groupBy("doc_id").agg(F.min_by(lone, F.when(lone.isNotNull(), order)).alias("lone"), card_number(reading).alias("joined"))
    people = members(regions, scores).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "serial", "name", "relation", "gender", "age"))), lambda m: F.struct(m["serial"].alias("serial"), m["name"].alias("name"), m["relation"].alias("relation"), m["gender"].alias("gender"), m["age"].alias("age"))).alias("members"))
    rows = numbers.join(wide, "doc_id", "left").join(people, "doc_id", "left")
    v = lambda f: F.col(f"v_{f}")
    day = lambda c: F.when(F.regexp_extract(c, DAY, 0) != "", F.trim(F.regexp_extract(c, DAY, 0)))
    pair = F.regexp_extract_all(v("validity"), F.lit(DAY), F.lit(0))
    both = F.coalesce(F.size(pair) >= 2, F.lit(False))
    return rows.select(
        "doc_id", F.coalesce(card_number(v("job_card_number")), "lone", "joined").alias("job_card_number"), v("head_of_household").alias("head_of_household"), M.category(v("category")).alias("category"), day(v("registration_date")).alias("registration_date"),
        F.when(both, F.get(pair, F.lit(0))).otherwise(day(v("valid_from"))).alias("validity_from"), F.when(both, F.get(pair, F.lit(1))).otherwise(day(v("valid_to"))).alias("validity_to"),
        *[v(f).alias(f) for f in ("address", "village", "gram_panchayat", "block", "district", "state")], M.yes_no(v("bpl_status")).alias("bpl_status"), v("family_id").alias("family_id"), F.coalesce("members", F.array().cast("array<struct<serial:string,name:string,relation:string,gender:string,age:int>>")).alias("members"),
    )

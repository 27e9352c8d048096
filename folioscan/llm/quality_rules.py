"""Quality rules: a decision list learned by sequential covering, as one ordered Spark conditional expression.

1. Statistics of every whole text: array functions only, no exchange. Words are cut once; 8-word windows are
   hashed, and only texts with equal hashes sort them to mark the words that repeated windows cover.
2. Labelled texts that pass the base rules are dealt into a growing and a pruning part by a hash of their id. Each feature is
   cut at quantiles of the labelled texts.
3. Covering: a rule starts empty and takes the threshold condition with the highest information gain, until it covers
   no good text of the growing part or none helps. Then last conditions are pruned while that raises its worth on the pruning part. A
   rule that is right less often than RIGHT there ends the list; else its texts are covered and the next rule is grown on the rest.
   Each step counts the covered texts by feature and interval in one aggregate (features x CUTS rows), whatever the number
   of labels.
4. The list is emitted as ``when(rule 1, 1).when(rule 2, 2)...``; the first rule that holds rejects the text.

Scale: texts are read once and never move; a row of statistics per text is written to the shared folder, and learning reads
the labelled ones. The driver sees interval counts and the list itself.

Defined results: a null or empty text has no words and fails the base rules; very long texts are read whole; equal
texts have equal results; an id with several labels counts as bad if one of them is; without labels, or without bad ones, the list is
empty and rejects nothing; ties between conditions go to the first feature and the smaller threshold; an empty table
gives an empty table; other columns are ignored, whatever their names. Two windows of a text count as equal if their 64-bit hashes are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BLANKS = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Base rules: fewest words, and most words in repeated windows in hundredths.
FEWEST, REPEATED = 20, 30
#: Features that conditions look at, by the statistics of a text.
FEATURES = {
    "n_words": "n_words",
    "word_length": "word_chars / n_words",
    "symbols": "n_symbols / word_chars",
    "dup_lines": "n_dup_lines / n_lines",
    "repeated": "n_repeat_words / n_words",
    "distinct": "n_distinct / n_words",
    "line_words": "n_words / n_lines",
}
#: Intervals of a feature, conditions of a rule, rules of a list.
CUTS, CONDITIONS, RULES = 64, 4, 16
#: Least share of bad texts among those that a rule covers, on the pruning part, and fewest bad ones it covers in both parts.
RIGHT, COVERS = 0.9, 5
#: One in so many labelled texts prunes; the others grow.
PRUNING = 3


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts of each whole text; narrow, built-in functions only.

    ``F.transform`` over an array of one element names a value once, so that it is not computed again where it is used.
    """
    text = common.text_of(text_col)
    let = lambda value, body: F.transform(F.array(value), body)[0]

    def repeats(words: Column) -> Column:
        """Words that lie in a window found twice or more."""
        windows = lambda hashes: F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda k: F.xxhash64(*[F.get(hashes, k + j) for j in range(WINDOW)]))
        keys = let(F.transform(words, lambda w: F.xxhash64(w)), windows)
        marked = lambda k: F.when(F.size(F.array_distinct(k)) < F.size(k), covered(k)).otherwise(F.lit(0))
        return F.when(F.size(words) > WINDOW, let(keys, marked)).otherwise(F.lit(0))

    def covered(keys: Column) -> Column:
        """Length of the union of all windows whose key occurs twice."""
        placed = F.array_sort(F.transform(keys, lambda k, at: F.struct(k.alias("key"), at.alias("at"))))
        twice = lambda s: F.filter(s, lambda x, i: (F.get(s, i - 1)["key"] == x["key"]) | F.coalesce(F.get(s, i + 1)["key"] == x["key"], F.lit(False)))
        starts = let(placed, lambda s: F.array_sort(F.transform(twice(s), lambda x: x["at"])))
        return let(starts, lambda s: F.aggregate(F.transform(s, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b))

    def counted(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.concat_ws("", words)).cast("long").alias("word_chars"),
            repeats(words).cast("long").alias("n_repeat_words"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    signs = lambda chars: reduce(lambda a, b: a + b, [F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in chars])
    found = docs.select(
        F.col(id_col).alias("doc_id"),
        let(F.filter(F.split(text, BLANKS), lambda w: w != ""), counted).alias("w"),
        signs(SYMBOLS).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
    )
    return found.select("doc_id", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "w.n_distinct")


def base_failed() -> Column:
    return (F.col("n_words") < FEWEST) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))


def feature(name: str) -> Column:
    """A feature as a double; 0 where it has no meaning."""
    return F.coalesce(F.try_divide(*map(F.col, FEATURES[name].split(" / "))).cast("double") if "/" in FEATURES[name] else F.col(FEATURES[name]).cast("double"), F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    """``feature >= threshold`` or ``feature < threshold``; ``cut`` is the threshold's number."""

    name: str
    above: bool
    threshold: float
    cut: int

    def holds(self) -> Column:
        return feature(self.name) >= self.threshold if self.above else feature(self.name) < self.threshold

    def covers(self) -> Column:
        """The same over interval numbers."""
        return F.col(self.name) > self.cut if self.above else F.col(self.name) <= self.cut

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.above else '<'} {self.threshold:.6g}"


def every(conditions: tuple[Condition, ...]) -> Column:
    return reduce(lambda a, b: a & b, [c.covers() for c in conditions], F.lit(True))


def labelled(stats: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[str, list[float]]]:
    """Table of bad (0 or 1), grows, and each feature's interval number, of labelled texts that pass the base rules; the thresholds."""
    truth = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") < 1).cast("int").alias("bad"))
    rows = stats.filter(~base_failed()).join(truth, "doc_id").select("doc_id", "bad", *[feature(f).alias(f) for f in FEATURES])
    shares = [k / CUTS for k in range(1, CUTS)]
    found = rows.agg(*[F.percentile_approx(f, shares, 10_000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted(set(found[f] or [])) for f in FEATURES}
    interval = lambda f: F.size(F.filter(F.array(*map(F.lit, cuts[f])).cast("array<double>"), lambda t: t <= F.col(f)))
    grows = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % PRUNING != 0
    return common.written(rows.select("bad", grows.alias("grows"), *[interval(f).alias(f) for f in FEATURES]), "rules-labelled"), cuts


def gain(bad: int, good: int, bad_before: int, good_before: int) -> float:
    """Information gained about bad texts by a condition."""
    if not bad:
        return 0.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad_before / (bad_before + good_before)))


def best_condition(rows: DataFrame, cuts: dict[str, list[float]]) -> tuple[Condition | None, int, int]:
    """The condition with the highest gain over ``rows``, and how many bad and good texts it leaves."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("name"), F.col(f).alias("cut")) for f in FEATURES])).alias("cell")
    counted = rows.select("bad", cells).groupBy("cell.name", "cell.cut").agg(F.sum("bad").alias("bad"), F.count("*").alias("n")).collect()  # features x CUTS at most
    counts = {(r["name"], r["cut"]): (r["bad"], r["n"] - r["bad"]) for r in counted}
    best, most, left = None, 1e-9, (0, 0)
    for name in FEATURES:
        own = [counts.get((name, k), (0, 0)) for k in range(len(cuts[name]) + 1)]
        bad_all, good_all = (sum(x) for x in zip(*own, strict=True))
        if not bad_all:
            return None, 0, 0
        bad = good = 0
        for k, threshold in enumerate(cuts[name]):
            bad, good = bad + own[k][0], good + own[k][1]
            for above, b, g in ((True, bad_all - bad, good_all - good), (False, bad, good)):
                if (found := gain(b, g, bad_all, good_all)) > most + 1e-9:
                    best, most, left = Condition(name, above, threshold, k), found, (b, g)
    return best, *left


def grow(rows: DataFrame, cuts: dict[str, list[float]]) -> tuple[Condition, ...]:
    """Conditions added one by one until no good text of the growing part is left."""
    conditions: tuple[Condition, ...] = ()
    while len(conditions) < CONDITIONS:
        condition, _, good = best_condition(rows.filter(F.col("grows") & every(conditions)), cuts)
        if condition is None:
            break
        conditions += (condition,)
        if not good:
            break
    return conditions


def prune(rows: DataFrame, conditions: tuple[Condition, ...]) -> tuple[tuple[Condition, ...], float, int]:
    """The first conditions that do best on the pruning part, the share of bad texts there, and bad ones covered in both parts."""
    firsts = [conditions[:k] for k in range(1, len(conditions) + 1)]
    tests = ~F.col("grows")
    found = rows.agg(*[x for k, c in enumerate(firsts) for x in (F.sum((every(c) & tests).cast("int") * F.col("bad")).alias(f"bad{k}"), F.count_if(every(c) & tests).alias(f"n{k}"), F.sum(every(c).cast("int") * F.col("bad")).alias(f"all{k}"))]).first()
    worth = [((2 * (found[f"bad{k}"] or 0) - found[f"n{k}"]) / found[f"n{k}"] if found[f"n{k}"] else -1.0) for k in range(len(firsts))]
    k = max(range(len(firsts)), key=lambda k: (worth[k], -k))
    return firsts[k], (worth[k] + 1) / 2, found[f"all{k}"] or 0


def learn(stats: DataFrame, labels: DataFrame) -> list[tuple[Condition, ...]]:
    """Decision list of rules that reject a text."""
    rows, cuts = labelled(stats, labels)
    rules: list[tuple[Condition, ...]] = []
    while len(rules) < RULES:
        conditions = grow(rows, cuts)
        if not conditions:
            break
        conditions, right, bad = prune(rows, conditions)
        if right < RIGHT or bad < COVERS:
            break
        rules.append(conditions)
        rows = rows.filter(~every(conditions))
    return rules


def expression(rules: list[tuple[Condition, ...]]) -> Column:
    """Number of the first rule that holds, from 1; null if none does."""
    out = F.lit(None).cast("int")
    for k, conditions in reversed(list(enumerate(rules, 1))):
        out = F.when(reduce(lambda a, b: a & b, [c.holds() for c in conditions]), F.lit(k)).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the statistics, base_failed, kept, rule (number of the rule that rejects), by a list learned from ``labels``."""
    stats = common.written(statistics(docs, id_col, text_col), "rules-statistics")
    rule = expression(learn(stats, labels))
    judged = stats.withColumn("base_failed", base_failed()).withColumn("rule", F.when(~F.col("base_failed"), rule))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")

"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon sends words to symbols (insult, threat, target, negation, report, other). Five small transducers read a
clause's symbols: negation (its scope covers the words after it), reported speech, target, insult (a further one in the
clause weighs more) and threat (weak before a target). Their composition is one table of states; each insult or threat adds its weight times the factor of the state it is met in.
Clauses that match are scored, not words: a text's features are sums over its clauses.

The lexicon is a short fixed list plus words and word beginnings learned from the labels of a bounded sample of
rows outside the held-out fold (LEARN rows at most, chosen by a hash of the id). A logistic scorer
over the clause features is fitted on the same rows.

Defined results: a null or empty text has no clause and gets the lowest score; very long texts are read whole; equal
texts have equal scores; of an id with several labels the toxic one counts; without any label the fixed list and a fixed
scorer serve; rows that repeat are scored alike; a score of exactly a half is toxic; an empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Labelled rows that are learned from at most; they bound the terms that can be learned.
LEARN = 20_000
#: A learned term is in at least this many toxic texts, and LIFT times as often in toxic ones as in others.
LEAST, LIFT = 6, 20.0
STEMS = range(3, 9)
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)

#: A short list of each symbol's words.
WORDS = {
    INSULT: "idiot idiots moron morons stupid scum loser losers trash clown clowns pathetic worthless disgusting imbecile vermin filth degenerate",
    THREAT: "kill hurt destroy murder stab strangle burn shoot beat",
    TARGET: "you your yours he she they them him her u du ihr sie dich tu vous ils elle usted ustedes ellos",
    NEGATION: "not never no neither nor without isn't aren't wasn't don't nicht kein keine nie pas jamais ni nunca sin tampoco",
    REPORT: "said says told wrote called calls quoted quote reported according alleged sagte schrieb dit écrit dijo escribió",
}
#: Multiplier of a hit by state: inside a negation's scope, inside reported speech, next to a target; words of a negation's scope.
NEGATED, REPORTED, TARGETED, SCOPE = 0.3, 0.5, 1.5, 3
#: Multiplier of an insult after an insult, and of a threat before any target.
PILED, AIMLESS = 1.25, 0.25
CLAUSE = re.compile(r"[.!?;:\n]+")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


class Transducer:
    """Deterministic: ``step(state, symbol) -> (state, factor)``; the factor weighs a hit read in that step."""

    def __init__(self, states: int, step):
        self.states, self.step = states, step

    def then(self, other: Transducer) -> Transducer:
        """Composition: both read the same symbols, factors multiply."""

        def step(state: int, symbol: int) -> tuple[int, float]:
            a, x = self.step(state // other.states, symbol)
            b, y = other.step(state % other.states, symbol)
            return a * other.states + b, x * y

        return Transducer(self.states * other.states, step)

    def table(self) -> list[list[tuple[int, float]]]:
        return [[self.step(s, symbol) for symbol in range(6)] for s in range(self.states)]


def transducers() -> list[Transducer]:
    """Negation, reported speech, target, insult, threat."""
    negation = Transducer(SCOPE + 1, lambda s, x: (SCOPE, 1.0) if x == NEGATION else (max(0, s - 1), NEGATED if s else 1.0))
    reported = Transducer(2, lambda s, x: (1, 1.0) if x == REPORT else (s, REPORTED if s else 1.0))
    target = Transducer(2, lambda s, x: (1, 1.0) if x == TARGET else (s, TARGETED if s else 1.0))
    insult = Transducer(2, lambda s, x: (1, PILED if s else 1.0) if x == INSULT else (s, 1.0))
    threat = Transducer(2, lambda s, x: (1, 1.0 if s else AIMLESS) if x == THREAT else (int(s or x == TARGET), 1.0))
    return [negation, reported, target, insult, threat]


def grammar() -> list[list[tuple[int, float]]]:
    """The composed table of all five."""
    first, *rest = transducers()
    for one in rest:
        first = first.then(one)
    return first.table()


class Lexicon:
    """Symbol and weight of a word: the fixed list, learned words, learned beginnings."""

    def __init__(self, learned: dict[str, float]):
        self.fixed = {w: (s, 1.0) for s, words in WORDS.items() for w in words.split()}
        self.words = {t: w for t, w in learned.items() if not t.endswith("*")}
        self.stems = {t[:-1]: w for t, w in learned.items() if t.endswith("*")}
        self.lengths = sorted({len(t) for t in self.stems})
        self.seen: dict[str, tuple[int, float]] = {}

    def __call__(self, word: str) -> tuple[int, float]:
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) > 300_000:
                self.seen.clear()
            weight = max([self.words.get(word, 0.0), *(self.stems.get(word[:n], 0.0) for n in self.lengths if n <= len(word))])
            own = self.fixed.get(word, (OTHER, 0.0))
            found = (INSULT, weight) if weight > 0 and own[0] in (OTHER, INSULT) else own
            self.seen[word] = found
        return found


FEATURES = ("sum", "best", "clauses", "hits", "density")


def clause_features(text: str, lexicon: Lexicon, table) -> tuple[np.ndarray, int]:
    """Sums over matched clauses, and the number of clauses that match."""
    total = best = 0.0
    clauses = hits = words = 0
    seen, known = lexicon.seen, lexicon
    for clause in CLAUSE.split(text.lower()):
        found = WORD.findall(clause)
        words += len(found)
        read = [seen[w] if w in seen else known(w) for w in found]
        if not any([r[1] > 0 and r[0] <= THREAT for r in read]):
            continue
        state, value = 0, 0.0
        for symbol, weight in read:
            state, factor = table[state][symbol]
            if symbol <= THREAT:
                value += weight * factor
                hits += 1
        total += value
        best = max(best, value)
        clauses += value > 0
    return np.array([np.log1p(total), np.log1p(best), np.log1p(clauses), np.log1p(hits), np.log1p(100 * total / max(1, words))]), clauses


def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic texts, other texts) counted in the batch; a term that ends in * is a word's beginning."""
    counts: dict[str, list[int]] = {}
    listed = {w for words in WORDS.values() for w in words.split()}
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = set(WORD.findall(text.lower()))
            for t in words | {w[:n] + "*" for w in words - listed for n in STEMS if n < len(w)}:
                counts.setdefault(t, [0, 0])[0 if toxic else 1] += 1
        if len(counts) > 500_000:
            yield _counted(counts)
            counts = {}
    yield _counted(counts)


def _counted(counts: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], ["term", "toxic", "clean"])


def held_out(id_col: str = "doc_id"):
    """The fold that is never learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def labelled(docs: DataFrame, labels: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """text, toxic of at most ``size`` labelled rows outside the held-out fold, chosen by a hash of the id; one text of each id, each text once."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic is not null and _id is not null")
    known = known.groupBy("_id").agg(F.max("toxic").alias("toxic")).filter(~held_out("_id")).orderBy(F.xxhash64("_id"), "_id").limit(size)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), common.text_of(text_col).alias("text"))
    met = rows.join(F.broadcast(known), "_id").groupBy("_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "toxic")).alias("row"))
    return met.select("row.text", "row.toxic").groupBy("text").agg(F.max("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, size: int = LEARN, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Model: learned terms with weights, weights of the scorer."""
    rows = common.written(labelled(docs, labels, size, id_col, text_col), "toxic-learn")
    of = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, fine = of.get(1, 0), of.get(0, 0)
    default = np.array([1.0, 0.5, 1.0, 1.5, 1.0, -2.5])
    if not bad or not fine:
        return {"terms": {}, "weights": default}
    counted = rows.mapInArrow(common.lean(terms_of), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    least = max(LEAST, int(0.003 * bad))
    lift = (F.col("toxic") + 0.5) / (bad + 1) / ((F.col("clean") + 0.5) / (fine + 1))
    found = counted.filter((F.col("toxic") >= least) & (lift >= LIFT)).collect()  # terms of at most ``size`` texts, each in LEAST of them
    found.sort(key=lambda r: (-r.toxic, r.term))
    by_term = {r.term: r.toxic for r in found}
    lone = {w[:n] + "*" for w, t in by_term.items() if w[-1] != "*" for n in STEMS if n < len(w) and t >= 0.8 * by_term.get(w[:n] + "*", t + t)}
    found = [r for r in found if r.term not in lone]  # a beginning that one word explains says nothing of other words
    terms = {r.term: float(min(1.0, np.log((r.toxic + 0.5) / (bad + 1) / ((r.clean + 0.5) / (fine + 1))) / 6)) for r in found}
    lexicon_terms, table = terms, grammar()

    def measured(batches):
        lexicon = Lexicon(lexicon_terms)
        for batch in batches:
            got = [clause_features(t, lexicon, table)[0].tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    seen = rows.mapInArrow(common.lean(measured), "x array<double>, toxic int").collect()  # at most ``size`` short vectors
    x, y = np.array([r.x for r in seen]), np.array([r.toxic for r in seen], float)
    order = np.lexsort((y, *x.T))
    return {"terms": terms, "weights": _logistic(x[order], y[order])}


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 40, decay: float = 1e-3) -> np.ndarray:
    """Newton steps; last weight is the bias. Six weights: element-wise sums, no BLAS on the driver."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip((x * w).sum(1), -30, 30)))
        slope = (x * (p - y)[:, None]).sum(0) / len(y) + decay * w
        bend = np.stack([(x * (x[:, k] * p * (1 - p))[:, None]).sum(0) for k in range(len(w))]) / len(y) + decay * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _scorer(model: dict):
    terms, weights, table, own = model["terms"], model["weights"], grammar(), []

    def run(texts: list[str]) -> list[tuple[float, int]]:
        if not own:
            own.append(Lexicon(terms))
        out = []
        for text in texts:
            x, clauses = clause_features(text, own[0], table)
            out.append((float(1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))), clauses))
        return out

    return run


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, clauses (matched) of every row's whole text; narrow."""

    def run(batches):
        scorer = _scorer(model)
        for batch in batches:
            got = scorer(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.float64()), pa.array([int(g[0] >= 0.5) for g in got], pa.int32()), pa.array([g[1] for g in got], pa.int32())], ["doc_id", "held_out", "score", "predicted", "clauses"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), common.text_of(text_col).alias("text"))
    return rows.mapInArrow(common.lean(run), "doc_id long, held_out boolean, score double, predicted int, clauses int")


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", learn_from: DataFrame | None = None) -> DataFrame:
    """The rows that are not predicted toxic, columns as they came."""
    model = fit(learn_from if learn_from is not None else docs, labels, LEARN, id_col, text_col)
    scorer = _scorer(model)

    @F.pandas_udf(T.BooleanType())
    def clean(texts):
        return type(texts)([g[0] < 0.5 for g in scorer(list(texts))], dtype=bool)

    return docs.filter(clean(common.text_of(text_col)))

"""Quality classifier from weak labels.

Twelve heuristic labellers vote on every text, nine of them bad (0) or nothing, three good (1) or nothing. Expectation-maximisation over the
counts of vote patterns of the whole corpus estimates how often each labeller votes on good and on bad texts, and so its accuracy, without any
given label. The posteriors then label a bounded sample, and a linear scorer over hashed features of the text learns
from it; the scorer judges every document by its whole text.

What the driver sees: the patterns' counts (at most PATTERNS rows are possible, 2 ** 12) and SAMPLE feature vectors.

Defined results: a null or empty text has no words, gets no votes and scores EMPTY; very long texts are read whole;
equal texts have equal scores, whatever their other columns and those columns' names, so rows that repeat are judged alike; a score of
exactly THRESHOLD is good; null ids are kept; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Documents that the scorer is fitted on (bounded sample, by a hash of the id), and width of the hashed features.
SAMPLE, WIDTH = 4000, 1024
EMPTY = 0.5
#: Letters added to a text's length in its shares: a few signs in a very short text prove nothing.
DAMP = 30
THRESHOLD = 0.5
#: Labellers: name, vote, conditions that must all hold for it (else no vote).
LABELLERS = (
    ("symbols", 0, (("symbol", ">", 0.09),)),
    ("capitals", 0, (("upper", ">", 0.30),)),
    ("variety", 0, (("unique", "<", 0.35),)),
    ("stutter", 0, (("stutter", ">", 0.15),)),
    ("shouting", 0, (("bang", ">", 0.10),)),
    ("table", 0, (("bar", ">", 0.10),)),
    ("runs", 0, (("run", ">", 0.10),)),
    ("lines", 0, (("same_line", ">", 0.50),)),
    ("letters", 0, (("alpha", "<", 0.68),)),
    ("prose", 1, (("symbol", "<", 0.06), ("upper", "<", 0.12), ("alpha", ">", 0.72), ("stutter", "<", 0.10), ("unique", ">", 0.40))),
    ("plain", 1, (("unique", ">", 0.45), ("stutter", "<", 0.04), ("bang", "<", 0.02), ("bar", "<", 0.02), ("run", "<", 0.02), ("upper", "<", 0.20))),
    ("lengths", 1, (("word", "<", 12.0), ("word", ">", 2.0), ("same_line", "<", 0.34), ("symbol", "<", 0.08), ("unique", ">", 0.35), ("bang", "<", 0.05))),
)
PATTERNS = 2 ** len(LABELLERS)
STATS = ("symbol", "upper", "unique", "stutter", "bang", "bar", "run", "same_line", "alpha", "word")
_RUN = re.compile(r"[^\w\s]{3,}")


def stats(text: str) -> dict[str, float] | None:
    """Shares that the labellers look at; None without words."""
    words = text.split()
    if not words:
        return None
    n, chars = len(words), len(text)
    alpha = sum(map(str.isalpha, text)) if not text.isascii() else len(text.translate(_KEEP_ALPHA))
    blank = chars - sum(map(len, words))
    digits = sum(map(text.count, "0123456789"))
    lines = [x for x in text.split("\n") if x.strip()]
    upper = len(text.translate(_KEEP_UPPER)) if text.isascii() else sum(map(str.isupper, text))
    return {
        "symbol": max(0, chars - alpha - blank - digits) / (chars + DAMP),
        "upper": upper / (alpha + DAMP),
        "unique": len(set(words)) / n if n >= 20 else 1.0,
        "stutter": sum(map(str.__eq__, words, words[1:])) / (n + 5),
        "bang": text.count("!!") / (n + 5),
        "bar": text.count("|") / (n + 5),
        "run": len(_RUN.findall(text)) / (n + 5),
        "same_line": 1 - len(set(lines)) / len(lines) if len(lines) >= 4 else 0.0,
        "alpha": (alpha + DAMP) / (chars + DAMP),
        "word": (chars - blank) / n,
    }


_KEEP_ALPHA = {c: None for c in range(128) if not chr(c).isalpha()}
_KEEP_UPPER = {c: None for c in range(128) if not chr(c).isupper()}


def votes(s: dict[str, float] | None) -> list[int]:
    """1 good, 0 bad, -1 no vote, of each labeller."""
    if s is None:
        return [-1] * len(LABELLERS)
    holds = lambda rule: s[rule[0]] > rule[2] if rule[1] == ">" else s[rule[0]] < rule[2]
    return [vote if all(map(holds, rules)) else -1 for _, vote, rules in LABELLERS]


def features(text: str, s: dict[str, float] | None) -> np.ndarray:
    """Hashed features: byte triples (square roots of shares) and statistics in twelfths of their log scale."""
    out = np.zeros(WIDTH, np.float32)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    half = WIDTH // 2
    if len(raw) > 2:
        kind = _KIND[raw].astype(np.uint32)
        triple = (kind[:-2] * np.uint32(961) + kind[1:-1] * np.uint32(31) + kind[2:]) * np.uint32(2654435761) >> np.uint32(32 - 9)
        count = np.bincount(triple, minlength=half)[:half]
        out[:half] = np.sqrt(count / count.sum())
    if s is not None:
        for k, name in enumerate(STATS):
            out[half + k * 48 + min(47, int(12 * np.log1p(s[name] * (1 if name == "word" else 40))))] = 1
    return out


#: Class of a byte: letters fold to case, digits and blanks to one class, symbols stay apart.
_KIND = np.array([1 if chr(b).islower() else 2 if chr(b).isupper() else 3 if chr(b).isdigit() else 4 if chr(b).isspace() else 5 if b > 127 else 6 + b % 25 for b in range(256)], np.uint8)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """(share of good texts, labellers' accuracies, posterior of each pattern) by expectation-maximisation.

    Each labeller has a chance to vote on a good and on a bad text; its accuracy is the share of its votes that the
    posteriors confirm. Starts from the majority of votes, ties as undecided.
    """
    voted = patterns >= 0
    sides = np.array([vote for _, vote, _ in LABELLERS])
    weight = counts / max(1, counts.sum())
    lead = (patterns == 1).sum(1) - (patterns == 0).sum(1)
    posterior = 1 / (1 + np.exp(-2.0 * lead))
    accuracy = np.full(patterns.shape[1], 0.5)
    prior = 0.5
    for _ in range(rounds):
        prior = float(np.clip((weight * posterior).sum(), 0.02, 0.98))
        chance = [np.clip(((weight * share)[:, None] * voted).sum(0) / max(1e-9, (weight * share).sum()), 1e-3, 1 - 1e-3) for share in (1 - posterior, posterior)]
        odds = np.log(prior / (1 - prior)) + np.where(voted, np.log(chance[1] / chance[0]), np.log((1 - chance[1]) / (1 - chance[0]))).sum(1)
        new = np.where(voted.any(1), 1 / (1 + np.exp(-np.clip(odds, -500, 500))), prior)
        moved = np.abs(new - posterior).max(initial=0)
        posterior = new
        right = np.where(sides == 1, posterior[:, None], 1 - posterior[:, None])
        accuracy = ((weight[:, None] * voted * right).sum(0) + 1e-9) / ((weight[:, None] * voted).sum(0) + 2e-9)
        if moved < 1e-6:
            break
    return prior, accuracy, posterior


def train(x: np.ndarray, y: np.ndarray, rounds: int = 12, decay: float = 2e-4) -> np.ndarray:
    """Weights and bias of a logistic scorer on soft labels, by Newton's method with a ridge."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1).astype(np.float64)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) / len(y) + decay * w
        bend = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x / len(y) + decay * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w - step
        if np.abs(step).max() < 1e-5:
            break
    return w


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [votes(stats(t)) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["".join("-01"[v + 1] for v in f) for f in found])], ["doc_id", "votes"])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(votes(s := stats(t)), features(t, s)) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(["".join("-01"[v + 1] for v in f) for f, _ in found], pa.string()), pa.array([x.tobytes() for _, x in found], pa.binary())], ["votes", "features"])


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_of(text_col).alias("text"))


def sample_of(rows: DataFrame, size: int) -> DataFrame:
    """At most ``size`` rows, chosen by hashes of id and text, each id and text once; only ids and hashes are sorted."""
    keyed = rows.withColumn("_hash", F.xxhash64("text"))
    chosen = keyed.select(F.col("doc_id").alias("_id"), F.col("_hash").alias("_own")).distinct().orderBy(F.xxhash64("_id"), "_id", "_own").limit(size)
    met = keyed.join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_own")), "left_semi")
    return met.dropDuplicates(["doc_id", "_hash"]).drop("_hash")


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Model: weights of the scorer, the labellers' accuracies, the share of good texts."""
    rows = rows_of(docs, id_col, text_col)
    counted = rows.mapInArrow(common.lean(_measured), "doc_id long, votes string").groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()
    if not counted:
        return {"weights": np.zeros(WIDTH + 1), "accuracy": np.full(len(LABELLERS), 0.5), "prior": 0.5}
    patterns = np.array([["-01".index(v) - 1 for v in r.votes] for r in counted])
    prior, accuracy, posterior = estimate(patterns, np.array([r.n for r in counted], float))
    by_votes = {r.votes: p for r, p in zip(counted, posterior, strict=True)}
    seen = sample_of(rows, sample).mapInArrow(common.lean(_featured), "votes string, features binary").filter(F.col("votes") != "-" * len(LABELLERS))

    def fitted(batches):
        """One task over at most ``sample`` rows: Spark gives its workers one BLAS thread."""
        got = sorted((r["features"], by_votes.get(r["votes"], prior)) for batch in batches for r in batch.to_pylist())
        x = np.stack([np.frombuffer(f, np.float32) for f, _ in got]) if got else np.zeros((0, WIDTH), np.float32)
        w = train(x, np.array([y for _, y in got])) if got else np.zeros(WIDTH + 1)
        yield pa.RecordBatch.from_arrays([pa.array([w.tolist()], pa.list_(pa.float64()))], ["weights"])

    weights = seen.repartition(1).mapInArrow(common.lean(fitted), "weights array<double>").first()
    return {"weights": np.array(weights[0]) if weights else np.zeros(WIDTH + 1), "accuracy": accuracy, "prior": prior}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, keep, votes_good, votes_bad of every row's whole text; narrow."""
    weights = model["weights"].astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, good, bad = [], [], []
            for text in batch.column(1).to_pylist():
                s = stats(text)
                v = votes(s)
                scores.append(EMPTY if s is None else float(1 / (1 + np.exp(-np.clip(features(text, s) @ weights[:-1] + weights[-1], -50, 50)))))
                good.append(v.count(1))
                bad.append(v.count(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([x >= THRESHOLD for x in scores], pa.bool_()), pa.array(good, pa.int32()), pa.array(bad, pa.int32())], ["doc_id", "score", "keep", "votes_good", "votes_bad"])

    return rows_of(docs, id_col, text_col).mapInArrow(common.lean(run), "doc_id long, score double, keep boolean, votes_good int, votes_bad int")


def classify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Fit on the corpus, then score all of it."""
    return score(docs, fit(docs, sample))


def keep(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that the scorer keeps, columns as they came."""
    weights = fit(docs, sample, id_col, text_col)["weights"].astype(np.float32)

    @F.pandas_udf(T.BooleanType())
    def good(texts):
        out = [(s := stats(t)) is None and EMPTY >= THRESHOLD or s is not None and float(features(t, s) @ weights[:-1] + weights[-1]) >= 0 for t in texts]
        return type(texts)(out, dtype=bool)

    return docs.filter(good(common.text_of(text_col)))

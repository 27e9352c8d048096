"""Masked pseudo-likelihood of documents by a bidirectional window network.

The network predicts every word from the two words on either side: context embeddings weighted by position sum to
a hidden vector, a softmax over classes and slots of a class gives the slot's probability, and a table of all words of
the corpus the word's within its slot. The SLOTS / 2 most frequent words have slots of their own, the others
share hash slots; there a word's probability is its count over the slot's, with one count left for any unseen word.
That table has a row for every distinct word and is joined in Spark, so it grows with the corpus.

Training covers every word of every document: partitions of at least PART_TOKENS words run Adagrad over their own texts in numpy, starting from
the same weights, and the partitions' weights are averaged by tokens, FAN at a time, in rounds; a corpus of fewer words
takes more rounds. A document's log_prob sums its slots' conditional log-probabilities, word_log_prob its words'.

Defined results: null, empty and blank texts have no words and all sums and means 0; very long texts are read whole;
equal texts have equal scores, so rows that repeat are scored alike; of equally frequent words those with the smaller hash
come first; null ids are kept; other columns are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, shingles

CLASSES, PER_CLASS, WIDTH, SIDE = 32, 32, 16, 2
SLOTS = CLASSES * PER_CLASS
ROUNDS, BATCH, RATE = 1, 4096, 0.3
FAN = 32
#: Words that a training partition has at least, and rounds that a smaller corpus takes at most.
PART_TOKENS, MOST_ROUNDS = 1 << 20, 8
#: Log-probabilities within slots are whole multiples of 1 / GRAIN, so that their sums don't depend on the order.
GRAIN = 1_000_000


class Network:
    """Weights in one flat vector, so that averaging is plain arithmetic."""

    SHAPES = {"embed": (SLOTS + 1, WIDTH), "place": (2 * SIDE, WIDTH), "top": (CLASSES, WIDTH), "top_bias": (CLASSES,), "low": (CLASSES, PER_CLASS, WIDTH), "low_bias": (CLASSES, PER_CLASS)}
    SIZE = sum(int(np.prod(s)) for s in SHAPES.values())

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        for name, shape in self.SHAPES.items():
            n = int(np.prod(shape))
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def fresh(cls, seed: int = 1) -> Network:
        net = cls(np.random.default_rng(seed).normal(0, 0.1, cls.SIZE).astype(np.float32))
        net.place += 1
        net.top_bias[:] = 0
        net.low_bias[:] = 0
        return net

    def hidden(self, context: np.ndarray) -> np.ndarray:
        """Sum of the context's embeddings, each weighted by its position: a table a position, so no product is made twice."""
        h = (self.embed * self.place[0])[context[:, 0]]
        for k in range(1, 2 * SIDE):
            h += (self.embed * self.place[k])[context[:, k]]
        return h

    @staticmethod
    def softmax(logits: np.ndarray, axis: int = 1) -> np.ndarray:
        logits -= logits.max(axis, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis, keepdims=True)
        return logits

    def shares(self, h: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of classes and of slots within the own class, a column a word; words lie by class, which begin at ``cuts``.

        Columns of all words are normalised at once: sums and maxima run along memory, not over 32 values a word.
        """
        within = np.empty((PER_CLASS, len(h)), np.float32)
        for c in range(CLASSES):
            if cuts[c] < cuts[c + 1]:
                within[:, cuts[c] : cuts[c + 1]] = self.low[c] @ h[cuts[c] : cuts[c + 1]].T + self.low_bias[c][:, None]
        return self.softmax(self.top @ h.T + self.top_bias[:, None], 0), self.softmax(within, 0)

    @staticmethod
    def by_class(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of words by class, and where each class begins."""
        top = (words // PER_CLASS).astype(np.uint8)
        order = np.argsort(top, kind="stable")
        return order, np.searchsorted(top[order], np.arange(CLASSES + 1))

    def log_probs(self, words: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Conditional log-probability of each word."""
        order, cuts = self.by_class(words)
        own, at = words[order], np.arange(len(words))
        of_class, within = self.shares(self.hidden(context[order]), cuts)
        p = np.empty(len(words), np.float32)
        p[order] = of_class[own // PER_CLASS, at] * within[own % PER_CLASS, at]
        return np.log(np.maximum(p, 1e-30).astype(np.float64))

    def step(self, words: np.ndarray, context: np.ndarray, memory: Network) -> None:
        """One Adagrad step on the mean negative log-probability."""
        order, cuts = self.by_class(words)
        words, context = words[order], context[order]
        n, at = len(words), np.arange(len(words))
        h = self.hidden(context)
        p, q = self.shares(h, cuts)
        grad = Network(np.zeros(self.SIZE, np.float32))
        p[words // PER_CLASS, at] -= 1
        q[words % PER_CLASS, at] -= 1
        grad.top[:], grad.top_bias[:] = p @ h, p.sum(1)
        back = p.T @ self.top
        for c in range(CLASSES):
            if cuts[c] < cuts[c + 1]:
                mine = slice(cuts[c], cuts[c + 1])
                grad.low[c], grad.low_bias[c] = q[:, mine] @ h[mine], q[:, mine].sum(1)
                back[mine] += q[:, mine].T @ self.low[c]
        # what comes back to a slot at a position; the gradients of embeddings and positions both follow from it
        size = SLOTS + 1
        ids = (context.T + size * np.arange(2 * SIDE)[:, None]).ravel()
        met = np.empty((2 * SIDE, size, WIDTH), np.float32)
        for d in range(WIDTH):
            met[:, :, d] = np.bincount(ids, weights=np.tile(back[:, d], 2 * SIDE), minlength=2 * SIDE * size).reshape(2 * SIDE, size)
        grad.place[:] = (met * self.embed).sum(1)
        for k in range(2 * SIDE):
            grad.embed += met[k] * self.place[k]
        grad.flat /= n
        memory.flat += grad.flat**2
        self.flat -= RATE * grad.flat / (np.sqrt(memory.flat) + 1e-6) * 0.3


def tokens(texts: list[str], frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, context ids, where each text begins): frequent words by rank, others by bucket."""
    hashes, at = shingles.word_hashes(texts)
    return *placed(hashes, at, frequent), at


def placed(hashes: np.ndarray, at: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, context ids) of hashed words."""
    ordered, rank = frequent[np.argsort(frequent)], np.argsort(frequent)
    spot = np.minimum(np.searchsorted(ordered, hashes), max(0, len(ordered) - 1))
    rest = len(frequent) + (hashes % np.uint64(SLOTS - len(frequent))).astype(np.int64)
    ids = np.where(ordered[spot] == hashes, rank[spot], rest) if len(frequent) else rest
    n = len(ids)
    start = np.repeat(at[:-1], np.diff(at))
    stop = np.repeat(at[1:], np.diff(at))
    index = np.arange(n)
    context = np.full((n, 2 * SIDE), SLOTS, np.int64)
    for k, move in enumerate([m for m in range(-SIDE, SIDE + 1) if m]):
        to = index + move
        inside = (to >= start) & (to < stop)
        context[inside, k] = ids[to[inside]]
    return ids, context


def rare_words(hashes: np.ndarray, ids: np.ndarray, at: np.ndarray, known: int) -> tuple[pa.Array, pa.Array]:
    """Distinct words of each text that have no slot of their own, and how often each occurs."""
    rare = np.flatnonzero(ids >= known)
    text = np.searchsorted(at, rare, side="right") - 1
    order = np.lexsort((hashes[rare], text))
    text, word = text[order], hashes[rare][order]
    new = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (text[1:] != text[:-1])])) if len(word) else np.zeros(0, np.int64)
    offsets = pa.array(np.searchsorted(text[new], np.arange(len(at))), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(word[new].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(np.diff(np.append(new, len(word))), pa.int64()))


def word_counts(rows: DataFrame) -> DataFrame:
    """Table of (word, n): every distinct word of the corpus by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            words = [shingles.word_hashes(texts[a:b])[0] for a, b in shingles.blocks(texts)]
            if words:
                values, n = np.unique(np.concatenate(words), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n, pa.int64())], ["word", "n"])

    counted = rows.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return common.written(counted, "lm-words")


def frequent_words(counted: DataFrame, count: int = SLOTS // 2) -> np.ndarray:
    """Hashes of the corpus's most frequent words; at most ``count`` reach the driver."""
    top = counted.orderBy(F.desc("n"), "word").limit(count).collect()
    return np.array([r.word for r in top], np.int64).view(np.uint64)


def slot_of(known: int) -> Column:
    """Hash slot of a word, counted from 0: its hash as an unsigned number modulo the hash slots."""
    count = SLOTS - known
    signed = F.pmod(F.col("word"), F.lit(count))
    return F.when(F.col("word") < 0, F.pmod(signed + (1 << 64) % count, F.lit(count))).otherwise(signed).cast("int")


def words_in_slots(counted: DataFrame, frequent: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """Table of (word, n, grains: log-probability within its slot) of all words without their own slot; grains of an unseen word by slot."""
    own = F.broadcast(counted.sparkSession.createDataFrame([(w,) for w in frequent.view(np.int64).tolist()], "word long"))
    rest = counted.join(own, "word", "left_anti").withColumn("slot", slot_of(len(frequent)))
    totals = np.ones(SLOTS - len(frequent))
    for r in rest.groupBy("slot").agg(F.sum("n").alias("n")).collect():  # at most SLOTS rows
        totals[r.slot] += r.n
    logs = np.log(totals)
    log_total = F.element_at(F.lit(logs.tolist()), F.col("slot") + 1)
    words = rest.select("word", "n", F.round((F.log("n") - log_total) * GRAIN).cast("long").alias("grains"))
    return common.written(words, "lm-slots"), np.round(-logs * GRAIN).astype(np.int64)


def averaged(parts: DataFrame) -> np.ndarray | None:
    """Token-weighted mean of the partitions' weights, FAN at a time."""

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        weight = group["weight"].to_numpy(float)
        total = sum(w * np.frombuffer(f, np.float32).astype(np.float64) for w, f in zip(weight, group["flat"], strict=True))
        return pd.DataFrame({"part": [int(group["part"].iloc[0]) // FAN], "weight": [weight.sum()], "flat": [(total / weight.sum()).astype(np.float32).tobytes()]})

    parts = common.written(parts, "lm-weights")
    while (n := parts.count()) > FAN:
        parts = common.written(parts.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(merge, "part long, weight double, flat binary"), "lm-weights")
    if not n:
        return None
    return np.frombuffer(merge(parts.toPandas())["flat"].iloc[0], np.float32).copy()  # at most FAN rows


def fit(docs: DataFrame, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Model: hashes of the frequent words, the network's weights, all other words' probabilities in their slots."""
    rows = docs.select(common.text_of(text_col).alias("text"))
    counted = word_counts(rows)
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = frequent_words(counted)
    words, unseen = words_in_slots(counted, frequent)
    rows = rows.coalesce(max(1, total // PART_TOKENS))
    rounds = max(rounds, min(MOST_ROUNDS, -(-PART_TOKENS // max(1, total))))
    flat = Network.fresh().flat
    for _ in range(rounds):
        start = flat

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            net, memory, seen = Network(start.copy()), Network(np.full(Network.SIZE, 1e-4, np.float32)), 0
            for batch in batches:
                texts = batch.column(0).to_pylist()
                for a, b in shingles.blocks(texts):
                    ids, context, _ = tokens(texts[a:b], frequent)
                    for k in range(0, len(ids), BATCH):
                        net.step(ids[k : k + BATCH], context[k : k + BATCH], memory)
                    seen += len(ids)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([float(seen)]), pa.array([net.flat.tobytes()], pa.binary())], ["part", "weight", "flat"])

        got = averaged(rows.mapInArrow(run, "part long, weight double, flat binary"))
        flat = flat if got is None else got
    return {"frequent": frequent, "flat": flat, "words": words, "unseen": unseen}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_prob (sum over the slots), word_log_prob (over the words) and their means, of every row's whole text.

    The network's part is narrow. Within slots a text is a bag of words, so its distinct rare words meet the table of
    all words in one join. A model without that table gives no word_log_prob.
    """
    frequent, flat = model["frequent"], model["flat"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, row = Network(flat), TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in shingles.blocks(texts):
                hashes, at = shingles.word_hashes(texts[a:b])
                ids, context = placed(hashes, at, frequent)
                each = np.concatenate([net.log_probs(ids[k : k + BATCH], context[k : k + BATCH]) for k in range(0, len(ids), BATCH)] or [np.zeros(0)])
                n = np.diff(at)
                total = np.array([each[at[k] : at[k + 1]].sum() for k in range(len(n))])
                words, counts = rare_words(hashes, ids, at, len(frequent))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + b - a)), batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(total, pa.float64()), words, counts], ["row", "doc_id", "n_tokens", "log_prob", "words", "counts"])
                row += b - a

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_of(text_col).alias("text"))
    rows = rows.mapInArrow(run, "row long, doc_id long, n_tokens long, log_prob double, words array<long>, counts array<long>")
    mean = lambda c: (F.col(c) / F.greatest("n_tokens", F.lit(1))).alias(f"mean_{c}")
    if "words" not in model:
        rows = rows.withColumn("word_log_prob", F.lit(None).cast("double"))
    else:
        rows = common.written(rows, "lm-rows")
        bags = rows.select("row", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
        unseen = F.element_at(F.lit(model["unseen"].tolist()), slot_of(len(frequent)) + 1)
        total = model["words"].agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        known = model["words"].withColumnRenamed("n", "occurs")  # a word of many texts is looked up by broadcast
        met = common.resolve(bags, known, "word", "occurs", total, F.col("row")).select("row", (F.col("n") * F.coalesce("grains", unseen)).alias("grains"))
        sums = met.groupBy("row").agg((F.sum("grains") / GRAIN).alias("within"))
        rows = rows.drop("words", "counts").join(sums, "row", "left").withColumn("word_log_prob", F.col("log_prob") + F.coalesce("within", F.lit(0.0)))
    return rows.select("doc_id", "n_tokens", "log_prob", mean("log_prob"), "word_log_prob", mean("word_log_prob"))

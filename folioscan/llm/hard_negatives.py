"""Hard negatives by threshold joins of vectors: near rows of another label, just below an anchor's positives.

1. Rows are checked and made whole numbers (floor of SCALE times each component); a row that repeats id, label and vector
   counts once.
2. Anchors, the stated query set, meet all rows of their label in blocks of at most ANCHORS x ROWS, and keep their POSITIVES
   best; then all rows of other labels, with one window of scores for each positive.
3. In a block, rows and anchors join by threshold. An inverted index lists rows by dimension, those of most energy first; a
   row leaves out its last dimensions, as soon as their norm alone can't lift any of the anchors to the threshold. Partial
   scores accumulate list by list; rows go as soon as their score and the norms of what remains stay below every threshold. Those
   that are left are scored exactly. Thresholds start near the window's top and are lowered, for anchors with
   windows still short, until all windows are full or their lower ends are reached.
4. Each block sends at most the wanted number of rows for each window; the best of all blocks are ranked by a window function.

Scale: each row is sent once for every ANCHORS anchors, each anchor once for every ROWS rows (the work of a query set
that grows with the table is their product). Blocks are bounded by hash cells, whatever share of the rows one label or one vector
holds. Only the dimensions' energies, the largest component and the numbers of blocks of large labels reach the driver or are broadcast.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part; a null id is never an anchor and
comes last in ties; shorter vectors count as filled up with zeros; a vector without components scores 0; rows of the
anchor's own id are neither positive nor negative; an id with several labels or vectors is so many rows; equal
scores go by id; scores are exact at any size and raise where they don't fit into a long; an empty table gives an
empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

EVERY, SCALE, POSITIVES, NEGATIVES = 50, 256, 5, 3
#: A negative's score is at least LOW and at most HIGH hundredths of the positive's.
LOW, HIGH = 50, 95
#: Labels of ids divisible by NOISE are moved on by one of LABELS.
NOISE, LABELS = 7, 10
#: Most anchors and rows of a block; blocks of small tables hold ROOT times the root of all rows.
ANCHORS, ROWS, ROOT = 2048, 16384, 16
#: Anchors that share an index, dimensions that are added at once.
SHARED, STEP = 32, 8
#: Thresholds, as parts of the way from a window's top to its lower end.
LEVELS = (0.125, 0.25, 0.375, 0.5, 1.0)
_EXACT = 1 << 53


def rows_of(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """none (no id), id, label (moved on for some ids), vec (whole numbers), row (tells apart rows of one id), anchor."""
    vec = F.col(vector_col).cast("array<double>")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    whole = F.transform(vec, lambda x: F.when(F.abs(x) < 2.0**44, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE))  # beyond that all doubles are whole
    id_ = F.col(id_col).cast("long")
    label = F.when(id_ % NOISE == 0, (F.col(label_col) + 1) % LABELS).otherwise(F.col(label_col)).cast("long")
    taken = vectors.filter(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & fine)
    rows = taken.select(id_.isNull().alias("none"), F.coalesce(id_, F.lit(0)).alias("id"), label.alias("label"), whole.alias("vec")).distinct()
    return rows.select("*", F.xxhash64("none", "id", "label", "vec").alias("row"), (~F.col("none") & (F.col("id") % EVERY == 0)).alias("anchor"))


class Block:
    """Rows of a block, dimensions in ``order``; ids ascend, so that the first of equal scores has the smallest."""

    def __init__(self, rows: pd.DataFrame, order: np.ndarray):
        rows = rows.sort_values(["none", "id"], ignore_index=True)
        self.none, self.ids, self.labels = (rows[c].to_numpy() for c in ("none", "id", "label"))
        self.x = filled(rows["vec"], order)
        self.rest = norms(self.x)

    def index(self, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inverted index for anchors that need ``least`` of a unit vector: row order, listed dimensions of each, lists' lengths.

        A row lists dimensions until what follows has a norm below ``least``; rows with most come first, so that
        the list of dimension d is the first ``lengths[d]`` rows.
        """
        listed = (self.rest[:, :-1] >= least).sum(1)
        order = np.argsort(-listed, kind="stable")
        lengths = np.searchsorted(-listed[order], -np.arange(self.x.shape[1]), "left")
        return order, listed[order], lengths

    def candidates(self, q: np.ndarray, q_rest: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (anchor, row) that may reach the anchor's threshold."""
        size = np.maximum(q_rest[:, 0], 1e-300)
        order, listed, lengths = self.index(float((thresholds / size).min()) * (1 - 1e-9) if (thresholds > 0).all() else -math.inf)
        rows = order[: lengths[0]] if len(lengths) else order
        listed, score = listed[: len(rows)], np.zeros((len(q), len(rows)))
        slack = 1e-9 * np.abs(thresholds) + 1e-6 * size
        for d in range(0, self.x.shape[1], STEP):
            wide = min(STEP, self.x.shape[1] - d)
            n = int(np.searchsorted(-listed, -d, "left"))  # the rows that list dimension d
            if not n:
                break
            part = self.x[rows[:n], d : d + wide] * (listed[:n, None] > np.arange(d, d + wide))
            score[:, :n] += q[:, d : d + wide] @ part.T
            end = np.minimum(listed, d + wide)
            alive = (score + q_rest[:, end] * self.rest[rows, end] >= (thresholds - slack)[:, None]).any(0)
            if not alive.all():
                rows, listed, score = rows[alive], listed[alive], score[:, alive]
        end = listed
        a, r = np.nonzero(score + q_rest[:, end] * self.rest[rows, end] >= (thresholds - slack)[:, None])
        return a, rows[r]

    def search(self, q: np.ndarray, q_ids: np.ndarray, fits, low: list[list], high: list[list], want: int) -> Iterator[tuple[int, int, np.ndarray, list]]:
        """(anchor, window, rows, scores): of each window the ``want`` best rows of the block.

        ``fits(anchors, rows)`` says which pairs may be; a window holds scores from low to high.
        """
        q_rest = norms(q)
        far = q_rest[:, 0] * self.rest[:, 0].max(initial=0)
        top = np.array([min(x) if x else 0 for x in high], float).clip(-far, far)
        end = np.array([min(x) if x else 0 for x in low], float).clip(-far, far)
        scorer = exact_scorer(q, self.x)
        going = np.array([k for k in range(len(q)) if low[k]], int)
        for part in LEVELS:
            if not len(going):
                return
            thresholds = top[going] - part * (top[going] - end[going]) if part < 1 else np.full(len(going), -math.inf)
            thresholds = np.maximum(thresholds, end[going] - 1e-6 * (1 + far[going])) if part == 1 else thresholds
            a, r = self.candidates(q[going], q_rest[going], thresholds)
            right = fits(going[a], r) & (self.none[r] | (self.ids[r] != q_ids[going[a]]))
            a, r = a[right], r[right]
            scores = scorer(going[a], r)
            reached = scores >= thresholds[a]
            a, r, scores = a[reached], r[reached], scores[reached]
            cuts = np.searchsorted(a, np.arange(len(going) + 1))
            short = []
            for k, anchor in enumerate(going):
                mine, his = r[cuts[k] : cuts[k + 1]], scores[cuts[k] : cuts[k + 1]]
                best = np.lexsort((mine, -his)) if his.dtype != object else np.array(sorted(range(len(his)), key=lambda i: (-his[i], mine[i])), int)
                mine, his = mine[best], his[best]
                wins = [[i for i in np.flatnonzero((his >= lo) & (his <= hi))[:want]] for lo, hi in zip(low[anchor], high[anchor], strict=True)]
                if part < 1 and min(map(len, wins)) < want:
                    short.append(anchor)
                    continue
                yield from ((int(anchor), w, mine[i], his[i].tolist()) for w, i in enumerate(wins) if len(i))
            going = np.array(short, int)


def filled(vectors: pd.Series, order: np.ndarray) -> np.ndarray:
    """Vectors as rows of equal width, dimensions in ``order``."""
    out = np.zeros((len(vectors), len(order)))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v  # shorter ones are filled up
    return out[:, order]


def norms(x: np.ndarray) -> np.ndarray:
    """Norm of what follows from each dimension on; one column more than dimensions."""
    with np.errstate(over="ignore"):
        squares = np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([squares, np.zeros((len(x), 1))], axis=1))


def exact_scorer(q: np.ndarray, x: np.ndarray):
    """Whole-number inner products of pairs: in doubles where all sums stay exact, else in unbounded numbers."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, x.shape[1]) < _EXACT:
        return lambda a, r: np.concatenate([np.einsum("ij,ij->i", q[a[k : k + 65536]], x[r[k : k + 65536]]) for k in range(0, len(a), 65536)] or [np.zeros(0)])
    return lambda a, r: np.array([sum(int(u) * int(v) for u, v in zip(q[i], x[j], strict=True)) for i, j in zip(a, r, strict=True)], object)


def _long(values: list) -> pd.Series:
    """Scores as longs; raises where one doesn't fit."""
    return pd.Series([int(v) for v in values], dtype="int64")


def _blocks(left: pd.DataFrame, right: pd.DataFrame, order: np.ndarray, fits, want: int, windows) -> pd.DataFrame:
    """All windows of the anchors of a block, in groups that share an index."""
    if left.empty or right.empty:
        return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("id", "row", "window", "found", "score")})
    block, out = Block(right, order), []
    q, labels, ids = filled(left["vec"], order), left["label"].to_numpy(), left["id"].to_numpy()
    for a in range(0, len(left), SHARED):
        some = left.iloc[a : a + SHARED]
        low, high = zip(*map(windows, some["scores"]), strict=True)
        pick = lambda k, r, a=a: fits(labels[a + k], block.labels[r])
        for k, w, rows, scores in block.search(q[a : a + SHARED], ids[a : a + SHARED], pick, low, high, want):
            out += [(some["id"].iloc[k], some["row"].iloc[k], w, None if block.none[i] else block.ids[i], s) for i, s in zip(rows, scores, strict=True)]
    found = pd.DataFrame(out, columns=["id", "row", "window", "found", "score"], dtype=object)
    return found.assign(found=pd.array([None if f is None else int(f) for f in found["found"]], dtype="Int64"), score=_long(found["score"]))


FOUND = "id long, row long, window int, found long, score long"


def _cells(count: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(count / size)).cast("int")


def _joined(anchors: DataFrame, rows: DataFrame, keys: list[str], run) -> DataFrame:
    """Blocks: anchors (with cells ``rows_in`` of the other side) meet rows (with ``anchors_in``) under ``keys``."""
    cell = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    left = anchors.select("*", cell("anchors_in").alias("a_cell"), F.explode(F.sequence(F.lit(0), F.col("rows_in") - 1)).alias("r_cell")).drop("anchors_in", "rows_in")
    right = rows.select(*[F.col(c).alias(c) for c in ("none", "id", "label", "vec")], cell("rows_in").alias("r_cell"), F.explode(F.sequence(F.lit(0), F.col("anchors_in") - 1)).alias("a_cell"))
    by = [*keys, "a_cell", "r_cell"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(run, FOUND)


def best(rows: DataFrame, size: int, order: np.ndarray) -> DataFrame:
    """id, row, positives and scores of each anchor's POSITIVES best rows of its label; the blocks are made label by label."""
    side = min(ROWS, 1 + ROOT * math.isqrt(size))
    large = rows.groupBy("label").agg(_cells(F.count("*"), side).alias("rows_in"), _cells(F.count_if("anchor"), ANCHORS).alias("anchors_in")).filter("rows_in > 1 or anchors_in > 1")
    if size // side <= 1 << 20:  # at most so many labels can be large
        large = F.broadcast(large)
    dealt = rows.join(large, "label", "left").fillna(1, ["rows_in", "anchors_in"])

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        windows = lambda _: ([-math.inf], [math.inf])
        return _blocks(left, right, order, lambda a, r: np.ones(len(r), bool), POSITIVES, windows)

    anchors = dealt.filter("anchor").withColumn("scores", F.array().cast("array<long>"))
    found = _joined(anchors, dealt, ["label"], run)
    rank = F.row_number().over(Window.partitionBy("id", "row").orderBy(F.desc("score"), F.asc_nulls_last("found")))
    top = found.withColumn("rank", rank).filter(F.col("rank") <= POSITIVES)
    listed = F.array_sort(F.collect_list(F.struct("rank", "found", "score")))  # POSITIVES at most
    return top.groupBy("id", "row").agg(listed.alias("listed")).select("id", "row", F.col("listed.found").alias("positives"), F.col("listed.score").alias("scores"))


def negatives(rows: DataFrame, positives: DataFrame, size: int, order: np.ndarray) -> DataFrame:
    """id, row, window (place of the positive), found, score, rank: NEGATIVES best rows of other labels in each window."""
    count = rows.filter("anchor").count()
    cells = lambda df: df.withColumn("rows_in", _cells(F.lit(size), min(ROWS, 1 + ROOT * math.isqrt(size)))).withColumn("anchors_in", _cells(F.lit(count), ANCHORS))
    anchors = rows.filter("anchor").join(positives.select("id", "row", "scores"), ["id", "row"])

    def windows(scores) -> tuple[list, list]:
        own = [int(s) for s in scores if s >= 0]  # the best come first; below 0 no negative's score fits
        return [-(-LOW * s // 100) for s in own], [HIGH * s // 100 for s in own]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _blocks(left, right, order, lambda a, r: a != r, NEGATIVES, windows)

    found = _joined(cells(anchors), cells(rows), [], run)
    rank = F.row_number().over(Window.partitionBy("id", "row", "window").orderBy(F.desc("score"), F.asc_nulls_last("found")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= NEGATIVES)


def mine(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = common.written(rows_of(vectors, id_col, vector_col, label_col), "negatives-rows")
    size = rows.count()
    energy = rows.select(F.posexplode("vec").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x") * F.col("x")).alias("energy")).collect()  # one row a dimension
    order = np.array([r["at"] for r in sorted(energy, key=lambda r: (-r["energy"], r["at"]))], int)
    positives = common.written(best(rows, size, order), "negatives-positives")
    found = negatives(rows, positives, size, order)
    at = F.col("window") + 1
    return found.join(positives, ["id", "row"]).select(
        F.col("id").alias("anchor_id"),
        F.element_at("positives", at).alias("positive_id"),
        "rank",
        F.col("found").alias("negative_id"),
        F.element_at("scores", at).alias("positive_score"),
        F.col("score").alias("negative_score"),
    )

"""Packing by cutting-stock column generation.

A document's ids and its end id are cut into full sequences and one rest. Spark counts the rests by length (in
units of GRAIN tokens, rounded up): the histogram is all that the driver sees, at most CAPACITY / GRAIN numbers. There
a linear program over patterns (how many pieces of each length share a sequence) is solved by column
generation: the master's duals price new patterns by an unbounded-knapsack dynamic program. Patterns are
rounded down, what is left is filled largest first, and Spark assigns them: a piece's exact rank among those of its
length finds its pattern, sequence and place.

Defined results: null or empty text is the end id alone; a text's pieces are gapless and cover every id; a sequence
never holds more than CAPACITY; very long texts give many full pieces and one rest; rows that repeat, null and repeated
ids are packed each, ties in any order; an empty table gives an empty table; other columns are ignored, whatever their
names. The program raises where it doesn't come within GAP of its bound.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bpe, common

CAPACITY, GRAIN, END_ID = 2048, 8, 1
#: The program stops when its value is within this share of the bound that the pricing proves.
GAP = 2e-4
#: Bytes of text whose distinct words are looked up together.
BLOCK = 32 << 20
#: Letters that are whole in NFC and lower to one letter each, and a stop at most.
LATIN = r"^[A-Za-zÀ-ÖØ-öø-įı-ɏ]+[.,]?$"


class LibraryBPE(bpe.WordBPE):
    """Words merged by the tokenizers library's model, ids as little-endian unsigned 32-bit bytes; the rest as in bpe."""

    @classmethod
    def load(cls, path: str) -> LibraryBPE:
        from tokenizers import Tokenizer

        out = super().load(path)
        out.tokenize = Tokenizer.from_file(path).model.tokenize
        return out

    def merge(self, word: str) -> bytes:
        """Printable ASCII stands for itself among the byte letters."""
        letters = word if word.isascii() and word.isprintable() else "".join([self.letters[b] for b in word.encode("utf-8")])
        ids = [t.id for t in self.tokenize(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def plain(self, text: str) -> bytes:
        return b"".join([self.words[w] for w in self.split(text)])

    def chunk(self, text: str) -> bytes:
        if "<" not in text and self.angled:
            return self.plain(text)
        parts = self.specials.split(text) if self.specials else [text]
        return b"".join([struct.pack("<I", self.special[p]) if k % 2 else self.plain(p) for k, p in enumerate(parts)])


_worker: dict[str, tuple[LibraryBPE, bpe._Cached]] = {}


def chunk_ids(own: LibraryBPE, value, chunks: pa.Array) -> pa.Array:
    """Id bytes of distinct chunks. A Latin word, perhaps with a stop, is lowered and parted in Arrow; all others go to ``value``."""
    latin = pc.match_substring_regex(chunks, LATIN)
    at = np.flatnonzero(latin.to_numpy(zero_copy_only=False))
    rest = np.setdiff1d(np.arange(len(chunks)), at, assume_unique=True)
    own_chunks = chunks.take(pa.array(at))
    heads = pc.utf8_lower(pc.utf8_rtrim(own_chunks, characters=".,")).dictionary_encode()
    words = pa.array(map(own.words.__getitem__, heads.dictionary.to_pylist()), pa.large_binary()).take(heads.indices)
    stop = pc.add(pc.ends_with(own_chunks, ".").cast(pa.int8()), pc.multiply(pc.ends_with(own_chunks, ",").cast(pa.int8()), pa.scalar(2, pa.int8())))
    stops = pa.array([b"", own.words["."], own.words[","]], pa.large_binary()).take(stop)
    both = pc.binary_join_element_wise(words, stops, pa.scalar(b"", pa.large_binary()))
    others = pa.array(map(value, chunks.take(pa.array(rest)).to_pylist()), pa.large_binary())
    return pa.concat_arrays([both, others]).take(pa.array(np.argsort(np.concatenate([at, rest]))))


def encoded(own: LibraryBPE, value, texts: pa.Array) -> tuple[memoryview, np.ndarray]:
    """Id bytes of all texts one after another, and where each begins: distinct words are looked up once, Arrow does the rest.

    No token crosses white space; a text with signs that count as such in one place only is encoded by itself.
    """
    split = pc.utf8_split_whitespace(texts)
    words = split.flatten().dictionary_encode()
    ids = chunk_ids(own, value, words.dictionary).take(words.indices)
    data, at = ids.buffers()[2], np.frombuffer(ids.buffers()[1], np.int64)[split.offsets.to_numpy()]
    odd = np.flatnonzero(pc.match_substring_regex(texts, bpe.ODD_BLANKS.pattern).to_numpy(zero_copy_only=False))
    if not len(odd):
        return memoryview(data or b""), at
    alone = {k: b"".join(map(value, own.pieces(texts[k].as_py()))) for k in odd.tolist()}
    parts = [alone[k] if k in alone else data[int(at[k]) : int(at[k + 1])].to_pybytes() for k in range(len(texts))]
    return memoryview(b"".join(parts)), np.cumsum([0, *map(len, parts)])


def cutter(tokenizer: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _worker:
            own = LibraryBPE.load(tokenizer)
            _worker[tokenizer] = (own, bpe._Cached(own.chunk))
        own, cache = _worker[tokenizer]
        end, value = struct.pack("<I", end_id), cache.__getitem__
        for batch in batches:
            ids, sizes = batch.column(0).to_pylist(), np.cumsum(pc.binary_length(batch.column(1)).to_numpy())
            cuts = np.unique([0, *np.searchsorted(sizes, np.arange(BLOCK, sizes[-1] if len(sizes) else 0, BLOCK)) + 1, len(ids)])
            for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                data, at = encoded(own, value, batch.column(1).slice(a, b - a))
                rows = []
                for doc_id, low, high in zip(ids[a:b], at.tolist(), at[1:].tolist(), strict=False):
                    n = (high - low) // 4 + 1
                    for start in range(0, n, capacity):
                        crc = zlib.crc32(data[low + 4 * start : min(high, low + 4 * (start + capacity))])
                        whole = min(capacity, n - start)
                        rows.append((doc_id, start, whole, zlib.crc32(end, crc) if start + whole == n else crc, n))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def price(duals: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of highest dual value: unbounded knapsack by dynamic programming."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        n = int(np.searchsorted(sizes, room, side="right"))
        best[room], took[room] = best[room - 1], -1
        if n:
            values = best[room - sizes[:n]] + duals[:n]
            k = int(values.argmax())
            if values[k] > best[room] + 1e-12:
                best[room], took[room] = values[k], k
    pattern, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            pattern[took[room]] += 1
            room -= sizes[took[room]]
    return float(best[capacity]), pattern


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivots, element-wise operations only: a driver's BLAS threads may be at odds with Spark's."""
    n = len(matrix)
    both = np.concatenate([matrix, np.eye(n)], 1)
    for k in range(n):
        best = k + int(np.abs(both[k:, k]).argmax())
        both[[k, best]] = both[[best, k]]
        both[k] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0
        both -= factor[:, None] * both[k]
    return both[:, n:]


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return (matrix * vector).sum(1)


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP, most: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as columns, times): covers ``demand`` exactly in the fewest sequences, fractions allowed."""
    m = len(sizes)
    columns = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(columns))
    demand = demand + 1e-7 * np.arange(1, m + 1)  # ties in the ratio test, else pivots may cycle
    times = _times(inverse, demand)
    for step in range(most):
        duals = inverse.sum(0)
        value, pattern = price(duals, sizes, capacity)
        if value <= 1 + 1e-9 or times.sum() * (1 - 1 / value) <= gap * times.sum():
            break
        move = _times(inverse, pattern)
        up = move > 1e-10
        ratio = np.full(m, np.inf)
        ratio[up] = np.maximum(times[up], 0) / move[up]
        out = int(ratio.argmin())
        columns[:, out] = pattern
        if step % 100 == 99:
            inverse = _inverse(columns)
        else:
            row = inverse[out] / move[out]
            inverse -= np.outer(move, row)
            inverse[out] = row
        times = _times(inverse, demand)
    else:
        raise RuntimeError(f"column generation did not come within {gap} of the bound in {most} steps")
    return columns, np.maximum(times, 0)


def plan(lengths: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(unit, from rank, to rank, copies, first sequence, first place) rows that assign every piece of the histogram."""
    sizes = np.array(sorted(lengths), np.int64)
    left = np.array([lengths[s] for s in sizes], np.int64)
    used: list[tuple[np.ndarray, int]] = []
    if len(sizes):
        columns, times = column_generation(sizes, left.astype(float), capacity)
        for k in np.argsort(-times, kind="stable"):
            pattern = np.round(columns[:, k]).astype(np.int64)
            whole = int(min([np.floor(times[k] + 1e-4), *(left[pattern > 0] // pattern[pattern > 0])]))
            if whole > 0:
                used.append((pattern, whole))
                left -= pattern * whole
    while left.any():  # what rounding left: largest first
        pattern, room = np.zeros_like(left), capacity
        for k in range(len(sizes) - 1, -1, -1):
            pattern[k] = min(left[k], room // sizes[k])
            room -= pattern[k] * sizes[k]
        whole = int((left[pattern > 0] // pattern[pattern > 0]).min())
        used.append((pattern, whole))
        left -= pattern * whole
    rows, begun, sequence = [], np.zeros_like(left), 0
    for pattern, whole in used:
        place = 0
        for k in np.flatnonzero(pattern):
            n = int(pattern[k])
            rows.append((int(sizes[k]), int(begun[k]), int(begun[k]) + n * whole, n, sequence, place))
            begun[k] += n * whole
            place += n
        sequence += whole
    return rows


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, grain: int = GRAIN, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_of(text_col).alias("text"))
    cut = rows.mapInArrow(common.lean(cutter(tokenizer, capacity, end_id)), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    cut = common.written(cut.withColumns({"unit": F.ceil(F.col("length") / grain).cast("int"), "piece": F.monotonically_increasing_id()}), "pack-pieces")
    histogram = {r.unit: r["n"] for r in cut.groupBy("unit").agg(F.count("*").alias("n")).collect()}  # at most capacity / grain rows
    table = spark.createDataFrame(plan(histogram, capacity // grain), "unit int, low long, high long, copies long, base long, place long")
    dealt = common.ranked(cut, ["unit"], ["doc_id", "start", "ids_crc32", "piece"], ["piece"], sum(histogram.values()), "rank")
    fits = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    placed = dealt.alias("p").join(F.broadcast(table).alias("t"), (F.col("p.unit") == F.col("t.unit")) & fits)
    local = F.col("rank") - F.col("low")
    placed = placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.floor(local / F.col("copies"))).alias("sequence_id"), (F.col("place") + local % F.col("copies")).alias("_place"))
    before = Window.partitionBy("sequence_id").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))

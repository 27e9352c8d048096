"""Spelling variants: words one edit apart, found by a variable-length gram index.

1. Words are counted over all documents (DataFrame functions; copies of a word fold before the shuffle).
2. Gram dictionary: grams of QMIN code points and longer ones, level by level. A gram is lengthened only while more than
   ``limit`` positions hold it; the tree below a rarer one is pruned. So the list of most grams is short.
3. A word, with a sign before and after it, is decomposed at each position into the gram that the dictionary gives there,
   read to the right and, in a second set, to the left. What a position gives depends on that gram's letters only.
4. Per-word bound: one edit at a letter can change no grams but those that span it; the largest number that span one letter
   is the bound. Two near words share all but so many of their grams, so each needs only its bound + 1 rarest
   grams' lists merged: they meet in at least one. The other, longer lists are left out.
5. Merged lists give candidates of nearly equal length, and these are verified: exactly one letter inserted, deleted or
   replaced. A pair that meets in several lists is kept in the smallest. Only verified pairs leave a task.

Scale: the dictionary is broadcast; it holds at most DICTIONARY grams by arithmetic (``limit`` follows the number of
positions). Lists longer than SIDE (grams that end with the word, or have QMAX letters, can't be lengthened) are
split into blocks that meet in pairs. All tables that later steps read again are written to the shared folder.

Defined results: a null text has no words, a null id counts as an empty one; rows that repeat count each; ties of a
form go to the smallest word in code-point order; very long texts and words are read whole; an empty table
gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, shingles

RUN = "[^A-Za-z\\u00C0-\\u00FF]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: One in so many runs loses a letter; words have at least so many code points and occurrences.
NOISE, LENGTH, LEAST = 97, 5, 3
#: A form occurs at least so many times as often as its word.
LEAD = 2
#: Shortest and longest gram; most grams in the dictionary; smallest bound of a list; words of a block of a long list.
QMIN, QMAX, DICTIONARY, LIST, SIDE = 3, 12, 1 << 20, 64, 1024
#: Rows of lists that a task merges at once, and letters that it decomposes at once.
ROWS, LETTERS = 1 << 17, 1 << 20
FIRST, LAST = "\x02", "\x03"
MOST_ROUNDS = 60
_U = np.uint64


def words_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: all words of the corpus after the deletions."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.split(common.text_of(text_col), RUN)).alias("run")).filter("run != ''")
    runs = runs.select("id", F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", CAPITALS, CAPITALS.lower())).alias("run"))
    drawn = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("draw"))
    at = (F.col("draw") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("draw") % NOISE == 0, cut).otherwise(F.col("run"))
    return drawn.groupBy(word.alias("word")).agg(F.count("*").alias("n")).filter((F.length("word") >= LENGTH) & (F.col("n") >= LEAST))


class Grams:
    """Frequent grams by their hash, which positions hold more than the limit; they are lengthened."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], np.concatenate([self.counts, counts])[order]

    def count(self, keys: np.ndarray) -> np.ndarray:
        """Positions of frequent grams, 0 for others."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], 0)


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each between two signs, and where each begins (one entry more than words)."""
    flat = np.frombuffer("".join(f"{FIRST}{w}{LAST}" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat.astype(np.uint64), np.cumsum([0] + [len(w) + 2 for w in words])


def _longest(letters: np.ndarray, at: np.ndarray, side: int, grams: Grams, levels: int) -> tuple[np.ndarray, ...]:
    """Of one reading direction: start, length, hash and count (0: not frequent) of each position's gram."""
    ends = np.repeat(at[1:], np.diff(at))
    start = np.flatnonzero(np.arange(len(letters)) + QMIN <= ends)
    length, count = np.full(len(start), QMIN), np.zeros(len(start), np.int64)
    with np.errstate(over="ignore"):
        key = np.full(len(start), side + 1, np.uint64)
        for k in range(QMIN):
            key = shingles.mix(key * _U(shingles.BASE) + letters[start + k])
        going = np.arange(len(start))
        for q in range(QMIN, levels + 1):
            count[going] = grams.count(key[going])
            if q == levels:
                break
            going = going[(count[going] > 0) & (start[going] + q < ends[start[going]])]
            key[going] = shingles.mix(key[going] * _U(shingles.BASE) + letters[start[going] + q])
            length[going] = q + 1
    return start, length, key, count


def decompose(words: list[str], grams: Grams, levels: int = QMAX):
    """owner, key, count of all grams of both directions, and each word's bound (most grams that span a letter)."""
    letters, at = _letters(words)
    back = np.repeat(at[:-1] + at[1:] - 1, np.diff(at)) - np.arange(len(letters))  # place of a letter in the word read backwards
    spans = np.zeros(len(letters) + 1, np.int64)
    owner, keys, counts = [], [], []
    word_at = np.repeat(np.arange(len(words)), np.diff(at))
    for side, read in enumerate((letters, letters[back])):
        start, length, key, count = _longest(read, at, side, grams, levels)
        first = start if side == 0 else back[start + length - 1]
        spans += np.bincount(first, minlength=len(spans)) - np.bincount(first + length, minlength=len(spans))
        owner.append(word_at[start])
        keys.append(key)
        counts.append(count)
    cover = np.cumsum(spans)[:-1]
    inner = (letters != ord(FIRST)) & (letters != ord(LAST))
    bound = np.maximum.reduceat(np.where(inner, cover, 0), at[:-1]) if len(words) else np.zeros(0, np.int64)
    return np.concatenate(owner), np.concatenate(keys), np.concatenate(counts), bound


def _chunks(words: list[str]) -> Iterator[tuple[int, int]]:
    ends = np.cumsum([len(w) + 2 for w in words])
    a = 0
    while a < len(words):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + LETTERS)))
        yield a, b
        a = b


def dictionary(words: DataFrame) -> tuple[Grams, int]:
    """Frequent grams of all lengths, and the limit they exceed. At most DICTIONARY grams reach the driver."""
    places = 2 * (words.agg(F.sum(F.length("word"))).first()[0] or 0)
    limit = max(LIST, -(-places * (QMAX - QMIN + 1) // DICTIONARY))
    grams = Grams()
    for q in range(QMIN, QMAX + 1):
        sent = words.sparkSession.sparkContext.broadcast(grams)

        def counted(batches: Iterator[pa.RecordBatch], q: int = q, sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(0).to_pylist()
                for a, b in _chunks(texts):
                    letters, at = _letters(texts[a:b])
                    back = np.repeat(at[:-1] + at[1:] - 1, np.diff(at)) - np.arange(len(letters))
                    keys = []
                    for side, read in enumerate((letters, letters[back])):
                        _, length, key, _ = _longest(read, at, side, sent.value, q)
                        keys.append(key[length == q])
                    found, n = np.unique(np.concatenate(keys), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], ["key", "n"])

        level = words.select("word").mapInArrow(counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > limit).toArrow()
        if not level.num_rows:
            break
        grams.add(level.column("key").to_numpy().astype(np.int64).view(np.uint64), level.column("n").to_numpy().astype(np.int64))
    return grams, limit


def signatures(words: list[str], grams: Grams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """owner, key, count of the lists that each word needs: its bound + 1 rarest grams, each once, ascending keys."""
    owner, key, count, bound = decompose(words, grams)
    order = np.lexsort((key, count, owner))
    owner, key, count = owner[order], key[order], count[order]
    rank = np.arange(len(owner)) - np.searchsorted(owner, np.arange(len(words)))[owner]
    need = rank <= bound[owner]
    owner, key, count = owner[need], key[need], count[need]
    order = np.lexsort((key, owner))
    owner, key, count = owner[order], key[order], count[order]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])]) if len(owner) else np.zeros(0, bool)
    return owner[new], key[new], count[new]


def lists(words: DataFrame, grams: Grams) -> DataFrame:
    """list, key, side, word, n, keys: one row for each list that a word is in; long lists are split into blocks.

    ``side``: 0 or 1 where a block compares two parts of a list, 2 where it compares a part with itself.
    """
    sent = words.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ns = batch.column(0).to_pylist(), batch.column(1)
            for a, b in _chunks(texts):
                owner, key, count = signatures(texts[a:b], sent.value)
                starts = np.searchsorted(owner, np.arange(b - a + 1))
                packed = [key[x:y].tobytes() for x, y in zip(starts, starts[1:], strict=False)]
                cells = np.maximum(1, -(-count // SIDE))
                with np.errstate(over="ignore"):
                    own = (shingles.mix(shingles.word_hashes(texts[a:b])[0])[owner] % cells.astype(np.uint64)).astype(np.int64)
                    rows = np.repeat(np.arange(len(owner)), cells)
                    other = np.arange(len(rows)) - np.repeat(np.cumsum(cells) - cells, cells)
                    low, high = np.minimum(own[rows], other), np.maximum(own[rows], other)
                    name = np.where(cells[rows] == 1, key[rows], shingles.mix(shingles.mix(key[rows] + low.astype(np.uint64)) + high.astype(np.uint64)))
                side = np.where(low == high, 2, np.where(own[rows] == low, 0, 1))
                who = owner[rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name.view(np.int64)), pa.array(key[rows].view(np.int64)), pa.array(side.astype(np.int8)), pa.array(texts[a:b]).take(pa.array(who)), ns.slice(a, b - a).take(pa.array(who)), pa.array(packed, pa.binary()).take(pa.array(who))],
                    ["list", "key", "side", "word", "n", "keys"],
                )

    return words.select("word", "n").mapInArrow(run, "list long, key long, side byte, word string, n long, keys binary")


def _common(letters: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, step: int) -> np.ndarray:
    """How many letters agree from a and b on, at most ``size``, in steps of 1 or -1."""
    agreed, going, k = np.zeros(len(a), np.int64), np.flatnonzero(size > 0), 0
    while len(going):
        going = going[letters[a[going] + step * k] == letters[b[going] + step * k]]
        k += 1
        agreed[going] = k
        going = going[size[going] > k]
    return agreed


def one_edit(letters: np.ndarray, start: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of words differ by exactly one letter inserted, deleted or replaced; sizes differ by one at most."""
    short, long = np.where(size[a] <= size[b], a, b), np.where(size[a] <= size[b], b, a)
    least = size[short]
    head = _common(letters, start[short], start[long], least, 1)
    tail = _common(letters, start[short] + least - 1, start[long] + size[long] - 1, least, -1)
    return np.where(size[long] == least, (head < least) & (head + tail >= least - 1), head + tail >= least)


def _met(table: pa.Table) -> pa.RecordBatch:
    """Verified pairs within the lists of a table that is sorted by list."""
    name, key, side = (table.column(c).to_numpy() for c in ("list", "key", "side"))
    words, n = table.column("word").to_pylist(), table.column("n")
    letters, at = _letters(words)
    start, size = at[:-1] + 1, np.diff(at) - 2
    order = np.lexsort((size, name))  # within a list by length, so that words of other lengths are soon out of reach
    name, side_of = name[order], side[order]
    going, found = np.arange(len(name)), []
    for d in range(1, len(name)):
        going = going[going + d < len(name)]
        going = going[(name[going] == name[going + d]) & (size[order[going + d]] - size[order[going]] <= 1)]
        if not len(going):
            break
        a, b = order[going], order[going + d]
        met = (side_of[going] == 2) | (side_of[going] != side_of[going + d])
        a, b = a[met], b[met]
        near = one_edit(letters, start, size, a, b)
        found.append(np.stack([a[near], b[near]]))
    a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    mine = _smallest(table.column("keys").to_pylist(), a, b) == key[a].view(np.uint64)
    a, b = pa.array(a[mine]), pa.array(b[mine])
    word, n = table.column("word").combine_chunks(), n.combine_chunks()
    return pa.RecordBatch.from_arrays([word.take(a), n.take(a), word.take(b), n.take(b)], ["a", "na", "b", "nb"])


def _smallest(keys: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest list that the words of each pair share; every pair shares one."""
    sizes = np.array([len(k) // 8 for k in keys], np.int64)
    wide = np.full((len(keys), sizes.max(initial=1)), ~_U(0))
    wide[np.arange(wide.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(keys), np.uint64)
    out = np.zeros(len(a), np.uint64)
    for k in range(0, len(a), 1 << 14):
        x, y = wide[a[k : k + (1 << 14)]], wide[b[k : k + (1 << 14)]]
        shared = (x[:, :, None] == y[:, None, :]).any(2)
        out[k : k + (1 << 14)] = x[np.arange(len(x)), shared.argmax(1)]
    return out


def near_pairs(words: DataFrame, most: int = ROWS) -> DataFrame:
    """a, na, b, nb: every pair of words that differ by one edit, once, in any order. ``most``: rows that a task merges at once."""
    grams, _ = dictionary(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= most:
                table = pa.Table.from_batches(held)
                name = table.column("list").to_numpy()
                cut = int(np.searchsorted(name, name[-1]))  # the last list may go on
                held = table.slice(cut).combine_chunks().to_batches()
                if cut:
                    yield _met(table.slice(0, cut))
        if held:
            yield _met(pa.Table.from_batches(held))

    rows = lists(words, grams).repartition("list").sortWithinPartitions("list")
    return rows.mapInArrow(run, "a string, na long, b string, nb long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of all words that have a form; a form occurs more often than its word, so chains end."""
    links = common.written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(MOST_ROUNDS):
        up = links.select(F.col("word").alias("at"), F.col("root").alias("next"))
        links = common.written(links.join(up, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if links.filter("moved").isEmpty():
            return links.select("word", "root")
        links = links.select("word", "root")
    raise RuntimeError("roots did not settle")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n: one row for each word of the corpus."""
    words = common.written(words_of(docs, id_col, text_col), "spelling-words")
    pairs = common.written(near_pairs(words), "spelling-pairs")
    sides = pairs.select(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("near"), F.col("nb").alias("near_n"))
    sides = sides.unionAll(pairs.select("b", "nb", "a", "na"))
    best = sides.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    led = -F.col("best.less") >= LEAD * F.col("n")
    best = common.written(best.select("word", "n_near", F.when(led, F.col("best.near")).alias("form"), F.when(led, -F.col("best.less")).alias("form_n")), "spelling-forms")
    found = words.join(best, "word", "left").join(roots(best.filter("form is not null")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


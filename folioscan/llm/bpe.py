"""Byte-pair encoding and decoding over a tokenizer file, whole texts.

The merge loop keeps the symbols of a word in a doubly linked list and the mergeable pairs in a
priority queue of (rank, position); an entry whose pair has changed since it was queued is stale
and skipped. Decoding concatenates vocabulary strings.

The file's rules (fixed format): NFC, white space to one blank, lower case letter by letter; words by the
pattern below; every byte of a word becomes a printable letter and the last one carries the
word-end mark. Special tokens are found in the raw text first.

Defined results: a null or empty text has no ids and decodes to the empty text; very long words
cost n log n; rows that repeat give equal rows; an empty table gives an empty table; other columns are
ignored, whatever their names. Letters, numbers and case are those of the tokenizers library's Unicode.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.normalizers import NFC, Lowercase
from tokenizers.pre_tokenizers import Split

from . import common



def _ranges(points: list[int]) -> str:
    """Ascending code points as the inside of a pattern's class."""
    starts = [c for k, c in enumerate(points) if not k or points[k - 1] != c - 1]
    ends = [c for k, c in enumerate(points) if k + 1 == len(points) or points[k + 1] != c + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True)) or "\\ud800"


#: Code points that Python's Unicode doesn't have. The tokenizers library's tables are newer than Python's and older than regex's, so these are asked of the library.
_UNKNOWN = [c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn"]
UNKNOWN = re.compile(f"[{_ranges(_UNKNOWN)}]")
_NEW = regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, _UNKNOWN)))
_KNOWS = Split(Regex(r"\p{L}|\p{N}"), "removed")
#: Fixed values of the tokenizer file's pre-tokenizer, with the library's letters and numbers.
_NEITHER = _ranges([ord(c) for c in _NEW if _KNOWS.pre_tokenize_str(c)])
WORDS = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{_NEITHER}]]+|[\p{{N}}--[{_NEITHER}]]|[[^\s\p{{L}}\p{{N}}]||[{_NEITHER}]]+")
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
BLANKS = regex.compile(r"\s+")
#: Characters that str.split() parts at and the pattern's white space doesn't, or the other way round.
ODD_BLANKS = re.compile("[\x1c-\x1f᠎​]")
_NFC, _LOWER = NFC(), Lowercase()
END = "</w>"
#: Entries of the newer half of a worker's cache of encoded chunks. Bounds memory, not results.
CACHE = 400_000


def byte_letters() -> dict[int, str]:
    """A printable letter for every byte: printable Latin-1 bytes stand for themselves, the rest follow from code point 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Cached(dict):
    """Value of a key, made on first use. A full cache becomes the older half, which is asked before making anew."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) < 64:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class WordBPE:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.rank = {pair: k for k, pair in enumerate(pairs)}
        self.string = {i: s for s, i in (self.vocab | self.special).items()}
        self.letters = byte_letters()
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.angled = all("<" in s for s in self.special)
        self.words = _Cached(self.merge)

    @classmethod
    def load(cls, path: str) -> WordBPE:
        with open(path, encoding="utf-8") as file:
            return cls(json.load(file))

    def merge(self, word: str) -> tuple[int, ...]:
        """Ids of one normalised word."""
        symbols: list[str | None] = [self.letters[b] for b in word.encode("utf-8")]
        symbols[-1] += END
        rank, last = self.rank, len(symbols) - 1
        if last == 0:
            return tuple(self.vocab[s] for s in symbols if s in self.vocab)
        after, before = list(range(1, last + 2)), list(range(-1, last))
        queue = [(r, k, a, b) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := rank.get((a, b))) is not None]
        heapq.heapify(queue)
        while queue:
            _, k, a, b = heapq.heappop(queue)
            right = after[k]
            if symbols[k] != a or right > last or symbols[right] != b:
                continue  # stale: one side has merged since
            symbols[k], symbols[right] = a + b, None
            after[k] = far = after[right]
            if far <= last:
                before[far] = k
                if (r := rank.get((a + b, symbols[far]))) is not None:
                    heapq.heappush(queue, (r, k, a + b, symbols[far]))
            if (left := before[k]) >= 0 and (r := rank.get((symbols[left], a + b))) is not None:
                heapq.heappush(queue, (r, left, symbols[left], a + b))
        return tuple(self.vocab[s] for s in symbols if s is not None and s in self.vocab)

    def split(self, text: str) -> list[str]:
        """Normalised words of a text without special tokens."""
        head = text[:-1] if text[-1:] in (".", ",") else text
        if head.isalpha() and "Σ" not in head and (head.isascii() or unicodedata.is_normalized("NFC", head)) and (low := head.lower()).isalpha():
            return [low] if head is text else [low, text[-1]]  # the usual case: one word, perhaps with a stop
        if text.isascii():
            return ASCII_WORDS.findall(text.lower())
        if UNKNOWN.search(text):
            return WORDS.findall(_LOWER.normalize_str(BLANKS.sub(" ", _NFC.normalize_str(text))))
        return WORDS.findall("".join(map(str.lower, BLANKS.sub(" ", unicodedata.normalize("NFC", text)))))

    def plain(self, text: str) -> tuple[int, ...]:
        """Ids of a text without special tokens."""
        found = self.split(text)
        return self.words[found[0]] if len(found) == 1 else tuple([i for w in found for i in self.words[w]])

    def chunk(self, text: str) -> tuple[int, ...]:
        """Ids of any text, special tokens found first."""
        if self.specials is None or "<" not in text and self.angled or not any(s in text for s in self.special):
            return self.plain(text)
        parts = self.specials.split(text)
        return tuple(i for k, p in enumerate(parts) for i in ((self.special[p],) if k % 2 else self.plain(p)))

    def pieces(self, text: str) -> list[str]:
        """Parts at white space: no token crosses it, so the parts encode one by one."""
        return BLANKS.split(text) if ODD_BLANKS.search(text) else text.split()

    def encode(self, text: str) -> list[int]:
        return [i for p in self.pieces(text) for i in self.chunk(p)]

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings with a blank between; special tokens are kept."""
        return " ".join([self.string[i] for i in ids])


_worker: dict[tuple[str, str], tuple[WordBPE, _Cached]] = {}


def worker_cache(path: str, kind: str, make) -> tuple[WordBPE, _Cached]:
    """One encoder and chunk cache per worker process, tokenizer file and kind of value."""
    if (path, kind) not in _worker:
        bpe = WordBPE.load(path)
        _worker[path, kind] = (bpe, _Cached(make(bpe)))
    return _worker[path, kind]


def digests(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def make(bpe: WordBPE):
        def value(chunk: str) -> tuple[int, str, str]:
            ids = bpe.chunk(chunk)
            return len(ids), " ".join(map(str, ids)), bpe.decode(list(ids))

        return value

    bpe, cache = worker_cache(path, "digest", make)
    sha = lambda text: hashlib.sha256(text.encode("utf-8")).hexdigest()
    for batch in batches:
        count, ids, decoded = [], [], []
        for text in batch.column(1).to_pylist():
            found = [v for p in bpe.pieces(text) if (v := cache[p])[0]]
            count.append(sum([v[0] for v in found]))
            ids.append(sha(" ".join([v[1] for v in found])))
            decoded.append(sha(" ".join([v[2] for v in found])))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row's whole text. Narrow: no shuffle."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_of(text_col).alias("text"))
    return rows.mapInArrow(lambda it: digests(tokenizer, it), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int): the token ids of every row's whole text."""

    def run(batches):
        bpe, cache = worker_cache(tokenizer, "ids", lambda bpe: bpe.chunk)
        for batch in batches:
            ids = [[i for p in bpe.pieces(text) for i in cache[p]] for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, text: the vocabulary strings of ``ids``, a blank between; a null list decodes to the empty text."""

    def run(batches):
        bpe, _ = worker_cache(tokenizer, "ids", lambda bpe: bpe.chunk)
        for batch in batches:
            texts = [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")

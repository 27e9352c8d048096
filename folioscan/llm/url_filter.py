"""URL rules by a bit-parallel wildcard automaton.

Every glob is a row of states, one bit a letter, packed one after another into 64-bit words (Shift-And).
A step reads one byte of every URL of a batch and moves all patterns of all URLs at once: shift by one
with carry between words, keep the bits whose letter fits, and hold the bits of states that a ``*`` follows.
A ``*`` left of the host's end never crosses a ``/``.

Defined results: null urls and urls without ``://`` have empty host and path and match no host rule; very long
urls run in narrower blocks, so a block's matrix stays small; repeated rows give equal rows; null ids are kept; of rules that fit the
longest decides, and no two that fit one url are equally long; an empty table gives an empty table; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (verdict, host suffix, path prefix); the longest fitting rule wins, and among equally long ones the first.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Globs over host and path that decide where no rule fits: first come, first served; else DEFAULT.
GLOBS = (("block", "ads-*"), ("block", "*.ads-*"), ("block", "*/ads/*"))
DEFAULT = "allow"
#: Bytes of one block's URL matrix.
BLOCK = 8 << 20


class Automaton:
    """Shift-And over globs; ``match`` gives a boolean for every URL and pattern."""

    def __init__(self, globs: list[str]):
        letters: list[int] = []  # a state each
        loops: list[int] = []  # 0 none, 1 any byte but '/', 2 any byte
        self.free: list[int] = []  # 0 anchored at the start, 1 or 2: a leading star of that kind
        self.first, self.last = [], []
        for glob in globs:
            raw, kinds, host = glob.encode(), [], True
            cut = raw.find(b"/")
            free, own = 0, []
            for k, b in enumerate(raw):
                host = k < cut if cut >= 0 else False
                if b == ord("*"):
                    if own:
                        kinds[-1] = max(kinds[-1], 1 if host else 2)
                    else:
                        free = max(free, 1 if host else 2)
                else:
                    own.append(b)
                    kinds.append(0)
            if not own:
                raise ValueError("a glob needs a letter")
            self.first.append(len(letters))
            letters += own
            loops += kinds
            self.last.append(len(letters) - 1)
            self.free.append(free)
        self.words = -(-len(letters) // 64)
        self.fits = np.zeros((256, self.words), np.uint64)
        self.hold = np.zeros((256, self.words), np.uint64)
        for k, (b, loop) in enumerate(zip(letters, loops, strict=True)):
            word, bit = k // 64, np.uint64(1 << (k % 64))
            self.fits[b, word] |= bit
            if loop:
                self.hold[:, word] |= bit
                if loop == 1:
                    self.hold[ord("/"), word] &= ~bit
        mask = lambda states: np.array([sum(1 << (s % 64) for s in states if s // 64 == w) for w in range(self.words)], np.uint64)
        self.starts = mask(self.first)
        self.begin = self.starts.copy()
        self.enter = [mask([s for s, f in zip(self.first, self.free, strict=True) if f == 2]), mask([s for s, f in zip(self.first, self.free, strict=True) if f == 1])]

    def match(self, texts: list[bytes]) -> np.ndarray:
        """texts x patterns; whole-string match."""
        out = np.zeros((len(texts), len(self.first)), bool)
        order = sorted(range(len(texts)), key=lambda k: len(texts[k]))
        at = 0
        while at < len(order):
            n = 1
            while at + n < len(order) and (n + 1) * max(1, len(texts[order[at + n]])) <= BLOCK:
                n += 1
            block = order[at : at + n]
            out[block] = self._block([texts[k] for k in block])
            at += n
        return out

    def _block(self, texts: list[bytes]) -> np.ndarray:
        lengths = np.array([len(t) for t in texts])
        wide = int(lengths.max(initial=0))
        grid = np.frombuffer(b"".join(t.ljust(wide, b"\0") for t in texts), np.uint8).reshape(len(texts), wide)
        state = np.zeros((len(texts), self.words), np.uint64)
        slash = np.zeros(len(texts), bool)  # a '/' has been read: stars of the host no longer enter
        for k in range(wide):
            byte = grid[:, k]
            moved = state << np.uint64(1)
            if self.words > 1:
                moved[:, 1:] |= state[:, :-1] >> np.uint64(63)
            moved &= ~self.starts
            moved |= self.begin if k == 0 else self.enter[0] | np.where(slash[:, None], np.uint64(0), self.enter[1])
            new = (moved & self.fits[byte]) | (state & self.hold[byte])
            state = np.where((k < lengths)[:, None], new, state)
            slash |= byte == ord("/")
        return np.stack([state[:, s // 64] >> np.uint64(s % 64) & np.uint64(1) for s in self.last], 1).astype(bool)


def rule_text(rule: tuple[str, str, str]) -> str:
    return rule[1] + rule[2]


def judge(rules=RULES, globs=GLOBS, default: str = DEFAULT):
    """A batch function (id, host, path) -> (id, host, path, rule, verdict)."""
    ranked = sorted(rules, key=lambda r: -len(rule_text(r)))
    patterns = [g for r in ranked for g in (f"{rule_text(r)}*", f"*.{rule_text(r)}*")] + [g for _, g in globs]
    names = np.array([rule_text(r) for r in ranked] + [None] * (len(globs) + 1), object)
    verdicts = np.array([r[0] for r in ranked] + [g[0] for g in globs] + [default], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(patterns)
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            hit = automaton.match([(h + p).encode("utf-8", "replace") for h, p in zip(hosts, paths, strict=True)])
            n = len(ranked)
            hit = np.concatenate([hit[:, 0 : 2 * n : 2] | hit[:, 1 : 2 * n : 2], hit[:, 2 * n :], np.ones((len(hosts), 1), bool)], 1)
            first = hit.argmax(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(names[first].tolist(), pa.string()), pa.array(verdicts[first].tolist(), pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return run


def parts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path; A-Z of the host lower-cased, path without query and fragment."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    split = pages.select(F.col(id_col).alias("page_id"), rest.alias("_rest"))
    host = F.translate(F.regexp_extract("_rest", r"^[^/?#]*", 0), capitals, capitals.lower())
    return split.select("page_id", host.alias("host"), F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))


def filter_urls(pages: DataFrame, rules=RULES, globs=GLOBS, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of every page; only the url column is read. No shuffle."""
    found = parts(pages, id_col, url_col).withColumn("page_id", F.col("page_id").cast("long"))
    return found.mapInArrow(judge(rules, globs, default), "page_id long, host string, path string, rule string, verdict string")

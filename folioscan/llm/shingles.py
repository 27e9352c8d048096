"""Word shingles and MinHash signatures in vectorised numpy.

Words are runs of bytes between ASCII blanks of the lower-cased text; a shingle is five words in a row, or all
words of a shorter text. Word hashes come from one running polynomial sum over a whole block of
texts, shingle hashes from five shifted word-hash vectors, so no Python loop runs per word.
"""

from __future__ import annotations

import hashlib

import numpy as np

WIDTH = 5
#: Bytes of text hashed at once.
BLOCK = 1 << 20
#: Odd multipliers (fixed values) of the polynomial and of the mixer.
BASE, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
_U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(MIX_A)
    x = (x ^ (x >> _U(33))) * _U(MIX_B)
    return x ^ (x >> _U(33))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2**64."""
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _powers:
        if len(_powers) > 2 or size > 1 << 22:
            _powers.clear()
        with np.errstate(over="ignore"):
            _powers[size] = (np.cumprod(np.full(size, BASE, _U)), np.cumprod(np.full(size, pow(BASE, -1, 1 << 64), _U)))
    return _powers[size]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words begin (one entry more than texts)."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    bytes_ = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)
    edges = np.cumsum([1] + [len(r) + 1 for r in raw])
    blank = _BLANK[bytes_]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    up, down = powers(len(bytes_))
    with np.errstate(over="ignore"):
        sums = np.cumsum((bytes_.astype(_U) + _U(1)) * up[: len(bytes_)])
        return mix((sums[ends - 1] - sums[starts - 1]) * down[starts]), np.searchsorted(starts, edges)


def shingle_hashes(texts: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in order with repeats, and where each text's begin."""
    words, at = word_hashes(texts)
    n = len(words)
    if not n:
        return np.zeros(0, _U), np.zeros(len(texts) + 1, np.int64)
    count = np.diff(at)
    stop = np.repeat(at[1:], count)
    index = np.arange(n)
    total = np.zeros(n, _U)
    with np.errstate(over="ignore"):
        for k in range(width):
            inside = index + k < stop
            factor = _U(pow(MIX_B, k + 1, 1 << 64))
            total += np.where(inside, words[np.minimum(index + k, n - 1)] * factor, _U(0))
        total = mix(total)
    first = np.repeat(at[:-1], count) == index
    keep = (index + width <= stop) | first
    return total[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def char_hashes(text: str, width: int = WIDTH) -> np.ndarray:
    """Hashes of all runs of ``width`` code points of the lower-cased text; a shorter text is one run."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(_U)
    if not len(points):
        return np.zeros(0, _U)
    n = max(1, len(points) - width + 1)
    total = np.zeros(n, _U)
    with np.errstate(over="ignore"):
        for k in range(min(width, len(points))):
            total += (points[k : k + n] + _U(1)) * _U(pow(BASE, k + 1, 1 << 64))
        return mix(total)


def blocks(texts: list[str]):
    """(from, to) of runs of texts with about BLOCK characters."""
    at = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > BLOCK:
            yield at, k
            at, size = k, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def shingle_sets(texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for a, b in blocks(texts):
        flat, at = shingle_hashes(texts[a:b], width)
        out += [np.unique(flat[at[k] : at[k + 1]]) for k in range(b - a)]
    return out


def permutations(count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of ``count`` universal hashes x -> a x + b modulo 2**64."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, count, dtype=_U) * _U(2) + _U(1), rng.integers(0, 1 << 63, count, dtype=_U)


def signatures(sets: list[np.ndarray], count: int, seed: int = 1) -> np.ndarray:
    """MinHash signatures (upper 32 bits of each minimum); an empty set has the largest value throughout."""
    out = np.full((len(sets), count), 0xFFFFFFFF, np.uint32)
    a, b = permutations(count, seed)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (size == 0 or size + len(sets[end]) <= 1 << 15):
            size += len(sets[end])
            end += 1
        full = [k for k in range(at, end) if len(sets[k])]
        if full:
            flat = np.concatenate([sets[k] for k in full])
            starts = np.concatenate([[0], np.cumsum([len(sets[k]) for k in full])[:-1]])
            with np.errstate(over="ignore"):
                for j in range(count):
                    out[full, j] = np.minimum.reduceat(flat * a[j] + b[j], starts) >> _U(32)
        at = end
    return out


def choose_bands(threshold: float, recall: float, most: int = 200) -> tuple[int, int]:
    """(bands, rows): the most selective banding that finds a pair at ``threshold`` with at least ``recall``.

    Raises where no banding of at most ``most`` hashes does.
    """
    best = None
    for rows in range(1, 33):
        bands = 1
        while bands * rows <= most and 1 - (1 - threshold**rows) ** bands < recall:
            bands += 1
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError(f"{most} hashes cannot find pairs of likeness {threshold} with recall {recall}")
    return best


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """texts x bands: one 64-bit key for each band, its number mixed in."""
    out = np.zeros((len(signature), bands), _U)
    with np.errstate(over="ignore"):
        for k in range(bands):
            key = np.full(len(signature), _U(k + 1) * _U(MIX_A))
            for r in range(rows):
                key = mix(key + (signature[:, k * rows + r].astype(_U) + _U(1)) * _U(BASE))
            out[:, k] = key
    return out


def set_key(one: np.ndarray) -> bytes:
    """Digest of a shingle set: equal keys are equal sets."""
    return hashlib.blake2b(one.tobytes(), digest_size=16).digest()

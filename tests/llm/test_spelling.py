import random
import re
import zlib
from collections import Counter

import numpy as np

from folioscan.llm import spelling

SCHEMA = "doc_id long, text string"


def plain_counts(rows):
    """Words and their counts by the printed rule."""
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def plain_variants(rows):
    n = plain_counts(rows)
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w, found in near.items():
        if found and n[best := min(found, key=lambda v: (-n[v], v))] >= 2 * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def corpus(seed, stems, size=300):
    """Words built from few stems and endings, with slips, so that grams are frequent and words near."""
    rng = random.Random(seed)
    words = []
    for _ in range(size):
        w = list("".join(rng.choice(stems) for _ in range(rng.randint(1, 3))))
        if w and rng.random() < 0.5:
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], ["é"], [w[k], "x"]])
        words.append("".join(w))
    return [(k, rng.choice([" ", ", ", "\n", "1"]).join(rng.choices(words, k=120))) for k in range(60)]


def got(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df).collect()}


def test_variants_equal_all_pairs(spark):
    for seed, stems in ((1, ["ab", "ba", "aab", "bb"]), (2, ["keit", "heit", "lich", "ung", "Ein", "ver", "über"]), (3, ["aaaaaa", "aaa", "aaaab"])):
        rows = corpus(seed, stems)
        found = got(spark.createDataFrame(rows, SCHEMA).repartition(5))
        assert found == plain_variants(rows) and any(f[1] for f in found)


def test_frequent_grams_and_blocks(spark, monkeypatch):
    """A small limit and small blocks and batches: long grams, split lists, lists over several batches."""
    monkeypatch.setattr(spelling, "LIST", 3)
    rows = corpus(4, ["ab", "ba", "ab×"], 600)
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain_variants(rows)
    words = spelling.words_of(df)
    texts, ns = zip(*[(r.word, r.n) for r in words.collect()], strict=True)
    monkeypatch.setattr(spelling, "QMAX", 5)
    grams, limit = spelling.dictionary(words)
    assert limit == 3 and len(grams.keys) and (grams.counts > limit).all()
    monkeypatch.setattr(spelling, "SIDE", 7)
    owner, key, count = spelling.signatures(list(texts), grams)
    assert (count > 7).any()
    run = spelling.lists(words, grams).repartition(1).sortWithinPartitions("list").toArrow()
    met = spelling._met(run)
    pairs = Counter(tuple(sorted(p)) for p in zip(met.column("a").to_pylist(), met.column("b").to_pylist(), strict=True))
    assert pairs == Counter({(a, b): 1 for a in texts for b in texts if a < b and one_apart(a, b)})
    parts = [(r.a, r.b) for r in spelling.near_pairs(words.coalesce(1), 50).collect()]
    assert Counter(tuple(sorted(p)) for p in parts) == pairs
    assert {w: n for w, n in zip(texts, ns, strict=True)} == {w[0]: w[3] for w in want}


def test_bound_holds():
    """No edit changes more grams of a word than its bound says."""
    rng = random.Random(5)
    pool = ["".join(rng.choice("ab") for _ in range(rng.randint(5, 12))) for _ in range(300)]
    grams = spelling.Grams()
    for q in range(spelling.QMIN, 7):
        n = Counter()
        for w in set(pool):
            _, key, count, _ = spelling.decompose([w], grams, q)
            n.update(key.tolist())
        more = [k for k, v in n.items() if v > 5 and not grams.count(np.array([k], np.uint64))[0]]
        grams.add(np.array(more, np.uint64), np.array([n[k] for k in more], np.int64))
    for w in pool[:100]:
        _, key, _, bound = spelling.decompose([w], grams, 7)
        own = Counter(key.tolist())
        for k in range(len(w) + 1):
            for other in {w[:k] + c + w[k + j :] for c in ("", "a", "b", "c") for j in (0, 1)} - {w}:
                if one_apart(w, other):
                    there = Counter(spelling.decompose([other], grams, 7)[1].tolist())
                    assert sum((own - there).values()) <= bound[0] < sum(own.values())


def test_edges(spark):
    """Null texts and ids, empty table, ties, repeated rows, very long words, clashing columns."""
    long = "ab" * 20_000
    rows = [(None, "house house house mouse mouse mouse"), (1, None), (2, ""), (3, "House"), (3, "House"), (4, "house " * 9), (5, "mouse " * 9), (6, "douse " * 3), (7, "louse " * 6), (8, f"{long} " * 4), (9, f"{long}c " * 9), (10, "1234 -- 中文")]
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, word int, list string")
    assert got(df) == plain_variants(rows)
    assert spelling.variants(df.limit(0)).collect() == []

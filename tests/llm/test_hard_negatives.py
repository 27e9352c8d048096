import math
import random

import numpy as np
import pytest

from folioscan.llm import entries, hard_negatives

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    """The contract, row by row."""
    seen, live = set(), []
    for i, v, y in rows:
        if y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i is not None and i % 7 == 0:
            y = (y + 1) % 10
        q = tuple(math.floor(256 * float(np.float32(x))) for x in v)
        if (i, y, q) not in seen:
            seen.add((i, y, q))
            live.append((i, y, q))
    last = lambda i: (i is None, i or 0)
    out = []
    for a, y, q in live:
        if a is None or a % 50:
            continue
        scored = [(sum(s * t for s, t in zip(q, r, strict=False)), i, z) for i, z, r in live if i != a]
        scored.sort(key=lambda s: (-s[0], last(s[1])))
        for p, pid, _ in [s for s in scored if s[2] == y][:5]:
            fit = [s for s in scored if s[2] != y and 50 * p <= 100 * s[0] <= 95 * p][:3]
            out += [(a, pid, k + 1, n, p, s) for k, (s, n, _) in enumerate(fit)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in hard_negatives.mine(df).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


def test_whole_table_equals_plain(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    found = sorted((tuple(r) for r in entries.op11_hard_negatives(spark, SF).collect()), key=str)
    assert found == plain(rows) and len(found) > 50


def test_small_blocks_equal_plain(spark, monkeypatch):
    """Many blocks on both sides, clustered vectors, a hot label, ties."""
    for name, n in (("ANCHORS", 3), ("ROWS", 16), ("ROOT", 1)):
        monkeypatch.setattr(hard_negatives, name, n)
    rng = random.Random(2)
    centres = [[rng.uniform(-1, 1) for _ in range(12)] for _ in range(6)]
    rows = []
    for i in range(0, 1500, 5):
        c = rng.choice(centres)
        scale = rng.choice([0.01, 1, 5])
        rows.append((i, [round(scale * (x + rng.gauss(0, 0.2)), 2) for x in c], 1 if rng.random() < 0.4 else rng.randrange(10)))
    rows += [(2000 + k, rows[3][1], k % 3) for k in range(30)]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(4)) == plain(rows)


def test_edges(spark):
    """Nulls anywhere, non-finite components, unequal widths, no components, repeated rows and ids, negative ids and labels, clashing columns."""
    nan, inf = math.nan, math.inf
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (0, [0.2, 0.9], 2), (1, [1.0, 0.6], 1), (2, [0.9], 1), (3, [0.8, 0.1, 3.0], 2), (4, [nan, 1.0], 2), (5, [inf, 1.0], 2), (6, [None, 1.0], 2),
            (7, [0.7, 0.4], 1), (8, None, 1), (9, [0.6, 0.3], None), (None, [0.7, 0.4], 2), (None, [0.9, 0.4], 1), (10, [], 2), (-50, [-1.0, 0.4], -3), (50, [0.0, 0.0], 4), (100, [0.0, 0.0], 4), (101, [0.0], 5), (11, [0.7, 0.4], 2), (150, [1.0, 0.5], 1)]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA + ", row int, none int, score string")
    found = got(df)
    assert found == plain(rows) and any(r[3] is None for r in found) and any(r[0] == 50 for r in found)
    assert hard_negatives.mine(df.limit(0)).collect() == []


def test_large_components(spark):
    big = [(50, [3e6, 1e6], 1), (1, [2.9e6, 1.1e6], 1), (2, [2.5e6, 1e6], 2), (3, [1.0, 2.0], 2)]
    assert got(spark.createDataFrame(big, SCHEMA)) == plain(big) != []
    with pytest.raises(Exception, match="too large|Overflow|overflow"):
        got(spark.createDataFrame([(50, [1e30], 1), (1, [1e30], 1), (2, [8e29], 2)], SCHEMA))


def test_index_leaves_out_nothing():
    """Every pair above its threshold is a candidate; weak last dimensions are left out of the lists."""
    import pandas as pd

    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(size=(400, 24)) / (1 + np.arange(24)))
    block = hard_negatives.Block(pd.DataFrame({"none": False, "id": np.arange(400), "label": 0, "vec": list(x)}), np.arange(24))
    q = np.floor(256 * rng.normal(size=(5, 24)) / (1 + np.arange(24)))
    for share in (0.3, 0.5, 0.8):
        t = share * np.linalg.norm(q, axis=1) * 256
        a, r = block.candidates(q, hard_negatives.norms(q), t)
        want = {(i, j) for i, j in zip(*np.nonzero(q @ x.T >= t[:, None]), strict=True)}
        assert want <= set(zip(a.tolist(), r.tolist(), strict=True)) and len(a) < 5 * 400
    _, listed, _ = block.index(0.5 * 256)
    assert listed.max() < 24

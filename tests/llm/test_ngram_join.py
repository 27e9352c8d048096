from itertools import combinations

import pytest

import numpy as np

from folioscan.llm import common, fingerprints, ngram_join, shingles


def brute_sets(texts):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute(rows, threshold=0.8):
    """class by union-find and links by all pairs of different sets."""
    ids, sets = [r[0] for r in rows], brute_sets([r[1] for r in rows])
    top = {i: i for i in ids}

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    first, links = {}, {}
    for i, s in zip(ids, sets):
        first.setdefault(frozenset(s), i)
    reps = {rep: s for s, rep in first.items()}
    for (a, s), (b, t) in combinations(reps.items(), 2):
        if s and t and len(s & t) >= threshold * len(s | t) - 1e-9:
            links[a] = links.get(a, 0) + 1
            links[b] = links.get(b, 0) + 1
            a, b = root(a), root(b)
            top[max(a, b)] = min(a, b)
    return {i: (root(first[frozenset(s)]), links.get(first[frozenset(s)], 0)) for i, s in zip(ids, sets)}


def made(n_groups=12):
    rows, k = [], 0
    for g in range(n_groups):
        words = [f"w{g}x{j}" for j in range(40 + g * 7)]
        for v in range(g % 5 + 1):
            w = list(words)
            if v:
                w[(v * 13) % len(w)] = f"new{v}"
            rows.append((k, " ".join(w), "x"))
            k += 1
    rows += [(k, "", "x"), (k + 1, None, "x"), (k + 2, "one two", "x"), (k + 3, "ONE  two", "x"), (k + 4, rows[3][1], "x")]
    return rows


def test_groups_match_brute_force(spark):
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string, links string").repartition(3)
    got = {r.doc_id: (r.class_id, r.links) for r in ngram_join.near_groups(df).collect()}
    assert got == brute(rows)


def test_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SIDE", 8)
    base = [f"w{j}" for j in range(200)]
    rows = []
    for v in range(45):
        w = list(base)
        w[(v * 7) % 200] = f"v{v}"
        rows.append((v, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.links) for r in ngram_join.near_groups(df).collect()}
    assert got == brute(rows)


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.class_id, r.links) for r in ngram_join.near_groups(docs).collect()}
    assert got == brute(rows)
    kept = {r.doc_id for r in ngram_join.keep_one(docs).select("doc_id").collect()}
    assert kept == {c for c, _ in brute(rows).values()}


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.near_groups(df).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (None, None), (2, "x")], "doc_id long, text string")
    assert ngram_join.near_groups(df).count() == 4


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.95])
def test_bands_reach_the_recall(threshold):
    bands, rows = shingles.choose_bands(threshold, 0.999)
    assert 1 - (1 - threshold**rows) ** bands >= 0.999


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(100, 101)], "a long, b long")
    got = {r.node: r.label for r in ngram_join.components(edges).collect()}
    assert got == {k: 0 for k in range(21)} | {100: 100, 101: 100}


def test_unreachable_recall_raises():
    with pytest.raises(ValueError):
        shingles.choose_bands(0.03, 0.999)


@pytest.mark.parametrize("bits", [64, 1 << 27])
def test_key_filter_never_loses_a_key(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "FILTER_BITS", bits)
    rows = spark.range(3000)
    bitmap = common.key_filter(rows.filter("id % 7 = 0"), "id")
    got = {r.id for r in common.marked(rows, bitmap, "id", "maybe").filter("maybe").collect()}
    wanted = {k for k in range(3000) if k % 7 == 0}
    assert got >= wanted and (bits == 64 or len(got) < len(wanted) + 10)
    assert common.marked(rows, bitmap, "id", "maybe").count() == 3000


@pytest.mark.parametrize("side, shingles_", [(512, 1 << 20), (4, 1 << 20), (512, 300)])
def test_a_pair_counts_once_whatever_the_blocks(spark, monkeypatch, side, shingles_):
    """Several overlapping groups, so that pairs meet at several pivots and in several blocks."""
    monkeypatch.setattr(ngram_join, "SIDE", side)
    monkeypatch.setattr(ngram_join, "PIVOT_SHINGLES", shingles_)
    rng = np.random.default_rng(5)
    rows = []
    for g in range(4):
        base = [f"g{g}w{j}" for j in range(120)]
        for v in range(12):
            w = list(base)
            for at in rng.integers(0, 120, v % 4):
                w[at] = f"v{rng.integers(0, 6)}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert {r.doc_id: (r.class_id, r.links) for r in ngram_join.near_groups(df).collect()} == want
    pairs = ngram_join.near_pairs(df).collect()
    assert len({(r.a, r.b) for r in pairs}) == len(pairs)
    links = {}
    for r in pairs:
        links[r.a], links[r.b] = links.get(r.a, 0) + 1, links.get(r.b, 0) + 1
    smallest = {}
    for i, s in zip([r[0] for r in rows], brute_sets([r[1] for r in rows])):
        smallest.setdefault(frozenset(s), i)
    assert links == {i: want[i][1] for i in smallest.values() if want[i][1]}


def test_ranges_part_an_id_that_spans_cuts():
    ranges = fingerprints.Ranges([3, 7, 7, 7, 7, 9])
    tie = np.linspace(-(2**63), 2**63 - 2048, 50).astype(np.int64)
    at = np.array([1, 3, 5, 7, 8, 9, 12])
    got = [ranges.of(np.full(50, a), tie) for a in at]
    flat = np.concatenate(got)
    assert (np.diff(flat) >= 0).all() and len(set(got[3])) == 4 and all(len(set(g)) == 1 for k, g in enumerate(got) if k != 3)


def test_one_id_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 4)
    rows = [(7, f"text number {k} of one id") for k in range(60)] + [(k, f"own {k}") for k in range(20)]
    got = fingerprints.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == 80 and len({r.edited_sha256 for r in got if r.doc_id == 7}) == 61
    own = {p.tobytes().hex() for p in fingerprints.prints([t for _, t in rows])}
    assert {r.fingerprint for r in got} == own


def test_hot_band_and_hub(spark):
    """A passage in a third of the texts, each different: one band, one pivot, a star of edges."""
    shared = " ".join(f"w{k}" for k in range(60))
    rows = [(k, f"{shared} own{k}") for k in range(300)] + [(1000 + k, f"text {k} " * 3 + f"{k * 7} ends here") for k in range(600)]
    got = {r.doc_id: (r.class_id, r.links) for r in ngram_join.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == (0, 299) for k in range(300)) and len(got) == 900
    star = spark.createDataFrame([(-5, k) for k in range(2000)] + [(3000 + k, 3001 + k) for k in range(40)], "a long, b long")
    labels = {r.node: r.label for r in ngram_join.components(star).collect()}
    assert all(labels[k] == -5 for k in range(2000)) and {labels[3000 + k] for k in range(41)} == {3000}


def test_stages_leave_clashing_columns_alone(spark):
    """Every name that the operators use themselves, as a column of the caller's."""
    import corpus_pipeline

    clean = "the quiet river runs along the old town and its gardens where people walk on summer evenings after work"
    names = ["_id", "_digest", "_row", "_maybe", "_near", "_page", "_bits", "_stays", "row", "digest", "whole", "_own", "_salt", "_text", "_null", "_best", "_hash", "words", "label", "score", "toxic", "quality", "copies", "rep"]
    rows = [(k, text, *[f"{n}{k}" for n in names]) for k, text in enumerate([clean, clean, clean + " today", "other words in a plain row that tell of a long road over hills and far away from here", None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, "/root/testdata/sf0.001")
        assert kept.columns == docs.columns, name
        found = {tuple(r) for r in kept.collect()}
        assert found <= set(rows) and len(found) >= 2, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= 4

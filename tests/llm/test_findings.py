from collections import Counter

import numpy as np
import pytest

from folioscan.llm import fingerprints, lm_score, ngram_join, quality, shingles, toxicity


def test_rare_words_have_probabilities_of_their_own(spark):
    common_words = [f"c{k}" for k in range(600)]
    rows = [(k, " ".join(common_words)) for k in range(4)] + [(10, "often " * 3), (11, "seldom"), (12, "often seldom often"), (13, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = lm_score.fit(df)
    got = {r.doc_id: r for r in lm_score.score(df, model).collect()}
    counts = Counter(w for _, t in rows for w in (t or "").split())
    hashes = dict(zip(counts, shingles.word_hashes([" ".join(counts)])[0].tolist()))
    frequent = set(model["frequent"].tolist())
    slot = {w: h % (lm_score.SLOTS - len(frequent)) for w, h in hashes.items() if h not in frequent}
    totals = Counter()
    for w, s in slot.items():
        totals[s] += counts[w]
    assert len(slot) == len(counts) - 512 and model["words"].count() == len(slot)
    for doc_id, text in rows:
        within = sum(np.log(counts[w] / (totals[slot[w]] + 1)) for w in (text or "").split() if w in slot)
        assert got[doc_id].word_log_prob == pytest.approx(got[doc_id].log_prob + within, abs=1e-4)
    assert got[13].word_log_prob == got[13].mean_word_log_prob == 0
    new = lm_score.score(spark.createDataFrame([(1, "neverseen")], "doc_id long, text string"), model).first()
    bucket = int(shingles.word_hashes(["neverseen"])[0][0]) % 512
    assert new.word_log_prob == pytest.approx(new.log_prob - np.log(totals[bucket] + 1), abs=1e-4)


def test_many_small_partitions_still_train(spark):
    df = spark.createDataFrame([(k, "a b c d e f g h " * 20) for k in range(64)], "doc_id long, text string")
    whole, split = (lm_score.score(d, lm_score.fit(d)).agg({"mean_log_prob": "avg"}).first()[0] for d in (df.coalesce(1), df.repartition(64)))
    assert split > whole - 0.2


def near_texts():
    base = [f"w{k}" for k in range(100)]
    return [" ".join(base), " ".join([*base[:50], "new", *base[51:]]), " ".join([*base[:53], "other", *base[54:]])]


def test_null_and_repeated_ids_keep_their_texts(spark):
    a, b, c = near_texts()
    far = " ".join(f"u{k}" for k in range(60))
    rows = [(None, "lone", 1), (None, a, 2), (None, b, 3), (7, far, 4), (7, c, 5), (7, "unlike all else", 6), (8, far + " end", 7), (9, "one more", 8), (9, "one more", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept long").repartition(3)
    got = {(r.doc_id, r.class_id, r.links): 0 for r in ngram_join.near_groups(df).collect()}
    assert set(got) == {(None, None, 0), (None, 7, 2), (7, 7, 2), (7, 7, 1), (7, 7, 0), (8, 7, 1), (9, 9, 0)}
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.text for r in kept.collect()) == sorted(["lone", c, far, "unlike all else", "one more"])


def test_near_copies_across_512_code_points():
    long = " ".join(f"word{k:03d}" for k in range(65))[:515]
    short = long[:505]
    a, b = fingerprints.prints([long, short])
    assert len(short) < 512 <= len(long) and (a == b).mean() > 0.8


def test_fingerprints_join_all_links_of_a_band(spark):
    rows = list(enumerate([*near_texts(), "far away from all of them", ""]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.links) for r in fingerprints.near_groups(df).collect()}
    assert got == {0: (0, 2), 1: (0, 2), 2: (0, 2), 3: (3, 0), 4: (4, 0)}
    assert {(r.a, r.b) for r in fingerprints.near_pairs(df, threshold=0.75).collect()} == {(0, 1), (0, 2), (1, 2)}


def test_samples_bound_rows(spark):
    rows = [(1, f"text {k}") for k in range(200)] + [(k, "once") for k in range(2, 40)] + [(None, "null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert quality.sample_of(df, 20).count() == 20 and quality.sample_of(df, 10**4).count() == len(rows)
    labels = spark.createDataFrame([(k, 1) for k in range(1, 40)], "doc_id long, toxic int")
    assert toxicity.labelled(df, labels, 30, "doc_id", "text").count() <= 2


def test_network_normalises_all_words_at_once_and_steps_down_the_gradient():
    rng = np.random.default_rng(4)
    words, context = rng.integers(0, lm_score.SLOTS, 300), rng.integers(0, lm_score.SLOTS + 1, (300, 2 * lm_score.SIDE))
    net = lm_score.Network.fresh()
    order, cuts = net.by_class(words)
    assert all(np.allclose(share.sum(0), 1, atol=1e-5) for share in net.shares(net.hidden(context[order]), cuts))
    whole = net.log_probs(words, context)
    assert np.allclose(whole, [net.log_probs(words[k : k + 1], context[k : k + 1])[0] for k in range(300)], atol=1e-5)
    start, memory = net.flat.copy(), lm_score.Network(np.zeros(lm_score.Network.SIZE, np.float32))
    net.step(words, context, memory)
    moved = np.sign(start - net.flat)  # a first Adagrad step only has the gradient's sign
    for at in np.argsort(-memory.flat)[:20]:
        up, down = start.copy(), start.copy()
        up[at], down[at] = up[at] + 0.01, down[at] - 0.01
        slope = (lm_score.Network(down).log_probs(words, context).mean() - lm_score.Network(up).log_probs(words, context).mean()) / 0.02
        assert np.sign(slope) == moved[at] and np.isclose(abs(slope), np.sqrt(memory.flat[at]), rtol=0.02)

import hashlib
import random
import zlib
from fnmatch import fnmatchcase

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.llm import common, exact_dedup, fingerprints, lm_score, quality, sharding, shingles, toxicity, url_filter

SF = "/root/testdata/sf0.001"
EDGE = [(1, "same", 5), (2, "same", None), (2, "same", None), (3, None, 1), (4, "", 2), (None, "lone", 3), (5, "word " * 20000, 4), (6, "same ", 6)]
SCHEMA = "doc_id long, text string, kept long"


def docs_of(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_exact_groups_and_edges(spark):
    df = spark.createDataFrame(EDGE, SCHEMA).repartition(3)
    got = sorted((r.doc_id or -1, r.keep_id, r.group_size, r.kept) for r in exact_dedup.groups(df).collect())
    assert got == sorted([(1, 2, 3, False), (2, 2, 3, True), (2, 2, 3, True), (3, 4, 2, False), (4, 4, 2, True), (-1, None, 1, True), (5, 5, 1, True), (6, 6, 1, True)])
    kept = exact_dedup.keep_one(df)
    assert kept.columns == df.columns and sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 2, 4, 5, 6]
    assert exact_dedup.groups(df.limit(0)).count() == 0 and exact_dedup.keep_one(df.limit(0)).count() == 0


def test_exact_groups_with_equal_digests(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.substring(c, 1, 1))
    df = spark.createDataFrame([(1, "aa"), (2, "ab"), (3, "aa"), (4, "b")], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.groups(df).collect()) == [(1, 3, 2), (2, 2, 1), (3, 3, 2), (4, 4, 1)]


def test_hot_groups_are_found(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 0.3)
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 100, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    rows = exact_dedup.groups(df).collect()
    assert all((r.keep_id, r.group_size) == ((99, 100) if r.doc_id < 100 else (r.doc_id, 1)) for r in rows) and len(rows) == 200


def test_two_level_ranks(spark, monkeypatch):
    monkeypatch.setattr(common, "RANK_ROWS", 7)
    df = spark.range(100).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"))
    rows = common.ranked(df, ["g"], ["k"], ["k"], 100, "r").collect()
    for g in range(3):
        assert sorted(r.r for r in rows if r.g == g) == list(range(sum(r.g == g for r in rows)))


def test_url_automaton_matches_globs():
    rng = random.Random(3)
    globs = ["com/*", "*.com/*", "a.b/en/*", "*.a.b/en/*", "*/ads/*", "ads-*", "*x*y*", "abc" * 40 + "*"]
    automaton = url_filter.Automaton(globs)
    texts = ["".join(rng.choice("abcxy./ads-en") for _ in range(rng.randint(0, 24))) for _ in range(3000)] + ["com/", "x.com/y", "a.b/en/", "z.a.b/en/q", "abc" * 40 + "tail", ""]
    hit = automaton.match([t.encode() for t in texts])

    def fits(text, glob):
        host, slash, path = glob.partition("/")
        if not slash:
            return fnmatchcase(text, glob)
        have, found, rest = text.partition("/")
        if "*" in host and host.strip("*") == "":
            return any(fnmatchcase(have[k:] + found + rest, glob[1:]) for k in range(len(have) + 1)) if found else False
        return bool(found) and fnmatchcase(have, host) and fnmatchcase(rest, path)

    for k, text in enumerate(texts):
        for j, glob in enumerate(globs):
            if glob == "*/ads/*":
                want = "/" in text and text[text.index("/") :].startswith("/ads/")
            else:
                want = fits(text, glob)
            assert hit[k, j] == want, (text, glob)


def test_url_rules(spark):
    urls = ["http://WWW.example.com/en/x?q#f", "https://example.com/en/", "http://a.example.com/fr/", "http://b.net/es/1", "http://b.net/de/", "nothing", None, "http://ads-track.example.org/", "http://example.com", "x://h.com/" + "p" * 70000]
    df = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = [(r.host, r.rule, r.verdict) for r in url_filter.filter_urls(df).orderBy("page_id").collect()]
    assert got == [("www.example.com", "www.example.com/en/", "allow"), ("example.com", "example.com/en/", "block"), ("a.example.com", "com/", "allow"), ("b.net", "net/es/", "block"), ("b.net", None, "allow"), ("", None, "allow"), ("", None, "allow"), ("ads-track.example.org", None, "block"), ("example.com", None, "allow"), ("h.com", "com/", "allow")]
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_shards_balance_and_keep_groups(spark):
    docs = docs_of(spark).select("doc_id", "text")
    rows = sharding.shard(docs.union(docs.limit(0)), 8).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    sizes = [sum(r["size"] for r in rs) for rs in by.values()]
    assert len(by) == 8 and max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    text = {d: t for d, t in docs.collect()}
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r["size"] == len(text[r.doc_id].encode()) + 8 for r in rows)
    assert sharding.shard(spark.createDataFrame(EDGE, SCHEMA)).count() == len(EDGE)
    assert sharding.shard(docs.limit(0)).count() == 0


def test_placement_is_the_highest_dot_product():
    """Against plain loops over shards and dimensions."""
    vectors = np.random.default_rng(4).dirichlet([1.0] * 200, 3).T
    residual, want = [[1 / 7] * 3 for _ in range(7)], {}
    for k in sorted(range(200), key=lambda k: (-vectors[k].sum(), k)):
        dots = [sum(r * v for r, v in zip(free, vectors[k], strict=True)) for free in residual]
        want[k] = dots.index(max(dots))
        residual[want[k]] = [r - v for r, v in zip(residual[want[k]], vectors[k], strict=True)]
    got = sharding.place(vectors, 7)
    assert got.tolist() == [want[k] for k in range(200)]
    loads = np.stack([np.bincount(got, weights=vectors[:, d], minlength=7) for d in range(3)]) * 7
    assert np.abs(loads - 1).max() < 0.06  # all three alike
    level = sharding.levelled(vectors, got, 7, np.ones(200, bool))
    by_bytes = np.bincount(level, weights=vectors[:, 0], minlength=7) * 7
    assert np.ptp(by_bytes) < np.ptp(loads[0]) and np.ptp(by_bytes) < 0.005


def test_shards_balance_all_three(spark):
    """A third of the rows are one short text, a few texts hold most bytes: bytes, tokens and rows stay near equal."""
    hot = F.when(F.col("id") % 3 == 0, F.lit("the same short text"))
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), hot.when(F.col("id") % 50 == 1, F.concat(F.repeat(F.lit("long words "), 60), F.col("id").cast("string"))).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    df = df.union(df.limit(2000).selectExpr("CAST(NULL AS LONG)", "'no id at all'"))
    rows = sharding.shard(df, 24).join(df.groupBy(F.crc32(F.col("text").cast("binary")).alias("text_crc32")).agg(F.first(F.size(F.split("text", " "))).alias("tokens")), "text_crc32")
    loads = rows.groupBy("shard").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n")).toPandas()
    assert len(loads) == 24
    assert np.ptp(loads["b"]) < 0.01 * loads["b"].mean()
    assert np.ptp(loads["t"]) < 0.12 * loads["t"].mean() and np.ptp(loads["n"]) < 0.12 * loads["n"].mean()


def test_a_group_larger_than_a_shard_is_split(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot " * 20).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"), F.lit(" x" * 38))).alias("text"))
    sizes = {r.shard: r.s for r in sharding.shard(df, 6).groupBy("shard").agg(F.sum("size").alias("s")).collect()}
    assert len(sizes) == 6 and max(sizes.values()) < 1.05 * min(sizes.values())


def test_fingerprints_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in docs_of(spark).select("doc_id", "text").orderBy("doc_id").limit(60).collect()] + [(10**6, None), (10**6 + 1, "")]
    got = {r.doc_id: r for r in fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    texts = [t or "" for _, t in rows]
    for k, (doc_id, _) in enumerate(rows):
        text, after = texts[k], texts[(k + 1) % len(rows)]
        part = len(text) // 4
        edited = text[: len(text) - part] + after[:part]
        own, new, other = fingerprints.prints([text, edited, after])
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (own.tobytes().hex(), new.tobytes().hex())
        assert abs(r.near_edited - (own == new).mean()) < 1e-9 and abs(r.near_next - (own == other).mean()) < 1e-9
    long = [r for r in got.values() if r.n_chars > 400]
    assert np.mean([r.near_edited for r in long]) > 0.45 and np.mean([r.near_next for r in long]) < 0.2


def test_fingerprint_edges(spark):
    assert fingerprints.fingerprint(spark.createDataFrame(EDGE, SCHEMA)).count() == len(EDGE)
    assert fingerprints.fingerprint(spark.createDataFrame([], SCHEMA)).count() == 0
    one = fingerprints.fingerprint(spark.createDataFrame([(1, "only one text here")], "doc_id long, text string")).first()
    assert one.near_next == 1.0


def test_near_pairs_are_verified(spark):
    base = [f"w{k}" for k in range(100)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:50], "new", *base[51:]])), (3, " ".join(f"u{k}" for k in range(100)))]
    (pair,) = fingerprints.near_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    a, b = shingles.shingle_sets([rows[0][1], rows[1][1]])
    assert (pair.a, pair.b) == (1, 2) and abs(pair.jaccard - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 1e-9


def test_grammar_weighs_states():
    lexicon, table = toxicity.Lexicon({}), toxicity.grammar()
    value = lambda t: toxicity.clause_features(t, lexicon, table)[0][0]
    assert value("the weather is fine") == 0
    assert value("you are an idiot") > value("an idiot") > value("he said: nothing, an idiot not") * 0
    assert value("you are an idiot") > value("you are not an idiot") > 0
    assert value("an idiot") > value("she said an idiot")
    assert value("I will kill you") > 0 and value("you I will kill") > value("kill the process")
    assert toxicity.clause_features("", lexicon, table)[1] == 0


def test_composition_equals_its_parts_run_side_by_side():
    """Random symbol runs: the composed table's factor is the product of the five transducers' own."""
    rng, table = random.Random(5), toxicity.grammar()
    for _ in range(200):
        state, own = 0, [0] * 5
        for _ in range(12):
            x = rng.randrange(6)
            state, factor = table[state][x]
            want = 1.0
            for k, t in enumerate(toxicity.transducers()):
                own[k], f = t.step(own[k], x)
                want *= f
            assert abs(factor - want) < 1e-12


def test_clause_scores_against_plain_rules():
    """Scores by rules written out for one clause, no automaton: scopes by position."""

    def plain(words):
        kind = {w: s for s, ws in toxicity.WORDS.items() for w in ws.split()}
        total = 0.0
        for k, w in enumerate(words):
            s = kind.get(w)
            if s not in (toxicity.INSULT, toxicity.THREAT):
                continue
            before = [kind.get(x) for x in words[:k]]
            factor = toxicity.NEGATED if toxicity.NEGATION in before[-3:] else 1.0
            factor *= toxicity.REPORTED if toxicity.REPORT in before else 1.0
            factor *= toxicity.TARGETED if toxicity.TARGET in before else 1.0
            if s == toxicity.INSULT:
                factor *= toxicity.PILED if toxicity.INSULT in before else 1.0
            else:
                factor *= 1.0 if {toxicity.TARGET, toxicity.THREAT} & set(before) else toxicity.AIMLESS
            total += factor
        return total

    rng, lexicon, table = random.Random(8), toxicity.Lexicon({}), toxicity.grammar()
    pool = ["you", "idiot", "scum", "kill", "hurt", "not", "never", "said", "the", "house", "green", "told", "she"]
    for _ in range(300):
        words = [rng.choice(pool) for _ in range(rng.randrange(1, 12))]
        got = toxicity.clause_features(" ".join(words), lexicon, table)[0][0]
        assert abs(got - np.log1p(plain(words))) < 1e-9


def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.93
    assert not [r for r in rows if r.predicted == 1 and r.toxic == 0]
    edge = spark.createDataFrame(EDGE, SCHEMA)
    scored = toxicity.score(edge, toxicity.fit(edge, labels.limit(0))).collect()
    assert len(scored) == len(EDGE) and all(0 <= r.score < 0.5 for r in scored)
    assert toxicity.keep(edge, labels).columns == edge.columns


def test_learned_beginnings():
    batch = __import__("pyarrow").RecordBatch.from_pydict({"text": ["zzqab der", "zzqcd die", "fine"], "toxic": [1, 1, 0]})
    rows = [r for b in toxicity.terms_of(iter([batch])) for r in b.to_pylist()]
    assert {r["term"]: (r["toxic"], r["clean"]) for r in rows}["zzq*"] == (2, 0)
    assert toxicity.Lexicon({"zzq*": 0.8})("zzqxy") == (toxicity.INSULT, 0.8)


def test_quality_without_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs)
    rows = quality.score(docs, model).join(labels, "doc_id").collect()
    assert np.mean([r.keep for r in rows if r.quality == 1]) > 0.99 and np.mean([not r.keep for r in rows if r.quality == 0]) > 0.9
    edge = spark.createDataFrame(EDGE, SCHEMA)
    assert quality.classify(edge).count() == len(EDGE) and quality.keep(edge).columns == edge.columns
    assert quality.classify(edge.limit(0)).count() == 0


def test_expectation_maximisation_finds_planted_accuracies():
    rng = np.random.default_rng(0)
    good = rng.random(20000) < 0.7
    sides = np.array([v for _, v, _ in quality.LABELLERS])
    rate = np.where(sides == 1, 0.8, 0.6)
    fires = rng.random((20000, len(sides))) < np.where(good[:, None] == (sides == 1), rate, 0.05)
    patterns, counts = np.unique(np.where(fires, sides, -1), axis=0, return_counts=True)
    prior, accuracy, _ = quality.estimate(patterns, counts.astype(float))
    assert abs(prior - good.mean()) < 0.02
    want = [(good[fires[:, k]] == (s == 1)).mean() for k, s in enumerate(sides)]
    assert np.abs(accuracy - want).max() < 0.03


def test_expectation_maximisation_against_rows_one_by_one():
    """The estimate from counted patterns equals one that walks every row and labeller in plain loops."""
    rng = np.random.default_rng(2)
    rows = [[vote if rng.random() < 0.3 else -1 for _, vote, _ in quality.LABELLERS] for _ in range(150)]
    share = [1 / (1 + np.exp(-2.0 * (r.count(1) - r.count(0)))) for r in rows]
    for _ in range(5):
        prior = min(0.98, max(0.02, sum(share) / len(rows)))
        chance = {}
        for k in range(len(quality.LABELLERS)):
            for side in (0, 1):
                w = [s if side else 1 - s for s in share]
                chance[k, side] = min(1 - 1e-3, max(1e-3, sum(x for x, r in zip(w, rows, strict=True) if r[k] >= 0) / max(1e-9, sum(w))))
        new = []
        for r in rows:
            odds = [prior, 1 - prior]
            for k, v in enumerate(r):
                for i, side in enumerate((1, 0)):
                    odds[i] *= chance[k, side] if v >= 0 else 1 - chance[k, side]
            new.append(odds[0] / sum(odds) if max(r) >= 0 else prior)
        share = new
    patterns, counts = np.unique(np.array(rows), axis=0, return_counts=True)
    _, _, got = quality.estimate(patterns, counts.astype(float), rounds=5)
    by = {tuple(p): g for p, g in zip(patterns.tolist(), got, strict=True)}
    assert max(abs(by[tuple(r)] - s) for r, s in zip(rows, share, strict=True)) < 1e-9


def test_language_model(spark):
    docs = docs_of(spark)
    model = lm_score.fit(docs, rounds=2)
    rows = {r.doc_id: r for r in lm_score.score(docs, model).collect()}
    net = lm_score.Network(model["flat"])
    for doc_id, text in docs.select("doc_id", "text").limit(5).collect():
        ids, context, _ = lm_score.tokens([text], model["frequent"])
        brute = sum(float(net.log_probs(ids[k : k + 1], context[k : k + 1])[0]) for k in range(len(ids)))
        assert rows[doc_id].n_tokens == len(text.split()) and abs(rows[doc_id].log_prob - brute) < 1e-3 * max(1, abs(brute))
    p = lm_score.Network.softmax(np.array([[1.0, 2.0]], np.float32))
    assert abs(p.sum() - 1) < 1e-6
    fresh = lm_score.score(docs, {"frequent": model["frequent"], "flat": lm_score.Network.fresh().flat}).agg(F.sum("log_prob")).first()[0]
    assert sum(r.log_prob for r in rows.values()) > fresh
    edge = spark.createDataFrame(EDGE, SCHEMA)
    assert lm_score.score(edge, lm_score.fit(edge)).count() == len(EDGE)
    assert lm_score.score(edge.limit(0), lm_score.fit(edge.limit(0))).count() == 0


def test_pipeline_against_its_stages_by_hand(spark):
    """Scores from the operators' own queries; dedup, near groups and pieces by brute force."""
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline
    from test_ngram_join import brute

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in quality.classify(docs).filter("keep").collect()}
    docs = docs.filter(F.col("doc_id").isin(list(good)))
    toxic = {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, labels)).filter("predicted = 1").collect()}
    last = {}
    for doc_id, text in sorted((r.doc_id, r.text or "") for r in docs.collect()):
        if doc_id not in toxic:
            last[text] = doc_id
    rows = sorted((i, t) for t, i in last.items())
    kept = {c for c, _ in brute(rows).values()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation(), library.no_padding()
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows if i in kept}
    got, sequences = {}, {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got.keys() == want.keys()
    for pieces, whole in ((p, want[i]) for i, p in got.items()):
        ends = [0, *(a + n for a, n in sorted(pieces))]
        assert [a for a, _ in sorted(pieces)] == ends[:-1] and ends[-1] == whole
    for pieces in sequences.values():
        ends = [0, *(a + n for a, n in sorted(pieces))]
        assert [a for a, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= 2048


@pytest.mark.parametrize("kind", ["edges", "empty"])
def test_pipeline_on_odd_tables(spark, tmp_path, kind):
    import corpus_pipeline

    df = spark.createDataFrame(EDGE, SCHEMA).selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "kept AS n_chars", "1 AS score")
    df = df.limit(0) if kind == "empty" else df
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert (len(rows) == 0) == (kind == "empty")
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns

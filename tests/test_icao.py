from folioscan.functions import checksum


def test_icao_digits_of_whole_regions(spark, monkeypatch):
    from folioscan.plans import queries

    texts = ["L898902C3", "740812", "L898902C36UTO7408122F1204159ZE184226B<<<<<", "a-b 1", "", "x" * 500]
    monkeypatch.setattr(queries.X, "regions", lambda s, d: s.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "doc_id long, seq int, text string"))
    rows = queries.QUERIES["icao_check_digit_whole"](spark, "").collect()
    value = lambda c: max(0, checksum.ALPHABET.find(c))
    assert len(rows) == len(texts) and max(len(r.data) for r in rows) == 500
    for r in rows:
        assert r.digit == sum(value(c) * (7, 3, 1)[k % 3] for k, c in enumerate(r.data)) % 10

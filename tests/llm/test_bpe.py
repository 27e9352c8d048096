import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from folioscan.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = [*map(chr, range(0x20)), *"aZé '.,<|>1²½ßΣσİ", "́", "ͅ", " ", "\x85", "\xa0", "　", "᠎", "​", "가", "ᅡ", "😀", " <|endoftext|> ", "<|startoftext|>", "'LL", "don't"]


def texts():
    rng = random.Random(7)
    out = ["", " ", "x" * 5000, "it's 'S I'M", "A<|endoftext|>b"] + ["".join(rng.choice(ODD) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    return out + pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()


def test_ids_and_decoding_equal_the_library():
    own, lib = bpe.WordBPE.load(PATH), packing.LibraryBPE.load(PATH)
    for text in texts():
        ids = LIBRARY.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, text
        assert own.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)
        assert b"".join(lib.chunk(p) for p in lib.pieces(text)) == b"".join(i.to_bytes(4, "little") for i in ids)


def test_every_code_point_equals_the_library():
    """Each in the middle of words, alone and before a stop, by both encoders."""
    own, lib = bpe.WordBPE.load(PATH), packing.LibraryBPE.load(PATH)
    points = [*range(1, 0xD800), *range(0xE000, 0x110000)]
    for k in range(0, len(points), 4096):
        texts = [f"ab{c}cd, {c} X{c}." for c in map(chr, points[k : k + 4096])]
        if k < 0x32000 or 0xE0000 <= points[k] < 0xE1000:
            for text, want in zip(texts, LIBRARY.encode_batch(texts, add_special_tokens=False), strict=True):
                assert own.encode(text) == want.ids, ascii(text)
                assert b"".join(lib.chunk(p) for p in lib.pieces(text)) == b"".join(i.to_bytes(4, "little") for i in want.ids), ascii(text)


def test_query_rows(spark):
    rows = [(1, "Hello there"), (2, None), (3, ""), (3, ""), (4, "ab " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "'q' as ids")
    got = sorted(map(tuple, bpe.round_trip(df, PATH).collect()))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for doc_id, text in rows:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want)
    back = bpe.decode_ids(bpe.encode_ids(df, PATH), PATH)
    assert {r.text for r in back.collect()} == {LIBRARY.decode(LIBRARY.encode(t or "", add_special_tokens=False).ids) for _, t in rows}
    assert bpe.round_trip(df.limit(0), PATH).count() == 0


def test_stale_queue_entries():
    own = bpe.WordBPE({"added_tokens": [], "model": {"vocab": {"a": 0, "aa": 1, "a</w>": 2, "aa</w>": 3, "aaa</w>": 4}, "merges": [["a", "a"], ["aa", "a</w>"], ["a", "a</w>"]]}})
    assert own.merge("aaa") == (4,)
    assert own.merge("aaaa") == (1, 3)


def test_packing_pieces(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "word " * 9000)], "doc_id long, text string"))
    rows = packing.pack(docs, PATH).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc_id, text in docs.collect():
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(raw[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert sum(r.length for r in rows) > 0.97 * 2048 * len(by_sequence)
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_column_generation_is_near_the_bound():
    rng = random.Random(1)
    lengths = {k: rng.randint(1, 400) for k in range(1, 129)}
    rows = packing.plan(lengths, 128)
    sequences = max(base + (high - low) // n for _, low, high, n, base, _ in rows)
    sizes = np.array(sorted(lengths))
    columns, times = packing.column_generation(sizes, np.array([lengths[k] for k in sizes], float), 128, gap=1e-6, most=20_000)
    assert np.allclose(columns @ times, [lengths[k] for k in sizes], atol=1e-3) and ((columns * sizes[:, None]).sum(0) <= 128).all()
    assert sequences <= 1.01 * times.sum()
    for unit, count in lengths.items():
        own = sorted((low, high) for u, low, high, *_ in rows if u == unit)
        assert own[0][0] == 0 and own[-1][1] == count and all(a[1] == b[0] for a, b in zip(own, own[1:]))

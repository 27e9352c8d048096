"""Case folding on the JVM against the standard's, letter by letter."""

import unicodedata

from folioscan.functions import text as T
from folioscan.operators import evaluate
from test_engine import column


def test_every_letter(spark):
    """All letters whose folding differs from themselves, and those that fold with others; in the middle of a word."""
    points = [chr(c) for c in range(0x20, 0x1F000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    cased = [c for c in points if c.casefold() != c or c.lower() != c or c.upper() != c]
    cased = [c for c in cased if "CHEROKEE" not in unicodedata.name(c, "")]
    got = column(spark, [f"a{c}b" for c in cased], T.casefold)
    assert len(cased) > 2500 and [(c, g) for c, g in zip(cased, got, strict=True) if g != f"a{c}b".casefold()] == []


def test_words(spark):
    words = ["Straße", "STRASSE", "ΟΔΟΣ", "οδος", "İstanbul", "ısı", "ПРИВЕТ", "ﬁn", "ʼN", "ὈΔΥΣΣΕΎΣ", "plain", ""]
    assert column(spark, words, T.casefold) == [w.casefold() for w in words]
    assert column(spark, ["Straße 1", "STRASSE-1"], evaluate.normalize_value) == ["strasse1", "strasse1"]
    assert column(spark, ["  ΟΔΟΣ\t x "], T.dedup_key) == ["οδοσ x"]

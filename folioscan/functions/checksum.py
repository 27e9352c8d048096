"""Check digits as Column expressions: ICAO 9303 weights and Verhoeff tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def dihedral() -> list[list[int]]:
    """Multiplication of the dihedral group of ten elements."""
    return [[(a + b) % 5 if a < 5 and b < 5 else (a + b - 5) % 5 + 5 if a < 5 else (a - b) % 5 + 5 if b < 5 else (a - b) % 5 for b in range(10)] for a in range(10)]


def permutations() -> list[list[int]]:
    """Powers 0 to 7 of Verhoeff's permutation."""
    first = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    rows = [list(range(10))]
    for _ in range(7):
        rows.append([first[x] for x in rows[-1]])
    return rows


def icao_digit(c: Column) -> Column:
    """Weighted sum modulo 10: weights 7, 3, 1; < and unknown characters count 0."""
    weight = lambda k: F.element_at(F.array(F.lit(7), F.lit(3), F.lit(1)), (k % 3 + 1).cast("int"))
    values = F.transform(F.split(c, ""), lambda ch, k: F.greatest(F.instr(F.lit(ALPHABET), ch) - 1, F.lit(0)) * weight(k))
    return F.when(F.length(c) == 0, F.lit(0)).otherwise(F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10)


def check_digit_ok(data: Column, digit: Column) -> Column:
    """False, not null, when the printed digit is no digit."""
    return F.coalesce(icao_digit(data) == F.when(digit.rlike("^[0-9]$"), digit.cast("int")), F.lit(False))


def verhoeff_ok(c: Column) -> Column:
    """True for a digit string whose Verhoeff sum is 0; false for empty or other text."""
    table = F.lit([x for row in dihedral() for x in row])
    power = F.lit([x for row in permutations() for x in row])
    digits = F.transform(F.split(F.reverse(c), ""), lambda ch, k: F.struct(ch.try_cast("int").alias("d"), k.alias("k")))
    total = F.aggregate(digits, F.lit(0), lambda a, x: F.element_at(table, a * 10 + F.element_at(power, (x["k"] % 8 * 10 + x["d"] + 1).cast("int")) + 1))
    return F.when(c.rlike("^[0-9]+$"), total == 0).otherwise(F.lit(False))


def verhoeff_ok_of(c: Column, digits: int) -> Column:
    """``verhoeff_ok`` of texts of so many digits, false for others: one look-up a digit, no lambda."""
    table, powers = [x for row in dihedral() for x in row], permutations()
    total = F.lit(0)
    for k in range(digits):
        digit = F.ascii(F.substring(c, digits - k, 1)) - 48
        total = F.get(F.lit(table), total * 10 + F.get(F.lit(powers[k % 8]), digit))
    return F.coalesce(F.when(c.rlike(f"^[0-9]{{{digits}}}$"), total == 0), F.lit(False))

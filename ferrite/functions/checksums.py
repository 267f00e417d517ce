"""Check digits and small hashes as native expressions. Every function takes and returns columns; null gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digit(s: Column, i: Column) -> Column:
    return F.substring(s, i, F.lit(1)).cast("int")


def luhn(number: Column) -> Column:
    """Luhn check of 12 to 19 digits; blanks and dashes don't count, anything else fails."""
    d = F.regexp_replace(number, "[ -]", "")
    n = F.length(d)

    def add(total: Column, i: Column) -> Column:
        v = _digit(d, n - i)
        return total + F.when(i % 2 == 0, v).when(v > 4, v * 2 - 9).otherwise(v * 2)

    return F.when(number.isNotNull(), F.when(d.rlike("^[0-9]{12,19}$"), F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0).otherwise(False))


def _dihedral(a: int, b: int) -> int:
    """Product in the symmetry group of the pentagon, reflections numbered 5 to 9."""
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b - 5) % 5
    return 5 + (a - 5 - b) % 5 if b < 5 else (a - b) % 5


#: Fixed value: Verhoeff's permutation; its powers are used by position.
_PERMUTATION = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)


def _powers() -> list[list[int]]:
    rows = [list(range(10))]
    for _ in range(7):
        rows.append([_PERMUTATION[x] for x in rows[-1]])
    return rows


def verhoeff(number: Column) -> Column:
    """Verhoeff check of exactly 12 digits; other characters don't count."""
    d = F.regexp_replace(number, "[^0-9]", "")
    product = F.array(*[F.lit(_dihedral(a, b)) for a in range(10) for b in range(10)])
    powers = F.array(*[F.lit(x) for row in _powers() for x in row])
    fold = F.aggregate(F.sequence(F.lit(0), F.lit(11)), F.lit(0), lambda c, i: F.get(product, c * 10 + F.get(powers, (i % 8) * 10 + _digit(d, F.lit(12) - i))))
    return F.when(number.isNotNull(), F.when(F.length(d) == 12, fold == 0).otherwise(False))


def iban(text: Column) -> Column:
    """ISO 7064 mod 97 of an IBAN; blanks don't count."""
    s = F.regexp_replace(text, "[ \t\r\n]", "")
    moved = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(v < 58, (rest * 10 + (v - 48)) % 97).otherwise((rest * 100 + (v - 55)) % 97)

    return F.when(text.isNotNull(), F.when(s.rlike("^[A-Z0-9]{5,}$"), F.aggregate(F.split(moved, ""), F.lit(0), add) == 1).otherwise(False))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over code points, as a bigint."""
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("bigint")) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.when(text.isNotNull(), F.aggregate(chars, F.lit(2166136261).cast("bigint"), step))


def fnv1a_hex(text: Column) -> Column:
    return F.lower(F.lpad(F.hex(fnv1a(text)), 8, "0"))


def bucket(n: Column) -> Column:
    """Power-of-two label of a count: none, 1, 2-3, 4-7 and so on."""
    low = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length(F.bin(n)) - 1)
    return F.when(n <= 0, "none").when(n == 1, "1").otherwise(F.concat(low.cast("string"), F.lit("-"), (low * 2 - 1).cast("string")))

"""A generator of text with known personal data: one value of a class a row, its place known exactly.

Every value is arithmetic on the row's key, so that SQL can make the same one. Check digits are sought among the ten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checksums

#: In this order a key's remainder picks the class.
CLASSES = ("JWT", "API_KEY", "API_KEY", "AADHAAR", "PAN", "GSTIN", "IFSC", "IBAN", "PHONE", "PASSPORT", "DOB", "DOB", "BANK_ACCOUNT", "MONEY", "ADDRESS", "CREDIT_CARD")


def digits(key: Column, n: int, salt: int = 0) -> Column:
    """``n`` digits that depend on the key."""
    return F.lpad(((key * 7919 + 104_729 + salt) % 10 ** min(n, 12)).cast("string"), n, "0")


def check_digit(body: Column, passes) -> Column:
    """The digit that ``passes`` accepts after ``body``."""
    return F.get(F.filter(F.array(*[F.lit(str(d)) for d in range(10)]), lambda d: passes(F.concat(body, d))), F.lit(0))


def verhoeff_digit(body: Column) -> Column:
    return check_digit(body, checksums.verhoeff)


def luhn_digit(body: Column) -> Column:
    return check_digit(body, checksums.luhn)


def iban_digits(country: str, rest: Column) -> Column:
    """The two check digits of an IBAN."""
    pairs = F.transform(F.sequence(F.lit(2), F.lit(98)), lambda d: F.lpad(d.cast("string"), 2, "0"))
    return F.get(F.filter(pairs, lambda d: checksums.iban(F.concat(F.lit(country), d, rest))), F.lit(0))


def values(key: Column) -> Column:
    """struct(before, value) of the key's class."""
    lit, two = F.lit, lambda x: F.lpad(x.cast("string"), 2, "0")
    body, card, rest = F.concat((key % 8 + 2).cast("string"), digits(key, 10)), F.concat(lit("4"), digits(key, 14)), F.concat(lit("WEST"), digits(key, 14))
    made = (
        ("", F.concat(lit("eyJhbGciOiJI"), digits(key, 9), lit(".eyJzdWIi"), digits(key, 9, 1), lit("."), digits(key, 9, 2))),
        ("", F.concat(lit("sk-"), digits(key, 18))),
        ("", F.concat(lit("AIza"), digits(key, 35))),
        ("", F.concat(body, verhoeff_digit(body))),
        ("", F.concat(lit("ABCDE"), digits(key, 4), lit("F"))),
        ("", F.concat(two(key % 37), lit("ABCDE"), digits(key, 4), lit("F1Z5"))),
        ("", F.concat(lit("HDFC0"), digits(key, 6))),
        ("", F.concat(lit("GB"), iban_digits("GB", rest), rest)),
        ("", F.concat(lit("9"), digits(key, 9))),
        ("", F.concat(lit("A"), digits(key, 7))),
        ("", F.concat_ws("/", two(key % 28 + 1), two(key % 12 + 1), (key % 70 + 1950).cast("string"))),
        ("", F.concat_ws("-", (key % 70 + 1950).cast("string"), two(key % 12 + 1), two(key % 28 + 1))),
        ("account no: ", digits(key, 12)),
        ("", F.concat(lit("$ "), (key % 9000 + 1).cast("string"), lit(".50"))),
        ("", F.concat(lit("12, Gandhi Road, Chennai 6"), digits(key, 5))),
        ("", F.concat(card, luhn_digit(card))),
    )
    out = None
    for i, (before, value) in enumerate(made):
        s = F.struct(lit(before).alias("before"), value.alias("value"))
        out = F.when(key % len(made) == i, s) if out is None else out.when(key % len(made) == i, s)
    return out


def corpus(keys: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, cls, value, start): a text for each key, and the truth about it."""
    made = values(F.col(key))
    rows = keys.select(F.col(key).alias("doc_id"), F.get(F.array(*[F.lit(c) for c in CLASSES]), (F.col(key) % len(CLASSES)).cast("int")).alias("cls"), made.alias("v"))
    head = F.concat(F.lit("Note x"), F.col("doc_id").cast("string"), F.lit("x: "), F.col("v.before"))
    return rows.select("doc_id", F.concat(head, F.col("v.value"), F.lit(" end")).alias("text"), "cls", F.col("v.value").alias("value"), F.length(head).alias("start"))

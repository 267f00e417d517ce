"""Format-preserving pseudonyms for personal data in text. DataFrame functions only.

One expression finds candidates; each is then validated by its kind. Numbers and dates are permuted within their format
by a keyed Feistel network: the halves of the value's domain are added to, in turn, by a keyed hash of the other half,
modulo the half's size, so each round can be undone and equal values stay equal in all documents.

* payment cards: 13 to 19 digits that pass the Luhn check; all digits but the last are permuted, then the check digit
  is made anew, so the pseudonym passes too; separators stay in place
* phone numbers: the digits after the country code, or all ten of an unprefixed number; punctuation stays
* social security numbers ddd-dd-dddd with assignable parts: all nine digits
* IPv4 addresses with octets up to 255: 32 bits
* dates yyyy-mm-dd and d/m/yyyy that exist, within 73,000 days of 1900-01-01: another such date in the same format; one
  that only exists as m/d/yyyy walks on along the permutation to the next that also does

Mail addresses and secrets have no such domain: they become keyed hashes, an address under a reserved domain and a
secret of the same length in hexadecimal.

The caller gives the key. It reaches the executors as the value of a scalar subquery, so query plans don't show it.

Defined results: null text stays null and has no replacements. Candidates that fail validation stay as they are.
Overlaps can't occur: candidates are the leftmost matches of one expression. Repeated rows each get a row. All columns
of the caller stay; where one has the name for the kinds already, these get the name with underscores after it.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ROUNDS = 10
EPOCH, DAYS, DAYS_LOW = "1900-01-01", 73_000, 292
#: Steps on the way to a date whose day is above 12: 2 in 5 steps miss, so all of these do once in 10**25 dates.
WALK = 64
#: The session setting that holds the key of the registered query and of the pipeline.
KEY_SETTING = "spark.ferrite.pii.key"

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|(?:sk|pk|rk|ghp|gho)[-_][A-Za-z0-9_-]{16,80}|AKIA[0-9A-Z]{16})(?![A-Za-z0-9])"
DATE = r"(?<![\d/-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4})(?![\d/]|-\d)"
IP = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d]|-\d)"
CARD = r"(?<![\dA-Za-z])(?:\d{13,19}|\d{4}([ -])\d{4}(?:\1\d{4}){1,2}(?:\1\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{5})(?![\dA-Za-z])"
PHONE = r"\+\d{1,3}(?:[ .-]?\(\d{2,4}\)|[ .-]?\d{2,4})(?:[ .-]?\d{2,4}){1,3}(?!\d)|(?<![\d+(])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
ANY = "|".join((EMAIL, SECRET, DATE, IP, SSN, CARD, PHONE))
#: Whatever ANY matches holds one of these; texts without are not searched.
HINT = r"@|\d[\d ()./-]{6}|[0-9a-f]{32}|(?:sk|pk|rk|ghp|gho)[-_]|AKIA"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once; an expression that a lambda holds is else computed at each step."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def _hash60(*parts: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 15), 16, 10).cast("bigint")


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: Column, tweak: Column) -> Column:
    """struct(a, b): a keyed permutation of the pairs 0 <= a < size_a, 0 <= b < size_b."""

    def step(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        f = _hash60(key, tweak, i.cast("string"), F.when(odd, s["b"]).otherwise(s["a"]).cast("string"))
        return F.struct(F.when(odd, (s["a"] + f) % size_a).otherwise(s["a"]).alias("a"), F.when(odd, s["b"]).otherwise((s["b"] + f) % size_b).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")), step)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("bigint")


def permute_digits(digits: Column, key: Column, kind: str) -> Column:
    """A keyed permutation of the strings of as many digits; two digits at least."""
    n = F.length(digits)
    low = F.floor(n / 2).cast("int")
    high = n - low
    pair = feistel(F.substring(digits, F.lit(1), low), F.substring(digits, low + 1, high), _power(low), _power(high), key, F.concat(F.lit(kind), n.cast("string")))
    return _let(pair, lambda got: F.concat(F.lpad(got["a"].cast("string"), low, "0"), F.lpad(got["b"].cast("string"), high, "0")))


def _luhn_sum(digits: Column, doubled_first: int) -> Column:
    """Luhn sum from the right; the digits at positions of this parity (0: the last one) count twice."""
    n = F.length(digits)

    def add(s: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return s + F.when(i % 2 == doubled_first, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""

    def put(s: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(F.concat(s["o"], F.when(is_digit, F.substring(digits, s["k"], F.lit(1))).otherwise(c)).alias("o"), (s["k"] + is_digit.cast("int")).alias("k"))

    return F.aggregate(F.filter(F.split(shape, ""), lambda c: c != ""), F.struct(F.lit("").alias("o"), F.lit(1).alias("k")), put, lambda s: s["o"])


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def _date(x: Column, key: Column) -> Column:
    iso, wide = F.substring(x, 5, 1) == "-", F.length(x) == 10
    parse = lambda *patterns: F.coalesce(*[F.try_to_timestamp(x, F.lit(p)) for p in patterns]).cast("date")
    day = F.when(iso, parse("yyyy-MM-dd")).when(wide, parse("dd/MM/yyyy")).otherwise(parse("d/M/yyyy"))
    swapped = F.when(~iso & day.isNull(), F.when(wide, parse("MM/dd/yyyy")).otherwise(parse("M/d/yyyy")))
    on = lambda n: F.date_add(F.lit(EPOCH).cast("date"), n.cast("int"))

    def move(n: Column) -> Column:
        return _let(feistel(F.floor(n / DAYS_LOW), n % DAYS_LOW, F.lit(DAYS // DAYS_LOW), F.lit(DAYS_LOW), key, F.lit("date")), lambda got: got["a"] * DAYS_LOW + got["b"])

    def walk(n: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), move(n), lambda m, _: F.when(F.dayofmonth(on(m)) > 12, m).otherwise(move(m)))

    def shown(n: Column) -> Column:
        return _let(on(n), lambda d: F.when(iso, F.date_format(d, "yyyy-MM-dd")).when(wide, F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "d/M/yyyy")))

    def swapped_shown(n: Column) -> Column:
        return _let(on(n), lambda d: F.when(wide, F.date_format(d, "MM/dd/yyyy")).otherwise(F.date_format(d, "M/d/yyyy")))

    since = lambda d: F.datediff(d, F.lit(EPOCH).cast("date")).cast("bigint")
    plain = _let(since(day), lambda n: F.when(n.between(0, DAYS - 1), _let(move(n), shown)))
    other = _let(since(swapped), lambda n: F.when(n.between(0, DAYS - 1), _let(walk(n), swapped_shown)))
    return F.coalesce(plain, other)


def _ip(x: Column, key: Column) -> Column:
    def shown(got: Column) -> Column:
        parts = [F.floor(got["a"] / 256), got["a"] % 256, F.floor(got["b"] / 256), got["b"] % 256]
        return F.concat_ws(".", *[p.cast("string") for p in parts])

    def move(o: Column) -> Column:
        octet = lambda i: o[i].cast("int")
        pair = feistel(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), F.lit(65536), F.lit(65536), key, F.lit("ip"))
        return F.when(F.forall(o, lambda v: v.cast("int") < 256), _let(pair, shown))

    return _let(F.split(x, r"\."), move)


def _card(x: Column, key: Column) -> Column:
    def whole(body: Column) -> Column:
        return F.concat(body, ((10 - _luhn_sum(body, 0) % 10) % 10).cast("string"))

    def move(d: Column) -> Column:
        new = _let(permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card"), whole)
        return F.when(_luhn_sum(d, 1) % 10 == 0, _let(new, lambda digits: _refill(x, digits)))

    return _let(_digits(x), move)


def _phone(x: Column, key: Column) -> Column:
    country = F.regexp_extract(x, r"^\+(?:\d{1,3}(?=[ .(-])|\d)", 0)

    def move(rest: Column) -> Column:
        return _let(_digits(rest), lambda d: F.when(F.length(d).between(6, 14), F.concat(country, _let(permute_digits(d, key, "phone"), lambda digits: _refill(rest, digits)))))

    return _let(F.substring(x, F.length(country) + 1, F.length(x)), move)


def _ssn(x: Column, key: Column) -> Column:
    fine = ~F.substring(x, 1, 3).isin("000", "666") & (F.substring(x, 1, 1) != "9") & (F.substring(x, 5, 2) != "00") & (F.substring(x, 8, 4) != "0000")
    return F.when(fine, _let(permute_digits(_digits(x), key, "ssn"), lambda digits: _refill(x, digits)))


def pseudonym(x: Column, key: Column) -> Column:
    """struct(kind, value) for one candidate; both null if it fails validation."""
    kind = (
        F.when(F.instr(x, "@") > 0, "email")
        .when(x.rlike(_whole(SECRET)), "secret")
        .when(x.rlike(_whole(DATE)), "date")
        .when(x.rlike(_whole(IP)), "ip")
        .when(x.rlike(_whole(SSN)), "ssn")
        .when(x.rlike(_whole(CARD)), "card")
        .otherwise("phone")
    )
    secret = F.substring(F.concat(F.sha2(F.concat_ws("|", key, F.lit("s1"), x), 256), F.sha2(F.concat_ws("|", key, F.lit("s2"), x), 256)), F.lit(1), F.length(x))
    email = F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", key, F.lit("email"), F.lower(x)), 256), 1, 16), F.lit("@mail.invalid"))

    def named(k: Column) -> Column:
        value = (
            F.when(k == "email", email)
            .when(k == "secret", secret)
            .when(k == "date", _date(x, key))
            .when(k == "ip", _ip(x, key))
            .when(k == "ssn", _ssn(x, key))
            .when(k == "card", _card(x, key))
            .otherwise(_phone(x, key))
        )
        return F.struct(k.alias("kind"), value.alias("value"))

    return _let(kind, named)


def session_key(spark: SparkSession) -> str:
    """The key in KEY_SETTING; without one, a random key that lasts as long as the application."""
    sc = spark.sparkContext
    if not spark.conf.get(KEY_SETTING, None) and not hasattr(sc, "_ferrite_pii_key"):
        sc._ferrite_pii_key = secrets.token_hex(32)
    return spark.conf.get(KEY_SETTING, None) or sc._ferrite_pii_key


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def pseudonymise(docs: DataFrame, key: str, text: str = "text", kinds: str = "pii_kinds") -> DataFrame:
    """All columns of ``docs`` with ``text`` rewritten, and ``kinds``, the kinds replaced in order of appearance."""
    if not key:
        raise ValueError("a key is needed")
    k, m, p, out = (_free(n, docs.columns) for n in ("_key", "_matches", "_pseudonyms", kinds))
    held = docs.sparkSession.createDataFrame([(key,)], "k string").scalar()
    hit = F.coalesce(F.col(text).rlike(HINT), F.lit(False))
    found = docs.withColumns({k: held, m: F.when(hit, F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0)))})
    found = found.withColumn(p, F.when(F.size(m) > 0, F.transform(m, lambda x: pseudonym(x, F.col(k)))))
    some = F.coalesce(F.exists(p, lambda x: x["value"].isNotNull()), F.lit(False))
    # The gaps between matches, each but the first after the match's pseudonym, or the match itself.
    new = F.transform(p, lambda x, i: F.coalesce(x["value"], F.get(F.col(m), i)))
    text_out = F.array_join(F.zip_with(F.concat(F.array(F.lit("")), new), F.split(F.col(text), ANY, -1), lambda v, g: F.concat(v, g)), "")
    listed = F.transform(F.filter(p, lambda x: x["value"].isNotNull()), lambda x: x["kind"])
    return found.withColumn(out, F.when(some, listed).otherwise(F.array().cast("array<string>"))).withColumn(text, F.when(some, text_out).otherwise(F.col(text))).drop(k, m, p)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: every document's text with pseudonyms."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, session_key(spark)).select("doc_id", "text", F.size("pii_kinds").cast("bigint").alias("n_replaced"), F.array_join("pii_kinds", ",").alias("pii_kinds"))

"""Personal data under format-preserving pseudonyms, so that equal values stay linked across documents.

Numbers and dates that pass their own check (Luhn, mod 97, octets, calendar, area and group) are permuted inside their
format by a keyed Feistel network: a card stays a valid card, a date a date, an address an address. E-mail addresses
aren't numbers: they become keyed names under a reserved domain. The key decides the permutation; whoever holds it can
link, nobody else can. It reaches the tasks as the result of a subquery, so no plan shows it.
"""

from __future__ import annotations

import secrets
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.spans import let

ROUNDS = 8
#: Fixed patterns, in the order in which they are tried at a place. A name in front of @ is tried from its first character
#: alone, or from where the last match ended, so that a long run without @ is read once. A host has 127 labels at most.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,125}\.[A-Za-z]{2,}"
DATE = (
    r"(?<![0-9])(?:(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])"
    r"|(?:0[1-9]|[12][0-9]|3[01])([./])(?:0[1-9]|1[0-2])\1(?:19|20)[0-9]{2})(?![0-9])"
)
ADDRESS = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])"
PHONE = (
    r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}"
    r"|\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z])"
)
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[A-Z]{0,4}[0-9]{10,26}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![0-9A-Za-z])"
KINDS = {"email": EMAIL, "date": DATE, "address": ADDRESS, "ssn": SSN, "card": CARD, "phone": PHONE, "iban": IBAN}
#: All kinds that begin by a digit, a plus, a bracket or a country, and those with e-mail before them for texts that hold an @.
NUMBERS = "(?=[0-9+(]|[A-Z]{2}[0-9]{2})(?:" + "|".join(f"(?:{p})" for k, p in KINDS.items() if k != "email") + ")"
ANY = f"(?:{EMAIL})|{NUMBERS}"
#: Days from 1900-01-01 to 2099-12-31: 73,049 = 17 x 4,297, so that the network permutes them exactly.
DAYS = (17, 4297)
#: Areas 001 to 899 but 666, with groups 01 to 99, and serials 0001 to 9999: all numbers that pass the check.
SSN_HALVES = (898 * 99, 9999)


def feistel(left: Column, right: Column, a: Column, b: Column, key: Column, tweak: str) -> Column:
    """Struct (l, r): a keyed permutation of the pairs in [0, a) x [0, b); each round adds to one half a keyed hash of
    the other, which can be taken away again, so distinct pairs stay distinct."""

    def hashed(x: Column, i: Column) -> Column:
        return F.conv(F.substring(F.sha2(F.concat_ws("|", key, F.lit(tweak), a.cast("string"), b.cast("string"), i.cast("string"), x.cast("string")), 256), 1, 15), 16, 10).cast("long")

    def step(s, i):
        even = i % 2 == 0
        other = F.when(even, s["r"]).otherwise(s["l"])
        h = hashed(other, i)
        return F.struct(F.when(even, F.pmod(s["l"] + h, a)).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(F.pmod(s["r"] + h, b)).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _digits_permuted(digits: Column, key: Column, tweak: str) -> Column:
    """A string of 2 to 30 digits under the permutation of all strings of its length."""
    n = F.length(digits)
    n_left = F.floor(n / 2).cast("int")
    power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    out = feistel(F.substring(digits, F.lit(1), n_left), F.substring(digits, n_left + 1, n), power(n_left), power(n - n_left), key, tweak)
    return F.concat(F.lpad(out["l"].cast("string"), n_left, "0"), F.lpad(out["r"].cast("string"), n - n_left, "0"))


def _into(shape: Column, digits: Column) -> Column:
    """The digits in the places that digits have in the shape, from the left."""
    zero = F.struct(F.lit(0).alias("i"), F.lit("").alias("out"))

    def placed(d):
        def more(a, c):
            digit = c.between("0", "9")
            return F.struct((a["i"] + F.when(digit, 1).otherwise(0)).alias("i"), F.concat(a["out"], F.when(digit, F.substring(d, a["i"] + 1, F.lit(1))).otherwise(c)).alias("out"))

        return F.aggregate(F.split(shape, ""), zero, more, lambda a: a["out"])

    return let(digits, placed)


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits, of which the last one is not doubled."""

    def worth(c, i):
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _mod97(text: Column) -> Column:
    """The remainder of an upper-case string read as a number, a letter standing for two digits (A: 10)."""
    codes = F.transform(F.regexp_extract_all(text, F.lit("."), F.lit(0)), lambda c: F.ascii(c) - F.when(c >= "A", 55).otherwise(48))
    return F.aggregate(codes, F.lit(0), lambda r, v: (r * F.when(v > 9, 100).otherwise(10) + v) % 97)


def _date(match: Column) -> Column:
    """The day of either way to write it; null where the calendar has none."""
    return F.when(match.contains("-"), F.try_to_date(match, "yyyy-MM-dd")).otherwise(F.try_to_date(F.translate(match, ".", "/"), "dd/MM/yyyy"))


def _check_digits(country: Column, rest: Column) -> Column:
    """The two digits behind the country that make an IBAN valid."""
    return F.lpad((98 - _mod97(F.concat(rest, country, F.lit("00")))).cast("string"), 2, "0")


def _kind(match: Column, digits: Column) -> Column:
    """The kind of a match (digits: those in it) that also passes its check, or null."""
    octets = F.transform(F.split(match, r"\."), lambda x: F.coalesce(F.try_to_number(x, F.lit("999")).cast("int"), F.lit(999)))
    area = F.substring(digits, 1, 3)
    whole = lambda p: match.rlike(f"^(?:{p})$")
    plain = F.replace(match, F.lit(" "), F.lit(""))
    valid = (_mod97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1) & F.length(plain).between(15, 34)
    return (
        F.when(match.contains("@"), "email")
        .when(match.rlike("^[A-Z]"), F.when(valid, "iban"))
        .when(whole(DATE), F.when(_date(match).isNotNull(), "date"))
        .when(whole(ADDRESS), F.when(F.forall(octets, lambda x: x < 256), "address"))
        .when(whole(SSN), F.when(~area.isin("000", "666") & (area < "900") & (F.substring(digits, 4, 2) != "00") & (F.substring(digits, 6, 4) != "0000"), "ssn"))
        .when(whole(CARD) & F.length(digits).between(13, 19) & (_luhn_sum(digits) % 10 == 0), "card")
        .when(whole(PHONE) & F.length(digits).between(9, 15), "phone")
    )


def _ssn(digits: Column, key: Column) -> Column:
    """Nine digits of a valid number under the permutation of all valid ones."""
    area, group, serial = (F.substring(digits, *at).cast("int") for at in ((1, 3), (4, 2), (6, 4)))
    place = (area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1
    out = feistel(place, serial - 1, *map(F.lit, SSN_HALVES), key, "ssn")

    def written(x):
        index = F.floor(x["l"] / 99)
        parts = (index + 1 + F.when(index >= 665, 1).otherwise(0), 3), (x["l"] % 99 + 1, 2), (x["r"] + 1, 4)
        return F.concat(*[F.lpad(n.cast("string"), width, "0") for n, width in parts])

    return let(out, written)


def _moved_date(match: Column, key: Column) -> Column:
    first = F.lit("1900-01-01").cast("date")
    day = F.datediff(_date(match), first)
    moved = feistel(F.floor(day / DAYS[1]), day % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]), key, "date")
    date = let(moved, lambda m: F.date_add(first, (m["l"] * DAYS[1] + m["r"]).cast("int")))
    return (
        F.when(match.contains("-"), F.date_format(date, "yyyy-MM-dd"))
        .when(match.contains("."), F.date_format(date, "dd.MM.yyyy"))
        .otherwise(F.date_format(date, "dd/MM/yyyy"))
    )


def _moved_address(match: Column, key: Column) -> Column:
    octets = F.transform(F.split(match, r"\."), lambda x: x.cast("int"))
    halves = let(octets, lambda o: feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "address"))
    return let(halves, lambda h: F.concat_ws(".", *[F.floor(x / d) % 256 for x in (h["l"], h["r"]) for d in (256, 1)]))


def _moved_iban(match: Column, key: Column) -> Column:
    """Digits behind the check digits permuted, letters in place, check digits anew, blanks as they were."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    country, rest = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
    digits = F.regexp_replace(rest, "[^0-9]", "")
    moved = F.when(F.length(digits) > 1, _into(rest, _digits_permuted(digits, key, "iban"))).otherwise(rest)
    whole = let(moved, lambda m: F.concat(country, _check_digits(country, m), m))
    return F.when(match.contains(" "), F.trim(F.regexp_replace(whole, "(.{4})", "$1 "))).otherwise(whole)


def pseudonym(match: Column, kind: Column, digits: Column, key: Column) -> Column:
    """What stands for a match of that kind, with those digits: of the same kind and format; without a kind, the match itself."""
    n = F.length(digits)
    name = F.substring(F.sha2(F.concat_ws("|", key, F.lit("email"), F.lower(match)), 256), 1, 24)
    body = let(_digits_permuted(F.substring(digits, F.lit(1), n - 1), key, "card"), lambda b: F.concat(b, ((10 - _luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
    kept = F.greatest(n - 10, F.lit(0))  # the country's prefix of a long number stays
    phone = F.concat(F.substring(digits, F.lit(1), kept), _digits_permuted(F.substring(digits, kept + 1, n), key, "phone"))
    return (
        F.when(kind == "email", F.concat(F.lit("u"), name, F.lit("@mail.invalid")))
        .when(kind == "date", _moved_date(match, key))
        .when(kind == "address", _moved_address(match, key))
        .when(kind == "ssn", _into(match, _ssn(digits, key)))
        .when(kind == "card", _into(match, body))
        .when(kind == "phone", _into(match, phone))
        .when(kind == "iban", _moved_iban(match, key))
        .otherwise(match)
    )


def session_key(spark: SparkSession) -> str:
    """The key in ``spark.loomspark.pii.key``; without one, a random key that only this Python process knows, so that
    pseudonyms link what this process writes and nothing else. There is no default that others could know."""
    return spark.conf.get("spark.loomspark.pii.key", None) or _own_key()


@lru_cache(maxsize=1)
def _own_key() -> str:
    return secrets.token_hex(32)


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """A row for each row of docs: doc_id, text with pseudonyms, and n_<kind> (long) of what was replaced.

    A null text stays null with counts of 0. Equal rows give equal rows; other columns of docs are not read. Each row
    is worked on by itself, in time linear in its length and matches: nothing is shuffled. An empty key is refused.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    keys = docs.sparkSession.createDataFrame([(key,)], "key string")
    text = F.col("text").cast("string")
    # Each kind holds an @ or two digits at least; a text without an @ is spared the e-mail pattern.
    some = F.when(text.contains("@"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).when(text.rlike("[0-9]"), F.regexp_extract_all(text, F.lit(NUMBERS), F.lit(0)))
    parts = docs.select("doc_id", text.alias("text"), some.alias("found"), keys.scalar().alias("key"))
    gaps = F.when(F.size("found") > 0, F.when(F.contains("text", F.lit("@")), F.split("text", ANY, -1)).otherwise(F.split("text", NUMBERS, -1)))
    digits = F.transform("found", lambda m: F.struct(m.alias("m"), F.regexp_replace(m, "[^0-9]", "").alias("digits")))
    judged = F.transform(digits, lambda x: F.struct(x["m"].alias("m"), x["digits"].alias("digits"), _kind(x["m"], x["digits"]).alias("kind")))
    parts = parts.select("doc_id", "text", "key", gaps.alias("gaps"), judged.alias("found"))
    new = F.concat(F.transform("found", lambda x: pseudonym(x["m"], x["kind"], x["digits"], F.col("key"))), F.array(F.lit("")))
    joined = F.array_join(F.zip_with("gaps", new, lambda g, m: F.concat(g, m)), "")
    count = lambda k: F.coalesce(F.size(F.filter("found", lambda x: x["kind"] == k)), F.lit(0)).cast("long")
    changed = F.when(F.col("gaps").isNotNull(), joined).otherwise(F.col("text"))
    return parts.select("doc_id", changed.alias("text"), *[F.when(F.col("gaps").isNull(), F.lit(0).cast("long")).otherwise(count(k)).alias(f"n_{k}") for k in KINDS])

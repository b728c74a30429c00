"""Pseudonyms for personal numbers and dates that keep their format.

Card numbers (by Luhn's check digit), phone numbers, IPv4 addresses, calendar dates and e-mail
addresses are found and validated; each is replaced by a keyed permutation of its own kind and
length, so equal values stay equal in all documents and different ones stay different. The
permutation is an alternating Feistel network: a value is a pair of digits in bases ``a`` and ``b``,
and each round adds a keyed hash of one half to the other, modulo its base. A new card number gets its
own check digit; a new date is a date of the same range; separators and brackets stay.

Everything is built-in functions on the row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

ROUNDS = 8
KINDS = ("card", "phone", "ip", "date", "email")

# What may be personal; the order decides where several could start at one place.
# Possessive groups are loops in Java: others call themselves once a label and overflow the stack.
EMAIL = r"[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"\d{1,3}(?:\.\d{1,3}){3}"
PHONE = r"\+\d{1,3}[ -]?\(?\d{3}\)?[ -]?\d{3}[ -]?\d{4}"
DATE = r"\d{4}-\d{2}-\d{2}|\d{2}[/.]\d{2}[/.]\d{4}"
CARD = r"\d(?:[ -]?\d){12,18}"
NUMBERS = rf"(?<![\d.+-])(?:{PHONE}|(?:{IP}|{DATE}|{CARD})(?![\d-]|\.\d))"
PATTERN = rf"{NUMBERS}|(?<![A-Za-z0-9._%+-]){EMAIL}"

# Dates are permuted among 270 * 270 days.
FIRST_DAY, DATE_BASE = "1900-01-01", 270


def feistel(left: Column, right: Column, a: Column, b: Column, key: Column) -> Column:
    """The permuted pair of ``left < a`` and ``right < b``, as a struct ``l``, ``r``."""

    def mixed(i: Column, half: Column) -> Column:
        text = F.concat_ws(":", key, i.cast("string"), half.cast("string"))
        return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        left = F.when(even, (s.l + mixed(i, s.r)) % a).otherwise(s.l)
        right = F.when(even, s.r).otherwise((s.r + mixed(i, s.l)) % b)
        return F.struct(left.alias("l"), right.alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def permute_digits(digits: Column, key: Column) -> Column:
    """A string of 2 to 36 digits as another of its length."""
    n = F.length(digits)
    low = F.floor(n / 2).cast("int")
    high = n - low
    key = F.concat_ws(":", key, n.cast("string"))
    pair = feistel(F.substr(digits, F.lit(1), low).cast("long"),
                   F.substr(digits, low + 1, high).cast("long"),
                   F.pow(F.lit(10), low).cast("long"), F.pow(F.lit(10), high).cast("long"), key)
    return F.transform(F.array(pair), lambda p: F.concat(
        F.lpad(p.l.cast("string"), low, F.lit("0")), F.lpad(p.r.cast("string"), high, F.lit("0"))))[0]


def luhn_sum(digits: Column, double_last: bool) -> Column:
    """The sum of digits, every second one doubled, counted from the right end."""
    odd = 1 if double_last else 0
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, at: Column) -> Column:
        digit = F.substr(digits, F.length(digits) - at + 1, F.lit(1)).cast("int")
        twice = F.when(digit >= 5, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(at % 2 == odd, twice).otherwise(digit)

    return F.aggregate(places, F.lit(0), add)


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""
    def put(at: Column) -> Column:
        own = F.substr(shape, at, F.lit(1))
        before = F.length(_digits(F.substr(shape, F.lit(1), at)))
        return F.when(own.rlike("[0-9]"), F.substr(digits, before, F.lit(1))).otherwise(own)
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), put), "")


def _iso(value: Column) -> Column:
    """A date of either form as year, month, day."""
    european = F.concat_ws("-", F.substring(value, 7, 4), F.substring(value, 4, 2),
                           F.substring(value, 1, 2))
    return F.when(value.rlike(r"^\d{4}-"), value).otherwise(european)


def _day(value: Column) -> Column:
    """The number of a date among those permuted; null for what is no date or out of range."""
    day = F.datediff(F.try_to_date(_iso(value), "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date"))
    return F.when(day.between(0, DATE_BASE ** 2 - 1), day)


def kind(value: Column) -> Column:
    """What a match of :data:`PATTERN` is, once validated; null if it is nothing."""
    octets = F.transform(F.split(value, r"\."), lambda o: o.cast("int"))
    digits = _digits(value)
    luhn = F.length(digits).between(13, 19) & (luhn_sum(digits, False) % 10 == 0)
    return (F.when(value.contains("@"), "email")
            .when(value.rlike(r"^\+"), "phone")
            .when(value.rlike(rf"^{IP}$"), F.when(F.forall(octets, lambda o: o <= 255), "ip"))
            .when(value.rlike(rf"^(?:{DATE})$"), F.when(_day(value).isNotNull(), "date"))
            .when(luhn, "card"))


def pseudonym(value: Column, its_kind: Column, key: str) -> Column:
    """The replacement of a validated match; other matches stay."""
    def of(name: str) -> Column:
        return F.lit(f"{key}:{name}")

    digits = _digits(value)
    body = F.substr(digits, F.lit(1), F.length(digits) - 1)
    card = F.transform(F.array(permute_digits(body, of("card"))), lambda b: F.concat(
        b, ((10 - luhn_sum(b, True) % 10) % 10).cast("string")))[0]
    national = F.right(digits, F.lit(10))
    phone = F.concat(F.substr(digits, F.lit(1), F.length(digits) - 10),
                     permute_digits(national, of("phone")))
    octets = F.transform(F.split(value, r"\."), lambda o: o.cast("long"))
    half = F.lit(1 << 16).cast("long")
    ip = F.transform(
        F.array(feistel(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], half, half,
                        of("ip"))),
        lambda p: F.concat_ws(".", F.floor(p.l / 256), p.l % 256, F.floor(p.r / 256), p.r % 256))[0]
    base = F.lit(DATE_BASE).cast("long")
    day = F.transform(
        F.array(feistel(F.floor(_day(value) / DATE_BASE), _day(value) % DATE_BASE, base, base,
                        of("date"))),
        lambda p: F.date_add(F.lit(FIRST_DAY).cast("date"), (p.l * DATE_BASE + p.r).cast("int")))[0]
    date = (F.when(value.rlike(r"^\d{4}-"), F.date_format(day, "yyyy-MM-dd"))
            .when(value.contains("/"), F.date_format(day, "dd/MM/yyyy"))
            .otherwise(F.date_format(day, "dd.MM.yyyy")))
    name = F.substring_index(value, "@", 1)
    # an address's name has no fixed length to permute in: it becomes 16 hexadecimal digits
    email = F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws(":", of("email"), F.lower(name)),
                                                    256), 1, 16),
                     F.lit("@"), F.substring_index(value, "@", -1))
    return (F.when(its_kind == "card", _refill(value, card))
            .when(its_kind == "phone", _refill(value, phone))
            .when(its_kind == "ip", ip).when(its_kind == "date", date)
            .when(its_kind == "email", email).otherwise(value))


def _is(name: str):
    return lambda match: match["kind"] == name


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with personal values in ``text`` replaced, and the number of each kind found.

    ``n_card``, ``n_phone``, ``n_ip``, ``n_date`` and ``n_email`` replace columns of those names; all
    other columns pass through. A null text stays null with counts of 0; an empty or very long text
    is treated whole. Repeated rows are changed alike. What only looks like a personal value, such
    as a number with a wrong check digit or the 31st of February, stays.
    """
    found = F.transform(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)),
                        lambda m: F.struct(kind(m).alias("kind"), m.alias("value")))
    (matches,) = fresh(docs, "_pii_found")
    located = docs.withColumn(matches, F.coalesce(
        found, F.array().cast("array<struct<kind:string,value:string>>")))
    new = F.transform(matches, lambda m: pseudonym(m["value"], m["kind"], key))
    between = F.split(F.col("text"), PATTERN)
    text = F.concat(
        F.array_join(F.zip_with(F.slice(between, 1, F.size(matches)), new,
                                lambda plain, value: F.concat(plain, value)), ""),
        F.element_at(between, -1))
    some = F.exists(matches, lambda m: m["kind"].isNotNull())
    out = located.withColumn("text", F.when(some, text).otherwise(F.col("text")))
    for name in KINDS:
        out = out.withColumn(f"n_{name}", F.size(F.filter(matches, _is(name))).cast("long"))
    return out.drop(matches)

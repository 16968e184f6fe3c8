"""Format-preserving pseudonyms of personal numbers, dates and addresses by a keyed Feistel network.

Candidates are found by patterns and then validated: card numbers by their check digit, IPv4 addresses by their
octets, dates by the calendar (years 1900 to 2099), social security numbers by their ranges, telephone numbers and e-mail
addresses by their form and length. A date with slashes is read month first, or day first where that is no date.
A valid value becomes a sequence of elements with a range each (digits, letters by case, octets, a date's day number
in two parts). Its two halves take turns: each element of one half is moved within its range by an amount that a keyed
hash of the other half gives. That permutes all values of one format, so equal values have equal pseudonyms in all
documents and different ones different pseudonyms. Separators stay and don't count: a card's digits, a telephone number
with or without its country code, and a date in any form but one have the same pseudonym however they are written. The
exception are dates that can only be read day first between slashes: they become dates of that kind, by as many turns as
that takes, so that no two values with slashes meet. A card's last digit is made to check again; a telephone number's
country code and an e-mail address's domain stay. What isn't valid stays as it is.

Defined cases: a null text stays null, an empty one empty; repeated rows change alike; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Candidates of each kind.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,20}"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
ADDRESS = rf"(?<![\w.])(?:{OCTET}\.){{3}}{OCTET}(?![\w]|\.\d)"
DATE = (
    r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}(?=T\d\d:)"
    r"|(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\w/-]))"
)
SECURITY = r"(?<![\w.+-])\d{3}-\d{2}-\d{4}(?![\w-])"
PHONE = (
    r"(?<![\w.])\+\d{1,3} \(\d{3}\) \d{3}-\d{4}(?!\w)|(?<![\w.])\+\d{1,3}(?:[ .-]\d{2,4}){2,4}(?![\w-])"
    r"|(?<![\w.+-])(?:\(\d{3}\) |\d{3}-)\d{3}-\d{4}(?![\w-])|(?<![\w.])\+[1-9]\d{7,14}(?![\w-])"
)
#: Country codes of one and two digits; all others have three.
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
CARD = r"(?<![\w.+-])(?:\d{13,19}|(?:\d{4}-){3}\d{4}|(?:\d{4} ){3}\d{4})(?![\w-])"
ANY = "|".join((EMAIL, ADDRESS, DATE, SECURITY, PHONE, CARD))
KINDS = ("email", "address", "date", "security", "card", "phone")
#: Days from 1900-01-01 to 2099-12-31 are DAY_PARTS multiplied.
FIRST_DAY, DAY_PARTS = "1900-01-01", (17, 4297)
#: Turns after which a date read day first is still one of the first twelve days of a month: about 1 of 10 ** 26.
DAY_TURNS = 64


def feistel(elements: Column, ranges: Column, tag: Column, key: str) -> Column:
    """Permute an array of integers, each below its range, by ``key``; up to 64 elements."""
    size = F.size(elements)
    cut = F.floor(size / 2).cast("int")

    def turn(state: Column, r: Column) -> Column:
        first = r % 2 == 0
        other = F.when(first, F.slice(state, cut + 1, size - cut)).otherwise(F.slice(state, F.lit(1), cut))
        digest = F.sha2(F.concat_ws("|", F.lit(key), tag, size.cast("string"), r.cast("string"), F.array_join(other.cast("array<string>"), ",")), 512)

        def moved(x: Column, i: Column) -> Column:
            at = F.when(first, i).otherwise(i - cut)
            by = F.conv(F.substr(digest, at * 4 + 1, F.lit(4)), 16, 10).cast("int")
            return F.when(first == (i < cut), F.pmod(x + by, F.get(ranges, i))).otherwise(x)

        return F.transform(state, moved)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), elements, turn)


def permuted_text(text: Column, tag: Column, key: str) -> Column:
    """Permute letters within their case and digits; other characters stay."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c))

    def base(c: Column) -> Column:
        return F.when(c.between(48, 57), 48).when(c.between(97, 122), 97).when(c.between(65, 90), 65).otherwise(c)

    def width(c: Column) -> Column:
        return F.when(c.between(48, 57), 10).when(c.between(97, 122) | c.between(65, 90), 26).otherwise(1)

    moved = feistel(F.transform(codes, lambda c: c - base(c)), F.transform(codes, width), tag, key)
    return F.array_join(F.zip_with(codes, moved, lambda c, x: F.char(base(c) + x)), "")


def _email(value: Column, key: str) -> Column:
    local = F.substring_index(value, "@", 1)
    return F.when(F.length(local) <= 64, F.concat(permuted_text(local, F.lit("email"), key), F.substr(value, F.length(local) + 1)))


def _address(value: Column, key: str) -> Column:
    octets = F.split(value, r"\.").cast("array<int>")
    moved = feistel(octets, F.transform(octets, lambda _: F.lit(256)), F.lit("address"), key)
    return F.array_join(moved.cast("array<string>"), ".")


def _date(value: Column, key: str) -> Column:
    long = F.length(value) == 10
    slashed = value.contains("/")
    parts = F.split(value, r"[-./]").cast("array<int>")
    day_first = slashed & (F.get(parts, F.lit(0)) > 12)
    form = (
        F.when(value.contains("-"), "yyyy-MM-dd")
        .when(value.contains("."), F.when(long, "dd.MM.yyyy").otherwise("d.M.yyyy"))
        .when(day_first, F.when(long, "dd/MM/yyyy").otherwise("d/M/yyyy"))
        .otherwise(F.when(long, "MM/dd/yyyy").otherwise("M/d/yyyy"))
    )
    year = F.when(value.contains("-"), F.get(parts, F.lit(0))).otherwise(F.get(parts, F.lit(2)))
    month_first = slashed & ~day_first
    month = F.when(month_first, F.get(parts, F.lit(0))).otherwise(F.get(parts, F.lit(1)))
    day = (
        F.when(value.contains("-"), F.get(parts, F.lit(2))).when(month_first, F.get(parts, F.lit(1)))
        .otherwise(F.get(parts, F.lit(0)))
    )
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    date = F.try_to_date(text, "yyyy-MM-dd")
    first, low = F.lit(FIRST_DAY).cast("date"), F.lit(DAY_PARTS[1])

    def turned(days: Column) -> Column:
        """The day number that another one becomes."""
        halves = F.array(F.floor(days / low).cast("int"), days % low)
        moved = feistel(halves, F.array(F.lit(DAY_PARTS[0]), low), F.lit("date"), key)
        return F.get(F.transform(F.array(moved), lambda m: F.get(m, F.lit(0)) * low + F.get(m, F.lit(1))), F.lit(0))

    def turned_on(days: Column, turn: Column) -> Column:
        return F.when((turn == 0) | (F.dayofmonth(F.date_add(first, days)) <= 12), turned(days)).otherwise(days)

    days = F.date_diff(date, first)
    on = F.aggregate(F.sequence(F.lit(0), F.lit(DAY_TURNS - 1)), days, turned_on)
    there = F.date_add(first, F.when(day_first, on).otherwise(turned(days)))
    return F.when(year.between(1900, 2099) & date.isNotNull(), F.call_function("date_format", there, form))


def _security(value: Column, key: str) -> Column:
    """Three parts within their ranges: 001 to 899 but 666, 01 to 99, 0001 to 9999."""
    area, group, serial = (F.get(F.split(value, "-").cast("array<int>"), F.lit(i)) for i in range(3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    parts = F.array(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1)
    moved = feistel(parts, F.array(F.lit(898), F.lit(99), F.lit(9999)), F.lit("security"), key)

    def written(m: Column) -> Column:
        at = F.get(m, F.lit(0))
        whole = (F.when(at >= 665, at + 2).otherwise(at + 1), F.get(m, F.lit(1)) + 1, F.get(m, F.lit(2)) + 1)
        return F.concat_ws("-", *[F.lpad(part.cast("string"), n, "0") for part, n in zip(whole, (3, 2, 4))])

    return F.when(valid, F.get(F.transform(F.array(moved), written), F.lit(0)))


def _card(value: Column, key: str) -> Column:
    digits = F.regexp_replace(value, "[ -]", "")
    body = permuted_text(F.substr(digits, F.lit(1), F.length(digits) - 1), F.lit("card"), key)
    ends = F.sequence(F.lit(0), F.lit(9))
    whole = F.get(F.transform(F.array(body), lambda b: F.get(F.filter(
        F.transform(ends, lambda d: F.concat(b, d.cast("string"))), lambda s: F.call_function("luhn_check", s)), F.lit(0))), F.lit(0))
    mark = F.when(value.contains("-"), "$1-$2-$3-$4").when(value.contains(" "), "$1 $2 $3 $4").otherwise("$1$2$3$4")
    return F.when(F.call_function("luhn_check", digits), F.regexp_replace(whole, F.lit(r"^(\d{4})(\d{4})(\d{4})(\d+)$"), mark))


def _phone(value: Column, key: str) -> Column:
    head = F.when(value.rlike(r"^\+\d+$"), F.regexp_extract(value, COUNTRY, 0)).otherwise(F.regexp_extract(value, r"^(\+\d{1,3})?", 0))
    rest = F.substr(value, F.length(head) + 1)
    moved = permuted_text(F.regexp_replace(rest, r"\D", ""), F.lit("phone"), key)

    def spread(digits: Column) -> Column:
        """The digits at the places of those before, between the same separators."""
        def placed(c: Column, i: Column) -> Column:
            before = F.length(F.regexp_replace(F.substr(rest, F.lit(1), i + 1), r"\D", ""))
            return F.when(c.rlike(r"\d"), F.substr(digits, before, F.lit(1))).otherwise(c)

        return F.array_join(F.transform(F.split(rest, ""), placed), "")

    n = F.length(F.regexp_replace(value, r"\D", ""))
    return F.when(n.between(8, 15), F.concat(head, F.get(F.transform(F.array(moved), spread), F.lit(0))))


def kind_of(value: Column) -> Column:
    return (
        F.when(value.contains("@"), "email").when(value.rlike(r"^\d+(\.\d+){3}$"), "address")
        .when(value.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})$"), "date")
        .when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), "security")
        .when(value.rlike(r"^(\d{13,19}|\d{4}([ -])\d{4}\2\d{4}\2\d{4})$"), "card").otherwise("phone")
    )


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of a candidate, null if it isn't valid."""
    kind, makers = kind_of(value), (_email, _address, _date, _security, _card, _phone)
    out = F.lit(None).cast("string")
    for name, make in zip(KINDS, makers):
        out = F.when(kind == name, make(value, key)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, kinds, n_replaced): every text with pseudonyms in place of valid values, and the kinds of those."""
    held = F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    found = docs.select("doc_id", "text", F.coalesce(held, F.array().cast("array<string>")).alias("found"))
    found = found.withColumn("names", F.transform("found", lambda v: pseudonym(v, key)))
    gaps = F.split("text", ANY, -1)
    filled = F.zip_with(F.zip_with("found", "names", lambda v, p: F.coalesce(p, v)), gaps, lambda v, g: F.concat(g, F.coalesce(v, F.lit(""))))
    kinds = F.zip_with("found", "names", lambda v, p: F.when(p.isNotNull(), kind_of(v)))
    kinds = F.filter(kinds, lambda k: k.isNotNull())
    return found.select(
        "doc_id", F.when(F.size("found") > 0, F.array_join(filled, "")).otherwise(F.col("text")).alias("text"),
        F.coalesce(kinds, F.array().cast("array<string>")).alias("kinds"),
    ).withColumn("n_replaced", F.size("kinds").cast("long"))

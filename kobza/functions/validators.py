"""Checks of identifiers, dates and numbers, as boolean Column expressions. Null gives null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kobza.functions.expressions import let
from kobza.sources.lexicons import IBAN_LENGTHS, VIN_WEIGHTS

# Lengths of digests by algorithm.
DIGEST_LENGTHS = {"MD5": 32, "SHA1": 40, "SHA224": 56, "SHA256": 64, "SHA384": 96, "SHA512": 128, "SHA3256": 64, "SHA3512": 128, "BLAKE2S": 64, "BLAKE2B": 128}
ROMAN = "^M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"


def compact(value: Column) -> Column:
    """ASCII letters and digits alone, in upper case."""
    return F.upper(F.regexp_replace(value, "[^A-Za-z0-9]", ""))


def characters(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit("."), F.lit(0))


def weighted(value: Column, weight: Callable[[Column], Column], digit: Callable[[Column, Column], Column]) -> Column:
    """Sum of digit(character, place) * weight(place), places from 0; null if a digit is."""
    terms = F.transform(characters(value), lambda c, i: digit(c, i) * weight(i))
    return F.when(F.forall(terms, lambda t: t.isNotNull()), F.aggregate(terms, F.lit(0), lambda acc, t: acc + t))


def digit_or_x(last: int) -> Callable[[Column, Column], Column]:
    return lambda c, i: F.when(c.rlike("[0-9]"), c.try_cast("int")).when((c == "X") & (i == last), F.lit(10))


def is_leap(year: Column) -> Column:
    return (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))


def is_valid_date(day: Column, month: Column, year: Column) -> Column:
    """Gregorian, without bounds on the year."""
    longest = F.when(month == 2, F.when(is_leap(year), 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return month.between(1, 12) & (day >= 1) & (day <= longest)


def is_valid_iso_week(year: Column, week: Column) -> Column:
    before = year - 1
    weekday = (before + F.floor(before / 4) - F.floor(before / 100) + F.floor(before / 400) + 1) % 7
    return week.between(1, 52) | ((week == 53) & ((weekday == 4) | ((weekday == 3) & is_leap(year))))


def is_valid_ordinal_day(year: Column, day: Column) -> Column:
    return day.between(1, F.when(is_leap(year), 366).otherwise(365))


def valid_isbn(value: Column) -> Column:
    def check(c: Column) -> Column:
        ten = weighted(c, lambda i: F.lit(10) - i, digit_or_x(9)) % 11 == 0
        thirteen = c.rlike("^97[89][0-9]{10}$") & (weighted(c, lambda i: F.when(i % 2 == 0, 1).otherwise(3), digit_or_x(-1)) % 10 == 0)
        return F.when(F.length(c) == 10, F.coalesce(ten, F.lit(False))).otherwise(F.coalesce(thirteen, F.lit(False)))

    return F.when(value.isNotNull(), let(compact(value), check))


def valid_issn(value: Column) -> Column:
    check = lambda c: (F.length(c) == 8) & F.coalesce(weighted(c, lambda i: F.lit(8) - i, digit_or_x(7)) % 11 == 0, F.lit(False))
    return F.when(value.isNotNull(), let(compact(value), check))


def valid_iban(value: Column) -> Column:
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])

    def check(c: Column) -> Column:
        turned = characters(F.concat(F.substring(c, 5, 34), F.substring(c, 1, 4)))
        rest = F.aggregate(turned, F.lit(0), lambda acc, x: F.when(x.rlike("[0-9]"), acc * 10 + F.ascii(x) - 48).otherwise(acc * 100 + F.ascii(x) - 55) % 97)
        known = F.try_element_at(lengths, F.substring(c, 1, 2))
        return c.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (known.isNull() | (known == F.length(c))) & (rest == 1)

    return F.when(value.isNotNull(), let(compact(value), check))


def valid_luhn(value: Column) -> Column:
    """12 to 19 digits, apart from spaces and hyphens."""
    digits = F.regexp_replace(value, "[ -]", "")
    return F.when(value.isNotNull(), digits.rlike("^[0-9]{12,19}$") & F.coalesce(F.call_function("luhn_check", digits), F.lit(False)))


def vin_value(c: Column) -> Column:
    code = F.ascii(c)
    return F.when(c.rlike("[0-9]"), code - 48).when(c.between("A", "H"), code - 64).when(c.between("J", "R"), code - 73).when(c.between("S", "Z"), code - 81)


def valid_vin_checksum(value: Column) -> Column:
    """17 characters without I, O and Q; the check digit counts where the first is 1 to 5."""
    weights = F.array(*[F.lit(w) for w in VIN_WEIGHTS])

    def check(c: Column) -> Column:
        rest = weighted(c, lambda i: F.get(weights, i), lambda x, i: vin_value(x)) % 11
        return c.rlike("^[A-HJ-NPR-Z0-9]{17}$") & (~F.substring(c, 1, 1).between("1", "5") | F.coalesce(F.substring(c, 9, 1) == F.when(rest == 10, F.lit("X")).otherwise(rest.cast("string")), F.lit(False)))

    return F.when(value.isNotNull(), let(compact(value), check))


def valid_uuid_variant(value: Column) -> Column:
    return compact(value).rlike("^(0{32}|[0-9A-F]{12}[1-8][0-9A-F]{3}[89AB][0-9A-F]{15})$")


def valid_hash_length(algorithm: Column, value: Column) -> Column:
    lengths = F.create_map(*[x for name, n in DIGEST_LENGTHS.items() for x in (F.lit(name), F.lit(n))])
    digest = compact(value)
    return F.when(value.isNotNull() & algorithm.isNotNull(), F.coalesce((F.try_element_at(lengths, compact(algorithm)) == F.length(digest)) & digest.rlike("^[0-9A-F]*$"), F.lit(False)))


def valid_roman(value: Column) -> Column:
    """Canonical, up to 4999; the empty string counts too."""
    return value.rlike(ROMAN)


def valid_ipv4(value: Column) -> Column:
    """Four numbers up to 255."""
    return value.rlike("^[0-9]{1,3}([.][0-9]{1,3}){3}$") & F.forall(F.split(value, "[.]"), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))


def valid_ipv6(value: Column) -> Column:
    """Groups of one to four hex digits: eight, or fewer with one double colon."""
    groups = F.filter(F.split(value, ":"), lambda g: g != "")
    sound = F.forall(groups, lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$"))
    short = F.regexp_count(value, F.lit("::")) == 1
    edges = value.rlike("^(::|[^:])") & value.rlike("(::|[^:])$") & ~value.contains(":::")
    return value.contains(":") & sound & edges & ((short & (F.size(groups) < 8)) | ((F.regexp_count(value, F.lit("::")) == 0) & (F.size(groups) == 8)))


def valid_clock(hour: Column, minute: Column) -> Column:
    """Up to 23:59, and 24:00."""
    return (hour.between(0, 23) & minute.between(0, 59)) | ((hour == 24) & (minute == 0))


def valid_offset(hour: Column, minute: Column) -> Column:
    """Offsets from UTC up to 14:00."""
    return (hour.between(0, 13) & minute.between(0, 59)) | ((hour == 14) & (minute == 0))


def valid_coordinates(latitude: Column, longitude: Column) -> Column:
    return (F.abs(latitude) <= 90) & (F.abs(longitude) <= 180)

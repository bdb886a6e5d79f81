"""Checksums and format checks as Column expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import plain
from .unicode_fold import ascii_digits


def luhn_is_valid(x: Column) -> Column:
    """False for anything but one digit or more, of any script."""
    return F.coalesce(F.call_function("luhn_check", ascii_digits(x)), F.lit(False))


def _luhn_sum(x: Column, doubled: int) -> Column:
    """Sum of digits, those at indexes of parity ``doubled`` (a Column or a number) counted twice, nines cast out."""
    digits = F.transform(F.split(ascii_digits(x), ""), lambda c, i: F.when(i % 2 == doubled, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(digits, F.lit(0), lambda a, d: a + d)


def luhn_check_digit(x: Column) -> Column:
    """The digit that makes ``x`` and it valid; null unless ``x`` is digits."""
    total = _luhn_sum(x, (F.length(x) + 1) % 2)
    return F.when(ascii_digits(x).rlike("^[0-9]+$"), (10 - total % 10) % 10)


def national_id_is_valid(x: Column) -> Column:
    """Ten digits that start with 1 or 2: for an even length the rule is Luhn's."""
    return x.rlike(r"^[12]\p{Nd}{9}$") & luhn_is_valid(x)


def national_id_check_digit(first_nine: Column) -> Column:
    """The tenth digit; an error unless nine digits are given."""
    return F.when(ascii_digits(first_nine).rlike("^[0-9]{9}$"), (10 - _luhn_sum(first_nine, F.lit(0)) % 10) % 10).otherwise(F.raise_error("nine digits are needed").cast("int"))


def _mod97(x: Column) -> Column:
    """The remainder by 97 of digits and letters (A = 10), in Python's integers, since a number of 34 digits fits no type."""
    return F.arrow_udf(_mod97_all, "int")(ascii_digits(x))


def _mod97_all(x: pa.Array) -> pa.Array:
    return pa.array([None if v is None else plain.mod97(v) for v in x.to_pylist()], pa.int32())


def iban_is_valid(x: Column) -> Column:
    """Mod-97 check of an IBAN of any country, with or without spaces."""
    c = F.upper(F.replace(x, F.lit(" ")))
    latin = ascii_digits(c)
    return F.coalesce(latin.rlike("^[A-Z]{2}[0-9]{2}[0-9A-Z]+$") & (_mod97(F.concat(F.substr(latin, F.lit(5)), F.substr(latin, F.lit(1), F.lit(4)))) == 1), F.lit(False))


def iban_check_digits(country: Column, bban: Column) -> Column:
    return F.lpad((98 - _mod97(F.concat(F.upper(bban), F.upper(country), F.lit("00")))).cast("string"), 2, "0")


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_GROUPS = "[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*"


def ip_is_valid(x: Column) -> Column:
    """IPv4 without leading zeros, or IPv6 without a zone or an embedded IPv4 part."""
    groups = F.size(F.filter(F.split(x, ":"), lambda g: g != ""))
    full = x.rlike(f"^{_GROUPS}$") & (groups == 8)
    short = x.rlike(f"^(?:{_GROUPS})?::(?:{_GROUPS})?$") & (groups <= 7)
    return x.rlike(f"^{_OCTET}(?:\\.{_OCTET}){{3}}$") | (x.contains(":") & (full | short))

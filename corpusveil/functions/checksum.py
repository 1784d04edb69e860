"""Check digits as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import let
from .fixed import NIF_LETTERS


def nif_letter(number: Column) -> Column:
    """The letter of an eight-digit number."""
    return F.substring(F.lit(NIF_LETTERS), (number % 23 + 1).cast("int"), F.lit(1))


def nif_valid(value: Column) -> Column:
    """NIF or NIE: X, Y, Z count as 0, 1, 2; hyphens are ignored."""
    plain = F.translate(F.upper(value), "XYZ-", "012")
    # The check letter itself may be X, Y or Z, so it is taken from the untranslated text.
    return let(F.left(plain, F.length(plain) - 1), lambda digits: digits.rlike("^[0-9]{7,8}$") & (nif_letter(digits.try_cast("long")) == F.right(F.upper(value), F.lit(1))))


def mod97(digits_and_letters: Column) -> Column:
    """Remainder by 97 of a string whose letters count as 10..35."""

    def step(a: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code.between(48, 57), (a * 10 + code - 48) % 97).otherwise((a * 100 + code - 55) % 97)

    return F.aggregate(F.split(digits_and_letters, ""), F.lit(0), step)


def iban_valid(value: Column) -> Column:
    """15 to 34 letters and digits whose rearrangement leaves 1 by 97."""

    def check(v: Column) -> Column:
        turned = F.concat(F.substring(v, 5, 34), F.left(v, F.lit(4)))
        return v.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (mod97(F.when(v.rlike("^[A-Z0-9]{5,34}$"), turned).otherwise("0")) == 1)

    return let(F.upper(F.regexp_replace(value, r"[\s\-]", "")), check)

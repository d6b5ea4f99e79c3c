"""Scalar functions of legacy data (F1-F8, E18, P12, P17): built-in expressions, no Python per row."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def unpack_decimal(raw: Column, scale: int = 0) -> Column:
    """COMP-3 (packed decimal) bytes to a decimal. The last nibble is the sign: C, F plus, D minus.

    Null for null, empty, or bytes that are no packed decimal; at most 31 digits.
    """
    digits = F.hex(raw)
    body, sign = F.substr(digits, F.lit(1), F.length(digits) - 1), F.right(digits, F.lit(1))
    valid = body.rlike("^[0-9]{1,31}$") & sign.isin("C", "F", "D", "A", "E", "B")
    number = body.cast("decimal(31,0)") / F.pow(F.lit(10), F.lit(scale)).cast("decimal(12,0)") if scale else body.cast("decimal(31,0)")
    return F.when(valid, F.when(sign.isin("D", "B"), -number).otherwise(number))


def pack_decimal(number: Column, digits: int) -> Column:
    """The inverse of :func:`unpack_decimal` for whole numbers: (digits + 1) / 2 bytes, rounded up."""
    width = digits if digits % 2 else digits + 1
    text = F.lpad(F.abs(number).cast("string"), width, "0")
    return F.unhex(F.concat(text, F.when(number < 0, "D").otherwise("C")))


def zoned_decimal(text: Column, scale: int = 0) -> Column:
    """Zoned decimal in display form; an overpunched last character carries the sign ({ A-I plus, } J-R minus)."""
    last = F.right(text, F.lit(1))
    plus, minus = "{ABCDEFGHI", "}JKLMNOPQR"  # fixed values: overpunched digits 0 to 9
    digit = F.when(last.rlike("[0-9]"), last).otherwise(F.translate(last, plus + minus, "0123456789" * 2))
    body = F.concat(F.substr(text, F.lit(1), F.length(text) - 1), digit)
    number = F.when(body.rlike("^[0-9]{1,24}$"), body).cast("decimal(24,0)") / F.lit(10**scale).cast("decimal(12,0)")
    return F.when(last.isin(*minus), -number).otherwise(number)


def binary_number(raw: Column) -> Column:
    """Big-endian COMP of up to 8 bytes, two's complement."""
    value, bits = F.conv(F.hex(raw), 16, 10).cast("decimal(20,0)"), F.octet_length(raw) * 8
    return F.when(F.octet_length(raw).between(1, 8), F.when(value >= F.pow(F.lit(2.0), bits - 1).cast("decimal(20,0)"), value - F.pow(F.lit(2.0), bits).cast("decimal(20,0)")).otherwise(value))


def ebcdic_text(raw: Column, charset: str = "cp037") -> Column:
    """EBCDIC bytes to text. Spark's ``decode`` has no such charset: an Arrow-batched function."""
    @F.pandas_udf("string")
    def decoded(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else bytes(b).decode(charset))

    return decoded(raw)


def compact_date(text: Column) -> Column:
    """YYYYMMDD to a date; null where it is none."""
    return F.try_to_date(text, "yyyyMMdd")


def picture(pic: Column) -> dict[str, Column]:
    """Digits, characters, decimals and total length of a PIC clause, repetition counts expanded."""
    def total(symbol: str, part: Column) -> Column:
        counted = F.regexp_extract_all(part, F.lit(rf"{symbol}\(([0-9]+)\)"), 1)
        repeated = F.aggregate(counted, F.lit(0), lambda a, n: a + n.cast("int"))
        return repeated + F.regexp_count(F.regexp_replace(part, r"[9XA]\([0-9]+\)", ""), F.lit(symbol))

    upper = F.upper(pic)
    fraction = F.when(upper.contains("V"), F.substring_index(upper, "V", -1)).otherwise(F.lit(""))
    digits, chars, decimals = total("9", upper), total("X", upper) + total("A", upper), total("9", fraction)
    kind = F.when(chars > 0, "string").when(decimals > 0, "decimal").otherwise("integer")
    return {"digits": digits, "characters": chars, "decimals": decimals, "length": digits + chars, "kind": kind}


def number_or_zero(text: Column) -> Column:
    """What a numeric field takes from text; unparseable is 0."""
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def fixed_text(text: Column, size: int) -> Column:
    """Padded with spaces and cut to the size of the field."""
    return F.rpad(text, size, " ")


def divide_or_keep(target: Column, by: Column) -> Column:
    """a division by zero keeps the target."""
    return F.coalesce(F.try_divide(target, by), target)


def tally(text: Column, what: str) -> Column:
    """how often a literal occurs."""
    return (F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / len(what)


def sorted_json(struct: Column) -> Column:
    """JSON whose keys are in order, so that equal objects have equal text."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.from_json(F.to_json(struct), "map<string,string>")))))

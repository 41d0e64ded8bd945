"""Byte sizes, durations and words: formatting and parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units as they are written, with what they stand for.
BINARY_UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB", "ZiB", "YiB")
POWERS = {"K": 1, "M": 2, "G": 3, "T": 4, "P": 5, "E": 6, "Z": 7, "Y": 8}
DURATION_UNITS = {"d": 86400.0, "h": 3600.0, "min": 60.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "µs": 1e-6, "ns": 1e-9}
TRUE_WORDS, FALSE_WORDS = ("true", "on", "yes"), ("false", "off", "no")
DISABLED_WORDS = ("false", "no", "off", "disable", "disabled", "none", "n/a", "na")

NUMBER = r"([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def _trimmed(x: Column, decimals: int) -> Column:
    """Fixed decimals, without the fraction where all its digits are zero."""
    shown = F.call_function("format_number", x, F.lit("0." + "0" * decimals if decimals else "0"))
    return F.regexp_replace(shown, r"\.0+$", "") if decimals else shown


def _signed(x: Column, shown: Column) -> Column:
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), shown)


def format_nbytes(nbytes: Column, decimals: int = 2) -> Column:
    """As ``1.50 KiB``: divided by 1024 while at least 1024."""
    size = F.abs(nbytes.cast("double"))
    out = None
    for k in reversed(range(len(BINARY_UNITS))):
        shown = F.concat(_trimmed(size / float(1 << (10 * k)), decimals), F.lit(f" {BINARY_UNITS[k]}"))
        if out is None:
            out = shown
        else:
            out = F.when(size < float(1 << (10 * (k + 1))), shown).otherwise(out)
    return _signed(nbytes, out)


def format_duration(seconds: Column, decimals: int = 2) -> Column:
    """As ``1.50 min``: days, hours and minutes from one on, below a second ms, us or ns; under one ns, seconds."""
    size = F.abs(seconds.cast("double"))
    steps = [("d", 86400.0), ("h", 3600.0), ("min", 60.0), ("s", 1.0), ("ms", 1e-3), ("us", 1e-6), ("ns", 1e-9)]
    out = F.concat(_trimmed(size, decimals), F.lit(" s"))
    for unit, length in reversed(steps):
        shown = size / length if length >= 1 else size * round(1 / length)
        out = F.when(size >= length, F.concat(_trimmed(shown, decimals), F.lit(f" {unit}"))).otherwise(out)
    return _signed(seconds, out)


def _half_away(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def _number(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 1).try_cast("double")


def parse_nbytes(text: Column) -> Column:
    """Bytes of ``1 KiB`` (1024) or ``1 KB`` (1000), rounded half away from zero; null where it doesn't parse or fit."""
    pattern = r"^\s*" + NUMBER + r"\s*([A-Za-z]*)\s*$"
    unit = F.upper(F.regexp_extract(text, pattern, 2))
    factor = F.when(unit.isin("", "B"), F.lit(1.0))
    for letter, power in POWERS.items():
        factor = factor.when(unit == f"{letter}B", F.lit(1000.0**power)).when(unit == f"{letter}IB", F.lit(1024.0**power))
    value = _half_away(_number(text, pattern) * factor)
    return F.when(F.abs(value) < 9.223372036854775e18, value.cast("bigint"))


def parse_nbytes_unsigned(text: Column) -> Column:
    value = parse_nbytes(text)
    return F.when(value >= 0, value)


def parse_nbytes_or_percent(text: Column, total: Column) -> Column:
    """Bytes, or ``40%`` of ``total``; the percentage is rounded to a whole number first."""
    pattern = r"^\s*" + NUMBER + r"\s*%\s*$"
    percent = _half_away(_number(text, pattern))
    share = _half_away(total.cast("double") * percent / 100.0).cast("bigint")
    return F.when(text.rlike(pattern), F.when(percent >= 0, share)).otherwise(parse_nbytes_unsigned(text))


def parse_duration(text: Column) -> Column:
    """Seconds of ``10 ms``, seconds where no unit stands; null where it doesn't parse."""
    pattern = r"^\s*" + NUMBER + r"\s*([A-Za-zµ]*)\s*$"
    unit = F.regexp_extract(text, pattern, 2)
    factor = F.when(unit == "", F.lit(1.0))
    for name, length in DURATION_UNITS.items():
        factor = factor.when(unit == name, F.lit(length))
    value = _number(text, pattern)
    return F.when(text.rlike(pattern), value * factor)


def parse_bool(text: Column) -> Column:
    """A leading whole number is true unless 0; else true, on, yes or false, off, no in any case; else null."""
    number = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1)
    word = F.lower(F.trim(text))
    return F.when(number != "", number.try_cast("bigint") != 0).when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def parse_optional(text: Column) -> Column:
    """The text, or null where it says that something is disabled."""
    return F.when(~F.lower(F.trim(text)).isin(*DISABLED_WORDS), text)


def parse_string_list(text: Column, delimiter: str = ",") -> Column:
    """Trimmed tokens, empty ones between delimiters included; none of a blank text."""
    tokens = F.transform(F.split(text, f"\\Q{delimiter}\\E", -1), lambda x: F.trim(x))
    return F.when(F.trim(text) == "", F.array().cast("array<string>")).otherwise(tokens)


def parse_optional_nbytes(text: Column) -> Column:
    """Bytes, or null where the text says that something is disabled."""
    return parse_nbytes(parse_optional(text))


def ceil_div(a: Column, b: Column) -> Column:
    """Of whole numbers of any size: what is left over is made up to a whole multiple first, and decimals divide exactly."""
    whole = (a.cast("decimal(20,0)") + F.pmod(-a.cast("decimal(20,0)"), b.cast("decimal(20,0)"))).cast("decimal(20,0)")
    return (whole / b.cast("decimal(20,0)")).cast("bigint")

"""Scalar value functions: number tests, lengths, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spellings of a decimal float that a data file may use.
DECIMAL = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
SPECIAL = r"[+-]?(?i:nan|inf|infinity)"

# White space trimmed around a line, and separating data tokens.
LINE_SPACE = (
    "\t\n\u000b\f\r \u0085        "
    "         　"
)
TOKEN_SPACE = "[ \t\n\f\r]+"

# The two automatic grid-length policies.
LENGTH_GLOBAL = "min"
LENGTH_PER_VARIABLE = "minvar"


def is_number(token: Column) -> Column:
    """True when the token is a float; Java suffixes such as ``1.5f`` are not."""
    return token.rlike(f"^(?:{DECIMAL}|{SPECIAL})$")


def to_double(token: Column) -> Column:
    """Parse a token, giving NULL when :func:`is_number` is false."""
    return (
        F.when(token.rlike(f"^{DECIMAL}$"), token.try_cast("double"))
        .when(token.rlike("^[+-]?(?i:nan)$"), F.lit(float("nan")))
        .when(token.rlike(f"^{SPECIAL}$"), token.try_cast("double"))
    )


def trim_line(line: Column) -> Column:
    return F.trim(line, F.lit(LINE_SPACE))


def header_tokens(line: Column) -> Column:
    """TAB-separated names, trimmed, empty ones dropped."""
    names = F.transform(F.split(trim_line(line), "\t"), trim_line)
    return F.filter(names, lambda t: t != "")


def has_number(line: Column) -> Column:
    """True when any TAB-separated token of the line is a number. One pattern
    over the line: this runs on every line of every file."""
    space = LINE_SPACE.replace("\t", "")
    return line.rlike(f"(?:^|\t)[{space}]*(?:{DECIMAL}|{SPECIAL})[{space}]*(?:\t|\\z)")


def data_tokens(line: Column) -> Column:
    """Tokens split on ASCII white space."""
    trimmed = trim_line(line)
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, TOKEN_SPACE)
    )


def is_finite(c: Column) -> Column:
    return ~(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))


def parse_length(text: Column) -> Column:
    """Decimal integer or ``2^k`` to BIGINT; NULL for anything else."""
    exponent = F.regexp_extract(text, r"^2\^\+?([0-9]{1,9})$", 1)
    k = F.when(exponent != "", exponent.try_cast("int"))
    power = F.when(k < 63, F.pow(F.lit(2.0), k).cast("bigint"))
    return F.coalesce(
        F.when(text.rlike(r"^\+?[0-9]+$"), text.try_cast("bigint")),
        power,
    )


def is_power_of_two(n: Column) -> Column:
    return (n > 0) & (n.bitwiseAND(n - F.lit(1)) == 0)


def format_length(n: Column) -> Column:
    """``2^k`` for powers of two, else the decimal integer."""
    k = F.length(F.bin(n)) - 1
    return F.when(is_power_of_two(n), F.concat(F.lit("2^"), k.cast("string"))).otherwise(
        n.cast("string")
    )


def is_length(text: Column) -> Column:
    return text.isin(LENGTH_GLOBAL, LENGTH_PER_VARIABLE) | parse_length(text).isNotNull()


def bad_derivative(c: Column) -> Column:
    return ~c.isin(0, 1, 2)


def bad_tuning(c: Column) -> Column:
    return c < 0

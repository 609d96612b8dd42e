"""Cell cleaning and typing as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a boolean word, a missing cell and a date shape.
BOOLEAN_TOKENS = ["true", "false", "yes", "no", "1", "0", "y", "n"]
MISSING_TOKENS = ["", "NULL"]
DATE_SHAPES = [r"^[0-9]{4}-[0-9]{2}-[0-9]{2}", r"^[0-9]{2}/[0-9]{2}/[0-9]{4}", r"^[0-9]{2}-[0-9]{2}-[0-9]{4}"]
EMAIL_SHAPE = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
NUMBER_SHAPE = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
SPECIAL_FLOATS = ["nan", "inf", "+inf", "-inf", "infinity", "+infinity", "-infinity"]


def is_blank(c: Column) -> Column:
    """Null or empty."""
    return c.isNull() | (c.cast("string") == "")


def phone_digits(c: Column) -> Column:
    """Digits only, without a leading country code 1 on eleven digits."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)


def clean_phone(c: Column) -> Column:
    """``(ddd) ddd-dddd`` for ten digits; anything else stays as it came."""
    d = phone_digits(c)
    pretty = F.concat(
        F.lit("("), F.substring(d, 1, 3), F.lit(") "), F.substring(d, 4, 3), F.lit("-"), F.substring(d, 7, 4)
    )
    return F.when(is_blank(c), F.lit("")).when(F.length(d) == 10, pretty).otherwise(c)


def is_valid_email(c: Column) -> Column:
    """Shape check; a missing address is not an invalid one."""
    return is_blank(c) | c.rlike(EMAIL_SHAPE)


def to_number(c: Column) -> Column:
    """Double where the trimmed text is a plain or exponent number, else null."""
    t = F.trim(c)
    return F.when(t.rlike(NUMBER_SHAPE), t.try_cast("double"))


def clean_amount(c: Column) -> Column:
    """Keep digits and dots only: ``USD 1,200.50`` gives 1200.5; nothing left gives null."""
    return to_number(F.regexp_replace(c, "[^0-9.]", ""))


def money_amount(c: Column) -> Column:
    """Strict variant: only ``$`` and ``,`` are dropped, other text gives null."""
    return to_number(F.regexp_replace(c.cast("string"), "[$,]", ""))


def coerce(c: Column) -> Column:
    """Cell typing: struct(kind, number, text) with kind null, integer, number or string."""
    t = F.trim(c)
    number = to_number(c)
    is_float = t.rlike("[.eE]")
    whole = t.rlike("^[+-]?[0-9]+$")
    kind = (
        F.when(is_blank(t), F.lit("null"))
        .when(is_float & number.isNotNull(), F.lit("number"))
        .when(~is_float & whole, F.lit("integer"))
        .otherwise(F.lit("string"))
    )
    return F.struct(
        kind.alias("kind"),
        F.when(kind.isin("number", "integer"), number).alias("number"),
        F.when(kind == "string", t).alias("text"),
    )


def value_kind(c: Column) -> Column:
    """boolean, integer, number, date or string; ``missing`` for null and its spellings.

    Boolean words win over integers, so a 0/1 column is boolean.
    """
    t = F.trim(c)
    date_like = F.lit(False)
    for shape in DATE_SHAPES:
        date_like = date_like | t.rlike(shape)
    return (
        F.when(c.isNull() | c.isin(MISSING_TOKENS), F.lit("missing"))
        .when(F.lower(t).isin(BOOLEAN_TOKENS), F.lit("boolean"))
        .when(c.rlike("^-?[0-9]+$"), F.lit("integer"))
        .when(t.rlike(NUMBER_SHAPE) | F.lower(t).isin(SPECIAL_FLOATS), F.lit("number"))
        .when(date_like, F.lit("date"))
        .otherwise(F.lit("string"))
    )

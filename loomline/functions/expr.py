"""Column expressions: identifiers, tokens, buckets, dates and decay. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "unknown"
_BLANK = ("", "nan", "<na>", "none")
_TRUE = ("1", "1.0", "true", "True", "YES", "yes", "Y", "y")
AGE_BUCKETS = ((17, "under_18"), (24, "18_24"), (34, "25_34"), (44, "35_44"), (54, "45_54"), (64, "55_64"))
POSTAL_BUCKETS = ((1, "singleton"), (5, "rare"), (50, "medium"))
TIERS = (("cold_start", 0, 0), ("low", 1, 2), ("medium", 3, 9), ("high", 10, None))


def strip(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), "^\\s+|\\s+$", "")


def present(c: Column) -> Column:
    """False for null and for the strings that stand for a missing value."""
    return F.coalesce(~F.lower(strip(c)).isin(*_BLANK), F.lit(False))


def item_id(c: Column) -> Column:
    """Ten digits for numbers, other text as it is; empty and longer numbers raise."""
    text = strip(c)
    number = F.regexp_replace(text, "\\.0+$", "")
    digits = number.rlike("^[0-9]+$")
    return (
        F.when(F.coalesce(text, F.lit("")) == "", F.raise_error(F.lit("empty item id")))
        .when(digits & (F.length(number) > 10), F.raise_error(F.concat(F.lit("item id too long: "), number)))
        .when(digits, F.lpad(number, 10, "0"))
        .otherwise(text)
    )


def user_id(c: Column) -> Column:
    text = strip(c)
    return F.when(F.coalesce(text, F.lit("")) == "", F.raise_error(F.lit("empty user id"))).otherwise(text)


def category(c: Column) -> Column:
    """Token of a category name: white space and slashes to single underscores, missing to unknown. Names that are their own token need no pattern."""
    name = c.cast("string")
    plain = (F.translate(name, " \t\n\x0b\f\r/\\", "") == name) & ~F.contains(name, F.lit("__")) & ~F.startswith(name, F.lit("_")) & ~F.endswith(name, F.lit("_"))
    bare = F.when(F.lower(name).isin(*_BLANK), UNKNOWN).otherwise(name)
    token = F.regexp_replace(F.regexp_replace(F.regexp_replace(strip(c), "[\\s/\\\\]+", "_"), "_+", "_"), "^_+|_+$", "")
    return F.when(plain, bare).otherwise(F.when(present(c) & (token != ""), token).otherwise(UNKNOWN))


def text(c: Column) -> Column:
    return F.when(present(c), F.regexp_replace(F.lower(strip(c)), "\\s+", " ")).otherwise("")


def combo(*columns: Column) -> Column:
    known = F.filter(F.array(*map(category, columns)), lambda x: x != UNKNOWN)
    return F.when(F.size(known) > 0, F.array_join(known, "__")).otherwise(UNKNOWN)


def numeric_id(c: Column) -> tuple[Column, Column, Column]:
    """(number, token, missing) of an identifier that may be a number."""
    ok = present(c)
    clean = F.regexp_replace(strip(c), "\\.0+$", "")
    return (
        F.when(ok, F.coalesce(clean.try_cast("double"), F.lit(0.0))).otherwise(0.0),
        F.when(ok, category(clean)).otherwise(UNKNOWN),
        F.when(ok, 0.0).otherwise(1.0),
    )


def text_parts(c: Column) -> tuple[Column, Column, Column, Column]:
    """(text, characters, words, missing)."""
    t = text(c)
    some = t != ""
    return (
        F.when(some, t).otherwise(UNKNOWN),
        F.length(t).cast("double"),
        F.when(some, F.size(F.split(t, " "))).otherwise(0).cast("double"),
        F.when(some, 0.0).otherwise(1.0),
    )


def binary_flag(c: Column) -> Column:
    return F.when(F.coalesce(strip(c).isin(*_TRUE), F.lit(False)), 1.0).otherwise(0.0)


def age_bucket(age: Column) -> Column:
    out = F.when(F.lit(False), "")
    for most, name in AGE_BUCKETS:
        out = out.when(age <= most, name)
    return out.otherwise("65_plus")


def age_parts(c: Column) -> tuple[Column, Column, Column]:
    """(age, bucket of the half-even rounded age, missing)."""
    n = strip(c).try_cast("double")
    ok = F.coalesce((n >= 0) & (n <= 120), F.lit(False))
    return F.when(ok, n).otherwise(0.0), F.when(ok, age_bucket(F.bround(n))).otherwise(UNKNOWN), F.when(ok, 0.0).otherwise(1.0)


def postal_hash(c: Column) -> Column:
    n = F.conv(F.substring(F.sha2(strip(c), 256), 1, 8), 16, 10).cast("long") % 100
    return F.format_string("h%02d", n)


def postal_frequency(n: Column) -> Column:
    out = F.when(F.lit(False), "")
    for most, name in POSTAL_BUCKETS:
        out = out.when(n <= most, name)
    return out.otherwise("common")


def price_band(price: Column, low: float = 0.05, high: float = 0.15) -> Column:
    return F.when(price.isNull(), UNKNOWN).when(price < low, "low").when(price < high, "mid").otherwise("high")


def tier(history: Column, tiers: tuple = TIERS) -> Column:
    """The first tier, in order, whose bounds hold the history's length."""
    out = F.when(F.lit(False), "")
    for name, low, high in tiers:
        fits = history >= low if low else F.lit(True)
        out = out.when(fits & (history <= high) if high is not None else fits, name)
    return out


def decay(days: Column, half_life: float) -> Column:
    if half_life <= 0:
        return F.lit(1.0)
    return F.exp(-F.log(F.lit(2.0)) * F.greatest(F.lit(0), days) / half_life)


def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(text(c), F.lit("[a-z0-9]+"), F.lit(0))


def group_id(user: Column, day: Column) -> Column:
    return F.concat_ws("@", user, F.date_format(day, "yyyy-MM-dd"))


def as_day(c: Column) -> Column:
    return c.cast("date")


def week_start(day: Column, weeks: int) -> Column:
    """First day of the ``weeks`` weeks that end on ``day``."""
    return F.date_sub(day, 7 * weeks - 1)


def label_window(day: Column, horizon: int) -> tuple[Column, Column]:
    return F.date_add(day, 1), F.date_add(day, horizon)


def tail(items: Column, n: int) -> Column:
    return F.slice(items, F.greatest(F.size(items) - (n - 1), F.lit(1)), n)

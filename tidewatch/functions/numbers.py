"""Numeric column helpers: rounding, clipping, parsing, money text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.binding import let
from tidewatch.functions.text import clean_text, non_empty, strip_brackets

# Cell texts that mean "no value".
EMPTY_MARKS = ["", "-", "--", "N.A.", "NA", "N.A", "N/A", "Nil", "NIL"]

NUMBER_IN_TEXT = r"[-+]?\d+(?:,\d+)*(?:\.\d+)?"
# What a decimal literal may look like once commas are gone.
PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def half_even(c: Column, digits: int = 0) -> Column:
    """Round half to even on the scaled binary value, as NumPy does."""
    if digits == 0:
        return F.rint(c)
    scale = F.lit(float(10**digits))
    return F.rint(c * scale) / scale


def decimal_round(c: Column, digits: int) -> Column:
    """Round the exact binary value, as Python's ``round`` and ``%.nf`` do.

    Scaling can only err by turning a near-tie into a tie. The error of the
    product is recovered by splitting the factor into halves whose products are
    exact, and decides such ties.
    """
    scale = F.lit(float(10**digits))

    def settle(x: Column, y: Column) -> Column:
        wide = x * F.lit(134217729.0)
        high = wide - (wide - x)
        error = (high * scale - y) + (x - high) * scale
        return F.when(
            F.abs(y - F.floor(y)) == 0.5,
            F.when(error > 0, F.ceil(y).cast("double")).when(error < 0, F.floor(y).cast("double")).otherwise(F.rint(y)),
        ).otherwise(F.rint(y))

    return let(c, lambda x: let(x * scale, lambda y: settle(x, y))) / scale


def clip(c: Column, low: float, high: float) -> Column:
    """Clamp, keeping NULL as NULL (least/greatest alone would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def no_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def to_number(c: Column) -> Column:
    """Lenient numeric coercion: anything unparsable becomes NULL."""
    return no_nan(F.trim(c.cast("string")).try_cast("double"))


def exact_sum(c: Column, digits: int) -> Column:
    """Sum of values that have at most ``digits`` decimals, in whole units.

    Integer addition gives the same total in any order of rows.
    """
    scale = 10.0**digits
    return F.sum(F.rint(c * scale).cast("bigint")).cast("double") / F.lit(scale)


def exact_mean(c: Column, digits: int, weight: Column | None = None) -> Column:
    """Mean over the non-NULL values, from an integer sum."""
    scale, w = 10.0**digits, F.lit(1) if weight is None else weight
    total = F.sum(F.rint(c * scale).cast("bigint") * w).cast("double")
    return total / F.sum(F.when(c.isNotNull(), w)).cast("double") / F.lit(scale)


def is_true(c: Column) -> Column:
    """A comparison whose NULL outcome counts as false."""
    return F.coalesce(c, F.lit(False))


def _parse(c: Column) -> Column:
    return let(
        F.replace(c, F.lit(","), F.lit("")),
        lambda plain: F.when(plain.rlike(PLAIN_NUMBER), plain.try_cast("double")))


def _given(s: Column, parse) -> Column:
    """``parse(s)`` unless the cell only marks a missing value."""
    return let(s, lambda x: F.when(~x.isin(EMPTY_MARKS), parse(x)))


def normalize_progress(c: Column) -> Column:
    """Percent text to 0..100; a fraction strictly between 0 and 1 is scaled up."""
    s = F.trim(strip_brackets(F.trim(F.replace(clean_text(c), F.lit("%"), F.lit("")))))
    pct = let(_given(s, _parse), lambda v: F.when((v > 0) & (v < 1), v * 100.0).otherwise(v))
    return decimal_round(let(pct, lambda p: F.when((p >= 0) & (p <= 100), p)), 2)


def normalize_money(c: Column) -> Column:
    """Money text to a number; falls back to the first number in the text."""

    def parse(s: Column) -> Column:
        bare = F.trim(F.regexp_replace(F.regexp_replace(s, r"[₹ ]", ""), r"(?i)rs\.?|crore", ""))
        return let(bare, lambda b: F.coalesce(
            _parse(b),
            non_empty(F.replace(F.regexp_extract(b, NUMBER_IN_TEXT, 0), F.lit(","), F.lit(""))).try_cast("double")))

    return decimal_round(_given(F.trim(strip_brackets(clean_text(c))), parse), 2)


def format_crore(c: Column) -> Column:
    """Money for display, stepping from Cr to Lakh Cr."""
    a = F.abs(c)
    sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))
    text = (
        F.when(a < 1000.0, F.concat(F.format_string("%.1f", decimal_round(a, 1)), F.lit(" Cr")))
        .when(a < 100000.0, F.concat(F.format_number(F.rint(a), 0), F.lit(" Cr")))
        .otherwise(F.concat(F.format_string("%.2f", decimal_round(a / 100000.0, 2)), F.lit(" Lakh Cr")))
    )
    return F.when(c.isNull() | F.isnan(c), F.lit("₹0.0 Cr")).otherwise(
        F.concat(sign, F.lit("₹"), text)
    )

"""Calendar months as text (``YYYY-MM``) and as integers (``year*12 + month``)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.binding import let
from tidewatch.functions.numbers import EMPTY_MARKS
from tidewatch.functions.text import clean_text, non_empty, strip_brackets

# Month words and numbers.
MONTH_NUMBERS = {
    "january": "01", "february": "02", "march": "03", "april": "04", "may": "05",
    "june": "06", "july": "07", "august": "08", "september": "09", "october": "10",
    "november": "11", "december": "12",
    "jan": "01", "feb": "02", "mar": "03", "apr": "04", "jun": "06", "jul": "07",
    "aug": "08", "sep": "09", "sept": "09", "oct": "10", "nov": "11", "dec": "12",
}
FULL_MONTHS = (
    "January|February|March|April|May|June|July|August|September|October|November|December"
)
ANY_MONTH = FULL_MONTHS + "|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"


def month_number(word: Column) -> Column:
    """Two-digit month of a month word, NULL when it is none."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(MONTH_NUMBERS.items())])
    return F.try_element_at(table, F.lower(word))


def month_index(c: Column) -> Column:
    """``YYYY-MM`` to ``year*12 + month``; NULL unless the month is 1..12."""
    ok = c.rlike(r"^\d{4}-(0[1-9]|1[0-2])$")
    y = F.substring(c, 1, 4).try_cast("int")
    m = F.substring(c, 6, 2).try_cast("int")
    return F.when(ok, y * 12 + m)


def month_label(idx: Column) -> Column:
    """Inverse of :func:`month_index`."""
    y = F.floor((idx - 1) / 12).cast("int")
    m = F.pmod(idx - 1, F.lit(12)) + 1
    return F.concat(
        F.lpad(y.cast("string"), 4, "0"), F.lit("-"), F.lpad(m.cast("string"), 2, "0")
    )


def add_months(c: Column, k: int) -> Column:
    return month_label(month_index(c) + k)


def months_inclusive(start: Column, end: Column) -> Column:
    return month_index(end) - month_index(start) + 1


def _ym(year: Column, month: Column) -> Column:
    """Join a four-digit year and a numeric month, NULL outside 1..12.

    No match is the empty text, which is kept from the cast: a cast that fails
    raises and catches an exception for each row.
    """
    return let(let(month, non_empty).try_cast("int"), lambda n: F.when(
        (n >= 1) & (n <= 12) & (year != ""),
        F.concat(year, F.lit("-"), F.lpad(n.cast("string"), 2, "0"))))


def normalize_month(c: Column) -> Column:
    """Any supported month spelling to ``YYYY-MM``, tried in a fixed order."""
    iso = r"^(\d{4})[-/](\d{1,2})$"
    num = r"^(\d{1,2})[-/](\d{4})$"
    word4 = r"^([A-Za-z]+)[\s,-]+(\d{4})$"
    word2 = r"^([A-Za-z]+)[\s,-]+(\d{2})$"
    inner = r"(\d{1,2})[/](\d{4})"
    inner_word = rf"(?i)({FULL_MONTHS})[\s,]+(20\d{{2}})"

    def read(s: Column) -> Column:
        part = lambda pattern, group: F.regexp_extract(s, pattern, group)
        short = let(non_empty(part(word2, 2)), lambda yy: F.concat(
            F.when(yy.cast("int") < 70, F.lit("20")).otherwise(F.lit("19")), yy))
        return F.when(~s.isin(EMPTY_MARKS), F.coalesce(
            _ym(part(iso, 1), part(iso, 2)),
            _ym(part(num, 2), part(num, 1)),
            _ym(part(word4, 2), month_number(part(word4, 1))),
            _ym(short, month_number(part(word2, 1))),
            _ym(part(inner, 2), part(inner, 1)),
            _ym(part(inner_word, 2), month_number(part(inner_word, 1))),
        ))

    return let(F.trim(strip_brackets(clean_text(c))), read)

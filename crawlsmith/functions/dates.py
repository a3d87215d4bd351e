"""Dates in free text: an ordered grammar of forms, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names by their first three letters.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_MONTH = "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\\.?"
_END = r"(?![\d])"
#: Forms in the order in which they are tried: a pattern, and which of its groups are year, month and day (0: the first of the month).
FORMS = [
    (rf"^(\d{{4}})[-/. ](\d{{1,2}})[-/. ](\d{{1,2}}){_END}", 1, 2, 3),
    (rf"(?<!\d)(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}){_END}", 3, 2, 1),
    (rf"(?<!\d)(\d{{1,2}})(?:st|nd|rd|th)?[-\s,]+{_MONTH}[-\s,]+(\d{{4}}|\d{{2}}){_END}", 3, 2, 1),
    (rf"(?<![a-z]){_MONTH}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?:\d\d:\d\d(?::\d\d)?\s+(?:[a-z]+\s+)?)?(\d{{4}}){_END}", 3, 1, 2),
    (rf"(?<!\d)(\d{{4}})[-\s]+{_MONTH}[-\s]+(\d{{1,2}}){_END}", 1, 2, 3),
    (rf"^(\d{{1,2}})[/-](\d{{1,2}})[/-](\d{{4}}|\d{{2}}){_END}", 3, 1, 2),
    (rf"(?<![a-z])(?<!\d[^a-z]){_MONTH}[-\s,]+(\d{{4}}){_END}", 2, 1, 0),
]


def parse_date(text: Column) -> Column:
    """The first date that a form finds in a text and that the calendar has; null without one.

    Two-digit years below 50 are of this century. Numbers with slashes are month first, with points day first.
    """
    low = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))

    def one(pattern: str, year: int, month: int, day: int) -> Column:
        part = lambda i: F.regexp_extract(low, pattern, i)
        y = F.when(F.length(part(year)) == 2, F.concat(F.when(part(year) < "50", "20").otherwise("19"), part(year))).otherwise(part(year))
        place = F.array_position(F.array(*map(F.lit, MONTHS)), part(month))
        m = F.when(place > 0, place.cast("string")).otherwise(part(month))
        d = part(day) if day else F.lit("1")
        return F.when(y != "", F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd"))

    return F.coalesce(*[one(*form) for form in FORMS])


def age_in_years(day: Column, as_of: str) -> Column:
    return F.datediff(F.lit(as_of).cast("date"), day) / 365.25


def age_label(years: Column) -> Column:
    """Whole years in words."""
    n = F.floor(years)
    return (
        F.when(years.isNull(), "не удалось определить")
        .when(n <= 0, "меньше 1 года")
        .when(n == 1, "1 год")
        .when(n.between(2, 4), F.concat(n.cast("string"), F.lit(" года")))
        .otherwise(F.concat(n.cast("string"), F.lit(" лет")))
    )

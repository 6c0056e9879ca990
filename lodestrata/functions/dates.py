"""Dates as people write them, as column expressions: a small grammar instead of a list of formats.

A text is cut into numbers, words and marks.  Words may be one month (a name, or three letters or more of
it), weekdays, ordinal endings and fillers; a time of day behind the date is left off.  With a month's name
two numbers are needed, else three; what can be a year only (three digits or more, or over 31) is one.  Of
the rest, with three numbers the month comes first unless that is over 12; a leading year is followed by the
month.  Anything else is no date: unknown words, missing or further parts, days that a month doesn't have.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
#: Words that may stand in a date and say nothing.
FILLERS = ("st", "nd", "rd", "th", "of", "the", "day", "on", "ad", "ce")
#: Years of two digits up to this one are of this century, others of the last.
PIVOT = 68

_TIME = r"(?:[t\s]|,\s*)\s*\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s*(?:[ap]\.?m\.?)?\s*(?:z|utc|gmt|[+-]\d{2}:?\d{2})?$"


def _within(f, value: Column) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def _month(word: Column) -> Column:
    """The month that a word names, or null."""
    out = F.lit(None).cast("int")
    for k, name in enumerate(MONTHS, 1):
        out = F.when((F.length(word) >= 3) & F.lit(name).startswith(word), k).otherwise(out)
    return F.when(word == "sept", 9).otherwise(out)


def _idle(word: Column) -> Column:
    """Whether a word is a weekday, an ordinal ending or a filler."""
    out = word.isin(*FILLERS)
    for name in WEEKDAYS:
        out = out | ((F.length(word) >= 3) & F.lit(name).startswith(word))
    return out | word.isin("tues", "thur", "thurs")


def _year(digits: Column) -> Column:
    y = digits.try_cast("int")
    return F.when(F.length(digits) > 2, y).when(y <= PIVOT, 2000 + y).otherwise(1900 + y)


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.when(year.between(1, 9999), F.format_string("%04d-%02d-%02d", year, month.try_cast("int"), day.try_cast("int"))), "yyyy-MM-dd")


def _is_year(digits: Column) -> Column:
    return (F.length(digits) > 2) | (digits.try_cast("int") > 31)


def parse_date(c: Column) -> Column:
    """The date that a text says, or null."""
    text = F.regexp_replace(F.lower(F.btrim(c)), _TIME, "")
    text = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")

    def resolved(t: Column) -> Column:
        words, n = t["words"], t["numbers"]
        months = F.filter(F.transform(words, _month), lambda m: m.isNotNull())
        known = F.forall(words, lambda w: _month(w).isNotNull() | _idle(w)) & t["clean"]
        a, b, third = (F.get(n, k) for k in range(3))
        named = F.get(months, 0)
        with_name = F.when(_is_year(a) & ~_is_year(b), _date(_year(a), named, b)).when(~_is_year(a), _date(_year(b), named, a))
        low = lambda x: x.try_cast("int") <= 12
        year_first = F.when(low(b), _date(_year(a), b, third)).when(low(third), _date(_year(a), third, b))
        year_last = F.when(low(a), _date(_year(third), a, b)).otherwise(_date(_year(third), b, a))
        numeric = F.when(_is_year(a), F.when(~_is_year(b) & ~_is_year(third), year_first)).when(~_is_year(b), year_last)
        return F.when(known & (F.size(months) == 1) & (F.size(n) == 2), with_name).when(known & (F.size(months) == 0) & (F.size(n) == 3), numeric)

    parts = F.struct(
        F.regexp_extract_all(text, F.lit(r"([a-z]+)"), 1).alias("words"),
        F.regexp_extract_all(text, F.lit(r"(\d+)"), 1).alias("numbers"),
        (text.rlike(r"^[a-z0-9\s,./'’-]*$") & ~text.rlike(r"\d{5,}|^-|\d\.\d+$") | text.rlike(r"^\d{1,2}\.\d{1,2}\.\d{2,4}$|^\d{4}\.\d{1,2}\.\d{1,2}$")).alias("clean"),
    )
    return _within(resolved, parts)

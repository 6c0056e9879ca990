"""Whether an extracted value is the same answer as a label, by field."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import parse_date
from .text import company, leading_integer, name_tokens, number

TOLERANCE = 0.001


def nullish(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def match_company(a: Column, b: Column) -> Column:
    return company(a) == company(b)


def match_ticker(a: Column, b: Column) -> Column:
    return F.lower(F.trim(a)) == F.lower(F.trim(b))


def match_date(a: Column, b: Column) -> Column:
    return F.coalesce(parse_date(a) == parse_date(b), F.lit(False))


def match_employees(a: Column, b: Column) -> Column:
    return F.coalesce(leading_integer(a) == leading_integer(b), F.lit(False))


def close(x: Column, y: Column) -> Column:
    """Equal where either is zero, else within the relative tolerance."""
    return F.when((x == 0) | (y == 0), x == y).otherwise(F.abs(x - y) <= TOLERANCE * F.greatest(F.abs(x), F.abs(y)))


def match_number(a: Column, b: Column) -> Column:
    return F.coalesce(close(number(a), number(b)), F.lit(False))


def match_person(a: Column, b: Column) -> Column:
    x, y = name_tokens(a), name_tokens(b)
    given = lambda t: F.transform(F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))), lambda w: F.substring(w, 1, 1))
    shared = (F.size(x) == 1) | (F.size(y) == 1) | F.arrays_overlap(given(x), given(y))
    return (F.size(x) > 0) & (F.size(y) > 0) & (F.try_element_at(x, F.lit(-1)) == F.try_element_at(y, F.lit(-1))) & shared


RULES = {
    "company_name": match_company,
    "ticker": match_ticker,
    "fiscal_year_end": match_date,
    "employees": match_employees,
    "total_assets": match_number,
    "revenue_most_recent_fy": match_number,
    "ceo_name": match_person,
    "dividends_declared_per_share": match_number,
    "goodwill_impairment": match_number,
}


def matches(field: Column, label: Column, prediction: Column) -> Column:
    """Empty matches empty only; an unknown field is refused inside the plan."""
    rule = F.raise_error(F.concat(F.lit("unknown field "), field)).cast("boolean")
    for name, f in RULES.items():
        rule = F.when(field == name, f(label, prediction)).otherwise(rule)
    return F.when(nullish(label) | nullish(prediction), nullish(label) & nullish(prediction)).otherwise(rule)

"""Years and months as they are written on timelines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Short names of months.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def _month(month: Column) -> Column:
    """A month from 1 to 12, else null."""
    return F.when(month.between(1, 12), month)


def month_year(year: Column, month: Column) -> Column:
    """``Mar 2019``, or the year alone without a month."""
    name = F.when(month.between(1, 12), F.get(F.array(*map(F.lit, MONTHS)), month.cast("int") - 1))
    return F.concat_ws(" ", name, year.cast("string"))


def _counted(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, F.lit(f"1 {one}")).otherwise(F.concat(n.cast("string"), F.lit(f" {many}")))


def duration(months: Column, exact: Column) -> Column:
    """``2 yrs 3 mos`` where months are known, else whole years."""
    months = F.greatest(F.lit(0), months)
    years, rest = F.floor(months / 12).cast("int"), (months % 12).cast("int")
    whole = F.when(years <= 0, "<1 yr").otherwise(_counted(years, "yr", "yrs"))
    both = F.concat_ws(" ", F.when(years > 0, _counted(years, "yr", "yrs")), F.when(rest > 0, _counted(rest, "mo", "mos")))
    return F.when(~exact, whole).when((years <= 0) & (rest == 0), "<1 mo").otherwise(both)


def date_range(start_year: Column, start_month: Column, end_year: Column, end_month: Column, current: Column, now_year: Column, now_month: Column, year_only: bool = False) -> Column:
    """``Mar 2019 – Present · 2 yrs 3 mos``, ``2015 – 2018 · 4 yrs``, ``2015 – ? · ongoing``, or ``Date unknown``.

    Without a month a start counts from January and an end to December; months are told only if both sides have one.
    """
    if year_only:
        start_month = end_month = F.lit(None).cast("int")
    current = F.coalesce(current, F.lit(False))
    told = lambda m: F.coalesce(m, F.lit(0)) != 0
    exact = F.lit(False) if year_only else told(start_month) & (current | (end_year.isNotNull() & told(end_month)))
    months = lambda y, m: (y - start_year) * 12 + F.coalesce(_month(m), F.lit(12)) - F.coalesce(_month(start_month), F.lit(1)) + 1
    begin = month_year(start_year, start_month)
    return (
        F.when(start_year.isNull(), "Date unknown")
        .when(current, F.concat(begin, F.lit(" – Present · "), duration(months(now_year, now_month), exact)))
        .when(end_year.isNull(), F.concat(begin, F.lit(" – ? · ongoing")))
        .otherwise(F.concat(begin, F.lit(" – "), month_year(end_year, end_month), F.lit(" · "), duration(months(end_year, end_month), exact)))
    )


def role_years(text: Column, first: int = 1900, last: int = 2100) -> Column:
    """Struct (start, end) of the first two four-digit numbers of a text: nothing if the first is no year, no end if the second isn't one or comes before it."""
    found = F.regexp_extract_all(text, F.lit(r"\b(\d{4})\b"), F.lit(1))
    start, end = F.get(found, F.lit(0)).cast("int"), F.get(found, F.lit(1)).cast("int")
    ok = start.between(first, last)
    return F.struct(F.when(ok, start).alias("start"), F.when(ok & end.between(first, last) & (end >= start), end).alias("end"))

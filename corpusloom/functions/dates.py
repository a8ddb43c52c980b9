"""Date functions of columns."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

ORIGIN = date(1970, 1, 1)
#: Names of months; three letters are enough, and "sept" stands beside "sep".
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def days_since(day: Column, origin: date = ORIGIN) -> Column:
    return F.datediff(F.to_date(day), F.lit(origin))


def year_of_day(day: Column, origin: date = ORIGIN) -> Column:
    return F.year(F.date_add(F.lit(origin), day))


def day_before_year(year: int, origin: date = ORIGIN) -> int:
    """First day that is no longer in ``year``: the cutoff that keeps all of it."""
    return (date(year + 1, 1, 1) - origin).days


def day_of_year_end(year: int, origin: date = ORIGIN) -> int:
    """Day number of December 31: the cutoff of feature snapshots, which leaves that day out."""
    return (date(year, 12, 31) - origin).days


def day_of_month_cutoff(until_year: int, until_month: int | None = None, origin: date = ORIGIN) -> int:
    """Cutoff of averaged vectors; with a month it falls in the year after, as the parameters have always been read."""
    if until_month is None:
        return (date(until_year + 1, 1, 1) - origin).days
    return (date(until_year + 1, until_month + 1, 1) - origin).days


def month_number(text: Column) -> Column:
    """1 to 12 from a number or a name; 1 for anything else."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\.+$", "")
    names = F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS, 1) for name in {m, m[:3]} | ({"sept"} if i == 9 else set()) for x in (name, i)))
    number = F.coalesce(clean.try_cast("int"), F.try_element_at(names, clean), F.lit(1))
    return F.when(number.between(1, 12), number).otherwise(1)


def partial_date(year: Column, month: Column, day: Column, free_text: Column) -> Column:
    """ISO date from parts that may be missing; the year also from the first token of ``free_text`` that begins with one. Null without a year."""
    token = F.get(F.filter(F.transform(F.split(F.coalesce(free_text, F.lit("")), r"\s+", -1), lambda t: F.substring(t, 1, 4)), lambda t: t.try_cast("int").isNotNull()), 0)
    number = F.coalesce(year.try_cast("int"), token.try_cast("int"))
    in_month = day.try_cast("int")
    in_month = F.when(in_month.between(1, 31), in_month).otherwise(1)
    return F.when(number.isNotNull(), F.format_string("%04d-%02d-%02d", number, month_number(month), in_month))


def any_date(text: Column) -> Column:
    """A date from full, year-month, year-only or day-first text; null for impossible ones."""
    full = F.try_to_date(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    month = F.try_to_date(F.concat(F.nullif(F.regexp_extract(text, r"^(\d{4}-\d{2})$", 1), F.lit("")), F.lit("-01")), "yyyy-MM-dd")
    year = F.try_to_date(F.concat(F.nullif(F.regexp_extract(text, r"^(\d{4})$", 1), F.lit("")), F.lit("-01-01")), "yyyy-MM-dd")
    parts = [F.regexp_extract(text, r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})$", i) for i in (3, 2, 1)]
    first = F.try_to_date(F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0")), "yyyy-MM-dd")
    return F.coalesce(full, month, year, first)


def five_year_period(year: Column) -> Column:
    start = F.floor(year / 5) * 5
    return F.concat(start.cast("string"), F.lit("-"), (start + 4).cast("string"))


def date_bounds(start_year: int, end_year: int, today: date | None = None) -> tuple[date, date]:
    """First and last day of the years, the last not after ``today``."""
    today = today or date.today()
    if start_year > end_year:
        raise ValueError("the first year is after the last")
    start, end = date(start_year, 1, 1), min(date(end_year, 12, 31), today)
    if start > end:
        raise ValueError("no day of these years has passed yet")
    return start, end


def middle_day(start: date, end: date) -> date:
    return start + timedelta(days=(end - start).days // 2)

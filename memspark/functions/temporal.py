"""Column functions for closed time intervals and for dates in words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memspark.functions import vocab as V

_MONTHS = "january february march april may june july august september october november december".split()
_MONTH = "january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec"


def midpoint(earliest: Column, latest: Column) -> Column:
    return F.timestamp_micros(F.expr("0").cast("bigint") + F.unix_micros(earliest) + F.floor((F.unix_micros(latest) - F.unix_micros(earliest)) / 2).cast("bigint"))


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a0 <= b1) & (a1 >= b0)


def is_before(a0: Column, a1: Column, ac: Column, b0: Column, b1: Column, bc: Column) -> Column:
    """Whether interval a lies before b; null where either is too uncertain or they overlap."""
    sure = (ac >= V.COMPARE_CONFIDENCE) & (bc >= V.COMPARE_CONFIDENCE)
    return F.when(sure & ~overlaps(a0, a1, b0, b1), a1 < b0)


def _month(word: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m[:3]) for m in _MONTHS]), F.substring(F.lower(word), 1, 3)).cast("int")


def parse(raw: Column, anchor: Column) -> Column:
    """Struct (earliest, latest, confidence, granularity) of a date in words relative to ``anchor``, or null.

    Specific forms come before general ones: an ISO date; month and year; early, mid or late of a year; a year; a
    month alone (the last one that began by the anchor); yesterday, today, last week, month or year; N days, weeks,
    months or years ago; recently; a while ago."""
    t = F.lower(F.trim(raw))
    day = F.to_date(anchor)
    at = lambda d: d.cast("timestamp")
    shift = lambda n: anchor - F.make_dt_interval(days=n)
    iso = F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})", 1)
    m_word, m_year = F.regexp_extract(t, rf"^(?:in\s+)?({_MONTH})\.?,?\s+(\d{{4}})\b", 1), F.regexp_extract(t, rf"^(?:in\s+)?({_MONTH})\.?,?\s+(\d{{4}})\b", 2)
    part, p_year = F.regexp_extract(t, r"\b(early|mid|late)[\s-]+(\d{4})\b", 1), F.regexp_extract(t, r"\b(early|mid|late)[\s-]+(\d{4})\b", 2)
    year = F.regexp_extract(t, r"\b((?:19|20)\d{2})\b", 1)
    m_only = F.regexp_extract(t, rf"\b({_MONTH})\b", 1)
    n, unit = F.regexp_extract(t, r"\b(\d{1,4})\s+(day|week|month|year)s?\s+ago\b", 1), F.regexp_extract(t, r"\b(\d{1,4})\s+(day|week|month|year)s?\s+ago\b", 2)
    k = F.when(n != "", n.cast("int")).otherwise(0)
    first = lambda y, m: F.make_date(F.when(y != "", y.cast("int")).otherwise(2000), F.coalesce(m, F.lit(1)), F.lit(1))
    bound = lambda a, b, c, g: F.struct(a.alias("earliest"), b.alias("latest"), F.lit(c).alias("confidence"), F.lit(g).alias("granularity"))
    month_of = first(m_year, _month(m_word))
    year_of = first(year, F.lit(1))
    lone_m = _month(m_only)
    lone = F.make_date(F.year(day) - F.when(lone_m > F.month(day), 1).otherwise(0), F.coalesce(lone_m, F.lit(1)), F.lit(1))
    seg_from = first(p_year, F.when(part == "early", 1).when(part == "mid", 4).otherwise(9))
    seg_to = F.last_day(first(p_year, F.when(part == "early", 4).when(part == "mid", 9).otherwise(12)))
    last_month = F.add_months(F.trunc(day, "month"), -1)
    last_year = F.add_months(F.trunc(day, "year"), -12)
    ago_month = F.add_months(F.trunc(day, "month"), -k)
    ago_year = F.add_months(F.trunc(day, "year"), -12 * k)
    weekday = F.weekday(day)
    return (
        F.when(iso != "", bound(F.try_to_timestamp(iso), F.try_to_timestamp(iso), 1.0, "exact"))
        .when(m_year != "", bound(at(month_of), at(F.last_day(month_of)), 0.70, "month"))
        .when(p_year != "", bound(at(seg_from), at(seg_to), 0.55, "year"))
        .when(year != "", bound(at(year_of), at(F.last_day(F.add_months(year_of, 11))), 0.55, "year"))
        .when(m_only != "", bound(at(lone), at(F.last_day(lone)), 0.50, "month"))
        .when(t.rlike(r"\byesterday\b"), bound(shift(F.lit(1)), shift(F.lit(1)), 0.95, "day"))
        .when(t.rlike(r"\btoday\b"), bound(anchor, anchor, 0.95, "day"))
        .when(t.rlike(r"\blast week\b"), bound(shift(weekday + 7), shift(weekday + 1), 0.75, "week"))
        .when(t.rlike(r"\blast month\b"), bound(at(last_month), at(F.last_day(last_month)), 0.75, "month"))
        .when(t.rlike(r"\blast year\b"), bound(at(last_year), at(F.last_day(F.add_months(last_year, 11))), 0.65, "year"))
        .when(unit == "day", bound(shift(k), shift(k), 0.85, "day"))
        .when(unit == "week", bound(shift(k * 7 + 6), shift(k * 7), 0.75, "week"))
        .when(unit == "month", bound(at(ago_month), at(F.last_day(ago_month)), 0.70, "month"))
        .when(unit == "year", bound(at(ago_year), at(F.last_day(F.add_months(ago_year, 11))), 0.65, "year"))
        .when(t.rlike(r"\brecently\b"), bound(shift(F.lit(30)), anchor, 0.40, "month"))
        .when(t.rlike(r"\ba while ago\b"), bound(shift(F.lit(365)), shift(F.lit(30)), 0.25, "year"))
    )

"""Time strings ``yyyyMMdd HH:mm:ss``: normalisers per catalog, closed ranges, overlap scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An open start and an open end.
OPEN_BEGIN, OPEN_END = "00010101 00:00:00", "99991231 00:00:00"
DAY, NIGHT = " 00:00:00", " 23:59:59"


def _instant(s: Column) -> Column:
    stamp = F.when(s.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.]+(Z|[+-][0-9]{2}:?[0-9]{2})$"), F.try_to_timestamp(s))
    return F.date_format(stamp, "yyyyMMdd HH:mm:ss")


def _month_end(year: Column, month: Column) -> Column:
    return F.date_format(F.last_day(F.make_date(year, month, F.lit(1))), "yyyyMMdd")


def ckan(raw: Column, begin: bool) -> Column:
    """Null, blank, negative and unreadable values are open; years and months widen to their end."""
    s, end = F.trim(raw), F.lit(OPEN_BEGIN if begin else OPEN_END)
    y, m = F.substring(s, 1, 4), F.substring(s, 6, 2)
    return (
        F.when(s.isNull() | (s == ""), end).when(s.startswith("9999"), F.lit(OPEN_END)).when(s.rlike("^-[0-9]"), end)
        .when(s.rlike("^[0-9]{4}$"), F.concat(s, F.lit(("0101" if begin else "1231") + DAY)))
        .when(
            s.rlike("^[0-9]{4}[-/](0[1-9]|1[0-2])$"),
            F.concat(F.concat(y, m, F.lit("01")) if begin else _month_end(y.cast("int"), m.cast("int")), F.lit(DAY)),
        )
        .when(s.rlike("^[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}$"), F.concat(F.regexp_replace(s, "[-/]", ""), F.lit(DAY)))
        .otherwise(F.coalesce(_instant(s), end))
    )


def stac(raw: Column, begin: bool) -> Column:
    """As ``ckan``, but months are ``yyyyMM`` with the month clamped, and ``yyyyMMdd`` is known."""
    s, end = F.trim(raw), F.lit(OPEN_BEGIN if begin else OPEN_END)
    y = F.substring(s, 1, 4)
    m = F.least(F.lit(12), F.greatest(F.lit(1), F.substring(s, 5, 2).cast("int")))
    month = F.concat(y, F.lpad(m.cast("string"), 2, "0"), F.lit("01")) if begin else _month_end(y.cast("int"), m)
    return (
        F.when(s.isNull() | (s == ""), end).when(s.startswith("9999"), F.lit(OPEN_END)).when(s.rlike("^-[0-9]"), end)
        .when(s.rlike("^[0-9]{4}$"), F.concat(s, F.lit(("0101" if begin else "1231") + DAY)))
        .when(s.rlike("^[0-9]{6}$"), F.concat(month, F.lit(DAY))).when(s.rlike("^[0-9]{8}$"), F.concat(s, F.lit(DAY)))
        .when(s.rlike("^[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}$"), F.concat(F.regexp_replace(s, "[-/]", ""), F.lit(DAY)))
        .otherwise(F.coalesce(_instant(s), end))
    )


def fgdc(raw: Column, begin: bool) -> Column:
    """First token only; end days last to 23:59:59; unreadable values are null."""
    whole = F.trim(raw)
    s, tail = F.split(whole, "\\s+")[0], DAY if begin else NIGHT
    day = F.when(s.rlike("^[0-9]{8}$"), F.try_to_date(s, "yyyyMMdd")).when(
        s.rlike("^[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}$"), F.try_to_date(F.regexp_replace(s, "/", "-"), "yyyy-MM-dd")
    )
    loose = F.when(
        whole.rlike("^[0-9]{4}[-/][0-9]{2}[-/][0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$"),
        F.try_to_timestamp(F.regexp_replace(whole, "/", "-"), F.lit("yyyy-MM-dd HH:mm:ss")),
    )
    return F.coalesce(
        _instant(whole), F.when(s.rlike("^[0-9]{4}$"), F.concat(s, F.lit(("0101" if begin else "1231") + tail))),
        F.concat(F.date_format(day, "yyyyMMdd"), F.lit(tail)), F.date_format(loose, "yyyyMMdd HH:mm:ss"),
    )


def fgdc_range(calendar: Column, begin: Column, end: Column, published: Column) -> tuple[Column, Column]:
    """First and last calendar date, else begin and end, else publication; a missing end is the begin."""
    b = F.coalesce(F.try_element_at(calendar, F.lit(1)), begin, published)
    return b, F.coalesce(F.try_element_at(calendar, F.lit(-1)), end, b)


def closed_range(text: Column) -> Column:
    """``2018-2020``, ``2018-01-01 to 2020-12-31``, ``20180101``, ``2020`` -> struct(start, end), else null."""
    s = F.trim(F.regexp_replace(text, "(?i)^\\s*time\\s*=", ""))
    one = "([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{8}|[0-9]{4})"
    pattern = f"(?i)^{one}\\s*(?:to|~|—|-)\\s*{one}$"
    a, b = F.regexp_extract(s, pattern, 1), F.regexp_extract(s, pattern, 2)

    def day(x: Column) -> Column:
        return F.when(F.length(x) != 4, F.date_format(F.try_to_date(F.regexp_replace(x, "[-/]", ""), "yyyyMMdd"), "yyyyMMdd"))

    year = lambda x: F.when(x.rlike("^[0-9]{4}$"), x)
    span = lambda lo, hi: F.struct(F.concat(lo, F.lit(DAY)).alias("start"), F.concat(hi, F.lit(NIGHT)).alias("end"))
    years = span(F.concat(F.least(a, b), F.lit("0101")), F.concat(F.greatest(a, b), F.lit("1231")))
    return (
        F.when(year(a).isNotNull() & year(b).isNotNull(), years)
        .when(day(a).isNotNull() & day(b).isNotNull(), span(F.least(day(a), day(b)), F.greatest(day(a), day(b))))
        .when(year(s).isNotNull(), span(F.concat(s, F.lit("0101")), F.concat(s, F.lit("1231"))))
        .when(day(s).isNotNull(), span(day(s), day(s)))
    )


def overlaps(begin: Column, end: Column, start: str, stop: str) -> Column:
    """Closed intervals, compared as strings."""
    return (begin <= stop) & (end >= start)


def minutes(c: Column) -> Column:
    """Minutes since 1970 of a time string, in UTC; seconds are dropped, as the score does."""
    day = F.datediff(F.try_to_date(F.substring(c, 1, 8), "yyyyMMdd"), F.lit("1970-01-01").cast("date")).cast("long")
    return day * 1440 + F.substring(c, 10, 2).cast("long") * 60 + F.substring(c, 13, 2).cast("long")


def time_f1(begin: Column, end: Column, start: str, stop: str) -> Column:
    """Harmonic mean of the shares of the dataset's and of the query's time that overlap."""
    b, e, s, t = minutes(begin), minutes(end), minutes(F.lit(start)), minutes(F.lit(stop))
    common = F.least(e, t) - F.greatest(b, s)
    total = (e - b) + F.greatest(F.lit(1), t - s)
    return F.coalesce(F.when((common > 0) & (e > b), F.least(F.lit(1.0), 2.0 * common / total)), F.lit(0.0))

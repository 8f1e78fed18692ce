"""Date expressions over ISO strings and timestamps."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperlode.functions.basic import blank_to_null, strip


def year_of(c: Column) -> Column:
    """First four characters as a year, null if they are no number."""
    s = strip(c.cast("string"))
    return F.when(F.length(s) >= 4, F.substring(s, 1, 4).try_cast("int"))


def utc(c: Column) -> Column:
    """ISO time with zone as a timestamp; null if it cannot be read."""
    return F.try_to_timestamp(c)


def in_utc(ts: Column) -> Column:
    """Wall clock of an instant in UTC, whatever the time zone of the session."""
    return F.to_utc_timestamp(ts, F.current_timezone())


def feed_time(ts: Column) -> Column:
    return F.date_format(in_utc(ts), "yyyyMMddHHmm")


def iso_seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")


def day_heading(ts: Column) -> Column:
    return F.date_format(ts, "EEE, d MMM yyyy")


def two_digit_year(year: Column) -> Column:
    text = year.cast("string")
    return F.right(text, F.lit(2))


def submitted_on(text: Column) -> Column:
    """Date of a "Submitted on 4 Sep 2025" line as written, or N/A."""
    found = F.regexp_extract(text, r"Submitted on (\d+ \w+ \d+)", 1)
    return F.when(found != "", found).otherwise("N/A")


def submitted_date(text: Column) -> Column:
    return F.to_date(F.try_to_timestamp(submitted_on(text), F.lit("d MMM yyyy")))


def ledger_day(target_day: str | None = None, look_back_days: int | None = None) -> Column:
    """Day of the run, marked with the look-back span if one is set."""
    base = F.lit(target_day) if target_day else F.current_date().cast("string")
    return F.concat(base, F.lit(f"（{look_back_days}）")) if look_back_days else base


def paper_day(updated: Column, published: Column, fallback: Column, look_back_days: int | None = None) -> Column:
    """Day of the paper itself: updated, else published, else the ledger day."""
    first = F.coalesce(F.when(updated != "", updated), published)
    base = F.coalesce(blank_to_null(F.substring(first, 1, 10)), fallback)
    return F.concat(base, F.lit(f"（{look_back_days}）")) if look_back_days else base

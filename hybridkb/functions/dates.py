"""Dates of free text and of chat exports. The reference day is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def normalise_date(raw: Column, today: Column) -> Column:
    """ISO text: ISO passes through unchecked; D/M/YYYY and D/M are day-first; today, yesterday and weekday
    names (the latest past one) are resolved; anything else is the reference day."""
    t = F.trim(raw)
    low = F.lower(t)
    iso = F.date_format(today, "yyyy-MM-dd")
    out = F.when(raw.isNull(), iso).when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t)
    day = lambda text: F.coalesce(F.date_format(F.try_to_timestamp(text, F.lit("d/M/yyyy")).cast("date"), "yyyy-MM-dd"), iso)
    out = out.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), day(t))
    out = out.when(t.rlike(r"^\d{1,2}/\d{1,2}$"), day(F.concat(t, F.lit("/"), F.year(today).cast("string"))))
    out = out.when(F.contains(low, F.lit("today")), iso).when(F.contains(low, F.lit("yesterday")), F.date_format(F.date_sub(today, 1), "yyyy-MM-dd"))
    for n, name in enumerate(WEEKDAYS):
        back = F.pmod(F.weekday(today) - n, F.lit(7))
        out = out.when(F.contains(low, F.lit(name)), F.date_format(F.date_sub(today, F.when(back == 0, 7).otherwise(back)), "yyyy-MM-dd"))
    return out.otherwise(iso)


def chat_timestamp(day: Column, time: Column) -> Column:
    """Separators / . -, two- or four-digit years, 24-hour or AM/PM times; day-first wins, none gives NULL."""
    d = F.regexp_replace(F.trim(day), r"[.\-]", "/")
    t = F.upper(F.regexp_replace(F.trim(time), r"\s+(?=[APap][Mm]$)", " "))
    year = F.when(F.length(F.element_at(F.split(d, "/"), -1)) == 2, "yy").otherwise("yyyy")
    both = F.concat(d, F.lit(" "), t)
    out = []
    for clock in ("h:mm:ss a", "h:mm a", "H:mm:ss", "H:mm"):
        for order in ("d/M/", "M/d/"):
            fits = t.rlike("[AP]M$") if clock.endswith("a") else ~t.rlike("[AP]M$")
            for y in ("yy", "yyyy"):
                out.append(F.when(fits & (year == y), F.try_to_timestamp(both, F.lit(f"{order}{y} {clock}"))))
    return F.coalesce(*out)


def date_format_label(day: Column, time: Column) -> Column:
    """A label of separator, day order, year width and clock."""
    sep = F.when(F.contains(day, F.lit(".")), ".").when(F.contains(day, F.lit("-")), "-").otherwise("/")
    parts = F.split(F.trim(day), r"[/.\-]")
    month_first = (parts[0].try_cast("int") <= 12) & (parts[1].try_cast("int") > 12)
    order = F.when(month_first, F.concat(F.lit("MM"), sep, F.lit("DD"))).otherwise(F.concat(F.lit("DD"), sep, F.lit("MM")))
    year = F.when(F.length(parts[2]) == 2, "YY").otherwise("YYYY")
    seconds = time.rlike(r":\d{2}:\d{2}")
    half = F.concat(F.lit("h:MM"), F.when(seconds, "SS ").otherwise(" "), F.lit("AM/PM"))
    whole = F.concat(F.lit("HH:MM"), F.when(seconds, "SS").otherwise(""), F.lit(" (24h)"))
    return F.concat(order, sep, year, F.lit(" "), F.when(time.rlike("[APap][Mm]"), half).otherwise(whole))

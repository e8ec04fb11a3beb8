"""Dates, times and durations. A duration is a number of nanoseconds."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Nanoseconds in a unit.
UNITS = {"ns": 1, "us": 1_000, "µs": 1_000, "ms": 1_000_000, "sec": 1_000_000_000, "min": 60_000_000_000, "hr": 3_600_000_000_000, "day": 86_400_000_000_000, "wk": 604_800_000_000_000}

#: Format letters and the session's date patterns.
STRFTIME = {
    "Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "j": "DDD", "b": "MMM", "B": "MMMM",
    "a": "EEE", "A": "EEEE", "p": "a", "I": "hh", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy", "R": "HH:mm", "z": "xx",
    "Z": "VV", "f": "SSSSSS", "e": "d", "h": "MMM", "k": "H", "l": "h",
}


def pattern(fmt: str) -> str:
    """A strftime format as a date pattern."""
    out, k, plain = [], 0, ""
    while k < len(fmt):
        if fmt[k] == "%" and k + 1 < len(fmt):
            if plain:
                out.append("'" + plain.replace("'", "''") + "'" if re.search("[A-Za-z']", plain) else plain)
                plain = ""
            if fmt[k + 1] == "%":
                out.append("'%'")
            elif fmt[k + 1] in STRFTIME:
                out.append(STRFTIME[fmt[k + 1]])
            else:
                raise ValueError(f"format %{fmt[k + 1]} is not supported")
            k += 2
        else:
            plain += fmt[k]
            k += 1
    if plain:
        out.append("'" + plain.replace("'", "''") + "'" if re.search("[A-Za-z']", plain) else plain)
    return "".join(out)


def strftime(c: Column, fmt: str) -> Column:
    return F.date_format(c, pattern(fmt))


def into_datetime(c: Column, fmt: str | None = None) -> Column:
    """Text to a timestamp; null where it does not fit."""
    return F.try_to_timestamp(c, F.lit(pattern(fmt))) if fmt else F.try_to_timestamp(c)


def from_epoch_nanos(c: Column) -> Column:
    """Nanoseconds since 1970 to a timestamp (microseconds)."""
    return F.timestamp_micros(F.call_function("div", c, F.lit(1000).cast("long")))


def epoch_nanos(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) * 1000


def date_record(c: Column) -> Column:
    """Parts of a timestamp."""
    return F.struct(F.year(c).alias("year"), F.month(c).alias("month"), F.day(c).alias("day"), F.hour(c).alias("hour"), F.minute(c).alias("minute"), F.second(c).alias("second"))


#: Name -> part of a date.
PARTS = {
    "year": F.year, "quarter": F.quarter, "month": F.month, "week": F.weekofyear, "weekday": lambda c: F.weekday(c) + 1, "day": F.day, "ordinal": F.dayofyear,
    "hour": F.hour, "minute": F.minute, "second": F.second, "millisecond": lambda c: (F.unix_micros(c.cast("timestamp")) / 1000 % 1000).cast("int"), "microsecond": lambda c: (F.unix_micros(c.cast("timestamp")) % 1_000_000).cast("int"), "nanosecond": lambda c: ((F.unix_micros(c.cast("timestamp")) % 1_000_000) * 1000).cast("int"),
}


def part(c: Column, name: str) -> Column:
    return PARTS[name](c)


def truncate(c: Column, every: str) -> Column:
    """Round down to a multiple of a span such as `1d`, `15m`, `2h`, `1w`, `1mo`, `1q`, `1y`."""
    n, unit = re.fullmatch(r"(\d+)\s*([a-z]+)", every).groups()
    n = int(n)
    single = {"y": "year", "q": "quarter", "mo": "month", "w": "week", "d": "day", "h": "hour", "m": "minute", "s": "second"}
    if n == 1:
        return F.date_trunc(single[unit], c)
    if unit in ("y", "q", "mo"):
        months = n * {"y": 12, "q": 3, "mo": 1}[unit]
        at = F.year(c) * 12 + F.month(c) - 1
        start = at - at % months
        return F.make_timestamp(F.floor(start / 12).cast("int"), (start % 12 + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    span = n * {"w": 604_800, "d": 86_400, "h": 3_600, "m": 60, "s": 1}[unit] * 1_000_000
    shift = 4 * 86_400_000_000 if unit == "w" else 0  # weeks start on Monday
    micros = F.unix_micros(c.cast("timestamp")) - shift
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(span)) + shift)


def into_duration(c: Column) -> Column:
    """Text such as `1hr 20min 3sec` to nanoseconds; null if any part is not understood."""
    names = "|".join(sorted(UNITS, key=len, reverse=True))
    whole = c.rlike(f"^\\s*(-?\\d+(\\.\\d+)?\\s*({names})\\s*)+$")
    numbers = F.regexp_extract_all(c, F.lit(f"(-?\\d+(?:\\.\\d+)?)\\s*(?:{names})"), F.lit(1))
    units = F.regexp_extract_all(c, F.lit(f"-?\\d+(?:\\.\\d+)?\\s*({names})"), F.lit(1))
    table = F.create_map(*(F.lit(x) for pair in UNITS.items() for x in (pair[0], float(pair[1]))))
    total = F.aggregate(F.zip_with(numbers, units, lambda a, u: a.cast("double") * F.element_at(table, u)), F.lit(0.0), lambda s, x: s + x)
    return F.when(whole, F.round(total).cast("long"))


def format_duration(c: Column, unit: str) -> Column:
    """Nanoseconds as a number with a unit."""
    return F.concat((c / F.lit(UNITS[unit])).cast("string"), F.lit(f" {unit}"))


def duration_parts(c: Column) -> Column:
    """Nanoseconds as weeks, days, hours, minutes, seconds and so on, without zero parts."""
    left, parts = F.abs(c), []
    for unit in ("wk", "day", "hr", "min", "sec", "ms", "µs", "ns"):
        n = F.call_function("div", left, F.lit(UNITS[unit]).cast("long"))
        parts.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))))
        left = left - n * UNITS[unit]
    text = F.concat_ws(" ", *parts)
    return F.when(c == 0, "0sec").otherwise(F.concat(F.when(c < 0, "-").otherwise(""), text))


def difference(later: Column, earlier: Column) -> Column:
    """Nanoseconds between two timestamps."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) * 1000


def to_timezone(c: Column, zone: str) -> Column:
    """Wall-clock time in a zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), c.cast("timestamp_ntz"))


def replace_timezone(c: Column, zone: str) -> Column:
    """The instant at which a zone's clocks show this wall-clock time."""
    return F.to_utc_timestamp(c, zone)


def humanize(c: Column, now: Column) -> Column:
    """How long ago or ahead, in the largest whole unit."""
    seconds = F.unix_seconds(c) - F.unix_seconds(now)
    size = F.abs(seconds)
    text = F.lit("now")
    for unit, span in (("second", 1), ("minute", 60), ("hour", 3600), ("day", 86_400), ("week", 604_800), ("month", 2_592_000), ("year", 31_536_000)):
        n = F.floor(size / span)
        text = F.when(size >= span, F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"))).otherwise(text)
    return F.when(size < 1, "now").when(seconds < 0, F.concat(text, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), text))


def seq_date(spark: SparkSession, begin: str, end: str, days: int = 1, fmt: str = "%Y-%m-%d", reverse: bool = False) -> DataFrame:
    """Dates from begin to end as text."""
    dates = spark.sql(f"SELECT explode(sequence(DATE '{begin}', DATE '{end}', INTERVAL {int(days)} DAYS)) AS d")
    order = F.col("d").desc() if reverse else F.col("d")
    return dates.orderBy(order).select(F.date_format("d", pattern(fmt)).alias("date"))


def calendar(spark: SparkSession, year: int, month: int, week_start: int = 0) -> DataFrame:
    """A month as weeks: one column a weekday (0 is Monday)."""
    names = ["mo", "tu", "we", "th", "fr", "sa", "su"]
    names = names[week_start:] + names[:week_start]
    days = spark.sql(f"SELECT explode(sequence(DATE '{year:04}-{month:02}-01', last_day(DATE '{year:04}-{month:02}-01'))) AS d")
    at = F.pmod(F.weekday("d") - week_start, F.lit(7))
    offset = F.pmod(F.weekday(F.trunc("d", "month")) - week_start, F.lit(7))
    rows = days.select(F.floor((F.day("d") - 1 + offset) / 7).alias("week"), at.alias("at"), F.day("d").alias("day"))
    return rows.groupBy("week").pivot("at", list(range(7))).agg(F.first("day")).orderBy("week").drop("week").toDF(*names)


def timezones(spark: SparkSession) -> DataFrame:
    """Known time zones."""
    from zoneinfo import available_timezones

    return spark.createDataFrame([(z,) for z in sorted(available_timezones())], "timezone string")


def ceil(c: Column, every: str) -> Column:
    """Round up to a multiple of a span; see truncate."""
    n, unit = re.fullmatch(r"(\d+)\s*([a-z]+)", every).groups()
    names = {"y": "years", "q": "months", "mo": "months", "w": "weeks", "d": "days", "h": "hours", "m": "minutes", "s": "seconds"}
    low = truncate(c, every)
    step = F.expr(f"INTERVAL {int(n) * (3 if unit == 'q' else 1)} {names[unit]}")
    return F.when(low == c, low).otherwise(low + step)


#: Names of weekdays, Monday first, and words for days.
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
DAY_WORDS = {"today": 0, "tomorrow": 1, "yesterday": -1}


def from_human(c: Column, now: Column) -> Column:
    """A timestamp from words: `now`, `today at 18:30`, `last friday at 19:45`, `next monday`, `in 5 minutes and 30 seconds`, `2 days ago`. Null where not understood."""
    t = F.lower(F.trim(c))
    midnight = F.date_trunc("day", now)
    clock = F.regexp_extract(t, r"(?:^|at )(\d{1,2}):(\d\d)(?::(\d\d))?$", 0)
    clock = F.regexp_replace(clock, "^at ", "")
    part = lambda k: F.coalesce(F.get(F.split(clock, ":"), F.lit(k)).try_cast("int"), F.lit(0))
    seconds = F.when(clock == "", F.when(t.rlike(" at "), None).otherwise(0)).otherwise(part(0) * 3600 + part(1) * 60 + part(2))
    day = F.regexp_replace(t, r"\s*(at )?\d{1,2}:\d\d(:\d\d)?$", "")
    shift = F.when(day == "", 0)
    for word, n in DAY_WORDS.items():
        shift = shift.when(day == word, n)
    for k, name in enumerate(WEEKDAYS):
        ahead = F.pmod(F.lit(k) - F.weekday(now), F.lit(7))
        shift = shift.when(day.isin(name, f"this {name}"), ahead).when(day == f"next {name}", F.when(ahead == 0, 7).otherwise(ahead)).when(day == f"last {name}", F.when(ahead == 0, -7).otherwise(ahead - 7))
    spans = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800}
    unit = "(second|minute|hour|day|week)s?"
    table = F.create_map(*(F.lit(x) for pair in spans.items() for x in pair))
    total = F.aggregate(F.zip_with(F.regexp_extract_all(t, F.lit(rf"(\d+) {unit}"), F.lit(1)), F.regexp_extract_all(t, F.lit(rf"(\d+) {unit}"), F.lit(2)), lambda n, u: n.cast("long") * F.element_at(table, u)), F.lit(0).cast("long"), lambda s, x: s + x)
    list_ = rf"\d+ {unit}((,| and|, and)? \d+ {unit})*"
    moved = F.when(t.rlike(rf"^in {list_}$"), total).when(t.rlike(rf"^{list_} ago$"), -total)
    at = F.timestamp_seconds(F.unix_seconds(midnight) + shift * 86_400 + seconds)
    return F.when(t == "now", now).when(moved.isNotNull(), F.timestamp_micros(F.unix_micros(now) + moved * 1_000_000)).otherwise(at)

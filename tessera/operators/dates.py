"""Date and number formatting jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def api_date(seconds: Column, unix: bool = False) -> Column:
    """API date: 0..1000 seconds → NULL; else ISO-8601 'Z' text (or the
    integer seconds when ``unix``)."""
    s = F.floor(seconds.cast("double")).cast("long")
    bad = s.between(0, 1000)
    if unix:
        return F.when(~bad, s)
    return F.when(~bad, F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def api_dates(df: DataFrame, cols: list[str], unix: bool = False) -> DataFrame:
    """D1 on columns holding timestamps or epoch seconds → ``<col>_api``."""
    out = df
    for c in cols:
        secs = F.unix_timestamp(F.col(c)) if dict(df.dtypes)[c].startswith("timestamp") else F.col(c)
        out = out.withColumn(f"{c}_api", api_date(secs, unix))
    return out


_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd"]


def strict_timestamp(text: Column) -> Column:
    """Parse 'Y-m-d H:i:s', 'Y-m-d H:i' or 'Y-m-d' only when the value
    re-formats to the same text (strict validation)."""
    parsed = [F.when(F.date_format(F.try_to_timestamp(text, F.lit(f)), f) == text,
                     F.try_to_timestamp(text, F.lit(f))) for f in _FORMATS]
    return F.coalesce(*parsed)


def to_utc(text: Column, tz: Column) -> Column:
    """Local wall time text in zone ``tz`` → UTC 'yyyy-MM-dd HH:mm:ss'
    ('' when the text is not a complete date)."""
    ts = strict_timestamp(F.trim(text))
    return F.coalesce(F.date_format(F.to_utc_timestamp(ts, tz), "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def from_utc(text_or_ts: Column, tz: Column, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """UTC wall time → local wall time in zone ``tz``."""
    return F.date_format(F.from_utc_timestamp(text_or_ts.cast("timestamp"), tz), fmt)


def readable_local(seconds: Column, tz: Column) -> Column:
    """Epoch seconds → 'Monday January 1st, 2024 09:00 AM' in zone ``tz``."""
    local = F.from_utc_timestamp(F.timestamp_seconds(seconds.cast("long")), tz)
    day = F.dayofmonth(local)
    suffix = (F.when(day.isin(11, 12, 13), "th").when(day % 10 == 1, "st").when(day % 10 == 2, "nd")
              .when(day % 10 == 3, "rd").otherwise("th"))
    return F.concat(F.date_format(local, "EEEE MMMM "), day.cast("string"), suffix,
                    F.date_format(local, ", yyyy hh:mm a"))


def convert_times(df: DataFrame, col: str, tz_col: str) -> DataFrame:
    """``<col>_utc`` (local → UTC) and ``<col>_local`` (UTC → local)."""
    return (df.withColumn(f"{col}_utc", to_utc(F.col(col), F.col(tz_col)))
              .withColumn(f"{col}_local", from_utc(strict_timestamp(F.trim(F.col(col))), F.col(tz_col))))


# Age units in seconds, largest first.
AGE_UNITS = [(31536000, "year"), (2592000, "month"), (604800, "week"), (86400, "day"),
             (3600, "hour"), (60, "minute"), (1, "second")]


def age_text(seconds_ago: Column) -> Column:
    """D3: '3 days', '1 hour' … for the largest unit that fits; '' when ≤ 0."""
    t = seconds_ago.cast("long")
    expr = F.lit("")
    for unit, name in reversed(AGE_UNITS):
        n = F.floor(t / unit)
        expr = F.when(t >= unit, F.concat(n.cast("string"), F.lit(" " + name),
                                          F.when(n > 1, F.lit("s")).otherwise(F.lit("")))).otherwise(expr)
    return expr


def age_buckets(df: DataFrame, col: str, as_of: str) -> DataFrame:
    """D3: age text, minutes since and minutes until ``as_of`` for a
    timestamp column (minutes only when more than 60 seconds)."""
    now = F.unix_timestamp(F.to_timestamp(F.lit(as_of)))
    ts = F.unix_timestamp(F.col(col))
    since = now - ts
    return (df.withColumn("age", F.when(ts > 0, age_text(since)).otherwise(F.lit("")))
              .withColumn("minutes_since", F.when((ts > 0) & (since > 60), F.floor(since / 60)).otherwise(F.lit(0)))
              .withColumn("minutes_until", F.when((ts > 0) & (-since > 60), F.floor(-since / 60)).otherwise(F.lit(0))))


def valid_date(text: Column, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Strict date check (parses and re-formats to the same text)."""
    return F.coalesce(F.date_format(F.try_to_timestamp(text, F.lit(fmt)), fmt) == text, F.lit(False))


def hms_to_seconds(text: Column) -> Column:
    """D4: 'h:m:s' (missing parts padded at the end, as the page helper
    does) → seconds; 0 when the text holds no digit."""
    parts = F.split(F.coalesce(text, F.lit("")), ":")
    padded = F.concat(parts, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 3 - F.size(parts))))
    nums = F.transform(padded, lambda p: F.coalesce(F.regexp_extract(p, r"^\s*([+-]?[0-9]+)", 1).try_cast("long"),
                                                     F.lit(0).cast("long")))
    rev = F.reverse(nums)
    total = F.aggregate(F.zip_with(rev, F.sequence(F.lit(0), F.size(rev) - 1), lambda v, i: v * F.pow(F.lit(60), i)),
                        F.lit(0.0), lambda acc, x: acc + x).cast("long")
    return F.when(F.coalesce(text, F.lit("")).rlike("[0-9]"), total).otherwise(F.lit(0).cast("long"))


def seconds_to_hms(seconds: Column) -> Column:
    """Seconds → 'mm:ss', or 'hh:mm:ss' above one hour."""
    s = seconds.cast("long")
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    hh = F.floor(s / 3600)
    mm = F.floor(s / 60) % 60
    ss = s % 60
    return F.concat(F.when(s > 3600, F.concat(F.substring(F.concat(F.lit("00"), hh.cast("string")), -2, 2),
                                               F.lit(":"))).otherwise(F.lit("")), two(mm), F.lit(":"), two(ss))


# Byte size units.
SIZE_UNITS = ["B", "KB", "MB", "GB", "TB"]


def format_bytes(c: Column, precision: int = 2) -> Column:
    """D5: '1.5 KB' style size: unit exponent floor(ln(b)/ln(1024)) capped
    at TB, value rounded half up, no trailing zeros."""
    b = F.greatest(c.cast("double"), F.lit(0.0))
    p = F.least(F.when(b > 0, F.floor(F.log(b) / F.log(F.lit(1024.0)))).otherwise(F.lit(0)), F.lit(4)).cast("int")
    v = F.round(b / F.pow(F.lit(1024.0), p), precision)
    txt = F.regexp_replace(F.regexp_replace(F.format_string(f"%.{precision}f", v), r"0+$", ""), r"\.$", "")
    units = F.array(*[F.lit(u) for u in SIZE_UNITS])
    return F.concat(txt, F.lit(" "), F.try_element_at(units, p + 1))


def pad_number(c: Column, length: int = 8) -> Column:
    """Zero-padded id (last ``length`` characters), '' for ids ≤ 0 or an
    all-zero result."""
    length = 64 if length > 64 else (8 if length <= 0 else length)
    n = c.cast("long")
    v = F.substring(F.concat(F.lit("0" * length), n.cast("string")), -length, length)
    return F.when((n > 0) & (v != F.lit("0" * length)), v).otherwise(F.lit(""))


def format_sizes(df: DataFrame, col: str, out: str = "size_text") -> DataFrame:
    return df.withColumn(out, format_bytes(F.col(col)))


def pad_ids(df: DataFrame, col: str, length: int = 8, out: str = "padded") -> DataFrame:
    return df.withColumn(out, pad_number(F.col(col), length))

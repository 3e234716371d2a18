"""Column expressions that repair dates, damaged JSON text and whitespace."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of the four metadata fields.
TEXT_FIELD = r'"{name}"\s*:\s*"([^"]*)"'
NUMBER_FIELD = r'"{name}"\s*:\s*([-+]?\d+(?:\.\d+)?)'

# The characters that count as whitespace at the ends of a text.
WHITESPACE = (
    " \t\n\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Last second a nanosecond timestamp can hold; later epoch values count as unreadable.
LAST_EPOCH_SECOND = 9223372036

# Written dates that are not ISO, tried in this order: a month above 12 can only be a day.
WRITTEN_FORMATS = (
    "M/d/yyyy",
    "d/M/yyyy",
    "yyyy/M/d",
    "yyyy.M.d",
    "yyyyMMdd",
    "d-MMM-yyyy",
    "MMM d, yyyy",
    "MMM d yyyy",
    "d MMM yyyy",
)
# Two-digit years count from 1969 to 2068.
SHORT_FORMAT, SHORT_YEARS_FROM = "d-MMM-yy", 1969


def strip_all(text: Column) -> Column:
    """Remove every kind of leading and trailing whitespace, not only spaces."""
    return F.btrim(text, F.lit(WHITESPACE))


def parse_mixed_date(text: Column) -> Column:
    """ISO or written dates and ``0x`` epoch seconds as TIMESTAMP_NTZ; anything else is null.

    The epoch arithmetic stays in the zone-free type, so the session time zone plays no part.
    """
    value = strip_all(text)
    digits = F.regexp_replace(F.substring(value, 3, 2**31 - 1), "^0+(?=.)", "")
    seconds = F.conv(digits, 16, 10).cast("decimal(20,0)")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    from_hex = F.when(
        digits.rlike(r"\A[0-9a-fA-F]{1,16}\z") & (seconds <= LAST_EPOCH_SECOND),
        epoch + F.make_dt_interval(secs=seconds.cast("decimal(18,6)")),
    )
    # A time of day after the date is added to it; alone it would be read in the session's zone.
    clock = F.regexp_extract(value, r" (\d{1,2}:[0-5]\d(?::[0-5]\d)?)\z", 1)
    day = F.when(clock != "", F.regexp_replace(value, r" \d{1,2}:[0-5]\d(?::[0-5]\d)?\z", "")).otherwise(value)

    def part(at: int) -> Column:
        return F.coalesce(F.get(F.split(F.nullif(clock, F.lit("")), ":"), F.lit(at)).cast("int"), F.lit(0))

    short = F.to_date(F.try_to_timestamp(day, F.lit(SHORT_FORMAT)))
    short = F.when(F.year(short) >= SHORT_YEARS_FROM + 100, F.add_months(short, -1200)).otherwise(short)
    dates = F.coalesce(*[F.to_date(F.try_to_timestamp(day, F.lit(form))) for form in WRITTEN_FORMATS], short)
    time = F.make_dt_interval(hours=part(0), mins=part(1), secs=part(2).cast("decimal(18,6)"))
    written = F.when(part(0) < 24, dates.cast("timestamp_ntz") + time)
    from_text = F.coalesce(value.try_cast("timestamp_ntz"), written)
    return F.when(value.rlike("^0[xX]"), from_hex).otherwise(from_text)


def text_field(json_text: Column, name: str) -> Column:
    """First text value of a field; null where the field is absent, '' where it is empty.

    The long text is searched once for the whole match, which is never empty; its value is then cut out.
    """
    pattern = TEXT_FIELD.format(name=re.escape(name))
    whole = F.nullif(F.regexp_extract(json_text, pattern, 0), F.lit(""))
    return F.regexp_extract(whole, pattern, 1)


def number_field(json_text: Column, name: str, data_type: str = "decimal(18,2)") -> Column:
    """First numeric value of a field; null where it is absent or does not fit the type."""
    pattern = NUMBER_FIELD.format(name=re.escape(name))
    return F.nullif(F.regexp_extract(json_text, pattern, 1), F.lit("")).try_cast(data_type)


# Fixed value: the characters that a standard column name keeps.
NAME_KEEPS = r"[^A-Za-z0-9]+"


def standard_name(name: str) -> str:
    """Column name in upper case with runs of other characters turned into one underscore."""
    return re.sub(NAME_KEEPS, "_", str(name)).strip("_").upper()


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ, independent of the session time zone."""
    day = F.unix_date(ts.cast("date")).cast("bigint")
    seconds = (day * 24 + F.hour(ts)) * 3600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")


def from_epoch_micros(micros: Column) -> Column:
    """Inverse of :func:`epoch_micros`."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(secs=(micros.cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)"))


def leading_digit(amount: Column) -> Column:
    """First non-zero digit of a positive amount, else null."""
    return F.when(
        amount > 0, F.nullif(F.regexp_extract(amount.cast("string"), "([1-9])", 1), F.lit("")).cast("int")
    )

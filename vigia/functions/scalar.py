"""Column helpers shared by the operators: text and tag keys, times in UTC, safe ratios, shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US
UNKNOWN = "desconhecido"


def text_key(column: str | Column) -> Column:
    """Trimmed lower-case text; null becomes the empty text."""
    return F.coalesce(F.lower(F.trim(F.col(column) if isinstance(column, str) else column)), F.lit(""))


def tag_key(column: str | Column) -> Column:
    """Trimmed upper-case equipment tag; null becomes the empty text."""
    return F.coalesce(F.upper(F.trim(F.col(column) if isinstance(column, str) else column)), F.lit(""))


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 as a long, for times with and without zone alike."""
    if df.schema[column].dataType.typeName() == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{column}`)")
    return F.unix_micros(F.col(column))


def utc_time(column: str | Column, zone: str = "America/Sao_Paulo") -> Column:
    """Text to a UTC time; nothing that can't be read fails.

    Text with an offset keeps its instant; text without one is local time of ``zone``. Local times that
    a change of the clocks skips or repeats become null.
    """
    text = F.trim((F.col(column) if isinstance(column, str) else column).cast("string"))
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    local = F.try_to_timestamp(F.regexp_replace(text, "T", " "))
    instant = F.to_utc_timestamp(local, zone)
    back = F.from_utc_timestamp(instant, zone)
    hour = F.expr("INTERVAL 1 HOUR")
    twice = (F.from_utc_timestamp(instant + hour, zone) == local) | (F.from_utc_timestamp(instant - hour, zone) == local)
    return F.when(zoned, F.try_to_timestamp(text)).when((back == local) & ~twice, instant)


def number_or_null(column: str | Column) -> Column:
    """NaN becomes null, so that comparisons and maxima don't take it for the largest number."""
    c = F.col(column) if isinstance(column, str) else column
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def safe_divide(a: Column, b: Column) -> Column:
    """Quotient; 0 where the denominator is 0 or either side is null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def safe_percent(a: Column, b: Column) -> Column:
    return F.round(safe_divide(a, b) * 100, 4)


def shift_of(hour: Column) -> Column:
    """Work shift: 6 to 13 morning, 14 to 21 afternoon, night otherwise."""
    return F.when(hour.isNull(), UNKNOWN).when(hour.between(6, 13), "manha").when(hour.between(14, 21), "tarde").otherwise("noite")


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def day_key(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))

"""Times that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def utc_timestamp(df: DataFrame, name: str) -> Column:
    """A time column as TIMESTAMP; one without a zone is read as UTC, whatever the session zone is."""
    if dict(df.dtypes)[name] != "timestamp_ntz":
        return F.col(name)
    micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{name}`)")
    return F.timestamp_micros(micros)


def utc_day(c: Column) -> Column:
    return F.date_from_unix_date(F.floor(F.unix_seconds(c) / 86400).cast("int"))

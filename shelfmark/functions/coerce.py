"""Loose operational values to typed columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from shelfmark.schemas import MONEY


def _as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _text(value: Column | str) -> Column:
    return F.trim(_as_col(value).cast("string"))


def money(value: Column | str) -> Column:
    """Exact two-decimal amount; sums of it do not depend on row order."""
    return _as_col(value).cast(MONEY)


def _parsed_double(value: Column | str) -> Column:
    # A trailing d or f is a number to the JVM but not to the data's writers.
    text = _text(value)
    return F.when(~text.rlike(r"[0-9.][dDfF]$"), text.try_cast("double"))


def int_or(value: Column | str, default: int = 0) -> Column:
    """"7" and "7.9" give 7; blank, NULL and unparseable values give ``default``."""
    return F.coalesce(
        _text(value).try_cast("bigint"),
        _parsed_double(value).try_cast("bigint"),
        F.lit(default).cast("bigint"),
    )


def float_or(value: Column | str, default: float = 0.0) -> Column:
    """Blank, NULL and unparseable values give ``default``."""
    return F.coalesce(_parsed_double(value), F.lit(float(default)))


def int_or_null(value: Column | str) -> Column:
    """Loader variant: whole numbers only, everything else is NULL."""
    return _text(value).try_cast("bigint")


def float_or_null(value: Column | str) -> Column:
    return _parsed_double(value)


def text_or_null(value: Column | str) -> Column:
    return _as_col(value).cast("string")


def utc_timestamp(value: Column | str) -> Column:
    """ISO-8601 text, with or without Z or an offset, to an instant; unparseable gives NULL."""
    text = _text(value)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text))


def epoch_seconds_timestamp(value: Column | str) -> Column:
    return F.timestamp_seconds(_as_col(value))


def key_or_document_id(key: Column | str, document_id: Column | str) -> Column:
    """An empty key counts as missing."""
    return F.coalesce(F.nullif(_as_col(key).cast("string"), F.lit("")), _as_col(document_id).cast("string"))


def minute_snapshot_id(product_id: Column | str, captured_at: Column | str) -> Column:
    """Two captures within one minute share an id."""
    return F.concat_ws(
        "_", _as_col(product_id).cast("string"), F.date_format(_as_col(captured_at), "yyyyMMdd'T'HHmm")
    )


def iso_utc(value: Column | str) -> Column:
    """Instant to ISO-8601 text in UTC; microseconds only where there are any."""
    stamp = _as_col(value)
    whole = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(stamp), F.lit(1_000_000))
    fraction = F.when(micros == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    return F.concat(whole, fraction, F.lit("+00:00"))


def output_ready(dtype: T.DataType, column: Column) -> Column:
    """Instants and dates to ISO text and decimals to doubles, at any depth."""
    if isinstance(dtype, T.TimestampType):
        return iso_utc(column)
    if isinstance(dtype, T.DateType):
        return F.date_format(column, "yyyy-MM-dd")
    if isinstance(dtype, T.DecimalType):
        return column.cast("double")
    if isinstance(dtype, T.ArrayType):
        return F.transform(column, lambda item: output_ready(dtype.elementType, item))
    if isinstance(dtype, T.StructType):
        fields = [output_ready(f.dataType, column.getField(f.name)).alias(f.name) for f in dtype.fields]
        return F.when(column.isNotNull(), F.struct(*fields))
    return column


def for_output(df):
    """Every column of ``df`` in its output form."""
    return df.select(*[output_ready(f.dataType, F.col(f.name)).alias(f.name) for f in df.schema.fields])

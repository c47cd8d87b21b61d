"""Newline-delimited JSON: everything read as text first, then cast column by column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def _loose(dtype: T.DataType) -> T.DataType:
    """The same shape with every leaf as text, so that no value is lost to a type mismatch."""
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _loose(f.dataType)) for f in dtype.fields])
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_loose(dtype.elementType))
    return T.StringType()


def _typed(dtype: T.DataType, column):
    if isinstance(dtype, T.StructType):
        fields = [_typed(f.dataType, column.getField(f.name)).alias(f.name) for f in dtype.fields]
        return F.when(column.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(column, lambda item: _typed(dtype.elementType, item))
    if isinstance(dtype, T.TimestampType):
        return F.try_to_timestamp(F.trim(column))
    if isinstance(dtype, T.StringType):
        return column
    return F.trim(column).try_cast(dtype)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the declared types, lines that are no JSON). A value that does not fit its type is NULL."""
    declared = T.StructType.fromDDL(schema)
    loose = _loose(declared).add(CORRUPT, T.StringType())
    lines = spark.read.text(path).where(F.trim("value") != "")
    read = lines.select(
        "value", F.from_json("value", loose, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("row"))
    broken = F.col(f"row.{CORRUPT}").isNotNull()
    rows = read.where(~broken).select(
        *[_typed(f.dataType, F.col(f"row.{f.name}")).alias(f.name) for f in declared.fields]
    )
    return rows, read.where(broken).select(F.col("value").alias("line"))

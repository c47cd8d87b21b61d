"""Top rows per group, newest row per key, pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_per(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of every group. ``order`` must end in a unique key.

    The filter on row_number lets Spark cut every map task to k rows per group before the
    shuffle, so a group that holds most of the table still sends few rows.
    """
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)
    return ranked if rank else ranked.drop(name)


def newest_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_per(df, keys, order, 1)


def page_per(df: DataFrame, by: Sequence[str], order: Sequence[Column], *, offset: int = 0, limit: int = 50) -> DataFrame:
    """Rows offset+1 … offset+limit of every group, with the next page's token, NULL on the last page."""
    if offset < 0 or limit < 1:
        raise ValueError("offset must be >= 0 and limit >= 1")
    # One row past the page tells whether another page follows.
    rows = top_per(df, by, order, offset + limit + 1, rank="position").where(F.col("position") > offset)
    more = F.max("position").over(Window.partitionBy(*by)) > offset + limit
    return (
        rows.withColumn("next_page_token", F.when(more, F.lit(str(offset + limit))))
        .where(F.col("position") <= offset + limit)
    )


def page_token(token: str | None) -> int:
    if token is None:
        return 0
    if not token.isdigit():
        raise ValueError(f"page token must be a number, got {token!r}")
    return int(token)

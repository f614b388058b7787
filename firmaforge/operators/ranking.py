"""Top rows per group, and ordered paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_rows(df: DataFrame, group: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each group.

    Spark cuts every task's share of a group to ``limit`` rows before the shuffle (the
    window group limit), so a group that holds most of the data stays small. It does so for
    limits up to ``spark.sql.optimizer.windowGroupLimitThreshold``.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return (
        df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= limit).drop("_rank")
    )


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` (1 to 100) rows; end ``order`` with a unique key."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("page number starts at 1 and page size is 1 to 100")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def ordered_by(df: DataFrame, column: str, descending: bool = True) -> list[Column]:
    """Sort order on a caller-named column, checked against the columns there are."""
    if column not in df.columns:
        raise ValueError(f"cannot sort by {column!r}")
    return [F.desc(column) if descending else F.asc(column)]

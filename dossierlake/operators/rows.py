"""How rows are laid down before texts are worked on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The rows with further columns, each told once a row.

    A filter on a column of a projection is pushed below it, and takes a copy of all that the column is made of with
    it; what a generator gives is not copied. The outer form is used, since the other filters on its own input first.
    """
    return df.select(*df.columns, F.inline_outer(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by their keys: a table of short rows is a few megabytes in one or two splits, whatever is made of each row.

    The number of partitions is the session's; without one they would be merged again by their bytes.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)

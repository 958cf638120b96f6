"""Columns that are made once a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def made_once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with more columns, made once a row: a generator hands them on, which filters and projections above cannot fold into their own expressions.

    They are made in a projection below it. Spark compiles that one, while it interprets whatever a generator has to make with a lambda in it.
    """
    made = rows.select("*", *[c.alias(f"once_{n}") for n, c in columns.items()])
    return made.select(*rows.columns, F.inline(F.array(F.struct(*[F.col(f"once_{n}").alias(n) for n in columns]))))

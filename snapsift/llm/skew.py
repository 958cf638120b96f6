"""A join with a table of groups in which no key's rows have to meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group with more than one in so many of the grouped rows is hot; so there are fewer hot groups than this.
HOT = 1_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` left-joined with ``groups`` on ``key`` (not null), where ``groups`` has one row for each key and the number of its rows in ``size``.

    Hot groups are fewer than ``HOT`` rows at any size of the data, so they are broadcast and their rows stay where they are; of the other groups
    none has more than one in ``HOT`` of the rows, so an exchange deals them evenly. Both tables are read twice: they should be written ones.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    is_hot = F.col(size) * HOT > F.lit(total)
    hot = F.broadcast(groups.where(is_hot))
    cold = rows.join(hot.select(key), key, "left_anti").join(groups.where(~is_hot).hint("merge"), key, "left")
    return rows.join(hot, key).unionByName(cold)

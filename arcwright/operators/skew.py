"""Joins that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key that holds at least this part of the rows is joined by broadcast; no more than its inverse of keys can.
HOT_SHARE = 1 / 1000


def join_hot(rows: DataFrame, table: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table`` (one row a key, other column names) on equal keys.

    ``n`` names the table's column with the key's number of rows among the ``total`` of ``rows`` (an upper
    bound of ``rows``' size). Keys with a thousandth of them or more, of which there are at most a
    thousand, are broadcast, so their rows are joined where they lie; the others are joined as
    Spark sees fit. Null keys match nothing.
    """
    least = max(1, int(total * HOT_SHARE))
    hot = table.where(F.col(n) >= least)
    cold = table.where(F.col(n) < least)
    others = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")  # rows of hot keys don't move
    return rows.join(F.broadcast(hot), on).unionByName(others.join(cold, on))

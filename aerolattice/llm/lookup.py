"""Joining rows with facts about their group when one group may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group that holds more than one in HOT_SHARE rows is broadcast: there are fewer than HOT_SHARE of them.
HOT_SHARE = 1000


def with_group(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Rows left-joined with `groups` on `key`; `size` is a column of `groups` that counts the group's rows."""
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.where(F.col(size) * HOT_SHARE > total).withColumn("_hot", F.lit(True))
    common = groups.where(F.col(size) * HOT_SHARE <= total)
    wide = rows.join(F.broadcast(hot), key, "left")
    rest = wide.where("_hot IS NULL").select(*rows.columns).join(common, key, "left")
    return wide.where("_hot").select(*rest.columns).unionByName(rest)

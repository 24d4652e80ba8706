"""Bounded samples for fitting, without sending more than about their size to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(df: DataFrame, column: str, n: int) -> list:
    """At most ``n`` different values of ``column``, those with the least hashes; the same for the same data.

    A filter on the hash, set from the number of different values, leaves about three times ``n`` of them before
    copies are dropped and they are ordered, so what is shuffled and sent to the driver is bounded, and a value
    that a third of all rows hold counts once. Null values are left out.
    """
    rows = df.where(F.col(column).isNotNull()).select(column, F.xxhash64(column).alias("_h"))
    total = rows.agg(F.approx_count_distinct("_h")).first()[0]
    if total > 3 * n:
        rows = rows.where(F.col("_h") < int(-(2**63) + 3 * n / total * 2**64))
    once = rows.groupBy("_h").agg(F.first(column).alias("v"))
    return [r.v for r in once.orderBy("_h").limit(n).collect()]

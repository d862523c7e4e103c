"""How rows are dealt to tasks before work that their bytes don't show."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to as many tasks as the session shuffles to.

    Adaptive execution puts small partitions together by their bytes; rows that a task spreads over cells or pairs are few bytes and much work, so
    their number of tasks is held.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)

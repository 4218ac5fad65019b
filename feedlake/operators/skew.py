"""Joins for keys that may hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_one_per_key(
    rows: DataFrame, per_key: DataFrame, keys: Sequence[str], row_id: str, salts: int = 32
) -> DataFrame:
    """Inner join of many rows with a table of one row per key.

    Adaptive execution splits hot keys only where that costs no extra shuffle,
    which it does when the join is followed by an aggregation on the same key.
    Here each key is spread over ``salts`` partitions by a hash of the row id,
    and its single partner row is repeated that often. When the partner table
    fits Spark's broadcast limit, Spark sends it out whole and shuffles nothing.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(row_id), F.lit(salts)))
    repeated = per_key.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    )
    return salted.join(repeated, [*keys, "_salt"]).drop("_salt")

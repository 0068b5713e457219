"""Joins with a table of one row a key, where a few keys may hold most of the other table's rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT = 1024


def join_unique(rows: DataFrame, side: DataFrame, keys: list[str], weight: str, total: int, spread: Column) -> DataFrame:
    """``rows`` left-joined with ``side``, which has one row for each value of ``keys`` and says in ``weight`` how many rows have it.

    Keys of more than 1/HOT of all ``total`` rows are fewer than HOT: they are
    broadcast, and their rows, like those with a null key, are dealt by
    ``spread`` instead of by key.
    """
    others = [c for c in side.columns if c not in keys]
    hot = side.filter(F.col(weight) * HOT > total).select(*keys, F.struct(*others).alias("_hot"))
    zero = F.pmod(F.xxhash64(*keys), F.lit(1)).cast("long")  # a literal would be folded, and rows dealt by the keys alone
    rest = side.select(*keys, F.struct(*others).alias("_rest"), zero.alias("_salt"))
    apart = reduce(or_, (F.col(k).isNull() for k in keys), F.col("_hot").isNotNull())
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(apart, F.xxhash64(spread)).otherwise(F.lit(0)).cast("long"))
    joined = salted.join(rest, [*keys, "_salt"], "left")
    return joined.select(*rows.columns, *(F.coalesce(F.col("_hot")[c], F.col("_rest")[c]).alias(c) for c in others))

"""Table fingerprints that don't depend on the order of rows: sums of row digests, and trees of them by key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = ["h1", "h2", "h3", "h4"]
SKIP = ("record_last_updated",)


def canonical(columns: Sequence[str]) -> Column:
    """One text for the values, each with its length, so that no two rows of values give the same; null is a dash."""
    text = lambda c: F.col(c).cast("string")
    return F.concat_ws("", *(F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in columns))


def lanes(columns: Sequence[str]) -> list[Column]:
    """SHA-256 of the canonical text as four numbers of 60 bits, whose sums are exact in 38 digits."""
    digest = F.sha2(canonical(columns), 256)
    return [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("bigint").cast("decimal(28,0)").alias(h) for i, h in enumerate(LANES)]


def _compared(df: DataFrame, skip: Sequence[str]) -> list[str]:
    return sorted(c for c in df.columns if c not in skip)


def fingerprint(df: DataFrame, skip: Sequence[str] = SKIP) -> DataFrame:
    """(n_rows, fingerprint): the sums of the row digests, which combine map-side; no task holds more than a row."""
    sums = df.select(*lanes(_compared(df, skip))).agg(F.count("*").alias("n_rows"), *(F.coalesce(F.sum(h), F.lit(0)).cast("string").alias(h) for h in LANES))
    return sums.select("n_rows", F.sha2(F.concat_ws(":", F.col("n_rows").cast("string"), *LANES), 256).alias("fingerprint"))


def ordered_fingerprint(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """(digest) over all rows in the given order, for small contract tables: it gathers them."""
    columns = sorted(df.columns)
    rows = df.select(F.struct(*order).alias("at"), F.to_json(F.struct(*columns)).alias("row"))
    return rows.agg(F.sha2(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("at", "row"))), lambda x: x["row"])), 256).alias("digest"))


#: Hexadecimal digits of the key's digest at each level of a tree, from the root to the leaves.
LEVELS = (0, 2, 4)


def bucket(key: Sequence[str], digits: int) -> Column:
    return F.substring(F.sha2(canonical(key), 256), 1, digits) if digits else F.lit("")


def hash_tree(df: DataFrame, key: Sequence[str], skip: Sequence[str] = SKIP, levels: Sequence[int] = LEVELS) -> DataFrame:
    """(level, path, n, h1..h4): the sums of the rows of each bucket of keys.

    Rows are summed once, by leaf and map-side; the levels above are sums of leaves.  Written down, partitioned by
    level, a tree lets an audit read no more of it than the path to what differs.
    """
    leaves = df.select(bucket(key, levels[-1]).alias("path"), *lanes(_compared(df, skip))).groupBy("path").agg(F.count("*").alias("n"), *(F.sum(h).alias(h) for h in LANES))
    above = leaves.select(F.explode(F.array(*map(F.lit, levels))).alias("level"), "path", "n", *LANES)
    cut = above.withColumn("path", F.expr("substring(path, 1, level)"))
    return cut.groupBy("level", "path").agg(F.sum("n").alias("n"), *(F.sum(h).alias(h) for h in LANES))


def _signed(df: DataFrame, key: Sequence[str], skip: Sequence[str], digits: int, sign: int) -> DataFrame:
    sides = [F.lit(int(sign == s)).cast("bigint").alias(c) for c, s in (("left_rows", 1), ("right_rows", -1))]
    return df.select(bucket(key, digits).alias("path"), *lanes(_compared(df, skip))).select("path", *sides, *((F.col(h) * sign).cast("decimal(28,0)").alias(h) for h in LANES))


def bucket_differences(left: DataFrame, right: DataFrame, key: Sequence[str], digits: int = LEVELS[-1], skip: Sequence[str] = SKIP) -> DataFrame:
    """(path, left_rows, right_rows, equal) of the leaves of two tables at hand: one exchange of sums, in which equal rows cancel out."""
    rows = _signed(left, key, skip, digits, 1).unionByName(_signed(right, key, skip, digits, -1))
    summed = rows.groupBy("path").agg(F.sum("left_rows").alias("left_rows"), F.sum("right_rows").alias("right_rows"), *(F.sum(h).alias(h) for h in LANES))
    return summed.select("path", "left_rows", "right_rows", reduce(lambda x, y: x & y, (F.col(h) == 0 for h in LANES), F.col("left_rows") == F.col("right_rows")).alias("equal"))


def unequal_buckets(left: DataFrame, right: DataFrame, levels: Sequence[int] = LEVELS) -> DataFrame:
    """(path, left_rows, right_rows) of the leaves in which two trees differ; below an equal bucket nothing is compared."""
    parents, above = None, 0
    for level in levels:
        sides = []
        for tree, sign in ((left, 1), (right, -1)):
            rows = tree.filter(F.col("level") == level)
            if parents is not None:
                rows = rows.join(parents, F.substring("path", 1, above) == F.col("parent"), "left_semi")
            sides.append(rows.select("path", *(F.when(F.lit(sign == s), F.col("n")).otherwise(0).alias(c) for c, s in (("left_rows", 1), ("right_rows", -1))), *((F.col(h) * sign).cast("decimal(38,0)").alias(h) for h in LANES)))
        summed = sides[0].unionByName(sides[1]).groupBy("path").agg(F.sum("left_rows").alias("left_rows"), F.sum("right_rows").alias("right_rows"), *(F.sum(h).alias(h) for h in LANES))
        differ = summed.filter(reduce(lambda x, y: x | y, (F.col(h) != 0 for h in LANES), F.col("left_rows") != F.col("right_rows")))
        parents, above = differ.select(F.col("path").alias("parent")), level
    return differ.select("path", "left_rows", "right_rows")


def differing_keys(left: DataFrame, right: DataFrame, key: Sequence[str], buckets: DataFrame, digits: int = LEVELS[-1], skip: Sequence[str] = SKIP) -> DataFrame:
    """(key columns, left_rows, right_rows, status, columns): the keys in ``buckets`` whose rows are missing, extra or changed on the right, and where.

    Only rows of these buckets are exchanged.  Rows of a key are compared as a multiset; of a hot key one partial sum
    for each task is all that moves.
    """
    compared = [c for c in _compared(left, skip) if c not in key]
    sides = []
    for df, sign in ((left, 1), (right, -1)):
        inside = df.withColumn("_path", bucket(key, digits)).join(buckets.select(F.col("path").alias("_path")), "_path", "left_semi")
        hashed = [(F.xxhash64(canonical([c])).cast("decimal(20,0)") * sign).alias(f"_c{i}") for i, c in enumerate(compared)]
        whole = [(x * sign).alias(h) for x, h in zip(lanes(_compared(df, skip)), [f"_{h}" for h in LANES])]
        sides.append(inside.select(*key, F.lit(int(sign > 0)).alias("_left"), *hashed, *whole))
    sums = sides[0].unionByName(sides[1]).groupBy(*key).agg(F.sum("_left").alias("left_rows"), F.sum(1 - F.col("_left")).alias("right_rows"), *(F.sum(f"_c{i}").alias(f"_c{i}") for i in range(len(compared))), *(F.sum(f"_{h}").alias(f"_{h}") for h in LANES))
    differ = reduce(lambda x, y: x | y, (F.col(f"_{h}") != 0 for h in LANES), F.col("left_rows") != F.col("right_rows"))
    status = F.when(F.col("right_rows") == 0, "missing").when(F.col("left_rows") == 0, "extra").otherwise("changed")
    named = F.array_compact(F.array(*(F.when(F.col(f"_c{i}") != 0, F.lit(c)) for i, c in enumerate(compared)))) if compared else F.array().cast("array<string>")
    found = sums.filter(differ).withColumn("status", status)
    return found.select(*key, "left_rows", "right_rows", "status", F.when(F.col("status") == "changed", F.array_join(named, ",")).otherwise("").alias("columns"))

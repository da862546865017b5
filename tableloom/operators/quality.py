"""Assertions over tables before they are published."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import new_folder


class AssertionFailed(RuntimeError):
    """A table that may not be published."""


def null_keys(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows in which a key column is null."""
    return df.agg(F.count_if(reduce(lambda a, b: a | b, [F.col(f"`{k}`").isNull() for k in keys]))).first()[0]


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_keys(df: DataFrame, keys: Sequence[str]) -> None:
    n = null_keys(df, keys)
    if n:
        raise AssertionFailed(f"{n} rows without a key")
    if not duplicate_keys(df, keys).isEmpty():
        raise AssertionFailed(f"{', '.join(keys)} is not unique")


def assert_no_shrink(staged: int, published: int, least: float = 0.5, allow: bool = False) -> None:
    """A replacement must keep at least half of the rows, unless allowed or the target is empty."""
    if not allow and published and staged < least * published:
        raise AssertionFailed(f"{staged} rows would replace {published}")


def assert_failure_rate(rejected: int, kept: int, most: float = 0.999) -> None:
    total = rejected + kept
    if total and rejected / total > most:
        raise AssertionFailed(f"{rejected} of {total} rows were rejected")


def row_hashes(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a row. Whether a column is null is hashed beside its value."""
    parts = [p for c in sorted(columns or df.columns) for p in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    first = F.xxhash64(*parts)
    return first, F.xxhash64(F.lit("again"), *reversed(parts))


def _sums(df: DataFrame, columns: Sequence[str] | None, names: Sequence[str] = ("n", "h1", "h2")) -> list[Column]:
    """A multiset's hash as aggregates: its size and the exact sums of its rows' hashes. Sums, unlike exclusive or, do
    not lose rows that come in pairs, and they can be added up over parts."""
    return [F.count(F.lit(1)).alias(names[0]),
            *[F.sum(h.cast("decimal(20,0)")).alias(n) for h, n in zip(row_hashes(df, columns), names[1:])]]


def checksum(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[int, int, int]:
    """(rows, two sums) of a table: equal for equal rows, each as often, however they are stored."""
    row = df.agg(*_sums(df, columns)).first()
    return row[0], int(row[1] or 0), int(row[2] or 0)


def same_table(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> bool:
    """Whether two tables hold the same rows, each as often, and neither repeats a key."""
    if checksum(a) != checksum(b, a.columns):
        return False
    return not keys or duplicate_keys(a, keys).isEmpty() and duplicate_keys(b, keys).isEmpty()


def differing_keys(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None,
                   bits: int = 10, levels: int = 2) -> DataFrame:
    """(keys, in_a, in_b) of the keys whose rows differ between two tables, with their numbers of rows.

    Ranges of the keys' hash are compared by their checksums, which leave a task as one row a range; of the ranges that
    differ, ranges of them are compared, and so on; last, keys in the ranges that still differ. Only keys and hashes are
    shuffled, and only those of differing ranges: equal tables cost one scan each and ``2 ** bits`` rows. Where more
    than ``2 ** bits`` ranges differ the keys are compared at once."""
    columns = list(columns or a.columns)
    spark = a.sparkSession
    names = [f"k{i}" for i in range(len(keys))]

    def hashed(df: DataFrame, side: str) -> DataFrame:
        own = [F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)]
        h1, h2 = row_hashes(df, columns)
        return df.select(*own, F.xxhash64(*[F.col(f"`{k}`") for k in keys]).alias("at"), h1.alias("h1"), h2.alias("h2"),
                         F.lit(side).alias("side"))

    def unlike(rows: DataFrame, by: Sequence[str]) -> DataFrame:
        """The groups that differ. Both tables meet in one grouping, combined in each task first."""
        of = lambda s, v: F.when(F.col("side") == s, v)
        sums = [F.coalesce(F.sum(of(s, F.col(h).cast("decimal(20,0)"))), F.lit(0)).alias(f"{h}{s}") for s in "ab" for h in ("h1", "h2")]
        return rows.groupBy(*by).agg(*[F.count(of(s, F.lit(1))).alias(f"in_{s}") for s in "ab"], *sums).where(
            "in_a <> in_b OR h1a <> h1b OR h2a <> h2b")

    rows = hashed(a, "a").unionByName(hashed(b, "b"))
    for level in range(1, levels + 1):
        ranges = unlike(rows.withColumn("range", F.shiftright("at", 64 - bits * level)), ["range"]).select("range")
        found = [r[0] for r in ranges.limit((1 << bits) + 1).collect()]  # ranges: bounded by the limit
        if len(found) > 1 << bits:
            break
        few = spark.createDataFrame([(r,) for r in found], "range bigint")
        rows = rows.join(F.broadcast(few), F.shiftright("at", 64 - bits * level) == F.col("range"), "left_semi")
        if level < levels:
            path = new_folder(spark, "hashes")
            rows.write.parquet(path)
            rows = spark.read.schema(rows.schema).parquet(path)
    return unlike(rows, names).select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "in_a", "in_b")


def reproduces(query, recorded_rows: int) -> bool:
    """Whether a recorded query, run again, gives as many rows."""
    return query().count() == recorded_rows

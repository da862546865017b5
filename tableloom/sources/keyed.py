"""A table of rows by key that changes are merged into: plain Parquet folders by bucket, of which a merge rewrites only
those that it touches.

A row keeps the sequence value of the change that made it, and a deleted key stays as a tombstone, so whether a change
is newer than what the table has is decided by the table itself. A merge takes the greatest state of each key, which
does not depend on the order in which changes come nor on how they are split into batches, and a batch that comes twice
changes nothing.

Writes are Spark's own dynamic partition overwrite. What is to be written is written beside the table first; a run that
dies between the two is finished by the next one, and readers take those buckets from there. One run writes at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import BuildError

#: Columns that a table keeps beside its rows.
BUCKET, GONE = "bucket__", "gone__"
#: How deletes and later changes of a key meet: a delete is final, or the greater sequence value wins.
DELETES = ("final", "by_sequence")


def newest(rows: DataFrame, keys: Sequence[str], sequence: str, deletes: str = "final", within: Sequence[str] = ()) -> DataFrame:
    """Of each key the greatest state: with ``final`` a tombstone before all rows, else the greater sequence value, and
    at equal ones the tombstone. Rows that are equal so far are told apart by their other values. Null is the least."""
    if deletes not in DELETES:
        raise BuildError(f"deletes are {' or '.join(DELETES)}")
    first = [F.col(GONE).desc(), F.col(f"`{sequence}`").desc_nulls_last()]
    rest = [F.col(f"`{c}`").desc_nulls_last() for c in rows.columns if c not in (*keys, sequence, GONE, BUCKET)]
    order = [*(first if deletes == "final" else reversed(first)), *rest]
    key = Window.partitionBy(*within, *[F.col(f"`{k}`") for k in keys]).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(key)).where("_n = 1").drop("_n")


class KeyedTable:
    """``keys`` tell rows apart, ``sequence`` is the column that orders a key's changes. ``bucket`` is a column made of
    the keys alone, with which rows are laid out; else a hash of the keys in ``buckets`` parts. Choose as many that a
    bucket is some hundred megabytes; keys whose changes come together, such as recent ones, should share buckets."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], sequence: str, buckets: int = 64,
                 bucket: Column | None = None, deletes: str = "final"):
        self.spark, self.path, self.keys, self.sequence, self.deletes = spark, path.rstrip("/"), list(keys), sequence, deletes
        self.pending = f"{self.path}/_pending"  # Spark's readers pass over names with an underscore
        self.bucket = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)) if bucket is None else bucket

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _has(self, pattern: str) -> bool:
        fs, at = self._fs(pattern)
        return bool(fs.globStatus(at))

    def _ready(self) -> DataFrame | None:
        """Rows that a run has written beside the table and not yet into it."""
        return self.spark.read.parquet(self.pending) if self._has(f"{self.pending}/_SUCCESS") else None

    def _stored(self) -> DataFrame | None:
        """All rows and tombstones with their bucket."""
        ready = self._ready()
        if not self._has(f"{self.path}/{BUCKET}=*"):
            return ready
        rows = self.spark.read.parquet(self.path)
        if ready is None:
            return rows
        moved = [r[0] for r in ready.select(BUCKET).distinct().collect()]  # buckets: as many as the table is laid out in
        return rows.where(~F.col(BUCKET).isin(moved)).unionByName(ready)

    def read(self) -> DataFrame | None:
        """The live rows; None before the first merge."""
        rows = self._stored()
        return None if rows is None else rows.where(~F.col(GONE)).drop(GONE, BUCKET)

    def files(self) -> set[str]:
        """The table's data files by name."""
        return set(self.spark.read.parquet(self.path).inputFiles())

    def _finish(self) -> None:
        """Puts pending rows into the table: each of their buckets is replaced as a whole."""
        rows = self._ready()
        if rows is not None:
            rows.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        fs, at = self._fs(self.pending)
        fs.delete(at, True)

    def merge(self, changes: DataFrame, gone: Column | None = None, since=None,
              asserts: Sequence[Callable[[DataFrame], None]] = ()) -> int:
        """Changes merged into the table; returns how many buckets were rewritten. ``gone`` tells which are deletes; of
        those only key and sequence value count. ``since`` is the time, as a sequence value, before which no change
        comes any more: changes before it are left out, and tombstones before it go from rewritten buckets, so that
        their number is bounded by what is deleted in the time that a change may be late. ``asserts`` look at the live
        rows of the touched buckets as they were written beside the table; if one raises, the table stays as it was."""
        self._finish()
        at = F.col(f"`{self.sequence}`")
        rows = changes.withColumn(GONE, F.lit(False) if gone is None else F.coalesce(gone, F.lit(False)))
        if since is not None:
            rows = rows.where(at.isNull() | (at >= F.lit(since)))
        kept = {*self.keys, self.sequence, GONE}
        rows = rows.select(*[F.col(f"`{c}`") if c in kept else F.when(~F.col(GONE), F.col(f"`{c}`")).alias(c) for c in rows.columns])
        rows = newest(rows.withColumn(BUCKET, self.bucket), self.keys, self.sequence, self.deletes)
        # the changes are fixed before their buckets are looked up: worked out twice they might differ
        rows.write.mode("overwrite").parquet(f"{self.path}/_changes")
        rows = self.spark.read.schema(rows.schema).parquet(f"{self.path}/_changes")
        old = self._stored()
        touched = [r[0] for r in rows.select(BUCKET).distinct().collect()]  # buckets: as many as the table is laid out in
        if not touched:
            return 0
        if old is not None:
            rows = rows.unionByName(old.where(F.col(BUCKET).isin(touched)))
        rows = newest(rows.repartition(BUCKET), self.keys, self.sequence, self.deletes, [BUCKET])
        if since is not None:
            rows = rows.where(~F.col(GONE) | at.isNull() | (at >= F.lit(since)))
        rows.write.mode("overwrite").parquet(f"{self.path}/_checked")
        live = self.spark.read.parquet(f"{self.path}/_checked").where(~F.col(GONE)).drop(GONE, BUCKET)
        for check in asserts:
            check(live)
        fs, at = self._fs(f"{self.path}/_checked")
        fs.rename(at, self._fs(self.pending)[1])
        self._finish()
        return len(touched)

    def delete(self, keys: DataFrame, sequence) -> int:
        """Keys deleted as of a sequence value."""
        old = self._stored()
        if old is None:
            return 0
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in old.schema.fields if f.name not in (*self.keys, self.sequence, GONE, BUCKET)]
        gone = keys.select(*self.keys, F.lit(sequence).cast(old.schema[self.sequence].dataType).alias(self.sequence), *empty)
        return self.merge(gone, F.lit(True))

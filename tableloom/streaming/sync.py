"""Incremental synchronisation: bookmarks, soft deletes, key reconciliation and ticks.

A sync saves two things after it has committed, never before: the bookmark (up to where changes were read) and the
list of keys that the target should have. Both are tables, compared by joins.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import BuildError
from ..operators.schemas import stable_hash
from ..sources.keyed import GONE, KeyedTable, newest
from ..sources.sinks import VersionedTable, deleted, last_wins, upserted

OVERLAP = dt.timedelta(seconds=300)


class SyncStopped(RuntimeError):
    """A sync that would do harm and was stopped before it wrote anything."""


def changed_since(df: DataFrame, column: str, bookmark: dt.datetime | None) -> DataFrame:
    """Rows at or after the bookmark, and rows without a time; without a bookmark all rows."""
    if bookmark is None:
        return df
    c = F.col(f"`{column}`")
    return df.where((c >= F.lit(bookmark)) | c.isNull())


def next_bookmark(seen: dt.datetime | None, clock: dt.datetime, saved: dt.datetime | None, mode: str,
                  took: dt.timedelta = dt.timedelta(0), overlap: dt.timedelta = OVERLAP) -> dt.datetime | None:
    """The earlier of the latest time seen and the source's clock, less an overlap that covers the run itself."""
    back = max(overlap, took + dt.timedelta(seconds=60))
    if seen is None:
        return clock - back if mode == "replace" else saved
    return min(seen, clock) - back


def bookmark_report(df: DataFrame, column: str, clock: dt.datetime) -> dict:
    """Rows without a time, the latest time, and whether it lies ahead of the clock."""
    c = F.col(f"`{column}`")
    row = df.agg(F.count_if(c.isNull()).alias("nulls"), F.max(c).alias("latest"),
                 F.count_if(c > F.lit(clock)).alias("ahead")).first()
    return {"nulls": row["nulls"], "latest": row["latest"], "ahead": row["ahead"] > 0}


@dataclass(frozen=True)
class Bookmark:
    """A saved position; it holds only for the job it was saved by."""

    fingerprint: str
    time: dt.datetime

    def time_for(self, job: dict) -> dt.datetime | None:
        """The position, or None (read everything) for a job that has changed."""
        return self.time if stable_hash(job) == self.fingerprint else None


def split_soft_deletes(df: DataFrame, flag: str) -> tuple[DataFrame, DataFrame]:
    """(live rows, deleted rows) without the flag; a null flag counts as live."""
    gone = F.coalesce(F.col(f"`{flag}`"), F.lit(False))
    return df.where(~gone).drop(flag), df.where(gone).drop(flag)


def usable_keys(df: DataFrame, keys: Sequence[str], policy: str = "stop") -> DataFrame:
    """Rows whose keys are neither null nor empty; others stop the sync or are skipped."""
    bad = reduce(lambda a, b: a | b, [
        F.col(f"`{k}`").isNull() | (F.col(f"`{k}`").cast("string") == "") for k in keys])
    if policy == "stop":
        n = df.where(bad).count()
        if n:
            raise SyncStopped(f"{n} rows without a key")
        return df
    if policy != "skip":
        raise BuildError(f"no policy {policy!r}")
    return df.where(~bad)


def refuse_empty_replace(df: DataFrame, allow: bool = False) -> None:
    if not allow and df.isEmpty():
        raise SyncStopped("an empty table would replace the target")


@dataclass
class Reconciliation:
    """Keys to delete, the new list of keys, and how many scanned keys were repeated."""

    deletes: DataFrame
    keys: DataFrame
    repeated: DataFrame

    def guard(self, saved: DataFrame, scan: DataFrame, most_percent: float = 20.0) -> int:
        """The number of deletes, or a stop: for an empty scan, or more deletes than allowed."""
        n, before = self.deletes.count(), saved.count()
        if scan.isEmpty():
            raise SyncStopped("the scan found no keys")
        if before and 100.0 * n / before > most_percent:
            raise SyncStopped(f"{n} of {before} keys would be deleted")
        return n


def reconcile(saved: DataFrame, scan: DataFrame, upserts: DataFrame, keys: Sequence[str]) -> Reconciliation:
    """deletes = saved - (scan or upserts); new list = scan or upserts. Keys meet by hash, in one shuffle each."""
    keys = list(keys)
    now = scan.select(*keys).unionByName(upserts.select(*keys)).distinct()
    repeated = scan.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))
    return Reconciliation(saved.select(*keys).distinct().join(now, keys, "left_anti"), now, repeated)


def rebuilt_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The list of keys after a replacement."""
    return df.select(*keys).distinct()


def added_keys(saved: DataFrame, upserts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return saved.select(*keys).unionByName(upserts.select(*keys)).distinct()


def collapse(changes: DataFrame, keys: Sequence[str], sequence: str, operation: str = "op") -> tuple[DataFrame, DataFrame]:
    """(upserts, deletes) of a tick: of each key only its last state counts, and a key that was deleted in the tick
    is only deleted, whatever else happened to it. ``operation`` is ``delete`` for deletes."""
    gone = changes.where(F.col(operation) == "delete").select(*keys).distinct()
    rest = changes.where(F.coalesce(F.col(operation) != "delete", F.lit(True)))
    live = last_wins(rest.join(gone, list(keys), "left_anti"), keys, sequence)
    return live.select(*[F.col(f"`{c}`") for c in changes.columns if c not in (operation,)]), gone


def once_per(ledger: DataFrame, events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Events that the ledger has no row for, one per key: what to append."""
    return events.dropDuplicates(list(keys)).join(ledger.select(*keys), list(keys), "left_anti")


def replace_table(table: VersionedTable, df: DataFrame, run_id: str, keys: Sequence[str], flag: str | None = None,
                  allow_empty: bool = False, allow_shrink: bool = False) -> int:
    """Whole-table mode."""
    if flag:
        df = split_soft_deletes(df, flag)[0]
    df = usable_keys(df, keys)
    refuse_empty_replace(df, allow_empty)
    return table.replace(df, run_id, keys, allow_shrink=allow_shrink)


def upsert_delta(table: VersionedTable, df: DataFrame, run_id: str, keys: Sequence[str], sequence: str,
                 bookmark: dt.datetime | None = None, flag: str | None = None) -> int:
    """Delta mode: rows since the bookmark, soft deletes applied, in one commit. A row that is older than what the table
    has of its key changes nothing; one without a time was read now, and counts as newer."""
    if table.has_run(run_id):
        return table.version
    rows = usable_keys(changed_since(df, sequence, bookmark), keys)
    rows = last_wins(rows, keys, sequence)
    base, old = table.version, table.read()
    if old is not None:
        have = old.select(*keys, F.col(f"`{sequence}`").alias("_stored"))
        newer = F.col("_stored").isNull() | F.col(f"`{sequence}`").isNull() | (F.col(f"`{sequence}`") >= F.col("_stored"))
        rows = rows.join(have, list(keys), "left").where(newer).select(*[F.col(f"`{c}`") for c in rows.columns])
    live, gone = split_soft_deletes(rows, flag) if flag else (rows, None)
    new = live if old is None else upserted(old, live, keys)
    return table.commit(new if gone is None else deleted(new, gone, keys), run_id, (), base)


def tick(table: VersionedTable | KeyedTable, changes: DataFrame, batch_id: int, keys: Sequence[str], sequence: str,
         operation: str = "op", since=None) -> None:
    """One micro-batch merged with what the table has: of each key the greatest state stays, and a deleted key stays
    deleted (in a ``KeyedTable`` as it was made), so the table is the same for any order and split of the changes. A
    batch that comes again, or has no rows, changes nothing. ``since`` is as in ``KeyedTable.merge``."""
    if changes.isEmpty():
        return
    gone = F.col(f"`{operation}`").eqNullSafe("delete")
    if isinstance(table, KeyedTable):
        table.merge(changes.withColumn(GONE, gone).drop(operation), F.col(GONE), since)
        return
    run_id = f"batch-{batch_id}"
    if table.has_run(run_id):
        return
    rows = changes.withColumn(GONE, gone).drop(operation)
    base, old = table.version, table.stored()
    if old is not None:
        rows = rows.unionByName(old if GONE in old.columns else old.withColumn(GONE, F.lit(False)))
    table.commit(newest(rows, keys, sequence), run_id, (), base)
    table.drop_versions()


def stream_into(changes: DataFrame, table: VersionedTable | KeyedTable, checkpoint: str, keys: Sequence[str], sequence: str,
                operation: str = "op"):
    """A running query that applies a stream of changes, tick by tick, until it has read all there is."""
    return (
        changes.writeStream.foreachBatch(lambda df, n: tick(table, df, n, keys, sequence, operation))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


# --- key lists in buckets -----------------------------------------------------------------------------------------------


def saved_keys(df: DataFrame, keys: Sequence[str], table: str, buckets: int, path: str) -> DataFrame:
    """The distinct keys of ``df`` as a table in ``buckets`` sorted buckets. Reconciliations read it in place: choose at
    least as many buckets as the session has shuffle partitions, or Spark deals it anew."""
    df.sparkSession.sql(f"DROP TABLE IF EXISTS `{table}`")
    rows = df.select(*keys).distinct().repartition(buckets, *keys)
    rows.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table)


def reconcile_saved(saved: DataFrame, scan: DataFrame, upserts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of each key of either side its state: ``delete`` if only the saved list has it, ``add`` if it is new, else
    ``keep``. One join; the saved list, in buckets, stays where it is, and the keys that were seen are dealt to it."""
    keys = list(keys)
    now = scan.select(*keys).unionByName(upserts.select(*keys)).distinct().withColumn("_now", F.lit(True))
    both = saved.select(*keys).withColumn("_saved", F.lit(True)).hint("merge").join(now, keys, "full")
    state = F.when(F.col("_now").isNull(), "delete").when(F.col("_saved").isNull(), "add").otherwise("keep")
    return both.select(*keys, state.alias("state"))

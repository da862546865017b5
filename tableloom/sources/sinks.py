"""Writing tables: versions behind a pointer, staged and asserted; upserts, deletes, quarantine and delivery.

Plain Parquet has no transactions, so a ``VersionedTable`` is a folder of versions; readers see the version that the
newest pointer file names. Putting the pointer in its place is the only step that publishes, so a run that dies at any
moment leaves the table as it was and in nobody's way, and a run that is repeated under its run id changes nothing. It is
meant for tables that are replaced whole; for changes by key see ``keyed.KeyedTable``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import BuildError
from ..operators import quality
from .keyed import GONE
from .staging import new_folder


def last_wins(df: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """One row per key, that with the largest sequence value: rows have no order of their own."""
    if sequence not in df.columns:
        raise BuildError(f"last-one-wins needs the sequence column {sequence}")
    rest = [F.col(f"`{c}`").desc_nulls_last() for c in df.columns if c not in (*keys, sequence)]
    w = Window.partitionBy(*keys).orderBy(F.col(f"`{sequence}`").desc_nulls_last(), *rest)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upserted(target: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The target with the rows of ``changes`` in place of its rows with their keys. Where the keys are all columns,
    present rows stay as they are."""
    if set(keys) == set(target.columns):
        return target.unionByName(changes.join(target.select(*keys), list(keys), "left_anti").select(*target.columns))
    return target.join(changes.select(*keys), list(keys), "left_anti").select(*target.columns).unionByName(
        changes.select(*target.columns))


def deleted(target: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return target.join(gone.select(*keys), list(keys), "left_anti").select(*target.columns)


class VersionedTable:
    """A table of Parquet versions with atomic commits and an optional quarantine beside it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _pointers(self) -> list[tuple[int, str]]:
        """(version, run id) of what was published, in order."""
        fs, path = self._fs()
        folder = path(f"{self.path}/_commits")
        if not fs.exists(folder):
            return []
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString
        found = []
        for s in fs.listStatus(folder):
            if s.getPath().getName().isdigit():
                stream = fs.open(s.getPath())
                found.append((int(s.getPath().getName()), text(stream, "UTF-8")))
                stream.close()
        return sorted(found)

    def _publish(self, v: int, run_id: str) -> None:
        """The pointer, written aside and moved to its place, which fails if another run has a pointer there."""
        fs, path = self._fs()
        aside = path(f"{self.path}/_commits/_{v}-{run_id}-{uuid.uuid4().hex}")
        stream = fs.create(aside)
        stream.write(bytearray(run_id, "utf-8"))
        stream.close()
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration())
        keep_target = self.spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(fs.makeQualified(aside), fs.makeQualified(path(f"{self.path}/_commits/{v:012d}")), keep_target)
        except Exception:
            fs.delete(aside, False)
            raise

    @property
    def version(self) -> int:
        found = self._pointers()
        return found[-1][0] if found else 0

    def has_run(self, run_id: str) -> bool:
        return any(r == run_id for _, r in self._pointers())

    def stored(self) -> DataFrame | None:
        """The current rows, and tombstones if a tick left any; None before the first commit."""
        found = self._pointers()
        return self.spark.read.parquet(f"{self.path}/v={found[-1][0]}-{found[-1][1]}") if found else None

    def read(self) -> DataFrame | None:
        """The current rows; None before the first commit."""
        rows = self.stored()
        return rows if rows is None or GONE not in rows.columns else rows.where(~F.col(GONE)).drop(GONE)

    def commit(self, df: DataFrame, run_id: str, asserts: Sequence[Callable[[DataFrame], None]] = (),
               base: int | None = None) -> int:
        """Writes a new version, checks it as it was written, and publishes it. A run id commits once. ``base`` is the
        version that ``df`` was made of (else the one now); if another run has published since, this one fails."""
        if self.has_run(run_id):
            return self.version
        base = self.version if base is None else base
        v = base + 1
        fs, path = self._fs()
        target = f"{self.path}/v={v}-{run_id}"
        df.write.mode("overwrite").parquet(target)
        try:
            written = self.spark.read.parquet(target)
            for check in asserts:
                check(written)
        except Exception:
            fs.delete(path(target), True)
            raise
        fs.mkdirs(path(f"{self.path}/_commits"))
        self._publish(v, run_id)
        return v

    def replace(self, df: DataFrame, run_id: str, keys: Sequence[str] = (), least: float = 0.5,
                allow_shrink: bool = False) -> int:
        base, old = self.version, self.read()
        before = old.count() if old is not None else 0
        checks = [lambda d: quality.assert_no_shrink(d.count(), before, least, allow_shrink)]
        if keys:
            checks.append(lambda d: quality.assert_keys(d, keys))
        return self.commit(df, run_id, checks, base)

    def upsert(self, changes: DataFrame, run_id: str, keys: Sequence[str], sequence: str | None = None) -> int:
        if sequence is not None:
            changes = last_wins(changes, keys, sequence)
        base, old = self.version, self.read()
        return self.commit(changes if old is None else upserted(old, changes, keys), run_id,
                           [lambda d: quality.assert_keys(d, keys)], base)

    def delete(self, gone: DataFrame, run_id: str, keys: Sequence[str]) -> int:
        base, old = self.version, self.read()
        return self.version if old is None else self.commit(deleted(old, gone, keys), run_id, (), base)

    def drop_versions(self, keep: int = 2) -> None:
        """Deletes the rows of all but the newest ``keep`` versions; their pointers stay, so runs still commit once."""
        fs, path = self._fs()
        for v, run_id in self._pointers()[:-keep]:
            fs.delete(path(f"{self.path}/v={v}-{run_id}"), True)

    def quarantine(self, rejects: DataFrame, run_id: str, table: str, most: int | None = None) -> DataFrame:
        """Rejected rows beside the table, all of them or the first ``most``; returns them as written."""
        rows = (rejects if most is None else rejects.limit(most)).select(
            F.lit(run_id).alias("run_id"), F.lit(table).alias("dest_table"), F.col("step").alias("step_id"), "function",
            "input_value", "source_row", F.lit("open").alias("status"))
        rows.write.mode("overwrite").parquet(f"{self.path}/_quarantine/run={run_id}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/_quarantine/run={run_id}")


def write_direct(df: DataFrame, path: str, mode: str = "append", fmt: str = "parquet") -> None:
    """Without staging."""
    df.write.mode(mode).format(fmt).save(path)


def nest_columns(df: DataFrame, json_arrays: dict[str, str] | None = None) -> DataFrame:
    """Columns with dotted names as nested structs; the named JSON columns as arrays of the given type."""
    tree: dict = {}
    for name in df.columns:
        at = tree
        *parents, last = name.split(".")
        for p in parents:
            at = at.setdefault(p, {})
            if not isinstance(at, dict):
                raise BuildError(f"{name} lies under a value")
        c = F.col(f"`{name}`")
        kind = (json_arrays or {}).get(name)
        if isinstance(at.get(last), dict):
            raise BuildError(f"{name} is a value and a parent")
        at[last] = F.from_json(c, f"array<{kind}>") if kind else c

    def build(node) -> Column:
        return F.struct(*[build(v).alias(k) for k, v in node.items()]) if isinstance(node, dict) else node

    return df.select(*[build(v).alias(k) for k, v in tree.items()])


def coerce_json(df: DataFrame, target: T.StructType) -> DataFrame:
    """Structs and arrays as JSON text where the target column is JSON; elsewhere they are refused."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            if f.name not in target.names or not (target[f.name].metadata or {}).get("json"):
                raise BuildError(f"{f.name} is nested, and its target is not JSON")
            c = F.to_json(c).alias(f.name)
        out.append(c)
    return df.select(*out)


# --- delivery ----------------------------------------------------------------------------------------------------------

PART_ROWS, PART_BYTES = 50_000, 56_000_000


def assign_parts(df: DataFrame, rows: int = PART_ROWS, size: int = PART_BYTES, folder: str | None = None) -> DataFrame:
    """(partition, part, n_rows, n_bytes, body, last, total_parts): rows as JSON in parts of bounded rows and bytes.

    Parts are filled within a task in one pass, so no task holds more than a part; a row that is larger than a part
    is an error. They are written to ``folder`` (a new shared one) once and numbered as they were written; the last
    part carries the number of all parts."""
    folder = folder or new_folder(df.sparkSession, "parts")
    json_rows = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("row"),
                          F.spark_partition_id().alias("partition"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        used = part = where = 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([where], pa.int32()), pa.array([part], pa.int32()), pa.array([len(held)], pa.int64()),
                pa.array([used], pa.int64()), pa.array(["[" + ",".join(held) + "]"], pa.string())],
                ["partition", "part", "n_rows", "n_bytes", "body"])

        for batch in batches:
            for row, p in zip(batch.column(0), batch.column(1)):
                row, where = row.as_py(), p.as_py()
                n = len(row.encode("utf-8"))
                if n > size:
                    raise ValueError(f"a row of {n} bytes is larger than a part")
                if held and (len(held) == rows or used + n > size):
                    yield full()
                    held, used, part = [], 0, part + 1
                held.append(row)
                used += n
        if held:
            yield full()

    schema = "partition int, part int, n_rows bigint, n_bytes bigint, body string"
    json_rows.mapInArrow(run, schema).write.mode("overwrite").parquet(folder)
    parts = df.sparkSession.read.schema(schema).parquet(folder)
    total, end = parts.select("partition", "part").agg(
        F.count(F.lit(1)), F.max(F.struct("partition", "part"))).first()
    last = F.lit(False) if end is None else (F.col("partition") == end[0]) & (F.col("part") == end[1])
    return parts.withColumn("last", last).withColumn("total_parts", F.lit(total).cast("bigint"))


def deliver(df: DataFrame, send: Callable[[str, str], None], folder: str | None = None,
            has: Callable[[str], bool] | None = None) -> int:
    """Hands (id, body) of each part to ``send`` on the executors; returns how many parts this run handed over.

    ``folder``, in storage that is shared, holds one delivery: its parts, which are cut once, so their ids stay, and a
    ledger of the ids that went out, which is read before anything is sent. A run that is started again goes on from
    there. A task enters its parts when it ends, also where the run fails later; about parts of tasks that did not end,
    ``has`` asks the receiver whether it knows the id. Without ``has`` those may come twice, under the same id."""
    spark = df.sparkSession
    folder = folder or new_folder(spark, "delivery")
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    there = lambda name: bool(fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")))
    if not there("parts/_SUCCESS"):
        assign_parts(df, folder=f"{folder}/parts")
    parts = spark.read.parquet(f"{folder}/parts").select(
        F.concat_ws("-", F.col("partition").cast("string"), F.col("part").cast("string")).alias("id"), "body")
    if there("ledger/*.parquet"):
        parts = parts.join(spark.read.parquet(f"{folder}/ledger"), "id", "left_anti")
    left = parts.count()
    if not left:
        return 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                if has is None or not has(key):
                    send(key, body.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([key])], ["id"])

    parts.repartition(left, "id").mapInArrow(run, "id string").write.mode("append").option(
        "mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{folder}/ledger")  # a task's file stays
    return left


def write_ndjson(df: DataFrame, path: str) -> int:
    """Rows as JSON lines, and a sidecar with header and count, which comes from the same job."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(f"{path}/rows")
    n = seen.get["n"]
    spark = df.sparkSession
    spark.createDataFrame([(",".join(df.columns), n)], "columns string, row_count bigint").coalesce(1).write.mode(
        "overwrite").json(f"{path}/trailer")
    return n


def write_csv(df: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """CSV with a header, quotes doubled inside quotes, and nulls told from empty texts, in files of bounded length: one
    with quoted line breaks cannot be split when it is read."""
    df.write.mode("overwrite").options(header=True, quote='"', escape='"', quoteAll=True, nullValue="\\N", emptyValue="",
                                       ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, lineSep="\n",
                                       maxRecordsPerFile=rows_per_file).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What ``write_csv`` wrote. Quoted line breaks are part of a value, so a file, which is short, is read by one task."""
    return spark.read.schema(schema).options(header=True, quote='"', escape='"', multiLine=True, nullValue="\\N", emptyValue="",
                                             lineSep="\n", maxCharsPerColumn=-1).csv(path)


#: Wire types that a source type may be delivered as (fixed values).
WIRE = {
    "text": ("Text",), "number": ("Number", "Text"), "date": ("Date", "DateTime", "Text"),
    "datetime": ("DateTime", "Date", "Text"), "boolean": ("Boolean", "Text"),
}


def plain_number(c: Column, kind: T.DataType) -> Column:
    """A number in exact plain digits: no exponent, no trailing zeros."""
    d = c if isinstance(kind, T.DecimalType) else c.cast("decimal(38,18)") if isinstance(
        kind, (T.FloatType, T.DoubleType)) else None
    if d is None:
        return c.cast("string")
    s = d.cast("string")
    s = F.when(F.contains(s, F.lit(".")), F.regexp_replace(F.regexp_replace(s, r"0+$", ""), r"\.$", "")).otherwise(s)
    return F.when(s.rlike(r"^0E-[0-9]+$"), "0").otherwise(s)


def wire_value(df: DataFrame, column: str, source: str, target: str, zone: str | None = None) -> Column:
    """A column as text for delivery. Dates are never shifted; date-times are taken from a named zone to UTC."""
    if target not in WIRE.get(source, ()):
        raise BuildError(f"{source} cannot be delivered as {target}")
    c, kind = F.col(f"`{column}`"), df.schema[column].dataType
    if source == "number":
        return plain_number(c, kind)
    if source == "boolean":
        return F.when(c, "true").when(~c, "false")
    if source == "date":
        day = F.date_format(c, "yyyy-MM-dd")
        return F.concat(day, F.lit("T00:00:00Z")) if target == "DateTime" else day
    if source == "datetime":
        if target == "Date":
            return F.date_format(c, "yyyy-MM-dd")
        if isinstance(kind, T.TimestampNTZType):
            if zone is None:
                raise BuildError(f"{column} needs a zone")
            ZoneInfo(zone)
            c = F.to_utc_timestamp(c.cast("timestamp"), zone)
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return c.cast("string")


def json_number(c: Column) -> Column:
    """A decimal as a JSON number where a double holds it exactly, else as a JSON string."""
    s = plain_number(c, T.DecimalType(38, 18))
    exact = c.cast("double").cast("decimal(38,18)") == c.cast("decimal(38,18)")
    return F.when(exact, s).otherwise(F.concat(F.lit('"'), s, F.lit('"')))



"""Reading and writing tables of databases through JDBC, in parts that hold about as many rows each.

The source does what it can: filters and columns are pushed into its queries, and each part is one range of the key, so
a read is spread over tasks and a lost one is read again. Exact types are asked for by name.
"""

from __future__ import annotations

import datetime as dt
import os
import sqlite3
import uuid
from collections.abc import Iterator, Sequence
from contextlib import closing
from dataclasses import dataclass
from decimal import Decimal
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import BuildError
from ..operators.predicates import Predicate
from .tables import exact_read, partitioned_options


def embedded_options(name: str, table: str) -> dict[str, str]:
    """Options for a table of an embedded database in this process's memory, which comes with Spark; for tests and for
    local masters, as other processes do not see it."""
    return {"url": f"jdbc:derby:memory:{name};create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver", "dbtable": table}


def create_as(df: DataFrame, options: dict[str, str], types: dict[str, str] | None = None, batch: int = 10_000) -> None:
    """A new table with the rows of ``df``, written by its tasks in batches; ``types`` are the database's names of types."""
    extra = {"createTableColumnTypes": ", ".join(f"`{c}` {t}" for c, t in types.items())} if types else {}
    df.write.format("jdbc").options(**options, **extra, batchsize=str(batch)).mode("overwrite").save()


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _literal(value) -> str:
    """A number, or a day or time in the escapes that every JDBC driver knows."""
    if isinstance(value, dt.datetime):
        return "{ts '" + value.isoformat(" ", "microseconds") + "'}"
    if isinstance(value, dt.date):
        return "{d '" + value.isoformat() + "'}"
    if isinstance(value, bool) or not isinstance(value, (int, float, Decimal)):
        raise BuildError(f"a key of {type(value).__name__} has no ranges here")
    return str(value)


def key_cuts(spark: SparkSession, options: dict[str, str], key: str, parts: int, accuracy: int = 10_000) -> list:
    """Values that cut the key into parts of about equal size: approximate quantiles. Only the key is read, in ranges
    of equal width between its least and greatest value, which the source looks up."""
    whole = spark.read.format("jdbc").options(**options)
    lo, hi, n = whole.load().agg(F.min(f"`{key}`"), F.max(f"`{key}`"), F.count(F.lit(1))).first()
    if lo is None or lo == hi or parts < 2:
        return []
    kind = whole.load().schema[key].dataType
    read = whole.load()
    if not isinstance(kind, (T.FloatType, T.DoubleType)):
        bounds = {"lowerBound": str(lo), "upperBound": str(hi)} if isinstance(lo, dt.date) else {}
        lo_, hi_ = (0, 1) if bounds else (int(lo), int(hi) + 1)
        wide = partitioned_options(options, key, lo_, hi_, min(parts, n)) | bounds
        read = spark.read.format("jdbc").options(**wide).load()
    steps = [i / parts for i in range(1, parts)]
    cuts = read.agg(F.percentile_approx(F.col(f"`{key}`"), steps, accuracy)).first()[0]
    return sorted({c for c in cuts if c > lo})


def range_predicates(key: str, cuts: Sequence) -> list[str]:
    """Conditions of ranges between cuts, open at both ends; null keys are in the first."""
    k = quoted(key)
    if not cuts:
        return ["1 = 1"]
    inner = [f"{k} >= {_literal(a)} AND {k} < {_literal(b)}" for a, b in zip(cuts, cuts[1:])]
    return [f"{k} < {_literal(cuts[0])} OR {k} IS NULL", *inner, f"{k} >= {_literal(cuts[-1])}"]


def read_by_key(spark: SparkSession, options: dict[str, str], key: str, parts: int,
                native: Sequence[tuple[str, str]] = (), cuts: Sequence | None = None) -> tuple[DataFrame, list[tuple[str, str]]]:
    """A table in ``parts`` ranges of its key that hold about as many rows each, and (name, reason) of the columns that
    are not read. ``native`` gives the source's types of columns that must not pass through a binary float."""
    schema, left_out = exact_read(native)
    cuts = key_cuts(spark, options, key, parts) if cuts is None else cuts
    rest = {k: v for k, v in options.items() if k not in ("url", "dbtable")}
    if schema:
        rest["customSchema"] = schema
    df = spark.read.jdbc(options["url"], options["dbtable"], predicates=range_predicates(key, cuts), properties=rest)
    return df.drop(*[n for n, _ in left_out]), left_out


# --- database files that a cluster shares ----------------------------------------------------------------------------

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_AS_TEXT = (T.StringType, T.BooleanType, T.DecimalType, T.FloatType, T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType)
_OPERATORS = {"eq": "=", "neq": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}
BATCH = 10_000


@dataclass(frozen=True)
class DatabaseFiles:
    """A table in SQLite files, one for each task that wrote it, in a folder that driver and executors share. Integers
    are integers there, everything else is Spark's text of it, so that decimals keep all their digits."""

    files: tuple[str, ...]
    table: str
    key: str
    schema: T.StructType


def _create_file(batches: Iterator[pa.RecordBatch], folder: str, table: str, key: str, integers: list[bool]) -> Iterator[pa.RecordBatch]:
    """The rows of a task as one file; its name is handed on when it is complete, so a task that dies leaves none."""
    path, n = f"{folder}/{uuid.uuid4().hex}.db", 0
    with closing(sqlite3.connect(path, isolation_level=None)) as db:
        db.execute("PRAGMA journal_mode = OFF")
        db.execute("PRAGMA synchronous = OFF")
        for batch in batches:
            if not n:
                columns = ", ".join(f"{quoted(c)} {'INTEGER' if i else 'TEXT'}" for c, i in zip(batch.schema.names, integers))
                db.execute(f"CREATE TABLE IF NOT EXISTS {quoted(table)} ({columns})")
                db.execute("BEGIN")
            marks = ", ".join("?" * batch.num_columns)
            db.executemany(f"INSERT INTO {quoted(table)} VALUES ({marks})", zip(*[c.to_pylist() for c in batch.columns]))
            n += batch.num_rows
            db.execute("COMMIT")
            db.execute("BEGIN")
        if n:
            db.execute(f"CREATE INDEX {quoted('by ' + key)} ON {quoted(table)} ({quoted(key)})")
            db.execute("COMMIT")
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([path])], ["file"])
    else:
        os.remove(path)


def create_files(df: DataFrame, folder: str, table: str, key: str) -> DatabaseFiles:
    """A new table with the rows of ``df`` in files of an embedded database, each written by one task, in order of the
    key and with an index on it. ``folder`` is a ``file:`` address or a path that every executor sees."""
    where = urlparse(folder)
    if where.scheme not in ("", "file"):
        raise BuildError(f"an embedded database has its files in a shared folder of the file system, not at {folder}")
    if not isinstance(df.schema[key].dataType, _INTEGERS):
        raise BuildError("the key of database files is an integer")
    for f in df.schema.fields:
        if not isinstance(f.dataType, (*_INTEGERS, *_AS_TEXT)):
            raise BuildError(f"{f.name} of type {f.dataType.simpleString()} has no column in database files")
    path = unquote(where.path)
    os.makedirs(path, exist_ok=True)
    integers = [isinstance(f.dataType, _INTEGERS) for f in df.schema.fields]
    plain = df.sortWithinPartitions(key).select(
        *[F.col(f"`{f.name}`").cast("bigint" if i else "string").alias(f.name) for f, i in zip(df.schema.fields, integers)])
    made = plain.mapInArrow(lambda batches: _create_file(batches, path, table, key, integers), "file string")
    return DatabaseFiles(tuple(r[0] for r in made.collect()), table, key, df.schema)  # one name a task


def _rows_of(files: Sequence[str], sql: str, values: Sequence, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for file in files:
        with closing(sqlite3.connect(f"file:{file}?mode=ro&immutable=1", uri=True)) as db:
            cursor = db.execute(sql, values)
            while rows := cursor.fetchmany(BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema.names)


def _pushed(predicates: Sequence[Predicate], schema: T.StructType) -> tuple[list[str], list]:
    """Conditions on integers and texts for the database's own filter, with their values."""
    parts, values = [], []
    for p in predicates:
        kind = schema[p.column].dataType
        fits = isinstance(kind, _INTEGERS) and type(p.value) is int or type(kind) is T.StringType and isinstance(p.value, str)
        if p.op not in _OPERATORS or p.ignore_case or not fits:
            raise BuildError(f"{p.op} on {p.column} is no filter of database files")
        parts.append(f"{quoted(p.column)} {_OPERATORS[p.op]} ?")
        values.append(p.value)
    return parts, values


def file_cuts(spark: SparkSession, source: DatabaseFiles, parts: int, accuracy: int = 10_000) -> list[int]:
    """Values that cut the key into parts of about equal size: approximate quantiles. Only the key is read, a file a task."""
    if not source.files or parts < 2:
        return []
    sql, names = f"SELECT {quoted(source.key)} FROM {quoted(source.table)}", source.files
    kind = pa.schema([("k", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _rows_of([names[i] for i in batch.column(0).to_pylist()], sql, (), kind)

    keys = spark.range(0, len(names), 1, len(names)).mapInArrow(run, "k bigint")
    found = keys.agg(F.min("k"), F.percentile_approx("k", [i / parts for i in range(1, parts)], accuracy)).first()
    return sorted({c for c in found[1] or [] if c > found[0]})


def read_files_by_key(spark: SparkSession, source: DatabaseFiles, parts: int, predicates: Sequence[Predicate] = (),
                      cuts: Sequence[int] | None = None) -> DataFrame:
    """The table in ``parts`` ranges of its key that hold about as many rows each, a task a range. The database looks the
    range up by its index and applies ``predicates``, so only their rows leave it."""
    ranges = range_predicates(source.key, file_cuts(spark, source, parts) if cuts is None else cuts)
    tests, values = _pushed(predicates, source.schema)
    fields = source.schema.fields
    columns = ", ".join(quoted(f.name) for f in fields)
    integers = [isinstance(f.dataType, _INTEGERS) for f in fields]
    sqls = [f"SELECT {columns} FROM {quoted(source.table)} WHERE " + " AND ".join(f"({t})" for t in (r, *tests)) for r in ranges]
    names = source.files
    kind = pa.schema([(f"c{i}", pa.int64() if whole else pa.string()) for i, whole in enumerate(integers)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield from _rows_of(names, sqls[i], values, kind)

    rows = spark.range(0, len(sqls), 1, len(sqls)).mapInArrow(
        run, ", ".join(f"c{i} {'bigint' if whole else 'string'}" for i, whole in enumerate(integers)))
    return rows.select(*[F.col(f"c{i}").cast(f.dataType).alias(f.name) for i, f in enumerate(fields)])

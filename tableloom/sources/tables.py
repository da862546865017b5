"""Reading tables: scans, keyed and partitioned reads, documents, samples and catalogs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import BuildError
from ..operators.predicates import Predicate, where_all


def scan(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """All columns of a stored table; Spark prunes what is not used."""
    return spark.read.format(fmt).options(**options).load(path)


#: JDBC URL patterns and drivers by connector (fixed values).
CONNECTORS = {
    "mysql": ("jdbc:mysql://{host}:{port}/{database}", "com.mysql.cj.jdbc.Driver", 3306),
    "postgres": ("jdbc:postgresql://{host}:{port}/{database}", "org.postgresql.Driver", 5432),
    "supabase": ("jdbc:postgresql://{host}:{port}/{database}?sslmode=require", "org.postgresql.Driver", 5432),
    "sqlserver": ("jdbc:sqlserver://{host}:{port};databaseName={database}",
                  "com.microsoft.sqlserver.jdbc.SQLServerDriver", 1433),
}


def jdbc_options(connector: str, host: str, database: str, table: str, user: str, password: str,
                 port: int | None = None, fetch_size: int = 10_000) -> dict[str, str]:
    """Options of ``spark.read.format("jdbc")`` for a connector."""
    if connector not in CONNECTORS:
        raise BuildError(f"no connector {connector!r}")
    url, driver, usual = CONNECTORS[connector]
    return {"url": url.format(host=host, port=port or usual, database=database), "driver": driver, "dbtable": table,
            "user": user, "password": password, "fetchsize": str(fetch_size), "pushDownAggregate": "true"}


def mongo_options(host: str, database: str, collection: str, port: int = 27017) -> dict[str, str]:
    """Options of the MongoDB Spark connector (``format("mongodb")``)."""
    return {"connection.uri": f"mongodb://{host}:{port}", "database": database, "collection": collection}


def partitioned_options(options: dict[str, str], column: str, lower: int, upper: int, parts: int) -> dict[str, str]:
    """A JDBC read split by ranges of a numeric key, in place of paging by key."""
    if upper <= lower or parts < 1:
        raise BuildError("a partitioned read needs lower < upper and parts >= 1")
    return options | {"partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper),
                      "numPartitions": str(parts)}


def in_ranges(df: DataFrame, key: str, lower: int, upper: int, parts: int, output: str = "part") -> DataFrame:
    """Rows with the number of the range of a keyed read that would bring them: ranges of equal width from ``lower`` to
    ``upper``, open at both ends; null keys are in the first."""
    if upper <= lower or parts < 1:
        raise BuildError("a partitioned read needs lower < upper and parts >= 1")
    stride = max(1, (upper - lower) // parts)
    at = F.floor((F.col(f"`{key}`") - F.lit(lower)) / F.lit(stride))
    return df.withColumn(output, F.coalesce(F.least(F.greatest(at, F.lit(0)), F.lit(parts - 1)), F.lit(0)).cast("int"))


#: SQL Server types that must not pass through a binary float, and those that are not read (fixed values).
EXACT = {"money": "DECIMAL(19,4)", "smallmoney": "DECIMAL(10,4)", "bigint": "BIGINT", "datetime2": "TIMESTAMP_NTZ"}
NOT_READ = {"geometry": "spatial", "geography": "spatial", "hierarchyid": "hierarchy", "image": "binary",
            "varbinary": "binary", "binary": "binary", "timestamp": "row version", "rowversion": "row version",
            "sql_variant": "mixed types"}


def exact_read(columns: Sequence[tuple[str, str]]) -> tuple[str, list[tuple[str, str]]]:
    """From (name, native type) the ``customSchema`` of a JDBC read without float loss, and (name, reason) of the
    columns that are left out."""
    schema, left_out = [], []
    for name, native in columns:
        base = native.split("(")[0].lower()
        if base in NOT_READ:
            left_out.append((name, NOT_READ[base]))
        elif base in ("decimal", "numeric"):
            inner = native[native.find("("):] if "(" in native else "(38,18)"
            schema.append(f"`{name}` DECIMAL{inner}")
        elif base in EXACT:
            schema.append(f"`{name}` {EXACT[base]}")
    return ", ".join(schema), left_out


def after_key(keys: Sequence[str], cursor: Sequence) -> Column:
    """Rows after a composite key in ascending order, nulls first: an OR of ANDs that sources can evaluate."""
    if len(keys) != len(cursor):
        raise BuildError("a cursor has a value for each key")

    def greater(k: str, v) -> Column:
        return F.col(f"`{k}`").isNotNull() if v is None else F.col(f"`{k}`") > F.lit(v)

    alternatives = []
    for i in range(len(keys)):
        equal = [F.col(f"`{k}`").eqNullSafe(F.lit(v)) for k, v in zip(keys[:i], cursor[:i])]
        alternatives.append(reduce(lambda a, b: a & b, [*equal, greater(keys[i], cursor[i])]))
    return reduce(lambda a, b: a | b, alternatives)


def page_after(df: DataFrame, keys: Sequence[str], cursor: Sequence | None, limit: int) -> DataFrame:
    """The next rows in order of key."""
    rows = df if cursor is None else df.where(after_key(keys, cursor))
    return rows.orderBy(*[F.col(f"`{k}`").asc_nulls_first() for k in keys]).limit(limit)


def read_request(df: DataFrame, columns: Sequence[str], predicates: Sequence[Predicate] = (),
                 cursor: tuple[Sequence[str], Sequence] | None = None, limit: int | None = None) -> DataFrame:
    """A checked read: unknown columns are refused, the rest is select, filter, order and limit."""
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise BuildError(f"no column {', '.join(unknown)}")
    out = where_all(df, predicates)
    if cursor is not None:
        out = out.where(after_key(*cursor)).orderBy(*[F.col(f"`{k}`").asc_nulls_first() for k in cursor[0]])
    out = out.select(*[F.col(f"`{c}`") for c in columns])
    return out if limit is None else out.limit(limit)


def flatten_documents(df: DataFrame) -> DataFrame:
    """Nested documents as flat columns with dotted names; arrays become JSON text. A name that has a dot itself is
    not taken apart: its value becomes JSON, marked ``degraded``."""
    out: list[Column] = []

    def walk(c: Column, kind: T.DataType, name: str) -> None:
        if isinstance(kind, T.StructType):
            if any("." in f.name for f in kind.fields):
                out.append(F.to_json(c).alias(name, metadata={"json": True, "degraded": True}))
                return
            for f in kind.fields:
                walk(c.getField(f.name), f.dataType, f"{name}.{f.name}")
        elif isinstance(kind, (T.ArrayType, T.MapType)):
            out.append(F.to_json(c).alias(name, metadata={"json": True}))
        else:
            out.append(c.alias(name))

    for f in df.schema.fields:
        walk(F.col(f"`{f.name}`"), f.dataType, f.name)
    return df.select(*out)


def catalog(spark: SparkSession, database: str | None = None) -> DataFrame:
    """(table, column, type, nullable) of the catalog's tables."""
    rows = [(t.name, c.name, c.dataType, c.nullable) for t in spark.catalog.listTables(database)
            for c in spark.catalog.listColumns(t.name, database if not t.isTemporary else None)]
    return spark.createDataFrame(rows, "table string, column string, type string, nullable boolean")


def describe(df: DataFrame, table: str) -> DataFrame:
    """The same for one table by its schema."""
    rows = [(table, f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "table string, column string, type string, nullable boolean")


def head_tail_sample(df: DataFrame, key: str | None, n: int) -> tuple[DataFrame, str]:
    """The first and last ``n`` rows by key, and how they were taken: ``head-tail``, ``full-table`` for a table
    that is no larger, ``no-key-scan`` without a key."""
    if key is None:
        return df.limit(2 * n), "no-key-scan"
    if df.limit(2 * n + 1).count() <= 2 * n:
        return df, "full-table"
    k = F.col(f"`{key}`")
    both = df.orderBy(k.asc_nulls_first()).limit(n).unionByName(df.orderBy(k.desc_nulls_last()).limit(n))
    return both.dropDuplicates([key]), "head-tail"


def keyed_sample(df: DataFrame, key: str, fraction: float, seed: int = 7) -> DataFrame:
    """Rows whose key's hash falls under the fraction: the same rows on every run and however the table is split."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))))
    return df.where(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") < F.lit(int(fraction * (1 << 32))))


def random_sample(df: DataFrame, fraction: float, seed: int = 7) -> DataFrame:
    return df.sample(fraction=fraction, seed=seed)

"""Helpers that several operators use: tables staged in the cluster's shared folder, rows packed into one column, and
connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import shared_folder

_made: list[str] = []


def staged(df: DataFrame, name: str, plain: bool = False) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: its lineage is cut and survives lost executors.

    ``plain`` is for narrow tables of numbers that are joined: Spark takes the size of the files for that of the rows
    when it decides what to broadcast through the driver, and ids that repeat may shrink fiftyfold in files. Plain values
    are as large in files as in rows."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    how = {"compression": "uncompressed", "parquet.enable.dictionary": "false"} if plain else {}
    df.write.options(**how).parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in the list of staged tables, for ``release``."""
    return len(_made)


def release(spark: SparkSession, since: int, until: int | None = None) -> None:
    """Deletes the tables staged between two marks. Call it when what was made of them has been written."""
    for path in _made[since:until]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    del _made[since:until]


def packed(docs: DataFrame, **computed: str | Column) -> DataFrame:
    """Each row of ``docs`` in one struct ``row``, beside computed columns: names of the input meet no name of an
    operator. ``unpacked`` gives the rows back."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(whole, *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in computed.items()])


def unpacked(rows: DataFrame, columns: list[str], **more: Column) -> DataFrame:
    """The ``columns`` of packed rows in order; ``more`` replaces columns of that name or follows."""
    field = lambda c: more[c].alias(c) if c in more else F.col("row").getField(c).alias(c)
    return rows.select(*[field(c) for c in columns], *[v.alias(c) for c, v in more.items() if c not in columns])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph given as edges of bigint nodes.

    Returns (node, component) for every node that has an edge; component is the smallest node reachable.
    Each round hooks every node to its least neighbour, jumps to the neighbour's own hook and contracts the graph;
    nothing is collected. Least is meant in the order of a hash, so that ascending chains shrink as fast as others: a
    chain of 10,000 nodes takes about ten rounds, a star two."""
    spark = edges.sparkSession
    start = mark()
    cur = staged(
        edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct(), "edges",
        plain=True,
    )
    rounds: list[DataFrame] = []
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    while not cur.isEmpty():
        both = cur.select(F.col("b").alias("node"), F.col("a").alias("to")).unionByName(
            cur.select(F.col("a").alias("node"), F.col("b").alias("to"))
        )
        hook = both.groupBy("node").agg(F.min(order("to")).alias("o")).select(
            "node", F.least(order("node"), F.col("o")).getField("v").alias("parent"))
        up = hook.select(F.col("node").alias("parent"), F.col("parent").alias("up"))
        parent = staged(hook.join(up, "parent").select("node", F.col("up").alias("parent")), "parents", plain=True)
        rounds.append(parent)
        pa = parent.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        pb = parent.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        cur = staged(
            cur.join(pa, "a")
            .join(pb, "b")
            .where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .distinct(),
            "edges",
            plain=True,
        )
    if not rounds:
        return spark.createDataFrame([], "node bigint, component bigint")
    found = rounds[-1].select("node", F.col("parent").alias("root"))
    for parent in reversed(rounds[:-1]):
        nxt = found.select(F.col("node").alias("parent"), F.col("root"))
        found = (
            parent.join(nxt, "parent", "left")
            .select("node", F.coalesce("root", "parent").alias("root"))
        )
    found = staged(found, "roots", plain=True)
    least = found.groupBy("root").agg(F.min("node").alias("component"))
    end = mark()
    out = staged(found.join(least, "root").select("node", "component"), "components", plain=True)
    release(spark, start, end)
    return out

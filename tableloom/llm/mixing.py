"""Mixing sources to target weights by systematic sampling.

Each source has a target in words; a document's expected number of copies is target / size of its source.
Documents of a source are put in order, their expected copies are summed up from the first (a prefix sum), one
random offset in [0, 1) per source is added, and a document is taken once for each whole number that its stretch
of the sum crosses. Ordering by size makes this a sample stratified by size, so the taken words differ from the
target by about one large document.

The prefix sum is distributed: rows are dealt by ranges of (source, order), each range is summed, the ranges'
sums are scanned (one row per source and range), and rows are numbered within their range. A source that holds
most rows is spread over many ranges.

Defined cases: a null text has size 0; a null source is a source of its own, ordered last; documents of size 0
are sampled as any other and add nothing; repeated rows are separate documents; an empty table gives an empty
result; texts of any length count by their words and are joined back whole; ties in size are ordered by id; extra
columns of any name stay as they are in ``mix_documents`` and are not read by the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import packed, staged, unpacked

#: A word, as all operators of this subpackage count words.
WORD = r"[^\x20\x09-\x0D]+"
#: No document is taken more often than this.
MOST_COPIES = 3.0


def word_count(text: str | Column = "text") -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered_sources(sizes: DataFrame) -> DataFrame:
    """``sizes`` with the place of each source in code-point order, null last. Sources are dealt by ranges; only the
    ranges' counts (one row a range) go through the driver."""
    parts = max(1, int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = F.col("source").asc_nulls_last()
    ranged = sizes.repartitionByRange(parts, order).sortWithinPartitions(order)
    ranged = staged(ranged.withColumn("id", F.monotonically_increasing_id()), "sources")
    part, place = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted(ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = {}, 0
    for r in counts:
        before[r["part"]] = total
        total += r["n"]
    start = F.map_from_arrays(F.array(*[F.lit(int(k)) for k in before]), F.array(*[F.lit(v) for v in before.values()])
                              ) if before else F.create_map(F.lit(0), F.lit(0))
    return ranged.withColumn("number", start[part] + place).drop("id")


def mixture_targets(sizes: DataFrame, most: float = MOST_COPIES) -> DataFrame:
    """Targets of sources: from (source, source_size) to (source, source_size, weight, target).

    Weights are 1, 2, 3, 1, 2, 3, ... over the sources in order. The targets share the total of all sizes by
    weight; none exceeds ``most`` times its source's size, and what it leaves goes to the others by weight.
    This is water filling: the level (target by weight) of those that are not capped rises each time that others are
    found to be capped at it, until none is; each step is one aggregate over the sources."""
    rows = staged(
        numbered_sources(sizes)
        .withColumn("weight", F.col("number") % 3 + 1)
        .withColumn("cap", F.col("source_size") * F.lit(most))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .select("source", "source_size", "weight", "cap", "ratio"), "weights")
    total = float(rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, capped = -1.0, -1
    while True:
        low = F.col("ratio") <= F.lit(level)
        n, caps, weights = rows.agg(
            F.count_if(low), F.coalesce(F.sum(F.when(low, F.col("cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~low, F.col("weight"))), F.lit(0))).first()
        if n == capped or not weights:
            break
        capped, level = n, (total - caps) / weights
    return rows.select("source", "source_size", "weight", F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def source_offset(seed: int, source: Column) -> Column:
    """One number in [0, 1) for each source, the same on every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def systematic_copies(sized: DataFrame, seed: int = 7, most: float = MOST_COPIES) -> DataFrame:
    """From (doc_id, source, size) rows to the same rows with source_size, target and copies."""
    spark = sized.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sized = staged(sized.select("doc_id", "source", "size"), "sizes")  # the texts are read once
    rows = staged(
        sized
        .repartitionByRange(parts, F.col("source").asc_nulls_last(), "size", "doc_id")
        .withColumn("part", F.spark_partition_id()),
        "mix",
    )
    by_part = rows.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    scan = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("source", "part", F.coalesce(F.sum("n").over(scan), F.lit(0)).alias("before"))
    targets = mixture_targets(by_part.groupBy("source").agg(F.sum("words").alias("source_size")), most)
    ranges = before.alias("b").join(targets.alias("t"), F.expr("b.source <=> t.source")).select(
        F.col("b.source").alias("source_"), F.col("b.part").alias("part_"), "before", "source_size", "target"
    )
    order = Window.partitionBy("source", "part").orderBy("size", "doc_id")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at = F.col("before") + F.col("place")
    offset = source_offset(seed, F.col("source"))
    return (
        rows.withColumn("place", F.row_number().over(order))
        .join(ranges, F.expr("source <=> source_ AND part = part_"))
        .withColumn("rate", rate)
        .withColumn("copies", (F.floor(F.col("rate") * at + offset) - F.floor(F.col("rate") * (at - 1) + offset)))
        .select("doc_id", "source", "size", "source_size", "target", F.col("copies").cast("long").alias("copies"))
    )


def mix_documents(docs: DataFrame, seed: int = 7, most: float = MOST_COPIES) -> DataFrame:
    """The mixture itself: each document once for each time it is taken, with the columns of ``docs``, whatever their
    names."""
    sized = packed(docs, id="doc_id", origin="source", size=word_count())
    copies = systematic_copies(
        sized.select(F.col("id").alias("doc_id"), F.col("origin").alias("source"), "size"), seed, most)
    lists = copies.groupBy("doc_id", "source", "size").agg(F.sort_array(F.collect_list("copies")).alias("copies"))
    lists = lists.toDF("id_", "origin_", "size_", "copies")
    same = Window.partitionBy("id", "origin", "size").orderBy(F.col("row").getField("text"))
    return unpacked(
        sized.join(lists, F.expr("id <=> id_ AND origin <=> origin_ AND size = size_"))
        .withColumn("place", F.row_number().over(same))
        .withColumn("times", F.expr("copies[place - 1]"))
        .where("times > 0")
        .withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))),
        docs.columns,
    )


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = systematic_copies(docs.select("doc_id", "source", word_count().alias("size")))
    return found.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


#: The sizes, targets and copies of ``{table}`` as a chain of common table expressions for DuckDB.
COPIES_SQL = r"""
sized AS (SELECT doc_id, source,
                 coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM {table}),
sizes AS (SELECT source, sum(size)::DOUBLE AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight,
                   source_size * 3.0 AS cap FROM sizes),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))
                     / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS lev
           FROM weighed
           WINDOW before AS (ORDER BY cap / weight, source NULLS LAST
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(cap, weight * max(lev) OVER ()) AS target,
                   ('0x' || substr(md5('7:' || coalesce('s' || source, 'null')), 1, 8))::BIGINT / 4294967296.0 AS u
            FROM levels),
placed AS (SELECT s.doc_id, s.source, s.size, t.source_size::BIGINT AS source_size, t.target, t.u,
                  CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
                  row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id) AS place
           FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (SELECT doc_id, source, size, source_size, target,
                  (floor(rate * place + u) - floor(rate * (place - 1) + u))::BIGINT AS copies FROM placed)
"""

QUERIES = {"op2_mix_sources": op2_mix_sources}
ORACLE = {
    "op2_mix_sources": "WITH " + COPIES_SQL.format(table="documents")
    + "SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM copies"
}

"""Joins, windows, sets, paging and cross-source reduction."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import BuildError


#: A name that ends in a number in parentheses.
_NUMBERED = r"^(.*) \(([1-9][0-9]{0,8})\)$"
#: Right rows of an as-of join that are broadcast at most, and their bytes at most (counted as text).
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32_000_000
#: Spans, or runs of them, that a left row of an as-of join is compared with at a time.
FAN = 64


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str,
              values: Sequence[str], slice_seconds: int = 86_400) -> DataFrame:
    """Each left row with the ``values`` of the latest right row of its key at or before its time, null without one.

    Of right rows with equal key and time the largest values win; null keys and times never match. A small right side
    (by rows and bytes, counted) becomes spans from each time to the next and is broadcast: left rows are not shuffled,
    however many a key has. A key of many spans is a search tree: runs of ``FAN`` spans, runs of such runs, and so on,
    are looked up level by level, so a left row is compared with ``FAN`` spans a level. A large right side meets the left rows in slices of time, so that a key with most rows is dealt
    over many tasks; what holds at a slice's begin comes from the slices before it."""
    keys = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(on)]
    names = [f"k{i}" for i in range(len(on))]
    item = F.struct(*[F.col(f"`{c}`") for c in values])
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in names], F.col("t").isNotNull())
    told = right.select(*keys, F.col(f"`{right_time}`").alias("t"), item.alias("value")).where(whole)
    points = told.groupBy(*names, "t").agg(F.max("value").alias("value"))
    own = F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("row")
    rows = left.select(own, *keys, F.col(f"`{left_time}`").alias("t"))
    probe = told.limit(BROADCAST_ROWS + 1).groupBy(*names).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length(F.to_json(F.struct("*")))).alias("size")).agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0)), F.max("n")).first()
    if probe[0] <= BROADCAST_ROWS and probe[1] <= BROADCAST_BYTES:
        spans = points.select(
            *names, F.col("t").alias("since"), F.lead("t").over(Window.partitionBy(*names).orderBy("t")).alias("until"), "value",
            (F.row_number().over(Window.partitionBy(*names).orderBy("t")) - 1).alias("at"))
        levels = 1
        while FAN**levels < (probe[2] or 0):
            levels += 1
        found = rows.withColumn("run", F.lit(0))
        for level in reversed(range(levels)):  # from the widest runs to the spans
            width = FAN**level
            run = F.floor(F.col("at") / width)
            step = spans if not level else spans.groupBy(*names, run.alias("at")).agg(
                F.min("since").alias("since"), F.when(F.count_if(F.col("until").isNull()) == 0, F.max("until")).alias("until"))
            step = step.select(*[F.col(k).alias(f"{k}_") for k in names], "since", "until", F.col("at").alias("at_"),
                               F.floor(F.col("at") / FAN).alias("run_") if level < levels - 1 else F.lit(0).alias("run_"),
                               *([] if level else ["value"]))
            same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"{k}_") for k in names], F.col("run") == F.col("run_"))
            met = same & (F.col("t") >= F.col("since")) & (F.col("until").isNull() | (F.col("t") < F.col("until")))
            found = found.join(F.broadcast(step), met, "left").select(
                "row", *names, "t", F.col("at_").alias("run"), *([] if level else ["value"]))
    else:
        part = F.floor(F.unix_timestamp(F.col("t").cast("timestamp")) / F.lit(slice_seconds)).alias("part")
        cut = points.select(*names, "t", "value", part)
        rows = rows.select("row", *names, "t", part)
        # what holds at the begin of a slice: the last value of the slices before, of one row a key and slice
        ends = cut.groupBy(*names, "part").agg(F.max_by("value", "t").alias("end"))
        slices = rows.where(whole).select(*names, "part").distinct().join(ends, [*names, "part"], "full")
        before = Window.partitionBy(*names).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        begins = slices.withColumn("begin", F.last("end", ignorenulls=True).over(before)).select(*names, "part", "begin")
        # the begin is one more point, ahead of all of the slice
        heads = begins.where("begin IS NOT NULL").select(
            *names, F.lit(None).cast(left.schema[left_time].dataType).alias("t"), "part", F.col("begin").alias("value"),
            F.lit(0).alias("side"))
        stacked = heads.unionByName(cut.withColumn("side", F.lit(0))).unionByName(
            rows.withColumn("side", F.lit(1)), allowMissingColumns=True)
        w = Window.partitionBy(*names, "part").orderBy(F.asc_nulls_first("t"), "side").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        found = stacked.withColumn("value", F.when(whole, F.last("value", ignorenulls=True).over(w))).where("side = 1")
    return found.select("row.*", *[F.col("value").getField(c).alias(c) for c in values])


def with_label(df: DataFrame, names: DataFrame, key: str, name_key: str, name: str, output: str) -> DataFrame:
    """A left join to a table of names; without a name the key itself, as text."""
    labels = names.select(F.col(f"`{name_key}`").alias("_key"), F.col(f"`{name}`").alias("_name"))
    return df.join(labels, F.col(f"`{key}`") == F.col("_key"), "left").withColumn(
        output, F.coalesce("_name", F.col(f"`{key}`").cast("string"))).drop("_key", "_name")


def with_counts(parents: DataFrame, key: str, children: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Each parent with the number of its rows in several child tables. Children are counted before the joins, so
    that no join multiplies another's rows."""
    for output, (child, child_key) in children.items():
        counts = child.groupBy(F.col(f"`{child_key}`").alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
        parents = parents.join(counts, F.col(f"`{key}`") == F.col("_key"), "left").withColumn(
            output, F.coalesce("_n", F.lit(0))).drop("_key", "_n")
    return parents


def latest_child(parents: DataFrame, children: DataFrame, key: str, child_key: str, order: Sequence[str],
                 values: Mapping[str, str]) -> DataFrame:
    """Each parent with values of its latest child, null without one."""
    item = F.struct(F.struct(*[F.col(f"`{c}`") for c in order]).alias("at"),
                    F.struct(*[F.col(f"`{c}`") for c in values]).alias("of"))
    best = children.groupBy(F.col(f"`{child_key}`").alias("_key")).agg(F.max(item).alias("_best"))
    return parents.join(best, F.col(f"`{key}`") == F.col("_key"), "left").select(
        *[F.col(f"`{c}`") for c in parents.columns], *[F.col(f"_best.of.`{c}`").alias(n) for c, n in values.items()])


def semi(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(other.select(*on), list(on), "left_semi")


def anti(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(other.select(*on), list(on), "left_anti")


def with_parameters(df: DataFrame, parameters: DataFrame) -> DataFrame:
    """Every row with the columns of a one-row table, which is read once and becomes literals."""
    rows = parameters.limit(2).collect()
    if len(rows) != 1:
        raise BuildError("parameters are one row")
    return df.withColumns({c: F.lit(rows[0][c]).cast(parameters.schema[c].dataType) for c in parameters.columns})


def number_duplicates(df: DataFrame, scope: Sequence[str], name: str, order: Sequence[str]) -> DataFrame:
    """Names made unique within a scope, ignoring case: the oldest keeps its name, later ones get the lowest numbers
    from `` (2)`` on with which no name of the scope ends in parentheses already.

    A name ``x (n)`` takes the number n from the names ``x``; the free numbers are the rest, counted from 2. Several
    ``x (2)`` are a group of their own, whose suffix comes after the one that they have. A group's rows and its taken
    numbers stand in one order, so that each row counts the taken ones below its own; nothing is collected."""
    whole = F.col(f"`{name}`")
    low = F.lower(whole)
    base, number = F.regexp_extract(low, _NUMBERED, 1), F.regexp_extract(low, _NUMBERED, 2).try_cast("int")
    by = [F.col(f"`{c}`").alias(f"_s{i}") for i, c in enumerate(scope)]
    group = [*[f"_s{i}" for i in range(len(scope))], "_name"]
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    rows = df.select(*by, low.alias("_name"), row, F.lit(None).cast("int").alias("_taken"), *[
        F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(order)])
    taken = df.where(number >= 2).select(*by, base.alias("_name"), number.alias("_taken")).distinct()
    nth = F.row_number().over(Window.partitionBy(*group, F.col("_taken").isNull()).orderBy(
        "_taken", *[f"_o{i}" for i in range(len(order))]))
    both = rows.unionByName(taken, allowMissingColumns=True).withColumn("_nth", nth)
    # the k-th taken number t has t - 1 - k free ones below it; the n-th row gets the free number n - 1 of them
    place = F.coalesce(F.col("_taken") - 1 - F.col("_nth"), F.col("_nth") - 1)
    line = Window.partitionBy(*group).orderBy(place, F.col("_taken").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("_below", F.count("_taken").over(line))
    old, number = F.col("_row").getField(name), (F.col("_nth") + F.col("_below")).cast("string")
    out = F.when((F.col("_nth") > 1) & old.isNotNull(), F.concat(old, F.lit(" ("), number, F.lit(")"))).otherwise(old)
    return both.where("_row IS NOT NULL").select(*[
        (out if c == name else F.col("_row").getField(c)).alias(c) for c in df.columns])


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(
        "_n = 1").drop("_n")


def last_n_per_key(df: DataFrame, keys: Sequence[str], time: str, tie: str, n: int, status: str) -> DataFrame:
    """Per key: the statuses of its ``n`` most recent rows, oldest first, the status of the latest, and its rows."""
    order = (F.col(f"`{time}`").desc(), F.col(f"`{tie}`").desc())
    recent = df.select(*keys, time, tie, status).withColumn(
        "_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n)
    item = F.struct((-F.col("_n")).alias("at"), F.col(f"`{status}`").alias("s"))
    strips = recent.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_strip"))
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    return strips.join(totals, list(keys)).select(
        *keys, F.transform("_strip", lambda x: x["s"]).alias("strip"),
        F.element_at("_strip", -1).getField("s").alias("latest"), "total")


def top_n(df: DataFrame, by: Sequence[str], measure: Column, n: int, output: str = "value") -> DataFrame:
    """The ``n`` groups with the largest measure; ties by key."""
    return df.groupBy(*by).agg(measure.alias(output)).orderBy(F.desc_nulls_last(output), *by).limit(n)


def bucketed(df: DataFrame, column: str, bounds: Sequence[float], output: str = "bucket") -> DataFrame:
    """Rows with the number of the bucket that a value falls into: 0 below the first bound, and so on."""
    c, out = F.col(f"`{column}`"), F.lit(len(bounds))
    for i, b in reversed(list(enumerate(bounds))):
        out = F.when(c < b, i).otherwise(out)
    return df.withColumn(output, F.when(c.isNotNull(), out))


def auto_bounds(df: DataFrame, column: str, buckets: int, accuracy: int = 10_000) -> list[float]:
    """Bounds that deal the values into about equal buckets, from approximate quantiles in one pass."""
    steps = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(F.col(f"`{column}`").cast("double"), steps, accuracy)).first()[0]
    return sorted(set(found or []))


def facets(df: DataFrame, views: Mapping[str, tuple[Sequence[str], Column]]) -> dict[str, DataFrame]:
    """Several groupings of one table by name: (keys, measure) each."""
    return {name: df.groupBy(*keys).agg(measure.alias("value")) for name, (keys, measure) in views.items()}


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> tuple[DataFrame, int, bool]:
    """A page of rows, the number of all rows, and whether there are more."""
    total = df.count()
    return df.orderBy(*order).offset(offset).limit(limit), total, offset + limit < total


def capped(df: DataFrame, n: int) -> tuple[DataFrame, bool]:
    """At most ``n`` rows, and whether there were more."""
    return df.limit(n), df.limit(n + 1).count() > n


def preview(df: DataFrame, n: int = 50) -> tuple[DataFrame, tuple[str, str] | None]:
    """The first rows, and (text column, number column) for a chart if exactly one column is numeric and there is
    a text column."""
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.limit(n), ((texts[0], numbers[0]) if len(numbers) == 1 and texts else None)


def merged(feeds: Mapping[str, DataFrame], output: str = "source") -> DataFrame:
    """Tables of different shape stacked by name and tagged with where each row comes from."""
    out = None
    for name, df in feeds.items():
        df = df.withColumn(output, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise BuildError("nothing to merge")
    return out


def union_distinct(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both, one per key."""
    return a.unionByName(b).dropDuplicates(list(keys))


def reduce_extreme(sources: Mapping[str, DataFrame], column: str, largest: bool = True) -> DataFrame:
    """All rows, of any source, that hold the largest (or smallest) value; tagged with their source.

    Only one value a source is gathered; the rows themselves are filtered where they are."""
    stacked = _numeric_sources(sources, column)
    best = stacked.agg((F.max if largest else F.min)(F.col(f"`{column}`")).alias("_best"))
    return stacked.join(F.broadcast(best), F.col(f"`{column}`") == F.col("_best")).drop("_best")


def reduce_total(sources: Mapping[str, DataFrame], column: str | None) -> DataFrame:
    """(total, sources): the sum of a column, or the number of rows, over all sources, and which contributed."""
    if column is not None:
        _numeric_sources(sources, column)
    parts = None
    for name, df in sources.items():
        value = F.count(F.lit(1)) if column is None else F.sum(F.col(f"`{column}`").cast("double"))
        part = df.agg(value.alias("v")).withColumn("s", F.lit(name))
        parts = part if parts is None else parts.unionByName(part)
    return parts.agg(F.sum("v").alias("total"),
                     F.array_sort(F.collect_list(F.when(F.col("v").isNotNull(), F.col("s")))).alias("sources"))


def _numeric_sources(sources: Mapping[str, DataFrame], column: str) -> DataFrame:
    for name, df in sources.items():
        if df is None:
            raise BuildError(f"source {name} failed, so the whole answer is refused")
        if column not in df.columns:
            raise BuildError(f"source {name} has no column {column}")
        if not isinstance(df.schema[column].dataType, T.NumericType):
            raise BuildError(f"{column} of source {name} is not numeric")
    return merged(sources)

"""Operational analytics: usage, costs, limits, health and activity.

The driver's ``events`` stand for usage (event_type: what was used, user_id: who, value: how much) and ``orders`` for
runs (o_custkey: whose, o_orderstatus: F succeeded, O running, P failed)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import relations
from .registry import query, read

#: The day that "today" means in these queries: the data's last.
TODAY = dt.datetime(2024, 1, 30)


def price_history(usage: DataFrame) -> DataFrame:
    """Prices of each kind from two dates on."""
    kinds = usage.select("event_type").distinct()
    since = F.explode(F.array(*[F.lit(dt.datetime(2024, 1, d)) for d in (1, 15)]))
    return kinds.select("event_type", since.alias("since")).withColumn(
        "price", F.length("event_type") + F.when(F.dayofmonth("since") == 15, 1.0).otherwise(0.0))


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage with the price that held when it occurred, and its cost."""
    found = relations.asof_join(usage, prices, ["event_type"], "ts", "since", ["price"])
    return found.withColumn("cost", F.col("value") * F.col("price"))


def when_sum(condition: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0.0))


def usage_totals(costs: DataFrame, today: dt.datetime) -> DataFrame:
    """Today's and this month's rows, quantity and cost in one pass."""
    day = F.col("ts") >= F.lit(today)
    month = F.col("ts") >= F.date_trunc("month", F.lit(today))
    parts = []
    for name, c in (("day", day), ("month", month)):
        parts += [F.count_if(c).alias(f"n_{name}"), F.round(when_sum(c, F.col("value")), 4).alias(f"quantity_{name}"),
                  F.round(when_sum(c, F.col("cost")), 4).alias(f"cost_{name}")]
    return costs.agg(*parts)


def daily(df: DataFrame, time: str, **aggregates: Column) -> DataFrame:
    return df.groupBy(F.date_trunc("day", time).alias("day")).agg(*[a.alias(n) for n, a in aggregates.items()])


def gap_filled(series: DataFrame, last: dt.datetime, days: int, value: str) -> DataFrame:
    """A day for each of the last ``days`` days, 0 where there is none, and whether it was loaded."""
    axis = series.sparkSession.range(days).select(
        (F.lit(last) - F.make_dt_interval(F.col("id").cast("int"))).alias("day"))
    return axis.join(series.withColumn("_own", F.lit(True)), "day", "left").select(
        "day", F.coalesce(value, F.lit(0)).alias(value), F.coalesce("_own", F.lit(False)).alias("loaded"))


def kpi(df: DataFrame, time: str, last: dt.datetime, days: int, measure) -> DataFrame:
    """(value, delta): a measure over the last ``days`` days and its difference to the same span before, which is
    null where the data does not reach back. ``measure`` makes an aggregate out of a condition."""
    end, start, before = last + dt.timedelta(days=1), last - dt.timedelta(days=days - 1), last - dt.timedelta(days=2 * days - 1)
    t = F.col(time)
    now, then = (t >= F.lit(start)) & (t < F.lit(end)), (t >= F.lit(before)) & (t < F.lit(start))
    row = df.agg(measure(now).alias("value"), measure(then).alias("_before"), F.min(t).alias("_first"))
    return row.select("value", F.when(F.col("_first") <= F.lit(before), F.col("value") - F.col("_before")).alias("delta"))


def kpis(df: DataFrame, time: str, last: dt.datetime, days: int, measures: dict) -> DataFrame:
    """(kpi, value, delta) of several measures, in one pass over the table."""
    end, start, before = last + dt.timedelta(days=1), last - dt.timedelta(days=days - 1), last - dt.timedelta(days=2 * days - 1)
    t = F.col(time)
    now, then = (t >= F.lit(start)) & (t < F.lit(end)), (t >= F.lit(before)) & (t < F.lit(start))
    structs = [F.struct(F.lit(n).alias("kpi"), m(now).cast("double").alias("value"), m(then).cast("double").alias("before"))
               for n, m in measures.items()]
    row = df.agg(F.array(*structs).alias("rows"), F.min(t).alias("first"))
    return row.select("first", F.explode("rows").alias("r")).select(
        "r.kpi", "r.value", F.when(F.col("first") <= F.lit(before), F.col("r.value") - F.col("r.before")).alias("delta"))


def gated_percentile(value: str, p: float, least: int = 20) -> Column:
    """The nearest-rank percentile of a column, null for fewer than ``least`` values."""
    return F.when(F.count(value) >= least, F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{value}`)"))


def metered(usage: DataFrame, limits: DataFrame, on: Sequence[str]) -> DataFrame:
    """Usage by key and kind beside its limit: the override where there is one, else the plan's."""
    totals = usage.groupBy(*on).agg(F.sum("value").alias("used"))
    return totals.join(limits, list(on), "left").withColumn("limit", F.coalesce("override_limit", "plan_limit"))


_COSTS = """costs AS (SELECT e.*, p.price, e.value * p.price AS cost FROM events e ASOF LEFT JOIN (
SELECT event_type, TIMESTAMP '2024-01-01' AS since, length(event_type)::DOUBLE AS price FROM events GROUP BY 1
UNION ALL SELECT event_type, TIMESTAMP '2024-01-15', length(event_type) + 1.0 FROM events GROUP BY 1) p
ON e.event_type = p.event_type AND e.ts >= p.since)"""


def _costs(spark, sf) -> DataFrame:
    e = read(spark, sf, "events")
    return priced(e, price_history(e))


@query(f"""WITH {_COSTS} SELECT count(*) FILTER (ts >= TIMESTAMP '2024-01-30') AS n_day,
round(coalesce(sum(value) FILTER (ts >= TIMESTAMP '2024-01-30'), 0), 4) AS quantity_day,
round(coalesce(sum(cost) FILTER (ts >= TIMESTAMP '2024-01-30'), 0), 4) AS cost_day,
count(*) FILTER (ts >= TIMESTAMP '2024-01-01') AS n_month, round(sum(value) FILTER (ts >= TIMESTAMP '2024-01-01'), 4) AS quantity_month,
round(sum(cost) FILTER (ts >= TIMESTAMP '2024-01-01'), 4) AS cost_month FROM costs""")
def usage_today_and_month(spark, sf):
    return usage_totals(_costs(spark, sf), TODAY)


@query(f"""WITH {_COSTS} SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n, round(sum(cost), 4) AS cost FROM costs GROUP BY 1""")
def daily_usage(spark, sf):
    return daily(_costs(spark, sf), "ts", n=F.count(F.lit(1)), cost=F.round(F.sum("cost"), 4))


@query(f"""WITH {_COSTS} (SELECT 'user' AS dimension, user_id::VARCHAR AS key, round(sum(cost), 4) AS value FROM costs GROUP BY user_id
ORDER BY value DESC, user_id LIMIT 5) UNION ALL (SELECT 'kind', event_type, round(sum(cost), 4) AS value FROM costs GROUP BY event_type
ORDER BY value DESC, event_type LIMIT 5)""")
def top_consumers(spark, sf):
    # one pass over the usage: sums by user and kind, from which both lists are made
    c = _costs(spark, sf).groupBy("user_id", "event_type").agg(F.sum("cost").alias("cost"))
    parts = [relations.top_n(c, [k], F.round(F.sum("cost"), 4), 5).select(
        F.lit(d).alias("dimension"), F.col(k).cast("string").alias("key"), "value") for d, k in (("user", "user_id"), ("kind", "event_type"))]
    return parts[0].unionByName(parts[1])


@query("""SELECT event_type, TIMESTAMP '2024-01-15' AS since, length(event_type) + 1.0::DOUBLE AS price FROM events GROUP BY 1""")
def latest_price(spark, sf):
    return relations.latest_per_key(price_history(read(spark, sf, "events")), ["event_type"], [F.desc("since")])


@query("""SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS day, count(*) FILTER (o_orderstatus = 'F') AS succeeded,
count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) FILTER (o_orderstatus = 'O') AS running, round(sum(o_totalprice), 2) AS volume
FROM orders GROUP BY 1""")
def filtered_daily_counts(spark, sf):
    status = F.col("o_orderstatus")
    return daily(read(spark, sf, "orders"), "o_orderdate", succeeded=F.count_if(status == "F"), failed=F.count_if(status == "P"),
                 running=F.count_if(status == "O"), volume=F.round(F.sum("o_totalprice"), 2))


@query("""SELECT count(*) AS n_all, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS n_recent,
count(DISTINCT user_id) FILTER (ts >= TIMESTAMP '2024-01-16') AS active FROM events""")
def totals_and_recent(spark, sf):
    recent = F.col("ts") >= F.lit(dt.datetime(2024, 1, 16))
    return read(spark, sf, "events").agg(F.count(F.lit(1)).alias("n_all"), F.count_if(recent).alias("n_recent"),
                                         F.count_distinct(F.when(recent, F.col("user_id"))).alias("active"))


@query("""(SELECT 'overdrawn' AS reason, c_custkey AS who, round(c_acctbal, 2) AS measure FROM customer WHERE c_acctbal < 0
ORDER BY measure, who LIMIT 5) UNION ALL (SELECT 'near limit', o_custkey, count(*)::DOUBLE AS m FROM orders GROUP BY 2 HAVING count(*) >= 0.8 * 20
ORDER BY m DESC, 2 LIMIT 5) UNION ALL (SELECT 'failing', o_custkey, count(*)::DOUBLE AS m FROM orders WHERE o_orderstatus = 'P' GROUP BY 2
ORDER BY m DESC, 2 LIMIT 5)""")
def needs_attention(spark, sf):
    o = read(spark, sf, "orders")
    overdrawn = read(spark, sf, "customer").where("c_acctbal < 0").select(
        F.lit("overdrawn").alias("reason"), F.col("c_custkey").alias("who"), F.round("c_acctbal", 2).alias("measure")).orderBy(
        "measure", "who").limit(5)
    n = F.count(F.lit(1)).cast("double").alias("measure")
    near = o.groupBy(F.col("o_custkey").alias("who")).agg(n).where(F.col("measure") >= 0.8 * 20)
    failing = o.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("who")).agg(n)
    parts = [overdrawn] + [d.orderBy(F.desc("measure"), "who").limit(5).select(F.lit(r).alias("reason"), "who", "measure")
                           for r, d in (("near limit", near), ("failing", failing))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""SELECT event_type, round(sum(value), 4) AS used, (CASE WHEN event_type = 'view' THEN 5000.0 ELSE 100.0 * length(event_type) END)::DOUBLE AS "limit"
FROM events GROUP BY 1""")
def metered_vs_limit(spark, sf):
    e = read(spark, sf, "events")
    limits = e.select("event_type").distinct().withColumns({
        "plan_limit": 100.0 * F.length("event_type"), "override_limit": F.when(F.col("event_type") == "view", 5000.0)})
    return metered(e, limits, ["event_type"]).select("event_type", F.round("used", 4).alias("used"), "limit")


@query("""SELECT c_custkey, count(*) AS used FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) >= 15""")
def limit_impact(spark, sf):
    used = read(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("used")).where("used >= 15")
    return read(spark, sf, "customer").join(used, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "used")


@query("""SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS members,
(SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey AND o_orderdate >= TIMESTAMP '1998-01-01') AS recent_runs
FROM nation""")
def organisation_list(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", "c_nationkey")
    runs = read(spark, sf, "orders").where(F.col("o_orderdate") >= F.lit(dt.datetime(1998, 1, 1))).select("o_custkey").join(
        c, F.col("o_custkey") == F.col("c_custkey"))
    return relations.with_counts(read(spark, sf, "nation"), "n_nationkey", {
        "members": (c, "c_nationkey"), "recent_runs": (runs, "c_nationkey")}).select("n_nationkey", "members", "recent_runs")


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (ts >= TIMESTAMP '2024-01-29') AS n_last_day FROM events GROUP BY 1""")
def health_counts(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("ts") >= F.lit(TODAY - dt.timedelta(days=1))).alias("n_last_day"))


@query("""SELECT d::TIMESTAMP AS day, coalesce(n, 0) AS n, n IS NOT NULL AS loaded FROM generate_series(TIMESTAMP '2024-01-17', TIMESTAMP '2024-01-30',
INTERVAL 1 DAY) g(d) LEFT JOIN (SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events WHERE event_type = 'error' AND user_id = 7 GROUP BY 1) e ON e.day = g.d""")
def gap_filled_days(spark, sf):
    e = read(spark, sf, "events").where("event_type = 'error' AND user_id = 7")
    return gap_filled(daily(e, "ts", n=F.count(F.lit(1))), TODAY, 14, "n")


@query("""WITH e AS (SELECT *, ts >= TIMESTAMP '2024-01-17' AND ts < TIMESTAMP '2024-01-31' AS now, ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-17' AS before
FROM events) SELECT 'count' AS kpi, (count(*) FILTER (now))::DOUBLE AS value, (count(*) FILTER (now) - count(*) FILTER (before))::DOUBLE AS delta FROM e
UNION ALL SELECT 'purchase rate', round((count(*) FILTER (now AND event_type = 'purchase')) / (count(*) FILTER (now)), 9),
round((count(*) FILTER (now AND event_type = 'purchase')) / (count(*) FILTER (now)) - (count(*) FILTER (before AND event_type = 'purchase')) / (count(*) FILTER (before)), 9) FROM e
UNION ALL SELECT 'median', round(median(value) FILTER (now), 9), round(median(value) FILTER (now) - median(value) FILTER (before), 9) FROM e""")
def kpi_delta(spark, sf):
    e = read(spark, sf, "events")
    measures = {
        "count": lambda c: F.count_if(c).cast("double"),
        "purchase rate": lambda c: F.try_divide(F.count_if(c & (F.col("event_type") == "purchase")), F.count_if(c)),
        "median": lambda c: F.median(F.when(c, F.col("value")))}
    return kpis(e, "ts", TODAY, 14, measures).select("kpi", F.round("value", 9).alias("value"), F.round("delta", 9).alias("delta"))


@query("""SELECT user_id, CASE WHEN count(value) >= 20 THEN quantile_disc(value, 0.95) END AS p95 FROM events WHERE event_type = 'click' GROUP BY 1""")
def p95_gated(spark, sf):
    return read(spark, sf, "events").where("event_type = 'click'").groupBy("user_id").agg(
        gated_percentile("value", 0.95).alias("p95"))


@query("""SELECT date_trunc('day', ts)::TIMESTAMP AS day, round(median(value), 9) AS median FROM events WHERE event_type <> 'error' GROUP BY 1""")
def daily_median(spark, sf):
    return daily(read(spark, sf, "events").where("event_type <> 'error'"), "ts", median=F.round(F.median("value"), 9))


@query("""SELECT CASE WHEN value < 10 THEN 0 WHEN value < 50 THEN 1 WHEN value < 100 THEN 2 ELSE 3 END AS bucket, count(*) AS n FROM events GROUP BY 1""")
def value_buckets(spark, sf):
    found = relations.bucketed(read(spark, sf, "events"), "value", (10.0, 50.0, 100.0))
    return found.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'kind' AS facet, event_type AS key, count(*) AS value FROM events GROUP BY 2 UNION ALL
SELECT 'day', strftime(ts, '%Y-%m-%d'), count(*) FROM events GROUP BY 2""")
def event_facets(spark, sf):
    e = read(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    n = F.count(F.lit(1))
    views = relations.facets(e, {"kind": (["event_type"], n), "day": (["day"], n)})
    parts = [df.select(F.lit(name).alias("facet"), F.col(df.columns[0]).alias("key"), "value") for name, df in views.items()]
    return parts[0].unionByName(parts[1])


@query("""SELECT bucket, round(count(*) / (SELECT count(*) FROM events), 2) AS share FROM (SELECT CASE WHEN value < q[1] THEN 0 WHEN value < q[2] THEN 1
WHEN value < q[3] THEN 2 ELSE 3 END AS bucket FROM events, (SELECT quantile_disc(value, [0.25, 0.5, 0.75]) AS q FROM events)) GROUP BY 1""")
def auto_buckets(spark, sf):
    e = read(spark, sf, "events")
    sizes = relations.bucketed(e, "value", relations.auto_bounds(e, "value", 4)).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    all_ = F.sum("n").over(Window.partitionBy(F.lit(1)))  # four rows
    return sizes.select("bucket", F.round(F.col("n") / all_, 2).alias("share"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT user_id, string_agg(event_type, ',' ORDER BY n DESC) FILTER (n <= 5) AS strip, count(*) AS total FROM r GROUP BY 1
HAVING max(event_type) FILTER (n = 1) = 'error'""")
def failing_list(spark, sf):
    found = relations.last_n_per_key(read(spark, sf, "events"), ["user_id"], "ts", "event_id", 5, "event_type")
    return found.where("latest = 'error'").select("user_id", F.array_join("strip", ",").alias("strip"), "total")


@query("""SELECT * FROM (SELECT 'events' AS source, event_id AS id, event_type AS action FROM events UNION ALL
SELECT 'orders', o_orderkey, o_orderstatus FROM orders) WHERE contains(lower(action), 'error') ORDER BY source, id DESC LIMIT 30 OFFSET 10""")
def audit_feed(spark, sf):
    from ..operators.predicates import search

    feed = relations.merged({
        "events": read(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("action")),
        "orders": read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("action"))})
    return relations.page(search(feed, "ERROR", ["action"]), [F.col("source"), F.desc("id")], 30, 10)[0]

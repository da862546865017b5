"""Queries over databases, tables that are changed in place, key lists, sketches and comparisons of tables. Each has a
twin in DuckDB's SQL."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import field, scalars as s
from ..functions.values import BuildError
from ..operators import profiles, quality, relations, schemas, steps
from ..operators.predicates import Predicate
from ..sources import databases, keyed, sinks
from ..sources.staging import new_folder
from ..streaming import sync
from .catalogue import _MESSY, messy_amounts
from .registry import query, read

# --- comparing tables ---------------------------------------------------------------------------------------------------

_CHANGED = """(SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS o_totalprice,
CASE WHEN o_orderstatus = 'P' THEN o_totalprice END AS o_discount FROM {t} WHERE o_orderdate <> TIMESTAMP '1996-02-29' UNION ALL
SELECT o_orderkey, o_custkey, o_totalprice, NULL FROM {t} WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')"""
_PLAIN = "(SELECT o_orderkey, o_custkey, o_totalprice, NULL::DOUBLE AS o_discount FROM orders)"


def _changed(o: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Orders, and orders with one day lost, urgent ones twice, and prices that moved to another column."""
    p, none = F.col("o_orderstatus") == "P", F.lit(None).cast("double")
    a = o.select("o_orderkey", "o_custkey", "o_totalprice", none.alias("o_discount"))
    b = o.where(F.col("o_orderdate") != F.lit(dt.datetime(1996, 2, 29))).select(
        "o_orderkey", "o_custkey", F.when(~p, F.col("o_totalprice")).alias("o_totalprice"), F.when(p, F.col("o_totalprice")).alias("o_discount"))
    twice = o.where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select(*a.columns[:3], none.alias("o_discount"))
    return a, b.unionByName(twice)


@query(f"""SELECT DISTINCT o_orderkey FROM (({{a}} EXCEPT ALL {{b}}) UNION ALL ({{b}} EXCEPT ALL {{a}}))""".format(
    a=f"SELECT * FROM {_PLAIN}", b=f"SELECT * FROM {_CHANGED.format(t='orders')}"))
def differing_rows(spark, sf):
    """The keys whose rows differ between two tables: lost, repeated, and with a value in another column."""
    a, b = _changed(read(spark, sf, "orders"))
    return quality.differing_keys(a, b, ["o_orderkey"]).select("o_orderkey")


@query("""SELECT 'copy' AS what, true AS same UNION ALL SELECT 'twice', count(*) = 0 FROM orders UNION ALL
SELECT 'swapped', count(*) FILTER (o_custkey <> o_orderkey) = 0 FROM orders""")
def table_checksums(spark, sf):
    """Whether a table is the same as itself dealt anew, as itself twice over, and as itself with two columns swapped."""
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    swapped = o.select(F.col("o_custkey").alias("o_orderkey"), F.col("o_orderkey").alias("o_custkey"))
    rows = [(what, quality.same_table(o, b)) for what, b in (("copy", o.repartition(5)), ("twice", o.unionByName(o)), ("swapped", swapped))]
    return spark.createDataFrame(rows, "what string, same boolean")


# --- tables that are changed in place --------------------------------------------------------------------------------------

_LOG = """(SELECT user_id, event_id, value, event_type = 'error' AND user_id % 7 = 0 AS gone FROM events)"""


def _log(spark, sf) -> DataFrame:
    return read(spark, sf, "events").select(
        "user_id", "event_id", "value", F.when((F.col("event_type") == "error") & (F.col("user_id") % 7 == 0), "delete").otherwise("upsert").alias("op"))


@query(f"""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY gone DESC, event_id DESC) AS n FROM {_LOG}) WHERE n = 1 AND NOT gone""")
def ticks_out_of_order(spark, sf):
    """The whole log of changes in five ticks, the latest first, and one of them again: the same table as in one."""
    log = _log(spark, sf)
    table = keyed.KeyedTable(spark, new_folder(spark, "ticks"), ["user_id"], "event_id", 8)
    by_type = ["purchase", "view", "error", "click", "signup", "error"]
    for n, kind in enumerate(by_type):
        sync.tick(table, log.join(read(spark, sf, "events").where(F.col("event_type") == kind).select("event_id"), "event_id", "left_semi")
                  .select(*log.columns), n, ["user_id"], "event_id")
    rest = read(spark, sf, "events").where(~F.col("event_type").isin(by_type) | F.col("event_type").isNull()).select("event_id")
    sync.tick(table, log.join(rest, "event_id", "left_semi").select(*log.columns), len(by_type), ["user_id"], "event_id")
    return table.read()


@query(f"""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM {_LOG}) WHERE n = 1 AND NOT gone""")
def ticks_with_returns(spark, sf):
    """The same log where a later change brings a deleted key back, older half last."""
    log = _log(spark, sf)
    middle = log.agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0] or 0
    table = keyed.KeyedTable(spark, new_folder(spark, "ticks"), ["user_id"], "event_id", 8, deletes="by_sequence")
    for n, part in enumerate((log.where(F.col("event_id") > middle), log.where(F.col("event_id") <= middle))):
        sync.tick(table, part, n, ["user_id"], "event_id")
    return table.read()


@query("""SELECT year(o_orderdate) * 12 + month(o_orderdate) - 1 AS month, count(*) AS n, round(sum(CASE WHEN o_orderdate >= TIMESTAMP '1998-06-01'
THEN o_totalprice + 1 ELSE o_totalprice END), 2) AS total, o_orderdate >= TIMESTAMP '1998-06-01' AS rewritten FROM
(SELECT *, date_trunc('month', o_orderdate) AS m FROM orders) GROUP BY 1, 4""")
def touched_buckets(spark, sf):
    """Orders laid out by month; a change of the last months' prices rewrites their buckets and no other file."""
    o = read(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("at"), "o_totalprice").withColumn(
        "month", F.year("at") * 12 + F.month("at") - 1)
    path = new_folder(spark, "months")
    table = keyed.KeyedTable(spark, path, ["month", "o_orderkey"], "version", bucket=F.col("month"))
    table.merge(o.drop("at").withColumn("version", F.lit(1)))
    before = table.files()
    late = o.where(F.col("at") >= F.lit(dt.datetime(1998, 6, 1))).drop("at")
    table.merge(late.withColumn("o_totalprice", F.col("o_totalprice") + 1).withColumn("version", F.lit(2)))
    kept = sorted({int(f.split(f"{keyed.BUCKET}=")[1].split("/")[0]) for f in table.files() & before})  # buckets
    return table.read().groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).withColumn(
        "rewritten", ~F.col("month").isin(kept))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
(SELECT count(*) FILTER (o_orderstatus = 'F') > 0 FROM orders) AS refused FROM orders""")
def asserted_merge(spark, sf):
    """Dearer prices merged into a table of orders under an assertion; negative prices before them are refused, and
    leave the table as it was."""
    o = read(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", F.lit(1).alias("version"))
    table = keyed.KeyedTable(spark, new_folder(spark, "orders"), ["o_orderkey"], "version", 8)

    def checks(live: DataFrame) -> None:
        quality.assert_keys(live, ["o_orderkey"])
        if not live.where("o_totalprice < 0").isEmpty():
            raise quality.AssertionFailed("a price below zero")

    table.merge(o, asserts=[checks])
    done, refused = o.where("o_orderstatus = 'F'"), False
    try:
        table.merge(done.withColumns({"o_totalprice": -F.col("o_totalprice"), "version": F.lit(9)}), asserts=[checks])
    except quality.AssertionFailed:
        refused = True
    table.merge(done.withColumns({"o_totalprice": F.col("o_totalprice") + 1, "version": F.lit(2)}), asserts=[checks])
    return table.read().select("o_orderkey", "o_totalprice", F.lit(refused).alias("refused"))


# --- key lists ---------------------------------------------------------------------------------------------------------------


@query("""SELECT k AS o_custkey, CASE WHEN NOT now THEN 'delete' WHEN NOT saved THEN 'add' ELSE 'keep' END AS state FROM
(SELECT k, bool_or(side = 's') AS saved, bool_or(side = 'n') AS now FROM (SELECT o_custkey AS k, 's' AS side FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_custkey, 'n' FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT c_custkey, 'n' FROM customer WHERE c_acctbal < 0) GROUP BY 1)""")
def reconcile_buckets(spark, sf):
    """A saved list of keys in sorted buckets against the keys of a scan and of changes."""
    o, c = read(spark, sf, "orders"), read(spark, sf, "customer")
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    saved = sync.saved_keys(o.where("o_orderstatus = 'F'"), ["o_custkey"], f"keys_{uuid.uuid4().hex}", buckets, new_folder(spark, "keys"))
    return sync.reconcile_saved(saved, o.where("o_orderstatus = 'O'"), c.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"])


# --- databases ---------------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, o_custkey, o_totalprice::DECIMAL(19,4) AS price, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_custkey > 10""")
def database_read(spark, sf):
    """Orders in files of an embedded database, read back in eight ranges of the key with exact prices and a pushed filter."""
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("decimal(19,4)").alias("price"), "o_orderstatus")
    source = databases.create_files(o, new_folder(spark, "database"), "orders", "o_orderkey")
    return databases.read_files_by_key(spark, source, 8, [Predicate("o_orderstatus", "eq", "F"), Predicate("o_custkey", "gt", 10)])


# --- profiles and documents ----------------------------------------------------------------------------------------------------

_FAILS = {"to_number": "l_linenumber % 5 <> 0", "to_integer": "l_linenumber % 5 <> 0"}


@query("SELECT 'amount' AS \"column\", how, n_values, n_passed, coalesce(list_sort(list_distinct(texts))[1:3], []) AS examples FROM (" + " UNION ALL ".join(
    f"""SELECT '{how}' AS how, count(amount) AS n_values, count(amount) FILTER (NOT ({_FAILS.get(how, 'true')})) AS n_passed,
list(left(amount, 50)) FILTER ({_FAILS.get(how, 'true')}) AS texts FROM {_MESSY}""" for how in (*profiles.COERCIONS, *profiles.DATE_FORMATS)) + ")")
def failing_examples(spark, sf):
    """For each of eight ways to read a text column the least three texts that it does not read."""
    return profiles.parse_rates(messy_amounts(read(spark, sf, "lineitem")), ["amount"]).select("column", "how", "n_values", "n_passed", "examples")


@query("""SELECT 'l_orderkey' AS "column", count(*) AS n_rows, count(*) - count(l_orderkey) AS n_null, true AS near, true AS merged FROM lineitem UNION ALL
SELECT 'l_extendedprice', count(*), count(*) - count(l_extendedprice), true, true FROM lineitem UNION ALL
SELECT 'l_returnflag', count(*), count(*) - count(l_returnflag), true, true FROM lineitem""")
def sketched_profile(spark, sf):
    """Sketches of each year's lines, made of one year after the other, merged, against exact figures: distinct values
    within 5 %, the median's rank within 3 %; and the same distinct values as one sketch of all."""
    columns = ["l_orderkey", "l_extendedprice", "l_returnflag"]
    df = read(spark, sf, "lineitem").withColumn("year", F.year("l_shipdate"))
    path, saved = new_folder(spark, "sketches"), None
    for last in (1994, 9999):
        so_far = df.where((F.col("year") <= last) | F.col("year").isNull())
        saved = profiles.part_sketches(so_far, "year", columns) if saved is None else profiles.grown_sketches(saved, so_far, "year", columns)
        saved.write.parquet(f"{path}/{last}")
        saved = spark.read.parquet(f"{path}/{last}")
    merged = profiles.merged_sketches(saved)
    whole = profiles.merged_sketches(profiles.part_sketches(df.withColumn("year", F.lit(0)), "year", columns)).select(
        "column", F.col("n_distinct").alias("at_once"))
    median = {r["column"]: r["quantiles"][0] for r in merged.collect() if r["quantiles"]}  # a row a column
    exact = df.agg(F.array(*[F.struct(
        F.lit(c).alias("column"), F.count_distinct(c).alias("d"),
        (F.avg((F.col(c) <= median[c]).cast("double")) if c in median else F.lit(0.5)).alias("rank")) for c in columns]).alias("x"))
    exact = exact.select(F.explode("x").alias("x")).select("x.*")
    near = (F.abs(F.col("n_distinct") - F.col("d")) <= 0.05 * F.col("d")) & (F.abs(F.col("rank") - 0.5) <= 0.03)
    return merged.join(exact, "column").join(whole, "column").select(
        "column", "n_rows", "n_null", near.alias("near"), (F.abs(F.col("n_distinct") - F.col("at_once")) <= 0.05 * F.col("at_once")).alias("merged"))


def _documents(e: DataFrame) -> DataFrame:
    """Events as JSON texts of several shapes: the keys, and a value's type, go with the event's type."""
    user = F.struct(F.col("user_id").alias("id"), F.when(F.col("event_type") == "signup", "new").alias("state"))
    by_type = {"purchase": F.to_json(F.struct("event_id", user.alias("user"), F.col("value").cast("decimal(18,2)").alias("amount"))),
               "error": F.to_json(F.struct("event_id", F.array("user_id").alias("users"), F.lit("none").alias("amount"))),
               "click": F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit("]"))}
    text = F.to_json(F.struct("event_id", user.alias("user")))
    for kind, made in by_type.items():
        text = F.when(F.col("event_type") == kind, made).otherwise(text)
    return e.select(F.col("event_id").alias("k"), text.alias("doc"))


@query("""SELECT event_id AS k, event_id AS "doc.event_id", CASE WHEN event_type <> 'error' THEN user_id END AS "doc.user.id",
CASE WHEN event_type = 'signup' THEN 'new' END AS "doc.user.state", CASE WHEN event_type = 'error' THEN '[' || user_id || ']' END AS "doc.users",
CASE WHEN event_type = 'error' THEN '"none"' END AS text_amount, CASE WHEN event_type = 'purchase' THEN round(value, 2) END AS amount
FROM events WHERE event_type <> 'click'""")
def json_documents(spark, sf):
    """JSON texts of several shapes, as columns: the union of their keys; a number that is a text elsewhere stays JSON."""
    flat, _ = schemas.flattened_documents(_documents(read(spark, sf, "events")), "doc")
    amount = F.col("`doc.amount`")
    quoted = F.startswith(amount, F.lit('"'))
    return flat.select("k", *[F.col(f"`doc.{c}`") for c in ("event_id", "user.id", "user.state", "users")],
                       F.when(quoted, amount).alias("text_amount"), F.when(~quoted, F.round(amount.cast("double"), 2)).alias("amount"))


@query("""SELECT 'flatten_non_object' AS function, '[' || event_id || ']' AS input_value FROM events WHERE event_type = 'click'""")
def json_rejects(spark, sf):
    return schemas.flattened_documents(_documents(read(spark, sf, "events")), "doc")[1]


@query("""WITH n AS (SELECT count(*) AS n, count(*) FILTER (event_type <> 'click') AS objects, count(*) FILTER (event_type = 'signup') AS new,
count(*) FILTER (event_type NOT IN ('click', 'error')) AS users, count(*) FILTER (event_type = 'error') AS lists, count(*) FILTER (event_type IN ('error', 'purchase')) AS amounts
FROM events WHERE event_type <> 'click')
SELECT path, present AS n_present, round(present / n, 9) AS share FROM (SELECT n, unnest([struct_pack(path := 'event_id', present := objects),
struct_pack(path := 'user.id', present := users), struct_pack(path := 'user.state', present := new), struct_pack(path := 'users', present := lists),
struct_pack(path := 'amount', present := amounts)], recursive := true) FROM n)""")
def json_presence(spark, sf):
    """Paths of JSON documents, none of which was named, and in what share of the documents each has a value."""
    docs = _documents(read(spark, sf, "events")).where(F.startswith("doc", F.lit("{")))
    return schemas.document_presence(docs, "doc").select("path", "n_present", F.round("share", 9).alias("share"))


# --- what had no query of its own ------------------------------------------------------------------------------------------------


@query("""SELECT 'one failed' AS case_name, NULL::DOUBLE AS total, true AS refused UNION ALL
SELECT 'all there', (SELECT sum(o_totalprice) FROM orders) + (SELECT sum(l_extendedprice) FROM lineitem), false""")
def refused_answer(spark, sf):
    """A total over two sources, and the refusal of the whole answer when one of them fails."""
    there = {"orders": read(spark, sf, "orders").select(F.col("o_totalprice").alias("price")),
             "lines": read(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("price"))}
    out = None
    for case, sources in (("one failed", there | {"lines": None}), ("all there", there)):
        try:
            part = relations.reduce_total(sources, "price").select(F.lit(case).alias("case_name"), "total", F.lit(False).alias("refused"))
        except BuildError:
            part = read(spark, sf, "region").limit(1).select(F.lit(case).alias("case_name"), F.lit(None).cast("double").alias("total"), F.lit(True).alias("refused"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT l_orderkey, l_linenumber, floor(l_quantity / 3)::DOUBLE AS whole, floor(-l_extendedprice)::DOUBLE AS below FROM lineitem""")
def whole_numbers(spark, sf):
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", s.int_(field("l_quantity", "number") / 3).col.alias("whole"),
                                              s.int_(-field("l_extendedprice", "number")).col.alias("below"))


@query("""SELECT count(*) AS n, 0::BIGINT AS let_through FROM lineitem""")
def refused_expressions(spark, sf):
    """Expressions over a table that are refused before any row is read: wrong kinds, arity, arguments and branches."""
    df = read(spark, sf, "lineitem")
    number, text = field("l_quantity", "number"), field("l_returnflag", "text")
    wrong = [lambda: number + text, lambda: number & (number > 1), lambda: s.parse_date(text, 7), lambda: s.upper(number),
             lambda: s.coalesce(number, text), lambda: steps.drop_fields(df, ["nope"]), lambda: bool(number > 1)]
    passed = 0
    for build in wrong:
        try:
            build()
            passed += 1
        except BuildError:
            pass
    return df.agg(F.count(F.lit(1)).alias("n"), F.lit(passed).cast("bigint").alias("let_through"))


@query("""SELECT 'same rows dealt anew' AS what, true AS same UNION ALL SELECT 'more of the same shape', true UNION ALL
SELECT 'nulls that were not there', count(*) FILTER (o_orderstatus = 'F') = 0 FROM orders UNION ALL SELECT 'names in another order', true UNION ALL SELECT 'another type', false""")
def stable_hashes(spark, sf):
    """What changes the hash of a profile or of a job's definition, and what does not."""
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    of = lambda d: profiles.profile_hash(profiles.column_stats(d))
    holes = o.withColumn("o_orderstatus", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")))
    typed = o.withColumn("o_orderkey", F.col("o_orderkey").cast("string"))
    rows = [("same rows dealt anew", of(o) == of(o.repartition(3))), ("more of the same shape", of(o) == of(o.unionByName(o))),
            ("nulls that were not there", of(o) == of(holes)),
            ("names in another order", schemas.stable_hash({"a": 1, "b": [2]}) == schemas.stable_hash({"b": [2], "a": 1})),
            ("another type", schemas.stable_hash(o.schema) == schemas.stable_hash(typed.schema))]
    return spark.createDataFrame(rows, "what string, same boolean")


@query("""SELECT e.event_id, (SELECT max_by(o_totalprice, o_orderdate) FROM (SELECT o_orderdate, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1) o
WHERE o_orderdate <= e.at) AS price FROM (SELECT event_id, ts - INTERVAL 27 YEAR AS at FROM events) e""")
def asof_one_key(spark, sf):
    """Every event with the price of the latest order before it: one key has all the prices."""
    e = read(spark, sf, "events").select("event_id", (F.col("ts") - F.expr("INTERVAL 27 YEAR")).alias("at"), F.lit("all").alias("key"))
    o = read(spark, sf, "orders").select(F.col("o_orderdate").cast(e.schema["at"].dataType).alias("since"), F.col("o_totalprice").alias("price"), F.lit("all").alias("key"))
    return relations.asof_join(e, o, ["key"], "at", "since", ["price"]).select("event_id", "price")

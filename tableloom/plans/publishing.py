"""Queries over contracts, types, assertions, sinks and synchronisation: what a user runs before, while and after a
table is published. Each has a twin in DuckDB's SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import field, scalars as s
from ..functions.values import Val
from ..operators import profiles, quality, relations, schemas, steps
from ..operators.predicates import Parameter, Predicate, bind, where_all
from ..sources import sinks, tables
from ..sources.staging import new_folder
from ..streaming import sync
from .catalogue import _MESSY, _MESSY_DATES, messy_amounts, messy_dates
from .registry import query, read

# --- reading --------------------------------------------------------------------------------------------------------


@query("""SELECT least(greatest(o_orderkey // 1000, 0), 7)::INT AS part, count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY 1""")
def partitioned_read(spark, sf):
    found = tables.in_ranges(read(spark, sf, "orders"), "o_orderkey", 0, 8000, 8)
    return found.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


@query("""SELECT o_orderkey FROM orders WHERE ('0x' || substr(md5('7:' || o_orderkey), 1, 8))::BIGINT < 429496729""")
def keyed_sample(spark, sf):
    return tables.keyed_sample(read(spark, sf, "orders"), "o_orderkey", 0.1).select("o_orderkey")


_NATIVE = """CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'bigint' WHEN 'VARCHAR' THEN 'text'
WHEN 'DOUBLE' THEN {double} WHEN 'TIMESTAMP' THEN {stamp} END"""


@query(f"""SELECT "table", "column", system, native, lost FROM (
SELECT t AS "table", column_name AS "column", unnest([struct_pack(system := 'mysql', native := {_NATIVE.format(double="'double'", stamp="'datetime(6)'")},
lost := CASE WHEN column_type = 'TIMESTAMP' THEN 'zone' END), struct_pack(system := 'postgres', native := {_NATIVE.format(double="'double precision'", stamp="'timestamp'")},
lost := NULL)], recursive := true) FROM (SELECT 'lineitem' AS t, column_name, column_type FROM (DESCRIBE lineitem) UNION ALL
SELECT 'orders', column_name, column_type FROM (DESCRIBE orders)))""")
def native_types(spark, sf):
    """The column types that a target system would get for two tables, and what they lose."""
    rows = []
    for t in ("lineitem", "orders"):
        for f in read(spark, sf, t).schema.fields:
            rows += [(t, f.name, system, *schemas.to_native(system, f.dataType)) for system in ("mysql", "postgres")]
    return spark.createDataFrame(rows, "table string, column string, system string, native string, lost string")


@query("""SELECT column_name AS "column", CASE WHEN column_type = 'VARCHAR' THEN 'string' WHEN column_type = 'TIMESTAMP' THEN 'timestamp_ntz'
ELSE lower(column_type) END AS type FROM (DESCRIBE orders)""")
def native_round_trip(spark, sf):
    """Types of a table after they went to a system's names and back."""
    back = [(f.name, schemas.from_native("postgres", schemas.to_native("postgres", f.dataType)[0])[0].simpleString())
            for f in read(spark, sf, "orders").schema.fields]
    return spark.createDataFrame(back, "column string, type string")


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice::DECIMAL(19,4) AS price FROM lineitem""")
def exact_read(spark, sf):
    """A read under the exact types of a source's money columns; columns of types that are not read are left out."""
    custom, left_out = tables.exact_read([("price", "money"), ("l_orderkey", "bigint"), ("shape", "geometry")])
    kinds = {f.name: f.dataType for f in T._parse_datatype_string(custom).fields}
    df = read(spark, sf, "lineitem").withColumnRenamed("l_extendedprice", "price").withColumn("shape", F.lit(b"x"))
    gone = [n for n, _ in left_out]
    cast = [F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns if c not in gone]
    return df.select(*cast).select("l_orderkey", "l_linenumber", "price")


# --- schemas and contracts -----------------------------------------------------------------------------------------


@query("""SELECT event_id::DOUBLE AS id, event_type AS what, ts::TIMESTAMP AS at, value::VARCHAR AS note FROM events
UNION ALL SELECT o_totalprice, o_orderstatus, o_orderdate::TIMESTAMP, o_orderpriority FROM orders
UNION ALL SELECT c_custkey, c_name, NULL, NULL FROM customer""")
def union_widened(spark, sf):
    """Three tables under the least common types: a number beside a text becomes text, what one lacks is null."""
    a = read(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("what"), F.col("ts").alias("at"), F.col("value").alias("note"))
    b = read(spark, sf, "orders").select(F.col("o_totalprice").alias("id"), F.col("o_orderstatus").alias("what"), F.col("o_orderdate").alias("at"),
                                         F.col("o_orderpriority").alias("note"))
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("what"))
    return schemas.union_widened(schemas.union_widened(a, b), c)


@query("""SELECT c_custkey AS customer_key, c_name AS name_2, c_acctbal AS name, c_mktsegment AS name_3 FROM customer""")
def normal_names(spark, sf):
    df = read(spark, sf, "customer").select(F.col("c_custkey").alias("Customer Key"), F.col("c_acctbal").alias("Name!"),
                                            F.col("c_name").alias("NAME"), F.col("c_mktsegment").alias("__name__"))
    return schemas.normalize_names(df)


@query("""SELECT column_name AS "column", CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'HUGEINT' THEN 'bigint' ELSE lower(column_type) END AS type
FROM (DESCRIBE SELECT l_returnflag, count(*) AS n, sum(l_extendedprice * (1 - l_discount)) AS net FROM lineitem GROUP BY 1)""")
def output_schema(spark, sf):
    """The schema that steps give, without reading rows."""
    pipe = steps.Pipeline([
        lambda d: steps.compute(d, "net", field("l_extendedprice") * (1 - field("l_discount"))),
        lambda d: steps.aggregate(d, ["l_returnflag"], [steps.Agg("count", None, "n"), steps.Agg("sum", "net", "net")])])
    found = pipe.output_schema(read(spark, sf, "lineitem"))
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in found.fields], "column string, type string")


@query("""WITH c(name, kind) AS (VALUES ('o_orderkey', 'BIGINT'), ('o_totalprice', 'VARCHAR'), ('o_note', 'VARCHAR'), ('o_orderdate', 'TIMESTAMP'))
SELECT name AS "column", CASE WHEN column_name IS NULL THEN 'missing' ELSE 'is float, not string' END AS problem,
CASE WHEN column_name IS NULL THEN 'ALTER TABLE orders ADD COLUMN ' || name || ' text' END AS fix
FROM c LEFT JOIN (DESCRIBE orders) ON column_name = name WHERE column_type IS NULL OR column_type <> kind""")
def contract_differences(spark, sf):
    have = read(spark, sf, "orders").schema
    want = T.StructType([have["o_orderkey"], T.StructField("o_totalprice", T.StringType()), T.StructField("o_note", T.StringType()), have["o_orderdate"]])
    contract = schemas.build_contract([(n, n) for n in want.names], want, ["o_orderkey"])
    return spark.createDataFrame(schemas.compare_contract(contract, have, "orders"), "column string, problem string, fix string")


@query("""SELECT 'CREATE TABLE IF NOT EXISTS orders (' || string_agg(column_name || ' ' || CASE column_type WHEN 'VARCHAR' THEN 'text' WHEN 'DOUBLE' THEN
'double precision' WHEN 'TIMESTAMP' THEN 'timestamp' ELSE lower(column_type) END || CASE WHEN column_name = 'o_orderkey' THEN ' NOT NULL' ELSE '' END, ', ')
|| ', PRIMARY KEY (o_orderkey))' AS ddl FROM (DESCRIBE orders)""")
def create_table_ddl(spark, sf):
    have = read(spark, sf, "orders").schema
    contract = schemas.build_contract([(n, n) for n in have.names], have, ["o_orderkey"])
    return spark.createDataFrame([(schemas.create_table_sql(contract, "orders"),)], "ddl string")


@query("""SELECT 'stop' AS what, column_name || ' is gone' AS why FROM (DESCRIBE orders) WHERE column_name = 'o_orderpriority' UNION ALL
SELECT 'stop', column_name || ' changed its type' FROM (DESCRIBE orders) WHERE column_name = 'o_totalprice' UNION ALL
SELECT 'warn', 'o_channel is new' UNION ALL SELECT 'unmapped', column_name FROM (DESCRIBE orders) WHERE column_name NOT IN ('o_orderkey', 'o_totalprice', 'o_orderpriority')""")
def target_drift(spark, sf):
    """A target that lost, gained and changed a column since a job over it was saved, and columns that the job leaves out."""
    saved = read(spark, sf, "orders")
    now = saved.drop("o_orderpriority").withColumn("o_totalprice", F.col("o_totalprice").cast("string")).withColumn("o_channel", F.lit("web"))
    mapping = [(c, c) for c in ("o_orderkey", "o_totalprice", "o_orderpriority")]
    found = schemas.target_drift(saved.schema, now.schema, [t for _, t in mapping], ["o_orderkey"], ["o_orderkey"], "upsert", ["upsert", "replace"])
    rows = [(k, v) for k, values in found.items() for v in values] + [("unmapped", c) for c in schemas.unmapped_fields(saved, mapping)]
    return spark.createDataFrame(rows, "what string, why string")


@query("""SELECT c_custkey AS "C CustKey", c_name AS "C-NAME", c_acctbal AS c_acctbal FROM customer""")
def auto_mapped(spark, sf):
    df = read(spark, sf, "customer")
    target = T.StructType([T.StructField("C CustKey", T.LongType()), T.StructField("C-NAME", T.StringType()), df.schema["c_acctbal"],
                           T.StructField("c_note", T.StringType())])
    found = schemas.auto_map(df.schema, target, ["C CustKey"])
    assert not found["errors"] and found["nulls"] == ["c_note"]
    return steps.map_fields(df, found["mapping"])


@query("""SELECT s_suppkey, s_acctbal FROM supplier""")
def resolved_entity(spark, sf):
    """The one table that has the fields that are asked for."""
    entities = {t: read(spark, sf, t).columns for t in ("customer", "supplier", "part", "orders")}
    name = schemas.resolve_entity(entities, ["s_suppkey", "s_acctbal"])
    return read(spark, sf, name).select("s_suppkey", "s_acctbal")


# --- predicates, functions, nested data -----------------------------------------------------------------------------


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-06-01'""")
def relative_dates(spark, sf):
    df = read(spark, sf, "orders")
    now = dt.datetime(1998, 7, 15, 20, tzinfo=dt.timezone.utc)
    rows = [Predicate("o_orderdate", "gte", Parameter("from")), Predicate("o_orderdate", "lt", Parameter("to"))]
    return where_all(df, bind(rows, df.schema, {"from": "startOfYear-1y", "to": "startOfMonth-1m"}, "UTC", now)).select("o_orderkey")


@query("""SELECT l_orderkey, l_linenumber, l_quantity, l_tax IS NOT NULL AS present, l_tax IS NOT NULL AS numeric, l_shipmode IS NOT NULL AS texty,
trunc(l_quantity / 7)::BIGINT AS whole, l_quantity ** 2 AS squared, exp(l_discount) AS grown, ln(l_quantity) / ln(2) AS doublings, lower(l_shipmode) AS mode,
minute(shipped)::DOUBLE AS mi, second(shipped)::DOUBLE AS se FROM (SELECT *, l_returnflag || '-Mode' AS l_shipmode, l_shipdate + l_linenumber * INTERVAL 61 SECOND AS shipped FROM lineitem)""")
def more_functions(spark, sf):
    df = read(spark, sf, "lineitem").withColumn("l_shipmode", F.concat("l_returnflag", F.lit("-Mode"))).withColumn(
        "at", F.col("l_shipdate") + F.make_dt_interval(secs=(F.col("l_linenumber") * 61).cast("decimal(18,6)")))
    q, x = field("l_quantity", "number"), field("l_shipmode", "text")
    at = Val(F.col("at"), (), "date")
    return df.select("l_orderkey", "l_linenumber", "l_quantity", *[v.col.alias(k) for k, v in {
        "present": s.is_not_null(field("l_tax")), "numeric": s.is_number(field("l_tax")), "texty": s.is_text(x),
        "whole": s.to_integer(q / 7), "squared": s.power(q, 2), "grown": s.exp(field("l_discount", "number")), "doublings": s.log(q, 2),
        "mode": s.lower(x), "mi": s.minute(at), "se": s.second(at)}.items()])


@query("""SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type END AS kind, CASE WHEN event_type <> 'error' AND value >= 10 THEN value END AS amount,
CASE WHEN event_type <> 'error' THEN (value >= 20)::INT + (user_id >= 20)::INT ELSE 0 END::BIGINT AS n_parts FROM events""")
def redacted_documents(spark, sf):
    """Documents pruned at three levels by conditions over what they hold."""
    df = read(spark, sf, "events").select("event_id", F.struct(
        F.col("event_type").alias("type"), F.struct("value").alias("money"),
        F.array(F.struct(F.col("value").alias("n")), F.struct(F.col("user_id").cast("double").alias("n"))).alias("parts")).alias("doc"))
    rules = {"doc": lambda c: c["type"] != "error", "doc.money": lambda c: c["value"] >= 10, "doc.parts[]": lambda c: c["n"] >= 20}
    out = steps.redact(df, lambda path, c: rules[path](c) if path in rules else None)
    return out.select("event_id", F.col("doc.type").alias("kind"), F.col("doc.money.value").alias("amount"),
                      F.coalesce(F.size("doc.parts"), F.lit(0)).cast("long").alias("n_parts"))


@query("""SELECT event_type AS type, value FROM events""")
def replaced_root(spark, sf):
    df = read(spark, sf, "events").select(F.struct(F.col("event_type").alias("type"), "value").alias("doc"), "event_id")
    return steps.replace_root(df, "doc")


@query("""SELECT event_id, '{"event_type":"' || event_type || '","user_id":' || user_id || '}' AS doc, '[' || event_id || ',' || user_id || ']' AS ids FROM events""")
def json_columns(spark, sf):
    """Nested values as JSON text, where the target has JSON columns."""
    df = read(spark, sf, "events").select("event_id", F.struct("event_type", "user_id").alias("doc"), F.array("event_id", "user_id").alias("ids"))
    return sinks.coerce_json(df, T.StructType([T.StructField("event_id", T.LongType()), schemas.json_field("doc"), schemas.json_field("ids")]))


@query("""SELECT o_orderkey, '{"status":"' || o_orderstatus || '"}' AS doc FROM orders""")
def to_json_column(spark, sf):
    df = read(spark, sf, "orders").select("o_orderkey", F.struct(F.col("o_orderstatus").alias("status")).alias("o"))
    return steps.to_json(df, "o", "doc").df.select("o_orderkey", "doc")


@query(r"""SELECT o_orderkey, regexp_replace(regexp_replace(o_totalprice::DECIMAL(20,2)::VARCHAR, '0+$', ''), '\.$', '') AS price,
'"123456789012345.0' || lpad(o_orderkey::VARCHAR, 12, '0') || '7"' AS long FROM orders""")
def json_numbers(spark, sf):
    """Decimals as JSON numbers where a double holds them, else as JSON texts."""
    long = F.concat(F.lit("123456789012345.0"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), F.lit("7")).cast("decimal(38,18)")
    return read(spark, sf, "orders").select("o_orderkey", sinks.json_number(F.col("o_totalprice").cast("decimal(20,2)").cast("double")).alias("price"),
                                            sinks.json_number(long).alias("long"))


# --- groups, caps, policies ----------------------------------------------------------------------------------------


@query("""SELECT count(*) AS groups, count(*) > 3 AS refused FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)""")
def group_probe(spark, sf):
    df, keys = read(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"]
    try:
        steps.refuse_many_groups(df, keys, 3)
        refused = False
    except steps.StepFailed:
        refused = True
    return df.select(*keys).distinct().agg(F.count(F.lit(1)).alias("groups"), F.lit(refused).alias("refused"))


@query("""SELECT least(count(*), 500) AS n, count(*) > 500 AS truncated FROM orders UNION ALL SELECT least(count(*), 500), count(*) > 500 FROM nation""")
def capped_rows(spark, sf):
    out = None
    for t in ("orders", "nation"):
        df, more = relations.capped(read(spark, sf, t), 500)
        part = df.agg(F.count(F.lit(1)).alias("n"), F.lit(more).alias("truncated"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT least(count(*), 50) AS n, 'c_name' AS label, 'c_acctbal' AS number FROM customer""")
def preview_rows(spark, sf):
    df, hint = relations.preview(read(spark, sf, "customer").select("c_name", "c_acctbal"))
    return df.agg(F.count(F.lit(1)).alias("n")).withColumns({"label": F.lit(hint[0]), "number": F.lit(hint[1])})


@query(f"""SELECT count(*) FILTER (l_linenumber % 5 <> 0) > 0 AS stopped, 'compute number: to_number failed in ' || count(*) FILTER (l_linenumber % 5 <> 0) || ' rows' AS message
FROM {_MESSY}""")
def fail_policy(spark, sf):
    df = messy_amounts(read(spark, sf, "lineitem"))
    try:
        steps.compute(df, "number", s.to_number(field("amount", "text")))
        message = None
    except steps.StepFailed as e:
        message = str(e)
    return df.limit(1).select(F.lit(message is not None).alias("stopped"), F.lit(message).alias("message"))


# --- profiles ------------------------------------------------------------------------------------------------------


def _bucket(condition: str, name: str) -> str:
    return f"CASE count(*) FILTER ({condition}) WHEN 0 THEN 'none' WHEN count(*) THEN 'all' ELSE 'some' END AS {name}"


@query(f"""SELECT 'amount' AS "column", {_bucket("amount IS NULL", '"null"')}, {_bucket("amount = ''", "empty")}, {_bucket("amount <> '' AND trim(amount) = ''", "blank")},
{_bucket("amount = 'n/a'", "missing_token")}, coalesce(bool_or(regexp_matches(amount, '^0[0-9]+$')), false) AS leading_zeros FROM {_MESSY}""")
def profile_signature(spark, sf):
    return profiles.signatures(profiles.column_stats(messy_amounts(read(spark, sf, "lineitem")), ["amount"]))


@query(f"""SELECT 'amount' AS "column", count(*) FILTER (l_linenumber % 5 <> 0) AS failed,
round(count(*) FILTER (l_linenumber % 5 <> 0) / count(*), 9) AS rate, round(greatest(2 * count(*) FILTER (l_linenumber % 5 <> 0) / count(*), 0.01), 9) AS max_rate FROM {_MESSY}""")
def cleaning_dry_run(spark, sf):
    df = messy_amounts(read(spark, sf, "lineitem"))
    plan = profiles.CleanPlan({"amount": s.to_number(field("amount", "text"))})
    rows = [(r["column"], r["failed"], round(r["rate"], 9), round(r["max_rate"], 9)) for r in plan.dry_run(df)]
    return spark.createDataFrame(rows, "column string, failed bigint, rate double, max_rate double")


@query(f"""SELECT CASE WHEN (SELECT count(*) FILTER (day = 'N/A') FROM {_MESSY_DATES}) > 0 THEN 'profile' END AS reason""")
def profile_drift(spark, sf):
    """The first reason for which a cleaning plan no longer holds: missing words came into a column."""
    dates = messy_dates(read(spark, sf, "orders")).select("o_orderkey", "day")
    before = dates.withColumn("day", F.when(F.col("day") != "N/A", F.col("day")).otherwise("2024-01-01"))
    saved, now = ({"schema": schemas.stable_hash(d.schema), "signature_version": 1,
                   "profile": profiles.profile_hash(profiles.column_stats(d, ["day"]))} for d in (before, dates))
    return dates.limit(1).select(F.lit(profiles.drift(saved, now)).alias("reason"))


# --- assertions and sinks -------------------------------------------------------------------------------------------


def _holds(check, *args, **kw) -> bool:
    try:
        check(*args, **kw)
        return True
    except (quality.AssertionFailed, sync.SyncStopped):
        return False


@query("""WITH o AS (SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'X') AS x FROM orders)
SELECT 'shrink' AS check_name, f >= 0.5 * n AS passed FROM o UNION ALL SELECT 'shrink allowed', true FROM o UNION ALL
SELECT 'failure rate', (n - x) / n <= 0.999 FROM o UNION ALL SELECT 'empty replace', x > 0 FROM o UNION ALL
SELECT 'keys', (SELECT count(DISTINCT o_orderkey) = count(*) FROM orders) UNION ALL
SELECT 'repeated keys', (SELECT count(DISTINCT l_orderkey) = count(*) FROM lineitem) UNION ALL SELECT 'reproduces', true FROM o""")
def publish_checks(spark, sf):
    """Assertions before a table is published, each on real counts."""
    o = read(spark, sf, "orders")
    n, f, x = o.agg(F.count(F.lit(1)), F.count_if(F.col("o_orderstatus") == "F"), F.count_if(F.col("o_orderstatus") == "X")).first()
    rows = [("shrink", _holds(quality.assert_no_shrink, f, n)), ("shrink allowed", _holds(quality.assert_no_shrink, f, n, allow=True)),
            ("failure rate", _holds(quality.assert_failure_rate, n - x, x)),
            ("empty replace", _holds(sync.refuse_empty_replace, o.where("o_orderstatus = 'X'"))),
            ("keys", _holds(quality.assert_keys, o, ["o_orderkey"])),
            ("repeated keys", _holds(quality.assert_keys, read(spark, sf, "lineitem"), ["l_orderkey"])),
            ("reproduces", quality.reproduces(lambda: o, n))]
    return spark.createDataFrame(rows, "check_name string, passed boolean")


@query("""SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders""")
def written_and_checked(spark, sf):
    """A direct write, read back and compared with its source by checksum and keys."""
    df = read(spark, sf, "orders")
    path = new_folder(spark, "direct")
    sinks.write_direct(df, path, "overwrite")
    back = spark.read.parquet(path)
    if not quality.same_table(df, back, ["o_orderkey"]):
        raise quality.AssertionFailed("the table was not written as it is")
    return back.select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query(f"""SELECT 'r1' AS run_id, 'lines' AS dest_table, 'compute number' AS step_id, 'to_number' AS function, amount AS input_value, 'open' AS status,
count(*) AS n FROM {_MESSY} WHERE l_linenumber % 5 <> 0 GROUP BY amount""")
def quarantine_table(spark, sf):
    """All rejected rows of a run, written beside the table and read back."""
    found = steps.compute(messy_amounts(read(spark, sf, "lineitem")), "number", s.to_number(field("amount", "text")), "quarantine")
    table = sinks.VersionedTable(spark, new_folder(spark, "lines"))
    rows = table.quarantine(found.rejects, "r1", "lines")
    return rows.groupBy("run_id", "dest_table", "step_id", "function", "input_value", "status").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, event_type, round(value, 2) AS value, (SELECT count(*) FROM events) AS trailer FROM events""")
def ndjson_round_trip(spark, sf):
    path = new_folder(spark, "ndjson")
    df = read(spark, sf, "events").select("event_id", "event_type", F.round("value", 2).alias("value"))
    sinks.write_ndjson(df, path)
    n = spark.read.schema("columns string, row_count bigint").json(f"{path}/trailer").first()["row_count"]
    return spark.read.schema(df.schema).json(f"{path}/rows").withColumn("trailer", F.lit(n))


@query("""SELECT doc_id, md5(text) AS md5, source FROM documents""")
def csv_round_trip(spark, sf):
    """Whole texts with quotes and line breaks through CSV and back."""
    path = new_folder(spark, "csv")
    df = read(spark, sf, "documents").select("doc_id", "text", "source")
    sinks.write_csv(df, path)
    back = sinks.read_csv(spark, path, df.schema)
    return back.select("doc_id", F.md5("text").alias("md5"), "source")


# --- synchronisation -------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderkey IS NOT NULL""")
def usable_keys(spark, sf):
    """Rows without a key are skipped, and counted where they would stop the run."""
    df = read(spark, sf, "orders").withColumn("key", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderkey").cast("string")).otherwise(""))
    return sync.usable_keys(df, ["key"], "skip").select("o_orderkey")


@query("""SELECT 'same job' AS job, count(*) FILTER (o_orderdate >= TIMESTAMP '1997-01-01') AS n FROM orders UNION ALL SELECT 'changed job', count(*) FROM orders""")
def bookmark_of_job(spark, sf):
    """A bookmark holds only for the job it was saved by; a changed job reads everything."""
    df = read(spark, sf, "orders")
    job = {"table": "orders", "columns": df.columns}
    mark = sync.Bookmark(schemas.stable_hash(job), dt.datetime(1997, 1, 1))
    out = None
    for name, now in (("same job", job), ("changed job", job | {"columns": ["o_orderkey"]})):
        part = sync.changed_since(df, "o_orderdate", mark.time_for(now)).agg(F.lit(name).alias("job"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0""")
def key_list(spark, sf):
    """The key list after a replacement, with the keys of a later tick added."""
    saved = sync.rebuilt_keys(read(spark, sf, "orders").where("o_orderstatus = 'F'"), ["o_custkey"])
    return sync.added_keys(saved, read(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"])


@query("""SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN o_totalprice + 1 ELSE o_totalprice END AS price FROM orders
WHERE NOT (o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderstatus = 'P')""")
def sync_modes(spark, sf):
    """A whole-table replacement, then a delta with soft deletes since a bookmark, as versions of one table."""
    o = read(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), "o_orderdate", "o_orderstatus")
    table = sinks.VersionedTable(spark, new_folder(spark, "modes"))
    sync.replace_table(table, o, "whole", ["o_orderkey"])
    delta = o.withColumn("price", F.col("price") + 1).withColumn("gone", F.col("o_orderstatus") == "P")
    sync.upsert_delta(table, delta, "delta", ["o_orderkey"], "o_orderdate", dt.datetime(1998, 1, 1), "gone")
    return table.read().select("o_orderkey", "price")


# --- analytics -------------------------------------------------------------------------------------------------------


@query("""SELECT c_custkey AS user_id, c_name, count(DISTINCT n_regionkey) AS organisations, count(o_orderkey) AS runs FROM customer JOIN nation ON n_nationkey = c_nationkey
LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""")
def user_list(spark, sf):
    """Users with the number of organisations they belong to and of their runs."""
    c = read(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    member = c.join(read(spark, sf, "nation").select("n_nationkey", "n_regionkey"), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", "n_regionkey").distinct()
    return relations.with_counts(c, "c_custkey", {"organisations": (member, "c_custkey"), "runs": (read(spark, sf, "orders"), "o_custkey")}).select(
        F.col("c_custkey").alias("user_id"), "c_name", "organisations", "runs")


@query("""SELECT n_nationkey, members, runs, last_run, last_status FROM (SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS members FROM nation)
LEFT JOIN (SELECT c_nationkey, count(*) AS runs, max(o_orderkey) FILTER (k = 1) AS last_run, max(o_orderstatus) FILTER (k = 1) AS last_status FROM (
SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1)
ON c_nationkey = n_nationkey""")
def organisation_overview(spark, sf):
    """Each organisation with its members, runs and last run."""
    c = read(spark, sf, "customer").select("c_custkey", "c_nationkey")
    runs = read(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    best = F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus"))
    seen = runs.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("runs"), best.alias("last"))  # combined before the shuffle
    members = relations.with_counts(read(spark, sf, "nation").select("n_nationkey"), "n_nationkey", {"members": (c, "c_nationkey")})
    return members.join(seen, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        "n_nationkey", "members", "runs", F.col("last.o_orderkey").alias("last_run"), F.col("last.o_orderstatus").alias("last_status"))


@query("""SELECT event_type, count(*) AS runs, count(*) FILTER (value >= 20) AS large, round(avg(value), 6) AS mean, max(ts) AS last_at FROM events GROUP BY 1""")
def workflow_summary(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("value") >= 20).alias("large"), F.round(F.avg("value"), 6).alias("mean"), F.max("ts").alias("last_at"))


@query("""SELECT * FROM (SELECT 'event' AS source, event_id AS id, ts AS moment, event_type AS what FROM events UNION ALL
SELECT 'order', o_orderkey, o_orderdate, o_orderstatus FROM orders) ORDER BY moment DESC, source, id LIMIT 40""")
def activity_feed(spark, sf):
    """The latest of two kinds of activity, newest first."""
    e = read(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("moment"), F.col("event_type").alias("what"))
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("moment"), F.col("o_orderstatus").alias("what"))
    return relations.merged({"event": e, "order": o}).orderBy(F.desc("moment"), "source", "id").limit(40)


@query("""SELECT source, id, what, count(*) OVER () AS total FROM (SELECT 'events' AS source, event_id AS id, event_type AS what, ts AS moment FROM events UNION ALL
SELECT 'orders', o_orderkey, o_orderstatus, o_orderdate FROM orders) WHERE source = 'events' AND what IN ('purchase', 'error')
AND moment >= TIMESTAMP '2024-01-05' AND moment < TIMESTAMP '2024-01-25'""")
def audit_export(spark, sf):
    """The audit feed under filters as CSV, whole, with the number of rows that the filters leave."""
    e = read(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("what"), F.col("ts").alias("moment"))
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("what"), F.col("o_orderdate").alias("moment"))
    feed = relations.merged({"events": e, "orders": o})
    rows = [Predicate("source", "eq", "events"), Predicate("what", "in", ["purchase", "error"]), Predicate("moment", "gte", dt.datetime(2024, 1, 5)),
            Predicate("moment", "lt", dt.datetime(2024, 1, 25))]
    found = where_all(feed, rows).select("source", "id", "what")
    path = new_folder(spark, "audit")
    sinks.write_csv(found, path)
    back = sinks.read_csv(spark, path, found.schema)
    return back.withColumn("total", F.lit(back.count()))

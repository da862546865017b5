"""All named queries of the library (without the text-preparation subpackage).

Each query reads the driver's tables from ``sf_dir`` and has a twin in DuckDB's SQL where SQL can express it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import field, if_, ifs, literal, scalars as s, switch
from ..functions.values import Val
from ..operators import profiles, quality, relations, schemas, steps
from ..operators.predicates import Parameter, Predicate, bind, date_range, search, where_all
from ..sources import keyed, sinks, tables
from ..sources.staging import new_folder
from ..streaming import sync
from . import analytics
from .registry import ORACLE, QUERIES, query, read

_money = "decimal(20,2)"


def _cents(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 4)


# --- steps and aggregates -----------------------------------------------------------------------------------------


@query("""SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net,
       round(avg(l_extendedprice * (1 - l_discount)), 4) AS mean_net
FROM lineitem WHERE l_discount >= 0.05 GROUP BY l_returnflag HAVING count(*) > 100""")
def flagship_discount_summary(spark: SparkSession, sf: str) -> DataFrame:
    df = steps.filter_rows(read(spark, sf, "lineitem"), field("l_discount", "number") >= 0.05).df
    df = steps.compute(df, "net", field("l_extendedprice") * (1 - field("l_discount"))).df
    aggs = [steps.Agg("count", None, "n"), steps.Agg("sum", "net", "net"), steps.Agg("avg", "net", "mean_net")]
    df = steps.aggregate(df, ["l_returnflag"], aggs, having=field("n") > 100).df
    return df.select("l_returnflag", "n", F.round("net", 2).alias("net"), F.round("mean_net", 4).alias("mean_net"))


@query("""SELECT count(*) AS n, count(l_tax) AS n_tax, count(DISTINCT l_suppkey) AS suppliers,
       round(sum(l_quantity), 2) AS quantity, round(avg(l_quantity), 6) AS mean, min(l_shipdate) AS first_ship,
       max(l_returnflag) AS last_flag FROM lineitem""")
def whole_table_aggregate(spark, sf):
    a = steps.Agg
    df = steps.aggregate(read(spark, sf, "lineitem"), [], [
        a("count", None, "n"), a("count_field", "l_tax", "n_tax"), a("count_distinct", "l_suppkey", "suppliers"),
        a("sum", "l_quantity", "quantity"), a("avg", "l_quantity", "mean"), a("min", "l_shipdate", "first_ship"),
        a("max", "l_returnflag", "last_flag")]).df
    return df.withColumn("quantity", F.round("quantity", 2)).withColumn("mean", F.round("mean", 6))


@query("""WITH p AS (SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, count(*) AS statuses, sum(n)::BIGINT AS n, round(sum(q) / sum(n), 6) AS mean FROM p GROUP BY 1""")
def multi_level_rollup(spark, sf):
    a = steps.Agg
    df = steps.aggregate(read(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"],
                         [a("count", None, "n1"), a("sum", "l_quantity", "q1")]).df
    df = steps.aggregate(df, ["l_returnflag"], [a("count", None, "statuses"), a("sum", "n1", "n"), a("sum", "q1", "q")]).df
    return steps.compute(df, "mean", s.divide(field("q"), field("n"))).df.select(
        "l_returnflag", "statuses", "n", F.round("mean", 6).alias("mean"))


@query("""SELECT o_orderpriority, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END
AS o_orderpriority FROM orders) GROUP BY 1""")
def null_keys_form_a_group(spark, sf):
    df = read(spark, sf, "orders").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")))
    return steps.aggregate(df, ["o_orderpriority"], [steps.Agg("count", None, "n")]).df


@query("SELECT l_orderkey, l_linenumber, l_quantity AS qty FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def project_filter_map(spark, sf):
    df = steps.filter_rows(read(spark, sf, "lineitem"),
                           (field("l_quantity", "number") > 45) & (field("l_returnflag", "text") == "R")).df
    df = steps.drop_fields(df, ["l_tax", "l_discount"]).df
    return steps.map_fields(df, [("l_orderkey", "l_orderkey"), ("l_linenumber", "l_linenumber"), ("l_quantity", "qty")])


@query("""SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 5 AND 20 AND p_brand IN ('Brand#12', 'Brand#13', 'Brand#21')
AND p_retailprice >= 1000 AND contains(lower(p_type), 'a') AND p_name IS NOT NULL AND p_size <> 7""")
def row_predicates(spark, sf):
    rows = [Predicate("p_size", "between", (5, 20)), Predicate("p_brand", "in", ["Brand#12", "Brand#13", "Brand#21"]),
            Predicate("p_retailprice", "gte", Parameter("least")), Predicate("p_type", "contains", "A", True),
            Predicate("p_name", "is_not_null"), Predicate("p_size", "neq", 7)]
    df = read(spark, sf, "part")
    return where_all(df, bind(rows, df.schema, {"least": 1000})).select("p_partkey", "p_name")


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '1') OR contains(lower(c_mktsegment), 'build')")
def free_text_search(spark, sf):
    df = read(spark, sf, "customer")
    return search(df, "BUILD", ["c_mktsegment"]).unionByName(search(df, "1", ["c_name"])).dropDuplicates(["c_custkey"]).select("c_custkey", "c_name")


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'
AND o_orderstatus = 'F'""")
def half_open_range(spark, sf):
    return date_range(read(spark, sf, "orders"), "o_orderdate", dt.datetime(1995, 1, 1), dt.datetime(1996, 1, 1),
                      o_orderstatus="F").select("o_orderkey")


@query("""SELECT l_returnflag, CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'middle' ELSE 'large' END AS size,
CASE l_linestatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE '?' END AS status,
CASE WHEN l_discount = 0 THEN 0 ELSE 1 END AS discounted, count(*) AS n FROM lineitem GROUP BY ALL""")
def branches(spark, sf):
    df = read(spark, sf, "lineitem")
    q = field("l_quantity", "number")
    for name, v in (("size", ifs(q < 10, "small", q < 30, "middle", "large")),
                    ("status", switch(field("l_linestatus", "text"), "O", "open", "F", "filled", "?")),
                    ("discounted", if_(field("l_discount", "number") == 0, 0, 1))):
        df = steps.compute(df, name, v).df
    return df.groupBy("l_returnflag", "size", "status", "discounted").agg(F.count(F.lit(1)).alias("n"))


# --- scalar functions ---------------------------------------------------------------------------------------------


@query(r"""SELECT p_partkey, concat(p_name, '/', p_brand) AS joined, upper(p_name) AS up, length(p_name)::DOUBLE AS len,
left(p_name, 3) AS l3, right(p_name, 4) AS r4, substring(p_name, 2, 3) AS m, replace(p_brand, '#', '-') AS sub,
instr(p_name, 'a')::DOUBLE AS at, repeat(p_brand, 2) AS twice,
CASE WHEN len(string_split(p_type, ' ')) >= 2 THEN string_split(p_type, ' ')[2] END AS second,
CASE WHEN regexp_matches(p_brand, '[0-9]+') THEN regexp_extract(p_brand, '[0-9]+') END AS digits,
regexp_replace(p_brand, '([A-Z])', '<\1>', 'g') AS marked, contains(p_type, 'STEEL') AS steel FROM part""")
def text_functions(spark, sf):
    n, b, t = field("p_name", "text"), field("p_brand", "text"), field("p_type", "text")
    return read(spark, sf, "part").select("p_partkey", *[v.col.alias(k) for k, v in {
        "joined": s.concat(n, "/", b), "up": s.upper(n), "len": s.len_(n), "l3": s.left(n, 3), "r4": s.right(n, 4),
        "m": s.mid(n, 2, 3), "sub": s.substitute(b, "#", "-"), "at": s.find("a", n), "twice": s.rept(b, 2),
        "second": s.split(t, " ", 2), "digits": s.regex_extract(b, "[0-9]+"),
        "marked": s.regex_replace(b, "([A-Z])", "<\\1>"), "steel": s.contains(t, "STEEL")}.items()])


@query("""SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, floor(l_extendedprice) AS fl, ceil(l_extendedprice) AS ce,
trunc(-l_extendedprice) AS tr, sign(l_quantity - 25) AS si, abs(l_quantity - 25) AS ab,
CASE WHEN l_quantity - 25 >= 0 THEN sqrt(l_quantity - 25) END AS sq,
CASE WHEN l_linenumber - 3 <> 0 THEN l_quantity / (l_linenumber - 3) END AS di,
l_quantity - 7 * floor(l_quantity / 7) AS mo, trunc(l_quantity / 7) AS qu,
floor(abs(l_extendedprice) * 10 + 0.5) / 10 AS ro, ceil(l_extendedprice * 10) / 10 AS ru, floor(l_extendedprice * 10) / 10 AS rd,
floor(abs(l_quantity / 5) + 0.5) * 5 AS rm, CASE WHEN l_discount > 0 THEN ln(l_discount) END AS lg FROM lineitem""")
def math_functions(spark, sf):
    q, p, n, d = (field(c, "number") for c in ("l_quantity", "l_extendedprice", "l_linenumber", "l_discount"))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", *[v.col.alias(k) for k, v in {
        "fl": s.floor(p), "ce": s.ceil(p), "tr": s.trunc(-p), "si": s.sign(q - 25), "ab": s.abs_(q - 25), "sq": s.sqrt(q - 25),
        "di": s.divide(q, n - 3), "mo": s.mod(q, 7), "qu": s.quotient(q, 7), "ro": s.round_(p, 1), "ru": s.round_up(p, 1),
        "rd": s.round_down(p, 1), "rm": s.round_to_multiple(q, 5), "lg": s.ln(d)}.items()])


@query("""SELECT o_orderkey, year(o_orderdate)::DOUBLE AS y, month(o_orderdate)::DOUBLE AS m, day(o_orderdate)::DOUBLE AS d,
quarter(o_orderdate)::DOUBLE AS q, isodow(o_orderdate)::DOUBLE AS w, hour(o_orderdate)::DOUBLE AS h,
(year(TIMESTAMP '1998-08-02') - year(o_orderdate))::DOUBLE AS years,
((year(TIMESTAMP '1998-08-02') - year(o_orderdate)) * 12 + month(TIMESTAMP '1998-08-02') - month(o_orderdate))::DOUBLE AS months,
trunc((epoch(TIMESTAMP '1998-08-02') - epoch(date_trunc('second', o_orderdate))) / 86400)::DOUBLE AS days,
date_trunc('second', o_orderdate) + INTERVAL 1 MONTH AS next_month,
date_trunc('second', o_orderdate) + INTERVAL 129600 SECOND AS later FROM orders""")
def date_functions(spark, sf):
    d = field("o_orderdate", "date")
    end = Val(F.lit(dt.datetime(1998, 8, 2)), (), "date")
    return read(spark, sf, "orders").select("o_orderkey", *[v.col.alias(k) for k, v in {
        "y": s.year(d), "m": s.month(d), "d": s.day(d), "q": s.quarter(d), "w": s.weekday(d), "h": s.hour(d),
        "years": s.date_diff(end, d, "year"), "months": s.date_diff(end, d, "month"), "days": s.date_diff(end, d, "day"),
        "next_month": s.date_add(d, 1, "month"), "later": s.date_add(d, 1.5, "day")}.items()])


def messy_amounts(df: DataFrame) -> DataFrame:
    """Texts as people enter them, out of prices."""
    price = F.col("l_extendedprice").cast("decimal(20,2)").cast("string")
    return df.withColumn("amount", F.when(F.col("l_linenumber") % 5 == 0, price)
                         .when(F.col("l_linenumber") % 5 == 1, F.concat(F.lit("$"), price))
                         .when(F.col("l_linenumber") % 5 == 2, F.concat(price, F.lit(" kg")))
                         .when(F.col("l_linenumber") % 5 == 3, F.lit("n/a")).otherwise(F.lit("  ")))


_MESSY = """(SELECT *, CASE l_linenumber % 5 WHEN 0 THEN l_extendedprice::DECIMAL(20,2)::VARCHAR
WHEN 1 THEN '$' || l_extendedprice::DECIMAL(20,2)::VARCHAR WHEN 2 THEN l_extendedprice::DECIMAL(20,2)::VARCHAR || ' kg'
WHEN 3 THEN 'n/a' ELSE '  ' END AS amount FROM lineitem)"""


@query(f"""SELECT l_orderkey, l_linenumber, amount, CASE WHEN l_linenumber % 5 = 0 THEN amount::DOUBLE END AS number,
CASE WHEN l_linenumber % 5 = 0 THEN trunc(amount::DOUBLE)::BIGINT END AS whole, l_linenumber % 5 IN (3, 4) AS missing,
l_linenumber % 5 = 0 AS looks FROM {_MESSY}""")
def coercions_on_messy_text(spark, sf):
    a = field("amount", "text")
    return messy_amounts(read(spark, sf, "lineitem")).select(
        "l_orderkey", "l_linenumber", "amount", s.to_number(a).col.alias("number"), s.to_integer(a).col.alias("whole"),
        s.is_missing_token(a).col.alias("missing"), s.looks_numeric(a).col.alias("looks"))


def messy_dates(df: DataFrame) -> DataFrame:
    d = F.col("o_orderdate")
    return df.withColumn("day", F.when(F.col("o_orderkey") % 4 == 0, F.date_format(d, "yyyy-MM-dd"))
                         .when(F.col("o_orderkey") % 4 == 1, F.date_format(d, "dd/MM/yyyy"))
                         .when(F.col("o_orderkey") % 4 == 2, F.date_format(d, "yyyy/MM/dd")).otherwise(F.lit("N/A")))


_MESSY_DATES = """(SELECT *, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE 'N/A' END AS day FROM orders)"""


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN date_trunc('day', o_orderdate) END AS iso,
CASE WHEN o_orderkey % 4 = 1 THEN date_trunc('day', o_orderdate) END AS dmy,
CASE WHEN o_orderkey % 4 = 2 THEN date_trunc('day', o_orderdate) END AS slashed FROM {_MESSY_DATES}""")
def parse_dates(spark, sf):
    d = field("day", "text")
    return messy_dates(read(spark, sf, "orders")).select(
        "o_orderkey", s.to_date(d).col.alias("iso"), s.parse_date(d, "DD/MM/YYYY").col.alias("dmy"),
        s.parse_date(d, "YYYY/MM/DD").col.alias("slashed"))


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice,
regexp_replace(regexp_replace((floor(l_extendedprice * 1e6 + 0.5) / 1e6)::DECIMAL(38,6)::VARCHAR, '0+$', ''), '\\.$', '') AS txt,
(floor(l_extendedprice * 1000 + 0.5) / 1000)::DECIMAL(38,3)::VARCHAR AS fixed3 FROM lineitem""".replace("\\\\", "\\"))
def number_texts(spark, sf):
    p = field("l_extendedprice", "number")
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", s.to_text(p).col.alias("txt"),
                                              s.format_number(p, 3).col.alias("fixed3"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'))) AS canonical,
regexp_matches(text, '(?i)licensed under') AS licensed, length(text)::DOUBLE AS chars FROM documents""")
def regex_clean(spark, sf):
    t = field("text", "text")
    return read(spark, sf, "documents").select(
        "doc_id", F.md5(s.canonicalize(t).col).alias("canonical"), s.regex_match(t, "licensed under", True).col.alias("licensed"),
        s.len_(t).col.alias("chars"))


@query("SELECT doc_id, md5(strip_accents(text)) AS bare FROM documents")
def strip_accents(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(s.strip_accents(field("text", "text")).col).alias("bare"))


# --- failure policies ------------------------------------------------------------------------------------------------


@query(f"SELECT l_orderkey, l_linenumber, amount::DOUBLE AS number FROM {_MESSY} WHERE l_linenumber % 5 = 0")
def quarantine_kept(spark, sf):
    r = steps.compute(messy_amounts(read(spark, sf, "lineitem")), "number", s.to_number(field("amount", "text")), "quarantine")
    return r.df.select("l_orderkey", "l_linenumber", "number")


@query(f"""SELECT 'compute number' AS step, 'to_number' AS function, amount AS input_value, count(*) AS n FROM {_MESSY}
WHERE l_linenumber % 5 <> 0 GROUP BY amount""")
def quarantine_rejects(spark, sf):
    r = steps.compute(messy_amounts(read(spark, sf, "lineitem")), "number", s.to_number(field("amount", "text")), "quarantine")
    return r.rejects.groupBy("step", "function", "input_value").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT count(*) AS kept, count(*) FILTER (l_linenumber % 5 = 0) AS with_number FROM {_MESSY}")
def null_policy(spark, sf):
    r = steps.compute(messy_amounts(read(spark, sf, "lineitem")), "number", s.to_number(field("amount", "text")), "null")
    return r.df.agg(F.count(F.lit(1)).alias("kept"), F.count("number").alias("with_number"))


@query(f"SELECT 'filter' AS step, 'to_number' AS functions, 'drop' AS policy, count(*) FILTER (l_linenumber % 5 <> 0) AS failed FROM {_MESSY}")
def drop_count(spark, sf):
    df = messy_amounts(read(spark, sf, "lineitem"))
    pipe = steps.Pipeline([lambda d: steps.filter_rows(d, s.to_number(field("amount", "text")) > 0, "drop")])
    pipe.run(df).df.write.format("noop").mode("overwrite").save()
    return pipe.report(spark)


@query(f"""SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber % 5 = 0 THEN amount::DOUBLE END, 0) AS number,
l_linenumber % 5 <> 0 AS bad FROM {_MESSY}""")
def handled_failures(spark, sf):
    n = s.to_number(field("amount", "text"))
    df = steps.compute(messy_amounts(read(spark, sf, "lineitem")), "number", s.coalesce(n, 0)).df
    return steps.compute(df, "bad", s.is_null(n)).df.select("l_orderkey", "l_linenumber", "number", "bad")


@query("""SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderkey % 7 <> 0""")
def conform_to_contract(spark, sf):
    df = read(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"))
    names = ["o_orderkey", "o_totalprice", "o_orderdate"]
    contract = schemas.build_contract([(n, n) for n in names], read(spark, sf, "orders").schema, ["o_orderkey"])
    return schemas.conform(df, contract).df


@query("""SELECT 'conform' AS step, 'to_number' AS function, 'x' AS input_value, count(*) AS n FROM orders WHERE o_orderkey % 7 = 0""")
def conform_rejects(spark, sf):
    df = read(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"))
    contract = schemas.build_contract([(n, n) for n in df.columns], read(spark, sf, "orders").schema)
    return schemas.conform(df, contract).rejects.groupBy("step", "function", "input_value").agg(F.count(F.lit(1)).alias("n"))


# --- JSON and documents ------------------------------------------------------------------------------------------------


@query("SELECT event_id, props->>'$.k' AS props_k FROM events")
def props_flatten(spark, sf):
    return steps.flatten_json(read(spark, sf, "events"), "props").df.select("event_id", "props_k")


@query("""SELECT 'flatten props' AS step, 'flatten_non_object' AS function, input_value, count(*) AS n FROM (
SELECT CASE WHEN event_id % 10 = 0 THEN '[1]' WHEN event_id % 10 = 1 THEN '7' END AS input_value FROM events)
WHERE input_value IS NOT NULL GROUP BY ALL""")
def doc_flatten_quarantine(spark, sf):
    df = read(spark, sf, "events").withColumn("props", F.when(F.col("event_id") % 10 == 0, "[1]").when(
        F.col("event_id") % 10 == 1, "7").when(F.col("event_id") % 10 == 2, "null").otherwise(F.col("props")))
    r = steps.flatten_json(df, "props", ["k"])
    return r.rejects.groupBy("step", "function", "input_value").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey, c_nationkey AS c_where_nation, c_mktsegment AS c_what_segment, c_acctbal AS c_what_balance_amount FROM customer""")
def struct_flatten(spark, sf):
    df = read(spark, sf, "customer").select(
        "c_custkey", F.struct(F.struct(F.col("c_nationkey").alias("nation")).alias("where"), F.struct(
            F.col("c_mktsegment").alias("segment"), F.struct(F.col("c_acctbal").alias("amount")).alias("balance")).alias("what")).alias("c"))
    return steps.flatten(df, "c", 3).df


@query("""SELECT o_orderkey, count(l_orderkey) AS n_items FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def lookup_and_unwind(spark, sf):
    orders = read(spark, sf, "orders").select("o_orderkey")
    lines = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    df = steps.lookup(orders, lines, "o_orderkey", "l_orderkey", "items")
    df = steps.unwind(df, "items", keep_empty=True)
    return df.groupBy("o_orderkey").agg(F.count("items").alias("n_items"))


@query("""SELECT r_regionkey, r_name, coalesce((SELECT '[' || string_agg('{"n_name":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']'
FROM nation WHERE n_regionkey = r_regionkey), '[]') AS nations FROM region""")
def children_as_json(spark, sf):
    return steps.children_json(read(spark, sf, "region"), read(spark, sf, "nation"),
                               "r_regionkey", "n_regionkey", ["n_name"], ["n_nationkey"], "nations")


_KIND = """CASE WHEN bool_and(regexp_full_match(v, '-?[0-9]+')) THEN 'integer' WHEN bool_and(regexp_full_match(v, '-?[0-9]+([.][0-9]+)?'))
THEN 'float' ELSE 'string' END AS kind"""


@query(f"""SELECT field, {_KIND} FROM (SELECT 'id' AS field, event_id::VARCHAR AS v FROM events UNION ALL SELECT 'a.n', props->>'$.k' FROM events
UNION ALL SELECT 'a.s', event_type FROM events UNION ALL SELECT 'mix', CASE WHEN event_id % 2 = 0 THEN '1.5' ELSE '2' END FROM events) GROUP BY 1""")
def infer_documents(spark, sf):
    df = read(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("id"), F.get_json_object("props", "$.k").alias("a.n"),
        F.concat(F.lit('"'), F.col("event_type"), F.lit('"')).alias("a.s"),
        F.when(F.col("event_id") % 2 == 0, "1.5").otherwise("2").alias("mix"))
    found = schemas.infer_schema(schemas.shape_counts(df, df.columns), df.count())

    def walk(t, prefix=""):
        for f in t.fields:
            if hasattr(f.dataType, "fields"):
                yield from walk(f.dataType, f"{prefix}{f.name}.")
            else:
                yield prefix + f.name, schemas.kind_of(f.dataType)

    return spark.createDataFrame(list(walk(found)), "field string, kind string")


@query("""SELECT event_id, event_type AS "doc.type", value AS "doc.at.value", '[' || event_id || ',' || user_id || ']' AS "doc.ids" FROM events""")
def flatten_documents(spark, sf):
    df = read(spark, sf, "events").select("event_id", F.struct(
        F.col("event_type").alias("type"), F.struct("value").alias("at"), F.array("event_id", "user_id").alias("ids")).alias("doc"))
    return tables.flatten_documents(df)


@query("SELECT event_id, event_type AS t, value AS v, 2::BIGINT AS n_ids FROM events")
def nested_write(spark, sf):
    flat = read(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("doc.type"), F.col("value").alias("doc.at.value"),
        F.to_json(F.array("event_id", "user_id")).alias("doc.ids"))
    nested = sinks.nest_columns(flat, {"doc.ids": "bigint"})
    return nested.select("event_id", F.col("doc.type").alias("t"), F.col("doc.at.value").alias("v"),
                         F.size("doc.ids").cast("long").alias("n_ids"))


# --- joins, windows, sets ------------------------------------------------------------------------------------------------


@query("""SELECT e.event_id, s.event_id AS signup_id FROM events e ASOF LEFT JOIN
(SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'signup' GROUP BY 1, 2) s
ON e.user_id = s.user_id AND e.ts >= s.ts""")
def asof_last_signup(spark, sf):
    e = read(spark, sf, "events")
    signups = e.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("signup_id"))
    return relations.asof_join(e.select("event_id", "user_id", "ts"), signups, ["user_id"], "ts", "ts", ["signup_id"]).select(
        "event_id", "signup_id")


_PRICES = """(SELECT event_type, TIMESTAMP '2024-01-01' AS since, length(event_type)::DOUBLE AS price FROM events GROUP BY 1
UNION ALL SELECT event_type, TIMESTAMP '2024-01-15', length(event_type) + 1.0 FROM events GROUP BY 1)"""


@query(f"""SELECT e.event_type, count(*) AS n, round(sum(e.value * p.price), 4) AS cost FROM events e ASOF LEFT JOIN {_PRICES} p
ON e.event_type = p.event_type AND e.ts >= p.since GROUP BY 1""")
def asof_price(spark, sf):
    e = read(spark, sf, "events")
    return analytics.priced(e, analytics.price_history(e)).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("cost"), 4).alias("cost"))


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def inner_join(spark, sf):
    return read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", "n_name", "r_name")


@query("""SELECT c_custkey, coalesce(n_name, c_nationkey::VARCHAR) AS nation FROM customer LEFT JOIN
(SELECT * FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal < 0)) ON c_nationkey = n_nationkey""")
def label_fallback(spark, sf):
    in_debt = read(spark, sf, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("n_nationkey"))
    return relations.with_label(read(spark, sf, "customer"), relations.semi(read(spark, sf, "nation"), in_debt, ["n_nationkey"]),
                                "c_nationkey", "n_nationkey", "n_name", "nation").select("c_custkey", "nation")


@query("""SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers,
(SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation""")
def fan_out_counts(spark, sf):
    return relations.with_counts(read(spark, sf, "nation"), "n_nationkey", {
        "customers": (read(spark, sf, "customer"), "c_nationkey"),
        "suppliers": (read(spark, sf, "supplier"), "s_nationkey")}).select("n_nationkey", "customers", "suppliers")


@query("""SELECT c_custkey, o.o_orderkey AS last_order FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, row_number() OVER
(PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) o ON o_custkey = c_custkey AND n = 1""")
def latest_order_per_customer(spark, sf):
    return relations.latest_child(read(spark, sf, "customer").select("c_custkey"), read(spark, sf, "orders"), "c_custkey",
                                  "o_custkey", ["o_orderdate", "o_orderkey"], {"o_orderkey": "last_order"})


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def semi_orders(spark, sf):
    poor = read(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return relations.semi(read(spark, sf, "orders"), poor, ["o_custkey"]).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_orders(spark, sf):
    ordered = read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return relations.anti(read(spark, sf, "customer"), ordered, ["c_custkey"]).select("c_custkey")


@query("SELECT o_orderkey, o_totalprice > (SELECT avg(o_totalprice) FROM orders) AS above FROM orders")
def one_row_parameters(spark, sf):
    orders = read(spark, sf, "orders")
    return relations.with_parameters(orders, orders.agg(F.avg("o_totalprice").alias("mean"))).select(
        "o_orderkey", (F.col("o_totalprice") > F.col("mean")).alias("above"))


@query("""SELECT p_partkey, CASE WHEN n = 1 THEN p_name ELSE p_name || ' (' || n || ')' END AS p_name FROM (SELECT *, row_number() OVER
(PARTITION BY p_brand, lower(p_name) ORDER BY p_partkey) AS n FROM (SELECT p_partkey, p_brand, left(p_name, 2) AS p_name FROM part))""")
def name_dedupe(spark, sf):
    df = read(spark, sf, "part").select("p_partkey", "p_brand", F.left("p_name", F.lit(2)).alias("p_name"))
    return relations.number_duplicates(df, ["p_brand"], "p_name", ["p_partkey"]).select("p_partkey", "p_name")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)
AS n FROM events) WHERE n = 1""")
def latest_event_per_user(spark, sf):
    return relations.latest_per_key(read(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select(
        "user_id", "event_id", "event_type")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT user_id, string_agg(event_type, ',' ORDER BY n DESC) FILTER (n <= 20) AS strip, max(event_type) FILTER (n = 1) AS latest,
count(*) AS total FROM r GROUP BY 1""")
def last20_strip(spark, sf):
    df = relations.last_n_per_key(read(spark, sf, "events"), ["user_id"], "ts", "event_id", 20, "event_type")
    return df.withColumn("strip", F.array_join("strip", ","))


@query("""SELECT o_custkey, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1 ORDER BY value DESC, o_custkey LIMIT 10""")
def top_customers(spark, sf):
    return relations.top_n(read(spark, sf, "orders"), ["o_custkey"], F.round(F.sum("o_totalprice"), 2), 10)


@query("""SELECT o_orderkey, (SELECT count(*) FROM orders) AS total, (SELECT count(*) FROM orders) > 70 AS more FROM orders
ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 50""")
def page_with_total(spark, sf):
    rows, total, more = relations.page(read(spark, sf, "orders"), [F.desc_nulls_last("o_totalprice"), F.col("o_orderkey")], 20, 50)
    return rows.select("o_orderkey", F.lit(total).cast("long").alias("total"), F.lit(more).alias("more"))


@query("""SELECT 'event' AS source, event_id AS id, event_type AS what FROM events UNION ALL
SELECT 'message', conv_id * 1000 + turn, role FROM conversations""")
def merged_feed(spark, sf):
    e = read(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("what"))
    c = read(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("what"))
    return relations.merged({"event": e, "message": c})


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_dedupe(spark, sf):
    a = read(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"))
    b = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"))
    return relations.union_distinct(a, b, ["nation"])


@query("""SELECT o_orderkey FROM orders WHERE (o_custkey, o_orderkey) > (100, 500) ORDER BY o_custkey, o_orderkey LIMIT 25""")
def after_key_page(spark, sf):
    return tables.page_after(read(spark, sf, "orders"), ["o_custkey", "o_orderkey"], [100, 500], 25).select("o_orderkey")


@query("""(SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100) UNION (SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 100)""")
def head_tail_sample(spark, sf):
    return tables.head_tail_sample(read(spark, sf, "orders"), "o_orderkey", 100)[0].select("o_orderkey")


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 49""")
def structured_read(spark, sf):
    return tables.read_request(read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity"],
                               [Predicate("l_returnflag", "eq", "R"), Predicate("l_quantity", "gte", 49.0)])


# --- reduction -----------------------------------------------------------------------------------------------------------


@query("""SELECT l_returnflag AS source, l_orderkey, l_quantity FROM lineitem WHERE l_quantity = (SELECT max(l_quantity) FROM lineitem)""")
def reduce_max_ties(spark, sf):
    df = read(spark, sf, "lineitem")
    return relations.reduce_extreme({f: df.where(F.col("l_returnflag") == f) for f in "ANR"}, "l_quantity").select(
        "source", "l_orderkey", "l_quantity")


@query("SELECT sum(l_quantity) AS total, 'A,N,R' AS sources FROM lineitem")
def reduce_sum_sources(spark, sf):
    df = read(spark, sf, "lineitem")
    out = relations.reduce_total({f: df.where(F.col("l_returnflag") == f) for f in "ANR"}, "l_quantity")
    return out.withColumn("sources", F.array_join("sources", ","))


# --- profiles and cleaning -------------------------------------------------------------------------------------------------


@query(f"""SELECT 'amount' AS "column", count(*) AS n_rows, 0::BIGINT AS n_null, 0::BIGINT AS n_empty,
count(*) FILTER (amount = '  ') AS n_blank, count(*) FILTER (amount = 'n/a') AS n_missing_token,
count(DISTINCT amount) AS n_distinct, min(length(amount))::INT AS min_length, max(length(amount))::INT AS max_length,
min(amount) AS least, max(amount) AS greatest, false AS leading_zeros FROM {_MESSY}""")
def column_profile(spark, sf):
    return profiles.column_stats(messy_amounts(read(spark, sf, "lineitem")), ["amount"], exact=True).select(
        "column", "n_rows", "n_null", "n_empty", "n_blank", "n_missing_token", "n_distinct", "min_length", "max_length",
        "least", "greatest", "leading_zeros")


@query(f"""SELECT 'amount' AS "column", 'to_number' AS how, count(*) AS n_values, count(*) FILTER (l_linenumber % 5 = 0) AS n_passed
FROM {_MESSY} UNION ALL SELECT 'amount', 'to_date', count(*), 0 FROM {_MESSY}""")
def parse_rates(spark, sf):
    return profiles.parse_rates(messy_amounts(read(spark, sf, "lineitem")), ["amount"]).where(
        "how IN ('to_number', 'to_date')").select("column", "how", "n_values", "n_passed")


_ROUTE = """CASE WHEN bool_or(v IN ('n/a', '-', '?') OR trim(v) = '') THEN CASE WHEN bool_or(regexp_matches(v, '[0-9]')) THEN 'both' ELSE 'missing-value' END
WHEN bool_or(regexp_matches(v, '[0-9]')) THEN 'coercion' ELSE 'none' END AS route"""


@query(f"""SELECT "column", {_ROUTE} FROM (SELECT 'amount' AS "column", amount AS v FROM {_MESSY} UNION ALL SELECT 'l_returnflag', l_returnflag FROM lineitem
UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem) GROUP BY 1""")
def route_columns(spark, sf):
    df = messy_amounts(read(spark, sf, "lineitem")).select("amount", "l_returnflag", "l_linestatus")
    return spark.createDataFrame([(r["column"], r["route"]) for r in profiles.route_columns(df)], "column string, route string")


@query()
def profile_hash(spark, sf):
    stats = profiles.column_stats(read(spark, sf, "orders"))
    return spark.createDataFrame([(profiles.profile_hash(stats), schemas.stable_hash(read(spark, sf, "orders").schema))],
                                 "profile string, schema string")


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 5 < 3 THEN l_extendedprice::DECIMAL(20,2)::DOUBLE END AS amount FROM {_MESSY}""")
def clean_numbers(spark, sf):
    df = messy_amounts(read(spark, sf, "lineitem")).select("l_orderkey", "l_linenumber", "amount")
    return profiles.propose_cleaning(df).apply(df, "null").df


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN date_trunc('day', o_orderdate) END AS day FROM {_MESSY_DATES}""")
def clean_dates(spark, sf):
    df = messy_dates(read(spark, sf, "orders")).select("o_orderkey", "day")
    return steps.compute(df, "day", profiles.clean_date(df, "day"), "null").df


@query("""SELECT event_id, event_id % 2 = 0 AS flag FROM events""")
def clean_booleans(spark, sf):
    word = F.element_at(F.array(*[F.lit(w) for w in ("Yes", "no", "Y", "N", "TRUE", "false", "1", "0")]),
                        (F.col("event_id") % 8 + 1).cast("int"))
    df = read(spark, sf, "events").select("event_id", word.alias("flag"))
    return steps.compute(df, "flag", profiles.clean_boolean(field("flag", "text"))).df


# --- assertions and sync -----------------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def unique_keys(spark, sf):
    return quality.duplicate_keys(read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT count(*) FILTER (o_orderkey % 5 = 0) AS without_key FROM orders""")
def null_keys(spark, sf):
    df = read(spark, sf, "orders").withColumn("k", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey")))
    return spark.createDataFrame([(quality.null_keys(df, ["k"]),)], "without_key bigint")


_HALVES = """t AS (SELECT * FROM orders),
d AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1 AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT -1 - c_custkey, c_custkey, 'O', c_acctbal, TIMESTAMP '1998-01-01', '5-LOW' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))"""


def _halves(spark, sf) -> tuple[DataFrame, DataFrame]:
    """All orders, and changes to them: the finished ones, dearer, and a first order of each customer without any."""
    o, c = read(spark, sf, "orders"), read(spark, sf, "customer")
    first = relations.anti(c, o.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select(
        (-1 - F.col("c_custkey")).alias("o_orderkey"), F.col("c_custkey").alias("o_custkey"), F.lit("O").alias("o_orderstatus"),
        F.col("c_acctbal").alias("o_totalprice"), F.lit(dt.datetime(1998, 1, 1)).cast(o.schema["o_orderdate"].dataType).alias("o_orderdate"),
        F.lit("5-LOW").alias("o_orderpriority"))
    done = o.where("o_orderstatus = 'F'").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return o, done.unionByName(first)


@query(f"""WITH {_HALVES} SELECT o_orderkey, o_totalprice FROM d UNION ALL
SELECT o_orderkey, o_totalprice FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM d)""")
def upsert_orders(spark, sf):
    target, delta = _halves(spark, sf)
    twice = delta.unionByName(delta.withColumn("o_totalprice", F.lit(0.0)).withColumn(
        "o_orderdate", F.col("o_orderdate") - F.expr("INTERVAL 1 DAY")))
    return sinks.upserted(target, sinks.last_wins(twice, ["o_orderkey"], "o_orderdate"), ["o_orderkey"]).select(
        "o_orderkey", "o_totalprice")


@query(f"WITH {_HALVES} SELECT o_orderkey FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM d)")
def delete_by_key(spark, sf):
    target, delta = _halves(spark, sf)
    return sinks.deleted(target, delta, ["o_orderkey"]).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' OR o_orderkey % 11 = 0")
def delta_read(spark, sf):
    df = read(spark, sf, "orders").withColumn("o_orderdate", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate")))
    return sync.changed_since(df, "o_orderdate", dt.datetime(1997, 1, 1)).select("o_orderkey")


@query("""SELECT least(max(o_orderdate), TIMESTAMP '1998-01-01') - INTERVAL 300 SECOND AS bookmark,
count(*) FILTER (o_orderdate > TIMESTAMP '1998-01-01') > 0 AS ahead FROM orders""")
def next_bookmark(spark, sf):
    clock = dt.datetime(1998, 1, 1)
    r = sync.bookmark_report(read(spark, sf, "orders"), "o_orderdate", clock)
    return spark.createDataFrame([(sync.next_bookmark(r["latest"], clock, None, "upsert"), r["ahead"])],
                                 "bookmark timestamp, ahead boolean")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def soft_delete_split(spark, sf):
    df = read(spark, sf, "orders").withColumn("gone", F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "P", False))
    return sync.split_soft_deletes(df, "gone")[0].select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority <> '1-URGENT'")
def reconcile_deletes(spark, sf):
    o = read(spark, sf, "orders")
    saved, scan, ups = o, o.where("o_orderstatus <> 'P'"), o.where("o_orderpriority = '1-URGENT'")
    return sync.reconcile(saved, scan, ups, ["o_orderkey"]).deletes


@query("SELECT count(*) FILTER (o_orderstatus = 'P') AS deletes, count(*) FILTER (o_orderstatus = 'P') * 100.0 / count(*) > 20 AS stopped FROM orders")
def mass_delete_guard(spark, sf):
    o = read(spark, sf, "orders")
    scan = o.where("o_orderstatus <> 'P'")
    r = sync.reconcile(o, scan, o.limit(0), ["o_orderkey"])
    try:
        n, stopped = r.guard(o, scan), False
    except sync.SyncStopped:
        n, stopped = r.deletes.count(), True
    return spark.createDataFrame([(n, stopped)], "deletes bigint, stopped boolean")


def _changes(spark, sf) -> DataFrame:
    return read(spark, sf, "events").select(
        "user_id", "event_id", "value", F.when((F.col("event_type") == "error") & (F.col("user_id") % 7 == 0), "delete").otherwise("upsert").alias("op"))


_TICK = """c AS (SELECT user_id, event_id, value, CASE WHEN event_type = 'error' AND user_id % 7 = 0 THEN 'delete' ELSE 'upsert' END AS op FROM events),
live AS (SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM c
WHERE op = 'upsert' AND user_id NOT IN (SELECT user_id FROM c WHERE op = 'delete')) WHERE n = 1)"""


@query(f"WITH {_TICK} SELECT user_id, event_id, value FROM live")
def tick_collapse(spark, sf):
    return sync.collapse(_changes(spark, sf), ["user_id"], "event_id")[0]


@query(f"WITH {_TICK} SELECT user_id, event_id, value FROM live")
def tick_stream(spark, sf):
    """The same changes as a stream into a keyed table, read back."""
    base = new_folder(spark, "tick")
    _changes(spark, sf).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(_changes(spark, sf).schema).parquet(f"{base}/in")
    table = keyed.KeyedTable(spark, f"{base}/table", ["user_id"], "event_id", 16)
    sync.stream_into(stream, table, f"{base}/checkpoint", ["user_id"], "event_id").awaitTermination()
    return table.read()


@query(f"""WITH {_HALVES} SELECT o_orderkey, o_totalprice FROM d UNION ALL
SELECT o_orderkey, o_totalprice FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM d)""")
def staged_upsert(spark, sf):
    """Two commits and a repeated one into a versioned table, read back."""
    target, delta = _halves(spark, sf)
    table = sinks.VersionedTable(spark, new_folder(spark, "orders"))
    table.replace(target, "first", ["o_orderkey"])
    for _ in range(2):
        table.upsert(delta, "second", ["o_orderkey"], "o_orderdate")
    return table.read().select("o_orderkey", "o_totalprice")


@query("""SELECT event_type AS kind, user_id AS subject, min(event_id) AS first FROM events GROUP BY 1, 2
HAVING min(ts) >= TIMESTAMP '2024-01-03'""")
def ledger_once(spark, sf):
    """Who did what for the first time since the ledger, that of the first two days, was written."""
    e = read(spark, sf, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("subject"), F.col("event_id").alias("first"), "ts")
    ledger = e.where(F.col("ts") < F.lit(dt.datetime(2024, 1, 3))).select("kind", "subject").distinct()
    return sync.once_per(ledger, e.groupBy("kind", "subject").agg(F.min("first").alias("first")), ["kind", "subject"])


@query("""SELECT count(*) AS n_rows, sum(length('{"doc_id":' || doc_id || coalesce(',"source":"' || source || '"', '')
|| coalesce(',"n_chars":' || n_chars, '') || '}'))::BIGINT AS n_bytes, sum(doc_id)::BIGINT AS ids, sum(n_chars)::BIGINT AS chars,
1::BIGINT AS n_last, 0::BIGINT AS too_large FROM documents""")
def delivery_parts(spark, sf):
    """What the parts' bodies hold, read back, and whether each is within its bounds."""
    parts = sinks.assign_parts(read(spark, sf, "documents").select("doc_id", "source", "n_chars"), 100, 4_000)
    row = "array<struct<doc_id: bigint, source: string, n_chars: bigint>>"
    rows = parts.withColumn("rows", F.from_json("body", row))
    total = F.aggregate("rows", F.lit(0).cast("bigint"), lambda a, x: a + x["doc_id"])
    chars = F.aggregate("rows", F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x["n_chars"], F.lit(0)))
    small = (F.size("rows") == F.col("n_rows")) & (F.col("n_rows") <= 100) & (F.col("n_bytes") <= 4_000)
    return rows.agg(F.sum(F.size("rows")).alias("n_rows"), F.sum("n_bytes").alias("n_bytes"), F.sum(total).alias("ids"),
                    F.sum(chars).alias("chars"), F.count_if(F.col("last")).alias("n_last"), F.count_if(~small).alias("too_large"))


@query(r"""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate - INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') || '.000Z' AS utc,
regexp_replace(regexp_replace(o_totalprice::DECIMAL(20,2)::VARCHAR, '0+$', ''), '\.$', '') AS price FROM orders""")
def wire_values(spark, sf):
    df = read(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("at"), F.col("o_totalprice").cast("decimal(20,2)").alias("price"))
    return df.select("o_orderkey", sinks.wire_value(df, "at", "datetime", "Date").alias("day"),
                     sinks.wire_value(df, "at", "datetime", "DateTime", "Asia/Tokyo").alias("utc"),
                     sinks.wire_value(df, "price", "number", "Number").alias("price"))


@query("""SELECT 'lineitem' AS "table", column_name AS "column", CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP WITH TIME ZONE'
THEN 'timestamp' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'INTEGER' THEN 'int' ELSE lower(column_type) END AS type, "null" = 'YES' AS nullable FROM (DESCRIBE lineitem)""")
def describe_table(spark, sf):
    return tables.describe(read(spark, sf, "lineitem"), "lineitem")

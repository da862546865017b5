import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableloom.functions import BuildError, field
from tableloom.functions import scalars as s
from tableloom.operators import profiles, quality, relations, schemas, steps
from tableloom.operators.predicates import Parameter, Predicate, bind, relative_date, search, where_all


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, "10", "A"), (2, None, "B"), (3, "x", "A"), (4, "7", None)], "id int, age string, name string")


def test_policies(spark, people):
    n = s.to_number(field("age", "text"))
    with pytest.raises(steps.StepFailed, match="to_number failed in 1 rows"):
        steps.compute(people, "n", n)
    kept = steps.compute(people, "n", n, "null")
    assert {r["id"]: r["n"] for r in kept.df.collect()} == {1: 10.0, 2: None, 3: None, 4: 7.0}
    assert kept.report.count == 1
    r = steps.compute(people, "n", n, "quarantine")
    assert sorted(x["id"] for x in r.df.collect()) == [1, 2, 4]
    bad = r.rejects.collect()
    assert len(bad) == 1 and bad[0]["function"] == "to_number" and bad[0]["input_value"] == "x" and '"id":3' in bad[0]["source_row"]
    assert r.df.count() + r.rejects.count() == people.count()


def test_filter_keeps_true_only(people):
    assert [r["id"] for r in steps.filter_rows(people, field("name", "text") == "A").df.orderBy("id").collect()] == [1, 3]


def test_pipeline_report(spark, people):
    pipe = steps.Pipeline([lambda d: steps.compute(d, "n", s.to_number(field("age", "text")), "drop"), lambda d: steps.drop_fields(d, ["age"])])
    assert pipe.output_schema(people).names == ["id", "name", "n"]
    out = pipe.run(people)
    assert out.df.count() == 3
    assert [tuple(r) for r in pipe.report(spark).collect()] == [("compute n", "to_number", "drop", 1)]


def test_aggregate_edges(spark, people):
    a = steps.Agg
    empty = steps.aggregate(people.limit(0), [], [a("count", None, "n"), a("sum", "id", "s")]).df.collect()
    assert [tuple(r) for r in empty] == [(0, None)]
    groups = steps.aggregate(people, ["name"], [a("count", None, "n")]).df.collect()
    assert {(r["name"], r["n"]) for r in groups} == {("A", 2), ("B", 1), (None, 1)}
    with pytest.raises(BuildError):
        steps.aggregate(people, ["name"], [a("count", None, "name")])
    with pytest.raises(BuildError):
        steps.aggregate(people, ["nope"], [a("count", None, "n")])
    with pytest.raises(steps.StepFailed):
        steps.refuse_many_groups(people, ["id"], 2)
    assert steps.group_count(people, ["name"]) == 3


def test_flatten(spark):
    df = spark.createDataFrame([(1, '{"a":1,"b":"x"}'), (2, "[1]"), (3, "null"), (4, None), (5, '{"a":2}'), (6, "oops")], "id int, j string")
    r = steps.flatten_json(df, "j")
    assert {tuple(x) for x in r.df.collect()} == {(1, "1", "x"), (3, None, None), (4, None, None), (5, "2", None)}
    assert {x["input_value"] for x in r.rejects.collect()} == {"[1]", "oops"}
    nested = spark.sql("select named_struct('a', 1, 'b', named_struct('c', 2)) as s, 3 as s_x")
    assert steps.flatten(nested, "s").df.columns == ["s_a", "s_b", "s_x"]
    with pytest.raises(BuildError):
        steps.flatten(spark.sql("select named_struct('a', 1) as s, 3 as s_a"), "s")


def test_predicates(spark, people):
    rows = where_all(people, bind([Predicate("id", "gte", Parameter("k")), Predicate("name", "is_not_null")], people.schema, {"k": 2})).collect()
    assert sorted(r["id"] for r in rows) == [2, 3]
    for bad in ({}, {"k": "two"}):
        with pytest.raises(BuildError):
            bind([Predicate("id", "eq", Parameter("k"))], people.schema, bad)
    with pytest.raises(BuildError):
        where_all(people, [Predicate("zzz", "is_null")])
    assert search(people, "a", ["name"]).count() == 2
    now = dt.datetime(2024, 3, 15, 23, 30, tzinfo=dt.timezone.utc)
    assert relative_date("today", "Asia/Tokyo", now) == dt.date(2024, 3, 16)
    assert relative_date("startOfMonth-3m", now=now) == dt.date(2023, 12, 1)
    assert relative_date("startOfYear-1y", now=now) == dt.date(2023, 1, 1)


def test_asof(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9), ("a", 3)], "k string, t int")
    right = spark.createDataFrame([("a", 3, 30), ("a", 4, 40), ("a", 4, 41), ("c", 1, 1), ("a", None, 7)], "k string, t int, v int")
    rows = relations.asof_join(left, right, ["k"], "t", "t", ["v"]).collect()
    assert {tuple(r) for r in rows} == {("a", 5, 41), ("a", 1, None), ("b", 9, None), ("a", 3, 30)}


def test_reduce(spark):
    a, b = spark.createDataFrame([(1,), (5,)], "v int"), spark.createDataFrame([(5,), (2,)], "v int")
    rows = relations.reduce_extreme({"a": a, "b": b}, "v").collect()
    assert {(r["v"], r["source"]) for r in rows} == {(5, "a"), (5, "b")}
    assert tuple(relations.reduce_total({"a": a, "b": b}, "v").first()) == (13.0, ["a", "b"])
    with pytest.raises(BuildError):
        relations.reduce_extreme({"a": a, "b": None}, "v")
    with pytest.raises(BuildError):
        relations.reduce_total({"a": a.select(F.col("v").cast("string"))}, "v")


TYPES = [T.LongType(), T.DoubleType(), T.DecimalType(10, 2), T.StringType(), T.BooleanType(), T.DateType(), T.TimestampType(), T.TimestampNTZType(),
         T.ArrayType(T.LongType()), T.StructType([T.StructField("a", T.LongType())]), schemas.ANY_JSON]


def test_lattice_laws():
    for a in TYPES:
        assert schemas.join_types(a, a).type == a
        for b in TYPES:
            assert schemas.join_types(a, b).type == schemas.join_types(b, a).type
    assert schemas.join_types(T.LongType(), T.DoubleType()).type == T.DoubleType()
    assert schemas.join_types(T.DateType(), T.TimestampType()).type == T.TimestampType()
    assert schemas.join_types(T.BooleanType(), T.LongType()).degraded
    merged = schemas.join_types(T.StructType([T.StructField("a", T.LongType(), False)]), T.StructType([T.StructField("b", T.StringType(), False)])).type
    assert merged["a"].nullable and merged["b"].nullable


def test_inference():
    found = schemas.infer_schema({"id": {"integer": 10}, "user.name": {"string": 10}, "user.age": {"integer": 6, "float": 4},
                                  "tags": {"array": 10}, "nick": {"string": 3, "null": 7}}, 10)
    assert schemas.kind_of(found["user"].dataType["age"].dataType) == "float"
    assert found["tags"].metadata["json"] and not found["id"].nullable and found["nick"].metadata["presence"] == 0.3


def test_names_and_contracts(spark):
    seen = set()
    assert [schemas.normal_name(n, seen) for n in ("Order ID", "order-id", "é", "x" * 80)][:3] == ["order_id", "order_id_2", "field"]
    assert all(len(n) <= 63 for n in seen)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.DecimalType(10, 2))])
    c = schemas.build_contract([("id", "id"), ("v", "amount")], schema, ["id"])
    assert "PRIMARY KEY (id)" in schemas.create_table_sql(c, "t") and "numeric(10,2)" in schemas.create_table_sql(c, "t")
    problems = schemas.compare_contract(c, T.StructType([T.StructField("id", T.StringType()), T.StructField("extra", T.LongType())]))
    assert [p["column"] for p in problems] == ["id", "amount"]
    assert schemas.stable_hash(c) == schemas.stable_hash(schemas.build_contract([("id", "id"), ("v", "amount")], schema, ["id"]))
    drift = schemas.target_drift(schema, T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())]), ["id", "v"], ["id"], ["id"], "upsert", ["upsert"])
    assert drift["stop"] == ["v is gone", "id changed its type"] and drift["warn"] == ["n is new"]
    m = schemas.auto_map(T.StructType([T.StructField("Order-Id", T.LongType()), T.StructField("x", T.BooleanType())]),
                         T.StructType([T.StructField("order_id", T.LongType()), T.StructField("x", T.LongType()), T.StructField("y", T.LongType())]), ["order_id"])
    assert m["mapping"][0] == ("Order-Id", "order_id") and m["nulls"] == ["y"] and len(m["errors"]) == 1
    assert schemas.resolve_entity({"a": ["x"], "b": ["x", "y"]}, ["y"]) == "b"
    assert schemas.from_native("sqlserver", "money")[0] == T.DecimalType(19, 4) and schemas.from_native("mysql", "time")[1]


def test_conform_first_failure_wins(spark):
    df = spark.createDataFrame([("1", "x"), ("y", "z"), ("2", "true")], "a string, b string")
    c = schemas.Contract((schemas.ContractColumn("a", "a", T.LongType()), schemas.ContractColumn("b", "b", T.BooleanType())))
    r = schemas.conform(df, c)
    assert [tuple(x) for x in r.df.collect()] == [(2, True)]
    assert sorted(x["function"] for x in r.rejects.collect()) == ["to_boolean", "to_integer"]


def test_cleaning(spark):
    df = spark.createDataFrame([(1, "$1,200.50", "yes", "01234", "31/12/2024"), (2, "N/A", "N", "00012", "01/02/2024"), (3, "3", "1", "1", None)],
                               "id int, amount string, active string, zip_code string, day string")
    routes = {r["column"]: r["route"] for r in profiles.route_columns(df)}
    assert routes["amount"] == "both" and routes["zip_code"] == "none"
    out = {r["id"]: r for r in profiles.propose_cleaning(df).apply(df, "null").df.collect()}
    assert out[1]["amount"] == 1200.5 and out[2]["amount"] is None and out[1]["zip_code"] == "01234"
    assert [out[i]["active"] for i in (1, 2, 3)] == [True, False, True]
    assert out[2]["day"] == dt.datetime(2024, 2, 1)
    assert profiles.date_order(spark.createDataFrame([("31/12/2024",), ("12/31/2024",)], "d string"), "d") == "ambiguous"
    assert profiles.decimal_mark(spark.createDataFrame([("1.200,50",), ("3,5",)], "p string"), "p") == ","
    rows = profiles.propose_cleaning(df).dry_run(df)
    assert all(r["max_rate"] >= 0.01 for r in rows)


def test_profile_hash_is_of_shape(spark):
    a = spark.createDataFrame([("x",), (None,)], "c string")
    b = spark.createDataFrame([("x",), ("y",), (None,)], "c string")
    assert profiles.profile_hash(profiles.column_stats(a)) == profiles.profile_hash(profiles.column_stats(b))
    assert profiles.drift({"schema": 1, "profile": 2}, {"schema": 1, "profile": 3}) == "profile"


def test_quality(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, v string")
    assert quality.null_keys(df, ["k"]) == 1 and quality.duplicate_keys(df, ["k"]).count() == 1
    for bad in (lambda: quality.assert_keys(df, ["k"]), lambda: quality.assert_no_shrink(4, 10), lambda: quality.assert_failure_rate(1000, 0)):
        with pytest.raises(quality.AssertionFailed):
            bad()
    quality.assert_no_shrink(0, 0)
    assert quality.same_table(df, df.repartition(3)) and not quality.same_table(df, df.limit(2))

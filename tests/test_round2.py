"""As-of joins by both plans, number dressings, pruning, widened unions, versions and rivals."""

import random

import pytest

from tableloom.operators import profiles, relations, schemas, steps
from tableloom.sources import sinks, tables


@pytest.mark.parametrize("small", [True, False])
def test_asof_join_by_spans_and_by_slices(spark, monkeypatch, small):
    rng = random.Random(4)
    left = [(i, rng.choice(["a", "b", "hot", "hot", "hot", None]), rng.choice([None, *range(40 * 86_400)][:: 37_000]) if i % 9 else None) for i in range(400)]
    right = [(rng.choice(["a", "hot", None]), rng.choice([None, rng.randrange(40 * 86_400)]), rng.randrange(1000)) for _ in range(120)]
    right += [right[0], ("a", 5 * 86_400, 1), ("a", 5 * 86_400, 2)]
    left += [(1000, "a", 5 * 86_400), (1001, "a", 5 * 86_400 - 1)]
    if not small:
        monkeypatch.setattr(relations, "BROADCAST_ROWS", 3)
    a = spark.createDataFrame(left, "id int, key string, s bigint").selectExpr("id", "key", "timestamp_seconds(s) AS at", "'x' AS part", "1 AS value")
    b = spark.createDataFrame(right, "key string, s bigint, price int").selectExpr("key", "timestamp_seconds(s) AS since", "price")
    out = relations.asof_join(a, b, ["key"], "at", "since", ["price"])
    assert out.columns == ["id", "key", "at", "part", "value", "price"]
    plan = out._jdf.queryExecution().toString()
    assert ("BroadcastHashJoin" in plan and "Window" in plan) if small else "full" in plan.lower()
    got = {r["id"]: r["price"] for r in out.collect()}
    assert len(got) == len(left)
    for i, key, s in left:
        before = [(t, p) for k, t, p in right if k == key and key is not None and t is not None and s is not None and t <= s]
        assert got[i] == (max(before)[1] if before else None), (i, key, s)


def test_dressings_and_names():
    want = {"$5": "currency", "5 €": "currency", "7%": "percent", "1,200": "groups", "1.200.300,5": "groups", "-12,345.6": "groups", "5 kg": "unit", "5kg": "unit",
            "12": None, "1,2": None, "abc": None, "kg 5": None, "5 metres": None, "": None, "12-34": None, "1,2000": None}
    assert {t: profiles.dressed_as(t) for t in want} == want
    assert profiles.name_words("customerZipCode2") == ["customer", "zip", "code2"] and profiles.name_words("phone-no") == ["phone", "no"]


def test_routes_give_reasons(spark):
    df = spark.createDataFrame([("$5", "007", "n/a", "x"), ("7", "012", "y", "z")], "price string, member_id string, note string, word string")
    found = {r["column"]: r for r in profiles.route_columns(df)}
    assert found["price"]["route"] == "coercion" and "currency" in found["price"]["reason"] or "to_number" in found["price"]["reason"]
    assert found["member_id"]["route"] == "none" and found["member_id"]["identifier"] and "identifier" in found["member_id"]["reason"]
    assert found["note"]["route"] == "missing-value" and found["word"] == {"column": "word", "route": "none", "identifier": False, "reason": ""}


def test_redact_keeps_nulls_and_order(spark):
    df = spark.createDataFrame([(1, (1, [(5,), (50,), None])), (2, None), (3, (-1, []))], "id int, d struct<v: int, xs: array<struct<n: int>>>")
    out = {r["id"]: r["d"] for r in steps.redact(df, lambda p, c: {"d": c["v"] > 0, "d.xs[]": c["n"] > 10}.get(p) if p in ("d", "d.xs[]") else None).collect()}
    assert out[1]["v"] == 1 and [x["n"] for x in out[1]["xs"]] == [50] and out[2] is None and out[3] is None


def test_union_widened(spark):
    a = spark.createDataFrame([(1, "x")], "k int, s string")
    b = spark.createDataFrame([(2.5, 3)], "k double, s int")
    out = schemas.union_widened(a, b)
    assert out.dtypes == [("k", "double"), ("s", "string")] and sorted(map(tuple, out.collect())) == [(1.0, "x"), (2.5, "3")]


def test_versions_have_one_winner(spark, tmp_path):
    table = sinks.VersionedTable(spark, f"file://{tmp_path}/t")
    df = spark.range(5)
    assert table.commit(df, "first") == 1 and table.commit(df.limit(0), "first") == 1
    base = table.version
    table.commit(spark.range(7), "second", (), base)
    with pytest.raises(Exception):
        table.commit(spark.range(9), "rival", (), base)
    assert table.version == 2 and table.read().count() == 7
    table.drop_versions(1)
    assert table.read().count() == 7 and table.has_run("first")


def test_ranges_and_keyed_samples(spark):
    df = spark.range(1000).selectExpr("IF(id = 7, NULL, id) AS id")
    counts = {r["part"]: r["count"] for r in tables.in_ranges(df, "id", 100, 900, 4).groupBy("part").count().collect()}
    assert counts == {0: 300, 1: 200, 2: 200, 3: 300}
    a, b = (sorted(r[0] or -1 for r in tables.keyed_sample(x, "id", 0.2).collect()) for x in (df, df.repartition(9)))
    assert a == b and 120 < len(a) < 280


def test_csv_keeps_texts(spark, tmp_path):
    rows = [(1, 'a "quoted" text, with\nlines\r\nand \\ signs'), (2, ""), (3, None), (4, "  blanks  "), (5, "\\N x"), (6, "long " * 300_000)]
    df = spark.createDataFrame(rows, "id int, t string")
    sinks.write_csv(df, f"file://{tmp_path}/c")
    assert sorted(map(tuple, sinks.read_csv(spark, f"file://{tmp_path}/c", df.schema).collect())) == rows

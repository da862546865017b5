import datetime as dt
import uuid

import pytest
from pyspark.sql import types as T

from tableloom.functions import BuildError
from tableloom.operators import quality
from tableloom.sources import sinks, tables
from tableloom.streaming import sync


def _table(spark):
    return sinks.VersionedTable(spark, f"{spark.conf.get('spark.checkpoint.dir')}/t-{uuid.uuid4().hex}")


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions(spark):
    t = _table(spark)
    a = spark.createDataFrame([(1, 1, 10), (2, 1, 20)], "k int, seq int, v int")
    assert t.read() is None and t.replace(a, "r1", ["k"]) == 1
    up = spark.createDataFrame([(2, 1, 21), (2, 2, 22), (3, 1, 30)], "k int, seq int, v int")
    assert t.upsert(up, "r2", ["k"], "seq") == 2
    assert t.upsert(up, "r2", ["k"], "seq") == 2  # the same run changes nothing
    want = [(1, 1, 10), (2, 2, 22), (3, 1, 30)]
    assert _rows(t.read()) == want
    with pytest.raises(quality.AssertionFailed):
        t.replace(a.limit(1), "r3", ["k"])
    with pytest.raises(quality.AssertionFailed):
        t.replace(a.unionByName(a), "r4", ["k"])
    assert _rows(t.read()) == want and t.version == 2
    t.delete(a.limit(1), "r5", ["k"])
    assert t.read().count() == 2
    with pytest.raises(BuildError):
        sinks.last_wins(a, ["k"], "nope")


def test_bookmarks():
    clock = dt.datetime(2026, 1, 2)
    saved = dt.datetime(2026, 1, 1)
    assert sync.next_bookmark(dt.datetime(2026, 1, 3), clock, saved, "upsert") == clock - dt.timedelta(seconds=300)
    assert sync.next_bookmark(None, clock, saved, "upsert") == saved
    assert sync.next_bookmark(None, clock, saved, "replace", dt.timedelta(seconds=600)) == clock - dt.timedelta(seconds=660)
    mark = sync.Bookmark(sync.stable_hash({"a": 1}), saved)
    assert mark.time_for({"a": 1}) == saved and mark.time_for({"a": 2}) is None


def test_reconcile(spark):
    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k int")
    r = sync.reconcile(keys(1, 2, 3, 4), keys(1, 2, 2), keys(4, 5), ["k"])
    assert _rows(r.deletes) == [(3,)] and _rows(r.keys) == [(1,), (2,), (4,), (5,)] and r.repeated.first()[0] == 1
    with pytest.raises(sync.SyncStopped):
        r.guard(keys(1, 2, 3, 4), keys(1, 2, 2))
    assert r.guard(keys(1, 2, 3, 4), keys(1, 2), 50) == 1
    same = sync.reconcile(keys(1, 2), keys(1, 2), keys(), ["k"])
    assert same.deletes.isEmpty()
    with pytest.raises(sync.SyncStopped):
        same.guard(keys(1, 2), keys())


def test_soft_deletes_and_keys(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "k int, gone boolean")
    live, gone = sync.split_soft_deletes(df, "gone")
    assert _rows(live) == [(2,), (3,)] and _rows(gone) == [(1,)]
    bad = spark.createDataFrame([("",), (None,), ("a",)], "k string")
    assert sync.usable_keys(bad, ["k"], "skip").count() == 1
    with pytest.raises(sync.SyncStopped):
        sync.usable_keys(bad, ["k"])
    with pytest.raises(sync.SyncStopped):
        sync.replace_table(_table(spark), df.limit(0), "r", ["k"])


def test_tick(spark):
    t = _table(spark)
    changes = spark.createDataFrame([(1, 1, "a", "upsert"), (1, 2, "b", "upsert"), (2, 1, "c", "delete"), (2, 2, "d", "upsert")],
                                    "k int, seq int, v string, op string")
    sync.tick(t, changes, 0, ["k"], "seq")
    sync.tick(t, changes, 0, ["k"], "seq")
    sync.tick(t, changes.limit(0), 1, ["k"], "seq")
    assert _rows(t.read()) == [(1, 2, "b")] and t.version == 1
    sync.tick(t, spark.createDataFrame([(1, 3, None, "delete"), (5, 1, "e", "upsert")], changes.schema), 2, ["k"], "seq")
    assert _rows(t.read()) == [(5, 1, "e")]


def test_delta(spark):
    t = _table(spark)
    day = lambda n: dt.datetime(2026, 1, n)
    schema = "id int, qty int, at timestamp, gone boolean"
    sync.upsert_delta(t, spark.createDataFrame([(1, 1, day(1), False), (2, 2, day(2), False)], schema), "a", ["id"], "at", None, "gone")
    more = spark.createDataFrame([(1, 9, day(1), False), (2, 3, day(5), True), (3, 4, None, False)], schema)
    sync.upsert_delta(t, more, "b", ["id"], "at", day(3), "gone")
    assert sorted((r["id"], r["qty"]) for r in t.read().collect()) == [(1, 1), (3, 4)]


def test_delivery(spark):
    df = spark.range(95).selectExpr("id", "repeat('x', 20) as t").repartition(2)
    parts = sinks.assign_parts(df, 10, 10_000).collect()
    assert sum(p["n_rows"] for p in parts) == 95 and all(p["n_rows"] <= 10 for p in parts)
    assert sum(p["last"] for p in parts) == 1 and all(p["total_parts"] == len(parts) for p in parts)
    with pytest.raises(Exception, match="larger than a part"):
        sinks.assign_parts(df, 10, 5).collect()


def test_wire(spark):
    df = spark.sql("select timestamp_ntz'2024-07-01 12:00:00' as at, cast('1200.500' as decimal(20,3)) as n, date'2024-01-02' as d, true as b, 1e21D as big")
    row = df.select(sinks.wire_value(df, "at", "datetime", "DateTime", "Europe/Berlin"), sinks.wire_value(df, "n", "number", "Number"),
                    sinks.wire_value(df, "d", "date", "DateTime"), sinks.wire_value(df, "b", "boolean", "Text"),
                    sinks.json_number(df["n"])).first()
    assert tuple(row) == ("2024-07-01T10:00:00.000Z", "1200.5", "2024-01-02T00:00:00Z", "true", "1200.5")
    for bad in (("at", "datetime", "DateTime"), ("n", "number", "Date")):
        with pytest.raises(BuildError):
            sinks.wire_value(df, *bad)


def test_documents(spark):
    df = spark.sql("select 1 as id, named_struct('a', named_struct('b', 2), 'c', array(1, 2)) as doc, named_struct('x.y', 1) as odd")
    flat = tables.flatten_documents(df)
    assert flat.columns == ["id", "doc.a.b", "doc.c", "odd"] and flat.schema["odd"].metadata["degraded"]
    nested = sinks.nest_columns(flat.select("id", "`doc.a.b`", "`doc.c`"), {"doc.c": "int"})
    assert nested.select("doc.c").first()[0] == [1, 2]
    with pytest.raises(BuildError):
        sinks.coerce_json(df, T.StructType([T.StructField("doc", T.StringType())]))


def test_sources():
    o = tables.jdbc_options("postgres", "h", "d", "t", "u", "p")
    assert o["url"] == "jdbc:postgresql://h:5432/d"
    assert tables.partitioned_options(o, "id", 0, 100, 4)["numPartitions"] == "4"
    schema, out = tables.exact_read([("a", "money"), ("b", "decimal(38,10)"), ("c", "geometry"), ("d", "int")])
    assert schema == "`a` DECIMAL(19,4), `b` DECIMAL(38,10)" and out == [("c", "spatial")]


def test_after_key(spark):
    df = spark.createDataFrame([(None, 1), (1, None), (1, 2), (2, 1)], "a int, b int")
    assert _rows(tables.page_after(df, ["a", "b"], [1, None], 10)) == [(1, 2), (2, 1)]
    assert tables.page_after(df, ["a", "b"], [None, 1], 10).count() == 3
    assert tables.head_tail_sample(df, "b", 10)[1] == "full-table" and tables.head_tail_sample(df, None, 1)[1] == "no-key-scan"

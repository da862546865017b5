"""Comparisons of tables, tables that are changed in place, commits that die, databases, key lists, sketches, examples,
documents, deliveries and the edges of reading texts."""

import datetime as dt
import os
import random
import subprocess
import sys
import tempfile
import time
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tableloom.functions import field, scalars
from tableloom.functions.values import BuildError
from tableloom.operators import profiles, quality, relations, schemas
from tableloom.operators.predicates import Predicate
from tableloom.sources import databases, keyed, sinks
from tableloom.sources.staging import new_folder
from tableloom.streaming import sync


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# comparing tables ---------------------------------------------------------------------------------------------------------


def table(spark, values, schema="k string, v int"):
    return spark.createDataFrame(values, schema)


def test_checksums_tell_multisets_apart(spark):
    a, b, c = ("a", 1), ("b", 2), ("c", 3)
    assert not quality.same_table(table(spark, [a, a, b]), table(spark, [c, c, b]))
    assert not quality.same_table(table(spark, [a, b]), table(spark, [a, b, b, b]))
    assert not quality.same_table(table(spark, [("a", None)]), table(spark, [(None, 1)]))
    assert not quality.same_table(table(spark, [("a", None)], "k string, v string"), table(spark, [(None, "a")], "k string, v string"))
    assert quality.same_table(table(spark, [a, b, b]), table(spark, [b, a, b]).repartition(3))
    assert quality.same_table(table(spark, []), table(spark, []))
    parts = [quality.checksum(table(spark, x)) for x in ([a, b], [b], [a, b, b])]
    assert tuple(map(sum, zip(*parts[:2]))) == parts[2]


@pytest.mark.parametrize("bits", [1, 3, 10])
def test_differing_keys(spark, bits):
    rng = random.Random(bits)
    base = [(i, rng.choice("xyz"), rng.choice([None, 1.5, 2.5])) for i in range(500)] + [(None, "n", 1.0)]
    other = [r for r in base if r[0] != 7] + [(8, "z", 9.0), (600, "new", 1.0), base[20]]
    other = [(i, s, None if i in (30, 31) else v) for i, s, v in other] + [(None, "n", 1.0)]
    schema = "id int, s string, v double"
    found = {r["id"]: (r["in_a"], r["in_b"]) for r in quality.differing_keys(table(spark, base, schema), table(spark, other, schema), ["id"], bits=bits).collect()}
    want = {}
    for k in {r[0] for r in base + other}:
        a, b = (sorted((r for r in x if r[0] == k), key=repr) for x in (base, other))
        if a != b:
            want[k] = (len(a), len(b))
    assert found == want
    same = table(spark, base, schema)
    assert quality.differing_keys(same, same.repartition(4), ["id"], bits=bits).count() == 0


def test_names_become_unique(spark):
    names = ["x", "x", "x (2)", "X", "y (2)", "y (2)", "y", "y", "x (4)", "z", None, None, "x (04)", "(2)", "y (2) (2)"]
    df = spark.createDataFrame([(1, n, i) for i, n in enumerate(names)] + [(2, "x", 0), (2, "x", 1)], "scope int, name string, at int")
    out = {(r["scope"], r["at"]): r["name"] for r in relations.number_duplicates(df, ["scope"], "name", ["at"]).collect()}
    got = [out[1, i] for i in range(len(names))]
    assert got == ["x", "x (3)", "x (2)", "X (5)", "y (2)", "y (2) (3)", "y", "y (3)", "x (4)", "z", None, None, "x (04)", "(2)", "y (2) (2)"]
    assert len({n.lower() for n in got if n}) == len([n for n in got if n]) and out[2, 1] == "x (2)"


# state ----------------------------------------------------------------------------------------------------------------------


def path(spark, name="t"):
    return f"{spark.conf.get('spark.checkpoint.dir')}/{name}-{uuid.uuid4().hex}"


LOG = "k int, seq int, v string, op string"


def state(log, deletes):
    """The table of a log, in one go."""
    out = {}
    for k, seq, v, op in log:
        gone, at = op == "delete", -1 if seq is None else seq
        rank = (gone, at) if deletes == "final" else (at, gone)
        if k not in out or (rank, v or "") > out[k][0]:
            out[k] = ((rank, v or ""), (k, seq, v), gone)
    return sorted((r for _, r, gone in out.values() if not gone), key=repr)


@pytest.mark.parametrize("deletes", ["final", "by_sequence"])
def test_any_order_and_split_of_changes_gives_one_table(spark, deletes):
    rng = random.Random(len(deletes))
    log = [(rng.randrange(12), rng.choice([None, *range(30)]), rng.choice("abc"), rng.choice(["upsert", "upsert", "upsert", "delete"])) for _ in range(60)]
    for n in (1, 3, 5):
        rng.shuffle(log)
        t = keyed.KeyedTable(spark, path(spark), ["k"], "seq", 4, deletes=deletes)
        parts = [log[i::n] for i in range(n)]
        for i, part in enumerate([*parts, parts[0]]):  # the first comes twice
            sync.tick(t, spark.createDataFrame(part, LOG), i, ["k"], "seq")
        assert rows(t.read()) == state(log, deletes)


def test_late_changes_do_not_win(spark):
    for t in (keyed.KeyedTable(spark, path(spark), ["k"], "seq", 4), sinks.VersionedTable(spark, path(spark))):
        for i, change in enumerate([(1, 10, "new", "upsert"), (1, 5, "old", "upsert"), (2, 7, None, "delete"), (2, 6, "late", "upsert")]):
            sync.tick(t, spark.createDataFrame([change], LOG), i, ["k"], "seq")
        assert rows(t.read()) == [(1, 10, "new")]
    t = sinks.VersionedTable(spark, path(spark))
    for i, seq in enumerate((10, 5, None)):
        sync.upsert_delta(t, spark.createDataFrame([(1, seq, f"v{seq}")], "k int, seq int, v string"), f"r{i}", ["k"], "seq")
        assert t.read().first()["v"] == ("v10" if seq else "vNone")


def test_old_tombstones_go(spark):
    t = keyed.KeyedTable(spark, path(spark), ["k"], "seq", 1)
    t.merge(spark.createDataFrame([(1, 1, "a"), (2, 9, "b")], "k int, seq int, v string"), F.col("k") == 1)
    assert t._stored().count() == 2 and t.read().count() == 1
    t.merge(spark.createDataFrame([(1, 2, "too late"), (3, 11, "c")], "k int, seq int, v string"), since=5)
    assert rows(t.read()) == [(2, 9, "b"), (3, 11, "c")] and t._stored().count() == 2
    t.delete(spark.createDataFrame([(3,)], "k int"), 12)
    assert rows(t.read()) == [(2, 9, "b")]


def test_only_touched_buckets_are_written(spark):
    t = keyed.KeyedTable(spark, path(spark), ["id"], "seq", 50)
    t.merge(spark.range(1000).selectExpr("id", "1 AS seq", "id * 2 AS v"))
    before = t.files()
    n = t.merge(spark.range(10).selectExpr("id", "2 AS seq", "-1L AS v"))  # one key in a hundred
    assert 1 <= n <= 10 and len(before - t.files()) == n and len(before & t.files()) == len(before) - n
    assert t.read().where("v = -1").count() == 10 and t.read().count() == 1000


def test_a_merge_that_died_is_finished(spark, monkeypatch):
    t = keyed.KeyedTable(spark, path(spark), ["id"], "seq", 4)
    t.merge(spark.range(20).selectExpr("id", "1 AS seq"))
    monkeypatch.setattr(t, "_finish", lambda: None)
    t.merge(spark.range(5).selectExpr("id", "2 AS seq"))  # written beside the table only
    monkeypatch.undo()
    fs, at = t._fs(f"{t.path}/{keyed.BUCKET}=0")
    fs.delete(at, True)  # and died on its way into it
    assert t.read().where("seq = 2").count() == 5 and t.read().count() == 20
    t.merge(spark.range(3).selectExpr("id", "0 AS seq"))
    assert t.read().where("seq = 2").count() == 5 and t.read().count() == 20 and t._ready() is None


def test_a_commit_that_died_locks_nothing(spark):
    t = sinks.VersionedTable(spark, path(spark))
    t.commit(spark.range(3), "first")
    publish = t._publish
    t._publish = lambda v, run: (_ for _ in ()).throw(RuntimeError("died"))
    with pytest.raises(RuntimeError):
        t.commit(spark.range(9), "dies")
    t._publish = publish
    assert t.version == 1 and t.read().count() == 3
    assert t.commit(spark.range(5), "second") == 2 and t.read().count() == 5 and t.has_run("second") and not t.has_run("dies")
    with pytest.raises(Exception):
        t._publish(2, "rival")
    assert t.read().count() == 5


def test_saved_keys_are_not_dealt_anew(spark):
    key = "k int"
    saved = sync.saved_keys(spark.range(2000).selectExpr("cast(id AS int) AS k"), ["k"], f"saved_{uuid.uuid4().hex}", 8, path(spark, "keys"))
    now = spark.createDataFrame([(i,) for i in range(0, 3000, 3)], key)
    found = sync.reconcile_saved(saved, now, spark.createDataFrame([(1,), (5000,)], key), ["k"])
    want = {k: "keep" for k in range(0, 2000, 3)} | {k: "delete" for k in range(2000) if k % 3} | {k: "add" for k in range(2001, 3000, 3)} | {1: "keep", 5000: "add"}
    assert {r["k"]: r["state"] for r in found.collect()} == want
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    lines = plan.split("\n")
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line)
    join = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line)
    assert not any("Exchange" in line for line in lines[join:scan])


# databases ------------------------------------------------------------------------------------------------------------------


def test_database_round_trip(spark):
    df = spark.range(1000).selectExpr("IF(id = 3, NULL, id * id) AS id", "cast(id * 1.0001 AS decimal(19,4)) AS price", "concat('t', id % 5) AS \"Kind\"".replace('"', "`"), "X'00' AS shape")
    options = databases.embedded_options(f"d{uuid.uuid4().hex}", "things")
    databases.create_as(df, options, {"Kind": "VARCHAR(5)"})
    back, left_out = databases.read_by_key(spark, options, "id", 8, [("price", "money"), ("shape", "varbinary")])
    assert left_out == [("shape", "binary")] and back.schema["price"].dataType.simpleString() == "decimal(19,4)"
    assert back.rdd.getNumPartitions() == 8
    sizes = [r[1] for r in back.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * min(sizes)
    assert quality.same_table(df.drop("shape"), back)
    few = back.where("Kind = 't3' AND id > 10").select("price")
    assert "PushedFilters" in (plan := few._jdf.queryExecution().executedPlan().toString()) and "GreaterThan(id,10)" in plan and "EqualTo(Kind,t3)" in plan
    assert few.count() == 199
    with pytest.raises(BuildError):
        databases.range_predicates("id", ["a'; DROP"])


@pytest.mark.parametrize("kind", ["date", "timestamp", "double"])
def test_database_ranges_of_other_keys(spark, kind):
    made = {"date": "date_add(date'2024-01-01', cast(id * id / 100 AS int))", "timestamp": "timestamp_seconds(id * id)", "double": "id * id + 0.25D"}[kind]
    df = spark.range(500).selectExpr(f"{made} AS k", "id")
    options = databases.embedded_options(f"d{uuid.uuid4().hex}", "things")
    databases.create_as(df, options)
    back, _ = databases.read_by_key(spark, options, "k", 4)
    sizes = [r[1] for r in back.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * min(sizes) and quality.same_table(df, back)


def test_database_files(spark):
    values = [(None if i == 3 else i * i, Decimal(i) / 10000 + 10**14, f"t{i % 5}\0é" if i % 7 else None, i * 0.1, dt.date(2024, 1, 1)) for i in range(1000)]
    df = spark.createDataFrame(values, "id bigint, price decimal(19,4), `Ki\"nd` string, d double, day date").repartition(6)
    source = databases.create_files(df, new_folder(spark, "database"), "things", "id")
    back = databases.read_files_by_key(spark, source, 8)
    assert len(source.files) == 6 and back.schema.simpleString() == df.schema.simpleString() and quality.same_table(df, back)
    sizes = [r[1] for r in back.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * min(sizes)
    few = databases.read_files_by_key(spark, source, 8, [Predicate('Ki"nd', "eq", "t3\0é"), Predicate("id", "gt", 10)])
    assert quality.same_table(df.where("`Ki\"nd` = 't3\\0é' AND id > 10"), few) and few.count() > 100
    empty = databases.create_files(df.where("false"), new_folder(spark, "database"), "things", "id")
    assert databases.read_files_by_key(spark, empty, 8).count() == 0
    for folder, key in (("hdfs://x/y", "id"), (new_folder(spark, "database"), "d")):
        with pytest.raises(BuildError):
            databases.create_files(df, folder, "things", key)


def test_database_read_on_a_cluster():
    """Executors that are processes of their own read what others wrote."""
    code = """
import tempfile
from pyspark.sql import SparkSession
import __spark_entry__
s = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config(
    "spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-")).getOrCreate()
print("rows", __spark_entry__.queries()["database_read"](s, "/root/testdata/sf0.001").count(), s.read.parquet(
    "/root/testdata/sf0.001/orders.parquet").where("o_orderstatus = 'F' AND o_custkey > 10").count())
s.stop()
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "SPARK_"))} | {"PYTHONPATH": root}
    run = subprocess.run([sys.executable, "-c", code], env=env, cwd=tempfile.mkdtemp(prefix="spark-"), capture_output=True, text=True, timeout=170)
    found = [x.split() for x in run.stdout.splitlines() if x.startswith("rows ")]
    assert found and found[0][1] == found[0][2] != "0", run.stderr[-1500:]


# profiles and documents ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 3, 200])
def test_three_failing_examples(spark, n):
    values = [f"x{i % n}" + "é" * 60 for i in range(3 * n)] + ["12", "2024-01-02", " true ", None] if n else [None, "7"]
    df = spark.createDataFrame([(v,) for v in values], "a string").repartition(3)
    found = {r["how"]: r for r in profiles.parse_rates(df).collect()}
    reads = {"to_number": {"12", "7"}, "to_integer": {"12", "7"}, "to_boolean": {" true "}, "to_date": {"2024-01-02"}, "YYYY-MM-DD": {"2024-01-02"}}
    for how, r in found.items():
        failing = [v for v in values if v is not None and v not in reads.get(how, set())]
        assert r["examples"] == sorted({v[:50] for v in failing}, key=str.encode)[:3], how
        assert r["n_passed"] == r["n_values"] - len(failing)


def test_sketches_of_parts_merge(spark):
    df = spark.range(20_000).selectExpr("id % 7 AS day", "id % 5000 AS k", "IF(id % 10 = 0, NULL, cast(id AS double)) AS x", "cast(id % 3 AS string) AS s")
    first = profiles.part_sketches(df.where("day < 5"), "day", ["k", "x", "s"])
    grown = profiles.grown_sketches(first, df, "day", ["k", "x", "s"])
    assert sorted(r[0] for r in grown.select("part").distinct().collect()) == list(range(7)) and grown.count() == 21
    found = {r["column"]: r for r in profiles.merged_sketches(grown, [0.25, 0.5]).collect()}
    assert found["x"]["n_rows"] == 20_000 and found["x"]["n_null"] == 2000 and abs(found["k"]["n_distinct"] - 5000) < 250
    assert found["s"]["n_distinct"] == 3 and found["s"]["quantiles"] is None and abs(found["x"]["quantiles"][1] - 10_000) < 600
    bounds = profiles.sketched_bounds(grown, "k", 4)
    assert len(bounds) == 3 and all(abs(b - 1250 * (i + 1)) < 200 for i, b in enumerate(bounds))
    assert profiles.sketched_bounds(grown, "s", 4) == []


def test_documents_of_any_shape(spark):
    texts = ['{"a": 1, "b": {"c": "x", "d.e": true}}', '{"a": 2.5, "b": {"c": null}}', '{"b": 7}', '{"q\'s": [1, 2]}', "[1]", "5", "null", "no json", None, "{}"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, doc string")
    objects = df.where("k IN (0, 1, 3, 6, 8, 9)")
    flat, rejects = schemas.flattened_documents(objects, "doc")
    assert set(flat.columns) == {"k", "doc.a", "doc.b.c", "doc.b.d.e", "doc.q's"} and rejects.count() == 0
    found = {r["k"]: r.asDict() for r in flat.collect()}
    assert len(found) == 6 and float(found[1]["doc.a"]) == 2.5 and found[0]["doc.b.c"] == "x" and found[0]["doc.b.d.e"] is True and found[3]["doc.q's"] == "[1,2]"
    shares = {r["path"]: (r["n_present"], round(r["share"], 3)) for r in schemas.document_presence(objects, "doc").collect()}
    assert shares == {"a": (2, 0.333), "b.c": (1, 0.167), "b.d.e": (1, 0.167), "q's": (1, 0.167)}
    flat, rejects = schemas.flattened_documents(df, "doc", schemas.inferred_documents(objects, "doc"))
    assert {r["input_value"] for r in rejects.collect()} == {"[1]", "5", "no json"} and flat.count() == 7


def test_asof_join_with_one_key(spark):
    n = 90_000
    prices = spark.range(n).selectExpr("'k' AS key", "timestamp_seconds(id * 10) AS since", "id AS price")
    events = spark.range(0, n * 20, 1, 4).selectExpr("id", "'k' AS key", "timestamp_seconds(id div 2) AS at")
    began = time.time()
    out = relations.asof_join(events, prices, ["key"], "at", "since", ["price"])
    assert out.where("price <> id div 20 OR price IS NULL").count() == 0 and out.count() == n * 20
    assert time.time() - began < 120  # span by span it would be 10 ** 11 comparisons


# delivery ---------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("asks", [True, False])
def test_delivery_goes_on_after_a_failure(spark, tmp_path, monkeypatch, asks):
    monkeypatch.setattr(sinks, "PART_ROWS", 10)
    cut = sinks.assign_parts
    monkeypatch.setattr(sinks, "assign_parts", lambda df, folder: cut(df, 10, 10_000, folder))
    got, folder = str(tmp_path), path(spark, "delivery")

    def send(key, body):
        with open(f"{got}/{key}.{uuid.uuid4().hex}", "w") as f:
            f.write(body)
        if key.endswith("-2") and not os.path.exists(f"{got}/failed"):
            open(f"{got}/failed", "w").close()
            raise OSError("the line went dead after the part had gone out")

    has = (lambda key: any(f.startswith(f"{key}.") for f in os.listdir(got))) if asks else None
    df = spark.range(400).selectExpr("id", "repeat('x', 5) AS t").repartition(2)
    with pytest.raises(Exception):
        sinks.deliver(df, send, folder, has)
    sinks.deliver(df, send, folder, has)
    assert sinks.deliver(df, send, folder, has) == 0
    names = [f.split(".")[0] for f in os.listdir(got) if f != "failed"]
    assert len(set(names)) == spark.read.parquet(f"{folder}/parts").count() == spark.read.parquet(f"{folder}/ledger").distinct().count()
    assert len(names) == len(set(names)) if asks else len(names) <= len(set(names)) + 16 < 2 * len(set(names))


# texts --------------------------------------------------------------------------------------------------------------------------------


def test_edges_of_numbers_and_times(spark):
    numbers = {"1": 1, "+1.": 1, "-.5": -0.5, "1e3": 1000, "1E-0003": 0.001, " 2\t": 2, "1e12345": None, "1e+00001": None, "1e0001": 10, ".": None, "": None, "+": None, "--1": None,
               "1-": None, "1.2.3": None, "1e": None, "e5": None, "1e5e5": None, "0x10": None, "NaN": None, "Infinity": None, "1d": None, "1f": None, "1 2": None, "1e999": None, "٣": None, "1_0": None}
    day, t = dt.datetime(2024, 2, 29), dt.datetime(2024, 2, 29, 1, 2, 3)
    dates = {"2024-02-29": day, "2024-02-29Z": day, "2024-02-29T01:02:03": t, "2024-02-29 01:02:03Z": t, "2023-02-29": None, "2024-02-29T01:02": None, "2024-2-29": None, "2024-02-29z": None,
             "2024-02-29T01:02:60": None, "2024-02-29T24:00:00": None, "2024-02-29t01:02:03": None, "2024/02/29": None, "2024-02-29ZZ": None, "٢٠٢٤-02-29": None, "2024-02-29T01:02:03.5": None, "": None}
    stamps = dates | {"2024-02-29T01:02:03.5": t.replace(microsecond=500_000), "2024-02-29 01:02:03.123456Z": t.replace(microsecond=123_000), "2024-02-29T01:02:03.": None,
                      "2024-02-29T01:02:03.1234567": None, "2024-02-29.5": None, "2024-02-29T01:02:03.1a": None}
    for made, want in ((scalars.to_number, numbers), (scalars.to_date, dates), (scalars.to_timestamp, stamps)):
        df = spark.createDataFrame([(k,) for k in want], "t string")
        assert {r["t"]: r["v"] for r in df.select("t", made(field("t", "text")).col.alias("v")).collect()} == want
    df = spark.createDataFrame([("29/02/2024 07h",), ("29-02-2024 07h",), ("2/02/2024 07h",), ("29/02/2024 07hh",)], "t string")
    assert [r[0] for r in df.select(scalars.parse_date(field("t", "text"), "DD/MM/YYYY HHh").col).collect()] == [dt.datetime(2024, 2, 29, 7), None, None, None]


def test_examples_of_few_texts_take_no_second_look(spark, monkeypatch):
    """Columns of few distinct texts are told by the first aggregation; others look again at rows that may matter only."""
    df = spark.range(3000).selectExpr("element_at(array('A', 'N', 'R'), cast(id % 3 AS int) + 1) AS flag",
                                      "element_at(array('F', NULL), cast(id % 2 AS int) + 1) AS status", "concat('x', lpad(id, 5, '0')) AS many")
    looked, attempts = [], profiles._attempts
    monkeypatch.setattr(profiles, "_attempts", lambda d, columns: looked.append(d.count()) or attempts(d, columns))
    got = {(r["column"], r["how"]): r["examples"] for r in profiles.parse_rates(df).collect()}
    assert got["flag", "to_number"] == ["A", "N", "R"] and got["status", "to_date"] == ["F"]
    assert all(got["many", how] == ["x00000", "x00001", "x00002"] for how in profiles._WAYS)
    assert looked[0] == 3000 and sum(looked[1:]) < 50
    texts = [None, "", "é", "\U0001f600", "\uffff", "a" * 60, "a" * 61, "b", "1", "true", *[f"t{i}" for i in range(40)]]
    for n in (3, 5, 8, 20, len(texts)):
        some = texts[:n]
        got = {r["how"]: r["examples"] for r in profiles.parse_rates(spark.createDataFrame([(t,) for t in some * 2], "x string")).collect()}
        fails = {t[:50] for t in some if t is not None and t not in ("1", "true")}
        for how in ("YYYY-MM-DD", "to_date"):
            assert got[how] == sorted(fails | {t for t in some if t in ("1", "true")}, key=lambda t: t.encode())[:3]

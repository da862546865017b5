"""A Merkle manifest of a dataset: a digest of every row, a root over all of them, and a proof for each.

The rows of a group are leaves in order of id. Runs of eight nodes become their digest, level by level, until one node
is left, the group's subroot; the subroots become the root in the same way. A proof is the list of the siblings on the
way up, so that anybody can fold a row into the root without the other rows.

The tree is a nested-struct rollup. A leaf's rank in its group is written in digits of base eight. Blocks of 512 leaves
(three digits) are grouped by one digit less at a time, each time nesting the children's structs in their parent, all
under one dealing of the rows; the blocks' roots are the leaves of the next storey, 512 times smaller, until one node a
group is left. On the way down a block and the proof of its root meet in the same grouping (a union, no join), and
``transform`` and ``explode`` open the structs again, which gives each child its siblings. No task ever holds more
than a block of a group, however large the group; ranks come from sorted ranges and the ranges' counts.

Defined cases: an absent value (null) is a mark of its own in a leaf, so null and empty text differ; a null group is a
group, ordered first; a null id is ordered first and is never tampered with; rows with equal group and id are ordered
by leaf, and equal rows are separate leaves with the same digest; a group of one row has its leaf as subroot; an empty
table gives an empty manifest; texts of any length are digested whole; extra columns, of any name, are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import mark, release, staged

#: Nodes of a run, and digits of a block.
FAN, DIGITS = 8, 3
_BITS = 3
_SPAN = DIGITS * _BITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*hexes: Column) -> Column:
    return F.sha2(F.concat(*hexes), 256)


def written(value: Column) -> Column:
    """A value as it enters a leaf: its bytes' count, a colon and itself; a dash for null."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_of(values: Sequence[Column]) -> Column:
    return digest(*[written(v) for v in values])


def _levels(size: str) -> Column:
    """How often runs are made out of so many nodes until one is left."""
    return F.expr(f"aggregate(sequence(0, 20), 0, (n, k) -> n + int({size} > shiftleft(1L, {_BITS} * k)))")


def ranked(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """Nodes (tree, hash, own, and the order's columns) with their rank in the tree and its size. Nodes are dealt by
    ranges and sorted there; a tree's ranges are counted and summed up, one row for each."""
    parts = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = [F.col("tree"), *[F.col(c).asc_nulls_first() for c in order]]
    placed = nodes.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn(
        "place", F.monotonically_increasing_id()).select("tree", "hash", "own", "place")
    placed = staged(placed, "ranges").withColumn("part", F.shiftright("place", 33))
    counts = placed.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("size"))
    return placed.join(starts, ["tree", "part"]).select(
        "tree", (F.col("place") + F.col("shift")).alias("rank"), "size", "hash", "own")


def _rolled(nodes: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per block (tree, block, size, kids, hash): digit columns of the rank are grouped away one by one, from
    the lowest, and each group's nodes become the kids of its node. ``keep`` are columns of one row of a block."""
    digits = [f"d{j}" for j in range(DIGITS)]
    rows = nodes.repartition("tree", "block")
    for j in range(DIGITS):
        kid = F.when(F.col("node").isNotNull(), F.struct(F.col(digits[j]).alias("at"), "node"))
        rows = rows.groupBy("tree", "block", *reversed(digits[j + 1:])).agg(
            F.sort_array(F.collect_list(kid)).alias("kids"), F.max("size").alias("size"),
            *[F.first(c, ignorenulls=True).alias(c) for c in keep])
        joined = F.sha2(F.array_join(F.transform("kids", lambda k: k["node"]["hash"]), ""), 256)
        whole = F.when(_levels("size") > j, joined).otherwise(F.expr("try_element_at(kids, 1).node.hash"))
        node = F.struct(whole.alias("hash"), F.col("kids"))
        rows = rows.withColumn("node", F.when(F.size("kids") > 0, node))
    return rows


def _in_blocks(nodes: DataFrame) -> DataFrame:
    digit = lambda j: F.shiftright("rank", _BITS * j).bitwiseAND(F.lit(FAN - 1)).cast("int")
    return nodes.select("tree", F.shiftright("rank", _SPAN).alias("block"), "size",
                        *[digit(j).alias(f"d{j}") for j in range(DIGITS)], F.struct("hash", "own").alias("node"))


def grown(nodes: DataFrame) -> list[DataFrame]:
    """Storeys of trees: the nodes, the roots of their blocks, those blocks' roots, until each tree has one node."""
    storeys = [nodes]
    most = None
    while most is None or most > 1:
        blocks = _rolled(_in_blocks(storeys[-1]))
        up = blocks.select("tree", F.col("block").alias("rank"),
                           F.expr(f"(size + {(1 << _SPAN) - 1}) div {1 << _SPAN}").alias("size"),
                           F.col("node.hash").alias("hash"), F.lit(None).cast("string").alias("own"))
        storeys.append(staged(up, "blocks"))
        most = storeys[-1].agg(F.max("size")).first()[0] or 0
    return storeys


def opened(storeys: Sequence[DataFrame], tops: DataFrame) -> DataFrame:
    """(tree, rank, hash, own, path, sub, root) of every node of the lowest storey. ``tops`` has (tree, rank, path,
    sub, root) for the nodes of the highest; a path is a list of (at, others): the place in a run, and its other nodes.
    Each storey's blocks meet their roots' rows in the grouping itself."""
    found = tops
    for storey in reversed(storeys[:-1]):
        blocks = _in_blocks(storey)
        roots = found.select("tree", F.col("rank").alias("block"), "path", "sub", "root")
        rows = _rolled(blocks.unionByName(roots, allowMissingColumns=True), ["path", "sub", "root"])
        rows = rows.select("tree", F.col("block").alias("rank"), "size", "kids", "path", "sub", "root")
        for j in reversed(range(DIGITS)):
            rows = rows.select("*", F.posexplode("kids").alias("at", "kid"))
            others = F.expr("transform(filter(kids, (k, i) -> i <> at), k -> k.node.hash)")
            step = F.array(F.struct("at", others.alias("others")))
            path = F.when(_levels("size") > j, F.concat(step, "path")).otherwise(F.col("path"))
            inner = [F.col("kid.node.kids").alias("kids")] if j else [F.col("kid.node.hash").alias("hash"),
                                                                     F.col("kid.node.own").alias("own")]
            rows = rows.select("tree", (F.col("rank") * FAN + F.col("at")).alias("rank"), "size", *inner,
                               path.alias("path"), "sub", "root")
        found = rows
    return found


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf folds into with its proof."""
    def up(acc: Column, step: Column) -> Column:
        o, at = step["others"], step["at"]
        return F.sha2(F.array_join(F.concat(F.slice(o, F.lit(1), at), F.array(acc),
                                            F.slice(o, at + 1, F.lit(FAN))), ""), 256)

    return F.aggregate(path, start, up)


def merkle_manifest(docs: DataFrame, values: Sequence[str] = FIELDS, group: str = "lang", key: str = "doc_id",
                    second: Column | None = None) -> DataFrame:
    """(key, second, leaf, subroot, root, path) for every row. ``second`` is a column that goes with a leaf, such as
    the leaf of a copy to be verified."""
    tree = F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit(""))
    leaves = staged(docs.select(
        tree.alias("tree"), F.col(key).alias("key"), leaf_of([F.col(v) for v in values]).alias("hash"),
        (F.lit(None).cast("string") if second is None else second).alias("second"),
        F.monotonically_increasing_id().alias("tie")), "leaves")
    leaves = ranked(leaves.withColumn("own", F.struct("key", "second")), ["key", "hash", "tie"])
    storeys = grown(leaves)
    subroots = storeys[-1].select(F.lit("").alias("tree"), "hash", F.col("tree").alias("own"))
    forest = grown(ranked(subroots, ["own"]))
    no_path = F.array().cast("array<struct<at:int,others:array<string>>>")
    tops = forest[-1].select("tree", "rank", no_path.alias("path"), F.lit(None).cast("string").alias("sub"),
                             F.col("hash").alias("root"))
    roots = opened(forest, tops)  # a row for each tree
    tops = roots.select(F.col("own").alias("tree"), F.lit(0).cast("bigint").alias("rank"), "path",
                        F.col("hash").alias("sub"), "root")
    return opened(storeys, staged(tops, "subroots")).select(
        F.col("own.key").alias(key), F.col("own.second").alias("second"), F.col("hash").alias("leaf"),
        F.col("sub").alias("subroot"), "root", "path")


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.flatten(F.transform(path, lambda s: s["others"])), ""), 256)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    start = mark()
    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    lower = F.translate("text", _UPPER, _LOWER)
    tampered = F.when(chosen, leaf_of([lower if f == "text" else F.col(f) for f in FIELDS]))
    rows = merkle_manifest(docs, second=tampered).select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        folded(F.coalesce("second", "leaf"), F.col("path")).alias("folded_root"))
    out = staged(rows.withColumn("verified", F.col("folded_root") == F.col("root")), "proofs")
    release(spark, start, mark() - 1)
    return out


def _sql(levels: int = 7) -> str:
    """A chain of common table expressions: the tree level by level up, and every leaf folded level by level."""
    value = lambda f: f"coalesce(strlen({f}::VARCHAR) || ':' || {f}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(text if f == "text" else value(f) for f in FIELDS) + ")"
    lower = f"coalesce(strlen(text) || ':' || translate(text, '{_UPPER}', '{_LOWER}'), '-')"
    crc = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), "
           "lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), "
           "range(8)), lambda x, k: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)")
    parts = [
        f"""d AS (SELECT *, {leaf(value('text'))} AS leaf, CASE WHEN ({crc}) % 3 = 0 THEN {leaf(lower)} END AS second,
        coalesce('=' || lang, '') AS tree FROM documents)""",
        """a0 AS (SELECT tree, doc_id, leaf, second, leaf AS h, count(*) OVER (PARTITION BY tree) AS n,
        row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM d)"""]

    def storeys(p: str) -> None:
        for k in range(levels):
            parts.append(f"""{p}{k + 1} AS (SELECT tree, r // 8 AS r, (n + 7) // 8 AS n,
            CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY r)) ELSE min(h) END AS h FROM {p}{k} GROUP BY tree, r // 8, n)""")

    storeys("a")
    parts.append(f"""b0 AS (SELECT '' AS tree, tree AS own, h, count(*) OVER () AS n,
    row_number() OVER (ORDER BY tree) - 1 AS r FROM a{levels})""")
    storeys("b")
    parts.append("""f0 AS (SELECT tree, doc_id, leaf, coalesce(second, leaf) AS acc, '' AS proof, r AS spot, n AS m FROM a0)""")

    def fold(src: str, dst: str, storey: str, tree: str) -> None:
        run = f"""SELECT tree, r // 8 AS q, n, list(h ORDER BY r) AS hs FROM {storey} GROUP BY tree, r // 8, n"""
        left, right = "array_to_string(hs[1:(spot % 8)], '')", "array_to_string(hs[(spot % 8 + 2):8], '')"
        parts.append(f"""{dst} AS (SELECT f.* EXCLUDE (acc, proof, spot), CASE WHEN n > 1 THEN sha256({left} || acc || {right}) ELSE acc END AS acc,
        proof || CASE WHEN n > 1 THEN {left} || {right} ELSE '' END AS proof, spot // 8 AS spot FROM {src} f JOIN ({run}) s ON s.tree = {tree} AND s.q = f.spot // 8)""")

    for k in range(levels):
        fold(f"f{k}", f"f{k + 1}", f"a{k}", "f.tree")
    parts.append(f"g0 AS (SELECT f.* EXCLUDE (spot), b0.r AS spot, b0.h AS subroot FROM f{levels} f JOIN b0 ON b0.own = f.tree)")
    for k in range(levels):
        fold(f"g{k}", f"g{k + 1}", f"b{k}", "''")
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, b.h AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = b.h AS verified
FROM g{levels}, b{levels} b"""


QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
ORACLE = {"op11_merkle_manifest": _sql()}

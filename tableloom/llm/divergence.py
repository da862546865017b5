"""How the sources of a language differ in their words: an audit of a corpus before it is mixed.

Terms are counted by a token-start pointer sort. A task takes its texts as they lie in Arrow's buffers, finds where terms
begin, and sorts these pointers by the terms' bytes with a multikey quicksort: eight bytes at a time are compared as one
unsigned number, a large slice is parted in three around a pivot and its middle goes on eight bytes further, small
slices are finished by sorting. The pointers come in order of source and document, and the sort keeps that order
among equal terms, so each run of equal pointers gives, by its boundaries alone, the term's count and its documents for
every source. Runs are merged over a task's slices and then by Spark, one row a task, group and term.

Sources are compared in shares of a thousand million, with one added to each count of a kept term and one for its
absence. A pair of sources needs a sum over all kept terms of their language; all but the terms that one of them has
contribute the same amount, so tasks add up only the difference, for tiles of 32 sources and slices of some thousand
terms, which bounds a task by the tile and the slice. No task gets all of a source or a term.

Defined cases: null texts, languages and sources count as empty ones; a group without terms occurs with count 0 for
every kept term, and where a language keeps no term its pairs have value 0; ties are ordered by item in UTF-8; repeated
rows are separate documents; a text longer than a slice is counted slice by slice and is one document; an empty table
gives an empty result; extra columns, of any name, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import mark, release, staged
from ._text import _LOWER, blocks, raw

#: Documents in which a term must occur to be kept, and terms reported for a group.
LEAST_DOCS, TOP = 10, 10
#: Shares are counted in so many parts.
PARTS = 1_000_000_000
#: Bytes of a slice of texts, rows that a task holds before it hands them on, pointers that are sorted without parting.
SLICE, HELD, SMALL = 4 << 20, 400_000, 1 << 16
#: Sources of a tile and terms of a slice of a language, in which pairs are compared.
TILE, TERMS = 32, 4096

_INK = np.zeros(256, bool)
_INK[65:91] = _INK[97:123] = _INK[128:] = True
_MASKS = np.array([(0xFFFFFFFFFFFFFFFF << (8 * (8 - k))) & 0xFFFFFFFFFFFFFFFF for k in range(9)], np.uint64)


def term_pointers(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of letters and non-ASCII bytes in ``b``."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], _INK[b], [False]))))
    return edges[::2], edges[1::2]


def pointer_sort(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, small: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """The order of the terms at ``starts`` to ``ends``, which keeps that of equal ones, and where a new term begins.
    Multikey quicksort over characters of eight bytes; terms have no zero byte, so a zero ends them."""
    words = np.ndarray(len(b) + 1, ">u8", np.concatenate((b, np.zeros(8, np.uint8))).tobytes(), 0, (1,))
    order, fresh = np.arange(len(starts)), np.zeros(len(starts), bool)
    fresh[:1] = True

    def keys(p: np.ndarray, depth: int) -> np.ndarray:
        at = starts[p] + depth
        return words[np.minimum(at, len(b))].astype(np.uint64) & _MASKS[np.clip(ends[p] - at, 0, 8)]

    def finish(lo: int, hi: int, depth: int) -> None:
        spots, run = np.arange(lo, hi), np.zeros(hi - lo, np.int64)
        while len(spots):
            p = order[spots]
            key = keys(p, depth)
            place = np.lexsort((key, run))
            key = key[place]
            order[spots] = p[place]
            new = np.ones(len(spots), bool)
            new[1:] = (key[1:] != key[:-1]) | (run[1:] != run[:-1])
            fresh[spots[new]] = True
            run = np.cumsum(new)
            same = np.zeros(len(spots), bool)  # several with this key
            same[:-1] |= ~new[1:]
            same[1:] |= ~new[1:]
            going = same & (key & np.uint64(255) != 0)
            spots, run, depth = spots[going], run[going], depth + 8

    stack = [(0, len(starts), 0)]
    while stack:
        lo, hi, depth = stack.pop()
        if hi - lo <= small:
            finish(lo, hi, depth)
            continue
        p = order[lo:hi]
        key = keys(p, depth)
        pivot = np.sort(key[:: max(1, len(key) // 255)])[len(key[:: max(1, len(key) // 255)]) // 2]
        less, more = key < pivot, key > pivot
        mid = ~(less | more)
        order[lo:hi] = np.concatenate((p[less], p[mid], p[more]))
        a, z = lo + int(less.sum()), hi - int(more.sum())
        fresh[a] = True
        if z < hi:
            fresh[z] = True
        if lo < a:
            stack.append((lo, a, depth))
        if z < hi:
            stack.append((z, hi, depth))
        if pivot & np.uint64(255):
            stack.append((a, z, depth + 8))
    return order, fresh


def _texts_at(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    lengths = ends - starts
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    data = b[np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))


def counted(data: np.ndarray, offs: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, documents, count) of some texts: row i lies at offs[i] to offs[i + 1] and is of group[i]. A text
    must not end inside a term of the next one: callers pass whole texts, or cuts between terms."""
    b = _LOWER[data[offs[0] : offs[-1]]]
    local = offs - offs[0]
    starts, ends = term_pointers(b)
    inner = local[1:-1]  # texts that touch: a run of letters over a border is two terms
    cut = inner[(inner > 0) & (inner < len(b))]
    cut = np.unique(cut[_INK[b[cut - 1]] & _INK[b[cut]]])
    starts, ends = np.sort(np.concatenate((starts, cut))), np.sort(np.concatenate((ends, cut)))
    doc = np.searchsorted(local, starts, "right") - 1
    by = np.argsort(group[doc], kind="stable")
    starts, ends, doc = starts[by], ends[by], doc[by]
    order, fresh = pointer_sort(b, starts, ends)
    doc = doc[order]
    g = group[doc]
    pair = fresh.copy()
    pair[1:] |= g[1:] != g[:-1]
    one = pair.copy()
    one[1:] |= doc[1:] != doc[:-1]
    at = np.flatnonzero(pair)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, pa.array([], pa.string()), none, none
    n = np.diff(np.concatenate((at, [len(doc)])))
    return g[at], _texts_at(b, starts[order[at]], ends[order[at]]), np.add.reduceat(one.astype(np.int64), at), n


def _merged(held: list[pa.Table]) -> pa.Table:
    found = pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("df", "sum"), ("n", "sum")])
    return found.rename_columns(["lang", "source", "term", "df", "n"])


def _long(data: np.ndarray, lo: int, hi: int, size: int) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """One text slice by slice, cut where no term is."""
    parts = []
    while lo < hi:
        end = min(hi, lo + size)
        while end < hi and _INK[data[end - 1]] and _INK[data[end]]:
            end += 1
        parts.append(counted(data, np.array([lo, end]), np.zeros(1, np.int64)))
        lo = end
    t = pa.table({"term": pa.concat_arrays([p[1] for p in parts]), "n": np.concatenate([p[3] for p in parts])})
    t = t.group_by("term").aggregate([("n", "sum")])
    n = t.column("n_sum").to_numpy()
    return np.zeros(len(n), np.int64), t.column("term").combine_chunks(), np.ones(len(n), np.int64), n


def count_terms(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """From (lang, source, text) to (lang, source, term, df, n), merged over what a task reads as far as that stays
    small."""
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        langs, sources = (batch.column(i).dictionary_encode() for i in (0, 1))
        group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
        data, offs = raw(batch.column(2))
        for i, j in blocks(data, offs, size):
            if offs[j] - offs[i] > size and j == i + 1:
                g, term, df, n = _long(data, int(offs[i]), int(offs[j]), size)
                g = g + group[i]
            else:
                g, term, df, n = counted(data, offs[i : j + 1], group[i:j])
            width = max(1, len(sources.dictionary))
            held.append(pa.table({"lang": langs.dictionary.take(pa.array(g // width)),
                                  "source": sources.dictionary.take(pa.array(g % width)), "term": term, "df": df, "n": n}))
            rows += len(g)
            if rows > HELD:
                held = [_merged(held)]
                rows = held[0].num_rows
                if rows > HELD // 2:
                    yield from held[0].to_batches(1 << 16)
                    held, rows = [], 0
                    pa.default_memory_pool().release_unused()
    if held:
        yield from _merged(held).to_batches(1 << 16)


def term_counts(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n) of the terms that occur in ``least`` documents of their language. One shuffle: rows are
    dealt by language and term, and both the counts of sources and the documents of the language are summed there."""
    plain = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = plain.mapInArrow(count_terms, "lang string, source string, term string, df bigint, n bigint")
    sums = found.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))
    return sums.withColumn("docs", F.sum("df").over(Window.partitionBy("lang", "term"))).where(
        F.col("docs") >= least).select("lang", "source", "term", "n")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(PARTS * (count + 2) / (total + 2 * terms)), exactly."""
    wide = lambda c: c.cast("decimal(19,0)")
    over, under = F.lit(PARTS).cast("decimal(10,0)") * wide(count + 2), wide(total + 2 * terms)
    return 1 + F.call_function("div", over, under)


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pair_sums(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """What the terms of a slice add to the pairs of two tiles, beyond what an absent term adds."""
    i, p0, p = (table.column(c).to_numpy(zero_copy_only=False) for c in ("i", "p0", "p"))
    term = table.column("term").combine_chunks().dictionary_encode()
    ids, at = np.unique(i, return_inverse=True)
    base = np.zeros(len(ids), np.int64)
    base[at] = p0
    real = ~pc.is_null(table.column("term")).to_numpy(zero_copy_only=False)
    shares = np.repeat(base[:, None], len(term.dictionary), 1)
    shares[at[real], term.indices.drop_null().to_numpy()] = p[real]
    low, high = key[1].as_py(), key[2].as_py()
    a_s, b_s = np.flatnonzero(ids // TILE == low), np.flatnonzero(ids // TILE == high)
    out: list[tuple[int, int, int]] = []
    for a in a_s:
        later = b_s[b_s > a]
        if len(later):
            d, s = shares[a] - shares[later], shares[a] + shares[later]
            d0, s0 = base[a] - base[later], base[a] + base[later]
            more = (d * d // s - (d0 * d0 // s0)[:, None]).sum(1)
            out += [(int(ids[a]), int(ids[b]), int(m)) for b, m in zip(later, more)]
    return pa.table({"lang": pa.array([key[0].as_py()] * len(out), pa.string()), "i": pa.array([o[0] for o in out], pa.int64()),
                     "j": pa.array([o[1] for o in out], pa.int64()), "more": pa.array([o[2] for o in out], pa.int64())})


def source_divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` holds each other source of the language by its distance,
    part ``term`` the terms that stand out of the language most."""
    counts = staged(term_counts(docs, least), "terms")
    by_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("of_lang"))
    langs = by_lang.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("of_lang").alias("n_lang"))
    groups = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(
        0, ["total", "v", "n_lang"]).withColumn("i", place.cast("bigint"))
    tiles = F.floor((F.count(F.lit(1)).over(Window.partitionBy("lang")) - 1) / TILE)
    groups = staged(groups.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0).cast("bigint"), F.col("total"), F.col("v"))))
                    .withColumn("last_tile", tiles), "groups")

    # every count with its group's facts; a group's rows are dealt by a salt too, as one may hold most of them
    salts = 64
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    known = counts.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int")).join(salted, ["lang", "source", "salt"])
    known = staged(known.select("lang", "source", "term", "n", "i", "p0", "v", "n_lang", "last_tile",
                                share(F.col("n"), F.col("total"), F.col("v")).alias("p")), "shares")

    # terms
    whole = known.join(by_lang, ["lang", "term"]).withColumn("q", share(F.col("of_lang"), F.col("n_lang"), F.col("v")))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = whole.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                        distance(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    # pairs
    slices = F.ceil(F.col("v") / TERMS)
    tile = F.floor(F.col("i") / TILE)
    fields = ["lang", F.least(tile, "other").alias("a"), F.greatest(tile, "other").alias("b"), "slice", "i", "p0", "term", "p"]
    rows = known.withColumn("slice", F.pmod(F.xxhash64("term"), slices))
    heads = groups.where("v > 0").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), slices - 1))).withColumns(
        {"term": F.lit(None).cast("string"), "p": F.col("p0")})
    deal = F.explode(F.sequence(F.lit(0).cast("bigint"), "last_tile"))
    dealt = [d.withColumn("other", deal).select(*fields) for d in (rows, heads)]
    sums = dealt[0].unionByName(dealt[1]).groupBy("lang", "a", "b", "slice").applyInArrow(
        _pair_sums, "lang string, i bigint, j bigint, more bigint").groupBy("lang", "i", "j").agg(F.sum("more").alias("more"))
    side = lambda n: groups.select("lang", "v", F.col("source").alias(f"source{n}"), F.col("i").alias(f"i{n}"), F.col("p0").alias(f"p{n}"))
    both = side(1).join(side(2).drop("v"), "lang").where("i1 <> i2").withColumns(
        {"i": F.least("i1", "i2"), "j": F.greatest("i1", "i2")}).join(sums, ["lang", "i", "j"], "left")
    value = F.coalesce(F.col("v") * distance(F.col("p1"), F.col("p2")), F.lit(0)) + F.coalesce("more", F.lit(0))
    pairs = both.select("lang", F.col("source1").alias("source"), F.lit("pair").alias("part"),
                        F.col("source2").alias("item"), value.alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))
    return pairs.unionByName(terms)


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    start = mark()
    out = staged(source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet")), "divergence")
    release(spark, start, mark() - 1)
    return out


_P = "1 + (1000000000::HUGEINT * ({c} + 2)) // ({n} + 2 * {v})"
_F = "(({p} - {q}) * ({p} - {q})) // ({p} + {q})"
QUERIES = {"op12_source_divergence": op12_source_divergence}
ORACLE = {"op12_source_divergence": rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS k,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
t AS (SELECT lang, source, k, unnest(words) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT k) AS df FROM t GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::HUGEINT AS m FROM c GROUP BY ALL HAVING sum(df) >= 10),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(m)::HUGEINT AS total FROM kept GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
every AS (SELECT g.lang, source, kept.term, m, coalesce(n, 0)::HUGEINT AS n, v, total
          FROM g JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN c USING (lang, source, term)),
sized AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS own FROM every),
p AS (SELECT lang, source, term, n, {_P.format(c='n', n='own', v='v')} AS p, {_P.format(c='m', n='total', v='v')} AS q FROM sized),
terms AS (SELECT lang, source, 'term' AS part, term AS item, {_F.format(p='p', q='q')} AS value FROM p WHERE n > 0 AND p > q),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
            SELECT x.lang, x.source AS s1, y.source AS s2, sum({_F.format(p='x.p', q='y.p')}) AS value
            FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
          ON s.lang = a.lang AND s1 = a.source AND s2 = b.source)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (FROM terms UNION ALL FROM pairs)) WHERE part = 'pair' OR rank <= 10"""}

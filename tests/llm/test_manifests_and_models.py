"""Brute-force versions and odd input for the Merkle manifest, the audit of sources and the n-gram model."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableloom.llm import divergence, lm_scoring, merkle, queries

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(5)
    long = " ".join(rng.choice(["Aa", "bb", "über", "x-y", "tail7"]) for _ in range(3000))
    rows = [(1, "Hello hello, World", "en", "a", 18), (2, None, "en", "a", None), (3, "", "en", None, 0), (4, " \n\t", None, "b", 3),
            (5, long, "en", "b", 1), (5, long, "en", "b", 1), (6, "é ß 😀 \x00 a\x00b ▁ <s>", "fr", "c", 9), (None, "no id here", "en", "a", 1),
            (None, None, None, None, None), (7, "ABCé1éabc Zz zz", "", "", 2), (8, "x" * 500 + " " + "x" * 501, "en", "a", 1)]
    return rows + [(100 + i, rng.choice(["Hello world", "hello there World", "abc abcd abcdefgh abcdefghi"]), "en", "ab"[i % 2], i) for i in range(40)]


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).selectExpr("*", "'x' as hash", "1 as tree", "2 as rank", "3 as key", "'t' as term")


# manifests --------------------------------------------------------------------------------------------------------------


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text):
    doc_id, _, lang, source, n_chars = row
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(hashes):
    """The root of some hashes and the (place, siblings) of each on the way."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for i, path in enumerate(paths):
            run = level[at[i] // 8 * 8: at[i] // 8 * 8 + 8]
            path.append((at[i] % 8, run[: at[i] % 8] + run[at[i] % 8 + 1:]))
            at[i] //= 8
        level = [sha("".join(level[k: k + 8])) for k in range(0, len(level), 8)]
    return level[0], paths


def manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    inner = {g: climb([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in langs}
    root, tops = climb([inner[g][0] for g in langs])
    out = []
    for g, top in zip(langs, tops):
        for (_, _, h, r), path in zip(sorted(groups[g], key=lambda x: x[:3]), inner[g][1]):
            path = path + top
            acc = h
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                acc = leaf(r, None if r[1] is None else r[1].translate(LOWER))
            for at, others in path:
                acc = sha("".join(others[:at] + [acc] + others[at:]))
            out.append((r[0], h, inner[g][0], root, sha("".join(s for _, o in path for s in o)), acc, acc == root))
    return sorted(out, key=repr)


def written(spark, tmp_path, rows):
    d = tmp_path / "documents.parquet"
    (rows if hasattr(rows, "write") else spark.createDataFrame(rows, DOCS)).write.parquet(str(d))
    return str(tmp_path)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_manifest_odd(spark, tmp_path, odd, odd_rows):
    assert as_rows(queries.QUERIES["op11_merkle_manifest"](spark, written(spark, tmp_path, odd))) == manifest(odd_rows)


@pytest.mark.parametrize("n", [0, 1, 9, 513, 1300])
def test_manifest_of_any_size(spark, tmp_path, n):
    rows = [(i * 7 % n, f"Text {i}", "de" if i % 97 else None, "s", i) for i in range(n)]
    assert as_rows(queries.QUERIES["op11_merkle_manifest"](spark, written(spark, tmp_path, rows))) == (manifest(rows) if n else [])


def test_manifest_of_many_groups(spark, tmp_path):
    rows = [(i, f"T{i}", f"l{i % 600}", None, None) for i in range(700)]
    assert as_rows(queries.QUERIES["op11_merkle_manifest"](spark, written(spark, tmp_path, rows))) == manifest(rows)


def test_manifest_opens_without_joins(spark):
    nodes = spark.range(20).selectExpr("'' tree", "id rank", "20L size", "sha2(cast(id as string), 256) hash", "cast(id as string) own")
    tops = spark.createDataFrame([("", 0, [], None, "r")], "tree string, rank bigint, path array<struct<at:int,others:array<string>>>, sub string, root string")
    found = merkle.opened([nodes, tops], tops)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 20


# the audit --------------------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def audit(rows, least, top):
    docs = [((r[2] or ""), (r[3] or ""), TERM.findall((r[1] or "").translate(LOWER))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for x, _, ws in docs if x == lang for t in set(ws))
        kept = {t for t, n in df.items() if n >= least}
        count = defaultdict(Counter)
        for x, s, ws in docs:
            if x == lang:
                count[s].update(w for w in ws if w in kept)
        count = {s: count[s] for s in {d[1] for d in docs if d[0] == lang}}
        whole = sum(count.values(), Counter())

        def shares(c):
            total = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: shares(c) for s, c in count.items()}, shares(whole)
        for s in count:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in count if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, t, v, i) for i, (v, t) in enumerate(found if part == "pair" else found[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [1, 2, 10, 1000])
def test_audit_odd(odd, odd_rows, least):
    found = divergence.source_divergence(odd, least)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert as_rows(found) == audit(odd_rows, least, 10)


def test_audit_over_tiles_and_slices(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TERMS", 7)
    rng = random.Random(1)
    words = ["w" + chr(97 + i // 26) + chr(97 + i % 26) for i in range(60)]
    rows = [(i, " ".join(rng.choices(words[: rng.randint(1, 60)], k=30)), "en", f"s{i % 70}", 1) for i in range(300)]
    assert as_rows(divergence.source_divergence(spark.createDataFrame(rows, DOCS), 10)) == audit(rows, 10, 10)


def test_audit_of_nothing(odd):
    assert divergence.source_divergence(odd.limit(0)).count() == 0


@pytest.mark.parametrize("small", [1, 3, 1 << 16])
def test_pointer_sort(small):
    rng = random.Random(small)
    for _ in range(30):
        terms = ["".join(rng.choices("abé", k=rng.choice([1, 2, 7, 8, 9, 16, 17, 40]))).encode() for _ in range(rng.randint(0, 200))]
        terms += rng.choices(terms, k=len(terms)) if terms else []
        b = np.frombuffer(b" ".join(terms), np.uint8)
        starts, ends = divergence.term_pointers(b)
        assert [bytes(b[s:e]) for s, e in zip(starts, ends)] == terms
        order, fresh = divergence.pointer_sort(b, starts, ends, small)
        assert order.tolist() == sorted(range(len(terms)), key=lambda i: (terms[i], i))
        got = [terms[i] for i in order]
        assert fresh.tolist() == [i == 0 or got[i] != got[i - 1] for i in range(len(got))]


def test_long_texts_are_one_document(odd_rows):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({c: pa.array([(r[i] or "") for r in odd_rows], pa.string()) for c, i in (("lang", 2), ("source", 3), ("text", 1))})
    rows = lambda size: sorted(tuple(x) for b in divergence.count_terms(iter([batch]), size) for x in zip(*b.to_pydict().values()))
    assert rows(50) == rows(1 << 20)


# the model --------------------------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BEGIN, END = ("<",), (">",)


def model(rows, learns, order, mass):
    """Counts of n-grams, and the scores of the rows, word by word."""
    count = Counter()
    texts = [[BEGIN, *WORD.findall((r[1] or "").translate(LOWER)), END] for r in rows]
    for r, t in zip(rows, texts):
        if learns(r[0]):
            for k in range(1, order + 1):
                count.update(tuple(t[i: i + k]) for i in range(len(t) - k + 1))
    single = {g: c for g, c in count.items() if len(g) == 1 and g[0] != BEGIN}
    n, v = sum(single.values()), len(single)

    def p(context, w):
        if not context:
            return (count[(w,)] + 1) / (n + v + 1)
        less, c = p(context[1:], w), count[context]
        return (count[(*context, w)] + mass * less) / (c + mass) if c else less

    out = []
    for r, t in zip(rows, texts):
        score = sum(math.log10(p(tuple(t[max(0, i - order + 1): i]), t[i])) for i in range(1, len(t)))
        base = sum(math.log10((count[(w,)] + 1) / (n + v + 1)) for w in t[1:])
        out.append((r[0], not learns(r[0]), len(t) - 1, sum(count[(w,)] > 0 for w in t[1:]), n, base, score))
    for context in [(), *[g for g in count if 0 < len(g) < order][:20]]:
        if END not in context:  # a distribution over the known words and one unknown
            assert math.isclose(sum(p(context, w) for (w,) in single) + p(context, "?"), 1, rel_tol=1e-9)
    return out


def close(got, want):
    key = lambda r: (repr(r[:5]), r[5], r[6])
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert tuple(g[:5]) == tuple(w[:5]) and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def learns(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 != 2


@pytest.mark.parametrize("order,size", [(1, 100), (2, 100), (3, 4000), (4, 1 << 20)])
def test_model_odd(odd, odd_rows, order, size):
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    found = lm_scoring.score_texts(odd.repartition(3), ~held, order=order, mass=3.0, size=size)
    found = found.selectExpr("doc_id", "not learn", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    close(found.collect(), model(odd_rows, learns, order, 3.0))


def test_model_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.QUERIES["op13_lm_scoring"](spark, DIR).collect()
    close(found, model(rows, learns, lm_scoring.ORDER, lm_scoring.MASS))
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_pieces_add_up(odd_rows, order):
    import pyarrow as pa

    grams = lm_scoring.Grams(pa.array([r[1] or "" for r in odd_rows]), order)
    counts = grams.counts(np.ones(len(odd_rows), bool))
    automaton = lm_scoring.Automaton(grams, counts, 100, 50, 3.0)
    whole = automaton.scores(grams, 1 << 20)
    for piece in (1, 2, 5, 64):
        assert automaton.scores(grams, piece) == pytest.approx(whole, rel=1e-12)


def test_model_learns_nothing(spark, odd):
    found = lm_scoring.score_texts(odd, F.lit(False)).collect()
    assert len(found) == odd.count() and all(r["score"] == r["base_score"] == 0 and r["n_known"] == r["train_tokens"] == 0 for r in found)
    assert lm_scoring.score_texts(odd.limit(0), F.lit(True)).count() == 0

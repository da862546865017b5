"""Document fingerprints: bottom-k sketches of shingle hashes.

A fingerprint holds the k smallest hashes of a text's distinct 5-word shingles. Sketches of parts merge into the
sketch of the whole (the k smallest of their union). From two sketches the resemblance (Jaccard), the containment
and from one the number of distinct shingles are estimated; while sets have fewer than k shingles, exactly.

Defined cases: null and empty texts have the empty fingerprint, which is like itself (1.0) and unlike all others
(0.0); texts with fewer than five words have one shingle, the whole sequence; a document alone in its table is its
own next document; rows with equal ids are ordered by text; null ids come first; texts of any length are taken whole;
an empty table gives an empty result; extra columns of any name are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text

K = 256
WIDTH = 5


def sketch(shingles: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest of sorted distinct hashes."""
    return shingles[:k]


def likeness(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated resemblance of the sets behind two sketches."""
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a, b)[:k]
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum()) / len(union)


def size_estimate(s: np.ndarray, k: int = K) -> float:
    """Distinct hashes behind a sketch; exact while there are fewer than k."""
    return float(len(s)) if len(s) < k else (k - 1) / ((float(s[k - 1]) + 1) / 2.0**64)


def containment_estimate(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of a's set that b has, from their likeness and sizes."""
    j, na, nb = likeness(a, b, k), size_estimate(a, k), size_estimate(b, k)
    return min(1.0, j / (1 + j) * (na + nb) / na) if na else 1.0


def _signed(h: np.ndarray) -> np.ndarray:
    """Unsigned order kept in signed integers, so that Spark's order of bigint is the sketch's order."""
    return (h ^ np.uint64(1 << 63)).view(np.int64)


def fingerprint_column(docs: DataFrame, text_col: str = "text", out: str = "fingerprint", k: int = K,
                       width: int = WIDTH) -> DataFrame:
    """``docs`` with the sketch of each text as a sorted array of bigint."""
    kept = [f for f in docs.schema.fields if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, T.ArrayType(T.LongType()))])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            data, offs = _text.raw(batch.column(at))
            for lo, hi in _text.blocks(data, offs):
                found = [_signed(sketch(s, k)) for s in _text.shingle_sets(data, offs[lo : hi + 1], width)]
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(rows.schema.get_field_index(n)) for n in names]
                    + [pa.array(found, pa.list_(pa.int64()))], [*names, out])

    return docs.mapInArrow(run, schema)


def merge_fingerprints(sketches: DataFrame, by: list[str], col: str = "fingerprint", k: int = K) -> DataFrame:
    """The sketch of each group's union: of each group's hashes, dealt in 64 parts, the k smallest a part, and of these
    the k smallest. A group that holds most sketches is spread over the parts; window limits keep k rows a group in
    each task before a shuffle."""
    hashes = sketches.select(*by, F.explode(col).alias("_h")).withColumn("_part", F.pmod(F.xxhash64("_h"), F.lit(64)))
    order = F.col("_h").asc()
    some = hashes.withColumn("_n", F.dense_rank().over(Window.partitionBy(*by, "_part").orderBy(order)))
    some = some.where(F.col("_n") <= k).groupBy(*by, "_part", "_h").agg(F.lit(1).alias("_one"))
    best = some.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("_n") <= k)
    return best.groupBy(*by).agg(F.sort_array(F.collect_list("_h")).alias(col))


def resemblance(a: str | Column, b: str | Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of two sketch columns."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, 1.0).otherwise(both / F.greatest(F.size(union), F.lit(1)))


def distinct_count(a: str | Column, k: int = K) -> Column:
    """Estimated number of distinct shingles behind a sketch: (k - 1) / the k-th smallest hash, scaled to (0, 1]."""
    a = F.col(a) if isinstance(a, str) else a
    kth = (F.element_at(a, k).cast("double") + F.lit(float(1 << 63)) + 1.0) / F.lit(float(1 << 64))
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / kth)


def containment(a: str | Column, b: str | Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: |A and B| / |A|, with |A and B| = J / (1 + J) (|A| + |B|)."""
    j, na, nb = resemblance(a, b, k), distinct_count(a, k), distinct_count(b, k)
    return F.when(na == 0, 1.0).otherwise(F.least(F.lit(1.0), j / (1 + j) * (na + nb) / na))


def encoded(s: np.ndarray) -> str:
    """A sketch as text: base64 of its hashes as little-endian unsigned 64-bit integers."""
    return base64.b64encode(s.astype("<u8").tobytes()).decode("ascii")


def with_next_document(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, extra, id, text) dealt so that a task holds runs of neighbouring documents in order.

    Buckets are ranges of the id with bounds taken as quantiles (four times as many as shuffle partitions); each
    bucket also gets, marked as extra, the first document of the next bucket (the last bucket that of the first), so
    texts are read and shuffled once. A document's bucket is found by binary search, not in the plan."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    number = F.coalesce(F.col(id_col).cast("double"), F.lit(float("-inf")))
    steps = [i / (4 * parts) for i in range(1, 4 * parts)]
    row = docs.agg(F.percentile_approx(id_col, steps, 10_000)).first()
    bounds = np.array(sorted(set(row[0] or [])), float)

    @F.pandas_udf("int")
    def bucket_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(float), "right"), dtype="int32")

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), number.alias("number"))
    firsts = sorted(docs.select(number.alias("number")).groupBy(bucket_of("number").alias("bucket")).agg(
        F.min("number").alias("first")).collect())  # one row per bucket
    first = np.array([r["first"] for r in firsts], float)
    before = np.array([firsts[i - 1]["bucket"] for i in range(len(firsts))], "int32")

    @F.pandas_udf("array<int>")
    def buckets_of(ids: pd.Series) -> pd.Series:
        """A document's bucket, and for the first of a bucket the one before."""
        ids = ids.to_numpy(float)
        mine = np.searchsorted(bounds, ids, "right").astype("int32")
        at = np.minimum(np.searchsorted(first, ids), max(len(first) - 1, 0))
        heads = first[at] == ids if len(first) else np.zeros(len(ids), bool)
        return pd.Series([[m, before[a]] if h else [m] for m, a, h in zip(mine, at, heads)])

    return (
        own.select("id", "text", F.posexplode(buckets_of("number")).alias("extra", "bucket"))
        .select("bucket", "extra", "id", "text")
        .repartition(parts, "bucket")
        .sortWithinPartitions("bucket", "extra", "id", "text")
    )


def fingerprint_edits(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """Fingerprints of each document and of its edited text, with their likeness and that to the next document, the
    estimated number of the document's shingles, and the estimated share of them that its edited text keeps.

    The edited text has the last floor(n / 2) code points replaced by the first as many of the next document."""
    dealt = with_next_document(docs)
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()), T.StructField("n_shingles_estimate", T.DoubleType()),
        T.StructField("kept_estimate", T.DoubleType()),
    ])

    def sketches(texts: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer(b"".join(texts), np.uint8)
        offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        return [sketch(s, k) for s in _text.shingle_sets(data, offs, width)]

    def finish(ids: list, texts: list[str], id_type: pa.DataType) -> pa.RecordBatch:
        """Of all but the last document, which is only a neighbour."""
        edited = []
        for t, after in zip(texts, texts[1:]):
            half = len(t) // 2
            edited.append((t[: len(t) - half] + after[:half]).encode("utf-8"))
        own, other = sketches([t.encode("utf-8") for t in texts]), sketches(edited)
        n = len(edited)
        return pa.RecordBatch.from_arrays([
            pa.array(ids[:n], id_type),
            pa.array([len(t) for t in texts[:n]], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
            pa.array([encoded(s) for s in own[:n]], pa.string()),
            pa.array([encoded(s) for s in other], pa.string()),
            pa.array([likeness(own[i], other[i], k) for i in range(n)], pa.float64()),
            pa.array([likeness(own[i], own[i + 1], k) for i in range(n)], pa.float64()),
            pa.array([size_estimate(s, k) for s in own[:n]], pa.float64()),
            pa.array([containment_estimate(own[i], other[i], k) for i in range(n)], pa.float64()),
        ], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, closed, ids, texts, size = None, False, [], [], 0
        for batch in batches:
            id_type = batch.column(2).type
            for b, extra, doc, t in zip(*(batch.column(i) for i in range(4))):
                b, extra, t = b.as_py(), extra.as_py(), t.as_py() or ""
                if b != bucket:
                    bucket, closed, ids, texts, size = b, False, [], [], 0
                if closed:
                    continue  # rows with the same id as the neighbour
                ids.append(doc.as_py())
                texts.append(t)
                size += len(t)
                closed = bool(extra)
                if len(texts) > 1 and (closed or size > 500_000):
                    yield finish(ids, texts, id_type)
                    ids, texts, size = ids[-1:], texts[-1:], len(t)

    return dealt.mapInArrow(run, schema)


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_fingerprints": op1_fingerprints}

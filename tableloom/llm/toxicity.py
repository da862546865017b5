"""Toxic passages by maximum-scoring segments, and documents' toxicity.

Learning. Words of labelled documents are counted by label. A word's log-odds of the toxic label comes from its
counts under a Dirichlet prior whose mean is the estimate of a broader unit: the word's first five characters, for
these the first four, for these the common rate. Log-odds that are less than ``Z`` (four) standard errors from zero
count as zero. A word's score is its signed log-odds, held within ``MOST``, less a drift, so that ordinary text scores
negative and words that speak against toxicity cost more than others.

Search. A linear-time scan (Ruzzo and Tompa) finds all maximal scoring segments of a document. With n words, a
segment of score S is expected E = K n exp(-L S) times by chance; L and K (the extreme-value parameters) are fitted
to the best segments of non-toxic documents. Segments with E < 1 are significant; the sum of their -ln E, put
through a logistic curve fitted to the labelled documents, is the document's score. Labelled documents are scored
without their own counts.

Labels of at most SAMPLE documents are used (those with the smallest hash of their id, a documented bound that
makes learning a fixed cost, and with it the model, which holds every unit of theirs); every document is scored, over
its whole text.

Defined cases: null and empty texts have no words and get the curve's value at zero; without labels of both
kinds the score is the share of toxic ones (0 without labels); a document with several labels is toxic if one is;
labels that are null are not used; where rows share an id, the text with the smallest hash is learnt from; repeated
rows are scored each, and equal texts get equal scores; an empty table gives
an empty result; long texts take time in proportion to their words; extra columns of any name are not read, and kept
columns may have any name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import staged

#: Labelled documents used at most for learning.
SAMPLE = 20_000
FOLDS = 5
DRIFT = 2.0
#: Standard errors that log-odds must be away from zero to count.
Z = 4.0
STRENGTH = 20.0
MOST = 6.0
_WORD = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def units_of(word: str) -> list[str]:
    """The word and the broader units that stand behind it."""
    out = [word]
    if len(word) > 5:
        out.append(word[:5] + "*")
    if len(word) > 4:
        out.append(word[:4] + "*")
    return out


def unit_hash(unit: str) -> int:
    """As Spark's ``xxhash64`` of a text."""
    h = xxhash.xxh64_intdigest(unit.encode("utf-8"), seed=42)
    return h - (1 << 64) if h >> 63 else h


class Model:
    """Counts of units by label, found by hash, and the fitted curve."""

    def __init__(self, units: np.ndarray, a: np.ndarray, b: np.ndarray, toxic: int, clean: int):
        order = np.argsort(units)
        self.units, self.a, self.b = units[order], a[order].astype(np.int32), b[order].astype(np.int32)
        self.toxic, self.clean = max(toxic, 1), max(clean, 1)
        self.base = math.log(self.toxic / self.clean)
        self.rate, self.scale = 1.0, 0.1
        self.slope, self.shift = 1.0, 0.0
        self.constant: float | None = None
        self._cache: dict[str, float] = _Scores(self)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_cache"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._cache = _Scores(self)

    def counts(self, unit: str) -> tuple[int, int]:
        h = unit_hash(unit)
        at = int(np.searchsorted(self.units, h))
        return (int(self.a[at]), int(self.b[at])) if at < len(self.units) and self.units[at] == h else (0, 0)

    def log_odds(self, word: str, without: Counter | None = None, toxic: bool = False) -> float:
        odds, common = 0.0, self.toxic / (self.toxic + self.clean)
        for unit in reversed(units_of(word)):
            a, b = self.counts(unit)
            if without:
                own = without[unit]
                a, b = (a - own, b) if toxic else (a, b - own)
            a, b = max(a, 0), max(b, 0)
            if a + b == 0:
                continue
            share = 1 / (1 + math.exp(-(odds + self.base)))
            f = (a + STRENGTH * share) / (a + b + STRENGTH)
            found = math.log(f / (1 - f)) - self.base
            error = math.sqrt(1 / (a + STRENGTH * common) + 1 / (b + STRENGTH * (1 - common)))
            odds = found if abs(found) >= Z * error else 0.0
        return odds

    def score(self, word: str, without: Counter | None = None, toxic: bool = False) -> float:
        """Signed: positive for words that speak for toxicity, the drift below zero for those that say nothing."""
        return max(-MOST, min(self.log_odds(word, without, toxic), MOST)) - DRIFT

    def scores(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self._cache.__getitem__, words), float, len(words))

    def passages(self, words: list[str]) -> list[tuple[int, int, float, float]]:
        """Significant passages: first word, word after the last, score, expected number by chance."""
        return self.significant(scored_segments(self.scores(words)), len(words))

    def significant(self, segs: list[tuple[int, int, float]], n: int) -> list[tuple[int, int, float, float]]:
        found = []
        for lo, hi, s in segs:
            e = self.scale * n * math.exp(-self.rate * s)
            if e < 1:
                found.append((lo, hi, s, e))
        return found

    def evidence(self, segs: list[tuple[int, int, float]], n: int) -> float:
        return sum(max(0.0, self.rate * s - math.log(self.scale * n)) for _, _, s in segs)

    def probability(self, segs: list[tuple[int, int, float]], n: int) -> float:
        if self.constant is not None:
            return self.constant
        x = self.evidence(segs, max(n, 1))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * x + self.shift))))


class _Scores(dict):
    """Scores of words, remembered; bounded."""

    def __init__(self, of: Model):
        super().__init__()
        self.of = of

    def __missing__(self, word: str) -> float:
        if len(self) > 500_000:
            self.clear()
        s = self.of.score(word)
        if len(word) < 40:
            self[word] = s
        return s


def _scan(at: list[int], before: list[float], after: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments in linear time, from the words that score above zero: their places, and the sums
    of all scores before and after them."""
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    for i, left, total in zip(at, before, after):
        cur = (i, i + 1, left, total)
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= cur[2]:
                j -= 1
            if j < 0 or found[j][3] >= cur[3]:
                found.append(cur)
                break
            cur = (found[j][0], cur[1], found[j][2], cur[3])
            del found[j:]
    return [(a, b, r - l) for a, b, l, r in found]


def scored_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """The maximal scoring segments of a sequence of scores: first place, place after the last, score."""
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    total = np.cumsum(scores)
    return _scan(at.tolist(), (total[at] - scores[at]).tolist(), total[at].tolist())


def segments(hits: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """The same where all words but some hits score ``-drift``."""
    at, before, after, total, last = [], [], [], 0.0, 0
    for i, s in hits:
        total -= drift * (i - last)
        at.append(i)
        before.append(total)
        total += s
        after.append(total)
        last = i + 1
    return _scan(at, before, after)


def _gumbel(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Rate and scale of E = K n exp(-L S) from the best scores of documents without toxic passages (many are 0,
    so the tail is fitted: of documents with a hit, the mean excess gives L, their share gives K)."""
    hit = best > 0
    if hit.sum() < 10:
        return 1.0, (float(hit.sum()) + 1) / max(float(n.sum()), 1.0)
    low = np.quantile(best[hit], 0.5)
    tail = best[best >= low]
    rate = 1 / max(float(np.mean(tail - low)), 0.2)
    scale = len(tail) * math.exp(rate * low) / max(float(n.sum()), 1.0)
    return min(max(rate, 0.2), 5.0), min(max(scale, 1e-6), 10.0)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps, with a weak prior that keeps them finite."""
    w = np.zeros(2)
    data = np.stack([x, np.ones(len(x))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(data @ w, -30, 30)))
        grad = data.T @ (y - p) - np.array([0.02, 0.02]) * w
        hess = (data * (p * (1 - p))[:, None]).T @ data + 0.02 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(w[0], 0.01)), float(w[1])


def held_out(doc_id) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model learned from the labelled documents that are not held out."""
    known = (
        labels.where(F.col("toxic").isNotNull() & ~held_out("doc_id"))
        .groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    )
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))  # SAMPLE labels
    # one row an id, however many rows of the table share it: what is gathered below is bounded by the sample
    one = F.min_by("text", F.struct(F.col("text").isNull(), F.xxhash64("text"), "text")).alias("text")
    rows = staged(rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), one).select("toxic", "text"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = [Counter(), Counter()]
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                both[int(toxic > 0)].update(set(tokens(text.as_py())))
            if len(both[0]) + len(both[1]) > 1_000_000:
                yield counted(both)
                both = [Counter(), Counter()]
        yield counted(both)

    def counted(both: list[Counter]) -> pa.RecordBatch:
        words = list(both[0].keys() | both[1].keys())
        return pa.RecordBatch.from_arrays([
            pa.array(words, pa.string()), pa.array([both[1][w] for w in words], pa.int64()),
            pa.array([both[0][w] for w in words], pa.int64())], ["word", "a", "b"])

    words = rows.mapInArrow(count, "word string, a bigint, b bigint")
    unit = F.array(F.col("word"), F.when(F.length("word") > 5, F.concat(F.substring("word", 1, 5), F.lit("*"))),
                   F.when(F.length("word") > 4, F.concat(F.substring("word", 1, 4), F.lit("*"))))
    units = (
        words.select(F.explode(F.array_compact(unit)).alias("unit"), "a", "b")
        .groupBy("unit").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    )
    total = words.agg(F.sum("a"), F.sum("b")).first()
    held = units.select(F.xxhash64("unit"), "a", "b").toArrow()  # of at most ``sample`` documents
    model = Model(*(held.column(i).to_numpy() for i in range(3)), total[0] or 0, total[1] or 0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rescore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = []
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                toxic = int(toxic > 0)
                words = tokens(text.as_py())
                kinds = set(words)
                own = Counter(u for w in kinds for u in units_of(w))
                memo = {w: m.score(w, own, bool(toxic)) for w in kinds}
                segs = scored_segments(np.fromiter(map(memo.__getitem__, words), float, len(words)))
                out.append((toxic, len(words), [s for _, _, s in segs]))
            yield pa.RecordBatch.from_arrays([
                pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int64()),
                pa.array([o[2] for o in out], pa.list_(pa.float64()))], ["toxic", "n", "scores"])

    seen = rows.mapInArrow(rescore, "toxic int, n bigint, scores array<double>").collect()  # at most ``sample`` rows
    y = np.array([r[0] for r in seen], float)
    if not len(y) or y.min() == y.max():
        model.constant = float(y.mean()) if len(y) else 0.0
        return model
    n = np.array([max(r[1], 1) for r in seen], float)
    best_of = np.array([max(r[2], default=0.0) for r in seen])
    model.rate, model.scale = _gumbel(best_of[y == 0], n[y == 0])
    x = np.array([model.evidence([(0, 0, s) for s in r[2]], max(r[1], 1)) for r in seen])
    model.slope, model.shift = _logistic(x, y)
    return model


def score_documents(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with score and the significant passages (first word, word after the last, score)."""
    schema = docs.select(*keep).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passage = T.StructType().add("first", "integer").add("after", "integer").add("score", "double")
    full = schema.add("score", "double").add("passages", T.ArrayType(passage))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        kind = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            scores, found = [], []
            for text in batch.column(batch.num_columns - 1):
                words = tokens(text.as_py())
                segs = scored_segments(m.scores(words))
                scores.append(m.probability(segs, len(words)))
                found.append([{"first": a, "after": b, "score": s} for a, b, s, _ in m.significant(segs, len(words))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keep))] + [pa.array(scores, pa.float64()), pa.array(found, kind)],
                names)

    names = [*[f"kept_{i}" for i in range(len(keep))], *full.names[len(keep):]]
    typed = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, full.fields)])
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(text_col).alias("_text_"))
    return rows.mapInArrow(run, typed).toDF(*full.names)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, model, ["doc_id"]).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


QUERIES = {"op6_toxicity": op6_toxicity}

"""Log-probabilities of texts under a smoothed n-gram model of the corpus, by a weighted backoff automaton.

A model of the whole corpus fits no machine, and is not cut down to fit: tasks get just the part that their texts meet.

1. Texts are put together in blocks of some megabytes, a compressed row each.
2. Each block sends its distinct n-grams of all orders, as sorted 61-bit hashes with their counts in learning texts, in
   slices of the hashes' range. A slice adds up the counts of all blocks and answers each of them in the order it was
   asked in, a count an n-gram.
3. A block and its answers meet, and the block's automaton is built: a state for each context that was learnt, an arc
   for each learnt n-gram from its context's state, and a failure arc from each state to that of the context without its
   first word. All documents of a block go from left to right at the same time, each with its own state, long ones in
   several pieces: a word without an arc takes the failure arc and its weight, until a state has one; the empty state has
   one for every word.

Both shuffles grow with the corpus, tasks do not: a block has a bounded size, and there are as many slices as blocks. A
very common n-gram is asked for once a block.

The model: words, then one end. The order-1 probability of a word is (c + 1) / (N + V + 1), as in the base score. A
longer n-gram has (c + m p) / (C + m), where c and C count it and its context, p is the probability without the context's
first word, and m is a prior mass (hierarchical Dirichlet smoothing); so a failure arc weighs m / (C + m), and every
context's probabilities add up to one over the known words and one unknown. A text's first context is its begin.

Defined cases: a null text is empty, and has its end as its only token; a null id learns (the query); repeated rows are
separate documents, and what they say counts as often; without learning texts every token has probability one, as the
only unknown; ties do not occur, as nothing is ranked; an empty table gives an empty result; a text longer than a block
has a block of its own; extra columns, of any name, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import mark, release, staged
from ._text import _STEP, blocks, mix, raw, word_hashes, words

#: Length of the longest n-grams of the query, and the prior mass m. The mass was chosen on held-out texts of sf0.1.
ORDER, MASS = 2, 400.0
#: Bytes of text in a block, and tokens that a text goes in one piece: a longer one's pieces run side by side.
BLOCK, PIECE = 6 << 20, 256
_BEGIN, _END = np.uint64(0xB5297A4D3F84D5A1), np.uint64(0x68E31DA4C2B1F0E7)
_CODE = 7  # the low bits of a hash tell its order; 0 is the begin


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, a place of each, and of each value its number among them."""
    by = np.argsort(values)
    ordered = values[by]
    new = np.ones(len(by), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    ids = np.empty(len(by), np.int64)
    ids[by] = np.cumsum(new) - 1
    return ordered[new], by[new], ids


class Grams:
    """The n-grams of a block. Tokens of all texts stand in a row, each text with a begin before and an end after;
    ``texts`` are the positions of the begins. ``ids[k]`` has the number of the n-gram of length k + 1 that ends at
    each position, -1 where there is none, and ``keys[k]`` those n-grams' hashes in order."""

    def __init__(self, texts: pa.Array, order: int):
        data, offs = raw(texts)
        b, starts, ends, at = words(data, offs, lower=True)
        n = np.diff(at)
        self.lengths = n + 1  # tokens with the end
        self.texts = np.concatenate(([0], np.cumsum(n + 2)[:-1])) if len(n) else np.zeros(0, np.int64)
        total = int((n + 2).sum())
        token = np.empty(total, np.uint64)
        inner = np.ones(total, bool)
        inner[self.texts] = inner[self.texts + n + 1] = False
        token[self.texts], token[self.texts + n + 1] = _BEGIN, _END
        token[inner] = word_hashes(b, starts, ends)
        place = np.arange(total) - np.repeat(self.texts, n + 2)
        self.doc = np.repeat(np.arange(len(n)), n + 2)
        self.keys, self.ids, self.first = [], [], []
        for k in range(order):
            spots = np.flatnonzero(place >= k)
            h = token[spots] * _STEP[k]
            for j in range(1, k + 1):
                h = h + token[spots - j] * _STEP[k - j]
            h = (mix(h) & ~np.uint64(_CODE)) | np.uint64(k + 1)
            if k == 0:
                h[self.texts] &= ~np.uint64(_CODE)
            keys, first, ids = _distinct(h)
            here = np.full(total, -1, np.int64)
            here[spots] = ids
            self.keys.append(keys)
            self.ids.append(here)
            self.first.append(spots[first])

    def asked(self) -> np.ndarray:
        """All hashes in order: what the block asks for."""
        return np.sort(np.concatenate(self.keys))

    def counts(self, learn: np.ndarray) -> np.ndarray:
        """How often each of ``asked`` occurs in texts that are learnt from."""
        every = [np.bincount(i[i >= 0], learn[self.doc[i >= 0]].astype(float), len(k)).astype(np.int64)
                 for k, i in zip(self.keys, self.ids)]
        return np.concatenate(every)[np.argsort(np.concatenate(self.keys))]


def _planes(values: np.ndarray) -> bytes:
    """Bytes of numbers, first bytes first: runs of zeros, which compress well."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _values(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def to_blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """From (key, learn, text) to (blob): rows of up to ``size`` bytes of text in one compressed row."""
    held: list[pa.RecordBatch] = []
    used = 0

    def block() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for part in held:
                out.write_batch(part)
        return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["blob"])

    for batch in batches:
        _, offs = raw(batch.column(2))
        for i, j in blocks(*raw(batch.column(2)), size):
            n = int(offs[j] - offs[i])
            if held and used + n > size:
                yield block()
                held, used = [], 0
            held.append(pa.RecordBatch.from_arrays([c.take(pa.array(range(i, j))) for c in batch.columns], batch.schema.names))
            used += n
    if held:
        yield block()


def _opened(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def _text_of(table: pa.Table) -> pa.Array:
    return pa.concat_arrays([c.cast(pa.large_string()) for c in table.column("text").chunks])


def asking(order: int, slices: int):
    """From (block, blob) to (slice, block, keys, counts)."""
    bounds = (np.arange(1, slices, dtype=object) * (1 << 64) // slices).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(*batch.columns):
                table = _opened(blob.as_py())
                grams = Grams(_text_of(table), order)
                keys, counts = grams.asked(), grams.counts(table.column("learn").to_numpy())
                cuts = np.concatenate(([0], np.searchsorted(keys, bounds), [len(keys)]))
                for s in np.flatnonzero(np.diff(cuts)):
                    k, c = keys[cuts[s]: cuts[s + 1]], counts[cuts[s]: cuts[s + 1]]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([s], pa.int64()), pa.array([block.as_py()], pa.int64()),
                        pa.array([_planes(np.diff(k, prepend=np.uint64(0)))], pa.binary()),
                        pa.array([_planes(c.astype(np.uint64))], pa.binary())], ["slice", "block", "keys", "counts"])

    return run


def _answers(number: int, asked: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    keys = [np.cumsum(_values(k, np.uint64), dtype=np.uint64) for _, k, _ in asked]
    every, _, at = _distinct(np.concatenate(keys))
    totals = np.zeros(len(every), np.uint64)
    np.add.at(totals, at, np.concatenate([_values(c, np.uint64) for _, _, c in asked]))
    single = (every & np.uint64(_CODE)) == 1
    cuts = np.cumsum([0] + [len(k) for k in keys])
    found = [_planes(totals[at[cuts[i]: cuts[i + 1]]]) for i in range(len(keys))]
    n, v = int(totals[single].sum()), int((totals[single] > 0).sum())
    rows = len(asked)
    return pa.RecordBatch.from_arrays([
        pa.array([number] * rows, pa.int64()), pa.array([b for b, _, _ in asked], pa.int64()), pa.array(found, pa.binary()),
        pa.array([n] + [0] * (rows - 1), pa.int64()), pa.array([v] + [0] * (rows - 1), pa.int64())],
        ["slice", "block", "counts", "n", "v"])


def answering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of slice to (slice, block, counts) and the slice's sums over single words, in its first row."""
    held: list[tuple[int, bytes, bytes]] = []
    now = None
    for batch in batches:
        for row in zip(*batch.columns):
            number, block, keys, counts = (x.as_py() for x in row)
            if number != now and held:
                yield _answers(now, held)
                held = []
            now = number
            held.append((block, keys, counts))
    if held:
        yield _answers(now, held)


class Automaton:
    """The states, arcs and failure arcs of a block's n-grams, of which ``counts`` tells how often they were learnt."""

    def __init__(self, grams: Grams, counts: np.ndarray, n: int, v: int, mass: float):
        keys, order = grams.asked(), len(grams.keys)
        self.order = order
        learnt = [counts[np.searchsorted(keys, k)] for k in grams.keys]
        self.known = learnt[0] > 0
        p = (learnt[0] + 1) / (n + v + 1)
        self.word = np.log10(p)
        # states: the empty one, then learnt n-grams shorter than the longest
        state, made = [], 1
        for k in range(order - 1):
            ids = np.zeros(len(learnt[k]), np.int64)
            have = np.flatnonzero(learnt[k] > 0)
            ids[have] = made + np.arange(len(have))
            made += len(have)
            state.append(ids)
        width = len(learnt[0])
        self.width = width
        self.fail, self.fail_weight = np.zeros(made, np.int64), np.zeros(made)
        arcs = [(np.arange(width), self.word, state[0] if order > 1 else np.zeros(width, np.int64))]
        for k in range(1, order):
            at = grams.first[k]
            context, rest, word = grams.ids[k - 1][at - 1], grams.ids[k - 1][at], grams.ids[0][at]
            total = learnt[k - 1][context]
            p = np.where(total > 0, (learnt[k] + mass * p[rest]) / (total + mass), p[rest])
            seen = learnt[k] > 0
            after = state[k] if k < order - 1 else state[k - 1][rest]
            arcs.append((state[k - 1][context[seen]] * width + word[seen], np.log10(p[seen]), after[seen]))
            have = np.flatnonzero(learnt[k - 1] > 0)
            self.fail_weight[state[k - 1][have]] = np.log10(mass / (learnt[k - 1][have] + mass))
            if k > 1:  # states of one word fail to the empty one
                self.fail[state[k - 1][have]] = state[k - 2][grams.ids[k - 2][grams.first[k - 1][have]]]
        labels = np.concatenate([a[0] for a in arcs])
        by = np.argsort(labels, kind="stable")
        self.labels = labels[by]
        self.weight, self.next = np.concatenate([a[1] for a in arcs])[by], np.concatenate([a[2] for a in arcs])[by]
        self.begin = state[0] if order > 1 else np.zeros(width, np.int64)

    def step(self, at: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a word each, and what the ways there weigh."""
        at, after, weight = at.copy(), np.empty(len(at), np.int64), np.zeros(len(at))
        left = np.arange(len(at))
        while len(left):
            label = at[left] * self.width + word[left]
            arc = np.minimum(np.searchsorted(self.labels, label), len(self.labels) - 1)
            hit = self.labels[arc] == label
            done, arc = left[hit], arc[hit]
            weight[done] += self.weight[arc]
            after[done] = self.next[arc]
            left = left[~hit]
            weight[left] += self.fail_weight[at[left]]
            at[left] = self.fail[at[left]]
        return after, weight

    def scores(self, grams: Grams, piece: int = PIECE) -> np.ndarray:
        """Of each text the sum of what its way through the automaton weighs. One step takes every piece a token
        further; a piece inside a text begins in the state to which the words before lead, as no state remembers more
        of them than the longest context has."""
        piece = max(piece, self.order)
        n = -(-grams.lengths // piece)
        text = np.repeat(np.arange(len(n)), n)
        number = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        lengths = np.minimum(piece, grams.lengths[text] - number * piece)
        by = np.argsort(-lengths, kind="stable")
        text, number, lengths = text[by], number[by], lengths[by]
        first = grams.texts[text] + number * piece  # the token before a piece
        tokens = grams.ids[0]
        at = np.zeros(len(by), np.int64)
        at[number == 0] = self.begin[tokens[first[number == 0]]]
        inner = np.flatnonzero(number)
        for back in range(self.order - 2, -1, -1):
            at[inner] = self.step(at[inner], tokens[first[inner] - back])[0]
        total = np.zeros(len(by))
        going = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(by) else 0) + 1), "right")
        for step, n in enumerate(going, 1):
            at[:n], weight = self.step(at[:n], tokens[first[:n] + step])
            total[:n] += weight
        return np.bincount(text, total, len(grams.texts))


def _scored(blob: bytes, answers: list[bytes], order: int, mass: float, n: int, v: int) -> pa.RecordBatch:
    table = _opened(blob)
    grams = Grams(_text_of(table), order)
    counts = np.concatenate([_values(a, np.uint64) for a in answers]).astype(np.int64)
    automaton = Automaton(grams, counts, n, v, mass)
    token = np.ones(len(grams.doc), bool)
    token[grams.texts] = False
    doc, word, rows = grams.doc[token], grams.ids[0][token], len(grams.texts)
    known = np.bincount(doc, automaton.known[word].astype(float), rows).astype(np.int64)
    base = np.bincount(doc, automaton.word[word], rows)
    key, learn = (pa.concat_arrays(table.column(c).chunks) for c in ("key", "learn"))
    return pa.RecordBatch.from_arrays([
        key, learn, pa.array(grams.lengths), pa.array(known), pa.array(np.full(rows, n)), pa.array(base),
        pa.array(automaton.scores(grams))], ["key", "learn", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def scoring(order: int, mass: float, n: int, v: int):
    """From rows in order of (block, slice), the block's own first, to a row for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob, answers = None, []
        for batch in batches:
            for slice_, value in zip(batch.column(1), batch.column(2)):
                if slice_.as_py() < 0:
                    if blob is not None:
                        yield _scored(blob, answers, order, mass, n, v)
                    blob, answers = value.as_py(), []
                else:
                    answers.append(value.as_py())
        if blob is not None:
            yield _scored(blob, answers, order, mass, n, v)

    return run


def score_texts(docs: DataFrame, learn: Column, key: str = "doc_id", order: int = ORDER, mass: float = MASS,
                size: int = BLOCK) -> DataFrame:
    """(key, learn, n_tokens, n_known, train_tokens, base_score, score) for every row; ``learn`` tells which rows the
    model learns from."""
    if not 1 <= order <= 6:
        raise ValueError("order is 1 to 6")
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.coalesce(learn, F.lit(True)).alias("learn"), F.coalesce("text", F.lit("")).alias("text"))
    cut = rows.mapInArrow(lambda batches: to_blocks(batches, size), "blob binary")
    own = staged(cut.select(F.monotonically_increasing_id().alias("block"), "blob"), "blocks")
    n_blocks = max(1, own.count())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_blocks)
    asked = own.mapInArrow(asking(order, n_blocks), "slice bigint, block bigint, keys binary, counts binary")
    answers = staged(asked.repartition(parts, "slice").sortWithinPartitions("slice").mapInArrow(
        answering, "slice bigint, block bigint, counts binary, n bigint, v bigint"), "answers")
    n, v = answers.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    both = own.select("block", F.lit(-1).cast("bigint").alias("slice"), F.col("blob").alias("value")).unionByName(
        answers.select("block", "slice", F.col("counts").alias("value")))
    kind = T.StructType([
        T.StructField("key", docs.schema[key].dataType), T.StructField("learn", T.BooleanType()),
        *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")],
        *[T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]])
    found = both.repartition(parts, "block").sortWithinPartitions("block", "slice").mapInArrow(scoring(order, mass, n, v), kind)
    return found.withColumnRenamed("key", key)


def op13_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    start = mark()
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    found = score_texts(docs, ~held_out)
    out = staged(found.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                              "base_score", "score"), "scores")
    release(spark, start, mark() - 1)
    return out


QUERIES = {"op13_lm_scoring": op13_lm_scoring}

"""Quality rules of documents and of the hosts they come from.

Base rules look at one document: too few words, or too many words inside repeated 8-word windows. Host rules
aggregate the failures of each rule (the base rules, and too many symbols for the words) by host: the domain of a
URL, else the source as it stands. A host's failure rate by a rule is shrunk towards the rate of all hosts with a beta
prior fitted to the hosts by moments; a host that stands out of the prior of one rule is rejected, with all its
documents. A host with few documents stays near the common rate. Where the hosts' rates spread no more than chance (and
a prior of STRONGEST documents) explains, no spread can be fitted, and only rates beyond LEAST_RATE stand out.

Defined cases: a null or empty text has no words and fails; a null host is a host of its own; repeated rows count
each; an empty table gives an empty result; texts of any length are measured whole; hosts with equal rates (ties) get
equal verdicts; extra columns of any name stay as they are in ``keep_good_documents`` and are not read by the query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text
from ._shared import packed, staged, unpacked

MIN_WORDS = 20
WINDOW = 8
MOST_REPEATED_PERCENT = 30
#: Share of failing documents, after shrinking, beyond which a whole host goes in any case.
WORST_RATE = 0.8
#: Where hosts show no spread of their own, a host whose rate does not exceed this is not rejected.
LEAST_RATE = 0.5
#: The most documents that a prior counts as.
STRONGEST = 1000.0
MOST_SYMBOLS_PERCENT = 50
#: Texts that a task measures at once: rows, and bytes (one text at least).
ROWS, BLOCK = 512, 1 << 17
#: Hosts that are broadcast at most, and the bytes of their names; more are joined by shuffle.
BROADCAST_HOSTS, BROADCAST_BYTES = 20_000, 4_000_000

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeated(w: np.ndarray, words: int, width: int) -> int:
    """Words inside windows (given by hash, in order) that occur twice or more."""
    order = np.argsort(w, kind="stable")
    s = w[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    dup = np.zeros(len(w), bool)
    dup[order[1:][same]] = True
    dup[order[:-1][same]] = True
    cover = np.zeros(words + 1, np.int64)
    at = np.flatnonzero(dup)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def _duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def measured_batches(batches: Iterator[pa.RecordBatch], names: list[str], keep: int, at_text: int,
                     inner: str = "") -> Iterator[pa.RecordBatch]:
    """The first ``keep`` columns of batches with the measures of the texts in column ``at_text`` (or in its field
    ``inner``). Few texts are looked at at once, and what a batch took goes back before the next one comes."""
    for batch in batches:
        texts = batch.column(at_text).field(inner) if inner else batch.column(at_text)
        for at_row in range(0, batch.num_rows, ROWS):
            data, offs = _text.raw(texts.slice(at_row, ROWS))
            for lo, hi in _text.blocks(data, offs, BLOCK):
                o = offs[lo : hi + 1]
                b, starts, ends, at = _text.words(data, o)
                hashes = _text.word_hashes(b, starts, ends)
                wins = _text.windows(hashes, WINDOW)
                heads = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])  # code points before a byte
                chars = np.concatenate([[0], np.cumsum(heads[ends] - heads[starts])])
                signs = np.concatenate([[0], np.cumsum(_SYMBOL[b])])
                local = o - o[0]
                n = np.diff(at)
                dup_lines, repeats = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
                whole = b.tobytes()
                for i in range(hi - lo):
                    dup_lines[i] = _duplicate_lines(whole[local[i] : local[i + 1]])
                    if n[i] > WINDOW:
                        repeats[i] = _repeated(wins[at[i] : at[i + 1] - WINDOW + 1], int(n[i]), WINDOW)
                found = [n, np.diff(chars[at]), np.diff(signs[local]), dup_lines, repeats]
                rows = batch.slice(at_row + lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(i) for i in range(keep)] + [pa.array(x, pa.int64()) for x in found],
                    names,
                )
        batch = texts = rows = data = b = None
        pa.default_memory_pool().release_unused()


def document_measures(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` with the measures of each whole text. ``text_col`` may name a field of a kept
    struct (``row.text``), so that the text travels once."""
    schema = docs.select(*keep).schema
    for name in _MEASURES:
        schema = schema.add(name, "long")
    outer, _, inner = text_col.partition(".")
    at_text = keep.index(outer) if inner else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return measured_batches(batches, schema.names, len(keep), at_text, inner)

    return docs.select(*keep, *([] if inner else [F.col(text_col).alias("_text_")])).mapInArrow(run, schema)


#: Rules whose failures are counted by host; the first two also fail the document itself.
RULES = ("short", "repeated", "symbols")


def rule_failures() -> dict[str, Column]:
    """Each rule's failure of one document, from its measures."""
    return {
        "short": F.col("n_words") < MIN_WORDS,
        "repeated": 100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > MOST_SYMBOLS_PERCENT * F.col("n_words"),
    }


def base_failed() -> Column:
    failed = rule_failures()
    return failed["short"] | failed["repeated"]


def domain(source: str | Column) -> Column:
    """The domain of a URL (host name in lower case, without ``www.`` and port); anything else as it stands."""
    source = F.col(source) if isinstance(source, str) else source
    host = F.lower(F.regexp_extract(source, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host == "", source).otherwise(F.regexp_replace(host, r"^www\.", ""))


def host_verdicts(failures: DataFrame, worst_rate: float = WORST_RATE, least_rate: float = LEAST_RATE) -> DataFrame:
    """Per host: its documents, and for each rule the failures, the shrunk rate and whether that rejects the host.

    ``failures`` has host, n and a count of failures by rule, in as many rows a host as one likes. A rule's prior
    Beta(a, b) has the mean m of the hosts' rates and the variance v that is left of theirs after the sampling noise is
    taken away: a + b = m (1 - m) / v - 1, held within [1, STRONGEST]. A host is rejected by a rule if its shrunk rate
    exceeds the limit m + 3 standard deviations of the prior, or ``worst_rate`` in any case; only where the hosts give no
    spread (a + b is at STRONGEST) the limit is ``least_rate`` at least."""
    hosts = failures.groupBy("host").agg(F.sum("n").alias("n"), *[F.sum(r).alias(r) for r in RULES])
    hosts = staged(hosts, "hosts")
    asked = []
    for r in RULES:
        rate = F.col(r) / F.col("n")
        asked += [F.avg(rate).alias(f"m_{r}"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias(f"v_{r}"),
                  F.avg(rate * (1 - rate) / F.col("n")).alias(f"noise_{r}")]
    seen = hosts.agg(*asked).first()  # one row
    out = [F.col("host"), F.col("n")]
    rejected = F.lit(False)
    for r in RULES:
        m, v = seen[f"m_{r}"] or 0.0, max((seen[f"v_{r}"] or 0.0) - (seen[f"noise_{r}"] or 0.0), 0.0)
        strength = min(max(m * (1 - m) / v - 1, 1.0), STRONGEST) if v > 0 else STRONGEST
        limit = m + 3 * math.sqrt(m * (1 - m) / (strength + 1))
        limit = min(worst_rate, limit if strength < STRONGEST else max(least_rate, limit))
        shrunk = (F.col(r) + F.lit(m * strength)) / (F.col("n") + F.lit(strength))
        rejected = rejected | (shrunk > F.lit(limit))
        out += [F.col(r).alias(f"failed_{r}"), shrunk.alias(f"rate_{r}"), F.lit(limit).alias(f"limit_{r}")]
    return hosts.select(*out, rejected.alias("host_rejected"))


def counted_failures(measured: DataFrame, host: Column) -> DataFrame:
    """Failures by host of measured documents, summed in each task before they are shuffled."""
    failed = rule_failures()
    return measured.groupBy(host.alias("host")).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(failed[r]).alias(r) for r in RULES])


def _small(hosts: DataFrame) -> DataFrame:
    """Marked for broadcast if the hosts are few and their names short."""
    n, size = hosts.limit(BROADCAST_HOSTS + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("host_")), F.lit(0))).first()
    return F.broadcast(hosts) if n <= BROADCAST_HOSTS and size <= BROADCAST_BYTES else hosts


def judge_documents(docs: DataFrame, host_col: str = "source", worst_rate: float = WORST_RATE) -> DataFrame:
    """(doc_id, host_col, measures, host_rejected, base_failed, kept) of each document; the text is read once."""
    measured = staged(document_measures(docs, ["doc_id", host_col]), "measures")
    host = domain(F.col(f"`{host_col}`"))
    hosts = host_verdicts(counted_failures(measured, host), worst_rate).select(
        F.col("host").alias("host_"), "host_rejected")
    judged = measured.join(_small(hosts), host.eqNullSafe(F.col("host_")), "left").drop("host_")
    return judged.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def keep_good_documents(docs: DataFrame, host_col: str = "source", worst_rate: float = WORST_RATE) -> DataFrame:
    """The documents that the rules keep, with the columns of ``docs``, whatever their names.

    Texts are measured once for the hosts' counts and once for the documents, so that no copy of the table is kept in
    between; each time a text goes to Python once."""
    host = domain(host_col).alias("host")
    counted = document_measures(docs.select(host, "text"), ["host"])
    bad = staged(host_verdicts(counted_failures(counted, F.col("host")), worst_rate).where("host_rejected").select(
        F.col("host").alias("host_")), "bad-hosts")
    rows = packed(docs, host=domain(host_col))
    kept = document_measures(rows, ["row", "host"], "row.text").where(~base_failed()).select("row", "host")
    if not bad.isEmpty():
        kept = kept.join(_small(bad), F.expr("host <=> host_"), "left_anti")
    return unpacked(kept, docs.columns)


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge_documents(docs).select("doc_id", *_MEASURES, "base_failed", "kept", "host_rejected")


_SQL_RULES = {"short": "n_words < 20", "repeated": "100 * n_repeat_words > 30 * n_words",
              "symbols": "100 * n_symbols > 50 * n_words"}
_SQL_HOSTS = ", ".join(f"count(*) FILTER ({c}) AS {r}" for r, c in _SQL_RULES.items())
_SQL_MOMENTS = ", ".join(
    f"avg({r} / n) AS m_{r}, greatest(var_pop({r} / n) - avg({r} / n * (1 - {r} / n) / n), 0) AS v_{r}" for r in _SQL_RULES)
_SQL_PRIORS = ", ".join(
    f"greatest(1.0, least(1000.0, coalesce(m_{r} * (1 - m_{r}) / nullif(v_{r}, 0) - 1, 1000.0))) AS s_{r}" for r in _SQL_RULES)
_SQL_REJECTED = " OR ".join(
    f"({r} + m_{r} * s_{r}) / (n + s_{r}) > least(0.8, greatest(CASE WHEN s_{r} < 1000 THEN 0 ELSE 0.5 END, "
    f"m_{r} + 3 * sqrt(m_{r} * (1 - m_{r}) / (s_{r} + 1))))"
    for r in _SQL_RULES)

QUERIES = {"op5_quality_rules": op5_quality_rules}
ORACLE = {
    "op5_quality_rules": r"""
WITH texts AS (SELECT doc_id, CASE WHEN regexp_matches(source, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]+') THEN
                 regexp_replace(lower(regexp_extract(source, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', '')
                 ELSE source END AS host, coalesce(text, '') AS text,
                      coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
dup_lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (
                SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts)
              WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
wins AS (SELECT doc_id, i, w[i:i + 7] AS win FROM (
           SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM texts WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins) WHERE n > 1),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(8) t(k) GROUP BY 1),
base AS (SELECT t.doc_id, t.host, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                coalesce(d.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
         FROM texts t LEFT JOIN dup_lines d ON d.doc_id = t.doc_id LEFT JOIN cover c ON c.doc_id = t.doc_id),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base),
"""
    + f"""hosts AS (SELECT host, count(*) AS n, {_SQL_HOSTS} FROM judged GROUP BY 1),
moments AS (SELECT {_SQL_MOMENTS} FROM hosts),
priors AS (SELECT *, {_SQL_PRIORS} FROM moments),
verdicts AS (SELECT host, {_SQL_REJECTED} AS host_rejected FROM hosts, priors)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT host_rejected AS kept, host_rejected
FROM judged j JOIN verdicts v ON j.host IS NOT DISTINCT FROM v.host"""
}

r"""Lines that recur across documents, found with a log-template tree and dropped.

A line is parsed as a log line is: its words, with every word that holds a digit generalised to ``<*>``, lead
through a tree of fixed depth, first by the number of words, then by the first three of them. At the leaf the
rest of the line is cut into three stretches. The line's templates are the whole line, and, for lines of
``variable_from`` words or more, the line with one of the three stretches generalised as a variable field.
Words with digits are generalised only where ``min_literal`` words and half of the template's words stay literal:
rows of numbers would all be one template. A line short of that is compared as it stands. A template recurs if it
occurs in ``min_docs`` documents. In each recurring template the first line (smallest document id, then place) stays
and the others are dropped, so a line goes if one of its templates recurs and has an earlier line. Templates are
compared as 64-bit hashes of their parts; only hashes and places are shuffled, and texts only once, to meet the
places of their dropped lines.

All of it is built of DataFrame functions.

Defined cases: a null text stays null and an empty one empty; lines of fewer than ``min_words`` words always stay;
a line repeated only within its document stays; rows that share id and text are one document, rows that share only
the id are several; rows with a null id are several documents ordered first; of lines that tie (equal rows of one
id) the first place stays; an empty table gives an empty result; long texts cost time in proportion to their lines;
other columns of any name stay as they are, and a column named ``n_lines`` or ``n_dropped`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import mark, packed, release, staged, unpacked

DEPTH = 3
MIN_WORDS = 3
MIN_DOCS = 2
#: A template with generalised words has so many literal words at least, and half of its words are literal.
MIN_LITERAL = 3
#: Words from which a template may have a variable field: with 5, a stretch is one word and four stay.
VARIABLE_FROM = 5
#: Per cent of equal words in place that make two lines of a leaf alike.
SIMILAR = 70
#: Forms that share a piece are compared one by one up to this number; beyond it the piece is split further.
FEW = 16

_SPACES = r"[\x20\x09-\x0D]+"


def _tells(min_literal: int, *parts):
    """Whether enough words of a template are literal."""
    numbers = sum((F.size(F.filter(p, lambda w: w == "<*>")) for p in parts), F.lit(0))
    size = sum((F.size(p) for p in parts), F.lit(0))
    return ~F.col("digits") | ((size - numbers >= min_literal) & (2 * numbers <= size))


def masked_lines(docs: DataFrame, min_words: int = MIN_WORDS, min_literal: int = MIN_LITERAL) -> DataFrame:
    """(doc, fp, pos, n, w, digits, told): for each line that counts its document, place and words, generalised if told."""
    lines = docs.select(
        F.col("doc_id").alias("doc"), F.xxhash64("text").alias("fp"), F.posexplode(F.split("text", "\n", -1))
    )
    words = F.filter(F.split("col", _SPACES, -1), lambda w: w != "")
    digits, number = F.col("col").rlike("[0-9]"), lambda w: w.rlike("[0-9]")
    masked = F.when(digits, F.transform("words", lambda w: F.when(number(w), "<*>").otherwise(w))).otherwise(
        F.col("words"))
    return (
        lines.withColumn("words", words)
        .withColumn("n", F.size("words"))
        .where(F.col("n") >= min_words)
        .withColumn("w", masked)
        .withColumn("digits", digits)
        .withColumn("told", _tells(min_literal, F.col("w")))
        .withColumn("w", F.when(F.col("told"), F.col("w")).otherwise(F.col("words")))
        .select("doc", "fp", "pos", "n", "w", "digits", "told")
    )


def template_keys(docs: DataFrame, min_words: int = MIN_WORDS, variable_from: int = VARIABLE_FROM,
                  depth: int = DEPTH, min_literal: int = MIN_LITERAL) -> DataFrame:
    """(doc, fp, pos, keys): for each line that counts, its document, place and the hashes of its templates."""
    n, rest = F.col("n"), F.lit(depth)
    first = F.floor((n - rest) / 3).cast("int")
    second = F.floor((n - rest) * 2 / 3).cast("int")

    def part(lo, hi):
        return F.slice("w", lo + rest + 1, hi - lo)

    zero = F.lit(0)
    a, b, c = part(zero, first), part(first, second), part(second, n - rest)
    lead = F.slice("w", 1, depth)
    whole = F.xxhash64(F.lit(0), n, F.col("w"))
    loose = [F.when(_tells(min_literal, lead, x, y), F.xxhash64(F.lit(k), n, lead, x, y))
             for k, x, y in ((1, b, c), (2, a, c), (3, a, b))]
    return masked_lines(docs, min_words, min_literal).select(
        "doc", "fp", "pos", F.when(F.col("told") & (n >= variable_from), F.array_compact(F.array(whole, *loose)))
        .otherwise(F.array(whole)).alias("keys"))


def _piece():
    """Bounds of the i-th of d + 1 pieces of the open words."""
    return [F.floor((F.col("i") + k) * F.size("open") / (F.col("d") + 1)).cast("int") for k in (0, 1)]


def similar_lines(docs: DataFrame, share: int = SIMILAR, min_words: int = MIN_WORDS, depth: int = DEPTH,
                  min_literal: int = MIN_LITERAL, few: int = FEW) -> DataFrame:
    """(doc, fp, pos): lines with an earlier line in another document, of the same word count and leading words and
    with ``share`` per cent of equal words in place.

    Lines that differ in at most d words share one of d + 1 pieces, so pieces find every such pair. A form (the lines
    of equal words) meets the first form of each of its pieces. Where that tells nothing, a piece of up to ``few`` forms
    is compared form by form; in a piece of more, the words beside it are cut into d + 1 pieces again, of which like
    forms share one, and so on until a piece has few forms or so few words are open that all its forms are alike. No
    piece is compared all with all and no pair is lost."""
    n = F.col("n")
    lines = masked_lines(docs, min_words, min_literal).where("told").withColumn("d", n - F.ceil(n * share / 100).cast("int"))
    lines = lines.where("d > 0").select(
        "doc", "fp", "pos", "n", "d", F.xxhash64("n", F.slice("w", 1, depth)).alias("leaf"),
        F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    own = F.struct("doc", "fp")
    leaves = staged(lines.groupBy("leaf").agg(F.min(own).alias("a"), F.max(own).alias("b")).where(
        "NOT (a.doc <=> b.doc AND a.fp = b.fp)").select("leaf"), "leaves")
    lines = staged(lines.join(leaves, "leaf").withColumn("id", F.xxhash64("leaf", "h")), "leaf-lines")
    forms = staged(lines.groupBy("id").agg(
        F.first("leaf").alias("leaf"), F.first("n").alias("n"), F.first("d").alias("d"), F.first("h").alias("h"),
        F.min(F.struct("doc", "fp", "pos")).alias("at")), "forms")

    def like(pairs: DataFrame, forms: DataFrame) -> DataFrame:
        """The ids whose form is like an earlier one of the pairs."""
        pairs = pairs.where("e.at < at AND NOT (e.at.doc <=> at.doc AND e.at.fp = at.fp)")
        pairs = pairs.select("id", F.col("e.id").alias("other")).distinct()
        others = forms.select(F.col("id").alias("other"), F.col("h").alias("g"))
        equal = F.size(F.filter(F.zip_with("h", "g", lambda x, y: x == y), lambda x: x))
        return pairs.join(forms.select("id", "h", "n", "d"), "id").join(others, "other").where(
            equal >= n - F.col("d")).select("id").distinct()

    def cut(rows: DataFrame) -> DataFrame:
        """(up, key, id, at, i): each row of (key, id, at, d, open) under each of the pieces of its open words."""
        alike = F.col("d") >= F.size("open")
        rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.when(alike, 0).otherwise(F.col("d")))))
        lo, hi = _piece()
        piece = F.when(alike, F.array().cast("array<bigint>")).otherwise(F.slice("open", lo + 1, hi - lo))
        return rows.select(F.col("key").alias("up"), F.xxhash64("key", "i", piece).alias("key"), "id", "at", "i")

    def beside(rows: DataFrame) -> DataFrame:
        """The rows with those open words that are not of the row's piece; none where all forms were alike."""
        lo, hi = _piece()
        rest = F.concat(F.slice("open", F.lit(1), lo), F.slice("open", hi + 1, F.size("open") - hi))
        return rows.where("d < size(open)").select("key", "id", "at", "d", rest.alias("open"))

    level = forms.select(F.col("leaf").alias("key"), "id", "at", "d",
                         F.slice("h", F.lit(depth + 1), F.greatest(n - depth, F.lit(0))).alias("open"))
    found = None
    while True:
        start = mark()
        every = staged(cut(level), "pieces")
        keys = staged(every.groupBy("key").agg(
            F.min(F.struct("at", "id")).alias("e"), F.count(F.lit(1)).alias("forms")).where("forms > 1"), "piece-keys")
        # pieces of one form end here, and so do forms that share none
        shared = staged(every.join(keys, "key"), "shared-pieces")
        release(docs.sparkSession, start, start + 2)
        forms = staged(forms.join(shared.select("id").distinct(), "id", "left_semi").select("id", "n", "d", "h"), "sharing")
        keyed, sizes = shared.drop("e", "forms"), shared.select("key", "forms").distinct()
        # the first form of a piece, and the first one of another document
        other = shared.where("NOT (e.at.doc <=> at.doc AND e.at.fp = at.fp)").withColumn("own", F.struct("at", "id"))
        second = other.groupBy("key").agg(F.min("own").alias("e"))
        quick = like(shared.select("id", "at", "e").union(keyed.join(second, "key").select("id", "at", "e")), forms)
        known = staged(quick if found is None else found.union(quick).distinct(), "like-first")
        left = keyed.join(known, "id", "left_anti")
        small = keyed.join(sizes.where(F.col("forms") <= few), "key").select("key", F.struct("at", "id").alias("e"))
        found = staged(known.union(like(left.join(small, "key"), forms)).distinct(), "like")
        # a large piece with forms that are not settled goes on, up to the last of these
        large = staged(left.join(sizes.where(F.col("forms") > few), "key").join(found, "id", "left_anti")
                       .groupBy("key").agg(F.max("at").alias("until")), "large-pieces")
        if large.isEmpty():
            break
        rows = keyed.join(large, "key").where("at <= until").select("up", "key", "id", "i")
        level = staged(beside(rows.join(level.withColumnRenamed("key", "up"), ["up", "id"])), "open-words")
    return lines.join(found, "id", "left_semi").select("doc", "fp", "pos")


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS, similar: int | None = None, **options) -> DataFrame:
    """(doc, fp, drop): for each document with recurring lines the places of those that go."""
    keys = staged(template_keys(docs, **options), "lines").select("doc", "fp", "pos", F.explode("keys").alias("key"))
    place = F.struct("doc", "fp", "pos")
    if min_docs == 2:  # two documents differ if the smallest and the largest do: one pass, summed before the shuffle
        found = keys.groupBy("key").agg(
            F.min(place).alias("first"), F.max(F.struct("doc", "fp")).alias("last")
        ).where("NOT (first.doc <=> last.doc AND first.fp = last.fp)")
    else:
        found = (
            keys.groupBy("key", "doc", "fp").agg(F.min("pos").alias("pos"))
            .groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("docs"))
            .where(F.col("docs") >= min_docs)
        )
    gone = (
        keys.join(found.select("key", "first"), "key")
        .where("NOT (first.doc <=> doc AND first.fp = fp AND first.pos = pos)")
        .select("doc", "fp", "pos")
    )
    if similar is not None:
        gone = gone.union(similar_lines(docs, similar))
    return gone.distinct().groupBy("doc", "fp").agg(F.sort_array(F.collect_list("pos")).alias("drop"))


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, **options) -> DataFrame:
    """``docs`` without the recurring lines of ``text``, with the counts n_lines and n_dropped added; with ``similar``
    also without the lines that have so many per cent of their words in common with an earlier one."""
    plain = docs.select("doc_id", "text")
    found = dropped_lines(plain, min_docs, **options).toDF("doc_", "fp_", "drop")
    lines = F.split("text", "\n", -1)
    # in time linear in the lines: the gaps between dropped places make a flag for each place
    before = F.concat(F.array(F.lit(-1)), F.slice("drop", 1, F.size("drop") - 1))
    gaps = F.zip_with("drop", before, lambda p, q: p - q - 1)
    flags = F.flatten(F.transform(gaps, lambda g: F.concat(F.array_repeat(F.lit(False), g), F.array(F.lit(True)))))
    return unpacked(
        packed(docs, id="doc_id", text="text", fp=F.xxhash64("text"))
        .join(found, F.expr("id <=> doc_ AND fp = fp_"), "left")
        .withColumn("gone", flags),
        docs.columns,
        text=F.when(F.col("drop").isNull(), F.col("text")).otherwise(
            F.array_join(F.zip_with(lines, "gone", lambda x, g: F.when(g.isNull() | ~g, x)), "\n")),
        n_lines=F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"),
        n_dropped=F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("long"),
    )


def op9_drop_recurring_lines(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return drop_recurring_lines(docs).select("doc_id", "n_lines", "n_dropped", "text")


def op9_drop_similar_lines(spark, sf_dir: str) -> DataFrame:
    """As op9_drop_recurring_lines, and lines like an earlier one go wherever they differ; it has no SQL twin."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return drop_recurring_lines(docs, similar=SIMILAR).select("doc_id", "n_lines", "n_dropped", "text")


#: The kept texts of ``{table}`` as a chain of common table expressions for DuckDB.
LINES_SQL = r"""
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM {table}),
split AS (SELECT doc_id, pos, regexp_matches(line, '[0-9]') AS digits,
                 list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS own FROM lines),
masked AS (SELECT *, list_transform(own, lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS m FROM split),
told AS (SELECT *, NOT digits OR (len(m) - len(list_filter(m, lambda w: w = '<*>')) >= 3
                                  AND 2 * len(list_filter(m, lambda w: w = '<*>')) <= len(m)) AS told FROM masked),
counted AS (SELECT doc_id, pos, digits, told, CASE WHEN told THEN m ELSE own END AS w, len(m) AS n,
                   (len(m) - 3) // 3 AS c1, (len(m) - 3) * 2 // 3 AS c2 FROM told WHERE len(m) >= 3),
loose AS (SELECT *, list_filter(CASE WHEN told AND n >= 5 THEN [
              [['1'], w[1:3], w[4+c1:3+c2], w[4+c2:n]], [['2'], w[1:3], w[4:3+c1], w[4+c2:n]],
              [['3'], w[1:3], w[4:3+c1], w[4+c1:3+c2]]] ELSE [] END,
              lambda k: NOT digits OR (len(flatten(k[2:4])) - len(list_filter(flatten(k[2:4]), lambda x: x = '<*>')) >= 3
                        AND 2 * len(list_filter(flatten(k[2:4]), lambda x: x = '<*>')) <= len(flatten(k[2:4])))) AS more FROM counted),
keyed AS (SELECT doc_id, pos, unnest(list_concat([[['0'], w, [], []]], more)) AS key, n FROM loose),
recurring AS (SELECT n, key, min(struct_pack(d := doc_id, p := pos)) AS first FROM keyed
              GROUP BY n, key HAVING min(doc_id) <> max(doc_id)),
gone AS (SELECT DISTINCT k.doc_id, k.pos FROM keyed k JOIN recurring r ON k.n = r.n AND k.key = r.key
         WHERE NOT (r.first.d = k.doc_id AND r.first.p = k.pos)),
counts AS (SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_dropped,
                  coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL), '') AS kept
           FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
"""

QUERIES = {"op9_drop_recurring_lines": op9_drop_recurring_lines, "op9_drop_similar_lines": op9_drop_similar_lines}
ORACLE = {
    "op9_drop_recurring_lines": "WITH " + LINES_SQL.format(table="documents")
    + "SELECT d.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_dropped, 0) AS n_dropped, "
    "CASE WHEN d.text IS NULL THEN NULL ELSE c.kept END AS text "
    "FROM documents d LEFT JOIN counts c ON d.doc_id = c.doc_id"
}

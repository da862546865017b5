"""Column profiles, signatures, drift, and cleaning by rules over them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field as _field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars
from ..functions.values import Failure, Val, fallible, field
from .schemas import stable_hash
from .steps import StepResult, _apply

#: Date formats that are tried, in order (fixed values).
DATE_FORMATS = ("YYYY-MM-DD", "YYYY/MM/DD", "DD/MM/YYYY", "MM/DD/YYYY")
COERCIONS = ("to_number", "to_integer", "to_boolean", "to_date")
EXAMPLES, EXAMPLE_CHARS = 3, 50
#: Columns profiled by one aggregation; more are done in several.
WIDTH = 100


def _text_columns(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}


def _groups(columns: Sequence[str]) -> list[list[str]]:
    return [list(columns[i : i + WIDTH]) for i in range(0, len(columns), WIDTH)]


def column_stats(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = False) -> DataFrame:
    """One row per column: counts of rows, nulls, empty and blank texts, missing words and distinct values, least
    and greatest value and length, whether texts begin with zeros. One aggregation over the table. Distinct values
    are estimated by a sketch; if ``exact``, a second pass shuffles each column's values once, after each task has
    dropped its repeats."""
    columns = list(columns or df.columns)
    texts = _text_columns(df)
    parts = []
    for group in _groups(columns):
        structs, bound = [], []
        for i, name in enumerate(group):
            c = F.col(f"c{i}")
            text, s = name in texts, c if name in texts else c.cast("string")
            bare, missing = F.col(f"t{i}"), F.col(f"m{i}")
            bound.append(F.col(f"`{name}`").alias(f"c{i}"))
            no = F.lit(0).cast("bigint")
            structs.append(F.struct(
                F.lit(name).alias("column"), F.count(F.lit(1)).alias("n_rows"), F.count_if(c.isNull()).alias("n_null"),
                (F.count_if(s == "") if text else no).alias("n_empty"),
                (F.count_if((s != "") & (bare == "")) if text else no).alias("n_blank"),
                (F.count_if(missing & (bare != "")) if text else no).alias("n_missing_token"),
                F.min(s if text else c).cast("string").alias("least"), F.max(s if text else c).cast("string").alias("greatest"),
                (F.min(F.length(s)) if text else F.lit(None).cast("int")).alias("min_length"),
                (F.max(F.length(s)) if text else F.lit(None).cast("int")).alias("max_length"),
                (F.coalesce(F.max(F.startswith(s, F.lit("0")) & s.rlike("^0[0-9]+$")), F.lit(False)) if text
                 else F.lit(False)).alias("leading_zeros"),
                (F.lit(None).cast("bigint") if exact else F.approx_count_distinct(c)).alias("n_distinct")))
        places = [i for i, name in enumerate(group) if name in texts]
        read = df.select(*bound)  # one projection after the other: each text is stripped once, then looked at once
        read = read.select("*", *[F.btrim(f"c{i}", F.lit(scalars.BLANKS)).alias(f"t{i}") for i in places])
        read = read.select("*", *[scalars.is_missing_token(field(f"t{i}", "text")).col.alias(f"m{i}") for i in places])
        row = read.agg(F.array(*structs).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
        if exact:
            values = F.explode(F.array(*[F.struct(F.lit(n).alias("c"), F.col(f"`{n}`").cast("string").alias("v")) for n in group]))
            distinct = df.select(values.alias("x")).select("x.c", "x.v").where("v IS NOT NULL").distinct().groupBy(
                F.col("c").alias("_c")).agg(F.count(F.lit(1)).alias("_d"))
            row = row.join(F.broadcast(distinct), F.col("column") == F.col("_c"), "left").withColumn(
                "n_distinct", F.coalesce("_d", F.lit(0))).drop("_c", "_d")  # one row per column
        parts.append(row)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_WAYS = (*COERCIONS, *DATE_FORMATS)
_RATES = "column string, how string, n_values bigint, n_passed bigint, rate double, examples array<string>"
#: Classes of failing texts, by hash, whose least ones bound the least of all.
_CLASSES = 4


def _attempts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Of each row the texts ``s{i}``, stripped ``t{i}``, the number they are ``v{i}``, and whether each way reads them,
    ``p{i}_{j}``: one projection after the other, so that every attempt is made once a row."""
    n = range(len(columns))
    read = df.select(*[F.col(f"`{c}`").alias(f"s{i}") for i, c in enumerate(columns)])
    read = read.select("*", *[F.btrim(f"s{i}", F.lit(scalars.BLANKS)).alias(f"t{i}") for i in n])
    read = read.select("*", *[scalars.to_number(field(f"t{i}", "text")).col.alias(f"v{i}") for i in n])

    def passes(i: int, how: str) -> Column:
        text, number = field(f"t{i}", "text"), field(f"v{i}", "number")
        if how in ("to_number", "to_integer"):
            return getattr(scalars, how)(number).col.isNotNull()
        # a number is no date, and a date no number: the tests for one spare those for the other
        made = getattr(scalars, how)(text) if how in COERCIONS else scalars.parse_date(text, how)
        return made.col.isNotNull() if how == "to_boolean" else number.col.isNull() & made.col.isNotNull()

    return read.select("*", *[passes(i, how).alias(f"p{i}_{j}") for i in n for j, how in enumerate(_WAYS)])


@dataclass
class _Readings:
    """How many texts of a column there are of each kind, that is for each set of tests that they pass: bit 0 that there
    is a text, bits 1 to 8 the ways that read it, further bits what cleaning asks; and the least and greatest text of each
    class of a kind. Where these are one, the class holds no other."""

    counts: dict[int, int] = _field(default_factory=dict)
    spans: dict[int, list[tuple[str, str]]] = _field(default_factory=dict)

    def count(self, *bits: int, without: int | None = None) -> int:
        """Texts with any of the bits, and without another."""
        some = sum(1 << b for b in bits)
        return sum(n for m, n in self.counts.items() if m & some and not (without is not None and m >> without & 1))

    def rate(self, column: str, j: int) -> dict:
        """The counts of one way, small texts that it does not read, and the open spans in which smaller ones may lie."""
        spans = [x for m, spans in self.spans.items() if m & 1 and not m >> (j + 1) & 1 for x in spans]
        known = sorted({t for x in spans for t in x}, key=_bytes)[:EXAMPLES]
        most = _bytes(known[-1]) if len(known) == EXAMPLES else None
        gaps = [x for x in spans if x[0] != x[1] and (most is None or _bytes(x[0]) < most)]
        return {"column": column, "how": _WAYS[j], "n_values": self.count(0), "n_passed": self.count(j + 1),
                "examples": known, "gaps": gaps}


def _bytes(text: str) -> bytes:
    """By which Spark orders texts."""
    return text.encode("utf-8", "surrogatepass")


def _readings(df: DataFrame, columns: Sequence[str], more: Sequence[Sequence[Column]] = ()) -> list[_Readings]:
    """The readings of columns of ``_attempts``; ``more`` has further tests of each. One aggregation by the kind of
    text, of which there are few, whatever the number of rows."""
    kinds = []
    for i in range(len(columns)):
        tests = [F.col(f"s{i}").isNotNull(), *[F.col(f"p{i}_{j}") for j in range(len(_WAYS))], *(more[i] if more else ())]
        mask = sum((F.when(t, F.lit(1 << b)).otherwise(F.lit(0)) for b, t in enumerate(tests)), F.lit(0))
        short = F.left(F.col(f"s{i}"), F.lit(EXAMPLE_CHARS))
        kinds.append(F.struct(F.lit(i).alias("i"), mask.alias("mask"), F.pmod(F.hash(short), F.lit(_CLASSES)).alias("part"), short.alias("text")))
    rows = df.select(F.explode(F.array(*kinds)).alias("x")).select("x.*").groupBy("i", "mask", "part").agg(
        F.count(F.lit(1)).alias("n"), F.min("text").alias("least"), F.max("text").alias("most"),
        F.collect_set(F.lit(0)).alias("one"))  # with a set Spark groups by hashing; a least text alone makes it sort
    found = [_Readings() for _ in columns]
    for r in rows.collect():  # kinds of texts
        f = found[r["i"]]
        f.counts[r["mask"]] = f.counts.get(r["mask"], 0) + r["n"]
        if r["least"] is not None:
            f.spans.setdefault(r["mask"], []).append((r["least"], r["most"]))
    return found


def _failing_examples(df: DataFrame, group: Sequence[str], rows: Sequence[dict]) -> dict[tuple[str, str], list[str]]:
    """The least ``EXAMPLES`` distinct failing texts of each column and way. The readings tell some; a smaller one lies
    between the least and the greatest text of a class, below those that are known. Only rows with such texts are looked
    at again, none where every class is one text or the known ones lie below the rest. Texts are combined in each task."""
    at = {name: i for i, name in enumerate(group)}
    found = {(r["column"], r["how"]): set(r["examples"]) for r in rows}
    wanted, near = [], F.lit(False)
    for r in rows:
        if not r["gaps"]:
            continue
        i, j = at[r["column"]], _WAYS.index(r["how"])
        low = min((x[0] for x in r["gaps"]), key=_bytes)
        high = min(max((x[1] for x in r["gaps"]), key=_bytes), *r["examples"][EXAMPLES - 1 :], key=_bytes) \
            if len(r["examples"]) == EXAMPLES else max((x[1] for x in r["gaps"]), key=_bytes)
        inside = lambda t: (t > F.lit(low)) & (t < F.lit(high)) & ~t.isin(*r["examples"])  # noqa: B023, E731
        short, own = F.left(F.col(f"s{i}"), F.lit(EXAMPLE_CHARS)), F.left(F.col(f"`{r['column']}`"), F.lit(EXAMPLE_CHARS))
        wanted.append(F.when(inside(short) & ~F.col(f"p{i}_{j}"), F.struct(
            F.lit(r["column"]).alias("column"), F.lit(r["how"]).alias("how"), short.alias("text"))))
        near = near | F.coalesce(inside(own), F.lit(False))
    if wanted:
        texts = _attempts(df.where(near), group).select(F.explode(F.array_compact(F.array(*wanted))).alias("x")).select("x.*").distinct()
        first = F.row_number().over(Window.partitionBy("column", "how").orderBy("text"))
        for r in texts.withColumn("_n", first).where(F.col("_n") <= EXAMPLES).collect():  # 3 a way
            found[r["column"], r["how"]].add(r["text"])
    return {k: sorted(v, key=_bytes)[:EXAMPLES] for k, v in found.items()}


def parse_rates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, how, n_values, n_passed, rate, examples): how often each coercion and date format reads the texts, with
    the least three texts of up to 50 characters that it does not read. One aggregation over the table, and a second
    look at the few rows with small failing texts."""
    columns = [c for c in (columns or df.columns) if c in _text_columns(df)]
    out = []
    for group in _groups(columns):
        rows = [f.rate(c, j) for c, f in zip(group, _readings(_attempts(df, group), group)) for j in range(len(_WAYS))]
        examples = _failing_examples(df, group, rows)
        out += [(r["column"], r["how"], r["n_values"], r["n_passed"], r["n_passed"] / r["n_values"] if r["n_values"] else None,
                 examples.get((r["column"], r["how"]), [])) for r in rows]
    return df.sparkSession.createDataFrame(out, _RATES)


# --- statistics that are kept by part and merged -----------------------------------------------------------------------

#: Parameters of the sketches: distinct values within about 2 %, ranks within about 2 %.
SKETCH_BITS, SKETCH_K = 12, 200


def part_sketches(df: DataFrame, part: str, columns: Sequence[str]) -> DataFrame:
    """(part, column, n_rows, n_null, distinct, ranks): a row for each part of a table, such as a day, and column, with
    sketches that can be merged. One aggregation, combined in each task. Keep the rows, and make new ones of new parts
    only: nothing that was read is read again."""
    structs = []
    for name in columns:
        c, numeric = F.col(f"`{name}`"), isinstance(df.schema[name].dataType, T.NumericType)
        value = c if isinstance(df.schema[name].dataType, (T.IntegerType, T.LongType, T.StringType, T.BinaryType)) else c.cast("string")
        structs.append(F.struct(
            F.lit(name).alias("column"), F.count(F.lit(1)).alias("n_rows"), F.count_if(c.isNull()).alias("n_null"),
            F.hll_sketch_agg(value, F.lit(SKETCH_BITS)).alias("distinct"),
            (F.kll_sketch_agg_double(c.cast("double"), F.lit(SKETCH_K)) if numeric else F.lit(None).cast("binary")).alias("ranks")))
    rows = df.groupBy(F.col(f"`{part}`").alias("part")).agg(F.array(*structs).alias("x"))
    return rows.select("part", F.explode("x").alias("x")).select("part", "x.*")


def grown_sketches(saved: DataFrame, df: DataFrame, part: str, columns: Sequence[str]) -> DataFrame:
    """Saved sketches with those of the table's new parts; the filter on ``part`` prunes the parts that are known."""
    known = [r[0] for r in saved.select("part").distinct().collect()]  # parts of a table, such as its days
    new = df.where(~F.col(f"`{part}`").isin(known) | F.col(f"`{part}`").isNull()) if known else df
    return saved.unionByName(part_sketches(new, part, columns))


def merged_sketches(sketches: DataFrame, quantiles: Sequence[float] = (0.5,)) -> DataFrame:
    """(column, n_rows, n_null, n_distinct, quantiles) over all parts."""
    rows = sketches.groupBy("column").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_null").alias("n_null"), F.hll_union_agg("distinct").alias("d"),
        F.kll_merge_agg_double("ranks").alias("r"))
    has = F.kll_sketch_get_n_double("r") > 0
    found = F.array(*[F.kll_sketch_get_quantile_double("r", F.lit(float(q))) for q in quantiles])
    return rows.select("column", "n_rows", "n_null", F.hll_sketch_estimate("d").alias("n_distinct"),
                       F.when(F.col("r").isNotNull() & has, found).alias("quantiles"))


def sketched_bounds(sketches: DataFrame, column: str, buckets: int) -> list[float]:
    """Bounds that deal a column's values into about equal buckets, from kept sketches: no pass over the table."""
    row = merged_sketches(sketches.where(F.col("column") == column), [i / buckets for i in range(1, buckets)]).first()
    return sorted(set(row["quantiles"] or [])) if row else []


_COUNTS = ("n_null", "n_empty", "n_blank", "n_missing_token")


def signatures(stats: DataFrame) -> DataFrame:
    """Counts as none, some or all."""
    def bucket(c: str) -> Column:
        return F.when(F.col(c) == 0, "none").when(F.col(c) == F.col("n_rows"), "all").otherwise("some")

    return stats.select("column", *[bucket(c).alias(c[2:]) for c in _COUNTS], "leading_zeros")


def profile_hash(stats: DataFrame) -> str:
    """Hash of the columns' signatures: equal for tables of the same shape, whatever their size."""
    rows = signatures(stats).orderBy("column").collect()  # one row per column
    return stable_hash([r.asDict() for r in rows])


def drift(saved: dict, now: dict) -> str | None:
    """The first reason, in order, for which saved results no longer hold."""
    for key in ("schema", "signature_version", "profile", "catalog_version"):
        if saved.get(key) != now.get(key):
            return key
    return None


# --- cleaning ----------------------------------------------------------------------------------------------------------

#: Words in a column's name that mark identifiers, and signs of currencies (fixed values).
IDENTIFIER_WORDS = frozenset(["id", "zip", "postal", "code", "phone", "account", "sku"])
CURRENCIES = "$€£¥"


def name_words(name: str) -> list[str]:
    """The words of a column's name in lower case: they end at signs and where a capital follows a small letter."""
    words, word = [], ""
    for before, c in zip(" " + name, name):
        if not c.isalnum() or c.isupper() and (before.islower() or before.isdigit()):
            words.append(word)
            word = ""
        if c.isalnum():
            word += c.lower()
    return [w for w in (*words, word) if w]


def dressed_as(text: str) -> str | None:
    """What a number is dressed up with: a currency sign, a percent sign, marks between groups of three digits, or a
    unit of one to four letters after it. None for texts that are no dressed number."""
    text = text.strip()
    if not any(c.isdigit() for c in text):
        return None
    if text[0] in CURRENCIES or text[-1] in CURRENCIES:
        return "currency"
    if text[-1] == "%":
        return "percent"
    bare = text.lstrip("+-")
    for mark, point in ((",", "."), (".", ",")):
        head, *groups = bare.split(point)[0].split(mark)
        if groups and head.isdigit() and len(head) <= 3 and all(len(g) == 3 and g.isdigit() for g in groups):
            return "groups"
    number = bare.rstrip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    unit = bare[len(number):]
    if 1 <= len(unit) <= 4 and number.rstrip()[-1:].isdigit() and set(number.strip()) <= set("0123456789.,"):
        return "unit"
    return None


_ROUTES = {(False, False): "none", (True, False): "missing-value", (False, True): "coercion", (True, True): "both"}


def route_of(stats, rates: Sequence) -> dict:
    """The route of one column from its statistics and parse rates, and the reasons for it."""
    reasons = []
    missing = stats["n_missing_token"] + stats["n_empty"] + stats["n_blank"]
    if missing:
        reasons.append(f"{missing} texts stand for a missing value")
    best = max(rates, key=lambda r: r["n_passed"], default=None)
    forms = sorted({d for r in rates for d in map(dressed_as, r["examples"]) if d})
    coercible = bool(forms) or best is not None and best["n_passed"] > 0
    if coercible:
        reasons.append(f"{best['how']} reads {best['n_passed']} texts" if best["n_passed"] else f"numbers with {', '.join(forms)}")
    named = sorted(IDENTIFIER_WORDS.intersection(name_words(stats["column"])))
    identifier = coercible and bool(named or stats["leading_zeros"])
    if identifier:
        reasons.append(f"an identifier by its {'name' if named else 'leading zeros'}, so it is not read as a number")
    return {"column": stats["column"], "route": _ROUTES[bool(missing), coercible and not identifier],
            "identifier": identifier, "reason": "; ".join(reasons)}


def route_columns(df: DataFrame, stats: DataFrame | None = None, rates: DataFrame | None = None) -> list[dict]:
    """For each column what cleaning it needs, missing-value, coercion, both or none, and why."""
    stats = column_stats(df) if stats is None else stats
    rates = parse_rates(df) if rates is None else rates
    seen: dict[str, list] = {}
    for r in rates.collect():  # some rows per column
        seen.setdefault(r["column"], []).append(r)
    return [route_of(s, seen.get(s["column"], [])) for s in stats.orderBy("column").collect()]


def clear_missing(x: Val) -> Val:
    """Null in place of words for a missing value."""
    return Val(F.when(~scalars.is_missing_token(x).col, x.col), x.failures, "text")


def _undressed(x: Val) -> Val:
    """Text without currency signs, percent signs and units."""
    return scalars.regex_replace(scalars.trim(x), r"^[$€£¥]\s*|\s*[$€£¥%]$|\s*[A-Za-z]{1,4}$", "")


def clean_number(x: Val, decimal_mark: str = ".") -> Val:
    """A number out of text with currency signs, percent signs, units and marks between thousands."""
    return scalars.parse_number(_undressed(x), decimal_mark)


def decimal_mark(df: DataFrame, column: str) -> str:
    """The mark with which more texts of the column are numbers."""
    x = clear_missing(field(column, "text"))
    commas = F.count_if(x.col.rlike(r",[0-9]{1,2}([^0-9]|$)"))
    points = F.count_if(x.col.rlike(r"\.[0-9]{1,2}([^0-9]|$)"))
    row = df.agg(commas.alias("c"), points.alias("p")).first()
    return "," if row["c"] > row["p"] else "."


_BOOLEAN_WORDS = (("yes", "true"), ("y", "true"), ("no", "false"), ("n", "false"))


def clean_boolean(x: Val) -> Val:
    """Booleans out of yes, no, y, n, true, false, 1, 0 in any case."""
    s = F.lower(F.btrim(x.col, F.lit(scalars.BLANKS)))
    words = F.when(s.isNull(), None)
    for word, truth in _BOOLEAN_WORDS:
        words = words.when(s == word, truth)
    return scalars.to_boolean(Val(words.otherwise(s), x.failures, "text"))


def date_order(df: DataFrame, column: str) -> str:
    """Whether day or month comes first in a column of slashed dates: ``dmy``, ``mdy``, or ``ambiguous`` if rows
    speak for both, or for neither although both could be."""
    x = clear_missing(field(column, "text"))
    d = scalars.parse_date(x, "DD/MM/YYYY").col.isNotNull()
    m = scalars.parse_date(x, "MM/DD/YYYY").col.isNotNull()
    row = df.agg(F.count_if(d & ~m).alias("d"), F.count_if(m & ~d).alias("m"), F.count_if(d & m).alias("both")).first()
    if row["d"] and row["m"] or not row["d"] and not row["m"] and row["both"]:
        return "ambiguous"
    return "dmy" if row["d"] else "mdy" if row["m"] else "none"


def clean_date(df: DataFrame, column: str, on_ambiguous: str = "report") -> Val | None:
    """A chain of the date formats that read the column, best first, as one fallible value; None if the order of
    day and month is ambiguous (with ``exclusive_rows``, rows that one order alone reads are read). One pass."""
    facts = _cleaning_facts(df, [column])[column]
    order = _order_of(facts)
    if order != "ambiguous":
        return _date_by(column, order, facts)
    if on_ambiguous != "exclusive_rows":
        return None
    x = clear_missing(field(column, "text"))
    d, m = scalars.parse_date(x, "DD/MM/YYYY"), scalars.parse_date(x, "MM/DD/YYYY")
    one = F.when(d.col.isNull() | m.col.isNull() | (d.col == m.col), F.coalesce(d.col, m.col))
    read = F.coalesce(*[scalars.parse_date(x, f).col for f in _ISO], one)
    return fallible("parse_date", read, Val(x.col, (), "text"), kind="date")


@dataclass
class CleanPlan:
    """Cleaned values by column, with the failure rates seen in a dry run."""

    values: dict[str, Val] = _field(default_factory=dict)
    notes: dict[str, str] = _field(default_factory=dict)

    def dry_run(self, df: DataFrame) -> list[dict]:
        """Per column: failures, rate, and the rate to allow: twice as much, at least 1 %."""
        if not self.values:
            return []
        row = df.agg(F.count(F.lit(1)).alias("n"), *[
            F.count_if(v.failed).alias(f"f{i}") for i, v in enumerate(self.values.values())]).first()
        out = []
        for i, name in enumerate(self.values):
            rate = row[f"f{i}"] / row["n"] if row["n"] else 0.0
            out.append({"column": name, "failed": row[f"f{i}"], "rate": rate, "max_rate": max(2 * rate, 0.01)})
        return out

    def apply(self, df: DataFrame, policy: str = "quarantine") -> StepResult:
        """All columns cleaned in one pass, in their places; each value is worked out once a row."""
        made = {c: f"__clean{i}__" for i, c in enumerate(self.values)}
        failures = []
        for c, v in self.values.items():
            own = v.failures[-1] if v.failures else None
            if own and own.result is v.col:  # it fails where it is null, so the value that is there tells
                own = Failure(own.function, own.input, own.input.isNotNull() & F.col(made[c]).isNull())
                failures += [*v.failures[:-1], own]
            else:
                failures += v.failures
        bound = df.withColumns({made[c]: v.col for c, v in self.values.items()}) if made else df
        columns = [F.col(made[c]).alias(c) if c in made else F.col(f"`{c}`") for c in df.columns]
        row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
        return _apply(bound, "clean", Val(F.lit(True), tuple(failures), "boolean"), policy, lambda d: d.select(*columns), row)


#: A coercion that would fail in more than this share of rows is left out.
WORST_RATE = 0.5
_ISO = [f for f in DATE_FORMATS if f.startswith("YYYY")]


def _cleaning_facts(df: DataFrame, columns: Sequence[str]) -> dict[str, dict]:
    """What the rules need to know of each text column, gathered in one aggregation: every attempt to read a text is
    made once a row."""
    n = range(len(columns))
    both = _attempts(df, columns)
    both = both.select("*", *[clear_missing(field(f"t{i}", "text")).col.alias(f"x{i}") for i in n])
    both = both.select("*", *[_undressed(field(f"x{i}", "text")).col.alias(f"u{i}") for i in n])
    words = [w for w, _ in _BOOLEAN_WORDS] + ["true", "false", "1", "0"]
    more = [[F.col(f"x{i}").isNotNull(), F.lower(f"x{i}").isin(*words),
             *[scalars.parse_number(field(f"u{i}", "text"), mark).col.isNotNull() for mark in ".,"],
             *[F.col(f"x{i}").rlike(f"[{mark}][0-9]{{1,2}}([^0-9]|$)") for mark in ".,"]] for i in n]
    present, booleans, points, commas, point_marks, comma_marks = range(len(_WAYS) + 1, len(_WAYS) + 7)
    bit = {f: _WAYS.index(f) + 1 for f in DATE_FORMATS}  # no word for a missing value is a date
    iso, dmy, mdy = [bit[f] for f in _ISO], bit["DD/MM/YYYY"], bit["MM/DD/YYYY"]
    out = {}
    for name, f in zip(columns, _readings(both, columns, more)):
        out[name] = {
            "n": sum(f.counts.values()), "rates": [f.rate(name, j) for j in range(len(_WAYS))],
            "present": f.count(present), "booleans": f.count(booleans), "points": f.count(points), "commas": f.count(commas),
            "point_marks": f.count(point_marks), "comma_marks": f.count(comma_marks), "dmy": f.count(dmy, without=mdy),
            "mdy": f.count(mdy, without=dmy), "either": f.count(dmy) - f.count(dmy, without=mdy), "none": f.count(*iso),
            "with_dmy": f.count(*iso, dmy), "with_mdy": f.count(*iso, mdy), **{k: f.count(b) for k, b in bit.items()}}
    return out


def _order_of(facts: dict) -> str:
    if facts["dmy"] and facts["mdy"] or not facts["dmy"] and not facts["mdy"] and facts["either"]:
        return "ambiguous"
    return "dmy" if facts["dmy"] else "mdy" if facts["mdy"] else "none"


def _date_by(column: str, order: str, rates: dict) -> Val:
    x = clear_missing(field(column, "text"))
    formats = _ISO + [{"dmy": "DD/MM/YYYY", "mdy": "MM/DD/YYYY"}[order]] * (order != "none")
    ranked = sorted(formats, key=lambda f: -rates[f])
    return fallible("parse_date", F.coalesce(*[scalars.parse_date(x, f).col for f in ranked]), Val(x.col, (), "text"), kind="date")


def propose_cleaning(df: DataFrame, on_ambiguous: str = "report") -> CleanPlan:
    """A plan by rules: missing words go first, then the coercion that reads most values. Two passes over the table:
    statistics, and all attempts to read its texts."""
    plan = CleanPlan()
    texts = [c for c in df.columns if c in _text_columns(df)]
    if not texts:
        return plan
    facts: dict[str, dict] = {}
    for group in _groups(texts):
        facts |= _cleaning_facts(df, group)
    for stats in column_stats(df, texts).orderBy("column").collect():  # one row per column
        name = stats["column"]
        f = facts[name]
        kind = route_of(stats, f["rates"])["route"]
        x = clear_missing(field(name, "text"))
        value = x if kind in ("missing-value", "both") else None
        if kind in ("coercion", "both"):
            have = {r["how"]: r["n_passed"] / r["n_values"] if r["n_values"] else 0.0 for r in f["rates"]}
            booleans = f["booleans"] / f["present"] if f["present"] else 0.0
            if max(have[w] for w in (*DATE_FORMATS, "to_date")) > max(have["to_number"], booleans):
                order = _order_of(f)
                if order != "ambiguous":
                    read, passed = _date_by(name, order, f), f["none" if order == "none" else f"with_{order}"]
                else:
                    read = clean_date(df, name, on_ambiguous)
                    passed = f["present"] if read is None else f["with_dmy"] + f["with_mdy"] - f["none"] - 2 * f["either"]
                    if read is None:
                        plan.notes[name] = "order of day and month is ambiguous"
            elif booleans > have["to_number"] or booleans == 1:
                read, passed = clean_boolean(x), f["booleans"]
            else:
                comma = f["comma_marks"] > f["point_marks"]
                read, passed = clean_number(x, "," if comma else "."), f["commas" if comma else "points"]
            if read is not None:
                failing = (f["present"] - passed) / f["n"] if f["n"] else 0.0
                if failing <= WORST_RATE:
                    value = read
                else:
                    plan.notes[name] = f"coercion dropped: fails in {failing:.0%} of rows"
        if value is not None:
            plan.values[name] = value
    return plan

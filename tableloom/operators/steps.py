"""Steps over tables: filter, computed field, drop, aggregate, JSON and flattening, each with a failure policy.

A step gives a ``StepResult``: the kept rows, the rejected rows (or None) and a report. Policies for rows in which a
fallible call failed: ``fail`` (default; counted in one action before anything is written), ``null`` (keep the row
with the null), ``drop`` and ``quarantine`` (remove it; quarantine also captures function, input and row).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field as _field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import BuildError, Failure, Val, val

POLICIES = ("fail", "null", "drop", "quarantine")
#: Characters kept of a rejected input and of a rejected row.
INPUT_CHARS, ROW_CHARS = 500, 2000

REJECT_SCHEMA = "step string, function string, input_value string, source_row string"


class StepFailed(RuntimeError):
    """A step under the policy ``fail`` found failing rows. It names the step, the functions and the count only."""


@dataclass
class StepReport:
    """What a step did: its label, fallible functions, policy and, after an action, the count of failed rows."""

    label: str
    functions: tuple[str, ...]
    policy: str
    _count: Callable[[], int] = _field(default=lambda: 0, repr=False)

    @property
    def count(self) -> int:
        return self._count()


@dataclass
class StepResult:
    df: DataFrame
    rejects: DataFrame | None = None
    report: StepReport | None = None


def reject_rows(df: DataFrame, label: str, value: Val, row: Column | None = None) -> DataFrame:
    """Rows in which ``value`` failed, as (step, function, input_value, source_row)."""
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])) if row is None else row
    return df.where(value.failed).select(
        F.lit(label).alias("step"), value.failed_function.alias("function"),
        F.substring(value.failed_input, 1, INPUT_CHARS).alias("input_value"),
        F.substring(whole, 1, ROW_CHARS).alias("source_row"))


_FAILED = "__failed__"


def _apply(df: DataFrame, label: str, value: Val, policy: str, keep: Callable[[DataFrame], DataFrame],
           row: Column | None = None) -> StepResult:
    if policy not in POLICIES:
        raise BuildError(f"no policy {policy!r}")
    functions = tuple(dict.fromkeys(f.function for f in value.failures))
    if not functions:
        return StepResult(keep(df), None, StepReport(label, (), policy))
    if policy == "fail":
        n = df.where(value.failed).count()
        if n:
            raise StepFailed(f"{label}: {', '.join(functions)} failed in {n} rows")
        return StepResult(keep(df), None, StepReport(label, functions, policy))
    seen = Observation()
    # whether a row failed is worked out once, below the count, which no filter passes
    watched = df.withColumn(_FAILED, value.failed).observe(seen, F.count_if(F.col(_FAILED)).alias("n"))
    report = StepReport(label, functions, policy, lambda: seen.get["n"])
    if policy == "null":
        return StepResult(keep(watched).drop(_FAILED), None, report)
    rejects = reject_rows(df, label, value, row) if policy == "quarantine" else None
    return StepResult(keep(watched.where(~F.col(_FAILED))).drop(_FAILED), rejects, report)


def need_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise BuildError(f"no column {', '.join(missing)}")


def filter_rows(df: DataFrame, condition: Val, policy: str = "fail", label: str = "filter") -> StepResult:
    """Rows in which the condition is true."""
    condition = val(condition)
    if condition.kind not in (None, "boolean"):
        raise BuildError(f"a filter needs a condition, not {condition.kind}")
    return _apply(df, label, condition, policy, lambda d: d.where(condition.col))


def compute(df: DataFrame, name: str, value: Val, policy: str = "fail", label: str | None = None) -> StepResult:
    """A column added or replaced in place."""
    value = val(value)
    return _apply(df, label or f"compute {name}", value, policy, lambda d: d.withColumn(name, value.col))


def drop_fields(df: DataFrame, names: Sequence[str]) -> StepResult:
    need_columns(df, names)
    return StepResult(df.drop(*names))


@dataclass(frozen=True)
class Agg:
    """One aggregate: function, field (none for count), name of the result."""

    fn: str
    field: str | None
    alias: str


AGGREGATES: dict[str, Callable[[Column | None], Column]] = {
    "count": lambda c: F.count(F.lit(1)),
    "count_field": F.count,
    "count_distinct": F.count_distinct,
    "sum": F.sum,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
}


def aggregate(df: DataFrame, by: Sequence[str], aggs: Sequence[Agg], having: Val | None = None) -> StepResult:
    """Grouped aggregates; null keys form a group; without keys one row. ``having`` may use keys and aliases."""
    need_columns(df, [*by, *[a.field for a in aggs if a.field]])
    names = [*by, *[a.alias for a in aggs]]
    if len(set(names)) < len(names):
        raise BuildError("two results of an aggregate share a name")
    for a in aggs:
        if a.fn not in AGGREGATES:
            raise BuildError(f"no aggregate {a.fn!r}")
        if (a.field is None) != (a.fn == "count"):
            raise BuildError(f"{a.fn} takes {'no' if a.fn == 'count' else 'a'} field")
    columns = [AGGREGATES[a.fn](F.col(f"`{a.field}`") if a.field else None).alias(a.alias) for a in aggs]
    out = df.groupBy(*[F.col(f"`{c}`") for c in by]).agg(*columns)
    return StepResult(out.where(val(having).col) if having is not None else out)


def group_count(df: DataFrame, by: Sequence[str], exact: bool = True) -> int:
    """Number of distinct keys, exactly or by sketch."""
    need_columns(df, by)
    if exact:
        return df.select(*by).distinct().count()
    return df.agg(F.approx_count_distinct(F.struct(*by))).first()[0]


def refuse_many_groups(df: DataFrame, by: Sequence[str], most: int = 100_000) -> int:
    """The number of groups, or a refusal beyond ``most``. Off unless called: Spark spills."""
    n = df.select(*by).distinct().limit(most + 1).count()
    if n > most:
        raise StepFailed(f"more than {most} groups")
    return n


def map_fields(df: DataFrame, mapping: Sequence[tuple[str, str]]) -> DataFrame:
    """Columns picked and renamed, (source, target), in the mapping's order."""
    need_columns(df, [s for s, _ in mapping])
    if len({t for _, t in mapping}) < len(mapping):
        raise BuildError("a target is mapped twice")
    return df.select(*[F.col(f"`{s}`").alias(t) for s, t in mapping])


# --- JSON and nested data ------------------------------------------------------------------------------------------


def to_json(df: DataFrame, field: str, output: str) -> StepResult:
    """A column as JSON text in another; text is taken to be JSON already."""
    need_columns(df, [field])
    nested = isinstance(df.schema[field].dataType, (T.StructType, T.ArrayType, T.MapType))
    c = F.col(f"`{field}`")
    return StepResult(df.withColumn(output, F.to_json(c) if nested else c.cast("string"))
                      .withMetadata(output, {"json": True}))


def flatten(df: DataFrame, field: str, depth: int = 1) -> StepResult:
    """A struct's fields as columns ``field_sub``, down to ``depth`` levels, in the struct's place."""
    need_columns(df, [field])

    def walk(c: Column, kind: T.DataType, name: str, left: int):
        if isinstance(kind, T.StructType) and left:
            for f in kind.fields:
                yield from walk(c.getField(f.name), f.dataType, f"{name}_{f.name}", left - 1)
        else:
            yield name, c

    if not isinstance(df.schema[field].dataType, T.StructType):
        raise BuildError(f"{field} is no struct")
    flat = dict(walk(F.col(f"`{field}`"), df.schema[field].dataType, field, depth))
    clash = sorted(flat.keys() & (set(df.columns) - {field}))
    if clash:
        raise BuildError(f"flatten would overwrite {', '.join(clash)}")
    out = []
    for c in df.columns:
        out += [v.alias(k) for k, v in flat.items()] if c == field else [F.col(f"`{c}`")]
    return StepResult(df.select(*out))


def json_keys(df: DataFrame, field: str) -> list[str]:
    """Names that the objects in a JSON text column have, in order of name: the first pass of a ragged flatten."""
    keys = df.select(F.explode(F.json_object_keys(F.col(f"`{field}`"))).alias("k")).distinct()
    return [r[0] for r in keys.orderBy("k").collect()]


def flatten_json(df: DataFrame, field: str, keys: Sequence[str] | None = None,
                 policy: str = "quarantine") -> StepResult:
    """Members of JSON objects as text columns ``field_key``. Rows whose value is neither null nor an object are
    rejected as ``flatten_non_object``."""
    need_columns(df, [field])
    keys = json_keys(df, field) if keys is None else list(keys)
    clash = sorted({f"{field}_{k}" for k in keys} & (set(df.columns) - {field}))
    if clash:
        raise BuildError(f"flatten would overwrite {', '.join(clash)}")
    c = F.col(f"`{field}`")
    # JSON null is no failure; what cannot be read is
    odd = c.isNotNull() & F.json_object_keys(c).isNull() & ~(F.trim(c) == "null")
    value = Val(c, (Failure("flatten_non_object", c, odd),))
    parsed = F.from_json(c, T.MapType(T.StringType(), T.StringType()))

    def keep(d: DataFrame) -> DataFrame:
        own = d.withColumn("_map", parsed)
        columns = []
        for name in df.columns:
            columns += [F.col("_map").getItem(k).alias(f"{field}_{k}") for k in keys] if name == field else [
                F.col(f"`{name}`")]
        return own.select(*columns)

    return _apply(df, f"flatten {field}", value, policy, keep)


def unwind(df: DataFrame, field: str, keep_empty: bool = False) -> DataFrame:
    """One row for each element of an array; rows without elements go unless kept."""
    need_columns(df, [field])
    return df.withColumn(field, (F.explode_outer if keep_empty else F.explode)(F.col(f"`{field}`")))


def lookup(df: DataFrame, other: DataFrame, key: str, other_key: str, output: str) -> DataFrame:
    """The matching rows of another table as an array of structs, empty where none match."""
    rows = other.groupBy(F.col(f"`{other_key}`").alias("_key")).agg(
        F.collect_list(F.struct(*[F.col(f"`{c}`") for c in other.columns])).alias("_rows"))
    kind = rows.schema["_rows"].dataType.simpleString()
    return df.join(rows, F.col(f"`{key}`") == F.col("_key"), "left").withColumn(
        output, F.coalesce("_rows", F.array().cast(kind))).drop("_key", "_rows")


def children_json(parents: DataFrame, children: DataFrame, key: str, child_key: str, fields: Sequence[str],
                  order: Sequence[str], output: str = "children") -> DataFrame:
    """Each parent with its children as a JSON array in order, ``[]`` without any. Only the fields are shuffled."""
    item = F.struct(*[F.col(f"`{c}`") for c in order], F.struct(*[F.col(f"`{c}`") for c in fields]).alias("_v"))
    lists = children.groupBy(F.col(f"`{child_key}`").alias("_key")).agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["_v"])).alias("_json"))
    return parents.join(lists, F.col(f"`{key}`") == F.col("_key"), "left").withColumn(
        output, F.coalesce("_json", F.lit("[]"))).drop("_key", "_json")


def prune_struct(df: DataFrame, field: str, keep: dict[str, Column]) -> DataFrame:
    """Fields of a struct that are kept where their condition holds and null elsewhere; others go."""
    s = F.col(f"`{field}`")
    return df.withColumn(field, F.when(s.isNotNull(), F.struct(
        *[F.when(c, s.getField(n)).alias(n) for n, c in keep.items()])))


def redact(df: DataFrame, visible: Callable[[str, Column], Column | None]) -> DataFrame:
    """Documents pruned at every level. ``visible`` is asked for each struct, by its dotted path, and each array of
    structs, by that and ``[]``; it gives a condition over the struct, or None to leave it. A struct for which the
    condition is not true becomes null, with all below it; an array loses such elements."""

    def walk(c: Column, kind: T.DataType, path: str) -> Column:
        if isinstance(kind, T.StructType):
            inside = F.struct(*[walk(c.getField(f.name), f.dataType, f"{path}.{f.name}").alias(f.name) for f in kind.fields])
            condition = visible(path, c)
            return F.when(c.isNotNull() if condition is None else c.isNotNull() & condition, inside)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            return F.filter(F.transform(c, lambda x: walk(x, kind.elementType, f"{path}[]")), lambda x: x.isNotNull())
        return c

    return df.select(*[walk(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in df.schema.fields])


def replace_root(df: DataFrame, field: str) -> DataFrame:
    """The fields of a struct as the whole row."""
    return df.select(f"`{field}`.*")


# --- pipelines -------------------------------------------------------------------------------------------------------


@dataclass
class Pipeline:
    """Steps in order, each over the result of the one before."""

    steps: list[Callable[[DataFrame], StepResult]]
    reports: list[StepReport] = _field(default_factory=list)

    def run(self, df: DataFrame) -> StepResult:
        rejects: DataFrame | None = None
        self.reports = []
        for step in self.steps:
            result = step(df)
            df = result.df
            if result.rejects is not None:
                rejects = result.rejects if rejects is None else rejects.unionByName(result.rejects)
            if result.report is not None:
                self.reports.append(result.report)
        return StepResult(df, rejects)

    def output_schema(self, df: DataFrame) -> T.StructType:
        """The schema that the steps give, from the analyzer, without reading rows."""
        return self.run(df.limit(0)).df.schema

    def report(self, spark) -> DataFrame:
        """One row for each step that can fail, also at 0; read after an action over the result."""
        rows = [(r.label, ", ".join(r.functions), r.policy, r.count) for r in self.reports]
        return spark.createDataFrame(rows, "step string, functions string, policy string, failed bigint")

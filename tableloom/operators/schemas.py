"""Logical types, their lattice, inference, contracts and conformance.

Spark's own types are the logical types; what they cannot say is in a field's metadata: ``json`` (text that is any
JSON value), ``format`` (uuid, objectId) and ``presence`` (share of documents that have the field)."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars
from ..functions.values import BuildError, Failure, Val, field
from .steps import StepResult, _apply

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)
ANY_JSON = "json"


@dataclass(frozen=True)
class Joined:
    """A common type, whether it says less than its parts, and why."""

    type: T.DataType | str
    degraded: bool = False
    reason: str | None = None


def kind_of(t: T.DataType | str) -> str:
    """The logical kind of a Spark type."""
    if t == ANY_JSON:
        return ANY_JSON
    for kinds, name in (
        (T.StringType, "string"), (INTEGERS, "integer"), (FLOATS, "float"), (T.DecimalType, "decimal"),
        (T.BooleanType, "boolean"), (T.DateType, "date"), ((T.TimestampType, T.TimestampNTZType), "timestamp"),
        (T.BinaryType, "bytes"), (T.StructType, "object"), (T.ArrayType, "array"),
    ):
        if isinstance(t, kinds):
            return name
    return ANY_JSON


def join_types(a: T.DataType | str, b: T.DataType | str) -> Joined:
    """The least common type. Numbers widen, a date widens to a timestamp, structs merge by field, arrays by
    element; what has nothing in common becomes text, or JSON if one is nested."""
    if a == b:
        return Joined(a)
    ka, kb = kind_of(a), kind_of(b)
    kinds = {ka, kb}
    if ANY_JSON in kinds:
        return Joined(ANY_JSON, True, f"{ka} and {kb} only share JSON")
    if ka == kb == "integer":
        return Joined(T.LongType())
    if ka == kb == "float":
        return Joined(T.DoubleType())
    if kinds == {"integer", "float"}:
        return Joined(T.DoubleType())
    if "decimal" in kinds and kinds <= {"decimal", "integer", "float"}:
        if ka == kb:
            whole = max(a.precision - a.scale, b.precision - b.scale)
            scale = max(a.scale, b.scale)
            fits = whole + scale <= 38
            return Joined(T.DecimalType(min(38, whole + scale), scale if fits else max(0, 38 - whole)), not fits,
                          None if fits else "more digits than a decimal holds")
        d = a if ka == "decimal" else b
        if "integer" in kinds:
            return Joined(T.DecimalType(38, min(d.scale, 19)))
        return Joined(T.DecimalType(38, 18), True, "a float as a decimal")
    if kinds == {"date", "timestamp"}:
        return Joined(a if ka == "timestamp" else b)
    if ka == kb == "timestamp":
        return Joined(T.TimestampNTZType(), True, "a time with and one without zone")
    if ka == kb == "object":
        fields, worse = [], []
        for name in dict.fromkeys([*a.names, *b.names]):
            f, why = join_fields(a[name] if name in a.names else None, b[name] if name in b.names else None)
            fields.append(f)
            worse += [why] if why else []
        return Joined(T.StructType(fields), bool(worse), "; ".join(worse) or None)
    if ka == kb == "array":
        inner = join_types(a.elementType, b.elementType)
        if inner.type == ANY_JSON:
            return Joined(ANY_JSON, True, inner.reason)
        return Joined(T.ArrayType(inner.type, True), inner.degraded, inner.reason)
    if kinds & {"object", "array"}:
        return Joined(ANY_JSON, True, f"{ka} and {kb} only share JSON")
    return Joined(T.StringType(), True, f"{ka} and {kb} only share text")


def union_widened(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of two tables under the least common type of each column; a column that one lacks is null there."""
    names = list(dict.fromkeys([*a.columns, *b.columns]))
    fields = [join_fields(a.schema[n] if n in a.columns else None, b.schema[n] if n in b.columns else None)[0] for n in names]

    def shaped(df: DataFrame) -> DataFrame:
        out = []
        for f in fields:
            c = F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)
            nested = f.name in df.columns and kind_of(df.schema[f.name].dataType) in ("object", "array")
            if nested and kind_of(f.dataType) == "string":
                c = F.to_json(c)
            out.append(c.cast(f.dataType).alias(f.name))
        return df.select(*out)

    return shaped(a).unionByName(shaped(b))


def json_field(name: str, nullable: bool = True, **metadata) -> T.StructField:
    return T.StructField(name, T.StringType(), nullable, {"json": True, **metadata})


def join_fields(a: T.StructField | None, b: T.StructField | None) -> tuple[T.StructField, str | None]:
    """A field of two schemas; where one lacks it, nulls are possible."""
    if a is None or b is None:
        f = a or b
        return T.StructField(f.name, f.dataType, True, f.metadata), None
    types = [ANY_JSON if (f.metadata or {}).get("json") else f.dataType for f in (a, b)]
    found = join_types(*types)
    nullable = a.nullable or b.nullable
    if found.type == ANY_JSON:
        return json_field(a.name, nullable), found.reason
    return T.StructField(a.name, found.type, nullable, a.metadata if a.metadata == b.metadata else {}), found.reason


#: Shapes that a value of a loosely typed column can have.
SHAPES = ("null", "boolean", "integer", "float", "date", "string", "object", "array")


def shape_of(c: Column) -> Column:
    """The shape of a JSON text's value."""
    t = F.trim(c)
    return (
        F.when(c.isNull() | (t == "null"), "null").when(t.isin("true", "false"), "boolean")
        .when(t.rlike(r"^-?[0-9]+$"), "integer").when(t.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), "float")
        .when(F.startswith(t, F.lit("{")), "object").when(F.startswith(t, F.lit("[")), "array").otherwise("string")
    )


def shape_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, dict[str, int]]:
    """For each column of JSON texts, how many values have each shape: one pass, one row to the driver."""
    aggs = [F.count_if(shape_of(F.col(f"`{c}`")) == s).alias(f"{i}:{s}") for i, c in enumerate(columns) for s in SHAPES]
    row = df.agg(*aggs).first().asDict()
    return {c: {s: row[f"{i}:{s}"] for s in SHAPES} for i, c in enumerate(columns)}


_SHAPE_TYPES = {"boolean": T.BooleanType(), "integer": T.LongType(), "float": T.DoubleType(), "date": T.TimestampType(),
                "string": T.StringType(), "object": ANY_JSON, "array": ANY_JSON}


def infer_schema(counts: Mapping[str, Mapping[str, int]], documents: int) -> T.StructType:
    """A nested schema from dotted names and the counts of their values' shapes. A name that is both a value and a
    parent of others becomes JSON; ``presence`` is the share of documents with a value."""
    tree: dict = {}
    for name, shapes in counts.items():
        at = tree
        *parents, last = name.split(".")
        for p in parents:
            at = at.setdefault(p, [None, {}])[1]
        at.setdefault(last, [None, {}])[0] = shapes

    def build(node: dict) -> T.StructType:
        fields = []
        for name, (shapes, children) in sorted(node.items()):
            present = sum(n for s, n in (shapes or {}).items() if s != "null")
            share = present / documents if documents else 0.0
            kinds = [_SHAPE_TYPES[s] for s, n in (shapes or {}).items() if n and s != "null"]
            if children and not present:
                fields.append(T.StructField(name, build(children), True))
                continue
            if children:
                fields.append(json_field(name, True, presence=share))
                continue
            found: T.DataType | str = kinds[0] if kinds else T.StringType()
            for k in kinds[1:]:
                found = join_types(found, k).type
            nullable = share < 1
            fields.append(json_field(name, nullable, presence=share) if found == ANY_JSON
                          else T.StructField(name, found, nullable, {"presence": share}))
        return T.StructType(fields)

    return build(tree)


def normal_name(raw: str, seen: set[str], longest: int = 63) -> str:
    """A name of [a-z0-9_]; long ones end in a hash, repeated ones in a number. ``seen`` gets the result."""
    base = re.sub(r"_+", "_", re.sub(r"[^a-z0-9_]+", "_", raw.lower())).strip("_") or "field"
    if len(base) > longest:
        tag = hashlib.sha256(raw.encode("utf-8")).hexdigest()[:6]
        base = f"{base[: longest - 7]}_{tag}"
    name, n = base, 2
    while name in seen:
        name, n = f"{base}_{n}", n + 1
    seen.add(name)
    return name


def normalize_names(df: DataFrame, longest: int = 63) -> DataFrame:
    seen: set[str] = set()
    return df.toDF(*[normal_name(c, seen, longest) for c in df.columns])


# --- native types ------------------------------------------------------------------------------------------------------

#: Native column types by system: pattern of the lower-cased type, Spark type, what is lost (fixed values).
NATIVE: dict[str, list[tuple[str, str, str | None]]] = {
    "mysql": [
        (r"tinyint\(1\)|bool(ean)?", "boolean", None), (r"(tiny|small|medium|big)?int.*", "bigint", None),
        (r"float.*|double.*", "double", None), (r"(decimal|numeric).*", "decimal", None), (r"date", "date", None),
        (r"datetime.*", "timestamp_ntz", None), (r"timestamp.*", "timestamp", None),
        (r"time.*", "string", "time of day as text"), (r"json", "json", None),
        (r"(tiny|medium|long)?blob|(var)?binary.*", "binary", None), (r".*char.*|.*text|enum.*|set.*", "string", None)],
    "postgres": [
        (r"bool(ean)?", "boolean", None), (r"smallint|int[248]?|integer|bigint|serial|bigserial", "bigint", None),
        (r"real|double precision|float[48]?", "double", None), (r"(decimal|numeric).*", "decimal", None),
        (r"date", "date", None), (r"timestamp with time zone|timestamptz", "timestamp", None),
        (r"timestamp.*", "timestamp_ntz", None), (r"time.*", "string", "time of day as text"),
        (r"jsonb?", "json", None), (r"bytea", "binary", None), (r"uuid", "string", None), (r".*char.*|text", "string", None)],
    "sqlserver": [
        (r"bit", "boolean", None), (r"(tiny|small|big)?int", "bigint", None), (r"real|float.*", "double", None),
        (r"(decimal|numeric).*", "decimal", None), (r"money", "decimal(19,4)", None), (r"smallmoney", "decimal(10,4)", None),
        (r"date", "date", None), (r"datetimeoffset.*", "timestamp", "offset folded into UTC"),
        (r"datetime2.*", "timestamp_ntz", "seventh digit of a second"), (r"(small)?datetime", "timestamp_ntz", None),
        (r"time.*", "string", "time of day as text"), (r"uniqueidentifier", "string", None),
        (r"n?(var)?char.*|n?text|xml", "string", None)],
    "mongodb": [
        (r"bool", "boolean", None), (r"int|long", "bigint", None), (r"double", "double", None),
        (r"decimal", "decimal", None), (r"date|timestamp", "timestamp", None), (r"objectid|string", "string", None),
        (r"bindata", "binary", None), (r"object|array", "json", None)],
}


_SPARK_TYPES = {
    "boolean": T.BooleanType(), "bigint": T.LongType(), "double": T.DoubleType(), "date": T.DateType(),
    "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType(), "string": T.StringType(),
    "binary": T.BinaryType(), "decimal(19,4)": T.DecimalType(19, 4), "decimal(10,4)": T.DecimalType(10, 4),
}


def from_native(system: str, native: str) -> tuple[T.DataType | str, str | None]:
    """The logical type of a native column type, and what is lost (None: nothing)."""
    text = native.strip().lower()
    for pattern, name, lost in NATIVE[system]:
        if re.fullmatch(pattern, text):
            if name == "json":
                return ANY_JSON, lost
            if name == "decimal":
                m = re.search(r"\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)", text)
                if not m:
                    return T.DecimalType(38, 18), "precision not stated"
                p, s = int(m[1]), int(m[2] or 0)
                return (T.DecimalType(p, s), None) if p <= 38 else (T.DecimalType(38, min(s, 38)), "over 38 digits")
            return _SPARK_TYPES[name], lost
    return T.StringType(), f"{native} read as text"


#: DDL types by system and logical kind: type and what is lost (fixed values).
DDL: dict[str, dict[str, tuple[str, str | None]]] = {
    "mysql": {"string": ("text", None), "integer": ("bigint", None), "float": ("double", None),
              "decimal": ("decimal({p},{s})", None), "boolean": ("tinyint(1)", None), "date": ("date", None),
              "timestamp": ("datetime(6)", "zone"), "bytes": ("longblob", None), "json": ("json", None)},
    "postgres": {"string": ("text", None), "integer": ("bigint", None), "float": ("double precision", None),
                 "decimal": ("numeric({p},{s})", None), "boolean": ("boolean", None), "date": ("date", None),
                 "timestamp": ("timestamptz", None), "bytes": ("bytea", None), "json": ("jsonb", None)},
    "mongodb": {"string": ("string", None), "integer": ("long", None), "float": ("double", None),
                "decimal": ("decimal", None), "boolean": ("bool", None), "date": ("date", "a time of day is added"),
                "timestamp": ("date", "microseconds"), "bytes": ("binData", None), "json": ("object", None)},
}


def to_native(system: str, t: T.DataType | str) -> tuple[str, str | None]:
    kind = kind_of(t)
    kind = "json" if kind in ("object", "array") else kind
    name, lost = DDL[system][kind]
    if isinstance(t, T.DecimalType):
        name = name.format(p=t.precision, s=t.scale)
    if isinstance(t, T.TimestampNTZType) and system == "postgres":
        name = "timestamp"
    return name, lost


# --- contracts ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ContractColumn:
    """One column of a target: its name, where it comes from, its type, and whether it is a key or may be null."""

    name: str
    source: str
    type: T.DataType
    key: bool = False
    nullable: bool = True
    json: bool = False


@dataclass(frozen=True)
class Contract:
    columns: tuple[ContractColumn, ...]

    @property
    def keys(self) -> list[str]:
        return [c.name for c in self.columns if c.key]

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.type, c.nullable, {"json": True} if c.json else {})
                             for c in self.columns])


def build_contract(mapping: Sequence[tuple[str, str]], schema: T.StructType, keys: Sequence[str] = ()) -> Contract:
    """The contract of (source, target) pairs over a schema; key columns are not null."""
    missing = [s for s, _ in mapping if s not in schema.names]
    if missing:
        raise BuildError(f"no column {', '.join(missing)}")
    unmapped = [k for k in keys if k not in [t for _, t in mapping]]
    if unmapped:
        raise BuildError(f"key {', '.join(unmapped)} is not mapped")
    return Contract(tuple(
        ContractColumn(t, s, schema[s].dataType, t in keys, schema[s].nullable and t not in keys,
                       bool((schema[s].metadata or {}).get("json"))) for s, t in mapping))


def compare_contract(contract: Contract, target: T.StructType, table: str = "target",
                     system: str = "postgres") -> list[dict]:
    """Differences of an existing table from a contract, with a statement that would mend a missing column. Extra
    columns of the table are fine."""
    out = []
    for c in contract.columns:
        if c.name not in target.names:
            native = to_native(system, ANY_JSON if c.json else c.type)[0]
            out.append({"column": c.name, "problem": "missing", "fix": f"ALTER TABLE {table} ADD COLUMN {c.name} {native}"})
        elif kind_of(target[c.name].dataType) != kind_of(c.type):
            out.append({"column": c.name, "problem": f"is {kind_of(target[c.name].dataType)}, not {kind_of(c.type)}",
                        "fix": None})
    return out


def create_table_sql(contract: Contract, table: str, system: str = "postgres") -> str:
    """DDL of a contract: one key is the primary key, several are unique together."""
    lines = [f"{c.name} {to_native(system, ANY_JSON if c.json else c.type)[0]}{'' if c.nullable else ' NOT NULL'}"
             for c in contract.columns]
    if len(contract.keys) == 1:
        lines.append(f"PRIMARY KEY ({contract.keys[0]})")
    elif contract.keys:
        lines.append(f"UNIQUE ({', '.join(contract.keys)})")
    return f"CREATE TABLE IF NOT EXISTS {table} ({', '.join(lines)})"


_CASTS = {"integer": scalars.to_integer, "float": scalars.to_number, "decimal": scalars.to_number,
          "boolean": scalars.to_boolean, "date": scalars.to_date, "timestamp": scalars.to_timestamp}
_KINDS = {"integer": "number", "float": "number", "decimal": "number", "boolean": "boolean", "date": "date",
          "timestamp": "date", "string": "text"}


def conform(df: DataFrame, contract: Contract, policy: str = "quarantine") -> StepResult:
    """Every column cast to its contract's type, in one pass. Columns that have the type stay as they are. A row in
    which casts fail is rejected once, for the first column of the contract that failed."""
    failures: list[Failure] = []
    made: list[Column] = []
    out: dict[str, Column] = {}
    for i, c in enumerate(contract.columns):
        have, want = kind_of(df.schema[c.name].dataType), kind_of(c.type)
        if have == want or want not in _CASTS:
            continue
        v = _CASTS[want](field(c.name, _KINDS.get(have)))
        cast = f"__cast{i}__"  # made once, for the value and for the failure
        made.append(v.col.alias(cast))
        source = F.col(f"`{c.name}`")
        failures += [Failure(f.function, f.input, source.isNotNull() & F.col(cast).isNull()) for f in v.failures]
        out[c.name] = F.col(cast).cast(c.type)
    own = [F.col(f"`{n}`") for n in df.columns]
    value = Val(F.lit(True), tuple(failures), "boolean")
    return _apply(df.select(*own, *made), "conform", value, policy,
                  lambda d: d.select(*[out.get(n, F.col(f"`{n}`")).alias(n) for n in df.columns]), F.to_json(F.struct(*own)))


def unmapped_fields(df: DataFrame, mapping: Sequence[tuple[str, str]], policy: str = "count") -> list[str]:
    """Columns that no mapping takes; policy ``fail`` refuses them."""
    extra = sorted(set(df.columns) - {s for s, _ in mapping})
    if extra and policy == "fail":
        raise BuildError(f"not mapped: {', '.join(extra)}")
    return extra


def new_columns(before: T.StructType, now: T.StructType) -> list[str]:
    return [n for n in now.names if n not in before.names]


def target_drift(saved: T.StructType, now: T.StructType, mapped: Sequence[str], saved_keys: Sequence[str],
                 keys: Sequence[str], mode: str, modes: Sequence[str]) -> dict[str, list[str]]:
    """What has changed at the target since a job was saved: reasons to stop, and warnings."""
    stop = [f"{c} is gone" for c in mapped if c not in now.names]
    stop += [f"{c} changed its type" for c in mapped if c in now.names and c in saved.names
             and kind_of(saved[c].dataType) != kind_of(now[c].dataType)]
    stop += ["the key changed"] if list(saved_keys) != list(keys) else []
    stop += [f"mode {mode} is not supported"] if mode not in modes else []
    return {"stop": stop, "warn": [f"{c} is new" for c in new_columns(saved, now)]}


def auto_map(source: T.StructType, target: T.StructType, keys: Sequence[str] = ()) -> dict:
    """Targets matched to sources by name, exactly or else ignoring case, spaces, underscores and dashes. Gives the
    mapping, the targets that get nulls, and errors."""
    def plain(n: str) -> str:
        return re.sub(r"[\s_-]", "", n).lower()

    loose: dict[str, list[str]] = {}
    for n in source.names:
        loose.setdefault(plain(n), []).append(n)
    mapping, nulls, errors = [], [], []
    taken: dict[str, str] = {}
    for t in target.names:
        found = t if t in source.names else next(iter(loose.get(plain(t), [])), None)
        if found is None:
            (errors if t in keys else nulls).append(f"key {t} is not mapped" if t in keys else t)
            continue
        if found in taken:
            errors.append(f"{found} would feed {taken[found]} and {t}")
            continue
        taken[found] = t
        a, b = kind_of(source[found].dataType), kind_of(target[t].dataType)
        if a != b and (a, b) not in CONVERTIBLE:
            errors.append(f"{found} is {a}, {t} is {b}")
        mapping.append((found, t))
    return {"mapping": mapping, "nulls": nulls, "errors": errors}


#: Pairs of kinds that a value can be delivered across (fixed values).
CONVERTIBLE = frozenset([
    ("integer", "float"), ("integer", "decimal"), ("decimal", "float"), ("float", "decimal"), ("date", "timestamp"),
    ("integer", "string"), ("float", "string"), ("decimal", "string"), ("boolean", "string"), ("date", "string"),
    ("timestamp", "string"),
])


def resolve_entity(entities: Mapping[str, Sequence[str]], fields: Sequence[str]) -> str:
    """The one table that has all the fields."""
    found = [n for n, have in entities.items() if set(fields) <= set(have)]
    if len(found) != 1:
        raise BuildError("no table has all fields" if not found else f"ambiguous: {', '.join(sorted(found))}")
    return found[0]


def stable_hash(value) -> str:
    """SHA-256 of a value as canonical JSON: a contract, steps, a schema, a job's definition."""
    if isinstance(value, T.DataType):
        value = json.loads(value.json())
    if isinstance(value, Contract):
        value = [[c.name, c.source, c.type.simpleString(), c.key, c.nullable, c.json] for c in value.columns]
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


# --- documents as they come ---------------------------------------------------------------------------------------------


def _leaves(kind: T.DataType, path: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], T.DataType]]:
    """The leaves of a type. An object with a name that no path can say, with both kinds of quotes, is one leaf."""
    if isinstance(kind, T.StructType) and kind.fields and not any("'" in n and '"' in n for n in kind.names):
        return [x for f in kind.fields for x in _leaves(f.dataType, (*path, f.name))]
    return [(path, kind)]


def _at(path: Sequence[str]) -> str:
    """A path as ``variant_get`` takes it."""
    return "$" + "".join(f'["{p}"]' if "'" in p else f"['{p}']" for p in path)


def _is_object(v: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT<")), F.lit(False))


def inferred_documents(df: DataFrame, column: str) -> T.DataType:
    """The type of the JSON objects in a text column, with every key that any of them has: one aggregation, whose result
    is a type, whatever the number of rows. Other texts do not count, and values that clash become variants."""
    rows = df.select(F.try_parse_json(f"`{column}`").alias("v"))
    text = rows.agg(F.schema_of_variant_agg(F.when(_is_object("v"), F.col("v")))).first()[0] or "VOID"
    return T._parse_datatype_string(text.replace("OBJECT<", "STRUCT<"))


def document_presence(df: DataFrame, column: str, kind: T.DataType | None = None) -> DataFrame:
    """(path, type, n_present, share) of each leaf of the documents in a JSON column: in how many it has a value."""
    kind = inferred_documents(df, column) if kind is None else kind
    leaves = [x for x in _leaves(kind) if x[0]]
    if not leaves:
        return df.sparkSession.createDataFrame([], "path string, type string, n_present bigint, share double")
    rows = df.select(F.try_parse_json(f"`{column}`").alias("v"))
    present = [F.variant_get("v", F.lit(_at(p)), "variant") for p, _ in leaves]
    structs = [F.struct(F.lit(".".join(p)).alias("path"), F.lit(k.simpleString()).alias("type"),
                        F.count_if(v.isNotNull() & ~F.is_variant_null(v)).alias("n_present"), F.count(F.lit(1)).alias("n"))
               for (p, k), v in zip(leaves, present)]
    return rows.agg(F.array(*structs).alias("x")).select(F.explode("x").alias("x")).select(
        "x.path", "x.type", "x.n_present", F.try_divide("x.n_present", "x.n").alias("share"))


def flattened_documents(df: DataFrame, column: str, kind: T.DataType | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): a JSON text column as one column a leaf, under dotted names, with the keys of all rows; arrays
    and clashing values become JSON text. A text that is neither null nor an object is rejected as
    ``flatten_non_object``. One pass, given the type."""
    kind = inferred_documents(df, column) if kind is None else kind
    parsed = df.withColumn("_v", F.try_parse_json(f"`{column}`"))
    odd = F.col(f"`{column}`").isNotNull() & ~(_is_object("_v") | F.coalesce(F.is_variant_null("_v"), F.lit(False)))
    out = [F.col(f"`{c}`") for c in df.columns if c != column]
    for path, k in _leaves(kind):
        if path:
            plain = not isinstance(k, (T.ArrayType, T.VariantType, T.NullType, T.StructType))
            v = F.variant_get("_v", F.lit(_at(path)), "variant")
            c = F.try_variant_get("_v", F.lit(_at(path)), k.simpleString()) if plain else F.when(~F.is_variant_null(v), F.to_json(v))
            out.append(c.alias(f"{column}.{'.'.join(path)}"))
    rejects = parsed.where(odd).select(F.lit("flatten_non_object").alias("function"), F.col(f"`{column}`").alias("input_value"))
    return parsed.where(~odd).select(*out), rejects

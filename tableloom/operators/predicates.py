"""Row predicates, named parameters and relative dates for filters."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import BuildError

OPERATORS = ("eq", "neq", "gt", "gte", "lt", "lte", "contains", "in", "between", "starts_with", "is_null",
             "is_not_null")
#: Values that an ``in`` takes at most.
IN_VALUES = 1000


@dataclass(frozen=True)
class Predicate:
    """A test of one column. ``value`` is a literal, a list for ``in``, a pair for ``between`` or a ``Parameter``."""

    column: str
    op: str
    value: object = None
    ignore_case: bool = False


@dataclass(frozen=True)
class Parameter:
    """A named value that is bound when the filter is used."""

    name: str


def condition(p: Predicate) -> Column:
    c, v = F.col(f"`{p.column}`"), p.value
    if p.op == "eq":
        return c == v
    if p.op == "neq":
        return c != v
    if p.op == "gt":
        return c > v
    if p.op == "gte":
        return c >= v
    if p.op == "lt":
        return c < v
    if p.op == "lte":
        return c <= v
    if p.op == "contains":
        return F.contains(F.lower(c), F.lower(F.lit(v))) if p.ignore_case else F.contains(c, F.lit(v))
    if p.op == "in":
        if not 1 <= len(v) <= IN_VALUES:
            raise BuildError(f"in takes 1 to {IN_VALUES} values")
        return c.isin(*v)
    if p.op == "between":
        return c.between(*v)
    if p.op == "starts_with":
        return F.startswith(c, F.lit(v))
    if p.op == "is_null":
        return c.isNull()
    if p.op == "is_not_null":
        return c.isNotNull()
    raise BuildError(f"no operator {p.op!r}")


def all_of(predicates: Sequence[Predicate]) -> Column:
    """All hold; an empty list keeps every row."""
    return reduce(lambda a, b: a & b, [condition(p) for p in predicates], F.lit(True))


def where_all(df: DataFrame, predicates: Sequence[Predicate]) -> DataFrame:
    """Rows that meet all predicates; unknown columns are refused."""
    for p in predicates:
        if p.column not in df.columns:
            raise BuildError(f"no column {p.column}")
    return df.where(all_of(predicates)) if predicates else df


def search(df: DataFrame, text: str | None, columns: Sequence[str]) -> DataFrame:
    """Rows in which one of the columns holds the text, ignoring case; without text all rows."""
    if not text:
        return df
    found = [F.contains(F.lower(F.col(f"`{c}`")), F.lit(text.lower())) for c in columns]
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(f, F.lit(False)) for f in found]))


def date_range(df: DataFrame, column: str, start=None, end=None, **equal) -> DataFrame:
    """Rows from ``start`` up to before ``end`` and with the given values; each part is optional."""
    c = F.col(f"`{column}`")
    if start is not None:
        df = df.where(c >= F.lit(start))
    if end is not None:
        df = df.where(c < F.lit(end))
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(f"`{name}`") == F.lit(value))
    return df


_RELATIVE = re.compile(r"^(today|startOfMonth|startOfYear)(?:([+-])(\d+)([dmy]))?$")


def relative_date(token: str, zone: str = "UTC", now: dt.datetime | None = None) -> dt.date:
    """``today``, ``today-7d``, ``startOfMonth-1m``, ``startOfYear-2y`` in a zone."""
    m = _RELATIVE.match(token)
    if not m:
        raise BuildError(f"no relative date {token!r}")
    base, sign, n, unit = m.groups()
    day = (now or dt.datetime.now(dt.timezone.utc)).astimezone(ZoneInfo(zone)).date()
    steps = int(n or 0) * (-1 if sign == "-" else 1)
    allowed = {"today": "d", "startOfMonth": "m", "startOfYear": "y"}[base]
    if unit and unit != allowed:
        raise BuildError(f"{base} moves by {allowed}, not {unit}")
    if base == "today":
        return day + dt.timedelta(days=steps)
    if base == "startOfMonth":
        months = day.year * 12 + day.month - 1 + steps
        return dt.date(months // 12, months % 12 + 1, 1)
    return dt.date(day.year + steps, 1, 1)


def bind(predicates: Sequence[Predicate], schema: T.StructType, values: dict[str, object], zone: str = "UTC",
         now: dt.datetime | None = None) -> list[Predicate]:
    """Parameters replaced by their values. A missing value, a value of the wrong type and a relative date for a
    column that holds no dates are refused."""
    out = []
    for p in predicates:
        v = p.value
        if isinstance(v, Parameter):
            if v.name not in values:
                raise BuildError(f"no value for {v.name}")
            v = values[v.name]
        kind = schema[p.column].dataType
        if isinstance(v, str) and _RELATIVE.match(v):
            if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
                v = relative_date(v, zone, now)
            elif not isinstance(kind, T.StringType):
                raise BuildError(f"{p.column} holds no dates")
        for x in v if isinstance(v, (list, tuple)) else [v]:
            _check(p.column, kind, x)
        out.append(Predicate(p.column, p.op, v, p.ignore_case))
    return out


def _check(column: str, kind: T.DataType, value) -> None:
    if value is None:
        return
    ok = {
        T.StringType: (str,), T.BooleanType: (bool,), T.DateType: (dt.date, str), T.TimestampType: (dt.date, str),
        T.TimestampNTZType: (dt.date, str),
    }.get(type(kind))
    if ok is None and isinstance(kind, T.NumericType):
        ok = (int, float)
    if ok and (not isinstance(value, ok) or isinstance(value, bool) and bool not in ok):
        raise BuildError(f"{column} takes no {type(value).__name__}")

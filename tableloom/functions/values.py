"""Values that remember how they can fail.

A ``Val`` is a Spark column together with the fallible calls that made it. A call has *failed* in a row when all its
arguments are non-null and its result is null; null input never fails. All of it stays ordinary Catalyst
expressions, so a step that checks failures runs in the same code as the step itself.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class BuildError(ValueError):
    """An expression that is refused when it is built: wrong kinds, arity or arguments."""


@dataclass(frozen=True)
class Failure:
    """One fallible call: its name, its first argument and whether it failed; ``result`` is what it gives, where it
    fails just if that is null and the input is not."""

    function: str
    input: Column
    failed: Column
    result: Column | None = None


@dataclass(frozen=True, eq=False)
class Val:
    """A column, its fallible calls, and its kind where known: number, text, boolean, date or json."""

    col: Column
    failures: tuple[Failure, ...] = ()
    kind: str | None = None

    def __add__(self, other):
        return _arithmetic("+", self, other)

    def __radd__(self, other):
        return _arithmetic("+", other, self)

    def __sub__(self, other):
        return _arithmetic("-", self, other)

    def __rsub__(self, other):
        return _arithmetic("-", other, self)

    def __mul__(self, other):
        return _arithmetic("*", self, other)

    def __rmul__(self, other):
        return _arithmetic("*", other, self)

    def __truediv__(self, other):
        return _arithmetic("/", self, other)

    def __rtruediv__(self, other):
        return _arithmetic("/", other, self)

    def __neg__(self):
        return Val(-self.col, self.failures, "number")

    def __eq__(self, other):
        return _compare(self, other, lambda a, b: a == b)

    def __ne__(self, other):
        return _compare(self, other, lambda a, b: a != b)

    def __lt__(self, other):
        return _compare(self, other, lambda a, b: a < b)

    def __le__(self, other):
        return _compare(self, other, lambda a, b: a <= b)

    def __gt__(self, other):
        return _compare(self, other, lambda a, b: a > b)

    def __ge__(self, other):
        return _compare(self, other, lambda a, b: a >= b)

    def __and__(self, other):
        return _logic(self, other, lambda a, b: a & b)

    def __or__(self, other):
        return _logic(self, other, lambda a, b: a | b)

    def __invert__(self):
        a = _boolean(self)
        return Val(~a.col, a.failures, "boolean")

    def __bool__(self):
        raise BuildError("use & | ~ on expressions, not and / or / not")

    @property
    def failed(self) -> Column:
        """Whether any of the calls failed in a row."""
        return reduce(lambda a, b: a | b, [f.failed for f in self.failures], F.lit(False))

    @property
    def failed_function(self) -> Column:
        """Name of the first call that failed, else null."""
        return F.coalesce(*[F.when(f.failed, F.lit(f.function)) for f in self.failures], F.lit(None).cast("string"))

    @property
    def failed_input(self) -> Column:
        """First argument, as text, of the first call that failed."""
        return F.coalesce(*[F.when(f.failed, f.input.cast("string")) for f in self.failures],
                          F.lit(None).cast("string"))


def field(name: str, kind: str | None = None) -> Val:
    """A column of the table."""
    return Val(F.col(f"`{name}`"), (), kind)


def literal(value) -> Val:
    """A string, number, boolean or null."""
    if value is not None and not isinstance(value, (str, int, float, bool)):
        raise BuildError(f"no literal of type {type(value).__name__}")
    kind = None if value is None else "boolean" if isinstance(value, bool) else "text" if isinstance(value, str) else "number"
    return Val(F.lit(value), (), kind)


def val(x) -> Val:
    """A ``Val`` of whatever may stand in an expression: a value, a column, a Python literal."""
    if isinstance(x, Val):
        return x
    if isinstance(x, Column):
        return Val(x)
    return literal(x)


def join_failures(*values: Val) -> tuple[Failure, ...]:
    return tuple(f for v in values for f in v.failures)


def fallible(function: str, result: Column, *arguments: Val, kind: str | None) -> Val:
    """The result of a call that can fail, with the failures of its arguments before its own."""
    present = reduce(lambda a, b: a & b, [a.col.isNotNull() for a in arguments])
    own = Failure(function, arguments[0].col, present & result.isNull(), result if len(arguments) == 1 else None)
    return Val(result, (*join_failures(*arguments), own), kind)


def _same_kind(a: Val, b: Val, what: str) -> None:
    if a.kind and b.kind and a.kind != b.kind:
        raise BuildError(f"{what} of {a.kind} and {b.kind}")


def _arithmetic(op: str, a, b) -> Val:
    a, b = val(a), val(b)
    for x in (a, b):
        if x.kind not in (None, "number"):
            raise BuildError(f"{op} needs numbers, not {x.kind}")
    if op == "/":
        col = F.try_divide(a.col, b.col)
    else:
        col = {"+": a.col + b.col, "-": a.col - b.col, "*": a.col * b.col}[op]
    return Val(col, join_failures(a, b), "number")


def _compare(a, b, op) -> Val:
    a, b = val(a), val(b)
    _same_kind(a, b, "comparison")
    return Val(op(a.col, b.col), join_failures(a, b), "boolean")


def _boolean(x) -> Val:
    x = val(x)
    if x.kind not in (None, "boolean"):
        raise BuildError(f"a condition is needed, not {x.kind}")
    return x


def _logic(a, b, op) -> Val:
    a, b = _boolean(a), _boolean(b)
    return Val(op(a.col, b.col), join_failures(a, b), "boolean")


def if_(condition, then, otherwise) -> Val:
    """``then`` where the condition is true, else ``otherwise`` (also where it is null)."""
    return ifs(condition, then, otherwise)


def ifs(*parts) -> Val:
    """``ifs(c1, v1, c2, v2, ..., otherwise)``."""
    if len(parts) < 3 or len(parts) % 2 == 0:
        raise BuildError("ifs takes pairs of condition and value, and a value for the rest")
    *pairs, otherwise = parts
    otherwise = val(otherwise)
    conditions = [_boolean(c) for c in pairs[::2]]
    results = [val(v) for v in pairs[1::2]]
    for r in results:
        _same_kind(r, otherwise, "branches")
    # a branch can fail only where it is taken
    taken, before = [], F.lit(False)
    for c in conditions:
        here = F.coalesce(c.col, F.lit(False))
        taken.append(here & ~before)
        before = before | here
    failures = join_failures(*conditions)
    for r, where in zip([*results, otherwise], [*taken, ~before]):
        failures += tuple(Failure(f.function, f.input, where & f.failed) for f in r.failures)
    out = F.when(conditions[0].col, results[0].col)
    for c, r in zip(conditions[1:], results[1:]):
        out = out.when(c.col, r.col)
    kind = next((r.kind for r in [*results, otherwise] if r.kind), None)
    return Val(out.otherwise(otherwise.col), failures, kind)


def switch(x, *parts) -> Val:
    """``switch(x, v1, r1, v2, r2, ..., otherwise)``."""
    if len(parts) < 3 or len(parts) % 2 == 0:
        raise BuildError("switch takes pairs of value and result, and a result for the rest")
    x = val(x)
    *pairs, otherwise = parts
    out = []
    for v, r in zip(pairs[::2], pairs[1::2]):
        out += [x == v, r]
    return ifs(*out, otherwise)

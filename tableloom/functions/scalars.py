"""The scalar functions: 62 in all, with exactly specified edges.

Null in gives null out unless a function says otherwise. Numbers are doubles; rounding is half away from zero on the
double product; text is measured in code points; dates are timestamps in the session's zone (UTC).
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .values import BuildError, Failure, Val, fallible, join_failures, val

#: ASCII white space, which is all that trim and canonicalize know.
BLANKS = " \t\n\r\f\v"
#: Words for a missing value, lower case (fixed values).
MISSING_TOKENS = ("n/a", "na", "null", "none", "nil", "-", "?", "#n/a")

_PLAIN_NUMBER = r"^-?[0-9]+(\.[0-9]+)?$"
_DIGITS = "0123456789"
#: A day and a clock time, in which 9 stands for any digit.
_DAY, _CLOCK = "9999-99-99", "99:99:99"


def _num(x) -> tuple[Val, Column]:
    v = val(x)
    if v.kind not in (None, "number"):
        raise BuildError(f"a number is needed, not {v.kind}")
    return v, v.col.cast("double")


def _text(x) -> tuple[Val, Column]:
    v = val(x)
    if v.kind not in (None, "text"):
        raise BuildError(f"a text is needed, not {v.kind}")
    return v, v.col.cast("string")


def _fixed(x, what: str, kinds=(str,)):
    if not isinstance(x, kinds) or isinstance(x, bool) and bool not in kinds:
        raise BuildError(f"{what} must be a Python literal")
    return x


def _number(col: Column, *of: Val) -> Val:
    return Val(col, join_failures(*of), "number")


def _string(col: Column, *of: Val) -> Val:
    return Val(col, join_failures(*of), "text")


def _truth(col: Column, *of: Val) -> Val:
    return Val(col, join_failures(*of), "boolean")


def _whole(x: Column) -> Column:
    """Toward zero, as a double: F.floor would saturate at the largest bigint."""
    return x - x % F.lit(1.0)


def _floor(x: Column) -> Column:
    t = _whole(x)
    return F.when(x < t, t - 1).otherwise(t)


def _strip(s: Column) -> Column:
    return F.btrim(s, F.lit(BLANKS))


# --- null handling and tests -------------------------------------------------------------------------------------


def concat(*xs) -> Val:
    """Joined texts; null counts as empty."""
    vs = [val(x) for x in xs]
    return _string(F.concat(*[F.coalesce(_as_text(v), F.lit("")) for v in vs]), *vs)


def coalesce(*xs) -> Val:
    """The first that is not null. A last argument that cannot fail makes the whole safe; else it is one call."""
    vs = [val(x) for x in xs]
    kinds = {v.kind for v in vs if v.kind}
    if len(kinds) > 1:
        raise BuildError(f"coalesce of {sorted(kinds)}")
    col, kind = F.coalesce(*[v.col for v in vs]), next(iter(kinds), None)
    if not vs[-1].failures:
        return Val(col, (), kind)
    first = join_failures(*vs)
    failed = col.isNull() & Val(col, first).failed
    return Val(col, (Failure("coalesce", first[0].input, failed),), kind)


def is_null(x) -> Val:
    return Val(val(x).col.isNull(), (), "boolean")


def is_not_null(x) -> Val:
    return Val(val(x).col.isNotNull(), (), "boolean")


def is_missing_token(x) -> Val:
    """Blank text or a word for a missing value; false for all else, never null."""
    v = val(x)
    if v.kind not in (None, "text"):
        return _truth(F.lit(False), v)
    s = _strip(v.col.cast("string"))
    short = F.length(s) <= max(map(len, MISSING_TOKENS))
    return _truth(F.coalesce((s == "") | short & F.lower(s).isin(*MISSING_TOKENS), F.lit(False)), v)


def contains(text, needle, ignore_case: bool = False) -> Val:
    """Literal search; false where the text is null or no text."""
    v, n = val(text), val(needle)
    if v.kind not in (None, "text"):
        return _truth(F.lit(False), v, n)
    a, b = v.col.cast("string"), n.col.cast("string")
    if ignore_case:
        a, b = F.lower(a), F.lower(b)
    return _truth(F.coalesce(F.contains(a, b), F.lit(False)), v, n)


def is_number(x) -> Val:
    v = val(x)
    numeric = F.typeof(v.col).rlike("^(tinyint|smallint|int|bigint|float|double|decimal)")
    return _truth(numeric & v.col.isNotNull(), v)


def is_text(x) -> Val:
    v = val(x)
    return _truth((F.typeof(v.col) == "string") & v.col.isNotNull(), v)


def looks_numeric(x) -> Val:
    v = val(x)
    if v.kind == "number":
        return _truth(v.col.isNotNull(), v)
    return _truth(F.coalesce(v.col.cast("string").rlike(_PLAIN_NUMBER), F.lit(False)), v)


# --- numbers -----------------------------------------------------------------------------------------------------


def abs_(x) -> Val:
    v, c = _num(x)
    return _number(F.abs(c), v)


def sign(x) -> Val:
    v, c = _num(x)
    return _number(F.signum(c), v)


def floor(x) -> Val:
    v, c = _num(x)
    return _number(_floor(c), v)


int_ = floor


def ceil(x) -> Val:
    v, c = _num(x)
    t = _whole(c)
    return _number(F.when(c > t, t + 1).otherwise(t), v)


def trunc(x) -> Val:
    v, c = _num(x)
    return _number(_whole(c), v)


def sqrt(x) -> Val:
    v, c = _num(x)
    return _number(F.when(c >= 0, F.sqrt(c)), v)


def power(a, b) -> Val:
    (va, a), (vb, b) = _num(a), _num(b)
    return _number(F.pow(a, b), va, vb)


def divide(n, d, default=None) -> Val:
    """The quotient; where the divisor is 0, ``default`` or null."""
    (vn, n), (vd, d) = _num(n), _num(d)
    other = val(default)
    out = F.when(n.isNull() | d.isNull(), F.lit(None).cast("double")).when(d == 0, other.col.cast("double"))
    return _number(out.otherwise(F.try_divide(n, d)), vn, vd, other)


def mod(n, d) -> Val:
    """The remainder with the divisor's sign; null for divisor 0."""
    (vn, n), (vd, d) = _num(n), _num(d)
    return _number(F.when(d != 0, n - d * _floor(F.try_divide(n, d))), vn, vd)


def quotient(n, d) -> Val:
    (vn, n), (vd, d) = _num(n), _num(d)
    return _number(F.when(d != 0, _whole(F.try_divide(n, d))), vn, vd)


def _scaled(x, digits, turn) -> Val:
    (v, c), (vd, d) = _num(x), _num(digits)
    scale = F.pow(F.lit(10.0), d)
    return _number(F.signum(c) * turn(F.abs(c) * scale) / scale, v, vd)


def round_(x, digits=0) -> Val:
    return _scaled(x, digits, lambda a: _whole(a + 0.5))


def round_up(x, digits=0) -> Val:
    """Away from zero."""
    return _scaled(x, digits, lambda a: F.when(a > _whole(a), _whole(a) + 1).otherwise(a))


def round_down(x, digits=0) -> Val:
    return _scaled(x, digits, _whole)


def round_to_multiple(x, m) -> Val:
    """The nearest multiple, half away from zero; multiple 0 gives 0."""
    (v, c), (vm, m) = _num(x), _num(m)
    q = F.try_divide(c, m)
    out = F.when(m == 0, F.lit(0.0)).otherwise(F.signum(q) * _whole(F.abs(q) + 0.5) * m)
    return _number(F.when(c.isNotNull() & m.isNotNull(), out), v, vm)


def exp(x) -> Val:
    v, c = _num(x)
    return _number(F.exp(c), v)


def ln(x) -> Val:
    v, c = _num(x)
    return _number(F.when(c > 0, F.log(c)), v)


def log(x, base=10) -> Val:
    (v, c), (vb, b) = _num(x), _num(base)
    return _number(F.when((c > 0) & (b > 0) & (b != 1), F.log(c) / F.log(b)), v, vb)


# --- text --------------------------------------------------------------------------------------------------------


def upper(x) -> Val:
    v, s = _text(x)
    return _string(F.upper(s), v)


def lower(x) -> Val:
    v, s = _text(x)
    return _string(F.lower(s), v)


def trim(x) -> Val:
    v, s = _text(x)
    return _string(_strip(s), v)


def len_(x) -> Val:
    v, s = _text(x)
    return _number(F.length(s).cast("double"), v)


def _count(x) -> tuple[Val, Column]:
    v, c = _num(x)
    return v, F.greatest(_whole(c), F.lit(0.0)).cast("int")


def left(x, n) -> Val:
    (v, s), (vn, n) = _text(x), _count(n)
    return _string(F.left(s, n), v, vn)


def right(x, n) -> Val:
    (v, s), (vn, n) = _text(x), _count(n)
    return _string(F.when(n == 0, F.when(s.isNotNull(), "")).otherwise(F.right(s, n)), v, vn)


def mid(x, start, n) -> Val:
    """From the 1-based place ``start`` (at least 1), ``n`` characters (at least 0)."""
    (v, s), (vs, a), (vn, n) = _text(x), _num(start), _count(n)
    return _string(F.substring(s, F.greatest(_whole(a), F.lit(1.0)).cast("int"), n), v, vs, vn)


def substitute(x, old, new) -> Val:
    """Every occurrence, literally; an empty ``old`` changes nothing."""
    (v, s), (va, a), (vb, b) = _text(x), _text(old), _text(new)
    out = F.when(a == "", s).otherwise(F.replace(s, a, b))
    return _string(F.when(a.isNotNull() & b.isNotNull(), out), v, va, vb)


def find(needle, text, ignore_case: bool = False) -> Val:
    """1-based place of the first occurrence, 0 if there is none; an empty needle is at 1."""
    (va, a), (vb, b) = _text(needle), _text(text)
    if ignore_case:
        a, b = F.lower(a), F.lower(b)
    return _number(F.position(a, b).cast("double"), va, vb)


def rept(x, n) -> Val:
    """Repeated; the count is held in [0, 1000]."""
    (v, s), (vn, n) = _text(x), _count(n)
    return _string(F.repeat(s, F.least(n, F.lit(1000))), v, vn)


def split(x, delimiter, i) -> Val:
    """The 1-based i-th part; null beyond the parts."""
    (v, s), (vd, d), (vi, i) = _text(x), _text(delimiter), _num(i)
    place = _whole(i).cast("int")
    parts = F.when(d == "", F.lit(1)).otherwise(
        F.try_divide(F.length(s) - F.length(F.replace(s, d, F.lit(""))), F.length(d)).cast("int") + 1)
    safe = F.greatest(place, F.lit(1))
    return _string(F.when((place >= 1) & (place <= parts), F.when(d == "", s).otherwise(F.split_part(s, d, safe))), v, vd, vi)


def regex_match(x, pattern: str, ignore_case: bool = False) -> Val:
    v, s = _text(x)
    return _truth(s.rlike(("(?i)" if ignore_case else "") + _fixed(pattern, "a pattern")), v)


def regex_extract(x, pattern: str, group: int = 0) -> Val:
    """The group of the first match; null without a match."""
    v, s = _text(x)
    if not 0 <= group <= re.compile(_fixed(pattern, "a pattern")).groups:
        raise BuildError(f"the pattern has no group {group}")
    return _string(F.when(s.rlike(pattern), F.regexp_extract(s, pattern, group)), v)


def regex_replace(x, pattern: str, replacement: str, ignore_case: bool = False) -> Val:
    """Every match; ``\\1`` in the replacement stands for a group, ``$`` for itself."""
    v, s = _text(x)
    java = re.sub(r"\\([1-9])", r"$\1", _fixed(replacement, "a replacement").replace("$", r"\$"))
    return _string(F.regexp_replace(s, ("(?i)" if ignore_case else "") + _fixed(pattern, "a pattern"), java), v)


def canonicalize(x) -> Val:
    """Runs of white space become one space; none at the ends."""
    v, s = _text(x)
    return _string(F.btrim(F.regexp_replace(s, r"[ \t\n\r\f\x0B]+", " ")), v)


@pandas_udf(StringType())
def _without_accents(s: pd.Series) -> pd.Series:
    def bare(t):
        return None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if not "̀" <= c <= "ͯ")

    return s.map(bare)


def strip_accents(x) -> Val:
    """Canonical decomposition without combining marks (the one function that needs Python: Spark has no NFD)."""
    v, s = _text(x)
    return _string(_without_accents(s), v)


# --- coercions ---------------------------------------------------------------------------------------------------


def _finite(n: Column) -> Column:
    return F.when(F.abs(n) < float("inf"), n)  # no number is greater than any


def _to_double(s: Column, exponent: bool = True) -> Column:
    """Digits with a sign, a point and an exponent of up to four digits; the cast tells whether they are in order. A
    look at the first character rules most other texts out. The text is named as seldom as can be: each time repeats
    the expression that it is."""
    known = F.left(s, F.lit(1)).isin(*_DIGITS, *"+-.") & F.translate(s, _DIGITS + "+-.", "").isin("", *"eE"[: 2 * exponent])
    if exponent:
        known = known & ~s.rlike("[eE][+-]?[0-9]{5}")
    return _finite(F.when(known, s.try_cast("double")))


def _as_number(v: Val) -> Column:
    if v.kind == "boolean":
        return F.lit(None).cast("double")
    if v.kind == "number":
        return _finite(v.col.cast("double"))
    return _to_double(_strip(v.col.cast("string")))


def to_number(x) -> Val:
    v = val(x)
    return fallible("to_number", _as_number(v), v, kind="number")


def to_integer(x) -> Val:
    """Toward zero; null beyond the range of bigint."""
    v = val(x)
    n = _as_number(v)
    return fallible("to_integer", F.when(F.abs(n) < 9.2e18, _whole(n).cast("bigint")), v, kind="number")


def _decimal_text(c: Column, digits: int) -> Column:
    """Half away from zero, exactly ``digits`` decimals, no exponent."""
    scale = float(10**digits)
    scaled = _whole(F.abs(c) * scale + 0.5)
    body = (scaled.cast("decimal(38,0)") / F.lit(10**digits).cast("decimal(38,0)")).cast(f"decimal(38,{digits})")
    return F.concat(F.when((c < 0) & (scaled != 0), "-").otherwise(""), body.cast("string"))


def _as_text(v: Val) -> Column:
    if v.kind == "text":
        return v.col.cast("string")
    if v.kind == "boolean":
        return F.when(v.col, "true").when(~v.col, "false")
    if v.kind == "number":
        six = _decimal_text(v.col.cast("double"), 6)
        return F.regexp_replace(F.regexp_replace(six, r"0+$", ""), r"\.$", "")
    return v.col.cast("string")


def to_text(x) -> Val:
    """Booleans as true / false; numbers with at most six decimals and no exponent."""
    v = val(x)
    return _string(_as_text(v), v)


def format_number(x, digits: int) -> Val:
    """Exactly ``digits`` (0 to 10) decimals, padded, without marks between thousands."""
    v = val(x)
    digits = min(max(int(_fixed(digits, "digits", (int,))), 0), 10)
    return _string(_decimal_text(_as_number(v), digits), v)


def to_boolean(x) -> Val:
    v = val(x)
    if v.kind == "boolean":
        out = v.col
    elif v.kind == "number":
        out = F.when(v.col == 1, True).when(v.col == 0, False)
    else:
        s = F.lower(_strip(v.col.cast("string")))
        out = F.when(s.isin("true", "1"), True).when(s.isin("false", "0"), False)
    return fallible("to_boolean", out, v, kind="boolean")


def _fits(s: Column, *shapes: str) -> Column:
    """Whether a text has one of some shapes: the same length and marks, and a digit for each 9."""
    return F.length(s).isin(*{len(x) for x in shapes}) & F.translate(s, _DIGITS[:9], "9" * 9).isin(*shapes)


def _made(y, mo, d, h, mi, se) -> Column:
    """A timestamp of texts, null if there is no such time (seconds under 60)."""
    def whole(x):
        return F.coalesce(x.try_cast("int"), F.lit(0))

    second = whole(se)
    return F.when(second < 60, F.try_make_timestamp(whole(y), whole(mo), whole(d), whole(h), whole(mi), second))


#: Shapes of a day and of a day with a clock time; each may end in the mark of UTC.
_TIMES = [_DAY, f"{_DAY}T{_CLOCK}", f"{_DAY} {_CLOCK}"]
_DATES = [*_TIMES, *[x + "Z" for x in _TIMES]]
_STAMPS = [*_DATES, *[x + "." + "9" * n + end for x in _TIMES[1:] for n in range(1, 7) for end in ("", "Z")]]


def _stamp(s: Column) -> Column:
    """The time that a day, or a day and a clock time, tells in the first 19 characters."""
    return _made(*[F.substring(s, at, n) for at, n in ((1, 4), (6, 2), (9, 2), (12, 2), (15, 2), (18, 2))])


def _as_date(v: Val) -> Column:
    if v.kind == "date":
        return F.date_trunc("second", v.col.cast("timestamp"))
    s = _strip(v.col.cast("string"))
    return F.when(_fits(s, *_DATES), _stamp(s))


def to_date(x) -> Val:
    """ISO text (a time needs its seconds) as a timestamp; impossible days fail."""
    v = val(x)
    return fallible("to_date", _as_date(v), v, kind="date")


def to_timestamp(x) -> Val:
    """As to_date, with a fraction that is cut to milliseconds."""
    v = val(x)
    if v.kind == "date":
        return fallible("to_timestamp", F.date_trunc("millisecond", v.col.cast("timestamp")), v, kind="date")
    s = _strip(v.col.cast("string"))
    millis = F.rpad(F.translate(F.substring(s, 21, 3), "Z", ""), 3, "0").try_cast("int")
    out = F.when(_fits(s, *_STAMPS), F.timestamp_add("MILLISECOND", millis, _stamp(s)))
    return fallible("to_timestamp", out, v, kind="date")


#: Tokens of date formats and the places of their values.
DATE_TOKENS = {"YYYY": 0, "MM": 1, "DD": 2, "HH": 3, "mm": 4, "ss": 5}


def _date_shape(fmt: str) -> tuple[str, dict[int, tuple[int, int]]]:
    """A format's shape, and for each value its place and width: all tokens have a fixed width."""
    shape, where, at = "", {}, 0
    while at < len(fmt):
        token = next((t for t in DATE_TOKENS if fmt.startswith(t, at)), None)
        if token:
            where[DATE_TOKENS[token]] = (at + 1, len(token))
        shape += "9" * len(token) if token else fmt[at]
        at += len(token) if token else 1
    return shape, where


def parse_date(x, fmt: str) -> Val:
    """Text in a fixed format of YYYY MM DD HH mm ss and literal characters, of which 9 may not be one."""
    v = val(x)
    shape, where = _date_shape(_fixed(fmt, "a format"))
    if "9" in fmt:
        raise BuildError("a format has no 9 of its own")
    s = _strip(v.col.cast("string"))
    parts = [F.lit("1970"), F.lit("1"), F.lit("1"), F.lit(""), F.lit(""), F.lit("")]
    for place, (at, width) in where.items():
        parts[place] = F.substring(s, at, width)
    return fallible("parse_date", F.when(_fits(s, shape), _made(*parts)), v, kind="date")


def parse_number(x, decimal_mark: str = ".") -> Val:
    """Text with the given decimal mark; the other mark stands between thousands; no exponents."""
    v = val(x)
    if _fixed(decimal_mark, "a mark") not in (".", ","):
        raise BuildError("the decimal mark is . or ,")
    if v.kind == "number":
        return fallible("parse_number", _as_number(v), v, kind="number")
    bare = _strip(v.col.cast("string"))
    s = F.translate(bare, ",", "") if decimal_mark == "." else F.translate(bare, ",.", ".")
    return fallible("parse_number", _to_double(s, exponent=False), v, kind="number")


# --- dates -------------------------------------------------------------------------------------------------------


def _date_part(name: str):
    def part(x) -> Val:
        v = val(x)
        return _number(getattr(F, name)(_as_date(v)).cast("double"), v)

    part.__name__ = name
    return part


year, month, hour, minute, second, quarter = (
    _date_part(n) for n in ("year", "month", "hour", "minute", "second", "quarter"))


def day(x) -> Val:
    v = val(x)
    return _number(F.dayofmonth(_as_date(v)).cast("double"), v)


def weekday(x) -> Val:
    """Monday 1 to Sunday 7."""
    v = val(x)
    return _number((F.weekday(_as_date(v)) + 1).cast("double"), v)


_UNITS = ("year", "month", "day", "hour", "minute", "second")
_SECONDS = {"day": 86400, "hour": 3600, "minute": 60, "second": 1}


def _unit(unit: str) -> str:
    if unit not in _UNITS:
        raise BuildError(f"the unit is one of {', '.join(_UNITS)}")
    return unit


def date_diff(a, b, unit: str) -> Val:
    """a - b: years and months by the calendar's fields, smaller units cut toward zero."""
    va, vb = val(a), val(b)
    x, y = _as_date(va), _as_date(vb)
    if _unit(unit) == "year":
        out = F.year(x) - F.year(y)
    elif unit == "month":
        out = (F.year(x) - F.year(y)) * 12 + F.month(x) - F.month(y)
    else:
        out = _whole((F.unix_timestamp(x) - F.unix_timestamp(y)).cast("double") / float(_SECONDS[unit]))
    return _number(out.cast("double"), va, vb)


def date_add(d, n, unit: str) -> Val:
    """Months and years keep to the last day of a shorter month; milliseconds are dropped."""
    vd, (vn, n) = val(d), _num(n)
    x = _as_date(vd)
    if _unit(unit) in ("year", "month"):
        out = F.timestamp_add("MONTH", _whole(n).cast("int") * (12 if unit == "year" else 1), x)
    else:
        out = F.timestamp_add("SECOND", _whole(n * float(_SECONDS[unit])).cast("bigint"), x)
    return Val(out, join_failures(vd, vn), "date")

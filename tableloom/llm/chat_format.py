"""Chat formatting with a small compiled template language.

A template is text with ``{{ expression }}``, ``{% if %}``/``{% elif %}``/``{% else %}``, ``{% for x in xs %}``,
``{% set x = expression %}`` and ``{% generation %}``, which marks what a model is to learn. It is parsed into a
syntax tree, constants are folded (pieces of text that meet are joined, operations on constants and branches on
constant conditions are resolved), and the tree becomes nested Python closures. The language is sandboxed: values
are strings, numbers, booleans, lists and dicts; names and items are looked up in dicts only, never as attributes of
Python objects; there are no calls but the filters listed here; arithmetic takes numbers only, so that texts are
neither repeated nor formatted, and a value that grows beyond ``LONGEST`` code points is refused. Whatever is wrong
with a template, or with a value for it, is a ``TemplateError``.

Texts may hold the strings that the template uses to mark turns. The filter ``escape`` makes them harmless and
``unescape`` restores them exactly: backslashes are doubled, and one backslash goes behind the first character of
each control string. So turns and learned texts can be read back from the output alone.

Conversations are rendered as a stream: messages are read, rendered and read back one by one, so a long
conversation needs the memory of its longest turn.

Defined cases: a null role or text is empty; rows of a conversation with equal turn are ordered by role and text;
null turns come first; rows with a null conversation id form one conversation; repeated rows are turns each; long
texts and long conversations cost time in proportion to them, the memory of their longest turn, and one task each; an
empty table gives no rows; extra columns of any name are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Strings with a meaning in formatted conversations.
CONTROLS = ("<s>", "</s>", "<|sep|>", "[INST]", "[/INST]")
TEMPLATE = (
    "{% for m in messages %}{{ '<s>' }}{{ m.role | escape }}{{ '<|sep|>' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.content | escape }}{% endgeneration %}"
    "{% else %}{{ m.content | escape }}{% endif %}{{ '</s>' }}{% endfor %}"
)

_CONTROL = re.compile("|".join(f"({re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROLS))


def escape(text: str) -> str:
    if "\\" in text:
        text = text.replace("\\", "\\\\")
    return _CONTROL.sub(lambda m: m.group() + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text


class TemplateError(ValueError):
    """A template that cannot be parsed, or a value it may not use."""


def _text(value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (str, int, float)):
        return str(value)
    raise TemplateError(f"a {type(value).__name__} cannot be printed")


FILTERS: dict[str, Callable] = {
    "escape": lambda v: escape(_text(v)),
    "trim": lambda v: _text(v).strip(),
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "length": lambda v: len(v) if isinstance(v, (str, list, dict)) else 0,
    "string": _text,
}

_PIECE = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*)
                        |(?P<op>==|!=|<=|>=|[-+*%~<>()\[\].,|]))""", re.X)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_LEVELS = [("or",), ("and",), ("==", "!=", "<", ">", "<=", ">=", "in"), ("+", "-", "~"), ("*", "%")]


#: Code points that a value made by ``+`` or ``~`` may have, and those of a constant that is folded.
LONGEST, LONGEST_CONSTANT = 1 << 28, 10_000


def _joined(a, b) -> str:
    a, b = _text(a), _text(b)
    if len(a) + len(b) > LONGEST:
        raise TemplateError("a value is too long")
    return a + b


def _add(a, b):
    return a + b if _numbers(a, b) else _joined(a, b)


def _numbers(a, b) -> bool:
    return isinstance(a, (int, float)) and isinstance(b, (int, float))


def _arithmetic(sign: str, f: Callable) -> Callable:
    """Of numbers only: texts are neither repeated nor formatted."""

    def run(a, b):
        if not _numbers(a, b):
            raise TemplateError(f"{sign} takes numbers")
        try:
            return f(a, b)
        except ArithmeticError as e:
            raise TemplateError(f"{sign}: {e}") from e

    return run


def _ordered(sign: str, f: Callable) -> Callable:
    def run(a, b):
        if not _numbers(a, b) and not (isinstance(a, str) and isinstance(b, str)):
            raise TemplateError(f"{sign} takes two numbers or two texts")
        return f(a, b)

    return run


def _holds(a, b) -> bool:
    if isinstance(b, str) and isinstance(a, str) or isinstance(b, list):
        return a in b
    if isinstance(b, dict):
        return isinstance(a, (str, int, float, bool)) and a in b
    raise TemplateError("in takes a text, a list or a mapping")


_BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "+": _add, "~": _joined, "in": _holds,
    "<": _ordered("<", lambda a, b: a < b), ">": _ordered(">", lambda a, b: a > b),
    "<=": _ordered("<=", lambda a, b: a <= b), ">=": _ordered(">=", lambda a, b: a >= b),
    "-": _arithmetic("-", lambda a, b: a - b), "*": _arithmetic("*", lambda a, b: a * b),
    "%": _arithmetic("%", lambda a, b: a % b),
}


class _Expression:
    """Parses one expression into ("const", v), ("name", n), ("item", of, key), ("not", x), ("filter", name, x),
    ("and" | "or", a, b) or ("binary", operator, a, b)."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        return None if kind == "str" else value

    def take(self, expected: str | None = None):
        if self.at >= len(self.tokens) or expected is not None and self.peek() != expected:
            raise TemplateError(f"expected {expected or 'more'}")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self):
        tree = self.level(0)
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def level(self, n: int):
        if n == len(_LEVELS):
            return self.unary()
        left = self.level(n + 1)
        while (op := self.peek()) in _LEVELS[n]:
            self.take()
            right = self.level(n + 1)
            left = (op, left, right) if op in ("and", "or") else ("binary", op, left, right)
        return left

    def unary(self):
        if self.peek() == "not":
            self.take()
            return ("not", self.level(2))
        if self.peek() == "-":
            self.take()
            return ("binary", "-", ("const", 0), self.unary())
        return self.postfix(self.atom())

    def atom(self):
        kind, value = self.take()
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "num":
            return ("const", float(value) if "." in value else int(value))
        if kind == "name":
            fixed = {"true": True, "false": False, "none": None}
            return ("const", fixed[value.lower()]) if value.lower() in fixed else ("name", value)
        if value == "(":
            tree = self.level(0)
            self.take(")")
            return tree
        raise TemplateError(f"unexpected {value!r}")

    def postfix(self, tree):
        while True:
            if self.peek() == ".":
                self.take()
                tree = ("item", tree, ("const", self.take()[1]))
            elif self.peek() == "[":
                self.take()
                tree = ("item", tree, self.level(0))
                self.take("]")
            elif self.peek() == "|":
                self.take()
                name = self.take()[1]
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                tree = ("filter", name, tree)
            else:
                return tree


def parse_expression(source: str):
    try:
        return _Expression(source).whole()
    except RecursionError as e:
        raise TemplateError("an expression is nested too deeply") from e


def parse(template: str) -> list:
    """The syntax tree of a template: a list of ("text", s), ("print", e), ("if", [(e, body)...], else body),
    ("for", name, e, body), ("set", name, e) and ("generation", body)."""
    root: list = []
    stack: list[tuple[str, list]] = [("", root)]
    at = 0
    for m in _PIECE.finditer(template):
        before = template[at : m.start()]
        if m.group().startswith(("{{-", "{%-")):
            before = before.rstrip()
        if at and template[:at].endswith(("-}}", "-%}")):
            before = before.lstrip()
        at = m.end()
        body = stack[-1][1]
        if before:
            body.append(("text", before))
        if m.group(1) is not None:
            body.append(("print", parse_expression(m.group(1))))
            continue
        if m.group(2) is None:
            continue
        word, _, rest = m.group(2).strip().partition(" ")
        if word == "if":
            node = ["if", [(parse_expression(rest), [])], []]
            body.append(node)
            stack.append(("if", node[1][-1][1]))
        elif word in ("elif", "else"):
            kind, _ = stack.pop()
            if kind != "if":
                raise TemplateError(f"{word} outside if" if kind != "else" else f"{word} after else")
            node = stack[-1][1][-1]
            if word == "elif":
                node[1].append((parse_expression(rest), []))
                stack.append(("if", node[1][-1][1]))
            else:
                stack.append(("else", node[2]))
        elif word == "for":
            name, mark, of = rest.partition(" in ")
            if not mark or not name.strip().isidentifier():
                raise TemplateError(f"cannot read for {rest!r}")
            node = ["for", name.strip(), parse_expression(of), []]
            body.append(node)
            stack.append(("for", node[3]))
        elif word == "set":
            name, mark, value = rest.partition("=")
            if not mark or not name.strip().isidentifier():
                raise TemplateError(f"cannot read set {rest!r}")
            body.append(("set", name.strip(), parse_expression(value)))
        elif word == "generation":
            node = ["generation", []]
            body.append(node)
            stack.append(("generation", node[1]))
        elif word.startswith("end") and len(stack) > 1 and word[3:] == {"else": "if"}.get(stack[-1][0], stack[-1][0]):
            stack.pop()
        else:
            raise TemplateError(f"unexpected {word!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    rest = template[at:]
    if at and template[:at].endswith(("-}}", "-%}")):
        rest = rest.lstrip()
    if rest:
        root.append(("text", rest))
    return root


def fold_expression(e):
    kind = e[0]
    if kind in ("const", "name"):
        return e
    parts = [fold_expression(x) if isinstance(x, tuple) else x for x in e[1:]]
    folded = (kind, *parts)
    if kind in ("and", "or") and parts[0][0] == "const":
        return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
    if all(p[0] == "const" for p in parts if isinstance(p, tuple)):
        value = _closure(folded)({})
        if not isinstance(value, str) or len(value) <= LONGEST_CONSTANT:
            return ("const", value)
    return folded


def fold(body: list) -> list:
    """The body with constants resolved and neighbouring texts joined."""
    out: list = []

    def put(node) -> None:
        if node[0] == "text":
            if out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + node[1])
            elif node[1]:
                out.append(node)
        else:
            out.append(node)

    for node in body:
        kind = node[0]
        if kind == "print":
            e = fold_expression(node[1])
            put(("text", _text(e[1])) if e[0] == "const" else ("print", e))
        elif kind == "if":
            branches, otherwise = [], fold(node[2])
            for condition, inner in node[1]:
                e = fold_expression(condition)
                if e[0] == "const":
                    if e[1]:
                        otherwise = fold(inner)
                        break
                    continue
                branches.append((e, fold(inner)))
            if branches:
                put(("if", branches, otherwise))
            else:
                for x in otherwise:
                    put(x)
        elif kind == "for":
            put(("for", node[1], fold_expression(node[2]), fold(node[3])))
        elif kind == "set":
            put(("set", node[1], fold_expression(node[2])))
        elif kind == "generation":
            put(("generation", fold(node[1])))
        else:
            put(node)
    return out


def _item(of, key):
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, str)) and isinstance(key, int):
        return of[key] if -len(of) <= key < len(of) else None
    return None


def _closure(e) -> Callable[[dict], object]:
    kind = e[0]
    if kind == "const":
        value = e[1]
        return lambda env: value
    if kind == "name":
        name = e[1]
        return lambda env: env.get(name)
    if kind == "item":
        of, key = _closure(e[1]), _closure(e[2])
        return lambda env: _item(of(env), key(env))
    if kind == "not":
        x = _closure(e[1])
        return lambda env: not x(env)
    if kind == "filter":
        f, x = FILTERS[e[1]], _closure(e[2])
        return lambda env: f(x(env))
    if kind == "and":
        a, b = _closure(e[1]), _closure(e[2])
        return lambda env: a(env) and b(env)
    if kind == "or":
        a, b = _closure(e[1]), _closure(e[2])
        return lambda env: a(env) or b(env)
    f, a, b = _BINARY[e[1]], _closure(e[2]), _closure(e[3])
    return lambda env: f(a(env), b(env))


_Render = Callable[[dict, bool], Iterator[tuple[str, bool]]]


def _body(nodes: list) -> _Render:
    parts = [_node(n) for n in nodes]

    def render(env: dict, learned: bool) -> Iterator[tuple[str, bool]]:
        for part in parts:
            yield from part(env, learned)

    return render


def _node(node) -> _Render:
    kind = node[0]
    if kind == "text":
        text = node[1]

        def render(env, learned):
            yield text, learned
    elif kind == "print":
        value = _closure(node[1])

        def render(env, learned):
            yield _text(value(env)), learned
    elif kind == "if":
        branches = [(_closure(c), _body(b)) for c, b in node[1]]
        otherwise = _body(node[2])

        def render(env, learned):
            for condition, inner in branches:
                if condition(env):
                    yield from inner(env, learned)
                    return
            yield from otherwise(env, learned)
    elif kind == "for":
        name, of, inner = node[1], _closure(node[2]), _body(node[3])

        def render(env, learned):
            items = of(env)
            if isinstance(items, (str, dict)) or items is None or not isinstance(items, Iterable):
                raise TemplateError("only lists can be walked")
            own = dict(env)
            items, index = iter(items), 0
            missing = object()
            item = next(items, missing)
            while item is not missing:
                after = next(items, missing)
                index += 1
                own[name] = item
                own["loop"] = {"index": index, "index0": index - 1, "first": index == 1, "last": after is missing}
                yield from inner(own, learned)
                item = after
    elif kind == "set":
        name, value = node[1], _closure(node[2])

        def render(env, learned):
            env[name] = value(env)
            return
            yield
    else:
        inner = _body(node[1])

        def render(env, learned):
            yield from inner(env, True)
    return render


class Template:
    """A compiled template."""

    def __init__(self, source: str):
        self.tree = fold(parse(source))
        self._render = _body(self.tree)

    def pieces(self, **values) -> Iterator[tuple[str, bool]]:
        """The output in pieces, each with whether it is to be learned."""
        return self._render(dict(values), False)

    def render(self, **values) -> tuple[str, list[tuple[int, int]]]:
        """The output, and the stretches of it that are to be learned."""
        out, spans, at = [], [], 0
        for text, learned in self.pieces(**values):
            if learned and text:
                if spans and spans[-1][1] == at:
                    spans[-1] = (spans[-1][0], at + len(text))
                else:
                    spans.append((at, at + len(text)))
            out.append(text)
            at += len(text)
        return "".join(out), spans


class Reader:
    """Reads turns and learned text back from formatted output that comes in pieces."""

    def __init__(self):
        self.turns = self.chars = self.learned_chars = 0
        self._all, self._learned = hashlib.sha256(), hashlib.sha256()
        self._held, self._masked = "", []

    def feed(self, text: str, learned: bool) -> None:
        if learned:
            self._masked.append((len(self._held), len(self._held) + len(text)))
        self.chars += len(text)
        self._held += text
        if text.endswith("</s>") or "</s>" in text:
            self._turns()

    def _turns(self) -> None:
        while (end := self._held.find("</s>")) >= 0:
            turn = self._held[:end]
            if not turn.startswith("<s>"):
                raise ValueError("output does not start with a turn")
            role, mark, content = turn[3:].partition("<|sep|>")
            if not mark:
                raise ValueError("a turn has no separator")
            self._all.update(f"{unescape(role)}\n{unescape(content)}\n".encode("utf-8"))
            self.turns += 1
            for lo, hi in self._masked:
                text = unescape(self._held[lo:hi])
                self.learned_chars += len(text)
                self._learned.update(text.encode("utf-8"))
            self._held, self._masked = self._held[end + 4 :], []

    def digests(self) -> tuple[str, str]:
        if self._held:
            raise ValueError("output ends inside a turn")
        return self._all.hexdigest(), self._learned.hexdigest()


def _conversations(batches: Iterator[pa.RecordBatch]):
    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    return groupby(rows(), key=lambda r: r[0])


def _dealt(conversations: DataFrame) -> DataFrame:
    return (
        conversations.select("conv_id", "turn", "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
    )


def _messages(turns) -> Iterator[dict]:
    return ({"role": r or "", "content": t or ""} for _, r, t in turns)


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, formatted, learned): each conversation's output and the stretches to be learned."""
    span = T.StructType().add("start", "long").add("end", "long")
    schema = T.StructType([conversations.schema["conv_id"], T.StructField("formatted", T.StringType()),
                           T.StructField("learned", T.ArrayType(span))])
    id_type = conversations.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(template)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for conv, turns in _conversations(batches):
            text, spans = compiled.render(messages=_messages(turns))
            yield pa.RecordBatch.from_arrays([
                pa.array([conv], to_arrow(id_type)), pa.array([text], pa.string()),
                pa.array([[{"start": a, "end": b} for a, b in spans]], kind)], schema.names)

    return _dealt(conversations).mapInArrow(run, schema)


def to_arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def formatted_digests(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Counts and digests of each conversation, read back from its formatted output."""
    schema = T.StructType([
        conversations.schema["conv_id"], T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])
    id_type = conversations.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(template)
        kinds = [to_arrow(id_type), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], schema.names)

        for conv, turns in _conversations(batches):
            reader = Reader()
            for text, learned in compiled.pieces(messages=_messages(turns)):
                reader.feed(text, learned)
            a, b = reader.digests()
            rows.append((conv, reader.turns, a, reader.learned_chars, b, reader.chars))
            if len(rows) == 5_000:
                yield batch()
                rows = []
        if rows:
            yield batch()

    return _dealt(conversations).mapInArrow(run, schema)


#: The conversation that the query adds to the table: both turns hold control strings.
PROBE = "</s>[INST] ok [/INST]"


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast(table.schema["conv_id"].dataType).alias("conv_id"),
        F.col("id").cast(table.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return formatted_digests(table.unionByName(probe))


QUERIES = {"op3_chat_format": op3_chat_format}
ORACLE = {
    "op3_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(regexp_replace(replace(role, '\', '\\'), '<(s>|/s>|\|sep\|>)|\[(/?INST\])', '__\1\2', 'g'))
          + length(regexp_replace(replace(text, '\', '\\'), '<(s>|/s>|\|sep\|>)|\[(/?INST\])', '__\1\2', 'g'))
          + 14 AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id"""
}

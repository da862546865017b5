"""Exact encoding and decoding with a sentencepiece BPE model, by backtracking instead of merging.

The encoder walks the text once. At each position it takes the longest vocabulary piece (an Aho-Corasick
automaton finds it) and accepts it if it is compatible with the piece before: re-merging the two pieces'
characters by the model's scores must give those two pieces again. If it is not, the next shorter piece is
tried, and when none is left the walk steps back one piece; a bitfield holds the positions already known to
fail, so that no position is tried twice. A sequence in which all neighbours are compatible is the one that
merging makes.

Texts are cut before runs of the space mark and around characters that no longer piece contains, since no
merge crosses such a place (checked against the vocabulary when the model is loaded); the parts are
remembered by each worker in a cache of bounded size.

Defined cases: null and empty texts give the begin and end ids alone and decode to an empty text; repeated and tied
rows give repeated results; texts of any length are encoded whole, in time in proportion to them; an empty table gives
an empty result; other columns pass through ``encode_texts`` unless they carry an output's name, in which case the
output wins, and are not read by the query.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
#: Kinds of pieces in a sentencepiece model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Entries that a worker's cache of text parts holds before it is emptied.
CACHE_ENTRIES = 400_000


def _fields(buf: bytes) -> Iterator[tuple[int, int, object]]:
    """Fields of a protocol-buffer message: (number, wire type, value)."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            x = buf[i]
            i += 1
            out |= (x & 127) << shift
            shift += 7
            if x < 128:
                return out

    while i < len(buf):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: object = varint()
        elif kind == 1:
            value, i = buf[i : i + 8], i + 8
        elif kind == 5:
            value, i = buf[i : i + 4], i + 4
        else:
            n = varint()
            value, i = buf[i : i + n], i + n
        yield key >> 3, kind, value


class PieceModel:
    """Vocabulary of a BPE model file and its exact encoder and decoder."""

    def __init__(self, path: str):
        import ahocorasick

        pieces: list[tuple[str, float, int]] = []
        self.dummy_prefix = self.escape = True
        self.squeeze = True
        kind = 1
        charsmap = b""
        with open(path, "rb") as f:
            message = f.read()
        for number, _, value in _fields(message):
            if number == 1:
                piece, score, what = "", 0.0, NORMAL
                for n, _, v in _fields(value):
                    if n == 1:
                        piece = v.decode("utf-8")
                    elif n == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif n == 3:
                        what = v
                pieces.append((piece, score, what))
            elif number == 2:
                for n, _, v in _fields(value):
                    if n == 3:
                        kind = v
            elif number == 3:
                for n, _, v in _fields(value):
                    if n == 2:
                        charsmap = v
                    elif n == 3:
                        self.dummy_prefix = bool(v)
                    elif n == 4:
                        self.squeeze = bool(v)
                    elif n == 5:
                        self.escape = bool(v)
        if kind != 2 or charsmap or self.squeeze or not self.escape:
            raise ValueError("only BPE models without a normaliser that rewrites characters are supported")
        if any(what in (USER_DEFINED, UNUSED) for _, _, what in pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.ids = {p: i for i, (p, _, what) in enumerate(pieces) if what == NORMAL}
        self.score = {p: s for p, s, what in pieces if what == NORMAL}
        self.pieces = [p for p, _, _ in pieces]
        self.kinds = [what for _, _, what in pieces]
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, what) in enumerate(pieces) if what == BYTE}
        self.unknown = next(i for i, (_, _, what) in enumerate(pieces) if what == UNKNOWN)
        control = [i for i, (_, _, what) in enumerate(pieces) if what == CONTROL]
        self.begin, self.end = control[0], control[1]
        self._automaton = ahocorasick.Automaton()
        for p in self.ids:
            self._automaton.add_word(p, p)
        self._automaton.make_automaton()
        #: The longest proper prefix of a piece that is a piece itself.
        self._shorter = {
            p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.ids), None) for p in self.ids
        }
        self._id_bytes = {p: i.to_bytes(4, "little") for p, i in self.ids.items()}
        self._byte_bytes = [self.byte_ids.get(x, self.unknown).to_bytes(4, "little") for x in range(256)]
        self._pairs: dict[tuple[str, str], bool] = {}
        self._whole: dict[str, bool] = {}
        self._parts: dict[str, bytes] = {}
        long = [p for p in self.ids if len(p) > 1]
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in long):
            self._cut = None
        else:
            alone = "\n" if not any("\n" in p for p in long) else ""
            self._cut = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|{alone}" if alone else ""))
        #: What each id stands for when decoded.
        self._bytes = [
            b"" if what == CONTROL else bytes([int(p[3:5], 16)]) if what == BYTE
            else " ⁇ ".encode() if what == UNKNOWN else p.replace(SPACE, " ").encode()
            for p, _, what in pieces
        ]
        self._odd = np.array([what == BYTE for what in self.kinds])

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain merging: again and again the best-scored neighbours, the leftmost of equals."""
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = self.score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def reachable(self, piece: str) -> bool:
        """Whether merging the piece's own characters gives the piece."""
        known = self._whole.get(piece)
        if known is None:
            known = self._whole[piece] = self.merge(list(piece)) == [piece]
        return known

    def compatible(self, left: str, right: str) -> bool:
        key = (left, right)
        known = self._pairs.get(key)
        if known is None:
            known = self.merge(list(left + right)) == [left, right]
            if len(self._pairs) >= 300_000:
                self._pairs.clear()
            self._pairs[key] = known
        return known

    def _longest(self, text: str) -> list[str | None]:
        """For each position the longest piece that starts there."""
        found: list[str | None] = [None] * len(text)
        for end, piece in self._automaton.iter(text):  # later matches from the same start are longer
            found[end + 1 - len(piece)] = piece
        return found

    def backtrack(self, text: str) -> list[str]:
        """Pieces of a text without unknown characters."""
        if text in self.ids and self.reachable(text):
            return [text]
        longest = self._longest(text)
        failed = 0  # bit p: nothing that ends at p can be continued
        out: list[str] = []
        pos, n = 0, len(text)
        piece = longest[0]
        while True:
            while piece is not None:
                end = pos + len(piece)
                if not (failed >> end) & 1 and (self.compatible(out[-1], piece) if out else self.reachable(piece)):
                    break
                piece = self._shorter[piece]
            if piece is not None:
                out.append(piece)
                pos = end
                if pos == n:
                    return out
                piece = longest[pos]
            else:
                if not out:
                    raise ValueError(f"no encoding of {text!r}")
                failed |= 1 << pos
                last = out.pop()
                pos -= len(last)
                piece = self._shorter[last]

    def _encode_part(self, part: str) -> bytes:
        known, out, run = self._id_bytes, [], 0
        for i, c in enumerate(part):
            if c not in known:
                if i > run:
                    out += [known[p] for p in self.backtrack(part[run:i])]
                out += [self._byte_bytes[x] for x in c.encode("utf-8", "surrogatepass")]
                run = i + 1
        if run < len(part):
            out += [known[p] for p in self.backtrack(part[run:])]
        return b"".join(out)

    def encode_bytes(self, text: str | None, ends: bool = True) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            body = b""
        else:
            t = text.replace(" ", SPACE)
            if self.dummy_prefix:
                t = SPACE + t
            cache = self._parts
            if len(cache) > CACHE_ENTRIES:
                cache.clear()
            out = []
            for part in [t] if self._cut is None else self._cut.findall(t):
                ids = cache.get(part)
                if ids is None:
                    ids = self._encode_part(part)
                    if len(part) < 64:
                        cache[part] = ids
                out.append(ids)
            body = b"".join(out)
        if not ends:
            return body
        return self.begin.to_bytes(4, "little") + body + self.end.to_bytes(4, "little")

    def encode(self, text: str | None, ends: bool = True) -> list[int]:
        return np.frombuffer(self.encode_bytes(text, ends), "<u4").tolist()

    def decode(self, ids) -> str:
        """Text of ids: control ids vanish, runs of byte pieces are read as UTF-8 (a byte that cannot be read
        gives U+FFFD), and the space that the encoder put in front goes."""
        ids = np.asarray(ids, np.int64)
        table = self._bytes
        listed = ids.tolist()
        whole = b"".join([table[i] for i in listed])
        try:
            text = whole.decode("utf-8")
        except UnicodeDecodeError:
            text = self._decode_slow(listed)
        first = next((i for i in listed if self.kinds[i] != CONTROL), None)
        return text[1:] if self.dummy_prefix and first is not None and self.pieces[first].startswith(SPACE) else text

    def _decode_slow(self, ids: list[int]) -> str:
        out, run = [], bytearray()

        def flush() -> None:
            i = 0
            while i < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[i : i + n]).decode("utf-8"))
                        i += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    i += 1
            run.clear()

        for i in ids:
            if self.kinds[i] == BYTE:
                run.extend(self._bytes[i])
            else:
                flush()
                out.append(self._bytes[i].decode("utf-8"))
        flush()
        return "".join(out)


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """The model of a file, loaded once by each worker."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_texts(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids",
                 decoded_col: str | None = "decoded") -> DataFrame:
    """``df`` with the ids of each text (begin and end ids included) and, if asked, the decoded text."""
    outs = [ids_col] + ([decoded_col] if decoded_col else [])
    kept = [f for f in df.schema.fields if f.name not in outs]
    schema = T.StructType([*kept, T.StructField(ids_col, T.ArrayType(T.LongType()))]
                          + ([T.StructField(decoded_col, T.StringType())] if decoded_col else []))
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids, texts = [], []
                for t in part.column(part.schema.get_field_index(text_col)).to_pylist():
                    e = np.frombuffer(m.encode_bytes(t), "<u4")
                    ids.append(e.astype(np.int64))
                    if decoded_col:
                        texts.append(m.decode(e))
                cols = [part.column(part.schema.get_field_index(n)) for n in names]
                cols.append(pa.array(ids, pa.list_(pa.int64())))
                if decoded_col:
                    cols.append(pa.array(texts, pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names + outs)

    return df.mapInArrow(run, schema)


def encoding_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, the number of token ids, and digests of the ids and of the decoded text.

    Encoding and decoding happen in one pass; ids and texts never leave the task, so a row costs its digests."""
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            n, a, b = [], [], []
            for t in batch.column(1):
                e = m.encode_bytes(t.as_py())
                n.append(len(e) // 4)
                a.append(hashlib.sha256(e).hexdigest())
                b.append(hashlib.sha256(m.decode(np.frombuffer(e, "<u4")).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                schema.names)
            batch = t = None
            pa.default_memory_pool().release_unused()

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def public_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the installed public vocabulary lies (the same place on each machine)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_piece_encoding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encoding_digests(docs, public_path())


QUERIES = {"op7_piece_encoding": op7_piece_encoding}

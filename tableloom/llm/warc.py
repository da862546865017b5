"""WARC derivatives: metadata and plain-text conversion records made from response records.

A response record holds an HTTP response: status line, headers, body. For each, the builder makes two records that
refer to it (``WARC-Refers-To`` its record id, with its target URI and date): a *metadata* record with fields about
the source (its headers and digests as they stood, the HTTP status and headers, title and links) and a *conversion*
record with the text of the page. Each derivative carries its own block digest; ids are made from the source's id
and the kind, so that a repeated run, or a lost executor's repeated task, gives the same records.

Bad sources are not dropped: what is no WARC record (or null) gives a metadata record that says so and an empty
conversion, under an id made of its bytes; so does a block that is no HTTP response. Header fields may repeat, be
empty or lack a space, and keep their order and number; without a usable length the block ends where the record does.

Defined cases: null and empty bodies give empty conversions; null URIs are left out of the headers; long pages and
tags that are never closed take time in proportion to their length; repeated and tied rows give records with equal
ids; an empty table gives an empty result; extra columns are not read, and kept columns may have any name.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as _html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Name space of record ids that this module makes.
_IDS = uuid.UUID("6f1e3c52-9a0d-5c3f-8b61-6d1b0a4f7c21")
#: Date of records made from tables that have none.
EPOCH = "1970-01-01T00:00:00Z"

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(
    r"</?(?:address|article|aside|blockquote|body|br|caption|dd|details|div|dl|dt|fieldset|figure|footer|form|h[1-6]|"
    r"header|hr|html|li|main|nav|ol|p|pre|section|summary|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*>", re.I)
_ANY_TAG = re.compile(r"<[^>]*>")
_SPACES = re.compile(r"[ \t\r\f\v ]+")
_TITLE = re.compile(r"<title\b[^>]*>", re.I)
_TITLE_END = re.compile(r"</title", re.I)
_LINK = re.compile(r"<a\b[^>]*>", re.I)
_HREF = re.compile(r"\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class Headers(dict):
    """Header fields: all of them in order as ``pairs``; looked up by name in any case, the first of its name."""

    def __init__(self, pairs: list[tuple[str, str]]):
        super().__init__()
        self.pairs = list(pairs)
        for k, v in self.pairs:
            self.setdefault(k.lower(), v)

    def __getitem__(self, name: str) -> str:
        return super().__getitem__(name.lower())

    def __contains__(self, name: object) -> bool:
        return isinstance(name, str) and super().__contains__(name.lower())

    def get(self, name: str, default=None):
        return super().get(name.lower(), default)


def digest(block: bytes) -> str:
    """SHA-1 in base 32, as WARC files have it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode("ascii")


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_IDS, chr(0).join(parts))}>"


def serialized(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record as it stands in a WARC file. Line breaks in header values become spaces."""
    lines = ["WARC/1.1"] + [f"{k}: {' '.join(v.splitlines())}" for k, v in headers if v is not None]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[Headers, bytes]:
    """Headers and block of one serialized record. Raises ``ValueError`` for what does not begin as one."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    pairs: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and pairs:  # a folded line
            pairs[-1] = (pairs[-1][0], f"{pairs[-1][1]} {line.strip()}")
        elif ":" in line:
            name, value = line.split(":", 1)
            pairs.append((name.strip(), value.strip()))
    headers = Headers(pairs)
    size = headers.get("Content-Length", "")
    if size.isascii() and size.isdigit():
        return headers, rest[: int(size)]
    return headers, rest.removesuffix(b"\r\n\r\n")


def page_text(page: str) -> str:
    """All visible text, one block a line."""
    page = _HIDDEN.sub(" ", page).replace("\n", " ")
    tags = page.rfind(">") + 1  # after it there are no whole tags
    page = _ANY_TAG.sub("", _BREAK.sub("\n", page[:tags])) + page[tags:]
    if "&" in page:
        page = _html.unescape(page)
    lines = (_SPACES.sub(" ", line).strip() for line in page.split("\n"))
    return "\n".join(line for line in lines if line)


def page_title(page: str) -> str | None:
    page = page[: page.rfind(">") + 1]
    begin = _TITLE.search(page)
    end = _TITLE_END.search(page, begin.end()) if begin else None
    return " ".join(_html.unescape(page[begin.end() : end.start()]).split()) if end else None


def page_links(page: str) -> list[str]:
    page = page[: page.rfind(">") + 1]
    found = (_HREF.search(m[0]) for m in _LINK.finditer(page))
    return [_html.unescape(m[1] or m[2] or m[3] or "") for m in found if m]


def response(url: str | None, body: str | None, date: str = EPOCH) -> tuple[list[tuple[str, str | None]], bytes]:
    """A response record of a page: headers and block."""
    payload = (body or "").encode("utf-8")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode("ascii") + payload
    headers = [
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", url or "", digest(payload))),
        ("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Payload-Digest", digest(payload)),
        ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return headers, block


def http_parts(block: bytes) -> tuple[str | None, list[tuple[str, str]], bytes]:
    """Status line, headers and body of an HTTP response; no status line if it is none."""
    head, mark, body = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    if not mark or not lines[0].startswith("HTTP/"):
        return None, [], b""
    return lines[0], [tuple(x.strip() for x in line.split(":", 1)) for line in lines[1:] if ":" in line], body


def derivatives(headers: Headers | dict[str, str], block: bytes,
                error: str | None = None) -> list[tuple[list[tuple[str, str | None]], bytes]]:
    """The metadata and the conversion record of a response record. ``error`` says why there is none to read."""
    source = headers.get("WARC-Record-ID") or record_id("unknown", digest(block))
    status, http, body = http_parts(block)
    page = body.decode("utf-8", "replace")
    pairs = headers.pairs if isinstance(headers, Headers) else list(headers.items())
    about: list[tuple[str, str]] = [(f"source-{k}", v) for k, v in pairs]
    about += [("http-status", status)] if status else [("error", error or "no HTTP response")]
    about += [(f"http-{k}", v) for k, v in http]
    title = page_title(page)
    if title is not None:
        about.append(("title", title))
    about += [("outlink", link) for link in page_links(page)]
    out = []
    for kind, content_type, data in (
        ("metadata", "application/warc-fields", "".join(f"{k}: {' '.join(v.splitlines())}\r\n" for k, v in about)),
        ("conversion", "text/plain; charset=utf-8", page_text(page)),
    ):
        data = data.encode("utf-8")
        out.append(([
            ("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, source)),
            ("WARC-Target-URI", headers.get("WARC-Target-URI")), ("WARC-Date", headers.get("WARC-Date", EPOCH)),
            ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", headers.get("WARC-Target-URI")),
            ("WARC-Refers-To-Date", headers.get("WARC-Date", EPOCH)), ("WARC-Block-Digest", digest(data)),
            ("Content-Type", content_type), ("Content-Length", str(len(data))),
        ], data))
    return out


def parts_of(record: bytes | None) -> tuple[Headers, bytes, str | None]:
    """Headers, block and error of a record that may be anything."""
    if record is None:
        return Headers([]), b"", "no record"
    try:
        return (*parse_record(record), None)
    except ValueError as e:
        return Headers([]), record, str(e)


def response_records(pages: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """(keep..., record): a serialized response record of each page."""
    schema = pages.select(*keep).schema.add("record", "binary")
    names = [*[f"kept_{i}" for i in range(len(keep))], "record"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(keep)
        for batch in batches:
            found = [serialized(*response(u.as_py(), h.as_py())) for u, h in zip(batch.column(n), batch.column(n + 1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(n)] + [pa.array(found, pa.binary())], names)

    names_of = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, schema.fields)])
    return pages.select(*[F.col(f"`{c}`") for c in keep], F.col("url").alias("_url"), F.col("html").alias("_html")).mapInArrow(
        run, names_of).toDF(*schema.names)


def derive_records(records: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """(keep..., warc_type, record_id, refers_to, target_uri, block_digest, content_length, source_digest, record):
    two rows for each response record."""
    schema = records.select(*keep).schema
    for name in ("warc_type", "record_id", "refers_to", "target_uri", "block_digest"):
        schema = schema.add(name, "string")
    schema = schema.add("content_length", "long").add("source_digest", "string").add("record", "binary")
    names = [*[f"kept_{i}" for i in range(len(keep))], *schema.names[len(keep):]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(keep)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                at, rows = [], []
                for i, data in enumerate(part.column(n)):
                    source, block, error = parts_of(data.as_py())
                    for headers, body in derivatives(source, block, error):
                        h = dict(headers)
                        at.append(i)
                        rows.append((h["WARC-Type"], h["WARC-Record-ID"], h["WARC-Refers-To"], h["WARC-Target-URI"],
                                     h["WARC-Block-Digest"], len(body), source.get("WARC-Payload-Digest"),
                                     serialized(headers, body)))
                kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(i).take(pa.array(at, pa.int64())) for i in range(n)]
                    + [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    typed = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, schema.fields)])
    rows = records.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col("record").alias("_record"))
    return rows.mapInArrow(run, typed).toDF(*schema.names)


def write_records(records: DataFrame, path: str, column: str = "record") -> None:
    """Records as a Parquet table of one binary column."""
    records.select(column).write.mode("overwrite").parquet(path)


#: Bytes of records, before compression, after which a task begins another file.
FILE_BYTES = 256_000_000


def write_warc(records: DataFrame, path: str, column: str = "record", file_bytes: int = FILE_BYTES) -> list[str]:
    """Records as ``.warc.gz`` files under ``path`` (a URI that driver and executors share), one gzip member a record, as
    WARC tools read them. A task writes beside its files and renames them when they are whole, so that a repeated task
    replaces what it wrote. Returns the names of the files (a few a task)."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        at = TaskContext.get()
        system, folder = fs.FileSystem.from_uri(path)
        system.create_dir(folder, recursive=True)
        done: list[str] = []
        out, size = None, 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                system.move(hidden(), f"{folder}/{done[-1]}")
                out = None

        def hidden() -> str:
            return f"{folder}/.{done[-1]}.{at.taskAttemptId()}"

        for batch in batches:
            for record in batch.column(0):
                record = record.as_py()
                if record is None:
                    continue
                if out is None or size > file_bytes:
                    close()
                    done.append(f"part-{at.partitionId():05d}-{len(done):03d}.warc.gz")
                    out, size = system.open_output_stream(hidden(), compression=None), 0
                out.write(gzip.compress(record, mtime=0))
                size += len(record)
        close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["file"])

    return sorted(r[0] for r in records.select(column).mapInArrow(run, "file string").collect())


_MEMBER = b"\x1f\x8b\x08"
_ENDS = re.compile(rb"[\r\n]*")
_NEXT = b"\r\n\r\nWARC/"
_LENGTH = re.compile(rb"^content-length[ \t]*:[ \t]*([0-9]{1,18})[ \t]*\r?$", re.M | re.I)


def _inflated(data: bytes, step: int = 1 << 20) -> Iterator[bytes | None]:
    """The bytes of a file piece by piece; None where a damaged or cut member ends and the next one begins."""
    if not data.startswith(_MEMBER[:2]):
        for at in range(0, len(data), step):
            yield data[at : at + step]
        return
    at = 0
    while 0 <= at < len(data):
        member, place = zlib.decompressobj(31), at
        try:
            while not member.eof and (place < len(data) or member.unconsumed_tail):
                rest = member.unconsumed_tail
                if not rest:
                    rest = data[place : place + step]
                    place += len(rest)
                yield member.decompress(rest, step)
            if member.eof:
                at = place - len(member.unused_data)
                if at < len(data) and not data.startswith(_MEMBER, at):
                    at = data.find(_MEMBER, at)  # padding between members
                continue
        except zlib.error:
            pass
        yield None
        at = data.find(_MEMBER, at + 1)


def cut_records(pieces: Iterator[bytes | None]) -> Iterator[bytes]:
    """Records as they stand, of a file's bytes in pieces; no more than a record and a piece is held.

    A length that is missing, no number, or not followed by the record's end does not count: such a record goes to where
    the next one begins. What stands before a record and is none comes as a record of its own."""
    held = bytearray()

    def end_of(at: int, final: bool) -> int:
        """Where the record that begins at a place ends; -1 if that is not known yet."""
        if held.startswith(b"WARC/", at) or b"WARC/".startswith(held[at:]):
            head = held.find(b"\r\n\r\n", at)
            length = _LENGTH.search(held, at, head + 2) if head >= 0 else None
            end = head + 4 + int(length[1]) if length else -1
            if not final and (head < 0 or len(held) < end + 4):
                return -1
            if length and (held.startswith(b"\r\n\r\n", end) or end == len(held)):
                return min(end + 4, len(held))
            at = max(head, at)
        following = held.find(_NEXT, at)
        return following + 4 if following >= 0 else len(held) if final else -1

    def whole(final: bool) -> Iterator[bytes]:
        at = 0
        while (at := _ENDS.match(held, at).end()) < len(held) and (end := end_of(at, final)) > at:
            yield bytes(held[at:end])
            at = end
        del held[:at]

    for piece in pieces:
        if piece is None:
            yield from whole(True)
        else:
            held += piece
            yield from whole(False)
    yield from whole(True)


def read_warc(spark, path: str) -> DataFrame:
    """(file, record) of ``.warc.gz`` or ``.warc`` files, each record as it stands.

    A file (of 2 GB at most, as Spark reads it) is one task's; its records are inflated and handed on one by one. Damage
    costs no more than where it is: a cut file gives what is there, after a damaged member the next one is read, and
    bytes that are no record come as a record, from which ``derive_records`` makes one that says so."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1)):
                found, size = [], 0

                def part() -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays(
                        [pa.array([name.as_py()] * len(found), pa.string()), pa.array(found, pa.binary())], ["file", "record"])

                for record in cut_records(_inflated(data.as_py())):
                    found.append(record)
                    size += len(record)
                    if size > 8_000_000:
                        yield part()
                        found, size = [], 0
                if found:
                    yield part()

    return files.mapInArrow(run, "file string, record binary")


def op10_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = derive_records(response_records(pages))
    return found.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "block_digest",
                        "content_length", "source_digest", F.sha2("record", 256).alias("record_sha256"))


QUERIES = {"op10_warc_derivatives": op10_warc_derivatives}

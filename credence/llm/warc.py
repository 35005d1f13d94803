"""WARC derivatives (operator 4): metadata and plain-text conversion records of responses.

Each response record gives two records that point back to it with
WARC-Refers-To and keep its target, date and payload digest: a metadata record
(JSON with the source headers, the links and the title) and a conversion
record with the page's text.  Work is done record by record inside Arrow
batches; nothing is shuffled.
"""

from __future__ import annotations

import base64
import gzip
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATE = "1970-01-01T00:00:00Z"
_SPACE_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")       # the public namespace for names that are URLs
_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title\s*>|\Z)", re.S | re.I)
_BLOCK = re.compile(r"</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|table|tr|td|th|h[1-6]|section|article|header|footer|nav|aside|main|blockquote|pre|form|title|head|body|html|option)\b[^<>]*>", re.I)
_TAG = re.compile(r"<[/!?]?[a-zA-Z][^<>]*>|<!DOCTYPE[^<>]*>", re.I)
_LINK = re.compile(r"<(a|area|link|img|script|iframe|source)\b([^<>]*)>", re.I)
_HREF = re.compile(r"""\b(href|src)\s*=\s*("([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_BLANK = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1(block).digest()).decode("ascii")


def record_id(*parts: str) -> str:
    """The same parts always give the same id, so a repeated task writes the same record."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE_ID, chr(0).join(parts))}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"{k}: {_line(v)}" for k, v in [*headers, ("Content-Length", str(len(block)))]]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def parse_headers(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(first line, fields, what follows the blank line); folded fields are joined."""
    head, gap, rest = block.partition(b"\r\n\r\n")
    if not gap:
        head, gap, rest = block.partition(b"\n\n")
    lines = re.split(r"\r?\n", re.sub(r"\r?\n[ \t]+", " ", head.decode("utf-8", "replace")))
    fields = [(k.strip(), v.strip()) for k, colon, v in (x.partition(":") for x in lines[1:]) if colon]
    return lines[0], fields, rest


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(WARC fields, block) of one record; a field that repeats keeps its first value, a bad length the whole rest."""
    _, fields, rest = parse_headers(raw)
    named: dict[str, str] = {}
    for k, v in fields:
        named.setdefault(k, v)
    size = named.get("Content-Length", "")
    return named, rest[: int(size)] if size.isdigit() else rest


def page_text(page: str) -> str:
    """The visible text: a line for each block element, white space folded."""
    text = html.unescape(_TAG.sub("", _BLOCK.sub("\n", _DROP.sub(" ", page)))).replace("\r", "\n")
    return _LINES.sub("\n", _BLANK.sub(" ", text)).strip()


def page_links(page: str) -> list[dict[str, str]]:
    out = []
    if _DROP.search(page):                     # comments go, of scripts the opening tag stays
        page = _DROP.sub(lambda m: " " if m[0].startswith("<!--") else m[0].split(">")[0] + ">", page)
    for tag, inside in _LINK.findall(page):
        for m in _HREF.finditer(inside):
            out.append({"path": f"{tag.upper()}@/{m[1].lower()}", "url": html.unescape(next(x for x in (m[3], m[4], m[5], "") if x is not None))})
    return out


def _title(page: str) -> str | None:
    m = _TITLE.search(page)
    return " ".join(html.unescape(_TAG.sub("", m[1])).split()) if m else None




def page_responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """page_id, record: a WARC/1.1 response record of every page.

    A null url is left out of the record, a null html is an empty payload.
    Equal rows give equal records.  Other columns are not read.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for page, url, body in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                payload = (body or "").encode("utf-8")
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
                target = [("WARC-Target-URI", url)] if url is not None else []
                made.append(record([("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", str(page), url or "", digest(payload))), *target, ("WARC-Date", date),
                                    ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(payload)), ("Content-Type", "application/http; msgtype=response")], block))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(made, pa.binary())], names=["page_id", "record"])

    chosen = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return chosen.mapInArrow(run, f"page_id {kind}, record binary")


def _charset(content_type: str) -> str:
    m = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", content_type, re.I)
    try:
        return m[1] if m and b"".decode(m[1]) == "" else "utf-8"
    except LookupError:
        return "utf-8"


def _derived(fields: dict[str, str], block: bytes, whole: bool) -> Iterator[tuple]:
    source, target, date = fields.get("WARC-Record-ID", ""), fields.get("WARC-Target-URI"), fields.get("WARC-Date", DATE)
    status, http, payload = parse_headers(block)
    kind = next((v for k, v in http if k.lower() == "content-type"), "")
    page = payload.decode(_charset(kind), "replace")
    entity_digest = digest(payload)
    payload_digest = fields.get("WARC-Payload-Digest") or entity_digest
    title, links = _title(page), page_links(page)
    envelope = {"Envelope": {"WARC-Header-Metadata": fields, "Payload-Metadata": {
        "Actual-Content-Type": "application/http; msgtype=response", "HTTP-Response-Metadata": {
            "Response-Message": status, "Headers": http, "Entity-Length": len(payload), "Entity-Digest": entity_digest,
            "HTML-Metadata": {"Head": {"Title": title}, "Links": links}}}}}
    made = {"metadata": ("application/json", json.dumps(envelope, ensure_ascii=False).encode("utf-8", "surrogatepass")),
            "conversion": ("text/plain; charset=utf-8", page_text(page).encode("utf-8", "surrogatepass"))}
    for what, (content_type, out) in made.items():
        own, out_digest = record_id(what, source, payload_digest), digest(out)
        headers = [("WARC-Type", what), ("WARC-Record-ID", own), ("WARC-Refers-To", source), *([("WARC-Target-URI", target)] if target is not None else []), ("WARC-Date", date),
                   ("WARC-Block-Digest", out_digest), ("WARC-Payload-Digest", payload_digest) if what == "metadata" else ("WARC-Source-Payload-Digest", payload_digest), ("Content-Type", content_type)]
        yield what, own, source, target, date, kind, payload_digest, out_digest, len(links), title, out, record(headers, out) if whole else None


_COLUMNS = ("kind string, record_id string, refers_to string, target_uri string, date string, source_content_type string, source_digest string, "
            "block_digest string, n_links long, title string, block binary, record binary")


def derive(responses: DataFrame, id_col: str = "page_id", record_col: str = "record", with_records: bool = True) -> DataFrame:
    """Two rows for every response record: the metadata and the conversion record.

    page_id, kind, record_id, refers_to, target_uri, date, source_content_type,
    source_digest, block_digest, n_links, title, block (the record's content)
    and record (the whole record; null without ``with_records``).  Records whose WARC-Type is not response
    give no rows, nor does a null record; a response without HTML gives an
    empty text, no title and no links.  Other columns are not read.
    """
    kind = responses.schema[id_col].dataType.simpleString()
    names = ["page_id", *(c.split()[0] for c in _COLUMNS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):     # blocks are as long as the pages
                parsed = ((i, *parse_record(raw)) for i, raw in zip(part.column("page_id").to_pylist(), part.column("record").to_pylist()) if raw is not None)
                rows = [(i, *d) for i, fields, content in parsed if fields.get("WARC-Type") == "response" for d in _derived(fields, content, with_records)]
                columns = list(zip(*rows)) if rows else [()] * len(names)
                types = [part.schema.field("page_id").type, *[pa.string()] * 8, pa.int64(), pa.string(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    chosen = responses.select(F.col(id_col).alias("page_id"), F.col(record_col).alias("record"))
    return chosen.mapInArrow(run, f"page_id {kind}, {_COLUMNS}")


def gzip_members(records: DataFrame, record_col: str = "record") -> DataFrame:
    """``records`` with ``member``: each record as a gzip member; members joined in any order are a .warc.gz file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if r is None else gzip.compress(r, mtime=0) for r in batch.column(record_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*batch.schema.names, "member"])
    from pyspark.sql.types import BinaryType, StructField, StructType
    return records.mapInArrow(run, StructType([*records.schema.fields, StructField("member", BinaryType())]))


def _members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file one at a time; a plain file is one."""
    at = 0
    while data[at: at + 2] == b"\x1f\x8b":
        member, parts = zlib.decompressobj(31), []
        while at < len(data) and not member.eof:
            fed = data[at: at + (1 << 20)]
            parts.append(member.decompress(fed))
            at += len(fed) - len(member.unused_data)
        yield b"".join(parts)
    if at == 0:
        yield data


def _records(data: bytes) -> Iterator[bytes]:
    """The records of a file: gzip members, or plain records one after another.  A record lies in one member."""
    for plain in _members(data):
        at = plain.find(b"WARC/")
        while at >= 0:
            head = plain.find(b"\r\n\r\n", at)
            if head < 0:
                break
            size = re.search(rb"(?im)^content-length:\s*(\d+)", plain[at:head])
            end = head + 4 + int(size[1]) if size else len(plain)
            yield plain[at:end] + b"\r\n\r\n"
            at = plain.find(b"WARC/", end)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """path, page_id (place in the file), record of every record of the .warc or .warc.gz files under ``path``; a file is one task's work."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                for i, raw in enumerate(_records(data)):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([i]), pa.array([raw], pa.binary())], names=["path", "page_id", "record"])
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, page_id long, record binary")

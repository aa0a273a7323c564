"""WARC derivatives: from response records to linked metadata and plain-text conversion records.

Records are rows (headers as named columns, block as bytes) that can be written as WARC/1.1 bytes and read back.
A derived record refers to the response it comes from and keeps its target, date, source headers and digests.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.llm.workers import streaming

#: Columns of a record; block is binary, the others are text, null where a header is absent.
RECORD = (
    "warc_type", "record_id", "target_uri", "date", "refers_to", "refers_to_target_uri", "refers_to_date",
    "source_headers", "content_type", "block_digest", "payload_digest", "block",
)
#: Headers in the order in which they are written.
HEADERS = {
    "warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "date": "WARC-Date", "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To", "refers_to_target_uri": "WARC-Refers-To-Target-URI",
    "refers_to_date": "WARC-Refers-To-Date", "block_digest": "WARC-Block-Digest",
    "payload_digest": "WARC-Payload-Digest", "content_type": "Content-Type",
}
#: The extension header that carries the HTTP headers of the source on a derived record, lines joined by "; ".
SOURCE_HEADER = "X-Source-HTTP-Headers"
_TYPES = {c: pa.binary() if c == "block" else pa.string() for c in RECORD}
_SCHEMA = "row long, " + ", ".join(f"{c} {'binary' if c == 'block' else 'string'}" for c in RECORD)

#: Elements whose content is not shown, and those that begin and end a line.
_UNSEEN = ("script", "style", "noscript", "template", "svg")
_BLOCKS = frozenset(
    "address article aside blockquote br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table "
    "td th title tr ul".split()
)
_CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in (*_UNSEEN, "title")}
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_OPENING = re.compile(r"</?[A-Za-z!?]")
#: A quoted value that has no end before the region's.
_OPEN_QUOTE = re.compile(r"=\s*(?:\"[^\"]*|'[^']*)\Z")
_QUOTE_OR_END = re.compile(r"=\s*([\"'])|>")
_LANG = re.compile(r"\slang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_HREF = re.compile(r"\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_GAPS = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.I)


def digest(data: bytes) -> str:
    """A labelled digest in the form that WARC files use."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, *of: str) -> str:
    """The same id whenever the same record is made again."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join((kind, *of)))}>"


def _tags(page: str) -> Iterator[tuple[str, str, int]]:
    """(text before, tag, place after it) of each tag that is seen, in one pass; at the end the last text and no tag.

    A ``>`` in a quoted value does not end a tag, unless the quotes of the page do not come out even. Comments and the
    content of :data:`_UNSEEN` count as a space; without an end they go on to the end of the page.
    """
    at, quotes, parts = 0, True, []
    while (low := page.find("<", at)) >= 0:
        parts.append(page[at:low])
        if page.startswith("<!--", low):
            end = page.find("-->", low + 4)
            parts.append(" ")
            at = len(page) if end < 0 else end + 3
            continue
        if not _OPENING.match(page, low):
            parts.append("<")
            at = low + 1
            continue
        plain = page.find(">", low)
        if plain < 0:
            at = low
            break
        end = plain
        if quotes and _OPEN_QUOTE.search(page, low, plain):
            look, end = low, -1
            while found := _QUOTE_OR_END.search(page, look):
                if not found[1]:
                    end = found.start()
                    break
                shut = page.find(found[1], found.end())
                if shut < 0:
                    break
                look = shut + 1
            if end < 0:
                quotes, end = False, plain
        tag = page[low : end + 1]
        at = end + 1
        name = _NAME.match(tag)
        if name and name[1].lower() in _UNSEEN and tag[1] != "/":
            shut = _CLOSING[name[1].lower()].search(page, at)
            parts.append(" ")
            at = shut.end() if shut else len(page)
            continue
        yield "".join(parts), tag, at
        parts = []
    yield "".join([*parts, page[at:]]), "", len(page)


def read_page(page: str) -> tuple[str, list[tuple[str, str]]]:
    """What :func:`plain_text` and :func:`fields` tell of a page, in one pass."""
    parts, title, language, links = [], None, None, []
    for text, tag, at in _tags(page):
        found = _NAME.match(tag)
        name = found[1].lower() if found else ""
        parts.append(text)
        if name in _BLOCKS:
            parts.append("\n")
        if tag.startswith("</"):
            continue
        if name == "a":
            if found := _HREF.search(tag):
                links.append(found[1] or found[2] or found[3] or "")
        elif name == "title" and title is None:
            shut = _CLOSING["title"].search(page, at)
            title = page[at : shut.start()] if shut else ""
        elif name == "html" and language is None and (found := _LANG.search(tag)):
            language = found[1].lower()
    plain = _LINES.sub("\n", _GAPS.sub(" ", html.unescape("".join(parts)))).strip(" \n")
    told = [("title", html.unescape(title or "")), ("language", language or ""), *(("outlink", html.unescape(x)) for x in links)]
    return plain, [(k, v) for k, v in ((k, _one_line(v)) for k, v in told) if v]


def plain_text(page: str) -> str:
    """The visible text of a page: a line for each block, white space run together, entities resolved."""
    return read_page(page)[0]


def fields(page: str) -> list[tuple[str, str]]:
    """What a metadata record tells about a page: title, language, outgoing links in order."""
    return read_page(page)[1]


def _one_line(text: str) -> str:
    return " ".join(text.split())


def split_http(block: bytes) -> tuple[str, bytes]:
    """Header lines and payload of an HTTP message; without an empty line all of it is payload."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    return (head.decode("utf-8", "replace"), payload) if gap else ("", block)


def _unchunked(payload: bytes) -> bytes:
    """The body of chunks; what does not look like one is taken as it is from there on."""
    out, at = [], 0
    while (end := payload.find(b"\r\n", at)) >= 0:
        try:
            size = int(payload[at:end].split(b";")[0], 16)
        except ValueError:
            break
        if size <= 0:
            return b"".join(out)
        out.append(payload[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join([*out, payload[at:]])


def page_of(head: str, payload: bytes) -> str:
    """The text of a payload: chunks joined, gzip and deflate undone, in the charset of the headers or of the page.

    A payload that is not as its headers say counts as it stands, an unknown charset as UTF-8; bytes that are not valid
    in it become replacement characters.
    """
    told = {}
    for line in head.split("\r\n")[1:]:
        name, _, value = line.partition(":")
        told.setdefault(name.strip().lower(), value.strip().lower())
    if "chunked" in told.get("transfer-encoding", ""):
        payload = _unchunked(payload)
    coding = told.get("content-encoding", "")
    for wbits in (47,) if "gzip" in coding else (15, -15) if "deflate" in coding else ():
        unpacked = zlib.decompressobj(wbits)
        try:
            payload = unpacked.decompress(payload) + unpacked.flush()
            break
        except zlib.error:
            continue
    named = _CHARSET.search(told.get("content-type", "").encode()) or _CHARSET.search(payload[:2048])
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if payload.startswith(mark):
            return payload[len(mark) :].decode(name, "replace")
    try:
        return payload.decode(named[1].decode() if named else "utf-8", "replace")
    except (LookupError, UnicodeError, ValueError):
        return payload.decode("utf-8", "replace")


def serialize(record: dict) -> bytes:
    """A record as it stands in a WARC file."""
    block = record["block"] or b""
    lines = ["WARC/1.1", *(f"{HEADERS[c]}: {_one_line(record[c])}" for c in HEADERS if record.get(c))]
    if record.get("source_headers"):
        lines.append(f"{SOURCE_HEADER}: {_one_line(record['source_headers'])}")
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> list[dict]:
    """The records of a WARC file, plain or gzipped, in order.

    A block is as long as its header says, whatever is in it; without a length it goes up to the next record. A header
    line without a colon does not count, one that begins with white space goes on with the line before. What stands
    before a record's version is skipped. A record that is cut short is told as far as it goes.
    """
    if data[:2] == b"\x1f\x8b":
        data = _gunzipped(data)
    of = {h.lower(): c for c, h in HEADERS.items()} | {SOURCE_HEADER.lower(): "source_headers"}
    out, found = [], _VERSION.search(data)
    while found:
        head = _HEAD_END.search(data, found.end())
        start = head.end() if head else len(data)
        lines: list[str] = []
        for line in data[found.end() : head.start() if head else len(data)].decode("utf-8", "replace").replace("\r\n", "\n").split("\n"):
            if line[:1] in (" ", "\t") and lines:
                lines[-1] += " " + line.strip()
            else:
                lines.append(line)
        record: dict = dict.fromkeys(RECORD)
        length = None
        for line in lines:
            name, colon, value = line.partition(":")
            if colon and name.strip().lower() == "content-length":
                length = int(value) if value.strip().isdecimal() else None
            elif colon and name.strip().lower() in of:
                record[of[name.strip().lower()]] = value.strip()
        if length is None:
            after = _VERSION.search(data, start)
            record["block"] = data[start : after.start() if after else len(data)].removesuffix(b"\r\n\r\n")
        else:
            record["block"] = data[start : start + length]
            after = _VERSION.search(data, start + length)
        out.append(record)
        found = after
    return out


_VERSION = re.compile(rb"(?:\A|(?<=\n))WARC/\d[^\r\n]*\r?\n")
_HEAD_END = re.compile(rb"(?:\r?\n|(?<=\n))\r?\n")


def _gunzipped(data: bytes) -> bytes:
    """All members of a gzip file, as far as they are whole."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data) + member.flush())
        except zlib.error:
            break
        data = member.unused_data
    return b"".join(out)


def response(uri: str | None, page: str | None, key: str, date: str) -> dict:
    """The response record of a stored page, as a server would have sent it."""
    payload = (page or "").encode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}"
    block = head.encode() + b"\r\n\r\n" + payload
    return dict.fromkeys(RECORD) | {
        "warc_type": "response", "record_id": record_id("response", key, uri or "", digest(payload)), "target_uri": uri,
        "date": date, "content_type": "application/http; msgtype=response", "block_digest": digest(block),
        "payload_digest": digest(payload), "block": block,
    }


def derive(source: dict) -> list[dict]:
    """The metadata and the conversion record of a response, each of which names the other's source."""
    head, payload = split_http(source["block"] or b"")
    plain, page_fields = read_page(page_of(head, payload))
    linked = {
        "target_uri": source["target_uri"], "date": source["date"], "refers_to": source["record_id"],
        "refers_to_target_uri": source["target_uri"], "refers_to_date": source["date"],
        "source_headers": "; ".join(head.split("\r\n")) or None,
        "payload_digest": source["payload_digest"] or digest(payload),
    }
    text = plain.encode()
    own = source["record_id"] or ""
    conversion = record_id("conversion", own, linked["payload_digest"])
    told = [("via", own), ("conversion", conversion), ("source-block-digest", source["block_digest"] or ""), *page_fields]
    block = "".join(f"{k}: {v}\r\n" for k, v in told if v).encode()
    return [
        dict.fromkeys(RECORD) | linked | {
            "warc_type": "metadata", "record_id": record_id("metadata", own, linked["payload_digest"]),
            "content_type": "application/warc-fields", "block_digest": digest(block), "block": block,
        },
        dict.fromkeys(RECORD) | linked | {
            "warc_type": "conversion", "record_id": conversion, "content_type": "text/plain; charset=utf-8",
            "block_digest": digest(text), "block": text,
        },
    ]


def _batch(rows: list[int | None], records: list[dict]) -> pa.RecordBatch:
    columns = [pa.array([r[c] for r in records], t) for c, t in _TYPES.items()]
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), *columns], ["row", *RECORD])


def responses(
    pages: DataFrame, *, id: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z"
) -> DataFrame:
    """Response records of stored pages: ``row`` (the id) and the columns of :data:`RECORD`.

    A null page has an empty payload; a null url is left out of the headers. ``date`` is what is not known of them.
    Rows with one id, url and page give equal records.
    """
    frame = pages.select(*[F.col(f"`{c}`").cast(t) for c, t in ((id, "long"), (url, "string"), (html, "string"))])

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for at in range(0, len(batch), 256):
                rows, urls, texts = (c.to_pylist() for c in batch.slice(at, 256).columns)
                yield _batch(rows, [response(u, t, str(r), date) for r, u, t in zip(rows, urls, texts, strict=True)])

    return frame.mapInArrow(streaming(work), _SCHEMA)


def derivatives(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of the response records among ``records``; others have none.

    Same columns; two rows for each response. Chunks, gzip and charsets are undone (:func:`page_of`). A record
    with no payload gives an empty text and a metadata record without page fields.
    """
    frame = records.where("warc_type = 'response'").select("row", *RECORD)

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for at in range(0, len(batch), 256):
                some = batch.slice(at, 256).to_pylist()
                made = [(r["row"], d) for r in some for d in derive(r)]
                yield _batch([row for row, _ in made], [d for _, d in made])

    return frame.mapInArrow(streaming(work), _SCHEMA)


def serialized(records: DataFrame) -> DataFrame:
    """``row``, ``warc_type``, ``record_id`` and ``record``: the bytes of each record in a WARC file."""

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                data = [serialize(r) for r in part.select(list(RECORD)).to_pylist()]
                columns = [part.column(part.schema.get_field_index(c)) for c in ("row", "warc_type", "record_id")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(data, pa.binary())], ["row", "warc_type", "record_id", "record"])

    return records.select("row", *RECORD).mapInArrow(streaming(work), "row long, warc_type string, record_id string, record binary")


def parsed(files: DataFrame, *, content: str = "content") -> DataFrame:
    """The records of WARC data in a binary column, with ``row`` null; inverse of :func:`serialized`."""

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for data in batch.column(0).to_pylist():
                records = parse(data or b"")
                yield _batch([None] * len(records), records)

    return files.select(F.col(f"`{content}`").cast("binary")).mapInArrow(streaming(work), _SCHEMA)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    """Both derivatives of every page of ``pages``: links, headers and digests."""
    made = derivatives(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return made.select(
        F.col("row").alias("page_id"), "warc_type", "record_id", "refers_to", "target_uri", "source_headers", "content_type",
        F.octet_length("block").cast("long").alias("content_length"), "block_digest", "payload_digest",
        F.sha2("block", 256).alias("block_sha256"),
    )

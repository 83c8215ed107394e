"""WARC derivatives: from response records to linked metadata and plain-text conversion records.

A response record (WARC/1.1) is taken apart into its WARC headers, the HTTP headers and the payload. For each, two
records are built that point back at it: a ``metadata`` record (application/warc-fields: what the server said and what
the page says about itself) and a ``conversion`` record (text/plain: the page's visible text). Both carry
WARC-Refers-To with the response's record id, the target URI and date, and WARC-Refers-To-Target-URI and -Date; block
digests are those of the new blocks, and the source's payload digest and HTTP headers are kept in the metadata. Record
ids are name-based, so a run repeats them.

One pass, no shuffle: each response becomes its two records where it lies. ``records`` reads WARC files, gzipped by record
or not. Chunked, gzip and deflate bodies are undone for the text; digests are those of the payload as it was stored. A page
is read in one pass, in time proportional to its length. Links inside comments, scripts and other hidden parts are left out.

Defined cases: a null or empty page gives an empty payload and empty text; a null URI leaves the target headers out; a
record that can't be parsed, or whose coding isn't known, gives a metadata record with ``parse-error`` and an empty
conversion; a hidden element that isn't closed hides the rest if it is a script or style, else nothing; repeated rows repeat
their records; an empty table gives an empty result; other columns aren't read.
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
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = uuid.UUID("6f0c9d8e-52f6-5a44-9d7a-0b6a6d1b2f11")
#: What opens a comment (1), a closing tag (2: its name) or a tag (3: its name); a declaration or a closing tag without a name has no group. None holds a ">".
MARK = re.compile(r"<(?:(!--)|/([a-zA-Z][a-zA-Z0-9-]*)?|([a-zA-Z][a-zA-Z0-9-]*)|[!?])")
LINE_ENDS = re.compile(r"[\r\n]+")
HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
HIDDEN = frozenset("script style template noscript head".split())
BREAKS = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table article section header footer nav main aside blockquote pre dl dt dd hr form figure title body html".split())


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, '|'.join(map(str, parts)))}>"


def record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A WARC record: version, header fields that have a value, and the block."""
    head = "".join(f"{k}: {one_line(v)}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))] if v is not None)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def one_line(value: str) -> str:
    return LINE_ENDS.sub(" ", value) if "\n" in value or "\r" in value else value


def lowered(page: str) -> str:
    """A-Z in lower case, every character in its place; ``str.translate`` takes a dictionary lookup a character outside ASCII."""
    return page.lower() if page.isascii() else page.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def headers(block: bytes) -> list[tuple[str, str]]:
    """Header fields of a block of lines; folded lines belong to the one before."""
    out: list[tuple[str, str]] = []
    for line in block.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1] = out[-1][0], f"{out[-1][1]} {line.strip()}"
        elif ":" in line:
            k, _, v = line.partition(":")
            out.append((k.strip(), v.strip()))
    return out


def response(page_id: object, uri: str | None, body: bytes, date: str) -> bytes:
    """A response record of a page as it would have been fetched."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", page_id, uri)), ("WARC-Date", date), ("WARC-Target-URI", uri), ("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(body))]
    return record(fields, block)


def unchunked(body: bytes) -> bytes:
    """A chunked body put together; what is no chunk ends it."""
    out, at = [], 0
    while (line := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:line].split(b";")[0], 16)
        except ValueError:
            return body if not out else b"".join(out)
        if size <= 0:
            break
        out.append(body[line + 2 : line + 2 + size])
        at = line + 2 + size + 2
    return b"".join(out)


def inflated(body: bytes) -> bytes | None:
    """A gzip or deflate body, its members one after another; None for one that isn't."""
    for kind in (47, -15):  # with a header of either kind; without one
        out, left = [], body
        try:
            while left:
                work = zlib.decompressobj(kind)
                out.append(work.decompress(left) + work.flush())
                left = work.unused_data if work.eof and kind > 0 else b""
            return b"".join(out)
        except zlib.error:
            continue
    return None


class Response:
    """A parsed response record; header names in any case, the record itself gzipped or not."""

    def __init__(self, raw: bytes):
        if raw[:2] == b"\x1f\x8b":
            raw = inflated(raw) or b""
        head, gap, rest = raw.partition(b"\r\n\r\n")
        given = headers(head) if gap and head.startswith(b"WARC/") else []
        names = {n.lower(): n for n in ("Content-Length", "WARC-Target-URI", "WARC-Date", "WARC-Record-ID", "WARC-Payload-Digest", "WARC-Type")}
        self.warc = {names.get(k.lower(), k): v for k, v in given}
        size = self.warc.get("Content-Length", "")
        self.ok = bool(self.warc) and size.isascii() and size.isdigit() and int(size) <= len(rest) and self.warc.get("WARC-Type", "response").lower() == "response"
        block = rest[: int(size)] if self.ok else b""
        http, gap, self.payload = block.partition(b"\r\n\r\n")
        self.status, _, lines = http.partition(b"\r\n")
        self.ok = self.ok and bool(gap) and self.status.startswith(b"HTTP/")
        self.http = headers(lines)
        self.digest = digest(self.payload)

    def header(self, name: str) -> str:
        return next((v for k, v in self.http if k.lower() == name), "")

    def body(self) -> bytes | None:
        """The payload without transfer and content coding; None where that can't be undone."""
        body = unchunked(self.payload) if "chunked" in self.header("transfer-encoding").lower() else self.payload
        coding = self.header("content-encoding").lower().strip()
        if coding in ("", "identity") or not body:
            return body
        return inflated(body) if coding in ("gzip", "x-gzip", "deflate") else None

    def text(self) -> str:
        charset = re.search(r"charset=\"?([\w-]+)", self.header("content-type"), re.I)
        body = self.body() or b""
        try:
            return body.decode(charset[1] if charset else "utf-8", "replace")
        except (LookupError, ValueError):
            return body.decode("utf-8", "replace")


class Page:
    """The visible text, links, title and language of a page, from one pass over it that looks at no place twice."""

    def __init__(self, page: str):
        low = lowered(page)
        self.links: list[str] = []
        out: list[str] = []
        unclosed: set[str] = set()
        at, n = 0, len(page)
        while mark := MARK.search(page, at):
            i = mark.start()
            out.append(page[at:i])
            kind = mark.lastindex
            if kind == 1:
                end = page.find("-->", i + 4)
                at = n if end < 0 else end + 3
                out.append(" ")
                continue
            end = page.find(">", mark.end())
            if end < 0:  # no tag from here on
                at = i
                break
            at = end + 1
            if kind is None:
                continue
            name = mark[kind].lower()
            if name in BREAKS:
                out.append("\n")
            elif kind == 2:
                continue
            elif name == "a":
                if m := HREF.search(page, i, at):
                    self.links.append(html.unescape(next((x for x in m.groups() if x), "")))
            elif name in HIDDEN and name not in unclosed:
                close = low.find(f"</{name}", end)
                if close >= 0:
                    stop = page.find(">", close)
                    at = n if stop < 0 else stop + 1
                elif name in ("script", "style"):
                    at = n
                else:
                    unclosed.add(name)
                out.append(" ")
        out.append(page[at:])
        self.links = [x for x in self.links if x]
        lines = (" ".join(x.split()) for x in html.unescape("".join(out)).split("\n"))
        self.text = "\n".join(x for x in lines if x)
        self.title = self._title(page, low)
        head = low.find("<html")
        m = LANG.search(page, head, page.find(">", head) + 1) if head >= 0 else None
        self.lang = m[1] if m else None

    @staticmethod
    def _title(page: str, low: str) -> str | None:
        start = low.find("<title")
        begin = page.find(">", start) + 1 if start >= 0 else 0
        end = low.find("</title", begin) if begin else -1
        return html.unescape(" ".join(page[begin:end].split())) if end >= 0 else None


def plain_text(page: str) -> str:
    """The visible text of a page: blocks on lines of their own, entities resolved, runs of space collapsed."""
    return Page(page).text


def derived(raw: bytes) -> list[dict]:
    """The metadata and the conversion record of a response."""
    r = Response(raw)
    uri, date, source = r.warc.get("WARC-Target-URI"), r.warc.get("WARC-Date"), r.warc.get("WARC-Record-ID")
    coded = r.ok and r.body() is None
    page = Page(r.text() if r.ok else "")
    stated = r.warc.get("WARC-Payload-Digest")
    facts = [("parse-error", "not a response record" if not r.ok else "unknown content coding" if coded else None), ("http-status", r.status.decode("utf-8", "replace") or None), *[(f"http-header-{k.lower()}", v) for k, v in r.http], ("source-payload-digest", r.digest), ("source-digest-agrees", None if stated is None else str(stated == r.digest).lower()), ("title", page.title), ("language", page.lang), *[("outlink", x) for x in page.links]]
    blocks = {"metadata": ("application/warc-fields", "".join(f"{k}: {one_line(v)}\r\n" for k, v in facts if v is not None).encode("utf-8", "replace")), "conversion": ("text/plain; charset=utf-8", page.text.encode("utf-8", "replace"))}
    ids = {kind: record_id(kind, source, uri) for kind in blocks}
    out = []
    for kind, (content, block) in blocks.items():
        other, own = ids["conversion" if kind == "metadata" else "metadata"], digest(block)
        fields = [("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Concurrent-To", other if kind == "metadata" else None), ("WARC-Block-Digest", own), ("WARC-Payload-Digest", own if kind == "conversion" else None), ("Content-Type", content)]
        out.append({"warc_type": kind, "record_id": ids[kind], "refers_to": source, "target_uri": uri, "warc_date": date, "content_type": content, "content_length": len(block), "block_digest": own, "source_digest": r.digest, "source_headers": "\r\n".join(f"{k}: {v}" for k, v in r.http), "record": record(fields, block)})
    return out


SCHEMA = pa.schema([("warc_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("content_type", pa.string()), ("content_length", pa.int64()), ("block_digest", pa.string()), ("source_digest", pa.string()), ("source_headers", pa.string()), ("record", pa.binary())])
SCHEMA_SQL = "warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, source_digest string, source_headers string, record binary"


def split_records(content: bytes) -> Iterator[bytes]:
    """The records of a WARC file, by their lengths; what can't be told apart is one last record."""
    if content[:2] == b"\x1f\x8b":
        content = inflated(content) or b""
    at = 0
    while at < len(content):
        while content[at : at + 2] == b"\r\n":
            at += 2
        gap = content.find(b"\r\n\r\n", at)
        if gap < 0:
            if content[at:].strip():
                yield content[at:]
            return
        m = re.search(rb"(?im)^content-length:\s*([0-9]+)\s*$", content[at:gap].replace(b"\r\n", b"\n"))
        end = min(len(content), gap + 4 + int(m[1])) if m else len(content)
        yield content[at:end]
        at = end


def records(spark: SparkSession, path: str) -> DataFrame:
    """(path, page_id, record) of the response records in WARC files (of under 2 GB each); page_id counts in a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for number, raw in enumerate(split_records(content or b"")):
                    if dict((k.lower(), v) for k, v in headers(raw.partition(b"\r\n\r\n")[0])).get("warc-type", "").lower() == "response":
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([number], pa.int64()), pa.array([raw], pa.binary())], names=["path", "page_id", "record"])

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", "content").mapInArrow(run, "path string, page_id long, record binary")


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """(page_id, record): a response record for each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[c.to_pylist() for c in batch.columns], strict=True)
            made = [response(i, u, (h or "").encode("utf-8", "surrogatepass"), date) for i, u, h in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["page_id", "record"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, record binary")


def derivatives(records: DataFrame, id_col: str = "page_id", record_col: str = "record", group: int = 500) -> DataFrame:
    """Two rows for each response record: its metadata and its conversion."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, group):
                part = batch.slice(i, group)
                ids, rows = [], []
                for page, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for made in derived(raw or b""):
                        ids.append(page)
                        rows.append(made)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array([r[f.name] for r in rows], f.type) for f in SCHEMA]], names=["page_id", *SCHEMA.names])

    return records.select(F.col(id_col).cast("long").alias("page_id"), F.col(record_col).alias("record")).mapInArrow(run, f"page_id long, {SCHEMA_SQL}")

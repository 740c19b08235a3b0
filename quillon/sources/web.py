"""Web archives: records, documents, links."""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import html_to_text

RECORD = "path string, position bigint, kind string, uri string, trec_id string, headers map<string,string>, content binary"


#: Bytes of a file that are sent at once, that one look takes, and that are kept behind it.
PIECE, LOOK, BEHIND = 4 << 20, 1 << 16, 1 << 18


class Pieces:
    """A file that comes piece by piece; only what lies near the last look is held."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.held, self.start, self.done = pieces, b"", 0, False
        self.packed = self.look(0, 2) == b"\x1f\x8b"

    def look(self, at: int, n: int = LOOK) -> bytes:
        while at + n > self.start + len(self.held) and not self.done:
            piece = next(self.pieces, None)
            if piece is None:
                self.done = True
                break
            keep = max(0, min(at, self.start + len(self.held)) - BEHIND - self.start)
            self.held, self.start = self.held[keep:] + piece, self.start + keep
        return self.held[at - self.start : at - self.start + n]

    def find(self, what: bytes, at: int) -> int:
        """Where it begins, from a place on; -1 if it doesn't come."""
        while part := self.look(at, LOOK + len(what)):
            if (found := part.find(what)) >= 0:
                return at + found
            if len(part) < LOOK + len(what):
                return -1
            at += LOOK
        return -1


class Members(io.RawIOBase):
    """The bytes of a gzip file of one or more members, or of a plain one, whatever its name, from a place on.  ``broken`` tells
    where a member that can't be read to its end lies."""

    def __init__(self, raw: Pieces, at: int = 0) -> None:
        self.raw, self.at, self.ready, self.broken = raw, at, b"", -1
        self.unzip = zlib.decompressobj(31) if raw.packed else None

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:  # noqa: ANN001
        while not self.ready and self.broken < 0:
            tail = self.unzip.unconsumed_tail if self.unzip else b""
            part = tail or self.raw.look(self.at)
            if not part:
                break
            begin = self.at - len(tail)
            self.at += 0 if tail else len(part)
            if self.unzip is None:
                self.ready = part
                continue
            try:
                self.ready = self.unzip.decompress(part, 1 << 20)
            except zlib.error:
                self.broken = begin
                break
            if self.unzip.eof:  # the next member
                self.at -= len(self.unzip.unused_data)
                self.unzip = zlib.decompressobj(31)
        n = min(len(buffer), len(self.ready))
        buffer[:n], self.ready = self.ready[:n], self.ready[n:]
        return n


def streams(raw: Pieces) -> Iterator[io.BufferedReader]:
    """What can be read of a file: one stream, or, behind each broken member, another that begins with the next that can be read."""
    at = 0
    while at >= 0:
        members = Members(raw, at)
        yield io.BufferedReader(members)
        at = raw.find(b"\x1f\x8b\x08", members.broken + 1) if members.broken >= 0 else -1


def records(pieces: Iterator[bytes]) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(number, headers, content) of each record of an archive.  Header names are in lower case; what stands before a
    record's first line is passed over; a record without a length is empty, one that is cut off isn't given."""
    number = 0
    for stream in streams(Pieces(pieces)):
        for headers, content in records_of(stream):
            yield number, headers, content
            number += 1


def records_of(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes]]:
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip().upper().startswith(b"WARC/"):
            continue
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, colon, value = line.decode("utf-8", "replace").partition(":")
            if colon:
                headers[name.strip().lower()] = value.strip()
        try:
            size = int(headers.get("content-length", "0"))
        except ValueError:
            size = 0
        content = stream.read(size)
        if len(content) < size:
            while stream.read(LOOK):  # to the end, so that what is broken is known
                pass
            return
        yield headers, content


def read_archive(spark: SparkSession, path: str, pattern: str = "*.warc*") -> DataFrame:
    """Records of all archives under a path, a file a task; files come to Python in pieces, and records leave it in small batches, so that
    it holds a few MB and one record at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")
    last = F.floor((F.octet_length("content") - 1) / PIECE).cast("int")
    numbered = files.where(F.octet_length("content") > 0).select("path", "content", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    pieces = numbered.select("path", F.expr(f"substring(content, i * {PIECE} + 1, {PIECE})").alias("piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("position", pa.int64()), ("kind", pa.string()), ("uri", pa.string()), ("trec_id", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("content", pa.binary())])
        each = ((batch.column(0)[i].as_py(), batch.column(1)[i].as_py()) for batch in batches for i in range(batch.num_rows))
        for name, parts in groupby(each, key=itemgetter(0)):
            rows, size = [], 0
            for number, headers, content in records(piece for _, piece in parts):
                rows.append({"path": name, "position": number, "kind": headers.get("warc-type"), "uri": headers.get("warc-target-uri"), "trec_id": headers.get("warc-trec-id"), "headers": list(headers.items()), "content": content})
                size += len(content)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return pieces.mapInArrow(run, RECORD)


def document_number(trec_id: Column) -> Column:
    """The digits of a document's name from its "en" on."""
    return F.regexp_replace(F.regexp_extract(trec_id, "(en.*)$", 1), "[^0-9]", "").try_cast("bigint")


def body(content: Column) -> Column:
    """The document of a response: from the first < after its length header, or the first < at all."""
    text = content.cast("string")
    return F.regexp_extract(text, r"(?is)(?:^.*?content-length:[^\n]*\n)?.*?(<.*)$", 1)


def documents(archive: DataFrame, as_text: bool = True) -> DataFrame:
    """(doc_id, uri, html or text) of the responses."""
    rows = archive.where("kind = 'response'").select(document_number(F.col("trec_id")).alias("doc_id"), "uri", body(F.col("content")).alias("html"))
    return rows.select("doc_id", "uri", html_to_text("html").alias("text")) if as_text else rows


def normal_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no default port, a path at least."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    head = F.lower(F.regexp_extract(plain, r"^(?i)(https?://[^/?]+)", 1))
    rest = F.regexp_replace(plain, r"^(?i)https?://[^/?]+", "")
    bare = F.regexp_replace(F.regexp_replace(head, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    return F.when(head == "", None).otherwise(F.concat(bare, F.when(rest == "", "/").when(rest.startswith("?"), F.concat(F.lit("/"), rest)).otherwise(rest)))


def plain_path(path: Column) -> Column:
    """A path without . and .. segments; what would lead above the root leads to it."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda done, p: F.when(p == "..", F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)).when(p == ".", done).otherwise(F.array_append(done, p)),
    )
    return F.array_join(F.when(last.isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept), "/")


def resolve(base: Column, link: Column) -> Column:
    """The address that a link of a page leads to; null for other schemes than http and https, and for a page without a host."""
    bare = F.regexp_replace(F.trim(base), r"[?#].*$", "")
    host = F.regexp_extract(bare, r"^(?i)(https?://[^/?#]+)", 1)
    path = F.regexp_extract(bare, r"^(?i)https?://[^/]+(/.*)$", 1)
    folder = F.concat(F.regexp_replace(path, r"[^/]*$", ""), F.when(path == "", "/").otherwise(""))
    own = F.regexp_extract(link, r"^([^?#]*)", 1)
    tail = F.substring(link, F.length(own) + 1, F.length(link))
    there = (
        F.when(link.rlike("^(?i)https?://"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(host, "^([^:]+:)", 1), link))
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(own == "", F.concat(host, F.when(path == "", "/").otherwise(path), tail))
        .when(link.startswith("/"), F.concat(host, plain_path(own), tail))
        .otherwise(F.concat(host, plain_path(F.concat(folder, own)), tail))
    )
    return F.when(there.rlike("^(?i)https?://[^/]"), there)


def out_links(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, url): distinct normal addresses that a page's anchors lead to, relative ones resolved against the page's own."""
    links = F.explode(F.regexp_extract_all(html_col, F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""), F.lit(1)))
    rows = pages.select(F.col(id_col), F.col(url_col).alias("__base"), links.alias("__link"))
    return rows.select(id_col, normal_url(resolve(F.col("__base"), F.col("__link"))).alias("url")).where("url is not null").distinct()

"""WARC derivatives: each response gives a metadata and a plain-text conversion record.

Both point back at the response (WARC-Refers-To), carry its target, date and
payload digest on, and have digests of their own. The metadata record keeps the
response's HTTP headers, the title, the language and the outgoing links. Record
identifiers derive from the contents, so a job that is run again writes the
same bytes. ``write_warc`` and ``read_warc`` use Spark's own writers and
readers, so any store that Spark knows will do.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learnlake.llm.common import small_batches

VERSION = b"WARC/1.1"
#: For pages without a time of capture.
NO_DATE = "1970-01-01T00:00:00Z"

RECORD = "page_id long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, payload_digest string, block_digest string, block_length long, record binary"
COLUMNS = [x.split()[0] for x in RECORD.split(", ")]

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"""</?(?:p|div|br|hr|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|nav|aside|blockquote|pre|title|form|dd|dt)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""", re.I)
_TAG = re.compile(r"""<[a-zA-Z/!?](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|<[a-zA-Z/!?][^>]*+>""")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title", re.S | re.I)
_LANG = re.compile(r"""<html\b[^>]*?\blang\s*=\s*["']?([\w-]+)""", re.I)
_HREF = re.compile(r"""<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: object) -> str:
    name = hashlib.sha1("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")).digest()[:16]
    return f"<urn:uuid:{uuid.UUID(bytes=name, version=5)}>"


def one_line(value: str) -> str:
    return re.sub(r"\s+", " ", value).strip()


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record; headers without a value are left out, and values can't break out of their line."""
    lines = [VERSION, *(f"{k}: {one_line(v)}".encode("utf-8", "replace") for k, v in headers if v), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a WARC file, gzipped or not."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    at = 0
    while (at := raw.find(b"WARC/", at)) >= 0:
        end = raw.find(b"\r\n\r\n", at)
        if end < 0:
            return
        headers: dict[str, str] = {}
        for line in raw[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers.get("content-length") or 0)
        yield headers, raw[end + 4 : end + 4 + size]
        at = end + 4 + size


def split_http(block: bytes) -> tuple[str, bytes]:
    """HTTP head and payload of a response block; a block without a head is all payload."""
    if not block.startswith(b"HTTP/"):
        return "", block
    head, _, payload = block.partition(b"\r\n\r\n")
    return head.decode("latin-1"), payload


def plain_text(page: str) -> str:
    """The visible text: a line for each block element, without scripts, styles, comments and tags."""
    text = _TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub(" ", page)))
    lines = (" ".join(x.split()) for x in html.unescape(text).split("\n"))
    return "\n".join(x for x in lines if x)


def metadata_block(page: str, head: str, payload_digest: str, conversion_id: str) -> bytes:
    """application/warc-fields: what the conversion loses, with every distinct outlink."""
    title, lang = _TITLE.search(page), _LANG.search(page)
    fields = [("conversion", conversion_id), ("source-payload-digest", payload_digest)]
    fields += [("title", one_line(html.unescape(_TAG.sub("", title[1]))))] if title else []
    fields += [("languageOfDocument", lang[1])] if lang else []
    status, *headers = head.split("\r\n") if head else [""]
    fields += [("source-status", status)] if status else []
    fields += [("source-header", h) for h in headers if h]
    seen = dict.fromkeys(one_line(html.unescape(next(filter(None, m), ""))) for m in _HREF.findall(page))
    fields += [("outlink", x) for x in seen if x]
    return "".join(f"{k}: {one_line(v)}\r\n" for k, v in fields).encode("utf-8", "replace")


def _row(page_id, kind: str, rid: str, refers_to: str | None, uri: str | None, date: str, content_type: str, payload: str | None, block: bytes) -> tuple:
    headers = [
        ("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Refers-To", refers_to or ""), ("WARC-Target-URI", uri or ""), ("WARC-Date", date),
        ("WARC-Payload-Digest", payload or ""), ("WARC-Block-Digest", own := digest(block)), ("Content-Type", content_type),
    ]
    return page_id, kind, rid, refers_to, uri, date, content_type, payload, own, len(block), record_bytes(headers, block)


def response_row(page_id: int | None, uri: str | None, page: str | None, date: str = NO_DATE) -> tuple:
    """The response record of a crawled page; a null page is an empty payload."""
    payload = (page or "").encode("utf-8", "surrogatepass")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    found = digest(payload)
    return _row(page_id, "response", record_id("response", page_id, uri, date, found), None, uri, date, "application/http; msgtype=response", found, head + payload)


def derivative_rows(page_id: int | None, response: bytes) -> list[tuple]:
    """The metadata and the conversion record of a response record; none for a record of another type.

    A payload digest that the response has is carried on as it is; one that it
    lacks is worked out.
    """
    out = []
    for headers, block in parse_records(response):
        if headers.get("warc-type") != "response":
            continue
        head, payload = split_http(block)
        page = payload.decode("utf-8", "replace")
        found = headers.get("warc-payload-digest") or digest(payload)
        source, uri, date = headers.get("warc-record-id") or record_id("response", digest(block)), headers.get("warc-target-uri"), headers.get("warc-date") or NO_DATE
        text = plain_text(page).encode("utf-8", "replace")
        conversion = record_id("conversion", source)
        meta = metadata_block(page, head, found, conversion)
        out.append(_row(page_id, "metadata", record_id("metadata", source), source, uri, date, "application/warc-fields", found, meta))
        out.append(_row(page_id, "conversion", conversion, source, uri, date, "text/plain; charset=utf-8", found, text))
    return out


def _mapped(df: DataFrame, rows) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), 500):
                found = [r for x in frame.iloc[lo : lo + 500].itertuples(index=False, name=None) for r in rows(x)]
                yield pd.DataFrame(found, columns=COLUMNS).astype({"page_id": "Int64"})

    small_batches(df.sparkSession)
    return df.mapInPandas(run, RECORD)


def responses(pages: DataFrame, date: str = NO_DATE) -> DataFrame:
    """A response record for each page (page_id, url, html); nulls, repeated rows and further columns are allowed."""
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return _mapped(plain, lambda x: [response_row(None if pd.isna(x[0]) else int(x[0]), x[1], x[2], date)])


def derivatives(records: DataFrame) -> DataFrame:
    """Two records for each response among records (page_id, record); row by row, nothing is shuffled."""
    plain = records.select(F.col("page_id").cast("long").alias("page_id"), F.col("record").cast("binary").alias("record"))
    return _mapped(plain, lambda x: derivative_rows(None if pd.isna(x[0]) else int(x[0]), bytes(x[1] or b"")))


def page_derivatives(pages: DataFrame, date: str = NO_DATE) -> DataFrame:
    """derivatives(responses(pages)) in one pass over the pages.

    Every page gives two records: a null or empty html an empty conversion, a
    null url a record without target; repeated rows give repeated records, with
    equal identifiers; further columns are ignored; an empty table gives none.
    """
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def both(x: tuple) -> list[tuple]:
        page_id = None if pd.isna(x[0]) else int(x[0])
        return derivative_rows(page_id, response_row(page_id, x[1], x[2], date)[-1])

    return _mapped(plain, both)


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """A WARC file for each partition, of records whose blocks are UTF-8."""
    text = F.decode("record", "UTF-8")
    # the writer ends each value with \n, which is the record's own last character
    records.select(F.substring(text, F.lit(1), F.length(text) - 1).alias("value")).write.option("lineSep", "\n").option("compression", compression).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, warc_type, record_id, refers_to, target_uri, block, block_crc32) of every record of the WARC files at a path."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, raw in zip(frame["path"], frame["content"]):
                rows = [(name, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-refers-to"), h.get("warc-target-uri"), b, zlib.crc32(b)) for h, b in parse_records(bytes(raw))]
                yield pd.DataFrame(rows, columns=["file", "warc_type", "record_id", "refers_to", "target_uri", "block", "block_crc32"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, warc_type string, record_id string, refers_to string, target_uri string, block binary, block_crc32 long")

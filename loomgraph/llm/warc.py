"""Legacy archive converter: ARC records of either version become WARC records, written as archives and read back.

ARC header lines are parsed by the version that the archive's first block declares, payloads are cut by their declared
lengths. Record identifiers (name-based UUIDs), timestamps, types and SHA-1 digests in base32 are synthesised from
them. Of records with equal payloads one stays a response, the others become revisits that refer to it.

Scale: payloads never move between tasks unless revisits are many. A first pass yields a narrow table of digests; a
sum by digest finds the repeated ones; the list of revisits joins the pages again (broadcast by Spark if its written
size is small, else by a sort-merge join that adaptive execution may split). Archives are written by Spark's own
committer, gzip files of at most ARCS_PER_FILE archives of ARC_BYTES each (and the longest page), so a reader holds a
bounded number of bytes whatever a page's length, and a lost task leaves nothing behind.

Defined results: null html is an empty payload; a null or empty url is recorded as about:blank; a null page_id is
recorded without one and read back as null, and is the response of its payload only if no record with a page_id has
it; rows that repeat a page_id and payload have the same type; an empty table gives an empty archive and no rows;
columns other than page_id, url and html are ignored.
"""

import base64
import gzip
import hashlib
import io
import re
import uuid
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import as_bytes, durable, fresh_path, table

ARC_BYTES, ARCS_PER_FILE = 4 << 20, 8
ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = datetime(2000, 1, 1, tzinfo=timezone.utc)
UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def b32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---- ARC


def arc_start(name: str, version: int) -> bytes:
    block = f"{version} 0 loomgraph\n{ARC_FIELDS[version]}\n".encode()
    more = "" if version == 1 else "200 - - 0 " + name + " "
    return f"filedesc://{name} 0.0.0.0 20000101000000 text/plain {more}{len(block)}\n".encode() + block


def arc_record(version: int, name: str, offset: int, url: str, date: str, kind: str, block: bytes) -> bytes:
    more = "" if version == 1 else f"200 {hashlib.md5(block).hexdigest()} - {offset} {name} "
    return f"\n{url} 0.0.0.0 {date} {kind} {more}{len(block)}\n".encode() + block


def parse_arc(data: bytes):
    """(fields by name, block) of each record after the version block."""
    end = data.index(b"\n")
    length = int(data[:end].rsplit(b" ", 1)[1])
    lines = data[end + 1 : end + 1 + length].split(b"\n")
    names = lines[1].decode().split(" ")
    if int(lines[0].split(b" ")[0]) not in ARC_FIELDS or names != ARC_FIELDS[int(lines[0].split(b" ")[0])].split(" "):
        raise ValueError(f"not an ARC version block: {lines[:2]}")
    at = end + 1 + length
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        fields = dict(zip(names, data[at:end].decode("utf-8", "replace").rsplit(" ", len(names) - 1)))
        length = int(fields["Archive-length"])
        if end + 1 + length > len(data):
            raise ValueError(f"record of {fields['URL']} declares {length} bytes, {len(data) - end - 1} are left")
        yield fields, data[end + 1 : end + 1 + length]
        at = end + 1 + length


def page_to_arc(version: int, name: str, offset: int, page_id, url: str, html: bytes) -> bytes:
    mark = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n{mark}\r\n".encode()
    date = (EPOCH + timedelta(seconds=(page_id or 0) % (10**9))).strftime("%Y%m%d%H%M%S")
    url = UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) or "about:blank"
    return arc_record(version, name, offset, url, date, "text/html", head + html)


def arcs_of(pages: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """content: ARC archives of about ARC_BYTES, of both versions in turn; extra columns go along as lists, one value per record."""
    extra = extra or []
    src = pages.select("page_id", "url", "html", *extra)
    schema = "content binary" + "".join(f", `{c}` array<{src.schema[c].dataType.simpleString()}>" for c in extra)

    def build(it):
        n = 0
        for batch in it:
            held, values, start = [], [[] for _ in extra], True
            size = 0
            for row in zip(batch.column("page_id").to_pylist(), as_bytes(batch.column("url")), as_bytes(batch.column("html")), *[batch.column(c).to_pylist() for c in extra]):
                if start:
                    version, name, start = n % 2 + 1, f"part-{n}.arc", False
                    held, size, n = [arc_start(name, version)], 0, n + 1
                held.append(page_to_arc(version, name, size, row[0], row[1].decode("utf-8", "replace"), row[2]))
                size += len(held[-1])
                for v, x in zip(values, row[3:]):
                    v.append(x)
                if size >= ARC_BYTES:
                    yield one(b"".join(held), values, batch.schema)
                    held, values, start = [], [[] for _ in extra], True
            if held:
                yield one(b"".join(held), values, batch.schema)

    def one(content, values, of):
        return pa.RecordBatch.from_arrays([pa.array([content], pa.binary()), *[pa.array([v], pa.list_(of.field(c).type)) for c, v in zip(extra, values)]], names=["content", *extra])

    return src.mapInArrow(build, schema)


# ---- ARC to WARC


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """The head with its closing empty line, and the payload; no head if it isn't an HTTP response."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    at = block.find(b"\r\n\r\n")
    return (block[: at + 4], block[at + 4 :]) if at >= 0 else (block, b"")


def header(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode("utf-8", "replace").strip() if m else None


def describe(fields: dict, block: bytes) -> dict:
    """What a WARC record of an ARC record says."""
    head, payload = http_parts(block)
    date = datetime.strptime((fields["Archive-date"] + "0" * 14)[:14], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    digest, page = b32(payload), header(head, "X-Page-Id")
    return {
        "record_id": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join((fields['URL'], date, digest, page or '')))}>",
        "type": "response" if head else "resource", "uri": fields["URL"], "date": date, "ip": fields["IP-address"], "head": head, "payload": payload,
        "digest": digest, "kind": "application/http; msgtype=response" if head else fields["Content-type"], "page_id": None if page is None else int(page),
    }


def warc_record(r: dict, refers_to: tuple | None = None) -> bytes:
    """The bytes of a record; refers_to: page_id, record id, uri and date of the response that a revisit refers to."""
    block = r["head"] + (b"" if refers_to else r["payload"])
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else r['type']}", f"WARC-Record-ID: {r['record_id']}", f"WARC-Date: {r['date']}", f"WARC-Target-URI: {r['uri']}", f"WARC-IP-Address: {r['ip']}"]
    lines += [f"WARC-Payload-Digest: sha1:{r['digest']}", f"WARC-Block-Digest: sha1:{b32(block)}", f"Content-Type: {r['kind']}", f"Content-Length: {len(block)}"]
    if refers_to:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {refers_to[1]}", f"WARC-Refers-To-Target-URI: {refers_to[2]}", f"WARC-Refers-To-Date: {refers_to[3]}", f"X-Refers-To-Page-Id: {refers_to[0]}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warcinfo(arc: bytes) -> bytes:
    """The record of an ARC archive's version block: its name, date and software."""
    uri, ip, date = arc[: arc.index(b"\n")].decode("utf-8", "replace").split(" ")[:3]
    day = datetime.strptime(date, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    block = b"software: loomgraph\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, b32(arc))}>", f"WARC-Date: {day}", f"WARC-Filename: {uri.removeprefix('filedesc://')}"]
    lines += [f"WARC-Block-Digest: sha1:{b32(block)}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_records(stream):
    """(headers by lower-case name, block) of each record of a WARC stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]):
            raise ValueError(f"record {headers.get('warc-record-id')} is cut short")
        yield headers, block


DIGESTS = "page_id long, sha1 string, record_id string, uri string, date string"


def digests_of(arcs: DataFrame) -> DataFrame:
    """page_id, sha1 (hex, of the payload), record_id, uri, date of each record of ARC archives."""

    def read(it):
        for batch in it:
            for content in as_bytes(batch.column("content")):
                rows = [(d["page_id"], base64.b32decode(d["digest"]).hex(), d["record_id"], d["uri"], d["date"]) for d in (describe(*x) for x in parse_arc(content))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), *[pa.string()] * 4])] if rows else [pa.array([], t) for t in [pa.int64(), *[pa.string()] * 4]], names=["page_id", "sha1", "record_id", "uri", "date"])

    return arcs.mapInArrow(read, DIGESTS)


def warcs_of(arcs: DataFrame) -> DataFrame:
    """value: the WARC records of each ARC archive whose column refers_to has, for each record, null or what it refers to,
    after a warcinfo record for its version block. The last byte is left to the writer's line end."""

    def convert(it):
        for batch in it:
            for content, refers in zip(as_bytes(batch.column("content")), batch.column("refers_to").to_pylist()):
                out = [warcinfo(content)]
                for fields_block, r in zip(parse_arc(content), refers):
                    out.append(warc_record(describe(*fields_block), r and (r["page_id"], r["record_id"], r["uri"], r["date"])))
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)[:-1]], pa.binary())], names=["value"])

    return arcs.mapInArrow(convert, "value binary")


def convert_pages(pages: DataFrame, path: str) -> None:
    """Writes the pages' WARC archives to path by way of ARC archives."""
    pages = pages.select("page_id", "url", "html")
    digests = durable(digests_of(arcs_of(pages)), "digests")
    best = F.max(F.struct("page_id", "record_id", "uri", "date")).alias("refers_to")
    repeated = digests.groupBy("sha1").agg(best, F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = digests.select("page_id", "sha1").distinct().join(repeated, "sha1").where(~F.col("page_id").eqNullSafe(F.col("refers_to.page_id")))
    revisits = durable(revisits.select(F.col("page_id").alias("of"), F.col("sha1").alias("by"), "refers_to"), "revisits")
    sha1 = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    marked = pages.join(revisits, pages["page_id"].eqNullSafe(revisits["of"]) & (sha1 == revisits["by"]), "left").select("page_id", "url", "html", "refers_to")
    warcs_of(arcs_of(marked, ["refers_to"])).select(F.col("value").cast("string")).write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", ARCS_PER_FILE).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, uri, date of each record below path (but warcinfo).

    A response's payload is checked against its digest; a revisit's length is its HTTP head's."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "uri", "date"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def read(it):
        for batch in it:
            for content in as_bytes(batch.column("content")):
                rows = []
                for h, block in read_records(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)))):
                    if h["warc-type"] == "warcinfo":
                        continue
                    head, payload = http_parts(block)
                    digest, kind = h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"]
                    if kind != "revisit" and b32(payload) != digest:
                        raise ValueError(f"the payload of {h['warc-record-id']} doesn't match its digest")
                    page, to = header(head, "X-Page-Id"), h.get("x-refers-to-page-id")
                    length = int(header(head, "Content-Length") or 0) if kind == "revisit" else len(payload)
                    rows.append((None if page is None else int(page), length, digest, kind, None if to is None else int(to), h["warc-record-id"], h["warc-target-uri"], h["warc-date"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=names)

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path).select("content")
    return files.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, uri string, date string")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to for every row of pages, read back from its archives."""
    path = fresh_path(spark, "warc")
    convert_pages(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h, coalesce(html, '') AS p FROM pages),
b AS (SELECT d.*, max(page_id) OVER (PARTITION BY h, n) AS top FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM b
"""

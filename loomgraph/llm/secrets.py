"""Secret scans: Aho-Corasick keyword prefilter, anchored patterns at the hits, checksum validation of marked tokens.

One automaton pass over a text finds every keyword; a pattern is only tried where its keyword stands, left to right and
without overlap, which gives the same matches as scanning with the pattern itself. Runs of hex digits have no keyword
and are found by one scan for their shortest form. Tokens that carry their own CRC-32 (a four-letter mark, then base-62
digits of which the last six are the checksum) count only if it holds.

Defined results: null and empty texts have no secrets; repeated rows each get their own row; texts are scanned whole;
spans are code points, end exclusive; other columns pass through untouched.
"""

import hashlib
import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import as_bytes, settled, table, worker_cache

KINDS = ("assign", "access", "hex", "crc")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CRC_MARKS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
CRC = re.compile(rb"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def automaton():
    made = ahocorasick.Automaton()
    for w in ASSIGN_WORDS:
        made.add_word(w, ("assign", len(w)))
    made.add_word("akia", ("access", 4))
    for w in CRC_MARKS:
        made.add_word(w, ("crc", len(w)))
    made.make_automaton()
    return made


def crc62(text: bytes) -> str:
    """CRC-32 as six base-62 digits."""
    n, out = zlib.crc32(text), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out


def find_secrets(text: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes, by start and then kind as listed."""
    hits = {"assign": [], "access": [], "crc": []}
    for end, (kind, n) in worker_cache("secrets.automaton", automaton).iter(text.lower().decode("latin-1")):
        hits[kind].append(end + 1 - n)
    found = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    for kind, pattern in (("assign", ASSIGN), ("access", ACCESS), ("crc", CRC)):
        free = 0
        for at in sorted(hits[kind]):
            if at >= free and (m := pattern.match(text, at)):
                free = m.end()
                if kind == "assign" and len(m[2]) >= 12 or kind == "access" and m.end() - at >= 18 or kind == "crc" and crc62(m[1]) == m[2].decode():
                    found.append((at, m.end(), kind))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def in_code_points(text: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    if text.isascii():
        return spans
    places, at, n = {}, 0, 0
    for p in sorted({x for s in spans for x in s[:2]}):
        n += len(text[at:p].decode("utf-8", "replace"))
        places[p], at = n, p
    return [(places[s], places[e], k) for s, e, k in spans]


SPAN = "array<struct<kind:string,start:int,end:int>>"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """docs' doc_id and text with secret_spans: kind, start, end (code points, end exclusive), by start and kind."""
    src = docs.select("doc_id", "text")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(it):
        for batch in it:
            spans = [[{"kind": k, "start": s, "end": e} for s, e, k in in_code_points(t, find_secrets(t))] for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "secret_spans"])

    return src.mapInArrow(settled(scan), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, secret_spans {SPAN}")


def redacted(text: bytes, spans: list[tuple[int, int, str]], mark: bytes = b"[SECRET]") -> bytes:
    out, at = [], 0
    for s, e, _ in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return b"".join([*out, text[at:]])


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with every secret span replaced by a mark; no row goes, n_chars (where there is one) follows the text."""

    def scan(it):
        for batch in it:
            column = batch.column("text")
            texts = [None if t is None else redacted(t, find_secrets(t)).decode("utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()]
            columns = [pa.array(texts, column.type) if n == "text" else c for n, c in zip(batch.schema.names, batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = docs.mapInArrow(settled(scan), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def digest(spans: list[str]) -> str:
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of documents."""
    found = scan_secrets(table(spark, sf_dir, "documents"))
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secret_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(told(F.filter("secret_spans", lambda x: x["kind"] != "crc")), 256).alias("base_sha256"), told(F.col("secret_spans")).alias("spans"))

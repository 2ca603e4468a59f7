"""Benchmark decontamination: broadcast n-gram set, token-window scan, verified hits, span or document removal.

The benchmark's windows go to the executors in blocks of bounded size (`block_windows` pairs of a window and an item),
one pass over the documents for each block. Where one block is not enough, the documents are written once with row
numbers; each pass then returns row numbers, spans and items of rows with hits alone, which are merged by row at the end.
So a large benchmark costs passes, never memory.

Defined results: null or empty texts have no words and no hits; null item ids count as the item ""; repeated items are
one item; a window that several items have is a hit of each of them; repeated documents each get their own row; texts of
any length are scanned whole; an empty benchmark leaves every document clean, and no documents give no rows; columns of
documents other than the id and text are never looked at.
"""

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import as_bytes, durable, settled, table

WINDOW = 10
#: Pairs of a window and an item that are broadcast at once; each takes about 250 bytes on an executor.
BLOCK_WINDOWS = 200_000
#: Documents of which at least this share of the words is hit go as a whole.
DROP_SHARE = 0.8
#: Letters, digits and all beyond ASCII stay, A-Z become small, anything else becomes a space.
FOLD = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
MULTIPLIERS = np.random.default_rng(20240607).integers(1, 2**63, WINDOW, dtype=np.uint64) | np.uint64(1)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Ngrams:
    """The windows of a block of items: word numbers, hashes by window length, and the exact windows to verify."""

    def __init__(self, size: int):
        self.size, self.ids, self.items, self.names, self.pairs = size, {}, {}, [], 0

    def add(self, item: str, words: list[bytes]) -> None:
        numbers = [self.ids.setdefault(w, len(self.ids) + 1) for w in words]
        length = min(self.size, len(numbers))
        if length:
            if not self.names or self.names[-1] != item:
                self.names.append(item)
            new, k = {tuple(numbers[i : i + length]) for i in range(len(numbers) - length + 1)}, len(self.names) - 1
            for w in new:
                self.items.setdefault(w, []).append(k)
            self.pairs += len(new)

    def close(self) -> "Ngrams":
        by = {}
        for w in self.items:
            by.setdefault(len(w), []).append(w)
        self.hashes = {n: np.unique(rolled(np.array(ws, dtype=np.uint64).reshape(-1), n)[::n]) for n, ws in by.items()}
        return self

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """(start, end) of the words of each verified window, and the items."""
        get = self.ids.get
        a = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        spans, found = [], set()
        for n, known in self.hashes.items():
            if len(a) < n:
                continue
            h = rolled(a, n)
            at = np.searchsorted(known, h)
            at[at == len(known)] = 0
            for i in np.flatnonzero(known[at] == h).tolist():
                if items := self.items.get(tuple(a[i : i + n].tolist())):
                    spans.append((i, i + n))
                    found.update(items)
        return spans, {self.names[k] for k in found}


def rolled(a: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n numbers in a row."""
    h = np.zeros(len(a) - n + 1, np.uint64)
    for j in range(n):
        h += a[j : j + len(h)] * MULTIPLIERS[j % len(MULTIPLIERS)] + np.uint64(j)
    return h ^ (h >> np.uint64(29))


def merged(spans: list) -> list[tuple[int, int]]:
    out = []
    for s, e in sorted(map(tuple, spans)):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def blocks_of(benchmark: DataFrame, size: int, block_windows: int):
    """Ngrams blocks, each of about block_windows pairs; items stream through the driver one partition at a time."""
    block, seen = Ngrams(size), 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        words = words_of((text or "").encode())
        for at in range(0, max(1, len(words)), block_windows):  # a very long item spans blocks
            part = words[at : at + block_windows + size - 1]
            if at and len(part) < size:
                break
            block.add(item or "", part)
            if block.pairs >= block_windows:
                yield block.close()
                block = Ngrams(size)
                seen += 1
    if block.items or not seen:
        yield block.close()


SPANS = "array<struct<s:int,e:int>>"
HITS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))


def hits_of(grams: Ngrams, batch: pa.RecordBatch) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Words, merged spans and items of each text of a batch."""
    n_words, spans, items = [], [], []
    for text in as_bytes(batch.column("text")):
        words = words_of(text)
        s, f = grams.scan(words) if grams.items else ([], set())
        n_words.append(len(words))
        spans.append([{"s": a, "e": b} for a, b in merged(s)])
        items.append(sorted(f))
    return pa.array(n_words, pa.int64()), pa.array(spans, HITS), pa.array(items, pa.list_(pa.string()))


def scan_documents(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """docs' columns, n_words, spans (merged hit word ranges), items (sorted strings) for every row. docs has a column
    text, and none of the names n_words, spans, items and row_."""
    blocks = blocks_of(benchmark, size, block_windows)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        return one_pass(docs, first)
    docs = durable(docs.withColumn("row_", F.monotonically_increasing_id()), "numbered")
    hits, words = [], None
    for block in itertools.chain((first, second), blocks):  # a block is made when its turn comes
        found = one_pass(docs.select("row_", "text"), block).drop("text")
        if words is None:
            found = durable(found, "hits")
            words = found.select("row_", "n_words")
        hits.append(durable(found.where("size(spans) > 0").drop("n_words"), "hits"))
    every = hits[0]
    for x in hits[1:]:
        every = every.unionByName(x)
    # bounded by a document's words and its items
    each = every.groupBy("row_").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    out = docs.join(words, "row_").join(each, "row_", "left")
    return out.withColumns({"spans": F.when(F.col("spans").isNull(), F.array().cast(SPANS)).otherwise(united(F.col("spans"))), "items": F.coalesce("items", F.array().cast("array<string>"))}).drop("row_")


def united(spans):
    """merged() of a column."""
    def step(done, x):
        last = F.try_element_at(done, F.lit(-1))
        wider = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))
        return F.when(F.coalesce(x["s"] <= last["e"], F.lit(False)), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.array().cast(SPANS), step)


def one_pass(src: DataFrame, block: Ngrams) -> DataFrame:
    """src with n_words, spans and items of one block."""
    held = src.sparkSession.sparkContext.broadcast(block)
    kind = src.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.lit(None).cast(SPANS), "items": F.lit(None).cast("array<string>")}).schema

    def scan(it):
        for batch in it:
            yield pa.RecordBatch.from_arrays([*batch.columns, *hits_of(held.value, batch)], names=kind.names)

    return src.mapInArrow(settled(scan), kind)


def removed_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without its hit words, and without what stands between the words of one span."""
    ends = [(m.start(), m.end()) for m in WORD.finditer(text)]
    out, at = [], 0
    for s, e in spans:
        out.append(text[at : ends[s][0]])
        at = ends[e - 1][1]
    return b"".join([*out, text[at:]])


def remove_contamination(docs: DataFrame, benchmark: DataFrame, drop_share: float = DROP_SHARE, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """docs without benchmark passages: hit words go, and so do documents of which at least drop_share of the words are
    hit. What is left of a cut text is scanned again, as its ends meet, until nothing is hit.

    Rows with no hit are untouched; all columns stay, n_chars (where there is one) follows the new text.
    """
    names, plain = [f"in_{c}" if c != "text" else c for c in docs.columns], docs.columns  # no clash with what the scan adds
    counted = "n_chars" in plain
    now, done = docs.toDF(*names), []

    def cut(it):
        for batch in it:
            column, spans = batch.column("text"), batch.column("spans").to_pylist()
            texts, n_words = column.cast(pa.binary()).to_pylist(), batch.column("n_words").to_pylist()
            ranges = [[(x["s"], x["e"]) for x in s] for s in spans]
            stays = [sum(e - s for s, e in x) < drop_share * n for x, n in zip(ranges, n_words)]
            texts = [removed_words(t, x) if y else t for t, x, y in zip(texts, ranges, stays)]
            columns = [pa.array(texts, pa.binary()).cast(column.type) if n == "text" else c for n, c in zip(batch.schema.names, batch.columns) if n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(stays))

    while True:
        found = durable(scan_documents(now, benchmark, block_windows=block_windows), "scanned", texts=True)
        done.append(found.where("size(spans) = 0").select(names))
        hit = found.where("size(spans) > 0")
        if hit.isEmpty():
            break
        now = durable(hit.mapInArrow(settled(cut), hit.select(names).schema), "cut", texts=True)
        if counted:
            now = now.withColumn("in_n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.toDF(*plain)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of documents."""
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    return scan_documents(docs.select("doc_id", "text"), benchmark).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated")
    )


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
g AS (SELECT DISTINCT item, least(10, len(ws)) AS n, array_to_string(list_slice(ws, i, i + least(10, len(ws)) - 1), ' ') AS gram FROM b, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS t(i) WHERE len(ws) > 0),
l AS (SELECT DISTINCT n FROM g),
d AS (SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS gram FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, l WHERE len(ws) >= n)),
h AS (SELECT doc_id, d.n, i, item FROM d JOIN g ON d.gram = g.gram AND d.n = g.n),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""

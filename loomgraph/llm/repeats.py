"""Suffix-array deduplication: every byte covered by a 100-byte string that also starts earlier is removed.

Texts are cut into stretches of windows (100-byte strings) that share an anchor, the smallest hash of the 32-byte
strings in them; equal windows have equal anchors, so they meet where stretches are dealt out by anchor. Equal stretches
are one text, all but the first of which are repeats as a whole. An anchor that has one text alone has no others, as the
windows of a stretch differ by the anchor's place in them. The texts of all other anchors go to shards, each of which is suffix-sorted by induction (`suffixes`); permuted common prefixes of 100 or
more bytes join suffixes into groups of equal windows, and all but the earliest window of a group are removed.

Scale: stretches and texts are dealt out by hashes of content, never by document. An anchor with a great many
different stretches (seen on a sample of documents, or by exact count) isn't one group: its stretches are dealt out
by their own content, and the remaining ones window by window; the sample only decides on the way, never on results.
A shard holds about SHARD_BYTES; LARGE bounds what one anchor adds to it. Documents move twice, compressed.

Defined results: null and empty texts have no bytes; texts under 100 bytes lose none; of rows that share a doc_id each
is a document of its own, ordered by its text's digest, null ids first (equal rows: any of them is the first); texts
of any length are searched whole; an empty table gives no rows; other columns are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import as_bytes, durable, settled, table
from loomgraph.llm.suffixes import common_prefixes, suffix_array

LENGTH, GRAM = 100, 32
#: Bytes of text in a shard; different stretches of one anchor that a shard takes.
SHARD_BYTES, LARGE = 2 << 20, 4000
#: Documents in the sample that finds common anchors, and the share of them in which an anchor is common.
SAMPLE, COMMON = 20_000, 0.005
OUT_ROWS = 100_000


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A hash of every `size` bytes in a row (a power of two), by doubling."""
    h, p, n = data.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1
    while n < size:
        h = h[:-n] * np.uint64(p) + h[n:]
        p, n = p * p % 2**64, 2 * n
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    n = 1
    size = len(h) - width + 1
    while 2 * n <= width:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    return np.minimum(h[:size], h[width - n : width - n + size])


def stretches(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and number of windows of each stretch of a text. The anchor of a window is its gram of least
    hash, the leftmost of several; a stretch has one and the same gram as its anchor."""
    if len(text) < length:
        return (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 2)
    h = gram_hashes(np.frombuffer(text, np.uint8))
    placed = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    least = sliding_least(placed, length - GRAM + 1)
    at = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    anchors = h[(least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    return anchors, at, np.diff(np.append(at, len(least)))


def joined(a, b) -> np.ndarray:
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ b
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


STRETCH_ROWS = "k long, r long, d long, x int, n int, kind int"
#: What a stretch is: its anchor is ordinary, or common; or it repeats an earlier stretch of its document.
PLAIN, COMMON_ANCHOR, REPEATED = 0, 1, 2


def stretch_rows(docs: DataFrame, common: np.ndarray, length: int = LENGTH) -> DataFrame:
    """A row for each stretch of docs (d, text): what it is dealt out by (its anchor; for common anchors its content too),
    digest of its bytes, document, first window, windows."""
    held = docs.sparkSession.sparkContext.broadcast(common)

    def sketch(it):
        hot = held.value
        for batch in it:
            parts, size = [], 0
            for d, text in zip(batch.column("d").to_pylist(), as_bytes(batch.column("text"))):
                k, x, n = stretches(text, length)
                if len(k):
                    ends = (x + n + length - 1).tolist()
                    r = np.fromiter((xxhash.xxh3_64_intdigest(text[s:e]) for s, e in zip(x.tolist(), ends)), np.uint64, len(k))
                    parts.append(told_apart(k, r, np.full(len(k), d), x, n, hot))
                    size += len(k)
                if size >= OUT_ROWS:
                    yield rows_of(parts)
                    parts, size = [], 0
            if parts:
                yield rows_of(parts)

    return docs.select("d", "text").mapInArrow(settled(sketch), STRETCH_ROWS)


def told_apart(k, r, d, x, n, hot: np.ndarray) -> tuple:
    """The columns of one document's stretches; those that repeat earlier ones of the document are joined where they touch."""
    common = np.isin(k, hot) if len(hot) else np.zeros(len(k), bool)
    k = np.where(common, joined(k, r), k)
    first = np.unique(joined(k, r), return_index=True)[1]
    if len(first) == len(k):
        return k, r, d, x, n, common.astype(np.int32)
    again = np.ones(len(k), bool)
    again[first] = False
    new = np.flatnonzero(again & ~np.concatenate(([False], again[:-1] & (x[1:] == x[:-1] + n[:-1]))))
    last = np.flatnonzero(again & ~np.concatenate((again[1:] & (x[1:] == x[:-1] + n[:-1]), [False])))
    return (*[np.concatenate((c[first], c[new])) for c in (k, r, d, x)], np.concatenate((n[first], x[last] + n[last] - x[new])), np.concatenate((common[first].astype(np.int32), np.full(len(new), REPEATED, np.int32))))


def rows_of(parts: list) -> pa.RecordBatch:
    k, r, d, x, n, kind = (np.concatenate(c) for c in zip(*parts))
    # a repeat goes anywhere: it has its answer
    k = np.where(kind == REPEATED, joined(k ^ d.astype(np.uint64), x.astype(np.uint64)), k)
    return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(r.view(np.int64)), pa.array(d, pa.int64()), pa.array(x, pa.int32()), pa.array(n, pa.int32()), pa.array(kind, pa.int32())], names=["k", "r", "d", "x", "n", "kind"])


#: A repeat, the first of equal stretches of an anchor that occurs again, the first of equal stretches of a common anchor.
REPEAT, FIRST, SPREAD = 0, 1, 2


def sifted(rows: DataFrame) -> DataFrame:
    """what, k, d, x, n: repeats of earlier stretches, and those that have to be compared further: the first of equal
    ones, where the anchor has different ones too. (Windows of a stretch differ, as the anchor's place in them does; so
    an anchor whose stretches are all equal has no other repeats than those.)"""
    names, types = ["what", "k", "d", "x", "n"], [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def sift(it):
        before, held = None, None  # the last row's anchor and digest; the last first stretch, and whether it has its predecessor's anchor
        for batch in ended(it):
            new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "r", "d", "x", "n", "kind")} if batch is not None else None
            if new is not None and not len(new["k"]):
                continue
            out = []
            if new is not None:
                known = new["kind"] == REPEATED
                out.append((REPEAT, {c: v[known] for c, v in new.items()}))
                new = {c: v[~known] for c, v in new.items()}
                k, r = new["k"], new["r"]
                same = np.concatenate(([before == (k[0], r[0])], (k[1:] == k[:-1]) & (r[1:] == r[:-1]))) if len(k) else np.empty(0, bool)
                out.append((REPEAT, {c: v[same] for c, v in new.items()}))
                before = (k[-1], r[-1]) if len(k) else before
                first = {c: v[~same] for c, v in new.items()}
                if held is not None:
                    first = {c: np.concatenate((held[0][c], v)) for c, v in first.items()}
            elif held is not None:
                first = held[0]
            else:
                continue
            k = first["k"]
            if len(k):
                after = np.append(k[1:] == k[:-1], False)
                again = after | np.concatenate(([held is not None and held[1]], after[:-1]))
                done = len(k) - (batch is not None)  # the last one waits for the next batch
                common = first["kind"][:done] == COMMON_ANCHOR
                out.append((SPREAD, {c: v[:done][common] for c, v in first.items()}))
                out.append((FIRST, {c: v[:done][again[:done] & ~common] for c, v in first.items()}))
                held = ({c: v[done:] for c, v in first.items()}, bool(again[-1])) if batch is not None else None
            columns = [np.concatenate([np.full(len(v["k"]), what) for what, v in out]), *[np.concatenate([v[c] for _, v in out]) for c in names[1:]]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return rows.repartition("k").sortWithinPartitions("k", "r", "d", "x").mapInArrow(settled(sift), "what int, k long, d long, x int, n int")


def ended(it):
    """The batches, then None."""
    yield from it
    yield None


# ---- texts of stretches


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, d and z, the text compressed, for moving."""

    def press(it):
        tool = zstandard.ZstdCompressor(level=1)
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("d"), pa.array([tool.compress(t) for t in as_bytes(batch.column("text"))], pa.binary())], names=["doc_id", "d", "z"])

    return docs.select("doc_id", "d", "text").mapInArrow(press, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, d long, z binary")


def texts_of(docs: DataFrame, wanted: DataFrame, length: int = LENGTH) -> DataFrame:
    """k, d, x, n, text of the wanted stretches (k, d, x, n)."""
    asked = wanted.groupBy("d").agg(F.collect_list(F.struct("k", "x", "n")).alias("asked"))  # bounded by the document

    def cut(it):
        tool = zstandard.ZstdDecompressor()
        for batch in it:
            rows = []
            for d, z, asked in zip(batch.column("d").to_pylist(), batch.column("z").to_pylist(), batch.column("asked").to_pylist()):
                text = tool.decompress(z)
                for a in asked:
                    rows.append((a["k"], d, a["x"], a["n"], text[a["x"] : a["x"] + a["n"] + length - 1]))
                if len(rows) >= OUT_ROWS // 4:
                    yield some(rows)
                    rows = []
            yield some(rows)

    def some(rows):
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)], names=["k", "d", "x", "n", "text"])

    return packed(docs).drop("doc_id").join(asked, "d").mapInArrow(settled(cut), "k long, d long, x int, n int, text binary")


def window_rows(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """The stretches (d, x, n, text) cut into single windows, dealt out by their content."""

    def cut(it):
        for batch in it:
            parts, size = [], 0
            for d, x, n, text in zip(*[batch.column(c).to_pylist() for c in ("d", "x", "n", "text")]):
                both = [xxhash.xxh3_128_intdigest(text[i : i + length]) for i in range(n)]
                parts.append((np.array([b >> 64 for b in both], np.uint64), np.array([b & (2**64 - 1) for b in both], np.uint64), np.full(n, d), np.arange(x, x + n), np.ones(n, np.int64), np.zeros(n, np.int32)))
                size += n
                if size >= OUT_ROWS:
                    yield rows_of(parts)
                    parts, size = [], 0
            if parts:
                yield rows_of(parts)

    return texts.select("d", "x", "n", "text").mapInArrow(settled(cut), STRETCH_ROWS)


# ---- shards


def shard_repeats(d: np.ndarray, x: np.ndarray, n: np.ndarray, texts: list[bytes], length: int = LENGTH) -> np.ndarray:
    """Rows (number of the stretch, first and last window in it) of windows that start earlier elsewhere in the shard."""
    data = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    starts = np.cumsum(sizes) - sizes
    letters = data.astype(np.int64) + 2
    letters[starts + sizes - 1] = 1  # between texts
    sa = suffix_array(np.append(letters, 0))[1:]
    of = np.repeat(np.arange(len(texts)), sizes)
    within = np.arange(len(data)) - starts[of]
    wanted = within < n[of]
    # over letters, not bytes: what stands between texts equals no byte of a text, so no wanted prefix of `length` meets it
    prefix = common_prefixes(letters, sa, wanted, int(sizes.max()))
    ordered = sa[wanted[sa]]
    group = np.concatenate(([True], prefix[ordered[1:]] < length))
    group[0] = True
    place = np.unique(d, return_inverse=True)[1][of[ordered]].astype(np.int64) << 32 | (x[of[ordered]] + within[ordered])
    heads = np.flatnonzero(group)
    least = np.minimum.reduceat(place, heads)
    late = np.sort(ordered[place > np.repeat(least, np.diff(np.append(heads, len(ordered))))])
    if not len(late):
        return np.empty((0, 3), np.int64)
    new = np.flatnonzero(np.concatenate(([True], (late[1:] != late[:-1] + 1) | (of[late[1:]] != of[late[:-1]]))))
    end = np.append(new[1:], len(late)) - 1
    return np.stack([of[late[new]], within[late[new]], within[late[end]]], axis=1)


def sharded(texts: DataFrame, total: int, length: int = LENGTH) -> DataFrame:
    """d, s, e: byte ranges of repeats among the stretches (k, d, x, n, text), of `total` bytes."""
    least = texts.sparkSession.sparkContext.defaultParallelism
    shards = max(least, -(-total // SHARD_BYTES))

    def search(it):
        d, x, n, texts = [], [], [], []
        for batch in it:
            for into, c in ((d, "d"), (x, "x"), (n, "n"), (texts, "text")):
                into += batch.column(c).to_pylist()
        if texts:
            d, x, n = (np.array(c, np.int64) for c in (d, x, n))
            found = shard_repeats(d, x, n, texts, length)
            i = found[:, 0]
            s, e = x[i] + found[:, 1], x[i] + found[:, 2] + length
            yield pa.RecordBatch.from_arrays([pa.array(d[i]), pa.array(s, pa.int32()), pa.array(e, pa.int32())], names=["d", "s", "e"])

    return texts.repartition(shards, "k").mapInArrow(settled(search), "d long, s int, e int")


# ---- the operator


def common_anchors(docs: DataFrame, rows: int, length: int = LENGTH) -> np.ndarray:
    """Anchors with different stretches in many documents of a sample; at most as many as a sample's anchors over their share."""
    share = min(1.0, SAMPLE / max(rows, 1))
    sample = docs.sample(False, share, seed=11) if share < 1 else docs
    found = stretch_rows(sample, np.empty(0, np.uint64), length).groupBy("k", "r").agg(F.lit(1).alias("one")).groupBy("k").agg(F.count("*").alias("n"))
    least = max(64, int(COMMON * min(rows, SAMPLE)))
    return np.array([r["k"] for r in found.where(F.col("n") >= least).select("k").collect()], np.int64).view(np.uint64)


def numbered(docs: DataFrame) -> DataFrame:
    """docs with d, a number that orders them: the doc_id, if it tells rows apart; else a number made of the order."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    if ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty():
        return docs.withColumn("d", F.col("doc_id").cast("long"))
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_first(), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return durable(ordered.withColumn("d", F.monotonically_increasing_id()), "numbered")


def repeat_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """d, s, e: byte ranges of repeats in docs (d, text); they may overlap."""
    rows = docs.count()
    found = durable(sifted(stretch_rows(docs, common_anchors(docs, rows, length), length)), "stretches")
    first = found.where(F.col("what") == FIRST)
    large = durable(first.groupBy("k").agg(F.count("*").alias("c")).where(F.col("c") > LARGE).select("k"), "large")
    whole, spread = first, found.where(F.col("what") == SPREAD)
    if not large.isEmpty():
        whole = first.join(large, "k", "left_anti")
        spread = spread.unionByName(first.join(large, "k", "left_semi"))
    out = found.where(F.col("what") == REPEAT).select("d", F.col("x").alias("s"), (F.col("x") + F.col("n") + (length - 1)).alias("e"))
    total = whole.agg(F.sum(F.col("n") + length)).first()[0]
    wanted = whole.select("k", "d", "x", "n").unionByName(spread.select(F.lit(None).cast("long").alias("k"), "d", "x", "n"))  # one journey for both
    texts = durable(texts_of(docs, wanted, length), "texts", texts=True)
    if total:
        out = out.unionByName(sharded(texts.where(F.col("k").isNotNull()), total, length))
    if not spread.isEmpty():
        again = sifted(window_rows(texts.where(F.col("k").isNull()), length))
        out = out.unionByName(again.where(F.col("what") == REPEAT).select("d", F.col("x").alias("s"), (F.col("x") + length).alias("e")))
    return durable(out, "spans")


def merged(spans: np.ndarray) -> np.ndarray:
    """Sorted, disjoint ranges that cover the same (touching ones are one)."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.concatenate(([True], spans[1:, 0] > reach[:-1])))
    return np.stack([spans[new, 0], reach[np.append(new[1:], len(spans)) - 1]], axis=1)


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row, and if asked for kept (binary)."""
    docs = numbered(docs.select("doc_id", "text"))
    spans = repeat_spans(docs, length)
    by_doc = spans.groupBy("d").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text

    def cut(it):
        tool = zstandard.ZstdDecompressor()
        for batch in it:
            rows, keeps = [], []
            for z, spans in zip(batch.column("z").to_pylist(), batch.column("spans").to_pylist()):
                text = tool.decompress(z)
                kept, gone, n = text, 0, 0
                if spans:
                    ranges = merged(np.array([(a["s"], a["e"]) for a in spans], np.int64))
                    gone, n = int((ranges[:, 1] - ranges[:, 0]).sum()), len(ranges)
                    edges = [0, *ranges.reshape(-1).tolist(), len(text)]
                    kept = b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2])])
                rows.append((len(text), gone, n, hashlib.sha256(kept).hexdigest()))
                keeps.append(kept)
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, [pa.int64()] * 3 + [pa.string()])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, *[pa.array(keeps, pa.binary())] * with_text], names=names)

    return packed(docs).join(by_doc, "d", "left").mapInArrow(settled(cut), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of documents."""
    return remove_repeats(table(spark, sf_dir, "documents"))

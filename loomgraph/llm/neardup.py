"""Near-duplicates by order min-hash of labelled shingles, with banded alignment as proof.

A text's k-mers are its five-word shingles, each labelled with how often it has occurred so far. Each of FUNCTIONS hashes
samples the SAMPLED smallest labelled k-mers and keeps them in text order: an ordered sketch, which two texts share if
they agree in the k-mers and in their order. Texts of a shared ordered sketch are candidates first; a banded alignment of
their words must then show an edit similarity of at least 0.8. Scattered edits leave a pair at 0.8 a fifth of its
shingles, of which two in one sketch are seldom both shared; so texts that share any one sampled k-mer are candidates too,
as far as they aren't in one class by then.

Scale: equal texts are one node from the start (a sum by digest), so copies cost one row each. A bucket of an ordered
sketch is held against its leader, which takes a row for each member. What shares a single k-mer meets in groups that
hold at most two blocks of bounded rows and bytes; larger buckets are dealt out by length first (texts of 0.8 are in one
length class or the next), then as pairs of blocks. A group drops pairs by bounds on their edits (lengths, word counts);
only members with a partner left bring their texts, in a second round, whose groups skip pairs that another group has,
align the rest by rising bound, and return only links between classes, one for two classes at most: rows out are in
proportion to rows in. What texts are joined with grows with the corpus, so those joins are by sorting, never broadcasts. So the classes are exactly those of all similar pairs that share
a k-mer of their samples. Classes are connected components of the links, found by alternating star contractions whose
rounds are written tables. Nothing of the corpus comes to the driver but counts.

Defined results: null and empty texts are copies of one another; texts of one to four words have one shingle, all of
them; texts of any length are sketched and aligned whole; rows that repeat a doc_id belong each to the class of their
text; ties of candidates or hashes never change the classes; a null doc_id has its text's class, which is null if no row
of the class has an id; an empty table gives no rows; other columns are ignored.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import as_bytes, durable, forget, settled, table, worker_cache

SHINGLE, SAMPLED, FUNCTIONS, SIMILARITY = 5, 2, 12, 0.8
RNG = np.random.default_rng(7)
WORD_FACTORS = RNG.integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)
FACTORS = RNG.integers(1, 2**63, FUNCTIONS, dtype=np.uint64) | np.uint64(1)
SALTS = RNG.integers(1, 2**63, FUNCTIONS, dtype=np.uint64)
MOST = np.uint64(2**64 - 1)
#: Positions hashed at once.
CHUNK = 1 << 16
#: Parts of the word counts, and of their parities, that rule pairs out; rows, and bytes of compressed text, of a block.
PARTS, PARITIES, GROUP, GROUP_BYTES = 256, 1024, 2048, 16 << 20
REMEMBERED = 300_000


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


class Hashes(dict):
    """64-bit hashes of words, found when first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def word_hashes(words: list[bytes]) -> np.ndarray:
    known = worker_cache("neardup.words", Hashes)
    if len(known) > REMEMBERED:
        known.clear()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def labelled(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A hash of each shingle and its number among the equal ones before it."""
    size = min(size, len(words))
    n = len(words) - size + 1
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h += words[j : j + n] * WORD_FACTORS[j]
    h = mixed(h)
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.r_[True, s[1:] != s[:-1]]
    if not new.all():
        at = np.arange(n)
        before = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
        h[order] = np.where(before > 0, mixed(s + before * np.uint64(0x9E3779B97F4A7C15)), s)
    return h


def sampled_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of labelled k-mers, the ordered sketch of each function, and every sampled k-mer with its function: both as keys
    that texts can meet by."""
    values, places = [], []
    rows = np.arange(FUNCTIONS)
    for at in range(0, len(keys), CHUNK):
        v = keys[None, at : at + CHUNK] * FACTORS[:, None]
        for _ in range(min(SAMPLED, v.shape[1])):
            i = v.argmin(axis=1)
            values.append(v[rows, i])
            places.append(i + at)
            v[rows, i] = MOST
    places = np.array(places)
    if len(places) > SAMPLED:  # of several chunks
        best = np.argsort(np.array(values), axis=0, kind="stable")[:SAMPLED]
        places = np.take_along_axis(places, best, 0)
    places.sort(axis=0)
    ordered = SALTS.copy()
    for i in places:
        ordered = mixed(ordered * np.uint64(0x9E3779B97F4A7C15) + keys[i])
    return ordered.view(np.int64), mixed(keys[places] ^ SALTS).reshape(-1).view(np.int64)


def profile(h: np.ndarray) -> bytes:
    """Of words with these hashes, how many there are in each of PARTS parts (255 at most), then whether their number is
    odd in each of PARITIES parts."""
    part = (h >> np.uint64(32)).astype(np.int64)
    counts = np.minimum(np.bincount(part % PARTS, minlength=PARTS), 255).astype(np.uint8)
    return counts.tobytes() + np.packbits(np.bincount(part % PARITIES, minlength=PARITIES) & 1).tobytes()


def sketch_of(text: bytes) -> tuple[list[int], list[int], int, bytes, bytes]:
    """Ordered sketches, single k-mers, number of words, their profile, and the words with spaces between; nothing to
    meet by without words."""
    words = words_of(text)
    h = word_hashes(words)
    ordered, single = sampled_of(labelled(h)) if words else ([], [])
    return ordered, single, len(words), profile(h), b" ".join(words)


# ---- alignment


def edit_distance(a: list[bytes], b: list[bytes], limit: int) -> int:
    """Edit distance of two word sequences if it is at most limit, else limit + 1. The band widens until it is enough."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    head, short = 0, min(len(a), len(b))
    while head < short and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < short - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        return min(len(a) + len(b), limit + 1)
    more = Counter(a)
    more.subtract(b)
    if max(sum(n for n in more.values() if n > 0), -sum(n for n in more.values() if n < 0)) > limit:
        return limit + 1  # words that have no partner at all
    places: dict[bytes, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    width = max(64, abs(len(a) - len(b)))
    while True:
        width = min(width, limit)
        d = banded(len(a), places, b, width)
        if d <= width or width == limit:
            return min(d, limit + 1)
        width *= 4


def banded(m: int, places: dict[bytes, int], b: list[bytes], width: int) -> int:
    """Edit distance of m words (their places as bits) and b by paths at most `width` off the diagonal, or more than width.

    Bit-parallel columns (Myers 1999): bit k of column j is row j - width + k; `up` and `down` are the rows whose cost
    is one more or less than the row's before. Beyond the band costs count as one more than at its edge."""
    size = 2 * width + 1
    every, last = (1 << size) - 1, 1 << (size - 1)
    down = (1 << (width + 1)) - 1
    up = every ^ down
    cost = width  # of the lowest row in the band
    find = places.get
    for j, w in enumerate(b, 1):
        shift = j - width - 1
        same = find(w, 0)
        same = (same >> shift if shift >= 0 else same << -shift) & every
        up, down = up >> 1 | last, down >> 1
        level = ((((same & up) + up) ^ up) | same | down) & every
        right = down | (every ^ (level | up))
        left = level & up
        if not level & last:
            cost += 1
        right = (right << 1 | 1) & every
        up = (left << 1 & every) | (every ^ (level | right))
        down = right & level
    below = len(b) + width - m  # rows between the last word of a and the band's lowest row
    if below:
        lower = ((1 << below) - 1) << (size - below)
        cost += (down & lower).bit_count() - (up & lower).bit_count()
    return cost


def similar(a: list[bytes], b: list[bytes], similarity: float = SIMILARITY) -> bool:
    limit = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
    return edit_distance(a, b, limit) <= limit


# ---- links


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), row (its number), ordered, single, n, counts, z (the words, compressed), size (of z)
    for every row."""
    names = ["doc_id", "digest", "ordered", "single", "n", "counts", "z", "size"]

    def sketch(it):
        tool = zstandard.ZstdCompressor(level=1)
        for batch in it:
            made = list(zip(*map(sketch_of, as_bytes(batch.column("text"))))) or [[]] * 5
            made[4] = list(map(tool.compress, made[4]))
            kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary()]
            columns = [pa.array(list(c), k) for c, k in zip(made, kinds)] + [pa.array(list(map(len, made[4])), pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), *columns], names=names)
        worker_cache("neardup.words", Hashes).clear()  # an idle worker holds nothing

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", digest_of("text").alias("digest"), "text").mapInArrow(settled(sketch), f"doc_id {kind}, digest binary, ordered array<long>, single array<long>, n int, counts binary, z binary, size int")
    return out.withColumn("row", F.monotonically_increasing_id())


def digest_of(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def led(members: DataFrame) -> DataFrame:
    """leader, node of all that share a key with others; the leader is a bucket's smallest node."""
    leaders = members.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("high")).where("leader <> high")
    return members.join(leaders.select("key", "leader"), "key").where("node <> leader").select("leader", "node").distinct()


def proven(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (leader, node) that are similar. texts: node, z."""

    def align(it):
        held, tool = (None, None), zstandard.ZstdDecompressor()
        for batch in it:
            out = []
            for a, x, y in zip(batch.column("leader").to_pylist(), batch.column("z_a").to_pylist(), batch.column("z_b").to_pylist()):
                if held[0] != a:
                    held = a, tool.decompress(x).split()
                out.append(similar(held[1], tool.decompress(y).split(), similarity))
            yield pa.RecordBatch.from_arrays([batch.column("leader"), batch.column("node")], names=["leader", "node"]).filter(pa.array(out, pa.bool_()))

    a, b = texts.select(F.col("node").alias("leader"), F.col("z").alias("z_a")), texts.select("node", F.col("z").alias("z_b"))
    return pairs.join(b.hint("merge"), "node").join(a.hint("merge"), "leader").select("leader", "node", "z_a", "z_b").mapInArrow(settled(align), "leader long, node long")


def linked(rows: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """node, root for every node of nodes (node: the row of rows that stands for it). rows: as sketched() has them, durable."""
    of = lambda *names: rows.select(F.col("row").alias("node"), *names)
    own = lambda *names: of(*names).join(nodes.select("node").hint("merge"), "node", "left_semi")
    pairs = durable(led(own("ordered").select("node", F.explode("ordered").alias("key"))), "pairs")
    wanted = pairs.select("node").union(pairs.select("leader")).distinct()
    texts = durable(of("z").join(wanted.hint("merge"), "node", "left_semi"), "texts")
    found = durable(proven(pairs, texts, similarity), "links", texts=True)
    forget(pairs, texts)
    roots = components(found.select(F.col("leader").alias("a"), F.col("node").alias("b")))
    # whatever shares a k-mer and is in different classes so far
    named = own("n", "size", "single").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = durable(several(named.select(F.explode("single").alias("key"), "node", "root", "n", "size")), "open")
    forget(found)
    # those with a partner that no bound rules out, and their texts
    marked = durable(grouped(open_, of("counts"), similarity, False), "marked").distinct()
    left = durable(several(open_.drop("rows", "bytes").join(marked, ["key", "node"], "left_semi")), "open")
    forget(open_)
    keys = left.groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("keys"))  # at most a sample's keys
    between = components(durable(grouped(left, of("counts", "z").join(keys.hint("merge"), "node"), similarity, True), "links", texts=True))
    out = nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("first"))
    return out.join(between.select(F.col("node").alias("first"), "root"), "first", "left").select("node", F.coalesce("root", "first").alias("root"))


def several(members: DataFrame) -> DataFrame:
    """members (key, node, root, n, size) of keys with different roots, with rows and bytes (of the key)."""
    total = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    return members.join(total.where("low <> high").select("key", "rows", "bytes"), "key")


def blocks_of(rows, size):
    return F.greatest(F.ceil(rows / GROUP), F.ceil(size / GROUP_BYTES), F.lit(1))


def grouped(open_: DataFrame, texts: DataFrame, similarity: float, align: bool) -> DataFrame:
    """Texts of one key and different roots, held against each other. open_: as several() has it; texts: node, counts, and
    to align keys (of the node) and z. Returns a, b, roots that similar texts join; or without align key, node of those
    that have a partner which lengths and word counts don't rule out.

    A key of one block is a group. Larger ones are dealt out by length: of texts whose similarity allows it, the lengths
    are of one class or the next; what has still more than a block's rows goes out as pairs of blocks."""
    width = float(-np.log(max(similarity, 1e-3)) * 1.0001 + 1e-4)
    class_ = F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) / width)
    ways = F.when(blocks_of(F.col("rows"), F.col("bytes")) == 1, F.array(F.lit(-1).cast("long"))).otherwise(F.array(class_, class_ + 1))
    sized = open_.select("key", "node", "root", "n", "size", class_.alias("own"), F.explode(ways).alias("class"))
    sized = sized.withColumn("own", (F.col("class") == -1) | (F.col("class") == F.col("own")))
    total = sized.groupBy("key", "class").agg(blocks_of(F.count("*"), F.sum("size")).alias("blocks"), F.max("own").alias("any"), F.min("root").alias("low"), F.max("root").alias("high"))
    dealt = sized.join(total.where("any AND low <> high").select("key", "class", "blocks"), ["key", "class"]).withColumn("mine", F.pmod(F.xxhash64("node"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    i, j = F.least("mine", "other"), F.greatest("mine", "other")
    dealt = dealt.select(F.xxhash64("key", "class", i, j).alias("group"), "key", "node", "root", "n", "own", F.when(i == j, F.lit(0)).when(F.col("mine") < F.col("other"), F.lit(1)).otherwise(F.lit(2)).alias("side"))

    def compare(it):
        parts, last = [], None
        for batch in it:
            if not batch.num_rows:
                continue
            groups = batch.column("group").to_numpy()
            at = 0
            for end in (np.flatnonzero(np.r_[groups[1:] != groups[:-1], True]) + 1).tolist():
                if parts and groups[at] != last:
                    yield links_within(parts, similarity, align)
                    parts = []
                parts.append(batch.slice(at, end - at))
                last, at = groups[at], end
        if parts:
            yield links_within(parts, similarity, align)

    together = dealt.join(texts.hint("merge"), "node").repartition("group").sortWithinPartitions("group")
    return together.mapInArrow(settled(compare), "a long, b long" if align else "key long, node long")


def links_within(parts: list[pa.RecordBatch], similarity: float, align: bool) -> pa.RecordBatch:
    """grouped() for one group. Links come once for two classes at most. A pair that shares several keys is left
    to one of their groups, by its number, so that pairs of many texts which share many keys are spread."""
    t = pa.Table.from_batches(parts).combine_chunks()
    n = t.column("n").to_numpy()
    order = np.argsort(n, kind="stable")
    n, side, own, root = n[order], t.column("side").to_numpy()[order], t.column("own").to_numpy()[order], t.column("root").to_numpy()[order]
    told = np.frombuffer(b"".join(t.column("counts").to_pylist()), np.uint8).reshape(len(n), -1)[order]
    counts, odd = told[:, :PARTS].astype(np.int16), np.ascontiguousarray(np.ascontiguousarray(told[:, PARTS:]).view(np.uint64).T)
    key, keys, z = t.column("key")[0].as_py(), *(t.column(c) if align else None for c in ("keys", "z"))
    tool, texts = zstandard.ZstdDecompressor(), {}
    node, met_by = t.column("node").to_numpy()[order], {}

    def words(i: int) -> list[bytes]:
        if len(texts) > 512:
            texts.clear()
        if i not in texts:
            texts[i] = tool.decompress(z[int(order[i])].as_py()).split()
        return texts[i]

    def here(a: int, b: int) -> bool:
        """Whether, of the keys that the pair shares, this one is its own."""
        for i in (a, b):
            if i not in met_by:
                met_by[i] = set(keys[int(order[i])].as_py())
        shared = sorted(met_by[a] & met_by[b])
        return shared[int(node[a] + node[b]) % len(shared)] == key

    # of a pair the longer text comes later, and bounds the number of edits
    limits = np.array([int((1 - similarity) * x + 1e-9) for x in n.tolist()])
    starts = np.searchsorted(n, n - limits)
    now, out_a, out_b, marked = root.copy(), [], [], np.zeros(len(n), bool)
    for b in range(1, len(n)):
        near = slice(starts[b], b)
        apart = np.bitwise_count(odd[:, near] ^ odd[:, b : b + 1]).sum(axis=0, dtype=np.uint16)  # an edit changes two parities at most
        at = starts[b] + np.flatnonzero((apart <= 2 * limits[b]) & (now[near] != now[b]) & (own[near] | own[b]) & ((side[near] != side[b]) | (side[b] == 0)))
        if len(at):  # each word too many on a side is an edit
            more = counts[at] - counts[b]
            over = np.maximum(more, 0).sum(axis=1)
            over = np.maximum(over, over - more.sum(axis=1))
            at, over = at[over <= limits[b]], over[over <= limits[b]]
        if not len(at):
            continue
        if not align:
            marked[at] = marked[b] = True
            continue
        at = at[np.argsort(over, kind="stable")]
        at = at[[here(a, b) for a in at.tolist()]]
        while len(at):
            a, at = int(at[0]), at[1:]
            if similar(words(a), words(b), similarity):
                out_a.append(root[a])
                out_b.append(root[b])
                now[now == now[a]] = now[b]
                at = at[now[at] != now[b]]
    if not align:
        return pa.RecordBatch.from_arrays([pa.array(np.full(marked.sum(), key), pa.int64()), pa.array(node[marked], pa.int64())], names=["key", "node"])
    return pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of edges (a, b): alternating stars (Kiveris et al. 2014)."""
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        near = both(e)
        if not large:
            near = near.where("v < u")
        least = near.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        near = near.join(least, "u")
        if large:
            out = near.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = near.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        before, now = now, durable(star(star(now, True), False), "edges")
        forget(before)
        new = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.shiftright(F.xxhash64("b", "a"), 20))).first()
        if new == mark:
            return durable(now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "roots")
        mark = new


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, digest, class_id (the smallest doc_id of the class), stays (it, with the smallest digest among those that
    have it, is the one of its class) for every row of docs."""
    rows = durable(sketched(docs), "sketches", texts=True)
    nodes = durable(rows.groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("doc_id")), "nodes")
    named = durable(nodes.join(linked(rows, nodes, similarity), "node"), "named")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("best")
    named = durable(named.join(named.groupBy("root").agg(best), "root").select("digest", F.col("best.doc_id").alias("class_id"), (F.col("digest") == F.col("best.digest")).alias("first")), "classes")
    out = rows.select("doc_id", "digest").join(named, "digest")
    return out.select("doc_id", "digest", "class_id", (F.col("first") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("stays"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of docs of each class, all columns untouched: that with the smallest doc_id, null after all others; of
    different texts with that doc_id the one of least digest, of rows that repeat it any."""
    stay = classes(docs.select("doc_id", "text"), similarity).where("stays").groupBy(F.col("doc_id").alias("doc_"), F.col("digest").alias("digest_")).agg(F.count("*").alias("n_"))
    stay = durable(stay, "stay")
    same = lambda few: F.col("doc_id").eqNullSafe(few["doc_"]) & (digest_of("text") == few["digest_"])
    alone, again = stay.where("n_ = 1"), stay.where("n_ > 1")
    out = docs.join(alone, same(alone), "left_semi")
    if again.isEmpty():
        return out
    twice = docs.join(again, same(again), "left_semi").select(F.struct("*").alias("row"), "doc_id", digest_of("text").alias("digest"))
    return out.unionByName(twice.dropDuplicates(["doc_id", "digest"]).select("row.*"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, kept (it is the one of its class that stays) for every row of documents."""
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", F.col("stays").alias("kept"))

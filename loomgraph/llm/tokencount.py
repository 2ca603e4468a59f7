"""Edit-aware token counts: a segment tree over pre-tokens for each document.

Leaves hold runs of pre-tokens with their token counts; inner nodes hold sums of characters and tokens. An edit finds
its leaf from the sums, re-encodes from a pre-token boundary shortly before the edit until new boundaries fall on old
ones again, and updates the sums on the paths of the leaves it touched. The pre-token pattern looks ahead a bounded
number of characters and never behind, so what lies beyond such a common boundary can't change.

Trees are tables: build_trees encodes documents once, edit_trees applies a table of edits to kept trees and returns the
new trees, so that a later round of edits encodes what it touches alone. A tree is kept as its leaves' pre-token lengths
and token counts beside the text; sums are added up again from them, nothing is encoded.

Scale: building is one pass over the documents, no shuffle; edits join trees by doc_id. A task holds one document's tree
at a time. A document's edits depend on each other, so they are one row; their number bounds it, not the corpus.

Defined results: null and empty texts have no tokens; edits are applied in order of seq (null first), then start, end and
text; a null start is 0, a null end the start, a null text empty; edits beyond the end of a text act at its end; edits
of no document do nothing; repeated rows each get their own row and all edits of their doc_id (null is one doc_id);
texts are encoded whole; empty tables give no rows; other columns are ignored.
"""

import base64
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import as_bytes, settled, table, worker_cache

LEAF = 64
#: Characters beyond its end that a pre-token's match may have looked at.
LOOK = 4
REMEMBERED = 400_000


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


class Counter:
    """Pre-tokens of a text and the number of tokens of each."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern, self.known = regex.compile(pattern), {}

    def counts(self, tokens: list[str]) -> list[int]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for t in {t for t in tokens if t not in known}:
            known[t] = len(self.encoding.encode_ordinary(t))
        return [known[t] for t in tokens]


class CountTree:
    """Token counts of one text under edits."""

    def __init__(self, text: str, counter: Counter):
        self.counter, self.encoded = counter, 0
        self.build(counter.pattern.findall(text))

    def build(self, tokens: list[str], counts: list[int] | None = None) -> None:
        counts = self.counter.counts(tokens) if counts is None else counts
        self.leaves = [(tokens[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(tokens), LEAF)] or [([], [])]
        self.base = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.base), [0] * (2 * self.base)
        for k, (t, c) in enumerate(self.leaves):
            self.chars[self.base + k], self.tokens[self.base + k] = sum(map(len, t)), sum(c)
        for k in range(self.base - 1, 0, -1):
            self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    @classmethod
    def kept(cls, text: str, lengths: list[int], counts: list[int], counter: Counter) -> "CountTree":
        """The tree of a kept row."""
        tree = cls.__new__(cls)
        tree.counter, tree.encoded = counter, 0
        ends = list(accumulate(lengths, initial=0))
        tree.build([text[a:z] for a, z in zip(ends, ends[1:])], counts)
        return tree

    def row(self) -> tuple[str, list[int], list[int]]:
        """text, lengths, counts: all that kept needs."""
        return self.text(), [len(t) for leaf, _ in self.leaves for t in leaf], [c for _, leaf in self.leaves for c in leaf]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character at (the last one beyond the end), and where it starts."""
        k, start = 1, 0
        while k < self.base:
            k *= 2
            if at - start >= self.chars[k] and self.chars[k + 1]:
                start += self.chars[k]
                k += 1
        return min(k - self.base, len(self.leaves) - 1), start

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces characters start to end (exclusive) by new; only the surroundings are encoded again."""
        size = self.chars[1]
        start, end = min(start, size), min(max(start, end), size)
        first, at = self.find(max(0, start - LOOK))
        while first and at + sum(len(t) for t in self.leaves[first][0][:1]) > start - LOOK:  # the boundary may lie in the leaf before
            first -= 1
            at -= self.chars[self.base + first]
        head = 0  # pre-tokens of the first leaf that stay
        tokens = self.leaves[first][0]
        while head < len(tokens) and at + len(tokens[head]) + LOOK <= start:
            at += len(tokens[head])
            head += 1
        last, stop = self.find(end)
        stop += self.chars[self.base + last]
        while True:
            old = [t for k in range(first, last + 1) for t in self.leaves[k][0]][head:]
            text = "".join(old)
            text = text[: start - at] + new + text[end - at :]
            whole, shift = stop >= size, len(new) - (end - start)
            # old boundaries at or after the edit's end, in places of the new text
            places, p = {}, 0
            for i, t in enumerate(old):
                if p >= end - at:
                    places[p + shift] = i
                p += len(t)
            made, resumed = [], len(old) if whole else None
            edited = start - at + len(new)
            for m in self.counter.pattern.finditer(text):
                if m.start() >= edited and m.start() in places:
                    resumed = places[m.start()]
                    break
                if not whole and m.end() + LOOK > len(text):
                    resumed = None
                    break
                made.append(m[0])
            if resumed is not None:
                break
            last += 1
            stop += self.chars[self.base + last]
        self.encoded += sum(map(len, made))
        keep = self.leaves[first]
        old_counts = [c for k in range(first, last + 1) for c in self.leaves[k][1]][head:]
        tokens = keep[0][:head] + made + old[resumed:]
        counts = keep[1][:head] + self.counter.counts(made) + old_counts[resumed:]
        span = last - first + 1
        if len(tokens) > 2 * LEAF * span:  # too much for these leaves: the tree is laid out anew, nothing is encoded again
            return self.build([t for k in range(first) for t in self.leaves[k][0]] + tokens + [t for k in range(last + 1, len(self.leaves)) for t in self.leaves[k][0]], [c for k in range(first) for c in self.leaves[k][1]] + counts + [c for k in range(last + 1, len(self.leaves)) for c in self.leaves[k][1]])
        each = -(-len(tokens) // span) or 1
        for j in range(span):
            leaf = (tokens[j * each : (j + 1) * each], counts[j * each : (j + 1) * each])
            self.leaves[first + j] = leaf
            k = self.base + first + j
            self.chars[k], self.tokens[k] = sum(map(len, leaf[0])), sum(leaf[1])
            while k > 1:
                k //= 2
                self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    def text(self) -> str:
        return "".join(t for leaf, _ in self.leaves for t in leaf)


#: The edits that the query applies to a text, one after the other: place as a fraction, characters cut, new text.
STATED = ((1, 4, 5, ""), (1, 2, 0, " (see the note) "), (3, 4, 3, "42,"))
EDIT = "array<struct<seq:bigint,start:bigint,end:bigint,text:string>>"


def stated_edits(n: int) -> list[tuple[int, int, str]]:
    """start, end and text of the stated edits of a text of n characters."""
    return [(a * n // b, a * n // b + cut, new) for a, b, cut, new in STATED]


def stated_column(n):
    """stated_edits as a column."""
    at = [F.floor(n * a / b).cast("long") for a, b, _, _ in STATED]
    return F.array(*[F.struct(F.lit(i).alias("seq"), x.alias("start"), (x + cut).alias("end"), F.lit(new).alias("text")) for i, (x, (_, _, cut, new)) in enumerate(zip(at, STATED))]).cast(EDIT)


def tree_schema(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, lengths array<int>, counts array<int>"


TREE_TYPES = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]


def build_trees(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, text, lengths and counts (of each pre-token) for every row of docs."""
    if not path:
        path, pattern = vocabulary()

    def build(it):
        counter = worker_cache(("counter", path), lambda: Counter(path, pattern))
        for batch in it:
            lengths, counts, sizes, texts = [], [], [0], []
            for text in as_bytes(batch.column("text")):
                texts.append(text.decode("utf-8", "replace"))
                tokens = counter.pattern.findall(texts[-1])
                lengths.append(np.fromiter(map(len, tokens), np.int32, len(tokens)))
                counts.append(np.array(counter.counts(tokens), np.int32))
                sizes.append(sizes[-1] + len(tokens))
            lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(x) if x else [], pa.int32())) for x in (lengths, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), *lists], names=["doc_id", "text", "lengths", "counts"])

    return docs.select("doc_id", "text").mapInArrow(settled(build), tree_schema(docs))


def columns(rows: list[tuple], types: list) -> list[pa.Array]:
    return [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(types), types)]


def lists_of(column):
    """The rows of an Arrow column of lists, null as []."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return (values[a:z].tolist() for a, z in zip(ends, ends[1:]))


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """trees with the column edits: all edits (doc_id, seq, start, end, text) of the tree's document in order."""
    one = F.struct(F.col("seq").cast("long").alias("seq"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "text")
    todo = edits.groupBy(F.col("doc_id").alias("of")).agg(F.sort_array(F.collect_list(one)).alias("edits"))
    return trees.select("doc_id", "text", "lengths", "counts").join(todo, F.col("doc_id").eqNullSafe(F.col("of")), "left").drop("of")


def apply_edits(trees: DataFrame, path: str | None = None, pattern: str | None = None, keep: bool = True) -> DataFrame:
    """The trees after their column edits, as doc_id, n_tokens, n_pretokens, n_edits, n_tokens_after, n_encoded_chars (by the
    edits) and, if they are to be kept, text, lengths and counts."""
    if not path:
        path, pattern = vocabulary()
    told = ["n_tokens", "n_pretokens", "n_edits", "n_tokens_after", "n_encoded_chars"]
    types = [pa.int64()] * len(told) + TREE_TYPES * keep

    def edit(it):
        counter = worker_cache(("counter", path), lambda: Counter(path, pattern))
        for batch in it:
            rows = []
            for text, lengths, counts, todo in zip(as_bytes(batch.column("text")), lists_of(batch.column("lengths")), lists_of(batch.column("counts")), batch.column("edits").to_pylist()):
                tree = CountTree.kept(text.decode("utf-8", "replace"), lengths, counts, counter)
                before, pretokens = tree.total, sum(len(t) for t, _ in tree.leaves)
                for e in todo or []:
                    start = max(0, e["start"] or 0)
                    tree.edit(start, start if e["end"] is None else e["end"], e["text"] or "")
                rows.append((before, pretokens, len(todo or []), tree.total, tree.encoded, *(tree.row() if keep else ())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns(rows, types)], names=["doc_id", *told, *["text", "lengths", "counts"] * keep])

    head, tail = tree_schema(trees).split(", ", 1)
    return trees.select("doc_id", "text", "lengths", "counts", "edits").mapInArrow(settled(edit), ", ".join([head, *[f"{n} long" for n in told], *[tail] * keep]))


def edit_trees(trees: DataFrame, edits: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Kept trees after a table of edits (doc_id, seq, start, end, text), see apply_edits."""
    return apply_edits(with_edits(trees, edits), path, pattern)


def count_tokens(docs: DataFrame, path: str | None = None, pattern: str | None = None, edits=stated_column) -> DataFrame:
    """doc_id, n_tokens, n_pretokens, n_edits, n_tokens_after, n_encoded_chars (by the edits, a column of the text's length) for every row."""
    return apply_edits(build_trees(docs, path, pattern).withColumn("edits", edits(F.length("text"))), path, pattern, keep=False)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every row of documents before and after the stated edits."""
    return count_tokens(table(spark, sf_dir, "documents"))

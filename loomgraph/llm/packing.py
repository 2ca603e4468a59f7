"""Hierarchical multi-length packing of tokenised documents.

Documents become token pieces, and each piece is routed to the smallest context tier that holds it (what exceeds the
longest tier fills whole windows at once). Tiers are packed from the longest down: a piece opens a window of its
tier, the gap takes the longest pieces of shorter tiers that fit, and is closed by cutting a piece. A piece whose gap
nothing can fill gives up one window of the next shorter tier and goes on as a smaller piece. So every window is full,
but for the last one of a partition, which is padded. A step group is STEP_TOKENS tokens: the windows of a tier fill groups
of their own, and what a partition has left of all tiers fills common ones from the longest window down, so only the
last group of a partition is short. Groups are numbered across partitions.

Scale: one pass over the documents, no shuffle; each task packs a pool of at most POOL_TOKENS tokens at a time and
carries what is left into the next pool. sequence_id is made of the partition and a count within it, so a task that
runs again makes the same sequences.

Defined results: null and empty texts are the closing id alone; a text of any length is packed whole; repeated rows
are packed as often as they stand there; an empty table gives no rows; other columns are ignored.
"""

import bisect
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from loomgraph.llm.common import as_bytes, settled, table, worker_cache

TIERS = (512, 1024, 2048, 4096)
CLOSING_ID = 2
POOL_TOKENS = 2_000_000
#: Tokens of a step group, a multiple of every tier.
STEP_TOKENS = 65_536
#: Chunks whose ids a Python worker remembers.
REMEMBERED = 300_000
BREAKS = re.compile(r"[ \t\n\r\x0b\x0c]+")
#: Letters that the tokenizer's normaliser only makes small, then marks without an apostrophe.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=?@]*)")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """How a byte-level vocabulary writes the bytes of each Latin-1 character: printable bytes as they are, others from 256 on."""
    shown = {b for a, z in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)) for b in range(a, z + 1)}
    rest = iter(range(256, 512))
    letters = {b: chr(b if b in shown else next(rest)) for b in range(256)}
    return {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}


class Known(dict):
    """Ids of chunks, found out when first asked for."""

    def __init__(self, find):
        self.find = find

    def __missing__(self, chunk):
        self[chunk] = out = self.find(chunk)
        return out


class Encoder:
    """Ids of whole texts. The tokenizer drops white space and never joins across it, so chunks between white space
    are encoded one by one and remembered."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.kind = np.dtype("<u4" if self.tokenizer.get_vocab_size() > 65_536 else "<u2")
        self.known, self.words, self.marks = Known(self.chunk), Known(self.word), Known(self.encode)

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def word(self, word: str) -> bytes:
        return np.array([t.id for t in self.model.tokenize(word.translate(self.letters))], self.kind).tobytes()

    def chunk(self, chunk: str) -> bytes:
        """A chunk of plain letters and marks after them is its small-letter word and its marks, which recur more often than it."""
        m = PLAIN.fullmatch(chunk)
        if not m:
            return self.encode(chunk)
        return self.words[m[1].lower()] + self.marks[m[2]] if m[2] else self.words[m[1].lower()]

    def forget(self) -> None:
        for held in (self.known, self.words, self.marks):
            held.clear()

    def ids(self, text: str) -> np.ndarray:
        for held, most in ((self.known, REMEMBERED), (self.words, 2 * REMEMBERED), (self.marks, REMEMBERED)):
            if len(held) > most:
                held.clear()
        chunks = BREAKS.split(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        return np.frombuffer(b"".join(map(self.known.__getitem__, chunks)), self.kind)


class Packer:
    """Packs pieces (doc, start, ids) of one partition; rows() gives what is packed so far."""

    def __init__(self, tiers=TIERS, step_tokens: int = STEP_TOKENS):
        self.tiers, self.step_tokens = tuple(sorted(tiers)), step_tokens
        self.pools = defaultdict(list)  # length -> pieces
        self.lengths: list[int] = []  # sorted lengths that have pieces
        self.tokens = self.sequences = 0
        self.groups = 0
        self.open: dict[int, list] = defaultdict(list)  # window size -> windows without a step group yet
        self.out: list[tuple] = []

    def add(self, doc, start: int, ids: np.ndarray) -> None:
        top = self.tiers[-1]
        while len(ids) >= top:
            self.emit([(doc, start, ids[:top])], top)
            start, ids = start + top, ids[top:]
        if len(ids):
            self.put((doc, start, ids))

    def put(self, piece: tuple) -> None:
        n = len(piece[2])
        if not self.pools[n]:
            bisect.insort(self.lengths, n)
        self.pools[n].append(piece)
        self.tokens += n

    def take(self, n: int) -> tuple:
        piece = self.pools[n].pop()
        if not self.pools[n]:
            self.lengths.pop(bisect.bisect_left(self.lengths, n))
        self.tokens -= n
        return piece

    def emit(self, pieces: list[tuple], size: int) -> None:
        waiting = self.open[size]
        waiting.append((self.sequences, pieces, size))
        self.sequences += 1
        if len(waiting) * size >= self.step_tokens:
            self.close(waiting)
            waiting.clear()

    def close(self, windows: list[tuple]) -> None:
        """The windows become the next step group."""
        for sequence, pieces, size in windows:
            at = 0
            for doc, start, ids in pieces:
                self.out.append((doc, start, ids, sequence, at, size, self.groups))
                at += len(ids)
        self.groups += 1

    def pack(self, last: bool) -> None:
        """Fills windows while there is a tier's worth of tokens; the last call leaves none."""
        for k in range(len(self.tiers) - 1, -1, -1):
            size, below = self.tiers[k], self.tiers[k - 1] if k else 0
            while self.lengths and self.lengths[-1] > below and self.tokens >= size:
                pieces = [self.take(self.lengths[-1])]
                gap = size - len(pieces[0][2])
                while gap:
                    at = bisect.bisect_right(self.lengths, gap)
                    if at:  # the longest piece that fits
                        pieces.append(self.take(self.lengths[at - 1]))
                    else:  # none fits: the shortest is cut
                        doc, start, ids = self.take(self.lengths[0])
                        pieces.append((doc, start, ids[:gap]))
                        self.put((doc, start + gap, ids[gap:]))
                    gap -= len(pieces[-1][2])
                self.emit(pieces, size)
            while k and self.lengths and self.lengths[-1] > below:  # too few tokens are left for a window of this tier
                doc, start, ids = self.take(self.lengths[-1])
                self.emit([(doc, start, ids[:below])], below)
                self.put((doc, start + below, ids[below:]))
        if last and self.lengths:
            rest = []
            while self.lengths:
                rest.append(self.take(self.lengths[-1]))
            n = sum(len(ids) for _, _, ids in rest)
            self.emit(rest, n if n & (n - 1) == 0 else self.tiers[-1])  # its reader pads it to the longest tier
        if last:
            held, room = [], self.step_tokens
            for window in sorted((w for ws in self.open.values() for w in ws), key=lambda w: -w[2]):
                if held and window[2] > room:
                    self.close(held)
                    held, room = [], self.step_tokens
                held.append(window)
                room -= window[2]
            if held:
                self.close(held)
            self.open.clear()

    def rows(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack_documents(docs: DataFrame, path: str | None = None, tiers=TIERS, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier (the window's
    padded size), step_group and, if asked for, ids (little-endian unsigned 32-bit)."""
    path = path or tokenizer_path()
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long" + ", ids binary" * with_ids

    def pack(it):
        encoder = worker_cache(("encoder", path), lambda: Encoder(path))
        packer, base, sizes, doc_ids = Packer(tiers), TaskContext.get().partitionId() << 32, [], []

        def made():
            rows = []
            for doc, start, ids, sequence, offset, tier, step in packer.rows():
                whole = ids.astype("<u4").tobytes()
                rows.append((doc[0], start, len(ids), zlib.crc32(whole), doc[1], base + sequence, offset, tier, base + step, *[whole] * with_ids))
            for at in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 4096]), types)], names=names)

        names, types = [], []
        for batch in it:
            if not names:
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"] + ["ids"] * with_ids
                types = [batch.schema.field("doc_id").type, *[pa.int64()] * 6, pa.int32(), pa.int64(), *[pa.binary()] * with_ids]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))):
                ids = np.append(encoder.ids(text.decode("utf-8", "replace")), encoder.kind.type(CLOSING_ID))
                packer.add((doc_id, len(ids)), 0, ids)
                if packer.tokens >= POOL_TOKENS or len(packer.out) >= 8192:
                    packer.pack(last=False)
                    yield from made()
        packer.pack(last=True)
        if names:
            yield from made()
        encoder.forget()  # an idle worker holds the tokenizer alone

    return docs.select("doc_id", "text").mapInArrow(settled(pack), schema)


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece of documents (and tier, step_group)."""
    return pack_documents(table(spark, sf_dir, "documents"))

"""Token ids in binary blocks, with document boundaries in Elias-Fano code.

A block holds the ids of consecutive documents one behind the other, in two bytes each where the
vocabulary allows it, and two sorted sequences in Elias-Fano code: where documents end, and their
doc_ids. For n values below u the code takes about n * (2 + log2(u / n)) bits; every 64th set bit of
the upper part has its place stored in four bytes, so that one value is found without decoding the
rest.

Layout, little-endian: magic "EFT1", width of an id (1 byte), number of documents, of documents
without doc_id, of ids (4 bytes each), the first doc_id (8 bytes), the two sequences, the ids.
"""

from __future__ import annotations

import functools
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.llm.common import shared_folder
from tillroll.llm.prefix_counts import PieceSplitter, spaced_simply
from tillroll.llm.vocabulary import byte_letters, load, specials

MAGIC = b"EFT1"
HEAD = struct.Struct("<4sBIIIq")
SEQUENCE = struct.Struct("<IBII")
EVERY = 64


class EliasFano:
    """A sorted sequence of numbers from 0 on."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        bits = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        lows = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1) if bits else np.zeros((0, 0))
        at = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        upper = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        upper[at] = 1
        low = np.packbits(lows.astype(np.uint8).ravel(), bitorder="little").tobytes()
        return cls(n, bits, low, np.packbits(upper, bitorder="little").tobytes(), at[::EVERY].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = SEQUENCE.pack(self.n, self.low_bits, len(self.low), len(self.high))
        return head + self.low + self.high + self.samples.tobytes()

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, bits, n_low, n_high = SEQUENCE.unpack_from(data, at)
        at += SEQUENCE.size
        low, high = data[at : at + n_low], data[at + n_low : at + n_low + n_high]
        at += n_low + n_high
        n_samples = -(-n // EVERY)
        return cls(n, bits, low, high, np.frombuffer(data, "<u4", n_samples, at)), at + 4 * n_samples

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        first = i * self.low_bits
        chunk = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8], "little")
        return chunk >> (first % 8) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value, found from the nearest stored place before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // EVERY]), i % EVERY
        byte = at // 8
        word = self.high[byte] >> (at % 8) << (at % 8)  # the sampled bit is the first that is left
        while left >= word.bit_count():
            left -= word.bit_count()
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        place = 8 * byte + (word & -word).bit_length() - 1
        return (place - i) << self.low_bits | self._low(i)

    def decode(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        values = (ones - np.arange(self.n)).astype(np.int64) << self.low_bits
        if self.low_bits and self.n:
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")
            bits = bits[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.int64)
            values |= (bits << np.arange(self.low_bits)).sum(axis=1)
        return values


def pack_block(doc_ids: list[int | None], ids: list[np.ndarray], width: int) -> bytes:
    """One block. The documents are in ascending doc_id order, those without doc_id first."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    first = int(known[0]) if len(known) else 0
    sizes = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    head = HEAD.pack(MAGIC, width, len(doc_ids), len(doc_ids) - len(known), len(flat), first)
    ends = EliasFano.encode(np.cumsum(sizes)).to_bytes()
    # the difference of two 64-bit numbers fits in 64 bits without sign
    keys = EliasFano.encode(known.astype(np.uint64) - np.uint64(first % 2**64)).to_bytes()
    return head + ends + keys + flat.astype(f"<u{width}").tobytes()


class Block:
    """A packed block, read without decoding what isn't asked for."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        magic, self.width, self.n_docs, self.n_null, self.n_ids, self.first = HEAD.unpack_from(self.data)
        if magic != MAGIC:
            raise ValueError("not a token block")
        self.ends, at = EliasFano.read(self.data, HEAD.size)
        self.keys, self.at = EliasFano.read(self.data, at)

    def span(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def ids(self, i: int) -> np.ndarray:
        begin, end = self.span(i)
        return np.frombuffer(self.data, f"<u{self.width}", end - begin, self.at + begin * self.width)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, start within the block, and ids of each document."""
        ends = self.ends.decode()
        wrap = 1 << 63  # sums leave 64 bits only where the ids of a block span more than half of them
        keys = [None] * self.n_null + [(int(k) + self.first + wrap) % (2 * wrap) - wrap for k in self.keys.decode()]
        flat = np.frombuffer(self.data, f"<u{self.width}", self.n_ids, self.at)
        for key, begin, end in zip(keys, [0, *ends[:-1]], ends):
            yield key, int(begin), flat[begin:end]


class Encoder:
    """Ids of whole texts as the library gives them; pieces and words seen before are looked up.

    Where no space has a blank beside it, a text may be cut before each space, and around line feeds if none
    has another beside it. The words of a new piece are encoded by the library's model. Other texts, and
    texts with special strings, go to the library whole. Pieces, and words of pieces with more than one, are known in two generations: when the young
    one is full it becomes the old one, and what is met again moves back, so that frequent ones stay.
    """

    def __init__(self, name: str, cached: int = 400_000):
        self.tok, self.cached = load(name), cached
        self.model = self.tok.model
        self.specials = specials(name)
        self.split = PieceSplitter(self.tok).split
        self.space = byte_letters()[32]
        self.pieces: dict[str, bytes] = {"": b""}  # what is left beside a cut at either end
        self.old_pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            found = self.old_words.get(word)
            if found is None:
                found = array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
            self.words[word] = found
        return found

    def _piece(self, piece: str) -> bytes:
        body = piece[1:] if piece[0] == " " else piece
        if body.isascii() and body.isalpha():  # one word for the vocabulary's pattern
            return self._word(self.space + body if body is not piece else body)
        return b"".join([self._word(w) for w in self.split(piece)])

    def _learn(self, parts: list[str], found: list[bytes | None]) -> None:
        """Fill in what the young generation does not know."""
        young, old = self.pieces, self.old_pieces
        for i, known in enumerate(found):
            if known is None:
                piece = parts[i]
                known = young.get(piece) or old.get(piece) or self._piece(piece)
                young[piece] = found[i] = known
        if len(young) > self.cached:
            self.old_pieces, self.pieces = young, {"": b""}
        if len(self.words) > self.cached:
            self.old_words, self.words = self.words, {}

    def encode(self, text: str) -> bytes:
        """The ids as 32-bit numbers in the machine's order."""
        if not spaced_simply(text) or any(s in text for s in self.specials):
            return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()
        if "\0" in text:
            parts = cut_before_spaces(text)
        else:
            cut = text.replace(" ", "\0 ")
            if "\n\n" not in text:
                cut = cut.replace("\n", "\0\n\0")
            parts = cut.split("\0")
        found = list(map(self.pieces.get, parts))
        if None in found:
            self._learn(parts, found)
        return b"".join(found)


def cut_before_spaces(text: str) -> list[str]:
    first, *rest = text.split(" ")
    return [first, *(" " + p for p in rest)]


@functools.lru_cache(maxsize=2)
def worker_encoder(name: str) -> Encoder:
    """One encoder per Python worker, so that tasks after the first find most words known."""
    return Encoder(name)


def write_tokens(
    docs: DataFrame,
    path: str | None = None,
    vocabulary: str = "byte_bpe_50k.json",
    end_id: int = 0,
    block_ids: int = 1 << 20,
) -> str:
    """Encode texts and write them as blocks in ascending doc_id order; the path is returned.

    The table has part, block, n_docs, n_ids and payload (the block); (part, block) is the order. A
    null text is empty and has the end id alone. Documents without doc_id come first, those with the
    same doc_id in the order of their texts. A block has `block_ids` ids, or one longer document.
    Other columns are not stored. Texts are dealt out by ranges of doc_id, so that no part depends on
    a hot source, and a part is written by one task and rewritten whole if its executor is lost.
    """
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/llm-tokens-{uuid.uuid4().hex[:12]}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary)
        width = 2 if encoder.tok.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        part, end = TaskContext.get().partitionId(), array("I", [end_id]).tobytes()
        block, keys, ids, n = 0, [], [], 0

        def full() -> pa.RecordBatch:
            payload = pack_block(keys, ids, width)
            row = {"part": [part], "block": [block], "n_docs": [len(keys)], "n_ids": [n], "payload": [payload]}
            return pa.RecordBatch.from_pydict(row, schema)

        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                keys.append(key)
                ids.append(np.frombuffer(encoder.encode(text or "") + end, np.uint32))
                n += len(ids[-1])
                if n >= block_ids:
                    yield full()
                    block, keys, ids, n = block + 1, [], [], 0
        if keys:
            yield full()

    schema = pa.schema(
        [("part", pa.int64()), ("block", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())]
    )
    # texts are dealt out by key; a random second key would cut equal keys apart
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    ordered.mapInArrow(run, "part long, block long, n_docs long, n_ids long, payload binary").write.option(
        "compression", "zstd"
    ).parquet(path)
    return path


def block_starts(blocks: DataFrame) -> DataFrame:
    """part, block and the number of ids before the block.

    The sums of the parts, one row per writing task, are added up first, then blocks within a part.
    """
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before.orderBy("part")), zero).alias("part_start")
    )
    within = F.sum("n_ids").over(before.partitionBy("part").orderBy("block"))
    inner = blocks.select("part", "block", F.coalesce(within, zero).alias("block_start"))
    return inner.join(parts, "part").select(
        "part", "block", (F.col("part_start") + F.col("block_start")).alias("start")
    )


def read_documents(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block, payload in zip(*(batch.column(i) for i in range(3))):
                rows = list(Block(payload.as_py()).documents())
                columns = {
                    "part": pa.array([part.as_py()] * len(rows), pa.int64()),
                    "block": pa.array([block.as_py()] * len(rows), pa.int64()),
                    "doc_id": pa.array([r[0] for r in rows], pa.int64()),
                    "offset": pa.array([r[1] for r in rows], pa.int64()),
                    "n_tokens": pa.array([len(r[2]) for r in rows], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(r[2].astype("<u4").tobytes()) for r in rows], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array([r[2].astype(np.int32) for r in rows], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    blocks = spark.read.parquet(path)
    types = "part long, block long, doc_id long, offset long, n_tokens long, ids_crc32 long"
    rows = blocks.select("part", "block", "payload").mapInArrow(run, types + ", ids array<int>" * with_ids)
    starts = block_starts(blocks.select("part", "block", "n_ids"))
    joined = rows.join(starts, ["part", "block"])
    columns = ["doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"]
    return joined.select(*columns, *(["ids"] if with_ids else []))

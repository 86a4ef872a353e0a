"""Token ids in a binary format of our own, coded by a static range asymmetric
numeral system (rANS).

A segment holds the ids of consecutive documents: a header, one frequency table that
all its blocks share, and independent blocks. A block deals its ids to LANES
interleaved states that one numpy step advances together; every CHECKPOINT steps it
notes the states and its place in the stream, so that a reader can start there.
Each block has a checksum of its ids and one of its coded bytes.

Layout, little-endian, lengths before parts:
  segment: magic "QRS1", u8 scale bits, u32 documents, u32 symbols, u32 blocks,
           i64 ids in the segment, then u32 tokens of each document, u32 symbols,
           u32 frequencies, blocks, u32 crc of all before it
  block:   u32 ids, u32 words, u32 checkpoints, u32 crc of the ids as u32,
           u32 crc of the part after this header, then for each checkpoint its step (u32), its word (u32)
           and LANES states (u64), then the words (u32)
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import shared_dir, table, tasks

MAGIC, LANES, CHECKPOINT = b"QRS1", 1024, 256
LOW = np.uint64(1 << 31)
BLOCK_IDS, SEGMENT_IDS = 1 << 18, 1 << 21
HEAD, BLOCK_HEAD = struct.Struct("<4sBIIIq"), struct.Struct("<IIIII")
END_ID = 2
#: Chunks whose ids a worker keeps, about 80 MB.
KEPT_CHUNKS = 400_000


class CorruptSegment(ValueError):
    """A magic, length or checksum isn't as written."""


def scale_bits(symbols: int) -> int:
    """Bits of the frequencies: two more than the symbols need, so that tables stay in a core's cache."""
    return min(20, max(12, symbols.bit_length() + 2))


def frequencies(counts: np.ndarray, scale: int) -> np.ndarray:
    """Positive counts scaled to a sum of 1 << scale, each at least 1.

    Rounds down, then gives what is left, or takes what is too much, from the largest.
    """
    total = 1 << scale
    if len(counts) > total:
        raise ValueError(f"{len(counts)} symbols need more than {scale} bits")
    f = np.maximum(1, counts.astype(np.float64) * (total / counts.sum())).astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    rest = total - int(f.sum())
    if rest > 0:
        f[order[0]] += rest
    for k in order:
        if rest >= 0:
            break
        take = min(-rest, int(f[k]) - 1)
        f[k] -= take
        rest += take
    return f.astype(np.uint64)


class Table:
    """Symbols of a segment with frequency and start; slots to symbols for decoding."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray, scale: int):
        self.symbols, self.freq, self.scale = symbols, freq.astype(np.uint64), scale
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64) if len(freq) else self.freq
        self.slots: np.ndarray | None = None

    def of_slot(self) -> np.ndarray:
        if self.slots is None:
            self.slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self.slots


def encode_block(at: np.ndarray, t: Table) -> tuple[list[tuple[int, int, np.ndarray]], np.ndarray]:
    """at: places of the ids in the table. Returns checkpoints (step, word, states) in
    the order of reading, and the words."""
    steps = -(-len(at) // LANES)
    states = np.full(LANES, LOW, np.uint64)
    limit = np.uint64(63 - t.scale)
    scale, words, marks, written = np.uint64(t.scale), [], [], 0
    for step in range(steps - 1, -1, -1):
        s = at[step * LANES:(step + 1) * LANES]
        x, f = states[:len(s)], t.freq[s]
        full = (x >> limit) >= f
        if full.any():
            words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            written += len(words[-1])
            x[full] >>= np.uint64(32)
        q = x // f
        x[:] = (q << scale) + (x - q * f) + t.start[s]
        if step % CHECKPOINT == 0:
            marks.append((step, written, states.copy()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    return [(step, written - w, x) for step, w, x in reversed(marks)], stream


def decode_block(n: int, mark: tuple[int, int, np.ndarray], words: np.ndarray, t: Table, stop: int | None = None) -> np.ndarray:
    """Ids of a block from a checkpoint on, up to step stop."""
    first, word, states = mark
    steps = min(-(-n // LANES), stop if stop is not None else 1 << 62)
    states, slots, scale = states.copy(), t.of_slot(), np.uint64(t.scale)
    mask, out = np.uint64((1 << t.scale) - 1), np.empty(max(0, min(n, steps * LANES) - first * LANES), np.uint32)
    at = 0
    for step in range(first, steps):
        k = min(LANES, n - step * LANES)
        x = states[:k]
        slot = x & mask
        s = slots[slot]
        out[at:at + k] = s
        at += k
        x[:] = t.freq[s] * (x >> scale) + slot - t.start[s]
        low = x < LOW
        m = int(np.count_nonzero(low))
        if m:
            x[low] = (x[low] << np.uint64(32)) | words[word:word + m]
            word += m
    return t.symbols[out]


def write_segment(documents: list[np.ndarray]) -> bytes:
    """The segment of these documents' ids (uint32)."""
    lengths = np.array([len(d) for d in documents], "<u4")
    ids = np.concatenate(documents).astype("<u4") if documents else np.zeros(0, "<u4")
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    symbols = np.flatnonzero(counts).astype("<u4")
    scale = scale_bits(len(symbols))
    t = Table(symbols, frequencies(counts[symbols], scale) if len(ids) else np.zeros(0), scale)
    place = np.zeros(len(counts), np.uint32)
    place[symbols] = np.arange(len(symbols))
    out = [HEAD.pack(MAGIC, scale, len(documents), len(symbols), -(-len(ids) // BLOCK_IDS), len(ids)), lengths.tobytes(), symbols.tobytes(), t.freq.astype("<u4").tobytes()]
    for first in range(0, len(ids), BLOCK_IDS):
        block = ids[first:first + BLOCK_IDS]
        marks, words = encode_block(place[block], t)
        body = b"".join(struct.pack("<II", step, word) + x.astype("<u8").tobytes() for step, word, x in marks) + words.tobytes()
        out += [BLOCK_HEAD.pack(len(block), len(words), len(marks), zlib.crc32(block.tobytes()), zlib.crc32(body)), body]
    whole = b"".join(out)
    return whole + struct.pack("<I", zlib.crc32(whole))


class Segment:
    """A reader: lengths of documents, the table, and blocks that decode on their own."""

    def __init__(self, data: bytes):
        if len(data) < HEAD.size + 4 or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise CorruptSegment("checksum of the segment")
        magic, scale, n_docs, n_symbols, n_blocks, self.n_ids = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise CorruptSegment("magic")
        at, parts = HEAD.size, []
        for n in (n_docs, n_symbols, n_symbols):
            parts.append(np.frombuffer(data, "<u4", n, at))
            at += 4 * n
        self.lengths, self.table, self.blocks = parts[0], Table(parts[1], parts[2], scale), []
        for _ in range(n_blocks):
            n, n_words, n_marks, crc, body_crc = BLOCK_HEAD.unpack_from(data, at)
            at += BLOCK_HEAD.size
            size = n_marks * (8 + 8 * LANES) + 4 * n_words
            if zlib.crc32(data[at:at + size]) != body_crc:
                raise CorruptSegment("checksum of a block")
            marks = []
            for _ in range(n_marks):
                marks.append((*struct.unpack_from("<II", data, at), np.frombuffer(data, "<u8", LANES, at + 8).astype(np.uint64)))
                at += 8 + 8 * LANES
            self.blocks.append((n, marks, np.frombuffer(data, "<u4", n_words, at).astype(np.uint64), crc))
            at += 4 * n_words

    def block(self, k: int) -> np.ndarray:
        n, marks, words, crc = self.blocks[k]
        ids = decode_block(n, marks[0], words, self.table).astype("<u4")
        if zlib.crc32(ids.tobytes()) != crc:
            raise CorruptSegment("checksum of a block's ids")
        return ids

    def from_checkpoint(self, k: int, mark: int) -> np.ndarray:
        """Ids of block k from one checkpoint to the next, without those before."""
        n, marks, words, _ = self.blocks[k]
        return decode_block(n, marks[mark], words, self.table, marks[mark + 1][0] if mark + 1 < len(marks) else None)

    def documents(self) -> Iterator[np.ndarray]:
        ids = np.concatenate([self.block(k) for k in range(len(self.blocks))]) if self.blocks else np.zeros(0, "<u4")
        at = 0
        for n in self.lengths:
            yield ids[at:at + n]
            at += int(n)


FILES = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("data", pa.binary())])
FILES_DDL = "shard int, segment int, first long, n_ids long, doc_ids array<long>, data binary"


def write_ids(texts: DataFrame, path: str, encode_with, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shards: int | None = None) -> None:
    """Encode all texts in ascending order of ids and write their segments to path.

    encode_with: a function without arguments that makes, in a worker, a function from
    texts to their ids as little-endian 16-bit bytes. Rows are dealt to shards by
    ranges of the id, and a shard is written in order, a segment at a time: a task
    holds one segment and the longest document. Rows under one id come in the order
    of their text's hash; a null text is an empty one, a null id comes first.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, shard = encode_with(), TaskContext.get().partitionId()
        names, documents, held, first, number = [], [], 0, 0, 0

        def segment() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((shard, number, first, held, names, write_segment(documents)), FILES)], schema=FILES)

        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                for name, raw in zip(part.column(0).to_pylist(), ids_of([t or "" for t in part.column(1).to_pylist()])):
                    ids = np.append(np.frombuffer(raw, "<u2").astype(np.uint32), np.uint32(end_id))
                    names.append(name)
                    documents.append(ids)
                    held += len(ids)
                    if held >= SEGMENT_IDS:
                        yield segment()
                        first, number = first + held, number + 1
                        names, documents, held = [], [], 0
        if names:
            yield segment()

    rows = texts.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(shards or tasks(texts.sparkSession), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    dealt.mapInArrow(encode, FILES_DDL).write.option("compression", "uncompressed").parquet(path)


def read_ids(spark, path: str) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before it: those in its shard, and those of
    the shards before, which are summed over one row a shard.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("own", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for shard, first, names, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                s = Segment(data.as_py())
                crc = [zlib.crc32(ids.tobytes()) for ids in s.documents()]
                n = s.lengths.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(n), pa.int32()), names.values, pa.array(first + np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())], schema=schema)

    files = spark.read.schema(FILES_DDL).parquet(path)
    documents = files.select("shard", "first", "doc_ids", "data").mapInArrow(decode, "shard int, doc_id long, own long, n_tokens long, ids_crc32 long")
    before = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("shard")) - F.col("n"))
    return documents.join(F.broadcast(before.select("shard", "before")), "shard").select("doc_id", (F.col("own") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op7_rans(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """tokenizer: the tokenizer's file, at the same place on every machine."""
    path = shared_dir(spark, "token-ids")
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")

    def encoder():
        from quarry.llm.tokens import chunk_ids

        return chunk_ids(tokenizer, "<u2", KEPT_CHUNKS)

    write_ids(table(spark, sf_dir, "documents"), path, encoder)
    return read_ids(spark, path)

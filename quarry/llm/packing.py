"""Packing of token sequences by minimum bin slack.

What a bin holds depends on lengths only, so the plan is made on the histogram of
lengths, which has at most as many entries as a bin has tokens, whatever the table's
size. For each bin the longest length that is left goes in, and a bitset subset-sum
over the lengths still available finds the fullest combination for the rest; that
combination is then removed as many times as the counts allow. The plan is a table of
rank intervals a length, bounded by the bin's size too; a piece finds its bin by its
rank among the pieces of its length.

Ranks need no sort and no task that holds a whole length: a piece is counted within
its writing task, and the counts of tasks and lengths are then summed up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import shared_dir, table

CAPACITY = 2048
END_ID = 0
#: Chunks whose ids a worker keeps where packing is all that runs, about 80 MB.
KEPT_CHUNKS = 400_000


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum up to room.

    Bit i of a set says that a sum of i can be made. Multiplicities are split in powers
    of two; lengths come longest first, so of equal sums one with long lengths wins.
    """
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            left, k = left - k, 2 * k
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + k
            at -= length * k
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Intervals (length, rank_from, rank_to, first_bin, per_bin, offset).

    Pieces of a length with rank_from <= rank < rank_to lie per_bin to a bin, from
    first_bin on, the first of a bin at offset.
    """
    left = {x: n for x, n in histogram.items() if n > 0}
    used, bins, out = dict.fromkeys(left, 0), 0, []
    while left:
        seed = max(left)
        left[seed] -= 1
        chosen = fullest(left, capacity - seed)
        left[seed] += 1
        chosen[seed] = chosen.get(seed, 0) + 1
        times, offset = min(left[x] // n for x, n in chosen.items()), 0
        for x, n in sorted(chosen.items(), reverse=True):
            out.append((x, used[x], used[x] + n * times, bins, n, offset))
            used[x] += n * times
            left[x] -= n * times
            offset += n * x
            if not left[x]:
                del left[x]
        bins += times
    return out


def pieces_of(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than capacity if it's cut."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.int32()), ("own_rank", pa.int64())])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, shard int, own_rank long"


def cut_pieces(texts: DataFrame, encode_with, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents, with the rank of each in its task among those of its length.

    encode_with makes, in a worker, a function from texts to their ids as little-endian
    32-bit bytes. A null text is an empty one: its only id is the end id.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, shard, ranks = encode_with(), TaskContext.get().partitionId(), {}
        for part in (b.slice(low, 1024) for b in batches for low in range(0, b.num_rows, 1024)):
            rows = []
            for name, raw in zip(part.column(0).to_pylist(), ids_of([t or "" for t in part.column(1).to_pylist()])):
                ids = np.append(np.frombuffer(raw, "<u4"), np.uint32(end_id)).astype("<u4")
                for piece, (start, length) in enumerate(pieces_of(len(ids), capacity)):
                    rank = ranks.setdefault(length, count())
                    rows.append((name, piece, start, length, zlib.crc32(ids[start:start + length].tobytes()), shard, next(rank)))
            columns = list(zip(*rows)) or [[]] * len(PIECES)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECES)], schema=PIECES)

    return texts.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES_DDL)


INTERVALS = pa.schema([(name, pa.int64()) for name in ("p_length", "rank_from", "rank_to", "first_bin", "per_bin", "p_offset")])


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Gives pieces their sequence_id and offset.

    pieces: as cut_pieces gives them, but read from files, so that ranks stay the same
    when a task runs again. Sequences have no gaps and at most capacity tokens.
    An empty table gives an empty one.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("shard", "length").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("shard")) - F.col("n")).drop("n")
    # at most `capacity` rows reach the driver, and the plan has at most about capacity * ln(capacity)
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # by Arrow: a list of rows would go through Python workers with a daemon of their own, which stay
    intervals = spark.createDataFrame(pa.Table.from_pylist([dict(zip(INTERVALS.names, row)) for row in plan(histogram, capacity)], schema=INTERVALS))
    ranked = pieces.join(before, ["shard", "length"]).withColumn("rank", F.col("own_rank") + F.col("before"))
    within = F.col("rank") - F.col("rank_from")
    runs = intervals.groupBy("p_length").agg(F.sort_array(F.collect_list(F.struct("rank_from", "rank_to", "first_bin", "per_bin", "p_offset"))).alias("runs"))
    found = ranked.join(F.broadcast(runs), F.col("length") == F.col("p_length"))
    run = F.filter("runs", lambda r: (r["rank_from"] <= F.col("rank")) & (F.col("rank") < r["rank_to"]))[0]
    found = found.withColumn("run", run).select("*", "run.rank_from", "run.first_bin", "run.per_bin", "run.p_offset")
    return found.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_bin") + F.floor(within / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.col("p_offset") + within % F.col("per_bin") * F.col("length")).cast("long").alias("offset"),
    )


def packed_documents(texts: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, kept: int | None = None) -> DataFrame:
    """Tokenize, cut and pack a table of doc_id and text; tokenizer: the file's path,
    the same on every machine; kept: chunks whose ids a worker keeps. Further columns are ignored, repeated rows are packed
    each, and an empty table gives an empty one."""
    spark = texts.sparkSession
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")

    def encoder():
        from quarry.llm.tokens import chunk_ids

        return chunk_ids(tokenizer, kept=kept)

    path = shared_dir(spark, "pieces")
    cut_pieces(texts, encoder, capacity=capacity).write.parquet(path)
    return pack(spark.read.schema(PIECES_DDL).parquet(path), capacity)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"), kept=KEPT_CHUNKS)

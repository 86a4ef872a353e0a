"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are sparse rows of (dimension, integer weight). Candidates and queries are
dealt into blocks; one task holds one block of each. It keeps the candidates as
postings by dimension and, dimension by dimension, scatters query weight times
posting weight into a dense score array. A partition selection leaves k entries a
query and block, and a window merges the blocks.

Both blocks are bounded (parameters), so a task's memory doesn't follow the table;
queries aren't broadcast. Work is queries times candidates, as an exhaustive search
must be, spread over all block pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialised

#: A posting list over this share of its block is kept as an array with zeros.
DENSE_SHARE = 0.25
#: Queries scored at a time: their score array stays in a core's cache.
QUERY_ROWS = 32


def quantised(vector: Column | str, scale: int = 64) -> Column:
    """floor(scale * x) of each component, as long."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def usable(vector: Column | str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    v = F.col(vector) if isinstance(vector, str) else vector
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(~odd, F.lit(False))


def _ragged(table: pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Row numbers and ids in the order of ids, null ids last, and a matrix of weights, zero where a row is shorter."""
    table = table.sort_by([("vec_id", "ascending"), ("row", "ascending")])
    lists = table.column("weights").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int64()))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False)[offsets[0]:] if len(lists) else np.zeros(0, np.int64)
    lengths = np.diff(offsets)
    dense = np.zeros((len(lists), int(lengths.max(initial=0))), np.int64)
    if len(values):
        dense[np.arange(dense.shape[1])[None, :] < lengths[:, None]] = values[: int(lengths.sum())]
    return table.column("row").to_numpy(), table.column("vec_id").combine_chunks(), dense


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Scores of all candidates, term by term, for QUERY_ROWS queries at a time.

    Yields the first query's row and a score array. 32-bit sums are used where the
    largest possible score fits, else 64-bit.
    """
    width = min(queries.shape[1], candidates.shape[1])
    top = int(np.abs(queries).max(initial=0)) * int(np.abs(candidates).max(initial=0)) * max(width, 1)
    kind = np.int32 if top < 2**31 else np.int64
    q, n = queries[:, :width].astype(kind), len(candidates)
    postings = []
    for d in range(width):
        column = candidates[:, d]
        at = np.flatnonzero(column)
        if len(at) > DENSE_SHARE * n:
            postings.append((None, np.ascontiguousarray(column, dtype=kind)))
        elif len(at):
            postings.append((at, column[at].astype(kind)))
        else:
            postings.append(None)
    for first in range(0, len(q), QUERY_ROWS):
        block = q[first:first + QUERY_ROWS]
        scores = np.zeros((len(block), n), kind)
        part = np.empty_like(scores)
        for d, posting in enumerate(postings):
            if posting is None:
                continue
            at, weights = posting
            rows = np.flatnonzero(block[:, d])
            if at is None and len(rows) > len(block) // 2:
                np.multiply(block[:, d, None], weights[None, :], out=part)
                scores += part
            elif at is None:
                scores[rows] += block[rows, d, None] * weights[None, :]
            elif len(rows):
                scores[np.ix_(rows, at)] += block[rows, d, None] * weights[None, :]
        yield first, scores


def _select(k: int):
    schema = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def best(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        q_row, q_id, q = _ragged(left)
        c_row, c_id, c = _ragged(right)
        n, out = len(c_row), []
        for first, scores in accumulate(q, c):
            # one key orders by score, then by smaller id: positions follow the ids
            keys = scores.astype(np.int64) * n + np.arange(n - 1, -1, -1)
            take = min(k + 1, n)
            top = np.argpartition(keys, n - take, axis=1)[:, n - take:]
            score, at = np.take_along_axis(scores, top, axis=1), np.broadcast_to(np.arange(first, first + len(scores))[:, None], top.shape)
            other = c_row[top] != q_row[at]
            asked, found = at[other], top[other]
            out.append(pa.table([q_row[asked], q_id.take(pa.array(asked)), c_id.take(pa.array(found)), score[other].astype(np.int64)], schema=schema))
        return pa.concat_tables(out)

    return best


def exact_topk(
    vectors: DataFrame, is_query: Column, k: int = 20, *, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: int = 64, block_rows: int = 4096, least_blocks: int = 16, query_rows: int = 8192,
) -> DataFrame:
    """The k rows with the highest integer inner product, for each query row.

    vectors: rows with an id and an array of numbers; is_query marks the queries, an
    expression on the id. Returns query_id, rank from 1, vec_id, score; ties go to
    the smaller id. A row isn't a candidate of its own query.

    Null vectors and vectors with a null or non-finite component take no part. Rows
    that repeat an id stay apart: each is a candidate of the others, and if it's a
    query each has its own ranks. A null id is a candidate, after the others among
    ties. A shorter vector lacks the last dimensions, an empty one scores 0. An empty
    table gives an empty result; further columns are ignored.
    Scores are 64-bit: |component| * scale stays under 2**31 or so.
    """
    ids = vectors.filter(usable(vector_col)).select(F.col(id_col).cast("long").alias("vec_id"), quantised(vector_col, scale).alias("weights"))
    rows = materialised(ids.withColumn("q", F.coalesce(is_query, F.lit(False))).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, queries = rows.agg(F.count("*"), F.count_if("q")).first()
    n_c, n_q = max(least_blocks, -(-n // block_rows)), max(1, -(-queries // query_rows))
    block = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.filter("q").select(block(n_q, 1).alias("qb"), every(n_c).alias("cb"), "row", "vec_id", "weights")
    right = rows.select(every(n_q).alias("qb"), block(n_c, 2).alias("cb"), "row", "vec_id", "weights")
    best = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(_select(k), "query_row long, query_id long, vec_id long, score long")
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark, sf_dir: str) -> DataFrame:
    from quarry.llm.common import table

    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP10_SQL = """
WITH v AS (SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 64)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON q.n <> c.n WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

"""Exact top-k search by inner product with sorted lists and score bounds.

Vectors become whole numbers and are stored in blocks; a block keeps, for each
dimension, its rows in ascending order: the sorted list of that dimension.  For
a query a list is read from its high end where the query's component is
positive, from its low end where it is negative, the same number of entries
from every list.  What has been read of a vector is its partial score; the last
values read bound what is missing from above, the far ends of the lists from
below.  No vector is looked up by its identifier before the end: reading stops
for a block once the vectors whose upper bound reaches the k-th best lower
bound are few, and only those get their final scores.  The k-th best score is
carried from block to block, so a block whose lists already begin below it is
left without reading.

A task takes one block of queries and a share of the vector blocks; each pair
of blocks meets once and yields at most k rows for a query.

Defined cases
    null vector, null or non-finite component   takes no part, as query or candidate
    a squared length of 2^53 or more, scaled   an error, as bounds would not be exact
    null identifier      a candidate, after all others in a tie; never a query
    vectors of unequal length   missing components count as 0
    ties                 go to the smaller identifier
    repeated rows        candidates each; a repeated query row has its own result
    fewer than k others  all of them
    empty table          empty result
    clashing columns     only identifier and vector are read
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lurelog.staging import staged

SCALE = 256
TOP = 5
EVERY = 50
#: Rows of a vector block and of a query block.
BLOCK = 1024
QUERIES = 1024
#: Shares of a list that are read before the bounds are looked at.
DEPTHS = (0.02, 0.1, 0.3, 0.6, 1.0)
#: Reading stops when the open candidates are at most this share of all pairs of a block.
FEW = 0.02
#: No score of vectors whose squared lengths stay below this can pass it, nor any part of one.
LARGEST = float(1 << 53)
_NO_ID = np.iinfo(np.int64).max
BLOCKS = "ids binary, cells binary, lists binary, width int, block long"


def _blocks(rows: int, lists: bool):
    """A function over batches of ``id, cells``: blocks of at most ``rows`` vectors."""

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, np.ndarray]] = []
        names = count(TaskContext.get().partitionId() << 32)

        def close() -> pd.DataFrame:
            width = max(len(v) for _, v in held)
            cells = np.zeros((len(held), width), np.int64)
            for k, (_, v) in enumerate(held):
                cells[k, : len(v)] = v
            ids = np.array([i for i, _ in held], np.int64)
            order = np.argsort(cells, axis=0, kind="stable").astype(np.int32) if lists else np.empty(0, np.int32)
            return pd.DataFrame([(ids.tobytes(), cells.tobytes(), order.tobytes(), width, next(names))], columns=["ids", "cells", "lists", "width", "block"])

        for batch in batches:
            for ident, cells in zip(batch["id"].tolist(), batch["cells"], strict=True):
                held.append((ident, np.asarray(cells, np.int64)))
                if len(held) == rows:
                    yield close()
                    held = []
        if held:
            yield close()

    return blocks


class Lists:
    """A block of vectors with its sorted lists."""

    def __init__(self, ids: bytes, cells: bytes, lists: bytes, width: int):
        self.ids = np.frombuffer(ids, np.int64)
        self.cells = np.frombuffer(cells, np.int64).reshape(len(self.ids), width)
        self.order = np.frombuffer(lists, np.int32).reshape(len(self.ids), width)

    def read(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What ``depth`` entries show from the low and from the high end: partial vectors,
        with each entry not read replaced by the last value read, so that products bound the score above."""
        rows, width = self.cells.shape
        low, high = np.empty((rows, width)), np.empty((rows, width))
        columns = np.arange(width)
        low[:] = self.cells[self.order[depth - 1], columns]
        high[:] = self.cells[self.order[rows - depth], columns]
        seen_low, seen_high = self.order[:depth], self.order[rows - depth :]
        low[seen_low, columns] = self.cells[seen_low, columns]
        high[seen_high, columns] = self.cells[seen_high, columns]
        # From below, an entry not read counts as the far end of its list.
        far_low, far_high = np.empty((rows, width)), np.empty((rows, width))
        far_low[:] = self.cells[self.order[-1], columns]
        far_high[:] = self.cells[self.order[0], columns]
        far_low[seen_low, columns] = low[seen_low, columns]
        far_high[seen_high, columns] = high[seen_high, columns]
        return low, high, far_low, far_high


def _kth(scores: np.ndarray, top: int) -> np.ndarray:
    """The ``top``-th largest of each row, minus infinity where there are fewer."""
    if scores.shape[1] < top:
        return np.full(len(scores), -np.inf)
    return np.partition(scores, scores.shape[1] - top, axis=1)[:, scores.shape[1] - top]


def search(queries: np.ndarray, query_ids: np.ndarray, block: Lists, floor: np.ndarray, top: int = TOP) -> tuple[np.ndarray, ...]:
    """Rows (query position, vector identifier, score) that can be among the ``top`` of a query.

    ``floor`` has for each query a score that ``top`` others are known to reach.
    """
    width = max(queries.shape[1], block.cells.shape[1])
    if block.cells.shape[1] < width or queries.shape[1] < width:
        queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
        if block.cells.shape[1] < width:
            cells = np.pad(block.cells, ((0, 0), (0, width - block.cells.shape[1])))
            block = Lists(block.ids.tobytes(), cells.tobytes(), np.argsort(cells, axis=0, kind="stable").astype(np.int32).tobytes(), width)
    rows = len(block.ids)
    exact = queries.astype(np.float64)
    up, down = np.maximum(exact, 0), np.minimum(exact, 0)
    slack = 1e-9 * (np.abs(exact) @ np.abs(block.cells).max(0).astype(np.float64)) if rows else np.zeros(len(queries))
    # Before any reading: the heads of the lists bound every vector of the block.
    head = up @ block.cells.max(0) + down @ block.cells.min(0)
    active = np.flatnonzero(head + slack >= floor)
    found_q, found_c = np.empty(0, np.int64), np.empty(0, np.int64)
    for share in DEPTHS:
        if not len(active):
            break
        low, high, far_low, far_high = block.read(max(1, int(rows * share)))
        upper = up[active] @ high.T + down[active] @ low.T
        lower = up[active] @ far_high.T + down[active] @ far_low.T
        lower[query_ids[active][:, None] == block.ids[None, :]] = -np.inf
        level = np.maximum(floor[active], _kth(lower, top) - slack[active])
        possible = upper + slack[active][:, None] >= level[:, None]
        few = possible.sum(1) <= max(4 * top, FEW * rows)
        done = few | (share == DEPTHS[-1])
        q, c = np.nonzero(possible & done[:, None])
        found_q, found_c = np.r_[found_q, active[q]], np.r_[found_c, c]
        active = active[~done]
    # Final scores, in whole numbers, of what the bounds left open.
    score = np.empty(len(found_q), np.int64)
    for at in range(0, len(found_q), 1 << 16):
        cut = slice(at, at + (1 << 16))
        score[cut] = np.einsum("ij,ij->i", queries[found_q[cut]], block.cells[found_c[cut]])
    other = query_ids[found_q] != block.ids[found_c]
    return found_q[other], block.ids[found_c[other]], score[other]


def _best(query: np.ndarray, ident: np.ndarray, score: np.ndarray, top: int) -> np.ndarray:
    """Positions of the ``top`` rows of each query by score, then by smaller identifier."""
    order = np.lexsort((ident, -score, query))
    begins = np.searchsorted(query[order], query[order], "left")
    return order[np.arange(len(order)) - begins < top]


def _search_blocks(top: int):
    """A function over pairs of blocks sorted by query block: at most ``top`` rows for each query."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None

        def result() -> pd.DataFrame:
            ids, q, v, s = state[1], state[3], state[4], state[5]
            return pd.DataFrame({"query_block": current, "place": q, "query_id": ids[q], "vec_id": v, "score": s})

        for batch in batches:
            for row in batch.itertuples():
                if row.query_block != current:
                    if state is not None:
                        yield result()
                    ids = np.frombuffer(row.q_ids, np.int64)
                    none = np.empty(0, np.int64)
                    cells = np.frombuffer(row.q_cells, np.int64).reshape(len(ids), row.q_width)
                    current, state = row.query_block, [cells, ids, np.full(len(ids), -np.inf), none, none, none]
                queries, ids, floor, q, v, s = state
                more = search(queries, ids, Lists(row.ids, row.cells, row.lists, row.width), floor, top)
                q, v, s = np.r_[q, more[0]], np.r_[v, more[1]], np.r_[s, more[2]]
                keep = _best(q, v, s, top)
                q, v, s = q[keep], v[keep], s[keep]
                full = np.bincount(q, minlength=len(ids)) >= top
                least = np.full(len(ids), np.inf)
                np.minimum.at(least, q, s.astype(np.float64))
                state = [queries, ids, np.where(full, least, -np.inf), q, v, s]
        if state is not None:
            yield result()

    return run


def top_k(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, top: int = TOP) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``top`` best rows for each row whose identifier ``every`` divides."""
    spark = df.sparkSession
    usable = F.col(vector_col).isNotNull() & F.forall(
        vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    )
    square = F.aggregate(vector_col, F.lit(0.0), lambda total, x: total + F.pow(F.floor(x.cast("double") * SCALE).cast("double"), F.lit(2.0)))
    scaled = F.when(square < LARGEST, F.transform(vector_col, lambda x: F.floor(x.cast("double") * SCALE))).otherwise(
        F.raise_error(F.lit("a vector is too long for exact scores"))
    )
    vectors = df.where(usable).select(F.col(id_col).alias("id"), scaled.alias("cells"))
    queries = vectors.where(F.col("id") % every == 0)
    named = vectors.withColumn("id", F.coalesce("id", F.lit(_NO_ID)))
    blocks = staged(named.mapInPandas(_blocks(BLOCK, lists=True), BLOCKS), "topk-lists")
    asked = staged(queries.repartition(F.xxhash64("id")).mapInPandas(_blocks(QUERIES, lists=False), BLOCKS), "topk-queries")
    # Only the names of the query blocks are numbered in one task; there is one for each QUERIES queries and task.
    numbers = asked.select("block", F.row_number().over(Window.orderBy("block")).alias("query_block"))
    numbered = asked.join(numbers, "block").select(
        "query_block", F.col("ids").alias("q_ids"), F.col("cells").alias("q_cells"), F.col("width").alias("q_width")
    )
    numbered = staged(numbered, "topk-numbered")
    n_blocks = numbered.count()
    if n_blocks == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shares = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // n_blocks)
    # Each pair of blocks meets in the task of its query block and share.
    pairs = blocks.withColumn("query_block", F.explode(F.sequence(F.lit(1), F.lit(n_blocks)))).withColumn(
        "share", F.pmod(F.xxhash64("block"), F.lit(shares))
    )
    spread = numbered.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    found = pairs.join(spread, ["query_block", "share"]).sortWithinPartitions("query_block").mapInPandas(
        _search_blocks(top), "query_block int, place long, query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("query_block", "place").orderBy(F.col("score").desc(), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.select("query_id", "rank", F.nullif("vec_id", F.lit(_NO_ID)).alias("vec_id"), "score")


def op7_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP7_SQL = """
WITH vectors AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS cells FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum([a[1] * a[2] FOR a IN list_zip(q.cells, c.cells)])::BIGINT AS score
  FROM vectors q, vectors c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 5
"""

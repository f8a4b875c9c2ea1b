"""Hard negatives for anchors, mined with score bounds along spanning trees of the anchors.

Anchors come in blocks; each block carries a minimum spanning tree of its
vectors.  For a block of candidates only the root's scores are computed at once.
Along an edge a score moves by at most the edge's length times the candidate's
norm, so a parent's score, or the range known of it, bounds the child's.  Only
candidates whose range meets what the child looks for are scored; their range
becomes a point, which tightens the bounds further down.

The first pass looks for the positives: ranges that reach the score of the
last positive so far.  The second looks for the negatives: ranges that meet a
positive's window, above the last negative so far.  Each pass lets every block
of anchors, a stated share of the rows, meet every block of candidates once and
returns a bounded number of rows for each anchor from each task.

Defined cases
    null label, null vector, null or non-finite component   takes no part
    null identifier      a candidate, after all others in a tie; never an anchor
    vectors of unequal length   missing components count as 0; an empty vector scores 0
    ties                 go to the smaller identifier
    repeated rows        candidates each; a repeated anchor row has its own results; rows that
                         share the anchor's identifier are not its candidates
    fewer than wanted    all of them; an anchor without positives gives no row
    scores beyond 2^62   an error, as are components of that size; nothing is dropped
    empty table          empty result
    clashing columns     only identifier, vector and label are read
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lurelog.staging import staged

SCALE = 256
EVERY = 100
POSITIVES = 5
NEGATIVES = 5
#: A negative scores from this share of the positive's score up to it.
WINDOW = (80, 100)
#: Rows of a block of candidates and of a block of anchors.
BLOCK = 2048
ANCHORS = 512
LARGEST = 1 << 62
#: Whole numbers up to here are exact in a double.
EXACT = float(1 << 53)
_NO_ID = np.iinfo(np.int64).max
BLOCKS = pa.schema([
    ("block", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("cells", pa.binary()), ("width", pa.int32()),
    ("order", pa.binary()), ("parents", pa.binary()), ("edges", pa.binary()),
])
BLOCKS_DDL = "block long, ids binary, labels binary, cells binary, width int, order binary, parents binary, edges binary"


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A minimum spanning tree: the points from the root on, parents first; each point's parent; its edge's length.

    The root is the point nearest to the mean.
    """
    n = len(points)
    root = int(np.argmin(((points - points.mean(0)) ** 2).sum(1)))
    order, parents, edges = [root], np.full(n, -1), np.zeros(n)
    away = ((points - points[root]) ** 2).sum(1)
    nearest = np.full(n, root)
    away[root] = np.inf
    for _ in range(n - 1):
        at = int(np.argmin(away))
        order.append(at)
        parents[at], edges[at] = nearest[at], np.sqrt(away[at])
        away[at] = np.inf
        closer = ((points - points[at]) ** 2).sum(1)
        better = (closer < away) & np.isfinite(away)
        away[better], nearest[better] = closer[better], at
    return np.array(order), parents, edges


class Block:
    """Identifiers, labels and vectors of a block, and the tree where it holds anchors."""

    def __init__(self, row: dict, prefix: str = ""):
        self.ids = np.frombuffer(row[f"{prefix}ids"], np.int64)
        self.labels = np.frombuffer(row[f"{prefix}labels"], np.int64)
        self.cells = np.frombuffer(row[f"{prefix}cells"], np.int64).reshape(len(self.ids), row[f"{prefix}width"])
        self.order = np.frombuffer(row[f"{prefix}order"], np.int64)
        self.parents = np.frombuffer(row[f"{prefix}parents"], np.int64)
        self.edges = np.frombuffer(row[f"{prefix}edges"], np.float64)
        self.norms = np.sqrt((self.cells.astype(np.float64) ** 2).sum(1))


def _blocks(rows: int, trees: bool):
    """A function over batches of ``id, label, cells``: blocks of at most ``rows`` vectors, numbered for each task."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[tuple[int, int, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            width = max(len(v) for _, _, v in held)
            cells = np.zeros((len(held), width), np.int64)
            for k, (_, _, v) in enumerate(held):
                cells[k, : len(v)] = v
            tree = spanning_tree(cells.astype(np.float64)) if trees else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
            row = {
                "block": number, "ids": np.array([i for i, _, _ in held], np.int64).tobytes(),
                "labels": np.array([x for _, x, _ in held], np.int64).tobytes(), "cells": cells.tobytes(), "width": width,
                "order": tree[0].astype(np.int64).tobytes(), "parents": tree[1].astype(np.int64).tobytes(), "edges": tree[2].tobytes(),
            }
            return pa.RecordBatch.from_pylist([row], BLOCKS)

        for batch in batches:
            ends = batch.column("cells").offsets.to_numpy()
            flat = batch.column("cells").values.to_numpy()
            for k, (ident, label) in enumerate(zip(batch.column("id").to_pylist(), batch.column("label").to_pylist(), strict=True)):
                held.append((ident, label, flat[ends[k] : ends[k + 1]]))
                if len(held) == rows:
                    yield close()
                    number, held = number + 1, []
        if held:
            yield close()

    return blocks


def _aligned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x for x in (a, b))


def bounded_scores(anchors: Block, others: Block, wanted) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, positions of candidates, their scores) for what the bounds leave open.

    ``wanted(anchor, low, high)`` marks the candidates that are worth a score,
    given ranges that surely hold each candidate's.
    """
    mine, theirs = _aligned(anchors.cells, others.cells)
    most = (anchors.norms.max() * others.norms.max()) * (1 + 1e-9)
    if most >= LARGEST:
        raise ArithmeticError("scores beyond 2^62")
    kind = np.float64 if most < EXACT else np.int64
    mine, theirs = mine.astype(kind), theirs.astype(kind)
    low, high = {}, {}
    children = np.bincount(anchors.parents[anchors.parents >= 0], minlength=len(anchors.ids))
    for at in anchors.order.tolist():
        parent = int(anchors.parents[at])
        if parent < 0:
            exact = theirs @ mine[at]
            bottom, top = exact.astype(np.float64), exact.astype(np.float64)
            slack = np.abs(bottom) * 1e-12
            chosen = np.flatnonzero(wanted(at, bottom - slack, top + slack))
            scores = exact[chosen].astype(np.int64)
        else:
            # Rounding of lengths and norms is far below this allowance.
            move = anchors.edges[at] * others.norms * (1 + 1e-9) + 1e-6
            bottom, top = low[parent] - move, high[parent] + move
            chosen = np.flatnonzero(wanted(at, bottom, top))
            scores = (theirs[chosen] @ mine[at]).astype(np.int64)
            bottom[chosen] = top[chosen] = scores
            children[parent] -= 1
            if children[parent] == 0:
                del low[parent], high[parent]
        if children[at]:
            low[at], high[at] = bottom, top
        if len(chosen):
            yield at, chosen, scores


def _first(ids: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    """Positions of the ``n`` first by score, then by smaller identifier."""
    if len(scores) > 4 * n:
        least = np.partition(scores, len(scores) - n)[len(scores) - n]
        near = np.flatnonzero(scores >= least)
        return near[np.lexsort((ids[near], -scores[near]))[:n]]
    return np.lexsort((ids, -scores))[:n]


def _merged(held: tuple, ids: np.ndarray, scores: np.ndarray, n: int) -> tuple:
    ids, scores = np.r_[held[0], ids], np.r_[held[1], scores]
    keep = _first(ids, scores, n)
    return ids[keep], scores[keep]


_NONE = (np.empty(0, np.int64), np.empty(0, np.int64))


def _floor(held: tuple, n: int) -> float:
    return float(held[1][-1]) if len(held[1]) == n else -np.inf


def find_positives(anchors: Block, others: Block, best: dict, n: int) -> None:
    """Bring ``best`` (anchor: identifiers, scores) up to date with another block."""

    def wanted(at, low, high):
        fit = (others.labels == anchors.labels[at]) & (others.ids != anchors.ids[at])
        return fit & (high >= _floor(best.get(at, _NONE), n))

    for at, chosen, scores in bounded_scores(anchors, others, wanted):
        best[at] = _merged(best.get(at, _NONE), others.ids[chosen], scores, n)


def find_negatives(anchors: Block, others: Block, windows: dict, best: dict, n: int, share: tuple[int, int]) -> None:
    """Bring ``best`` ((anchor, positive's place): identifiers, scores) up to date; ``windows`` has an anchor's positive scores."""
    least, whole = share

    def begins(at: int, place: int, score: int) -> float:
        # The smallest whole number in the window, or the last negative so far where that is higher.
        return max(-(-least * score // whole), _floor(best.get((at, place), _NONE), n))

    def wanted(at, low, high):
        fit = np.zeros(len(others.ids), bool)
        for place, score in windows.get(at, ()):
            fit |= (high >= begins(at, place, score)) & (low <= score)
        return fit & (others.labels != anchors.labels[at]) & (others.ids != anchors.ids[at])

    for at, chosen, scores in bounded_scores(anchors, others, wanted):
        ids = others.ids[chosen]
        for place, score in windows[at]:
            inside = (scores >= -(-least * score // whole)) & (scores <= score)
            if inside.any():
                best[at, place] = _merged(best.get((at, place), _NONE), ids[inside], scores[inside], n)


def _over_pairs(visit, rows, schema: pa.Schema):
    """A function over pairs of blocks sorted by anchor block: ``visit`` each pair, then give the ``rows`` of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, anchors, windows, best = None, None, None, {}
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names if not name.startswith("a_")}
                if row["number"] != current:
                    if current is not None:
                        yield pa.RecordBatch.from_pylist(rows(current, anchors, best), schema)
                    current, best = row["number"], {}
                    anchors = Block({name: batch.column(name)[k].as_py() for name in batch.schema.names if name.startswith("a_")}, "a_")
                    windows = {}
                    for found in row.get("windows") or ():
                        windows.setdefault(found["place"], []).append((found["nth"], found["positive_score"]))
                visit(anchors, Block(row), windows, best)
        if current is not None:
            yield pa.RecordBatch.from_pylist(rows(current, anchors, best), schema)

    return run


def _numbered(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``number`` from 0; only the block names, one a block, are ordered in one task."""
    names = blocks.select("block", (F.row_number().over(Window.orderBy("block")) - 1).alias("number"))
    return blocks.join(staged(names, "negatives-numbers"), "block")


def _pairs(anchors: DataFrame, candidates: DataFrame, count: int) -> DataFrame:
    """Every block of anchors beside every block of candidates; a task has one anchor block and a share of the others."""
    parts = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = max(1, -(-2 * parts // count))
    number = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    asked = candidates.withColumn("share", F.pmod(F.xxhash64("block"), F.lit(shares))).withColumn("number", number)
    named = [F.col(c).alias(f"a_{c}") for c in BLOCKS.names if c != "block"]
    extra = [c for c in anchors.columns if c not in BLOCKS.names]
    spread = anchors.select(*extra, *named).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    return asked.join(spread, ["number", "share"]).sortWithinPartitions("number")


def mine(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | Column = "label",
    every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW,
    block: int = BLOCK, anchor_block: int = ANCHORS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose identifier ``every`` divides.
    """
    spark = df.sparkSession
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    scaled = F.transform(vector_col, lambda x: F.floor(x.cast("double") * SCALE))
    large = F.exists(vector_col, lambda x: F.abs(x.cast("double")) * SCALE >= float(LARGEST))
    cells = F.when(large, F.raise_error(F.lit("a component beyond 2^62")).cast("array<bigint>")).otherwise(scaled)
    vectors = df.where(F.col(vector_col).isNotNull() & finite & label.isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), cells.alias("cells")
    )
    # Anchors of one label lie together, so edges are short; a hot label spreads over ranges.
    asked = vectors.where(F.col("id") % every == 0).repartitionByRange("label", F.xxhash64("id", "cells")).sortWithinPartitions("label")
    anchors = staged(_numbered(staged(asked.mapInArrow(_blocks(anchor_block, True), BLOCKS_DDL), "negatives-anchors")), "negatives-numbered")
    count = anchors.count()
    if count == 0:
        return spark.createDataFrame([], result)
    named = vectors.withColumn("id", F.coalesce("id", F.lit(_NO_ID)))
    candidates = staged(named.mapInArrow(_blocks(block, False), BLOCKS_DDL), "negatives-candidates")

    def positive_rows(number, here, best):
        return [
            {"number": number, "place": at, "anchor_id": int(here.ids[at]), "positive_id": i, "positive_score": s}
            for at, (ids, scores) in best.items() for i, s in zip(ids.tolist(), scores.tolist(), strict=True)
        ]

    found = _pairs(anchors, candidates, count).mapInArrow(
        _over_pairs(lambda a, b, _, best: find_positives(a, b, best, positives), positive_rows, pa.schema([
            ("number", pa.int32()), *[(c, pa.int64()) for c in ("place", "anchor_id", "positive_id", "positive_score")]])),
        "number int, place long, anchor_id long, positive_id long, positive_score long",
    )
    order = Window.partitionBy("number", "place").orderBy(F.desc("positive_score"), "positive_id")
    chosen = staged(found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= positives), "negatives-positives")
    # At most ``positives`` rows for each anchor of a block.
    windows = chosen.groupBy("number").agg(F.collect_list(F.struct("place", "nth", "positive_score")).alias("windows"))

    def negative_rows(number, here, best):
        return [
            {"number": number, "place": at, "nth": nth, "negative_id": i, "negative_score": s}
            for (at, nth), (ids, scores) in best.items() for i, s in zip(ids.tolist(), scores.tolist(), strict=True)
        ]

    mined = _pairs(anchors.join(windows, "number"), candidates, count).mapInArrow(
        _over_pairs(lambda a, b, w, best: find_negatives(a, b, w, best, negatives, window), negative_rows, pa.schema([
            ("number", pa.int32()), ("place", pa.int64()), ("nth", pa.int32()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])),
        "number int, place long, nth int, negative_id long, negative_score long",
    )
    order = Window.partitionBy("number", "place", "nth").orderBy(F.desc("negative_score"), "negative_id")
    best = mined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    unnamed = [F.nullif(c, F.lit(_NO_ID)).alias(c) for c in ("positive_id", "negative_id")]
    return best.join(chosen, ["number", "place", "nth"]).select("anchor_id", unnamed[0], "rank", unnamed[1], "positive_score", "negative_score")


def shifted_label(id_col: str = "vec_id", label_col: str = "label") -> Column:
    """The label, one further of ten where 7 divides the identifier."""
    label = F.col(label_col)
    return F.when(F.col(id_col) % 7 == 0, (label + 1) % 10).otherwise(label)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label_col=shifted_label())


OP13_SQL = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS cells FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    list_sum([p[1] * p[2] FOR p IN list_zip(a.cells, c.cells)])::BIGINT AS score
  FROM vectors a, vectors c WHERE a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth FROM scored WHERE same
), ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id,
    (row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id))::INTEGER AS rank,
    n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM placed p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
  WHERE p.nth <= 5
)
SELECT * FROM ranked WHERE rank <= 5
"""

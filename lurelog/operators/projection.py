"""Two principal components of a long weight table, without dense rows.

Randomized block Krylov range finder (Musco & Musco, NIPS 2015): a block of
random axes is multiplied with the covariance a few times; every product, made
orthonormal to those before, joins the basis, and the best two axes inside the
basis come from its small projected matrix.  The part of the last product that
leaves the basis tells how far these are from eigenvectors.

A product is two joins and sums.  Centring is algebra on the means, so no row
loses its sparseness; the basis is one row a term, and only matrices of its
width reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurelog.staging import staged

BLOCK = 32
#: Products at most; the basis has this many blocks.
ROUNDS = 12
#: Part of the first variance that may leave the basis when it is accepted.
SETTLED = 1e-6


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _products(table: DataFrame, left: str, right: str) -> np.ndarray:
    """Sums over the rows of all products of entries of two array columns."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = _matrix(batch, left).T @ _matrix(batch, right)
                total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    cells = table.select(*{left, right}).mapInArrow(sums, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    if not cells:
        return np.zeros((0, 0))
    found = np.zeros((1 + max(c.i for c in cells), 1 + max(c.j for c in cells)))
    for c in cells:
        found[c.i, c.j] = c.v
    return found


def _turned(table: DataFrame, kept: list[str], made: dict[str, list[tuple[str, np.ndarray]]]) -> DataFrame:
    """``kept`` columns beside array columns, each the sum of array columns times matrices."""
    schema = ", ".join([*(f"{c} {table.schema[c].dataType.simpleString()}" for c in kept), *(f"{c} array<double>" for c in made)])

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in kept]
            for parts in made.values():
                rows = sum(_matrix(batch, c) @ m for c, m in parts)
                ends = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32) if rows.shape[1] else np.zeros(batch.num_rows + 1, np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(rows).ravel())))
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *made])

    used = dict.fromkeys([*kept, *(c for parts in made.values() for c, _ in parts)])
    return table.select(*used).mapInArrow(turn, schema)


def _orthonormal(gram: np.ndarray, floor: float) -> np.ndarray:
    """A matrix that makes columns with this Gram matrix orthonormal; those shorter than ``floor`` squared are left out."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    good = values > max(floor, (values.max() if len(values) else 0.0) * 1e-13)
    return vectors[:, good] / np.sqrt(values[good])


def _scores(weights: DataFrame, axes: DataFrame, n: int) -> tuple[DataFrame, np.ndarray]:
    """``doc_id, s0…`` on the axes ``idx, mean, v``, and the scores of the mean."""
    means = axes.agg(*[F.sum(F.col("mean") * F.col("v")[j]) for j in range(n)]).first()
    sums = [F.sum(F.col("weight") * F.col("v")[j]).alias(f"s{j}") for j in range(n)]
    scores = weights.join(axes.select("idx", "v"), "idx").groupBy("doc_id").agg(*sums)
    return scores, np.array([x or 0.0 for x in means], float)


def _covariance_times(weights: DataFrame, axes: DataFrame, n_docs: int, n: int) -> DataFrame:
    """``idx, mean, q, w``: the covariance times the axes ``v``, beside the basis ``q``."""
    scores, shift = _scores(weights, axes, n)
    sums = weights.join(staged(scores, "pca-scores"), "doc_id").groupBy("idx").agg(
        *[F.sum(F.col("weight") * F.col(f"s{j}")).alias(f"t{j}") for j in range(n)]
    )
    moved = [(F.col(f"t{j}") - F.lit(n_docs * float(shift[j])) * F.col("mean")) / max(n_docs - 1, 1) for j in range(n)]
    return staged(axes.join(sums, "idx").select("idx", "mean", "q", F.array(*moved).alias("w")), "pca-products")


def principal_axes(weights: DataFrame, n_docs: int, wanted: int = 2, seed: int = 7) -> tuple[DataFrame | None, np.ndarray]:
    """``idx, mean, v`` with up to ``wanted`` axes, heaviest first, and their variances; None without any variance.

    ``weights(doc_id, idx, weight)`` is a written table.
    """
    terms = weights.groupBy("idx").agg((F.sum("weight") / n_docs).alias("mean"))
    start = F.array(*[F.xxhash64("idx", F.lit(seed), F.lit(j)) / float(1 << 63) for j in range(BLOCK)])
    raw = staged(terms.withColumn("w", start), "pca-start")
    if raw.isEmpty():
        return None, np.zeros(0)
    turn = _orthonormal(_products(raw, "w", "w"), 0.0)
    axes = staged(_turned(raw, ["idx", "mean"], {"v": [("w", turn)], "q": [("w", turn)]}), "pca-axes")
    n = width = turn.shape[1]
    projected = np.zeros((0, 0))
    for number in range(ROUNDS):
        product = _covariance_times(weights, axes, n_docs, n)
        inside = _products(product, "q", "w")
        grown = np.zeros((width, width))
        grown[: width - n, : width - n] = projected
        grown[:, width - n :], grown[width - n :, :] = inside, inside.T
        projected = (grown + grown.T) / 2
        # What leaves the basis, twice over for rounding.
        left = staged(_turned(product, ["idx", "mean", "q"], {"w": [("w", np.eye(n)), ("q", -inside)]}), "pca-outside")
        again, gram = _products(left, "q", "w"), _products(left, "w", "w")
        gram = gram - again.T @ again
        values, vectors = np.linalg.eigh(projected)
        best = np.argsort(-values)[:wanted]
        last = vectors[width - n :, best]
        leaving = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", last, gram, last), 0))
        first = max(values.max(), 0.0)
        turn = _orthonormal(gram, (first * 1e-12) ** 2)
        if not first or leaving.max() <= SETTLED * first or turn.shape[1] == 0 or number == ROUNDS - 1:
            break
        grown_basis = np.c_[np.eye(width), -again @ turn]
        axes = staged(_turned(left, ["idx", "mean"], {
            "v": [("w", turn), ("q", -again @ turn)],
            "q": [("q", grown_basis), ("w", np.c_[np.zeros((n, width)), turn])],
        }), "pca-axes")
        n, width = turn.shape[1], width + turn.shape[1]
    kept = best[values[best] > first * 1e-12] if first else best[:0]
    if not len(kept):
        return None, np.zeros(0)
    found = staged(_turned(product, ["idx", "mean"], {"v": [("q", vectors[:, kept])]}), "pca-found")
    # An axis may point either way; its largest loading is made positive.
    heaviest = found.agg(*[F.max_by(F.col("v")[j], F.struct(F.round(F.abs(F.col("v")[j]), 9), F.col("idx"))) for j in range(len(kept))]).first()
    signs = np.diag([1.0 if (h or 0) >= 0 else -1.0 for h in heaviest])
    return staged(_turned(found, ["idx", "mean"], {"v": [("v", signs)]}), "pca-found"), values[kept]


def pca_2d(weights: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc_id, x, y`` for every row of ``docs``: centred two-component projection.

    ``weights(doc_id, idx, weight)`` is a written table.  An axis that does not
    exist, as there are too few documents or they do not vary, gives 0.
    """
    axes, variances = principal_axes(weights, docs.count())
    n = len(variances)
    if n == 0:
        return docs.select("doc_id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    scores, shift = _scores(weights, axes, n)
    placed = docs.select("doc_id").join(staged(scores, "pca-scores"), "doc_id", "left")
    xy = [F.coalesce(f"s{j}", F.lit(0.0)) - float(shift[j]) for j in range(n)]
    return placed.select("doc_id", xy[0].alias("x"), (xy[1] if n > 1 else F.lit(0.0)).alias("y"))

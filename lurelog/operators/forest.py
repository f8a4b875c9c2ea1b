"""Isolation Forest (Liu, Ting, Zhou, ICDM 2008) as Spark jobs.

Fit: every row draws, by keyed hashes, the trees it may serve, skipping from one
to the next by geometric steps; each tree keeps its 256 smallest draws, and the
trees grow in parallel from those rows.  Score: the forest (trees x at most 511
nodes, whatever the data size) goes to the tasks as a broadcast and rows are
scored in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lurelog import schema
from lurelog.operators.features import FOREST_FEATURES
from lurelog.operators.quantiles import exact_quantiles
from lurelog.staging import staged

TREES = 200
SAMPLE = 256
EULER = 0.5772156649015329
#: Rows that go through a tree at a time; their values stay in a core's cache.
PART = 4096
_NODE = "tree int, node int, feature int, threshold double, depth double"
_HASH_SPAN = float(2**63)


def fit_forest(
    df: DataFrame, features: list[str] = FOREST_FEATURES, key: list[str] = schema.WINDOW_KEY,
    trees: int = TREES, sample: int = SAMPLE, seed: int = 42, rows: int | None = None,
) -> DataFrame:
    """Node table ``tree, node, feature, threshold, depth`` (children of i: 2i+1, 2i+2)."""
    rows = df.count() if rows is None else rows
    drawn = _tree_samples(df, features, key, trees, min(sample, rows), seed, rows)
    limit = ceil(log2(max(min(sample, rows), 2)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        ordered = pdf.sort_values("draw")
        values = ordered[features].to_numpy(dtype=float)
        return _grow(tree, values, limit, np.random.default_rng([seed, tree]))

    return drawn.groupBy("tree").applyInPandas(grow, _NODE)


def _tree_samples(df, features, key, trees, sample, seed, rows) -> DataFrame:
    """Exactly ``sample`` rows per tree, of all rows: the smallest keyed hashes of each tree.

    A row costs one hash and one more for every tree it is drawn for: the number
    of trees to the next one is geometric.  Most rows of a large table skip all
    trees at once and end there, in generated code.  About ``trees * sample``
    draws remain at any table size.
    """
    named = df.select(F.xxhash64(*key, F.lit(seed)).alias("row_id"), *features)
    # Six deviations above the mean leave no tree short of rows in practice; a
    # short tree would only use the fewer rows it has.
    share = min(1.0, (sample + 6 * sample**0.5 + 6) / max(rows, 1))

    def next_tree(after):
        """The first tree drawn from ``after`` on; at or beyond ``trees`` there is none."""
        if share >= 1.0:
            return after
        skip = F.floor(F.log(_unit(F.xxhash64("row_id", after, F.lit(seed + 1)))) / math.log1p(-share))
        return (after + F.least(skip, F.lit(trees))).cast("int")

    drawn = named.withColumn("first", next_tree(F.lit(0))).where(F.col("first") < trees)
    # The draws of one row, from its first; a row that is drawn at all rarely has many.
    steps = F.sequence(F.lit(1), F.lit(trees))
    start = F.struct(F.col("first").alias("at"), F.array("first").alias("all"))

    def step(found, _):
        at = next_tree(found["at"] + 1)
        more = F.struct(at.alias("at"), F.concat(found["all"], F.array(at)).alias("all"))
        return F.when(found["at"] + 1 >= trees, found).when(at >= trees, F.struct(F.lit(trees).alias("at"), found["all"].alias("all"))).otherwise(more)

    candidates = drawn.withColumn("tree", F.explode(F.aggregate(steps, start, step, lambda found: found["all"]))).withColumn(
        "draw", _unit(F.xxhash64("row_id", "tree"))
    )
    smallest = Window.partitionBy("tree").orderBy("draw", *features)
    return (
        candidates.withColumn("rn", F.row_number().over(smallest))
        .filter(F.col("rn") <= sample)
        .select("tree", "draw", *features)
    )


def _unit(hashed):
    """A 64-bit hash as a number in (0, 1]."""
    return (hashed.bitwiseAND(F.lit(2**63 - 1)) + 1.0) / F.lit(_HASH_SPAN)


def _grow(tree: int, values: np.ndarray, limit: int, rng: np.random.Generator) -> pd.DataFrame:
    nodes = []
    waiting = [(0, 0, np.arange(len(values)))]
    while waiting:
        node, depth, members = waiting.pop()
        part = values[members]
        low, high = part.min(axis=0), part.max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth >= limit or len(members) <= 1 or not len(varying):
            nodes.append((tree, node, -1, 0.0, depth + average_path(len(members))))
            continue
        feature = int(rng.choice(varying))
        cut = float(rng.uniform(low[feature], high[feature]))
        goes_left = part[:, feature] <= cut
        if goes_left.all():  # the draw rounded up to the maximum
            cut = float(low[feature])
            goes_left = part[:, feature] <= cut
        nodes.append((tree, node, feature, cut, float(depth)))
        waiting.append((2 * node + 1, depth + 1, members[goes_left]))
        waiting.append((2 * node + 2, depth + 1, members[~goes_left]))
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "depth"])


def average_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def score_rows(
    df: DataFrame, nodes: DataFrame, features: list[str] = FOREST_FEATURES,
    trees: int = TREES, sample: int = SAMPLE, rows: int | None = None, column: str = "raw_score",
) -> DataFrame:
    """Add ``-2^(-mean path / c)``: near -1 for outliers, higher for ordinary rows."""
    rows = df.count() if rows is None else rows
    psi = min(sample, rows)
    table = nodes.toPandas()  # at most trees x (2 * sample - 1) nodes
    width = int(table["node"].max()) + 1
    feature = np.full((trees, width), -1, dtype=np.int32)
    threshold = np.zeros((trees, width))
    depth = np.zeros((trees, width))
    at = (table["tree"].to_numpy(), table["node"].to_numpy())
    feature[at], threshold[at], depth[at] = table["feature"], table["threshold"], table["depth"]
    # A leaf leads to itself: nothing is above its threshold, and it is its own left child.
    leaf = feature < 0
    left = np.where(leaf, np.arange(width), 2 * np.arange(width) + 1).astype(np.int32)
    forest = df.sparkSession.sparkContext.broadcast((np.maximum(feature, 0), np.where(leaf, np.inf, threshold), left, depth))
    levels = ceil(log2(max(psi, 2)))
    scale = average_path(psi) or 1.0

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        feature, threshold, left, depth = forest.value
        for batch in batches:
            values = np.column_stack([s.to_numpy(dtype=float) for s in batch])
            total = np.zeros(len(values))
            for begin in range(0, len(values), PART):
                flat = np.ascontiguousarray(values[begin : begin + PART]).ravel()
                lines = np.arange(0, len(flat), values.shape[1])
                for tree in range(len(feature)):
                    splits, cuts, lefts = feature[tree], threshold[tree], left[tree]
                    node = np.zeros(len(lines), dtype=np.int32)
                    for _ in range(levels):
                        node = lefts[node] + (flat[lines + splits[node]] > cuts[node])
                    total[begin : begin + PART] += depth[tree, node]
            yield pd.Series(-np.exp2(-total / (len(feature) * scale)))

    return df.withColumn(column, score(*[F.col(f) for f in features]))


def isolation_forest(
    df: DataFrame, contamination: float = 0.01, seed: int = 42, *,
    features: list[str] = FOREST_FEATURES, key: list[str] = schema.WINDOW_KEY,
    trees: int = TREES,
) -> DataFrame:
    """Add ``if_score`` (score minus the contamination quantile) and ``if_pred`` (score < 0).

    Give it a written table.  The raw scores are staged once, so that the
    quantile and the result do not score every row twice.
    """
    rows = df.count()
    nodes = fit_forest(df, features, key, trees, SAMPLE, seed, rows)
    raw = staged(score_rows(df, nodes, features, trees, SAMPLE, rows), "forest-scores")
    offset = exact_quantiles(raw, ["raw_score"], [contamination]).first()["value"]
    score = F.col("raw_score") - F.lit(offset)
    return raw.withColumn("if_score", score).withColumn(
        "if_pred", (F.col("if_score") < 0).cast("int")
    ).drop("raw_score")


def without_forest(df: DataFrame) -> DataFrame:
    """The columns of an unscored run: no anomaly, no score."""
    return df.withColumns({"if_pred": F.lit(0), "if_score": F.lit(float("nan"))})

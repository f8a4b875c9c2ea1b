"""K-means on a long weight table: centres are rows, and rows that cannot change are skipped.

Points are ``weights(doc_id, idx, weight)`` with weights of zero or more; a
document without weights is the origin.  Centres are rows ``(cluster, idx,
total, n)``: sums over the members and how many of them have the term.  No
document and no centre is ever one cell or one array.

Seeding (Bahmani et al., "Scalable k-means++", VLDB 2012): in a few rounds every
document is drawn with a chance in proportion to its squared distance from the
candidates so far; of the candidates, each weighing the documents nearest to it,
k are picked by k-means++.

Iteration (Hamerly, "Making k-means even faster", SDM 2010): a document keeps an
upper bound of the distance to its centre and a lower bound of that to any
other.  Centres move, bounds give way by as much, and only documents whose
bounds cross are compared again; only documents that change their cluster change
the sums.  The driver sees a few numbers for each cluster.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurelog.staging import staged

SEED_ROUNDS = 3
#: Candidates drawn in a round, for each cluster.
OVERSAMPLED = 2
#: Lloyd's iteration ends by itself; this many rounds are an error.
ROUNDS = 1000
#: A document only leaves its cluster for one that is nearer by more than this.
TIE = 1e-12
#: Allowance of the bounds for rounding.
SLACK = 1e-7
_HASH_SPAN = float(2**63)


def _number_map(values: dict[int, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _ranked(points: DataFrame, weights: DataFrame, centres: DataFrame, squares: dict[int, float]) -> DataFrame:
    """``points`` with ``values``: for each centre its squared distance, less the point's own square.

    ``centres`` are rows ``cluster, idx, c``.  A centre that shares no term with a
    point stands at its own square, so only shared terms are joined; the array
    has one entry a centre.
    """
    products = weights.join(centres, "idx").groupBy("doc_id", "cluster").agg(F.sum(F.col("weight") * F.col("c")).alias("product"))
    shared = products.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("cluster", "product"))).alias("products"))
    every = F.array(*[F.struct(F.lit(s).alias("square"), F.lit(c).alias("cluster")) for c, s in sorted(squares.items())])

    def value(centre: Column) -> Column:
        product = F.coalesce(F.try_element_at("products", centre["cluster"]), F.lit(0.0))
        return F.struct((centre["square"] - 2 * product).alias("v"), centre["cluster"].alias("cluster"))

    return points.join(shared, "doc_id", "left").withColumn("values", F.transform(every, value)).drop("products")


def _distance(square: str | Column, v: Column) -> Column:
    return F.sqrt(F.greatest(F.col("square") + v, F.lit(0.0)))


def _nearest(ranked: DataFrame, own: Column | None = None) -> DataFrame:
    """``doc_id, cluster, upper, lower`` of points with ``values``; a tie stays with ``own``."""
    best = F.array_min("values")
    if own is not None:
        mine = F.element_at(F.filter("values", lambda x: x["cluster"] == own), 1)
        best = F.when(mine["v"] <= best["v"] + TIE, mine).otherwise(best)
    ranked = ranked.withColumn("best", best)
    other = F.array_min(F.filter("values", lambda x: x["cluster"] != F.col("best.cluster")))
    return ranked.withColumns({
        "cluster": F.col("best.cluster"), "upper": _distance("square", F.col("best.v")),
        "lower": F.coalesce(_distance("square", other["v"]), F.lit(float("inf"))),
    }).drop("best", "values")


def _chance(seed: int, number: int) -> Column:
    hashed = F.xxhash64("doc_id", F.lit(seed), F.lit(number))
    return (hashed.bitwiseAND(F.lit(2**63 - 1)) + 1.0) / F.lit(_HASH_SPAN)


def _closer(near: DataFrame, weights: DataFrame, fresh: DataFrame) -> DataFrame:
    """``near`` with what the ``fresh`` candidates change: squared distance and number of the nearest."""
    squares = {r.cluster: r.square for r in fresh.select("cluster", "square").collect()}  # a few candidates a cluster
    if not squares:
        return near
    centres = weights.join(fresh.select("doc_id", "cluster"), "doc_id").select("cluster", "idx", F.col("weight").alias("c"))
    seen = near.select("doc_id", "square", F.col("d2").alias("was"), F.col("cluster").alias("before"))
    found = _nearest(_ranked(seen, weights, centres, squares))
    d2 = F.col("upper") * F.col("upper")
    number = F.when(d2 < F.col("was"), F.col("cluster")).otherwise(F.col("before"))
    return staged(found.select("doc_id", "square", F.least("was", d2).alias("d2"), number.alias("cluster")), "kmeans-near")


def _numbered(docs: DataFrame, first: int) -> DataFrame:
    """A few ``docs`` with ``cluster``, a number from ``first`` on."""
    return docs.withColumn("cluster", (F.row_number().over(Window.orderBy("doc_id")) + first - 1).cast("int"))


def seeds(points: DataFrame, weights: DataFrame, k: int, seed: int) -> DataFrame:
    """``doc_id, square, cluster``: the documents that begin the clusters, one each."""
    by_chance = [F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id")]
    fresh = candidates = staged(_numbered(points.orderBy(*by_chance).limit(1), 0), "kmeans-candidates")
    near = _closer(points.withColumns({"d2": F.lit(float("inf")), "cluster": F.lit(0)}), weights, fresh)
    for number in range(SEED_ROUNDS):
        total = near.agg(F.sum("d2")).first()[0]
        if not total:
            break
        drawn = near.where(_chance(seed, number) * total < OVERSAMPLED * k * F.col("d2")).select("doc_id", "square")
        new = drawn.join(candidates.select("doc_id"), "doc_id", "left_anti")
        fresh = staged(_numbered(new, candidates.count()), "kmeans-drawn")
        candidates = candidates.unionByName(fresh)
        near = _closer(near, weights, fresh)
    n = candidates.count()
    if n < k:
        # Fewer distinct points than clusters were drawn: any others begin the rest.
        rest = points.join(candidates.select("doc_id"), "doc_id", "left_anti").orderBy(*by_chance).limit(k - n)
        return staged(candidates.unionByName(_numbered(rest, n)), "kmeans-seeds")
    numbers = {c: i for i, c in enumerate(_plus_plus(candidates, near, weights, n, k, seed))}
    picked = candidates.where(F.col("cluster").isin(*numbers)).withColumn("cluster", _number_map(numbers)[F.col("cluster")])
    return staged(picked, "kmeans-seeds")


def _plus_plus(candidates: DataFrame, near: DataFrame, weights: DataFrame, n: int, k: int, seed: int) -> list[int]:
    """k of ``n`` candidates by weighted k-means++; the driver sees their mutual distances."""
    mass = np.zeros(n)
    for row in near.groupBy("cluster").count().collect():
        mass[row["cluster"]] = row["count"]
    sparse = weights.join(candidates.select("doc_id", "cluster"), "doc_id").select("idx", "cluster", "weight")
    other = sparse.select("idx", F.col("cluster").alias("o"), F.col("weight").alias("w"))
    products = np.zeros((n, n))
    for row in sparse.join(other, "idx").groupBy("cluster", "o").agg(F.sum(F.col("weight") * F.col("w")).alias("p")).collect():
        products[row.cluster, row.o] = row.p
    squares = np.diag(products)
    apart = np.maximum(squares[:, None] + squares[None, :] - 2 * products, 0)
    rng = np.random.default_rng(seed)
    picked = [int(rng.choice(n, p=mass / mass.sum()))]
    while len(picked) < k:
        pull = mass * apart[picked].min(0)
        pull[picked] = 0
        if not pull.sum():
            pull = np.ones(n)
            pull[picked] = 0
        picked.append(int(rng.choice(n, p=pull / pull.sum())))
    return picked


def _means(sums: DataFrame, sizes: dict[int, int]) -> DataFrame:
    kept = sums.where("n > 0")
    return kept.select("cluster", "idx", (F.col("total") / _number_map(sizes)[F.col("cluster")]).alias("c"))


def kmeans(weights: DataFrame, docs: DataFrame, k: int = 8, seed: int = 42) -> DataFrame:
    """``doc_id, cluster``; fewer rows than clusters, or than two, are an error.

    ``weights`` is a written table.  A cluster that loses all its members is left
    out, so equal documents can make fewer than k.
    """
    n = docs.count()
    if n < max(2, k):
        raise ValueError(f"{k} clusters need at least {max(2, k)} sessions, got {n}")
    own = weights.groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("square"))
    points = staged(docs.select("doc_id").join(own, "doc_id", "left").fillna(0.0, ["square"]), "kmeans-points")
    begin = seeds(points, weights, k, seed)
    centres = staged(weights.join(begin, "doc_id").select("cluster", "idx", F.col("weight").alias("c")), "kmeans-centres")
    squares = {r.cluster: r.square for r in begin.collect()}
    state = staged(_nearest(_ranked(points, weights, centres, squares)), "kmeans-state")
    members = weights.join(state.select("doc_id", "cluster"), "doc_id")
    sums = members.groupBy("cluster", "idx").agg(F.sum("weight").alias("total"), F.count("*").alias("n"))
    sums = staged(sums.withColumn("old", F.lit(0.0)), "kmeans-sums")
    sizes = {r.cluster: r["count"] for r in state.groupBy("cluster").count().collect()}
    squares, _ = _squares_and_moves(sums, sizes, sizes)
    # The first means may lie anywhere: everything is compared again.
    moves = dict.fromkeys(sizes, float("inf"))
    for _ in range(ROUNDS):
        most = sorted(moves.values(), reverse=True)
        others = {c: (most[1] if len(most) > 1 else 0.0) if m == most[0] else most[0] for c, m in moves.items()}
        here = F.col("cluster")
        upper, lower = F.col("upper") + _number_map(moves)[here], F.col("lower") - _number_map(others)[here]
        kept = state.select("doc_id", "square", "cluster", upper.alias("upper"), lower.alias("lower"))
        crossed = F.col("upper") + SLACK >= F.col("lower")
        stale = kept.where(crossed).select("doc_id", "square", F.col("cluster").alias("was"))
        parts = weights.join(stale.select("doc_id"), "doc_id", "left_semi")
        again = _nearest(_ranked(stale, parts, _means(sums, sizes), squares), F.col("was"))
        same = kept.where(~crossed).withColumn("was", here)
        state = staged(again.select("doc_id", "square", "cluster", "upper", "lower", "was").unionByName(same.select("doc_id", "square", "cluster", "upper", "lower", "was")), "kmeans-state")
        counted = state.groupBy("cluster").agg(F.count("*").alias("n"), F.count_if(F.col("was") != here).alias("moved")).collect()
        if not sum(r.moved for r in counted):
            return state.select("doc_id", here.cast("int").alias("cluster"))
        before, sizes = sizes, {r.cluster: r.n for r in counted}
        moved = state.where(F.col("was") != here).select("doc_id", "cluster", "was")
        both = F.explode(F.array(F.struct(here.alias("cluster"), F.lit(1).alias("sign")), F.struct(F.col("was").alias("cluster"), F.lit(-1).alias("sign"))))
        change = weights.join(moved, "doc_id").select("idx", "weight", both.alias("to")).select(
            "to.cluster", "idx", (F.col("weight") * F.col("to.sign")).alias("total"), F.col("to.sign").cast("long").alias("n"), F.lit(0.0).alias("old")
        )
        known = sums.where("n > 0").select("cluster", "idx", "total", "n", F.col("total").alias("old"))
        summed = known.unionByName(change).groupBy("cluster", "idx").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.sum("old").alias("old"))
        # A term that no member has any more stays a round, so that the centre's move counts it.
        sums = staged(summed.withColumn("total", F.when(F.col("n") > 0, F.col("total")).otherwise(0.0)), "kmeans-sums")
        squares, moves = _squares_and_moves(sums, before, sizes)
    raise RuntimeError(f"clusters still change after {ROUNDS} rounds")


def _squares_and_moves(sums: DataFrame, before: dict[int, int], now: dict[int, int]) -> tuple[dict[int, float], dict[int, float]]:
    """Of each centre its square and how far it went since ``before``."""
    here = F.col("cluster")
    at = F.coalesce(F.col("total") / _number_map(now)[here], F.lit(0.0))
    was = F.coalesce(F.col("old") / _number_map(before)[here], F.lit(0.0))
    found = sums.groupBy("cluster").agg(F.sum(at * at).alias("square"), F.sqrt(F.sum((at - was) * (at - was))).alias("move")).collect()
    squares, moves = {r.cluster: r.square for r in found}, {r.cluster: r.move for r in found}
    return {c: squares.get(c, 0.0) for c in now}, {c: moves.get(c, 0.0) for c in now}

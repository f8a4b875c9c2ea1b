"""Order along a key, and look-ups, whatever share of the rows one key holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurelog.staging import staged

# Ranges for each shuffle partition, and sampled rows for each range.
RANGES_PER_PARTITION = 4
SAMPLED_PER_RANGE = 24
# Bytes of text in a part whose terms one task counts; a term takes some 100 bytes of its hash tables.
COUNTED_BYTES = 1 << 22
# The same where a part's terms are sorted, not kept in tables; larger parts name fewer terms in all.
DEALT_BYTES = 1 << 23
# A key with more than this part of all rows is served by broadcast; there can
# be no more such keys than its inverse.
HEAVY_PART = 1 / 1000


def by_size(df: DataFrame, key: str, text: str, piece: int = COUNTED_BYTES) -> DataFrame:
    """``df`` partitioned by ``key`` in parts of about ``piece`` bytes of ``text``.

    So what one task holds does not grow with the table.
    """
    return df.repartition(_parts(df, text, piece), key)


def dealt(df: DataFrame, key: str, text: str, piece: int = DEALT_BYTES) -> DataFrame:
    """``df`` with ``part``, which ``key`` alone decides, and partitioned by it; see ``by_size``.

    The column's metadata hold the ``labels`` of the parts.
    """
    parts = _parts(df, text, piece)
    # One label for each partition, as labels that share one would make it larger than others.
    label = F.col("id").cast("int")
    drawn = df.sparkSession.range(32 * parts).groupBy(F.pmod(F.hash(label), F.lit(parts))).agg(F.min(label).alias("label"))
    labels = sorted(r["label"] for r in drawn.collect())
    return df.select("*", part_of(key, labels)).repartition(parts, "part")


def part_of(key: str, labels: list[int]) -> Column:
    place = F.pmod(F.xxhash64(key), F.lit(len(labels))).cast("int")
    return F.get(F.lit(labels), place).alias("part", metadata={"labels": labels})


def _parts(df: DataFrame, text: str, piece: int) -> int:
    size = df.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-size // piece))


def sort_key(df: DataFrame, keys: list[str], order: list[str]) -> Column:
    """A total order of the rows: by key, then ``order``, then the whole row's hash.

    Times become microseconds, so that the cut points are plain numbers and texts.
    """

    def plain(name: str) -> Column:
        if isinstance(df.schema[name].dataType, T.TimestampType):
            return F.unix_micros(name)
        return F.col(name)

    parts = [F.xxhash64(*keys).alias("k"), *[F.col(c).alias(f"k_{c}") for c in keys]]
    parts += [plain(c).alias(f"o_{c}") for c in order]
    return F.struct(*parts, F.xxhash64(*df.columns).alias("tie"))


def cut_points(keyed: DataFrame, column: str) -> DataFrame | None:
    """One row ``cuts``: an ascending array of sampled keys; None for an empty table.

    The sample is bounded by the number of ranges, not by the data.
    """
    spark = keyed.sparkSession
    ranges = cut_ranges(spark)
    rows = keyed.count()
    if rows == 0:
        return None
    share = min(1.0, SAMPLED_PER_RANGE * ranges / rows)
    span = 1 << 30
    drawn = keyed.where(F.pmod(F.xxhash64(column), F.lit(span)) <= int(share * span)).select(column)
    place = F.row_number().over(Window.orderBy(column)) - 1
    total = F.count("*").over(Window.partitionBy())
    numbered = drawn.distinct().select(column, place.alias("place"), F.floor(place * ranges / total).alias("range"))
    first = numbered.groupBy("range").agg(F.min(column).alias("cut")).where("range > 0")
    return staged(first.agg(F.array_sort(F.collect_list("cut")).alias("cuts")), "cut-points")


def cut_ranges(spark: SparkSession) -> int:
    """Ranges that a table is cut into, of which a small one leaves some empty."""
    return RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_range(df: DataFrame, key: str, cuts: str, alias: str) -> DataFrame:
    """Add ``alias``: how many cut points are not above the key, by bisection.

    Every halving is a column of its own, which Spark compiles; a loop in one
    expression would be interpreted for every row.
    """
    found = df.withColumn(alias, F.lit(0))
    for power in reversed(range(cut_ranges(df.sparkSession).bit_length())):
        step = 1 << power
        reached = f"{key} >= get({cuts}, {alias} + {step - 1})"
        found = found.withColumn(alias, F.expr(f"CASE WHEN {reached} THEN {alias} + {step} ELSE {alias} END"))
    return found


def _ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame | None:
    """``df`` with ``_at``, its place in the total order, and ``_range``; None for an empty table.

    Cut points fall inside a key that holds many rows, inside one microsecond too.
    """
    keyed = df.withColumn("_at", sort_key(df, keys, order))
    cuts = cut_points(keyed, "_at")
    if cuts is None:
        return None
    # One row with an array of bounded length joins every row.
    placed = keyed.withColumn("_one", F.lit(1)).join(F.broadcast(cuts.withColumn("_one", F.lit(1))), "_one")
    return with_range(placed, "_at", "cuts", "_range").drop("cuts", "_one")


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], value: str, alias: str
) -> DataFrame:
    """Add ``alias``: ``value`` of the row before, per key and in ``order``.

    Rows are dealt by ranges of the total order, so no key needs a task of its
    own; the last row of each range, one a range, is what the next begins with.
    """
    placed = _ranged(df, keys, order)
    if placed is None:
        return df.withColumn(alias, F.lit(None).cast(df.schema[value].dataType))
    row = F.struct(*keys, value)
    ends = placed.groupBy("_range").agg(F.max_by(row, "_at").alias("_last"))
    earlier = Window.orderBy("_range")
    before = staged(ends.select("_range", F.lag("_last").over(earlier).alias("_carried")), "range-ends")
    inside = Window.partitionBy("_range").orderBy("_at")
    linked = placed.withColumn("_inside", F.lag(row).over(inside)).join(F.broadcast(before), "_range", "left")
    linked = linked.withColumn("_before", F.coalesce("_inside", "_carried"))
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_before.{key}"))
    return linked.withColumn(alias, F.when(same, F.col(f"_before.{value}"))).select(*df.columns, alias)


def with_position(df: DataFrame, keys: list[str], order: list[str], alias: str) -> DataFrame:
    """Add ``alias``: the row's number per key from 0, in ``order``."""
    placed = _ranged(df, keys, order)
    if placed is None:
        return df.withColumn(alias, F.lit(None).cast("long"))
    sizes = placed.groupBy(*keys, "_range").agg(F.count("*").alias("n"))
    along = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # Only a key that goes on from an earlier range needs an offset: one key a range.
    begins = sizes.withColumn("_begin", F.sum("n").over(along)).where("_begin IS NOT NULL").drop("n")
    begins = staged(begins, "range-begins")
    inside = Window.partitionBy(*keys, "_range").orderBy("_at")
    numbered = placed.withColumn("_inside", F.row_number().over(inside) - 1)
    joined = numbered.join(F.broadcast(begins), [*keys, "_range"], "left")
    place = F.coalesce("_begin", F.lit(0)) + F.col("_inside")
    return joined.withColumn(alias, place.cast("long")).select(*df.columns, alias)


def lookup_join(rows: DataFrame, lookup: DataFrame, key: str, weight: str, part: float = HEAVY_PART) -> DataFrame:
    """``rows`` inner-joined with ``lookup`` on ``key`` although a few keys are very frequent.

    ``weight`` is the number of rows of each key, so at most ``1 / part`` keys
    are heavy: these are broadcast to their rows, which do not move.  Only the
    rest is shuffled.  Give written tables; ``rows`` is read twice.
    """
    heavy_from = rows.count() * part
    heavy = lookup.where(F.col(weight) > heavy_from)
    values = [c for c in lookup.columns if c != key]
    hot = rows.join(F.broadcast(heavy), key)
    cold = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(
        lookup.where(F.col(weight) <= heavy_from), key
    )
    return hot.unionByName(cold).select(*rows.columns, *values)

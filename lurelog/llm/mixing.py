"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a share of the mix by weight, at most twice its own size;
what a full source cannot take is shared again among the rest.  A document's
expected number of copies is its source's target over the source's size.  The
whole part is taken as it is.  The fractional parts are rounded in pairs: mass
(probability times words) moves at random from one document to the other until
one of them is in or out for certain, so that expectations hold and the words
of the pair do not change.

The pairing is a reduction tree: buckets of about ``FAN`` documents fold in
parallel, each leaves one open document, and the open documents of ``FAN``
buckets fold on the next level, up to one for each source.  A hot source just
has more buckets.  Each level is written, so only open documents move on, and
what remains random for a source is less than one document.

All draws are hashes of the documents' identifiers: reruns agree.  Documents
without one are told apart by a written row number, so that they spread over
buckets like others.  Only DataFrame functions run here.

Defined cases
    null or blank text   size 0, takes nothing
    null source          a source of its own, last in order
    null identifier      a document like any other
    repeated rows        each row is a document of its own
    empty table          empty result; so are targets where all sizes are 0
    very long texts      counted whole; a document is in or out as a whole
    clashing columns     only identifier, text and source are read
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurelog.staging import staged

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
FAN = 32
SEED = 11


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank`` from 0 by code point, null last, without gathering them in one task."""
    spread = staged(
        sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-ranges"
    )
    sizes = spread.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return spread.join(begins, "part").withColumn("rank", F.col("begin") + F.row_number().over(inside) - 1).drop("part", "begin")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row for each source: ``source``, ``docs``, ``source_size``, ``target``."""
    sources = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = ranked(sources).withColumn("weight", F.get(cycle, (F.col("rank") % len(weights)).cast("int")))
    weighed = staged(weighed.withColumn("cap", F.col("source_size") * float(most)), "mix-sources")
    whole = weighed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    wanted = share * (whole["size"] or 0)
    level, full = (wanted / whole["weight"] if whole["weight"] else 0.0), None
    while True:
        # Words for each unit of weight, once the full sources are set aside.
        at_cap = F.col("cap") <= F.col("weight") * level
        held = weighed.agg(
            F.sum(F.when(at_cap, F.col("cap"))).alias("cap"), F.sum(F.when(~at_cap, F.col("weight"))).alias("weight"),
            F.count(F.when(at_cap, 1)).alias("n"),
        ).first()
        if held["n"] == full or not held["weight"]:
            break
        full, level = held["n"], (wanted - (held["cap"] or 0.0)) / held["weight"]
    return weighed.select("source", "docs", "source_size", F.least("cap", F.col("weight") * level).alias("target"))


def _fold(item: str) -> Column:
    """Fold ``items`` pairwise into settled documents and one that stays open."""
    return F.expr(f"""
    aggregate(
      items,
      named_struct('open', cast(null as {item}), 'done', cast(array() as array<struct<doc:{item},up:boolean>>)),
      (s, x) -> if(s.open is null, named_struct('open', x, 'done', s.done),
        transform(
          transform(
            array(named_struct(
              'up', least(s.open.size - s.open.mass, x.mass),
              'down', least(s.open.mass, x.size - x.mass),
              'draw', pmod(xxhash64(s.open.draw, x.draw, {SEED}), {1 << 52}) / {float(1 << 52)}D)),
            p -> named_struct('up', p.up, 'down', p.down, 'rise', p.draw * (p.up + p.down) < p.down)),
          q -> if(q.rise,
            if(s.open.size - s.open.mass <= x.mass,
              named_struct('open', named_struct('draw', x.draw, 'id', x.id, 'size', x.size, 'base', x.base, 'mass', x.mass - q.up),
                           'done', concat(s.done, array(named_struct('doc', s.open, 'up', true)))),
              named_struct('open', named_struct('draw', s.open.draw, 'id', s.open.id, 'size', s.open.size, 'base', s.open.base, 'mass', s.open.mass + q.up),
                           'done', concat(s.done, array(named_struct('doc', x, 'up', false))))),
            if(s.open.mass <= x.size - x.mass,
              named_struct('open', named_struct('draw', x.draw, 'id', x.id, 'size', x.size, 'base', x.base, 'mass', x.mass + q.down),
                           'done', concat(s.done, array(named_struct('doc', s.open, 'up', false)))),
              named_struct('open', named_struct('draw', s.open.draw, 'id', s.open.id, 'size', s.open.size, 'base', s.open.base, 'mass', s.open.mass - q.down),
                           'done', concat(s.done, array(named_struct('doc', x, 'up', true)))))))[0]))
    """)


def _level(items: DataFrame) -> DataFrame:
    """``items(source, bucket, item)`` folded by bucket: ``source``, ``bucket``, ``done``, ``open``."""
    kind = items.schema["item"].dataType.simpleString()
    grouped = items.groupBy("source", "bucket").agg(F.sort_array(F.collect_list("item")).alias("items"))
    folded = grouped.select("source", "bucket", _fold(kind).alias("s"))
    return staged(folded.select("source", "bucket", F.col("s.done").alias("done"), F.col("s.open").alias("open")), "mix-level")


def pivotal(docs: DataFrame, most_docs: int) -> DataFrame:
    """Round every fractional document in or out: ``source``, ``id``, ``size``, ``base``, ``up``.

    ``docs`` has ``source, docs, id, size, base, mass, draw``; ``most_docs`` is the largest ``docs``.
    """
    buckets = F.ceil(F.col("docs") / FAN).cast("long")
    items = docs.select(
        "source",
        F.pmod(F.xxhash64("draw", F.lit(SEED)), buckets).alias("bucket"),
        F.struct("draw", "id", "size", "base", "mass").alias("item"),
    )
    # Buckets exist only where they have documents; a level that finds one for each source is the last.
    left, settled = -(-most_docs // FAN), []
    while True:
        level = _level(items)
        settled.append(level.select("source", F.explode("done").alias("d")).select("source", "d.doc.id", "d.doc.size", "d.doc.base", "d.up"))
        items = level.select("source", F.floor(F.col("bucket") / FAN).alias("bucket"), F.col("open").alias("item"))
        if left <= 1:
            break
        left = -(-left // FAN)
    chance = F.pmod(F.xxhash64("item.draw", F.lit(SEED + 1)), F.lit(1 << 52)) / float(1 << 52)
    settled.append(items.select("source", "item.id", "item.size", "item.base", (chance < F.col("item.mass") / F.col("item.size")).alias("up")))
    found = settled[0]
    for more in settled[1:]:
        found = found.union(more)
    return found


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **shares) -> DataFrame:
    """One row for each document: identifier, ``size``, ``source_size``, ``target`` and ``taken``."""
    nth = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
    sizes = staged(
        df.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), nth.alias("nth")
        ),
        "mix-sizes",
    )
    targets = staged(source_targets(sizes, **shares), "mix-targets")
    most_docs = targets.agg(F.max("docs")).first()[0] or 0
    named = targets.withColumnRenamed("source", "named")
    docs = sizes.join(named, F.col("source").eqNullSafe(F.col("named"))).drop("named")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    docs = docs.withColumn("ratio", ratio).withColumn("base", F.floor("ratio").cast("long"))
    docs = docs.withColumn("mass", (F.col("ratio") - F.col("base")) * F.col("size")).withColumn("draw", F.xxhash64("id", "size", "nth", F.lit(SEED)))
    docs = staged(docs.drop("ratio", "nth"), "mix-docs")
    open_docs = docs.where("mass > 0")
    rounded = pivotal(open_docs, most_docs).select("source", "id", "size", "base", F.col("up").cast("long").alias("up"))
    plain = docs.where("mass <= 0").select("source", "id", "size", "base", F.lit(0).cast("long").alias("up"))
    found = rounded.union(plain).join(named, F.col("source").eqNullSafe(F.col("named")))
    return found.select(
        F.col("id").alias(id_col), "size", "source_size", "target", ((F.col("base") + F.col("up")) * F.col("size")).alias("taken")
    )


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))

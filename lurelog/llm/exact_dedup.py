"""Exact deduplication by content sort.

Sampled splitters cut the space of normalised contents into ranges, every row
goes to its range, each range is sorted externally by its whole text, and
neighbours are compared in full.  Ranges and the rows in them follow one order:
head of the text, SHA-256, whole text, identifier, number of the row.  As it
ends with that number, which no two rows share, a group of copies of any size
spreads over as many ranges as it has splitters, also where its rows have one
identifier or none; as equal texts are neighbours in it, only the runs that touch the
ends of a range are joined afterwards, comparing their whole texts again.

Rows are numbered as they are read, so give a written table: a task that runs
again then numbers its rows as before.  Only DataFrame functions run here.

Defined cases
    null text         counts as the empty text
    null identifier   sorts after all others; it stays only where its whole group has none
    repeated rows     rows of one identifier and text are members like any other; exactly one
                      row of a group has ``kept`` true
    empty table       empty result
    clashing columns  columns of the input named like an output column are replaced
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurelog.staging import staged

#: A splitter is drawn from about this many sampled rows.
SAMPLED_PER_RANGE = 24
#: Ranges for each shuffle partition; several small ranges level the tasks.
RANGES_PER_PARTITION = 4
#: Characters of the text in a splitter, before the digest that tells texts of one head apart.
SPLITTER_HEAD = 64
#: The sample is drawn by hash in steps of this part of all rows.
SPAN = 1 << 40
OUTPUT = ["keep_id", "group_size", "kept", "text_sha256"]
KEY_TYPE = "struct<head: string, hash: string, nameless: boolean, id: bigint, nth: bigint>"


def normalised(text: Column) -> Column:
    """The compared content: every run of ASCII white space as one space, null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _digest(content: Column) -> Column:
    return F.sha2(F.encode(content, "utf-8"), 256)


def _sort_key(content: Column, ident: Column, nth: Column) -> Column:
    return F.struct(
        F.substring(content, 1, SPLITTER_HEAD).alias("head"),
        _digest(content).alias("hash"),
        ident.isNull().alias("nameless"),
        F.coalesce(ident.cast("long"), F.lit(0)).alias("id"),
        nth.alias("nth"),
    )


def _numbered(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """``_id``, ``_text`` and ``_nth``, a number that no two rows share."""
    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.monotonically_increasing_id().alias("_nth"), *more)


def splitters(df: DataFrame, text_col: str, id_col: str, ranges: int) -> list:
    """At most ``ranges - 1`` keys in ascending order, taken from a sample of bounded size.

    Rows are drawn by their number, so rows that share identifier and text are drawn apart.
    """
    rows = df.count()
    if rows == 0:
        return []
    share = min(1.0, SAMPLED_PER_RANGE * ranges / rows)
    drawn = F.pmod(F.xxhash64("_nth", F.lit(3)), F.lit(SPAN)) <= int(share * SPAN)
    key = _sort_key(normalised(F.col("_text")), F.col("_id"), F.col("_nth"))
    keys = _numbered(df, id_col, text_col).where(drawn).select(key.alias("k")).orderBy("k").collect()
    step = max(1, len(keys) // ranges)
    return [r.k for r in keys[step::step]][: ranges - 1]


def range_of(key: Column, cuts: list) -> Column:
    """The number of cuts that are not above the key, found by bisection."""
    if not cuts:
        return F.lit(0)
    # One constant, however many cuts there are: the optimizer reads the text once.
    table = F.from_json(F.lit(json.dumps([c.asDict() for c in cuts])), f"array<{KEY_TYPE}>")

    def halve(key: Column, span: Column) -> Column:
        middle = F.floor((span["lo"] + span["hi"]) / 2).cast("int")
        right = key >= F.get(table, middle)
        return (
            F.when(span["lo"] >= span["hi"], span)
            .when(right, F.struct((middle + 1).alias("lo"), span["hi"].alias("hi")))
            .otherwise(F.struct(span["lo"].alias("lo"), middle.alias("hi")))
        )

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length()))
    # As an array's element the key is computed once, not at every step.
    found = F.transform(F.array(key), lambda k: F.aggregate(steps, start, lambda span, _: halve(k, span), lambda span: span["lo"]))
    return F.get(found, F.lit(0))


def content_sort(df: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """Rows with ``_range`` and ``_run`` (equal neighbours share one), staged.

    The struct ``_row`` has the columns to carry, so that none clashes with a
    name used here.  ``_edge`` holds the content of the first and last row of
    each range.
    """
    spark = df.sparkSession
    ranges = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = splitters(df, text_col, id_col, ranges)
    rows = _numbered(df, id_col, text_col, F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row"))
    keyed = rows.withColumn("_key", _sort_key(normalised(F.col("_text")), F.col("_id"), F.col("_nth")))
    placed = keyed.withColumn("_range", range_of(F.col("_key"), cuts)).withColumn("_sha256", F.col("_key.hash")).drop("_key")
    content = placed.repartition("_range").withColumn("_content", normalised(F.col("_text")))
    content = content.withColumn("_head", F.substring("_content", 1, SPLITTER_HEAD))
    # The order of the ranges, so that equal texts are neighbours across their ends too.
    order = Window.partitionBy("_range").orderBy("_head", "_sha256", "_content", F.col("_id").asc_nulls_last(), "_nth")
    previous, following = F.lag("_content").over(order), F.lead("_content").over(order)
    marked = content.select(
        "*",
        F.when(previous.isNull() | (previous != F.col("_content")), 1).otherwise(0).alias("_new"),
        F.when(previous.isNull() | following.isNull(), F.col("_content")).alias("_edge"),
    )
    numbered = marked.select(
        "_id", "_row", "_range",
        F.sum("_new").over(order).alias("_run"),
        (F.col("_new") == 1).alias("_first"),
        "_edge",
        "_sha256",
    )
    return staged(numbered, "content-sort")


def _edge_runs(runs: DataFrame, edges: DataFrame) -> DataFrame:
    """For the first and last run of each range: identifier and size of the whole group.

    At most two rows a range, so the windows over all ranges stay small however
    large the table is.
    """
    ends = runs.groupBy("_range").agg(F.max("_run").alias("_last"))
    outer = runs.join(ends, "_range").where((F.col("_run") == 1) | (F.col("_run") == F.col("_last")))
    outer = outer.join(edges, ["_range", "_run"])
    along = Window.orderBy("_range", "_run")
    linked = F.coalesce((F.col("_run") == 1) & (F.lag("_content").over(along) == F.col("_content")), F.lit(False))
    chained = outer.withColumn("_linked", linked).withColumn("_chain", F.sum(F.when(F.col("_linked"), 0).otherwise(1)).over(along))
    whole = Window.partitionBy("_chain")
    return chained.select(
        "_range", "_run", "_linked",
        F.min("_min").over(whole).alias("_keep"),
        F.sum("_size").over(whole).alias("_total"),
    )


def _sorted_runs(df: DataFrame, id_col: str, text_col: str, carry: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sorted rows, their runs, and the runs at the ends of ranges with their whole groups."""
    rows = content_sort(df, id_col, text_col, carry)
    runs = rows.groupBy("_range", "_run").agg(F.min("_id").alias("_min"), F.count("*").alias("_size"))
    runs = staged(runs, "content-runs")
    edges = rows.where(F.col("_edge").isNotNull()).groupBy("_range", "_run").agg(F.max("_edge").alias("_content"))
    return rows, runs, staged(_edge_runs(runs, edges), "content-edges")


def first_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, all columns; whole rows move once, into their range."""
    rows, _, whole = _sorted_runs(df, id_col, text_col, df.columns)
    # Two rows a range at most.
    linked = F.broadcast(whole.where("_linked").select("_range", "_run"))
    return rows.where("_first").join(linked, ["_range", "_run"], "left_anti").select("_row.*")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Every row with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    ``carry`` names the columns to return beside these; all by default.
    """
    carry = [c for c in (df.columns if carry is None else carry) if c not in OUTPUT]
    rows, runs, whole = _sorted_runs(df, id_col, text_col, carry)
    # Both sides come from one range each; the second has two rows a range at most.
    found = rows.join(runs, ["_range", "_run"]).join(F.broadcast(whole), ["_range", "_run"], "left")
    return found.select(
        *[F.col(f"_row.`{c}`") for c in carry],
        F.coalesce("_keep", "_min").alias("keep_id"),
        F.coalesce("_total", "_size").cast("long").alias("group_size"),
        (F.col("_first") & ~F.coalesce("_linked", F.lit(False))).alias("kept"),
        F.col("_sha256").alias("text_sha256"),
    )


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs, carry=["doc_id"])


OP3_SQL = r"""
WITH content AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
), grouped AS (
  SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM content GROUP BY body
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
FROM content JOIN grouped USING (body)
"""

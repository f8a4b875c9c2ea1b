"""The corpus pipeline: stages over ``documents``, each written and read back for the next.

Every stage works on all that the one before kept, and its decisions take
effect: rows are dropped, repeated or placed.  All but the last return the
columns of ``documents``.

Defined cases
    null or empty text  has no language, so the first stage drops it
    very long texts     read whole by every stage
    null identifier     a document of its own; it stays in a group only where no other document has an identifier
    repeated rows       one stays after exact dedup; rows that share an identifier are told apart by their content
    ties                the smaller identifier stays, then the smaller hash of the row
    empty table         every stage gives an empty table
    clashing columns    columns of the input pass through all stages but the last unchanged
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lurelog.llm import exact_dedup, langid, mixing, packing, registry, simhash
from lurelog.staging import staged


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose best language is hardly likelier than an even guess, go."""
    registry.prepared(spark)
    network = langid.fit(docs)
    found = langid.identify(docs.select("doc_id", "text", "lang", F.struct("*").alias("_row")), network=network)
    least = langid.certain(len(network.labels) if network else 0)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= least)).select("_row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest identifier stays."""
    return exact_dedup.first_of_each(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints are linked the one with the smallest identifier stays.

    Shingles and distance are those of the operator's query.  A row is known by
    its identifier and a hash of all its columns; equal rows are one document.
    """
    registry.prepared(spark)
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))
    key = F.struct(F.col("doc_id").isNull().alias("nameless"), ident.alias("id"), F.xxhash64(*docs.columns).alias("content"))
    keyed = docs.select(key.alias("_key"), "text", F.struct("*").alias("_row"))
    found = simhash.near_components(keyed, id_col="_key", radius=simhash.RADIUS)
    stay = found.where("_key = component_id").select("_key").distinct()
    once = Window.partitionBy("_key").orderBy("_key")
    rows = keyed.join(stay, "_key", "left_semi").withColumn("_nth", F.row_number().over(once)).where("_nth = 1")
    return rows.select("_row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, which may be never, once or twice.

    Rows are told apart by all their columns, as several may share an identifier;
    equal rows are taken as often as all of them together.
    """
    content = [F.hex(F.xxhash64(F.lit(seed), *docs.columns)) for seed in (1, 2)]
    key = F.concat_ws(":", F.col("doc_id").cast("string"), *content)
    keyed = docs.select(key.alias("_key"), "text", "source", F.struct("*").alias("_row"))
    found = mixing.mix(keyed, id_col="_key").where("taken > 0")
    copies = found.groupBy("_key").agg(F.sum(F.expr("int(taken div size)")).alias("_copies"))
    first = keyed.withColumn("_nth", F.row_number().over(Window.partitionBy("_key").orderBy("_key"))).where("_nth = 1")
    repeated = first.join(copies, "_key").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")).alias("_copy"))
    return repeated.select("_row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    registry.prepared(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("exact_dedup", exact),
    ("simhash", near),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL cannot express a trained classifier, bit-sliced fingerprints and random rounding; tests compare with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

"""Token ids of a corpus in a compressed file that opens at any block.

The file is a directory of Parquet tables, so that Spark's readers and writers
reach it in any store and a lost task leaves nothing half written:

``codebook``   ``symbol, count, bits``: the code length of every id that occurs.  Codes are
               canonical: they ascend by length, then by id.
``parts``      ``part, begin``: ids before each part.
``blocks``     one directory a part, one row a block, in the order of ``part`` and ``block``:
               ``before`` (ids of the part before the block), ``docs`` and ``lengths`` (the
               documents in ascending order and their number of ids), ``payload`` (the bit
               stream), ``checkpoints`` (the bit offset of every ``STRIDE``-th id).

A block holds whole documents and decodes by itself; inside, all runs between
checkpoints decode at once by table look-up.  Code lengths come from the counts
over the whole corpus and have at most ``huffman.LIMIT`` bits.

Defined cases
    null text          the empty text: its end id alone
    very long texts    encoded whole, in a block of their own size
    repeated rows      each row is a document; equal identifiers stand side by side
    null identifier    after all others
    empty table        a file without blocks, which reads back as no rows
    clashing columns   only identifier and text are read
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lurelog.llm import huffman, tokens
from lurelog.staging import new_path, staged

#: Ids in a block, at least, unless its part ends.
BLOCK = 1 << 18


def _blocks(path: str, vocabulary: int, dtype: str):
    """A function over sorted batches of ``id, text``: blocks of raw ids, and last the task's counts."""

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        encoder = tokens.encoder(path, words_only=False)
        counts = np.zeros(vocabulary, np.int64)
        number, before, docs, held, size = 0, 0, [], [], 0

        def row(raw: bytes | None, tally: bytes | None = None) -> pd.DataFrame:
            lengths = [len(h) // 4 for h in held]
            cells = (part, number if tally is None else -1, before, docs, lengths, raw, tally)
            return pd.DataFrame([cells], columns=["part", "block", "before", "docs", "lengths", "raw", "tally"])

        def close() -> pd.DataFrame:
            ids = np.frombuffer(b"".join(held), "<u4")
            counts[:] += np.bincount(ids, minlength=vocabulary)
            return row(ids.astype(dtype).tobytes())

        for batch in batches:
            for ident, ids in zip(batch["id"].tolist(), encoder.encode(batch["text"].tolist()), strict=True):
                docs.append(None if ident is None or ident != ident else ident)
                held.append(ids + tokens.END)
                size += len(held[-1]) // 4
                if size >= BLOCK:
                    yield close()
                    number, before, docs, held, size = number + 1, before + size, [], [], 0
        if held:
            yield close()
            before, docs, held = before + size, [], []
        if before:
            yield row(None, counts.tobytes())

    return blocks


def _pack(lengths: np.ndarray, dtype: str):
    """A function over blocks of raw ids: blocks of codes."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = huffman.canonical_codes(lengths)
        for batch in batches:
            coded = [huffman.encode(np.frombuffer(raw, dtype), lengths, codes) for raw in batch["raw"]]
            out = batch.drop(columns=["raw"])
            out["payload"] = [stream for stream, _, _ in coded]
            out["checkpoints"] = [points.astype(np.int32) for _, _, points in coded]
            yield out

    return pack


def _unpack(lengths: np.ndarray, with_ids: bool):
    """A function over blocks of codes with ``begin``: the documents and their ids, or only the ids' CRC-32."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = huffman.Decoder(lengths)
        for batch in batches:
            for row in batch.itertuples():
                size = np.asarray(row.lengths, np.int64)
                ends = np.cumsum(size)
                ids = decoder.decode(row.payload, int(ends[-1]), row.checkpoints).astype("<u4").tobytes()
                starts = ends - size
                own = (ids[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
                yield pd.DataFrame({
                    "id": row.docs,
                    "start": row.begin + row.before + starts,
                    "n_tokens": size,
                    "ids" if with_ids else "ids_crc32": list(own) if with_ids else [zlib.crc32(x) for x in own],
                })

    return unpack


def write_tokens(
    df: DataFrame, path: str, tokenizer: str, vocabulary: int, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode every text with an end id 0 and write the file at ``path``, in ascending order of the identifier.

    ``vocabulary`` is one more than the largest id.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"
    # Rows of one identifier, or without any, follow each other as they are read and spread over parts like others.
    order = [F.col("id").asc_nulls_last(), F.col("nth").asc()]
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("nth"))
    # Identifiers pass through Python as text: a column of numbers with a null would turn into floats there.
    ranged = docs.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("id").cast("string").alias("id"), "text")
    schema = "part int, block int, before long, docs array<string>, lengths array<int>, raw binary, tally binary"
    raw = staged(ranged.mapInPandas(_blocks(tokenizer, vocabulary, dtype), schema), "token-blocks")
    sizes = staged(raw.where("block = -1").select("part", "before", "tally"), "token-counts")

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = np.sum([np.frombuffer(t, np.int64) for t in batch["tally"]], axis=0, dtype=np.int64)
            used = np.flatnonzero(counts)
            yield pd.DataFrame({"symbol": used, "count": counts[used]})

    counted = sizes.select("tally").mapInPandas(totals, "symbol int, count long").groupBy("symbol").agg(F.sum("count").alias("count"))
    counts = np.zeros(vocabulary, np.int64)
    for row in counted.collect():  # a row for each id of the vocabulary at most
        counts[row.symbol] = row["count"]
    lengths = huffman.code_lengths(counts)
    used = np.flatnonzero(lengths)
    book = pd.DataFrame({"symbol": used, "count": counts[used], "bits": lengths[used]}).astype("int64")
    spark.createDataFrame(book, "symbol long, count long, bits long").coalesce(1).write.parquet(f"{path}/codebook")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.select("part", F.coalesce(F.sum("before").over(earlier), F.lit(0)).alias("begin"))
    parts.write.parquet(f"{path}/parts")
    schema = "part int, block int, before long, docs array<string>, lengths array<int>, payload binary, checkpoints array<int>"
    coded = raw.where("block >= 0").drop("tally").mapInPandas(_pack(lengths, dtype), schema)
    coded = coded.withColumn("docs", F.col("docs").cast(f"array<{kind}>"))
    # Without dictionaries: payloads never repeat.
    coded.sortWithinPartitions("part", "block").write.option("parquet.enable.dictionary", "false").option(
        "compression", "zstd"
    ).partitionBy("part").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, id_type: str = "bigint", with_ids: bool = True) -> DataFrame:
    """``id, start, n_tokens, ids`` of every document; ``ids`` are little-endian unsigned 32-bit numbers.

    Without ``with_ids`` their CRC-32 takes the place of the ids, which then stay in their task.
    """
    book = spark.read.parquet(f"{path}/codebook").toPandas()
    lengths = np.zeros(int(book["symbol"].max()) + 1 if len(book) else 1, np.uint8)
    lengths[book["symbol"]] = book["bits"]
    stored = (
        f"block int, before long, docs array<{id_type}>, lengths array<int>, payload binary, checkpoints array<int>, part int"
    )
    blocks = spark.read.schema(stored).parquet(f"{path}/blocks")
    parts = spark.read.schema("part int, begin long").parquet(f"{path}/parts")
    # A row for each part; parts are as many as the writer's shuffle partitions.
    placed = blocks.join(F.broadcast(parts), "part").withColumn("docs", F.col("docs").cast("array<string>"))
    last = "ids binary" if with_ids else "ids_crc32 long"
    found = placed.mapInPandas(_unpack(lengths, with_ids), f"id string, start long, n_tokens long, {last}")
    return found.withColumn("id", F.col("id").cast(id_type))


def op1_token_file(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = new_path(spark, "token-file")
    write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), vocabulary=50257)
    return read_tokens(spark, path, with_ids=False).withColumnRenamed("id", "doc_id")

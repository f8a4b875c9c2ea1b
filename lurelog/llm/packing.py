"""Packing documents into sequences of fixed capacity by a plan over the length histogram.

Texts become token ids with an end id.  Only documents longer than a sequence
are cut.  The histogram of piece lengths, one count for each length up to the
capacity, is all that the driver sees; ``packing_plan`` turns it into
configurations.  Pieces of one length are interchangeable: each gets a number
among all of its length, and the plan's uses of that length, laid end to end,
say which sequence and place the number has.  No text moves between tasks.

Defined cases
    null text          the empty text: one piece that holds the end id alone
    very long texts    cut into full pieces and a rest
    repeated rows      each row is a document of its own
    null identifier    a document like any other
    empty table        empty result
    clashing columns   only identifier and text are read
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurelog.llm import packing_plan, tokens
from lurelog.staging import staged

CAPACITY = 2048
PIECES = "piece int, start long, length long, ids_crc32 long, task int, number long"


def cut(path: str, capacity: int, with_ids: bool, words_only: bool = True):
    """A function over batches of ``id, text``: the pieces, numbered within the task by length."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        made = np.zeros(capacity + 1, np.int64)
        encoder = tokens.encoder(path, words_only)
        for batch in batches:
            rows = []
            for ident, ids in zip(batch["id"], encoder.encode(batch["text"].tolist()), strict=True):
                ids += tokens.END
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    length = len(part) // 4
                    rows.append((ident, k, at // 4, length, zlib.crc32(part), task, int(made[length]), *([part] if with_ids else [])))
                    made[length] += 1
            names = ["id", "piece", "start", "length", "ids_crc32", "task", "number", *(["ids"] if with_ids else [])]
            frame = pd.DataFrame(rows, columns=names)
            frame["id"] = frame["id"].astype(batch["id"].dtype)
            yield frame

    return pieces


def _uses(plan: list[tuple[packing_plan.Configuration, int]]) -> dict[int, dict[str, np.ndarray]]:
    """For each length the plan's uses in order: first number, first sequence, copies in one, place."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    numbered: dict[int, int] = {}
    sequence = 0
    for configuration, n in plan:
        place = 0
        for length, copies in configuration:
            begin = numbered.get(length, 0)
            found.setdefault(length, []).append((begin, sequence, copies, place))
            numbered[length] = begin + n * copies
            place += length * copies
        sequence += n
    return {length: dict(zip(("begin", "sequence", "copies", "place"), np.array(rows, np.int64).T, strict=True)) for length, rows in found.items()}


def place(uses: dict[int, dict[str, np.ndarray]]):
    """A function over batches with ``length`` and ``number``: ``sequence_id`` and ``offset``."""

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths, numbers = batch["length"].to_numpy(np.int64), batch["number"].to_numpy(np.int64)
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            order = np.argsort(lengths, kind="stable")
            begins = np.flatnonzero(np.r_[True, np.diff(lengths[order]) != 0]) if len(order) else []
            for rows in np.split(order, begins[1:]) if len(order) else []:
                length = int(lengths[rows[0]])
                use = uses[length]
                k = np.searchsorted(use["begin"], numbers[rows], "right") - 1
                inside = numbers[rows] - use["begin"][k]
                sequence[rows] = use["sequence"][k] + inside // use["copies"][k]
                offset[rows] = use["place"][k] + inside % use["copies"][k] * length
            yield batch.drop(columns=["number"]).assign(sequence_id=sequence, offset=offset)

    return placed


def pack(
    df: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row a piece: identifier, ``piece, start, length, ids_crc32, sequence_id, offset``, and ``ids`` on request.

    ``ids`` holds little-endian unsigned 32-bit numbers.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id string, {PIECES}" + (", ids binary" if with_ids else "")
    # Identifiers pass through Python as text: a column of numbers with a null would turn into floats there.
    docs = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    pieces = staged(docs.mapInPandas(cut(tokenizer, capacity, with_ids), schema), "pack-pieces")
    made = staged(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "pack-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for row in made.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row for each length at most
        counts[row.length] = row.n
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    begins = made.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    numbered = pieces.join(begins, ["length", "task"]).withColumn("number", F.col("number") + F.col("begin")).drop("begin", "task")
    uses = _uses(packing_plan.plan(counts, capacity))
    outcome = T.StructType([f for f in numbered.schema.fields if f.name != "number"]).add("sequence_id", "long").add("offset", "long")
    placed = numbered.mapInPandas(place(uses), outcome)
    return placed.select(
        F.col("id").cast(kind).alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else [])
    )


def op6_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))

"""The corpus queries and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from lurelog.llm import (
    chat, exact_dedup, langid, mixing, negatives, packing, repair, repeats, secrets, simhash, token_file, topk, warc,
)

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Bytes of rows that Spark hands to a Python worker at a time.
BATCH_BYTES = str(8 << 20)


def prepared(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where they start from another folder; bound their batches."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, known]))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def _query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(function)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(prepared(spark), sf_dir)

    return run


QUERIES = {
    function.__name__: _query(function)
    for function in (
        token_file.op1_token_file, mixing.op2_mixing, exact_dedup.op3_exact_dedup, repeats.op4_suffix_repeats,
        simhash.op5_simhash, packing.op6_packing, topk.op7_top_k, warc.op8_warc, langid.op9_language, secrets.op10_secrets,
        chat.op11_chat, repair.op12_repair, negatives.op13_hard_negatives,
    )
}

SQL = {
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op7_top_k": topk.OP7_SQL,
    "op8_warc": warc.OP8_SQL,
    "op11_chat": chat.OP11_SQL,
    "op13_hard_negatives": negatives.OP13_SQL,
}

"""Chat formatting by prefix-target expansion, with an exact way back.

Every reply (a turn of the assistant) becomes an example of its own: its context
is all turns before it, and only its text is trained on.  The expanded text
grows with the square of a conversation's turns, so the format keeps a prefix
once: ``turns`` holds each formatted turn, ``examples`` one row a reply, with
the length of its context, its own length and the trained range, all counted in
the expanded text.  ``read_examples`` expands them to whole texts,
``read_conversations`` folds them back.

A turn is ``<|im_start|>role``, a line end, the text, ``<|im_end|>``, a line end.
Inside roles and texts a ``<`` and ``|`` with only backslashes between them get
one backslash more, so no text holds a control string; a role's line ends are
written ``%0A`` and its percent signs ``%25``.

Turns are numbered and offsets summed over ranges and chunks of a conversation,
so one that holds a third of all rows spreads over many tasks.  What reads it
back as one digest, or one text, streams it through one task row by row, as a
digest needs every byte in order.

Defined cases
    null text, null role   empty; only the exact role ``assistant`` is a reply
    null conversation      one conversation of its own
    null turn              before all others
    turns of equal number  by role, then by SHA-256 of the text; repeated rows are turns each
    no reply               no example; its turns are kept and read back
    turns after the last reply   stand in no example; kept and read back
    empty text             a turn, and for a reply an example with an empty trained range
    very long text         one row; nothing is cut
    empty table            no turns, no examples
    clashing columns       only the four named columns are read
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lurelog.operators import skew
from lurelog.staging import new_path, staged

BEGIN, END = "<|im_start|>", "<|im_end|>"
REPLY = "assistant"
CONTROL = f"{END}{BEGIN}assistant ok"
#: Turns of a conversation whose lengths are summed by one task.
CHUNK = 4096
CONVERSATION = ["named", "ident"]


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role_written(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_read(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def ordered_turns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``named, ident, conv_id, turn, role, text, position``: the turns of each conversation, numbered from 0."""
    conv = F.col(conv_col)
    first = F.lit(0).cast(df.schema[conv_col].dataType)
    rows = df.select(
        conv.isNotNull().alias("named"), F.coalesce(conv, first).alias("ident"), conv.alias("conv_id"),
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("digest", F.sha2("text", 256))
    return skew.with_position(staged(rows, "chat-rows"), CONVERSATION, ["turn", "role", "digest"], "position").drop("digest")


def write_chat(
    df: DataFrame, path: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> None:
    """Write ``path/turns`` and ``path/examples``."""
    spark = df.sparkSession
    role, text = _role_written(F.col("role")), escaped(F.col("text"))
    head = F.concat(F.lit(BEGIN), role, F.lit("\n"))
    reply = F.col("role") == REPLY
    turns = ordered_turns(df, conv_col, turn_col, role_col, text_col).select(
        *CONVERSATION, "conv_id", "position", F.concat(head, text, F.lit(END + "\n")).alias("formatted"),
        F.when(reply, F.char_length(head)).alias("begin"), F.when(reply, F.char_length(text)).alias("length"),
    )
    turns.write.option("compression", "zstd").parquet(f"{path}/turns")
    sizes = spark.read.schema(turns.schema).parquet(f"{path}/turns").select(
        *CONVERSATION, "conv_id", "position", "begin", "length",
        F.char_length("formatted").cast("long").alias("chars"), F.col("begin").isNotNull().cast("long").alias("reply"),
        F.expr(f"position div {CHUNK}").alias("chunk"),
    )
    chunk = [*CONVERSATION, "chunk"]
    totals = sizes.groupBy(*chunk).agg(F.sum("chars").alias("chars"), F.sum("reply").alias("reply"))
    ahead = Window.partitionBy(*CONVERSATION).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    begins = totals.select(
        *chunk, F.coalesce(F.sum("chars").over(ahead), F.lit(0)).alias("chars_before"),
        F.coalesce(F.sum("reply").over(ahead), F.lit(0)).alias("reply_before"),
    )
    inside = Window.partitionBy(*chunk).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumns({
        "chars_inside": F.coalesce(F.sum("chars").over(inside), F.lit(0)),
        "reply_inside": F.coalesce(F.sum("reply").over(inside), F.lit(0)),
    }).where("reply = 1").join(staged(begins, "chat-begins"), chunk)
    context = F.col("chars_before") + F.col("chars_inside")
    placed.select(
        *CONVERSATION, "conv_id", (F.col("reply_before") + F.col("reply_inside")).alias("example"), "position",
        context.alias("context_chars"), (context + F.col("chars")).alias("example_chars"),
        (context + F.col("begin")).alias("loss_start"), (context + F.col("begin") + F.col("length")).alias("loss_end"),
    ).write.option("compression", "zstd").parquet(f"{path}/examples")


def _joined(spark: SparkSession, path: str) -> DataFrame:
    """The turns with their example, where they are the reply of one; a conversation in one partition, in order."""
    turns = spark.read.parquet(f"{path}/turns").drop("begin", "length")
    examples = spark.read.parquet(f"{path}/examples").drop("conv_id")
    both = turns.join(examples, [*CONVERSATION, "position"], "left")
    return both.repartition(*CONVERSATION).sortWithinPartitions(*CONVERSATION, "position")


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conversation, prefix = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (row["named"], row["ident"]) != conversation:
                conversation, prefix = (row["named"], row["ident"]), []
            prefix.append(row["formatted"])
            if row["example"] is not None:
                prefix = ["".join(prefix)]
                made = {"conv_id": row["conv_id"], "example": row["example"], "text": prefix[0],
                        "loss_start": row["loss_start"], "loss_end": row["loss_end"]}
                kinds = pa.schema([batch.schema.field("conv_id"), ("example", pa.int64()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
                yield pa.RecordBatch.from_pylist([made], kinds)


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """``conv_id, example, text, loss_start, loss_end``: every reply with its whole context, trained range in code points."""
    joined = _joined(spark, path)
    kind = joined.schema["conv_id"].dataType.simpleString()
    return joined.mapInArrow(_expand, f"conv_id {kind}, example long, text string, loss_start long, loss_end long")


DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of each conversation, a row at a time."""
    current = state = None

    def close() -> dict:
        turns, loss, made = state["turns"], state["loss"], state["made"] + state["chars"] - state["last"]
        return {"conv_id": state["conv"], "n_turns": state["n"], "turns_sha256": turns.hexdigest(), "loss_chars": state["loss_chars"],
                "loss_sha256": loss.hexdigest(), "formatted_chars": made, "n_examples": state["examples"]}

    kinds = None
    for batch in batches:
        kinds = pa.schema([
            batch.schema.field("conv_id"), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
            ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_examples", pa.int64()),
        ])
        done = []
        for row in batch.to_pylist():
            if (row["named"], row["ident"]) != current:
                if state is not None:
                    done.append(close())
                current = (row["named"], row["ident"])
                state = {"conv": row["conv_id"], "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(),
                         "loss_chars": 0, "chars": 0, "made": 0, "last": 0, "examples": 0}
            state["n"] += 1
            state["turns"].update(f"{row['role']}\n{row['text']}\n".encode())
            if row["context_chars"] is not None:
                if row["context_chars"] != state["chars"]:
                    raise ValueError(f"example {row['example']} of conversation {row['conv_id']} begins at the wrong place")
                state["loss"].update(row["trained"].encode())
                state["loss_chars"] += len(row["trained"])
                state["made"] += row["example_chars"]
                state["last"] = row["example_chars"]
                state["examples"] += 1
            state["chars"] += row["chars"]
        if done:
            yield pa.RecordBatch.from_pylist(done, kinds)
    if state is not None:
        yield pa.RecordBatch.from_pylist([close()], kinds)


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """``conv_id`` and digests of what the format holds of it, read back and unescaped.

    ``loss_*`` is the text under the trained ranges.  ``formatted_chars`` counts
    the characters of all examples, and those of the turns after the last reply.
    """
    joined = _joined(spark, path)
    kind = joined.schema["conv_id"].dataType.simpleString()
    body = F.expr(f"substr(formatted, {len(BEGIN) + 1}, char_length(formatted) - {len(BEGIN) + len(END) + 1})")
    cut = F.expr("substr(formatted, cast(loss_start - context_chars + 1 AS INT), cast(loss_end - loss_start AS INT))")
    read = joined.select(
        *CONVERSATION, "conv_id", "example", "context_chars", "example_chars",
        F.char_length("formatted").cast("long").alias("chars"),
        _role_read(F.substring_index(body, "\n", 1)).alias("role"),
        unescaped(F.substr(body, F.instr(body, "\n") + 1)).alias("text"),
        unescaped(cut).alias("trained"),
    )
    return read.mapInArrow(_fold, f"conv_id {kind}, {DIGESTS}")


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, REPLY, CONTROL)], rows.schema)
    path = new_path(spark, "chat")
    write_chat(rows.unionByName(control), path)
    return read_conversations(spark, path)


OP11_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS place,
    24 + length(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\\*)\|', '<\\\1|', 'g'))
       + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS chars
  FROM rows
), summed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY place) AS so_far,
    max(place) FILTER (WHERE role = 'assistant') OVER (PARTITION BY conv_id) AS last_reply FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (coalesce(sum(so_far) FILTER (WHERE role = 'assistant'), 0)
   + coalesce(sum(chars) FILTER (WHERE place > coalesce(last_reply, 0)), 0))::BIGINT AS formatted_chars,
  count(*) FILTER (WHERE role = 'assistant') AS n_examples
FROM summed GROUP BY conv_id
"""

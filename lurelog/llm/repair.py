"""Repair of conversation structure: the cheapest edits to alternating turns.

A conversation is right when its roles spell ``(s?(ua)+)?`` by their initials
and no turn is blank or said before.  Turns are kept, given the other role,
deleted or inserted; ``turn_search`` finds the cheapest edits by branch and
bound, and among those the ASCII-least string of their initials.

Only a letter a turn goes into the search.  A conversation is searched in pieces
of ``PIECE`` turns: a piece's sixteen least costs from state to state give the
bounds behind every piece, then each is searched from each state it may be
entered in, and a chain over the pieces picks the one that is.  So a
conversation with a third of all rows takes many tasks; only applying its edits
streams through one, row by row.

Defined cases
    null text, null role   one space (a blank turn; a role to be given anew)
    null conversation      one conversation of its own
    null turn              before all others
    turns of equal number  by role, then by SHA-256 of the text
    repeated rows          all but the first are duplicates
    empty text             a blank turn
    very long text         one row, read whole
    role initials other than s, u, a   never legal, so given anew or deleted
    empty table            empty result
    clashing columns       only the four named columns are read
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurelog.llm import turn_search as ts
from lurelog.operators import skew
from lurelog.staging import staged

#: Turns that one search takes.
PIECE = 16384
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
CONVERSATION = ["named", "ident"]
FAULTS = ("blank", "duplicate", "truncated")
_EMPTY = hashlib.sha256().hexdigest()


def judged_turns(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``named, ident, conv_id, turn, role, text, position, fault, symbol``: numbered turns and the first fault of each."""
    conv = F.col(conv_col)
    rows = df.select(
        conv.isNotNull().alias("named"), F.coalesce(conv, F.lit(0).cast(df.schema[conv_col].dataType)).alias("ident"),
        conv.alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
    # A written number lets copies of one row lie in different ranges.
    ).withColumns({"digest": F.sha2("text", 256), "row": F.monotonically_increasing_id()})
    placed = staged(skew.with_position(staged(rows, "turns"), CONVERSATION, ["turn", "role", "digest"], "position"), "turns-placed")
    content = [*CONVERSATION, "role", "digest"]
    repeated = placed.groupBy(*content).agg(F.min("position").alias("first"), F.count("*").alias("n")).where("n > 1")
    known = placed.join(staged(repeated.drop("n"), "turns-repeated"), content, "left")
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = (
        F.when(end == "", FAULTS[0]).when(F.col("position") > F.col("first"), FAULTS[1])
        .when(~F.right(end, F.lit(1)).isin(".", "!", "?"), FAULTS[2])
    )
    found = known.withColumn("fault", fault).drop("first", "digest", "row")
    code = F.when(F.col("fault").isNull(), ts.OK).when(F.col("fault") == FAULTS[2], ts.CUT).otherwise(ts.DROP)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return found.withColumn("symbol", F.char(F.lit(65) + kind * 3 + code))


def _mapped(df: DataFrame, function, made: str) -> DataFrame:
    """``CONVERSATION`` columns of ``df`` beside the rows that ``function`` makes of one row."""
    keys = [f"{name} {df.schema[name].dataType.simpleString()}" for name in CONVERSATION]
    names = [part.split()[0] for part in made.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out = [(row["named"], row["ident"], *values) for row in rows for values in function(row)]
            columns = list(zip(*out, strict=True)) if out else [()] * (2 + len(names))
            kinds = [batch.schema.field("named").type, batch.schema.field("ident").type]
            kinds += [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}[p.split()[1]] for p in made.split(", ")]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*CONVERSATION, *names])

    return df.mapInArrow(run, ", ".join([*keys, made]))


def _search_whole(row: dict) -> Iterator[tuple]:
    _, audit, _ = ts.search(row["symbols"], ts.START)
    yield row["piece"], audit


def _search_entries(row: dict) -> Iterator[tuple]:
    for entry in range(4) if row["piece"] else (ts.START,):
        _, audit, state = ts.search(row["symbols"], entry, None if row["piece"] == row["last"] else row["behind"])
        yield row["piece"], entry, state, audit


def _bounds(row: dict) -> Iterator[tuple]:
    """The least costs behind every piece, from the last to the first."""
    behind = ts.END
    for piece in sorted(row["pieces"], key=lambda p: -p["piece"]):
        yield piece["piece"], behind
        behind = ts.through(piece["costs"], behind)


def _chain(row: dict) -> Iterator[tuple]:
    """The state in which every piece is entered."""
    leads = {(p["piece"], p["entry"]): p["state"] for p in row["pieces"]}
    state = ts.START
    for piece in range(1 + max(piece for piece, _ in leads)):
        yield piece, state
        state = leads[piece, state]


def audits(turns: DataFrame, size: int = PIECE) -> DataFrame:
    """``named, ident, piece, audit``: the edits of every piece of the written ``turns``."""
    piece = [*CONVERSATION, "piece"]
    letters = F.array_sort(F.collect_list(F.struct("position", "symbol")))  # at most ``size`` of them
    pieces = turns.withColumn("piece", F.expr(f"position div {size}")).groupBy(*piece).agg(
        F.array_join(F.transform(letters, lambda e: e["symbol"]), "").alias("symbols")
    )
    lasts = turns.groupBy(*CONVERSATION).agg(F.expr(f"max(position) div {size}").alias("last"))
    pieces = staged(pieces.join(lasts, CONVERSATION), "turn-pieces")
    whole = _mapped(pieces.where("last = 0"), _search_whole, "piece long, audit string")
    parts = pieces.where("last > 0")
    if parts.isEmpty():
        return whole

    def listed(df: DataFrame, *columns: str) -> DataFrame:
        return df.groupBy(*CONVERSATION).agg(F.collect_list(F.struct(*columns)).alias("pieces"))

    crossings = _mapped(parts, lambda row: [(row["piece"], ts.crossing(row["symbols"]))], "piece long, costs array<long>")
    bounds = _mapped(listed(crossings, "piece", "costs"), _bounds, "piece long, behind array<long>")
    searched = staged(
        _mapped(parts.join(bounds, piece), _search_entries, "piece long, entry int, state int, audit string"), "turn-searches"
    )
    chosen = _mapped(listed(searched, "piece", "entry", "state"), _chain, "piece long, entry int")
    return whole.unionByName(searched.join(chosen, [*piece, "entry"]).select(*whole.columns))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order, with each piece's edits at its first: the repaired turns, deleted ones without a role."""
    current, last, edits, at, state = None, None, "", 0, ts.START

    def inserted() -> Iterator[dict]:
        nonlocal at, state
        while at < len(edits) and edits[at] == ts.INSERT:
            at, state = at + 1, ts.ASKED[state]
            yield {**last, "turn": None, "fault": None, "edit": ts.INSERT, "was": None, "role": ts.ROLE[state], "text": ""}

    kinds = None
    for batch in batches:
        conv = batch.schema.field("conv_id").type
        kinds = pa.schema([
            ("named", pa.bool_()), ("ident", batch.schema.field("ident").type), ("conv_id", conv), ("turn", batch.schema.field("turn").type),
            ("fault", pa.string()), ("edit", pa.string()), ("was", pa.string()), ("role", pa.string()), ("text", pa.string()),
        ])
        out = []
        for row in batch.to_pylist():
            key = {name: row[name] for name in ("named", "ident", "conv_id")}
            if (row["named"], row["ident"]) != current:
                out += inserted()
                current, last, state = (row["named"], row["ident"]), key, ts.START
            if row["audit"] is not None:
                edits, at = row["audit"], 0
            out += inserted()
            edit, role = edits[at], row["role"]
            at += 1
            if edit == ts.KEEP:
                state = ts.AFTER[state, role[0]]
            elif edit == ts.REROLE:
                state = ts.ASKED[state]
                role = ts.ROLE[state]
            else:
                role = None
            out.append({**key, "turn": row["turn"], "fault": row["fault"], "edit": edit, "was": row["role"], "role": role, "text": row["text"]})
        yield pa.RecordBatch.from_pylist(out, kinds)
    if last is not None:
        yield pa.RecordBatch.from_pylist(list(inserted()), kinds)


def repair(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", size: int = PIECE
) -> DataFrame:
    """``named, ident, conv_id, turn, fault, edit, was, role, text``: each conversation's turns, in order, with their edits.

    ``was`` is the role before (null: inserted), ``role`` the one now (null:
    deleted).  A partition holds whole conversations, one after another.
    """
    turns = staged(judged_turns(df, conv_col, turn_col, role_col, text_col), "turns-judged")
    found = audits(turns, size).withColumn("position", F.col("piece") * size).drop("piece")
    placed = turns.drop("symbol").join(staged(found, "turn-audits"), [*CONVERSATION, "position"], "left")
    kinds = {c: placed.schema[c].dataType.simpleString() for c in ("ident", "conv_id", "turn")}
    made = f"named boolean, ident {kinds['ident']}, conv_id {kinds['conv_id']}, turn {kinds['turn']}, fault string, edit string, was string, role string, text string"
    return placed.repartition(*CONVERSATION).sortWithinPartitions(*CONVERSATION, "position").mapInArrow(_apply, made)


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LEGAL = {"su", "ua", "au"}


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current = state = kinds = None

    def close() -> dict:
        turns, span = state["turns"], 0
        if state["last"] is not None:
            span = state["last"] - state["first"] + 1 - turns
        return {"conv_id": state["conv"], "gaps": span, **{f: state[f] for f in FAULTS}, "illegal": state["illegal"], "cost": state["cost"],
                "audit": "".join(state["audit"]), "repaired_sha256": state["hash"].hexdigest()}

    for batch in batches:
        kinds = pa.schema([
            batch.schema.field("conv_id"), *[(name, pa.int64()) for name in ("gaps", *FAULTS, "illegal", "cost")],
            ("audit", pa.string()), ("repaired_sha256", pa.string()),
        ])
        done = []
        for row in batch.to_pylist():
            if (row["named"], row["ident"]) != current:
                if state is not None:
                    done.append(close())
                current = (row["named"], row["ident"])
                state = {"conv": row["conv_id"], "first": None, "last": None, "turns": 0, **dict.fromkeys(FAULTS, 0), "illegal": 0, "cost": 0,
                         "audit": [], "hash": hashlib.sha256(), "before": None, "said": False}
            edit = row["edit"]
            state["audit"].append(edit)
            state["cost"] += {ts.KEEP: 0, ts.DELETE: ts.DELETE_COST}.get(edit, ts.CHANGE_COST)
            if row["fault"]:
                state[row["fault"]] += 1
                if row["fault"] == FAULTS[2] and edit != ts.DELETE:
                    state["cost"] += ts.TRUNCATED_COST
            if row["was"] is not None:
                initial = row["was"][:1]
                state["illegal"] += state["before"] is not None and state["before"] + initial not in LEGAL
                state["before"] = initial
                # Turns come in ascending order, missing numbers first.
                if row["turn"] is not None and row["turn"] != state["last"]:
                    state["first"] = row["turn"] if state["first"] is None else state["first"]
                    state["last"], state["turns"] = row["turn"], state["turns"] + 1
            if row["role"] is not None:
                state["hash"].update(f"{chr(10) if state['said'] else ''}{row['role']}:{row['text']}".encode())
                state["said"] = True
        if done:
            yield pa.RecordBatch.from_pylist(done, kinds)
    if state is not None:
        yield pa.RecordBatch.from_pylist([close()], kinds)


def report(repaired: DataFrame) -> DataFrame:
    """A row for each conversation of ``repair``'s rows: faults, cost, audit and a digest of the repaired turns."""
    kind = repaired.schema["conv_id"].dataType.simpleString()
    return repaired.mapInArrow(_report, f"conv_id {kind}, {REPORT}")


def damaged(df: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults planted by a checksum of conversation and turn; nulls become one space."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    plain = df.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(name.cast("binary")) % 20).alias("damage"))
    return plain.where("damage <> 0").select(
        "conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("damage") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = report(repair(damaged(conversations))).withColumnRenamed("conv_id", "found_id")
    every = conversations.select("conv_id").distinct()
    both = every.join(found, every.conv_id.eqNullSafe(found.found_id), "left").drop("found_id")
    counts = ["gaps", *FAULTS, "illegal", "cost"]
    return both.fillna(0, counts).fillna({"audit": "", "repaired_sha256": _EMPTY})

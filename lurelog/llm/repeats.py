"""Removal of byte strings that occur more than once anywhere, by suffix sorting.

A string of ``length`` bytes that starts at two places is removed at both.
Every window of that length has a minimizer: the least hash among its grams of
``GRAM`` bytes.  Equal windows have equal minimizers, so

1. each text is cut into runs of windows with one minimizer (about one run for
   70 windows), and only runs whose minimizer occurs at another place go on;
2. the bytes under a run's windows are its fragment; equal fragments of one
   minimizer are one row with a count, and all their windows repeat;
3. where a minimizer has several fragments, or one fragment holds it at several
   places, these are sorted together by their suffixes (``suffix_sort``), and windows whose neighbour in that order has a
   common prefix of the whole length repeat;
4. each document's repeated windows are united to spans and cut out.

A minimizer with more fragments than one task should sort is spread by the
digests of the single windows instead, which is exact as well.  Texts travel
compressed; matching moves 64-bit hashes and fragments only.

Defined cases
    null text          the empty text
    texts shorter than the length   nothing to remove
    very long texts    cut into pieces that overlap by a window
    repeated rows      each copy's windows start at another place, so they repeat
    null identifier    a document like any other
    empty table        empty result
    clashing columns   only identifier and text are read
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurelog.llm import suffix_sort
from lurelog.staging import staged

LENGTH = 200
GRAM = 64
#: Bytes whose hashes are held at a time, and bytes of fragments sorted together.
PIECE = 1 << 18
SORTED = 1 << 19
#: Fragments of a document handed on at a time.
FRAGMENTS = 4096
#: Fragments of one minimizer from which single windows are compared by digest.
WIDE = 4096
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Bits for a place within a piece.
_PLACE = np.uint64(PIECE.bit_length())
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class Rolling:
    """64-bit hashes of all grams of a byte array, by differences of one running sum."""

    def __init__(self, size: int):
        inverse = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
        self.up = np.cumprod(np.full(size, _MULTIPLIER))
        self.down = np.cumprod(np.full(size, inverse))
        self.value = np.random.default_rng(17).integers(1, 1 << 63, 256, dtype=np.uint64)

    def hashes(self, data: np.ndarray, gram: int) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.up[: len(data)], out=total[1:])
        found = (total[gram:] - total[:-gram]) * self.down[: len(data) - gram + 1]
        found ^= found >> np.uint64(29)
        found *= _MIX
        found ^= found >> np.uint64(32)
        return found


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    spare = -len(values) % width
    grid = np.pad(values, (0, spare), constant_values=np.uint64(0xFFFFFFFFFFFFFFFF)).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: len(values) - width + 1], ahead[width - 1 : len(values)])


_ROLLING: dict[int, Rolling] = {}


def window_runs(data: bytes, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimizer: start, number of windows, minimizer, places of it in the run.

    ``ends`` has the end of each text in ``data``; no window crosses one.
    """
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, none, none
    rolling = _ROLLING.get(0)
    if rolling is None or len(rolling.up) < len(data):
        rolling = _ROLLING[0] = Rolling(max(len(data), PIECE + length))
    hashes = rolling.hashes(np.frombuffer(data, np.uint8), gram)
    # The low bits tell the place, so that the first of equal grams counts and is known.
    placed = hashes >> _PLACE << _PLACE | np.arange(len(hashes), dtype=np.uint64)
    least = sliding_least(placed, length - gram + 1)
    place = (least & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int64)
    key = hashes[place]
    text = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
    inside = text[: len(least)] == text[length - 1 : length - 1 + len(least)]
    change = np.r_[True, (key[1:] != key[:-1]) | (text[1 : len(least)] != text[: len(least) - 1]) | (inside[1:] != inside[:-1])]
    begin = np.flatnonzero(change)
    size = np.diff(np.r_[begin, len(least)])
    good = inside[begin]
    places = np.add.reduceat(change | np.r_[True, place[1:] != place[:-1]], begin, dtype=np.int64)
    return begin[good], size[good], key[begin[good]].view(np.int64), places[good]


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], bytes]]:
    """Rows, their offsets in the text, and joined bytes of about ``PIECE``; long texts in overlapping parts."""
    rows, at, held, size = [], [], [], 0
    for row, text in enumerate(texts):
        for begin in range(0, max(1, len(text) - length + 1), PIECE):
            part = text[begin : begin + PIECE + length - 1]
            if len(part) < length:
                continue
            if size + len(part) > PIECE + length and held:
                yield rows, at, held
                rows, at, held, size = [], [], [], 0
            rows.append(row)
            at.append(begin)
            held.append(part)
            size += len(part)
    if held:
        yield rows, at, held


def _run_batches(length: int, gram: int):
    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch["text"]]
            for rows, at, parts in _pieces(texts, length):
                ends = np.cumsum([len(p) for p in parts])
                begin, size, key, places = window_runs(b"".join(parts), ends, length, gram)
                part = np.searchsorted(ends, begin, "right")
                row = np.array(rows)[part]
                start = begin - np.r_[0, ends[:-1]][part] + np.array(at)[part]
                yield pd.DataFrame({
                    "id": batch["id"].array.take(row), "text_hash": batch["text_hash"].to_numpy()[row],
                    "start": start, "windows": size, "key": key, "places": places,
                })

    return runs


@F.pandas_udf(T.BinaryType())
def compressed(texts: pd.Series) -> pd.Series:
    packer = zstandard.ZstdCompressor(level=1)
    return pd.Series([packer.compress((t or "").encode("utf-8", "surrogatepass")) for t in texts], dtype=object)


def _fragments(length: int):
    """A function over documents with their wanted runs: fragments and their digests."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        ready, size = [], 0
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                data = unpacker.decompress(row["packed"][0].as_py())
                runs = row["runs"].flatten()
                for first in range(0, len(runs), FRAGMENTS):
                    part = runs.slice(first, FRAGMENTS)
                    start, windows, key, places = part.flatten()
                    ends = zip(start.to_pylist(), windows.to_pylist(), strict=True)
                    found = [data[s : s + n + length - 1] for s, n in ends]
                    same = pa.array(np.zeros(len(found), np.int64))
                    made = pa.RecordBatch.from_arrays(
                        [
                            row["id"].take(same), row["text_hash"].take(same), start, windows, key, places,
                            pa.array([xxhash.xxh3_128_digest(p) for p in found], pa.binary()), pa.array(found, pa.binary()),
                        ],
                        ["id", "text_hash", "start", "windows", "key", "places", "digest", "fragment"],
                    )
                    ready.append(made)
                    size += made.nbytes
                    if size >= PIECE:
                        yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                        ready, size = [], 0
        if ready:
            yield from pa.Table.from_batches(ready).combine_chunks().to_batches()

    return cut


def _intervals(flags: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """Runs of set flags as ``(begin, end)``, each end moved on by ``reach``."""
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return [(int(b), int(e) + reach) for b, e in zip(edge[0::2], edge[1::2], strict=True)]


def sort_fragments(rows: list[tuple], length: int) -> list[tuple]:
    """``(key, digest, spans)`` for fragments ``(key, digest, count, bytes)``: what repeats, from the fragment's start."""
    text = np.frombuffer(b"".join(r[3] + b"\xff" for r in rows) + b"\xff", np.uint8) + np.uint8(1)  # 255, never in UTF-8, becomes 0
    size = np.array([len(r[3]) for r in rows])
    begin = np.r_[0, np.cumsum(size + 1)[:-1]]
    starts = np.zeros(len(text), bool)
    for b, n in zip(begin.tolist(), size.tolist(), strict=True):
        starts[b : b + n - length + 1] = True
    found = suffix_sort.repeated(text, starts, length)
    out = []
    for (key, digest, count, _), b, n in zip(rows, begin.tolist(), size.tolist(), strict=True):
        windows = n - length + 1
        flags = np.ones(windows, bool) if count > 1 else found[b : b + windows]
        spans = _intervals(flags, length - 1)
        if spans:
            out.append((key, digest, [list(s) for s in spans]))
    return out


def _sort_batches(length: int):
    """A function over fragments sorted by key; whole keys are sorted together up to ``SORTED`` bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, last = [], 0, None
        names = ["key", "digest", "spans"]
        for batch in batches:
            for row in batch.itertuples():
                if size > SORTED and row.key != last:
                    yield pd.DataFrame(sort_fragments(held, length), columns=names)
                    held, size = [], 0
                held.append((row.key, row.digest, row.copies, row.fragment))
                size += len(row.fragment)
                last = row.key
        if held:
            yield pd.DataFrame(sort_fragments(held, length), columns=names)

    return run


def _window_digests(length: int):
    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                data = row.fragment
                count = len(data) - length + 1
                yield pd.DataFrame({
                    "key": np.full(count, row.key), "digest": [row.digest] * count, "copies": np.full(count, row.copies),
                    "at": np.arange(count), "window": [xxhash.xxh3_128_digest(data[k : k + length]) for k in range(count)],
                })

    return digests


def _wide_spans(wide: DataFrame, length: int) -> DataFrame:
    """The same rows as ``_sort_batches`` for minimizers with very many fragments, by window digests."""
    windows = staged(
        wide.mapInPandas(_window_digests(length), "key long, digest binary, copies long, at int, window binary"), "repeat-windows"
    )
    often = windows.groupBy("window").agg(F.sum("copies").alias("n")).where("n > 1").select("window")
    marked = windows.join(often, "window").select("key", "digest", F.array(F.col("at").cast("long"), (F.col("at") + length).cast("long")).alias("span"))
    return marked.groupBy("key", "digest").agg(F.collect_list("span").alias("spans"))


def repeat_spans(df: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """The documents ``(id, text_hash, packed)`` and for each its covered ``spans`` ``(id, text_hash, spans)``."""
    kind = df.schema["id"].dataType.simpleString()
    hashed = df.select("id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    docs = hashed.select("id", "text_hash", compressed("text").alias("packed"))
    schema = f"id {kind}, text_hash long, start int, windows int, key long, places int"
    runs = staged(hashed.mapInPandas(_run_batches(length, gram), schema), "repeat-runs")
    keys = staged(runs.groupBy("key").agg(F.sum("places").alias("n")).where("n > 1").select("key"), "repeat-keys")
    wanted = runs.join(keys, "key").groupBy("id", "text_hash").agg(F.collect_list(F.struct("start", "windows", "key", "places")).alias("runs"))
    # A missing identifier joins by a stand-in that the text's hash tells apart.
    with_text = docs.withColumnRenamed("id", "own").join(
        wanted.withColumnRenamed("text_hash", "of"), F.col("own").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("of"))
    ).select("id", "text_hash", "packed", "runs")
    once = with_text.mapInArrow(
        _fragments(length),
        f"id {kind}, text_hash long, start int, windows int, key long, places int, digest binary, fragment binary",
    )
    places = staged(once, "repeat-fragments")
    copies = staged(
        places.groupBy("key", "digest").agg(F.count("*").alias("copies"), F.max("places").alias("places")), "repeat-copies"
    )
    shared = staged(copies.groupBy("key").agg(F.count("*").alias("kinds"), F.max("places").alias("places")), "repeat-kinds")
    several = shared.where("kinds > 1 OR places > 1").select("key", "kinds")
    texts = places.join(several, "key").groupBy("key", "digest").agg(
        F.count("*").alias("copies"), F.first("fragment").alias("fragment"), F.first("kinds").alias("kinds")
    )
    texts = staged(texts, "repeat-texts")
    narrow = texts.where(F.col("kinds") <= WIDE).drop("kinds").repartition("key").sortWithinPartitions("key")
    sorted_spans = narrow.mapInPandas(_sort_batches(length), "key long, digest binary, spans array<array<long>>")
    wide_spans = _wide_spans(texts.where(F.col("kinds") > WIDE).drop("kinds"), length)
    marked = staged(sorted_spans.union(wide_spans), "repeat-spans")
    at = places.drop("fragment", "places")
    alone = at.join(shared.where("kinds = 1 AND places = 1").select("key"), "key").join(copies.where("copies > 1").select("key", "digest"), ["key", "digest"])
    whole = alone.select("id", "text_hash", F.col("start").alias("b"), (F.col("start") + F.col("windows") + length - 1).alias("e"))
    part = at.join(marked, ["key", "digest"]).select("id", "text_hash", "start", F.explode("spans").alias("s")).select(
        "id", "text_hash", (F.col("start") + F.col("s")[0]).alias("b"), (F.col("start") + F.col("s")[1]).alias("e")
    )
    covered = whole.union(part).groupBy("id", "text_hash").agg(F.sort_array(F.collect_set(F.array("b", "e"))).alias("spans"))
    return docs, staged(covered, "repeat-covered")


def united(spans) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes from sorted spans; touching ones are one."""
    found: list[list[int]] = []
    for b, e in spans:
        if found and b <= found[-1][1]:
            found[-1][1] = max(found[-1][1], int(e))
        else:
            found.append([int(b), int(e)])
    return [(b, e) for b, e in found]


def _cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    unpacker = zstandard.ZstdDecompressor()
    for batch in batches:
        rows, size = [], 0

        def frame(rows: list[tuple], kind=batch["id"].dtype) -> pd.DataFrame:
            made = pd.DataFrame(rows, columns=["id", "n_bytes", "spans", "kept"])
            made["id"] = made["id"].astype(kind)
            return made

        for row in batch.itertuples():
            data = unpacker.decompress(row.packed)
            spans = united(row.spans) if row.spans is not None else []
            kept, at = [], 0
            for b, e in spans:
                kept.append(data[at:b])
                at = e
            kept.append(data[at:])
            rows.append((row.id, len(data), [list(s) for s in spans], b"".join(kept)))
            size += len(data)
            if size > PIECE:
                yield frame(rows)
                rows, size = [], 0
        if rows:
            yield frame(rows)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``id, n_bytes, spans, kept``: the removed byte spans of every document and what is left of it."""
    kind = df.schema[id_col].dataType.simpleString()
    # Identifiers pass through Python as text: a column of numbers with a null would turn into floats there.
    docs, covered = repeat_spans(df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")), length)
    named = covered.select(F.col("id").alias("of"), F.col("text_hash").alias("of_hash"), "spans")
    joined = docs.join(named, F.col("id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_hash")), "left")
    found = joined.select("id", "packed", "spans").mapInPandas(_cut_out, "id string, n_bytes long, spans array<array<long>>, kept binary")
    return found.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def op4_suffix_repeats(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s[1] - s[0])
    return remove_repeats(docs).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )

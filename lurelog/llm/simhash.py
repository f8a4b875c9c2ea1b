"""Near-duplicates by SimHash fingerprints compared as bit slices.

A fingerprint takes the majority of every bit over the XXH64 values of the
text's word shingles.  Two fingerprints link when at most ``radius`` bits
differ.  Equal fingerprints are one row from the start.  Pairs worth comparing
agree in all but ``radius`` of ``radius + 2`` bit blocks, so rows meet under
each choice of two agreeing blocks; a bucket with very many rows is cut again
by the same rule inside its remaining bits, which bounds every bucket.

Inside a bucket, 64 fingerprints form a block that is stored vertically: one
word for each bit position.  A query fingerprint is compared with all 64 at
once: each bit plane adds its differences to carry-save counters, and a block
is abandoned as soon as every lane has passed the radius.  Only a spanning
forest of the links leaves a bucket, never all pairs.

Defined cases
    null or blank text  fingerprint zero, which links like any other
    fewer words than a shingle  the whole word sequence is the one shingle
    long texts          hashed whole, counted in slices
    repeated rows       share a fingerprint and a component
    null identifier     follows its fingerprint; it never names a component that has another identifier
    empty table         empty result
    clashing columns    columns of the input named like an output column are replaced
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurelog.llm.components import components
from lurelog.staging import staged

BITS = 64
SEED = 42
WIDTH = 3
RADIUS = 2
#: Rows of a bucket from which it is cut again.
LARGE_BUCKET = 4096
#: Hashes counted, and query-block pairs compared, at a time.
SLICE = 1 << 16
PAIRS = 1 << 14
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
OUTPUT = ["fingerprint", "component_id"]


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """XXH64 of every ``width``-word shingle of the lower-cased text, in order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(line, SEED)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(line)]
    count = len(words) - width + 1
    found = (digest(line[a:b], SEED) for a, b in zip(starts[:count], ends[width - 1 :], strict=True))
    return np.fromiter(found, np.uint64, count)


def majority(hashes: np.ndarray) -> int:
    """The unsigned word whose bit is set where over half the hashes set it; zero for none."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), SLICE):
        part = hashes[at : at + SLICE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    packed = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(packed.view(np.uint64)[0])


@F.pandas_udf(T.LongType())
def simhash(texts: pd.Series) -> pd.Series:
    """The fingerprint of each text, as a signed 64-bit number."""
    words = np.array([majority(shingle_hashes(t)) for t in texts], np.uint64)
    return pd.Series(words.view(np.int64))


def _block_key(blocks: list[tuple[int, int]]):
    """The bits of the given (low, width) blocks of the fingerprint, packed into one number."""
    key = F.lit(0).cast("long")
    for low, width in blocks:
        key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1)))
    return key


def _cut(bits: list[tuple[int, int]], parts: int) -> list[list[tuple[int, int]]]:
    """The bit ranges dealt into ``parts`` groups of about equal size, as lists of (low, width)."""
    single = [b for low, width in bits for b in range(low, low + width)]
    groups = [single[len(single) * i // parts : len(single) * (i + 1) // parts] for i in range(parts)]
    return [[(b, 1) for b in g] if len({y - x for x, y in zip(g, g[1:], strict=False)}) > 1 else [(g[0], len(g))] for g in groups]


def bucket_keys(radius: int = RADIUS) -> list[list[tuple[int, int]]]:
    """Two of ``radius + 2`` blocks for each way to choose them: any linked pair agrees in one of these."""
    blocks = _cut([(0, BITS)], radius + 2)
    return [a + b for a, b in combinations(blocks, 2)]


def finer_keys(used: list[tuple[int, int]], radius: int = RADIUS) -> list[list[tuple[int, int]]]:
    """The same rule within the bits that ``used`` leaves, added to ``used``."""
    taken = {b for low, width in used for b in range(low, low + width)}
    rest = [(b, 1) for b in range(BITS) if b not in taken]
    return [used + a + b for a, b in combinations(_cut(rest, radius + 2), 2)]


def bit_planes(prints: np.ndarray, lane: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Vertical form: word ``[bit, block]`` holds that bit of the block's fingerprints, one a lane."""
    one = np.uint64(1)
    lanes = lane.astype(np.uint64)
    return np.stack([np.bitwise_or.reduceat(((prints >> np.uint64(b)) & one) << lanes, first) for b in range(BITS)])


def near_lanes(planes: np.ndarray, block: np.ndarray, query: np.ndarray, used: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each (block, query) pair the lanes within the radius, as a word.

    ``used`` has the lanes of each block that hold a fingerprint.
    """
    digits = (radius + 1).bit_length()
    result = np.zeros(len(block), np.uint64)
    live = np.arange(len(block))
    count = [np.zeros(len(block), np.uint64) for _ in range(digits)]
    over = np.zeros(len(block), np.uint64)
    lanes, words, prints = used[block], block, query
    for bit in range(BITS):
        wanted = np.uint64(0) - ((prints >> np.uint64(bit)) & np.uint64(1))
        carry = planes[bit, words] ^ wanted
        for digit in count:
            kept = digit & carry
            digit ^= carry
            carry = kept
        over |= carry  # the counter wrapped, so the lane stays out
        if bit % 8 == 7:
            stay = (lanes & ~(over | _above(count, radius))) != 0
            if not stay.all():
                live, over, lanes, words, prints = live[stay], over[stay], lanes[stay], words[stay], prints[stay]
                count = [digit[stay] for digit in count]
                if not len(live):
                    return result
    result[live] = lanes & ~over & ~_above(count, radius)
    return result


def _above(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter exceeds the radius."""
    above, equal = np.zeros_like(count[0]), np.full_like(count[0], ALL)
    for place in range(len(count) - 1, -1, -1):
        if radius >> place & 1:
            equal = equal & count[place]
        else:
            above = above | (equal & count[place])
            equal = equal & ~count[place]
    return above


def forest(prints: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each row the position of the smallest row it reaches within its group (rows sorted by group)."""
    rows = len(prints)
    root = np.arange(rows)
    begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[begins, rows])
    within = np.arange(rows) - np.repeat(begins, size)
    lane = within % BITS
    first = np.flatnonzero(lane == 0)
    planes = bit_planes(prints, lane, first)
    filled = np.diff(np.r_[first, rows]).astype(np.uint64)
    used = np.where(filled == BITS, ALL, (np.uint64(1) << (filled % np.uint64(BITS))) - np.uint64(1))
    # Row r meets the blocks of its own group that hold rows before it.
    blocks_before = np.searchsorted(first, np.repeat(begins, size))
    meets = within // BITS + 1
    ends = np.cumsum(meets)
    at = 0
    while at < rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        row = np.repeat(np.arange(at, to), meets[at:to])
        step = np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(meets[at:to])[:-1]], meets[at:to])
        block = blocks_before[row] + step
        near = near_lanes(planes, block, prints[row], used, radius)
        has = np.flatnonzero(near)
        bits = np.unpackbits(near[has].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        which, lanes = np.nonzero(bits)
        a, b = row[has[which]], first[block[has[which]]] + lanes
        below = b < a
        _unite(root, a[below], b[below])
        at = to
    return _flat(root)


def _flat(root: np.ndarray) -> np.ndarray:
    while True:
        up = root[root]
        if (up == root).all():
            return root
        root[:] = up


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of each pair; every root stays the smallest row of its tree."""
    while len(a):
        _flat(root)
        x, y = root[a], root[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))


def bucket_links(radius: int = RADIUS):
    """A function over batches sorted by ``key``: links ``(a, b)`` that span each bucket's components."""

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = pd.DataFrame({"key": np.empty(0, np.int64), "fp": np.empty(0, np.int64)})
        for batch in batches:
            joined = pd.concat([rest, batch[["key", "fp"]]], ignore_index=True)
            done = joined["key"] != joined["key"].iloc[-1]
            rest = joined[~done]
            yield from _spanning(joined[done], radius)
        yield from _spanning(rest, radius)

    return links


def _spanning(rows: pd.DataFrame, radius: int) -> Iterator[pd.DataFrame]:
    key = rows["key"].to_numpy(np.int64)
    again = np.r_[False, key[1:] == key[:-1]] if len(key) else np.empty(0, bool)
    many = again | np.r_[again[1:], False] if len(key) else again
    if not many.any():
        return
    key, prints = key[many], rows["fp"].to_numpy(np.int64)[many]
    root = forest(prints.view(np.uint64), key, radius)
    moved = root != np.arange(len(root))
    yield pd.DataFrame({"a": prints[moved], "b": prints[root[moved]]})


def fingerprint_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``(a, b)`` over the distinct fingerprints ``fp`` that connect all within the radius."""
    found = None
    tables = bucket_keys(radius)
    coarse = prints.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), _block_key(k).alias("k")) for i, k in enumerate(tables)])).alias("x")
    ).select("fp", F.xxhash64("x.t", "x.k").alias("key"), F.col("x.t").alias("t"))
    sizes = coarse.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = staged(sizes, "simhash-buckets")
    large = sizes.where(F.col("n") > LARGE_BUCKET).select("key")
    small = coarse.join(sizes.where(F.col("n") <= LARGE_BUCKET).select("key"), "key", "left_semi").select("key", "fp")
    hot = coarse.join(large, "key", "left_semi")
    parts = [
        hot.where(F.col("t") == i).select(
            "fp", F.explode(F.array(*[F.xxhash64(F.lit(j), F.col("key"), _block_key(k)) for j, k in enumerate(finer_keys(used, radius))])).alias("key")
        ).select("key", "fp")
        for i, used in enumerate(tables)
    ] if large.count() else []
    for part in [small, *parts]:
        found = part if found is None else found.union(part)
    return found.repartition("key").sortWithinPartitions("key").mapInPandas(bucket_links(radius), "a long, b long")


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Rows ``(id, fingerprint, component_id)`` for every row of ``df``."""
    docs = staged(df.select(F.col(id_col).alias("id"), simhash(text_col).alias("fp")), "simhash-prints")
    prints = staged(docs.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    links = fingerprint_links(prints.select("fp"), radius)
    roots = components(links).withColumnRenamed("node", "fp")
    rooted = staged(prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return docs.join(named, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))

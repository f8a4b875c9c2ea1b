"""TF-IDF of documents dealt to parts: rows of a document and a term are neither written nor shuffled.

Each part names its terms once, by hash, with the number of its documents that
have them.  These lists are dealt by ranges of the hash, where the lists of all
parts meet; each gets back its terms' document frequencies, in the order of the
list.  The part then splits its documents again and weighs them.  Only texts and
the two lists are shuffled.

Inside a part terms are told apart by their texts, between parts by 64 bits of
one keyed hash and 16 of another.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurelog.operators.skew import part_of

#: Parts whose lists together have about as many terms as one range of hashes.
PARTS_PER_RANGE = 2
HASH_KEY, CHECK_KEY = "terms of a part.", "as a second name"


class DealtTerms(NamedTuple):
    """``tokens(part, doc_id, terms)``, of documents that ``skew.dealt`` has dealt to parts, and which terms are kept."""

    tokens: DataFrame
    n_docs: int
    min_df: int
    max_df: float

    @property
    def labels(self) -> list[int]:
        return self.tokens.schema["part"].metadata["labels"]

    def frequencies(self) -> DataFrame:
        """``part, bucket, df``: the document frequencies of a part's terms in the order of their hashes, 0 where not kept."""
        buckets = max(self.tokens.sparkSession.sparkContext.defaultParallelism, len(self.labels) // PARTS_PER_RANGE)
        least, most = self.min_df, self.max_df * self.n_docs
        named = self.tokens.groupBy("part").applyInArrow(
            lambda tokens: _lists(_split(tokens), tokens["part"][0].as_py(), buckets),
            "part int, bucket int, hashes binary, checks binary, counts binary",
        )
        # As many partitions as ranges, so that no task grows with the table.
        return named.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(
            lambda lists: _summed_lists(lists, least, most), "part int, bucket int, df binary"
        )

    def weights(self) -> DataFrame:
        """``doc_id, term, df, weight``: rows of unit length."""
        n_docs = self.n_docs
        return self.tokens.groupBy("part").cogroup(self.frequencies().groupBy("part")).applyInArrow(
            lambda tokens, lists: _weight_table(_split(tokens), lists, n_docs),
            f"doc_id {self._type('doc_id')}, term string, df bigint, weight double",
        )

    def sums(self, clusters: DataFrame, least_df: Column) -> DataFrame:
        """``cluster, term, total``: sums of the weights of ``clusters(doc_id, cluster)``, for terms of ``least_df`` or more."""
        doc_id = F.col("doc_id").cast(self._type("doc_id")).alias("doc_id")
        known = clusters.where("doc_id IS NOT NULL AND cluster IS NOT NULL").groupBy(doc_id, "cluster").agg(F.count("*").alias("times"))
        known = known.select(part_of("doc_id", self.labels), "doc_id", "cluster", "times", least_df.cast("double").alias("least"))
        both = self.frequencies().unionByName(known, allowMissingColumns=True)
        n_docs = self.n_docs
        kind = clusters.schema["cluster"].dataType.simpleString()
        sums = self.tokens.groupBy("part").cogroup(both.groupBy("part")).applyInArrow(
            lambda tokens, lists: _cluster_sums(_split(tokens), lists, n_docs), f"cluster {kind}, term string, total double"
        )
        return sums.groupBy("cluster", "term").agg(F.sum("total").alias("total"))

    def _type(self, column: str) -> str:
        return self.tokens.schema[column].dataType.simpleString()


def _packed(values: np.ndarray) -> bytes:
    """First bytes, then second bytes and so on: those that are mostly zero lie together, which Spark's compression shortens."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _unpacked(packed: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _numbered(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """For each value a number, and the distinct values by number; nulls are one value."""
    coded = column.dictionary_encode(null_encoding="encode")
    numbers = [np.empty(0, np.int64), *[c.indices.to_numpy().astype(np.int64) for c in coded.chunks]]
    # The last chunk's dictionary has the values of all.
    values = coded.chunk(coded.num_chunks - 1).dictionary if coded.num_chunks else pa.array([], column.type)
    return np.concatenate(numbers), values


class _Split(NamedTuple):
    """Counted terms of a part: numbers of document and term in ascending order and how often; the documents, the terms."""

    doc: np.ndarray
    term: np.ndarray
    tf: np.ndarray
    docs: pa.Array
    terms: pa.Array


def _split(tokens: pa.Table) -> _Split:
    numbers, docs = _numbered(tokens["doc_id"])
    term, terms = _numbered(pc.list_flatten(tokens["terms"]))
    doc = np.repeat(numbers, pc.fill_null(pc.list_value_length(tokens["terms"]), 0).to_numpy())
    pairs, tf = np.unique(doc * len(terms) + term, return_counts=True)
    return _Split(*np.divmod(pairs, max(len(terms), 1)), tf, docs, terms)


def _hashed(terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and check of each term, and the order of terms by them."""
    texts = terms.to_numpy(zero_copy_only=False).astype(object)
    hashes = hash_array(texts, hash_key=HASH_KEY, categorize=False)
    checks = hash_array(texts, hash_key=CHECK_KEY, categorize=False).astype(np.uint16)
    return hashes, checks, np.lexsort((checks, hashes))


def _lists(part: _Split, label: int, buckets: int) -> pa.Table:
    """The list of one part, a row for each range of hashes."""
    hashes, checks, order = _hashed(part.terms)
    hashes, checks = hashes[order], checks[order]
    counts = np.bincount(part.term, minlength=len(hashes)).astype(np.uint32)[order]
    # Ranges of the hash, so that the ranges one after another are the list.
    bucket = (hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    ends = np.searchsorted(bucket, np.arange(buckets + 1))
    rows = []
    for b in np.flatnonzero(np.diff(ends)):
        own = slice(ends[b], ends[b + 1])
        steps = np.diff(hashes[own], prepend=np.uint64(0))
        rows.append({"part": label, "bucket": int(b), "hashes": _packed(steps), "checks": _packed(checks[own]), "counts": _packed(counts[own])})
    names = {"part": pa.int32(), "bucket": pa.int32(), "hashes": pa.binary(), "checks": pa.binary(), "counts": pa.binary()}
    return pa.Table.from_pylist(rows, pa.schema(names.items()))


def _summed_lists(lists: pa.Table, least: float, most: float) -> pa.Table:
    """The document frequencies for each list of one range of hashes."""
    counts = [_unpacked(x, np.uint32) for x in lists["counts"].to_pylist()]
    hashes = np.concatenate([np.cumsum(_unpacked(x, np.uint64)) for x in lists["hashes"].to_pylist()])
    checks = np.concatenate([_unpacked(x, np.uint16) for x in lists["checks"].to_pylist()])
    order = np.lexsort((checks, hashes))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(hashes[order]) != 0) | (np.diff(checks[order]) != 0)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    df = np.bincount(place, np.concatenate(counts)).astype(np.uint32)
    df[(df < least) | (df > most)] = 0
    parts = np.split(df[place], np.cumsum([len(c) for c in counts])[:-1])
    return lists.select(["part", "bucket"]).append_column("df", pa.array([_packed(p) for p in parts], pa.binary()))


def _weighed(part: _Split, lists: pa.Table, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the kept rows of a part, in the order of documents: numbers of document and term, df, weight."""
    lists = lists.filter(pc.is_valid(lists["df"])).sort_by("bucket")
    listed = np.concatenate([np.empty(0, np.uint32), *[_unpacked(x, np.uint32) for x in lists["df"].to_pylist()]])
    if len(listed) != len(part.terms):
        raise ValueError(f"{len(listed)} frequencies for {len(part.terms)} terms")
    df = np.empty(len(listed), np.int64)
    df[_hashed(part.terms)[2]] = listed
    kept = df[part.term] > 0
    doc, term = part.doc[kept], part.term[kept]
    raw = part.tf[kept] * (np.log((1 + n_docs) / (1 + df)) + 1)[term]
    return doc, term, df[term], raw / np.sqrt(np.bincount(doc, raw * raw))[doc]


def _weight_table(part: _Split, lists: pa.Table, n_docs: int) -> pa.Table:
    doc, term, df, weight = _weighed(part, lists, n_docs)
    return pa.table({"doc_id": part.docs.take(pa.array(doc)), "term": part.terms.take(pa.array(term)), "df": df, "weight": weight})


def _cluster_sums(part: _Split, lists: pa.Table, n_docs: int) -> pa.Table:
    """One part's sums by cluster and term."""
    doc, term, df, weight = _weighed(part, lists, n_docs)
    given = lists.filter(pc.is_valid(lists["cluster"]))
    found = pc.index_in(given["doc_id"], value_set=part.docs)
    given, found = given.filter(pc.is_valid(found)), found.drop_null().to_numpy()
    number, clusters = _numbered(given["cluster"])
    # The rows of each document lie together; every cluster it is given takes them all.
    begin, end = np.searchsorted(doc, found), np.searchsorted(doc, found, "right")
    size = end - begin
    owner = np.repeat(np.arange(len(found)), size)
    row = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
    enough = df[row] >= given["least"].to_numpy()[owner]
    owner, row = owner[enough], row[enough]
    keys, place = np.unique(number[owner] * max(len(part.terms), 1) + term[row], return_inverse=True)
    total = np.bincount(place, weight[row] * given["times"].to_numpy()[owner], len(keys))
    at, named = np.divmod(keys, max(len(part.terms), 1))
    return pa.table({"cluster": clusters.take(pa.array(at)), "term": part.terms.take(pa.array(named)), "total": total.astype(np.float64)})

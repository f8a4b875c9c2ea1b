"""Terms of session command sequences: dictionary, TF-IDF matrix, heaviest terms of clusters."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurelog.functions.text import command_doc, doc_terms, first_word, words
from lurelog.operators import skew
from lurelog.operators.dealt_terms import DealtTerms
from lurelog.staging import staged

INDEX_BUCKETS = 1024
# The heaviest terms are looked for among those that as large a part of a cluster's documents could make.
LIKELY_PART = 1 / 200


def sessions_for_clustering(sessions: DataFrame, min_commands: int = 3) -> DataFrame:
    """Sessions with enough commands; an unreadable count is 0."""
    if "num_commands" not in sessions.columns:
        return sessions
    enough = F.coalesce(F.col("num_commands").try_cast("double"), F.lit(0.0)) >= min_commands
    return sessions.filter(enough)


def session_docs(sessions: DataFrame) -> DataFrame:
    """``doc_id, doc`` from the ordered command list; text is taken as a single command."""
    textual = isinstance(sessions.schema["commands_seq"].dataType, T.StringType)
    lines = "array(commands_seq)" if textual else "commands_seq"
    return sessions.selectExpr("session_id AS doc_id", f"{command_doc(lines)} AS doc")


def doc_tokens(docs: DataFrame) -> DataFrame:
    """``doc_id, term``: every word and every pair of neighbouring words of ``doc``.

    Documents in parts stay one row each: ``part, doc_id, terms``.
    """
    if "part" in docs.columns:
        return docs.selectExpr("part", "doc_id", f"{doc_terms('doc')} AS terms")
    return docs.selectExpr("doc_id", f"explode({doc_terms('doc')}) AS term")


def item_tokens(items: DataFrame) -> DataFrame:
    """``doc_tokens`` from one row per command (``session_id, position, command``).

    Words and pairs inside a line come from that line; the pair across two lines
    needs only the last word of the line before.  No session is ever one list.
    """
    lines = items.filter("command IS NOT NULL").selectExpr(
        "session_id AS doc_id", "position", f"{first_word('command')} AS word"
    )
    tokens = lines.filter("char_length(word) >= 2").selectExpr(
        "doc_id", "position", f"{words('word')} AS ws"
    ).filter("size(ws) > 0").withColumn("last_word", F.element_at("ws", -1))
    linked = skew.with_previous(tokens, ["doc_id"], ["position"], "last_word", "before")
    linked = linked.withColumn(
        "ws", F.when(F.col("before").isNotNull(), F.concat(F.array("before"), "ws")).otherwise(F.col("ws"))
    )
    # The word carried over from the line before is not counted again by itself.
    skip = F.when(F.col("before").isNotNull(), 2).otherwise(1)
    # Written, as the counts and the dictionary both read it.
    return staged(linked.withColumn("skip", skip).select("doc_id", "ws", "skip"), "item-words").selectExpr(
        "doc_id",
        """explode(concat(slice(ws, skip, size(ws)),
                          zip_with(slice(ws, 1, size(ws) - 1), slice(ws, 2, size(ws)),
                                   (a, b) -> concat(a, ' ', b)))) AS term""",
    )


def term_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, term, tf`` over 1- and 2-grams; counting combines on the map side."""
    return doc_tokens(docs).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def item_term_counts(items: DataFrame) -> DataFrame:
    """``term_counts`` from one row per command."""
    return item_tokens(items).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"))


class TermMatrix(NamedTuple):
    """A TF-IDF matrix by numbers: ``terms(idx, term, df, idf)`` and ``weights(doc_id, idx, weight)``.

    Of documents in parts nothing is written: ``dealt`` makes both anew, and a
    term's hash is its number.
    """

    terms: DataFrame
    weights: DataFrame
    dealt: DealtTerms | None = None

    def named(self) -> DataFrame:
        """``doc_id, term, weight``; give written weights where they serve more than this."""
        if self.dealt is not None:
            return self.dealt.weights().select("doc_id", "term", "weight")
        return skew.lookup_join(self.weights, self.terms, "idx", "df").select("doc_id", "term", "weight")


def term_matrix(tokens: DataFrame, n_docs: int, min_df: int, max_df: float) -> TermMatrix:
    """The matrix of ``tokens(doc_id, term)``, rows of unit length.

    A term must occur in at least ``min_df`` documents and in at most the share
    ``max_df`` of them; idf is ``ln((1+n)/(1+df)) + 1``.

    Tokens with a ``part`` stay in it, see ``dealt_terms``.  Of others, texts of terms are shuffled once, for the dictionary, after each task has
    combined its own; give documents partitioned by ``doc_id``, and counting them
    shuffles nothing.  Rows find their terms by a 64-bit hash; two kept terms of
    one hash are an error, never a sum, and that a rare term has the hash of a
    kept one has a chance of one in 2^64 for each pair.  Kept terms are numbered from 0, and all that
    follows works on these numbers.  Terms of very many documents are joined by
    broadcast (see ``lookup_join``), so no join has a hot key.
    """
    idf = F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1
    if "part" in tokens.columns:
        dealt = DealtTerms(tokens, n_docs, min_df, max_df)
        rows = dealt.weights().withColumn("idx", F.xxhash64("term"))
        terms = rows.groupBy("idx", "term").agg(F.first("df").alias("df")).withColumn("idf", idf)
        return TermMatrix(terms, rows.select("doc_id", "idx", "weight"), dealt)
    counts = tokens.groupBy("doc_id", "term").agg(F.count("*").cast("int").alias("tf"))
    counts = staged(counts.select("doc_id", F.xxhash64("term").alias("hash"), "tf", "term"), "term-counts")
    kept = document_frequency(counts).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    found = staged(kept.withColumns({"hash": F.xxhash64("term"), "idf": idf}), "terms-kept")
    terms = staged(_numbered(found), "terms")
    weighted = skew.lookup_join(counts.drop("term"), terms.select("hash", "idx", "df", "idf"), "hash", "df").select(
        "doc_id", "idx", (F.col("tf") * F.col("idf")).alias("raw")
    )
    weighted = staged(weighted, "raw-weights")
    norms = weighted.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    # Both sides are written tables: a small norm table is broadcast, otherwise
    # adaptive execution can split the partition of a huge document.
    unit = weighted.join(staged(norms, "norms"), "doc_id").select("doc_id", "idx", (F.col("raw") / F.col("norm")).alias("weight"))
    return TermMatrix(terms.drop("hash"), unit)


def _numbered(terms: DataFrame) -> DataFrame:
    """Dense numbers ``idx`` 0…V-1, without sorting the terms in one task.

    Terms are numbered inside hash buckets; the buckets' offsets are a table of
    INDEX_BUCKETS rows.
    """
    bucketed = terms.withColumn("bucket", F.pmod("hash", F.lit(INDEX_BUCKETS)))
    before = Window.partitionBy().orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucketed.groupBy("bucket").agg(F.count("*").alias("n")).select(
        "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy("bucket").orderBy("hash", "term")
    clash = F.raise_error(F.concat(F.lit("another term has the hash of "), "term")).cast("int")
    place = F.when(F.lag("hash").over(inside) == F.col("hash"), clash).otherwise(F.row_number().over(inside))
    return (
        bucketed.withColumn("rn", place)
        .join(F.broadcast(offsets), "bucket")
        .withColumn("idx", F.col("offset") + F.col("rn") - 1)
        .drop("bucket", "rn", "offset")
    )


def top_terms(matrix: TermMatrix, clusters: DataFrame, n: int = 15) -> DataFrame:
    """Per cluster: size and the n heaviest terms of its mean vector.

    The mean counts documents without a term as zero; only terms that occur
    are listed.
    """
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n_sessions"))
    heaviest = Window.partitionBy("cluster").orderBy(F.desc("total"), "term")
    if matrix.dealt is not None:
        spelled = _dealt_sums(matrix.dealt, clusters, n)
    else:
        sums = (
            matrix.weights.join(clusters.select("doc_id", "cluster"), "doc_id")
            .groupBy("cluster", "idx")
            .agg(F.round(F.sum("weight"), 9).alias("total"))
        )
        # Terms that tie with the last are kept by number until their texts decide.
        near = Window.partitionBy("cluster").orderBy(F.desc("total"))
        few = sums.withColumn("place", F.rank().over(near)).filter(F.col("place") <= n)
        spelled = few.join(matrix.terms.select("idx", "term"), "idx")
    ranked = spelled.withColumn("rn", F.row_number().over(heaviest)).filter(F.col("rn") <= n)
    entries = F.array_sort(F.collect_list(F.struct("rn", "term")))
    listed = ranked.groupBy("cluster").agg(
        F.array_join(F.transform(entries, lambda e: e["term"]), ", ").alias("top_terms")
    )
    return sizes.join(listed, "cluster", "left").orderBy(F.desc("n_sessions"), "cluster")


def _dealt_sums(dealt: DealtTerms, clusters: DataFrame, n: int) -> DataFrame:
    """``cluster, term, total`` of all terms that can be among the n heaviest of a cluster.

    A weight is at most 1, so a sum is at most the term's document frequency,
    times the rows of a document that is given more than once.  Once n sums reach
    that bound of the terms left out, none of these is missed; where they do not,
    the n-th sum found is a bound that serves.
    """
    rows = clusters.where("doc_id IS NOT NULL AND cluster IS NOT NULL")
    sizes = {r["cluster"]: r["n"] for r in rows.groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    often = rows.groupBy("doc_id").count().agg(F.max("count")).first()[0] or 1
    bounds = {cluster: LIKELY_PART * size for cluster, size in sizes.items()}
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("total")))
    while True:
        bound = F.lit(0.0) if not bounds else F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair])[F.col("cluster")]
        sums = dealt.sums(rows, bound / often).select("cluster", "term", F.round("total", 9).alias("total"))
        sums = staged(sums, "cluster-sums")
        last = sums.withColumn("place", place).where(F.col("place") == n).collect()
        reached = dict.fromkeys(bounds, 0.0) | {r["cluster"]: r["total"] for r in last}
        if all(reached[c] > 1.001 * b or b == 0 for c, b in bounds.items()):
            return sums
        bounds = {c: 0.99 * r for c, r in reached.items()}

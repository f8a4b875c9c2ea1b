"""Clusters of session command sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurelog.operators import clusters as cl
from lurelog.operators.kmeans import kmeans
from lurelog.operators.projection import pca_2d
from lurelog.sinks import files, tables
from lurelog.staging import staged


def cluster_sessions(
    sessions: DataFrame, items: DataFrame, *, min_df: int, max_df: float, k: int = 8,
    min_commands: int = 3, seed: int = 42,
) -> dict[str, DataFrame]:
    """``sessions`` with their cluster, the cluster ``summary`` and 2-D ``coords``.

    ``items`` (see ``session_items``) has the commands of all sessions, one row each.
    """
    chosen = staged(cl.sessions_for_clustering(sessions, min_commands), "sessions")
    if chosen.isEmpty():
        raise ValueError("no session has enough commands")
    docs = chosen.select(F.col("session_id").alias("doc_id"))
    said = items.join(chosen.select("session_id"), "session_id", "left_semi")
    matrix = cl.term_matrix(cl.item_tokens(said), docs.count(), min_df, max_df)
    matrix = matrix._replace(weights=staged(matrix.weights, "weights"))  # read by every step below
    assigned = staged(kmeans(matrix.weights, docs, k, seed), "clusters")
    coords = pca_2d(matrix.weights, docs).join(assigned, "doc_id").select("doc_id", "x", "y", "cluster")
    labelled = chosen.join(assigned.withColumnRenamed("doc_id", "session_id"), "session_id")
    return {
        "sessions": labelled,
        "summary": cl.top_terms(matrix, assigned),
        "coords": coords,
    }


def cluster_and_write(sessions: DataFrame, items: DataFrame, out: str, **options) -> dict[str, DataFrame]:
    result = cluster_sessions(sessions, items, **options)
    tables.write_table(result["sessions"], f"{out}/session_clusters.parquet")
    files.write_csv(result["summary"], f"{out}/cluster_summary")
    files.write_csv(result["coords"].drop("doc_id"), f"{out}/cluster_coords_2d")
    return result

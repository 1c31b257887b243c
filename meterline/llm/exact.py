"""Exact de-duplication of documents with a heavy-hitter split (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize


def frequent_digests(digests: DataFrame, support: float) -> DataFrame:
    """Digests that may hold more than ``support`` of the rows, with their true counts and largest id.

    Misra-Gries (``freqItems`` keeps 1/support counters a task and merges them) finds every digest above the
    support and perhaps some below; a second aggregation counts the candidates exactly and drops the false ones.
    At most 1/support rows come back, however large the input is, so the result may be broadcast.
    """
    candidates = digests.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    counted = (
        digests.join(F.broadcast(candidates), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("hot_size"), F.max("doc_id").alias("hot_keep"))
    )
    return counted.filter(F.col("hot_size") > digests.count() * support)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.002) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; of equal texts the row with the largest id stays. Method: every text becomes a
    SHA-256 digest in its own task; Misra-Gries names the frequent digests; their verified winners (at most
    1/support rows) are broadcast, and all copies but the winner leave map-side; what remains is shuffled by digest,
    where no group holds more than ``support`` of the rows.

    A null text counts as empty. Ids may be null or repeated: a null id loses to any other; of rows with the same id
    and text exactly one stays (which one does not matter, they are the same); a group whose ids are all null keeps
    one row and has a null keep_id. An empty table gives no rows. Other columns are neither read nor returned.
    """
    digests = materialize(
        docs.select(F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("digest"))
    )
    hot = F.broadcast(materialize(frequent_digests(digests, support)))
    marked = digests.join(hot, "digest", "left")
    is_loser = F.col("hot_size").isNotNull() & F.coalesce(F.col("doc_id") < F.col("hot_keep"), F.col("hot_keep").isNotNull())
    losers = marked.filter(is_loser).select(
        "doc_id", F.col("hot_keep").alias("keep_id"), F.col("hot_size").alias("group_size"),
        F.lit(False).alias("kept"), F.col("digest").alias("text_sha256"),
    )
    group = Window.partitionBy("digest")
    rest = marked.filter(~is_loser).select(
        "doc_id",
        F.coalesce(F.col("hot_keep"), F.max("doc_id").over(group)).alias("keep_id"),
        F.coalesce(F.col("hot_size"), F.count(F.lit(1)).over(group)).alias("group_size"),
        (F.row_number().over(group.orderBy(F.col("doc_id").desc_nulls_last())) == 1).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    return losers.unionByName(rest)


#: DuckDB SQL for the whole result of exact_dedup over documents.
EXACT_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

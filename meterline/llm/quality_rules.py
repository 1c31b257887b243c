"""Quality rules: base limits, then gradient-boosted trees over document statistics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbdt
from .common import per_text
from .statistics import BASE, FEATURES, labelled_features, statistics_frame


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_rows: int = 6000,
    threshold: float = 0.5,
) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    base_failed: fewer than 50 words, or over half of the words lie in repeated 3-word windows. kept: not base_failed
    and the trees' probability of good quality is at least ``threshold``. The trees are fitted on at most
    ``sample_rows`` labelled documents (column ``quality``), chosen by a hash of their ids; the quality never rises
    with symbols, repeated lines, repeated words, capitals, shouts or digits (see statistics.FEATURES). Every document
    is scored whole, in one pass without a shuffle; the trees are a few thousand numbers.

    A null text has no words. Without labels of both classes the trees give one probability for all rows. Repeated
    rows give repeated results, an empty table none; other columns are neither read nor returned.
    """
    x, y = labelled_features(docs, labels, "quality", sample_rows, id_col, text_col)
    model = gbdt.fit(x, y, list(FEATURES.values()))

    def make():
        def work(texts: list[str | None]) -> pd.DataFrame:
            found = statistics_frame(texts)
            out = found[BASE].copy()
            out["score"] = gbdt.sigmoid(model.logit(found[list(FEATURES)].to_numpy(float)))
            return out

        return work

    scored = per_text(docs, make, ", ".join(f"{c} long" for c in BASE) + ", score double", id_col, text_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.select(
        "doc_id", *BASE, failed.alias("base_failed"), F.round("score", 6).alias("score"),
        (~failed & (F.col("score") >= threshold)).alias("kept"),
    )

"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbdt
from .common import materialize, per_text, slices
from .statistics import FEATURES, labelled_features, sampled_labels, statistics_frame

WORDS = re.compile(r"\w+")


def distinct_words(text: str | None) -> set[str]:
    return set(WORDS.findall(text.lower())) if text else set()


def toxic_lexicon(docs: DataFrame, picked: DataFrame, entries: int, least: int) -> dict[str, float]:
    """Words that mark toxic documents, with their log likelihood ratios, from the sampled labelled documents.

    A word counts once a document. Kept are the ``entries`` words of most evidence among those in at least ``least``
    toxic documents that are e^2 times likelier there than elsewhere.
    """
    own = docs.join(F.broadcast(picked), "label_id").select("text", "label")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = 0
            for part in slices(batch["text"]):
                held: dict[str, list[int]] = {}
                for text, label in zip(part, batch["label"].iloc[at : at + len(part)], strict=True):
                    for w in distinct_words(text):
                        held.setdefault(w, [0, 0])[int(label)] += 1
                at += len(part)
                yield pd.DataFrame([(w, a, b) for w, (a, b) in held.items()], columns=["word", "clean", "toxic"])

    size = {r["label"]: r["n"] for r in picked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = own.mapInPandas(run, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    ratio = F.log((F.col("t") + 0.5) / (size.get(1, 0) + 1.0)) - F.log((F.col("c") + 0.5) / (size.get(0, 0) + 1.0))
    top = counts.filter(F.col("t") >= least).withColumn("llr", ratio).filter("llr >= 2").orderBy(F.desc(F.col("t") * F.col("llr")), "word").limit(entries)
    return {r["word"]: float(r["llr"]) for r in top.collect()}


def beta_strength(means: DataFrame) -> tuple[float, float]:
    """Mean and strength of the Beta prior over groups (columns n, bad) by the method of moments.

    One row of sums comes to the driver. Groups that do not differ more than chance would explain get the largest
    strength, one group or none the least, so a sparse group leans on its parent.
    """
    r = means.agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("groups"),
        F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("square"), F.sum(1 / F.col("n")).alias("inverse"),
        F.sum(F.col("n") * F.col("n")).alias("n2"),
    ).first()
    if not r["n"]:
        return 0.5, 10.0
    mean = min(max(r["bad"] / r["n"], 1e-4), 1 - 1e-4)
    if r["groups"] < 2:
        return mean, 10.0
    between = max(0.0, r["square"] - r["n"] * mean * mean - (r["groups"] - 1) * mean * (1 - mean))
    spread = max(between / max(1e-9, r["n"] - r["n2"] / r["n"]), 1e-7)
    return mean, float(min(max(mean * (1 - mean) / spread - 1, 10.0), 1e5))


def document_evidence(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample_rows: int, entries: int, least: int
) -> DataFrame:
    """doc_id, p_low, p_toxic for every row, by models of the sampled labelled rows."""
    x, y = labelled_features(docs, labels, "quality", sample_rows, id_col, text_col)
    low = gbdt.fit(x, 1 - y, [-d for d in FEATURES.values()])
    picked = materialize(sampled_labels(labels, "toxic", sample_rows))
    own = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text"))
    lexicon = toxic_lexicon(own, picked, entries, least)

    def found(texts: list[str | None]) -> np.ndarray:
        return np.array([sum([lexicon[w] for w in distinct_words(t) & lexicon.keys()]) for t in texts], dtype=float)

    sample = own.join(F.broadcast(picked), "label_id").select(F.struct("label_id", "label").alias("doc"), "text")
    seen = per_text(sample, lambda: lambda t: pd.DataFrame({"found": found(t)}), "found double", "doc", "text")
    seen = seen.select("doc_id.label_id", "doc_id.label", "found").toPandas().sort_values(["label_id", "found"])
    toxic = gbdt.fit(seen[["found"]].to_numpy(float), seen["label"].to_numpy(float), [1], trees=40, depth=2, rate=0.3, least=0.5)

    def make():
        def work(texts: list[str | None]) -> pd.DataFrame:
            z = low.logit(statistics_frame(texts)[list(FEATURES)].to_numpy(float))
            return pd.DataFrame({"p_low": gbdt.sigmoid(z), "p_toxic": gbdt.sigmoid(toxic.logit(found(texts)[:, None]))})

        return work

    return per_text(docs, make, "p_low double, p_toxic double", "doc", text_col)


def classify_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    threshold: float = 0.5,
    sample_rows: int = 6000,
    entries: int = 400,
    least: int = 5,
) -> DataFrame:
    """Per document: doc_id, p_low, p_toxic, site (posterior of its host and path), p_bad, kept.

    Evidence: trees over the statistics of the whole text for low quality, and log likelihood ratios of the toxic
    words in it. The models are fitted on at most ``sample_rows`` labelled ids, chosen by hash. Every document's
    evidence is then summed by host and path; a path's share of bad documents is shrunk to its host's and that to the
    global share, with strengths estimated from all groups, so a site of few documents changes nothing. The site's
    log-odds against the global ones shift each head's log-odds; a document is kept if p_bad is below ``threshold``.

    A text of no words has no toxic evidence. Null hosts and paths are groups of their own. Repeated rows give
    repeated results and count each time; an empty table gives no rows; without labels of both classes a head says
    the same of all documents. Other columns are neither read nor returned.
    """
    own = docs.select(
        F.struct(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(path_col).alias("path")).alias("doc"),
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
    )
    scored = document_evidence(own, labels, "doc_id", "text", sample_rows, entries, least)
    scored = materialize(scored.select("doc_id.doc_id", "doc_id.host", "doc_id.path", "p_low", "p_toxic"))
    bad = 1 - (1 - F.col("p_low")) * (1 - F.col("p_toxic"))
    paths = materialize(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(bad * 1e9).cast("long")).alias("parts")))
    paths = paths.withColumn("bad", F.col("parts") / 1e9)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), (F.sum("parts") / 1e9).alias("bad"))
    mean, host_strength = beta_strength(hosts)
    path_strength = beta_strength(paths)[1]
    site_of_host = hosts.select(F.col("host").alias("of"), ((mean * host_strength + F.col("bad")) / (host_strength + F.col("n"))).alias("at_host"))
    site = (
        paths.join(site_of_host, F.col("host").eqNullSafe(F.col("of")))
        .select(
            F.col("host").alias("h"), F.col("path").alias("p"),
            ((F.col("at_host") * path_strength + F.col("bad")) / (path_strength + F.col("n"))).alias("site"),
        )
    )
    joined = scored.join(site, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))

    def logit(c):
        c = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), c))
        return F.log(c / (1 - c))

    shift = logit(F.col("site")) - float(np.log(mean / (1 - mean)))
    heads = [1 / (1 + F.exp(-(logit(F.col(c)) + shift))) for c in ("p_low", "p_toxic")]
    p_bad = 1 - (1 - heads[0]) * (1 - heads[1])
    return joined.select(
        "doc_id", F.round("p_low", 6).alias("p_low"), F.round("p_toxic", 6).alias("p_toxic"), F.round("site", 6).alias("site"),
        F.round(p_bad, 6).alias("p_bad"), (p_bad < threshold).alias("kept"),
    )


def kept_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, columns unchanged; rows that share an id stay if one of them does."""
    kept = classify_quality(docs, labels, id_col, **how).filter("kept").select(F.col("doc_id").alias("_id"))
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col("_id")), "left_semi")

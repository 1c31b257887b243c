"""Statistics of whole texts, for the quality operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, per_text

SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Features of the trees, each with the direction in which quality may move as it grows (0: free).
FEATURES = {
    "log_words": 0,
    "mean_word": 0,
    "symbols_a_word": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": -1,
    "shouts_a_word": -1,
    "digit_share": -1,
    "distinct_share": 0,
    "words_a_line": 0,
    "stops_a_word": 0,
    "other_share": 0,
}


def repeated_words(words: list[bytes], width: int = 3) -> tuple[int, int]:
    """Words inside windows of ``width`` words that occur twice or more, first occurrences included; distinct words."""
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    n, kinds = len(ids) - width + 1, len(number)
    if n < 2:
        return 0, kinds
    key = ids[:n]
    for k in range(1, width):
        if kinds > 1 and key.max() >= (1 << 62) // kinds:  # a very long text: keep the keys within 63 bits
            key = np.unique(key, return_inverse=True)[1]
        key = key * kinds + ids[k : n + k]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0, kinds
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(width):
        covered[k : n + k] |= twice
    return int(covered.sum()), kinds


def text_statistics(text: str | None) -> list[float]:
    """The base counts, then the features. A null text has none of anything."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen: set[str] = set()
    dup = filled = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            filled += 1
            dup += line in seen
            seen.add(line)
    repeats, kinds = repeated_words(words)
    byte = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    upper, lower, digits = int(byte[65:91].sum()), int(byte[97:123].sum()), int(byte[48:58].sum())
    per = 1.0 / max(1, n)
    return [
        n, chars, symbols, dup, repeats,
        np.log1p(n), chars * per, symbols * per, dup / max(1, filled), repeats * per, upper / max(1, upper + lower),
        int(byte[33] + byte[63]) * per, digits / max(1, chars), kinds * per, n / max(1, filled), int(byte[46]) * per,
        int(byte[128:192].sum()) / max(1, chars),
    ]


def statistics_frame(texts: list[str | None]) -> pd.DataFrame:
    rows = np.array([text_statistics(t) for t in texts], dtype=float).reshape(len(texts), len(BASE) + len(FEATURES))
    return pd.DataFrame(rows, columns=[*BASE, *FEATURES]).astype(dict.fromkeys(BASE, "int64"))


def sampled_labels(labels: DataFrame, column: str, rows: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``rows`` labelled ids, the same ones each time: those of least hash. Two labels of one id: the larger."""
    return (
        labels.filter(F.col(column).isNotNull() & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("label_id"), F.col(column).cast("int").alias("label"), F.xxhash64(id_col).alias("place"))
        .groupBy("label_id", "place").agg(F.max("label").alias("label"))
        .orderBy("place", "label_id").limit(rows).select("label_id", "label")
    )


def labelled_features(docs: DataFrame, labels: DataFrame, column: str, rows: int, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the sampled rows. The sample has at most ``rows`` ids, so its ids may be broadcast and
    its numbers collected."""
    picked = F.broadcast(sampled_labels(labels, column, rows))
    own = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text")).join(picked, "label_id")
    own = own.select(F.struct("label_id", "label").alias("doc"), "text")

    def make():
        return lambda texts: statistics_frame(texts)[list(FEATURES)]

    found = per_text(own, make, ", ".join(f"{f} double" for f in FEATURES), "doc", "text")
    got = found.select("doc_id.label_id", "doc_id.label", *FEATURES).toPandas()
    got = got.sort_values(["label_id", *FEATURES])
    return got[list(FEATURES)].to_numpy(float), got["label"].to_numpy(float)

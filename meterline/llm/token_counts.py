"""Token counts with a two-tier lookup that never shuffles pre-tokens."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_CHARS, materialize, per_text, slices
from .pieces import chunks

#: Summaries that one task adds up.
FAN = 16


def summarized(counts: Iterator[tuple[str, int]], held: Counter[str], most: int) -> None:
    """Adds chunks with their counts to a Misra-Gries summary of at most ``most`` chunks."""
    for chunk, n in counts:
        held[chunk] += n
    if len(held) > most:  # take the count of the first chunk beyond the limit off all of them
        cut = sorted(held.values(), reverse=True)[most]
        left = {c: n - cut for c, n in held.items() if n > cut}
        held.clear()
        held.update(left)


def frequent_chunks(docs: DataFrame, entries: int, per_task: int, longest: int) -> list[str]:
    """The most frequent chunks of all texts.

    Each task keeps a Misra-Gries summary, at most ``per_task`` chunks of up to ``longest`` characters, of all its texts:
    the texts stay where they lie. Summaries are written and added up by FAN, level by level, until one task holds the
    last one: no pre-token is shuffled, and at most ``per_task`` short rows come back, whatever the input.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[str] = Counter()
        for batch in batches:
            for part in slices(batch["text"]):
                found: Counter[str] = Counter()
                for text in part:
                    found.update(chunks(text))
                summarized(((c, n) for c, n in found.items() if len(c) <= longest), held, per_task)
        if held:
            yield pd.DataFrame({"chunk": list(held), "n": list(held.values())})
        pa.default_memory_pool().release_unused()

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[str] = Counter()
        for batch in batches:
            summarized(zip(batch["chunk"], batch["n"].tolist(), strict=True), held, per_task)
        if held:
            yield pd.DataFrame({"chunk": list(held), "n": list(held.values())})

    made = "chunk string, n long"
    written = materialize(docs.select("text").mapInPandas(count, made))
    while (parts := len(written.inputFiles())) > FAN:
        written = materialize(written.coalesce(-(-parts // FAN)).mapInPandas(add, made))
    summaries = written.coalesce(1).mapInPandas(add, made)
    total = {r["chunk"]: r["n"] for r in summaries.toLocalIterator()}
    return sorted(total, key=lambda c: (-total[c], c))[:entries]


def chunk_lengths(encoder, words: list[str]) -> list[int]:
    """Token counts of chunks by the library. A newline in front keeps its added space apart: two tokens to take off."""
    return [len(ids) - 2 for ids in encoder.encode(["\n" + w for w in words], num_threads=1)]


class Lengths:
    """Token count of each chunk: the frequent table, then what this worker has met. Chunks met for the first time are
    encoded together, a slice of texts at a time."""

    def __init__(self, table: dict[str, int], encoder, limit: int):
        self.table, self.encoder, self.limit = table, encoder, limit
        self.known, self.chars = dict(table), 0

    def learn(self, lists: list[list[str]]) -> dict[str, int]:
        wanted = set().union(*lists) if lists else set()
        new = [c for c in wanted if c not in self.known]
        if len(self.known) + len(new) > len(self.table) + self.limit or self.chars > CACHE_CHARS:
            self.known, self.chars = dict(self.table), 0
            new = [c for c in wanted if c not in self.known]
        self.chars += sum(map(len, new))
        self.known.update(zip(new, chunk_lengths(self.encoder, new), strict=True) if new else ())
        return self.known


def count_tokens(
    docs: DataFrame,
    model_path: str,
    limit: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    entries: int = 30_000,
    per_task: int = 20_000,
    cache: int = 300_000,
    longest: int = 48,
) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit, as the sentencepiece library counts whole texts.

    The frequent table (``entries`` chunks of up to ``longest`` characters and their counts, some MB at most, from
    summaries of all texts) is broadcast; workers encode other chunks with the library and remember up to ``cache`` of
    them. The table only saves time: the counts do not depend on it. A null or empty text has 0 bytes and 0 tokens. Repeated rows give repeated results, an empty
    table none; other columns are neither read nor returned.
    """
    import sentencepiece

    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    words = frequent_chunks(texts, entries, per_task, longest)
    here = sentencepiece.SentencePieceProcessor(model_file=model_path)
    sizes = chunk_lengths(here, words) if words else []
    shared = spark.sparkContext.broadcast((words, np.array(sizes, dtype=np.uint32)))

    def make():
        encoder = sentencepiece.SentencePieceProcessor(model_file=model_path)
        frequent, sizes = shared.value
        lengths = Lengths(dict(zip(frequent, sizes.tolist(), strict=True)), encoder, cache)

        def work(texts: list[str | None]) -> pd.DataFrame:
            lists = [chunks(t) for t in texts]
            look = lengths.learn(lists).__getitem__
            tokens = [sum(map(look, cs)) for cs in lists]
            size = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            return pd.DataFrame({"n_bytes": size, "n_tokens": tokens, "over_limit": [n > limit for n in tokens]})

        return work

    return per_text(docs, make, "n_bytes long, n_tokens long, over_limit boolean", id_col, text_col)

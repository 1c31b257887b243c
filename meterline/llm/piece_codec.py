"""Encoding documents into sentencepiece ids and back, with vectorised merge rounds."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame

from .common import CACHE_CHARS, per_text
from .pieces import SPACE, chunks, vocabulary

#: Chunks that a worker remembers, at most.
CACHE_CHUNKS = 400_000


class ChunkEncoder:
    """Ids of chunks, remembered per worker; what is not remembered goes through merge rounds, many at once."""

    def __init__(self, model_path: str, cache_chunks: int = CACHE_CHUNKS):
        self.vocabulary, self.limit = vocabulary(model_path), cache_chunks
        #: Ids of each chunk as text, and the decoded text of those that don't decode to themselves: most do, so a
        #: remembered chunk costs two short strings.
        self.ids: dict[str, str] = {}
        self.odd: dict[str, str] = {}
        self.chars = 0

    def learn(self, lists: list[list[str]]) -> None:
        """Remembers all chunks of the lists."""
        wanted = set().union(*lists) if lists else set()
        if len(self.ids) + len(wanted) > self.limit or self.chars > CACHE_CHARS:
            self.ids, self.odd, self.chars = {}, {}, 0
        new = [c for c in wanted if c not in self.ids]
        self.chars += sum(map(len, new))
        mark = self.vocabulary.symbol[SPACE]
        for c, ids in zip(new, self.vocabulary.encode_chunks(new), strict=True):
            self.ids[c] = ",".join(map(str, ids))
            # A mark in front keeps decode() from taking off the chunk's own space.
            decoded = self.vocabulary.decode([mark, *ids])
            if decoded != c.replace(SPACE, " "):
                self.odd[c] = decoded

    def joined_ids(self, cs: list[str]) -> str:
        """Ids of a text's remembered chunks, joined by commas."""
        known = self.ids
        return ",".join([known[c] for c in cs])

    def decoded(self, cs: list[str]) -> str:
        """Decoded text of a text's remembered chunks, without the library's space in front."""
        if not self.odd.keys().isdisjoint(cs):
            return "".join([self.odd[c] if c in self.odd else c.replace(SPACE, " ") for c in cs])[1:]
        return "".join(cs).replace(SPACE, " ")[1:]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, ids (array of int), decoded (string). The operator's own output.

    Ids equal the library's encode() without begin and end ids; decoded equals its decode(ids). A null or empty text
    has no ids and decodes to the empty string. Repeated rows give repeated results; an empty table gives none; other
    columns are neither read nor returned. One pass, no shuffle; a long text costs n log n steps and its own length
    in memory.
    """

    def make():
        encoder = ChunkEncoder(model_path)

        def work(texts: list[str | None]) -> pd.DataFrame:
            lists = [chunks(t) for t in texts]
            encoder.learn(lists)
            return pd.DataFrame({
                "ids": [[int(i) for c in cs for i in encoder.ids[c].split(",")] for cs in lists],
                "decoded": [encoder.decoded(cs) for cs in lists],
            })

        return work

    return per_text(docs, make, "ids array<int>, decoded string", id_col, text_col)


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256; the same work as encode_documents, but only digests leave the task."""

    def make():
        encoder = ChunkEncoder(model_path)

        def work(texts: list[str | None]) -> pd.DataFrame:
            counts, ids, decoded = [], [], []
            lists = [chunks(t) for t in texts]
            encoder.learn(lists)
            for cs in lists:
                joined = encoder.joined_ids(cs)
                counts.append(joined.count(",") + 1 if joined else 0)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(encoder.decoded(cs).encode("utf-8", "surrogatepass")).hexdigest())
            return pd.DataFrame({"n_tokens": counts, "ids_sha256": ids, "decoded_sha256": decoded})

        return work

    return per_text(docs, make, "n_tokens long, ids_sha256 string, decoded_sha256 string", id_col, text_col)

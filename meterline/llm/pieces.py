"""A sentencepiece BPE vocabulary as flat arrays, the split of texts into independent chunks, and vectorised merges.

The vocabulary is read through the sentencepiece library; encoding and decoding are done here.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

SPACE = "▁"
#: Pieces hold the space mark only at their front and never hold a newline, so no merge crosses these borders.
CHUNK = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+")
NONE = np.int64(1) << 40


def chunks(text: str | None) -> list[str]:
    """The chunks of a text after the library's normalisation (one space in front, spaces as marks)."""
    return CHUNK.findall(SPACE + text.replace(" ", SPACE)) if text else []


class PieceVocabulary:
    """Pieces, scores and merge table of one BPE model with byte fallback and identity normalisation."""

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = sp.get_piece_size()
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) for i in range(size)]
        self.piece = [sp.id_to_piece(i) for i in range(size)]
        self.byte_id = {int(self.piece[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        normal = {self.piece[i]: i for i in range(size) if not special[i]}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in normal):
            raise ValueError("the chunk borders don't hold for this vocabulary")
        chars = sorted({c for p in normal for c in p} - normal.keys())
        #: Symbols: the pieces, then single characters that occur only inside longer pieces.
        self.symbol = normal | {c: size + k for k, c in enumerate(chars)}
        self.size, self.text_of = size, {i: p for p, i in self.symbol.items()}
        scores = sorted({sp.get_score(i) for i in normal.values()}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}  # equal scores share a rank: the leftmost pair goes first
        self.width = size + len(chars)
        pairs: dict[int, tuple[int, int]] = {}
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = self.symbol.get(p[:k]), self.symbol.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = (place[sp.get_score(i)], i)
        # Where no pair that holds the made symbol ranks before it, all pairs of that rank may merge in the same round.
        least_use: dict[int, int] = {}
        for k, (r, _) in pairs.items():
            for part in divmod(k, self.width):
                least_use[part] = min(r, least_use.get(part, r))
        self.together = np.ones(len(scores) + 1, dtype=bool)
        for r, made in pairs.values():
            self.together[r] &= least_use.get(made, r + 1) > r
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.rank = np.array([pairs[k][0] for k in self.keys.tolist()] + [NONE], dtype=np.int64)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()] + [-1], dtype=np.int64)
        single = sorted((ord(s), i) for s, i in self.symbol.items() if len(s) == 1)
        self.code = np.array([c for c, _ in single], dtype=np.int64)
        self.code_id = np.array([i for _, i in single], dtype=np.int64)

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair in the merge table, or that of its last entry (no merge)."""
        key = left * self.width + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), at, len(self.keys))

    def _symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat symbols and their word numbers; a character outside the vocabulary is minus its code point."""
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        symbols = np.where(self.code[at] == code, self.code_id[at], -code - 1)
        return symbols, np.repeat(np.arange(len(words)), [len(w) for w in words])

    def merge_rounds(self, words: list[str]) -> list[list[int]]:
        """Symbols of each word after all merges. In each round every word merges its pairs of least rank from the left, all
        words at once; finished words leave the arrays. The library merges one pair at a time, the leftmost of least
        rank. Where every pair that holds the new symbol ranks behind it (``together``, looked up for each rank when the
        vocabulary is read), or those that it forms with the symbols beside it do, it takes all pairs of that rank before
        any other, so they merge in one round; else the word's leftmost pair merges alone."""
        out: list[list[int]] = [[] for _ in words]
        symbols, word = self._symbols(words)
        while len(symbols):
            same = word[1:] == word[:-1]
            pair = np.where(same, self._find(symbols[:-1], symbols[1:]), len(self.keys))
            rank = np.append(self.rank[pair], NONE)
            starts = np.flatnonzero(np.append(True, ~same))
            least = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(symbols)))
            done = np.repeat(least == NONE, lengths)
            if done.any():
                for k in np.flatnonzero(least == NONE):
                    s = starts[k]
                    out[word[s]] = symbols[s : s + lengths[k]].tolist()
            hits = np.flatnonzero((rank == np.repeat(least, lengths)) & ~done)
            # of pairs that overlap every second one from the left, or the first of the word alone
            opens = np.append(True, hits[1:] != hits[:-1] + 1)[: len(hits)]
            leads = np.append(True, word[hits][1:] != word[hits][:-1])[: len(hits)]
            place = np.arange(len(hits))
            odd = (place - np.maximum.accumulate(np.where(opens, place, 0))) % 2 == 1
            # a rank with earlier uses of its symbol: those that its merges would make here decide
            several = ~odd & ~self.together[rank[hits]]
            if several.any():
                at, new = hits[several], self.made[pair[hits[several]]]
                after = np.append(symbols, [-1, -1])
                left = np.where(np.isin(at - 2, at) & same[at - 1], new, np.where((at > 0) & same[at - 1], symbols[at - 1], -1))
                right = np.where(np.append(same, [False, False])[at + 1], after[at + 2], -1)
                sooner = np.minimum(self.rank[self._find(left, new)], self.rank[self._find(new, right)]) <= rank[at]
                odd |= np.isin(word[hits], word[at[sooner]]) & ~leads
            first = hits[~odd]
            symbols = symbols.copy()
            symbols[first] = self.made[pair[first]]
            keep = ~done
            keep[first + 1] = False
            symbols, word = symbols[keep], word[keep]
        return out

    def ids(self, symbols: list[int]) -> list[int]:
        """Piece ids of merged symbols; what has no piece becomes the bytes of its UTF-8 form."""
        out = []
        for s in symbols:
            if 0 <= s < self.size:
                out.append(s)
            else:
                char = chr(-s - 1) if s < 0 else self.text_of[s]
                out.extend(self.byte_id[b] for b in char.encode("utf-8", "surrogatepass"))
        return out

    def encode_chunks(self, words: list[str]) -> list[list[int]]:
        """Ids of each chunk."""
        return [self.ids(symbols) for symbols in self.merge_rounds(words)] if words else []

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces and byte runs joined, marks as spaces, the added space in front dropped."""
        out, run = [], bytearray()
        for i in ids:
            p = self.piece[i]
            if len(p) == 6 and p[:3] == "<0x" and self.byte_id.get(int(p[3:5], 16)) == i:
                run.append(int(p[3:5], 16))
            else:
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run = bytearray()
                out.append(p)
        if run:
            out.append(run.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def vocabulary(model_path: str) -> PieceVocabulary:
    """One vocabulary per worker process and model file."""
    return PieceVocabulary(model_path)

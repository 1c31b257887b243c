"""A run-compressed Burrows-Wheeler index of many short pieces of text, and matching statistics streamed against it.

Pieces are byte strings without 0xFF (which UTF-8 never holds). The transform is that of the pieces with a separator
behind each; a separator is larger than any byte, an earlier piece's smaller than a later one's.
"""

from __future__ import annotations

import numpy as np

SEPARATOR = 0xFF
WORD = 8
#: Owner of what occurs nowhere.
NOBODY = np.iinfo(np.int64).max


def laid_out(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, starts): pieces of ``flat`` that end at ``ends``, each followed by a separator, some more at the end."""
    lengths = np.diff(ends, prepend=0)
    text = np.full(len(flat) + len(ends) + 2 * WORD, SEPARATOR, dtype=np.uint8)
    text[np.arange(len(flat)) + np.repeat(np.arange(len(ends)), lengths)] = flat
    return text, ends - lengths + np.arange(len(ends))


def words_at(text: np.ndarray, n: int, kind: str) -> np.ndarray:
    """The eight bytes at each of the first ``n`` places as a number."""
    return np.ndarray((n,), np.dtype(kind), buffer=text, strides=(1,)).astype(kind[1:])


def sorted_suffixes(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(suffix array, classes, reach): by prefix doubling from eight bytes on. Two suffixes of one class agree on
    ``reach`` bytes, the largest doubled length that is no more than ``depth``."""
    n = int(starts[-1] + lengths[-1] + 1)
    stops = starts + lengths
    stop = np.repeat(stops, lengths + 1)  # the separator behind each place
    left = stop - np.arange(n)
    key = words_at(text, n, ">u8")
    cut = left < WORD
    key[cut] |= (np.uint64(1) << ((WORD - left[cut]) * 8).astype(np.uint64)) - np.uint64(1)  # what lies behind it is not seen
    order = np.argsort(key)
    order[n - len(starts) :] = stops  # separators are the largest; they differ by their pieces
    ordered = key[order]
    fresh = np.ones(n, dtype=bool)
    np.not_equal(ordered[1:], ordered[:-1], out=fresh[1:])
    fresh[n - len(starts) :] = True
    piece = np.repeat(np.arange(len(starts)), lengths + 1)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))  # the first row of a suffix's class
    at, classes, reach = WORD, rank, WORD
    slots = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))  # rows whose suffixes others still equal
    while len(slots):
        open_ = order[slots]
        ahead = open_ + at
        within = ahead <= stop[open_]
        follow = np.where(within, rank[np.where(within, ahead, 0)], n - len(starts) + piece[open_])
        key = (rank[open_].astype(np.uint64) << np.uint64(32)) | follow.astype(np.uint64)
        turn = np.argsort(key)
        key = key[turn]
        fresh = np.ones(len(slots), dtype=bool)
        np.not_equal(key[1:], key[:-1], out=fresh[1:])
        order[slots] = open_[turn]
        rank = rank.copy() if rank is classes else rank
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        at *= 2
        if at <= depth:
            classes, reach = rank, at
        slots = slots[~(fresh & np.append(fresh[1:], True))]
    return order, classes, reach


class RunIndex:
    """Runs of the transform with the text's places at both of their ends.

    Runs are also cut where the next row's suffix begins with other ``length`` bytes, so all rows of a run whose
    suffixes have that many belong to one string, and ``first`` holds its least owner in the whole index.
    """

    def __init__(self, flat: np.ndarray, ends: np.ndarray, owners: np.ndarray, length: int) -> None:
        self.length = length
        self.text, self.starts = laid_out(flat, ends)
        lengths = np.diff(ends, prepend=0)
        suffixes, classes, reach = sorted_suffixes(self.text, self.starts, lengths, length)
        n = len(suffixes)
        before = self.text[np.maximum(suffixes - 1, 0)]
        before[suffixes == 0] = SEPARATOR
        left = np.repeat(self.starts + lengths, lengths + 1) - np.arange(n)
        whole = (left >= length)[suffixes]
        near, far = classes[suffixes], classes[np.minimum(suffixes + length - reach, n - 1)]
        begins = np.ones(n, dtype=bool)  # rows that begin another string of ``length`` bytes
        equal = (near[1:] == near[:-1]) & (far[1:] == far[:-1])
        begins[1:] = (whole[1:] != whole[:-1]) | whole[1:] & ~equal  # shorter suffixes need no telling apart
        groups = np.flatnonzero(begins)
        owner = np.where(whole, np.repeat(owners, lengths + 1)[suffixes], NOBODY)
        least = np.minimum.reduceat(owner, groups)

        cuts = begins.copy()
        cuts[1:] |= before[1:] != before[:-1]
        self.rows = np.flatnonzero(cuts)
        self.chars = before[self.rows]
        self.head = suffixes[self.rows]
        self.tail = suffixes[np.append(self.rows[1:], n) - 1]
        self.last_row = np.append(self.rows[1:], n) - 1
        self.first = least[(np.cumsum(begins) - 1)[self.rows]]
        sizes = np.diff(np.append(self.rows, n))
        self.run_of = np.repeat(np.arange(len(self.rows), dtype=np.int32), sizes)  # a directory, to find runs without a search
        self.ends_at = np.arange(n - len(ends), n)  # rows of the separators
        by_char = np.argsort(self.chars, kind="stable")
        self.lf = np.empty(len(self.rows), dtype=np.int64)  # row of the suffix one byte longer, for a run's first row
        self.lf[by_char] = np.cumsum(sizes[by_char]) - sizes[by_char]
        self.by_char, self.char_at = by_char, np.searchsorted(self.chars[by_char], np.arange(257))
        self.keys = self.chars[by_char].astype(np.int64) * (len(self.rows) + 1) + by_char  # for the next run of a byte

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes the text has in common from places a and b on, ``most`` at most."""
        words = np.ndarray((len(self.text) - WORD + 1,), np.dtype("<u8"), buffer=self.text, strides=(1,))
        found, open_ = np.zeros(len(a), dtype=np.int64), np.flatnonzero(most > 0)
        while len(open_):
            at = found[open_]
            differ = words[a[open_] + at] ^ words[b[open_] + at]
            low = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, WORD, np.frexp(low.astype(np.float64))[1].astype(np.int64) - 1 >> 3)
            found[open_] = np.minimum(at + same, most[open_])
            open_ = open_[(differ == 0) & (found[open_] < most[open_])]
        return found

    def stream(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(matched, place, first) for every byte of the patterns: the length of the longest prefix of the pattern's rest
        that occurs in the index, one place of it, and the least owner of its first ``length`` bytes.

        All patterns are read backwards side by side. A row of the transform follows each; where its run has another
        byte, the nearer ends of the runs of the right byte above and below are compared with the match so far, and
        the longer continuation is taken. ``rows`` are rows to begin with: those of the separators behind them for
        patterns that are pieces of the index.
        """
        matched, place = np.zeros(len(text), dtype=np.int64), np.zeros(len(text), dtype=np.int64)
        first = np.full(len(text), NOBODY, dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        ends, lengths = (starts + lengths)[order], lengths[order]
        row = np.zeros(len(ends), dtype=np.int64) if rows is None else rows[order]
        at = np.full(len(ends), self.head[0], dtype=np.int64) if rows is None else ends.copy()
        have = np.zeros(len(ends), dtype=np.int64)
        run = self.run_of[row]
        for step in range(int(lengths[0]) if len(lengths) else 0):
            n = int(np.searchsorted(-lengths, -step, side="left"))  # patterns longer than this
            row, at, have, run, ends = row[:n], at[:n], have[:n], run[:n], ends[:n]
            char = text[ends - 1 - step]
            off = np.flatnonzero(self.chars[run] != char)
            if len(off):
                self._jump(off, char[off], row, at, have, run)
            row = self.lf[run] + row - self.rows[run]
            if len(off):
                row, at = np.where(have >= 0, row, 0), np.where(have >= 0, at, self.head[0] + 1)
            at, have, run = at - 1, have + 1, self.run_of[row]
            here = ends - 1 - step
            matched[here], place[here] = have, at
            long = have >= self.length
            first[here[long]] = self.first[run[long]]
        return matched, place, first

    def _jump(self, off: np.ndarray, char: np.ndarray, row: np.ndarray, at: np.ndarray, have: np.ndarray, run: np.ndarray) -> None:
        """Moves the followed rows ``off`` to the best end of a run of their bytes; -1 in ``have`` where there is none."""
        here = np.searchsorted(self.keys, char.astype(np.int64) * (len(self.rows) + 1) + run[off])
        above, below = here - 1, here
        has_above, has_below = above >= self.char_at[char], below < self.char_at[char.astype(np.int64) + 1]
        above = self.by_char[np.where(has_above, above, 0)]
        below = self.by_char[np.where(has_below, below, 0)]
        up = np.where(has_above, self.common(at[off], self.tail[above], np.where(has_above, have[off], 0)), -1)
        down = np.where(has_below, self.common(at[off], self.head[below], np.where(has_below, have[off], 0)), -1)
        rises = up >= down
        have[off] = np.maximum(up, down)
        run[off] = np.where(rises, above, below)
        row[off] = np.where(rises, self.last_row[above], self.rows[below])
        at[off] = np.where(rises, self.tail[above], self.head[below])

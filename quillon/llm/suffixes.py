"""Suffix orders of integer sequences, and the two indexes built on them.

RunIndex is the run-length compressed Burrows-Wheeler transform with samples at the ends of its runs;
WordIndex is an FM-index whose transform lies in a wavelet matrix.
"""

from __future__ import annotations

import numpy as np


def suffix_array(keys: np.ndarray, width: int) -> np.ndarray:
    """Order of the suffixes of a sequence. keys[i] ranks its first width symbols; ranks then double."""
    n = len(keys)
    order = np.argsort(keys)
    ranked = keys[order]
    fresh = np.ones(n, bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    group = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    tied = ~fresh
    tied[:-1] |= ~fresh[1:]
    slots = np.flatnonzero(tied)
    while len(slots):
        at = order[slots]
        head = group[slots]
        beyond = at + width >= n  # such suffixes sort first, the shortest before all
        pair = head * (2 * n + 1) + np.where(beyond, -1 - at, rank[np.where(beyond, 0, at + width)]) + n
        by = np.argsort(pair)
        at, pair = at[by], pair[by]
        order[slots] = at
        fresh = np.ones(len(slots), bool)
        fresh[1:] = pair[1:] != pair[:-1]
        heads = np.maximum.accumulate(np.where(fresh, slots, 0))
        group[slots] = heads
        rank[at] = heads
        single = fresh & np.r_[fresh[1:], True]
        slots = slots[~single]
        width *= 2
    return order


def _eight(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, first byte highest; zeros follow the end."""
    padded = np.zeros(len(text) + 8, np.uint64)
    padded[: len(text)] = text
    out = np.zeros(len(text), np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | padded[j : j + len(text)]
    return out


class RunIndex:
    """Run-compressed BWT of texts joined by separators, sampled at the ends of its runs.

    For each run only its first and its last suffix are kept: their text position and how far they
    agree with the suffix before (after) them in suffix order. Where the transform does not change,
    moving one position on in the text lowers that agreement by exactly one, so the samples give the
    matching statistics of every position against all others: from the latest sample at or before it.
    """

    def __init__(self, texts: list[bytes]):
        self.starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        raw = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
        # A separator sorts below all bytes; byte values move up by one, and the two that can't be in UTF-8 (0xFE, 0xFF) share 255.
        text = np.minimum(raw, 254).astype(np.uint8) + np.uint8(1)
        text[self.starts[1:] - 1] = 0
        self.n = len(text)
        eight = _eight(text)
        order = suffix_array(eight, 8)
        bwt = text[order - 1].astype(np.int16)
        bwt[order == 0] = -1  # nothing comes before the first suffix: it ends the runs around it
        change = np.flatnonzero(bwt[1:] != bwt[:-1])
        self.runs = len(change) + bool(self.n)
        heads, tails = change + 1, change
        self.head_at = order[heads]
        self.head_agrees = self._agreement(eight, self.head_at, order[heads - 1])
        self.tail_at = order[tails]
        self.tail_agrees = self._agreement(eight, self.tail_at, order[tails + 1])
        self.ends = (order[:1], order[-1:])  # first and last suffix: no neighbour on one side

    def _agreement(self, eight: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        at = 0
        while len(live):
            inside = np.maximum(a[live], b[live]) + at < self.n
            live = live[inside]
            differ = eight[a[live] + at] ^ eight[b[live] + at]
            done = differ != 0
            out[live[done]] = at + (differ[done].astype(">u8").view(np.uint8).reshape(-1, 8) != 0).argmax(axis=1)
            live = live[~done]
            at += 8
            out[live] = at
        return np.minimum(out, self.n - np.maximum(a, b)) if len(a) else out

    def matching_statistics(self) -> np.ndarray:
        """At each position of the joined texts the length of its longest match that starts elsewhere."""
        best = np.zeros(self.n, np.int64)
        place = np.arange(self.n)
        for at, agrees, end in ((self.head_at, self.head_agrees, self.ends[0]), (self.tail_at, self.tail_agrees, self.ends[1])):
            reach = np.full(self.n, -1, np.int64)
            reach[end] = end
            reach[at] = at + agrees
            latest = np.maximum.accumulate(np.where(reach >= 0, place, 0))
            np.maximum(best, reach[latest] - place, out=best)
        return best

    def long_matches(self, length: int) -> list[np.ndarray]:
        """For each text, whether its string of length at each start occurs elsewhere too."""
        found = self.matching_statistics() >= length
        return [found[a : max(a, b - length)] for a, b in zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True)]


class WaveletMatrix:
    """Ranks of symbols in a sequence: a bit vector for each bit of the symbols, in 64-bit words with counts."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.n = bits, len(symbols)
        self.words, self.counts, self.zeros = [], [], []
        for level in range(bits - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(bool)
            packed = np.zeros((-(-(self.n + 1) // 64)) * 8, np.uint8)
            raw = np.packbits(bit, bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view(np.uint64)
            self.words.append(words)
            self.counts.append(np.r_[0, np.cumsum(np.bitwise_count(words))].astype(np.int32))
            self.zeros.append(int(self.n - bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[level][at >> 6] + np.bitwise_count(self.words[level][at >> 6] & mask)

    def rank(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often symbol occurs before low and before high, counted from where its run of the last level starts."""
        start = np.zeros(len(symbol), np.int64)
        for level in range(self.bits):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            moved = []
            for at in (start, low, high):
                ones = self._ones(level, at)
                moved.append(np.where(one, self.zeros[level] + ones, at - ones))
            start, low, high = moved
        return low - start, high - start


class WordIndex:
    """FM-index of sequences of symbols joined by separators."""

    def __init__(self, sequences: list[np.ndarray]):
        self.starts = np.cumsum([0, *(len(s) + 1 for s in sequences)])
        joined = np.zeros(int(self.starts[-1]), np.int64)
        body = np.ones(len(joined), bool)
        body[self.starts[1:] - 1] = False
        flat = np.concatenate(sequences) if sequences else np.zeros(0, np.uint64)
        known, ids = np.unique(flat, return_inverse=True)
        joined[body] = ids + 1
        self.text = joined
        bits = max(1, int(len(known)).bit_length())
        ahead = np.zeros(len(joined) + 2, np.int64)
        ahead[: len(joined)] = joined
        per = max(1, min(3, 62 // bits))
        keys = joined.copy()
        for j in range(1, per):
            keys = (keys << bits) | ahead[j : j + len(joined)]
        order = suffix_array(keys, per)
        self.wavelet = WaveletMatrix(joined[order - 1], bits)
        self.before = np.r_[0, np.cumsum(np.bincount(joined, minlength=len(known) + 1))]

    def longest(self, floor: np.ndarray, end: np.ndarray) -> np.ndarray:
        """By backward search from each end down to its floor: where the longest word sequence starts
        that ends there and occurs at least twice."""
        start = end.copy()
        live = np.arange(len(end))
        low = np.zeros(len(end), np.int64)
        high = np.full(len(end), len(self.text), np.int64)
        while True:
            live = live[start[live] > floor[live]]
            if not len(live):
                return start
            symbol = self.text[start[live] - 1]
            a, b = self.wavelet.rank(symbol, low[live], high[live])
            twice = b - a >= 2
            live, symbol = live[twice], symbol[twice]
            low[live] = self.before[symbol] + a[twice]
            high[live] = self.before[symbol] + b[twice]
            start[live] -= 1

    def long_matches(self, length: int) -> list[np.ndarray]:
        """For each sequence, whether its length symbols from each start occur elsewhere too.

        The start of the longest repeated sequence never falls as the end moves on, so a range of ends
        whose outer two decide all between them is settled at once; other ranges are halved.
        """
        base, stop = self.starts[:-1], self.starts[1:] - 1
        found = np.zeros(len(self.text), bool)
        some = stop - base >= length
        owner = base[some]
        first, last = owner + length, stop[some]
        low, high = self.longest(owner, first), self.longest(owner, last)
        for end, begin in ((first, low), (last, high)):
            found[end[end - begin >= length] - length] = True
        while len(first):
            wide = (last - first > 1) & (last - low >= length)  # else nothing is left between, or nothing there can reach the length
            whole = wide & (high <= first - length + 1)
            for a, b in zip((first[whole] - length).tolist(), (last[whole] - length).tolist(), strict=True):
                found[a + 1 : b] = True
            rest = wide & ~whole
            owner, first, last, low, high = (x[rest] for x in (owner, first, last, low, high))
            middle = (first + last) // 2
            begin = self.longest(np.maximum(owner, low), middle)
            found[middle[middle - begin >= length] - length] = True
            owner, first, last, low, high = np.r_[owner, owner], np.r_[first, middle], np.r_[middle, last], np.r_[low, begin], np.r_[begin, high]
        return [found[a : max(a, b - length + 1)] for a, b in zip(base.tolist(), stop.tolist(), strict=True)]

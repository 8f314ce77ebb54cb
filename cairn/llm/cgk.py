"""Words of a text, their CGK embedding, and bit-sampling keys over it (helper of problem 7)."""

from __future__ import annotations

import html
import re

import numpy as np
import xxhash

_WORD = re.compile(r"[^\W_]+")
_ESCAPES = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|\\[nrtbfv](?![a-z]{0,2}\\)|%([0-9a-fA-F]{2})(?=[0-9a-zA-Z%_+.-])|</?[a-zA-Z][^<>\n]{0,80}>|[­​-‍⁠﻿]")
#: One word in so many may differ.
EACH = 8
_SOFT = "­​‌‍⁠﻿"


def _plain(m: re.Match) -> str:
    code = m.group(1) or m.group(2) or m.group(3)
    if code:
        return chr(int(code, 16))
    return "" if m.group()[0] in _SOFT else " "


def normal_words(text: str) -> list[str]:
    """Lower-case runs of letters or digits, entities and escapes resolved, markup and invisible marks gone."""
    if "&" in text:
        text = html.unescape(text)
    if "\\" in text or "%" in text or "<" in text or any(c in text for c in _SOFT):
        text = _ESCAPES.sub(_plain, text)
    return _WORD.findall(text.lower())


class WordIds(dict):
    """Word -> 63-bit id, the same in every process."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word) >> 1
        return value


class Embedding:
    """`repeats` CGK walks of windows of `size` words, and `bands` samples of `sample` places from each.

    A walk reads the window word by word; at each of its 3 * size steps it puts out the word it is at and moves
    on or stays by a random bit of that step and word. Windows within a small edit distance soon walk in step
    again, so their walks differ in few places, and a sample of places is equal with high probability. All
    random choices follow from `seed`.
    """

    def __init__(self, size: int, repeats: int, bands: int, sample: int, seed: int = 7):
        self.size, self.repeats, self.bands, self.sample = size, repeats, bands, sample
        rng = np.random.default_rng(seed)
        self.length = 3 * size
        self.salts = rng.integers(1, 1 << 62, size=(repeats, self.length), dtype=np.uint64) | np.uint64(1)
        self.places = np.stack([np.sort(rng.choice(self.length - size // 2, size=sample, replace=False)) for _ in range(repeats * bands)]).reshape(repeats, bands, sample)
        self.mixers = rng.integers(1, 1 << 62, size=(repeats, bands, sample), dtype=np.uint64) | np.uint64(1)

    def keys(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(len(starts), repeats * bands) keys of the windows of `words` (ids) that begin at `starts`."""
        out = np.empty((len(starts), self.repeats * self.bands), dtype=np.int64)
        padded = np.concatenate([words.astype(np.uint64), np.zeros(self.length + 1, dtype=np.uint64)])
        for r in range(self.repeats):
            at = starts.astype(np.int64).copy()
            end = at + self.size
            walk = np.empty((self.length, len(starts)), dtype=np.uint64)
            for step in range(self.length):
                word = np.where(at < end, padded[at], np.uint64(0))
                walk[step] = word
                at += ((word * self.salts[r, step]) >> np.uint64(61)).astype(np.int64) & 1
            for b in range(self.bands):
                key = np.full(len(starts), r * self.bands + b + 1, dtype=np.uint64)
                for place, mixer in zip(self.places[r, b], self.mixers[r, b], strict=True):
                    key = (key ^ walk[place]) * mixer
                    key ^= key >> np.uint64(29)
                out[:, r * self.bands + b] = (key >> np.uint64(1)).astype(np.int64)
        return out


def leaks(doc: np.ndarray, item: np.ndarray, low: int, high: int, run: int, most: int) -> bool:
    """Whether `run` or more consecutive words of `item` occur in `doc`, one in EACH of them changed at most.

    A change is a word replaced, left out or put in. A run of 2 * run words or more falls into two halves, one of
    which has no greater share of changes, so runs of less, with `most` changes then, tell all. Looked for where
    the place in `doc` is that in `item` plus `low` to `high`; exact there: runs without words left out or put in
    are counted, for others Sellers' dynamic programme decides from each place where a run can begin.
    """
    n, m = len(doc), len(item)
    if m < run or n < run - most:
        return False
    place = np.arange(m)[None, :] + np.arange(low, high + 1)[:, None]
    same = (doc[np.clip(place, 0, n - 1)] == item[None, :]) & (place >= 0) & (place < n)
    balance = np.zeros((len(same), m + 1), dtype=np.int32)  # a match counts 1, a change EACH - 1 less than nothing
    np.cumsum(EACH * same - (EACH - 1), axis=1, out=balance[:, 1:])
    if (balance[:, run:] >= np.minimum.accumulate(balance, axis=1)[:, : m + 1 - run]).any():
        return True
    # the words of a run lie on diagonals no further apart than its changes; where enough of them do, it may begin
    upto = np.zeros((len(same) + 1, m), dtype=np.int16)
    np.cumsum(same, axis=0, out=upto[1:])
    reach = min(most, len(same) - 1)
    balance = np.zeros((len(same) - reach, m + 1), dtype=np.int32)
    np.cumsum(EACH * (upto[reach + 1 :] > upto[: -reach - 1]) - (EACH - 1), axis=1, out=balance[:, 1:])
    best = np.maximum.accumulate(balance[:, : run - 1 : -1], axis=1)[:, ::-1]
    starts = np.flatnonzero((best >= balance[:, : m + 1 - run]).any(axis=0))
    return len(starts) > 0 and _within(doc, item, starts, low, high, run, most)


def _within(doc: np.ndarray, item: np.ndarray, starts: np.ndarray, low: int, high: int, run: int, most: int) -> bool:
    """Whether a run of `item` that begins at one of `starts` is in `doc` between the shifts `low` and `high`."""
    width = high - low + 2 * run + most
    at = starts[:, None] + low + np.arange(width)[None, :]
    words = np.where((at >= 0) & (at < len(doc)), doc[np.clip(at, 0, len(doc) - 1)], -1)
    steps = np.arange(width + 1, dtype=np.int16)
    cost = np.zeros((len(starts), width + 1), dtype=np.int16)  # a match may begin anywhere
    for i in range(2 * run - 1):
        inside = starts + i < len(item)
        step = np.empty_like(cost)
        step[:, 0] = i + 1
        step[:, 1:] = np.minimum(cost[:, 1:] + 1, cost[:, :-1] + (words != item[np.minimum(starts + i, len(item) - 1)][:, None]))
        cost = np.minimum.accumulate(step - steps, axis=1) + steps
        least = cost.min(axis=1)
        if i + 1 >= run and (inside & (EACH * least <= i + 1)).any():
            return True
        alive = inside & (least <= most)
        if not alive.all():
            starts, words, cost = starts[alive], words[alive], cost[alive]
            if not len(starts):
                return False
    return False

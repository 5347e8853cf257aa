"""Ids of a public word-level BPE, with each distinct word encoded once per worker as far as its table holds.

The tokenizer ends tokens at white space, so a text's ids are those of its words in order.  A word whose
ASCII punctuation follows an ASCII letter or digit is two such units.  The table is an array addressed by
the word's 64-bit hash; an entry that is displaced is encoded again, so its size bounds memory only.
"""

from __future__ import annotations

import ctypes
import os
import re

import numpy as np

from marklens.llm import bytetext as bt

_SLOTS = 1 << 20
_FLAT = 1 << 23
_TAIL = np.zeros(256, bool)
_TAIL[list(b".,!?;:%$*&#")] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
#: Words of letters that the tokenizer's own normaliser changes by lower-casing only.
_PLAIN = re.compile("[a-zA-ZÀ-ÖØ-öø-ÿ]+")


class Subwords:
    """Encoder of one vocabulary file; one per worker process."""

    _open: dict[str, Subwords] = {}

    @classmethod
    def of(cls, path: str) -> Subwords:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    @classmethod
    def close(cls) -> None:
        """Free the tables of this worker and give the memory back; the next use builds them again."""
        cls._open.clear()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps what is freed
        if trim:
            trim(0)

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.wide = np.uint32 if self.whole.get_vocab_size() > 65536 else np.uint16
        self.key = np.zeros(_SLOTS, np.uint64)
        self.at = np.zeros(_SLOTS, np.int64)
        self.size = np.zeros(_SLOTS, np.int32)
        self.flat = np.zeros(1 << 16, self.wide)
        self.used = 0

    def encode(self, units: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(units)
        rest = []
        for i, b in enumerate(units):
            if b.isascii():
                w = b.decode().lower()
                if w.isalpha():
                    out[i] = [t.id for t in self.model.tokenize(w)]
                    continue
            else:
                w = b.decode()
                if _PLAIN.fullmatch(w):
                    w = self.letters.pre_tokenize_str(w.lower())[0][0]
                    out[i] = [t.id for t in self.model.tokenize(w)]
                    continue
            rest.append(i)
        if rest:
            for i, e in zip(rest, self.whole.encode_batch_fast([units[i].decode() for i in rest], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return out

    def ids(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a piece of texts, and the bounds of each text's ids."""
        start, end = bt.spans(data, bounds)
        last = np.maximum.accumulate(np.where(_TAIL[data], -1, np.arange(len(data), dtype=np.int32))) if len(data) else start
        core = np.minimum(end, np.maximum(last[end - 1] + 1, start)) if len(start) else end
        two = (core > start) & (core < end)
        two[two] = _ALNUM[data[core[two] - 1]]
        units = len(start) + int(two.sum())
        place = np.arange(len(start)) + np.r_[0, np.cumsum(two)[:-1]] if len(start) else np.zeros(0, np.int64)
        s, e = np.empty(units, np.int64), np.empty(units, np.int64)
        s[place], e[place] = start, np.where(two, core, end)
        s[place[two] + 1], e[place[two] + 1] = core[two], end[two]
        h = bt.hashes(bt.LOWER[data], s, e)
        slot = (h & np.uint64(_SLOTS - 1)).astype(np.int64)
        hit = (self.key[slot] == h) & (self.size[slot] > 0)
        at, size = self.at[slot], self.size[slot]
        if not hit.all():
            miss = np.flatnonzero(~hit)
            fresh, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            found = self.encode([data[s[i] : e[i]].tobytes() for i in miss[first]])
            length = np.fromiter(map(len, found), np.int32, len(found))
            total = int(length.sum())
            if self.used + total > min(len(self.flat), _FLAT):
                if self.used + total > _FLAT:  # start over: the hits of this piece are copied first
                    keep = _gather(self.flat, at[hit], size[hit])
                    self.key[:], self.size[:] = 0, 0
                    self.flat = np.concatenate([keep, np.zeros(max(1 << 16, total), self.wide)])
                    at[hit] = np.r_[0, np.cumsum(size[hit])[:-1]] if hit.any() else at[hit]
                    self.used = len(keep)
                else:
                    self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), total), self.wide)])
            place = self.used + np.r_[0, np.cumsum(length)[:-1]]
            self.flat[self.used : self.used + total] = np.fromiter((x for f in found for x in f), self.wide, total)
            self.used += total
            where = (fresh & np.uint64(_SLOTS - 1)).astype(np.int64)
            self.key[where], self.at[where], self.size[where] = fresh, place, length
            at[miss], size[miss] = place[back], length[back]
        ids = _gather(self.flat, at, size)
        run = np.r_[0, np.cumsum(size)]
        return ids, run[np.searchsorted(s, bounds, "left")]


def _gather(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenation of flat[at:at + size]."""
    if not len(at):
        return flat[:0].copy()
    run = np.cumsum(size)
    return flat[np.arange(run[-1]) + np.repeat(at - np.r_[0, run[:-1]], size)]

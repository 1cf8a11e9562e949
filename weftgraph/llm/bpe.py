"""Byte-pair encoding with a hierarchical-bitmap rank queue.

A pre-token is a doubly linked list of byte ranges. Pairs wait in buckets, one per merge rank; a bitmap of two levels says which
buckets hold something, and find-first-set on both levels gives the lowest rank. Merging never searches: entries that a merge has
made untrue stay where they are and are skipped when their bucket comes up. A pre-token of n bytes costs O(n log n) at worst, for the
sorting of buckets, instead of the O(n^2) of repeated scans.
"""

from __future__ import annotations

import base64
import os
from array import array
from functools import lru_cache
from itertools import chain

import regex

# Fixed value: the pattern that splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

VOCABULARIES = "/opt/tokenizers"
_BITS = 8
_MASK = (1 << _BITS) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class RankQueue:
    """Positions by rank. ``push`` in any order; ``pop`` gives the lowest rank and its positions from left to right."""

    __slots__ = ("_buckets", "_low", "_high")

    def __init__(self) -> None:
        self._buckets: dict[int, list[int]] = {}
        self._low: dict[int, int] = {}
        self._high = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self._buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self._buckets[rank] = [position]
        block = rank >> _BITS
        self._low[block] = self._low.get(block, 0) | 1 << (rank & _MASK)
        self._high |= 1 << block

    def pop(self) -> tuple[int, list[int]] | None:
        high = self._high
        if not high:
            return None
        block = (high & -high).bit_length() - 1
        low = self._low[block]
        first = low & -low
        self._low[block] = low = low ^ first
        if not low:
            self._high = high ^ (1 << block)
        rank = block << _BITS | (first.bit_length() - 1)
        positions = self._buckets.pop(rank)
        if len(positions) > 1:
            positions.sort()
        return rank, positions


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: always the lowest-ranked adjacent pair first, of equals the leftmost. Every single byte must have a rank."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    get = ranks.get
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    queue = RankQueue()
    push = queue.push
    for i in range(n - 1):
        rank = get(word[i : i + 2])
        if rank is not None:
            push(rank, i)
    while (popped := queue.pop()) is not None:
        rank, positions = popped
        for at, i in enumerate(positions):
            j = after[i]
            if j < 0 or j >= n or get(word[i : after[j]]) != rank:
                continue  # stale: one of the two was merged since
            k = after[j]
            after[i], after[j] = k, -1
            lower = False
            if k < n:
                before[k] = i
                new = get(word[i : after[k]])
                if new is not None:
                    push(new, i)
                    lower = new <= rank
            p = before[i]
            if p >= 0:
                new = get(word[p:k])
                if new is not None:
                    push(new, p)
                    lower |= new <= rank
            if lower:  # the rest waits until the lower rank is done
                for rest in positions[at + 1 :]:
                    push(rank, rest)
                break
    ids, i = [], 0
    while i < n:
        k = after[i]
        ids.append(ranks[word[i:k]])
        i = k
    return ids


class _Known(dict):
    """Ids of pre-tokens seen before. Only what is remembered is bounded: after ``most`` it starts anew, and long ones aren't kept."""

    def __init__(self, ranks: dict[bytes, int], most: int, longest: int) -> None:
        super().__init__()
        self._ranks, self._most, self._longest = ranks, most, longest

    def __missing__(self, token: str) -> list[int]:
        ids = merge(token.encode("utf-8", "replace"), self._ranks)
        if len(token) <= self._longest:
            if len(self) >= self._most:
                self.clear()
            self[token] = ids
        return ids


class Encoder:
    """Texts to ids by one rank file."""

    def __init__(self, path: str, remembered: int = 400_000, longest: int = 40) -> None:
        self.ranks = load_ranks(path)
        self._split = regex.compile(PATTERN).findall
        self._known = _Known(self.ranks, remembered, longest)

    def encode(self, text: str | None) -> array:
        """An empty list for null and empty texts; strings of special tokens are ordinary text."""
        if not text:
            return array("i")
        return array("i", chain.from_iterable(map(self._known.__getitem__, self._split(text))))

    def decode(self, ids: list[int]) -> bytes:
        if not hasattr(self, "_tokens"):
            self._tokens = {i: t for t, i in self.ranks.items()}
        return b"".join(self._tokens[i] for i in ids)


@lru_cache(maxsize=4)
def encoder(name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> Encoder:
    """The encoder of a rank file, once per worker process."""
    return Encoder(os.path.join(folder, f"{name}.tiktoken"))

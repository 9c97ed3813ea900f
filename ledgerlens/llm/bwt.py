"""Burrows-Wheeler transforms of string collections: built shard by shard, merged by interleave refinement."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class ShardBWT:
    """A transform of some strings over symbols from 1 on; each string ends with a sentinel 0 of its own, ordered by
    the strings' order. `places` has for every suffix in order the index of its first symbol in the collection."""

    symbols: np.ndarray
    places: np.ndarray
    strings: int


def shard_bwt(symbols: np.ndarray, lengths: np.ndarray, base: int) -> ShardBWT:
    """symbols: the strings one after another, without sentinels; base: index of the first in the collection."""
    ends = np.cumsum(lengths + 1) - 1
    text = np.zeros(len(symbols) + len(lengths), np.int64)
    inner = np.ones(len(text), bool)
    inner[ends] = False
    text[inner] = symbols
    places = np.cumsum(inner) - 1 + base
    # ranks by prefix doubling; sentinels are told apart by the order of their strings
    rank = text + len(lengths)
    rank[ends] = np.arange(len(lengths))
    last = np.repeat(ends, lengths + 1)
    step, at = 1, np.arange(len(text))
    while True:
        ahead = at + step
        second = np.where(ahead <= last, rank[np.minimum(ahead, len(text) - 1)] + 1, 0)
        order = np.lexsort((second, rank))
        new = np.empty(len(text), np.int64)
        new[order] = np.concatenate([[0], np.cumsum((rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1]))])
        rank = new
        if rank[order[-1]] == len(text) - 1:
            break
        step *= 2
    before = np.concatenate([[0], text[:-1]])
    return ShardBWT(before[order], places[order], len(lengths))


def merge(shards: list[ShardBWT], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix places in merged order and their longest common prefixes (with the suffix before, at most `depth`).

    The interleave starts with the shards one after another. In each round it is dealt, without re-sorting suffixes,
    by the symbols that precede them, so after round h it is right for prefixes of h symbols; where two neighbours come
    apart in round h, their common prefix is h - 1. Rounds end when nothing comes apart any more, or at `depth`."""
    strings = sum(s.strings for s in shards)
    heads = np.repeat(np.arange(len(shards)), [s.strings for s in shards])
    sizes = np.array([len(s.symbols) for s in shards])
    offsets = np.cumsum(sizes) - sizes
    symbols = np.concatenate([s.symbols for s in shards])
    places = np.concatenate([s.places for s in shards])
    total = len(symbols)
    interleave = np.repeat(np.arange(len(shards), dtype=np.int32), sizes)
    common = np.full(total, -1, np.int64)
    common[0] = 0
    block = np.zeros(total, np.int64)

    def rows() -> np.ndarray:
        """For each merged position, the row of its shard's transform: shards keep their own order."""
        out = np.empty(total, np.int64)
        out[np.argsort(interleave, kind="stable")] = np.arange(total)
        return out

    for h in range(1, depth + 2):
        before = symbols[rows()]
        order = np.argsort(before, kind="stable")
        dealt = interleave[order]
        dealt[:strings] = heads
        apart = np.ones(total, bool)
        apart[1:] = (before[order][1:] != before[order][:-1]) | (block[order][1:] != block[order][:-1])
        apart[: strings + 1] = True
        fresh = apart & (common < 0)
        common[fresh] = h - 1
        block = np.cumsum(apart)
        interleave = dealt
        if h > 1 and not fresh.any():
            break
    common[common < 0] = depth
    return places[rows()], np.minimum(common, depth)


def longest_repeats(strings: np.ndarray, lengths: np.ndarray, depth: int, shards: int = 4) -> np.ndarray:
    """For every symbol of the collection the longest common prefix (in symbols, at most `depth`) of the suffix that
    starts there with any other suffix of the collection."""
    out = np.zeros(len(strings), np.int64)
    if not len(strings):
        return out
    cuts = np.unique(np.linspace(0, len(lengths), min(shards, len(lengths)) + 1).astype(int))
    edges = np.concatenate([[0], np.cumsum(lengths)])
    built = [shard_bwt(strings[edges[a] : edges[b]], lengths[a:b], int(edges[a])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    places, common = merge(built, depth)
    either = np.maximum(common, np.concatenate([common[1:], [0]]))
    real = sum(s.strings for s in built)  # the sentinels come first
    out[places[real:]] = either[real:]
    return out

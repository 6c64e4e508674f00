"""Restaurants of the words that follow a word, above the words' own restaurant.

A word's context is the word before it; a text starts and ends with the same boundary. All contexts
share one parent, the words' restaurant, whose customers are the tables that the contexts open.

Pairs are counted in each block of texts before anything is shuffled. A block knows its words' numbers and
counts in the whole corpus, so it can deal its distinct pairs to parts by their first word, and a first
word with more than ``HOT`` customers to several parts by its second word; every block deals alike.
A part holds about ``PART`` occurrences, travels as one packed row for each block, and is merged in one
task. What comes back to a block has the order of what it sent.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa

from .seating import STRENGTH, discount_of, pack, pack_planes, seat, unpack, unpack_planes

#: Occurrences in a part; customers of a context in one part, where there are no more than 2**20 such contexts.
PART, HOT, HOT_BITS = 1 << 21, 1 << 22, 20
#: Draws of all tables, and those of them that come before the averaged ones.
SWEEPS, BURN_IN = 3, 1
#: Pairs whose parts are computed at once.
_AT_ONCE = 1 << 16
#: Steps in a factor of ten, in which a part knows the probability of a word; a word of one occurrence.
STEPS, ONCE = 16, 255
#: Rows of the blocks' side and of the parts' side.
SENT = "part bigint, block bigint, data array<binary>"
SEATED = "kind int, k bigint, part bigint, n double, data array<binary>"


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def placed(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and each key's place among them; ``keys`` holds one array, which is taken from it, so that it isn't kept beside its sorted copy."""
    own = keys.pop()
    order = np.argsort(own)
    own = own[order]
    fresh = np.ones(len(own), bool)
    fresh[1:] = own[1:] != own[:-1]
    own = own[fresh]
    number = np.cumsum(fresh, dtype=np.int32)
    number -= 1
    where = np.empty(len(order), np.int32)
    where[order] = number
    return own, where


class BlockPairs:
    """The distinct pairs of a block in the order of parts, first words, second words (numbers of the block; its last is the boundary).

    ``numbers`` and ``counts`` are the words' in the corpus, the boundary's last. ``step`` is the place of each
    token's pair, ``starts`` where texts start in it; ``run`` is where a first word starts in a part.
    """

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, numbers: np.ndarray, counts: np.ndarray, parts: int, hot: int):
        n = len(numbers)
        after = np.cumsum(lengths)
        cur = np.insert(codes.astype(np.int32), after, n - 1)
        self.starts = np.concatenate(([0], (after + np.arange(1, len(lengths) + 1))[:-1]))
        keys = np.empty(len(cur), np.int64)
        keys[:1], keys[1:] = n - 1, cur[:-1]
        keys *= n
        keys += cur
        del cur
        held = [keys]
        del keys
        pairs, step = placed(held)
        self.split = counts // hot + 1
        part = np.empty(len(pairs), np.int32)
        for at in range(0, len(pairs), _AT_ONCE):
            u, w = np.divmod(pairs[at : at + _AT_ONCE], n)
            salt = mixed(numbers[w]) % self.split[u].astype(np.uint64)
            part[at : at + _AT_ONCE] = (mixed(numbers[u].astype(np.uint64) + (salt << np.uint64(1))) >> np.uint64(11)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.step, self.part = place[step], part[order]
        del place, step, part
        pairs = pairs[order]
        self.u, self.w = (pairs // n).astype(np.int32), (pairs % n).astype(np.int32)
        del pairs
        fresh = np.ones(len(order), bool)
        fresh[1:] = (self.u[1:] != self.u[:-1]) | (self.part[1:] != self.part[:-1])
        self.run = np.flatnonzero(fresh)

    def sent(self, learned: np.ndarray, numbers: np.ndarray, counts: np.ndarray, log10: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
        """For each part its first words with their splits and lengths, second words with their counts and probabilities."""
        count = np.bincount(self.step, learned, minlength=len(self.u)).astype(np.int64)
        rough = np.where(counts == 1, ONCE, np.clip(np.rint(-STEPS * log10), 0, ONCE - 1)).astype(np.uint8)
        cut = np.flatnonzero(np.concatenate(([True], self.part[1:] != self.part[:-1], [True])))
        ends = np.append(self.run, len(self.u))
        for a, b in zip(cut[:-1], cut[1:]):
            i, j = np.searchsorted(self.run, (a, b))
            first, second = self.u[self.run[i:j]], self.w[a:b]
            yield int(self.part[a]), [pack_planes(numbers[first]), pack_planes(self.split[first]), pack_planes(np.diff(ends[i : j + 1])), pack_planes(numbers[second]), pack_planes(count[a:b]), pack(rough[second])]


def seat_part(u, first, split, second, count, rough) -> tuple[np.ndarray, np.ndarray]:
    """(customers left after discounts, tables of the last draw) of distinct pairs; ``u`` is the place in ``first`` and ``split``."""
    discount = discount_of(int((count == 1).sum()), int((count == 2).sum()))
    parent = (10.0 ** (-np.arange(ONCE + 1) / STEPS))[rough]
    # a word of one occurrence has one table whatever its probability
    opened = np.bincount(u, count > 0, minlength=len(split))
    seed = mixed(mixed(first[u]) ^ (second.astype(np.uint64) << np.uint64(1)))
    mean = np.zeros(len(count))
    tables = (count > 0).astype(np.float64)
    for sweep in range(SWEEPS):
        base = (STRENGTH + discount * (opened * split)[u]) * parent
        tables = np.rint(seat(count, base, discount, seed + np.uint64(sweep)))
        opened = np.bincount(u, tables, minlength=len(split))
        if sweep >= BURN_IN:
            mean += tables / (SWEEPS - BURN_IN)
    return np.maximum(count - discount * mean, 0), tables


def _part(blobs: list[tuple[int, list[bytes]]]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merge a part's rows: replies, then numbers and tables of second words, numbers and discounts of split contexts."""
    firsts, splits, seconds, counts, roughs, sizes, runs = [], [], [], [], [], [], []
    for _, data in blobs:
        first, split, lengths, second, count = (unpack_planes(x) for x in data[:5])
        runs.append((len(first), lengths.astype(np.int32)))
        firsts.append(first)
        splits.append(split)
        seconds.append(second)
        counts.append(count.astype(np.int32))  # of one block
        roughs.append(unpack(data[5], np.uint8))
        sizes.append(len(second))
    contexts, index, at = np.unique(np.concatenate(firsts), return_index=True, return_inverse=True)
    split = np.concatenate(splits)[index]
    del firsts, splits, index
    held = [np.concatenate(seconds)]
    del seconds
    words, second = placed(held)
    rough_of = np.empty(len(words), np.uint8)
    rough_of[second] = np.concatenate(roughs)  # every block knows a word's alike
    del roughs
    keys = np.repeat(at, np.concatenate([x[1] for x in runs]))
    keys *= len(words)
    keys += second
    del second
    held = [keys]
    del keys
    pairs, where = placed(held)
    count = np.bincount(where, np.concatenate(counts), minlength=len(pairs)).astype(np.int64)
    del counts
    u, w = (pairs // len(words)).astype(np.int32), (pairs % len(words)).astype(np.int32)
    del pairs
    left, tables = seat_part(u, contexts, split, words[w], count, rough_of[w])
    given = np.bincount(u, count - left, minlength=len(contexts))
    replies, pair_from, run_from = [], 0, 0
    for (block, _), size, (n, _) in zip(blobs, sizes, runs):
        replies.append((block, [pack(left[where[pair_from : pair_from + size]].astype("<f4")), pack(given[at[run_from : run_from + n]].astype("<f8"))]))
        pair_from, run_from = pair_from + size, run_from + n
    served = np.bincount(w, tables, minlength=len(words))
    several = (rough_of != ONCE) & (served > 0)
    shared = split > 1
    return replies, words[several], served[several], contexts[shared], given[shared]


def seat_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, block, data) sorted by part: kind 1 goes back to block ``k``, kind 2 are tables by second word, kind 3 discounts of split contexts."""

    def rows() -> Iterator[tuple[int, int, list[bytes]]]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield tuple(batch.column(c)[i].as_py() for c in ("part", "block", "data"))

    def many(kind: int, keys: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(keys), 50_000):
            k, v = keys[i : i + 50_000], values[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.nulls(len(k), pa.int64()), pa.array(v.astype(np.float64)), pa.nulls(len(k), pa.list_(pa.binary()))], names)

    names = ["kind", "k", "part", "n", "data"]
    for part, found in groupby(rows(), key=lambda r: r[0]):
        replies, words, tables, contexts, given = _part([(block, data) for _, block, data in found])
        for block, data in replies:
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([block], pa.int64()), pa.array([part], pa.int64()), pa.nulls(1, pa.float64()), pa.array([data], pa.list_(pa.binary()))], names)
        yield from many(2, words, tables)
        yield from many(3, contexts, given)

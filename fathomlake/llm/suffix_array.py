"""Suffix arrays in numpy: Larsson-Sadakane refinement and Kasai's common prefixes."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Places of the suffixes of a byte array in order. Ranks by the first eight bytes are refined by the ranks of the
    suffixes 8, 16, 32, ... further on, in the groups that are not yet sorted alone; a suffix that ends comes first.
    depth: bytes after which suffixes may stay in any order, so that copies of long texts end as soon as strings do."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    first = np.ndarray((n,), ">u8", padded, strides=(1,)).astype(np.uint64)
    order = np.argsort(first, kind="stable")
    new = np.diff(first[order], prepend=first[order[0]]) != 0
    new[0] = True
    rank = np.zeros(n + 1, np.int64)  # of the place n, the empty suffix: 0; of others: where their group starts, and 1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
    # Zero bytes stand for the end in the padding, so that short suffixes tie with zeros until their ends tell them apart.
    step = 8 if not (text == 0).any() and n > 8 else 1
    if step == 1:
        order = np.argsort(text, kind="stable")
        new = np.diff(text[order].astype(np.int16), prepend=-1) != 0
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
    left = np.flatnonzero(~(new & np.append(new[1:], True)))  # places in the order that share a rank with a neighbour
    while len(left) and (depth is None or step < depth):
        at = order[left]
        key = rank[at] * np.int64(n + 2) + rank[np.minimum(at + step, n)]
        by = np.argsort(key, kind="stable")
        order[left] = at = at[by]
        new = np.diff(key[by], prepend=-1) != 0
        rank[at] = np.maximum.accumulate(np.where(new, left, 0)) + 1
        left = left[~(new & np.append(new[1:], True))]
        step *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int | None = None) -> np.ndarray:
    """For each suffix in order, the bytes it has in common with the one before; 0 for the first. With a depth, what is
    at least that much may be given as less than it is, though not as less than the depth.

    Kasai's observation: where the suffix at i and its neighbour are preceded by the same byte, the suffix at i has one
    common byte less than the one at i - 1. Only the other places are compared, eight bytes at a time and all at once.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    follows = np.zeros(n, bool)
    follows[1:] = (before[1:] > 0) & (text[:-1] == text[before[1:] - 1]) & (before[:-1] >= 0)
    # The neighbour of i - 1 must be the byte before the neighbour of i, else the count starts afresh.
    follows[1:] &= before[:-1] == before[1:] - 1
    if depth is not None:  # a count up to twice the depth serves as many followers as the depth is long
        follows[::depth] = False
    here = np.flatnonzero(~follows & (before >= 0))
    there, length = before[here], np.zeros(n, np.int64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    eight = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
    active, done, most = np.arange(len(here)), np.zeros(len(here), np.int64), n if depth is None else 2 * depth
    while len(active):
        i, j = here[active] + done[active], there[active] + done[active]
        room = n - np.maximum(i, j)
        differ = eight[np.minimum(i, n)] ^ eight[np.minimum(j, n)]
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
        done[active] += np.minimum(same, np.maximum(room, 0))
        active = active[(same == 8) & (room > 8) & (done[active] < most)]
    length[here] = done
    # Of a run of followers each has one less than the one before.
    start = np.maximum.accumulate(np.where(follows, 0, np.arange(n)))
    length = np.where(follows, length[start] - (np.arange(n) - start), length)
    return length[order]

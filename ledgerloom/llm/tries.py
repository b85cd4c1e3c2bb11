"""Numpy helper run inside tasks: the self-join of a binary trie within a Hamming budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LEAF = 64  #: node pairs with at most so many leaf pairs are compared directly
ROOM = 1 << 18  #: node pairs or leaf pairs handled at a time

U64 = np.uint64


def top_bits(codes: np.ndarray, bits: int) -> np.ndarray:
    return codes & U64((0xFFFFFFFFFFFFFFFF << (64 - bits)) & 0xFFFFFFFFFFFFFFFF) if bits else codes * U64(0)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-but-one place of each stretch of equal values."""
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return starts, np.r_[starts[1:], len(values)]


def expanded(alo, ahi, blo, bhi) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places of node pairs; of a node with itself those with i < j."""
    wide = bhi - blo
    size = (ahi - alo) * wide
    pair = np.repeat(np.arange(len(size)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    i, j = alo[pair] + at // wide[pair], blo[pair] + at % wide[pair]
    keep = (i < j) | (alo != blo)[pair]
    return i[keep], j[keep]


def trie_pairs(codes: np.ndarray, roots, depth: int, bits: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of codes that differ in at most ``budget`` of their first ``bits`` bits.

    ``codes`` is sorted and left-aligned; a node is a stretch of codes with a common prefix. ``roots`` are node
    pairs (alo, ahi, blo, bhi, differing bits so far) of prefixes of ``depth`` bits. Node pairs go down together,
    one bit at a time, adding the bits that differ; a pair over the budget is pruned with all that is below it.
    """
    stack = [(depth, *roots)]
    while stack:
        depth, alo, ahi, blo, bhi, diff = stack.pop()
        if len(alo) > ROOM:
            half = len(alo) // 2
            for part in (slice(None, half), slice(half, None)):
                stack.append((depth, *(x[part] for x in (alo, ahi, blo, bhi, diff))))
            continue
        leaf = (ahi - alo) * (bhi - blo) <= LEAF
        if depth >= bits:
            for k in np.flatnonzero(~leaf):  # equal codes in great number: a row of pairs at a time
                for i in range(alo[k], ahi[k]):
                    j = np.arange(max(blo[k], i + 1) if alo[k] == blo[k] else blo[k], bhi[k])
                    if len(j):
                        yield np.full(len(j), i), j
        if leaf.any():
            parts = [x[leaf] for x in (alo, ahi, blo, bhi)]
            for s in range(0, len(parts[0]), ROOM // LEAF):
                i, j = expanded(*(x[s : s + ROOM // LEAF] for x in parts))
                near = np.bitwise_count(top_bits(codes[i] ^ codes[j], bits)) <= budget
                if near.any():
                    yield i[near], j[near]
        if depth >= bits or leaf.all():
            continue
        alo, ahi, blo, bhi, diff = (x[~leaf] for x in (alo, ahi, blo, bhi, diff))
        bit = U64(1 << (63 - depth))
        amid = np.clip(np.searchsorted(codes, top_bits(codes[alo], depth) | bit), alo, ahi)
        bmid = np.clip(np.searchsorted(codes, top_bits(codes[blo], depth) | bit), blo, bhi)
        other = alo != blo
        children = [
            (alo, amid, blo, bmid, diff, None),
            (amid, ahi, bmid, bhi, diff, None),
            (alo, amid, bmid, bhi, diff + 1, None),
            (amid, ahi, blo, bmid, diff + 1, other),  # of a node with itself the same as the pair before
        ]
        grown = []
        for a0, a1, b0, b1, d, only in children:
            keep = (a1 > a0) & (b1 > b0) & (d <= budget)
            if only is not None:
                keep &= only
            grown.append([x[keep] for x in (a0, a1, b0, b1, d)])
        nodes = [np.concatenate(x) for x in zip(*grown)]
        if len(nodes[0]):
            stack.append((depth + 1, *nodes))


def merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the groups of places i and j, in place; a group's label is its smallest place."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up

"""Two-stage suffix sorting and long common prefixes of neighbours.

Works on one block of byte strings. Only suffixes that are smaller than their
successors are compared and sorted; every other suffix follows from its
successor's place by one scan over the first-byte buckets. Order is exact to
``depth`` bytes, which is all that equal strings of that length need.
"""

from __future__ import annotations

import numpy as np

#: Ends each string of a block; no UTF-8 text holds this byte.
END = 0xFF


def _small(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last one counts as such."""
    n = len(text)
    differs = np.concatenate([text[:-1] != text[1:], [True]])
    at = np.where(differs, np.arange(n), n)
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    after = np.append(text, 255).astype(np.int16)
    after[n] = 256
    return text[nearest] < after[nearest + 1]


def _words(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each position as one number that sorts like them."""
    return np.lib.stride_tricks.sliding_window_view(padded, 8)[at].view(">u8").ravel().astype(np.uint64)


def _direct(padded: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their first ``depth`` bytes or more."""
    key = _words(padded, at)
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    fresh = np.concatenate([[True], key[1:] != key[:-1]]) if len(at) else np.zeros(0, bool)
    for deep in range(8, depth, 8):
        tied = np.flatnonzero(~fresh | np.append(~fresh[1:], False))
        if not len(tied):
            break
        group, key = np.cumsum(fresh)[tied], _words(padded, at[tied] + deep)
        order = np.lexsort((key, group))
        at[tied], key = at[tied][order], key[order]
        fresh[tied[1:]] |= (key[1:] != key[:-1]) & (group[1:] == group[:-1])
    return at


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """All positions of ``text`` in order of their suffixes, exact to ``depth`` bytes."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    direct = _direct(padded, np.flatnonzero(_small(text)), depth)
    edges = np.searchsorted(text[direct], np.arange(257))
    start = np.concatenate([[True], text[1:] != text[:-1]])
    run = np.arange(n) - np.maximum.accumulate(np.where(start, np.arange(n), 0)) + 1
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        part = direct[edges[c]:edges[c + 1]]
        if waiting[c]:
            # each induced suffix brings the run of equal bytes before it, shorter runs first
            lead = np.concatenate(waiting[c])
            sizes = run[lead]
            if sizes.max() > 1:
                step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                order = np.argsort(step, kind="stable")
                lead = (np.repeat(lead, sizes) - step)[order]
            part = np.concatenate([lead, part])
        if not len(part):
            continue
        out.append(part)
        before = part[part > 0] - 1
        byte = text[before]
        larger = byte > c
        before, byte = before[larger], byte[larger]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        cuts = [i for i in (0, *(np.flatnonzero(byte[1:] != byte[:-1]) + 1).tolist()) if i < len(byte)]
        for a, b in zip(cuts, [*cuts[1:], len(byte)], strict=False):
            waiting[byte[a]].append(before[a:b])
    return np.concatenate(out)


def reaches(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the common prefix of suffixes ``a`` and ``b`` has ``length`` bytes."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    same = np.ones(len(a), bool)
    for deep in [*range(0, length - 8, 8), length - 8]:
        live = np.flatnonzero(same)
        same[live] = _words(padded, a[live] + deep) == _words(padded, b[live] + deep)
    return same


def least_owner(strings: list[bytes], owner: np.ndarray, length: int) -> np.ndarray:
    """For every start of a ``length``-byte substring, string by string, its least owner.

    ``owner`` has a number per string; the least is taken over all strings of
    the block that hold the same substring.
    """
    sizes = np.array([len(s) for s in strings], np.int64)
    text = np.frombuffer(bytes([END]).join(strings) + bytes([END]), np.uint8)
    firsts = np.cumsum(sizes + 1) - sizes - 1
    counts = np.maximum(sizes - length + 1, 0)
    string = np.repeat(np.arange(len(strings)), counts)
    starts = firsts[string] + np.arange(len(string)) - np.repeat(np.cumsum(counts) - counts, counts)
    number = np.full(len(text), -1, np.int64)
    number[starts] = np.arange(len(starts))
    order = number[suffix_array(text, length)]
    order = order[order >= 0]
    if not len(order):
        return np.zeros(0, np.int64)
    joined = reaches(text, starts[order[:-1]], starts[order[1:]], length)
    group = np.concatenate([[True], ~joined])
    least = np.minimum.reduceat(owner[string[order]], np.flatnonzero(group))
    out = np.empty(len(starts), np.int64)
    out[order] = least[np.cumsum(group) - 1]
    return out

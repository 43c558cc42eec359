"""Suffix arrays in numpy by Larsson-Sadakane refinement, whole or up to a width."""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: A place in an array of under 2**21 symbols.
_BITS = 21


def suffix_array(first: np.ndarray, covered: int, limit: np.ndarray | None = None, owner: np.ndarray | None = None) -> np.ndarray:
    """Suffix array of a text, or of several texts one after the other.

    ``first[i]`` orders suffix i by its first ``covered`` symbols.  Each round
    doubles the prefix that is sorted, looking only at groups that still hold
    more than one suffix (Larsson & Sadakane 2007).  With several texts,
    ``owner[i]`` numbers the text of position i and ``limit[i]`` counts the
    symbols to its end; the end of a text sorts before every symbol and before
    the ends of later texts.
    """
    n = len(first)
    n_owners = int(owner[-1]) + 1 if owner is not None and n else 0
    sa, ordered = _sort(np.asarray(first).astype(_U), n)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    heads = np.flatnonzero(new)
    rank[sa] = np.repeat(heads, np.diff(np.append(heads, n)))
    open_at = np.flatnonzero(_in_groups(new))  # places in sa not yet settled
    h = covered
    shift = _U(_BITS if n + n_owners + 1 < 1 << _BITS else 32)
    while len(open_at):
        pos = sa[open_at]
        nxt = rank[np.minimum(pos + h, n)] + 1 + n_owners
        if limit is not None:
            nxt = np.where(limit[pos] <= h, owner[pos], nxt)
        order, key = _sort((rank[pos].astype(_U) << shift) | nxt.astype(_U), n)
        sa[open_at] = pos = pos[order]
        new = np.ones(len(pos), bool)
        new[1:] = key[1:] != key[:-1]
        heads = np.flatnonzero(new)
        rank[pos] = open_at[np.repeat(heads, np.diff(np.append(heads, len(pos))))]
        open_at = open_at[_in_groups(new)]
        h *= 2
    return sa


def _sort(key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, sorted keys).  Sorting plain words is several times faster than
    an argsort, so the index rides in the low bits where it fits."""
    if n < 1 << _BITS and len(key) and int(key.max()) < 1 << (64 - _BITS):
        packed = np.sort((key << _U(_BITS)) | np.arange(len(key), dtype=_U))
        return (packed & _U((1 << _BITS) - 1)).astype(np.int64), packed >> _U(_BITS)
    order = np.argsort(key, kind="stable")
    return order, key[order]


def _in_groups(new: np.ndarray) -> np.ndarray:
    """Members of groups of two or more, given where groups begin."""
    last = np.ones(len(new), bool)
    last[:-1] = new[1:]
    return ~(new & last)


def equal_prefixes(text: np.ndarray, limit: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of a suffix array, of several texts one after the other, whose
    suffixes share ``width`` symbols (bytes): (suffixes in order, where runs begin).

    ``limit[i]`` counts the symbols from i to the end of its own text.  The same
    refinement, ended at ``width``: a suffix shorter than the prefix that is sorted
    next leaves, for no longer one looks it up; the last round moves on by what is
    left to ``width``.  Suffixes that stay in one group share ``width`` symbols, so
    no common prefixes have to be counted."""
    n = len(text)
    used = np.bincount(text, minlength=256) > 0
    per = max(1, (int(used.sum()) - 1).bit_length())
    depth = max(1, min(width, (64 - _BITS) // per))
    symbol = (np.cumsum(used) - 1).astype(_U)[text]
    key = symbol.copy()
    for j in range(1, min(depth, n)):
        key <<= _U(per)
        key[:n - j] |= symbol[j:]
    del symbol
    pos = np.flatnonzero(limit >= depth).astype(np.uint32)
    pos, key = _ordered(key[pos], pos, n)
    rank = np.zeros(n, np.uint32)
    new = _heads(key)
    rank[pos] = _head_places(new)
    shift = _U(_BITS if n < 1 << _BITS else 32)
    while depth < width:
        step = min(depth, width - depth)
        pos = pos[_in_groups(new) & (limit[pos] >= depth + step)]
        key = rank[pos].astype(_U)
        key <<= shift
        key |= rank[pos + step]
        pos, key = _ordered(key, pos, n)
        new = _heads(key)
        key >>= shift
        at = _head_places(new)
        at -= _head_places(_heads(key))
        at += key.astype(np.uint32)
        rank[pos] = at
        depth += step
    keep = _in_groups(new)
    return pos[keep].astype(np.int64), new[keep]


def _ordered(key: np.ndarray, pos: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, keys) by key, then position; ``key`` may be overwritten."""
    if n < 1 << _BITS and len(key) and int(key.max()) < 1 << (64 - _BITS):
        key <<= _U(_BITS)
        key |= pos
        key.sort()
        pos = (key & _U((1 << _BITS) - 1)).astype(np.uint32)
        key >>= _U(_BITS)
        return pos, key
    order = np.argsort(key, kind="stable")
    return pos[order], key[order]


def _heads(key: np.ndarray) -> np.ndarray:
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return new


def _head_places(new: np.ndarray) -> np.ndarray:
    """For every member, where its group begins."""
    at = np.arange(len(new), dtype=np.uint32)
    at *= new
    return np.maximum.accumulate(at, out=at)

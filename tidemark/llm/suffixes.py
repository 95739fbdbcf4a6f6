"""Suffix arrays by induced sorting, and permuted common prefixes: the core of operator 11, on one shard's bytes.

A suffix is S if it is smaller than the next one, L if larger; an S suffix behind an L suffix is a
leftmost-smaller one (LMS). Sorted LMS suffixes induce the order of all L suffixes in one scan from the
left, and these that of all S suffixes in one from the right. The LMS suffixes are sorted by the same
two scans (which sort the substrings between them), by naming equal substrings, and by recursion on
the names where names repeat. The scans run over whole buckets at a time where the alphabet is small
(bytes), and symbol by symbol in the recursion, whose alphabet is as large as its string.
"""

from __future__ import annotations

import numpy as np

#: Up to this many symbols order is induced.
SMALL_ALPHABET = 1024


def _types(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each suffix is S, positions of LMS suffixes); the last symbol is the unique least one."""
    n = len(s)
    change = np.flatnonzero(s[:-1] != s[1:])  # an equal neighbour has the type of the one behind it
    rises = np.append(s[change] < s[change + 1], True)
    small = np.repeat(rises, np.diff(np.concatenate([[-1], change, [n - 1]])))
    return small, np.flatnonzero(small[1:] & ~small[:-1]) + 1


def _deal(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(stable order by symbol, its symbols, where each begins, rank of each entry within its symbol)."""
    order = np.argsort(symbols, kind="stable")
    sorted_ = symbols[order]
    first = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    count = np.diff(np.append(first, len(sorted_)))
    return order, sorted_[first], count, np.arange(len(sorted_)) - np.repeat(first, count)


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, alphabet: int) -> np.ndarray:
    """The order that LMS suffixes in the given order induce: all suffixes of a bucket push those in front of them at once."""
    n = len(s)
    ends = np.cumsum(np.bincount(s, minlength=alphabet))
    starts = np.append(0, ends[:-1])
    out = np.full(n, -1, dtype=np.int32)
    order, symbols, count, rank = _deal(s[lms])
    seeds = np.zeros(alphabet, dtype=np.int64)
    seeds[symbols] = count
    seed_at = lms[order]
    seed_from = np.append(0, np.cumsum(seeds)[:-1])
    used = np.flatnonzero(ends > starts).tolist()

    head = starts.copy()
    for c in used:
        done = int(starts[c])
        for part in (None, seed_at[seed_from[c] : seed_from[c] + seeds[c]]):
            while True:
                if part is None:
                    batch = out[done : head[c]]
                    done = int(head[c])
                    if not len(batch):
                        break
                else:
                    batch = part
                front = batch[batch > 0] - 1
                front = front[~small[front]]
                if len(front):
                    o, sym, num, r = _deal(s[front])
                    out[np.repeat(head[sym], num) + r] = front[o]
                    head[sym] += num
                if part is not None:
                    break
    tail = ends.copy()
    for c in reversed(used):
        done, first_small = int(ends[c]), int(head[c])
        for larger in (False, True):
            while True:
                if larger:
                    batch = out[starts[c] : first_small][::-1]
                else:
                    batch = out[tail[c] : done][::-1]
                    done = int(tail[c])
                    if not len(batch):
                        break
                front = batch[batch > 0] - 1
                front = front[small[front]]
                if len(front):
                    o, sym, num, r = _deal(s[front])
                    out[np.repeat(tail[sym], num) - 1 - r] = front[o]
                    tail[sym] -= num
                if larger:
                    break
        if c == 0:  # the last symbol stands alone, and nothing pushes it
            out[0] = n - 1
    return out


def _by_followers(names: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a string of names whose last one, 0, stands nowhere else."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    slots, step = np.arange(n), 0
    rank = np.zeros(n, dtype=np.int64)
    key = names[order].astype(np.int64)
    while True:
        new = np.append(True, key[1:] != key[:-1])
        start = np.maximum.accumulate(np.where(new, slots, 0))  # a group's rank is its first place
        rank[order[slots]] = start
        alone = new & np.append(new[1:], True)
        slots = slots[~alone]
        if not len(slots):
            return order.astype(np.int32)
        step = 2 * step or 1
        at = order[slots]
        key = rank[at] * n + rank[np.minimum(at + step, n - 1)]
        sorted_ = np.argsort(key, kind="stable")
        order[slots], key = at[sorted_], key[sorted_]


def _names(s: np.ndarray, lms: np.ndarray, ranked: np.ndarray) -> tuple[np.ndarray, int]:
    """(name of the substring at each LMS position, in text order; number of names)."""
    ends = np.append(lms[1:], lms[-1])  # a substring ends with the next one's first symbol
    number = np.empty(len(s), dtype=np.int32)
    number[lms] = np.arange(len(lms))
    where = number[ranked]
    length = ends[where] - ranked
    same = np.append(False, length[1:] == length[:-1])
    open_ = np.flatnonzero(same)
    k = 0
    while len(open_):
        open_ = open_[length[open_] >= k]
        equal = s[ranked[open_] + np.minimum(k, length[open_])] == s[ranked[open_ - 1] + np.minimum(k, length[open_])]
        same[open_[~equal]] = False
        open_ = open_[equal]
        k += 1
    name = np.cumsum(~same) - 1
    out = np.empty(len(lms), dtype=np.int32)
    out[where] = name
    return out, int(name[-1]) + 1


def suffix_array(s: np.ndarray, alphabet: int) -> np.ndarray:
    """Starts of all suffixes of ``s`` in order; symbols lie in [0, alphabet) and the last one is 0, which stands nowhere else."""
    n = len(s)
    if n == 1:
        return np.zeros(1, dtype=np.int32)
    if alphabet > SMALL_ALPHABET:
        return _by_followers(s)
    small, lms = _types(s)
    lms = lms.astype(np.int32)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    ranked = _induce(s, small, lms, alphabet)
    ranked = ranked[is_lms[ranked]]
    names, found = _names(s, lms, ranked)
    if found < len(lms):
        ranked = lms[suffix_array(names, found)]
    return _induce(s, small, ranked, alphabet)


def permuted_common_prefixes(s: np.ndarray, order: np.ndarray, stop: int) -> np.ndarray:
    """For each position, how many symbols its suffix shares with the one before it in order; ``stop`` ends every match.

    Only where the symbols in front of both suffixes differ (or are ``stop``) symbols are compared;
    from there on each next position shares one symbol less.
    """
    n = len(s)
    before = np.full(n, -1, dtype=np.int32)
    before[order[1:]] = order[:-1]
    at = np.arange(n, dtype=np.int32)
    prior = np.maximum(before - 1, 0)
    fresh = (before <= 0) | (at == 0)
    fresh[1:] |= (s[:-1] != s[prior[1:]]) | (s[:-1] == stop)
    starts = np.flatnonzero(fresh)
    shared = np.zeros(len(starts), dtype=np.int32)
    # four symbols at a time while they agree and none ends the match, then one by one
    padded = np.concatenate([s, np.full(3, stop)]).astype(np.uint16)
    four = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 4)).view(np.uint64).ravel()
    ends = padded == stop
    ends[:-1] |= ends[1:]
    ends[:-2] |= ends[2:]
    ends = ends[:n]
    todo = np.flatnonzero(before[starts] >= 0)
    for width, text in ((4, four), (1, s)):
        open_ = todo
        while len(open_):
            i, j = starts[open_] + shared[open_], before[starts[open_]] + shared[open_]
            good = (np.maximum(i, j) < n) & (text[np.minimum(i, n - 1)] == text[np.minimum(j, n - 1)])
            good &= ~ends[np.minimum(i, n - 1)] if width > 1 else s[np.minimum(i, n - 1)] != stop
            open_ = open_[good]
            shared[open_] += width
    last = np.cumsum(fresh) - 1
    return np.maximum(shared[last] - (at - starts[last]), 0)

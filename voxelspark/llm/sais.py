"""Suffix arrays by induced sorting, and permuted common prefixes.

``suffix_array`` sorts bytes: suffixes are classified as larger or smaller than the next, the leftmost-smaller (LMS) substrings are sorted by inducing and named, their order is found by recursion, and two passes over the buckets induce the rest. On bytes the passes work on whole buckets with numpy. The recursion, whose alphabets are as large as their strings, ranks substrings and induces suffixes by sorting numbers (``sort_suffixes``), as a pass over so many buckets is slow in numpy.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffix array of a uint8 array; the end of the text counts as the smallest character."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    small = smaller_types(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if not len(lms):
        return induce(text, small, lms)
    order = induce(text, small, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = order[is_lms[order]]
    index = np.zeros(n, np.int64)
    index[lms] = np.arange(len(lms))
    ends = np.append(lms[1:] + 1, n)
    place = index[ordered]
    length = ends - lms
    last = place == len(lms) - 1  # its substring ends with the text, so it has no equal
    a, b = place[1:], place[:-1]
    new = (length[a] != length[b]) | last[1:] | last[:-1]
    alike = np.flatnonzero(~new)  # of one length: compared byte by byte
    if len(alike):
        sizes = length[a[alike]]
        begin = np.cumsum(sizes) - sizes
        step = np.arange(sizes.sum()) - np.repeat(begin, sizes)
        differs = text[np.repeat(lms[a[alike]], sizes) + step] != text[np.repeat(lms[b[alike]], sizes) + step]
        new[alike] = np.logical_or.reduceat(differs, begin)
    names = np.zeros(len(lms), np.int64)
    names[place] = np.concatenate([[0], np.cumsum(new)])
    if names.max() + 1 == len(lms):
        return induce(text, small, ordered)
    return induce(text, small, lms[sort_suffixes(names)])


def smaller_types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last is larger than the empty one."""
    n = len(text)
    differs = text[:-1] != text[1:]
    up = np.append(text[:-1] < text[1:], False)
    at = np.where(np.append(differs, True), np.arange(n), n)
    return up[np.minimum.accumulate(at[::-1])[::-1]]


def induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in the order induced by the LMS suffixes ``lms``, given in order: first the larger ones from the left, then the smaller ones from the right.

    A bucket's own suffixes are taken in rounds: those known so far induce their left neighbours, which join later buckets, or the end of this one and the next round.
    """
    n = len(text)
    sizes = np.bincount(text, minlength=256)
    starts = np.cumsum(sizes) - sizes
    out = np.full(n, -1, np.int64)
    seeds = [lms[text[lms] == c] for c in range(256)] if len(lms) < 256 else _split(lms, text[lms])

    heads = starts.copy()

    def push(suffixes: np.ndarray) -> None:
        keys = text[suffixes]
        order = np.argsort(keys, kind="stable")
        suffixes, keys = suffixes[order], keys[order]
        counts = np.bincount(keys, minlength=256)
        first = np.cumsum(counts) - counts
        out[heads[keys] + np.arange(len(keys)) - first[keys]] = suffixes
        heads[:] += counts

    used = np.flatnonzero(sizes)
    push(np.array([n - 1]))
    for c in used:
        at = starts[c]
        while at < heads[c]:
            batch = out[at : heads[c]]
            at = heads[c]
            left = batch[batch > 0] - 1
            push(left[~small[left]])
        left = seeds[c] - 1
        push(left[~small[left]])

    tails = starts + sizes

    def pull(suffixes: np.ndarray) -> None:
        """``suffixes`` come from the right; each goes before what its bucket's end holds."""
        keys = text[suffixes]
        order = np.argsort(keys, kind="stable")
        suffixes, keys = suffixes[order], keys[order]
        counts = np.bincount(keys, minlength=256)
        first = np.cumsum(counts) - counts
        out[tails[keys] - 1 - (np.arange(len(keys)) - first[keys])] = suffixes
        tails[:] -= counts

    for c in used[::-1]:
        at = starts[c] + sizes[c]
        while at > tails[c]:
            batch = out[tails[c] : at][::-1]
            at = tails[c]
            left = batch[batch > 0] - 1
            pull(left[small[left]])
        batch = out[starts[c] : heads[c]][::-1]
        left = batch[batch > 0] - 1
        pull(left[small[left]])
    return out


def _split(values: np.ndarray, keys: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(keys, kind="stable")
    return np.split(values[order], np.cumsum(np.bincount(keys, minlength=256))[:-1])


def sort_suffixes(s: np.ndarray) -> np.ndarray:
    """The suffix array of integers from 0 on, of an alphabet as large as it likes; the end counts as the smallest.

    One level of the recursion: places are classified as in ``suffix_array``, and the LMS substrings are ranked and named. If names repeat, their string is sorted by recursion. A suffix then follows from what stands before its next LMS suffix and from the rank of that one, which is one sort of numbers. Where types are part of the symbols, an LMS symbol never meets an equal one that is not LMS, so what stands before it decides as far as it differs.
    """
    n = len(s)
    order = np.argsort(s, kind="stable")
    if n < 2 or (np.diff(s[order]) > 0).all():
        return order
    text = np.append(s + 1, 0)  # the end is the last LMS suffix
    small = smaller_types(text)
    small[n] = True
    stop = np.append(False, small[1:] & ~small[:-1])
    lms = np.flatnonzero(stop)
    symbol = text * 2 + small
    places = np.arange(n + 1)
    nearest = np.minimum.accumulate(np.where(stop, places, n)[::-1])[::-1]
    after = np.append(nearest[1:], n)
    follow = ranks_to(symbol, nearest - places)
    own = dense(symbol[:n] * (follow.max() + 1) + follow[1:])
    names = dense(own[lms[:-1]])
    ranks = np.zeros(n + 1, np.int64)
    ranks[lms[:-1][sort_suffixes(names)]] = np.arange(1, len(lms))
    return np.argsort(own * len(lms) + ranks[after[:n]], kind="stable")


def dense(keys: np.ndarray) -> np.ndarray:
    """The ranks of numbers, equal ones alike, from 0 on."""
    order = np.argsort(keys)
    ordered = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.append(False, ordered[1:] != ordered[:-1]))[: len(keys)]
    return out


def ranks_to(symbol: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Ranks of the strings of symbols from each place to the one at its ``distance``; prefixes of two or three times the length at a time."""
    ranks, length, longest = symbol, 1, int(distance.max()) + 1 if len(distance) else 0
    while length < longest:
        base = int(ranks.max()) + 2
        key = ranks
        steps = 3 if base**3 < 1 << 62 else 2
        for k in range(1, steps):
            more = np.zeros(len(ranks), np.int64)
            at = np.flatnonzero(distance >= k * length)
            more[at] = ranks[at + k * length] + 1
            key = key * base + more
        ranks, length = dense(key), length * steps
    return ranks


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place of the text, the length of the prefix that its suffix shares with the one before it in the suffix array.

    If the characters before a pair are equal, its value is one less than that of the place to the left; only the other values are compared, eight characters at a time.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    places = np.arange(n)
    derived = np.zeros(n, bool)
    ok = before[1:] > 0
    derived[1:] = ok & (text[:-1] == text[np.where(ok, before[1:] - 1, 0)])
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    todo = np.flatnonzero(~derived & (before >= 0))
    length = np.zeros(len(todo), np.int64)
    active = np.arange(len(todo))
    while len(active):
        a, b = todo[active] + length[active], before[todo[active]] + length[active]
        inside = (a < n) & (b < n)
        active, a, b = active[inside], a[inside], b[inside]
        if not len(active):
            break
        same = np.cumprod(eight[a] == eight[b], axis=1).sum(1)
        step = np.minimum(same, n - np.maximum(a, b))
        length[active] += step
        active = active[step == 8]
    out[todo] = length
    last = np.maximum.accumulate(np.where(derived, -1, places))
    return np.where(derived, np.maximum(out[np.maximum(last, 0)] - (places - last), 0), out)

"""Suffix array by induced sorting, and permuted common prefixes, of a string that fits one task."""

from __future__ import annotations

import numpy as np


def suffix_types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S); the last symbol must be the unique smallest."""
    n = len(s)
    up = np.zeros(n, dtype=np.int8)
    up[:-1] = np.sign(s[1:].astype(np.int64) - s[:-1])
    up[-1] = 1
    # a run of equal symbols has the type of its last one
    decided = np.where(up != 0, np.arange(n), n)
    following = np.minimum.accumulate(decided[::-1])[::-1]
    return up[following] > 0


def name_substrings(s: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Ranks of the substrings from each leftmost-smaller position to the next, in text order; equal ones get equal ranks.

    Symbols are compared with their types behind them, several packed in a word; substrings longer than a word are refined
    word by word among those that still tie.
    """
    typed = s.astype(np.int64) * 2 + small
    bits = int(typed.max()).bit_length()
    per = max(1, 62 // bits)
    n, size = len(s), np.append(np.diff(lms) + 1, 1)

    def word(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), dtype=np.int64)
        for k in range(per):
            inside = left > k
            out = (out << bits) | np.where(inside, typed[np.minimum(at + k, n - 1)], 0)
        return out

    _, names = np.unique(word(lms, size), return_inverse=True)
    names = names.astype(np.int64)
    done = per
    while True:
        many = np.bincount(names)[names] > 1
        open_ = np.flatnonzero(many & (size > done))
        if not len(open_):
            return names
        # those that tie and have ended rank before none: their word is 0, and types keep prefixes apart
        tied = np.flatnonzero(np.isin(names, np.unique(names[open_])))
        more = word(lms[tied] + done, size[tied] - done)
        order = np.lexsort((more, names[tied]))
        a, b = names[tied][order], more[order]
        fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        head = np.concatenate([[True], a[1:] != a[:-1]])
        inner = np.cumsum(fresh) - 1
        inner -= np.maximum.accumulate(np.where(head, inner, 0))  # 0, 1, ... within a name
        wide = np.int64(inner.max() + 1) if len(inner) else np.int64(1)
        full = names * wide
        full[tied[order]] += inner
        _, names = np.unique(full, return_inverse=True)
        names = names.astype(np.int64)
        done += per


def induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array, from the leftmost-smaller suffixes in order: one scan places the larger, one back the smaller."""
    n = len(s)
    count = np.bincount(s)
    end = np.cumsum(count)
    sa = np.full(n, -1, dtype=np.int64)
    symbol = s[lms]
    # the i-th of a bucket's own, counted from its end
    from_end = np.cumsum(np.bincount(symbol, minlength=len(count)))[symbol] - np.arange(len(lms))
    sa[end[symbol] - from_end] = lms
    text, kind, order = s.tolist(), small.tolist(), sa.tolist()
    head = (end - count).tolist()
    for at in range(n):
        j = order[at] - 1
        if j >= 0 and not kind[j]:
            c = text[j]
            order[head[c]] = j
            head[c] += 1
    tail = end.tolist()
    for at in range(n - 1, -1, -1):
        j = order[at] - 1
        if j >= 0 and kind[j]:
            c = text[j]
            tail[c] -= 1
            order[tail[c]] = j
    return np.array(order, dtype=np.int64)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of integers whose last one is the unique smallest."""
    if len(s) == 1:
        return np.zeros(1, dtype=np.int64)
    small = suffix_types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    names = name_substrings(s, small, lms)
    order = np.argsort(names, kind="stable") if names.max() + 1 == len(names) else suffix_array(names)
    return induce(s, small, lms[order])


def permuted_prefixes(s: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """In text order: how many symbols each suffix shares with the one before it in the array, up to ``most``."""
    n = len(s)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, dtype=np.int64)
    live = np.flatnonzero(before >= 0)
    bits = int(s.max()).bit_length() if n else 1
    per = max(1, 62 // bits)
    padded = np.concatenate([s.astype(np.int64), np.zeros(per + 1, dtype=np.int64)])
    word = np.zeros(n + 1, dtype=np.int64)
    for k in range(per):
        word = (word << bits) | padded[k : k + n + 1]
    while len(live):
        a, b = live + out[live], before[live] + out[live]
        inside = (a < n) & (b < n)
        same = np.zeros(len(live), dtype=bool)
        same[inside] = word[a[inside]] == word[b[inside]]
        rest, now = live[~same], inside[~same]
        # the last word is compared symbol by symbol
        rest = rest[now]
        for _ in range(per):
            a, b = rest + out[rest], before[rest] + out[rest]
            ok = (a < n) & (b < n)
            ok[ok] = padded[a[ok]] == padded[b[ok]]
            rest = rest[ok]
            out[rest] += 1
        live = live[same]
        out[live] += per
        live = live[out[live] < most]
    return np.minimum(out, most)

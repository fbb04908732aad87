"""Suffix arrays by induced sorting, and permuted common prefixes, as NumPy array steps."""

from __future__ import annotations

import numpy as np

from speechloom.llm.batches import mixed


def _grouped(chars: np.ndarray, values: np.ndarray, queues: list[list[np.ndarray]]) -> None:
    """Append values to the queues of their characters, in order."""
    if not len(values):
        return
    order = np.argsort(chars, kind="stable")
    chars, values = chars[order], values[order]
    cut = [0, *(np.flatnonzero(chars[1:] != chars[:-1]) + 1).tolist(), len(values)]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        queues[chars[a]].append(values[a:b])


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _induce(text: np.ndarray, small: np.ndarray, heads: list[np.ndarray], size: int) -> np.ndarray:
    """All suffixes in order, from leftmost-smaller suffixes given in order for each character.

    One scan upwards places the suffixes larger than their right neighbour behind it, one scan downwards the smaller
    ones; a scan takes the characters one by one and all suffixes of a character together.
    """
    larger: list[np.ndarray] = []
    queues: list[list[np.ndarray]] = [[] for _ in range(size)]
    for char in range(size):
        now, placed = _joined(queues[char]), []
        while len(now):
            placed.append(now)
            before = now[now > 0] - 1
            before = before[~small[before]]
            near = text[before]
            _grouped(near[near != char], before[near != char], queues)
            now = before[near == char]  # runs of one character go on within its bucket
        larger.append(_joined(placed))
        before = heads[char][heads[char] > 0] - 1
        _grouped(text[before], before, queues)
    out: list[np.ndarray] = []
    queues = [[] for _ in range(size)]
    for char in range(size - 1, -1, -1):
        now, placed = _joined(queues[char]), []
        while len(now):
            placed.append(now)
            before = now[now > 0] - 1
            before = before[small[before]]
            near = text[before]
            _grouped(near[near != char], before[near != char], queues)
            now = before[near == char]
        down = larger[char][::-1]
        before = down[down > 0] - 1
        before = before[small[before]]
        _grouped(text[before], before, queues)
        out.append(_joined(placed))
        out.append(down)
    # The last character, the only smallest one, is induced by nothing.
    out.append(np.array([len(text) - 1], np.int32))
    return np.concatenate(out)[::-1]


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` in the order of their first ``depth`` characters at least.

    ``text`` holds small integers and ends with a 0 that stands nowhere else. Suffixes are classified against their
    right neighbour; substrings between leftmost-smaller suffixes are sorted by induction and named; the string of
    names is sorted in turn (by doubling its ranks until they differ or span ``depth``: its alphabet is large, and
    one array step per character would not pay); from its order all suffixes are induced.
    """
    n, size = len(text), int(text.max()) + 1 if len(text) else 1
    if n < 2:
        return np.arange(n)
    # The type of a suffix is that of the next change of character to its right.
    change = np.flatnonzero(text[1:] != text[:-1])
    rises = text[change] < text[change + 1]
    # The last two characters differ, so there is always a change.
    small = np.append(np.repeat(rises, np.diff(change, prepend=-1)), True)
    del change, rises
    first = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    if not len(first):
        first = np.array([n - 1], np.int32)

    def heads(order: np.ndarray) -> list[np.ndarray]:
        chars = text[order]
        rank = np.argsort(chars, kind="stable")
        return np.split(order[rank], np.searchsorted(chars[rank], np.arange(1, size)))

    order = _induce(text, small, heads(first), size)
    place = np.full(n, -1, np.int32)
    place[first] = np.arange(len(first))
    sub = place[order]
    sub = sub[sub >= 0]
    del place, order
    # Equal neighbours in this order are equal substrings; hashes of 64 bits tell.
    stop = np.append(first[1:] + 1, n)
    power = np.full(n + 1, np.uint64(0x9E3779B97F4A7C15))
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(text.astype(np.uint64) + np.uint64(1)) * power[:n])])
    inverse = np.full(n + 1, np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64)))
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    print_ = mixed((sums[stop] - sums[first]) * inverse[first] + (stop - first).astype(np.uint64))[sub]
    del power, sums, inverse
    # A name is the rank of the first of its equals; only those that have equals are sorted on.
    head = np.append(True, print_[1:] != print_[:-1])
    names = np.empty(len(first), np.int64)
    names[sub] = np.maximum.accumulate(np.where(head, np.arange(len(sub)), 0))
    equal = np.flatnonzero(~(head & np.append(head[1:], True)))
    span = 1
    while len(equal) and 2 * span < depth + 2:
        items = sub[equal]
        beyond = items + span
        pair = names[items] * (len(names) + 1) + np.where(beyond < len(names), names[np.minimum(beyond, len(names) - 1)] + 1, 0)
        rank = np.argsort(pair)
        items, pair = items[rank], pair[rank]
        head = np.append(True, pair[1:] != pair[:-1])
        sub[equal] = items
        names[items] = np.maximum.accumulate(np.where(head, equal, 0))
        equal = equal[~(head & np.append(head[1:], True))]
        span *= 2
    return _induce(text, small, heads(first[sub]), size)


def permuted_lcp(data: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """For each position of ``order`` in text order: bytes it shares with the position before it in ``order``, up to ``cap``.

    Returned as an array over all positions of ``data`` (0 for the first and for those outside ``order``). ``data`` must go
    on for ``cap`` bytes behind every position of ``order``.
    """
    phi = np.full(len(data), -1, np.int32)
    phi[order[1:]] = order[:-1]
    out = np.zeros(len(data), np.int16)
    at = np.flatnonzero(phi >= 0)
    words = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(8, np.uint8)), 8)
    words = np.ascontiguousarray(words).view("<u8").ravel()
    for step in range(0, cap, 8):
        if not len(at):
            break
        differ = words[at + step] ^ words[phi[at] + step]
        same = differ == 0
        low = differ[~same]
        low &= ~low + np.uint64(1)
        out[at[~same]] = np.minimum(cap, step + np.log2(low.astype(np.float64)).astype(np.int64) // 8)
        at = at[same]
        out[at] = min(cap, step + 8)
    return out

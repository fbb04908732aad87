"""Best monotone paths of many segments at once.

Segments of like length are padded to one group; a step of the search advances all of its segments by a frame, as one
array operation. Only a window of tokens around the best is followed (``_windowed``); every cell that leaves the window is
weighed by what the best path through it could still reach. Where that is less than what was found, the path is the best of
all; the few other segments are searched whole (``_group``). There scores are kept for every ``sqrt(frames)``-th frame only: on the way back each stretch between two
kept rows is computed again, so a group holds about ``2 * sqrt(frames) * tokens`` numbers per segment and never a
matrix of frames by tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Cells (segments x tokens) that one step of a group works on, padding included.
GROUP_CELLS = 1 << 16
GROUP_SEGMENTS = 256
#: Tokens of a segment that a search follows at a time; what one cannot settle goes to the next, then to the whole search.
WINDOWS = (32, 256)


@dataclass
class Segment:
    """Log-probabilities ``frames x classes`` with the wildcard's behind the last class, the tokens' classes, and the blank."""

    logp: np.ndarray
    tokens: np.ndarray
    blank: int


@dataclass
class Path:
    """Token, frame and probability of each step of a path; frames follow one another."""

    token: np.ndarray
    frame: np.ndarray
    prob: np.ndarray


def best_paths(segments: list[Segment]) -> list[Path | None]:
    """The best path of every segment; None where there are no tokens or more tokens than frames."""
    out: list[Path | None] = [None] * len(segments)
    able = [i for i, s in enumerate(segments) if 0 < len(s.tokens) <= len(s.logp)]
    for window in WINDOWS:
        for group in _grouped(segments, able, window):
            for i, path in zip(group, _windowed([segments[i] for i in group], window), strict=True):
                out[i] = path
        able = [i for i in able if out[i] is None]
    for group in _grouped(segments, able, None):
        for i, path in zip(group, _group([segments[i] for i in group]), strict=True):
            out[i] = path
    return out


def _grouped(segments: list[Segment], able: list[int], window: int | None) -> Iterator[list[int]]:
    """Segments of like length, as many as keep a step of the search within ``GROUP_CELLS``; a window bounds the tokens of each."""
    able = sorted(able, key=lambda i: (len(segments[i].logp), len(segments[i].tokens)))
    while able:
        most, take = 0, 0
        for i in able[:GROUP_SEGMENTS]:
            most = max(most, len(segments[i].tokens))
            if take and min(most, window or most) * (take + 1) > GROUP_CELLS:
                break
            take += 1
        group, able = able[:take], able[take:]
        yield group


def _reach(s: Segment) -> tuple[np.ndarray, np.ndarray, float]:
    """What a path can still gain: with ``r`` tokens to enter from frame ``t`` on, at most ``r * price + best[t + r] - sums[t]``.

    A path takes the blank's score in every frame but those where it enters a token, which give at most the frame's best
    class of a token. Any ``price`` of a token bounds that; the mean gain of a token makes the bound a close one.
    """
    blank = s.logp[:, s.blank].astype(np.float64)
    other = s.logp[:, np.unique(s.tokens)].max(axis=1).astype(np.float64)
    price = float(np.maximum(blank, other).sum() / len(s.tokens))
    if not np.isfinite(price):
        price = 0.0
    sums = np.concatenate([[0.0], np.cumsum(np.maximum(blank, other - price))])
    return np.maximum.accumulate(sums[::-1])[::-1], sums, price


def _windowed(segments: list[Segment], window: int) -> list[Path | None]:
    """Best paths found in a window of tokens that moves with the best score; None where a path outside might be as good."""
    order = sorted(range(len(segments)), key=lambda i: -len(segments[i].logp))
    segments = [segments[i] for i in order]
    n, frames = len(segments), np.array([len(s.logp) for s in segments])
    counts = np.array([len(s.tokens) for s in segments])
    wide = min(window, int(counts.max()))
    classes = np.array([s.logp.shape[1] for s in segments])
    flat = np.concatenate([s.logp.ravel() for s in segments]).astype(np.float32, copy=False)
    start = np.cumsum(frames * classes) - frames * classes
    blank_at = start + [s.blank for s in segments]
    # One token more than the window on either side of what it reads; those behind the end are never entered.
    padded = np.zeros((n, int(counts.max()) + wide + 1), np.int64)
    longest = int(frames[0])
    before = np.full((longest, n), -np.inf, np.float32)
    best, sums = np.full((n, longest + 2), -np.inf), np.zeros((n, longest + 2))
    price = np.zeros(n)
    for i, s in enumerate(segments):
        padded[i, : counts[i]] = s.tokens
        run = np.cumsum(s.logp[:, s.blank], dtype=np.float32)
        starts = len(run) + 1 - counts[i]
        before[0, i] = 0.0
        before[1:starts, i] = run[: starts - 1]
        best[i, : len(run) + 1], sums[i, : len(run) + 1], price[i] = _reach(s)
    tokens = padded.ravel()
    line = np.arange(n) * padded.shape[1]
    at_line = np.arange(n) * (longest + 2)
    best, sums = best.ravel(), sums.ravel()

    def hope(k: int, t: int, value: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The most that cells of the first ``k`` segments reach with ``left`` tokens to enter from frame ``t`` on."""
        far = np.minimum(t + left, longest + 1)
        reach = np.where(left >= 0, best.take(at_line[:k] + far), -np.inf)
        return value + left * price[:k] + (reach - sums.take(at_line[:k] + t))

    span = np.arange(wide)
    cell = np.full((n, wide + 2), -np.inf, np.float32)  # the window's scores between the cells beside it
    first = np.zeros(n, np.int64)
    entered = np.zeros((longest, n, (wide + 7) // 8), np.uint8)
    firsts = np.zeros((longest, n), np.int64)
    top, end, lost = np.full(n, -np.inf, np.float32), np.zeros(n, np.int64), np.full(n, -np.inf)
    active = np.searchsorted(-frames, -np.arange(longest), side="left")
    last = np.maximum(counts - wide, 0)
    with np.errstate(invalid="ignore"):
        for t in range(longest):
            k = int(active[t])
            head, row = first[:k], cell[:k]
            row[:, 0] = np.where(head == 0, before[t, :k], -np.inf)
            step = t * classes[:k]
            blank = flat[blank_at[:k] + step]
            ahead = row[:, 1:-1].argmax(axis=1)
            move = (head < last[:k]) & ((ahead > wide // 2) | (head < counts[:k] - wide - (frames[:k] - t - 1)))
            if wide < padded.shape[1] - wide - 1:
                # What leaves: the cell in front and the first one's staying, or the last one's going on.
                left = counts[:k] - 1 - head
                gone = np.maximum(hope(k, t, row[:, 0], left + 1), hope(k, t + 1, row[:, 1] + blank, left))
                entry = flat[start[:k] + step + tokens[line[:k] + head + wide]]
                over = hope(k, t + 1, row[:, -2] + entry, left - wide)
                drop = np.where(move, gone, over)
                np.fmax(lost[:k], drop, out=lost[:k])
                prev = np.where(move[:, None], row[:, 1:], row[:, :-1])
                first[:k] += move
            else:
                prev = row[:, :-1]
            score = flat.take(tokens.take((line[:k] + head)[:, None] + span) + (start[:k] + step)[:, None])
            moved, stayed = prev[:, :-1] + score, prev[:, 1:] + blank[:, None]
            entered[t, :k] = np.packbits(moved > stayed, axis=1)
            firsts[t, :k] = head
            np.maximum(moved, stayed, out=row[:, 1:-1])
            final = counts[:k] - 1 - head
            value = np.where(final < wide, row[np.arange(k), 1 + np.minimum(final, wide - 1)], -np.inf)
            better = value > top[:k]
            top[:k][better], end[:k][better] = value[better], t + 1
    # Sums in single precision stray by less than this.
    slack = frames * 2.0 ** -22 * (1 + np.abs(top, where=np.isfinite(top), out=np.zeros(n, np.float32)))
    sure = np.isfinite(top) & (lost < top - slack) & np.isfinite(sums).reshape(n, -1).all(axis=1)
    token = np.full((longest, n), -1, np.int32)
    prob = np.zeros((longest, n))
    j = np.where(sure, counts - 1, -1)
    for t in range(int(end[sure].max(initial=0)) - 1, -1, -1):
        on = np.flatnonzero((t < end) & (j >= 0))
        if not len(on):
            continue
        own = j[on] - firsts[t, on]
        step = (entered[t, on, own >> 3] >> (7 - (own & 7))) & 1
        token[t, on] = j[on]
        prob[t, on] = flat[np.where(step, start[on] + tokens[line[on] + j[on]], blank_at[on]) + t * classes[on]]
        j[on] -= step
    out: list[Path | None] = [None] * n
    for i in np.flatnonzero(sure):
        used = np.flatnonzero(token[:, i] >= 0)
        out[order[i]] = Path(token[used, i].astype(np.int64), used, np.exp(prob[used, i]))
    return out


class _Group:
    """Padded view of some segments: what a step reads at a frame."""

    def __init__(self, segments: list[Segment]):
        self.frames = np.array([len(s.logp) for s in segments])
        self.counts = np.array([len(s.tokens) for s in segments])
        classes = np.array([s.logp.shape[1] for s in segments])
        self.flat = np.concatenate([s.logp.ravel() for s in segments]).astype(np.float32, copy=False)
        start = np.cumsum(self.frames * classes) - self.frames * classes
        tokens = np.zeros((len(segments), self.counts.max()), np.int64)
        for row, s in zip(tokens, segments, strict=True):
            row[: len(s.tokens)] = s.tokens
        self.token_at, self.blank_at, self.classes = start[:, None] + tokens, start + [s.blank for s in segments], classes
        # Score before the first token: blanks only; no start is allowed when too few frames are left for all tokens.
        width = int(self.frames.max())
        self.before = np.full((width, len(segments)), np.inf, np.float32)
        for i, s in enumerate(segments):
            sums = np.cumsum(s.logp[:, s.blank], dtype=np.float32)
            self.before[0, i] = 0.0
            self.before[1: len(sums), i] = sums[:-1]
            self.before[max(0, len(sums) + 1 - len(s.tokens)):, i] = np.inf

    def scores(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all tokens and of the blank at a frame; behind its end a segment repeats its last."""
        step = np.minimum(t, self.frames - 1) * self.classes
        return self.flat[self.token_at + step[:, None]], self.flat[self.blank_at + step]

    def moves(self, t: int, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of entering each token at frame ``t`` and of staying in it, from the ``row`` before the frame."""
        token, blank = self.scores(t)
        ahead = np.concatenate([self.before[t][:, None], row[:, :-1]], axis=1)
        return ahead + token, row + blank[:, None]


def _group(segments: list[Segment]) -> list[Path | None]:
    group = _Group(segments)
    n, count = group.token_at.shape
    frames = int(group.frames.max())
    every = max(1, int(np.sqrt(frames)))
    row = np.full((n, count), -np.inf, np.float32)
    kept, best, at = [], np.full(n, -np.inf, np.float32), np.zeros(n, np.int64)
    who = np.arange(n)
    for t in range(frames):
        if t % every == 0:
            kept.append(row)
        row = np.maximum(*group.moves(t, row))
        final = row[who, group.counts - 1]
        better = (final > best) & (t < group.frames)
        best[better], at[better] = final[better], t + 1
    # Back from the best end: token of each frame, and whether it was entered there.
    token = np.full((frames, n), -1, np.int32)
    prob = np.zeros((frames, n))
    j = group.counts - 1
    for k in range(len(kept) - 1, -1, -1):
        low, high = k * every, min((k + 1) * every, frames)
        entered, row = np.empty((high - low, n, count), bool), kept[k]
        for t in range(low, high):
            moved, stayed = group.moves(t, row)
            np.greater(moved, stayed, out=entered[t - low])
            row = np.maximum(moved, stayed)
        for t in range(high - 1, low - 1, -1):
            on = np.flatnonzero((t < at) & (j >= 0))
            if not len(on):
                continue
            own = j[on]
            step = entered[t - low, on, own]
            offset = t * group.classes[on]
            token[t, on] = own
            prob[t, on] = group.flat[np.where(step, group.token_at[on, own], group.blank_at[on]) + offset]
            j[on] -= step
    out: list[Path | None] = []
    for i in range(n):
        used = np.flatnonzero(token[:, i] >= 0)
        out.append(Path(token[used, i].astype(np.int64), used, np.exp(prob[used, i])) if j[i] < 0 else None)
    return out

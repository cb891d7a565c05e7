"""Attacks in blocks of samples: frames whose spectrum grows, placed to the sample, loud enough and rising; and the sounds that begin there.

Every kernel takes an array and the sample at which it begins, and says the same of a frame or an attack whatever block it is seen from. What
needs the whole stem (its loudest sample, its strongest growth) comes as a number.
"""

from __future__ import annotations

import math

import numpy as np

from tidemark.operators.signal import FRAME, GATE, HOP, LONGEST_S, SILENCE, fingerprint, flux_of_frames, peak, root_mean_square

GAP_S, PREROLL_S, DELTA = 0.05, 0.003, 0.07
#: Seconds before and behind a frame in which it must be the highest, and in which it must stand out from the mean.
HIGHEST_S, MEAN_S = (0.03, 0.01), (0.1, 0.07)
#: A fine block, and how many before it its level is held against.
FINE, BEFORE = 64, 4
#: How far an attack may be from the middle of its frame, and frames whose attacks may come out of order.
NEAR = FRAME // 2 + HOP
CROSSED = -(-(2 * NEAR + BEFORE * FINE) // HOP)


def frames_in(rate: float, seconds: tuple[float, float]) -> tuple[int, int]:
    before, behind = (max(1, math.floor(s * rate / HOP + 0.5)) for s in seconds)
    return before, behind


def reach(rate: float) -> int:
    """Samples around a block that its attacks depend on."""
    around = max(max(frames_in(rate, s)) for s in (HIGHEST_S, MEAN_S))
    return max((CROSSED + around + 2) * HOP + FRAME, NEAR + (BEFORE + 1) * FINE + int(GAP_S * rate))


def frame_range(block_no: int, block: int, n: int) -> tuple[int, int]:
    """Frames of a block: those whose middle lies in it; the last block of a track has the frame at its very end too."""
    first = -(-block_no * block // HOP)
    return first, n // HOP + 1 if (block_no + 1) * block >= n else -(-(block_no + 1) * block // HOP)


def around(values: np.ndarray, before: int, behind: int, fill: float) -> np.ndarray:
    """Row t: the values from ``before`` places before t to ``behind`` places behind it."""
    padded = np.concatenate([np.full(before, fill), values, np.full(behind, fill)])
    return np.lib.stride_tricks.sliding_window_view(padded, before + behind + 1)


def salient(growth: np.ndarray, rate: float, first: int, count: int) -> np.ndarray:
    """Whether each frame's growth, as a share of the stem's strongest, stands out. growth: frames from ``first`` on of ``count`` in the track."""
    highest = around(growth, *frames_in(rate, HIGHEST_S), -np.inf).max(axis=1)
    before, behind = frames_in(rate, MEAN_S)
    frame = first + np.arange(len(growth))
    there = np.minimum(frame + behind, count - 1) - np.maximum(frame - before, 0) + 1
    mean = around(growth, before, behind, 0.0).sum(axis=1) / there
    return (growth > DELTA) & (growth >= highest) & (growth >= mean + DELTA)


def gather(x: np.ndarray, begin: int, at: np.ndarray, before: int, behind: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Samples from ``before`` before to ``behind`` behind each place, one row each, and which of them lie in the track."""
    place = at[:, None] + np.arange(-before, behind)
    inside = (place >= 0) & (place < n)
    return np.where(inside, x[np.clip(place - begin, 0, len(x) - 1)], 0.0), inside


def place(x: np.ndarray, begin: int, n: int, centres: np.ndarray) -> np.ndarray:
    """Where the attack near each centre begins: in the fine block that stands out most from those before it, the first sample at a tenth of its peak."""
    if not len(centres):
        return centres
    start, end = np.maximum(centres - NEAR, 0), np.minimum(centres + NEAR, n)
    base = np.maximum(start - BEFORE * FINE, 0)
    loud, _ = gather(np.abs(x), begin, base, 0, 2 * NEAR + BEFORE * FINE, n)
    loud[base[:, None] + np.arange(loud.shape[1]) >= end[:, None]] = -1.0  # not heard
    level = loud.reshape(len(base), -1, FINE).max(axis=2)
    earlier = np.stack([around(row, BEFORE, 0, 0.0)[:, :-1].max(axis=1) for row in level])
    number = np.arange(level.shape[1])
    counts = (number >= ((start - base) // FINE)[:, None]) & (level >= 0)
    gain = np.where(counts, np.maximum(level, 0) / np.maximum(earlier, 1e-4), -1.0)
    best = gain.argmax(axis=1)
    inner = np.take_along_axis(loud.reshape(len(base), -1, FINE), best[:, None, None], axis=1)[:, 0]
    return base + best * FINE + (inner >= inner.max(axis=1, keepdims=True, initial=0.0) / 10).argmax(axis=1)


def audible(x: np.ndarray, begin: int, n: int, rate: float, at: np.ndarray, loudest: float) -> np.ndarray:
    """Whether what follows each attack is loud enough, and louder than what was before it."""
    short = int(0.01 * rate)
    after, _ = gather(np.abs(x), begin, at, 0, int(GAP_S * rate), n)
    square, inside = gather(x * x, begin, at, short, short, n)
    mean = [part.sum(axis=1) / np.maximum(there.sum(axis=1), 1) for part, there in ((square[:, :short], inside[:, :short]), (square[:, short:], inside[:, short:]))]
    return (after.max(axis=1, initial=0.0) >= loudest * GATE) & ((at == 0) | (np.sqrt(mean[1]) > 1.2 * np.sqrt(mean[0])))


def candidates(x: np.ndarray, begin: int, n: int, rate: float, frames: tuple[int, int], strongest: float, loudest: float) -> np.ndarray:
    """Attacks of the frames from ``frames[0]`` to ``frames[1]`` that lie behind those of all frames before, in order; only their distance is left to test."""
    if not strongest > 0 or not n:
        return np.zeros(0, dtype=np.int64)
    first, last = frames
    count = n // HOP + 1
    wide = max(max(frames_in(rate, s)) for s in (HIGHEST_S, MEAN_S))
    seen = max(0, first - CROSSED - wide), min(count, last + wide)
    growth = flux_of_frames(x, begin, *seen, [range(FRAME // 2)])[0] / strongest
    frame = seen[0] + np.flatnonzero(salient(growth, rate, seen[0], count))
    frame = frame[(frame >= first - CROSSED) & (frame < last)]
    at = place(x, begin, n, frame * HOP)
    fine = audible(x, begin, n, rate, at, loudest)
    frame, at = frame[fine], at[fine]
    # an attack that is not behind an earlier frame's can be no new one: that one, or the one it was too near to, stands in its way
    ahead = np.concatenate([[-1], np.maximum.accumulate(at)[:-1]]) if len(at) else at
    return at[(frame >= first) & (at > ahead)]


def spaced(at: np.ndarray, gap: float, last: float = -math.inf) -> np.ndarray:
    """Which of ordered places are kept when each must come ``gap`` after the one kept before; ``last``: the one kept before them all."""
    chosen, k = [], int(np.searchsorted(at, last + gap, side="left"))
    while k < len(at):
        chosen.append(k)
        k = max(k + 1, int(np.searchsorted(at, at[k] + gap, side="left")))
    return np.array(chosen, dtype=np.int64)


def onsets(mono: np.ndarray, rate: float) -> list[int]:
    """Attacks of a whole stem that is at hand as one array."""
    every = (0, len(mono) // HOP + 1)
    strongest = flux_of_frames(mono, 0, *every, [range(FRAME // 2)])[0].max(initial=0.0) if len(mono) else 0.0
    found = candidates(np.asarray(mono, dtype=np.float64), 0, len(mono), rate, every, strongest, peak(mono))
    return found[spaced(found, int(GAP_S * rate))].tolist()


def sound_end(x: np.ndarray, begin: int, attack: int, until: int, rate: float, loudest: float) -> int:
    """Where a sound ends: at ``until`` or two seconds on, without the quiet stretches of 10 ms at its end."""
    step = int(0.01 * rate)
    end = min(until, attack + int(LONGEST_S * rate))
    most = max(0, -(-(end - attack - 2 * step) // step))
    tail = np.abs(x[end - most * step - begin : end - begin]).reshape(most, step).max(axis=1, initial=0.0)[::-1]
    loud = np.flatnonzero(tail >= loudest * SILENCE)
    return end - step * int(loud[0] if len(loud) else most)


def describe_hit(x: np.ndarray, begin: int, attack: int, following: int, until: int, rate: float, loudest: float, edges: list[int]) -> tuple[int, float, float, np.ndarray]:
    """(end, peak, level of what rings on before it, fingerprint) of the sound of an attack. following: the next attack; until: the next sound's start."""
    at, lead = attack - begin, int(PREROLL_S * rate)
    return (
        sound_end(x, begin, attack, until, rate, loudest),
        peak(x[at : at + int(GAP_S * rate)]),
        root_mean_square(x[max(0, at - lead) : at]),
        fingerprint(x, at, following - begin, edges),
    )

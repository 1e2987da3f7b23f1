"""Words of a text and stretches of aligned words, for several operators."""

from __future__ import annotations

import re

import numpy as np

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    """Runs of ``\\w`` in lower case; none of a null text."""
    return _WORD.findall(text.lower()) if text else []


def longest_stretch(equal: np.ndarray, share: float) -> tuple[int, int]:
    """The longest [i, j) in which at least ``share`` of ``equal`` is true (the
    first of them), without the false ones at its ends; (0, 0) if none is true."""
    n = len(equal)
    if n == 0 or not equal.any():
        return 0, 0
    total = np.concatenate(([0.0], np.cumsum(equal - share)))
    below = np.minimum.accumulate(total)
    starts = np.flatnonzero(np.concatenate(([True], total[1:] < below[:-1])))   # each lower than all before
    above = np.maximum.accumulate(total[::-1])[::-1]
    # the last place whose later maximum is not below the start: ``above`` never rises
    ends = n - np.searchsorted(above[::-1], total[starts] - 1e-9, "left")
    best = int(np.argmax(ends - starts))
    i, j = int(starts[best]), int(ends[best])
    inside = np.flatnonzero(equal[i:j])
    return (i + int(inside[0]), i + int(inside[-1]) + 1) if len(inside) else (0, 0)


def _longest_between(equal: np.ndarray, share: float) -> tuple[int, int]:
    """The longest [i, j) that begins and ends with a true one and of which at least
    ``share`` is true (the first of them); (0, 0) if none is true."""
    places = np.flatnonzero(equal)
    if not len(places):
        return 0, 0
    total = np.concatenate(([0.0], np.cumsum(equal - share)))
    lead, tail = total[places], total[places + 1]
    lower = np.concatenate(([True], lead[1:] < np.minimum.accumulate(lead)[:-1]))
    starts = np.flatnonzero(lower)                  # no earlier start is as low
    above = np.maximum.accumulate(tail[::-1])       # by place from the last, never falling
    last = len(places) - 1 - np.searchsorted(above, lead[starts] - 1e-9, "left")
    length = places[last] - places[starts]
    best = int(np.argmax(length))
    return int(places[starts[best]]), int(places[last[best]]) + 1


def stretches(equal: np.ndarray, share: float, least: int) -> list[tuple[int, int]]:
    """Disjoint stretches of at least ``least`` that begin and end with a true one and of
    which at least ``share`` is true: the longest (first of them), then those of what
    lies to its left and right, in order."""
    found, open_ = [], [(0, len(equal))]
    while open_:
        a, b = open_.pop()
        if b - a < least:
            continue
        i, j = _longest_between(equal[a:b], share)
        if j - i >= least:
            found.append((a + i, a + j))
            open_ += [(a, a + i), (a + j, b)]
    return sorted(found)

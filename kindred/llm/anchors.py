"""Anchors: places that any two equal strings of WINDOW bytes share.

Of the K-byte strings that begin in a window's first WINDOW - K + 1 places, the one with
the least hash (the first, if equal) is the window's anchor. It depends on the window's
bytes alone, so equal windows have equal anchors at equal offsets. About two in
WINDOW - K + 2 places are anchors; each stands for the run of windows that chose it.
"""

from __future__ import annotations

import numpy as np

from kindred.llm.text import _INV, BASE, TABLE, U, mix, powers

WINDOW, K = 400, 300
SIDE = WINDOW - K  # bytes that a window may have before or after its anchor's string
_AT = U((1 << 28) - 1)


class Rolling:
    """Hashes of any substrings of a buffer."""

    def __init__(self, buf: np.ndarray):
        self.scan = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(TABLE[buf] * powers(_INV, len(buf)), out=self.scan[1:])
        self.power = powers(BASE, len(buf) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.scan[end] - self.scan[start]) * self.power[start])


def anchors(texts: list[bytes], start_of: np.ndarray, buf: np.ndarray) -> dict[str, np.ndarray]:
    """For texts laid end to end in buf (text i from start_of[i]): text, p (the anchor), e1 and e2 (first and last window that chose it), h (hash of the anchor's string); places are within the text."""
    size = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    none = {k: np.empty(0, dtype=np.int64) for k in ("text", "p", "e1", "e2")} | {"h": np.empty(0, dtype=np.uint64)}
    if not len(buf) or not (size >= WINDOW).any():
        return none
    roll, n = Rolling(buf), len(buf)
    order = (mix((roll.scan[K:] - roll.scan[:-K]) * roll.power[: n + 1 - K]) & ~_AT) | np.arange(n + 1 - K, dtype=np.uint64)
    # Least of SIDE + 1 = 101 places: by doubling to 64, then two overlapping spans of 64.
    low, span = order, 1
    while span * 2 <= SIDE + 1:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: n + 1 - WINDOW], low[SIDE + 1 - span :][: n + 1 - WINDOW])
    place = (low & _AT).astype(np.int64)
    valid = np.zeros(len(place), dtype=bool)
    owner = np.zeros(len(place), dtype=np.int64)
    for i in np.flatnonzero(size >= WINDOW):
        valid[start_of[i] : start_of[i] + size[i] - WINDOW + 1] = True
        owner[start_of[i] : start_of[i] + size[i] - WINDOW + 1] = i
    window = np.flatnonzero(valid)
    place, owner = place[window], owner[window]
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(window)]]) - 1
    text, p = owner[first], place[first]
    base = start_of[text]
    return {"text": text, "p": p - base, "e1": window[first] - base, "e2": window[last] - base, "h": roll.of(p, p + K)}

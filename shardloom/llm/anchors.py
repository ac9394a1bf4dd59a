"""Anchors of fixed-length windows: the place of the smallest k-byte hash in each window.

Equal windows have their anchor at the same offset, so windows can only be equal under equal anchors. A text of n bytes
has about 2n / (w + 1) anchors for w = length - k + 1; each has a run of successive windows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from .shingles import U, hashes, mix

K = 20
_B = U(0x9E3779B97F4A7C15)
_INV = U(pow(int(_B), -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.multiply.accumulate(np.append(U(1), np.full(size, b, U))) for b in (_B, _INV)]
    return _POWERS


def _slide(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over x[i : i + w] for each i."""
    span, n = 1, len(x)
    while span * 2 <= w:
        x = op(x[: len(x) - span], x[span:])
        span *= 2
    m = n - w + 1
    return op(x[:m], x[w - span : w - span + m]) if w > span else x[:m]


def window_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """What orders the places. Chance or malice that makes two of them equal moves an anchor, and loses no window."""
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.append(U(0), np.cumsum((data.astype(U) + U(1)) * up[: len(data)], dtype=U))
        return mix((sums[k:] - sums[:-k]) * down[: len(data) - k + 1])


class Runs(NamedTuple):
    """Runs of windows of texts that lie end to end. anchor, content: hashes of the anchor's bytes, and of all bytes of
    the run with the anchor's place among them; text: the run's text; start, end: its first window and the one past its last."""

    text: np.ndarray
    anchor: np.ndarray
    content: np.ndarray
    start: np.ndarray
    end: np.ndarray
    place: np.ndarray


def runs(texts: list[bytes], length: int, k: int = K) -> Runs:
    """Runs of all windows inside the texts, in order. Of equal hashes in a window the leftmost is the anchor."""
    joined, w = b"".join(texts), length - k + 1
    none = np.empty(0, np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    long = np.flatnonzero(sizes >= length)
    if not len(long):
        return Runs(none, none.astype(U), none.astype(U), none, none, none)
    h = window_hashes(np.frombuffer(joined, np.uint8), k)
    least = _slide(h, w, np.minimum)
    # A place is an anchor if it holds the minimum of some window. Windows with one minimum lie side by side, and the places
    # that hold it follow each other: each takes the windows after the place before, up to the one that starts at it.
    padded = np.concatenate([np.zeros(w - 1, U), least, np.zeros(w - 1, U)])
    places = np.flatnonzero(h == _slide(padded, w, np.maximum)[: len(h)])
    value = h[places]
    other = value[1:] != value[:-1]
    turn = np.flatnonzero(least[1:] != least[:-1]) + 1
    of = np.append(0, np.cumsum(other))
    start = np.append(0, turn)[of]
    start[1:] = np.maximum(start[1:], np.where(other, 0, places[:-1] + 1))
    some = start < np.minimum(np.append(turn, len(least))[of], places + 1)
    begins, places = start[some], places[some]
    # Windows inside one text: the runs are parted where a text's first window is, and after its last.
    first = (np.cumsum(sizes) - sizes)[long]
    last = first + sizes[long] - length + 1
    bound = np.sort(np.concatenate([begins, first, last]), kind="stable")
    of, after = np.searchsorted(first, bound, "right") - 1, np.append(bound[1:], 0)
    inside = (of >= 0) & (bound < last[of]) & (bound < after)
    start, end, text = bound[inside], after[inside], long[of[inside]]
    place = places[np.searchsorted(begins, start, "right") - 1]
    with np.errstate(over="ignore"):
        content = mix(hashes(joined, start, end + length - 1, 2) + (place - start).astype(U))
    return Runs(text, hashes(joined, place, place + k, 1), content, start, end, place)

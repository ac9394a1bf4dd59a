"""Distinct word shingles of many texts at once, as 64-bit hashes of the words' bytes."""

from __future__ import annotations

import numpy as np

from .common import blocks

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
#: The low bytes of a number that a piece of so many bytes fills.
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], U)
_ODD = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def hashes(joined: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each joined[start:end]: eight bytes at a time, with a finaliser after each eight, so that no sum or
    polynomial structure of the bytes carries over to the hash."""
    eight = np.ndarray((len(joined) + 1,), U, joined + b"\x00" * 8, 0, (1,))
    size = ends - starts
    with np.errstate(over="ignore"):
        h = mix(size.astype(U) * _ODD + U(seed))
        live, at, rest, x, done = None, starts, size, h, 0  # live: which of h the rows x are; None while they are all
        while len(rest) and rest.max() > 0:
            if rest.min() <= 0:
                on = np.flatnonzero(rest > 0)
                if live is not None:
                    h[live] = x
                live, at, rest, x = on if live is None else live[on], at[on], rest[on], x[on]
            piece = eight[at + done] if rest.min() >= 8 else eight[at + done] & _MASK[np.minimum(rest, 8)]
            x = mix((x ^ piece) * _ODD + U(done + 1))
            if live is None:
                h = x
            rest = rest - 8
            done += 8
        if live is not None:
            h[live] = x
    return h


def words(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the maximal runs without white space."""
    space = np.concatenate([[True], _SPACE[np.frombuffer(joined, np.uint8)], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[::2], hashes(joined, edge[::2], edge[1::2])


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each text, A-Z lower-cased. A text with fewer words has its whole sequence as one, one without words none."""
    out: list[np.ndarray] = []
    for a, b in blocks([len(t) for t in texts]):
        part = texts[a:b]
        starts, h = words(b"\n".join(part).lower())
        bounds = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in part]))
        with np.errstate(over="ignore"):
            rolled = np.zeros(max(0, len(h) - width + 1), U)
            for k in range(width):
                rolled = mix(rolled * U(3) + h[k : k + len(rolled)] + U(k))
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if e - s >= width:
                    out.append(np.unique(rolled[s : e - width + 1]))
                elif e > s:
                    x = U(e - s) * np.ones(1, U)
                    for k in range(s, e):
                        x = mix(x * U(5) + h[k])
                    out.append(x)
                else:
                    out.append(np.empty(0, U))
    return out

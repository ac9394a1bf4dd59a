"""Word boundaries of byte-level and word-end BPE, found for many texts at once from code-point classes.

Texts are laid end to end with a mark between them; runs of one class (letter, number, white space, other) are found by
comparing neighbours, and the patterns' few rules on blanks and contractions are applied to the runs.
"""

from __future__ import annotations

import unicodedata

import numpy as np

LETTER, NUMBER, SPACE, OTHER, MARK = range(5)
#: White space outside these is none for the patterns (fixed values: the Unicode property White_Space).
SPACES = (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_CLASSES: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of each code point; MARK at 0x110000."""
    global _CLASSES
    if _CLASSES is None:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        table[list(SPACES)] = SPACE
        _CLASSES = np.append(table, np.uint8(MARK))
    return _CLASSES


def code_points(texts: list[str]) -> np.ndarray:
    """Code points of the texts, each followed by a mark."""
    joined = np.frombuffer("\x00".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) - 1
    joined[ends] = 0x110000
    return joined


def _runs(cp: np.ndarray):
    cls = classes()[cp]
    starts = np.flatnonzero(np.append(True, cls[1:] != cls[:-1])) if len(cls) else np.empty(0, np.int64)
    return starts, np.append(starts[1:], len(cls)), cls[starts] if len(cls) else cls


def _contractions(cp, starts, ends, kinds, blank_before):
    """Letters that an apostrophe standing alone takes from the run of letters after it, for each run of others."""
    take = np.zeros(len(starts), np.int64)
    at = np.flatnonzero((kinds == OTHER) & (ends - starts == 1) & ~blank_before)
    at = at[(at + 1 < len(starts))]
    at = at[(cp[starts[at]] == 0x27) & (kinds[at + 1] == LETTER)]
    if len(at):
        s = starts[at + 1]
        one = cp[s]
        two = np.where(ends[at + 1] - s > 1, cp[np.minimum(s + 1, len(cp) - 1)], 0)
        take[at] = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        take[at[pair]] = 2
    return take


def blank_led(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends for '(contraction)| ?letters| ?numbers| ?others|white space (?!non-space)|white space'."""
    starts, ends, kinds = _runs(cp)
    if not len(starts):
        return starts, starts
    word = (kinds != SPACE) & (kinds != MARK)
    prev_blank = np.append(False, (kinds[:-1] == SPACE) & (cp[ends[:-1] - 1] == 0x20))
    led = word & prev_blank
    take = _contractions(cp, starts, ends, kinds, prev_blank)
    s = starts - led
    s[1:] += take[:-1]
    e = ends + take
    space = np.flatnonzero(kinds == SPACE)
    before_word = np.append(word[1:], False)[space]
    last_blank = cp[ends[space] - 1] == 0x20
    e[space] -= before_word
    lone = space[before_word & ~last_blank]
    keep = (kinds != MARK) & (s < e)
    s_all, e_all = np.concatenate([s[keep], ends[lone] - 1]), np.concatenate([e[keep], ends[lone]])
    order = np.argsort(s_all, kind="stable")
    return s_all[order], e_all[order]


def bare(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends for '(contraction)|letters|one number|others'; white space is dropped."""
    starts, ends, kinds = _runs(cp)
    if not len(starts):
        return starts, starts
    take = _contractions(cp, starts, ends, kinds, np.zeros(len(starts), bool))
    s, e = starts.copy(), ends + take
    s[1:] += take[:-1]
    keep = ((kinds == LETTER) | (kinds == OTHER)) & (s < e)
    digits = np.flatnonzero(classes()[cp] == NUMBER)
    s_all, e_all = np.concatenate([s[keep], digits]), np.concatenate([e[keep], digits + 1])
    order = np.argsort(s_all, kind="stable")
    return s_all[order], e_all[order]

"""Format-preserving pseudonyms for personal data, by a keyed Feistel network.

Each kind turns a validated value into a number below the size of its format's domain, a Feistel network permutes that
domain under the key, and the number is written back in the same format: lengths, separators and letter case stay, check
digits are made to fit, dates stay dates. The permutation walks on until the result is valid in its kind too, so it is
invertible with the key, and equal values get equal pseudonyms in every document.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import unicodedata
from collections.abc import Callable
from functools import cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ready

ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
KINDS = ("email", "iban", "ip", "date", "ssn", "phone", "card")

RUN = re.compile(r"[0-9 ().+/\-]+")
NUMBERS = {
    "ip": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "date": r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "card": r"[0-9](?:[ -]?[0-9]){12,18}",
    "phone": r"(?:\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,4}\)?){2,5}|\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}|[0-9]{3}(?P<mark>[-. ])[0-9]{3}(?P=mark)[0-9]{4}|0[1-9][0-9]{1,3}[-/ ][0-9]{6,8})",
}
#: A date may have a time of day after it.
HEAD, TAIL = r"(?<![\w@/])(?<![0-9]\.)", r"(?:(?=T[0-9]{2}:)|(?![\w@]|-[0-9]))"
AHEAD = 4
NUMBER = re.compile(f"{HEAD}(?:{'|'.join(NUMBERS.values())}){TAIL}", re.ASCII)
EACH = {k: re.compile(f"{v}{TAIL}", re.ASCII) for k, v in NUMBERS.items()}
AFTER = re.compile(TAIL, re.ASCII)
LOCAL = re.compile(r"[\w.%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")
_IBAN = r"[{0}]{{2}}[0-9]{{2}}(?:[{0}0-9]{{11,30}}|(?: [{0}0-9]{{4}}){{2,7}}(?: [{0}0-9]{{1,4}})?)"
IBAN = re.compile(f"(?<![A-Za-z0-9])(?:{_IBAN.format('A-Z')}|{_IBAN.format('a-z')})(?![A-Za-z0-9])")
GROUPS = re.compile(r"(?<![A-Za-z0-9])(?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9])+|[a-z]{2}[0-9]{2}(?: ?[a-z0-9])+)(?![A-Za-z0-9])")
#: Country calling codes of one and two digits (fixed values); all others have three.
CALLING = {"1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49"}
CALLING |= {str(x) for x in (*range(51, 59), *range(60, 67), 81, 82, 84, 86, *range(90, 96), 98)}


class Feistel:
    """A keyed permutation of 0..size-1 for any size."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, r: int, tweak: bytes, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(b"%d|%d|" % (r, x) + tweak, key=self.key, digest_size=32).digest(), "big")

    def forward(self, x: int, size: int, tweak: bytes, valid: Callable[[int], bool] = lambda _: True) -> int:
        """Walks the cycle of x until a valid number; x itself has to be valid."""
        side = isqrt(size - 1) + 1 if size > 1 else 1
        while True:
            a, b = divmod(x, side)
            for r in range(ROUNDS):
                a, b = b, (a + self._round(r, tweak, b)) % side
            x = a * side + b
            if x < size and valid(x):
                return x

    def back(self, x: int, size: int, tweak: bytes, valid: Callable[[int], bool] = lambda _: True) -> int:
        side = isqrt(size - 1) + 1 if size > 1 else 1
        while True:
            a, b = divmod(x, side)
            for r in reversed(range(ROUNDS)):
                a, b = (b - self._round(r, tweak, a)) % side, a
            x = a * side + b
            if x < size and valid(x):
                return x


@cache
def _alphabet(c: str) -> str:
    """Characters that a letter or number may turn into: those of its category among the 128 around it."""
    kind, first = unicodedata.category(c), ord(c) & ~127
    if kind[0] not in "LN":
        return c
    return "".join(x for x in map(chr, range(first, first + 128)) if unicodedata.category(x) == kind)


def rank(text: str) -> tuple[int, int]:
    """Number of a text among all that have letters and digits of the same alphabets in its places, and their count."""
    x, size = 0, 1
    for c in text:
        letters = _alphabet(c)
        x, size = x * len(letters) + letters.index(c), size * len(letters)
    return x, size


def unrank(x: int, like: str) -> str:
    out = []
    for c in reversed(like):
        letters = _alphabet(c)
        x, r = divmod(x, len(letters))
        out.append(letters[r])
    return "".join(reversed(out))


def luhn(digits: str) -> int:
    """Sum that a valid number has at 0 mod 10."""
    return sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 * (d > "4")) for i, d in enumerate(reversed(digits))) % 10


def _spread(digits: str, like: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in like)


class Pseudonyms:
    """walk is Feistel.forward to pseudonymise and Feistel.back to restore."""

    def __init__(self, key: bytes, back: bool = False):
        feistel = Feistel(key)
        self.walk = feistel.back if back else feistel.forward

    def _whole(self, text: str, tweak: bytes, valid: Callable[[str], bool] = lambda _: True) -> str:
        x, size = rank(text)
        return unrank(self.walk(x, size, tweak, lambda y: valid(unrank(y, text))), text) if size > 1 else text

    def email(self, local: str) -> str:
        return self._whole(local, b"email")

    def iban(self, v: str) -> str | None:
        def check(country: str, body: str) -> int:
            return int("".join(str(int(c, 36)) for c in body + country + "00")) % 97  # letters count alike in either case

        like, v = v, v.replace(" ", "")
        if not 15 <= len(v) <= 34 or (check(v[:2], v[4:]) + int(v[2:4])) % 97 != 1:
            return None
        body = self._whole(v[4:], b"iban" + v[:2].upper().encode())
        it = iter(f"{v[:2]}{98 - check(v[:2], body):02d}{body}")
        return "".join(c if c == " " else next(it) for c in like)

    def ip(self, v: str) -> str | None:
        parts = [int(p) for p in v.split(".")]
        if any(p > 255 for p in parts) or any(len(p) > 1 and p[0] == "0" for p in v.split(".")):
            return None
        public = lambda a: 0 < a < 224 and a != 127
        like = public(parts[0])
        x = self.walk(int.from_bytes(bytes(parts), "big"), 1 << 32, b"ip", lambda y: public(y >> 24) == like)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def date(self, v: str) -> str | None:
        mark = next(c for c in v if not c.isdigit())
        a, b, c = v.split(mark)
        # Year first; by dots the day first; by slashes the month first unless that can't be.
        order = "ymd" if mark == "-" else "dmy" if mark == "." or int(a) > 12 else "mdy"
        p = dict(zip(order, (a, b, c), strict=True))
        try:
            day = datetime.date(int(p["y"]), int(p["m"]), int(p["d"])).toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        # What a format can say of a day is kept by the permutation, which goes by the day alone: whether its day or month has
        # one digit (so that padding shows) and whether its day is past 12 (so that the order of a date with slashes shows).
        told = lambda n: ((d := datetime.date.fromordinal(FIRST_DAY + n)).day > 12, min(d.day, d.month) < 10)
        like, short = told(day - FIRST_DAY), [k for k in "dm" if len(p[k]) == 1]
        padded = any(p[k][0] == "0" for k in "dm")
        if short and padded:  # one part padded and one not: a format of its own, where that has to show again
            mixed = lambda n: told(n) == like and (datetime.date.fromordinal(FIRST_DAY + n).day < 10) and (datetime.date.fromordinal(FIRST_DAY + n).month < 10)
            n = self.walk(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, b"date" + short[0].encode(), mixed)
        else:
            n = self.walk(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, b"date", lambda n: told(n) == like)
        d = datetime.date.fromordinal(FIRST_DAY + n)
        parts = {"y": str(d.year), "d": str(d.day), "m": str(d.month)}
        return mark.join(parts[k].zfill(2) if k != "y" and k not in short and (padded or not short) else parts[k] for k in order)

    def ssn(self, v: str) -> str | None:
        valid = lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"
        return self._whole(v, b"ssn", valid) if valid(v) else None

    def card(self, v: str) -> str | None:
        digits = re.sub(r"\D", "", v)
        if luhn(digits) or digits[0] not in "23456" or len(set(digits)) == 1:
            return None
        body = digits[0] + self._whole(digits[1:-1], b"card" + digits[:1].encode())
        return _spread(body + str((10 - luhn(body + "0")) % 10), v)

    def phone(self, v: str) -> str | None:
        digits = re.sub(r"\D", "", v)
        if not 8 <= len(digits) <= 15 or v.count("(") != v.count(")"):
            return None
        kept = next((n for n in (1, 2) if digits[:n] in CALLING), 3) if v[0] == "+" else int(digits[0] == "0")
        area = digits[kept] > "1"
        return _spread(digits[:kept] + self._whole(digits[kept:], b"phone" + digits[:kept].encode(), lambda s: (s[0] > "1") == area), v)

    def _ibans(self, text: str, lo: int, hi: int) -> list[tuple[int, int, str]]:
        """(start, end, kind) of what is validated in text[lo:hi]; of the blanks where it can end the last that fits."""
        out, at = [], lo
        while m := IBAN.search(text, at, hi):
            ends = [m.end(), *(m.start() + i for i in range(len(m[0]) - 1, 0, -1) if m[0][i] == " ")]
            end = next((e for e in ends if self.iban(text[m.start() : e])), None)
            if end:
                out.append((m.start(), end, "iban"))
            at = end or m.start() + 1
        return out

    def _number(self, text: str, at: int, end: int) -> tuple[int, int, str] | None:
        """What is validated from at on: the kinds in order, each at its longest, then with fewer groups of digits."""
        for kind, pattern in EACH.items():
            stop = end
            while m := pattern.match(text, at, stop):
                if AFTER.match(text, m.end(), end) and getattr(self, kind)(m[0]) is not None:
                    return at, m.end(), kind
                stop = at + len(m[0].rstrip(")").rstrip("0123456789").rstrip(" .(-/+"))
        return None

    def _numbers(self, text: str, lo: int, hi: int) -> list[tuple[int, int, str]]:
        out, at, end = [], lo, min(len(text), hi + AHEAD)
        while m := NUMBER.search(text, at, end):
            hit = self._number(text, m.start(), end)
            if hit:
                out.append(hit)
            at = hit[1] if hit else m.start() + 1
        return out

    def _renamed(self, text: str, lo: int, hi: int, split: Callable[[str, int, int], list[tuple[int, int, str]]]) -> list[tuple[int, int, str, str]]:
        """What split finds in text[lo:hi], with pseudonyms.

        Digits beside a value can turn valid together with its pseudonym. All values walk on until split finds them where
        they are, which keeps the text invertible.
        """
        spans = split(text, lo, hi)
        values = [text[s:e] for s, e, _ in spans]
        while spans:
            values = [getattr(self, kind)(v) for (_, _, kind), v in zip(spans, values, strict=True)]
            new, at, want = text[max(0, lo - 2) : lo], lo, []
            first = len(new)
            for (s, e, kind), v in zip(spans, values, strict=True):
                new += text[at:s]
                want.append((len(new), len(new) + len(v), kind))
                new, at = new + v, e
            new += text[at:hi]
            if split(new + text[hi : hi + AHEAD], first, len(new)) == want:
                break
        return [(*span, v) for span, v in zip(spans, values, strict=True)]

    def found(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym) of what is validated, in order and apart."""
        out: list[tuple[int, int, str, str]] = []
        at, before = text.find("@"), 0
        while at >= 0:
            head = LOCAL.match(text[before:at][::-1])
            tail = DOMAIN.match(text, at + 1)
            if head and tail:
                local = head[0][::-1].lstrip(".%+-")
                if local:
                    out.append((at - len(local), at, "email", self.email(local)))
            at, before = text.find("@", at + 1), at + 1
        for m in GROUPS.finditer(text):
            out += self._renamed(text, m.start(), m.end(), self._ibans)
        parts, at = [], 0
        for a, b, *_ in sorted(out):
            parts += [text[at:a], "x" * (b - max(a, at))]
            at = max(at, b)
        rest = "".join([*parts, text[at:]])  # no number overlaps what is taken
        for m in RUN.finditer(rest):
            hi = m.start() + len(m[0].rstrip(" ().+/-"))
            if hi - m.start() > 6:  # no kind has fewer characters
                out += self._renamed(rest, m.start(), hi, self._numbers)
        return sorted(out)

    def apply(self, text: str) -> tuple[str, dict[str, int]]:
        parts, at, counts = [], 0, dict.fromkeys(KINDS, 0)
        for a, b, kind, new in self.found(text):
            if a >= at:
                parts += [text[at:a], new]
                at = b
                counts[kind] += 1
        return "".join([*parts, text[at:]]), counts


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """id, text with pseudonyms, n_found, n_<kind> for every row; back=True restores what the same key made.

    A null text stays null with nothing found. Repeated rows and null ids are treated as they stand; an empty table gives
    no rows; other columns are ignored. Numbers that fail validation (check digits, calendar, ranges) stay as they are.
    """

    def run(batches):
        names = Pseudonyms(key, back)
        for batch in batches:
            texts, counts = [], {k: [] for k in KINDS}
            for t in batch.column(1).to_pylist():
                new, n = names.apply(t) if t else (t, dict.fromkeys(KINDS, 0))
                texts.append(new)
                for k in KINDS:
                    counts[k].append(n[k])
            each = [pa.array(counts[k], pa.int64()) for k in KINDS]
            total = pa.array([sum(x) for x in zip(*counts.values(), strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), total, *each], [id_col, "text", "n_found", *[f"n_{k}" for k in KINDS]])

    ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, text string, n_found long, " + ", ".join(f"n_{k} long" for k in KINDS))

"""BPE by a priority queue of merge ranks over a doubly linked list of symbols.

Every adjacent pair that has a rank goes on the heap with its place; the smallest rank (then the leftmost place) is
merged, the neighbours' new pairs go on the heap, and entries whose symbols have changed since are skipped when they
come up. Decoding joins vocabulary strings.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import pretokens
from .common import blocks, ready

DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> dict[int, str]:
    """Byte -> the printable character that stands for it in vocabularies: itself where printable, else 256 and up in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(plain))
    return table


def merge(symbols: list[int], ranks: dict[int, int], merged: list[int]) -> list[int]:
    """symbols after all merges. ranks: left << 20 | right -> rank; merged: rank -> symbol."""
    n = len(symbols)
    if n == 1:
        return symbols
    symbols, left, right, get = [*symbols], [*range(-1, n - 1)], [*range(1, n), -1], ranks.get
    heap = [r * n + i for i in range(n - 1) if (r := get(symbols[i] << 20 | symbols[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = divmod(heapq.heappop(heap), n)
        j = right[i]
        if j < 0 or symbols[i] < 0 or get(symbols[i] << 20 | symbols[j]) != rank:
            continue  # stale: one of the two has been merged since
        new = symbols[i] = merged[rank]
        symbols[j] = -1
        k = right[i] = right[j]
        if k >= 0:
            left[k] = i
            if (r := get(new << 20 | symbols[k])) is not None:
                heapq.heappush(heap, r * n + i)
        h = left[i]
        if h >= 0 and (r := get(symbols[h] << 20 | new)) is not None:
            heapq.heappush(heap, r * n + h)
    return [s for s in symbols if s >= 0]


def supported(data: dict, normalizer: object, pre_tokenizer: object) -> None:
    """An error for a file whose settings aren't those that are built here. trim_offsets has no part in ids."""
    plain = lambda x: [plain(y) for y in x] if isinstance(x, list) else {k: plain(y) for k, y in x.items() if k != "trim_offsets"} if isinstance(x, dict) else x
    model = data["model"]
    off = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    odd = [t["content"] for t in data["added_tokens"] if t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized")]
    if model["type"] != "BPE" or off or odd or data.get("post_processor"):
        raise ValueError(f"not supported: model {model['type']}, settings {off}, added tokens {odd}, post-processor {data.get('post_processor')}")
    for name, want in (("normalizer", normalizer), ("pre_tokenizer", pre_tokenizer)):
        if plain(data.get(name)) != want:
            raise ValueError(f"not supported: {name} {data.get(name)}")


#: Settings of the word-end files, as they stand in them.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]}


class WordBpe:
    """A word-end BPE file: normalised by composition, white space runs to one blank and lower case; words by pretokens.bare."""

    #: Words whose tokens are kept at hand, in each of two generations.
    KEPT = 250_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        supported(data, NORMALIZER, PRE_TOKENIZER)
        model = data["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.names = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        self.end = model["end_of_word_suffix"] or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {self.vocab[a] << 20 | self.vocab[b]: r for r, (a, b) in enumerate(pairs)}
        self.merged = [self.vocab[a + b] for a, b in pairs]
        letters = byte_letters()
        self.inner = [self.vocab.get(letters[b], -1) for b in range(256)]
        self.last = [self.vocab.get(letters[b] + self.end, -1) for b in range(256)]
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.led = os.path.commonprefix(list(self.special))
        #: word -> its ids, and its tokens, joined by blanks
        self.young: tuple[dict[str, str], dict[str, str]] = ({}, {})
        self.old: tuple[dict[str, str], dict[str, str]] = ({}, {})

    def word(self, word: str) -> list[int]:
        data = word.encode("utf-8", "surrogatepass")
        symbols = [self.inner[b] for b in data[:-1]] + [self.last[data[-1]]]
        symbols = [s for s in symbols if s >= 0]
        return merge(symbols, self.ranks, self.merged) if symbols else []

    @staticmethod
    def normal(text: str) -> str:
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def learn(self, words: list[str]) -> tuple[dict[str, str], dict[str, str]]:
        """Dictionaries that hold every one of words."""
        if len(self.young[0]) > self.KEPT:
            self.old, self.young = self.young, ({}, {})
        (ids, tokens), (old_ids, old_tokens) = self.young, self.old
        for w in set(words):
            if w not in ids:
                if w in old_ids:
                    ids[w], tokens[w] = old_ids[w], old_tokens[w]
                else:
                    found = self.word(w)
                    ids[w], tokens[w] = " ".join(map(str, found)), " ".join([self.names[i] for i in found])
        return self.young

    def pieces(self, texts: list[str]) -> list[list[str]]:
        """Each text's words. Text between specials is split alone; a special is a piece that starts with a tab, which no word has."""
        parts, owner = [], []
        for i, t in enumerate(texts):
            for k, part in enumerate(self.split.split(t) if self.special and self.led in t else (t,)):
                parts.append("\t" + part if k % 2 else self.normal(part))
                owner.append((i, k % 2))
        out: list[list[str]] = [[] for _ in texts]
        plain = [p for p, (_, special) in zip(parts, owner, strict=True) if not special]
        joined = "\x00".join([*plain, ""])
        starts, ends = pretokens.bare(pretokens.code_points(plain))
        words = [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        at, place = 0, 0
        cuts = []
        for p in plain:
            place += len(p) + 1
            cuts.append(place)
        bounds = starts.searchsorted(cuts).tolist() if len(starts) else [0] * len(cuts)
        k = 0
        for p, (i, special) in zip(parts, owner, strict=True):
            if special:
                out[i].append(p)
            else:
                out[i] += words[at : bounds[k]]
                at, k = bounds[k], k + 1
        return out

    def encode_strings(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(number of tokens, ids joined by blanks, decoded text) of each text."""
        pieces = self.pieces(texts)
        ids, tokens = self.learn([w for ws in pieces for w in ws if w[:1] != "\t"])
        for name, i in self.special.items():
            ids["\t" + name], tokens["\t" + name] = str(i), name
        for ws in pieces:
            i = " ".join(map(ids.__getitem__, ws))
            d = " ".join(map(tokens.__getitem__, ws))
            yield i.count(" ") + bool(i), i, d

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in next(self.encode_strings([text]))[1].split()]

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings joined by a blank, as the library does for a file without a decoder; unknown ids are skipped."""
        return " ".join([self.names[i] for i in ids if i in self.names])


_LOADED: dict[str, object] = {}


def loaded(kind: Callable, path: str):
    """One tokenizer a worker, kept between tasks."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, digest of the ids, digest of the decoded text for every row.

    Null text is empty: no tokens. Repeated rows and null ids are encoded as they stand; an empty table gives no rows;
    other columns are ignored. path must open on every executor.
    """

    def run(batches):
        bpe = loaded(WordBpe, path)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n, ids, decoded = [], [], []
            for a, b in blocks([len(t) for t in texts]):
                for count, i, d in bpe.encode_strings(texts[a:b]):
                    n.append(count)
                    ids.append(sha(i))
                    decoded.append(sha(d))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

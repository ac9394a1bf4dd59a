"""Token counts of whole texts under a byte-level BPE; huge texts in overlapping chunks that are spliced.

A chunk's encoding gives, for each word of the pattern, its place and its number of tokens. Where word starts of two
neighbouring chunks coincide inside their overlap, at least MARGIN before the left chunk ends, the encodings can be
spliced: matching goes on from a word start without memory, so the right chunk is right from there on, and the left one,
which saw the text from a proven start and MARGIN beyond, is right up to there (no special string and no contraction is
longer than MARGIN). Runs without such a place (one long word, a long run of white space) widen the overlap twofold
until there is one or the chunk reaches the end of the text.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import pretokens
from .bpe import loaded
from .common import blocks, ready

#: Characters above which a text is cut into chunks, and of their overlap. Short texts are laid together up to BLOCK.
CHUNK = 1 << 14
OVERLAP = 1 << 10
BLOCK = 1 << 18
MARGIN = 64
LIMIT = 512


class ByteBpe:
    """Counts under a byte-level BPE file. The pieces' merges are the library's own."""

    KEPT = 400_000

    def __init__(self, path: str):
        import json

        import tiktoken

        from .bpe import byte_letters, supported

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        supported(data, None, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True})
        back = {c: b for b, c in byte_letters().items()}
        self.special = [t["content"] for t in data["added_tokens"]]
        skip = set(self.special)
        vocab = {bytes([back[c] for c in s]): i for s, i in data["model"]["vocab"].items() if s not in skip}
        # A merge's rank is the place of its result in the merge list; single bytes come first.
        pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        ranks = {bytes([b]): i for i, b in enumerate(range(256)) if bytes([b]) in vocab}
        for r, (a, b) in enumerate(pairs):
            ranks.setdefault(bytes([back[c] for c in a + b]), 256 + r)
        self.core = tiktoken.Encoding("own", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def counts(self, words: list[str]) -> list[int]:
        young, old, one = self.young, self.old, self.core.encode_ordinary
        for w in set(words):
            if w not in young:
                got = old.get(w)
                young[w] = got if got is not None else len(one(w))
        out = [young[w] for w in words]
        if len(young) > self.KEPT:
            self.old, self.young = young, {}
        return out

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts in the laid-out texts (each followed by a mark), token counts, and the place where each text begins."""
        cuts = np.cumsum([0] + [len(t) + 1 for t in texts], dtype=np.int64)
        joined = "\x00".join([*texts, ""])
        cp = pretokens.code_points(texts)
        special = []
        for name in self.special:
            at = joined.find(name)
            while at >= 0:
                special.append((at, at + len(name)))
                at = joined.find(name, at + len(name))
        for a, b in special:
            cp[a:b] = 0x110000  # what stands before and after is matched alone
        starts, ends = pretokens.blank_led(cp)
        counts = np.array(self.counts([joined[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), np.int64)
        if special:
            starts = np.concatenate([starts, np.array([a for a, _ in special], np.int64)])
            counts = np.concatenate([counts, np.ones(len(special), np.int64)])
            order = np.argsort(starts, kind="stable")
            starts, counts = starts[order], counts[order]
        return starts, counts, cuts

    def chunk(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        starts, counts, _ = self.words([text])
        return starts, counts


def spliced(text: str, encode: Callable[[str], tuple[np.ndarray, np.ndarray]], chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = MARGIN) -> int:
    """Tokens of a text from its chunks. encode: text -> word starts, token counts."""
    total, proven = 0, 0  # proven: a word start; what stands before it is counted
    end = min(len(text), chunk)
    starts, counts = encode(text[:end])
    base = 0
    while end < len(text):
        width = overlap
        while True:
            begin = max(base, end - width)
            last = min(len(text), begin + max(chunk, 2 * width))
            r_starts, r_counts = encode(text[begin:last])
            common = np.intersect1d(starts + base, r_starts + begin)
            common = common[(common > max(begin, proven)) & (common <= end - margin)]
            if len(common) or begin == base:
                break
            width *= 2
        if len(common):
            at = int(common[-1])
            total += int(counts[(starts + base >= proven) & (starts + base < at)].sum())
            proven, base, starts, counts, end = at, begin, r_starts, r_counts, last
        else:  # the overlap is the whole left chunk: take the longer one instead, from the same proven start
            last = min(len(text), base + 2 * (end - base))
            starts, counts = encode(text[base:last])
            end = last
    return total + int(counts[starts + base >= proven].sum())


def _together(sizes: list[int], chunk: int):
    """Ranges of texts of at most BLOCK characters in all; a text of more than a chunk stands alone."""
    at = 0
    for i in [i for i, n in enumerate(sizes) if n > chunk] + [len(sizes)]:
        yield from ((at + a, at + b) for a, b in blocks(sizes[at:i], BLOCK))
        if i < len(sizes):
            yield i, i + 1
        at = i + 1


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for every row.

    Null text is empty: no bytes, no tokens. Repeated rows and null ids are counted as they stand; an empty table gives
    no rows; other columns are ignored. path must open on every executor.
    """

    def run(batches):
        bpe = loaded(ByteBpe, path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = np.zeros(len(texts), np.int64)
            sizes = [len(t) for t in texts]
            for a, b in _together(sizes, chunk):
                if sizes[a] > chunk:
                    n[a] = spliced(texts[a], bpe.chunk, chunk, overlap)
                    continue
                starts, counts, cuts = bpe.words(texts[a:b])
                sums = np.append(0, np.cumsum(counts))
                at = np.searchsorted(starts, cuts)
                n[a:b] = sums[at[1:]] - sums[at[:-1]]
            size = np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")

"""Removal of long strings that repeat across documents, by difference-cover suffix sorting.

A string of LENGTH bytes is a window; a window that also starts in a document with a smaller id is removed. Suffixes that
share their first LENGTH bytes share a window's anchor (see anchors), so anchors deal the suffixes out to tasks without
parting equal windows. Each anchor has a run of windows in a document; runs whose anchors agree in 64 bits of hash and whose
bytes (and anchor's place) agree in 64 bits of another are settled as wholes, by the smallest id that has them: within a
task first, which sends one row a run on, so that a passage that all documents share is one row a task. Runs that differ under one anchor are open: their text is suffix
sorted by the difference-cover algorithm (sort the triples at two of three places, recurse on their names, merge the
suffixes at the third), and neighbours with a common prefix of LENGTH bytes are equal windows. An anchor with so many
open runs, or bytes of them, that no task should hold them gives its windows one by one, sorted by Spark.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .anchors import Runs, runs
from .common import blocks, cut, ready, whole_number
from .shingles import U, mix

LENGTH = 50
#: Runs, and bytes of them, of an anchor above which its windows are sorted by Spark, and bytes that are suffix sorted at once.
HOT_RUNS = 10_000
HOT_BYTES = 1_000_000
SORT_BYTES = 1_000_000
FULL, OPEN, HOT = 0, 1, 2
#: Runs that a task holds before it settles them.
HELD_RUNS = 1 << 20
#: Bytes of text whose runs are found at once: arrays of eight times that many bytes stay in a processor's cache.
RUN_BYTES = 1 << 18
PIECES = "doc long, th long, kind int, a long, data binary, starts array<int>, ends array<int>"


def _triples(first: np.ndarray, second: np.ndarray, third: np.ndarray, bits: int) -> np.ndarray:
    """Keys in the order of the triples, whose numbers have at most bits bits; pairs are ranked first where three don't fit."""
    if 3 * bits <= 63:
        return (first << 2 * bits) | (second << bits) | third
    return (np.unique((first << bits) | second, return_inverse=True)[1] << bits) | third


def _by(values: np.ndarray) -> np.ndarray:
    """Stable order of natural numbers below 2 ** 32, by numpy's radix sort, which takes 16 bits."""
    order = np.argsort(values.astype(np.uint16), kind="stable")
    if len(values) and values.max() >> 16:
        order = order[np.argsort((values >> 16).astype(np.uint16)[order], kind="stable")]
    return order


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Sorted starts of the suffixes of s (positive integers), by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    ones = np.arange(1, n + (n % 3 == 1), 3)  # one past the end where the last third place would have no neighbour
    twos = np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    bits = max(int(t.max()), len(sample) + 1).bit_length()
    key = _triples(t[sample], t[sample + 1], t[np.minimum(sample + 2, n + 2)], bits)
    order = np.argsort(key)  # equal triples get one name, and the recursion orders them
    key = key[order]
    name = np.empty(len(sample), np.int64)
    name[order] = np.cumsum(np.append(True, key[1:] != key[:-1]))
    if name[order[-1]] < len(sample):
        order = suffix_array(name)
        name[order] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = name
    rank[n:] = 0
    sorted_sample = sample[order]
    big = len(sample) + 2
    one_key = lambda i: t[i] * big + rank[i + 1]
    is_one = order < len(ones)
    of_one, of_two = sorted_sample[is_one], sorted_sample[~is_one]
    zeros = of_one - 1  # all third places, by what follows them
    zeros = zeros[_by(t[zeros])]
    of_one, sorted_sample = of_one[of_one < n], sorted_sample[sorted_sample < n]
    both = np.concatenate([of_two, zeros])
    two_key = _triples(t[both], t[both + 1], rank[both + 2], bits)
    before = np.searchsorted(one_key(of_one), one_key(zeros)) + np.searchsorted(two_key[: len(of_two)], two_key[len(of_two) :])
    at = before + np.arange(len(zeros))
    out = np.empty(n, np.int64)
    taken = np.zeros(n, bool)
    taken[at] = True
    out[at], out[~taken] = zeros, sorted_sample
    return out


def repeated(parts: list[bytes], docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Window starts of the parts (of at least length bytes) that also occur in a part of a smaller doc: numbers of the
    parts, and starts within them, in order."""
    joined = b"\x00".join([*parts, b"\x00" * 8])
    text = np.frombuffer(joined, np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    owner = np.full(len(text), -1, np.int64)
    of = np.repeat(np.arange(len(parts)), sizes - length + 1)
    owner[_counted(begin, sizes - length + 1)] = of
    sa = suffix_array(text.astype(np.int64) + 1)
    sa = sa[owner[sa] >= 0]
    near = np.arange(1, len(sa))  # those that equal the one before, as far as compared: the ends of windows first, as sorted ones begin alike
    eight = np.ndarray((len(text) - 7,), U, joined, 0, (1,))
    for off in [length - 8, *range(0, length - 8, 8)] if length >= 8 else ():
        near = near[eight[sa[near] + off] == eight[sa[near - 1] + off]]
    for off in range(length) if length < 8 else ():
        near = near[text[sa[near] + off] == text[sa[near - 1] + off]]
    new = np.ones(len(sa), bool)
    new[near] = False
    first = np.flatnonzero(new)
    d = docs[owner[sa]]
    least = np.repeat(np.minimum.reduceat(d, first), np.diff(np.append(first, len(sa)))) if len(sa) else d
    hit = np.sort(sa[d > least])
    return owner[hit], hit - begin[owner[hit]]


def _counted(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... counts[i] times for each i."""
    before = np.cumsum(counts) - counts
    return np.arange(counts.sum()) + np.repeat(begin - before, counts)


def _ranges(row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted different places of sorted rows as half-open ranges: row, start, end."""
    new = np.append(True, (place[1:] != place[:-1] + 1) | (row[1:] != row[:-1]))[: len(place)]
    first = np.flatnonzero(new)
    return row[first], place[first], place[np.append(first[1:], len(place))[: len(first)] - 1] + 1


def _bytes(batch: pa.RecordBatch, i: int) -> list[bytes]:
    return [t or b"" for t in batch.column(i).cast(pa.binary()).to_pylist()]


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists end to end, and where each row's begin, and the last one's end; null is empty."""
    counts = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return col.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(counts))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _scan(length: int):
    """doc, text -> (a, s, doc) of every different run, once a task, with the smallest doc there; and for each of the other
    docs a row with its list of runs, which are settled by that: a is some number then, so that these rows spread evenly."""

    def settle(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        a, s, d = (np.concatenate([x[i] for x in held]) for i in range(3))
        order = np.argsort(s)
        if ((s[order[1:]] == s[order[:-1]]) & (a[order[1:]] != a[order[:-1]])).any():
            order = np.lexsort((s, a))
        a, s, d = a[order], s[order], d[order]
        first = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (a[1:] != a[:-1])))
        smallest = np.minimum.reduceat(d, first)
        least = np.repeat(smallest, np.diff(np.append(first, len(a))))
        none = pa.list_(pa.int64())
        for lo in range(0, len(first), 1 << 16):
            on = first[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([_signed(a[on]), _signed(s[on]), pa.array(smallest[lo : lo + (1 << 16)]), pa.nulls(len(on), none)], ["a", "s", "doc", "full"])
        rest = np.flatnonzero(d > least)
        rest = rest[np.argsort(d[rest], kind="stable")]
        cuts = np.flatnonzero(np.append(True, d[rest][1:] != d[rest][:-1]))[: len(rest)]
        ends = np.append(cuts, len(rest))
        for lo in range(0, len(cuts), 1 << 12):
            e = ends[lo : lo + (1 << 12) + 1]
            lists = pa.ListArray.from_arrays(pa.array(e - e[0], pa.int32()), _signed(s[rest[e[0] : e[-1]]]))
            docs = d[rest[e[:-1]]]
            yield pa.RecordBatch.from_arrays([_signed(mix(docs.view(U))), pa.nulls(len(docs), pa.int64()), pa.array(docs), lists], ["a", "s", "doc", "full"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids, texts = np.array(batch.column(0).to_pylist(), np.int64), _bytes(batch, 1)
            for lo, hi in blocks([len(t) for t in texts], RUN_BYTES):
                r = runs(texts[lo:hi], length)
                held.append((r.anchor, r.content, ids[lo:hi][r.text]))
                size += len(r.text)
                if size >= HELD_RUNS:
                    yield from settle(held)
                    held, size = [], 0
        if size:
            yield from settle(held)

    return run


def _pieces(length: int):
    """doc, th, text, full, open, hot (contents of runs) -> the full runs' places; the open runs' and hot windows' bytes.

    An open run or a hot window comes once a text, with all of its places as starts.
    """

    def marked(r: Runs, named: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Which runs their texts' lists name; the lists lie end to end, counts long."""
        if not len(named):
            return np.empty(0, np.int64)
        with np.errstate(over="ignore"):
            named = np.sort(named + np.repeat(mix(np.arange(len(counts)).astype(U)), counts))
            key = r.content + mix(r.text.astype(U))
        return np.flatnonzero(named[np.minimum(np.searchsorted(named, key), len(named) - 1)] == key)

    def block(ids: list, th: list, texts: list[bytes], lists: list[tuple]) -> list[tuple]:
        r, out = runs(texts, length), []
        base = np.cumsum([0] + [len(t) for t in texts])[r.text] if len(r.text) else r.text
        start, end = r.start - base, r.end - base
        on = marked(r, *lists[FULL])
        cuts = np.flatnonzero(np.append(True, r.text[on][1:] != r.text[on][:-1]))[: len(on)].tolist()
        for x, y in zip(cuts, [*cuts[1:], len(on)], strict=False):
            i = r.text[on[x]]
            out.append((ids[i], th[i], FULL, None, None, start[on[x:y]], end[on[x:y]]))
        for kind in (OPEN, HOT):
            places: dict[tuple[int, int, bytes], list[int]] = {}
            on = marked(r, *lists[kind])
            for i, a, p, q in zip(r.text[on].tolist(), r.anchor[on].view(np.int64).tolist(), start[on].tolist(), end[on].tolist(), strict=True):
                for u, v in [(p, q)] if kind == OPEN else ((u, u + 1) for u in range(p, q)):
                    places.setdefault((i, a, texts[i][u : v + length - 1]), []).append(u)
            out += [(ids[i], th[i], kind, a, data, at, None) for (i, a, data), at in places.items()]
        return out

    def run(batches):
        for batch in batches:
            ids, th, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), _bytes(batch, 2)
            lists = [_lists(batch.column(k)) for k in (3, 4, 5)]
            for lo, hi in blocks([len(t) for t in texts], RUN_BYTES):
                if out := block(ids[lo:hi], th[lo:hi], texts[lo:hi], [(x.view(U)[at[lo] : at[hi]], np.diff(at[lo : hi + 1])) for x, at in lists]):
                    yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    names = [c.split()[0] for c in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names)


def _sort(length: int):
    """a, doc, th, places, data by anchor -> doc, th, starts, ends of windows that a smaller doc has."""

    def settle(held: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        doc, th = rows.column(1).to_numpy(), rows.column(2).to_numpy()
        part, at = repeated(_bytes(rows, 4), doc, length)
        places, cuts = _lists(rows.column(3))
        hits, n_places = np.bincount(part, minlength=len(doc)), np.diff(cuts)
        # Each place of a part has all of the part's hits; so many parts at once that these are some million.
        for lo, hi in blocks((n_places * hits).tolist()):
            row = np.repeat(np.arange(lo, hi), n_places[lo:hi])
            each = at[_counted((np.cumsum(hits) - hits)[row], hits[row])]
            place = np.repeat(places[cuts[lo] : cuts[hi]].astype(np.int64), hits[row]) + each
            row = np.repeat(row, hits[row])
            order = np.lexsort((place, row))
            row, place = row[order], place[order]
            once = np.append(True, (row[1:] != row[:-1]) | (place[1:] != place[:-1]))[: len(row)]
            row, start, end = _ranges(row[once], place[once])
            on, n = np.unique(row, return_counts=True)
            ends = pa.array(np.append(0, np.cumsum(n)), pa.int32())
            ranges = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (start, end)]
            yield pa.RecordBatch.from_arrays([pa.array(doc[on]), pa.array(th[on]), *ranges], ["doc", "th", "starts", "ends"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            a = batch.column(0).to_numpy()
            sizes = np.array([len(t) for t in _bytes(batch, 4)], np.int64)
            before = np.cumsum(sizes + 1) - sizes - 1
            heads = np.flatnonzero(np.append(a[:1] != last, a[1:] != a[:-1]))
            lo = 0
            while lo < len(a):
                full = np.searchsorted(before, SORT_BYTES // 2 - size + before[lo], "right")
                at = heads[np.searchsorted(heads, full) :][:1]
                hi = int(at[0]) if len(at) else len(a)
                held.append(batch.slice(lo, hi - lo))
                if not len(at):
                    size += int(before[-1] + sizes[-1] + 1 - before[lo])
                    break
                yield from settle(held)
                held, size, lo = [], 0, hi
            last = a[-1] if len(a) else last
        if held:
            yield from settle(held)

    return run


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot_runs: int = HOT_RUNS) -> DataFrame:
    """doc, th (hash of the text), starts, ends: ranges of window starts that are removed, for documents that have any."""
    ready(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.filter(F.col(id_col).isNotNull()).select(whole_number(docs, id_col).alias("doc"), text.alias("text"))
    rows = base.mapInArrow(_scan(length), "a long, s long, doc long, full array<long>")
    by_run = Window.partitionBy("a").orderBy("s", "doc")
    by_anchor = Window.partitionBy("a")
    new_run = (F.lag("s").over(by_run).isNull() | (F.lag("s").over(by_run) != F.col("s"))).cast("long")
    rows = rows.withColumn("new", F.when(F.col("full").isNull(), new_run))
    # The first row of a run has its smallest id; carried along the run it settles the others.
    carried = F.last(F.when(F.col("new") == 1, F.col("doc")), ignorenulls=True).over(by_run.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("least", carried).withColumns({"n_runs": F.sum("new").over(by_anchor), "lo": F.min("least").over(by_anchor), "hi": F.max("least").over(by_anchor)})
    # A run has fewer than 2 * length bytes; each has one row that is open, that of its smallest id.
    hot = (F.col("n_runs") > hot_runs) | (F.col("n_runs") * (2 * length) > HOT_BYTES)
    kind = F.when(F.col("full").isNotNull() | (F.col("least") < F.col("doc")), FULL).when((F.col("n_runs") > 1) & (F.col("lo") < F.col("hi")), F.when(hot, HOT).otherwise(OPEN))
    flags = cut(rows.withColumn("kind", kind).filter("kind is not null").select("doc", "s", "kind", "full"), "runs")
    pick = lambda k: F.collect_list(F.when(F.col("kind") == k, F.col("s")))
    lists = flags.groupBy("doc").agg(F.concat(F.flatten(F.collect_list("full")), pick(FULL)).alias("full"), pick(OPEN).alias("open"), pick(HOT).alias("hot"))
    joined = base.withColumn("th", F.xxhash64("text")).join(lists, "doc").select("doc", "th", "text", "full", "open", "hot")
    pieces = cut(joined.mapInArrow(_pieces(length), PIECES), "pieces")
    marks = "doc long, th long, starts array<int>, ends array<int>"
    open_runs = pieces.filter(F.col("kind") == OPEN).select("a", "doc", "th", "starts", "data").repartition("a").sortWithinPartitions("a")
    sorted_runs = open_runs.mapInArrow(_sort(length), marks)
    by_window = Window.partitionBy("data").orderBy("doc")
    hot = pieces.filter(F.col("kind") == HOT).withColumn("least", F.first("doc").over(by_window)).filter("least < doc")
    hot = hot.select("doc", "th", "starts", F.transform("starts", lambda x: x + 1).alias("ends"))
    return pieces.filter(F.col("kind") == FULL).select("doc", "th", "starts", "ends").unionByName(sorted_runs).unionByName(hot)


def _remove(length: int):
    def run(batches):
        for batch in batches:
            texts, starts, ends = _bytes(batch, 1), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            n, gone, spans, sha = [], [], [], []
            for t, ss, es in zip(texts, starts, ends, strict=True):
                kept, removed, n_spans, at = hashlib.sha256(), 0, 0, 0
                for s, e in sorted(zip(ss or [], es or [], strict=True)):
                    e += length - 1
                    if s > at or not n_spans:
                        kept.update(t[at:s])
                        n_spans += 1
                        removed += e - s
                        at = e
                    elif e > at:
                        removed += e - at
                        at = e
                kept.update(t[at:])
                n.append(len(t))
                gone.append(removed)
                spans.append(n_spans)
                sha.append(kept.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (n, gone, spans)], pa.array(sha, pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def dedup_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 for every row.

    Null text is empty. Texts shorter than length lose nothing. Rows that repeat an id aren't smaller than each other;
    a row with a null id neither loses bytes nor makes others lose any. An empty table gives no rows; other columns are
    ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = repeats(docs, id_col, text_col, length).groupBy("doc", "th").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("th"))
    rows = rows.join(found, (F.col("id") == F.col("doc")) & (rows["th"] == found["th"]), "left").select("id", "text", "starts", "ends")
    return rows.mapInArrow(_remove(length), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)

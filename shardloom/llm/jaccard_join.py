"""N-gram Jaccard join by parity sketches.

Sizes fall into bands so narrow that linked sets lie in one band or in neighbours. A band's join bounds the symmetric
difference of any linked pair by D. Every shingle toggles one bit of a sketch of m parts of BITS bits, so the Hamming
distance of two sketches is at most the symmetric difference, and sketches at most D apart agree on at least m - D
parts. A set leaves out its z emptiest parts; with m = D + 1 + 2z linked sets still share a part that both keep. Sets
that share a part are candidates; a sketch of FOLD bits rules most unrelated ones out by its Hamming distance, and what
is left is verified on the whole shingle sets.

Equal sets are one class from the start. The sets of a bucket of equal parts meet its hub, the smallest of them: within a
task first, which sends one set a bucket on, then among tasks. So a part that a third of all sets share costs one row a
task in any one place. Buckets with one hub are one group. Each set is first held against its hubs only; pairs inside a
group are looked at again only where they are in different components still, each pair in the first of the groups that
both are in, so no link between components is lost and no pair is made twice. What that last step costs is the product
of a group's smaller components with the group: near copies that link with none of their family each have to be ruled
out against all of it, on 512 bits a pair.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, keep_ids, ready, whole_number
from .components import components
from .shingles import U, mix, shingle_sets

#: Bits of a sketch's part. They are never laid out, so a part with two or three set is still told from most others.
BITS = 1 << 16
FOLD = 512
#: For sets of at least WIDE_FROM shingles, on which a FOLD of random bits is too close, one more sketch.
WIDE, WIDE_FROM = 4096, 600
#: Bits of a bucket's key. Keys that fall together by chance only add candidates, and each bit less is moved with every part.
KEY_BITS = 48
#: Ids that are broadcast to the scan that fetches candidates' texts; with more, the fetch is a shuffled join.
BROADCAST_IDS = 1_000_000
#: Distinct sets that a task remembers, so as to send a set's parts once.
REMEMBERED = 50_000
#: Keys that a task holds before it sends them.
HELD_KEYS = 1 << 19
ROWS = "id long, n long, f1 long, f2 long, fold array<long>, wide array<long>, node long, part int, blob binary, key long, hub long"
COLUMNS = [c.split()[0] for c in ROWS.split(", ")]
KINDS = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2 + [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]


@cache
def bands(num: int, den: int) -> tuple[list[int], list[tuple[int, int]]]:
    """First sizes of the bands; (m, z) of each band's join, m = 0 where only equal sets link. For Jaccard >= num / den."""
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(starts[-1] * den // num + 1)
    joins = []
    for i in range(len(starts) - 2):
        small = starts[i + 1] - 1
        large = min(starts[i + 2] - 1, small * den // num)
        d = (den - num) * (small + large) // (den + num)
        z = max(1, round(0.06 * d))
        joins.append((d + 1 + 2 * z if d else 0, z))
    return starts, joins


def part_keys(hashes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of a set's sketch parts, for the join of its own band and that of the band below."""
    starts, joins = bands(num, den)
    band, out = bisect_right(starts, len(hashes)) - 1, []
    for i in (band, band - 1):
        if i < 0 or not joins[i][0] or not len(hashes):
            continue
        m, z = joins[i]
        part = ((hashes >> U(32)) * U(m) >> U(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        held = np.bincount(part, minlength=m)
        first = np.cumsum(held) - held
        # A part's bits go by the XOR of a number for each bit; a bit that is set twice is not set.
        value = np.append(mix((hashes & U(BITS - 1)) + U(1))[order], U(0))
        sketch = np.bitwise_xor.reduceat(value, first) * (held > 0)
        keep = np.ones(m, bool)
        keep[np.argsort(held, kind="stable")[:z]] = False
        with np.errstate(over="ignore"):
            out.append(mix(mix(sketch + U(i * 2 + 1)) + mix(np.arange(m, dtype=U)))[keep] >> U(64 - KEY_BITS))
    return np.concatenate(out) if out else np.empty(0, U)


def fold(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Parity sketch of a whole set."""
    odd = np.bincount((hashes >> U(9) & U(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd).view(U)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(x) for x in arrays])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*arrays, np.empty(0, U)]).view(np.int64)))


def _planes(x: np.ndarray, n: int) -> bytes:
    """The low n bytes of numbers, byte by byte, which compresses where high bytes are alike."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def _unplanes(data: bytes, count: int, n: int) -> np.ndarray:
    out = np.zeros((count, 8), np.uint8)
    out[:, :n] = np.frombuffer(data, np.uint8, n * count).reshape(n, count).T
    return out.view("<u8").ravel()


def pack_keys(keys: np.ndarray, nodes: np.ndarray) -> bytes:
    """Sorted keys and the nodes of one task (high halves equal): differences and low halves, compressed."""
    body = _planes(np.diff(keys, prepend=U(0)), 6) + _planes(nodes & 0xFFFFFFFF, 4)
    return struct.pack("<qi", int(nodes[0]) >> 32, len(keys)) + pa.compress(body, codec="zstd", asbytes=True)


def unpack_keys(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    task, count = struct.unpack_from("<qi", blob)
    body = pa.decompress(blob[12:], decompressed_size=10 * count, codec="zstd", asbytes=True)
    return np.cumsum(_unplanes(body, count, 6), dtype=U), (task << 32) + _unplanes(body[6 * count :], count, 4).astype(np.int64)


def _stars(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted different (key, node), whether each is its key's first, and that first node."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    new = np.append(True, (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1]))[: len(keys)]
    keys, nodes = keys[new], nodes[new]
    first = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    return keys, nodes, first, nodes[np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))]


def _rows(**cols) -> pa.RecordBatch:
    n = len(next(iter(cols.values())))
    return pa.RecordBatch.from_arrays([cols[c] if c in cols else pa.nulls(n, k) for c, k in zip(COLUMNS, KINDS, strict=True)], COLUMNS)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x).astype(U).view(np.int64))


def _sketches(width: int, num: int, den: int, parts: int):
    """id, text -> three kinds of rows: a document's set and sketches, with a node where it is a task's first row of that
    set; blobs of (key, node) by range of keys; (key, hub, node) of sets that share a key within the task."""

    def flush(keys: list[np.ndarray], nodes: list[np.ndarray]):
        k, x, first, hub = _stars(np.concatenate(keys), np.concatenate(nodes))
        if not first.all():
            yield _rows(key=_signed(k[~first]), hub=pa.array(hub[~first]), node=pa.array(x[~first]))
        k, x = k[first], x[first]
        part = ((k >> U(KEY_BITS - 32)) * U(parts) >> U(32)).astype(np.int64)
        at = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist()
        for lo in range(0, len(at), 64):
            cuts = [*at[lo : lo + 65], len(k)][: len(at[lo : lo + 64]) + 1]
            blobs = [pack_keys(k[a:b], x[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield _rows(part=pa.array(part[cuts[:-1]].astype(np.int32)), blob=pa.array(blobs, pa.binary()))

    def run(batches):
        task, made = TaskContext.get().partitionId() << 32, 0
        seen: set[tuple[int, int]] = set()
        keys, nodes, held = [], [], 0
        for batch in batches:
            ids, texts = batch.column(0), [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            n, f1, f2, folds, wides, own = [], [], [], [], [], []
            for i, h in zip(ids.to_pylist(), shingle_sets(texts, width), strict=True):
                with np.errstate(over="ignore"):
                    f = int(mix(h + U(11)).sum(dtype=U)), int(mix(h ^ U(0x5555555555555555)).sum(dtype=U))
                # A row without an id has no link; its text's keys come with the first row that has one.
                if i is not None and len(h) and f not in seen:
                    if len(seen) > REMEMBERED:
                        seen.clear()
                    seen.add(f)
                    mine = part_keys(h, num, den)
                    keys.append(mine)
                    nodes.append(np.full(len(mine), task + made, np.int64))
                    own.append(task + made)
                    made, held = made + 1, held + len(mine)
                else:
                    own.append(None)
                n.append(len(h))
                f1.append(f[0])
                f2.append(f[1])
                folds.append(fold(h, FOLD))
                wides.append(fold(h, WIDE) if len(h) >= WIDE_FROM else np.empty(0, U))
                if held >= HELD_KEYS:
                    yield from flush(keys, nodes)
                    keys, nodes, held = [], [], 0
            yield _rows(id=ids, n=pa.array(n, pa.int64()), f1=_signed(np.array(f1, U)), f2=_signed(np.array(f2, U)), fold=_lists(folds), wide=_lists(wides), node=pa.array(own, pa.int64()))
        if held:
            yield from flush(keys, nodes)

    return run


def _meet(batches):
    """Blobs of one range of keys -> (key, hub, node) of nodes that share a key with a smaller one of another task."""
    got = [unpack_keys(b) for batch in batches for b in batch.column(0).to_pylist()]
    if got:
        k, x, first, hub = _stars(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))
        for lo in range(0, len(k), 1 << 16):
            on = lo + np.flatnonzero(~first[lo : lo + (1 << 16)])
            yield pa.RecordBatch.from_arrays([_signed(k[on]), pa.array(hub[on]), pa.array(x[on])], ["key", "hub", "node"])


def _pack(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([zlib.compress(t or b"", 1) for t in batch.column(1).cast(pa.binary()).to_pylist()], pa.binary())], ["id", "packed"])


def _verify(width: int, num: int, den: int):
    def run(batches):
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok, memo = [], {}
            for x, y in zip(left, right, strict=True):
                if x not in memo:
                    memo = {x: shingle_sets([zlib.decompress(x)], width)[0]}
                a, b = memo[x], shingle_sets([zlib.decompress(y)], width)[0]
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(den * both >= num * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    return run


def _join(docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int, every: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id, n, ...), members (id, rep) and, of the class representatives, every link (a, b) or else the components."""
    spark = docs.sparkSession
    ready(spark)
    base = docs.select(whole_number(docs, id_col).alias("id"), F.col(text_col).alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), base.rdd.getNumPartitions())
    found = cut(base.mapInArrow(_sketches(width, num, den, parts), ROWS), "sketches")
    sets = found.filter("n is not null")
    nodes = sets.filter("id is not null and n > 0").select("id", "n", "f1", "f2", "fold", "wide")
    classes = nodes.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("fold").alias("fold"), F.first("wide").alias("wide"))
    classes = cut(classes, "classes")
    member = cut(nodes.select("id", "f1", "f2").distinct().join(classes.select("f1", "f2", "rep"), ["f1", "f2"]).select("id", "rep"), "members")
    reps = classes.select("rep", "n", "fold")
    wide = classes.filter(F.col("n") >= WIDE_FROM).select("rep", "wide")
    named = cut(sets.filter("node is not null").select("node", "f1", "f2").join(classes.select("f1", "f2", "rep"), ["f1", "f2"]).select("node", "rep"), "named")

    # (hub, x): sets that share a key with a smaller one. A task's own hub may have met a smaller one of another task.
    among = cut(found.filter("blob is not null").select("part", "blob").repartitionById(parts, F.col("part")).select("blob").mapInArrow(_meet, "key long, hub long, node long"), "among")
    inside = found.filter("key is not null").select("key", F.col("hub").alias("node"), F.col("node").alias("x"))
    inside = inside.join(among.withColumnRenamed("hub", "top"), ["key", "node"], "left").select(F.coalesce("top", "node").alias("hub"), "x")
    starry = among.select("hub", F.col("node").alias("x")).unionByName(inside).distinct()
    group = starry.join(named.toDF("x", "rep"), "x").join(named.toDF("hub", "h"), "hub").filter("h <> rep").select("h", "rep").distinct()
    group = cut(group, "groups")

    def linkable() -> Column:
        """Sizes and sketches of a and b allow a link."""
        apart = sum((F.bit_count(F.col("fa")[i].bitwiseXOR(F.col("fb")[i])) for i in range(1, FOLD // 64)), F.bit_count(F.col("fa")[0].bitwiseXOR(F.col("fb")[0])))
        sizes = F.least("na", "nb") * den >= F.greatest("na", "nb") * num
        return sizes & (apart * (den + num) <= (F.col("na") + F.col("nb")) * (den - num))

    def near(pairs: DataFrame) -> DataFrame:
        """Different pairs a, b, na, nb -> a, b (a < b) of those that the wide sketches allow. Only pairs of two large sets meet them."""
        turned = F.col("a") > F.col("b")
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(turned, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(turned, F.col("na")).otherwise(F.col("nb")).alias("nb"))
        pairs = cut(pairs, "near")
        large = F.least("na", "nb") >= WIDE_FROM
        p = pairs.filter(large).join(wide.toDF("a", "wa"), "a").join(wide.toDF("b", "wb"), "b")
        apart = F.aggregate(F.zip_with("wa", "wb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
        allowed = p.filter(apart * (den + num) <= (F.col("na") + F.col("nb")) * (den - num)).select("a", "b")
        return allowed.union(pairs.filter(~large).select("a", "b"))

    def verified(pairs: DataFrame) -> DataFrame:
        """pairs a, b -> a, b of those that link."""
        wanted = cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "wanted")
        small = wanted.count() <= BROADCAST_IDS
        found = base.join(F.broadcast(wanted) if small else wanted, "id", "left_semi").mapInArrow(_pack, "id long, packed binary")
        # A repeated id may have several texts; the class decides which one stands for it.
        found = cut(found, "texts")
        both = pairs.join(found.toDF("a", "pa"), "a").join(found.toDF("b", "pb"), "b")
        return both.select("a", "b", "pa", "pb").mapInArrow(_verify(width, num, den), "a long, b long, ok boolean").filter("ok").select("a", "b").distinct()

    def inside_groups(rows: DataFrame, which: Column) -> DataFrame:
        """rows h, rep, root, big -> pairs of a group's members that may link, each in the first of the groups that hold both."""
        per_rep = rows.groupBy("rep").agg(F.array_sort(F.collect_set("h")).alias("hs"))
        rows = cut(rows.join(reps, "rep").join(per_rep, "rep").select("h", "rep", "root", "big", "n", "fold", "hs"), "spread")
        p = rows.toDF("h", "a", "ra", "big_a", "na", "fa", "ha")
        q = rows.toDF("h", "b", "rb", "big_b", "nb", "fb", "hb")
        once = F.array_min(F.array_intersect("ha", "hb")) == p["h"]
        return near(p.join(q, (p["h"] == q["h"]) & which & linkable() & once).select("a", "b", "na", "nb"))

    everyone = group.union(group.select("h", F.col("h").alias("rep"))).distinct()
    if every:
        rows = everyone.select("h", "rep", F.lit(0).alias("root"), F.lit(False).alias("big"))
        return sets, member, cut(verified(inside_groups(rows, F.col("a") < F.col("b"))), "links")

    first = group.join(reps.toDF("h", "na", "fa"), "h").join(reps.toDF("rep", "nb", "fb"), "rep").filter(linkable())
    first = cut(near(first.select(F.col("h").alias("a"), F.col("rep").alias("b"), "na", "nb")).distinct(), "pairs")
    start = cut(first.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "start")
    twice = member.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b")
    twice = member.join(twice.select("id", "a"), "id").select("a", F.col("rep").alias("b")).filter("a <> b")
    links = cut(verified(start).union(twice), "links")
    roots = components(links)

    def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        p = pairs.join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left")
        return p.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")

    rest = cut(apart(first.join(start, ["a", "b"], "left_anti"), roots), "rest")
    if not rest.isEmpty():
        links = cut(links.union(verified(rest)), "links")
        roots = components(links)

    # Groups that still span components. A group's largest component is never held against itself: the others' members
    # meet all of the group, so the work is the product of the two counts, not the square of the group.
    placed = cut(everyone.join(roots.toDF("rep", "root"), "rep", "left").select("h", "rep", F.coalesce("root", "rep").alias("root")), "placed")
    per_root = placed.groupBy("h", "root").agg(F.count("*").alias("c"))
    split = per_root.groupBy("h").agg(F.max_by("root", F.struct("c", "root")).alias("most"), F.count("*").alias("roots")).filter("roots > 1").select("h", "most")
    rows = placed.join(split, "h").select("h", "rep", "root", (F.col("root") == F.col("most")).alias("big"))
    across = inside_groups(rows, ~F.col("big_a") & (F.col("ra") != F.col("rb")) & (F.col("big_b") | (F.col("a") < F.col("b"))))
    across = cut(across.join(first, ["a", "b"], "left_anti"), "across")
    if not across.isEmpty():
        links = cut(links.union(verified(across)), "links")
        roots = components(links)

    return sets, member, roots


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """id, n_shingles, component_id for every row; linked where den * |intersection| >= num * |union|.

    component_id is the smallest id reachable. Null or wordless text has no shingle and no link. Rows that repeat an id
    are one node with the links of all of them; a row with a null id has no link and a null component. An empty table
    gives no rows; other columns are ignored. Ids are whole numbers; shingles are told apart by 64 bits of hash.
    """
    sets, member, roots = _join(docs, id_col, text_col, width, num, den, False)
    lowest = member.join(roots.toDF("rep", "root"), "rep", "left").select("id", F.coalesce("root", "rep").alias("root")).groupBy("id").agg(F.min("root").alias("component_id"))
    out = sets.select("id", F.col("n").alias("n_shingles")).join(lowest, "id", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def near_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """(a, b) with a < b for every link between classes of equal shingle sets, and (id, rep) for every document in a class.

    A class goes by its smallest id. All pairs of classes that share a part are verified, so a group of near copies costs
    the square of its different sets, which is also the number of its links. Nulls and repeated ids are as in near_components.
    """
    _, member, links = _join(docs, id_col, text_col, width, num, den, True)
    return links, member.withColumnRenamed("id", id_col)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with the smallest id of each component; documents without words stay. All columns kept."""
    found = near_components(docs, id_col, text_col, **how)
    return keep_ids(docs, found.filter(F.col(id_col).eqNullSafe(F.col("component_id"))).select(id_col), id_col)

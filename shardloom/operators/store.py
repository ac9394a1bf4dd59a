"""Tables of blocks that change: versions published together, idempotent inserts, set-once columns, flags, archiving, retention.

A store is a folder. A table's version is a Parquet folder that is never changed; a manifest names one version of every
table. Writers write new versions of what they change and then a manifest under the next number, which only one of them can
create, so readers see all of a change or nothing, and keep what they opened. Rewrites are anti-joins and unions, as plain
Parquet has no merge.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codecs
from . import graph, ordered, relations, shards

BLOCK, PROOF, LINK = 0, 1, 2
#: A block's payload and the flag that says it is there.
FLAG_OF = {BLOCK: "has_data", PROOF: "has_proof", LINK: "has_proof_link"}
ARCHIVE_SPAN = 100
STATE_DAYS = 2


class Conflict(RuntimeError):
    """Another writer has published in the meantime."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _latest(self) -> int:
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        fs = folder.getFileSystem(conf)
        if not fs.exists(folder):
            return 0
        done = [int(f.getPath().getName()) for f in fs.listStatus(folder) if fs.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
        return max(done, default=0)

    def versions(self, at: int | None = None) -> tuple[int, dict[str, str]]:
        """Number of a manifest (the latest) and the tables' folders in it. There are about twelve tables."""
        n = self._latest() if at is None else at
        return n, ({r["name"]: r["folder"] for r in self.spark.read.parquet(f"{self.path}/manifest/{n}").collect()} if n else {})

    def read(self, name: str, at: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.versions(at)[1][name])

    def commit(self, after: int, **tables: DataFrame) -> int:
        """Publish new versions of tables, if manifest number after is still the latest; its number."""
        now, folders = self.versions()
        if now != after:
            raise Conflict(f"manifest {now}, not {after}")
        for name, df in tables.items():
            folders[name] = f"{self.path}/tables/{name}/{uuid.uuid4().hex}"
            df.write.parquet(folders[name])
        rows = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(f).alias("folder")) for n, f in sorted(folders.items())]))
        try:
            self.spark.range(1).coalesce(1).select(rows.alias("x")).select("x.*").write.mode("error").parquet(f"{self.path}/manifest/{after + 1}")
        except Exception as e:
            if self._latest() > after:
                raise Conflict(f"manifest {after + 1} is another writer's") from e
            raise
        return after + 1


def _set_flag(handles: DataFrame, ids: DataFrame, flags: list[str]) -> DataFrame:
    """handles with flags set for ids, and changed: whether that made a difference."""
    bits = F.lit(sum(1 << (codecs.BASE + codecs.FLAGS.index(f)) for f in flags))
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    rows = handles.join(hit, "id", "left").withColumn("_new", F.when(F.col("_hit"), F.col("flags").bitwiseOR(bits)).otherwise(F.col("flags")))
    return rows.withColumn("changed", F.col("_new") != F.col("flags")).withColumn("flags", F.col("_new")).drop("_hit", "_new")


def set_applied(handles: DataFrame, ids: DataFrame) -> DataFrame:
    return _set_flag(handles, ids, ["is_applied"])


def create_handles(handles: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(handles with those of new blocks, statuses id, status): created, or fetched where the id is known."""
    fresh = blocks.dropDuplicates(["id"])
    return handles.unionByName(fresh.join(handles.select("id"), "id", "left_anti")), relations.insert_if_absent(handles, fresh.select("id"), "id")


def store_payloads(handles: DataFrame, entries: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """incoming: id, kind, data -> (handles, entries, statuses id, kind, status): new, or known, which changes nothing.

    A payload of a block without a handle isn't stored; its status is unknown.
    """
    one = incoming.dropDuplicates(["id", "kind"])
    has = F.lit(False)
    for kind, name in FLAG_OF.items():
        has = has | ((F.col("kind") == kind) & codecs.flag(F.col("flags"), name))
    judged = one.join(handles.select("id", "flags"), "id", "left").withColumn("status", F.when(F.col("flags").isNull(), "unknown").when(has, "known").otherwise("new"))
    new = judged.filter("status = 'new'")
    bits = F.create_map(*[F.lit(x) for kind, name in FLAG_OF.items() for x in (kind, 1 << (codecs.BASE + codecs.FLAGS.index(name)))])
    per_id = new.groupBy("id").agg(F.bit_or(bits[F.col("kind")]).alias("_bits"))
    handles = handles.join(per_id, "id", "left").withColumn("flags", F.col("flags").bitwiseOR(F.coalesce("_bits", F.lit(0)))).drop("_bits")
    return handles, entries.unionByName(new.select(entries.columns)), judged.select("id", "kind", "status")


def store_handles(handles: DataFrame, key_blocks: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Upserts handles; those of key blocks go into key_blocks (seq_no, id) as well."""
    kept = handles.join(changed.select("id"), "id", "left_anti")
    keys = changed.filter(codecs.is_key(F.col("flags"), F.col("seq_no")) & shards.is_masterchain(F.col("workchain"))).select("seq_no", "id")
    return kept.unionByName(changed.select(handles.columns)), key_blocks.join(keys.select("seq_no"), "seq_no", "left_anti").unionByName(keys)


def store_connections(handles: DataFrame, edges: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """new: id, direction, to_id -> (handles, edges). An edge is stored once; its flag goes with it."""
    fresh = new.dropDuplicates(["id", "direction"]).join(edges.select("id", "direction"), ["id", "direction"], "left_anti")
    for direction in ("next1", "next2", "prev1", "prev2"):
        handles = _set_flag(handles, fresh.filter(F.col("direction") == direction), [f"has_{direction}"]).drop("changed")
    return handles, edges.unionByName(fresh.select(edges.columns))


def set_refs(handles: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """refs: id, ref -> (handles, conflicts id, now, ref). A masterchain reference is set once; the same one again is fine."""
    one = refs.filter("ref <> 0").groupBy("id").agg(F.min("ref").alias("_lo"), F.max("ref").alias("_hi"))
    rows = handles.join(one, "id", "left").withColumn("_now", codecs.ref_seq(F.col("flags")))
    odd = F.col("_lo").isNotNull() & ((F.col("_lo") != F.col("_hi")) | (F.col("_now") != 0) & (F.col("_now") != F.col("_lo")))
    new = F.when(F.col("_lo").isNotNull() & ~odd, F.col("flags").bitwiseOR(F.col("_lo"))).otherwise(F.col("flags"))
    bad = rows.filter(odd).select("id", F.col("_now").alias("now"), F.col("_hi").alias("ref"))
    return rows.withColumn("flags", new).select(handles.columns), bad


def move_into_archive(handles: DataFrame, entries: DataFrame, archives: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """frames: id, archive_id, data (a frame each) -> (handles, entries, archives archive_id, segment_no, data).

    Blocks that have moved already are passed over; the others' frames follow the archive's last segment in order of id.
    """
    done = handles.filter(codecs.flag(F.col("flags"), "moved_to_archive")).select("id")
    new = frames.join(done, "id", "left_anti")
    last = archives.groupBy("archive_id").agg(F.max("segment_no").alias("_last"))
    place = F.row_number().over(Window.partitionBy("archive_id").orderBy("id"))
    segments = new.withColumn("_n", place).join(last, "archive_id", "left").select("archive_id", (F.coalesce(F.col("_last") + 1, F.lit(0)) + F.col("_n") - 1).cast("long").alias("segment_no"), "data")
    handles = _set_flag(handles, new, ["moving_to_archive", "moved_to_archive"]).drop("changed")
    return handles, entries.join(new.select("id"), "id", "left_anti"), archives.unionByName(segments)


class Removal(NamedTuple):
    handles: DataFrame
    entries: DataFrame
    stats: DataFrame


def to_remove(handles: DataFrame, tops: DataFrame) -> DataFrame:
    """Handles (workchain, shard, seq_no, flags) below the edge: neither in a shard at or past its top, nor block 0, nor a
    key block of the masterchain. A block of a shard that the edge doesn't know is below it."""
    mc = shards.is_masterchain(F.col("workchain"))
    rows = shards.contained(handles, tops)
    return rows.filter(~F.col("contains") & (F.col("seq_no") != 0) & ~(mc & codecs.flag(F.col("flags"), "is_key_block"))).select(handles.columns)


def remove_blocks(handles: DataFrame, entries: DataFrame, tops: DataFrame) -> Removal:
    """Deletes blocks below the edge with their entries; handles of key blocks stay. Edges stay, too."""
    gone = graph.settled(to_remove(handles, tops).select("id", "workchain"))
    packages = entries.join(gone.select("id"), "id", "left_semi")
    stats = gone.agg(F.count_if(shards.is_masterchain(F.col("workchain"))).alias("mc_handles"), F.count("*").alias("handles")).crossJoin(packages.agg(F.count("*").alias("entries")))
    return Removal(handles.join(gone.select("id"), "id", "left_anti"), entries.join(gone.select("id"), "id", "left_anti"), stats)


def clear_handles(handles: DataFrame, tops: DataFrame) -> DataFrame:
    """handles with the data and proof flags of blocks below the edge cleared."""
    gone = to_remove(handles, tops).select("id").withColumn("_gone", F.lit(True))
    return handles.join(gone, "id", "left").withColumn("flags", F.when(F.col("_gone"), codecs.clear_data(F.col("flags"))).otherwise(F.col("flags"))).drop("_gone")


def removal_target(key_blocks: DataFrame, policy: str, last: int | None = None, distance: int = 0) -> DataFrame:
    """The key block that blocks are removed before: before_last_key, the one before the last; before_last_persistent, the
    last whose time bucket differs from its predecessor's; fixed distance behind last: the last key block there."""
    if policy == "before_last_key":
        two = key_blocks.orderBy(F.desc("seq_no")).limit(2)
        return two.orderBy("seq_no").limit(1).filter(F.lit(two.count() == 2))
    if policy == "before_last_persistent":
        rows = ordered.persistent_boundaries(key_blocks.select("seq_no", "gen_utime"))
        return rows.orderBy(F.desc("seq_no")).limit(1).select("seq_no", "gen_utime")
    if policy == "distance" and last is not None:
        return key_blocks.filter(F.col("seq_no") <= last - distance).orderBy(F.desc("seq_no")).limit(1)
    raise ValueError(policy)


def remove_archives(archives: DataFrame, until: int) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): the newest archive that starts before until stays, as it may reach past it; older ones go."""
    pivot = archives.filter(F.col("archive_id") < until).agg(F.max("archive_id").alias("_pivot"))
    rows = archives.join(F.broadcast(pivot))
    keep = F.col("_pivot").isNull() | (F.col("archive_id") >= F.col("_pivot"))
    return rows.filter(keep).drop("_pivot"), rows.filter(~keep).drop("_pivot")


def states_to_remove(states: DataFrame, tops: DataFrame) -> DataFrame:
    """States (workchain, shard, seq_no) that stand before the edge; block 0's stay, and those of shards it doesn't know."""
    rows = shards.contained(states, tops)
    return rows.filter((F.col("seq_no") != 0) & (F.col("seq_no") < F.col("top_seq"))).select(states.columns)


def remove_states(states: DataFrame, cells: DataFrame, refs: DataFrame, tops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(states, cells): states before the edge go, and with them the cells (node, rc) that nothing else refers to."""
    gone = graph.settled(states_to_remove(states, tops))
    removed = graph.cascade_delete(cells, refs, gone.select(F.col("cell").alias("node")))
    left = cells.join(removed.select("node", "removed"), "node", "left").withColumn("rc", F.col("rc") - F.coalesce("removed", F.lit(0))).drop("removed")
    return states.join(gone.select("workchain", "shard", "seq_no"), ["workchain", "shard", "seq_no"], "left_anti"), left.filter("rc > 0")


def snapshots_to_keep(key_blocks: DataFrame, now: Column, days: int = STATE_DAYS) -> DataFrame:
    """Persistent blocks (seq_no, gen_utime) of the last days, and one more before them."""
    rows = ordered.persistent_boundaries(key_blocks.select("seq_no", "gen_utime")).select("seq_no", "gen_utime")
    recent = rows.filter(F.col("gen_utime") + days * 86400 > now)
    older = rows.filter(F.col("gen_utime") + days * 86400 <= now).orderBy(F.desc("seq_no")).limit(1)
    return recent.unionByName(older)


def outdated_folders(names: DataFrame, keep_from: int) -> DataFrame:
    """Folders of snapshots whose name is a number below keep_from; other names are left alone."""
    return names.filter(F.expr("try_cast(name as bigint)") < keep_from)


def archives_in(archives: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Archives whose id lies from first to last, ends included, in order."""
    rows = archives if first is None else archives.filter(F.col("archive_id") >= first)
    return (rows if last is None else rows.filter(F.col("archive_id") <= last)).orderBy("archive_id")


def archives_to_upload(archives: DataFrame, last: int, until: int) -> DataFrame:
    """Ids after the last upload and before until, but for the newest archive, with the name each is uploaded under."""
    newest = archives.agg(F.max("archive_id").alias("_newest"))
    ids = archives.select("archive_id").distinct().filter((F.col("archive_id") > last) & (F.col("archive_id") < until))
    return ids.join(F.broadcast(newest), F.col("archive_id") < F.col("_newest")).select("archive_id", codecs.upload_key(F.col("archive_id")).alias("name"))

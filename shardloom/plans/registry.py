"""Registered queries over the lenses, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from ..operators import graph, ordered, relations
from ..sources import archive
from ..streaming import ingest
from .lenses import BLOCKS_SQL as B
from .lenses import blocks, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"select seq_no, gen_utime, prev_utime from (select *, lag(gen_utime) over (order by seq_no) as prev_utime from {B} where is_key) where gen_utime >> 17 <> prev_utime >> 17")
def persistent_boundaries(s, d):
    return ordered.persistent_boundaries(blocks(s, d).filter("is_key").select("seq_no", "gen_utime"))


@query(f"select seq_no, max(case when is_key then seq_no end) over (order by seq_no rows between unbounded preceding and 1 preceding) as prev_key from {B}")
def prev_key_block(s, d):
    b = blocks(s, d).select("seq_no", "is_key")
    return ordered.last_before(b, "seq_no", F.when(F.col("is_key"), F.col("seq_no")), "prev_key", False).select("seq_no", "prev_key")


@query(f"select a.seq_no, k.seq_no as key_seq_no from {B} a asof left join (select seq_no from {B} where is_key) k on a.seq_no >= k.seq_no")
def closest_key_asof(s, d):
    b = blocks(s, d).select("seq_no", "is_key")
    return ordered.last_before(b, "seq_no", F.when(F.col("is_key"), F.col("seq_no")), "key_seq_no", True).select("seq_no", "key_seq_no")


@query(f"select seq_no, g + 100 * ((seq_no - g) // 100) as archive_id from (select seq_no, greatest(seq_no - seq_no % 997, seq_no - seq_no % 20000) as g from {B})")
def archive_bucket(s, d):
    return ordered.archive_ids(blocks(s, d).select("seq_no"), "seq_no", F.col("seq_no") % 997 == 0)


@query(f"""with recursive b as (select seq_no, seq_no % 997 = 0 as is_key, seq_no - seq_no % 20000 as base, row_number() over (partition by seq_no // 20000 order by seq_no) as i from {B} where seq_no % 7 <> 3),
    r(seq_no, base, i, arch) as (select seq_no, base, i, case when is_key then seq_no else base end from b where i = 1
        union all select b.seq_no, b.base, b.i, case when b.is_key then b.seq_no when b.seq_no >= greatest(r.arch, b.base) + 100 then b.seq_no else greatest(r.arch, b.base) end from r join b on b.base = r.base and b.i = r.i + 1)
    select r.seq_no, b.is_key, r.arch as archive_id from r join b on b.seq_no = r.seq_no""")
def archive_bucket_gapped(s, d):
    b = blocks(s, d).filter("seq_no % 7 <> 3").select("seq_no", (F.col("seq_no") % 997 == 0).alias("is_key"))
    return ordered.archive_ids_gapped(b, "seq_no", "is_key")


@query(f"select seq_no, case when seq_no < m + 100 then m end as archive_id from (select seq_no, (select max(i) from unnest([0, 100, 150, 2000, 9000]) t(i) where i <= seq_no) as m from {B})")
def archive_cover(s, d):
    return relations.cover(blocks(s, d).select("seq_no"), [0, 100, 150, 2000, 9000], "seq_no", 100)


@query(f"select p + 1 as hole_from, seq_no - 1 as hole_to from (select seq_no, lag(seq_no) over (order by seq_no) as p from {B} where seq_no % 7 <> 3) where seq_no - p > 1")
def gap_check(s, d):
    return ordered.gaps(blocks(s, d).filter("seq_no % 7 <> 3").select("seq_no"), [], "seq_no")


@query("select min(event_id) as lo, max(event_id) as hi, count(*) as n, min(event_id) + count(*) = max(event_id) + 1 as contiguous from events")
def contiguity_summary(s, d):
    return ordered.contiguity(blocks(s, d), "seq_no")


def _tops(s, d):
    """Tops of an edge at half of the chain."""
    b = blocks(s, d)
    half = b.agg(F.max("seq_no").alias("_last"))
    return relations.top_blocks(b.join(F.broadcast(half)), "shard", "seq_no", F.col("seq_no") * 2 <= F.col("_last"))


@query(f"select shard, max(seq_no) as top from {B} where seq_no * 2 <= (select max(event_id) from events) group by shard")
def top_blocks(s, d):
    return _tops(s, d)


_TOPS = f"(select shard, max(seq_no) as top from {B} where seq_no * 2 <= (select max(event_id) from events) group by shard)"


@query(f"select b.seq_no, b.shard from {B} b left join {_TOPS} t on b.shard = t.shard where not coalesce(b.seq_no >= t.top, false) and b.seq_no <> 0 and not b.is_key")
def retention_delete_set(s, d):
    b = blocks(s, d)
    return relations.retention_delete(b, _tops(s, d), "shard", "seq_no", F.col("is_key")).select("seq_no", "shard")


@query(f"select b.shard, count(*) as n, count(*) filter (where b.is_key) as keys from {B} b join {_TOPS} t on b.shard = t.shard where b.seq_no < t.top group by b.shard")
def retention_counts(s, d):
    b = blocks(s, d)
    tops = relations.tops_hint(_tops(s, d))
    return b.join(tops, "shard").filter("seq_no < top").groupBy("shard").agg(F.count("*").alias("n"), F.count_if("is_key").alias("keys"))


@query(f"select b.seq_no, t.top < b.seq_no as is_after from {B} b join {_TOPS} t on b.shard = t.shard")
def edge_is_before(s, d):
    b = blocks(s, d)
    tops = relations.tops_hint(_tops(s, d))
    return b.join(tops, "shard").select("seq_no", (F.col("top") < F.col("seq_no")).alias("is_after"))


_P = "(select n_nationkey as k, right(lpad(bin(n_nationkey), 5, '0'), 5)[1:1 + n_nationkey % 5] as p from nation)"


@query(f"select a.k as ka, b.k as kb from {_P} a join {_P} b on starts_with(a.p, b.p) or starts_with(b.p, a.p)")
def prefix_join(s, d):
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("k"), codecs.prefix(F.col("n_nationkey").cast("long"), 5).alias("p5"))
    n = n.select("k", F.left(F.col("p5"), (1 + F.col("k") % 5).cast("int")).alias("p"))
    a, b = n.toDF("ka", "pa"), n.toDF("kb", "pb")
    return relations.prefix_join(a, b, "pa", "pb", 5).select("ka", "kb")


@query(f"select seq_no from {B} b where exists (select 1 from {B} x where x.is_key and x.seq_no in (b.seq_no - 1, b.seq_no - 2, b.seq_no - 4))")
def prev_in_family(s, d):
    b = blocks(s, d)
    keys = b.filter("is_key").select(F.explode(F.array(*[F.col("seq_no") + k for k in (1, 2, 4)])).alias("seq_no"))
    return b.select("seq_no").join(keys, "seq_no", "left_semi")


_D = f"(select shard as k, seq_no, case when event_type in ('signup', 'view') then 1 when failed then -1 else 0 end as delta from {B})"


@query(f"select k, rc, case when rc > 0 then p end as payload from (select k, sum(delta)::bigint as rc, arg_min(seq_no, seq_no) filter (where delta > 0) as p from {_D} group by k) where rc <> 0")
def refcount_merge(s, d):
    b = blocks(s, d).select(F.col("shard").alias("k"), "seq_no", F.when(F.col("event_type").isin("signup", "view"), 1).when(F.col("failed"), -1).otherwise(0).cast("long").alias("delta"))
    return relations.refcount_merge(b, "k", "delta", "seq_no", "seq_no")


@query(f"select k, rc, p as payload from (select k, sum(delta)::bigint as rc, arg_min(seq_no, seq_no) filter (where delta > 0) as p from {_D} group by k) where rc > 0")
def refcount_live(s, d):
    return refcount_merge(s, d).filter("rc > 0")


@query("select conv_id, string_agg(text, '|' order by turn, text) as data from conversations group by conv_id")
def archive_concat(s, d):
    c = table(s, d, "conversations").withColumn("o", F.struct("turn", "text"))
    return relations.concat_segments(c, "conv_id", "o", F.col("text"), "|")


_USE = {"documents": ("doc_id", "text"), "pages": ("page_id", "html"), "benchmark": ("item_id", "text"), "nation": ("n_nationkey", "n_name"), "part": ("p_partkey", "p_name")}


@query(" union all ".join(f"select '{t}' as table_name, sum(strlen({k}::varchar))::bigint as key_bytes, sum(strlen({v}))::bigint as value_bytes from {t}" for t, (k, v) in _USE.items()))
def disk_usage(s, d):
    parts = [relations.disk_usage(t, table(s, d, t), F.col(k), F.col(v)) for t, (k, v) in _USE.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"select seq_no, (seq_no & 4294967295) | case when is_key then 1::bigint << 43 else 0 end | case when failed then 1::bigint << 42 else 0 end | (1::bigint << 32) as packed, is_key, seq_no & 4294967295 as ref, ((seq_no & 4294967295) | case when is_key then 1::bigint << 43 else 0 end | case when failed then 1::bigint << 42 else 0 end) as cleared from {B}")
def flags_pack_unpack(s, d):
    b = blocks(s, d).withColumn("packed", codecs.pack_flags(F.col("seq_no"), {"has_data": F.lit(True), "is_applied": F.col("failed"), "is_key_block": F.col("is_key")}))
    return b.select("seq_no", "packed", codecs.flag(F.col("packed"), "is_key_block").alias("is_key"), codecs.ref_seq(F.col("packed")).alias("ref"), codecs.clear_data(F.col("packed")).alias("cleared"))


_NAME = "case p_partkey % 3 when 0 then 'block' when 1 then 'proof' else 'prooflink' end || '_(' || (p_partkey % 2 - 1) || ',' || lower(lpad(hex(p_partkey << 40), 16, '0')) || ',' || p_size || '):' || upper(sha256(p_name)) || ':' || upper(sha256(p_brand))"


def _names(s, d):
    p = table(s, d, "part")
    kind = F.element_at(F.array(*[F.lit(k) for k in codecs.KINDS]), (F.col("p_partkey") % 3 + 1).cast("int"))
    return p.select("p_partkey", codecs.file_name(kind, F.col("p_partkey") % 2 - 1, F.shiftleft("p_partkey", 40), F.col("p_size"), F.sha2("p_name", 256), F.sha2("p_brand", 256)).alias("name"))


@query(f"select p_partkey, {_NAME} as name from part")
def filename_format(s, d):
    return _names(s, d)


@query("select p_partkey, case p_partkey % 3 when 0 then 'block' when 1 then 'proof' else 'prooflink' end as kind, (p_partkey % 2 - 1)::integer as workchain, p_partkey << 40 as shard, p_size::bigint as seq, sha256(p_name) as root, sha256(p_brand) as file from part")
def filename_parse(s, d):
    return _names(s, d).select("p_partkey", codecs.parse_file_name(F.col("name")).alias("x")).select("p_partkey", "x.*")


@query("select coalesce(d.doc_id, l.doc_id) as doc_id, d.doc_id is not null as has_block, l.doc_id is not null as has_proof from documents d full join labels l on d.doc_id = l.doc_id")
def block_proof_pair(s, d):
    a = table(s, d, "documents").select("doc_id", F.lit(True).alias("b"))
    z = table(s, d, "labels").select("doc_id", F.lit(True).alias("p"))
    return a.join(z, "doc_id", "full").select("doc_id", F.col("b").isNotNull().alias("has_block"), F.col("p").isNotNull().alias("has_proof"))


@query("select doc_id from documents where doc_id not in (select doc_id from labels where doc_id is not null)")
def unapplied_anti(s, d):
    return table(s, d, "documents").select("doc_id").join(table(s, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("select doc_id, case when exists (select 1 from labels l where l.doc_id = d.doc_id) then 'fetched' else 'created' end as status from documents d")
def insert_if_absent(s, d):
    return relations.insert_if_absent(table(s, d, "labels"), table(s, d, "documents").select("doc_id"), "doc_id")


@query(f"select shard, min(r) as lo, max(r) as hi from (select shard, nullif(seq_no % 3, 0) as r from {B}) group by shard having min(r) < max(r)")
def set_once_conflicts(s, d):
    return relations.set_once_conflicts(blocks(s, d), "shard", F.col("seq_no") % 3)


@query("select o_orderpriority, coalesce(sum(case when o_orderstatus = 'O' then o_totalprice::decimal(28,2) end), 0) * 3 > sum(o_totalprice::decimal(28,2)) * 2 as ok from orders group by o_orderpriority")
def quorum(s, d):
    return relations.quorum(table(s, d, "orders"), "o_orderpriority", F.col("o_totalprice"), F.col("o_orderstatus") == "O")


@query(f"select shard, count(*) filter (where failed) / greatest(count(*), 1)::double as failures from {B} group by shard")
def avg_failures(s, d):
    return blocks(s, d).groupBy("shard").agg((F.count_if("failed") / F.greatest(F.count("*"), F.lit(1))).alias("failures"))


@query(f"""with recursive v as (select shard, row_number() over (partition by shard order by seq_no) as i, floor(value * 100)::bigint as x from {B}),
    r(shard, i, acc) as (select shard, i, x from v where i = 1 union all select v.shard, v.i, case when r.acc > 0 then (r.acc + v.x) // 2 else v.x end from r join v on v.shard = r.shard and v.i = r.i + 1)
    select shard, arg_max(acc, i) as roundtrip from r group by shard""")
def ewma_roundtrip(s, d):
    return ordered.ewma(blocks(s, d), "shard", "seq_no", F.floor(F.col("value") * 100))


@query(f"""with x as (select shard, seq_no, sum(case when failed then 1 else -1 end) over (partition by shard order by seq_no) as c from {B}),
    y as (select shard, seq_no, c - least(min(c) over (partition by shard order by seq_no), 0) as u from x) select shard, arg_max(u, seq_no)::bigint as unreliability from y group by shard""")
def unreliability(s, d):
    return ordered.unreliability(blocks(s, d), "shard", "seq_no", F.col("failed"))


@query(f"select shard, min(seq) as min_ref from (select shard, seq_no % 50 as seq, sum(case when failed then -1 else 1 end) as n from {B} group by all) where n > 0 group by shard")
def min_ref(s, d):
    n = blocks(s, d).groupBy("shard", (F.col("seq_no") % 50).alias("seq")).agg(F.sum(F.when(F.col("failed"), -1).otherwise(1)).alias("n"))
    return n.filter("n > 0").groupBy("shard").agg(F.min("seq").alias("min_ref"))


@query(f"select seq_no, count(*) over () < 50 as incomplete from (select seq_no from {B} where is_key and seq_no >= 100 order by seq_no limit 8)")
def key_page(s, d):
    return relations.key_page(blocks(s, d).filter("is_key").select("seq_no"), "seq_no", 100, 50)


@query(f"select gen_utime, seq_no from {B} order by gen_utime, seq_no limit 50")
def sorted_apply_order(s, d):
    return blocks(s, d).select("gen_utime", "seq_no").orderBy("gen_utime", "seq_no").limit(50)


@query(f"select shard, seq_no, lag(seq_no) over w as prev1, lead(seq_no) over w as next1 from {B} window w as (partition by shard order by seq_no)")
def predecessor_edges(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("shard").orderBy("seq_no")
    return blocks(s, d).select("shard", "seq_no", F.lag("seq_no").over(w).alias("prev1"), F.lead("seq_no").over(w).alias("next1"))


_E = "(select distinct l_suppkey as src, 100000 + l_partkey as dst from lineitem where l_orderkey % 2 = 0 union select distinct 100000 + l_partkey, l_suppkey from lineitem where l_orderkey % 2 = 1)"


def _edges(s, d):
    li = table(s, d, "lineitem")
    down = li.filter("l_orderkey % 2 = 0").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 100000).alias("dst"))
    return down.union(li.filter("l_orderkey % 2 = 1").select(F.col("l_partkey") + 100000, "l_suppkey")).distinct()


@query(f"with recursive r(node, level) as (select 1::bigint, 0 union select e.dst, r.level + 1 from r join {_E} e on e.src = r.node where r.level < 3) select node, min(level) as level from r group by node")
def closure_levels(s, d):
    return graph.closure(_edges(s, d), s.createDataFrame([(1,)], "node long"), 3)


_TREE = "(select distinct 'o' || l_orderkey as src, 'p' || l_partkey as dst from lineitem)"


def _refs(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()


def _tree(s, d):
    return _refs(table(s, d, "lineitem"))


@query(f"with r as (select src as node, 1 as c from (select distinct src from {_TREE}) union all select dst, 1 from {_TREE}) select node, count(*) as refs, not (node[1] = 'p' and substr(node, 2)::bigint % 5 = 0) as is_new from r group by node")
def dag_insert_plan(s, d):
    t = _tree(s, d)
    stored = t.filter(F.substring("dst", 2, 20).cast("long") % 5 == 0).select(F.col("dst").alias("node"))
    return graph.insert_plan(t, t.select(F.col("src").alias("node")).distinct(), stored)


@query(f"""with roots as (select distinct src as node from {_TREE} where substr(src, 2)::bigint % 2 = 0), rc as (select dst as node, count(*) as rc from {_TREE} group by dst),
    rem as (select t.dst as node, count(*) as removed from {_TREE} t join roots on t.src = roots.node group by t.dst)
    select node, 1::bigint as removed, true as gone from roots union all select rem.node, removed, removed = rc from rem join rc on rem.node = rc.node""")
def cascade_delete(s, d):
    t = _tree(s, d)
    src = t.select(F.col("src").alias("node")).distinct()
    cells = src.withColumn("rc", F.lit(1).cast("long")).unionByName(t.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("rc")))
    return graph.cascade_delete(cells, t, src.filter(F.substring("node", 2, 20).cast("long") % 2 == 0))


@query("select doc_id, sha256(text) as file_hash from documents")
def content_hash(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"))


@query("select conv_id, sha256(string_agg(sha256(text), '' order by turn, sha256(text))) as digest from conversations group by conv_id")
def merkle_fold(s, d):
    c = table(s, d, "conversations")
    return graph.merkle_fold(c, "conv_id", "turn", "text")


@query("""with e as (select distinct 'o' || l_orderkey as src, 'p' || l_partkey as dst from lineitem)
    select dst as node, sha256(dst) as digest, 1::bigint as cells, 0 as height from e group by dst
    union all select src, sha256(src || string_agg(sha256(dst), '' order by dst)), 1 + count(*), 1 from e group by src""")
def merkle_levels(s, d):
    t = _refs(table(s, d, "lineitem"))
    nodes = t.select(F.col("src").alias("node")).union(t.select("dst")).distinct().withColumn("data", F.col("node"))
    return graph.merkle_levels(nodes, t.withColumn("ord", F.col("dst")))


@query("select page_id, hex(encode(html)[101:160]) as part from pages where octet_length(encode(html)) > 100")
def payload_slice(s, d):
    p = table(s, d, "pages").withColumn("b", F.col("html").cast("binary"))
    return p.filter(F.octet_length("b") > 100).select("page_id", F.hex(F.substring("b", 101, 60)).alias("part"))


@query(f"select seq_no, case when failed then 'skip' when prev_key > 9000 then 'drop' when kind = 'mc' then case when seq_no = 5001 then 'apply' else 'ignore' end when mc_ref <= 5008 then 'preapply' else 'ignore' end as verdict from (select *, case when seq_no % 2 = 1 then 'mc' else 'shard' end as kind, seq_no as prev_key, seq_no as mc_ref from {B})")
def admission(s, d):
    b = blocks(s, d).select("seq_no", F.col("failed").alias("known"), F.when(F.col("seq_no") % 2 == 1, "mc").otherwise("shard").alias("kind"), F.col("seq_no").alias("prev_key"), F.col("seq_no").alias("mc_ref"))
    return ingest.admission(b, 5000, 9000, 5000).select("seq_no", "verdict")


@query(f"select seq_no, case when seq_no <= 100 then 'late' when seq_no = greatest(coalesce(lag(seq_no) over (order by seq_no), 100), 100) + 1 then 'next' else 'hole' end as verdict from {B} where seq_no % 11 <> 4")
def ordered_ingest(s, d):
    return ordered.classify_ingest(blocks(s, d).filter("seq_no % 11 <> 4").select("seq_no"), "seq_no", 100)


@query(f"select shard, (select max(gen_utime) from {B}) - max(gen_utime) as lag_s, max(seq_no) + 32 >= (select max(seq_no) from {B}) as is_synced from {B} group by shard")
def sync_status(s, d):
    b = blocks(s, d)
    top = b.agg(F.max("gen_utime").alias("t"), F.max("seq_no").alias("n"))
    own = b.groupBy("shard").agg(F.max("gen_utime").alias("u"), F.max("seq_no").alias("q"))
    return own.join(F.broadcast(top)).select("shard", (F.col("t") - F.col("u")).alias("lag_s"), (F.col("q") + 32 >= F.col("n")).alias("is_synced"))


@query()
def weighted_pick(s, d):
    """One supplier by weight, reproducibly: the smallest exponential of rate 2^-(key mod 10) drawn from the key's hash."""
    p = table(s, d, "supplier").select("s_suppkey", F.pow(F.lit(2.0), -(F.col("s_suppkey") % 10)).alias("w"))
    u = (F.pmod(F.xxhash64("s_suppkey", F.lit(42)), F.lit(1 << 40)) + 1) / float(1 << 40)
    return p.withColumn("draw", -F.log(u) / F.col("w")).orderBy("draw").limit(1).select("s_suppkey")


@query("select conv_id % 20 as g, row_number() over (partition by conv_id % 20 order by conv_id, turn, text) - 1 as ordinal, conv_id || ':' || turn as name, hex(encode(text)) as data from conversations")
def archive_roundtrip(s, d):
    c = table(s, d, "conversations").select((F.col("conv_id") % 20).alias("g"), F.struct("conv_id", "turn", "text").alias("o"), F.concat_ws(":", "conv_id", "turn").alias("name"), "text")
    back = archive.parse_archives(archive.build_archives(c, "g", "o", "name", "text"), "g", "content")
    return back.select("g", F.col("ordinal").cast("long").alias("ordinal"), "name", F.hex("data").alias("data"))

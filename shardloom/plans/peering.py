"""Registered queries on peers, archives' contents, references and configuration, each with its SQL."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from ..functions import codecs
from ..operators import peers, proofs
from ..sources import archive, config
from ..streaming import keeper
from .lenses import BLOCKS_SQL as B
from .lenses import blocks, table
from .registry import query


@query("""with e as (select user_id as peer, event_id as o, event_type <> 'error' as success, event_id % 3 <> 0 as counted, event_id % 5 = 0 as probe from events),
    g as (select *, coalesce(sum(counted::int) over (partition by peer order by o rows between unbounded preceding and 1 preceding), 0) as g from e),
    a as (select *, bool_or(probe) over (partition by peer, g order by o rows between unbounded preceding and current row) as active from g)
    select peer, count(*) filter (where counted) as attempts, count(*) filter (where counted and not success) as failures, 100 * count(*) filter (where counted and not success and active) as penalty from a group by peer""")
def peer_checks(s, d):
    e = table(s, d, "events")
    return peers.checks(e.select(F.col("user_id").alias("peer"), F.col("event_id").alias("ord"), (F.col("event_type") != "error").alias("success"), (F.col("event_id") % 3 != 0).alias("counted"), (F.col("event_id") % 5 == 0).alias("probe")))


@query(f"""with recursive v as (select shard as peer, row_number() over (partition by shard order by seq_no) as i, seq_no % 4 <> 0 as failed from {B}),
    r(peer, i, t) as (select peer, 0::bigint, 500 from v group by peer union all select v.peer, v.i, case when failed then least(5000, r.t * 3 // 2) else 500 end from r join v on v.peer = r.peer and v.i = r.i + 1)
    select peer, arg_max(t, i)::bigint as timeout from r group by peer""")
def backoff_timeouts(s, d):
    b = blocks(s, d).select(F.col("shard").alias("peer"), F.col("seq_no").alias("ord"), (F.col("seq_no") % 4 != 0).alias("failed"))
    return peers.backoff(b)


@query(f"select shard, seq_no, step from (select shard, seq_no, floor(seq_no * 100.0 / 10000 / 5) * 5 as step, lag(floor(seq_no * 100.0 / 10000 / 5)) over (partition by shard order by seq_no) as p, floor(seq_no * 100.0 / 10000 / 5) as b from {B}) where p is null or p <> b")
def progress_steps(s, d):
    return peers.progress_steps(blocks(s, d).select("shard", "seq_no"), "shard", "seq_no", F.col("seq_no") * 100.0 / 10000).withColumn("step", F.col("step").cast("double"))


@query("select user_id as peer, max(event_id) as last_ping from events group by user_id order by max(event_id) + 1000 > 9900, last_ping, peer limit 7")
def next_for_ping(s, d):
    p = table(s, d, "events").groupBy(F.col("user_id").alias("peer")).agg(F.max("event_id").alias("last_ping"))
    return peers.next_for_ping(p, 9900, 7)


@query("select user_id as peer, case when count(*) filter (where event_type = 'view') > 0 then count(*) filter (where event_type = 'view') * 100.0 / count(*) else 0 end as ratio from events group by user_id")
def hit_ratio(s, d):
    e = table(s, d, "events").groupBy(F.col("user_id").alias("peer")).agg(F.count_if(F.col("event_type") == "view").alias("h"), F.count_if(F.col("event_type") != "view").alias("m"))
    return e.select("peer", peers.hit_ratio(F.col("h"), F.col("m")).alias("ratio"))


_IDS = "(select p_partkey // 3 as i, p_partkey % 3 as k, p_name from part)"


@query(f"""select i % 10 as g, (i % 2 - 1)::integer as workchain, i << 40 as shard, i as seq, max(case when k = 0 then p_name end) as block, max(case when k = case when i % 2 = 0 then 1 else 2 end then p_name end) as proof, i % 2 <> 0 as is_link
    from {_IDS} where k = 0 or k = case when i % 2 = 0 then 1 else 2 end group by i""")
def block_maps(s, d):
    p = table(s, d, "part").select(F.expr("p_partkey div 3").alias("i"), (F.col("p_partkey") % 3).alias("k"), "p_name")
    kind = F.element_at(F.array(*[F.lit(x) for x in codecs.KINDS]), (F.col("k") + 1).cast("int"))
    h = F.sha2(F.col("i").cast("string"), 256)
    e = p.select((F.col("i") % 10).alias("g"), F.struct("i", "k").alias("o"), codecs.file_name(kind, F.col("i") % 2 - 1, F.shiftleft("i", 40), F.col("i"), h, h).alias("name"), "p_name")
    m = archive.block_maps(archive.parse_archives(archive.build_archives(e, "g", "o", "name", "p_name"), "g", "content"), "g")
    return m.select("g", "workchain", "shard", "seq", F.col("block").cast("string").alias("block"), F.col("proof").cast("string").alias("proof"), "is_link")


@query("select conv_id as archive_id, '01dd8fae' || lower(hex(encode(string_agg(text, '' order by turn, text)))) as data from conversations group by conv_id")
def archive_merge(s, d):
    head = F.unhex(F.lit(struct.pack("<I", archive.ARCHIVE_MAGIC).hex()))
    c = table(s, d, "conversations").select(F.col("conv_id").alias("archive_id"), F.struct("turn", "text").alias("segment_no"), F.concat(head, F.col("text").cast("binary")).alias("data"))
    return archive.merge_segments(c).withColumn("data", F.lower(F.hex("data")))


@query(f"""with o as (select shard, seq_no as step, seq_no % 40 as mc, case when seq_no % 3 = 0 then -1 else 1 end as delta from {B}), n as (select *, sum(delta) over (partition by shard, mc order by step) as n, lead(step) over (partition by shard, mc order by step) as u from o)
    select o.shard, o.step, min(n.mc) as least from o left join n on n.n > 0 and n.shard = o.shard and o.step >= n.step and (n.u is null or o.step < n.u) group by o.shard, o.step""")
def min_after_each(s, d):
    o = blocks(s, d).select("shard", F.col("seq_no").alias("step"), (F.col("seq_no") % 40).alias("mc_seq_no"), F.when(F.col("seq_no") % 3 == 0, -1).otherwise(1).alias("delta"))
    return keeper.min_after_each(o, ["shard"])


@query(f"with k as (select seq_no, gen_utime, lag(gen_utime) over (order by seq_no) as p from {B} where is_key) select seq_no, max(case when gen_utime >> 17 <> p >> 17 then seq_no end) over (order by seq_no) as init_seq from k")
def init_blocks(s, d):
    return keeper.init_blocks(blocks(s, d).filter("is_key").select("seq_no", "gen_utime")).select("seq_no", "init_seq")


@query(f"""with a as (select seq_no - seq_no % 100 as archive_id, min(seq_no) as first, max(seq_no) as last from {B} where seq_no % 5000 not between 4950 and 4999 group by all), r as (select *, max(last) over (order by archive_id rows between unbounded preceding and 1 preceding) as e from a where last >= 1234)
    select archive_id, first, last, archive_id < (select coalesce(min(archive_id), 1000000) from r where first > greatest(coalesce(e, 1233), 1233) + 1) as taken from r""")
def archives_in_order(s, d):
    a = blocks(s, d).filter("seq_no % 5000 not between 4950 and 4999").groupBy((F.col("seq_no") - F.col("seq_no") % 100).alias("archive_id")).agg(F.min("seq_no").alias("first"), F.max("seq_no").alias("last"))
    return keeper.archives_in_order(a, 1234)


@query("select s_suppkey as i, upper(sha256(s_name)) as key, (s_suppkey % 256) || '.2.3.4' as ip, (30000 + s_suppkey)::integer as port, -s_suppkey as version from supplier")
def config_nodes(s, d):
    """Each supplier as a network with one node, written as JSON and read again."""
    t = table(s, d, "supplier")
    b64 = lambda c: F.base64(F.unhex(c))
    signed = F.col("s_suppkey") % 256
    ip = F.when(signed > 127, signed - 256).otherwise(signed) * (1 << 24) + 0x020304
    typed = lambda name, *cols: F.struct(F.lit(name).alias("@type"), *cols)
    node = typed("dht.node", typed("pub.ed25519", b64(F.sha2("s_name", 256)).alias("key")).alias("id"), typed("adnl.addressList", F.array(typed("adnl.address.udp", ip.alias("ip"), (30000 + F.col("s_suppkey")).alias("port"))).alias("addrs")).alias("addr_list"), (-F.col("s_suppkey")).alias("version"), b64(F.sha2("s_name", 512)).alias("signature"))
    whole = typed("config.global", typed("dht.config.global", typed("dht.nodes", F.array(node).alias("nodes")).alias("static_nodes")).alias("dht"), typed("validator.config.global").alias("validator"))
    rows = config.nodes(config.parsed(t.select(F.to_json(whole).alias("text"))))
    return rows.select((F.col("port") - 30000).cast("long").alias("i"), F.hex("key").alias("key"), "ip", "port", "version")


@query("""with v as (select o_custkey % 50 as set_hash, o_custkey as key, min(o_orderkey % 9 + 1) as weight from orders group by all), q as (select n as id, case when n % 11 = 0 then -1 else n % 50 end as set_hash from range(200) r(n)),
    g as (select q.id, v.weight, (v.key * 7 + q.id) % 10 < 8 as signs, (v.key + q.id) % 397 <> 0 as valid, v.set_hash from q join v using (set_hash)),
    z as (select id, sum(weight) as total, coalesce(sum(weight) filter (where signs and valid), 0) as w, coalesce(bool_and(valid) filter (where signs), true) as ok from g group by id)
    select q.id, case when z.id is null then 'unknown_set' when not ok then 'bad_signature' when w * 3 <= total * 2 then 'weight' end as fault from q left join z using (id)""")
def broadcast_faults(s, d):
    v = table(s, d, "orders").groupBy((F.col("o_custkey") % 50).alias("set_hash"), F.col("o_custkey").alias("key")).agg(F.min(F.col("o_orderkey") % 9 + 1).alias("weight"))
    q = s.range(200).select("id", F.when(F.col("id") % 11 == 0, -1).otherwise(F.col("id") % 50).alias("set_hash"))
    signed = q.join(v, "set_hash").filter((F.col("key") * 7 + F.col("id")) % 10 < 8).select("id", "key", ((F.col("key") + F.col("id")) % 397 != 0).alias("valid"))
    return proofs.broadcast_faults(q, v, signed)

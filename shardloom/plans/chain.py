"""Registered queries on shards, edges, identities and proofs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from ..operators import proofs, shards
from .lenses import table
from .registry import query

_SHARDS = ["", "0", "1", "10", "11", "100", "101"]
_LIST = "[" + ", ".join(f"'{x}'" for x in _SHARDS) + "]"


def archive_blocks(s: SparkSession, d: str) -> DataFrame:
    """events as blocks of 25 archives: k, workchain, shard, seq_no."""
    mc = F.col("event_type") == "signup"
    shard = F.element_at(F.array(*[F.lit(x) for x in _SHARDS]), (F.col("event_id") % 7 + 1).cast("int"))
    return table(s, d, "events").select((F.col("user_id") % 25).alias("k"), F.when(mc, -1).otherwise(0).alias("workchain"), F.when(mc, "").otherwise(shard).alias("shard"), F.expr("event_id div 7 % 23").alias("seq_no"))


_B = f"(select user_id % 25 as k, case when event_type = 'signup' then -1 else 0 end as workchain, case when event_type = 'signup' then '' else {_LIST}[event_id % 7 + 1] end as shard, event_id // 7 % 23 as seq_no from events)"


def edges(s: SparkSession) -> tuple[DataFrame, DataFrame]:
    """An edge for each archive: tops (k, workchain, shard, top) and masters (k, mc_seq_no)."""
    k = s.range(25).withColumnRenamed("id", "k")
    which = F.when(F.col("k") % 3 == 0, F.array(F.lit("0"), F.lit("1"))).when(F.col("k") % 3 == 1, F.array(F.lit(""))).otherwise(F.array(F.lit("0"), F.lit("10"), F.lit("11")))
    return k.select("k", F.lit(0).alias("workchain"), F.explode(which).alias("shard"), (F.col("k") % 4 + 5).alias("top")), k.select("k", (F.col("k") % 5 + 15).alias("mc_seq_no"))


_T = "(select k, 0 as workchain, unnest(case k % 3 when 0 then ['0', '1'] when 1 then [''] else ['0', '10', '11'] end) as shard, k % 4 + 5 as top from range(25) r(k))"


@query(f"""with b as {_B}, t as {_T},
    sh as (select k, shard, max(seq_no) as last from b where workchain <> -1 group by k, shard),
    r as (select sh.*, (select max(top) from t where t.k = sh.k and t.shard = sh.shard) as own,
        (select max(top) from t where t.k = sh.k and length(t.shard) + 1 = length(sh.shard) and starts_with(sh.shard, t.shard)) as par,
        (select max(top) from t where t.k = sh.k and t.shard = sh.shard || '0') as le, (select max(top) from t where t.k = sh.k and t.shard = sh.shard || '1') as ri,
        (select max(top) from t where t.k = sh.k and length(t.shard) + 1 < length(sh.shard) and starts_with(sh.shard, t.shard)) as far from sh),
    u as (select k, shard, last, case when own is not null then 'next' when par is not null then 'split' when le is not null and ri is not null then 'merge' when far is not null then 'ancestor' end as rule,
        case when own is not null then own + 1 when par is not null then par + 1 when le is not null and ri is not null then greatest(le, ri) + 1 else far end as target from r),
    f as (select u.*, exists (select 1 from b where b.k = u.k and b.workchain <> -1 and b.shard = u.shard and b.seq_no = u.target) and rule <> 'ancestor' as found, last >= target as past from u where rule is not null),
    e as (select t.k, t.shard as edge, f.rule, f.shard, f.found, f.past and not f.found as lacks from t join f on f.k = t.k and case f.rule when 'next' then t.shard = f.shard when 'split' then f.shard in (t.shard || '0', t.shard || '1')
        when 'merge' then t.shard in (f.shard || '0', f.shard || '1') else starts_with(f.shard, t.shard) and length(t.shard) + 1 < length(f.shard) end),
    p as (select k, edge, max((rule = 'next' and found)::int) as nx, max((rule = 'merge' and found)::int) as mg, max((rule = 'split' and found)::int) as sp, bool_or(rule <> 'merge' and lacks) as lk,
        coalesce(bool_or(rule = 'split' and found and shard[-1] = '0'), false) as fl, coalesce(bool_or(rule = 'split' and lacks and shard[-1] = '0'), false) as ll,
        coalesce(bool_or(rule = 'split' and found and shard[-1] = '1'), false) as fr, coalesce(bool_or(rule = 'split' and lacks and shard[-1] = '1'), false) as lr from e group by k, edge),
    v as (select k, bool_or(nx + mg + sp > 1) as twice, bool_or(case when sp = 1 then (ll and not fl) or (lr and not fr) else nx + mg = 0 and lk end) as missing from p group by k),
    m as (select r.k, count(*) filter (where b.seq_no = r.k % 5 + 16) as mc from range(25) r(k) left join b on b.k = r.k and b.workchain = -1 group by r.k),
    z as (select m.k, case when mc > 1 then 'DuplicateMasterchainBlock' when twice then 'AmbiguousEdgeBlock' when mc = 0 then 'NextMasterchainBlockNotFound' when missing then 'NextBlockNotFound' end as error from m left join v on v.k = m.k)
    select k, error is null as ok, error from z""")
def edge_verification(s, d):
    tops, masters = edges(s)
    return shards.verify_edge(archive_blocks(s, d), tops.drop("workchain"), masters, ["k"])


@query(f"""with b as {_B}, t as {_T},
    j as (select distinct b.k, b.workchain, b.shard, b.seq_no, coalesce((select max(top) from t where t.k = b.k and t.workchain = b.workchain and t.shard = b.shard),
        (select min(top) from t where t.k = b.k and t.workchain = b.workchain and (starts_with(t.shard, b.shard) or starts_with(b.shard, t.shard)))) as top from b)
    select k, workchain, shard, seq_no, coalesce(top, 0) as top_seq, coalesce(seq_no >= top, false) as contains, coalesce(top < seq_no, false) as is_after from j""")
def top_containment(s, d):
    return shards.contained(archive_blocks(s, d).distinct(), edges(s)[0], key=["k"])


@query("""with b as (select o_orderkey as seq_no, ['', '0', '1', '10', '11', '100', '101'][o_custkey % 7 + 1] as shard, o_orderstatus = 'F' as after_split, o_orderstatus = 'P' as after_merge from orders),
    p as (select shard, seq_no, 1 as i, case when after_merge then shard || '0' when after_split then left(shard, greatest(length(shard) - 1, 0)) else shard end as ps, seq_no - 1 as pq from b
        union all select shard, seq_no, 2, shard || '1', seq_no - 2 from b where after_merge)
    select 0 as workchain, 'prev' || i as direction, shard, seq_no, ps as to_shard, pq as to_seq_no from p
    union select 0, case when shard = ps || '1' then 'next2' else 'next1' end, ps, pq, shard, seq_no from p""")
def block_connections(s, d):
    o = table(s, d, "orders")
    shard = F.element_at(F.array(*[F.lit(x) for x in _SHARDS]), (F.col("o_custkey") % 7 + 1).cast("int"))
    b = o.select(F.lit(0).alias("workchain"), shard.alias("shard"), F.col("o_orderkey").alias("seq_no"), (F.col("o_orderstatus") == "F").alias("after_split"), (F.col("o_orderstatus") == "P").alias("after_merge"))
    return shards.connections(b.withColumns({"prev1_seq": F.col("seq_no") - 1, "prev2_seq": F.col("seq_no") - 2}))


_W = f"(select distinct case when event_type = 'signup' then -1 else 0 end as workchain, case when event_type = 'signup' then '' else {_LIST}[event_id % 7 + 1] end as shard, event_id // 3 as seq_no from events)"


@query(f"""with b as {_W}, l as (select *, lag(seq_no) over (partition by workchain, shard order by seq_no) as p from b),
    o as (select * from l where p is not null and p + 1 <> seq_no)
    select workchain, shard, seq_no, case when workchain = -1 then 'MasterchainHole' else 'ShardHole' end as fault from o
    where workchain = -1 or not exists (select 1 from b where b.workchain = o.workchain and b.seq_no = o.seq_no - 1
        and (b.shard in (o.shard, o.shard || '0', o.shard || '1') or length(o.shard) > 0 and b.shard = left(o.shard, length(o.shard) - 1)))""")
def map_faults(s, d):
    b = table(s, d, "events").withColumn("wide", F.expr("event_id div 3"))
    mc = F.col("event_type") == "signup"
    shard = F.element_at(F.array(*[F.lit(x) for x in _SHARDS]), (F.col("event_id") % 7 + 1).cast("int"))
    return shards.map_faults(b.select(F.when(mc, -1).otherwise(0).alias("workchain"), F.when(mc, "").otherwise(shard).alias("shard"), F.col("wide").alias("seq_no")))


@query("""with n as (select n_nationkey as k, right(lpad(bin(n_nationkey), 5, '0'), 5)[1:n_nationkey % 6] as p from nation)
    select k, p, left(p, greatest(length(p) - 1, 0)) as parent, p || '0' as left_child, p || '1' as right_child, p[-1] = '1' and p <> '' as is_right, lower(hex(rpad(p || '1', 8, '0')::bit::blob)) || '00000000000000' as shard_hex, p as back from n""")
def shard_algebra(s, d):
    k = F.col("n_nationkey")
    n = table(s, d, "nation").select(k.alias("k"), F.left(codecs.prefix(k.cast("long"), 5), k % 6).alias("p"))
    kids, p = codecs.children(F.col("p")), F.col("p")
    n = n.select("k", "p", codecs.parent(p).alias("parent"), kids[0].alias("left_child"), kids[1].alias("right_child"), codecs.is_right_child(p).alias("is_right"), codecs.shard_id(p).alias("_id"))
    return n.select("k", "p", "parent", "left_child", "right_child", "is_right", F.lower(F.lpad(F.hex("_id"), 16, "0")).alias("shard_hex"), codecs.shard_prefix(F.col("_id")).alias("back"))


_PART = "lower(lpad(hex(p_partkey << 40), 16, '0'))"


@query(f"""select p_partkey, lpad(hex(((p_partkey % 2 - 1) & 4294967295)::bigint), 8, '0') || upper({_PART}) || lpad(hex(p_size), 8, '0') || upper(sha256(p_name)) || lpad(hex(p_partkey % 3), 2, '0') as key,
    (p_partkey % 2 - 1)::integer as workchain, p_partkey << 40 as shard, p_size::bigint as seq, upper(sha256(p_name)) as root, upper(sha256(p_brand)) as file, (p_partkey % 2 - 1) || ':' || {_PART} || ':' || p_size as shown from part""")
def id_codec(s, d):
    wc, shard, seq = F.col("p_partkey") % 2 - 1, F.shiftleft("p_partkey", 40), F.col("p_size")
    root, file = F.unhex(F.sha2("p_name", 256)), F.unhex(F.sha2("p_brand", 256))
    p = table(s, d, "part").select("p_partkey", F.hex(codecs.entry_key(wc, shard, seq, root, F.col("p_partkey") % 3)).alias("key"), codecs.id_from_bytes(codecs.id_to_bytes(wc, shard, seq, root, file)).alias("x"), codecs.short_name(wc, shard, seq).alias("shown"))
    return p.select("p_partkey", "key", "x.workchain", "x.shard", "x.seq", F.hex("x.root").alias("root"), F.hex("x.file").alias("file"), "shown")


@query("""select c_custkey, lpad(c_custkey::varchar, 9, '0') as upload_key, md5(c_name) as digest, c_custkey - c_custkey % 60 + 7 as aligned, greatest(c_custkey - 100, 0) as less,
    case when c_custkey = 0 then 0 else ceil(length(bin(c_custkey)) / 8)::integer end as bytes_to_fit, bit_count(c_custkey)::integer as ones from customer""")
def scalar_codecs(s, d):
    k = F.col("c_custkey")
    digest = F.lower(F.hex(F.unbase64(codecs.upload_digest(F.col("c_name").cast("binary")))))
    return table(s, d, "customer").select("c_custkey", codecs.upload_key(k).alias("upload_key"), digest.alias("digest"), codecs.aligned(k, 60, 7).alias("aligned"), codecs.less(k, F.lit(100)).alias("less"), codecs.bytes_to_fit(k).alias("bytes_to_fit"), F.bit_count(k).cast("int").alias("ones"))


_H = """(select event_id as seq_no, case when event_type = 'signup' then -1 else 0 end as workchain, ['', '0', '1'][event_id % 3 + 1] as shard, event_type = 'error' as after_merge, event_type = 'view' as after_split, user_id % 7 = 0 as is_key,
    event_id - user_id % 40 as prev_key_seq, event_id + user_id % 2 as id_seq_no from events)"""


@query(f"""select seq_no, list_filter([case when seq_no <> id_seq_no then 'seq_no' end, case when after_split and after_merge then 'split_and_merge' end, case when after_split and shard = '' then 'split_of_full' end,
    case when workchain = -1 and (after_split or after_merge) then 'masterchain_split' end, case when is_key and workchain <> -1 then 'key_outside_masterchain' end,
    case when prev_key_seq >= seq_no and seq_no > 0 then 'prev_key' end], lambda x: x is not null) as faults from {_H}""")
def header_faults(s, d):
    e, mc = table(s, d, "events"), F.col("event_type") == "signup"
    shard = F.element_at(F.array(F.lit(""), F.lit("0"), F.lit("1")), (F.col("event_id") % 3 + 1).cast("int"))
    h = e.select(F.col("event_id").alias("seq_no"), F.when(mc, -1).otherwise(0).alias("workchain"), shard.alias("shard"), (F.col("event_type") == "error").alias("after_merge"), (F.col("event_type") == "view").alias("after_split"), (F.col("user_id") % 7 == 0).alias("is_key"),
        (F.col("event_id") - F.col("user_id") % 40).alias("prev_key_seq"), (F.col("event_id") + F.col("user_id") % 2).alias("id_seq_no"))
    return proofs.header_faults(h).select("seq_no", "faults")


@query("""select a.o_orderkey as seq_no, b.o_orderkey as prev_key, case when a.o_custkey is null then 'undeclared' when b.o_orderkey is null then 'missing' when b.o_orderstatus <> 'F' then 'not_key' when b.o_orderkey >= a.o_orderkey then 'order' end as fault
    from orders a left join orders b on b.o_orderkey = a.o_custkey""")
def prev_key_faults(s, d):
    o = table(s, d, "orders")
    p = o.select(F.col("o_orderkey").alias("seq_no"), F.col("o_custkey").alias("prev_key_seq"), (F.col("o_orderstatus") == "F").alias("is_key"))
    return proofs.prev_key_faults(p, p).select("seq_no", "prev_key", "fault")


@query("""select d.doc_id, case when l.quality = 1 then 'full' when l.toxic = 0 then 'link' else 'empty' end as variant from documents d left join labels l on l.doc_id = d.doc_id""")
def proof_variant(s, d):
    j = table(s, d, "documents").select("doc_id").join(table(s, d, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    return j.select("doc_id", proofs.proof_variant(F.col("quality") == 1, F.col("toxic") == 0, F.lit(True)).alias("variant"))

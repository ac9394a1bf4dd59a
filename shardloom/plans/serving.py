"""Registered queries of the read API, of stores and of retention, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from ..operators import ordered, serve, shards, store
from .chain import _SHARDS
from .lenses import seconds, table
from .registry import query

_FLAGS = "(case when has_data then 1::bigint << 32 else 0 end | case when has_proof then 1::bigint << 33 else 0 end | case when has_link then 1::bigint << 34 else 0 end | case when is_key then 1::bigint << 43 else 0 end | (id - id % 10))"
_H0 = """(select event_id as id, event_id as seq_no, epoch_us(ts) // 1000000 as gen_utime, case when event_type = 'signup' then -1 else 0 end as workchain,
    case when event_type = 'signup' then '' else ['', '0', '1', '10', '11', '100', '101'][event_id % 7 + 1] end as shard, event_type <> 'error' as has_data,
    event_type = 'signup' and user_id % 3 <> 0 as has_proof, event_type <> 'signup' and user_id % 3 <> 0 as has_link, event_type = 'signup' and user_id % 7 = 0 as is_key, props from events)"""
_H = f"(select *, {_FLAGS} as flags from {_H0})"
_NAME = {0: "props", 1: "'proof' || id", 2: "'link' || id"}


def handles(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    mc, proven = F.col("event_type") == "signup", F.col("user_id") % 3 != 0
    shard = F.element_at(F.array(*[F.lit(x) for x in _SHARDS]), (F.col("event_id") % 7 + 1).cast("int"))
    flags = codecs.pack_flags(F.col("event_id") - F.col("event_id") % 10, {"has_data": F.col("event_type") != "error", "has_proof": mc & proven, "has_proof_link": ~mc & proven, "is_key_block": mc & (F.col("user_id") % 7 == 0)})
    return e.select(F.col("event_id").alias("id"), F.when(mc, -1).otherwise(0).alias("workchain"), F.when(mc, "").otherwise(shard).alias("shard"), F.col("event_id").alias("seq_no"), seconds(F.col("ts")).alias("gen_utime"), flags.alias("flags"))


def entries(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("id", F.col("event_id"))
    mc, proven = F.col("event_type") == "signup", F.col("user_id") % 3 != 0
    of = lambda rows, kind, data: rows.select("id", F.lit(kind).alias("kind"), data.cast("binary").alias("data"))
    out = of(e.filter(F.col("event_type") != "error"), 0, F.col("props"))
    return out.unionByName(of(e.filter(mc & proven), 1, F.concat(F.lit("proof"), "id"))).unionByName(of(e.filter(~mc & proven), 2, F.concat(F.lit("link"), "id")))


def edges(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").filter("event_id % 10 <> 9")
    return e.select(F.col("event_id").alias("id"), F.lit("next1").alias("direction"), (F.col("event_id") + 1).alias("to_id"))


def ids(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(F.col("event_id").alias("id"))


def key_blocks(s: SparkSession, d: str) -> DataFrame:
    return handles(s, d).filter(codecs.flag(F.col("flags"), "is_key_block")).select("seq_no", "id", "gen_utime")


_N = "(select event_id as id, case when event_id % 10 <> 9 then event_id + 1 end as to_id from events)"
_VARIANT = "case when has_proof then 'full' when has_link then 'link' else 'empty' end"
_FULL = f"""(select id, has_data and (has_proof or has_link) as found, workchain <> -1 as is_link, case when has_proof then 'proof' || id else 'link' || id end as proof, props from {_H})"""


def _text(rows: DataFrame, *cols: str) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("string") for c in cols})


@query(f"select id, to_id from {_N}")
def next_block_description(s, d):
    return serve.next_block_description(ids(s, d), edges(s, d))


@query(f"select id, {_VARIANT} as answer from {_H}")
def prepare_block_proof(s, d):
    return serve.prepare_block_proof(ids(s, d), handles(s, d))


@query(f"select id, case when not is_key and seq_no <> 0 then 'error' else {_VARIANT} end as answer from {_H}")
def prepare_key_block_proof(s, d):
    return serve.prepare_key_block_proof(ids(s, d), handles(s, d))


@query(f"select id, has_data as found from {_H}")
def prepare_block(s, d):
    return serve.prepare_block(ids(s, d), handles(s, d))


def _asked(s, d):
    return table(s, d, "documents").select((F.col("doc_id") % 50).alias("mc_seq_no"), F.col("doc_id").alias("id"), (F.col("doc_id") * 7 % 300).alias("offset"), F.lit(40).alias("max_size"), F.col("text").cast("binary").alias("data"))


@query("select d.doc_id % 50 as mc_seq_no, d.doc_id as id, exists (select 1 from labels l where l.doc_id = d.doc_id) as found from documents d")
def prepare_persistent_state(s, d):
    known = table(s, d, "labels").select((F.col("doc_id") % 50).alias("mc_seq_no"), F.col("doc_id").alias("id"))
    return serve.prepare_persistent_state(_asked(s, d).select("mc_seq_no", "id"), known)


@query("select doc_id % 50 as mc_seq_no, doc_id as id, doc_id * 7 % 300 as \"offset\", hex(coalesce(encode(text)[doc_id * 7 % 300 + 1:doc_id * 7 % 300 + 40], ''::blob)) as part from documents")
def persistent_state_part(s, d):
    rows = serve.persistent_state_part(_asked(s, d).drop("data"), _asked(s, d))
    return rows.withColumn("part", F.hex("part"))


@query("select event_id as id, false as found from events")
def prepare_zero_state(s, d):
    return serve.prepare_zero_state(ids(s, d))


@query(f"""with k as (select id, row_number() over (order by id) as r from {_H} where is_key),
    q as (select h.id as request, workchain, h.id as seq_no, h.id + (h.id % 13 = 0)::bigint as start, h.id % 12 as max_size, k.r, k.id as kid from {_H} h left join k on k.id = h.id),
    e as (select *, workchain <> -1 or kid is null or kid <> start as error from q),
    a as (select request, list(k.id order by k.id) as ids from e join k on not e.error and k.r >= e.r and k.r < e.r + least(max_size, 8) group by request)
    select e.request, array_to_string(coalesce(a.ids, []), ',') as ids, not error and len(coalesce(a.ids, [])) < max_size as incomplete, error from e left join a using (request)""")
def next_key_block_ids(s, d):
    q = handles(s, d).select(F.col("id").alias("request"), "workchain", "seq_no", (F.col("id") + F.when(F.col("id") % 13 == 0, 1).otherwise(0)).alias("id"), (F.col("id") % 12).cast("int").alias("max_size"))
    return serve.next_key_blocks(q, key_blocks(s, d)).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query(f"select id, found, case when found then is_link end as is_link, case when found then proof end as proof, case when found then props end as data from {_FULL}")
def block_full(s, d):
    return _text(serve.block_full(ids(s, d), handles(s, d), entries(s, d)), "proof", "data")


@query(f"select n.id, case when f.found then n.to_id end as next_id, coalesce(f.found, false) as found, case when f.found then is_link end as is_link, case when f.found then proof end as proof, case when f.found then props end as data from {_N} n left join {_FULL} f on f.id = n.to_id")
def next_block_full(s, d):
    return _text(serve.next_block_full(ids(s, d), edges(s, d), handles(s, d), entries(s, d)), "proof", "data")


@query(f"select id, case when has_data then props end as data, not has_data as error from {_H}")
def block_data(s, d):
    return _text(serve.block(ids(s, d), handles(s, d), entries(s, d)), "data")


def _proof_query(key_only: bool, link: bool):
    ok = ("has_link" if link else "has_proof") + (" and (is_key or seq_no = 0)" if key_only else "")

    def run(s, d):
        return _text(serve.block_proof(ids(s, d), handles(s, d), entries(s, d), key_only, link), "data")

    run.__name__ = f"{'key_' if key_only else ''}block_proof{'_link' if link else ''}"
    return query(f"select id, case when {ok} then {_NAME[2 if link else 1]} end as data, not ({ok}) as error from {_H}")(run)


for _key in (False, True):
    for _link in (False, True):
        _proof_query(_key, _link)


@query("select e.event_id as seq_no, case when e.event_id < a.id + 100 and e.event_id <= 8500 then a.id end as archive_id from events e asof left join (select event_id as id from events where event_id % 137 = 0) a on e.event_id >= a.id")
def archive_info(s, d):
    e = table(s, d, "events")
    return serve.archive_info(e.select(F.col("event_id").alias("seq_no")), e.filter("event_id % 137 = 0").select(F.col("event_id").alias("archive_id")), 9000, 8500)


@query("""with a as (select conv_id, encode(string_agg(text, '' order by turn, text)) as data from conversations group by conv_id)
    select conv_id as archive_id, conv_id * 7 % 900 as \"offset\", case when conv_id * 7 % 900 < octet_length(data) then hex(data[conv_id * 7 % 900 + 1:conv_id * 7 % 900 + 50]) end as data, conv_id * 7 % 900 >= octet_length(data) as error from a""")
def archive_slice(s, d):
    c = table(s, d, "conversations")
    a = c.groupBy(F.col("conv_id").alias("archive_id")).agg(F.expr("listagg(cast(text as binary)) within group (order by turn, text)").alias("data"))
    q = a.select("archive_id", (F.col("archive_id") * 7 % 900).alias("offset"), F.lit(50).alias("max_size"))
    return serve.archive_slice(q, a).withColumn("data", F.hex("data"))


@query("select event_id as id, 2 as version, 1 as capabilities from events")
def capabilities(s, d):
    return serve.capabilities(ids(s, d))


@query(f"""select q.id, q.kind::integer as kind, case when h.id is null then 'unknown' when case q.kind when 0 then has_data when 1 then has_proof else has_link end then 'known' else 'new' end as status
    from (select event_id + event_id % 2 * 5000 as id, event_id % 3 as kind from events) q left join {_H} h on h.id = q.id""")
def store_payloads(s, d):
    q = table(s, d, "events").select((F.col("event_id") + F.col("event_id") % 2 * 5000).alias("id"), (F.col("event_id") % 3).cast("int").alias("kind"), F.lit(b"x").alias("data"))
    return store.store_payloads(handles(s, d), entries(s, d), q)[2]


_TOPS = "(select -1 as workchain, '' as shard, max(event_id) // 2 as top from events union all select 0, '0', max(event_id) // 3 from events union all select 0, '1', max(event_id) * 2 // 3 from events)"
_BELOW = f"""(select h.*, coalesce((select max(top) from {_TOPS} t where t.workchain = h.workchain and t.shard = h.shard), (select min(top) from {_TOPS} t where t.workchain = h.workchain and (starts_with(t.shard, h.shard) or starts_with(h.shard, t.shard)))) as top from {_H} h)"""
_GONE = f"(select * from {_BELOW} where not coalesce(seq_no >= top, false) and seq_no <> 0 and not (workchain = -1 and is_key))"


def tops(s: SparkSession, d: str) -> DataFrame:
    top = table(s, d, "events").agg(F.max("event_id").alias("m"))
    rows = F.array(*[F.struct(F.lit(w).alias("workchain"), F.lit(p).alias("shard"), F.expr(e).alias("top")) for w, p, e in ((-1, "", "m div 2"), (0, "0", "m div 3"), (0, "1", "m * 2 div 3"))])
    return top.select(F.explode(rows).alias("x")).select("x.*")


@query(f"select count(*) filter (where workchain = -1) as mc_handles, count(*) as handles, (select count(*) from {_GONE} where has_data) + (select count(*) from {_GONE} where has_proof or has_link) as entries from {_GONE}")
def remove_blocks(s, d):
    return store.remove_blocks(handles(s, d), entries(s, d), tops(s, d)).stats


@query(f"select id, case when id in (select id from {_GONE}) then flags & ~(7::bigint << 32) else flags end as flags from {_H}")
def clear_handles(s, d):
    return store.clear_handles(handles(s, d), tops(s, d)).select("id", "flags")


@query(f"select id from {_BELOW} where seq_no <> 0 and seq_no < coalesce(top, 0)")
def states_to_remove(s, d):
    return store.states_to_remove(handles(s, d), tops(s, d)).select("id")


@query("select event_id as archive_id from events where event_id % 100 = 0 and event_id >= (select max(event_id) from events where event_id % 100 = 0 and event_id < 4321)")
def remove_archives(s, d):
    a = table(s, d, "events").filter("event_id % 100 = 0").select(F.col("event_id").alias("archive_id"))
    return store.remove_archives(a, 4321)[0]


@query("select event_id as archive_id, lpad(event_id::varchar, 9, '0') as name from events where event_id % 100 = 0 and event_id > 300 and event_id < 20000 and event_id < (select max(event_id) from events where event_id % 100 = 0)")
def archives_to_upload(s, d):
    a = table(s, d, "events").filter("event_id % 100 = 0").select(F.col("event_id").alias("archive_id"))
    return store.archives_to_upload(a, 300, 20000)


_P = f"(select seq_no, gen_utime, lag(gen_utime) over (order by seq_no) as p from {_H} where is_key)"


@query(f"with p as (select * from {_P} where p is null or gen_utime >> 17 <> p >> 17) select seq_no, gen_utime from p where gen_utime + 300 <= 1705500000 order by seq_no desc limit 1")
def choose_key_block(s, d):
    return serve.choose_key_block(key_blocks(s, d), 1705500000)


@query(f"with p as (select seq_no, gen_utime from {_P} where gen_utime >> 17 <> p >> 17) (select * from p where gen_utime + 172800 > 1705500000) union all (select * from p where gen_utime + 172800 <= 1705500000 order by seq_no desc limit 1)")
def snapshots_to_keep(s, d):
    return store.snapshots_to_keep(key_blocks(s, d), F.lit(1705500000))


@query(f"select h.id, h.workchain, case when workchain = -1 then has_proof else has_link end as proven, case when workchain = -1 then seq_no else id - id % 10 end as master, is_key or seq_no = 0 as is_key from {_H} h")
def handle_view(s, d):
    h, f = handles(s, d), F.col("flags")
    return h.select("id", "workchain", codecs.proof_or_link(F.col("workchain"), codecs.flag(f, "has_proof"), codecs.flag(f, "has_proof_link")).alias("proven"), codecs.master_ref(F.col("workchain"), F.col("seq_no"), codecs.ref_seq(f)).alias("master"), codecs.is_key(f, F.col("seq_no")).alias("is_key"))


@query(f"select k.seq_no, h.gen_utime from {_H} h join (select seq_no, id from {_H} where is_key) k on k.id = h.id")
def key_handles(s, d):
    return serve.key_handles(key_blocks(s, d), handles(s, d)).select("seq_no", "gen_utime")


@query("select event_id as seq_no, row_number() over (order by event_id) - 1 as place from events")
def ranked(s, d):
    return ordered.ranked(table(s, d, "events").select(F.col("event_id").alias("seq_no")), "seq_no", "place", 1000)


@query(f"select workchain, shard, string_agg(seq_no::varchar, ',' order by seq_no) as members, min(seq_no) as lowest, max(seq_no) as highest from {_H} group by workchain, shard")
def shard_members(s, d):
    """Numbers of each shard in order, with the lowest and the highest."""
    h = handles(s, d).withColumn("t", F.col("seq_no").cast("string"))
    return h.groupBy("workchain", "shard").agg(F.expr("listagg(t, ',') within group (order by seq_no)").alias("members"), F.min("seq_no").alias("lowest"), F.max("seq_no").alias("highest"))


@query("""select shard, case when rule is null then 'none' else rule end as rule, target from (select distinct s.shard, t.rule, t.target from (select unnest(['', '0', '1', '10', '11', '100', '101']) as shard) s left join
    (values ('0', 'next', 6), ('', 'merge', 9), ('1', 'next', 9)) t(shard, rule, target) on s.shard = t.shard where s.shard in ('', '0', '1') union all values ('10', 'split', 9), ('11', 'split', 9), ('100', 'ancestor', 8), ('101', 'ancestor', 8)) order by shard""")
def target_rules(s, d):
    tops = s.range(1).select(F.lit(0).alias("k"), F.explode(F.array(*[F.struct(F.lit(p).alias("shard"), F.lit(t).alias("top")) for p, t in (("0", 5), ("1", 8))])).alias("x")).select("k", "x.*")
    found = shards.targets(s.range(1).select(F.lit(0).alias("k"), F.explode(F.array(*[F.lit(x) for x in _SHARDS])).alias("shard")), tops, ["k"])
    return found.select("shard", F.coalesce("rule", F.lit("none")).alias("rule"), "target")

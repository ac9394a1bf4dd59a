import json

import pytest
from pyspark.sql import functions as F

from shardloom.operators import peers
from shardloom.sources import config
from shardloom.streaming import keeper


def test_min_references(spark):
    ops = [(1, 10, 1), (2, 10, -1), (3, 10, 1), (4, 15, 1), (5, 10, 1), (6, 10, -1), (7, 10, -1), (8, 15, -1)]
    df = spark.createDataFrame(ops, "step int, mc_seq_no long, delta int")
    assert [r["least"] for r in keeper.min_after_each(df).orderBy("step").collect()] == [10, None, 10, 10, 10, 10, 15, None]
    none = spark.createDataFrame([], "mc_seq_no long, n long")
    half = keeper.min_refs(none, df.filter("step <= 5"))
    assert sorted(map(tuple, half.collect())) == [(10, 2), (15, 1)] and keeper.min_refs(half, df.filter("step > 5")).isEmpty()
    with pytest.raises(Exception, match="more often"):
        keeper.min_refs(none, spark.createDataFrame([(1, 5, -1)], df.schema)).collect()


def test_keeper(spark):
    b = 1 << 17
    rows = [(1, 5, True), (2, b + 1, False), (3, 9, True), (4, b + 9, True), (5, b + 20, True), (6, 3 * b, True)]
    df = spark.createDataFrame(rows, "seq_no long, gen_utime long, is_key boolean")
    state, found = [keeper.Kept()], []
    sink = keeper.Keeper(lambda: state[0], lambda k: state.__setitem__(0, k), lambda k: found.append(k.persistent_seq))
    sink(df.filter("seq_no <= 3"), 0)
    assert state[0] == keeper.Kept(0, 3, 9) and found == []
    sink(df.filter("seq_no <= 5"), 1)
    sink(df.filter("seq_no <= 5"), 1)
    assert state[0] == keeper.Kept(1, 5, b + 20, 4, b + 9) and found == [4]
    sink(df, 2)
    sink(df.filter("seq_no < 3"), 3)
    assert state[0] == keeper.Kept(3, 6, 3 * b, 6, 3 * b) and found == [4, 6]
    assert [r["init_seq"] for r in keeper.init_blocks(df.filter("is_key").drop("is_key")).orderBy("seq_no").collect()] == [None, None, 4, 4, 6]


def test_archives_in_order(spark):
    rows = [(0, 0, 99), (100, 100, 199), (200, 200, 299), (400, 400, 410), (500, 411, 500), (100_000, 501, 600)]
    df = spark.createDataFrame(rows, "archive_id long, first long, last long")
    got = {r["archive_id"]: r["taken"] for r in keeper.archives_in_order(df, 150).collect()}
    assert got == {100: True, 200: True, 400: False, 500: False, 100_000: False}
    got = {r["archive_id"]: r["taken"] for r in keeper.archives_in_order(df, 405).collect()}
    assert got == {400: True, 500: True, 100_000: True}
    assert keeper.fits_request(100, 199) and not keeper.fits_request(100, 200) and not keeper.fits_request(200, 199) and keeper.prefetches(0, 1801) and not keeper.prefetches(0, 1800)


def test_archive_sink(spark):
    state, seen = [(-1, 5, spark.createDataFrame([(-1, "", 5), (0, "0", 5), (0, "1", 5)], "workchain int, shard string, top long"))], []
    sink = keeper.ArchiveSink(lambda: state[0], lambda *x: state.__setitem__(0, x), lambda df, i: seen.extend(map(tuple, df.select("workchain", "shard", "seq_no").collect())))
    blocks = lambda **s: spark.createDataFrame([(-1, "", n) for n in range(5, 8)] + [(0, shard[1:], n) for shard, ns in s.items() for n in ns], "workchain int, shard string, seq_no long")
    with pytest.raises(ValueError, match="NextBlockNotFound"):
        sink(blocks(s0=[7, 8], s1=[6]), 0)
    with pytest.raises(ValueError, match="holes"):
        sink(blocks(s0=[6, 9], s1=[6]), 0)
    assert seen == []
    sink(blocks(s0=[5, 6], s1=[6, 7]), 0)
    sink(blocks(s0=[5, 6], s1=[6, 7]), 0)
    assert sorted(seen) == [(-1, "", 6), (-1, "", 7), (0, "0", 6), (0, "1", 6), (0, "1", 7)] and state[0][:2] == (0, 7)
    assert sorted(map(tuple, state[0][2].collect())) == [(-1, "", 7), (0, "0", 6), (0, "1", 7)]


def test_peer_folds(spark):
    rows = [("a", 1, False, True, True), ("a", 2, False, True, False), ("a", 3, True, False, True), ("a", 4, False, False, False), ("a", 5, False, True, False), ("b", 1, True, True, True), ("b", 2, False, True, False)]
    df = spark.createDataFrame(rows, "peer string, ord int, success boolean, counted boolean, probe boolean")
    assert {r["peer"]: tuple(r)[1:] for r in peers.checks(df).collect()} == {"a": (3, 3, 200), "b": (2, 1, 0)}
    times = spark.createDataFrame([("a", i, True) for i in range(3)] + [("b", i, True) for i in range(20)] + [("c", 0, True), ("c", 1, False)], "peer string, ord int, failed boolean")
    assert {r["peer"]: r["timeout"] for r in peers.backoff(times).collect()} == {"a": 1687, "b": 5000, "c": 500}
    steps = spark.createDataFrame([("x", i, p) for i, p in enumerate([0, 1, 4, 5, 9, 10, 31])], "k string, o int, p int")
    assert [r["step"] for r in peers.progress_steps(steps, "k", "o", F.col("p")).orderBy("o").collect()] == [0, 5, 10, 30]
    row = spark.range(1).select(peers.hit_ratio(F.lit(3), F.lit(1)).alias("a"), peers.hit_ratio(F.lit(0), F.lit(0)).alias("b")).first()
    assert tuple(row) == (75.0, 0.0)


def test_peer_choices(spark):
    df = spark.createDataFrame([("a", 100, 1), ("b", None, 9), ("c", 5000, 7)], "peer string, last_ping long, unreliability int")
    assert [r["peer"] for r in peers.next_for_ping(df, 5500, 3).collect()] == ["b", "a", "c"]
    assert peers.to_replace(df).first()["peer"] == "b" and peers.to_replace(df.filter("peer = 'a'")).first()["peer"] == "a"
    picks = [peers.choose(df, seed).first()["peer"] for seed in range(40)]
    assert picks.count("a") > 30 and picks == [peers.choose(df.repartition(2), seed).first()["peer"] for seed in range(40)]
    assert peers.choose(df, 1, F.col("peer") == "c").first()["peer"] == "c"


def b64(x, n):
    import base64

    return base64.b64encode(bytes([x]) * n).decode()


def a_config():
    node = lambda k, ip: {"@type": "dht.node", "id": {"@type": "pub.ed25519", "key": b64(k, 32)}, "addr_list": {"@type": "adnl.addressList", "addrs": [{"@type": "adnl.address.udp", "ip": ip, "port": 30000 + k}, {"@type": "adnl.address.udp", "ip": 1, "port": 1}], "version": 0, "reinit_date": 0, "priority": 0, "expire_at": 0}, "version": -1, "signature": b64(k, 64)}
    block = lambda n: {"workchain": -1, "shard": -(1 << 63), "seqno": n, "root_hash": b64(n, 32), "file_hash": b64(n + 1, 32)}
    return {"@type": "config.global", "dht": {"@type": "dht.config.global", "k": 6, "a": 3, "static_nodes": {"@type": "dht.nodes", "nodes": [node(1, 1495755568), node(2, -1)]}}, "validator": {"@type": "validator.config.global", "zero_state": block(0), "hardforks": [block(7)]}}


def test_global_config(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(a_config(), indent=1))
    c = config.load(spark, str(tmp_path / "c.json"))
    assert [(bytes(r["key"])[0], r["ip"], r["port"], r["version"], len(r["signature"])) for r in config.nodes(c).orderBy("port").collect()] == [(1, "89.39.107.48", 30001, -1, 64), (2, "255.255.255.255", 30002, -1, 64)]
    assert [(r["role"], r["seq_no"], bytes(r["file_hash"])[:1]) for r in config.blocks(c).orderBy("role").collect()] == [("hardfork", 7, b"\x08"), ("zero_state", 0, b"\x01")]
    for change in (lambda c: c["dht"].update({"@type": "other"}), lambda c: c["dht"]["static_nodes"]["nodes"][0]["id"].update(key="AQID"), lambda c: c["dht"]["static_nodes"]["nodes"][1].pop("@type")):
        bad = a_config()
        change(bad)
        with pytest.raises(Exception, match="is other|no base64|is nothing"):
            config.nodes(config.parsed(spark.createDataFrame([(json.dumps(bad),)], "text string"))).collect()

import pytest
from pyspark.sql import functions as F

from shardloom.functions import codecs
from shardloom.operators import proofs, shards

#: Archives after an edge with masterchain block 5 and shards '0' and '1' at 5: shard -> numbers, and the expected error.
WHOLE = range(10)
SCENARIOS = [
    ({"0": WHOLE, "1": WHOLE}, None),
    ({"0": WHOLE, "10": range(6, 10), "1": range(5), "11": range(6, 10)}, None),
    ({"": range(6, 10)}, None),
    ({"0": WHOLE}, None),
    ({"0": WHOLE, "1": range(5)}, None),
    ({"0": WHOLE, "10": range(6, 10)}, None),
    ({"0": WHOLE, "11": range(6, 10)}, None),
    ({"0": WHOLE, "100": range(7, 10), "101": range(7, 10), "10": range(6, 7), "1": range(5), "11": range(6, 7)}, None),
    ({"0": range(7, 10), "1": WHOLE}, shards.NOT_FOUND),
    ({"0": WHOLE, "1": range(7, 10)}, shards.NOT_FOUND),
    ({"0": WHOLE, "1": [*range(5), *range(7, 10)]}, shards.NOT_FOUND),
    ({"0": WHOLE, "10": range(8, 10)}, shards.NOT_FOUND),
    ({"0": WHOLE, "100": range(8, 10)}, shards.NOT_FOUND),
    ({"0": WHOLE, "1": WHOLE, "10": range(6, 8)}, shards.AMBIGUOUS),
    ({"0": WHOLE, "10": range(6, 8), "11": range(8, 10)}, shards.NOT_FOUND),
    ({"": range(6, 10), "1": range(6, 8)}, shards.AMBIGUOUS),
]


def test_edges(spark):
    rows = [(i, 0, shard, n) for i, (parts, _) in enumerate(SCENARIOS) for shard, ns in parts.items() for n in ns]
    rows += [(i, -1, "", n) for i in range(len(SCENARIOS)) for n in range(10)] + [(100, -1, "", 5), (101, -1, "", 6), (101, -1, "", 6)]
    blocks = spark.createDataFrame(rows, "k long, workchain int, shard string, seq_no long")
    ks = [*range(len(SCENARIOS)), 100, 101]
    tops = spark.createDataFrame([(k, s, 5) for k in ks for s in ("0", "1")], "k long, shard string, top long")
    masters = spark.createDataFrame([(k, 5) for k in ks], "k long, mc_seq_no long")
    got = {r["k"]: (r["ok"], r["error"]) for r in shards.verify_edge(blocks, tops, masters, ["k"]).collect()}
    want = {i: (e is None, e) for i, (_, e) in enumerate(SCENARIOS)} | {100: (False, shards.MC_NOT_FOUND), 101: (False, shards.MC_TWICE)}
    assert got == want


def test_containment(spark):
    tops = spark.createDataFrame([(-1, "", 100), (0, "0", 1000), (0, "1", 1001)], "workchain int, shard string, top long")
    asked = [(0, "1", 100), (0, "", 100), (0, "", 10000), (0, "10", 100), (0, "10", 10000), (-1, "", 99), (-1, "", 100), (3, "", 5), (0, "", 1000)]
    df = spark.createDataFrame(asked, "workchain int, shard string, seq_no long")
    got = {(r["workchain"], r["shard"], r["seq_no"]): (r["contains"], r["top_seq"]) for r in shards.contained(df, tops).collect()}
    assert got == dict(zip(asked, [(False, 1001), (False, 1000), (True, 1000), (False, 1001), (True, 1001), (False, 100), (True, 100), (False, 0), (True, 1000)]))
    assert shards.to_process(df, None).count() == 9 and {r["seq_no"] for r in shards.to_process(df, tops).collect()} == {10000}


def test_predecessors_across_split_and_merge(spark):
    rows = [(0, "10", 7, True, False, 6, None), (0, "1", 7, False, True, 6, 5), (0, "11", 8, False, False, 7, None), (0, "11", 7, True, False, 6, None)]
    df = spark.createDataFrame(rows, "workchain int, shard string, seq_no long, after_split boolean, after_merge boolean, prev1_seq long, prev2_seq long")
    got = sorted(tuple(r)[1:] for r in shards.connections(df).collect())
    assert got == sorted([
        ("prev1", "10", 7, "1", 6), ("next1", "1", 6, "10", 7), ("prev1", "1", 7, "10", 6), ("prev2", "1", 7, "11", 5), ("next1", "10", 6, "1", 7), ("next1", "11", 5, "1", 7),
        ("prev1", "11", 8, "11", 7), ("next1", "11", 7, "11", 8), ("prev1", "11", 7, "1", 6), ("next2", "1", 6, "11", 7),
    ])


def test_faults_of_a_map(spark):
    rows = [(-1, "", n) for n in (4, 5, 7)] + [(0, "1", n) for n in (1, 2, 5, 9)] + [(0, "11", 4), (0, "", 3)]
    got = {tuple(r) for r in shards.map_faults(spark.createDataFrame(rows, "workchain int, shard string, seq_no long")).collect()}
    assert got == {(-1, "", 7, "MasterchainHole"), (0, "1", 9, "ShardHole")}


def test_shard_patterns(spark):
    prefixes = ["", "0", "1", "10", "0" * 59 + "1"]
    df = spark.createDataFrame([(p,) for p in prefixes], "p string").select("p", codecs.shard_id(F.col("p")).alias("i"))
    got = {r["p"]: r["i"] for r in df.collect()}
    assert got[""] == -(1 << 63) and got["0"] == 1 << 62 and got["1"] == -(1 << 62) and got["10"] == -(1 << 63) + (1 << 61)
    assert [r["b"] for r in df.select(codecs.shard_prefix(F.col("i")).alias("b")).collect()] == prefixes


def test_identity_bytes(spark):
    """Golden bytes: workchain -1, the masterchain's shard, 123, hashes of ones and twos."""
    df = spark.range(1).select(codecs.id_to_bytes(F.lit(-1), F.lit(-(1 << 63)), F.lit(123), F.unhex(F.lit("01" * 32)), F.unhex(F.lit("02" * 32))).alias("b"))
    b = df.select("b", codecs.id_from_bytes(F.col("b")).alias("x"), codecs.id_from_bytes(F.substring("b", 1, 79)).alias("y")).first()
    assert bytes(b["b"]) == bytes.fromhex("FFFFFFFF" + "0000000000000080" + "7B000000" + "01" * 32 + "02" * 32)
    assert (b["x"]["workchain"], b["x"]["shard"], b["x"]["seq"], bytes(b["x"]["file"])) == (-1, -(1 << 63), 123, b"\x02" * 32) and b["y"] is None


def test_text_codecs(spark):
    row = spark.range(1).select(
        codecs.fixed_base64(F.lit("AQID"), 3).alias("a"), codecs.fixed_base64(F.lit("AQID"), 4).alias("b"), codecs.fixed_base64(F.lit("?"), 1).alias("c"), codecs.fixed_hex(F.lit("0aFF"), 2).alias("d"), codecs.fixed_hex(F.lit("0aF"), 2).alias("e"),
        codecs.human_size(F.lit(1536)).alias("f"), codecs.upload_key(F.lit(42)).alias("g"), codecs.bytes_to_fit(F.lit(256)).alias("h"), codecs.bytes_to_fit(F.lit(0)).alias("i"),
    ).first()
    assert (bytes(row["a"]), row["b"], row["c"], bytes(row["d"]), row["e"], row["f"], row["g"], row["h"], row["i"]) == (b"\x01\x02\x03", None, None, b"\x0a\xff", None, "1.50 KiB", "000000042", 2, 0)


def test_proof_checks(spark):
    keys = spark.createDataFrame([(1, {i: b"x" for i in (28, 32, 33, 34, 35, 36, 37, 38)}), (2, {28: b"x", 34: b""})], "seq_no long, params map<int,binary>")
    got = {r["seq_no"]: r["faults"] for r in proofs.key_faults(keys).collect()}
    assert got[1] == [] and got[2] == [f"parameter_{i}" for i in (32, 33, 34, 35, 36, 37, 38)]
    validators = spark.createDataFrame([("s", "a", 1), ("s", "b", 1), ("s", "c", 1)], "set_hash string, key string, weight long")
    casts = spark.createDataFrame([(1, "s"), (2, "s"), (3, "x"), (4, "s")], "id long, set_hash string")
    signed = spark.createDataFrame([(1, k, True) for k in "abc"] + [(1, "a", True), (2, "a", True), (2, "b", True), (4, "a", True), (4, "b", False), (4, "c", True)], "id long, key string, valid boolean")
    assert {r["id"]: r["fault"] for r in proofs.broadcast_faults(casts, validators, signed).collect()} == {1: None, 2: "weight", 3: "unknown_set", 4: "bad_signature"}
    p = spark.createDataFrame([("a", "a", 0, True, "h", "h"), ("a", "b", 0, False, "h", "g"), ("m", "m", -1, False, "h", "h")], "id string, proof_for string, workchain int, is_link boolean, root_hash string, virtual_hash string")
    assert [r["faults"] for r in proofs.proof_faults(p).collect()] == [[], ["other_block", "full_proof_of_shard", "root_hash"], []]
    rows = spark.createDataFrame([("a", True), ("b", False), ("c", False)], "id string, ok boolean")
    assert {r["id"]: r["ok"] for r in proofs.accepted(rows, rows.filter("id = 'b'")).collect()} == {"a": True, "b": True, "c": False}
    ranges = spark.createDataFrame([("1", 0, 5, "x"), ("1", 6, 9, "y"), ("0", 0, 9, "z"), ("0", 9, 12, "w")], "shard string, first long, last long, collator string")
    blocks = spark.createDataFrame([("1", 5), ("1", 6), ("1", 20), ("0", 3)], "shard string, seq_no long")
    assert {(r["shard"], r["seq_no"]): r["collator"] for r in proofs.collator_range(blocks, ranges).collect()} == {("1", 5): "x", ("1", 6): "y", ("1", 20): None, ("0", 3): "z"}
    with pytest.raises(Exception, match="several ranges"):
        proofs.collator_range(spark.createDataFrame([("0", 9)], "shard string, seq_no long"), ranges).collect()


def test_content_faults(spark):
    df = spark.createDataFrame([(b"x",), (b"y",), (None,)], "data binary").withColumn("file_hash", F.unhex(F.sha2(F.lit("x"), 256)))
    assert [r["faults"] for r in proofs.content_faults(df).collect()] == [[], ["file_hash"], ["no_data"]]

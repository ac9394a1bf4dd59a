import hashlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from shardloom.functions import codecs
from shardloom.operators import graph, ordered, relations
from shardloom.plans import registry
from shardloom.sources import archive
from shardloom.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["seq_no", "gen_utime", "prev_utime"]


@pytest.mark.parametrize("name", ["retention_delete_set", "prefix_join", "cascade_delete", "archive_bucket", "refcount_merge", "archive_roundtrip", "ordered_ingest"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "nation lineitem events conversations".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(f"select {', '.join(cols)} from ({registry.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in df.select(cols).collect()))) == sorted(map(str, want))


def test_archive_fold_equals_formula_without_holes(spark):
    df = spark.range(45_000).select(F.col("id").alias("seq_no"), (F.col("id") % 997 == 0).alias("is_key"))
    a = ordered.archive_ids(df, "seq_no", F.col("is_key")).select("seq_no", "archive_id")
    b = ordered.archive_ids_gapped(df, "seq_no", "is_key").select("seq_no", "archive_id")
    assert a.exceptAll(b).isEmpty()


def test_last_before_crosses_empty_buckets(spark):
    df = spark.createDataFrame([(1, 10), (3, None), (100, None), (250, 7), (251, None)], "o long, v int")
    rows = ordered.last_before(df, "o", F.col("v"), "x", False, bucket=10).orderBy("o").collect()
    assert [r["x"] for r in rows] == [None, 10, 10, 10, 7]


def test_refcount_keeps_debt_and_drops_zero(spark):
    df = spark.createDataFrame([("a", 1, 1, b"p"), ("a", 2, 2, None), ("b", 1, 1, b"q"), ("b", 2, -1, None), ("c", 1, -1, None), ("c", 2, 2, b"r"), ("d", 1, -2, None)], "h string, o int, d long, p binary")
    got = {r["h"]: (r["rc"], r["payload"]) for r in relations.refcount_merge(df, "h", "d", "o", "p").collect()}
    assert got == {"a": (3, b"p"), "c": (1, b"r"), "d": (-2, None)}


@pytest.mark.parametrize("raw,want", [(b"", (0, None)), (b"1234567", (0, None)), ((2).to_bytes(8, "little"), (2, b"")), ((-2).to_bytes(8, "little", signed=True) + b"x", (-2, None)), ((3).to_bytes(8, "little") + b"x", (3, b"x"))])
def test_refcount_decode(raw, want):
    assert archive.decode_rc(raw) == want


def test_archive_frames():
    blob = archive.package([("a", b"xy"), ("b", b"")])
    assert list(archive.entries(blob)) == [(0, "a", b"xy"), (1, "b", b"")]
    for cut in range(5, len(blob)):
        if cut not in (4, len(archive.package([("a", b"xy")]))):
            with pytest.raises(archive.ArchiveError):
                list(archive.entries(blob[:cut]))
    with pytest.raises(archive.ArchiveError):
        list(archive.entries(b"nope" + blob))
    assert len(list(archive.entries(blob[:-7], strict=False))) == 1


def test_pieces_of_an_archive():
    blob = archive.package([("a", b"xy"), ("bcd", b""), ("e", b"z" * 40), ("last", b"")])
    for size in range(1, len(blob) + 1):
        v = archive.Verifier()
        for at in range(0, len(blob), size):
            v.feed(blob[at : at + size])
        assert v.finish() == 4
    whole = {4, *(len(archive.package([("a", b"xy"), ("bcd", b""), ("e", b"z" * 40)][:n])) for n in (1, 2, 3))}
    for end in set(range(len(blob))) - whole:
        v = archive.Verifier()
        v.feed(blob[:end])
        with pytest.raises(archive.ArchiveError):
            v.finish()
    for bad in (b"nope" + blob[4:], blob[:4] + b"\x00" + blob[5:]):
        with pytest.raises(archive.ArchiveError):
            archive.Verifier().feed(bad)
    assert archive.is_whole(blob) and not archive.is_whole(blob[:-1])


def test_block_maps(spark):
    h = "AB" * 32
    names = [(f"block_(-1,8000000000000000,7):{h}:{h}", b"b"), (f"proof_(-1,8000000000000000,7):{h}:{h}", b"p"), (f"prooflink_(-1,8000000000000000,7):{h}:{h}", b"no"), (f"proof_(0,4000000000000000,7):{h}:{h}", b"no"), (f"prooflink_(0,4000000000000000,8):{h}:{h}", b"l"), ("junk", b"no")]
    got = archive.block_maps(spark.createDataFrame([(1, n, d) for n, d in names], "g int, name string, data binary"), "g").collect()
    assert sorted((r["workchain"], r["seq"], bytes(r["block"] or b""), bytes(r["proof"]), r["is_link"]) for r in got) == [(-1, 7, b"b", b"p", False), (0, 8, b"", b"l", True)]


def test_read_archives(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i:09d}").write_bytes(archive.package([(f"n{i}", b"d" * i)]))
    assert sorted((r["path"][-1], r["name"], bytes(r["data"])) for r in archive.read_archives(spark, str(tmp_path)).collect()) == [(str(i), f"n{i}", b"d" * i) for i in range(3)]


def test_merge_keeps_one_head(spark):
    whole = archive.package([("a", b"1"), ("b", b"2")])
    df = spark.createDataFrame([(0, 0, archive.package([("a", b"1")])), (0, 1, archive.package([("b", b"2")])), (1, 0, whole[4:])], "archive_id int, segment_no int, data binary")
    assert [bytes(r["data"]) for r in archive.merge_segments(df).collect()] == [whole, whole]


def test_weighted_pick_is_the_smallest_draw(spark):
    picks = {registry.QUERIES["weighted_pick"](spark, SF).first()[0] for _ in range(2)}
    assert len(picks) == 1 and picks.pop() in {r[0] for r in spark.read.parquet(f"{SF}/supplier.parquet").select("s_suppkey").collect()}


def test_file_names(spark):
    df = spark.createDataFrame([(-1, -(1 << 63), 7)], "wc int, shard long, seq long")
    h = F.lit("ab" * 32)
    row = df.select(codecs.file_name(F.lit("proof"), F.col("wc"), F.col("shard"), F.col("seq"), h, h).alias("n")).withColumn("p", codecs.parse_file_name(F.col("n"))).first()
    assert row["n"] == f"proof_(-1,8000000000000000,7):{'AB' * 32}:{'AB' * 32}"
    assert (row["p"]["workchain"], row["p"]["shard"], row["p"]["seq"], row["p"]["root"]) == (-1, -(1 << 63), 7, "ab" * 32)
    assert spark.createDataFrame([("proof_(x)",)], "n string").select(codecs.parse_file_name(F.col("n")).alias("p")).first()["p"] is None


def test_insert_plan_and_cascade(spark):
    edges = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "c"), ("b", "c")], "src string, dst string")
    roots = spark.createDataFrame([("r",)], "node string")
    none = spark.createDataFrame([], "node string")
    got = {r["node"]: (r["refs"], r["is_new"]) for r in graph.insert_plan(edges, roots, none).collect()}
    assert got == {"r": (1, True), "a": (1, True), "b": (1, True), "c": (2, True)}
    stored = spark.createDataFrame([("b",)], "node string")
    got = {r["node"]: (r["refs"], r["is_new"]) for r in graph.insert_plan(edges, roots, stored).collect()}
    assert got == {"r": (1, True), "a": (1, True), "b": (1, False), "c": (1, True)}
    cells = spark.createDataFrame([("r", 1), ("a", 1), ("b", 2), ("c", 2)], "node string, rc long")
    got = {r["node"]: (r["removed"], r["gone"]) for r in graph.cascade_delete(cells, edges, roots).collect()}
    assert got == {"r": (1, True), "a": (1, True), "b": (1, False), "c": (1, False)}


def test_merkle_levels_rejects_missing_child(spark):
    nodes = spark.createDataFrame([("r", "x")], "node string, data string")
    edges = spark.createDataFrame([("r", 0, "gone")], "src string, ord int, dst string")
    with pytest.raises(ValueError):
        graph.merkle_levels(nodes, edges)


def test_merkle_levels_takes_all_of_lineitem(spark):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    kids = {}
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_partkey").collect():
        kids.setdefault(f"o{r[0]}", set()).add(f"p{r[1]}")
    want = {p: (sha(p), 1, 0) for ps in kids.values() for p in ps}
    want |= {o: (sha(o + "".join(sha(p) for p in sorted(ps))), 1 + len(ps), 1) for o, ps in kids.items()}
    got = registry.QUERIES["merkle_levels"](spark, SF).collect()
    assert {r["node"]: (r["digest"], r["cells"], r["height"]) for r in got} == want and len(got) == len(want)


def test_ordered_sink_stream(spark, tmp_path):
    state, applied = [(0, None)], []
    sink = ingest.OrderedSink(lambda: state[0], lambda s, h: state.__setitem__(0, (s, h)), lambda df, i: applied.extend(r["seq_no"] for r in df.collect()))
    src = str(tmp_path / "in")
    rows = lambda a, b: spark.range(a, b).select(F.col("id").alias("seq_no"), F.concat(F.lit("h"), "id").alias("hash"))

    def run():
        q = spark.readStream.schema("seq_no long, hash string").parquet(src).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()

    rows(1, 6).coalesce(1).write.parquet(src)
    run()
    rows(4, 9).coalesce(1).write.mode("append").parquet(src)
    run()
    assert sorted(applied) == list(range(1, 9)) and state[0] == (8, "h8")
    with pytest.raises(ingest.HoleError):
        sink(rows(10, 12), 5)
    with pytest.raises(ingest.HoleError):
        sink(rows(8, 9).withColumn("hash", F.lit("other")), 6)

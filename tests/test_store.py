import pytest
from pyspark.sql import functions as F

from shardloom.functions import codecs
from shardloom.operators import serve, store

HANDLES = "id string, workchain int, shard string, seq_no long, gen_utime long, flags long"


def flags(ref=0, **on):
    return ref | sum(1 << (codecs.BASE + codecs.FLAGS.index(k)) for k in on)


@pytest.fixture(scope="module")
def handles(spark):
    rows = [("m0", -1, "", 0, 0, flags()), ("m1", -1, "", 1, 100, flags(is_key_block=1, has_data=1, has_proof=1)), ("m2", -1, "", 2, 200_000, flags(has_data=1)), ("a1", 0, "0", 1, 100, flags(1, has_data=1, has_proof_link=1)), ("a2", 0, "0", 2, 100, flags(2))]
    return spark.createDataFrame(rows, HANDLES).cache()


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame([("m1", 0, b"M1"), ("m1", 1, b"P1"), ("m2", 0, b"M2"), ("a1", 0, b"A1"), ("a1", 2, b"L1")], "id string, kind int, data binary").cache()


def test_commits_are_whole_or_not_at_all(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    assert s.versions() == (0, {})
    assert s.commit(0, a=spark.range(3), b=spark.range(2)) == 1
    first = s.read("a")
    assert s.commit(1, a=spark.range(5)) == 2
    assert s.read("a").count() == 5 and s.read("b").count() == 2 and s.read("a", 1).count() == 3 and first.count() == 3
    with pytest.raises(store.Conflict):
        s.commit(1, b=spark.range(9))
    assert s.read("b").count() == 2


def test_payloads_are_stored_once(spark, handles, entries):
    new = spark.createDataFrame([("a2", 0, b"A2"), ("a2", 0, b"A2"), ("a2", 2, b"L2"), ("a1", 0, b"other"), ("zz", 0, b"?")], "id string, kind int, data binary")
    h, e, status = store.store_payloads(handles, entries, new)
    assert {(r["id"], r["kind"]): r["status"] for r in status.collect()} == {("a2", 0): "new", ("a2", 2): "new", ("a1", 0): "known", ("zz", 0): "unknown"}
    assert {r["id"]: r["flags"] for r in h.collect()}["a2"] == flags(2, has_data=1, has_proof_link=1) and e.count() == 7
    again, e, status = store.store_payloads(h, e, new)
    assert e.count() == 7 and status.filter("status = 'new'").isEmpty() and again.exceptAll(h).isEmpty()


def test_handles_refs_edges_and_flags(spark, handles):
    more = spark.createDataFrame([("a2", 0, "0", 2, 9, 0), ("b1", 0, "1", 1, 9, 0), ("b1", 0, "1", 1, 9, 0)], HANDLES)
    h, status = store.create_handles(handles, more)
    assert h.count() == 6 and {r["id"]: r["status"] for r in status.collect()} == {"a2": "fetched", "b1": "created"}
    refs = spark.createDataFrame([("a1", 1), ("a2", 3), ("b1", 7), ("b1", 7), ("m2", 0)], "id string, ref long")
    h, bad = store.set_refs(h, refs)
    assert [tuple(r) for r in bad.collect()] == [("a2", 2, 3)] and {r["id"]: r["flags"] & 0xFFFFFFFF for r in h.collect()}["b1"] == 7
    edges = spark.createDataFrame([("a1", "next1", "a2")], "id string, direction string, to_id string")
    new = spark.createDataFrame([("a1", "next1", "zz"), ("a2", "prev1", "a1")], edges.schema)
    h, e = store.store_connections(h, edges, new)
    assert sorted(map(tuple, e.collect())) == [("a1", "next1", "a2"), ("a2", "prev1", "a1")] and h.filter(codecs.flag(F.col("flags"), "has_prev1")).first()["id"] == "a2"
    done = store.set_applied(h, spark.createDataFrame([("a1",)], "id string"))
    assert [r["id"] for r in done.filter("changed").collect()] == ["a1"] and store.set_applied(done.drop("changed"), done.filter("changed")).filter("changed").isEmpty()
    keys = spark.createDataFrame([(1, "old")], "seq_no long, id string")
    up, keys = store.store_handles(handles, keys, handles.filter("id in ('m1', 'm2')").withColumn("gen_utime", F.lit(5).cast("long")))
    assert up.count() == 5 and up.filter("gen_utime = 5").count() == 2 and [tuple(r) for r in keys.collect()] == [(1, "m1")]


def test_archiving(spark, handles, entries):
    archives = spark.createDataFrame([(0, 0, b"head")], "archive_id long, segment_no long, data binary")
    frames = spark.createDataFrame([("m1", 0, b"f1"), ("a1", 0, b"f0"), ("m2", 100, b"f2")], "id string, archive_id long, data binary")
    h, e, a = store.move_into_archive(handles, entries, archives, frames)
    assert sorted((r[0], r[1], bytes(r[2])) for r in a.collect()) == [(0, 0, b"head"), (0, 1, b"f0"), (0, 2, b"f1"), (100, 0, b"f2")] and e.isEmpty()
    _, _, again = store.move_into_archive(h, e, a, frames)
    assert again.count() == 4


def test_removal(spark, handles, entries):
    tops = spark.createDataFrame([(-1, "", 2), (0, "00", 2)], "workchain int, shard string, top long")
    done = store.remove_blocks(handles, entries, tops)
    assert sorted(r["id"] for r in done.handles.collect()) == ["a2", "m0", "m1", "m2"] and tuple(done.stats.first()) == (0, 1, 2)
    cleared = {r["id"]: r["flags"] for r in store.clear_handles(handles, tops).collect()}
    assert cleared["a1"] == 1 and cleared["m1"] == flags(is_key_block=1, has_data=1, has_proof=1)
    ids = spark.createDataFrame([(0,), (100,), (200,), (300,)], "archive_id long")
    kept = lambda until: sorted(r[0] for r in store.remove_archives(ids, until)[0].collect())
    assert [kept(u) for u in (0, 100, 101, 250, 1000)] == [[0, 100, 200, 300], [0, 100, 200, 300], [100, 200, 300], [200, 300], [300]]
    assert [r[0] for r in store.archives_in(ids, 100, 250).collect()] == [100, 200]
    assert [tuple(r) for r in store.archives_to_upload(ids, 0, 1000).orderBy("archive_id").collect()] == [(100, "000000100"), (200, "000000200")]
    names = spark.createDataFrame([("5",), ("12",), ("tmp",)], "name string")
    assert [r[0] for r in store.outdated_folders(names, 10).collect()] == ["5"]


def test_states_go_with_their_cells(spark):
    states = spark.createDataFrame([(0, "", 1, "s1"), (0, "", 2, "s2"), (0, "", 0, "s0")], "workchain int, shard string, seq_no long, cell string")
    cells = spark.createDataFrame([("s1", 1), ("s2", 1), ("s0", 1), ("x", 2), ("y", 1)], "node string, rc long")
    refs = spark.createDataFrame([("s1", "x"), ("s2", "x"), ("s1", "y")], "src string, dst string")
    tops = spark.createDataFrame([(0, "", 2)], "workchain int, shard string, top long")
    left, cells = store.remove_states(states, cells, refs, tops)
    assert sorted(r["cell"] for r in left.collect()) == ["s0", "s2"] and {r["node"]: r["rc"] for r in cells.collect()} == {"s2": 1, "s0": 1, "x": 1}


def test_removal_targets(spark):
    keys = spark.createDataFrame([(10, 0), (20, 1 << 17), (30, (1 << 17) + 5)], "seq_no long, gen_utime long")
    pick = lambda *a, **k: [r["seq_no"] for r in store.removal_target(keys, *a, **k).collect()]
    assert pick("before_last_key") == [20] and pick("before_last_persistent") == [20] and pick("distance", last=35, distance=10) == [20] and pick("distance", last=5, distance=0) == []
    with pytest.raises(ValueError):
        store.removal_target(keys, "never")
    assert [r["seq_no"] for r in serve.choose_key_block(keys, 400).collect()] == [10] and [r["seq_no"] for r in serve.choose_key_block(keys, 1 << 20).collect()] == [20]


def test_pages_of_key_blocks(spark):
    keys = spark.createDataFrame([(n, f"k{n}") for n in range(0, 200, 10)], "seq_no long, id string")
    asked = [("a", -1, 50, "k50", 0), ("b", -1, 50, "k50", 3), ("c", -1, 50, "k50", 50), ("d", -1, 50, "kx", 3), ("e", 0, 50, "k50", 3), ("f", -1, 51, "k51", 3), ("g", -1, 180, "k180", 8)]
    rows = serve.next_key_blocks(spark.createDataFrame(asked, "request string, workchain int, seq_no long, id string, max_size int"), keys).collect()
    got = {r["request"]: (list(r["ids"]), r["incomplete"], r["error"]) for r in rows}
    assert got == {"a": ([], False, False), "b": (["k50", "k60", "k70"], False, False), "c": ([f"k{n}" for n in range(50, 130, 10)], True, False), "d": ([], False, True), "e": ([], False, True), "f": ([], False, True), "g": (["k180", "k190"], True, False)}
    assert [r["seq_no"] for r in serve.page_of(keys, "seq_no", 35, 2, forward=False).collect()] == [30, 20]


def test_archive_cover_of_a_table(spark):
    archives = spark.createDataFrame([(0,), (100,), (150,)], "archive_id long")
    asked = spark.createDataFrame([(n,) for n in (99, 149, 150, 249, 250)], "seq_no long")
    got = {r["seq_no"]: r["archive_id"] for r in serve.archive_info(asked, archives, 1000, 1000).collect()}
    assert got == {99: 0, 149: 100, 150: 150, 249: 150, 250: None}
    assert {r["seq_no"]: r["archive_id"] for r in serve.archive_info(asked, archives, 1000, 140).collect()}[149] is None


def test_key_blocks_without_handles_are_an_error(spark, handles):
    keys = spark.createDataFrame([(1, "m1")], "seq_no long, id string")
    assert serve.key_handles(keys, handles).count() == 1
    with pytest.raises(Exception, match="without a handle"):
        serve.key_handles(keys.withColumn("id", F.lit("gone")), handles).collect()

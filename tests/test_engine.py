import random

import duckdb
import pytest

from tidemark import cli
from tidemark.functions import bounds, codec
from tidemark.model import CommitConflict, Corruption, InvalidConfig, KeyNotFound, KeyTooLarge, StoreClosed, UnknownProperty, WriteStall
from tidemark.operators import algos, maintain, reads
from tidemark.plans import catalogue
from tidemark.sources import framed_log
from tidemark.sources.framed_log import list_fragments, read_framed_log, read_text_run, read_timed_log, write_text_run
from tidemark.sources.store import Config, Store
from tidemark.streaming.ingest import ingest, latest_view


def normal(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("customer", "orders", "events", "documents", "nation"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = catalogue.queries()[name](spark, sf)
    columns = sorted(df.columns)
    result = con.execute(catalogue.oracle_sql()[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    expected = sorted((tuple(normal(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)
    assert sorted((tuple(normal(r[c]) for c in columns) for r in df.collect()), key=str) == expected


def log(spark, rows):
    return spark.createDataFrame(rows, "k string, seq bigint, tomb boolean, v string")


def test_reads_match_a_dictionary(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a\0", "ab", "b", "é", "", "\U0010ffff"]), i + 1, rng.random() < 0.3, None) for i in range(120)]
    rows = [(k, s, t, None if t else rng.choice(["", "x\ty", "l\nm"])) for k, s, t, _ in rows]
    df = log(spark, rows)
    for snapshot in (None, 40):
        state = {}
        for k, s, t, v in rows:
            if snapshot is None or s <= snapshot:
                state[k] = None if t else v
        alive = sorted(((k, v) for k, v in state.items() if v is not None), key=lambda x: x[0].encode())
        assert [(r.k, r.v) for r in reads.scan(df, snapshot=snapshot).collect()] == alive
        assert [(r.k, r.v) for r in reads.scan(df, "a", "b", snapshot).collect()] == [x for x in alive if "a" <= x[0] < "b"]
        for p in ("a", "", "\U0010ffff"):
            expected = [x for x in alive if x[0].startswith(p)]
            assert [(r.k, r.v) for r in reads.scan_prefix(df, p, snapshot).collect()] == expected == [(r.k, r.v) for r in reads.scan_prefix_as_range(df, p, snapshot).collect()]
    with pytest.raises(InvalidConfig):
        reads.scan(df, "z", "a")
    assert reads.scan(df, "a", "a").count() == 0


@pytest.mark.parametrize("span", (1, 7, 1 << 20))
def test_history_and_as_of_join_in_ranges(spark, span):
    rng = random.Random(8)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(6)}", i + 1, rng.random() < 0.2, str(i)) for i in range(80)]
    versions = {}
    for k, s, t, v in rows:
        versions.setdefault(k, []).append((s, t, v))
    numbered = {(r.k, r.seq): r.version for r in reads.history(log(spark, rows), span).collect()}
    assert numbered == {(k, s): len(x) - i for k, x in versions.items() for i, (s, _, _) in enumerate(x)}
    probes = [(k, at, n) for n, (k, at) in enumerate([("hot", 0), ("hot", 1), ("hot", 80), ("hot", 80), ("absent", 5), *((rng.choice(sorted(versions)), rng.randrange(-3, 200)) for _ in range(60))])]
    found = {r.n: (r.k, r.t, r.seq, r.tomb, r.v) for r in reads.as_of(spark.createDataFrame(probes, "k string, t bigint, n int"), log(spark, rows), "t", span).collect()}
    assert found == {n: (k, at, *([x for x in versions.get(k, []) if x[0] <= at] or [(None, None, None)])[-1]) for k, at, n in probes}


def test_flush_and_compaction_keep_the_scan(spark):
    rng = random.Random(2)
    rows = log(spark, [(f"k{rng.randrange(30):02}", i + 1, rng.random() < 0.4, str(i)) for i in range(200)])
    expected = reads.scan(rows).collect()
    runs = maintain.flush(maintain.assign_runs(rows, 25))
    assert reads.scan(runs.drop("run")).collect() == expected
    assert reads.scan(maintain.compact_l0(runs)).collect() == expected
    deep = runs.where("run < 4").drop("run")
    top = maintain.compact_level(runs.where("run >= 6").drop("run"), runs.where("run in (4, 5)").drop("run"), deep)
    assert reads.scan(top.unionByName(deep)).collect() == expected


def test_restore_cuts_a_prefix(spark):
    base = spark.createDataFrame([("base", "ok")], "k string, v string")
    entries = spark.createDataFrame([(1, 100, "k1", False, "v1"), (2, 300, "k3", False, "v3"), (3, 200, "k2", False, "v2")], "pos bigint, ts bigint, k string, tomb boolean, v string")
    assert sorted(r.k for r in maintain.restore_until(base, entries, 250).collect()) == ["base", "k1"]


def test_bounds():
    assert bounds.prefix_end(b"ab\xff\xff") == b"ac" and bounds.prefix_end(b"\xff") is None and bounds.prefix_end(b"") is None


def test_framing_and_records(spark, tmp_path):
    assert codec.crc32c(b"123456789") == 0xE3069283
    big = b"\xab" * (100 * 1024)
    framed = codec.frame([big])
    assert [k for _, k, _ in codec.fragments(framed)] == [codec.FIRST, codec.MIDDLE, codec.MIDDLE, codec.LAST] and list(codec.records(framed)) == [big]
    batch = codec.encode(5, [(codec.PUT, b"u:1", b"alice"), (codec.DELETE, b"u:3", b"")])
    data = codec.frame([codec.encode(4, [(codec.PUT, b"k\t", b"")]), batch])
    with pytest.raises(Corruption):
        list(codec.records(data[:9] + b"X" + data[10:]))
    with pytest.raises(Corruption):
        list(codec.records(data[:-3]))
    assert len(list(codec.records(data + b"\1\2"))) == 2  # a torn header
    with pytest.raises(Corruption):
        codec.decode(batch + b"!")
    (tmp_path / "wal").mkdir()
    (tmp_path / "wal" / "a.log").write_bytes(data)
    rows = sorted(read_framed_log(spark, str(tmp_path / "wal")).collect(), key=lambda r: r.seq)
    assert [(r.seq, r.op, bytes(r.k), r.v if r.v is None else bytes(r.v)) for r in rows] == [(4, "put", b"k\t", b""), (5, "put", b"u:1", b"alice"), (6, "delete", b"u:3", None)]
    (tmp_path / "wal-7").write_bytes(codec.frame([codec.encode_timed(100, False, b"k1", b"v1")]))
    assert [(r.pos.segment, r.pos.i, bytes(r.k)) for r in read_timed_log(spark, str(tmp_path / "wal-7")).collect()] == [(7, 0, b"k1")]
    (tmp_path / "big.log").write_bytes(framed)
    assert [(r.position, r.type) for r in list_fragments(spark, str(tmp_path / "big.log")).orderBy("position").collect()] == [(0, 2), (32768, 3), (65536, 3), (98304, 4)]
    (tmp_path / "run.txt").write_text("RUN 1 1 0\n7\t0\ta\tx\n8\t1\tb\t\n\n")
    assert [tuple(r) for r in read_text_run(spark, str(tmp_path / "run.txt"), "RUN").orderBy("k").collect()] == [("a", 7, False, "x"), ("b", 8, True, None)]
    (tmp_path / "bad.txt").write_text("RUN 1 9 0\n")
    with pytest.raises(Corruption):
        read_text_run(spark, str(tmp_path / "bad.txt"), "RUN")


def test_store(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    store = Store.open(spark, path)
    store.write_batch([("put", "user:001", "v1"), ("put", "user:002", "v2"), ("put", "user:003", ""), ("delete", "user:002", None), ("put", "user:001", "v1-new")])
    seen = store.snapshot()
    other = Store.open(spark, path)
    store.put("user:009", "later")
    with pytest.raises(CommitConflict):
        other.put("x", "y")
    with pytest.raises(KeyNotFound):
        store.get("user:009", seen)
    assert store.get("user:001") == "v1-new" and store.get("user:003") == ""
    expected = [("user:001", "v1-new"), ("user:003", ""), ("user:009", "later")]
    assert [(r.k, r.v) for r in store.scan("user:", "user;").collect()] == expected == [(r.k, r.v) for r in store.scan_prefix("user:").collect()]
    with pytest.raises(KeyTooLarge):
        store.write_batch([("put", "fine", "x"), ("put", "k" * 1025, "x")])
    with pytest.raises(KeyNotFound):
        store.get("fine")
    store.delete("user:009")
    store.checkpoint(f"file://{tmp_path}/copy")
    store.flush()
    assert store.compact(0) and [(r.k, r.v) for r in store.scan().collect()] == expected[:2]
    assert store.vacuum() == [] and len(store.vacuum(-1)) == 1 and store.doctor()["repeated_seq"] == 0 and store.stats()["runs"] == 1
    copy = Store.open(spark, f"file://{tmp_path}/copy")
    assert [(r.k, r.v) for r in copy.scan().collect()] == expected[:2]
    for bad in ("", f"file://{tmp_path}/../x", f"file://{tmp_path}/copy"):
        with pytest.raises(InvalidConfig):
            store.checkpoint(bad)


def test_streaming(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('{"op":"put","k":"a","v":"1","ord":1}\n{"op":"put","k":"b","v":"2","ord":2}\n{"op":"delete","k":"a","ord":3}\n')
    store = Store.open(spark, f"file://{tmp_path}/s")
    for _ in range(2):  # the second run finds nothing new
        ingest(spark.readStream.schema("op string, k string, v string, ord bigint").json(str(folder)), store, "q", str(tmp_path / "ck")).awaitTermination()
    assert [(r.k, r.v) for r in store.scan().collect()] == [("b", "2")] and store.stats()["next_sequence"] == 4
    stream = spark.readStream.schema("op string, k string, v string, ord bigint").json(str(folder)).selectExpr("k", "ord as seq", "op = 'delete' as tomb", "v")
    latest_view(stream).writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.k, r.tomb) for r in spark.table("latest").collect()) == [("a", True), ("b", False)]


def rows_of(spark, ops):
    return spark.createDataFrame([(op, k, v, i) for i, (op, k, v) in enumerate(ops)], "op string, k string, v string, ord bigint")


def test_a_stream_batch_that_failed_is_written_when_it_comes_again(spark, tmp_path):
    store = Store.open(spark, f"file://{tmp_path}/s")
    with pytest.raises(InvalidConfig):
        store.write_batch(rows_of(spark, [("put", None, "x")]), ("q", 0))
    for _ in range(2):
        store.write_batch(rows_of(spark, [("put", "a", "1")]), ("q", 0))
    store.write_batch(rows_of(spark, []), ("q", 1))
    again = Store.open(spark, store.path)
    assert again.snapshot() == 1 and again.manifest["streams"] == {"q": 1}


def test_one_of_two_writers_commits(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    first, second = Store.open(spark, path), Store.open(spark, path)
    first.write_batch(rows_of(spark, [("put", "a", "1")]))
    with pytest.raises(CommitConflict):
        second.write_batch(rows_of(spark, [("put", "a", "2")]))
    assert Store.open(spark, path).get("a") == "1" and not [p for p in (tmp_path / "s").glob(".staged*")]


def test_replay_rotation_and_damage(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    store = Store.open(spark, path, Config(memtable_max_bytes=40))
    store.put("k1", "v1")
    store.write_batch([("put", "k2", "v2"), ("delete", "k1", None)])
    again = Store.open(spark, path)
    assert again.snapshot() == 3 and [(r.k, r.v) for r in again.scan().collect()] == [("k2", "v2")] and again.stats()["runs"] == 0
    store.put("k3", "x" * 40)  # fills the memtable
    assert store.memory == [] and store.counts["flush"] == 1 and not list((tmp_path / "s" / "log").glob("0*.log"))
    store.put("k4", "v4")
    log = next((tmp_path / "s" / "log").glob("0*.log"))
    content = log.read_bytes()
    log.write_bytes(content[:9] + b"\xff" + content[10:])
    (tmp_path / "s" / "log" / f".{log.name}.crc").unlink(missing_ok=True)
    assert store.doctor()["bad_log"] == 1
    with pytest.raises(Corruption):
        Store.open(spark, path)
    log.write_bytes(content)
    for f in (tmp_path / "s" / "data").rglob("*.parquet"):
        f.unlink()
    with pytest.raises(Corruption):
        Store.open(spark, path)
    store.close()
    store.close()
    for call in (store.doctor, store.stats, store.vacuum, lambda: store.put("a", "b"), lambda: store.hold_snapshot("x")):
        with pytest.raises(StoreClosed):
            call()


def test_snapshots_are_held_by_name(spark, tmp_path):
    store = Store.open(spark, f"file://{tmp_path}/s")
    store.put("a", "1")
    one = store.hold_snapshot("one")
    store.put("a", "2")
    two = store.hold_snapshot("two")
    store.delete("a")
    store.flush()
    store.compact(0)
    assert store.get("a", one) == "1" and store.get("a", two) == "2"
    store.release_snapshot("one")
    assert store.get("a", two) == "2"
    store.release_snapshot("two")
    store.put("b", "1")
    store.flush()
    store.compact(0)
    store.compact(1)
    with pytest.raises(InvalidConfig):
        store.get("a", one)
    with pytest.raises(KeyNotFound):
        store.get("a")


def test_backpressure_and_configuration(spark, tmp_path):
    store = Store.open(spark, f"file://{tmp_path}/s", Config(auto_compact=False, slowdown_l0_files=1, stop_l0_files=2))
    for k in "ab":
        store.write_batch(rows_of(spark, [("put", k, k)]))
    assert store.property("engine.stall.state") == "stop" and store.property("engine.metrics.stall.count") == 1
    with pytest.raises(WriteStall):
        store.put("c", "c")
    store.compact(0)
    store.put("c", "c")
    for bad in (Config(memtable_max_bytes=0), Config(slowdown_l0_files=13), Config(compaction_rate_bytes_per_sec=0)):
        with pytest.raises(InvalidConfig):
            Store.open(spark, f"file://{tmp_path}/t", bad)
    for path in ("", f"file://{tmp_path}/../t"):
        with pytest.raises(InvalidConfig):
            Store.open(spark, path)


def test_properties(spark, tmp_path):
    store = Store.open(spark, f"file://{tmp_path}/s")
    store.put("a", "1")
    store.delete("b")
    store.get("a")
    found = store.properties()
    assert len(found) == 44 and found["engine.metrics.put.count"] == found["engine.metrics.get.hit.count"] == 1 and found["engine.memtable.bytes"] == 3
    assert found["engine.metrics.wal.bytes"] == 15 + 2 + 15 + 1 and found["engine.metrics.latency.put.p50_us"] > 0 and found["engine.metrics.latency.scan.p99_us"] == 0
    with pytest.raises(UnknownProperty):
        store.property("engine.nothing")


def test_bytes_are_ordered_as_such(spark, tmp_path):
    store = Store.open(spark, f"file://{tmp_path}/s", binary=True)
    keys = [b"\xff\xff", b"\x7f", b"\xff", b"a\0", b"a", b"\xff\x00"]
    for k in keys:
        store.put(k, k)
    assert [bytes(r.k) for r in store.scan().collect()] == sorted(keys)
    store.flush()
    assert [bytes(r.k) for r in store.scan_prefix(b"\xff").collect()] == [b"\xff", b"\xff\x00", b"\xff\xff"]
    assert [bytes(r.k) for r in store.scan(b"a", b"a\0").collect()] == [b"a"] and store.get(b"a\0") == b"a\0"
    with pytest.raises(InvalidConfig):
        Store.open(spark, store.path, binary=False)


def test_text_runs_round_trip(spark, tmp_path):
    rows = log(spark, [("b", 2, True, None), ("a", 1, False, "x"), ("c", 3, False, "")])
    write_text_run(rows, str(tmp_path / "run"), "RUN", 1)
    assert sorted(map(tuple, read_text_run(spark, str(tmp_path / "run"), "RUN").collect())) == [("a", 1, False, "x"), ("b", 2, True, None), ("c", 3, False, "")]
    (tmp_path / "run" / "part-9.txt").write_text("9\t0\tz\tz\n")
    with pytest.raises(Corruption):
        read_text_run(spark, str(tmp_path / "run"), "RUN")


def test_segments_in_the_order_of_their_numbers(spark, tmp_path):
    for n, key in ((10, b"late"), (9, b"early")):
        (tmp_path / f"wal-{n}").write_bytes(codec.frame([codec.encode_timed(n, False, key, b"")]))
    rows = read_timed_log(spark, str(tmp_path)).orderBy("pos").collect()
    assert [bytes(r.k) for r in rows] == [b"early", b"late"]


def test_cycles_of_a_large_graph_are_found_with_short_plans(spark):
    n = 3000
    edges = spark.range(n).selectExpr("id as waiter", "if(id % 1000 = 999, id - 999, id + 1) as owner")
    found = algos.cycles(edges)
    assert sorted(map(tuple, found.collect())) == [(999, 1000), (1999, 1000), (2999, 1000)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_command_line(spark, tmp_path, capsys):
    def call(*argv):
        code = cli.main([argv[0], "--path", f"file://{tmp_path}/s", *argv[1:]], spark)
        out = capsys.readouterr()
        return code, out.out.strip(), out.err.strip()

    assert call("open") == (0, "open ok", "") and call("open", "--json")[1] == '{"ok":true}'
    assert call("put", "--key", "user:1", "--value", "é") == (0, "ok", "")
    assert call("put", "--json", "--key", "user:2", "--value", "b")[1] == '{"ok":true,"op":"put"}'
    assert call("get", "--key", "user:1")[1] == "é" and call("get", "--json", "--key", "user:1")[1] == '{"key":"user:1","value":"é"}'
    assert call("delete", "--key", "user:2")[1] == "ok"
    assert call("scan", "--prefix", "user:")[1] == "user:1\té" and call("scan", "--json", "--start", "a", "--end", "z")[1] == '[{"key":"user:1","value":"é"}]'
    assert "next_sequence=4" in call("stats")[1] and call("doctor")[1] == "doctor ok"
    assert call("property", "--name", "engine.l0.files")[1] == "0"
    for bad in (("get", "--key", "none"), ("scan", "--end", "z"), ("scan", "--prefix", "a", "--start", "b"), ("scan", "--start", "b", "--end", "a"), ("put", "--key", "a"), ("property", "--name", "x"), ("nothing",)):
        code, out, err = call(*bad)
        assert code == 1 and out == "" and err.startswith("error:"), bad
    assert call("get", "--json", "--key", "none")[2] == '{"ok": false, "error": "KeyNotFound"}'


def test_files_of_a_run_do_not_grow_with_it(spark, tmp_path):
    ops = [("put", f"k{i % 700:03}", str(i)) for i in range(1400)] + [("delete", f"k{i:03}", None) for i in range(100)]
    store = Store.open(spark, f"file://{tmp_path}/s", Config(file_bytes=32, level_base_bytes=1 << 20))
    store.write_batch(rows_of(spark, ops))
    held = store.hold_snapshot("all")
    expected = [(f"k{i:03}", str(i + 700)) for i in range(100, 700)]
    assert 8 < len(store.manifest["files"]) <= 64 and [(r.k, r.v) for r in store.scan().collect()] == expected
    store.compact(0)
    assert 8 < len(store.manifest["files"]) <= 64 and [(r.k, r.v) for r in store.scan(snapshot=held).collect()] == expected
    assert [store._pieces(n) for n in (0, 32, 33, 64 << 27, 1000 << 27)] == [1, 1, 2, 64, 1000]


def test_logs_are_cut_into_files_and_decoded_in_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(framed_log, "FILE_BYTES", 40_000)
    monkeypatch.setattr(framed_log, "SLICE", 2 * codec.BLOCK)
    monkeypatch.setattr(framed_log, "OUT_ROWS", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        rows = spark.range(1, 2001).selectExpr("id as seq", "id as pos", "timestamp_micros(id) as ts", "'put' as op", "false as tomb", "concat('k', id) as k", "repeat(cast(id % 10 as string), if(id = 700, 9000, 90)) as v")
        expected = [(r.seq, r.k.encode(), r.v.encode()) for r in rows.orderBy("seq").collect()]
        logs = framed_log.write_framed_log(rows, f"file://{tmp_path}/log", 1).collect()
        assert len(logs) > 4 and sum(r.records for r in logs) == 2000 and max(r.bytes for r in logs) < 80_000 and sorted(logs)[0].path.endswith(f"/{0:020d}.log")
        assert [(r.seq, bytes(r.k), bytes(r.v)) for r in read_framed_log(spark, f"file://{tmp_path}/log").orderBy("seq").collect()] == expected
        assert len(framed_log.archive(rows, f"file://{tmp_path}/old", 1).collect()) > 4
        back = read_timed_log(spark, f"file://{tmp_path}/old").orderBy("pos").collect()
        assert [(bytes(r.k), bytes(r.v)) for r in back] == [(k, v) for _, k, v in expected]
        monkeypatch.setattr(framed_log, "FILE_BYTES", 1 << 30)
        one, stale = tmp_path / "one", tmp_path / "one" / f"{1:020d}.log"
        one.mkdir()
        stale.write_bytes(b"of an attempt before")
        assert len(framed_log.write_framed_log(rows, f"file://{one}", 1).collect()) == 1 and not stale.exists()
        data = (one / f"{0:020d}.log").read_bytes()
        assert len(data) > 4 * codec.BLOCK and [(r.seq, bytes(r.k), bytes(r.v)) for r in read_framed_log(spark, f"file://{one}").orderBy("seq").collect()] == expected
        assert [(r.position, r.type, r.length) for r in list_fragments(spark, f"file://{one}").orderBy("position").collect()] == [(at, kind, len(part)) for at, kind, part in codec.fragments(data)]
        assert list(codec.records_of([data[: 2 * codec.BLOCK], data[2 * codec.BLOCK :]])) == list(codec.records(data))
        with pytest.raises(Corruption):
            list(codec.records_of([data[: 2 * codec.BLOCK]]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_an_empty_log_file_has_no_rows(spark, tmp_path):
    (tmp_path / "wal-1").write_bytes(b"")
    assert read_timed_log(spark, str(tmp_path)).count() == 0 == read_framed_log(spark, str(tmp_path)).count()


def test_a_restore_leaves_no_staged_rows(spark, tmp_path):
    base = Store.open(spark, f"file://{tmp_path}/base")
    base.put("a", "1")
    log = spark.createDataFrame([(1, 100, "b", False, "2"), (2, 200, "a", True, None), (3, 300, "c", False, "3")], "pos bigint, ts bigint, k string, tomb boolean, v string")
    assert [(r.k, r.v) for r in Store.restore(spark, f"file://{tmp_path}/new", base, log, 300).scan().collect()] == [("b", "2")] and not list((tmp_path / "new").glob(".staged*"))


@pytest.fixture(scope="module")
def versions(spark):
    return spark.range(1800).selectExpr("format_string('k%03d', id * 7 % 600) as k", "id + 1 as seq", "id % 11 = 3 as tomb", "if(id % 11 = 3, null, cast(id as string)) as v")


@pytest.fixture(scope="module")
def crowded(spark, versions, tmp_path_factory):
    """A store of one run, which would have hundreds of files of `file_bytes`."""
    store = Store.open(spark, f"file://{tmp_path_factory.mktemp('crowded')}/s", Config(file_bytes=64))
    store.write_batch(catalogue.operations(versions))
    return store


def same_rows(found, expected):
    return sorted(found.select("k", "v", "seq").collect()) == sorted(expected.select("k", "v", "seq").collect())


def test_a_scan_reads_few_files_of_a_run(versions, crowded):
    found = crowded.scan()
    assert 8 < len(found.inputFiles()) <= 64 and same_rows(found, reads.scan(versions))


def test_a_checkpoint_has_few_files_of_a_run(spark, versions, crowded, tmp_path):
    crowded.checkpoint(f"file://{tmp_path}/copy")
    copied = list((tmp_path / "copy").rglob("*.parquet"))
    assert 8 < len(copied) <= 64 and same_rows(Store.open(spark, f"file://{tmp_path}/copy").scan(), reads.scan(versions))


def test_a_multi_get_reads_few_files_of_a_run(spark, versions, crowded):
    keys = spark.createDataFrame([(f"k{i:03}",) for i in range(0, 600, 7)] + [("k599",), ("none",)], "k string")
    found = crowded.multi_get(keys)
    assert 8 < len(found.inputFiles()) <= 64 and same_rows(found, reads.multi_get(versions, keys))


def test_a_range_reads_few_files_of_a_run(versions, crowded):
    found = crowded.scan("k100", "k400")
    assert 4 < len(found.inputFiles()) < 48 and same_rows(found, reads.scan(versions, "k100", "k400"))


def test_python_gets_a_log_in_pieces(spark, tmp_path, monkeypatch):
    rows = spark.range(1, 2001).selectExpr("id as seq", "'put' as op", "concat('k', id) as k", "repeat(cast(id % 10 as string), 900) as v")
    size = sum(r.bytes for r in framed_log.write_framed_log(rows, f"file://{tmp_path}/log", 1).collect())
    given = []
    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(rows), name, lambda df, *_: given.append(df) or df)
    read_framed_log(spark, f"file://{tmp_path}/log")
    pieces = [len(r[-1]) for r in given[0].collect()]
    assert sum(pieces) == size > 1 << 20 and max(pieces) <= 1 << 20

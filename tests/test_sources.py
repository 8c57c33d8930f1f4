import hashlib
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tessera.plans import scans
from tessera.plans.memo import Stage, run_all
from tessera.sources import containers, layouts, publishing, records, sinks
from tessera.streaming import journal as streams

EVENT = StructType([StructField("event", StringType()), StructField("sequence", LongType())])


def test_tolerant_and_strict_readers(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text('{"event":"history_started","sequence":1}\nnot json\n{"event":"x","sequence":2')
    rows = records.tolerant_lines(spark, str(tmp_path), EVENT).collect()
    assert sorted(r.event for r in rows) == ["_unparseable_line", "_unparseable_line", "history_started"]
    strict = records.strict_journals(spark, str(tmp_path), "event string, sequence long")
    assert strict.count() == 2 and all(r.torn_tail for r in strict.collect())
    with pytest.raises(Exception, match="malformed line 2"):
        records.assert_clean(strict, "sequence").collect()


def test_arrays_zips_and_tables(spark, tmp_path):
    a = np.arange(35).reshape(5, 7) % 4
    np.save(tmp_path / "a.npy", a)
    px = records.npy_rasters(spark, str(tmp_path / "a.npy"))
    assert {(r.y, r.x): r.label for r in px.collect()} == {(y, x): a[y, x] for y in range(5) for x in range(7)}
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("001.png", b"x" * 10)
        z.writestr("__MACOSX/001.png", b"y")
        z.writestr(".hidden", b"z")
    assert [r.member for r in containers.contents(containers.members(spark, str(tmp_path / "t.zip"))).collect()] == ["001.png"]
    (tmp_path / "s.csv").write_text("nm,b,c,signal\n619.921,0,0,2.5\nbad,0,0,1\n")
    got = records.spectra_csv(spark, str(tmp_path / "s.csv")).collect()
    assert got[0].x == pytest.approx(2.0) and got[1].x is None


def test_many_documents_to_a_file(spark, tmp_path):
    journals = ['{"event":"a","sequence":1}\n{"event":"b","sequence":2}\n', '{"event":"c","sequence":1}\n{"event":"torn","sequence":2}', "", '{"event":"only","sequence":1}']
    records.pack(spark.createDataFrame([(j,) for j in journals], "value string").coalesce(1), str(tmp_path / "j"))
    got = records.strict_journals(spark, str(tmp_path / "j"), "event string, sequence long", packed=True).collect()
    assert sorted((r.event.event, r.line_no, r.torn_tail) for r in got) == [("a", 1, False), ("b", 2, False), ("c", 1, True)]
    documents = ['{"event": "x",\n "sequence": 1}', '{"event": "cut",\n "sequ', '{"event": "\\u001e", "sequence": 3}']
    records.pack(spark.createDataFrame([(x,) for x in documents], "value string").coalesce(1), str(tmp_path / "s"))
    read = records.sessions(spark, str(tmp_path / "s"), EVENT, packed=True).collect()
    assert sorted((r.event, r.sequence) for r in read if not r.error) == [("\x1e", 3), ("x", 1)] and [r.error for r in read if r.error] == [documents[1]]


@pytest.mark.parametrize("name", ["session_documents", "strict_journal"])
def test_no_file_is_made_for_a_key(spark, sf_dir, name, tmp_path, monkeypatch):
    monkeypatch.setattr(scans, "new_folder", lambda spark, what: str(tmp_path / what))
    rows = scans.QUERIES[name](spark, sf_dir).count()
    assert len(list(tmp_path.rglob("part-*"))) <= min(4, rows // 2)


def test_palette_refuses_unknown_colours(spark):
    palette = spark.createDataFrame([(0, 0, 0, 0), (255, 0, 0, 1)], "r int, g int, b int, label int")
    px = spark.createDataFrame([(0, 0, 255, 0, 0), (1, 0, 0, 0, 0)], "x int, y int, r int, g int, b int")
    assert {r.label for r in records.palette_labels(px, palette).collect()} == {0, 1}
    with pytest.raises(Exception, match="unknown colour"):
        records.palette_labels(px.withColumn("g", F.lit(128)), palette).collect()


def test_grid_inventory(spark):
    names = spark.createDataFrame([("m_r0_c0.png",), ("m_r0_c1.png",), ("m_r1_c1.png",), ("x/m_r0_c1.png",), ("notes.txt",)], "name string")
    tiles, twice, missing = layouts.grid_inventory(names)
    assert tiles.count() == 4 and twice.count() == 1
    assert [(r.row, r.col) for r in missing.collect()] == [(1, 0)]


def test_shadowed_and_companions(spark):
    files = spark.createDataFrame([(1, "1", "xlsx"), (2, "1", "csv"), (3, "2", "csv"), (4, None, "csv")], "id int, number string, ext string")
    assert sorted(r.id for r in layouts.shadowed(files, "number", "ext").collect()) == [1, 3, 4]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, v string")
    target = str(tmp_path / "out")
    sinks.publish(df, target)
    with pytest.raises(FileExistsError):
        sinks.publish(df, target)
    assert sinks.append_new(df, str(tmp_path / "blobs"), "id") == 2
    assert sinks.append_new(spark.createDataFrame([(2, "z"), (3, "c")], "id int, v string"), str(tmp_path / "blobs"), "id") == 1
    assert sinks.output_hashes(spark, target).count() >= 1
    sinks.export_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 3


def test_stages_are_remembered_and_retried(spark, tmp_path):
    calls = []

    def run(s, inputs, params):
        calls.append(dict(params))
        return inputs["src"].withColumn("v", F.lit(params["v"]))

    stage = Stage("one", run, ("src",), {"v": 1}, check=lambda df: None if df.head().v >= 2 else "low", retry=lambda p, why: {"v": p["v"] + 1})
    for _ in range(2):
        assert run_all(spark, str(tmp_path), [stage], {"src": spark.range(2)}, {"src": "k"})["one"].head().v == 2
    assert calls == [{"v": 1}, {"v": 2}]


def test_stream_equals_batch(spark, tmp_path):
    rows = [
        ("a", 1, "e1", "history_started"), ("a", 2, "e2", "x"), ("a", 4, "e4", "x"), ("a", 5, "e5", "history_closed"), ("a", 6, "e6", "x"),
        ("b", 1, "f1", "x")
    ]
    df = spark.createDataFrame(rows, "stream_id string, sequence long, event_id string, event string")
    folder = str(tmp_path / "in")
    df.where("sequence <= 2").coalesce(1).write.parquet(folder)
    df.where("sequence > 2").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = {(r.stream_id, r.sequence, r.fault) for r in streams.run_available(spark, streams.validate_stream(stream), "f").collect()}
    assert got == {("a", 4, "gap"), ("a", 6, "after close"), ("b", 1, "no start")}


def test_mirror_and_sessions(spark, tmp_path):
    df = spark.sql("select * from values (1, 'u', timestamp'2026-01-01 00:00:00'), (1, 'u', timestamp'2026-01-01 00:00:00'), (2, 'u', timestamp'2026-01-01 00:10:00'), (3, 'u', timestamp'2026-01-01 03:00:00'), (4, 'u', timestamp'2026-01-02 00:00:00') t(event_id, user, ts)")
    folder = str(tmp_path / "ev")
    df.write.parquet(folder)
    read = lambda: spark.readStream.schema(df.schema).parquet(folder)
    first = min(streams.run_available(spark, streams.sessions(read(), "user"), "s").collect(), key=lambda r: r.started)
    assert first.events == 3
    target, state = str(tmp_path / "mirror"), str(tmp_path / "mirror-state")
    assert streams.mirror(spark, read(), target, state).count() == 4
    df.where("event_id in (2, 4)").unionByName(df.where("event_id = 3").selectExpr("event_id + 2 as event_id", "user", "ts")).write.mode("append").parquet(folder)
    assert sorted(r.event_id for r in streams.mirror(spark, read(), target, state).collect()) == [1, 2, 3, 4, 5]


def test_running_reference_counts_accepted_only(spark):
    rows = [("a", i, v) for i, v in enumerate([10.0, 11.0, 12.0, 1.0, 9.0, float("nan"), 10.0], 1)]
    got = streams.running_focus_batch(spark.createDataFrame(rows, "stream_id string, sequence long, score double")).orderBy("sequence").collect()
    assert [r.accepted for r in got] == [True, True, True, False, True, False, True]
    assert got[4].reference == 11.0




def test_running_reference_equals_medians_of_the_last_fifteen():
    rng = np.random.default_rng(9)
    scores = [float(x) for x in np.round(rng.normal(10, 4, 300), 1)] + [None, float("inf"), 10.0]  # with ties
    frames, recent, want = list(enumerate(scores)), [], []
    for i, x in frames:
        reference = float(np.median(recent)) if len(recent) >= 3 else None
        ok = x is not None and bool(np.isfinite(x)) and (reference is None or x >= 0.6 * reference)
        want.append((i, reference, ok))
        recent = [*recent, x][-15:] if ok else recent
    first, held = streams.judge(reversed(frames[:100]), [])
    rest, held = streams.judge(frames[100:], held)
    assert first + rest == want and held == recent


def test_frames_of_many_streams_come_as_rows(spark, tmp_path):
    """No table is made for a stream in the workers: its frames come as rows, and its state is one value."""
    assert isinstance(streams.judge([], [1.0])[0], list)
    df = spark.range(6).selectExpr("cast(id % 3 as string) as stream_id", "id as sequence", "cast(id as double) as score")
    df.write.parquet(str(tmp_path / "in"))
    stream = streams.running_focus(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    assert "TransformWithStateInPySpark" in (plan := stream._jdf.queryExecution().analyzed().toString()) and "Pandas" not in plan


def test_streams_go_on_after_a_restart(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = []
    for stream in "abc":
        numbers = [int(x) for x in sorted(rng.choice(60, 45, replace=False) + 1)]
        rows += [(stream, n, f"{stream}{n}", "history_started" if n == 1 else "history_closed" if n == 40 else "step", float(rng.normal(10, 4))) for n in numbers]
        rows += [(stream, n, f"{stream}{n}-again", "step", float("nan")) for n in numbers[::9]]
    df = spark.createDataFrame(rows, "stream_id string, sequence long, event_id string, event string, score double")
    whole = {"faults": [], "focus": {(r.stream_id, r.sequence, r.reference, r.accepted) for r in streams.running_focus_batch(df.where("event_id not like '%again'")).collect()}}
    for stream in "abc":
        own = df.where(f"stream_id = '{stream}'").toPandas()
        whole["faults"] += [(stream, *r) for r in streams.faults(own, 1, False)[0].itertuples(index=False, name=None)]
    kept = df.where("event_id not like '%again'")
    for name, make, source in (("faults", streams.validate_stream, df), ("focus", streams.running_focus, kept)):
        folder, out, state = (str(tmp_path / f"{name}-{n}") for n in ("in", "out", "state"))
        for part in (source.where("sequence <= 30"), source.where("sequence > 30")):
            part.write.mode("append").parquet(folder)
            got = streams.run_available(spark, make(spark.readStream.schema(df.schema).parquet(folder)), name, out, state)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(whole[name], key=str)


def test_no_folder_of_one_machine_on_a_cluster():
    from types import SimpleNamespace

    from tessera.session import shared_folder

    unset = SimpleNamespace(isDefined=lambda: False, isEmpty=lambda: True)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)))
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: None), sparkContext=context)
    with pytest.raises(RuntimeError):
        shared_folder(cluster)


def test_published_folders_are_whole_and_checked(spark, tmp_path):
    rows = spark.range(50).selectExpr("id", "id % 5 as v")
    target = str(tmp_path / "out")
    sinks.publish_all({"a": rows, "b": rows.limit(10)}, target)
    got = {r.output: (r.rows, r.verified, r.v) for r in sinks.read_published(spark, target, {"a": rows.schema, "b": rows.schema}, "v").collect()}
    assert got["a"] == (50, True, 100) and got["b"][:2] == (10, True)
    with pytest.raises(FileExistsError):
        sinks.publish_all({"a": rows}, target)
    part = next((tmp_path / "out" / "a").glob("part-*.parquet"))
    part.rename(part.with_name("part-other.parquet"))
    (tmp_path / "out" / "a" / f".{part.name}.crc").unlink(missing_ok=True)
    got = {r.output: r.verified for r in sinks.read_published(spark, target, {"a": rows.schema, "b": rows.schema}, "v").collect()}
    assert got == {"a": False, "b": True}


def test_png_is_read_by_other_readers(spark, tmp_path):
    px = spark.range(70 * 30).selectExpr(
        "'i' as image", "cast(id % 70 as int) as x", "cast(id div 70 as int) as y", "cast(id * 7 % 256 as int) as g"
    ).where("(x + y) % 9 > 0")
    png = sinks.png_images(px, "image", "g", 70, 30, 8, 3).head().png
    (tmp_path / "i.png").write_bytes(png)
    got = {(r.x, r.y): r.r for r in records.image_pixels(spark, str(tmp_path / "i.png")).collect()}
    want = {(r.x, r.y): r.g for r in px.collect()}
    assert len(got) == 2100 and all(v == want.get(k, 3) for k, v in got.items())


def test_members_are_read_where_they_lie(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    held = {f"in/{i:03}.bin": rng.bytes(int(rng.integers(0, 5000))) for i in range(60)}
    for n, kind in enumerate((zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED)):
        with zipfile.ZipFile(tmp_path / f"a{n}.zip", "w", kind) as z:
            for name, data in held.items():
                z.writestr(name, data)
            z.writestr("in/broken.bin", b"q" * 3000)
            z.writestr("in/folder/", b"")
    listed = containers.members(spark, str(tmp_path / "*.zip"))
    assert listed.count() == 122
    whole = bytearray((tmp_path / "a0.zip").read_bytes())
    at = whole.index(b"q" * 3000)
    whole[at + 5] = 0
    (tmp_path / "a0.zip").write_bytes(bytes(whole))
    monkeypatch.setattr(containers, "TASK", 20_000)
    got = containers.contents(listed.where("member not like '%broken%'"))
    assert got.rdd.getNumPartitions() > 4
    rows = got.collect()
    assert len(rows) == 120 and all(bytes(r.content) == held[r.member] and r.bytes == len(r.content) for r in rows)
    with pytest.raises(Exception, match="broken.bin: damaged"):
        containers.contents(listed).collect()
    assert containers.contents(listed.limit(0)).count() == 0


def test_archives_are_written_and_read(spark, tmp_path):
    rows = spark.range(200).selectExpr("concat('x/', id) as member", "cast(repeat(id, 50) as binary) as content").repartition(3)
    assert containers.write_archives(rows, str(tmp_path / "z")).agg({"members": "sum"}).head()[0] == 200
    got = containers.contents(containers.members(spark, str(tmp_path / "z" / "*.zip"))).select("member", "content")
    assert got.exceptAll(rows).count() == 0 and got.count() == 200


def test_archives_without_members_are_read(spark, tmp_path):
    """A task without rows writes an archive without members, and others may have a comment."""
    rows = spark.range(3).selectExpr("concat('x/', id) as member", "cast(string(id) as binary) as content").repartition(8, "member")
    assert containers.write_archives(rows, str(tmp_path / "z")).where("members = 0").count() > 0
    with zipfile.ZipFile(tmp_path / "z" / "noted.zip", "w") as z:
        z.comment = b"nothing"
    got = containers.contents(containers.members(spark, str(tmp_path / "z" / "*.zip"))).select("member", "content")
    assert got.exceptAll(rows).count() == 0 and got.count() == 3
    assert containers.contents(containers.members(spark, str(tmp_path / "z" / "noted.zip"))).count() == 0


def test_archives_keep_any_language(spark, tmp_path):
    rows = [(1, "a", "en/us"), (2, "b", "-"), (3, "c", None), (4, "d", "__MACOSX"), (5, "e", "e\0n"), (None, "f", "ü"), (7, None, ""), (8, "", ".")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {(lang, 1, len(text or ""), hashlib.md5((text or "").encode()).hexdigest()) for _, text, lang in rows}
    assert {tuple(r)[:4] for r in scans.archive_members(spark, str(tmp_path)).collect()} == want
    spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert scans.archive_members(spark, str(tmp_path / "none")).count() == 0


def test_commit_writes_the_manifest_last(spark, tmp_path):
    spark.dataSource.register(publishing.HashedParquet)
    df = spark.range(1000).selectExpr("id", "cast(id as string) as s", "if(id % 7 = 0, null, id / 3) as x", "cast(id as decimal(12,3)) as d", "array(id) as a").repartition(3)
    target = str(tmp_path / "out")
    df.write.format("hashed_parquet").mode("append").save(target)
    noted = publishing.manifest(spark, target).collect()
    files = {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in (tmp_path / "out").glob("part-*")}
    assert {r.path: r.sha256 for r in noted} == files and sum(r.rows for r in noted) == 1000
    back = spark.read.parquet(target)
    assert back.exceptAll(df).count() == 0 and back.count() == 1000
    seen = {r.path.rsplit("/", 1)[-1]: r.sha256 for r in sinks.output_hashes(spark, target).collect()}
    assert {k: v for k, v in seen.items() if k in files} == files
    empty = str(tmp_path / "empty")
    df.limit(0).write.format("hashed_parquet").mode("append").save(empty)
    assert publishing.manifest(spark, empty).count() == 0


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(publishing.HashedParquet)
    bad = spark.range(0, 40_000, 1, 4).selectExpr("id", "assert_true(id < 35000) as fine")
    with pytest.raises(Exception):
        bad.write.format("hashed_parquet").mode("append").save(str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists()
    with pytest.raises(Exception):
        sinks.publish_all({"a": spark.range(5), "b": bad}, str(tmp_path / "all"))
    assert not list(tmp_path.glob("all*"))

"""Streams whose results are read while they run: late, repeated and replayed input, restarts, folding."""

import datetime as dt
import json
import os
import random
import shutil

import pytest

from factbase.operators.usage import FACT, usage_by_agent
from factbase.streaming import jobs, live

T0 = dt.datetime(2024, 1, 1, 10, 0, 0)
EVENTS = "event_id long, owner_id string, pack string, key string, agent string, ts timestamp"


def put(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def counters(spark, out):
    return sorted(map(tuple, live.read_live_usage(spark, out).collect()), key=repr)


def test_counters_equal_the_batch_form_in_any_order(spark, tmp_path):
    dice = random.Random(3)
    rows = [(i, f"o{i % 2}", "p", None if i % 9 == 0 else f"k{i % 4}", f"a{i % 3}", T0 + dt.timedelta(hours=dice.randrange(400))) for i in range(120)]
    rows += [(200, "o1", "p", "k1", "a1", None), (200, "o1", "p", "k1", "a1", None)]
    given = rows + dice.sample(rows, 40)
    dice.shuffle(given)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(0, len(given), 60):
        put(spark, given[i: i + 60], EVENTS, source)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    assert live.read_live_usage(spark, out).count() == 0
    live.live_usage(stream, out, delay="1 hour", every=2).awaitTermination()
    want = usage_by_agent(spark.createDataFrame(sorted(set(rows), key=repr), EVENTS), FACT)
    assert counters(spark, out) == sorted(map(tuple, want.collect()), key=repr)
    put(spark, given[:50], EVENTS, source)  # a whole file comes again, after a restart
    live.live_usage(stream, out, delay="1 hour", every=2).awaitTermination()
    assert counters(spark, out) == sorted(map(tuple, want.collect()), key=repr)


def test_reading_counters_opens_no_events(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    os.mkdir(source)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    for n in range(4):
        put(spark, [(100 * n + i, "o", "p", "k", "a", T0 + dt.timedelta(days=n)) for i in range(100)], EVENTS, source)
        live.live_usage(stream, out, every=2).awaitTermination()
    files = live.read_live_usage(spark, out).inputFiles()
    assert files and all("/base/" in f or "/deltas/" in f for f in files)
    assert [r.calls for r in live.read_live_usage(spark, out).collect()] == [400]
    assert len(live.numbered(spark, f"{out}/base")) == 2 and len(live.numbered(spark, f"{out}/deltas")) <= 4


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    """The step of a batch ran, but the stream ended before it was committed."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    os.mkdir(source)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    for n in range(4):
        put(spark, [(10 * n + i, "o", "p", "k", "a", T0 - dt.timedelta(days=n)) for i in range(10)], EVENTS, source)
    live.live_usage(stream, out, every=2).awaitTermination()
    before = counters(spark, out)
    last = max(int(n) for n in os.listdir(f"{out}/checkpoint/commits") if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{out}/checkpoint/commits/{name}"):
            os.remove(f"{out}/checkpoint/commits/{name}")
    live.live_usage(stream, out, every=2).awaitTermination()
    assert counters(spark, out) == before and before[0][-2] == 40


@pytest.mark.parametrize("every", [1, 50])
def test_bursts_reopen_and_equal_the_batch_form(spark, tmp_path, every):
    dice = random.Random(every)
    edge = T0.replace(minute=59, second=59)
    rows = [(f"o{i % 2}", edge + dt.timedelta(milliseconds=dice.randrange(20_000))) for i in range(90)]
    schema, source, out = "owner_id string, ts timestamp_ntz", str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(0, 90, 30):
        put(spark, rows[i: i + 30], schema, source)
        stream = spark.readStream.schema(schema).parquet(source)
        live.live_bursts(stream, out, every=every).awaitTermination()
        seen = [r for r in live.read_live_bursts(spark, out).collect()]
        want = jobs.debounced_reloads(spark.createDataFrame(rows[: i + 30], schema)).collect()
        assert sorted((r.owner_id, r.first_ts, r.last_ts, r.changes) for r in seen) == sorted(map(tuple, want))
        newest = max(t for _, t in rows[: i + 30])
        assert all(r.closed == (newest - r.last_ts > dt.timedelta(milliseconds=500)) for r in seen)
        assert any(r.closed for r in seen) and not all(r.closed for r in seen)


def test_watched_folder_over_four_looks_and_restarts(spark, tmp_path):
    folder, out = tmp_path / "packs" / "owner_id=ann", str(tmp_path / "seen")
    folder.mkdir(parents=True)
    good = {"name": "a", "scope": "work", "facts": [{"key": "k", "value": "v"}], "rules": []}

    def write(name, text, age):
        (folder / name).write_text(text)
        os.utime(folder / name, (1_700_000_000 + age, 1_700_000_000 + age))

    def look():
        had = live.numbered(spark, f"{out}/rows")
        live.watch_packs(spark, str(tmp_path / "packs"), out, availableNow=True).awaitTermination()
        new = [n for n in live.numbered(spark, f"{out}/rows") if n not in had]
        return sorted((r.owner_id, r.file, r.change, r.errors) for n in new for r in spark.read.parquet(f"{out}/rows/run={n}").collect())

    write("a.json", json.dumps(good), 0)
    write("b.json", json.dumps({**good, "name": "b"}), 0)
    write("same.json", json.dumps({**good, "name": "same"}), 0)
    write("notes.txt", "no pack", 0)
    assert look() == [("ann", n, "created", 0) for n in ("a.json", "b.json", "same.json")]
    write("a.json", "{broken", -500)  # an older version is put back
    (folder / "b.json").unlink()
    write("c.json", json.dumps({**good, "name": "c"}), 60)
    assert look() == [("ann", "a.json", "modified", 1), ("ann", "b.json", "deleted", None), ("ann", "c.json", "created", 0)]
    assert look() == []
    write("b.json", json.dumps({**good, "name": "b"}), 90)
    assert look() == [("ann", "b.json", "created", 0)]
    assert {r.file: r.errors for r in jobs.latest_packs(spark, out).collect()} == {"a.json": 1, "b.json": 0, "c.json": 0, "same.json": 0}
    shutil.rmtree(folder)
    assert {c for _, _, c, _ in look()} == {"deleted"} and jobs.latest_packs(spark, out).count() == 0


def test_a_running_watch_sees_a_change(spark, tmp_path):
    import time
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    query = live.watch_packs(spark, str(folder), out)
    try:
        (folder / "a.json").write_text('{"name": "a", "scope": "s"}')
        until = time.time() + 60
        while not live.numbered(spark, f"{out}/rows") and time.time() < until:
            time.sleep(0.5)
        assert [r.change for r in spark.read.parquet(f"{out}/rows").collect()] == ["created"]
    finally:
        query.stop()

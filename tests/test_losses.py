"""Nothing is lost: accesses, late events, rewritten files, trailing text, damaged exports, owners of pack files."""

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from factbase.functions import secrets, templates
from factbase.operators import access, extract, render, repo, usage, validate
from factbase.sources import chats, packs
from factbase.streaming import jobs

T0 = dt.datetime(2024, 1, 1, 10, 0, 0)


def test_pack_read_counts_once(spark):
    requests = spark.createDataFrame(
        [("o", "claude", "pack", "p", None, T0), ("o", "claude", "all", None, "work", T0 + dt.timedelta(hours=1)),
         ("o", "claude", "all", None, None, T0)],
        "owner_id string, agent string, tool string, pack_arg string, scope_arg string, ts timestamp_ntz")
    visible = spark.createDataFrame([("o", "claude", "p"), ("o", "claude", "q")], "owner_id string, agent string, pack string")
    both = spark.createDataFrame([("o", "p", "work"), ("o", "q", "home")], "owner_id string, pack string, scope string")
    facts = spark.createDataFrame([("o", "p", f"k{i}", i, "high") for i in range(3)] + [("o", "q", "z", 0, "high")],
                                  "owner_id string, pack string, key string, pos long, confidence string")
    log = usage.serve_log(requests, visible, facts, both)
    by_pack = {r.pack: (r.calls, r.last_called) for r in usage.usage_by_pack(log).collect()}
    assert by_pack == {"p": (3, T0 + dt.timedelta(hours=1)), "q": (1, T0)}  # the scoped request leaves q alone
    by_fact = {(r.pack, r.key): r.calls for r in usage.usage_by_fact(log).collect()}
    assert by_fact == {("p", f"k{i}"): 1 for i in range(3)}
    ranked = usage.rank_facts(usage.priority_scores(facts, usage.usage_by_fact(log))).collect()
    assert {r.key: r.calls for r in ranked} == {"k0": 1, "k1": 1, "k2": 1, "z": 0}
    only_facts = log.where("key is not null")
    assert usage.usage_by_pack(only_facts).count() == 0
    assert usage.reset_usage(only_facts, "p")[1].first().cleared == 3
    assert usage.reset_usage(log, "p")[1].first().cleared == 4


def test_late_and_replayed_events_count_once(spark, tmp_path):
    schema = "event_id long, owner_id string, pack string, key string, agent string, ts timestamp"
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for rows in ([(1, "o", "p", "k", "a", T0)], [(2, "o", "p", "k", "a", T0 - dt.timedelta(days=3)), (1, "o", "p", "k", "a", T0)],
                 [(3, "o", "p", "k", "a", T0 + dt.timedelta(days=1)), (3, "o", "p", "k", "a", T0 + dt.timedelta(days=1))]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.usage_counters(stream(), str(tmp_path / "out")).awaitTermination()
    assert [r.calls for r in jobs.read_usage_counters(spark, str(tmp_path / "out")).collect()] == [3]


def test_rewritten_and_deleted_files_are_seen(spark, tmp_path):
    folder, out = tmp_path / "packs" / "owner_id=ann", str(tmp_path / "seen")
    folder.mkdir(parents=True)
    good = {"name": "a", "scope": "work", "facts": [{"key": "k", "value": "v"}], "rules": []}

    def put(name, text, age):
        (folder / name).write_text(text)
        os.utime(folder / name, (1_700_000_000 + age, 1_700_000_000 + age))

    def look(run):
        rows = jobs.pack_changes(spark, str(tmp_path / "packs"), out, run).collect()
        return sorted((r.file, r.change, r.errors) for r in rows)

    put("a.json", json.dumps(good), 0)
    put("b.json", json.dumps({**good, "name": "b"}), 0)
    assert look(1) == [("a.json", "created", 0), ("b.json", "created", 0)]
    put("a.json", "{broken", 60)
    (folder / "b.json").unlink()
    put("c.json", json.dumps({**good, "name": "c"}), 60)
    assert look(2) == [("a.json", "modified", 1), ("b.json", "deleted", None), ("c.json", "created", 0)]
    assert look(3) == []
    latest = jobs.latest_packs(spark, out)
    assert sorted((r.file, r.errors) for r in latest.collect()) == [("a.json", 1), ("c.json", 0)]
    read = packs.read_packs(latest, "2024-02-01 00:00:00")
    assert [(r.owner_id, r.pack) for r in read[0].collect()] == [("ann", "c")] and read[1].count() == 1


def test_debounced_buckets_and_stream_agree(spark, tmp_path):
    edge = T0.replace(minute=0, second=59)
    times = [edge + dt.timedelta(milliseconds=x) for x in (700, 900, 1100, 1500, 9000)] + [T0 + dt.timedelta(hours=1, milliseconds=-200),
                                                                                        T0 + dt.timedelta(hours=1, milliseconds=100)]
    changes = spark.createDataFrame([("o", t) for t in times], "owner_id string, ts timestamp_ntz")
    want = [(times[0], times[3], 4), (times[4], times[4], 1), (times[5], times[6], 2)]
    for bucket in ("day", "hour", "minute", "second"):
        got = sorted((r.first_ts, r.last_ts, r.changes) for r in jobs.debounced_reloads(changes, bucket).collect())
        assert got == want, bucket
    for part in (times[3:], times[:3]):  # later changes first
        spark.createDataFrame([("o", t) for t in part], "owner_id string, ts timestamp_ntz").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("owner_id string, ts timestamp_ntz").parquet(str(tmp_path / "in"))
        jobs.debounced_stream(stream, str(tmp_path / "out")).awaitTermination()
    got = sorted((r.first_ts, r.last_ts, r.changes) for r in jobs.read_debounced(spark, str(tmp_path / "out"), "minute").collect())
    assert got == want


def test_one_document_and_nothing_else(spark):
    good = '{"name": "a", "scope": "work"}'
    docs = {"good": f" {good}\n", "trailing": good + " trailing {", "two": good + good, "pair": good + "," + good, "list": f"[{good}]",
            "early": "1,0],[2", "empty": "", "null": None, "cut": good[:-1]}
    raw = spark.createDataFrame(list(docs.items()), "file string, doc string")
    codes = {r.file: r.code for r in validate.validate_packs(raw).collect()}
    assert codes == {k: "root_not_mapping" if k == "list" else "unreadable" for k in docs if k != "good"}
    assert [r.file for r in packs.judge_packs(raw).where("good").collect()] == ["good"]
    answers = spark.createDataFrame([("o", 1, '{"facts": []} and {"x": 1}'), ("o", 2, 'so: {"facts": []}')], "owner_id string, batch_no long, raw string")
    assert [r.batch_no for r in extract.parse_extractions(answers).select("batch_no").collect()] == [2]


def test_damaged_exports_leave_a_row(spark):
    tree = '[{"mapping": {"a": {"message": {"author": {"role": "user"}, "content": {"parts": ["hello there"]}}}}}]'
    flat = '[{"messages": [{"role": "user", "content": "hello"}]}]'
    rows = [("o", "tree", tree), ("o", "cut", tree[:-1]), ("o", "more", tree + " []"), ("o", "text", '"x"'), ("o", "flat", flat), ("o", "none", None)]
    exports = spark.createDataFrame(rows, "owner_id string, file string, doc string")
    bad = {r.file: r.error for r in chats.unreadable_exports(exports, "flat").collect()}
    assert bad == {"cut": "unreadable", "more": "unreadable", "text": "unexpected str", "none": "unreadable"}
    assert {r.file for r in chats.read_chat_tree(exports).collect()} == {"tree"}
    assert {r.file for r in chats.read_chat_flat(exports).collect()} == {"flat"}


def test_pack_files_keep_owner_and_parts(spark, tmp_path):
    when = dt.datetime(2024, 1, 1)
    heads = spark.createDataFrame([(o, p, "work", None, when, when, "0.1.0") for o in ("ann", "bo b") for p in ("p", "q")],
                                  "owner_id string, pack string, scope string, description string, created_at timestamp_ntz, updated_at timestamp_ntz, schema_version string")
    facts = spark.createDataFrame([(o, "p", i, f"k{i}", [f"v{o}{i}"], False, "context", "high", None, None) for o in ("ann", "bo b") for i in range(2500)],
                                  "owner_id string, pack string, pos long, key string, value_items array<string>, value_is_list boolean, type string, confidence string, source string, updated_at timestamp_ntz")
    rules = spark.createDataFrame([("ann", "q", 3, "do", 5)], "owner_id string, pack string, pos long, instruction string, priority int")
    packs.write_packs(heads, facts, rules, str(tmp_path / "w"), "2024-02-01 00:00:00")
    raw = packs.raw_packs_from_json(spark, str(tmp_path / "w"), lines=True)
    p, f, r = packs.read_packs(raw, "2024-02-01 00:00:00")
    assert sorted((x.owner_id, x.pack) for x in p.collect()) == [("ann", "p"), ("ann", "q"), ("bo b", "p"), ("bo b", "q")]
    assert sorted((x.owner_id, x.pos, x.value_items[0]) for x in f.collect()) == sorted((o, i, f"v{o}{i}") for o in ("ann", "bo b") for i in range(2500))
    assert [tuple(x) for x in r.select("owner_id", "pack", "pos", "instruction", "priority").collect()] == [("ann", "q", 3, "do", 5)]


def test_one_document_of_a_pack_and_readable_dates(spark):
    doc = lambda value, when: json.dumps({"name": "a", "scope": "work", "meta": {"created_at": when},
                                          "facts": [{"key": "k", "value": value}, {"key": "l", "value": value}]})
    raw = spark.createDataFrame([("2.json", doc("second", "2024-01-01")), ("1.json", doc("first", "2024-01-01")), ("0.json", doc("x", "some day"))],
                                "file string, doc string")
    p, f, _ = packs.read_packs(raw, "2024-02-01 00:00:00")
    assert p.count() == 1 and sorted((r.pos, r.value_items[0]) for r in f.collect()) == [(0, "first"), (1, "first")]
    assert [r.file for r in packs.split_valid_packs(raw)[1].collect()] == ["0.json"]


def test_no_caps(spark):
    messages = spark.createDataFrame([("o", f"c{i}", i, "m" * (600 + i)) for i in range(700)], "owner_id string, conv_id string, pos long, text string")
    batches = extract.extraction_batches(messages)
    assert batches.agg(F.sum("n")).first()[0] == 700
    assert batches.where(F.contains("prompt", F.lit("m" * 1299))).count() == 1
    assert extract.extraction_batches(messages, max_batches=2, line_chars=10).agg(F.sum("n"), F.max(F.length("prompt"))).first()[0] == 100
    files = spark.createDataFrame([("o", f"/home/u/r{i}/.git", T0 + dt.timedelta(days=i), "") for i in range(30)],
                                  "owner_id string, path string, mtime timestamp_ntz, content string")
    roots = spark.createDataFrame([("o", "/home/u")], "owner_id string, root string")
    found = repo.discover_repos(files, roots).orderBy("rank").collect()
    assert [r.name for r in found] == [f"r{i}" for i in reversed(range(30))]
    assert repo.discover_repos(files, roots, 3).count() == 3
    lines = spark.createDataFrame([("o", "p", 0, "", 0, i, f"line {i}") for i in range(2500)],
                                  "owner_id string, pack string, block int, ord string, ord_n long, pos long, line string")
    parts = render.assemble(lines, ["owner_id", "pack"], ["block", "ord", "ord_n", "pos"]).orderBy("part").collect()
    assert "\n".join(r.text for r in parts) == "\n".join(f"line {i}" for i in range(2500)) and len(parts) == 3


def test_fixed_values():
    """Values that must stay as they are, spelled out."""
    assert (usage.W_USAGE, usage.W_FRESHNESS, usage.W_CONFIDENCE, usage.THRESHOLD) == (0.4, 0.4, 0.2, 70.0)
    assert usage.CONF_WEIGHT == {"high": 1.0, "medium": 0.66, "low": 0.33}
    assert jobs.GAP_MS == 500 and extract.BATCH == 50
    assert len(secrets.PATTERNS) == 27 and len(templates.TEMPLATES) == 14
    assert repo.EXTENSIONS[".py"] == "Python" and repo.EXTENSIONS[".rs"] == "Rust"
    assert access.ALIASES and all(k == k.lower() for k in access.ALIASES)


def test_damaged_exports_of_all_layouts(spark):
    from factbase.plans import catalog_chat
    from factbase.plans.catalog import spark_queries
    from factbase.plans.fixtures import Views
    folder, want = "/root/testdata/sf0.001", set()
    for r in catalog_chat._broken(Views(spark, folder)).collect():
        try:
            doc = json.loads(r.doc)
        except ValueError:
            continue
        for c, conv in enumerate(doc if isinstance(doc, list) else [doc] if isinstance(doc, dict) else []):
            first = "chat_messages" in conv
            for n, m in enumerate(conv.get("chat_messages") or conv.get("messages") or [conv]):
                body = m.get("text", m.get("content"))
                if m.get("sender", m.get("role")) in ("human", "user"):
                    for k, text in enumerate([body] if isinstance(body, str) else [x["text"] for x in body if x["type"] == "text"]):
                        if text or not first:
                            want.add((r.owner_id, r.file, c, n * 1048576 + k, text))
    got = spark_queries()["read_chat_damaged_layouts"](spark, folder).select("owner_id", "file", "conv_no", "pos", "text").collect()
    assert {int(w[1][1:]) % 5 for w in want} == {0, 1, 2, 3, 4}
    assert len(got) == len(want) and set(map(tuple, got)) == want

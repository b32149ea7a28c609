"""Single rules on tiny tables."""

import io
import json
import random
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from factbase.functions.values import age_days, bucketed_rank, running_max_before, strip
from factbase.operators import (access, audit, chat, decay, diff, extract, freshness, health, incremental, mutate,
                                provision, render, repo, search, usage, validate)
from factbase.schema import FACTS, PACKS, RULES
from factbase.sources import chats, packs as pack_source
from factbase.streaming import jobs

AS_OF = "2024-02-01 00:00:00"
NOW = datetime(2024, 2, 1)


def fact(key="k", value="v", pack="p", pos=0, type="context", confidence="high", source=None, updated_at=None, owner="o"):
    items = value if isinstance(value, list) else [value]
    return dict(owner_id=owner, pack=pack, pos=pos, key=key, value_items=items, value_is_list=isinstance(value, list),
                type=type, confidence=confidence, source=source, updated_at=updated_at)


def facts_of(spark, *rows):
    return spark.createDataFrame(list(rows), FACTS)


def packs_of(spark, *names, created=NOW, updated=NOW, description="d", scope="work"):
    return spark.createDataFrame([dict(owner_id="o", pack=n, scope=scope, schema_version="0.1.0", created_at=created,
                                       updated_at=updated, description=description, tags=[]) for n in names], PACKS)


def rules_of(spark, *rows):
    return spark.createDataFrame([dict(owner_id="o", pack="p", pos=i, instruction=t, priority=p)
                                  for i, (t, p) in enumerate(rows)], RULES)


def test_strip_and_age(spark):
    df = spark.createDataFrame([(" \t a b \n", NOW - timedelta(hours=12), NOW + timedelta(hours=1))],
                               "t string, a timestamp_ntz, b timestamp_ntz")
    row = df.select(strip("t").alias("t"), age_days(AS_OF, "a").alias("a"), age_days(AS_OF, "b").alias("b")).first()
    assert (row.t, row.a, row.b) == ("a b", 0, -1)


def test_distributed_rank_and_running_max(spark):
    rng = random.Random(3)
    rows = [("g" if rng.random() < 0.8 else "h", i * 40000, rng.randrange(5)) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, pos long, s int")
    ranked = bucketed_rank(df, ["g"], {"_a": -F.col("s"), "_b": F.shiftright("pos", 20)}, [F.col("pos")], "r")
    for g in "gh":
        want = [p for _, p, _ in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))]
        assert [r.pos for r in ranked.where(F.col("g") == g).orderBy("r").collect()] == want
    got = {(r.g, r.pos): r.m for r in running_max_before(df, ["g"], "pos", "s", "m").collect()}
    for g, p, _ in rows:
        before = [s for x, q, s in rows if x == g and q < p]
        assert got[(g, p)] == (max(before) if before else None)


@pytest.mark.parametrize("calls,want", [(0, 0.0), (1000, 100.0), (5000, 100.0)])
def test_usage_norm(spark, calls, want):
    assert spark.range(1).select(usage.usage_norm(F.lit(calls)).alias("x")).first().x == pytest.approx(want)


def test_priority_uses_given_freshness(spark):
    facts = facts_of(spark, fact()).withColumn("fresh", F.lit(80))
    log = spark.createDataFrame([], "owner_id string, pack string, key string, agent string, ts timestamp_ntz")
    assert usage.priority_scores(facts, usage.usage_by_fact(log), F.col("fresh")).first().score == 52.0


def test_decay_and_freshness(spark):
    rows = [fact("a", type="context", updated_at=NOW - timedelta(days=365)), fact("b", pos=1, type="identity", updated_at=NOW - timedelta(days=900)),
            fact("c", pos=2, type="skill", updated_at=NOW - timedelta(days=170)), fact("d", pos=3, type="skill", updated_at=NOW)]
    facts, packs = facts_of(spark, *rows), packs_of(spark, "p")
    status = {r.key: r.status for r in decay.decay_status(facts, packs, AS_OF).collect()}
    assert status == {"a": "expired", "b": "preserved", "c": "warning", "d": "preserved"}
    assert decay.apply_decay(facts, packs, AS_OF).count() == 3
    scores = {r.key: (r.freshness, r.label) for r in freshness.fact_freshness(facts, packs, AS_OF).collect()}
    assert scores == {"a": (0, "expired"), "b": (100, "fresh"), "c": (53, "aging"), "d": (100, "fresh")}
    assert freshness.pack_freshness(facts.limit(0), packs, AS_OF).first().score == 100


def test_agents_and_permissions(spark):
    rq = spark.createDataFrame([(1, "CLAUDE", None), (2, None, "cursor/0.42 VSCode"), (3, "openai-x", "cursor/1"), (4, None, None),
                                (5, " me ", None), (6, "", "curl/8")], "id int, agent_id string, user_agent string")
    got = {r.id: r.agent for r in access.resolve_agents(rq).collect()}
    assert got == {1: "claude", 2: "cursor", 3: "chatgpt", 4: "unknown", 5: "me", 6: "curl"}
    pm = spark.createDataFrame([("o", "claude", False, ["p"]), ("o", "cursor", False, []), ("o", "default", False, ["q"])],
                               "owner_id string, agent string, allow_all boolean, packs array<string>")
    who = spark.createDataFrame([("o", "claude"), ("o", "cursor"), ("o", "x"), ("n", "x")], "owner_id string, agent string")
    rules = {(r.owner_id, r.agent): (r.allow_all, r.packs) for r in access.allowed_packs(who, pm).collect()}
    assert rules == {("o", "claude"): (False, ["p"]), ("o", "cursor"): (False, ["q"]), ("o", "x"): (False, ["q"]), ("n", "x"): (True, [])}
    changes = spark.createDataFrame([("n", 1, "set", "claude", ["a"]), ("o", 2, "reset", None, None)],
                                    "owner_id string, seq long, action string, agent string, packs array<string>")
    after = {(r.owner_id, r.agent): r.rule for r in access.list_permissions(access.apply_permission_changes(pm, changes)).collect()}
    assert after == {("n", "claude"): "a", ("n", "default"): "all"}


def test_diff_rules(spark):
    a = facts_of(spark, fact("x", ["A", "B"]), fact("y", " Py ", pos=1), fact("z", "1", pos=2), fact("l", ["a", "b"], pos=3))
    b = facts_of(spark, fact("x", ["B", "A", "A"]), fact("y", "py", pos=1), fact("w", "2", pos=2), fact("l", "A, B", pos=3))
    got = {r.key: r.status for r in diff.diff_packs(a, b).collect()}
    assert got == {"x": "matching", "y": "matching", "z": "only_in_source", "w": "only_in_target", "l": "matching"}


def test_writes(spark):
    facts, packs = facts_of(spark, fact("a", "1"), fact("a", "2", pos=1)), packs_of(spark, "p")
    w = spark.createDataFrame([("o", "p", 1, "a", ["9"], False, None), ("o", "p", 2, "n", ["x"], False, "skill"),
                               ("o", "p", 3, "n", ["y"], False, None), ("o", "gone", 4, "n", ["y"], False, None)],
                              "owner_id string, pack string, seq long, key string, value_items array<string>, value_is_list boolean, type string")
    got = sorted((r.key, r.pos, r.value_items[0], r.type, r.source) for r in mutate.upsert_facts(facts, packs, w, AS_OF).collect())
    assert got == [("a", 0, "9", "context", "mcp"), ("a", 1, "2", "context", None), ("n", 4, "y", "skill", "mcp")]
    adds = spark.createDataFrame([("o", "p", 1, "a", "x, ,y", "style")], "owner_id string, pack string, seq long, key string, value string, type string")
    row = mutate.replace_facts(facts, packs, adds, AS_OF).first()
    assert (row.value_items, row.value_is_list, row.type) == (["x", "y"], True, "style")


def test_validation_codes(spark):
    docs = {"ok": {"name": "p", "scope": "s"}, "up": {"name": "Pack", "scope": "s"}, "bool": {"name": "p", "scope": "s", "rules": [{"instruction": "i", "priority": True}]},
            "rng": {"name": "p", "scope": "s", "rules": [{"instruction": "i", "priority": 11}]}, "null": {"name": None, "scope": "s"},
            "many": {"facts": [{"key": 1, "value": []}, 3]}}
    df = spark.createDataFrame([(k, json.dumps(d)) for k, d in docs.items()] + [("broken", "{")], "file string, doc string")
    got = {}
    for r in validate.validate_packs(df).collect():
        got.setdefault(r.file, set()).add(r.code)
    assert got == {"up": {"name_bad_start"}, "rng": {"rule_priority_range"}, "null": {"name_not_string"}, "broken": {"unreadable"},
                   "many": {"missing_name", "missing_scope", "fact_key_not_string", "fact_value_empty", "fact_not_mapping"}}


def test_packs_round_trip(spark, tmp_path):
    facts = facts_of(spark, fact("a", ["x", 'q"'], type="skill", confidence="low", source="manual", updated_at=NOW), fact("b", "y\nz", pos=1), fact("c", "late", pos=7))
    packs, rules = packs_of(spark, "p", description=None), rules_of(spark, ("r", 0), ("s", 9))
    docs = pack_source.pack_documents(packs, facts, rules, AS_OF, part_rows=5)
    assert docs.count() == 2  # position 7 goes to a second part
    raw = docs.select(F.concat("pack", F.lit("-"), "part", F.lit(".json")).alias("file"), "doc", "owner_id")
    p, f, r = pack_source.read_packs(raw, AS_OF)
    key = lambda x: (x.pos, x.key, x.value_items, x.value_is_list, x.type, x.confidence, x.source, x.updated_at)
    assert sorted(map(key, f.collect())) == sorted(map(key, facts.collect()))
    assert sorted((x.pos, x.instruction, x.priority) for x in r.collect()) == [(0, "r", 0), (1, "s", 9)]
    assert p.count() == 1
    pack_source.write_packs(packs, facts, rules, str(tmp_path / "out"), AS_OF)
    assert spark.read.text(str(tmp_path / "out")).count() == 1


def test_secrets(spark):
    texts = spark.createDataFrame([(1, "key AKIA" + "A1B2" * 4 + " and a@b.co"), (2, "nothing here")], "id int, text string")
    got = sorted((r.id, r.pattern, r.preview) for r in audit.audit_findings(texts).collect())
    assert got == [(1, "AWS Access Key", "AKIA...********"), (1, "Email Address", "***REDACTED***")]  # a short hit is masked whole
    assert audit.scrub_secrets(texts).where("id = 1").first().text == "key [REDACTED] and a@b.co"
    facts = facts_of(spark, fact("a", ["x", "ghp_" + "aB3d" * 9]))
    assert audit.redact_facts(facts).first().value_items == ["x", "ghp_...********"]


def test_health(spark):
    facts = facts_of(spark, *[fact(f"k{i}", "v", pos=i) for i in range(50)])
    packs, rules = packs_of(spark, "p", updated=NOW - timedelta(days=100)), rules_of(spark).limit(0)
    owners = spark.createDataFrame([("o",), ("none",)], "owner_id string")
    issues = health.diagnose(facts, rules, packs, AS_OF, owners)
    assert sorted(r.code for r in issues.where("owner_id = 'o'").collect()) == ["no_development_pack", "no_rules", "stale_pack", "too_many_facts"]
    scores = {r.owner_id: (r.score, r.band) for r in health.health_score(issues, owners).collect()}
    assert scores == {"o": (81, "good"), "none": (0, "needs work")}


def test_chat_archives(spark, tmp_path):
    export = [{"title": "t", "mapping": {"b": {"message": {"author": {"role": "user"}, "content": {"parts": ["  hello world ", {"i": 1}, "hi"]}}},
                                         "a": {"message": {"author": {"role": "assistant"}, "content": {"parts": ["ignored text"]}}},
                                         "c": {"message": None}}}]
    for name, entries in {"a.zip": {"x/conversations.json": export}, "b.zip": {"notes.txt": {}}}.items():
        with zipfile.ZipFile(tmp_path / name, "w") as zf:
            for entry, data in entries.items():
                zf.writestr(entry, json.dumps(data))
    rows = chats.read_export_archives(spark, str(tmp_path), "tree")
    assert rows.where("error is not null").count() == 1
    msgs = chats.read_chat_tree(rows.where("error is null").withColumn("owner_id", F.lit("o")))
    assert [r.text for r in msgs.collect()] == ["hello world"]


def test_chat_flat_layouts(spark):
    docs = [[{"chat_messages": [{"sender": "human", "text": "one"}, {"sender": "assistant", "text": "no"}, {"role": "user", "content": [{"type": "text", "text": "two"}]}]}],
            {"messages": [{"role": "user", "content": ""}, {"sender": "human", "text": "three"}]}, [{"role": "human", "content": "four"}, {"role": "x", "content": "no"}]]
    df = spark.createDataFrame([("o", str(i), json.dumps(d)) for i, d in enumerate(docs)], "owner_id string, file string, doc string")
    assert sorted(r.text for r in chats.read_chat_flat(df).collect()) == ["", "four", "one", "three", "two"]


def test_self_identification_variants(spark):
    m = spark.createDataFrame([("o", "1", 1, "I am a software engineer."), ("o", "1", 2, "I work at Acme Corp. ok"), ("o", "1", 3, "I'm learning Rust, slowly")],
                              "owner_id string, conv_id string, pos long, text string")
    assert {r.key: r.value_items[0] for r in chat.self_identification(m).collect()} == {"company": "Acme Corp", "learning": "Rust"}
    assert "role" in {r.key for r in chat.self_identification(m, fixed=True).collect()}


def test_merge_extracted(spark):
    x = spark.createDataFrame([("o", 1, "l", ["a"], True, "low"), ("o", 2, "l", ["b", "c"], True, "high"), ("o", 3, "l", ["c", "d"], True, "medium"),
                               ("o", 4, "l", ["z"], False, "low"), ("o", 5, "", ["e"], False, "high")],
                              "owner_id string, pos long, key string, value_items array<string>, value_is_list boolean, confidence string")
    items = [r.item for r in extract.merged_items(x).orderBy("from_pos", "item_no").collect()]
    assert items == ["b", "c", "d"]
    w = extract.merge_extracted_facts(x).collect()
    assert [(r.key, r.pos, r.first_pos) for r in w] == [("l", 2, 1)]


def test_templates_and_answers(spark):
    rq = spark.createDataFrame([("o", 1, "writer", None, None), ("o", 2, "writer", None, None), ("o", 3, "nope", None, None), ("o", 4, None, "mine", None)],
                               "owner_id string, seq long, template string, pack_name string, scope string")
    out = provision.instantiate_templates(rq, packs_of(spark, "old"))
    assert sorted(r.pack for r in out["packs"].collect()) == ["mine", "writer"]
    assert {(r.seq, r.reason) for r in out["rejected"].collect()} == {(2, "exists"), (3, "unknown template")}
    assert out["facts"].count() == 4 and out["rules"].count() == 4
    an = spark.createDataFrame([("o", 1, "tone", "1"), ("o", 2, "rules", "No jargon, , No emojis"), ("o", 3, "role", "skip")],
                               "owner_id string, seq long, kind string, value string")
    made = provision.answers_to_packs(an)
    assert [r.pack for r in made["packs"].collect()] == ["writer"] and made["rules"].count() == 5


def test_repo_scan(spark):
    files = spark.createDataFrame([
        ("o", "/h/app/.git", NOW, None), ("o", "/h/app/src/main.py", NOW, ""), ("o", "/h/app/dist/x.py", NOW, ""),
        ("o", "/h/app/package.json", NOW, '{"dependencies":{"react":"1"}}'), ("o", "/h/app/tsconfig.json", NOW, "{}"),
        ("o", "/h/app/requirements.txt", NOW, "FastAPI\npandas"), ("o", "/h/app/AGENTS.md", NOW, "be kind"), ("o", "/h/venv/y/.git", NOW, None)],
        "owner_id string, path string, mtime timestamp_ntz, content string")
    roots = spark.createDataFrame([("o", "/h")], "owner_id string, root string")
    got = {r.key: r.value_items for r in repo.owner_stack(files, roots).collect()}
    assert got["languages.primary"] == ["Python"] and got["projects.recent"] == ["app"]
    assert sorted(got["frameworks"]) == ["FastAPI", "React", "TypeScript", "pandas"]
    rule = repo.existing_rule_files(files, roots).first()
    assert (rule.key, rule.value_items) == ("existing_rules.agents-md", ["Found in app: be kind"])


def test_hash_cache(spark):
    cur = spark.createDataFrame([("o", "a", "1"), ("o", "b", "2"), ("o", "c", None)], "owner_id string, source_key string, hash string")
    old = spark.createDataFrame([("o", "a", "1", NOW), ("o", "b", "x", NOW)], "owner_id string, source_key string, hash string, scanned_at timestamp_ntz")
    got = {r.source_key: r.changed for r in incremental.changed_sources(cur, old).collect()}
    assert got == {"a": False, "b": True, "c": True}


def test_cards_and_profiles(spark):
    facts = facts_of(spark, fact("identity.name", "Ada", type="identity"), fact("role", "Engineer", pos=1, type="identity"),
                     fact("languages.primary", ["Python", "Rust"], pos=2, type="skill"), fact("note", "x", pos=3)).withColumn("score", F.lit(60.0))
    packs, rules = packs_of(spark, "p"), rules_of(spark, ("Be brief", 5), ("No jargon", 8), ("Third", 9))
    card = render.identity_cards(packs, facts, rules).first().card
    assert card == "Ada — Engineer\nStack: primary: Python, Rust\nKey rules: Be brief | No jargon"
    empty = render.identity_cards(packs, facts.limit(0), rules.limit(0)).first().card
    assert empty == render.NO_CARD
    entries = render.compact_profiles(packs, facts, rules, freshness.owner_freshness(facts, packs, AS_OF)).collect()
    assert sorted(r.section for r in entries) == [0, 0, 1, 2, 3, 3, 3, 4]


def test_documents_in_order(spark, tmp_path):
    facts = facts_of(spark, fact("b", "2"), fact("a", "1", pos=1))
    packs, rules = packs_of(spark, "p"), rules_of(spark, ("low", 0), ("high", 8))
    lines = render.pack_prompt(packs, facts, rules)
    text = render.assemble(lines, ["owner_id"]).first().text
    assert text == ("## Context: p (work)\n\nd\n\n\n### Known facts\n- **a**: 1\n- **b**: 2\n\n"
                    "### Rules & preferences\n- [P8] high\n- low")
    render.write_documents(lines, str(tmp_path / "docs"))
    assert spark.read.text(str(tmp_path / "docs")).where("value <> ''").count() == 8
    assert search.search_context(packs, facts, rules, "HIGH").first().line == "[p/work] Rule: high"


def test_pack_watch_keeps_latest(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.json").write_text('{"name": "a", "scope": "s"}')
    jobs.pack_changes(spark, str(folder), out, 1)
    (folder / "b.json").write_text('{"scope": 1}')
    jobs.pack_changes(spark, str(folder), out, 2)
    assert {r.file: r.errors for r in jobs.latest_packs(spark, out).collect()} == {"a.json": 0, "b.json": 2}


def test_debounce_across_hours(spark):
    t = datetime(2024, 1, 1, 0, 59, 59, 800000)
    rows = [("o", t + timedelta(milliseconds=d)) for d in (0, 300, 600, 5000)]
    got = sorted((r.first_ts, r.changes) for r in jobs.debounced_reloads(
        spark.createDataFrame(rows, "owner_id string, ts timestamp_ntz")).collect())
    assert got == [(rows[0][1], 3), (rows[3][1], 1)]


def test_counters_survive_restart(spark, tmp_path):
    rows = [(i, "o", datetime(2024, 1, 1, 0, i), "p", "k", "claude") for i in range(4)]
    schema = "event_id long, owner_id string, ts timestamp, pack string, key string, agent string"
    src, out = str(tmp_path / "log"), str(tmp_path / "out")
    spark.createDataFrame(rows[:2], schema).write.parquet(src)
    read = lambda: spark.readStream.schema(schema).parquet(src)
    jobs.usage_counters(read(), out).awaitTermination()
    spark.createDataFrame(rows[1:], schema).write.mode("append").parquet(src)  # event 1 comes again
    jobs.usage_counters(read(), out).awaitTermination()
    assert jobs.read_usage_counters(spark, out).first().calls == 4


def test_worker_code_ships_with_the_job(spark):
    batches = spark.createDataFrame([("o", 0, "p1"), ("o", 1, "bad")], "owner_id string, batch_no long, prompt string")
    def model(prompt):
        if prompt == "bad":
            raise RuntimeError
        return "Sure ```json\n{\"facts\": []}```"
    raw = extract.extract_with_model(batches, model)
    assert [r.batch_no for r in extract.parse_extractions(raw).collect()] == [0]

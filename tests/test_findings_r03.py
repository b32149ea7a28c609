"""What the findings of round 3 were about, one test each."""

import io
import random
import zipfile
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrameReader
from pyspark.sql import functions as F

from factbase.operators import extract, multi_search, render, similar
from factbase.plans import catalog_jobs
from factbase.plans.fixtures import Views
from factbase.schema import FACTS, RULES
from factbase.sources import chats, packs
from factbase.streaming import jobs, live
from tests.test_similar import RANK, losers_by_rule, norm


def test_a_table_that_is_a_folder_streams_too(spark, tmp_path):
    rows = spark.range(100).withColumnRenamed("id", "doc_id")
    rows.repartition(3).write.parquet(str(tmp_path / "in" / "documents.parquet"))
    rows.repartition(2).write.parquet(str(tmp_path / "in" / "other.parquet"))
    out = str(tmp_path / "out")
    jobs.run_to_end(jobs.stream_table(spark, str(tmp_path / "in"), "documents.parquet"), out)
    assert sorted(r.doc_id for r in spark.read.parquet(f"{out}/rows").collect()) == list(range(100))


RARE = [""] * 8 + list("ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;")


def short_texts(seed, n):
    dice = random.Random(seed)
    words = ["large", "ring", "hot", "bolt", "ECONOMY", "Brand#7", "blue", "aaaa", "ab", "é"]
    return [" ".join(dice.choices(words, k=dice.randrange(1, 8))) for _ in range(n)] + ["a" * 190, "a" * 150 + "b", "ab" * 90, "z"]


def test_ratios_of_many_short_pairs_are_the_matchers(monkeypatch):
    texts = short_texts(3, 60)
    x, y = (v.ravel() for v in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    monkeypatch.setattr(similar, "PAIRS_AT_ONCE", 500)
    monkeypatch.setattr(similar, "REGIONS_AT_ONCE", 64)
    for threshold in (0.75, 0.3):
        got = similar._Ratios(similar._Profile(np.array(texts, dtype=object)), threshold).of(x, y)
        want = [SequenceMatcher(None, texts[a], texts[b]).ratio() for a, b in zip(x, y)]
        assert [None if np.isnan(r) else r for r in got] == [r if r >= threshold else None for r in want]


def test_short_texts_of_a_tile_need_no_matcher(monkeypatch):
    """Pairs of short texts went through the matcher one by one."""
    texts = sorted(set(short_texts(4, 60)))
    n = len(texts)
    tile = pd.DataFrame({"owner_id": "o", "pack": "p", "text_id": [f"t{i}" for i in range(n)], "text": texts, "first_pos": range(n),
                         "last_pos": [i + (9 if i % 3 == 0 else 0) for i in range(n)], "copies": 1,
                         "key_lo": [f"k{i}" for i in range(n)], "key_hi": [f"k{i}" for i in range(n)], "side": 2})
    want = {(a, b): (SequenceMatcher(None, texts[a], texts[b]).ratio(), SequenceMatcher(None, texts[b], texts[a]).ratio() if b < tile.last_pos[a] else 0)
            for a in range(n) for b in range(a + 1, n)}

    class Idle:
        def __init__(self, *texts):
            assert texts == (None,)

    monkeypatch.setattr(similar, "SequenceMatcher", Idle)
    out = similar._compare_tile(0.75)(tile)
    got = {(r.pos_a, r.pos_b): (r.similarity, r.reverse) for r in out.itertuples()}
    assert len(got) == len(out) and got.keys() == {p for p, r in want.items() if max(r) >= 0.75}
    assert all((g if g == g else 0) == (w if w >= 0.75 else 0) for p in got for g, w in zip(got[p], want[p]))


def test_long_texts_of_common_syllables_are_given_up_by_their_grams():
    """Each shared gram counted as a block of its own, so all long texts of one language went to the matcher."""
    dice = random.Random(5)
    syllables = [a + b for a in "thnrsl" for b in ("e", "an", "in", "on", "at", "er", "ed")]
    text = lambda: " ".join("".join(dice.choices(syllables, k=dice.randrange(1, 4))) + dice.choice(RARE) for _ in range(500))
    texts = [text() for _ in range(6)]
    texts.append(texts[0].replace("the", "lon", 9))
    profile = similar._Profile(np.array(texts, dtype=object))
    ratios = [SequenceMatcher(None, t, texts[6]).ratio() for t in texts[:6]]
    assert ratios[0] >= 0.75 > max(ratios[1:])
    assert profile.promising(np.arange(6), 6, 0.75).tolist() == [0] and profile.may_reach(0, 6, 0.75)


def test_tiles_of_candidates_are_spread_over_tasks(spark):
    """The join of tiles is small in bytes and was put into one task, though its work grows with the square of its rows."""
    facts = [dict(owner_id="o", pack=f"p{i % 9}", pos=i, key=f"k{i}", value_items=[f"blue ring {i % 40}"], value_is_list=False, type="skill",
                  confidence="high", source=None, updated_at=None) for i in range(200)]
    pairs = similar.candidate_pairs(spark.createDataFrame(facts, FACTS))
    assert len(pairs.select("pack").rdd.glom().map(len).filter(lambda n: n > 0).collect()) > 1


def test_parts_of_documents_are_made_one_at_a_time(spark):
    """An aggregate and a join held all parts of an owner that a task met."""
    packs = spark.createDataFrame([("o", "p", "work", None), ("o", "q", "work", None), ("bare", "p", "work", None)],
                                  "owner_id string, pack string, scope string, description string")
    facts = spark.createDataFrame([dict(owner_id="o", pack="pq"[i % 2], pos=i, key=f"k{i}", value_items=[f"v{i}"], value_is_list=False,
                                        type="skill", confidence="high", source=None, updated_at=None) for i in range(2500)], FACTS)
    rules = spark.createDataFrame([("o", "p", 0, "be short", 3)], "owner_id string, pack string, pos long, instruction string, priority int")
    out = render.custom_instructions_text(packs, facts, rules)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_list(struct(_n" not in plan and "line" in plan
    rows = {(r.owner_id, r.field, r.part): r.text for r in out.collect()}
    assert len(rows) == out.count() == 3 + 1 + 2
    heads = {f: "\n".join(["=" * 60, h, "=" * 60, "", ""]) for f, h in render.FIELDS}
    about = "".join(rows["o", "about_you", n] + "\n" for n in range(3))
    want = ["[WORK]", *[f"- k{i}: v{i}" for i in range(0, 2500, 2)], "", "[WORK]", *[f"- k{i}: v{i}" for i in range(1, 2500, 2)]]
    assert about == heads["about_you"] + "\n".join(want) + "\n"
    assert rows["o", "response_style", 0] == heads["response_style"] + "[WORK]\n- be short"
    assert rows["bare", "about_you", 0] == heads["about_you"] and rows["bare", "response_style", 0] == heads["response_style"]


def test_a_look_lists_its_folder_once(spark, tmp_path, monkeypatch):
    for i in range(3):
        (tmp_path / "in" / f"d{i}").mkdir(parents=True)
        (tmp_path / "in" / f"d{i}" / "a.json").write_text('{"name": "p%d"}' % i)
    loads = []
    for name in ("load", "text"):
        real = getattr(DataFrameReader, name)
        monkeypatch.setattr(DataFrameReader, name, lambda self, *a, _real=real, _name=name, **k: (loads.append(_name), _real(self, *a, **k))[1])
    live.look(spark, str(tmp_path / "in"), str(tmp_path / "out"), 1)
    assert loads == ["load"]
    assert sorted(r.doc for r in jobs.latest_packs(spark, str(tmp_path / "out")).collect()) == ['{"name": "p%d"}' % i for i in range(3)]


def test_files_of_documents_are_written_by_all_tasks(spark):
    docs = catalog_jobs._by_file(Views(spark, "/root/testdata/sf0.001"))
    assert docs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_many_searches_make_rows_only_for_what_they_find(spark, monkeypatch):
    """Candidates by grams of three characters were thousands of lines for a query that few lines hold."""
    dice = random.Random(5)
    parts = ["the", "re", "on", "an", "he", " ", "in", "é", "\0", "𝄞"]
    texts = ["".join(dice.choices(parts, k=400)) for _ in range(60)] + ["", "x" * 100, "ab" * 40]
    rules = spark.createDataFrame([("o", "p", i, t, 5) for i, t in enumerate(texts)] + [("o", "p", 0, texts[0], 5), ("o", "p", 0, "other", 5)], RULES)
    packs = spark.createDataFrame([("o", "p", "work")], "owner_id string, pack string, scope string")
    asked = [t[i:i + n] for t in texts[:40] for i, n in [(7, 1), (9, 2), (30, 6), (50, 9), (70, 31), (90, 60)]] + ["", "x" * 33, "bab", "other", None]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    every = [r.instruction for r in rules.collect()]
    want = sorted((i, len(t)) for i, q in enumerate(asked) if q is not None for t in every if q.lower() in t.lower())
    monkeypatch.setattr(multi_search, "GROUP_BYTES", 3000)
    monkeypatch.setattr(multi_search, "SLICE", 97)
    found = multi_search.search_many(packs, spark.createDataFrame([], FACTS), rules, queries, show=F.length)
    assert sorted((r.query_id, r.line - len("[p/work] Rule: ")) for r in found.collect()) == want
    lines = multi_search.search_lines(spark.createDataFrame([], FACTS), rules).withColumn("line_id", F.xxhash64("body").cast("string"))
    probes = spark.createDataFrame([(bytearray(q.encode()),) for q in {"", "thereonan", *(t[20:28] for t in texts[:9])}], "probe binary")
    hits = multi_search.probe_hits(lines.dropDuplicates(["line_id"]), probes).join(probes, "probe").count()
    truth = sum(p.probe.decode() in t for p in probes.collect() for t in set(every))
    assert hits == truth


def test_long_texts_of_a_tile_need_no_matcher(monkeypatch):
    """Long texts that are near each other went through the matcher, character by character."""
    dice = random.Random(8)
    words = ["the", "tion", "and ", "é", "42", "x", "q", "z.", "\n", "of", "𝄞", " "]
    texts = []
    for n in (90, 150, 400, 900):
        base = dice.choices(words, k=n)
        for _ in range(6):
            some = list(base)
            for _ in range(dice.choice([1, 10, 60])):
                at = dice.randrange(len(some))
                some[at:at + dice.randrange(4)] = dice.choices(words, k=dice.randrange(4))
            texts.append("".join(some))
    matcher, pairs = SequenceMatcher, [(a, b) for a in range(len(texts)) for b in range(len(texts))]
    wants = [matcher(None, texts[a], texts[b]).ratio() for a, b in pairs]
    monkeypatch.setattr(similar, "SequenceMatcher", None)
    profile = similar._Profile(np.array(texts, dtype=object))
    for threshold in (0.75, 0.3):
        got = [profile.blocks(b, texts[b]).ratio(texts[a], profile.places[a], threshold) for a, b in pairs]
        assert got == [w if w >= threshold else None for w in wants]
    monkeypatch.setattr(similar, "SequenceMatcher", matcher)
    monkeypatch.setattr(similar, "SEEDS", 100)
    assert [profile.blocks(b, texts[b]).ratio(texts[a], profile.places[a], 0.3) for a, b in pairs] == got


def test_archives_are_not_held_by_the_ten_thousand(spark):
    """Arrow batches held 10,000 archives, their exports and their rows at once."""
    def packed(*entries):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as zf:
            for name, text in entries:
                zf.writestr(name, text)
        return bytearray(buffer.getvalue())

    archives = [("a.zip", packed(("conversations-1.json", "[1]"), ("conversations-2.json", b"\xff"), ("notes.txt", "x"))),
                ("b.zip", packed(("notes.txt", "x"))), ("c.zip", bytearray(b"no archive")), ("d.zip", None)]
    found = chats.unpack_archives(spark.createDataFrame(archives, "path string, content binary"), "flat")
    rows = {r.file: (r.doc, r.error and r.error.split(":")[0]) for r in found.collect()}
    assert rows == {"a.zip!conversations-1.json": ("[1]", None), "a.zip!conversations-2.json": (None, "UnicodeDecodeError"),
                    "b.zip": (None, "ValueError"), "c.zip": (None, "BadZipFile"), "d.zip": (None, "BadZipFile")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "InPandas" not in plan and "Arrow" not in plan


def test_answers_of_a_model_are_parsed_once(spark):
    """The filter and each use of the parsed answer searched and parsed the text again."""
    answers = ['```json\n{"summary":"a"}\n```', 'Sure: {"summary":"b"} ok', "{broken", "[1]", '{"summary":"c"}', None, "none"]
    raw = spark.createDataFrame([("o", i, a) for i, a in enumerate(answers)], "owner_id string, batch_no long, raw string")
    said = extract.parse_extractions(raw).select("batch_no", F.try_variant_get("v", "$.summary", "string").alias("s"))
    assert sorted(map(tuple, said.collect())) == [(0, "a"), (1, "b"), (4, "c")]
    plan = said._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 1


def _rows(n, value, rng, owner="o"):
    return [dict(owner_id=owner, pack="pq"[rng.random() < 0.3], pos=i, key=f"k{rng.randrange(n // 2)}", value_items=[value(i)], value_is_list=False,
                 type="skill", confidence=rng.choice(["high", "medium", "low"]), source=None,
                 updated_at=rng.choice([None, datetime(2024, 1, 1) + timedelta(days=rng.randrange(9))])) for i in range(n)]


def test_removals_by_rounds_are_those_of_one_round(spark, monkeypatch):
    rng = random.Random(8)
    words = ["blue ring", "blue rings", "hot bolt", "hot bold", "steel plate no 7", "steel plates no 7", "x"]
    facts = [*_rows(150, lambda i: rng.choice(words) + rng.choice(["", " a", " of brand 12"]), rng),
             *_rows(40, lambda i: " ".join(rng.choices(words, k=30)) + f" {i // 3}", rng, "long"), *_rows(60, lambda i: " ".join(rng.choices("abcdefgh", k=9)), rng, "apart")]
    frame = spark.createDataFrame(facts, FACTS)
    want = {tuple(r) for r in similar.removals(frame, chunk=7).collect()}
    monkeypatch.setattr(similar, "HEAD", 4)
    monkeypatch.setattr(similar, "GROWTH", 3)
    got = similar.removals(frame, chunk=7).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 100
    assert {r[:3] for r in want} == losers_by_rule(facts)


def test_facts_that_are_gone_are_compared_with_nobody(spark, monkeypatch):
    """All pairs of a pack were compared, though nearly all of its facts are removed by a few."""
    monkeypatch.setattr(similar, "HEAD", 20, raising=False)
    made, cut = [], similar.cut_lineage

    def counted(df):
        made.append((out := cut(df)).count())
        return out

    monkeypatch.setattr(similar, "cut_lineage", counted)
    facts = [dict(owner_id="o", pack="p", pos=i, key=f"k{i}", value_items=[f"a large blue ring of brand {i}"], value_is_list=False, type="skill",
                  confidence="high", source=None, updated_at=None) for i in range(300)]
    gone = similar.removals(spark.createDataFrame(facts, FACTS)).collect()
    assert {(r.pos, r.by) for r in gone} == {(i, 0) for i in range(1, 300)}
    assert max(made) <= 300  # all pairs would be 44,850


def test_pack_documents_are_judged_once(spark):
    """Facts, rules and packs parsed and judged every document for themselves, twice each."""
    docs = ['{"name":"p","scope":"work","facts":[{"key":"k","value":"v"},{"key":"l","value":["a","b"]}],"rules":[{"instruction":"r"}]}',
            '{"name":"p","scope":"late","facts":[],"rules":[]}', '{"name":"q","scope":"work","facts":[{"key":"k"}],"rules":[]}', "{broken", None]
    raw = spark.createDataFrame([(f"{i}.json", d) for i, d in enumerate(docs)], "file string, doc string")
    out = packs.read_packs(raw, "2024-02-01 00:00:00")
    assert all("parse_json" not in df._jdf.queryExecution().optimizedPlan().toString() for df in out)
    heads, facts, rules = (df.collect() for df in out)
    assert [(r.pack, r.scope) for r in heads] == [("p", "work")] and [(r.pack, r.pos, r.instruction) for r in rules] == [("p", 0, "r")]
    assert sorted((r.pack, r.pos, r.key, r.value_items, r.value_is_list) for r in facts) == [
        ("p", 0, "k", ["v"], False), ("p", 1, "l", ["a", "b"], True)]


def test_a_consolidation_normalises_its_facts_once_for_digests_and_once_for_texts(spark, monkeypatch):
    """Every round, every step and the report itself normalised and sorted all values again, and looked for the copies twice."""
    monkeypatch.setattr(similar, "HEAD", 10)
    rng, plans, cut = random.Random(3), [], similar.cut_lineage
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(similar, "cut_lineage", lambda df: plans.append(plan(df)) or cut(df))
    words = ["blue ring", "blue rings", "hot bolt", "hot bold", "steel plate no 7", "x"]
    facts = _rows(120, lambda i: rng.choice(words) + rng.choice(["", " a", " of brand 12"]), rng)
    report = similar.consolidation_report(spark.createDataFrame(facts, FACTS))
    assert sum("value_items" in p for p in plans) == 2 and "value_items" not in plan(report)
    assert max(p.count("FlatMapGroupsInPandas") for p in plans) == 1  # the two orders of a pair compared all texts of a round twice
    rows, total = report.collect(), similar.consolidation_totals(report).first()
    gone = {(r.owner_id, r.pack, r.pos) for r in rows if r.step != "contradiction"}
    best = {}
    for f in sorted(facts, key=lambda f: (-RANK[f["confidence"]], f["updated_at"] or datetime.min, f["pack"], f["pos"])):
        best[f["key"], norm(f)] = f
    left = list(best.values())
    copies = {("o", f["pack"], f["pos"]) for f in facts if f not in left}
    texts = {f["key"]: {norm(g) for g in left if g["key"] == f["key"]} for f in left}
    assert len(copies) > 10 and gone == copies | losers_by_rule(left)
    assert (total.exact, total.similar, total.removed, total.contradictions, total.modified_packs) == (
        len(copies), len(losers_by_rule(left)), len(gone), sum(len(t) > 1 for t in texts.values()), len({g[1] for g in gone}))

"""Similarity against the plain pairwise rule, on small random packs."""

import random
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import numpy as np
import pytest

from factbase.operators import consolidate as C
from factbase.operators import similar
from factbase.schema import FACTS

RANK = {"high": 0, "medium": 1, "low": 2}


def better(a, b):
    ra, rb = RANK[a["confidence"]], RANK[b["confidence"]]
    if ra != rb:
        return ra < rb
    return (a["updated_at"] or datetime.min) >= (b["updated_at"] or datetime.min)


def norm(f):
    items = [x.lower().strip() for x in f["value_items"]]
    return ", ".join(sorted(items)) if f["value_is_list"] else items[0]


def sim(a, b):
    return SequenceMatcher(None, norm(a), norm(b)).ratio()


def losers_by_rule(facts):
    gone = set()
    for pack in sorted({(f["owner_id"], f["pack"]) for f in facts}):
        rows = sorted((f for f in facts if (f["owner_id"], f["pack"]) == pack), key=lambda f: f["pos"])
        out = set()
        for i, a in enumerate(rows):
            if i in out:
                continue
            for j in range(i + 1, len(rows)):
                b = rows[j]
                if j in out or a["key"] == b["key"] or sim(a, b) < 0.75:
                    continue
                out.add(j if better(a, b) else i)
        gone |= {(*pack, rows[i]["pos"]) for i in out}
    return gone


def make_facts(seed, unique_keys, n=40):
    rng = random.Random(seed)
    bases = ["prefers small pure functions", "prefers small pure function", "works with spark daily",
             "python and sql", "dark themes", "dark theme",
             "The quick Brown fox jumps over the Lazy dog, every day at 10:30. " * 5]
    facts = []
    for owner in ("a", "b"):
        for pos in range(n):
            text = rng.choice(bases)
            if rng.random() < 0.5:
                k = rng.randrange(len(text))
                text = text[:k] + rng.choice("xyzQ ") + text[k + rng.randrange(3):]
            is_list = rng.random() < 0.2
            facts.append({
                "owner_id": owner, "pack": rng.choice(["p", "q"]), "pos": pos,
                "key": f"k{pos}" if unique_keys else f"k{rng.randrange(6)}",
                "value_items": text.split(" ") if is_list else [text], "value_is_list": is_list, "type": "context",
                "confidence": rng.choice(list(RANK)), "source": None,
                "updated_at": rng.choice([None, datetime(2024, 1, 1) + timedelta(days=rng.randrange(40))])})
    return facts


@pytest.mark.parametrize("seed,unique_keys,chunk", [(1, True, 1000), (2, False, 5), (3, False, 1000)])
def test_losers_match_rule(spark, seed, unique_keys, chunk):
    facts = make_facts(seed, unique_keys)
    df = spark.createDataFrame(facts, FACTS)
    got = {tuple(r) for r in similar.similar_losers(df, chunk=chunk).collect()}
    assert got == losers_by_rule(facts)
    kept = similar.drop_similar_facts(df, chunk=chunk).count()
    assert kept == len(facts) - len(got)


def test_copies_with_rising_dates(spark):
    facts = [dict(owner_id="a", pack="p", pos=i, key=f"k{i}", value_items=["same text"], value_is_list=False, type="skill",
                  confidence="high", source=None, updated_at=datetime(2024, 1, 1) + timedelta(days=i)) for i in range(6)]
    got = {tuple(r) for r in similar.similar_losers(spark.createDataFrame(facts, FACTS)).collect()}
    assert got == losers_by_rule(facts) == {("a", "p", i) for i in range(5)}


def test_similar_texts_match_all_pairs(spark):
    facts = make_facts(5, True)
    df = spark.createDataFrame(facts, FACTS)
    got = {(r.owner_id, r.pack, r.pos_a, r.pos_b): r.similarity
           for r in similar.similar_facts(df, chunk=4).where("copies_a = 1 and copies_b = 1 and pos_a < pos_b").collect()}
    single = {}
    for f in facts:
        single.setdefault((f["owner_id"], f["pack"], norm(f)), []).append(f)
    singles = [v[0] for v in single.values() if len(v) == 1]
    want = {}
    for a in singles:
        for b in singles:
            if (a["owner_id"], a["pack"]) == (b["owner_id"], b["pack"]) and a["pos"] < b["pos"] and sim(a, b) >= 0.75:
                want[(a["owner_id"], a["pack"], a["pos"], b["pos"])] = sim(a, b)
    assert got == want


def test_bounds_never_lose_a_pair():
    rng = random.Random(7)
    alphabet = "etaoin shrdlu ETA.Q7éü"
    for _ in range(300):
        a = "".join(rng.choice(alphabet) for _ in range(rng.choice([30, 150, 260, 700])))
        rate = rng.choice([0.02, 0.1, 0.2, 0.3])
        b = "".join(c if rng.random() > rate else rng.choice(alphabet) for c in a)[rng.randrange(20):]
        true = SequenceMatcher(None, a, b).ratio()
        got = similar.ratio_from(SequenceMatcher(None, a, b), 0.75)
        assert got == (true if true >= 0.75 else None)
        profile = similar._Profile(np.array([a, b], dtype=object))
        if true >= 0.75:
            assert profile.may_reach(0, 1, 0.75)
            assert profile.promising(np.array([0]), 1, 0.75).tolist() == [0]


def test_exact_duplicates_keep_best(spark):
    base = dict(owner_id="a", key="editor", value_items=["Cursor"], value_is_list=False, type="preference", source=None)
    rows = [dict(base, pack="dev", pos=0, confidence="high", updated_at=None),
            dict(base, pack="work", pos=0, confidence="medium", updated_at=datetime(2024, 1, 1)),
            dict(base, pack="work", pos=1, confidence="high", updated_at=None)]
    df = spark.createDataFrame(rows, FACTS)
    got = {(r.removed_from, r.pos, r.kept_in) for r in C.exact_duplicates(df).collect()}
    assert got == {("dev", 0, "work"), ("work", 0, "work")}
    assert C.drop_exact_duplicates(df).count() == 1


@pytest.mark.parametrize("most", [40, 1_000_000])
def test_losers_by_ranges_and_by_walk(spark, monkeypatch, most):
    monkeypatch.setattr(similar, "SETTLE_EDGES", most)
    facts = make_facts(11, False)
    got = {tuple(r) for r in similar.similar_losers(spark.createDataFrame(facts, FACTS)).collect()}
    assert got == losers_by_rule(facts)


def test_copies_of_a_hot_text_give_few_edges(spark):
    rng = random.Random(4)
    n = 3000
    facts = [dict(owner_id="a", pack="p", pos=i, key=f"k{i % 3}", value_items=["the same text"], value_is_list=False, type="skill",
                  confidence=rng.choice(list(RANK)), source=None, updated_at=datetime(2024, 1, 1) + timedelta(days=rng.randrange(300)))
             for i in range(n)]
    df = spark.createDataFrame(facts, FACTS)
    todo, sure = similar._split_dominated(df)
    assert sure.count() == 0
    kills, beats = similar._fact_edges(todo, df, 0.75, 1000)
    assert kills.count() + beats.count() < 60 * n  # every copy meets stairs only; all pairs would be 1000 n
    got = {r.pos for r in similar.similar_losers(df).collect()}
    few = facts[:300]
    short = {tuple(r) for r in similar.similar_losers(spark.createDataFrame(few, FACTS)).collect()}
    assert short == losers_by_rule(few) and len(got) > n - 30


def test_long_chain_needs_no_rounds(spark, monkeypatch):
    """Each fact is similar to its neighbours only; the walk settles a chain at once."""
    calls = []
    cut = similar.cut_lineage
    monkeypatch.setattr(similar, "cut_lineage", lambda df: calls.append(1) or cut(df))
    kills = spark.range(1000).selectExpr("'a' as owner_id", "'p' as pack", "id as src", "id + 1 as pos")
    state = {r.pos: r.stands for r in similar._settle(kills).collect()}
    assert state == {i: i % 2 == 0 for i in range(1001)} and len(calls) == 1


def test_rounds_follow_edges_and_not_chains(spark, monkeypatch):
    """A chain of five ranges takes five rounds; a fact with more removers than a range has edges is one row of a later range."""
    monkeypatch.setattr(similar, "SETTLE_EDGES", 200)
    monkeypatch.setattr(similar, "POSITIONS", 64)
    calls = []
    cut = similar.cut_lineage
    monkeypatch.setattr(similar, "cut_lineage", lambda df: calls.append(1) or cut(df))
    rng = random.Random(6)
    edges = [("a", "chain", i, i + 1) for i in range(1000)]
    edges += [("a", "hot", i, 900) for i in range(900)] + [("a", "hot", i - 1, i) for i in range(1, 300)] + [("a", "hot", 900, 901)]
    edges += [("b", "mixed", *sorted(rng.sample(range(400), 2))) for _ in range(900)] + [("b", "small", 1, 2), ("b", "small", 2, 3)]
    kills = spark.createDataFrame(edges, "owner_id string, pack string, src long, pos long")
    got = {(r.owner_id, r.pack, r.pos): r.stands for r in similar._settle(kills).collect()}
    want: dict = {}
    for owner, pack, src, pos in sorted(edges, key=lambda e: e[3]):
        want.setdefault((owner, pack, src), True)
        want[owner, pack, pos] = want.get((owner, pack, pos), True) and not want[owner, pack, src]
    assert got == want and similar._settle(kills).count() == len(want)
    assert similar._ranges(kills.where("pack = 'chain'")).agg({"range": "max"}).first()[0] == 4
    assert len(calls) <= 2 * (2 + 6)


def test_report_lists_every_step(spark):
    base = dict(owner_id="a", pack="p", value_is_list=False, type="skill", source=None, updated_at=None)
    rows = [dict(base, pos=0, key="k", value_items=["works with spark daily"], confidence="high"),
            dict(base, pos=1, key="l", value_items=["works with spark daily!"], confidence="low"),
            dict(base, pos=2, key="m", value_items=["dark"], confidence="low"),
            dict(base, pos=3, key="m", value_items=["light and bright"], confidence="low"),
            dict(base, pack="q", pos=0, key="k", value_items=["works with spark daily"], confidence="medium")]
    df = spark.createDataFrame(rows, FACTS)
    report = similar.consolidation_report(df)
    got = {(r.step, r.pack, r.pos, r.kept_in, r.kept_pos) for r in report.collect()}
    assert got == {("exact", "q", 0, "p", 0), ("contradiction", "p", 2, None, None), ("contradiction", "p", 3, None, None),
                   ("similar", "p", 1, "p", 0)}
    total = similar.consolidation_totals(report).first()
    assert (total.exact, total.similar, total.removed, total.contradictions, total.modified_packs) == (1, 1, 2, 1, 2)
    assert similar.consolidate(df).count() == 3


def test_candidates_hold_every_similar_pair_and_no_text_moves(spark):
    facts = make_facts(7, True)
    frame = spark.createDataFrame(facts, FACTS)
    for chunk in (3, 1000):
        got = similar.candidate_pairs(frame, chunk=chunk)
        pairs = {(r.owner_id, r.pack, r.text_a, r.text_b) for r in got.collect()}
        assert len(pairs) == got.count() and "text" not in got.columns
        found = similar.similar_texts(frame, chunk=chunk).collect()
        assert found and {(r.owner_id, r.pack, r.text_a, r.text_b) for r in found} <= pairs

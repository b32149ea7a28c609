import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from factbase.llm.prefix_trie import EMPTY, ends_digest, prefix_trie, turn_digests
from factbase.llm.queries import rebuilt

SCHEMA = "conv_id long, turn long, role string, text string, digest int, pos string, node long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def ordered(rows):
    """Turns of each conversation, in order."""
    out = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        if c is not None:
            out[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    return {c: [x[3:] for x in sorted(v)] for c, v in out.items()}


def plain(convs):
    """Nodes by walking every prefix and every subtree."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    rows = []
    for node, cs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        ends = sorted(c for c in cs if len(convs[c]) == len(node))
        rows.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), sum(len(n) == len(node) + 1 for n in below),
                     sum(not any(m[:-1] == n for m in members if m) for n in below),
                     sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n),
                     hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(rows, key=repr)


def found(trie):
    rows = trie.nodes.join(ends_digest(trie.ends), "node", "left").fillna(EMPTY, ["ends_sha256"]).drop("node")
    return sorted(map(tuple, rows.collect()), key=repr)


def some(seed):
    dice, rows = random.Random(seed), []
    for c in dice.sample(range(-3, 400), 45):
        for turn in range(dice.choice([1, 2, 3, 5, 9, 14])):
            rows.append((c, dice.choice([turn, turn, turn, None, 3]), dice.choice(["user", "bot", None]), dice.choice(["", "ab", "xy\xe9", None])))
        if dice.random() < 0.3:
            rows += rows[-2:]
    return rows + [(None, 1, "user", "lost")]


@pytest.mark.parametrize("seed,block,stretch", [(1, 4, 256), (2, 2, 2), (3, 3, 1), (4, 1, 3), (5, 4, 1)])
def test_against_every_prefix(spark, seed, block, stretch):
    rows = some(seed)
    assert found(prefix_trie(turn_digests(frame(spark, rows)), block, stretch, width=16)) == plain(ordered(rows))


def test_rebuilt_conversations(spark):
    rows = [(c, t, "user", f"{c % 3} {t}") for c in [*range(0, 60), *range(100, 130), 200, *range(305, 320)] for t in range(1 + c % 7)]
    convs, want = ordered(rows), {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 6
        want[c] = convs.get(c - c % 100, [])[:h] + convs[c][h:]
    assert any(not t for t in want.values())
    turns = rebuilt(turn_digests(frame(spark, rows)))
    assert found(prefix_trie(turns)) == plain(want)


def test_hot_conversation_hot_number_and_copies(spark):
    """A third of all turns in one conversation, a third with one number, a third in copies of one conversation."""
    rows = [(1, t, "user", f"t{t}") for t in range(3000)] + [(2, None, "user", f"n{i % 1500}") for i in range(3000)]
    rows += [(c, t, "user", "same") for c in range(10, 1010) for t in range(3)]
    got = {(r[0], r[1]): r[2:] for r in found(prefix_trie(turn_digests(frame(spark, rows)), width=64))}
    assert len(got) == 1 + 3000 + 3000 + 3
    ends = hashlib.sha256(",".join(map(str, range(10, 1010))).encode()).hexdigest()
    assert got[10, 3] == (10, 1000, 0, 1, 999 * 4, ends)
    assert got[1, 0] == (None, 1002, 3, 3, 999 * 12, EMPTY)
    assert got[1, 3000] == (1, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())


def test_inner_turns_stay_closed_where_siblings_agree(spark):
    from factbase.llm.prefix_trie import _blocks, _opened
    from pyspark.sql import functions as F
    rows = [(c, t, "u", "a" if t < 6 else f"{c}") for c in (1, 2) for t in range(9)]
    placed = _blocks(turn_digests(frame(spark, rows)), 4, 256)
    groups = placed.groupBy("path").agg(F.count("*").alias("n"), F.min("conv_id").alias("owner"), *[F.first(c).alias(c) for c in placed.columns if c not in ("conv_id", "path")])
    split = {(r.depth, r.n): r.split for r in _opened(groups, 4).collect()}
    assert split == {(1, 2): False, (2, 2): False, (3, 2): False, (4, 2): False, (5, 1): True, (6, 1): True, (7, 1): True, (8, 1): True, (9, 1): False}


def test_no_conversations(spark):
    turns = turn_digests(frame(spark, []))
    assert turns.count() == 0 and prefix_trie(turns).nodes.count() == 0 and found(prefix_trie(rebuilt(turns))) == []

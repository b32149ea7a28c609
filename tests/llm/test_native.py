"""Sharding, chat rotation and URL verdicts against plain loops."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from factbase.llm.chat import rotate
from factbase.llm.queries import op1_sharding, op8_chat, op9_urls, table
from factbase.llm.sharding import BITS, shard
from factbase.llm.urls import judge

FOLDER = "/root/testdata/sf0.001"


def ring(rows, shards, vnodes, slack=0.0):
    """Walk the ring row by row: rows wait in ring order, a full shard lets them pass."""
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    cell = lambda d: int(d[:4], 16) >> (16 - BITS)
    crc = lambda t: None if t is None else zlib.crc32(t.encode())
    nodes = sorted((md5(f"node-{i}"), i // vnodes) for i in range(shards * vnodes))
    arcs = [[] for _ in nodes]
    for i, text in rows:
        key = str(i) if i is not None else f"text-{crc(text)}" if text is not None else "null"
        at = next((j for j, (d, _) in enumerate(nodes) if cell(d) >= cell(md5(key))), 0)
        size = len((text or "").encode()) + 16
        arcs[at].append((md5(key), i is not None, i or 0, text is not None, crc(text) or 0, size, i))
    n = len(rows)
    room = [n // shards + (s < n % shards) for s in range(shards)] if not slack else [-int(-n * (1 + slack) // shards)] * shards
    out, waiting, held = [], [], Counter()
    for lap in range(2):
        for j, (_, s) in enumerate(nodes):
            if not lap:
                waiting += sorted(arcs[j])
            while waiting and held[s] < room[s]:
                x = waiting.pop(0)
                out.append((x[-1], x[5], x[4] if x[3] else None, s, held[s]))
                held[s] += 1
    assert not waiting
    return out


@pytest.mark.parametrize("shards,vnodes,slack", [(3, 4, 0.0), (7, 16, 0.0), (5, 8, 0.25), (1, 1, 0.0)])
def test_ring(spark, shards, vnodes, slack):
    rng = random.Random(shards)
    rows = [(i, "x" * rng.randrange(40)) for i in range(300)] + [(None, "n")] * 40 + [(5, "x")] * 9 + [(7, None), (None, None)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, shard int, size int")
    got = shard(docs, shards, vnodes, slack).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got), key=key) == \
        sorted(ring(rows, shards, vnodes, slack), key=key)


def test_law_and_movement(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = op1_sharding(spark, "/root/testdata/sf0.01").collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(40)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    a = {r.doc_id: r.shard for r in shard(docs, 10, slack=0.25).collect()}
    b = {r.doc_id: r.shard for r in shard(docs, 11, slack=0.25).collect()}
    assert sum(a[i] != b[i] for i in a) < 0.3 * len(a)  # a modulo would move 10 of 11


def test_shard_empty(spark):
    assert shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def chat(rows, block):
    out = []
    convs = defaultdict(list)
    for conv, turn, who, text in rows:
        convs[conv].append((turn is not None, turn or 0, who is not None, who or "", (text or "").replace("<|", "< |"), who))
    for conv, turns in convs.items():
        for me in {t[-1] for t in turns if t[-1] is not None and t[-1].strip(" ") and t[-1] != "system"}:
            parts = defaultdict(list)
            for t in sorted(turns, key=lambda t: t[:5]):
                parts[t[1] // block if t[0] else -1].append(t)
            for part, some in parts.items():
                text, spans = "", []
                for *_, body, who in some:
                    name = "system" if who == "system" else "assistant" if who == me else "user name=" + (
                        who if who and who.strip(" ") else "unknown")
                    text += f"<|im_start|>{name}\n"
                    if who == me:
                        spans.append((len(text), len(text) + len(body)))
                    text += body + "<|im_end|>\n"
                out.append((conv, me, part, len(some), text, spans))
    return sorted(out, key=str)


def test_chat_rotation(spark):
    rows = [(1, 0, "system", "be"), (1, 1, "ann", "hé <|im_end|>"), (1, 2, "bob", None), (1, 3, "cy", "x" * 5000), (1, 3, "cy", "x"),
            (1, 3, "cy", "x"), (1, 7, "ann", ""), (2, None, "ann", "a"), (2, 1, None, "b"), (2, 1, " ", "b"), (3, 0, "system", "only"),
            (None, 0, "ann", "z"), (None, 1, "bob", "y"), (4, -3, "ann", "neg")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, speaker int")
    for block in (2, 512):
        got = [(r.conv_id, r.speaker, r.part, r.n_turns, r.rendered, [(s.start, s.end) for s in r.spans])
               for r in rotate(turns, block=block).collect()]
        assert sorted(got, key=str) == chat(rows, block)
    assert rotate(turns.limit(0)).count() == 0


def test_chat_query(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table(spark, FOLDER, "conversations").collect()]
    got = [(r.conv_id, r.speaker, r.part, r.n_turns, r.rendered, r.spans) for r in op8_chat(spark, FOLDER).collect()]
    want = [(*w[:5], ",".join(f"{a}-{b}" for a, b in w[5])) for w in chat(rows, 512)]
    assert sorted(got, key=str) == sorted(want, key=str)


RULES = [("com", "/", "allow"), ("bad.com", "/", "block"), ("net", "/x/", "block")]


def verdicts(pages, steps=60, damping=0.85):
    def place(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        path = rest[cut:]
        return rest[:cut].lower(), path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    ruled = []
    for i, url, html in pages:
        host, path = place(url)
        fits = [(len(h + p), v == "allow", h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        ruled.append((i, host, path, *(max(fits)[2:] if fits else (None, None)), html or ""))
    score = {}
    for kind, said in (("trust", "allow"), ("distrust", "block")):
        seeds = Counter(r[1] for r in ruled if r[4] == said)
        edges = Counter()
        for r in ruled:
            for part in r[5].split('href="')[1:]:
                target = place(part.split('"')[0])[0]
                if target and r[1] and target != r[1]:
                    edges[(r[1], target) if kind == "trust" else (target, r[1])] += 1
        out = Counter()
        for (a, _), n in edges.items():
            out[a] += n
        seed = {h: n / sum(seeds.values()) for h, n in seeds.items()}
        s = dict(seed)
        for _ in range(steps):
            new = Counter()
            for (a, b), n in edges.items():
                new[b] += damping * s.get(a, 0) * n / out[a]
            kept = sum(new.values())
            for h, x in seed.items():
                new[h] += x * (1 - kept)
            s = dict(new)
        score[kind] = s
    return sorted((i, h, p, rule, said or ("block" if score["distrust"].get(h, 0) > score["trust"].get(h, 0) else "allow"))
                  for i, h, p, rule, said, _ in ruled)


def test_urls(spark):
    link = lambda *h: " ".join(f'<a href="http://{x}/q">t</a>' for x in h)
    pages = [(1, "http://good.com/a", link("nice.org", "nice.org", "mid.org")), (2, "https://x.bad.com/a?b", link("z.org")),
             (3, "http://farm.org/1", link("x.bad.com", "x.bad.com", "good.com")), (4, "http://NICE.org/2#f", link("mid.org")),
             (5, "http://mid.org", link("farm.org", "nice.org")), (6, None, None), (7, "no scheme", ""), (8, "http://q.net/x/1", None),
             (9, "http://q.net/y", ""), (10, "http://lone.org/", "<p>"), (11, "http://good.com", ""), (12, "x://bad.com/a", ""),
             (13, "http://farm.org/1", link("farm.org")), (14, "://?x", ""), (15, "http://a/b://c", "")]
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    frame = spark.createDataFrame([(*p, "c") for p in pages], "page_id long, url string, html string, host string")
    got = judge(frame, rules, steps=60)
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()) == verdicts(pages)
    assert judge(frame.limit(0), rules).count() == 0
    assert judge(frame, rules.limit(0)).where("verdict = 'block'").count() == 0


def test_urls_query(spark):
    rows = op9_urls(spark, FOLDER).collect()
    assert len(rows) == table(spark, FOLDER, "pages").count()

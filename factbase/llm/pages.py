"""Main text of web pages by site style trees.

The DOMs of one host are merged: elements with the same path of tags, classes and ids are one element node, whose
style nodes are the sequences of block children seen under it. All weights are entropies over the m pages that hold a
node (logarithms to base m; 1 where m is 1):

* presentation: of the distribution of its style nodes, a part 1 - DECAY^(styles - 1) of the node's importance;
* content: 1 less the mean of log c over its texts, each found on c of the m pages, averaged over the node's subtree.

Words like `sidebar` count as a sign of noise only as whole tokens of a class, id or role, never on body, article or main
and never on a branch with most of the page's text, unless an article or main stands beside it. An article or main inside a branch that only such words (or a form)
call noise is main text all the same, unless the page has more main text elsewhere or the branch is part of an article.

A branch is noise only if all nodes in it are, so a node counts for as much as the best one below it. A block of a page
is kept if PRIOR x what its markup says (1 inside article or main, 0 inside menus, footers, adverts and the like, else 1/2) and
(1 - PRIOR) x its importance add up to 1/2. On a host with MANY distinct pages or more, a block inside article or main counts by
its own line, whose importance is 1 - log c / log M for a line found at its node on c of the host's M pages, and markup weighs SURE,
less than 1/2: a line that nearly all pages of a site repeat goes, whatever stands around it. A page keeps its main text if every
line of it is such a line. No importance makes marked noise main text: comments and adverts that differ from page to page have
the same entropy as articles. Counts are summed by (host, node, feature) before anything else; only blocks that markup leaves
open need their node's importance at the page, and each host the few lines that nearly all its pages hold.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factbase.llm.storage import cut
from factbase.llm.urls import host_of
from factbase.llm.words import lean_stream

DECAY, PRIOR = 0.9, 0.6
MANY, SURE = 8, 0.47     # distinct pages of a host from which on markup weighs SURE against the importance of a line
FEW = 100_000            # pages with dropped nodes that may be broadcast
NOISE, OPEN, MAIN = 0, 1, 2
WEAK, BOXED = 3, 4       # while a page is read: noise by words or form alone; an article or main inside it
MOST, MOST_IN_MAIN = 0.5, 0.9  # shares of a page's text above which a branch is no noise by words or form

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr img br html".split())
NOISY_TAGS = frozenset("nav footer aside button select dialog menu head fieldset".split())
NOISY_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie "
                        "cookies consent gdpr notice notices alert sidebar aside nav navbar navigation menu breadcrumb breadcrumbs "
                        "footer comment comments reply replies disqus related recommended share sharing social newsletter "
                        "subscribe signup popup modal overlay pagination pager search login contentinfo complementary".split())
HEAD_WORDS = frozenset(["header", "masthead", "topbar"])
MAIN_WORDS = frozenset(["main", "article"])
WRAPPERS = frozenset(["body", "main", "article"])
#: An open element that ends when one of these begins.
ENDS = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]),
        "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
IN_HEAD = frozenset("title meta link script style base noscript template".split())
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
NAMES = re.compile(r"""(?i)(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
WORDS = re.compile(r"[a-z]+")


def _number(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


_KNOWN: dict = {}  # what _signs and _node found in this worker; a plain dict travels with the job, a cached function does not
MOST_KNOWN = 100_000


def _known(key: tuple, find: Callable):
    """find(*key[1:]), remembered."""
    if key not in _KNOWN:
        if len(_KNOWN) >= MOST_KNOWN:
            _KNOWN.clear()
        _KNOWN[key] = find(*key[1:])
    return _KNOWN[key]


def _signs(name: str, names: tuple[str, ...]) -> tuple[bool, bool, bool]:
    """Whether an element's form or names say noise, head of a page, main text. `names`: values of class, id and role."""
    return _known(("signs", name, names), _find_signs)


def _find_signs(name: str, names: tuple[str, ...]) -> tuple[bool, bool, bool]:
    pieces = [set(WORDS.findall(token)) for value in names for token in value.split()]
    pieces = [x for x in pieces if x]
    weak = name == "form" or any(x <= NOISY_WORDS for x in pieces)
    head = any(x <= HEAD_WORDS for x in pieces)
    main = name in MAIN_WORDS or any(x & MAIN_WORDS and not x & (NOISY_WORDS | HEAD_WORDS) for x in pieces)
    return (False, False, main) if name in WRAPPERS else (weak, head, main)


def _roles(elements: list[tuple[int, str, tuple[str, ...]]], own: list[int]) -> list[int]:
    """Role of each element (element above, name, names), from its markup and the characters of text that it holds itself."""
    hard = [False] * len(elements)
    for i, (up, name, _) in enumerate(elements):
        hard[i] = name in NOISY_TAGS or i > 0 and hard[up]
    size = [0 if h else n for h, n in zip(hard, own)]
    for i in range(len(elements) - 1, 0, -1):
        size[elements[i][0]] += size[i]
    signs = [_signs(name, names) for _, name, names in elements]
    in_main, branch = [False] * len(elements), [0] * len(elements)  # the nearest element with a sign of noise, or 0
    beside = [0] * len(elements)  # text of articles by such branches
    for i in range(1, len(elements)):
        up, (weak, head, main) = elements[i][0], signs[i]
        in_main[i] = in_main[up] or main
        branch[i] = i if weak or head else branch[up]
        if in_main[i] and not hard[i]:
            beside[branch[i]] += own[i]

    def most(i: int, inside: bool) -> bool:
        """Whether a branch holds so much of the page's text that words and form say nothing about it."""
        if size[i] <= size[0] * (MOST_IN_MAIN if inside else MOST):
            return False
        while i and not inside:
            i = branch[elements[i][0]]
            if beside[i]:
                return False
        return True

    roles, in_article = [OPEN] * len(elements), [False] * len(elements)
    for i in range(1, len(elements)):
        up, name, names = elements[i]
        above, (weak, head, main) = roles[up], signs[i]
        in_article[i] = in_article[up] or name == "article"
        inside = above in (MAIN, BOXED)
        if above == NOISE or hard[i] or name == "header" and not inside:
            roles[i] = NOISE
        elif (weak or head and not inside) and not most(i, inside):
            roles[i] = NOISE if in_article[i] else WEAK
        elif above == WEAK and (name in MAIN_WORDS or "main" in names):
            roles[i] = BOXED
        elif above == OPEN and main:
            roles[i] = MAIN
        else:
            roles[i] = above
    held = {r: sum(n for n, x in zip(own, roles) if x == r) for r in (MAIN, BOXED)}
    boxed = MAIN if held[BOXED] >= held[MAIN] else NOISE
    return [{WEAK: NOISE, BOXED: boxed}.get(r, r) for r in roles]


def _node(above: int, name: str, words: tuple[str, ...]) -> int:
    return _known(("node", above, name, words), lambda *x: _number(f"{x[0]}/{x[1]}.{'.'.join(x[2])}"))


def _tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): text, open or close. Contents of RAW elements are left out."""
    at, n = 0, len(html)
    lower = None
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            yield "text", "", html[at:]
            return
        if lt > at:
            yield "text", "", html[at:lt]
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        after = html[lt + 1: lt + 3]
        if after[:1] in ("!", "?"):
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        if not (after[:1].isascii() and after[:1].isalpha() or after[:1] == "/" and after[1:].isascii() and after[1:].isalpha()):
            yield "text", "", "<"
            at = lt + 1
            continue
        m = TAG.match(html, lt)
        if m:
            close, name, rest, at = m[1], m[2].lower(), m[3], m.end()
        else:  # a quote is never closed
            end = html.find(">", lt)
            if end < 0:
                return
            close, name, rest = ("/" if after[0] == "/" else ""), re.match(r"[^\s/>]*", html[lt + 1 + (after[0] == "/"): end])[0].lower(), ""
            at = end + 1
        yield ("close" if close else "open"), name, rest
        if not close and name in RAW and not (name in ("svg", "math") and rest.endswith("/")):
            lower = html.lower() if lower is None else lower
            end = lower.find(f"</{name}", at)
            if end < 0:
                return
            at = end


def read_page(html: str | None) -> tuple[dict[int, tuple], list[tuple[int, int, str]]]:
    """Element nodes {node: (nodes above, children)} and blocks (node, role, text) of a page, in page order."""
    nodes: dict[int, tuple[tuple[int, ...], list[str]]] = {0: ((), [])}
    blocks: list[tuple[int, int, str]] = []
    stack: list[tuple[str, int, int]] = [("", 0, 0)]  # name, node, element
    elements: list[tuple[int, str, tuple[str, ...]]] = [(0, "", ())]
    own = [0]
    held: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                blocks.append((*stack[-1][1:], text))
                own[stack[-1][2]] += len(text)

    for kind, name, rest in _tokens(html or ""):
        if kind == "text":
            held.append(entities.unescape(rest) if "&" in rest else rest)
        elif name in INLINE or name in RAW or name in VOID and name != "hr":
            if name == "br":
                held.append(" ")
        elif kind == "close":
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            flush()
            if depth:
                del stack[depth:]
        else:
            flush()
            while (top := stack[-1][0]) == "p" or name in ENDS.get(top, ()) or top == "head" and name not in IN_HEAD:
                stack.pop()
            if name == "hr":
                continue
            names: tuple[str, ...] = ()
            words: tuple[str, ...] = ()
            if "=" in rest:
                names = tuple((m[1] or m[2] or m[3] or "").lower() for m in NAMES.finditer(rest))
                words = tuple(sorted({w for x in names for w in WORDS.findall(x)}))
            _, above, element = stack[-1]
            node = _node(above, name, words)
            ups, children = nodes[above]
            if not children or children[-1] != name:
                children.append(name)
            if node not in nodes:
                nodes[node] = ((*ups, above), [])
            stack.append((name, node, len(elements)))
            elements.append((element, name, names))
            own.append(0)
    flush()
    roles = _roles(elements, own)
    return nodes, [(node, roles[element], text) for node, element, text in blocks]


FEATURES = "host string, node long, kind string, feature long, ups array<long>, share double"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page: its nodes (p), their styles (s), their texts (c), and nodes of blocks that markup leaves open (o).
    share: one over the number of copies of the page on its host, so that copies count once together."""
    for batch in batches:
        hosts, keys, pages = (batch.column(i).to_pylist() for i in range(3))
        copies = batch.column(3).to_pylist() if batch.num_columns > 3 else [None] * len(pages)
        for low in range(0, len(pages), 500):
            out, shares = [], []
            part = slice(low, low + 500)
            for host, key, n, html in zip(hosts[part], keys[part], copies[part], pages[part]):
                nodes, blocks = read_page(html)
                for node, (ups, children) in nodes.items():
                    out += [(host, node, "p", 0, ups), (host, node, "s", _number(" ".join(children)), None)]
                out += [(host, node, "c", x, None) for node, x in {(b[0], _number(b[2])) for b in blocks}]
                out += [(host, node, "o", key, None) for node in {b[0] for b in blocks if b[1] == OPEN}]
                shares += [1 / (n or 1)] * (len(out) - len(shares))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([*[pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], pa.array(shares, pa.float64())],
                                             names=["host", "node", "kind", "feature", "ups", "share"])


def importance(counts: DataFrame, decay: float = DECAY) -> DataFrame:
    """host, node, importance from host, node, kind, feature, n (pages) and ups (the nodes above, for kind p)."""
    held = counts.where("kind = 'p'").select("host", "node", F.col("n").alias("m"), "ups")
    base = F.when(F.col("m") > 1, F.log(F.col("m").cast("double")))
    sums = (counts.where("kind in ('s', 'c')").groupBy("host", "node").agg(
        F.sum(F.when(F.col("kind") == "s", F.col("n"))).alias("shown"), F.count_if(F.col("kind") == "s").alias("styles"),
        F.sum(F.when(F.col("kind") == "s", F.col("n") * F.log(F.col("n").cast("double")))).alias("spread"),
        F.count_if(F.col("kind") == "c").alias("texts"),
        F.sum(F.when(F.col("kind") == "c", F.log(F.col("n").cast("double")))).alias("known")))
    nodes = held.join(sums, ["host", "node"], "left").select(
        "host", "node", "m", "ups", "styles",
        F.coalesce((F.log("shown") - F.col("spread") / F.col("shown")) / base, F.lit(1.0)).alias("presentation"),
        F.when(F.col("texts") > 0, F.coalesce(1 - F.col("known") / F.col("texts") / base, F.lit(1.0))).alias("content"))
    below = (nodes.where("content is not null").select("host", "m", "content", F.explode(F.array_append("ups", F.col("node"))).alias("node"))
             .groupBy("host", "node").agg((F.sum(F.col("content") * F.col("m")) / F.sum("m")).alias("below")))
    part = F.pow(F.lit(decay), F.greatest(F.col("styles") - 1, F.lit(0)))
    own = nodes.join(below, ["host", "node"]).select(
        "host", "node", "ups", ((1 - part) * F.col("presentation") + part * F.col("below")).alias("own"))
    return (own.select("host", "own", F.explode(F.array_append("ups", F.col("node"))).alias("node"))
            .groupBy("host", "node").agg(F.max("own").alias("importance")))


def repeated_lines(counts: DataFrame, many: int = MANY, sure: float = SURE) -> DataFrame:
    """host, lines (numbers of node and text) too unimportant to stay where markup says main text.

    Such a line is on most pages of its host, so a host has no more of them than a page has blocks, but for a factor.
    """
    sites = counts.where("kind = 'p' and node = 0 and n > 1").where(F.col("n") >= many).select("host", F.col("n").alias("pages"))
    weight = 1 - F.log(F.col("n").cast("double")) / F.log(F.col("pages").cast("double"))
    return (counts.where("kind = 'c' and n > 1").select("host", "node", "feature", "n").join(sites, "host")
            .where(F.lit(sure) + F.lit(1 - sure) * weight < 0.5)
            .groupBy("host").agg(F.collect_set(F.struct("node", "feature")).alias("lines")))


def _small(frame: DataFrame) -> DataFrame:
    """To be broadcast if its rows were counted to be few."""
    return F.broadcast(frame) if frame.count() <= FEW else frame


def extract(pages: DataFrame, keep: list[str] | None = None, page_id: str = "page_id", url: str = "url", html: str = "html",
            prior: float = PRIOR, decay: float = DECAY, many: int = MANY, sure: float = SURE) -> DataFrame:
    """`keep` columns (page_id, url) of each row and text: its main text, blocks in page order joined by a line feed.

    Character references are decoded; white space inside a block is one space. A null page is an empty one; pages
    without a host (also with a null url) are one site. Repeated pages, and pages of one html at several addresses of a
    host, stay rows but count as one page of their site. Broken markup is read to
    its end: unclosed elements end with their page, an unclosed comment or script hides the rest.
    """
    keep = [page_id, url] if keep is None else keep
    if not 0.5 < prior <= 1:  # clear markup decides, whatever the importance
        raise ValueError("prior must be above 1/2")
    rows = pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], host_of(F.col(url)).alias("host"),
                        F.xxhash64(host_of(F.col(url)), F.col(html)).alias("key"), F.col(html).alias("html"))
    copies = _small(cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")))
    seen = rows.join(copies, "key", "left").select("host", "key", "html", "copies").mapInArrow(lean_stream(_features), FEATURES)
    counts = cut(seen.groupBy("host", "node", "kind", "feature").agg(
        F.round(F.sum("share")).cast("long").alias("n"), F.first("ups", True).alias("ups")))
    weak = importance(counts, decay).where(F.lit(prior / 2) + F.lit(1 - prior) * F.col("importance") < 0.5)
    dropped = _small(cut(counts.where("kind = 'o'").select("host", "node", F.col("feature").alias("key")).join(weak, ["host", "node"])
                         .groupBy("key").agg(F.collect_set("node").alias("dropped"))))
    repeated = _small(cut(repeated_lines(counts, many, sure)))
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, low, site in zip(*(batch.column(len(names) + i).to_pylist() for i in range(3))):
                low, site = frozenset(low or ()), frozenset((x["node"], x["feature"]) for x in site or ())
                shown = [x for x in read_page(page)[1] if x[1] == MAIN or x[1] == OPEN and x[0] not in low]
                own = [x for x in shown if x[1] != MAIN or not site or (x[0], _number(x[2])) not in site]
                if not any(x[1] == MAIN for x in own):
                    own = shown
                out.append("\n".join(x[2] for x in own))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(out, pa.string())], names=[*names, "text"])

    joined = rows.join(dropped, "key", "left").join(repeated, "host", "left").select(*names, "html", "dropped", "lines")
    schema = T.StructType([*rows.select(*names).schema.fields, T.StructField("text", T.StringType())])
    return joined.mapInArrow(lean_stream(run), schema).select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "text")

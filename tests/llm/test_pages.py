"""Main text of pages: the articles of the test pages, other markup, and importances against a plain computation."""

import html as entities
import math
import re
from collections import Counter, defaultdict

import pytest

from factbase.llm.pages import extract, importance, read_page
from factbase.llm.queries import op5_pages, table


def plain(page):
    """Article of a generated page: its blocks are what stands between h1 and p tags."""
    article = re.search(r"(?s)<article>(.*?)</article>", page)[1]
    parts = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
    return "\n".join(p for p in parts if p)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, folder):
    pages = {r.page_id: r for r in table(spark, folder, "pages").collect()}
    got = op5_pages(spark, folder).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == plain(pages[r.page_id].html) and r.url == pages[r.page_id].url and r.n_chars == len(r.text), r.page_id


CASES = [
    ("<article><header><h1>T &amp; U</h1></header><p>a <b>b</b>\n c&nbsp;d<p>e<br>f<footer>by x</footer></article>", "T & U\na b c d\ne f"),
    ("<main><div>x<script>var a='</div>'</script>y</div><form>name <input></form><!-- <p>no -->z</main>", "xy\nz"),
    ("<article>a<div class='comments'><p>nice!</p></div><div id=\"comment-7\">x</div>b</article><aside>c</aside>", "a\nb"),
    ("<article><ul><li>1<li>2<ul><li>3</ul></ul>1 < 2 && <3 &lt;b&gt; &#233; &bogus;", "1\n2\n3\n1 < 2 && <3 <b> é &bogus;"),
    ("<head><title>t</title><body><div role=main><table><tr><td>a<td>b<tr><td>c</table></div>", "a\nb\nc"),
    ("<div class='cookie notice'>ok?</div><article class=post>body<a href='x\">q</a></article>", None),
    ("<nav><article>teaser</article></nav><article><style>p{}</style>kept<!-- never closed <p>gone", "kept"),
    ("", ""), (None, ""), ("<", None), ("no markup at all", "no markup at all"), ("<script>x", ""), ("<p>" + "w " * 200_000, "w " * 199_999 + "w"),
]


def test_markup(spark):
    rows = [(i, f"http://h{i}.org/", page, "t", 1) for i, (page, _) in enumerate(CASES)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = {r.page_id: r.text for r in extract(frame).collect()}
    assert len(got) == len(CASES)
    for i, (_, want) in enumerate(CASES):
        assert want is None or got[i] == want, i
    assert extract(frame.limit(0)).count() == 0


LONG = "a long text of the article that the page is about"
NAMED = [
    (f"<body class='single no-sidebar'><article>{LONG}</article></body>", LONG),
    (f"<div class='content-with-sidebar'><p>{LONG}</p></div>", LONG),
    (f"<body class='search search-results'><main>{LONG}</main><div class=sidebar>links</div></body>", LONG),
    (f"<article class='post category-notices tag-newsletter newsletter'>{LONG}</article>", LONG),
    (f"<body><form id=aspnetForm action=x><nav>{LONG}</nav><div class=text><p>{LONG}</p></div></form></body>", LONG),
    (f"<body><form><div class=login>name</div><article>{LONG}<form>say</form></article></form></body>", LONG),
    (f"<main><form><p>{LONG}</p></form></main>", LONG),
    (f"<div class=overlay><article>{LONG[:20]}</article></div><div>{LONG}</div>", f"{LONG[:20]}\n{LONG}"),
    (f"<main><div class='promo'><article>x y</article></div><article>{LONG}</article></main>", LONG),
    (f"<article>{LONG}<section class=comments><article class=comment>{LONG}</article></section></article>", LONG),
    (f"<div class='cookie-notice'>ok?</div><div id=ad-2>buy</div><div class='box related'>r</div><p>{LONG}</p>", LONG),
    (f"<div class=search><p>{LONG}</p></div><div class=related><article>t</article></div>", f"{LONG}\nt"),
    (f"<article>short</article><div class=ad>{LONG}</div>", "short"),
    (f"<form><article>short</article><div class=ad>{LONG}</div></form>", "short"),
    (f"<main class=ad><p>{LONG}</p></main><div class=masthead>m</div>", LONG),
]


def test_noisy_words_of_wrappers(spark):
    frame = spark.createDataFrame([(i, f"http://h{i}.org/", page) for i, (page, _) in enumerate(NAMED)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract(frame).collect()}
    for i, (_, want) in enumerate(NAMED):
        assert got[i] == want, i


def test_noisy_words_of_wrappers_on_one_site(spark):
    page = ("<body class='single no-sidebar'><div class=top>Welcome to our site</div><form><div class='content-with-sidebar'><h2>T{0}</h2>"
            "<p>text number {0} of this site</p></div><div class=sidebar>links {0}</div></form></body>")
    frame = spark.createDataFrame([(i, "http://h.org/", page.format(i)) for i in range(9)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract(frame).collect()} == {i: f"T{i}\ntext number {i} of this site" for i in range(9)}


def by_hand(pages, decay=0.9):
    seen = defaultdict(lambda: defaultdict(Counter))
    for host, page in pages:
        nodes, blocks = read_page(page)
        for node, (ups, children) in nodes.items():
            seen[host][node]["p"] = ups
            seen[host][node]["m"] = seen[host][node].get("m", 0) + 1
            seen[host][node].setdefault("s", Counter())[tuple(children)] += 1
        for node, text in {(b[0], b[2]) for b in blocks}:
            seen[host][node].setdefault("c", Counter())[text] += 1
    out = {}
    for host, nodes in seen.items():
        own, content = {}, {}
        for node, x in nodes.items():
            if "c" in x:
                content[node] = 1.0 if x["m"] == 1 else 1 - sum(math.log(c) for c in x["c"].values()) / len(x["c"]) / math.log(x["m"])
        for node, x in nodes.items():
            leaves = [k for k in content if k == node or node in nodes[k]["p"]]
            if not leaves:
                continue
            below = sum(content[k] * nodes[k]["m"] for k in leaves) / sum(nodes[k]["m"] for k in leaves)
            total = sum(x["s"].values())
            shown = 1.0 if x["m"] == 1 else -sum(c / total * math.log(c / total) for c in x["s"].values()) / math.log(x["m"])
            part = decay ** (len(x["s"]) - 1)
            own[node] = (1 - part) * shown + part * below
        for node in own:
            out[host, node] = max(own[u] for u in own if u == node or node in nodes[u]["p"])
    return out


def test_importance_and_repeated_branches(spark):
    layout = "<div class=top>Welcome to our site</div><div class=body><h2>T{0}</h2><p>text {0}</p>{1}</div><div class=end>All rights reserved</div>"
    pages = [("a", layout.format(i, "<p>more</p>" * (i % 3))) for i in range(9)] + [("b", layout.format(0, ""))]
    frame = spark.createDataFrame([(i, f"http://{h}/", p) for i, (h, p) in enumerate(pages)], "page_id long, url string, html string")
    from pyspark.sql import functions as F
    from factbase.llm.pages import FEATURES, _features
    seen = frame.select(F.substring("url", 8, 1).alias("host"), F.col("page_id").alias("key"), "html").mapInArrow(_features, FEATURES)
    counts = seen.groupBy("host", "node", "kind", "feature").agg(F.count("*").alias("n"), F.first("ups", True).alias("ups"))
    got = {(r.host, r.node): r.importance for r in importance(counts).collect()}
    want = by_hand(pages)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    texts = {r.page_id: r.text for r in extract(frame).collect()}
    for i in range(9):  # what all pages of the site repeat goes; a site of one page keeps everything
        assert "Welcome" not in texts[i] and "rights" not in texts[i] and texts[i].startswith(f"T{i}\ntext {i}")
    assert texts[9].startswith("Welcome") and texts[9].endswith("reserved")


def test_copies_of_a_page_count_once(spark):
    """One plain page at two addresses of a host, given twice, and rows with a null url."""
    page = "<html><body><h1>A title</h1><p>" + "Some words of a plain page. " * 9 + "</p></body></html>"
    rows = [(1, "http://a.org/x", page), (2, "http://a.org/y", page), (2, "http://a.org/y", page), (3, None, page), (4, None, page), (None, "http://b.org/", page)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 6 and len({r.text for r in got}) == 1 and got[0].text.startswith("A title\nSome words")


def test_lines_that_a_site_repeats_go_from_its_articles(spark):
    """The importance of a line beats clear markup on a host of many pages, not on one of few, and never empties a page."""
    page = "<nav>menu {0}</nav><article><h1>T{0}</h1><p>text of page {0}</p><p>Follow us everywhere</p></article><div class=comments>c{0}</div>"
    rows = [(i, "http://big.org/", page.format(i)) for i in range(20)] + [(100 + i, "http://few.org/", page.format(i)) for i in range(4)]
    rows += [(200 + i, "http://same.org/", f"<nav>menu {i}</nav><article><h1>One</h1><p>article</p></article>") for i in range(12)]
    rows += [(300, "http://big.org/", None), (301, "http://big.org/", "<article>Follow us everywhere</article>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract(frame).collect()}
    assert {i: got[i] for i in range(20)} == {i: f"T{i}\ntext of page {i}" for i in range(20)}
    assert {got[100 + i] for i in range(4)} == {f"T{i}\ntext of page {i}\nFollow us everywhere" for i in range(4)}
    assert {got[200 + i] for i in range(12)} == {"One\narticle"}
    assert got[300] == "" and got[301] == "Follow us everywhere"
    assert "Follow" in {r.page_id: r.text for r in extract(frame, many=1000).collect()}[0]

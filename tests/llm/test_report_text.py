from fleetvitals.llm import report_text as R

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/a">Menu {i}</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Node {i}</h1><p>Memory  is&nbsp;at &lt;90&gt;&amp;{i}&#37;.<br>Next <b>bold</b></p><div class="ad">Buy</div><p>Unique text {i}</p>
<form><input value="x">Send</form><p>Last one {i}<aside>Side</aside><section class="comments"><p>First!</p></section></article>
<div id="sidebar"><p>Related</p></div><footer>&copy; us</footer></body></html>"""


def expected(i):
    return f"Node {i}\n\nMemory is at <90>&{i}%. Next bold\n\nUnique text {i}\n\nLast one {i}"


def test_article_without_what_surrounds_it(spark):
    rows = [(i, "h1" if i % 2 else f"h{i}", PAGE.format(i=i)) for i in range(20)]
    found = R.extract_text(spark.createDataFrame(rows, "report_id long, node_ip string, content string"), keep=["node_ip"]).collect()
    assert {r.report_id: (r.node_ip, r.text, r.n_chars) for r in found} == {i: (h, expected(i), len(expected(i))) for i, h, _ in rows}


def test_site_without_marks_loses_what_repeats(spark):
    """No element tells menu from text here: only the site's style tree does."""
    page = '<div class="a"><div class="b"><div>Home</div><div>Help</div></div><div class="c"><div class="t">Title {i}</div><div class="x">Story {i} of many</div></div><div class="d">All rights reserved</div></div>'
    rows = [(i, "10.0.0.1", page.format(i=i)) for i in range(12)] + [(99, "10.0.0.9", page.format(i=99))]
    found = {r.report_id: r.text for r in R.extract_text(spark.createDataFrame(rows, "report_id long, node_ip string, content string")).collect()}
    assert all(found[i] == f"Title {i}\n\nStory {i} of many" for i in range(12))
    # One page alone says nothing about what repeats.
    assert found[99] == "Home\n\nHelp\n\nTitle 99\n\nStory 99 of many\n\nAll rights reserved"


def test_copies_of_an_article_keep_their_text(spark):
    rows = [(i, "n", PAGE.format(i=1)) for i in range(40)] + [(100 + i, "n", PAGE.format(i=100 + i)) for i in range(10)]
    found = {r.report_id: r.text for r in R.extract_text(spark.createDataFrame(rows, "report_id long, node_ip string, content string")).collect()}
    assert all(found[i] == expected(1) for i in range(40)) and all(found[100 + i] == expected(100 + i) for i in range(10))


def test_copies_without_article_and_main_keep_their_text(spark):
    """Copies of one page, each with its own script and ad, on a host of their own and among pages of the same layout."""
    page = """<html><body><script>track({n})</script><div class="ad">Buy {n}</div><div class="b"><div>Home</div></div>
        <div class="c"><h1>Title {i}</h1><p>Story {i} of many</p><p>More on {i}</p></div><div class="d">All rights reserved</div></body></html>"""
    rows = [(n, host, page.format(i=1, n=n)) for n, host in [*((n, "copies") for n in range(40)), *((n, "both") for n in range(40, 80))]]
    rows += [(100 + i, "both", page.format(i=100 + i, n=i)) for i in range(10)]
    table = spark.createDataFrame(rows, "report_id long, node_ip string, content string").repartition(3)
    found = {r.report_id: r.text for r in R.extract_text(table).collect()}

    def story(i):
        return f"Title {i}\n\nStory {i} of many\n\nMore on {i}"

    # A single content says nothing about what repeats.
    assert all(found[n] == f"Home\n\n{story(1)}\n\nAll rights reserved" for n in range(40))
    assert all(found[n] == story(1) for n in range(40, 80)) and all(found[100 + i] == story(100 + i) for i in range(10))


def test_importance_of_a_merged_tree(spark):
    page = "<div><p>same</p><span>{i}</span></div>"
    rows = [(i, "n", page.format(i=i)) for i in range(10)]
    tree = R.style_trees(spark.createDataFrame(rows, "report_id long, node_ip string, content string")).collect()
    root = R._hash("", 0)
    div = R._hash("div", root & ((1 << 64) - 1))
    by_path = {r.path: r for r in tree}
    p, span = (by_path[R._hash(n, div & ((1 << 64) - 1))] for n in ("p", "span"))
    assert (p.pages, round(p.content, 6)) == (10, 0.0) and (span.pages, round(span.content, 6)) == (10, 1.0)
    assert abs(by_path[div].presentation) < 1e-9 and by_path[div].content is None


def test_broken_markup():
    assert R.main_text("<article><p><b>One.<br><p>Two</p></article>", {}) == "One.\n\nTwo"
    assert R.main_text("<article><p>open <b>bold", {}) == "open bold"
    assert R.main_text("a < b && c &am <p>x</p", {}) == "a < b && c &am\n\nx"
    assert R.main_text("<article><p title='a > b'>in</p></article>", {}) == "in"
    assert R.main_text("</p></div><article>t</article><script>never closed <p>x</p>", {}) == "t"
    assert R.main_text("<ul><li>a<li>b</ul><table><tr><td>1<td>2</table>", {}) == "a\n\nb\n\n1\n\n2"
    assert R.main_text("<" * 20000, {}) == "<" * 20000
    assert R.main_text("<div>" * 5000 + "deep", {}) == "deep"


def test_embedded_elements_keep_the_text_around_them():
    for name in ("svg", "math", "object", "noscript", "select", "template"):
        for page in (
            f"<article><p>One <{name} class='x'/>two</p><p>three</p></article><footer><{name}></{name}></footer>",
            f"<article><p>One <{name}>two</p><p>three</p></article>",
            f"<article><p>One <{name}>two</p><p>three</p></article><footer><{name}>x</{name}></footer>",
        ):
            assert R.main_text(page, {}) == "One two\n\nthree", page
        assert R.main_text(f"<article><{name}><p>One</p><p>two</p></article>", {}) == "One\n\ntwo"
    for name in ("svg", "noscript", "select", "template"):
        assert R.main_text(f"<article><p>One <{name}><b>no<i/></b></{name}>two</p></article>", {}) == "One two"
    assert R.main_text("<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p></article>", {}) == "So x=2 holds"
    assert R.main_text("<article><p>See <object data='p'><param name='a'>the plan</object> here</p></article>", {}) == "See the plan here"
    assert R.main_text("<article><svg><title/><path/></svg>One<script src='a'/><p>two</p></article>", {}) == "One\n\ntwo"
    assert R.main_text("<article>One<script src='a'/>var t</script> two<iframe><p>no</p></iframe></article>", {}) == "One two"


def test_odd_rows(odd, nothing):
    found = R.extract_text(odd, report_id="dump_id").collect()
    assert len(found) == odd.count()
    assert {r.dump_id: r.text for r in found if r.dump_id in (3, 4, 5, 7)} == {3: "", 4: "", 5: "", 7: "solo"}
    assert R.extract_text(nothing, report_id="dump_id").count() == 0


def test_quotes_open_values_only_after_an_equals_sign():
    assert R.main_text("<p title=Don't>First words. It's kept.</p><p>second</p>", {}) == "First words. It's kept.\n\nsecond"
    assert R.main_text("<p data-a = \"x > y\" b='>' c=d>in</p><p it's>two</p>", {}) == "in\n\ntwo"
    assert R.main_text('<p title="open>text</p>', {}) == "text"


def test_hidden_is_an_attribute_of_its_own():
    for markup in ('style="overflow: hidden"', 'title="no hidden fees"', 'aria-hidden="false"', "data-x='hidden'", 'class="hidden-not"', "data-hidden"):
        assert R.main_text(f"<div {markup}><p>text</p></div><p>B</p>", {}) == "text\n\nB", markup
    for markup in ("hidden", "HIDDEN", 'hidden=""', "class=x hidden", "hidden='until-found'"):
        assert R.main_text(f"<div {markup}><p>text</p></div><p>B</p>", {}) == "B", markup


def test_articles_are_roots_where_they_hold_most_of_the_page():
    inset = "<main><h1>Head line</h1><p>Lead and more of it</p><article>Inset</article><p>Rest of the long text</p></main>"
    assert R.main_text(inset, {}) == "Head line\n\nLead and more of it\n\nInset\n\nRest of the long text"
    teaser = '<body><h1>Title</h1><p>A long body text stands here.</p><article class="card">Teaser</article></body>'
    assert R.main_text(teaser, {}) == "Title\n\nA long body text stands here.\n\nTeaser"
    assert R.main_text("<p>Frame</p><article><p>All the words of the article</p></article>", {}) == "All the words of the article"
    assert R.main_text("<div>x</div><main><p>All the words</p><article>few</article></main>", {}) == "All the words\n\nfew"


def test_names_alone_prune_no_text_of_an_article():
    for markup in ("section class='related work'", "p class=share", "h2 id=reply", "p id=search", "div class='post-header'", "div id=notice"):
        tag = markup.split()[0]
        page = f"<article><p>Before it</p><{markup}>Words of its own</{tag}><p>After it</p></article>"
        assert R.main_text(page, {}) == "Before it\n\nWords of its own\n\nAfter it", markup
    linked = "<article><p>Before it</p><div class='related'>See <ul><li><a href=/a>Another story</a></ul></div><div class=share></div><p>After it</p></article>"
    assert R.main_text(linked, {}) == "Before it\n\nAfter it"
    for markup in ("div class=ad", "section id=comments", "div class='cookie-consent'", "ul class=breadcrumbs"):
        tag = markup.split()[0]
        assert R.main_text(f"<article><p>Text</p><{markup}><p>Not this</p></{tag}></article>", {}) == "Text", markup


def test_doubtful_names_go_where_the_site_repeats_them(spark):
    page = "<html><body><div class='notice'><p>Read our terms of use</p></div><div class=c><h1>Title {i}</h1><p>Story {i} of many</p></div></body></html>"
    rows = [(i, "n", page.format(i=i)) for i in range(12)]
    found = {r.report_id: r.text for r in R.extract_text(spark.createDataFrame(rows, "report_id long, node_ip string, content string")).collect()}
    assert found == {i: f"Title {i}\n\nStory {i} of many" for i in range(12)}


def test_unmatched_end_tags_cost_nothing():
    import time

    started = time.perf_counter()
    assert R.main_text("<div>" * 20_000 + "</b></p>" * 20_000 + "<p>deep</p>" + "<b>" * 20_000 + "<div>x</div>" * 2000, {}).startswith("deep")
    assert time.perf_counter() - started < 3


def plain_tree(pages):
    """The style tree of one site by its definition: (path -> pages, presentation, content)."""
    import math
    from collections import Counter, defaultdict

    distinct = {tuple(sorted(R.features(p or ""))) for p in pages}
    shown = defaultdict(lambda: ({}, Counter(), Counter()))
    for number, page in enumerate(distinct):
        for path, kind, value in page:
            if kind == 0:
                shown[path][0][number] = True
            else:
                shown[path][kind][value] += 1
    out = {}
    for path, (on, layouts, texts) in shown.items():
        n = len(on)
        several = sum(layouts.values())
        layout = min(1.0, -sum(c / several * math.log(c / several, n) for c in layouts.values())) if n > 1 else 1.0
        # A text's entropy: how evenly the pages share it, 1 on all and 0 on one.
        total = sum(texts.values())
        content = None if not total else 1.0 if n == 1 else max(0.0, 1 - sum(c * math.log(c, n) for c in texts.values()) / total)
        out[path] = (n, layout, content)
    return out


def test_given_pages_by_a_plain_style_tree(spark):
    """Every page of the table: the distributed tree is the plain one, and so is the text."""
    from pyspark.sql import functions as F

    from fleetvitals.llm import queries, url_rules

    sf = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html", url_rules.host_of(F.col("url")).alias("host")).collect()
    sites = {}
    for r in pages:
        sites.setdefault(r.host or "", []).append(r.html)
    # The table has many small hosts; all its pages as one site merge more.
    for by_host in (True, False):
        trees = {h: plain_tree(p) for h, p in sites.items()} if by_host else {"all": plain_tree([r.html for r in pages])}
        given = spark.createDataFrame([(r.page_id, (r.host or "") if by_host else "all", r.html) for r in pages], "report_id long, node_ip string, content string")
        for r in R.style_trees(given).collect():
            n, layout, content = trees[r.site][r.path]
            assert r.pages == n and abs(r.presentation - layout) < 1e-9 and (content is None) == (r.content is None)
            assert content is None or abs(r.content - content) < 1e-9
        used = {h: {path: v for path, v in t.items() if v[0] >= R.MIN_PAGES} for h, t in trees.items()}
        wanted = {r.page_id: R.main_text(r.html, used[(r.host or "") if by_host else "all"]) for r in pages}
        assert {r.report_id: r.text for r in R.extract_text(given).collect()} == wanted
        if by_host:
            assert {r.page_id: r.text for r in queries.op3_html_extraction(spark, sf).collect()} == wanted


LEGACY = """<html><head><title>MySQL report</title><style>td{{color:red}}</style></head><body>
<h1>MySQL Health Report</h1><div class="toc"><ul><li><a href="#a">Overview</a></li><li><a href="#b">Temporary tablespace</a></li></ul></div>
<h2 id="a">Node 10.0.0.{i}</h2><p>Uptime {i} days, {i}00 connections.</p>
<h2 id="b">Temporary tablespace</h2><table class="data"><tr><th>FILE_NAME</th><th>SIZE_MB</th></tr><tr><td>./ibtmp1</td><td>{i}12</td></tr></table>
<p class="notice">Restart node {i} to shrink it.</p></body></html>"""


def test_legacy_html_reports_keep_their_figures(spark):
    rows = [(i, "shop", LEGACY.format(i=i)) for i in range(1, 13)]
    for r in R.extract_text(spark.createDataFrame(rows, "report_id long, node_ip string, content string")).collect():
        blocks = r.text.split("\n\n")
        assert f"Node 10.0.0.{r.report_id}" in blocks and f"{r.report_id}12" in blocks and f"Restart node {r.report_id} to shrink it." in blocks
        assert f"Uptime {r.report_id} days, {r.report_id}00 connections." in blocks and "Overview" not in blocks


def test_kept_columns_that_are_called_as_results(spark):
    given = spark.createDataFrame([(1, "n", "<p>x</p>", "mine", "u")], "report_id long, node_ip string, content string, text string, url string")
    found = R.extract_text(given, keep=["text", "url", "report_id", "n_chars"])
    assert found.columns == ["report_id", "url", "text", "n_chars"] and tuple(found.first()) == (1, "u", "x", 1)

from html.parser import HTMLParser

from wearcurve.llm import html

SCHEMA = "page_id long, url string, html string, template string, host string"


class Plain(HTMLParser):
    """Text blocks of well-formed articles, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.skip, self.blocks, self.line = 0, 0, [], ""

    def flush(self):
        if s := " ".join(self.line.split()):
            self.blocks.append(s)
        self.line = ""

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside += 1
        if tag in ("script", "style"):
            self.skip += 1
        if tag in html.BLOCK:
            self.flush()
        elif tag == "br":
            self.line += " "

    def handle_endtag(self, tag):
        if tag in html.BLOCK:
            self.flush()
        if tag == "article":
            self.inside -= 1
        if tag in ("script", "style"):
            self.skip -= 1

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.line += data


def plain(page):
    p = Plain()
    p.feed(page)
    p.flush()
    return "\n".join(p.blocks)


def test_articles_equal_the_standard_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = {r.page_id: r.html for r in pages.collect()}
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert got == {i: plain(h) for i, h in rows.items()}


def test_markup():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header>top</header><nav><ul><li>menu</ul></nav><!-- <p>no</p> -->
    <article><header><h1>A &amp; B</h1></header><p class=lead>one <b>two<i>three</b><br>four<p>five&nbsp;six<script>var x = "</p><p>no";</script>
    <div class="ad-box ad">buy</div><div id="comments"><p>nice</p></div><aside>side</aside><ul><li>x<li>y</ul><table><tr><td>a<td>b<tr><th>c</table><form><input><p>f</p></form><pre>l1
    l2</pre><blockquote>&lt;q&gt; &#233;</blockquote><div class="gradient">kept</div></article><footer>&copy;</footer></body></html>"""
    assert html.main_text(page).split("\n") == ["A & B", "one twothree four", "five six", "x", "y", "a b", "c", "l1 l2", "<q> é", "kept"]


def test_pages_without_an_article():
    assert html.main_text("<body><div class=sidebar>s</div><div><p>one<p>two</div>tail<div role='navigation'>n</div></body>") == "one\ntwo\ntail"
    assert html.main_text("just text < 5 & more") == "just text < 5 & more"
    assert html.main_text("") == "" and html.main_text("<p>open <b>never") == "open never" and html.main_text("</p></div>x<!-- open") == "x"


def test_marks_and_attributes():
    assert html.main_text("<main><p>intro</p><article><p>story</p></article></main>") == "story"
    assert html.main_text("<div role=\"main\"><p>story</p></div><p>out</p>") == "story"
    assert html.main_text("<article><div data-id='ad' title='a notice'><a href='/x?id=ad&class=ads'>kept</a></div><div id=ad-1>x</div><p hidden>y</p></article>") == "kept"
    assert html.main_text("<div id=header>h</div><div class=content><div class='card header'>x</div>one</div>") == "one"
    assert html.main_text("<article><div class='story-header'>title</div><article class='comment'>c</article></article>") == "title"


def test_site_templates(spark):
    bar = "<div><p>Welcome to our site</p><ul><li>login</li></ul></div>"
    rows = [(i, f"http://Site.example:80/{i}", f"<body>{bar}<div><p>story {i}</p><p>Daily line</p></div></body>", None, None) for i in range(20)]
    rows += [(100 + i, f"http://other{i}.example/", f"<body>{bar}<p>alone {i}</p></body>", None, None) for i in range(5)]
    rows += [(200 + i, f"http://art.example/{i}", f"<article><p>story {i}</p><p>Daily line</p><div><p>Share this</p></div></article>", None, None) for i in range(10)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[3] == "story 3\nDaily line"  # the recurring container goes, the recurring paragraph stays
    assert got[103] == "Welcome to our site\nlogin\nalone 3"  # once on its host
    assert got[204] == "story 4\nDaily line"


def test_odd_rows_and_empty(spark):
    rows = [(1, None, None, None, None), (2, "", "", None, None), (None, "not a url", "<p>x</p>", "c", "c"), (3, "http://h/", "<p>long</p>" * 20_000, None, None), (3, "http://h/", "<p>long</p>" * 20_000, None, None), (4, "http://h/", "<div>" * 3000 + "deep" + "</div>" * 3000, None, None)]
    got = html.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert by[1] == "" and by[2] == "" and by[None] == "x" and by[3].count("\n") == 19_999 and by[4] == "deep"
    assert html.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_copies_of_a_page_are_no_template(spark):
    story = "<body><div><article><p>one story</p><div><p>its box</p></div><ul><li>item</li></ul></article></div></body>"
    rows = [(i, f"http://copies.example/{i}", f"<div>{i % 3}</div>{story}", None, None) for i in range(10)] + [(100 + i, f"http://copies.example/x{i}", f"<article><p>other {i}</p></article>", None, None) for i in range(10)]
    plain = "<body><div><p>a page</p><section><p>without marks</p></section></div></body>"
    rows += [(200 + i, f"http://plain.example/{i}", plain, None, None) for i in range(12)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {got[i] for i in range(10)} == {"one story\nits box\nitem"} and got[104] == "other 4"
    assert {got[200 + i] for i in range(12)} == {"a page\nwithout marks"}


def test_templates_around_the_article_stay():
    page = "<div><p>bar</p><div role=\"main\"><article><p>story</p></article></div></div>"
    assert html.main_text(page, frozenset(html.subtrees(html.tree(page)[0]).values())) == "story"


def test_articles_in_dropped_elements_are_no_region():
    assert html.main_text("<main><p>text</p></main><aside><article>teaser</article></aside>") == "text"
    assert html.main_text("<div><p>story</p></div><article class='comment'>c</article>") == "story"
    assert html.main_text("<p>body text</p><div class=related><article>teaser</article><main>no</main></div>") == "body text"
    assert html.main_text("<main><p>text</p><article><img src=x></article></main>") == "text"
    assert html.main_text("<p>text</p><main><article> </article></main>") == "text"


STORY = " ".join(f"word{k}" for k in range(60))


def sited(article):
    """40 pages of one host whose menu, advert and footer change from page to page."""
    rows = []
    for i in range(40):
        menu = "".join(f"<li><a href='/{i}-{k}'>label {i} {k}</a></li>" for k in range(2 + i % 4))
        body = f"<h1>Title {i}</h1><p>{STORY} {i}</p>" + (f"<ul><li>point one of {i}</li><li>point two</li></ul>" if i % 2 else "") + f"<p>end {i}</p>"
        wrap = f"<article>{body}</article>" if article else f"<div class='c7x{i}'>{body}</div>"
        rows.append((i, f"http://a.example/{i}", f"<body><div class='bar'><ul>{menu}</ul></div><div class='zz'>buy number {i} today</div>{wrap}<div id='bottom'>made by {i}</div></body>", None, None))
    want = {i: f"Title {i}\n{STORY} {i}\n" + (f"point one of {i}\npoint two\n" if i % 2 else "") + f"end {i}" for i in range(40)}
    return rows, want


def test_templates_decide_without_marks(spark):
    for article in (True, False):
        rows, want = sited(article)
        df = spark.createDataFrame(rows, SCHEMA)
        assert {r.page_id: r.text for r in html.extract(df, marks=False).collect()} == want
        assert {r.page_id: r.text for r in html.extract(df).collect()} == want


def test_template_counts_equal_brute_force(spark):
    for article in (True, False):
        rows = sited(article)[0] + [(100 + i, f"http://few.example/{i}", "<div><p>x</p></div>", None, None) for i in range(3)]
        rows += [(200 + i, "http://a.example/copy", rows[0][2], None, None) for i in range(30)]
        got = {r.host: (set(r.template), set(r.content)) for r in html.site_templates(spark.createDataFrame(rows, SCHEMA)).collect()}
        pages = {h for _, u, h, _, _ in rows if "a.example" in u}  # copies count once
        same, at = {}, {}
        for h in pages:
            root = html.tree(h)[0]
            for x in set(html.subtrees(root).values()):
                same[x] = same.get(x, 0) + 1
            seen = html.places(root)
            for p, (above, w, linked, own) in seen.items():
                if p:
                    m = at.setdefault(p, [above, 0, 0, 0, 0, 0])
                    for k, v in enumerate((1, w, linked, own, seen[0][1]), 1):
                        m[k] += v
        often = lambda m: m >= html.LEAST_PAGES and m >= html.SHARE * len(pages)
        most = {0} | {p for p, (_, m, w, _, _, total) in at.items() if often(m) and 2 * w > total}
        little = {p for p, (above, m, w, linked, _, total) in at.items() if often(m) and above in most and (w <= html.LITTLE * total or 2 * w <= total and 2 * linked > w)}
        content = {p for p, (_, m, w, _, own, total) in at.items() if often(m) and 2 * w > total and 2 * own >= w}
        assert got == {"a.example": ({x for x, m in same.items() if often(m)} | little, content)}


def test_all_pages_of_the_driver_have_templates(spark):
    """On hosts of enough pages the templates alone give the text that the articles give."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    sizes = pages.groupBy(html.host().alias("host")).count().where(f"count >= {html.LEAST_PAGES}")
    pages = pages.withColumn("host", html.host()).join(sizes, "host")
    want = {r.page_id: plain(r.html) for r in pages.collect()}
    got = {r.page_id: r.text for r in html.extract(pages, marks=False).collect()}
    assert got == want and len(want) > 50


def test_a_copied_article_keeps_its_text(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div><article><p>{STORY} {i}</p></article></div></body>", None, None) for i in range(30)]
    rows += [(100 + i, f"http://h.example/c{i}", f"<body><div><article><div><p>{STORY} copied</p></div></article></div><p>{i}</p></body>", None, None) for i in range(8)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[100 + i] == f"{STORY} copied" for i in range(8)) and got[7] == f"{STORY} 7"


def test_teasers_are_no_main_text():
    assert html.main_text(f"<article><p>teaser</p></article><article><p>two</p></article><div id='content'><p>{STORY}</p></div>") == f"teaser\ntwo\n{STORY}"
    assert html.main_text(f"<article><h1>A</h1></article><main><p>{STORY}</p></main>") == f"{STORY}"
    assert html.main_text("<article><p>short story</p></article><div>something else</div>") == "short story"


def test_malformed_markup_takes_linear_time():
    from time import perf_counter

    began = perf_counter()
    for x in ("<a " * 400_000, "</b>" * 300_000, "<b>" * 100_000 + "<p></p>" * 100_000, "<p><div>" + "<b>" * 50_000 + "<p>x</p>" * 50_000, '<a "' * 200_000, "<" * 300_000, "<!-- " * 100_000, "<script " * 100_000, "<a '\">" * 100_000):
        html.main_text(x)
    assert perf_counter() - began < 30
    assert html.main_text("<a " * 5 + "x") == "<a " * 4 + "<a x" and html.main_text('<p class="a>one</p><p>two</p>') == "one\ntwo"


def test_references_are_decoded_in_their_text():
    assert html.main_text("<p>a&am<b>p;</b>lt; b &lt;&eacute;&#8217;</p>") == "a&amp;lt; b <é’"


def test_query_gives_the_articles(spark):
    from wearcurve.llm import queries

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = sorted((r.page_id, r.url, plain(r.html), len(plain(r.html))) for r in pages.collect())
    assert sorted(tuple(r) for r in queries.op10_html_extraction(spark, "/root/testdata/sf0.01").select("page_id", "url", "text", "n_chars").collect()) == want

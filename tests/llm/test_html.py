from pyspark.sql import functions as F

from canonry.llm import html

FRAME = '<html><head><title>T x</title><style>p{{}}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy now cheap</div>{}<footer>&copy; me</footer></body></html>'


def page(inner):
    return FRAME.format(f"<article>{inner}</article>")


PAGES = [page(f"<h1>Title {i} here</h1>" + "".join(f"<p>Some words &amp; more words {j}.</p>" for j in range(i % 7))) for i in range(60)]
W = html.fit(PAGES)


def test_labelled_pages_are_found():
    for i, p in enumerate(PAGES):
        want = "\n".join([f"Title {i} here"] + [f"Some words & more words {j}." for j in range(i % 7)])
        assert html.main_text(p, W) == want


def test_blocks_space_and_references():
    assert html.main_text(page("<p>a\n  b&nbsp;<b>c</b>d<br>e</p>\n<p></p><div>&lt;x&gt; &unknown; &amp;amp;</div>tail of it"), W) == "a b cd e\n<x> &unknown; &amp;\ntail of it"


def test_boilerplate_inside_is_left_out():
    inner = '<h1>One two</h1><p>Kept words here.</p><form>Name <input></form><div class="comments"><p>First!</p></div><aside>See also</aside><script>x</script><p>Kept at last.</p>'
    assert html.main_text(page(inner), W) == "One two\nKept words here.\nKept at last."


def test_pages_without_an_article_and_broken_ones():
    assert html.main_text(FRAME.format("<p>plain words in here</p><p>and more of them</p>"), W) == "plain words in here\nand more of them"
    assert html.main_text(page("<p>cut off in the mid")[: -len("</article><footer>&copy; me</footer></body></html>")] + "dle <b", W) == "cut off in the middle"
    assert html.main_text(None, W) == html.main_text("", W) == html.main_text("<p></p>", W) == html.main_text("<!-- x", W) == ""
    assert html.main_text("<p>" * 3000 + "deep words", W).endswith("deep words")


def test_best_run_agrees_with_brute_force():
    found = html.tokens(PAGES[5])
    score = [W.of(t) for t in found]
    best = max(sum(score[i : j + 1]) for i in range(len(score)) for j in range(i, len(score)))
    a, b = html.best_run(found, W)
    assert abs(sum(score[a : b + 1]) - best) < 1e-9


def test_table(spark):
    rows = [(i, f"http://a/{i}", p, "own") for i, p in enumerate(PAGES)] + [(99, None, None, "own"), (1, "http://a/1", PAGES[1], "own")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extract(df).collect()
    assert len(got) == len(rows) and {r["text"] for r in got if r["page_id"] == 99} == {""} and {r["text"] for r in got if r["page_id"] == 1} == {"Title 1 here\nSome words & more words 0."}
    assert html.extract(df.where(F.lit(False))).count() == 0


def test_many_unclosed_items_before_the_article():
    options = "<form><select>" + "".join(f"<option>Land {i}" for i in range(300)) + "</select></form>"
    items = '<div class="menu"><ul>' + "".join(f"<li>Item {i}<div>" for i in range(300)) + "</ul></div>"
    cells = "<nav><table>" + "<tr><td>a<th>b" * 300 + "</table></nav>"
    for before in (options, items, cells):
        assert html.main_text(FRAME.format(f"{before}<article><p>The words of the page.</p></article>"), W) == "The words of the page."


def test_siblings_end_each_other():
    # The item of the class ends where the next begins, not so across lists.
    for a, b, c in (("<ul>", "li", "</ul>"), ("<dl>", "dt", "</dl>"), ("<table><tr>", "td", "</table>"), ("<table>", "tr", "</table>"), ("<select>", "option", "</select>")):
        found = html.tokens(f'{a}<{b} class="ad">not this<{b}>but this{c}')
        assert {t.text: t.boiler for t in found if t.text} == {"not this": True, "but this": b == "option"}
    found = html.tokens('<ul><li class="ad">x<ul><li>inner</ul>y<li>z</ul>')
    assert {t.text: t.boiler for t in found if t.text} == {"x": True, "inner": True, "y": True, "z": False}


ARTICLE = "<article><h1>Head line</h1><p>The words of the page go on and on here.</p></article>"
TEXT = "Head line\nThe words of the page go on and on here."


def test_names_on_what_holds_the_article():
    for before, after in (
        ('<body class="home has-sidebar"><div>x</div>', "</body>"),
        ('<div id="widget"><div class="header">Top</div><section class="sidebar">', "</section></div>"),
        ("<nav>" + "<li>a" * 250 + "</nav>", ""),
        ('<div role="banner">Our name</div><div class="siteFooter">us</div>', '<div class="comment-list"><p>First of all replies, and longer than the page is itself, it goes on</p></div>'),
    ):
        assert html.main_text(f"<html>{before}{ARTICLE}{after}</html>", W) == TEXT
    assert html.main_text('<body><article class="post widget"><p>The words of the page.</p></article></body>', W) == "The words of the page."


def test_attributes_are_read_as_browsers_do():
    assert html.main_text(page('<p class=x">Hello "world" and more</p><p>Then on</p>'), W) == 'Hello "world" and more\nThen on'
    assert html.main_text(page("<p a=b c=\"x>y\" d='z>' e = f/>Here it is</p>"), W) == "Here it is"
    assert html.main_text(page('<p title="never closed>words'), W) == ""
    for odd in ("<p " + "a " * 100_000 + ">", "<p a" + "=" * 100_000, "<" * 50_000, "<a " * 20_000, "<p \"" + "'" * 50_000):
        html.tokens(odd)  # in no time


def test_parts_of_names():
    yes = ("ad", "site-footer", "comment-list", "cookie-banner", "share-buttons", "related-posts", "nav", "top_menu")
    no = ("share-price", "has-sidebar", "with-sidebar", "header-image", "download", "adventure", "", "...", "no-ads")
    assert all(map(html.is_boilerplate_name, yes)) and not any(map(html.is_boilerplate_name, no))


FRAMES = (
    '<body class="single no-sidebar"><div class="mast"><a href=/>Home</a> <a href=/x>News of it</a></div><main>{}</main><div class="mast"><p>All rights are ours, and so on</p></div></body>',
    '<body><header><h2>Name of the site</h2></header><div id=wrap class="layout"><article>{}</article><aside><p>Other things to read</p></aside></div><footer>Ours</footer>',
    '<div class="mast">Top of it</div><article class="post widget">{}</article><section class="comments"><p>I do not agree with a word of it at all</p></section>',
)
BLOCKS = ("<p>{}</p>", "<h2>{}</h2>", "<ul><li>{}</ul>", '<div class="share-price">{}</div>', "<table><tr><td>{}</table>", "<blockquote>{}</blockquote>")


def test_whole_query_on_frames_not_fitted_on(spark, tmp_path):
    """Weights come from two frames; the third has other boilerplate.  What was put
    in is what must come out."""
    import random

    rng = random.Random(8)
    rows, want = [], {}
    for i in range(120):
        texts = [" ".join(f"w{rng.randint(0, 999)}" for _ in range(rng.randint(3, 40))) for _ in range(rng.randint(1, 8))]
        inner = "".join(rng.choice(BLOCKS).format(t) for t in texts)
        if i % 17 == 0:
            inner += '<div class="mast">Follow us there</div><script>var x = "<p>no</p>"</script>'
        rows.append((i, f"http://a/{i}", FRAMES[i % 3 if i >= 80 else i % 2].format(inner)))
        want[i] = "\n".join(texts)
    spark.createDataFrame([*rows, (500, None, None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.op9_html(spark, str(tmp_path)).collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()} | {500: ("", 0)}


def test_sample_has_one_of_equal_rows(spark):
    from canonry.llm import common

    df = spark.createDataFrame([("same",)] * 1000 + [(f"p{i}",) for i in range(2000)], "html string")
    assert common.sampled(df.where("html = 'same'"), 100, "html").count() == 1
    assert 40 <= common.sampled(df, 100, "html").count() <= 120
    assert common.sampled(df, 5000, "html").count() == 2001


def test_long_pages_are_labels_too(spark):
    long = [page(f"<h1>Title {i} here</h1>" + "<p>Some words &amp; more words.</p>" * 800) for i in range(5)]
    assert min(map(len, long)) > 20_000
    df = spark.createDataFrame([(p,) for p in long + [None, "<main", "no label"]], "html string")
    learnt, want = html.learn(df), html.fit(long)
    assert learnt.cost == want.cost and learnt.cost
    assert html.learn(spark.createDataFrame([(None,), ("no label",)], "html string")).cost == {}


LONG = " ".join(f"word{i}" for i in range(60))


def body(inner):
    return f"<html><body>{inner}</body></html>"


def test_what_wraps_the_page_is_no_boilerplate():
    nav = "<nav><ul><li><a href=/>Home</a></ul></nav>"
    for tag in ("form id=f", "header", "nav", "aside", "dialog"):
        name = tag.split()[0]
        assert html.main_text(body(f"<{tag}>{nav}{ARTICLE}</{name}>"), W) == TEXT
        assert html.main_text(body(f"<{tag}><ul><li>Home<li>About</ul>{ARTICLE}"), W) == TEXT
    assert html.main_text(body(f'<form><input type="hidden" name=a><input type=hidden>{nav}<p>{LONG}</p><input></form>'), W) == LONG
    # A form stays a form, and an article in a sidebar what it is.
    assert html.main_text(body(f"<p>{LONG}</p><form><p>Write to us</p><input><input><button>Send it</button></form>"), W) == LONG
    assert html.main_text(body(f"<div><p>{LONG}</p></div><aside><article><p>Read this too</p></article></aside>"), W) == LONG
    cards = "<article><p>Read this too</p></article>" * 3
    assert html.main_text(body(f"{ARTICLE}<aside>{cards}</aside><footer>{cards}</footer>"), W) == TEXT
    replies = f'<section class="comments"><article class="comment"><p>{LONG}</p></article></section>'
    assert html.main_text(body(ARTICLE + replies), W) == TEXT
    assert html.main_text(body(ARTICLE.replace("</article>", replies + "<p>Then on</p></article>")), W) == TEXT + "\nThen on"


def test_lists_tables_and_short_blocks_stay():
    items = [f"one{i}" for i in range(400)]
    listed = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
    assert html.main_text(body(f"<article><p>{LONG}</p>{listed}<p>{LONG}</p></article>"), W) == "\n".join([LONG, *items, LONG])
    for short, want in (
        ("<ul><li>a</li><li>b</li></ul>", "a\nb"),
        ("<h2>One</h2>", "One"),
        ("<table><caption>Cap</caption><tr><td>a</td><th>b</th></tr></table>", "Cap\na\nb"),
        ("<dl><dt>t0</dt><dd>d0</dd><dt>t1</dt><dd>d1</dd></dl>", "t0\nd0\nt1\nd1"),
        ("<figure><img><figcaption>It</figcaption></figure>", "It"),
    ):
        assert html.main_text(body(f"<article>{short}<p>{LONG}</p>{short}</article>"), W) == f"{want}\n{LONG}\n{want}"
        assert html.main_text(body(f"<main>{short}</main><p>Sign up for our newsletter</p>"[: None if "t0" in want else 13 + len(short)]), W) == want
    assert html.main_text(body(f"{ARTICLE}<p>Sign up for our newsletter and get all of it</p>"), W) == TEXT


def test_a_name_does_not_hide_most_of_a_page():
    for name in ("content-widget", "social", "promo"):
        assert html.main_text(body(f'<div class="{name}"><p>{LONG}</p></div><div class="x"><p>one two</p></div>'), W).startswith(LONG)
    assert html.main_text(body(f'<p>The text of it</p><div class="comments"><p>{LONG}</p></div>'), W) == "The text of it"
    links = "".join(f"<li><a href=/{i}>Item number {i}</a>" for i in range(100))
    assert html.main_text(body(f'<div class="menu"><ul>{links}</ul></div><p>The text of it</p>'), W) == "The text of it"


def test_frames_that_share_nothing_with_the_fitted_ones():
    """What is put in comes out, whatever stands around it."""
    import random

    rng = random.Random(5)
    word = lambda: "w" + str(rng.randint(0, 9999))
    say = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    for _ in range(200):
        want, inner = [], ""
        for _ in range(rng.randint(1, 8)):
            kind = rng.choice(("p", "ul", "dl", "table", "h4", "pre", "section"))
            texts = [say(1, 30) for _ in range(1 if kind in ("p", "h4", "pre", "section") else rng.randint(1, 5))]
            want += texts
            cell = {"ul": "<li>{}", "dl": "<dd>{}</dd>", "table": "<tr><td>{}</td></tr>"}.get(kind, "{}")
            inner += f"<{kind}>" + "".join(cell.format(t) for t in texts) + f"</{kind}>"
        tag = rng.choice(("article", "main"))
        made = f"<{tag}>{inner}</{tag}>"
        for _ in range(rng.randint(0, 3)):
            wrap = rng.choice(("center", "form", "section class=s", "td", "header", "div id=app"))
            made = f"<{wrap}>{made}</{wrap.split()[0]}>"
        made = rng.choice(("", "<menu><li>File<li>Edit</menu>", "<font>x1</font>")) + made + rng.choice(("", "<small>x2</small>", "<footer><p>x3 x4</footer>"))
        got = html.main_text(body(made), W)
        inside = sum(len(t.split()) for t in want)
        if inside >= 2:
            assert got == "\n".join(want)

import hashlib
import random
import re
import time
from html import unescape

from axonframe.llm.html_diff import copies, extract, lines_of, main_text, shared_lines

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="</p><article>no</article>";</script></head>
<body><header>Site</header><nav><ul><li>Menu</li></ul></nav><div class="ad">Buy</div><aside>Side</aside><form>Name <input></form>
<article><h1>Ti&amp;tle &#233;</h1><p>One  two<b>three</b>\n four<br>five</p><div id="comments"><p>First!</p></div><p>a &lt; b</article>
<footer>&copy; x</footer></body></html>"""


def test_article_alone():
    assert main_text(lines_of(PAGE), lines_of(PAGE)) == "Ti&tle é One twothree four five a < b"


def test_without_article_shared_lines_go():
    mine = lines_of("<p>Welcome</p><p>Only here</p><p>Bye</p>")
    assert main_text(mine, lines_of("<p>Welcome</p><p>Other</p><p>Bye</p>")) == "Only here"
    assert main_text(mine, []) == "Welcome Only here Bye"


def test_broken_markup():
    for html in ("", "<", "<p", "text &am", "<script>never closed", "<b><p>x</b>y</article>z", "<!-- open", "</p></p>x", "<head><p>x</p>"):
        lines_of(html)
    assert [x for x, _ in lines_of("<b><p>x</b>y</article>z")] == ["xy", "z"]


def lcs_length(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        got = [a[i] for i in sorted(shared_lines(a, b))]
        assert len(got) == lcs_length(a, b)
        rest = iter(b)
        assert all(x in rest for x in got)


def test_query_on_edge_cases(spark):
    rows = [(1, "http://h.x/a/1", PAGE), (2, "http://h.x/a/2", PAGE), (2, "http://h.x/a/2", PAGE), (3, None, None), (None, "", ""), (4, "http://h.x/b", "<p>" + "w " * 50_000)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, text string, _host string")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in extract(df).collect()}
    want = "Ti&tle é One twothree four five a < b"
    assert got == {(1, "http://h.x/a/1"): (want, len(want)), (2, "http://h.x/a/2"): (want, len(want)), (3, None): ("", 0), (None, ""): ("", 0), (4, "http://h.x/b"): (("w " * 50_000).strip(), 99_999)}
    assert extract(df).count() == 6 and extract(df.limit(0)).count() == 0
    assert unescape("&eacute;") == "é"


def test_copies_delete_nothing_from_each_other(spark):
    menu, end = "<p>Home | News</p>", "<p>Imprint</p>"
    body = lambda c, day="": menu + "".join(f"<p>{c}{i} {'word ' * 20}</p>" for i in range(5)) + day + end
    text = lambda c: " ".join(f"{c}{i} {'word ' * 20}".strip() for i in range(5))
    rows = [(i, f"http://h.x/a/{i}", body("a")) for i in range(4)] + [(4, "http://h.x/a/4", body("a", "<p>Monday</p>")), (5, "http://h.x/a/5", body("b"))]
    rows += [(10, None, body("c")), (11, None, body("c")), (11, None, body("c")), (20, "http://g.x/1", body("d")), (21, "http://g.x/2", body("d"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        got = {r.page_id: r.text for r in extract(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert [got[i] for i in range(4)] == [text("a")] * 4 and got[4] == text("a") + " Monday" and got[5] == text("b")
    assert all(got[i] == f"Home | News {text(c)} Imprint" for i, c in ((10, "c"), (11, "c"), (20, "d"), (21, "d")))


def test_marks_name_the_element_itself():
    pages = [
        '<body class="has-sidebar"><p>Text</p><div class="left-sidebar">Side</div></body>',
        '<html class="no-banner"><body class="single comment-open"><article class="post social"><p>Text</p></article></body></html>',
        '<div class="content no-sidebar"><p>Text</p></div>',
        '<div class="sidebar"><div id="menu"><main class="widget"><p>Text</p><p class="share">Tell</p></main></div></div>',
        '<div class="page-header"><article><p>Text</p></article></div>',
        '<div class="widget"><article><p>Text</p></article></div><div class="nav">Menu</div>',
        '<article><p>Text</p></article><div class="related"><article><p>Teaser</p></article></div>',
        '<article><p>Text</p><div class="related"><article><p>Teaser</p></article></div></article>',
        '<div hidden><main>No</main></div><div class="site-header">Site</div><p>Text</p>',
    ]
    assert [main_text(lines_of(p), []) for p in pages] == ["Text"] * len(pages)


def small_html(rng, host):
    """A page of a host: menu and footer that all its pages have, paragraphs of its own or of another page, with and without an article."""
    own = [f"<p>{' '.join(rng.choice('abcdefgh') * rng.randint(1, 9) for _ in range(rng.randint(3, 40)))}</p>" for _ in range(rng.randint(0, 5))]
    body = "".join([f"<p>{host} home</p>", *own, f"<div>More on {host}</div>", *(["<p>Share</p>"] if rng.random() < 0.5 else [])])
    return f"<article>{body}</article><p>Imprint</p>" if rng.random() < 0.3 else f"<nav>Menu</nav>{body}<p>Imprint</p>"


def brute_extract(rows):
    """All pages, by looking at every other page of the host and a whole table of subsequences."""
    split = lambda url: re.match(r"(?:[a-z]+://([^/?#]*))?([^?#]*)", url or "").groups("")
    spot = lambda r: (*(x.encode() for x in split(r[1])), r[0] is not None, r[0] or 0, hashlib.md5((r[2] or "").encode()).hexdigest())
    out = []
    for row in rows:
        mine, lines = spot(row), lines_of(row[2] or "")
        runs = []
        for r in sorted((r for r in rows if spot(r)[0] == mine[0]), key=spot):
            if runs and (runs[-1][0][2] or "") == (r[2] or ""):
                runs[-1].append(r)
            else:
                runs.append([r])
        n = next(n for n, run in enumerate(runs) if row in run)
        sides = [[run[-1] for run in runs[max(0, n - 3) : n][::-1]], [run[0] for run in runs[n + 1 : n + 4]]]
        near = [next((r for r in side if not copies(lines, lines_of(r[2] or ""))), None) for side in sides]
        near = [r for r in near if r]
        same = lambda r: next((i for i, (x, y) in enumerate(zip(split(r[1])[1] + "\0", split(row[1])[1] + "\1")) if x != y))
        other = [x for x, _ in lines_of(max(near, key=same)[2] or "")] if near else []
        mine = [x for x, _ in lines]
        gone, i, j = set(), 0, 0
        while i < len(mine) and j < len(other):
            if mine[i] == other[j] and lcs_length(mine[i:], other[j:]) == 1 + lcs_length(mine[i + 1 :], other[j + 1 :]):
                gone.add(i)
                i, j = i + 1, j + 1
            elif lcs_length(mine[i + 1 :], other[j:]) == lcs_length(mine[i:], other[j:]):
                i += 1
            else:
                j += 1
        main = any(region == "main" for _, region in lines)
        text = " ".join(x for i, (x, region) in enumerate(lines) if region == "main" or region == "other" and not main and i not in gone)
        out.append((row[0], row[1], text, len(text)))
    return out


def test_query_matches_brute_force_whatever_the_partitions(spark):
    rng, rows = random.Random(4), []
    for i in range(150):
        host = rng.choice(["big.x", "big.x", "big.x", "two.x", "one.x"])
        html = rng.choice(rows)[2] if rows and rng.random() < 0.3 else small_html(rng, host)
        rows.append((i, f"http://{host}/{rng.choice('ab')}/{rng.randint(0, 30)}{rng.choice(['', '?q=1', '#top'])}", html))
    rows += [rows[3], rows[3], (None, rows[5][1], rows[6][2]), (None, None, rows[7][2]), (200, None, small_html(rng, "none"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = brute_extract(rows)
    alone = [main_text(lines_of(html or ""), []) for _, _, html in rows]
    print("pages that differencing changes:", sum(w[2] != t for w, t in zip(want, alone)), "of", len(rows))
    assert sum(w[2] != t for w, t in zip(want, alone)) > 60
    for parts in (1, 4, 13):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = [tuple(r) for r in extract(df).collect()]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_repeated_unmarked_rows_keep_their_text(spark):
    df = spark.createDataFrame([(1, "http://h/a", "<p>Menu</p><p>only</p>")] * 2, "page_id long, url string, html string")
    assert [(r.text, r.n_chars) for r in extract(df).collect()] == [("Menu only", 9)] * 2


def test_pages_of_very_many_lines():
    rng = random.Random(6)
    mine, other = ([f"line {rng.randrange(30_000)}" for _ in range(50_000)] for _ in range(2))
    got = [mine[i] for i in sorted(shared_lines(mine, other))]
    rest = iter(other)
    assert all(x in rest for x in got) and len(got) > 300
    assert len(shared_lines(mine, mine[:100] + other[:100] + mine[100:])) == 50_000


def test_attributes_are_whole_names():
    for html in ('<article style="overflow:hidden"><p>Text</p></article>', '<article data-hidden="false"><p>Text</p></article>', '<div data-id="menu-1"><p>Text</p></div>', '<p title="class=menu">Text</p>', "<p title='id=ad hidden'>Text</p>",
                 '<div x-class="menu">Text</div>', '<div classes="menu">Text</div>', '<p data-role="navigation" hiddenx>Text</p>', '<div class=a/b id = "c" >Text</div>', "<div =hidden>Text</div>", '<a href=/menu/hidden class=x>Text</a>'):
        assert main_text(lines_of(html), []) == "Text", html
    for html in ('<div class="menu">No</div>', "<div ID = 'menu'>No</div>", "<div class=menu>No</div>", "<div hidden>No</div>", '<div aria-hidden="TRUE">No</div>', '<div a="x>y" role=navigation>No</div>', '<div class="x"class="y"hidden>No</div>', "<article hidden>No</article>"):
        assert main_text(lines_of(html), []) == "", html
    assert main_text(lines_of('<div class="a" class="menu">Text</div>'), []) == "Text"  # the first counts
    assert main_text(lines_of('<p title="a > b">Text</p>'), []) == "Text"


def test_odd_pages_take_linear_time():
    n = 1 << 20
    for unit, end in (("<a ", '"'), ("<a ", "'"), ("<a b='", ""), ('<a b="', ""), ("<a b=", '"'), ("<", ""), ("<a>", ""), ("</a>", ""), ("<a></b>", ""), ("<head>", ""), ("<div class=menu>", "x"), ("<div class=menu><main>", "x"), ("<p>x", ""), ("<!--", ""), ("<![CDATA[", ""), ("<!", ""), ("&", ""), ("<a ='", ""), ("<b x", "")):
        began = time.time()
        lines_of(unit * (n // len(unit)) + end)
        assert time.time() - began < 8, unit


def test_marks_around_marks():
    inside = '<div class="menu"><div id="ad"><main><p>Text</p><div class="share"><p>Tell</p></div></main></div><p>Buy</p></div><div class="sidebar">Side</div>'
    assert lines_of(inside) == [("Text", "main"), ("Tell", "chrome"), ("Buy", "other"), ("Side", "chrome")]

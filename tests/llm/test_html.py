import html as references
import re

import pytest

from tidewatch.llm import html as H


def texts(page):
    return [t for t, _ in H.region(H.parse(page))]


@pytest.mark.parametrize("page,want", [
    ("", []),
    ("plain &amp; simple", ["plain & simple"]),
    ("<article><h1>T</h1><p>a  b\n c<br>d<p>e &lt;x&gt;</article><footer>f</footer>", ["T", "a b c d", "e <x>"]),
    ("<body><nav><a href=x>menu</a></nav><div class='ad'>buy</div><div id=content><p>text <b>bold</b> <i>it</i></p>tail</div><aside>side</aside>", ["text bold it", "tail"]),
    ("<article><p><b>open<br><p>next</article>", ["open", "next"]),
    ("<head><title>t</title><style>p{}</style></head><body><script>var t='</p><article>';</script><p>x", ["x"]),
    ("<div class=page-with-sidebar><article>in</article><div class='sidebar'>out</div></div>", ["in"]),
    ("<article><p>a</p><section class='comments'><p>c1</p></section><article class='comment'>c2</article><form>f</form></article>", ["a"]),
    ("<article>a<!-- <p>no --> b <p hidden>h</p><p style='display: none'>h</p></article>", ["a b"]),
    ("<main><ul><li>1<li>2</ul><table><tr><td>x<td>y</table></main>", ["1", "2", "x", "y"]),
    ("<p>unclosed <a href=\"x>y</p><p>z</p>", ["unclosed y", "z"]),
    ("<div class=cookie-notice>c</div><header><a>logo</a></header><p>x<button>no</button> y</p>", ["x y"]),
    ("<article></article><p>only here</p>", ["only here"]),
    ("a < b and c > d", ["a < b and c > d"]),
])
def test_region(page, want):
    assert texts(page) == want


@pytest.mark.parametrize("tag", sorted(H.SKIPPED))
def test_unclosed_skipped_elements(tag):
    """They end with the element they stand in, and never take the article along."""
    article = "<article><h1>T</h1><p>text</p></article>"
    assert texts(f"<body><nav><{tag}>Menu<b>x</b></nav>{article}<p>after") == ["T", "text"]
    assert texts(f"<body><div><span><{tag}>Menu</span></div>{article}<{tag}>x</{tag}>") == ["T", "text"]
    assert texts(f"<body><{tag}>{article}") == ["T", "text"]
    inner = "</p>" if tag in H.PLAIN else "<p>n</p>" if tag != "head" else "<meta>"
    assert texts(f"<article><p>a <{tag}>{inner}</{tag}> b</p></article>") == ["a b"]


@pytest.mark.parametrize("page,want", [
    ("<html><head><title>t</title><meta charset=x><body><p>x</p>", ["x"]),
    ("<head><title>t</title><link rel=y><noscript><style>p{}</style></noscript><div>y</div>", ["y"]),
    ("<article><p>a</p><div><noscript><div><div>n</div></div><article>n</article></noscript>b</div></article>", ["a", "b"]),
    ("<head><title>t</title>\nwords <p>z", ["words", "z"]),
    ("<article><div><svg><svg><g></svg></g></svg>c</div></article>", ["c"]),
    ("<article><div><textarea></div><p>t</textarea>d</div></article>", ["d"]),
])
def test_skipped_elements(page, want):
    assert texts(page) == want


def brute_match(a, b):
    """Simple tree matching by its recursive definition, over (tag, hash, children)."""
    if a[0] != b[0]:
        return 0
    m = [[0] * (len(b[2]) + 1) for _ in range(len(a[2]) + 1)]
    for i, x in enumerate(a[2]):
        for j, y in enumerate(b[2]):
            w = brute_match(x, y)
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + w)
    return 1 + (1 if a[1] and a[1] == b[1] else 0) + m[-1][-1]


def test_alignment_finds_equal_texts():
    seed = "<body><div>menu</div><article><h1>A</h1><p>one</p><p>SUBSCRIBE</p></article><div>foot</div></body>"
    page = "<body><div>menu</div><article><h1>B</h1><p>x</p><p>y</p><p>z</p><p>SUBSCRIBE</p></article><div>foot</div></body>"
    root, tree = H.parse(page), H.Seed(H.skeleton(H.parse(seed)))
    assert H.align(root, tree) == brute_match(H.skeleton(root), H.skeleton(H.parse(seed))) == 11
    marked = [n for n in walk(root) if n.mark >= 0]
    assert [n.items[0] for n in marked] == ["menu", "SUBSCRIBE", "foot"] and all(tree.nodes[n.mark][1] == H.own(n) for n in marked)


def walk(n):
    yield n
    for k in n.kids:
        yield from walk(k)


def test_deep_and_long_pages():
    assert texts("<div>" * 5000 + "deep") == ["deep"]
    root = H.parse("<div>" * 3000 + "deep")
    H.align(root, H.Seed(H.skeleton(root)))
    assert len(texts("<article>" + "<p>x y" * 20000 + "</article>")) == 20000
    assert texts("<a href='" * 3000 + "x") is not None


def page(i, extra="", host="h"):
    return f"<body><div>Welcome to {host}</div><p>Sign up for our letter</p><p>Text number {i} {extra}</p><p>other {i * 7}</p></body>"


def test_templates_over_pages(spark):
    rows = [(i, f"http://h.example/{i}", page(i), "x") for i in range(20)]
    rows += [(100 + i, "http://copy.example/", page(1, host="copy"), None) for i in range(20)]  # copies are no evidence
    rows += [(200, "http://one.example/", page(5, host="one"), None), (201, None, page(6), None), (202, "::bad url", "", None), (203, "http://h.example/z", None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(4)
    got = {r.page_id: r.text for r in H.extract(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == f"Text number {i}\nother {i * 7}" for i in range(20))
    assert all(got[100 + i] == "Welcome to copy\nSign up for our letter\nText number 1\nother 7" for i in range(20))
    assert got[200].startswith("Welcome to one") and got[201].startswith("Welcome") and got[202] == got[203] == ""
    assert H.extract(df.limit(0)).collect() == []


def near_copy(i, tags="div"):
    """One article with its date and a sentence changed."""
    body = "".join(f"<p>Paragraph {k} of the one long story.</p>" for k in range(8))
    return f"<body><{tags}><p>Day {i}</p>{body}<p>Changed sentence {i}</p></{tags}><div>Shop footer line</div></body>"


def test_near_copies_are_no_template(spark):
    """Hosts made of near copies keep every paragraph, whether they mark an article or not."""
    rows = [(i, "http://plain.example/", near_copy(i)) for i in range(12)]
    rows += [(100 + i, "http://marked.example/", near_copy(i, "article")) for i in range(12)]
    # near copies are most of the host, but other pages show what is template
    rows += [(200 + i, "http://mixed.example/", near_copy(i)) for i in range(12)]
    rows += [(300 + i, "http://mixed.example/", f"<body><div><p>Own {i}</p><p>words {i}</p><p>end {i}</p></div><div>Shop footer line</div></body>") for i in range(9)]
    # a heading that half of the articles share
    rows += [(400 + i, "http://heads.example/", f"<article><h1>Summary</h1><p>Case {i}</p><p>Rest {i}</p></article>") for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text.split("\n") for r in H.extract(df).collect()}
    story = lambda i: [f"Day {i}", *[f"Paragraph {k} of the one long story." for k in range(8)], f"Changed sentence {i}"]
    for i in range(12):
        assert got[i] == [*story(i), "Shop footer line"]
        assert got[100 + i] == story(i)
        assert got[200 + i] == story(i)
    assert all(got[300 + i] == [f"Own {i}", f"words {i}", f"end {i}"] for i in range(9))
    assert all(got[400 + i] == ["Summary", f"Case {i}", f"Rest {i}"] for i in range(6))


def test_pages_with_articles_are_aligned_and_vote(spark):
    """What stands around articles is template on the host's other pages; what stands in articles stays."""
    article = "<body><div>Shop name</div><article><p>Case {0}</p><p>Always said</p><p>Rest {0}</p></article><div>Call us</div></body>"
    other = "<body><div>Shop name</div><div><p>Own {0}</p><p>words {0}</p></div><div>Call us</div></body>"
    rows = [(i, "http://h.example/", article.format(i)) for i in range(8)] + [(100 + i, "http://h.example/", other.format(i)) for i in range(2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    marked = [r for r in H.blocks(df).collect() if r._article]
    assert len(marked) == 8 and all(len(r._around) == 2 for r in marked)
    got = {r.page_id: r.text for r in H.extract(df).collect()}
    assert all(got[i] == f"Case {i}\nAlways said\nRest {i}" for i in range(8))
    assert all(got[100 + i] == f"Own {i}\nwords {i}" for i in range(2))


def test_query_against_a_plain_parse(spark):
    from tidewatch.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    want = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = r.html[r.html.index("<article>"):r.html.index("</article>")]
        parts = re.split(r"</?(?:p|h1|article)>", re.sub(r"</?b>", "", body.replace("<br>", " ")))
        parts = [" ".join(references.unescape(p).split()) for p in parts]
        want[r.page_id] = "\n".join(p for p in parts if p)
    got = QUERIES["op10_html"](spark, sf).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)

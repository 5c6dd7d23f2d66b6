"""Main-text extraction: page parts, templates of a host, and odd rows."""

import pytest

from skyloom.llm import page_template
from skyloom.llm.markup import TEXT, events
from skyloom.llm.page_template import _Names, _Template, _Walk, classes, main_text, main_texts

PAGES = "page_id long, url string, html string, host string, text string"


def texts(spark, rows):
    """(page_id, text, n_chars) of (page_id, url, html) rows; the table has columns that clash with the operator's."""
    found = main_texts(spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES)).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    return sorted((r["page_id"] if r["page_id"] is not None else -1, r["text"]) for r in found)


def alone(html):
    return main_text(html, _Template(None), None, set())


@pytest.mark.parametrize("html, text", [
    ("<p>one<p>two", "one\ntwo"),
    ("<article>a &amp;amp; b&lt;c&#233;</article>", "a &amp; b<cé"),
    ("<nav>x</nav><article><h1>T</h1><p><b>bold<br><p>next  \n line</article><footer>f</footer>", "T\nbold\nnext line"),
    ("<article>a<script>var t='</p>'</script>b<!-- c > d --><style>x{}</style></article>", "ab"),
    ("<ARTICLE>Up<P CLASS='ad'>no</P>down</ARTICLE>", "Up\ndown"),
    ("<article><p>one<br>two<div class='post-comments'><p>c</div><aside>s</aside><form>f <input></form><p>three</article>", "one two\nthree"),
    ("<article class='post comments-open'><p>kept</article><article class='comment'>gone</article>", "kept"),
    ("<header>site</header><main><header><h1>Title</h1></header><p>body</main>", "Title\nbody"),
    ("<div role=navigation>x</div><div role='main'>body <a href='/x'>link</a>.</div>", "body link."),
    ("<div class='cookie-notice'>x</div><div class='content'><h1>Head</h1><p>some running words of text</p><p>more of them</p></div><div class='site-footer'>f</div>",
     "Head\nsome running words of text\nmore of them"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"),
    ("<article>cut off <b>here", "cut off here"),
    ("<article>x <a title='a > b'>y</a> 1 < 2", "x y 1 < 2"),
    ("<article>" + "<p>w</p>" * 3, "w\nw\nw"),
    ("<article><table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("<article>one<noscript>no</noscript><button>no</button><p>\x0b \t</p>two", "one\ntwo"),
    ("<script>never closed <article>x", ""),
    ("", ""),
])
def test_one_page(html, text):
    assert alone(html) == text


def test_long_and_broken_markup():
    """Neither unclosed quotes nor endless nesting take more than linear time."""
    assert alone("<article>" + "<b><i>" * 30_000 + "x") == "x"
    assert alone("<article>" + '<a "' * 20_000 + "> end") .endswith("end")
    assert len(alone("<article>" + "word " * 400_000)) == 5 * 400_000 - 1


def site(i, body, host="h.example", close=True):
    return (
        f"http://{host}/{i}",
        f"<html><head><title>t{i}</title></head><body><div class=top><a href=/>Start</a> <a href=/{i}>page {i}</a></div><div class=text><h2>Head {i}</h2>{body}"
        f"<p>Printed on every page of this site</p></div><div class=end>Imprint <a href=/i>of us {i}</a></div>" + ("</body></html>" if close else ""),
    )


def bodies(n):
    return [" ".join(f"<p>line {j} says w{i * j} and v{i + j} in x{i}</p>" for j in range(1 + i % 4)) for i in range(n)]


def plain(i, body):
    return "\n".join([f"Head {i}", *[b.replace("<p>", "").replace("</p>", "") for b in body.split("</p> ")]])


def test_template_of_a_host(spark):
    """Without an article element the host's slots decide; what every page prints is a notice; few pages have no template."""
    found = bodies(30)
    rows = [(i, *site(i, b, close=i % 5 > 0)) for i, b in enumerate(found)]
    assert texts(spark, rows) == [(i, plain(i, b)) for i, b in enumerate(found)]
    few = texts(spark, rows[:3])
    assert [t for _, t in few] == [plain(i, b) + "\nPrinted on every page of this site" for i, b in enumerate(found[:3])]


def test_many_hosts(spark, monkeypatch):
    """Templates that are joined by a shuffle, for more than one host, give what broadcast ones give."""
    found = bodies(24)
    rows = [(i, *site(i, b, f"{'ab'[i % 2]}.example")) for i, b in enumerate(found)] + [(100, None, "<article>x</article>")]
    want = texts(spark, rows)
    assert want[:24] == [(i, plain(i, b)) for i, b in enumerate(found)]
    monkeypatch.setattr(page_template, "BROADCAST_HOSTS", 0)
    assert texts(spark, rows) == want


def test_copies_are_no_template(spark):
    """A host of many copies of one page keeps its text: copies count as one page."""
    url, html = site(1, bodies(3)[2])
    want = plain(1, bodies(3)[2]) + "\nPrinted on every page of this site"
    assert texts(spark, [(i, url, html) for i in range(40)]) == [(i, want) for i in range(40)]


def test_odd_rows(spark):
    rows = [(1, None, None), (None, "no host", ""), (2, "http://a/", "<article>x</article>"), (2, "http://a/", "<article>x</article>"), (3, None, "plain &copy; text")]
    assert texts(spark, rows) == [(-1, ""), (1, ""), (2, "x"), (2, "x"), (3, "plain © text")]
    assert texts(spark, []) == []


def test_classes_are_those_of_equal_vectors(spark):
    """The distributed classes equal those of plain occurrence vectors."""
    pages = [site(i, b)[1] for i, b in enumerate(bodies(12))]
    vectors, names = {}, _Names()
    for k, page in enumerate(pages):
        for event in events(page):
            if event.kind != TEXT:
                vectors.setdefault(names.tag(event), [0] * len(pages))[k] += 1
    groups = {}
    for token, vector in vectors.items():
        if sum(map(bool, vector)) >= 8:
            groups.setdefault(tuple(vector), set()).add(token)
    found = classes(spark.createDataFrame([("h", p) for p in pages], "host string, html string")).collect()
    assert len(found) == 1
    got = [set(c["tokens"]) & vectors.keys() for c in found[0]["classes"]]
    assert sorted(map(sorted, (g for g in got if len(g) > 1))) == sorted(map(sorted, (g for g in groups.values() if len(g) > 1)))


def test_order_and_nesting_are_checked():
    """A token out of order and an occurrence that another class cuts are found."""
    template = _Template([{"inner": False, "tokens": [1, 2, 3, 4]}, {"inner": True, "tokens": [7, 8]}])

    def broken(tokens):
        walk = _Walk(template)
        for t in tokens:
            walk.meet(t)
        return walk.broken

    assert broken([1, 2, 7, 8, 7, 8, 3, 4]) == set()
    assert broken([1, 3, 2, 4]) == {3, 2, 4}
    assert broken([1, 2, 7, 3, 8, 4]) == {7, 8}

import math
import time
from html.parser import HTMLParser

import numpy as np
import pytest

from docket.llm import extract as X
from docket.llm import queries

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li>News</ul></nav><!-- ad <p>no</p> --><div class="ad">Buy this now.</div>
<article><h1>A &amp; B&copy;</h1><p><b>First  line<br>goes\non. <p>Second &#233;&nbsp;x &lt;p&gt; <i>in</i>side.
<div class="comments"><p>I disagree with the writer.</p></div></article><footer>&copy; someone</footer></body></html>"""


@pytest.fixture(scope="module")
def labeller():
    return X.trained()


def test_blocks():
    got = [(b[0], b[1], round(b[2], 2)) for b in X.blocks_of(PAGE)]
    assert got == [
        ("title", "T", 0), ("li", "Home", 1), ("li", "News", 0), ("div", "Buy this now.", 0),
        ("h1", "A & B©", 0), ("p", "First line goes on.", 0), ("p", "Second é x <p> inside.", 0),
        ("p", "I disagree with the writer.", 0), ("footer", "© someone", 0),
    ]
    assert X.blocks_of(None) == X.blocks_of("") == X.blocks_of("<p> </p><br><!-- x") == []
    assert [b[1] for b in X.blocks_of('a < b <p x="1>2" y=\'<\'>c<td>d<td>e</table></p>f<script>g')] == ["a < b", "c", "d", "e", "f"]
    assert [b[1] for b in X.blocks_of("<p title=it's>First</p><p>Second don't</p><p>Third</p>")] == ["First", "Second don't", "Third"]


def test_bad_and_deep_markup_takes_time_in_proportion():
    for bad in ("<script ", '<p a="x ', "<div>x", "<!-- ", "</x>", "<li><ul>x", "<", "<td><section>", "<p a='", "<dl><dt>x<div><dd>"):
        began = time.time()
        X.blocks_of(bad * (1_000_000 // len(bad)))
        assert time.time() - began < 20, bad


def test_all_of_a_path_counts():
    deep = "<div class=comments>" + "<div class=a>" * 40
    plain = "<div class=article>" + "<div class=a>" * 40
    x, y = (X.features(X.blocks_of(p + "text"))[0] for p in (deep, plain))
    assert (x != y).any()
    stack = X.OpenPath()
    for tag in ("div", "p", "div"):
        stack.push(tag, X.names_of(tag, "menu a"))
    stack.close(0)
    assert not stack.vector.any()


def plain_logits(labeller, x):
    """The labeller in plain loops, for one page."""
    def lstm(rows, w, u):
        size = len(u)
        h, c, out = [0.0] * size, [0.0] * size, []
        for row in rows:
            z = [sum(a * w[i][k] for i, a in enumerate(row) if a) + sum(h[i] * u[i][k] for i in range(size)) for k in range(4 * size)]
            s = lambda v: 1 / (1 + math.exp(-v))
            i, f, o = ([s(z[g * size + k] + (g == 1)) for k in range(size)] for g in range(3))
            c = [f[k] * c[k] + i[k] * math.tanh(z[3 * size + k]) for k in range(size)]
            h = [o[k] * math.tanh(c[k]) for k in range(size)]
            out.append(h)
        return out

    p = [a.astype(float).tolist() for a in labeller.p]
    forth, back = lstm(x, p[0], p[1]), lstm(x[::-1], p[2], p[3])[::-1]
    return [
        sum(v * p[4][k][0] for k, v in enumerate([*a, *b])) + sum(v * p[5][k][0] for k, v in enumerate(row))
        for a, b, row in zip(forth, back, x)
    ]


def test_against_plain_loops(labeller):
    rng = np.random.default_rng(9)
    pages = [X.features(X.blocks_of(X.make_page(rng)[0])) for _ in range(3)]
    for page, marks in zip(pages, labeller.main_blocks(pages)):
        want = plain_logits(labeller, page.astype(float).tolist())
        got = labeller.logits(*X.padded([page]))[:, 0]
        assert np.allclose(got, want, atol=1e-3) and (marks == (np.array(want) > 0))[np.abs(want) > 1e-2].all()


def test_query_gives_the_article_of_each_given_page(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    got = {r.page_id: r for r in queries.op8_html_extraction(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(pages)
    for page in pages:
        walk = Article()
        walk.feed(page.html or "")
        walk.end()
        assert got[page.page_id].text == "\n".join(walk.blocks) and got[page.page_id].n_chars == len(got[page.page_id].text)


class Article(HTMLParser):
    """The text blocks inside <article>, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.parts, self.inside = [], [], 0

    def end(self):
        if text := " ".join("".join(self.parts).split()):
            self.blocks.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
        elif tag not in X.INLINE:
            self.end()
        self.inside += tag == "article"

    def handle_endtag(self, tag):
        if tag not in X.INLINE:
            self.end()
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    labeller = X.Labeller(3)
    x, mask = X.padded([rng.standard_normal((n, X.INPUT)).astype(np.float32) for n in (4, 2, 5)])
    y = (rng.random(mask.shape) < 0.5).astype(np.float32)

    def loss():
        z = labeller.logits(x, mask).astype(np.float64)
        return float(((np.logaddexp(0, z) - y * z) * mask).sum() / mask.sum())

    for k, g in enumerate(labeller.gradients(x, mask, y)):
        direction = rng.standard_normal(g.shape).astype(np.float32)
        old = labeller.p[k]
        labeller.p[k] = old + 1e-3 * direction
        up = loss()
        labeller.p[k] = old - 1e-3 * direction
        slope = (up - loss()) / 2e-3
        labeller.p[k] = old
        assert abs(slope - float((g * direction).sum())) < 2e-2 * max(1, abs(slope))


def test_batches_do_not_change_labels(labeller):
    rng = np.random.default_rng(5)
    pages = [X.features(X.blocks_of(X.make_page(rng)[0])) for _ in range(40)] + [np.zeros((0, X.INPUT), np.float32)]
    whole = labeller.main_blocks(pages)
    for p, w in zip(pages, whole):
        assert (labeller.main_blocks([p])[0] == w).all()


def test_held_out_pages(labeller):
    rng, right, total = np.random.default_rng(123), 0, 0
    for _ in range(200):
        page, main = X.make_page(rng)
        blocks = X.blocks_of(page)
        marks = labeller.main_blocks([X.features(blocks)])[0]
        want = set(main)
        right += sum((b[1] in want) == m for b, m in zip(blocks, marks))
        total += len(blocks)
    assert right / total > 0.985


def test_held_out_plain_pages(labeller):
    rng, right, total = np.random.default_rng(321), 0, 0
    for _ in range(200):
        page, main = X.make_plain_page(rng)
        blocks = X.blocks_of(page)
        marks = labeller.main_blocks([X.features(blocks)])[0]
        want = set(main)
        right += sum((b[1] in want) == m for b, m in zip(blocks, marks))
        total += len(blocks)
    assert right / total > 0.985


FIRST, SECOND = "The council met on Monday, and it decided to close the bridge.", "It will be opened again in May."
HAND_MADE = [
    ('<body><div id="kopf">Startseite Nachrichten</div><div id="inhalt"><p>Der erste Absatz handelt von der Stadt.</p>'
     '<p>Der zweite Absatz sagt, was geschah.</p></div><div id="fuss">Impressum</div></body>',
     "Der erste Absatz handelt von der Stadt.\nDer zweite Absatz sagt, was geschah."),
    ('<div id="inhalt"><p>Der Artikel ist hier.</p></div><div id="fuss">Impressum</div>', "Der Artikel ist hier."),
    ("<p>The first one.</p><p>The second one.</p>", "The first one.\nThe second one."),
    (f"<div>{FIRST}</div><div>{SECOND}</div>", f"{FIRST}\n{SECOND}"),
    (f"<body><div><div>Home News Sport</div><div>{FIRST}</div><div>{SECOND}</div><div>© 2020 The Paper</div></div></body>", f"{FIRST}\n{SECOND}"),
    (f"<table><tr><td>Home News</td><td>{FIRST} {SECOND}</td></tr></table>", f"{FIRST} {SECOND}"),
    (f"<table><tr><td><a href=/>Home</a> <a href=/n>News</a></td><td><p>{FIRST}</p><p>{SECOND}</p></td></tr><tr><td>Contact</td></tr></table>", f"{FIRST}\n{SECOND}"),
]


@pytest.mark.parametrize(("page", "want"), HAND_MADE)
def test_pages_without_known_names(labeller, page, want):
    assert X.main_texts([page], labeller)[0][0] == want


def test_weights_are_trained_once(spark, monkeypatch):
    monkeypatch.setattr(X, "trained", lambda: X.Labeller(5))
    monkeypatch.setattr(X, "stored_weights", lambda spark, folder=X.stored_weights(spark) + "-test": folder)
    for _ in range(2):
        monkeypatch.setattr(X, "FITTED", {})
        got = X.fitted(spark)
        monkeypatch.setattr(X, "trained", lambda: X.Labeller(6))
        assert all((a == b).all() for a, b in zip(got.p, X.Labeller(5).p))


def test_extract(spark, labeller):
    rows = [(1, PAGE, 3), (2, None, 3), (3, "", 3), (1, PAGE, 3), (4, "<article>" + "<p>word &amp; word</p>" * 3000 + "</article>", 3)]
    out = X.extract(spark.createDataFrame(rows, "page_id long, html string, text int"), labeller).collect()
    assert [r.text for r in out if r.page_id == 1] == ["A & B©\nFirst line goes on.\nSecond é x <p> inside."] * 2
    assert [r.text for r in out if r.page_id in (2, 3)] == ["", ""]
    assert [r.text for r in out if r.page_id == 4] == ["\n".join(["word & word"] * 3000)]
    assert X.extract(spark.createDataFrame([], "page_id long, html string"), labeller).count() == 0

import random
import re

import numpy as np
import pytest

from marlstone.llm import blocklabel, htmlextract, urlfilter
from marlstone.llm.htmlblocks import read_blocks


def test_blocks():
    page = "<body><p>a &amp; b\n  c<p>d <b>e</b>f<br>g</p><ul><li>h<li>i</ul><script>x<p>y</script><!-- z --><div title='>'>j</div>k"
    assert [b.text for b in read_blocks(page)] == ["a & b c", "d ef g", "h", "i", "j", "k"]
    assert read_blocks(None) == read_blocks("") == read_blocks("<p> </p><br>") == []
    assert [b.text for b in read_blocks("a < b <x y='1")] == ["a < b <x y='1"]


def test_gradients_are_right():
    rng = random.Random(1)
    pages = []
    labels = []
    for _ in range(3):
        markup, lines = blocklabel.generated_page(rng)
        blocks = read_blocks(markup)[:6]
        pages.append(blocklabel.features(blocks))
        labels.append(blocklabel.labels_of(blocks, lines))
    truth, model = np.concatenate(labels), blocklabel.Labeller.fresh(2)

    def loss():
        x = np.concatenate([model.logits([p])[0] for p in pages])
        return np.mean(np.log1p(np.exp(x)) - truth * x)

    found = model.gradients(pages, truth)
    for name, part in model.parts.items():
        at = np.unravel_index(np.argmax(np.abs(found[name])), part.shape)
        part[at] += 1e-5
        up = loss()
        part[at] -= 2e-5
        down = loss()
        part[at] += 1e-5
        assert found[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7)


def test_labels_of_unseen_pages():
    rng, wrong, blocks_seen = random.Random(77), 0, 0
    labeller = blocklabel.trained()
    for _ in range(200):
        markup, lines = blocklabel.generated_page(rng)
        blocks = read_blocks(markup)
        if blocks:
            logits = labeller.logits([blocklabel.features(blocks)])[0]
            wrong += int(((logits > 0) != (blocklabel.labels_of(blocks, lines) > 0)).sum())
            blocks_seen += len(blocks)
    assert wrong < 0.01 * blocks_seen


def test_a_long_page_beside_small_ones():
    """Long pages run in pieces, with the same labels, and in memory that doesn't grow with what stands beside them."""
    import tracemalloc

    rng, labeller = random.Random(3), blocklabel.trained()
    page = blocklabel.features(read_blocks("".join(blocklabel.generated_page(rng)[0] for _ in range(250))))
    assert len(page[0]) > blocklabel.PIECE
    whole = labeller._forward([page], False)[0]
    assert np.allclose(labeller.logits([page])[0], whole)
    markup = "<p>a</p>" * 30_000
    blocks = read_blocks(markup)
    small = blocklabel.features(read_blocks("<p>b</p>"))
    long = blocklabel.features(blocks)
    tracemalloc.start()
    found = labeller.logits([small] * 63 + [long])
    assert [len(f) for f in found] == [1] * 63 + [30_000] and tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.stop()


def test_time_is_linear():
    """A megabyte of unclosed tags, comments, heads or open elements takes seconds at most."""
    import time

    for part in ("<b ", "<!-- ", "<head>", "<div>x", "<span>x", "<a '>", '<b ">y', "<script ", "</p", "<![CDATA["):
        began = time.time()
        read_blocks(part * (1_000_000 // len(part)))
        read_blocks(part * (500_000 // len(part)) + ">")
        assert time.time() - began < 20, part


def test_a_page_inside_one_form():
    page = '<body><form method="post" action="/x.aspx"><div class="menu"><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></div><div class="content"><h1>A title of the story</h1><p>The first sentence of the story is here. And a second one follows it.</p><p>More of the same story, told at some length.</p></div><div class="footer">Terms of use</div></form></body>'
    assert htmlextract.main_texts([page], blocklabel.trained())[0].split("\n") == ["A title of the story", "The first sentence of the story is here. And a second one follows it.", "More of the same story, told at some length."]


def test_extraction(spark):
    page = "<html><head><title>T</title></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class=ad>Buy a thing now.</div><article><h1>A title here</h1><p>First words of the story.<p>More of it &eacute; there.</article><footer>&copy; me</footer>"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "", ""), (None, "x", "<p>"), (4, "y", page.replace("More", "More and " * 20_000))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS key", "2 AS text")
    found = htmlextract.extract(df).collect()
    text = "A title here\nFirst words of the story.\nMore of it é there."
    assert [tuple(r) for r in found if r["page_id"] == 1] == [(1, "u", text, len(text))] * 2
    assert {(r["page_id"], r["text"], r["n_chars"]) for r in found if r["page_id"] in (2, 3, None)} == {(2, "", 0), (3, "", 0), (None, "", 0)}
    assert [r["n_chars"] for r in found if r["page_id"] == 4] == [len(text) - 5 + len("More and " * 20_000)]
    assert htmlextract.extract(df.limit(0)).count() == 0


def _glob(pattern):
    return re.compile("".join({"*": ".*", "+": "[^/]*"}.get(c, re.escape(c)) for c in pattern), re.S)


def test_automaton_against_regular_expressions():
    rng = random.Random(5)
    globs = ["".join(rng.choice("ab/*+.") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    urls = ["".join(rng.choice("ab/.") for _ in range(rng.randint(0, 14))) for _ in range(500)]
    found = urlfilter.Automaton([g.encode() for g in globs]).matches([u.encode() for u in urls], 64)
    want = [[_glob(g).fullmatch(u) is not None for g in globs] for u in urls]
    assert (found == np.array(want)).all()


def test_url_verdicts(spark):
    cases = {
        None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no scheme": ("", "", None, "allow"),
        "http://A.Example.ORG/en/12?x": ("a.example.org", "/en/12", "example.org/en/1", "block"),
        "http://example.org/en/2": ("example.org", "/en/2", "org/", "allow"), "http://badexample.org/es/": ("badexample.org", "/es/", "org/", "allow"),
        "https://x.com/de/1#f": ("x.com", "/de/1", "com/de/", "block"), "https://x.com": ("x.com", "", None, "allow"),
        "http://evil.net/a.org/es/": ("evil.net", "/a.org/es/", None, "allow"), "http://ads.z.net/q": ("ads.z.net", "/q", None, "block"),
    }
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)] + [(99, "http://é.org/" + "x" * 5000)], "page_id bigint, url string").selectExpr("*", "'c' AS host", "'d' AS key")
    found = {r["page_id"]: tuple(r)[1:] for r in urlfilter.filter_urls(df).collect()}
    assert [found[i] for i in range(len(cases))] == list(cases.values())
    assert found[99][2:] == ("org/", "allow")
    assert urlfilter.filter_urls(df.limit(0)).count() == 0

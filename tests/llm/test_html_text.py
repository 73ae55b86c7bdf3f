import re
import time

from tessera.llm import html_text as H


def test_held_out_pages_come_out_whole():
    model, right = H.trained(), 0
    pages = H.sample_pages(120, seed=1234)
    for page in pages:
        nodes, y = H.labelled(page)
        want = "\n".join(n.text for n, v in zip(nodes, y, strict=True) if v and n.tag == "run")
        right += H.main_texts([re.sub(r' y="[01]"', "", page)], model)[0] == want
    assert right >= 0.85 * len(pages)


def test_reading_of_markup():
    page = '<body><!-- <p>no --><p>a &amp; b&nbsp;<b>c<br>d<p>e<script>var t="</p>x";</script><ul><li>f<li>g</ul><div>h<p>i</div>j &am'
    runs = [n.text for n in H.parse(page) if n.tag == "run"]
    assert runs == ["a & b c d", "e", "f", "g", "h", "i", "j &am"]
    assert [n.text for n in H.parse("<p>cut</p><p cl") if n.tag == "run"] == ["cut"]
    assert [n.text for n in H.parse("1 < 2 <p>3 > 2") if n.tag == "run"] == ["1 < 2", "3 > 2"]


def test_decoding_never_contradicts_itself():
    import numpy as np

    rng = np.random.default_rng(3)
    nodes = H.parse(H.sample_pages(1, 5)[0])
    for _ in range(30):
        p = rng.random(len(nodes))
        chosen = H.decode(nodes, p)
        assert bool(chosen) or p[0] < 0.99


def test_rows(spark):
    article = "<html><body><nav><ul><li><a href='/a'>menu</a></li><li><a href='/b'>other</a></li></ul></nav><article><h1>Title here</h1><p>First  part,\n with words. It goes on for a while, as texts do.</p><p>Second part of the article, with more words.</p></article><footer>&copy; someone</footer></body></html>"
    rows = spark.createDataFrame([(1, "u", article, "x"), (2, None, None, "x"), (3, "v", "", "x"), (None, "w", "<p", "x"), (1, "u", article, "x")], "page_id long, url string, html string, text string")
    out = H.extract(rows).collect()
    want = "Title here\nFirst part, with words. It goes on for a while, as texts do.\nSecond part of the article, with more words."
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in out) == [(0, "", 0), (1, want, len(want)), (1, want, len(want)), (2, "", 0), (3, "", 0)]
    assert H.extract(rows.limit(0)).count() == 0


def test_deep_pages_take_linear_time():
    for page, n in (("<div>" * 100_000, 100_001), ("<p><button>" + "<div>" * 100_000, 100_003), ("<b>" * 100_000 + "</i>" * 100_000, 1)):
        start = time.monotonic()
        nodes = H.parse(page)
        assert len(nodes) == n and len(H.features(nodes)) == n
        assert time.monotonic() - start < 10

import random
import re
from html import unescape

import numpy as np

from tidegrid.llm import html as h


def test_held_out_pages():
    rng, same = random.Random(12345), 0
    pages = [h.training_page(rng) for _ in range(150)]
    for page, got in zip(pages, h.texts_of(pages, h.trained())):
        root, nodes, keep = h.labelled(page)
        same += got == "\n".join(h.blocks(root, nodes, {id(n) for n, k in zip(nodes, keep) if k}))
    assert same >= 0.95 * len(pages)


def test_decoding_is_the_best_consistent_labelling():
    rng = np.random.default_rng(3)
    root = h.parse("<div><section><p>a</p><p>b</p></section><ul><li>c</li><li>d</li></ul></div>")
    nodes = h.candidates(root)
    for _ in range(200):
        odds = rng.standard_normal(len(nodes))
        found = h.decode(nodes, odds)
        value = lambda kept: sum(o for x, o in zip(nodes, odds) if id(x) in kept)
        ok = lambda kept: all(x.parent is root or id(x.parent) in kept for x in nodes if id(x) in kept)
        every = [{id(x) for k, x in enumerate(nodes) if m >> k & 1} for m in range(1 << len(nodes))]
        assert ok(found) and value(found) >= max(value(k) for k in every if ok(k)) - 1e-9


def test_parser_on_broken_markup():
    m = h.trained()
    texts = h.texts_of(
        [
            None,
            "",
            "no markup at all",
            "<article><p>One &amp; two&nbsp;three<p>Four <b>five\n six</b> seven<br>eight</article>",
            "<body><nav><a href=x>Home</a><a>Out</a></nav><article><h1>T &lt;1&gt;</h1><p>Para one is here, with words.<script>var x='<p>no</p>';</script> And goes on.</p><!-- gone --><p>Para two, as long as one.</b></i></div></article><footer>(c)</footer>",
            "<article>" + "<div>" * 3000 + "deep text that goes on, and on." + "</div>" * 10,
            "<<>><p <article><p>" + "x" * 10,
        ],
        m,
    )
    assert texts[:3] == ["", "", "no markup at all"] and texts[3] == "One & two three\nFour five six seven eight"
    assert texts[4] == "T <1>\nPara one is here, with words. And goes on.\nPara two, as long as one."


def gold(page):
    body = page[page.index("<article>") + 9 : page.index("</article>")]
    parts = re.split(r"</?(?:p|h1)>", body)
    return "\n".join(x for x in (re.sub(r"\s+", " ", unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", q)))).strip() for q in parts) if x)


def test_whole_table_against_its_template(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in h.extract(pages, ["page_id", "url"]).collect()}
    want = {r.page_id: gold(r.html) for r in pages.collect()}
    assert got == want


def test_nulls_repeats_and_empty(spark):
    rows = [(1, None, "t"), (None, "<article><p>Some words here, enough of them.</p></article>", "t"), (1, None, "t")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    assert sorted(r.text for r in h.extract(df, ["page_id"]).collect()) == ["", "", "Some words here, enough of them."]
    assert h.extract(df.limit(0), ["page_id"]).count() == 0


def test_text_that_lies_in_no_block():
    long = "This is the text of the page, which goes on for some time, as texts do. It has sentences, and commas in them."
    pages = [
        f"<html><head><title>t</title></head><body>{long}<br><br>{long}</body></html>",
        f"<body><nav><ul><li><a href=/>Home</a></li><li><a href=/a>All</a></li></ul></nav><span>{long}</span> <b>{long}</b><hr>{long}<footer><p>(c) 2020 us</p></footer></body>",
        f"<body><p>{long} <span class='advert'>Buy this now!</span>Then {long}</p><p>{long}</p></body>",
        f"<font><p>{long}</p>{long}</font>",
        f"{long} &lt;3 a < b",
        f"<article><p>{long} <span class='quote'>And this.</span></p></article>",
    ]
    got = h.texts_of(pages, h.trained())
    assert got == [f"{long} {long}", f"{long} {long}\n{long}", f"{long} Then {long}\n{long}", f"{long}\n{long}", f"{long} <3 a < b", f"{long} And this."]


def test_siblings_are_told_apart_however_many():
    page = "<body>" + "".join(f"<p>word {i}.</p>" for i in range(200)) + "</body>"
    root = h.wrap(h.parse(page))
    h._measure(root)
    f = h.features(h.candidates(root), root)
    assert len(f) == 200 and len(set(f[:, 17].tolist())) == 200 and (f[1:, 18] > 0).all()


def test_broken_pages_take_time_in_proportion():
    import time

    for piece in ('<a x="', "<!", "</a", "<a x='>\"", "<b <i", "<!--", "<a b=\"c' >"):
        start = time.perf_counter()
        h.parse(piece * 40_000)
        assert time.perf_counter() - start < 5, piece

"""Main text of pages: planted articles in several layouts, odd pages, and the inferred expressions."""

import html
import os
import random
import re

import pytest

import __spark_entry__ as entry
from phrasegraph.llm import wrappers
from phrasegraph.llm.pagetree import DEPTH, aligned, expression, judge, merged, parse

SF = "/root/testdata/sf0.001"
WORDS = "amber brook cedar delta ember fjord grove harbor inlet juniper kelp lagoon meadow".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def layout(kind, rng):
    """A page of one of four layouts and the blocks of its article."""
    blocks = [prose(rng, 4)] + [prose(rng, rng.randint(8, 40)) for _ in range(rng.randint(1, 6))]
    title, rest = blocks[0], blocks[1:]
    menu = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in rng.sample(WORDS, rng.randint(2, 5)))
    note = prose(rng, 12)
    if kind == "tags":
        body = f"<h1>{title}</h1>" + "".join(f"<p>{b}</p>" if i % 2 else f"<p><b>{b}<br>" for i, b in enumerate(rest))
        return (
            f"<html><head><title>{title}</title><style>p{{x}}</style></head><body><header>{note}</header><nav><ul>{menu}</ul></nav>"
            f"<script>var t='</p><article>x</article>';</script><article>{body}</article><!-- <p>{note}</p> -->"
            f"<aside>{note}</aside><form><label>Your name</label><input></form><footer>&copy; {note}</footer></body></html>"
        ), blocks
    if kind == "classes":
        body = f"<h2>{title}</h2>" + "".join(f"<p>{b}</p>" for b in rest)
        extra = f"<div class='share-buttons'>{note}</div>" if rng.random() < 0.5 else ""
        return (
            f"<body><div id='cookie-notice'>{note} {note}</div><div class='menu'>{menu}</div><div class='post-content' id='p{rng.randint(1, 99)}'>"
            f"{body}{extra}<div class='comments'><p>{note} {note}</p><p>{note}</p></div></div><div class='sidebar'>{note}</div>"
        ), blocks
    if kind == "main":
        quoted = rest[0].replace(" ", " \n\t ", 2)
        body = f"<h1>{title}</h1><section><p>{quoted}</p>" + "".join(f"<p>{b}" for b in rest[1:]) + "</section>"
        return f"<body><nav>{menu}</nav><main><div class=ad>{note}</div>{body}</main><footer>{note}</footer>", blocks
    # No names at all: the article is where the text is.
    body = f"<h1>{title}</h1>" + "".join(f"<p>{b}</p>" for b in rest + [prose(rng, 60)])
    blocks = [html.unescape(x) for x in re.findall(r"<(?:h1|p)>([^<]*)", body)]
    return f"<body><div><ul>{menu}</ul></div><div>{body}</div><div><a href=x>terms of use</a></div></body>", blocks


def test_planted_articles(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for i in range(160):
        kind = ("tags", "classes", "main", "plain")[i % 4]
        page, blocks = layout(kind, rng)
        rows.append((i, f"https://{kind}.example.org/{i}", page, "x", 1))
        want[i] = "\n".join(blocks)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, wrapper int").repartition(7)
    got = {r.page_id: r.text for r in wrappers.main_text(pages).collect()}
    assert got == want


def test_odd_pages(spark):
    deep = "<div>" * 5_000 + "deep" + "</div>" * 5_000
    rows = [
        (1, None, None),
        (2, "http://a.example/x", ""),
        (3, "no scheme", "just text"),
        (4, "http://a.example/y", "<article><p>one &amp; two&nbsp;&#51; &bogus; &lt;b&gt;</p><p>a < b</article>"),
        (4, "http://a.example/y", "<article><p>one &amp; two&nbsp;&#51; &bogus; &lt;b&gt;</p><p>a < b</article>"),
        (None, "http://a.example/z", "<article>cut off <b"),
        (5, "http://b.example", "<!-- never closed <article>gone</article>"),
        (6, "http://c.example", f"<article>{deep}<p>after</p></article>"),
        (7, "http://d.example", "<article>" + "<p>long text</p>" * 20_000 + "</article>"),
        (8, "http://e.example", "<article>" + "".join(f"<p>{i}<hr><h2>{i}</h2><div>{i}</div>" for i in range(2_000)) + "</article>"),
    ]
    got = wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    found = sorted(((r.page_id, r.text) for r in got), key=str)
    assert len(found) == len(rows)
    texts = dict(found)
    assert texts[1] == texts[2] == texts[5] == ""
    assert texts[3] == "just text"
    assert texts[4] == "one & two 3 &bogus; <b>\na < b"
    assert texts[None] == "cut off"
    assert texts[6] == "deep\nafter"
    assert texts[7] == "\n".join(["long text"] * 20_000)
    assert texts[8] == "\n".join(str(i) for i in range(2_000) for _ in range(3))
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert wrappers.main_text(empty).count() == 0


def test_expressions():
    def tree(page):
        return parse(page)[0]

    one = tree("<ul><li>a</li><li>b</li></ul><p>x</p>")
    assert expression(one) == "<> <ul> <li> # </>+ </> <p> # </> </>"
    two = tree("<ul><li>a</li></ul><div class=ad>y</div><p>x</p><p>z</p>")
    assert expression(merged(one, two)) == "<> <ul> <li> # </>+ </> <div.ad> # </>? <p> # </>+ </>"
    pairs = tree("<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>")
    assert expression(pairs) == "<> <dl> (<dt> # </> <dd> # </>)+ </> </>"
    single = tree("<dl><dt>a<dd>b</dl>")
    assert expression(merged(single, pairs)) == "<> <dl> (<dt> # </> <dd> # </>)+ </> </>"
    assert aligned([], []) == []
    assert len(expression(tree("<div>" * 1_000)).split("<div>")) <= DEPTH + 1


def test_wrapper_covers_all_pages_of_a_host(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "FAN_IN", 3)
    rng = random.Random(9)
    rows = [("h", layout("classes", rng)[0]) for _ in range(60)] + [("i", layout("tags", rng)[0])]
    pages = spark.createDataFrame(rows, "host string, html string").repartition(13)
    found = {r.host: r for r in wrappers.infer_wrappers(pages).collect()}
    assert {h: r.pages for h, r in found.items()} == {"h": 60, "i": 1}
    root = judge(wrappers.loads(found["h"].wrapper))
    assert "<div.share.buttons> # </>?" in expression(root)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_equals_brute_force(spark):
    def article(page):
        inner = re.search(r"<article>(.*?)(</article>|$)", page or "", re.S)
        blocks = re.split(r"</?(?:p|h1)>", inner[1]) if inner else []
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks]
        return "\n".join(b for b in blocks if b)

    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in entry.queries()["op13_html_extraction"](spark, SF).collect()}
    assert {i: r.text for i, r in got.items()} == {r.page_id: article(r.html) for r in pages}
    assert all(r.n_chars == len(r.text) for r in got.values())

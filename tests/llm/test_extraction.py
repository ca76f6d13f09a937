"""Main text against pages with known articles, and the two passes against a plain loop."""

import html
import random
import re

import numpy as np
import pytest

from tessera.llm import extraction
from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LONG = "The keeper of the light had been on the island for a year, and he was sure that it was the best of all the places that he had ever seen in his life."
OTHER = "In the morning she would go to the shore and look for what the sea had left there, as her mother and all of their people had done before them."


def test_query_gives_the_articles(spark):
    """On the given pages the article is what its element holds: its headline and paragraphs."""
    got = {r["page_id"]: r for r in QUERIES["op13_html_extraction"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", p["html"], re.DOTALL)[1])
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x).replace("<br>", " ")).split()) for x in parts]
        r = got[p["page_id"]]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"]) and r["url"] == p["url"]


PAGES = {
    "marked": (f"<body><header><h2>Site</h2></header><nav><a href=/>Home</a></nav><main><aside>{LONG}</aside><article><header><h1>Head &amp; line</h1><p>by me</p></header>"
               f"<p>{LONG}<p>Short.<div class='ad-box'>{OTHER}</div><p>{OTHER}</p><ul><li>one <b>a</b>b</ul><footer>{LONG}</footer></article>"
               f"<section id=comments><article>{OTHER}</article></section></main><footer>{LONG}</footer>", ["Head & line", LONG, "Short.", OTHER, "one ab"]),
    "left open": (f"<nav><ul><li><a>x</a><article><p>{LONG}<p>tail", [LONG, "tail"]),
    "unmarked": (f"<div class=menu>{LONG}</div><div><a href=a>News</a> <a href=b>Sport</a></div><h1>On the island</h1><div>{LONG}</div><p>He slept.<p>{OTHER}</p>"
                 "<div><a>About us and what we do for all of you in the world of today and of tomorrow too</a></div><div>© 2020 me</div>", ["On the island", LONG, "He slept.", OTHER]),
    "parts that say nothing": (f"<article><script>var a = '</p><p>{LONG}';</script><style>p{{}}</style><!-- <p>{LONG}</p> --><p title='a > b'>{LONG}</p><form><p>{OTHER}</form><p hidden>{OTHER}</p>"
                               f"<p style='display: none'>{OTHER}</p><p role=alert>{OTHER}</p><noscript>{OTHER}</noscript></article>", [LONG]),
    "references and space": (f"<article>{LONG} &eacute;&#233;&#xe9;\n\t a&nbsp;&nbsp;b<br>c&lt;p&gt; 1 < 2 &unknown;</article>", [LONG + " ééé a b c<p> 1 < 2 &unknown;"]),
    "layout classes": (f"<body class='has-sidebar'><article class='post with-ads'><p>{LONG}</p><p class='cookieNotice'>{OTHER}</p></article>", [LONG]),
    "link lists in an article": (f"<article><p>{LONG}</p><ul><li><a>{OTHER}</a></li></ul><p>{OTHER}</p></article>", [LONG, OTHER]),
    "text only": (LONG, [LONG]), "nothing": ("<body><nav>x</nav>", []), "open comment": (f"<article>{LONG}<!-- {OTHER}", [LONG]), "open script": (f"<article>{LONG}<script>{OTHER}", [LONG]),
    "no end": (f"<article>{LONG}<p", [LONG + "<p"]), "only opened": ("<p", []), "closers only": ("</div></p></article>" + LONG, [LONG]), "comment word": (f"<article class=comment>{LONG}</article><p>{OTHER}", [OTHER]),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, want = PAGES[name]
    assert extraction.main_text(page).split("\n\n") == (want or [""])


def test_second_pass_equals_a_plain_loop():
    rng = random.Random(4)
    for _ in range(400):
        n, section = rng.randint(1, 12), 0
        blocks = []
        zone = rng.choice((extraction.ELSEWHERE, extraction.ARTICLE))
        for _ in range(n):
            section += rng.random() < 0.2
            blocks.append(extraction.Block("x", zone, section, rng.random() < 0.2, 0))
        label = [rng.choice((0, 1, -1, -1, -1)) for _ in range(n)]
        border = int(zone != extraction.ELSEWHERE)
        want = []
        for i, b in enumerate(blocks):
            mine = [j for j, x in enumerate(blocks) if x.section == b.section]
            before, after = [j for j in mine if j < i and label[j] >= 0], [j for j in mine if j > i and label[j] >= 0]
            j, back = (before[-1], label[before[-1]]) if before else (mine[0] - 1, border)
            k, ahead = (after[0], label[after[0]]) if after else (mine[-1] + 1, border)
            near = back if i - j < k - i else ahead if k - i < i - j else back if back == ahead else border
            near = ahead if b.heading and after else near
            want.append((label[i] if label[i] >= 0 else near) == 1)
        assert extraction.second_pass(blocks, np.array(label)).tolist() == want


def test_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", f"<article>{LONG}"), (3, "u", f"<article>{LONG}"), (None, "u", "<p>x"), (4, "u", "<div>" * 20000 + LONG + "</section>" * 20000), (5, "u", "<a \"" * 30000 + ">" + LONG),
            (6, "u", f"<article>{LONG * 8000}"), (7, "u", "<" * 50000)]
    frame = spark.createDataFrame([(*r, "mine", 9) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    got = sorted(((r["page_id"] or 0, r["text"]) for r in extraction.extract(frame).collect()))
    assert got[:5] == [(0, ""), (1, ""), (2, ""), (3, LONG), (3, LONG)] and got[5] == (4, LONG) and got[7] == (6, LONG * 8000) and len(got) == len(rows)
    assert extraction.extract(frame.limit(0)).count() == 0

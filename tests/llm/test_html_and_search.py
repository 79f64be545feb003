from collections import Counter

import numpy as np
import pytest

from tidemark.llm import htmltext, topk


def test_main_text_of_page_parts():
    page = ("<!doctype html><head><title>t</title><script>var a='<p>no</p>';</script></head><body><nav><a href=/a>Home page of all the news</a></nav>"
            "<header><a href=/>Site name</a></header><div id=cookie-notice><p>We use cookies to give you a better time here.</p></div>"
            "<main><h1>A  title</h1><p>First &amp; long paragraph<br>of the text, with <b>words</b> &eacute;&#39;.<p>Second one, not closed, with words in it."
            "<ul><li>one thing here</li><li>two things here</li></ul></main><div class='comments'><p>I read this with great joy, thank you for it.</p></div>"
            "<form><p>Your name please, then your address.</p></form><footer>&copy; site</footer></body>")
    assert htmltext.main_text(page).split("\n\n") == [
        "A title", "First & long paragraph of the text, with words é'.", "Second one, not closed, with words in it.", "one thing here", "two things here"]


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<p class=\"x", "&am", "<!--", "</p></p>", "<script>", "<a href='>", "<p>" * 3000])
def test_broken_pages_give_a_text(page):
    assert isinstance(htmltext.main_text(page), str)


def test_cut_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(40):
        n = 7
        source, sink = rng.integers(0, 6, n).astype(float), rng.integers(0, 6, n).astype(float)
        edges = [(i, j, float(rng.integers(1, 4))) for i in range(n) for j in range(i) if rng.random() < 0.4]

        def cost(kept):
            return sum(sink[i] if kept[i] else source[i] for i in range(n)) + sum(w for a, b, w in edges if kept[a] != kept[b])
        least = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(htmltext.minimum_cut(list(source), list(sink), edges)) == least


def test_extract_keeps_every_row(spark):
    long = "<article>" + "<p>" + "Many words stand in this paragraph here. " * 2000 + "</p></article>"
    rows = [(1, "u", "<article><p>A text that is long enough to be kept.</p></article>", 1), (1, "u", "<article><p>A text that is long enough to be kept.</p></article>", 1),
            (None, None, None, 2), (3, None, "", 2), (4, "u", long, 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {r.page_id: (r.text, r.n_chars) for r in htmltext.extract(pages).collect()}
    assert htmltext.extract(pages).count() == 5 and got[None] == ("", 0) and got[3] == ("", 0)
    assert got[4][1] == len(got[4][0]) > 70_000 and got[1][0].startswith("A text")
    assert htmltext.extract(pages.limit(0)).count() == 0


def brute(rows, k, every):
    whole = [(i, [np.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for at, (i, q) in enumerate(whole):
        if i % every == 0:
            scored = sorted((-sum(int(a) * int(b) for a, b in zip(q, c)), j) for n, (j, c) in enumerate(whole) if n != at)
            out.update((i, n, j, -s) for n, (s, j) in enumerate(scored[:k], 1))
    return out


@pytest.mark.parametrize("rows_in_block, in_group", [(16, 2), (4, 1), (4096, 1024)])
def test_top_k_equals_brute_force(spark, rows_in_block, in_group):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=24) * rng.choice([0.1, 1, 5]), 1)]) for i in range(90)]
    rows += [(100 + i, rows[7][1]) for i in range(30)]  # ties
    rows += [(200, None), (201, [1.0, None] + [0.0] * 22), (202, [float("nan")] * 24), (220, [float("inf")] * 24), (None, rows[0][1]), (240, [0.0] * 24), (241, [1.0, 2.0]), (260, [])]
    rows += [rows[20], rows[20], (40, rows[3][1])]  # repeated rows, and one id with two vectors
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS label", "2 AS norm", "3 AS block", "4 AS part", "5 AS row", "6 AS floor")
    got = Counter(tuple(r) for r in topk.top_k(vectors, 20, 20, 64, rows_in_block, in_group).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(rows, 20, 20)
    assert topk.top_k(vectors.limit(0)).count() == 0 and topk.top_k(vectors.filter("vec_id = 260")).count() == 0


def test_only_live_pairs_of_groups_and_blocks_meet(spark):
    rng = np.random.default_rng(4)
    for tied in (False, True):
        draw = (lambda n: rng.integers(0, 4, n).astype(float)) if tied else (lambda n: rng.normal(size=n))
        tops, least = -np.sort(-draw(9)), np.sort(np.append(draw(5), -np.inf))
        asked = spark.createDataFrame([(p, float(v)) for p, v in enumerate(least)] + [(5, 99.0)], "part int, ratio double")
        placed = spark.createDataFrame([(b, float(v)) for b, v in enumerate(tops)] + [(8, -99.0)], "block int, norm double")
        reach, fans = topk.live_pairs(asked, placed, 6)
        assert dict(map(tuple, reach.collect())) == {p: int((tops >= v).sum()) for p, v in enumerate(least)}
        assert dict(map(tuple, fans.collect())) == {b: int((least <= v).sum()) for b, v in enumerate(tops)}


def test_few_and_large_vectors(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, -1.0]), (20, [3e6, 2e6])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 4 and max(r.score for r in got) == 2**63 - 1


PROSE = "<p>The paragraph has a good number of words in it, as articles do.</p>"
SAID = "The paragraph has a good number of words in it, as articles do."
SMALL = "A few words of the site that stand beside the article, in sentences."


@pytest.mark.parametrize("page, text", [
    (f'<body class="has-sidebar page">{PROSE}</body>', [SAID]),
    (f'<body class="home"><form id=aspnetForm>{PROSE}{PROSE}</form></body>', [SAID, SAID]),
    (f'<div class="post tags-open">{PROSE}{PROSE}</div><div class="tags">{SMALL}</div>', [SAID, SAID]),
    (f'<main>{PROSE}{PROSE}{PROSE}</main><div class="sidebar"><p>{SMALL}</p></div>', [SAID] * 3),
    (f"<div title=don't data-x=y>{PROSE}</div><p>It's done, and it's a sentence with a few more words.</p>", [SAID, "It's done, and it's a sentence with a few more words."]),
    (f"<header><div><p>{SMALL}</p></div></header><main>{PROSE}</main>", [SAID]),
    (f"<article><header><h1>The title of it all</h1></header>{PROSE}</article>", ["The title of it all", SAID]),
    (f"<main>{PROSE}</main><div><a href=x><h3>Another headline to click on now</h3></a><a href=y><h3>Yet one more headline for you</h3></a></div>", [SAID]),
    (f"<main>{PROSE}<div hidden>{PROSE}</div><div style='color:red; DISPLAY: none'>{PROSE}</div><p style='display:block'>{SMALL}</p></main>", [SAID, SMALL]),
    (f"<main><svg viewBox='0 0 1 1'/>{PROSE}<svg><text>no</text></svg>{PROSE}</main>", [SAID, SAID]),
    (f"<main><p>A link that is <a href=x>never closed in its paragraph, which goes on.<p>{SMALL}{PROSE}</main>", None),
])
def test_page_templates(page, text):
    got = htmltext.main_text(page).split("\n\n")
    assert got == text if text else SAID in got and SMALL in got


def test_deep_pages_take_linear_time():
    blocks = htmltext.blocks_of("<div>word " * 8000 + "</b></p></i>" * 8000)
    assert len(blocks) == 8000 and blocks[-1].element.depth == 8001

"""HTML extraction: articles among boilerplate, markup rules, edge rows."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st

from rinkspark.llm.html_extract import main_blocks, path_scores, with_main_text
from rinkspark.llm.html_queries import op6_html_extraction

P1 = "The first paragraph is long, has commas; and ends with a stop. It goes on for a while."
P2 = "The second one, shorter, also counts."


def page(body, head="<title>t</title>"):
    return f"<!DOCTYPE html><html><head>{head}<style>p{{}}</style><script>var x = '</p><p>no';</script></head><body>{body}</body></html>"


BOILER = (
    '<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu entry, long. Really, long.</a></ul></nav><div class="cookie-notice">We use cookies, sorry. Accept them, please.</div>'
    '<aside><p>Side text, with commas, and more of it. Quite long, indeed.</p></aside><div class="ad-banner">Buy this, now. It is cheap, good, and new.</div><form><p>Name, please.</p><input></form>'
)
AFTER = (
    '<section id="comments"><article class="comment"><p>A reader wrote this long comment, with many words, and commas. It goes on, and on, and on, for longer than the article itself does, really.</p></article></section><footer>&copy; me, 2020. All rights.</footer>'
)


def test_article_among_boilerplate():
    article = f"<h1>Title</h1><p>{P1}<p>{P2}</p><p>Short</p>"
    want = ["Title", P1, P2, "Short"]
    assert main_blocks(page(BOILER + f"<article>{article}</article>" + AFTER)) == want
    assert main_blocks(page(BOILER + f'<main><div class="content">{article}</div></main>' + AFTER)) == want
    assert main_blocks(page(BOILER + f'<div id="wrap" class="has-sidebar"><div class="post">{article}</div><div class="sidebar">{P1}</div></div>' + AFTER)) == want


def test_words_that_declare_the_article_away():
    parts = ["Title", P1, P2, P1 + " More, too.", "Short"]
    widgets = "".join(f'<div class="elementor-element elementor-widget elementor-widget-text-editor"><p>{p}</p></div>' for p in parts)
    social = '<div class="elementor-widget elementor-widget-social-icons"><p>Follow us, please.</p></div>'
    assert main_blocks(page(f'<header>Site</header><div class="elementor">{widgets}{social}</div>' + AFTER)) == parts
    plain = "".join(f"<p>{p}</p>" for p in parts)
    assert main_blocks(page(f'<form id="aspnetForm" action="/"><div>{plain}</div><div class="cookie-notice">We use cookies, sorry.</div></form>')) == parts
    assert main_blocks(page(f'<div class="social-share"><div class="page-header">{plain}</div></div>')) == parts
    assert main_blocks(page(f'<div>{plain}</div><form><p>Name, please.</p></form><div class="widget"><p>{P2}</p></div><div class="comments">{plain * 3}</div>')) == parts
    assert main_blocks(f'<p>{P1} <span class="share">Share</span> on.</p>') == [P1, "on."]


def test_article_in_uneven_parts():
    first = [f"{P1} Part {i}." for i in range(12)]
    parts = ["".join(f"<p>{p}</p>" for p in first), f"<p>{P1}</p>"]
    want = [*first, P1]
    assert main_blocks(page(f"<div>{parts[0]}</div><div>{parts[1]}</div>")) == want
    assert main_blocks(page(BOILER + f"<div><h1>Title</h1>{parts[0]}</div><div>{parts[1]}</div>" + AFTER)) == ["Title", *want]


def test_parts_of_articles_with_telling_names():
    body = f"<p>{P1}</p><p>{P2}</p>"
    heads = "".join(f'<h2 class="section-header">Part {i}</h2>{body}' for i in range(3))
    assert main_blocks(page(BOILER + f"<article>{heads}</article>" + AFTER)) == [x for i in range(3) for x in (f"Part {i}", P1, P2)]
    assert main_blocks(page(BOILER + f"<article><header><h1>Title</h1><p>By me</p></header>{body}</article>" + AFTER)) == ["Title", "By me", P1, P2]
    for name in ("share-price", "form-row", "related-work"):
        assert main_blocks(page(BOILER + f'<article>{body}<div class="{name}"><p>{P1}</p></div></article>' + AFTER)) == [P1, P2, P1]
    assert main_blocks(page(f"<article>{body}<p><label>Labelled</label> text</p></article>")) == [P1, P2, "Labelled text"]
    assert main_blocks(page(f'<article>{body}<div class="share">Share</div><div class="ad-box"><p>{P1}</p></div></article>')) == [P1, P2]


def test_content_beside_the_article():
    long = "".join(f"<p>{P1} {i}.</p>" for i in range(20))
    want = [f"{P1} {i}." for i in range(20)]
    assert main_blocks(page(BOILER + f"<article>{long}</article><article><p>{P1}</p></article>" + AFTER)) == [*want, P1]
    assert main_blocks(page(BOILER + f"<article>{long}</article><section><p>{P1}</p></section>" + AFTER)) == [*want, P1]


def plain_scores(paths, texts):
    """The ratios once more: per path, text and punctuation per block, smoothed
    over five blocks with exp(-d*d/2), fused as length * (1 + marks), averaged."""
    ratio = {}
    for p in paths:
        own = [t for q, t in zip(paths, texts, strict=True) if q == p]
        ratio[p] = (sum(map(len, own)) / len(own), sum(sum(c in ".,;:!?…、。，！？；：¿¡" for c in t) for t in own) / len(own))
    fused = []
    for i in range(len(paths)):
        near = {j: math.exp(-((i - j) ** 2) / 2) for j in range(i - 2, i + 3) if 0 <= j < len(paths)}
        a, b = (sum(w * ratio[paths[j]][k] for j, w in near.items()) / sum(near.values()) for k in (0, 1))
        fused.append(a * (1 + b))
    return {p: sum(f for f, q in zip(fused, paths, strict=True) if q == p) / paths.count(p) for p in paths}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a/p", "a/b/p", "c", "c/li"]), st.text(alphabet="ab ,.", min_size=1, max_size=30)), min_size=1, max_size=20))
def test_path_scores_equal_a_restatement(rows):
    paths, texts = [p for p, _ in rows], [t for _, t in rows]
    got, want = path_scores(paths, texts), plain_scores(paths, texts)
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 * (1 + want[p]) for p in got)


def test_markup():
    html = page(
        "<article><p>a&amp;b &lt;i&gt;&nbsp; x<br>y <b>bo</b>ld<!-- no --><p>one\n\n two<ul><li>l1<li>l2</ul><table><tr><td>c1<td>c2<tr><td>c3</table>"
        "<div hidden>no</div><p style='display: none'>no</p><script>no</script><pre>k  l</pre></b></p>&#x41;&eacute</article>"
    )
    assert main_blocks(html) == ["a&b <i> x y bold", "one two", "l1", "l2", "c1", "c2", "c3", "k l", "Aé"] or main_blocks(html) == ["a&b <i> x y bold", "one two", "l1", "l2", "c1 c2", "c3", "k l", "Aé"]


def test_unclosed_and_cut_pages():
    assert main_blocks(f"<article><h1>T</h1><p><b>{P1}<br><p>{P2} &am") == ["T", P1, P2 + " &am"]
    assert main_blocks(f"<article><p>{P1}</p><foot") == [P1]
    assert main_blocks(f"<article><p>{P1}</p><a href=\"x y") == [P1]
    assert main_blocks(P1) == [P1]
    assert main_blocks("<div>" * 5000 + P1) == [P1]
    assert main_blocks("<p a='" * 3000 + P1) is not None


def test_no_text():
    for html in ("", " ", "<nav><p>menu</p></nav>", "<script>x", "<!-- open", "<style>p{}</style>"):
        assert main_blocks(html) == []


def test_paths_of_prose_score_above_link_lists():
    paths = ["body/ul/li"] * 6 + ["body/div/p"] * 3
    score = path_scores(paths, ["Home"] * 6 + [P1, P2, P1])
    assert score["body/div/p"] > 5 * score["body/ul/li"]


def test_query_and_edge_rows(spark, tmp_path):
    rows = [(1, "u", page(f"<article><p>{P1}</p></article>")), (1, "u", page(f"<article><p>{P1}</p></article>")), (2, None, None), (3, "v", ""), (4, "w", "<p>\U0001f600é</p>")]
    spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(op6_html_extraction(spark, str(tmp_path)).collect())
    assert [tuple(r) for r in got] == [(1, "u", P1, len(P1)), (1, "u", P1, len(P1)), (2, None, "", 0), (3, "v", "", 0), (4, "w", "\U0001f600é", 2)]
    pages = spark.read.parquet(str(tmp_path / "pages.parquet"))
    assert with_main_text(pages).columns == [*pages.columns, "text_"]
    assert with_main_text(pages.filter("false")).count() == 0

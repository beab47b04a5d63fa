import itertools
import re
from html import unescape

import numpy as np
import pytest

from tallyframe.llm import content_model, extraction, html_tree, layouts, queries
from tests.llm.conftest import SF


@pytest.fixture(scope="module")
def model():
    return extraction.default_model()


def runs(markup):
    return [node.text for node in html_tree.read_page(markup).nodes if not node.tag]


def test_reader_of_tag_soup():
    assert runs("") == runs(" \n") == runs("<!-- open <p>a</p>") == []
    assert runs("<p>a<b>b<br>c<p>d</b>e</p>f") == ["ab c", "de", "f"]
    assert runs("<ul><li>a<li>b<ul><li>c</ul>d<li>e</ul>") == ["a", "b", "c", "d", "e"]
    assert runs("<table><tr><td>a<td>b<tr><th>c</table>d") == ["a", "b", "c", "d"]
    assert runs("a <3 b < c &lt;p&gt; &amp;amp; &#233;&eacute; &nosuch; x&nbsp;y") == ["a <3 b < c <p> &amp; éé &nosuch; x y"]
    assert runs("<script>if (a<b) '</p>'</script>x<STYLE>p{}</style >y<textarea>z</textarea><select><option>n</select>") == ["xy"]
    assert runs("<p title='a>b' class=\"c\">x</p></p></div>y<![CDATA[z]]><?php z ?>") == ["x", "y"]
    assert runs("<title>t</title><script>never ends <p>x") == []
    assert runs("<div>a<div>b</div>c</section></div>d") == ["a", "b", "c", "d"]
    page = html_tree.read_page('<title> A &amp;\nB </title><a href=x><div class="mainNav site-nav" id=Top hidden>l <p>k</a></p>m</div>')
    assert page.title == "A & B" and page.nodes[1].words == ("main", "nav", "site", "top", "hidden")
    assert [(node.text, node.linked) for node in page.nodes if not node.tag] == [("l", 1), ("k", 1), ("m", 0)]


def test_reader_needs_no_recursion_and_little_time():
    assert runs("<div><b>" * 30_000 + "x") == ["x"]
    assert len(runs("<p>a <" * 50_000)) == 50_000
    assert runs("<p " + "a='" * 30_000) == [] and len(runs('<p x="y">z' * 20_000)) == 20_000


def small_pages():
    markup = ["<div class=nav>a<p>b</p></div>", "<p>x</p><ul><li>y</ul>", "", "z"]
    return [html_tree.read_page(text) for text in markup]


def test_marginals_match_enumeration():
    pages, draw = small_pages(), np.random.default_rng(5)
    names = sorted({name for page in pages for found in content_model.features(page) for name in found})
    trained = content_model.Model(
        {name: n for n, name in enumerate(names)}, draw.normal(size=len(names)), draw.normal(size=(len(content_model.KINDS), 2, 2))
    )
    for page, got in zip(pages, trained.marginals(pages)):
        found = content_model.features(page)
        odds = [sum(trained.weights[trained.numbers[name]] for name in names) for names in found]
        total, content = 0.0, np.zeros(len(page.nodes))
        for states in itertools.product((0, 1), repeat=len(page.nodes)):
            energy = sum(odds[n] * state / 2 if state else -odds[n] / 2 for n, state in enumerate(states))
            for n, node in enumerate(page.nodes):
                if node.parent >= 0:
                    energy += trained.pair[content_model._kind(page, n), states[node.parent], states[n]]
            weight = np.exp(energy)
            total += weight
            content += weight * np.array(states)
        assert np.allclose(got, content / total)


def test_labels_follow_the_text():
    page = html_tree.read_page("<nav>a</nav><div><p>b</p><p>c</p>a<p>b</p></div>")
    state = content_model.label(page, "b\n\na\n\nb")
    assert [(node.text, int(s)) for node, s in zip(page.nodes, state) if not node.tag] == [("a", 0), ("b", 1), ("c", 0), ("a", 1), ("b", 1)]


def measured(model, pages):
    right = had = wanted = 0
    for got, (_, text) in zip(extraction.main_texts([markup for markup, _ in pages], model), pages):
        own, known = got.split("\n\n"), text.split("\n\n")
        right += sum(min(own.count(block), known.count(block)) for block in set(own))
        had, wanted = had + len(own), wanted + len(known)
    return right / had, right / wanted


def test_held_out_layouts(model):
    precision, recall = measured(model, layouts.labelled_pages(200, seed=2))
    assert precision > 0.97 and recall > 0.97


def test_pages_written_by_hand(model):
    blog = """<title>How to bake bread | Daily Loaf</title><body class="home"><a class="skip-link" href="#c">Skip to content</a>
      <header id="masthead"><p class="site-title"><a href="/">Daily Loaf</a></p><p>All about bread</p><nav><ul><li><a href=/a>Home</a>
      <li><a href=/b>Recipes</a></ul></nav></header><div id="content"><main><article class="post"><header class="entry-header">
      <h1>How to bake bread</h1></header><div class="entry-content"><p>Bread is simple. You need flour, water and time.</p><p>Mix all.
      <h2>Kneading</h2><p>Knead the dough for ten minutes, until it is smooth &amp; elastic.</p><ul><li>500 g flour<li>300 g water</ul>
      <div class="ad-slot">Buy our flour now! It is great.</div><p>Bake it for <b>forty</b> minutes.</p></div></article>
      <div id="comments"><h2>2 thoughts</h2><ol class="comment-list"><li class="comment"><p>I tried this recipe last weekend and it was
      wonderful. Thank you!</p></ol><form><p>Your address will not be published.</p></form></div></main><aside class="widget-area"><h2>
      Recent</h2><ul><li><a href=x>Rye bread for beginners</a></ul><p>We are two bakers who love to write about bread.</p></aside></div>
      <footer>All rights reserved.</footer><div class="cookie-bar">We use cookies to improve this site. Accept them, please.</div>"""
    news = """<body><div class=nav><a href=1>News</a> <a href=2>Sport</a></div><div><h1>City council approves budget</h1><div>The city
      council approved its yearly budget on Monday, after long debates.</div><div>The mayor said she was happy.</div></div>
      <div class=newsletter><p>Sign up and never miss a story.</p><input></div><div class=footer>© 2024 City News.</div>"""
    assert extraction.main_texts([blog, news], model) == [
        "How to bake bread\n\nBread is simple. You need flour, water and time.\n\nMix all.\n\nKneading\n\nKnead the dough for ten "
        "minutes, until it is smooth & elastic.\n\n500 g flour\n\n300 g water\n\nBake it for forty minutes.",
        "City council approves budget\n\nThe city council approved its yearly budget on Monday, after long debates.\n\nThe mayor said "
        "she was happy.",
    ]


def article(markup):
    """The article of a page of the given table, by its one layout."""
    inside = re.search(r"<article>(.*?)(</article>|\Z)", markup, re.S).group(1)
    blocks = [re.sub(r"<[^>]*>", " ", part) for part in re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inside))]
    return "\n\n".join(filter(None, (" ".join(unescape(block).split()) for block in blocks)))


def test_query_on_the_given_pages(spark):
    rows = queries.op13_html_extraction(spark, SF).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(pages) and all(r.url == pages[r.page_id].url and r.n_chars == len(r.text) for r in rows)
    assert sum(r.text == article(pages[r.page_id].html) for r in rows) >= 0.98 * len(rows)


def test_awkward_pages(spark):
    long = "<article>" + "<p>One more sentence of this very long text, and then some.</p>" * 30_000 + "</article>"
    schema = "html string, text string, n_chars string, page_id int, words string"
    rows = [(None, "old", "old", 1, "w"), ("", "old", None, None, None), (long, None, None, 3, None), (long, None, None, 3, None)]
    made = extraction.extract(spark.createDataFrame(rows, schema).repartition(2)).collect()
    assert sorted(r.text.count("One more sentence") for r in made) == [0, 0, 30_000, 30_000]
    assert all(r.n_chars == len(r.text) for r in made) and {r.page_id for r in made} == {1, None, 3}
    assert extraction.extract(spark.createDataFrame([], schema)).count() == 0


def test_fit_on_a_table(spark):
    pages = spark.createDataFrame(layouts.labelled_pages(60, seed=9) + [(None, "x"), ("y", None)], "html string, text string")
    precision, recall = measured(extraction.fit(pages), layouts.labelled_pages(60, seed=10))
    assert precision > 0.8 and recall > 0.8

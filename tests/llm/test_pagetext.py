"""The page model: marginals against enumeration, what training changes, names as evidence, odd tables and pages."""

import itertools
import random
import re
import time

import pytest

from caseloom.llm.pagetext import DEFINED, Node, extract, kind_of, labels_of, learn, main_text, marginals, own_potential, tree_of

FIRST, SECOND = "First long paragraph of the story with many words in it, and more of them.", "Second paragraph of it, also with many words, and then it ends."
MENU, AD = "<nav><a href='/'>Home</a></nav>", "<div class='ad'>Buy this now, it is cheap.</div>"


def page(body, foot="All words reserved"):
    return f"<body>{MENU}{AD}{body}<footer>{foot}</footer></body>"


@pytest.fixture(scope="module")
def model():
    return learn([page(f"<article><h1>Head</h1><p>{FIRST}</p><p>{SECOND}</p></article>")] * 30)


def test_marginals_are_those_of_enumeration(model):
    r = random.Random(7)
    for _ in range(40):
        nodes = [Node(-1, "page")]
        for i in range(1, r.randrange(2, 9)):
            parent = r.choice([k for k in range(i) if not nodes[k].text])
            text = r.choice(["", "", "A run of words, longer or shorter.", "Link"])
            nodes.append(Node(parent, r.choice(["div", "p", "li", "article", "aside"]), r.choice([(), (("ad",),), (("share", "prices"),), (("comments",),)]), text, len(text) * r.randrange(2)))
        total, sums = 0.0, [[0.0] * 3 for _ in nodes]
        for labels in itertools.product(range(3), repeat=len(nodes) - 1):
            labels, weight = (0, *labels), 1.0
            for i, node in enumerate(nodes[1:], 1):
                weight *= own_potential(node, model)[labels[i]] * model.turn[kind_of(node), labels[node.parent]][labels[i]]
            total += weight
            for i, label in enumerate(labels):
                sums[i][label] += weight
        for got, want in zip(marginals(nodes, model), sums, strict=True):
            assert got == pytest.approx([x / total for x in want], abs=1e-9)


def test_training_tells_parts_that_no_list_names():
    boxes = lambda i: f"<div class='zq'>Offer number {i} is cheap, buy it today and save.</div>"
    body = f"<div class='kx'><p>{FIRST}</p><p>{SECOND}</p></div>"
    trained = learn([f"<body>{boxes(i)}<article>{body}</article>{boxes(i + 1)}</body>" for i in range(40)])
    unmarked = f"<body>{boxes(5)}{body}{boxes(6)}</body>"
    assert main_text(unmarked, trained) == f"{FIRST}\n\n{SECOND}" and main_text(unmarked, learn([])) != f"{FIRST}\n\n{SECOND}"


def test_training_on_the_pages_tells_their_parts_without_the_defining_tags(spark):
    rows = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").orderBy("page_id").collect() if r.html]
    half, masked = len(rows) // 2, [re.sub(r"<(/?)(article|nav|footer)\b", r"<\1div", h).replace('class="ad"', 'class="q"') for h in rows]
    trained, blank = learn([h.replace('class="ad"', 'class="q"') for h in rows[:half]]), learn([])
    right = lambda m: sum(main_text(masked[i], m) == main_text(rows[i], trained) for i in range(half, len(rows))) / (len(rows) - half)
    assert right(trained) > 0.95 > right(blank)


def test_labels_come_from_html_alone():
    nodes = tree_of(f"<body><div class='ad comments'><p>x</p></div><article class='ad'><p>a</p><aside>b</aside><div><article><p>c</p></article></div></article><footer>d</footer></body>")
    assert [label for n, label in zip(nodes, labels_of(nodes), strict=True) if n.text] == [0, 1, 2, 2, 0] and labels_of(tree_of("<p>x</p>")) is None
    signs = learn([page(f"<article><p>{FIRST}</p></article>")] * 5).signs
    assert not any(f"tag {t}" in signs for t in DEFINED)


@pytest.mark.parametrize(
    "html",
    [
        f"<body><article class='share-prices'><p>{FIRST}</p><p>{SECOND}</p></article></body>",
        f"<body><main><section id='related-work'><p>{FIRST}</p><p>{SECOND}</p></section></main></body>",
        f"<body><main><div class='tags'><p>{FIRST}</p><p>{SECOND}</p></div></main></body>",
        f"<body><article><p>{FIRST}</p><p>{SECOND}</p><div class='user-posts'><p>I think that this was a great article, really great.</p><p>So do I, and I have read a few of them, believe me.</p></div></article></body>",
        f"<body><article><p>{FIRST}</p><p>{SECOND}</p></article><section class='comments'><p>I think that this was a great article, really great.</p></section></body>",
        f"<body><p>{FIRST}</p><p>{SECOND}</p></body>",
        f"<body><header><h1>Site</h1></header><div class='content'><p>{FIRST}</p><ul class='menu'><li><a href='1'>One</a></li><li><a href='2'>Two</a></li></ul><p>{SECOND}</p></div><aside>Aside words are here, quite long ones.</aside></body>",
    ],
)
def test_names_are_evidence(model, html):
    assert main_text(html, model) == f"{FIRST}\n\n{SECOND}"


def test_one_long_paragraph_without_any_main_part(spark):
    pages = spark.createDataFrame([(1, "u", f"<html><body><p>{FIRST} {SECOND}</p></body></html>")], "page_id long, url string, html string")
    assert [r.text for r in extract(pages).collect()] == [f"{FIRST} {SECOND}"]


def test_lists_stay_in_articles(model):
    html = page("<article><p>" + FIRST + "</p><ul><li>One thing to know about it.</li><li>Another thing</li></ul><table><tr><td>Cell one<td>Cell two</table></article>")
    assert main_text(html, model).split("\n\n") == [FIRST, "One thing to know about it.", "Another thing", "Cell one", "Cell two"]


def test_deep_pages_cost_in_proportion(model):
    took = []
    for depth in (3000, 30_000):
        began = time.time()
        for tags in ("<div>", "<blockquote>", "<li>"):
            main_text(tags * depth + f"<p>{FIRST}" + "</section>" * depth, model)
        took.append(time.time() - began)
    assert took[1] < 40 * took[0] + 2


def test_odd_tables(spark):
    html = page(f"<article><p>{FIRST}</p></article>")
    rows = [(1, "u", html), (1, "u", html), (None, None, html), (None, "v", None), (2, None, ""), (3, "w", page("<article>" + f"<p>{FIRST}</p>" * 5000 + "</article>"))]
    pages = spark.createDataFrame([(*r, "text", 5, "h") for r in rows], "page_id long, url string, html string, text string, n_chars int, h string")
    got = extract(pages).collect()
    assert sorted(((r.page_id, r.url, r.text) for r in got), key=repr) == sorted([(1, "u", FIRST), (1, "u", FIRST), (None, None, FIRST), (None, "v", ""), (2, None, ""), (3, "w", "\n\n".join([FIRST] * 5000))], key=repr)
    assert extract(pages.limit(0)).count() == 0

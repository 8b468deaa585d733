"""Pages of any depth, and wrappers that don't depend on the order of pages."""

import random

from slicewright.llm import html_wrapper

DIVS = 20_000


def test_depth(spark):
    deep = "<div>" * DIVS + "<article><p>good</p><nav>MENU</nav></article>" + "</div>" * DIVS
    list_ = "<ul>" + "<li><b>item" * 400
    docs = spark.createDataFrame([(1, "http://a/", deep), (2, "http://a/", "<div>" * 300 + "<p>flat</p><aside>no</aside>"), (3, "http://b/", list_)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_wrapper.main_text(docs).collect()}
    assert got == {1: "good", 2: "flat", 3: "\n".join(["item"] * 400)}


def test_order(spark):
    r = random.Random(3)
    rows = []
    for k in range(60):
        parts = [f"<p>p{j} of {k}</p>" if j % 2 else f"<ul><li>l{j} of {k}</ul>" for j in range(r.randrange(1, 6))]
        extra = "".join(f"<section><h2>h{j}</h2></section>" for j in range(r.randrange(3)))
        rows.append((k, "http://h/x", f"<body><nav>m</nav>{extra}<article>{''.join(parts)}</article></body>"))
    found = []
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3 + seed)
        found.append(tuple(html_wrapper.wrappers(docs).select("host", "path", "fixed", "expression").first()))
    assert found[0] == found[1] == found[2]

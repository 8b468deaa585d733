"""What is dropped from articles as template: only what stays while the rest of the article differs."""

from slicewright.llm import html_wrapper


def page(body, nav=""):
    return f"<html><body><nav>{nav}</nav><article>{body}</article><footer>f</footer></body></html>"


def read(spark, pages):
    rows = [(k, None, p) for k, p in enumerate(pages)]
    got = html_wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r["text"] for r in sorted(got, key=lambda r: r["page_id"])]


def test_copies_keep_their_texts(spark):
    assert read(spark, [page("<h1>Title</h1><p>only one")] * 7) == ["Title\nonly one"] * 7
    assert read(spark, [page("<h1>Title</h1><p>only one", nav=f"at {k}") for k in range(7)]) == ["Title\nonly one"] * 7
    four = [page(f"<h1>Title</h1><p>{'long enough text ' * 3}{k % 4}") for k in range(20)]
    assert read(spark, four) == [f"Title\n{'long enough text ' * 3}{k % 4}" for k in range(20)]
    assert read(spark, [page("<h1>a < b<!-- c --> d</h1><p>one<p>two<!-- --> more")] * 6) == ["a < b d\none\ntwo more"] * 6
    versions = [page(f"<h1>Title</h1><p>the same long paragraph here</p><div>seen {k} times</div>") for k in range(9)]
    assert read(spark, versions) == [f"Title\nthe same long paragraph here\nseen {k} times" for k in range(9)]


def test_template_goes_by_its_place(spark):
    pages = [page(f"<h1>T {k}</h1><p>{'Note' if k == 3 else f'words of article {k} ' * 4}</p><div>Note</div>") for k in range(8)]
    assert read(spark, pages) == [f"T {k}\n" + ("Note" if k == 3 else (f"words of article {k} " * 4).strip()) for k in range(8)]
    pages = [page(f"<p>Note</p><h1>T {k}</h1><p>{'Note' if k == 3 else f'words of article {k} ' * 4}</p>") for k in range(8)]
    assert read(spark, pages) == [f"T {k}\n" + ("Note" if k == 3 else (f"words of article {k} " * 4).strip()) for k in range(8)]

"""Names late in long class lists tell what is not the article."""

from slicewright.llm import html_wrapper


def test_a_late_name_is_seen():
    long = " ".join(f"utility-{c}{c}" for c in "abcdefgh")
    for late in (f"class='{long} sidebar'", f'id="{long} comments"', f"role='{long} search'"):
        page = f"<article><h1>T</h1><p>kept</p><div {late}><p>gone</p></div><div class='{long} text'><p>kept too</p></div></article>"
        assert html_wrapper.extract(page, []) == "T\nkept\nkept too"
    cut = "x" * 48 + " " + "share" + "holders"  # a cut at 60 characters must not make a name either
    cut = "y" * (60 - len(cut) + 7) + cut
    assert html_wrapper.extract(f"<article><p>a</p><div class='{cut}'><p>b</p></div></article>", []) == "a\nb"

"""Main text where several elements mark articles, or none of them is the main text."""

from rampart.llm.main_text import main_text

LONG = ["The first report of the day is long enough to surge on its own, since it has more than eighty-six characters.",
        "The second report of the day is long enough as well, and tells of other things than the first one of them did.",
        "The third report of the day closes the page with a few more words on what was said in the first and second."]


def test_sibling_articles_are_all_kept():
    page = "<main>" + "".join(f"<article><p>{x}</p></article>" for x in [LONG[0], "Short post.", *LONG[1:]]) + "</main>"
    assert main_text(page) == " ".join([LONG[0], "Short post.", *LONG[1:]])


def test_nested_articles_and_the_text_around_them_are_kept():
    page = f"<article><p>{LONG[0]}</p><article><p>{LONG[1]}</p></article><p>{LONG[2]}</p></article>"
    assert main_text(page) == " ".join(LONG)
    assert main_text(f"<article><p>{LONG[0]}</p><main><p>{LONG[1]}</p></main></article>") == " ".join(LONG[:2])


def test_text_in_a_div_beside_teasers():
    teasers = "<article><a href=x>More of it</a></article>" * 3
    page = "<div>" + "".join(f"<p>{x}</p>" for x in LONG) + f"</div><nav>x</nav>{teasers}"
    assert main_text(page) == " ".join(LONG)


def test_a_short_line_outside_an_article_does_not_surge():
    page = f"<article><h1><a href=x>Title</a></h1><p>{LONG[0]}<div class=ad>a</div><div class=ad>b</div><div class=ad>c</div><p>End.</article><div>Imprint</div>"
    assert main_text(page) == f"Title {LONG[0]} End."

import pytest

from quorumlens.llm import html_text

BODY = "A first sentence, with some length. " * 6
MORE = "Another paragraph follows; it has words, too. " * 5
PAGES = {
    "plain": ("just words &amp; more", "just words & more"),
    "article": (
        f"<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav>"
        f"<div class='ad'>Buy this, now.</div><article><h1>Title&nbsp;one</h1><p><b>{BODY}<br>x<p>{MORE}</p></article>"
        f"<footer>&copy; somebody, somewhere.</footer></body>",
        f"Title one\n\n{BODY.strip()} x\n\n{MORE.strip()}",
    ),
    "no article element": (
        f"<body><header><h1>Site</h1></header><div id=menu><a href=a>One</a> <a href=b>Two</a></div><div id='content'><h2>Head</h2>"
        f"<p>{BODY}</p><ul><li>point one.</li><li>point two.</li></ul><p>{MORE}</p></div><aside>See also, this.</aside>"
        f"<div class='comments'><p>{MORE}</p></div><form><p>{MORE}</p></form></body>",
        f"Head\n\n{BODY.strip()}\n\npoint one.\n\npoint two.\n\n{MORE.strip()}",
    ),
    "article header": (
        f"<article><header><h1>Title</h1></header><p>{BODY}</p><footer>by me</footer></article>",
        f"Title\n\n{BODY.strip()}",
    ),
    "cut off": (f"<article><p>{BODY}</p><p>{MORE}<a hre", f"{BODY.strip()}\n\n{MORE.strip()}"),
    "comment": (f"<article><!-- <p>no</p> --><p>{BODY}<!-- open", BODY.strip()),
    "inline": (f"<article><p>a<b>b</b>c {BODY}</p></article>", f"abc {BODY.strip()}"),
    "attributes": (f"<article><p title=\"a>b\" hidden-not='x'>{BODY}</p></article>", BODY.strip()),
    "empty": ("", ""),
    "only furniture": ("<body><nav>a b c.</nav></body>", ""),
    "space": (" \n\t ", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    assert html_text.main_text(PAGES[name][0]) == PAGES[name][1]


def test_high_ratio_paths_win():
    plain = lambda *texts: [(p, t, False) for p, t in texts]
    texts = plain(*[("b/ul/li/a", "Home")] * 5, ("b/div/p", BODY), ("b/div/p", MORE), *[("b/span", "one two")] * 3, *[("b/em", "x")] * 4)
    assert html_text.content_paths(texts) >= {"b/div/p"}
    texts = plain(*[("b/ul/li/a", "Home")] * 5, *[("x/%d" % i, "y") for i in range(5)], ("b/div/p", BODY))
    assert "b/ul/li/a" not in html_text.content_paths(texts)


def test_long_and_deep():
    assert html_text.main_text("<div>" * 20_000 + "<p>" + BODY) == BODY.strip()
    long = f"<p>{BODY}</p>" * 20_000
    assert html_text.main_text(f"<article>{long}</article>").count("\n\n") == 19_999


def test_rows(spark):
    rows = [(1, "u", None, 5), (None, None, "<p>x", 5), (2, "v", PAGES["article"][0], 5), (2, "v", PAGES["article"][0], 5)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars int")
    found = sorted(map(tuple, html_text.extract(df).collect()), key=str)
    text = PAGES["article"][1]
    assert found == sorted([(1, "u", "", 0), (None, None, "x", 1), (2, "v", text, len(text)), (2, "v", text, len(text))], key=str)
    assert html_text.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "part",
    [
        f'<p title="the hidden cost">{BODY}</p>',
        f"<p data-x='a hidden=b'>{BODY}</p>",
        f"<h1 class=article-header>{BODY}</h1>",
        f"<h2 id=search>{BODY}</h2>",
        f"<p class=notice>{BODY}</p>",
        f"<section id=related-work><p>{BODY}</p></section>",
    ],
)
def test_parts_of_an_article_stay(part):
    assert html_text.main_text(f"<body><article>{part}<p>{MORE}</p></article></body>") == f"{BODY.strip()}\n\n{MORE.strip()}"


@pytest.mark.parametrize("start", ["<p hidden>", "<p HIDDEN=''>", "<p id=x hidden />", "<p aria-hidden='true'>", "<p style='display: none'>", "<div class=related>"])
def test_hidden_parts_and_boxes_go(start):
    name = start[1:].split()[0].split(">")[0]
    end = "" if start.endswith("/>") else f"{BODY}</{name}>"
    assert html_text.main_text(f"<body><article>{start}{end}<p>{MORE}</p></article><div id=related><p>{BODY}</p></div></body>") == MORE.strip()


def test_ratios_decide_about_boxes_named_like_furniture(monkeypatch):
    """A named box goes beside an article, but stays where the text of the page is in it."""
    box = f"<div class='search-results'><h2>Head</h2><p>{BODY}</p><p>{MORE}</p></div>"
    text = f"Head\n\n{BODY.strip()}\n\n{MORE.strip()}"
    alone = f"<body><nav><a href=/>Home</a></nav><main>{box}</main></body>"
    beside = f"<body><main><p>{MORE}</p><p>{BODY}</p></main><div class='search-results'><p>{BODY}</p></div></body>"
    assert html_text.main_text(alone) == text
    assert html_text.main_text(beside) == f"{MORE.strip()}\n\n{BODY.strip()}"
    monkeypatch.setattr(html_text, "content_paths", lambda texts: {p for p, _, _ in texts})
    assert html_text.main_text(beside) != f"{MORE.strip()}\n\n{BODY.strip()}"
    assert html_text.main_text(PAGES["article"][0]) != PAGES["article"][1]

"""Main text against labelled pages, named parts or none, and odd markup."""

import random
import time

import numpy as np
import pytest

from inkwell.llm import html, html_pages

WORDS = "one two three four five six seven eight nine ten eleven twelve"


def judged(plain):
    model, right, moved, n = html.trained(), 0, 0, 0
    for parts in html_pages.labelled_pages(500, seed=77):
        source = "".join(p for p, _ in parts)
        if plain != (not any(x in source for x in ("<nav", "<footer", "<header", "class=\"ad", "sidebar\"", "menu", "id=\"", "role=", "breadcrumbs", "cookie", "related", "pagination"))):
            continue
        page = html.Page(source)
        got = model.text(source)
        n += 1
        right += got == html.labelled_text(page, np.repeat([c for _, c in parts], [len(p) for p, _ in parts]))
        moved += got != html.assemble(page, 0, len(page.pieces))
    return right, moved, n


def test_named_parts():
    right, _, n = judged(plain=False)
    assert n > 200 and right >= 0.95 * n


def test_no_named_parts():
    """Nothing but the scan can tell these pages' parts."""
    right, moved, n = judged(plain=True)
    assert n > 100 and right >= 0.93 * n and moved >= 0.95 * n


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("hello  world", "hello world"),
        ("", ""),
        ("<nav>only a menu</nav>", ""),
        (f"<body class='single has-sidebar'><nav><a>Home</a></nav><article><h1>T &amp; U</h1><p>{WORDS}</p></article><footer>all rights</footer>", f"T & U\n{WORDS}"),
        (f"<div class='sidebar-left'><ul><li><a>a b</a></li><li><a>c</a></li></ul><article><p>{WORDS}</p></article></div>", WORDS),
        ("<article><header><h1>T</h1><p>by someone</p></header><p>a b c.</p><footer>tags</footer></article>", "T\nby someone\na b c."),
        (f"<article><p>{WORDS}</p><section id=comments><article class=comment><p>{WORDS} {WORDS}</p></article></section></article>", WORDS),
        (f"<article><p>{WORDS}</p><map name=m><p>{WORDS}</p></article>", f"{WORDS}\n{WORDS}"),
        (f"<article><p>a <object data=x> b</p><video src=x><p>{WORDS}</p><select name=q><p>last one</p></article>", f"a b\n{WORDS}\nlast one"),
        (f"<article><p>a<select><option>x<option>y</select>b</p><p>{WORDS}</p></article>", f"ab\n{WORDS}"),
        (f"<article><p>one<!-- no --><script>var a='</p>'</script> two</p><div hidden>no</div><div class=ad>no</div><p>{WORDS}", f"one two\n{WORDS}"),
        ("<p>a &lt; b &#x41; &nbsp; c", "a < b A c"),
        ("<<<>>", "<<<>>"),
    ],
)
def test_pages(page, want):
    assert html.trained().text(page) == want


@pytest.mark.parametrize("start", ["<b>", "<div>", "<p>", "<li>", "<ul><li><b>", "<table><tr><td>", "<dl><dd><i>", "<a><b>", "<", "<a href='", "<select>", "</p>"])
@pytest.mark.parametrize("end", ["", "</i>", "</a>", "<li>"])
def test_deep(start, end):
    page = start * 20_000 + end * 20_000 + "x"
    began = time.perf_counter()
    html.trained().text(page)
    assert time.perf_counter() - began < 6


def test_rows(spark):
    long = f"<article>{f'<p>{WORDS}</p>' * 30_000}</article>"
    rows = [(1, "u", long, "x"), (1, "u", long, "x"), (2, None, None, "x"), (None, "v", "", "x"), (3, "w", "<p>é ü</p>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, html.extract(df).collect()), key=repr)
    whole = "\n".join([WORDS] * 30_000)
    assert got == sorted([(1, "u", whole), (1, "u", whole), (2, None, ""), (None, "v", ""), (3, "w", "é ü")], key=repr)
    assert html.extract(df.filter("page_id > 9")).count() == 0


def test_any_markup():
    rng = random.Random(3)
    bits = ["<p>", "</p>", "<div class='", "'", ">", "<", "<article", "</article>", "&amp", "a b ", "<!--", "-->", "<script>", "</script>", "<svg>", "<td>", "<li/>", '"', "\x00", "</"]
    for _ in range(300):
        html.trained().text("".join(rng.choices(bits, k=60)))

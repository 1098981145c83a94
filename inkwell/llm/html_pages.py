"""Labelled web pages, made by rule, from which the extractor learns its
weights. Each page is a list of parts ``(markup, content)``: what is content is
the article, what is not is a menu, header, footer, sidebar, notice, advert,
form or reader comment."""

from __future__ import annotations

import random

SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi zo an er in on ul est".split()


def _words(rng: random.Random, low: int, high: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(rng.randint(low, high)))


def _links(rng: random.Random, n: int, item: str = "li") -> str:
    return "".join(f'<{item}><a href="/{i}">{_words(rng, 1, 3)}</a></{item}>' for i in range(n))


def _noise(rng: random.Random) -> dict[str, list[str]]:
    """Markup of what is not content, by where it stands."""
    w = lambda a, b: _words(rng, a, b)
    links = lambda a, b, item="li": _links(rng, rng.randint(a, b), item)
    return {
        "top": [
            f"<header><h1>{w(1, 3)}</h1><nav><ul>{links(3, 9)}</ul></nav></header>",
            f'<div class="site-header"><p>{w(2, 6)}</p></div><ul class="menu">{links(4, 9)}</ul>',
            f'<div id="top-nav">{links(3, 8, "span")}</div>',
            f"<nav>{links(3, 8, 'div')}</nav>",
            f'<div class="breadcrumbs">{links(2, 4, "span")}</div>',
            f'<div class="cookie-notice"><p>{w(8, 25)}</p><button>{w(1, 2)}</button></div>',
            f'<div role="banner">{w(2, 8)}</div>',
            f'<div class="ad">{w(3, 14)}</div>',
        ],
        "middle": [
            f'<div class="advert">{w(3, 20)}</div>',
            f'<div class="ad-slot"><p>{w(3, 15)}</p></div>',
            f'<aside><h3>{w(1, 3)}</h3><ul>{links(2, 5)}</ul></aside>',
            f'<form action="/s"><label>{w(1, 3)}</label><input name="q"><p>{w(3, 9)}</p></form>',
            f'<div class="newsletter"><p>{w(6, 18)}</p></div>',
            f'<div class="share">{links(2, 4, "span")}</div>',
            f'<div style="display:none">{w(3, 20)}</div>',
        ],
        "end": [
            f'<section id="comments"><h2>{w(1, 2)}</h2>' + "".join(f'<div class="comment"><p>{w(4, 40)}</p></div>' for _ in range(rng.randint(1, 5))) + "</section>",
            f'<div class="sidebar"><p>{w(5, 30)}</p><ul>{links(3, 8)}</ul></div>',
            f'<aside class="related"><p>{w(5, 25)}</p>{links(2, 6, "p")}</aside>',
            f"<footer><p>&copy; {w(3, 14)}</p>{links(1, 5, 'span')}</footer>",
            f'<div id="footer">{w(4, 20)}</div>',
            f'<ul class="pagination">{links(2, 6)}</ul>',
            f'<div role="contentinfo">{w(3, 12)}</div>',
        ],
    }


def _untold(rng: random.Random) -> dict[str, list[str]]:
    """The same kinds of parts, with markup that names none of them."""
    w = lambda a, b: _words(rng, a, b)
    links = lambda a, b, item="li": _links(rng, rng.randint(a, b), item)
    name = lambda: rng.choice(["c", "x", "box-", "g"]) + str(rng.randint(1, 99))
    remarks = lambda: "".join(f'<div class="{name()}"><b>{w(1, 2)}</b> {w(1, 3)}<p>{w(3, 30)}</p></div>' for _ in range(rng.randint(1, 5)))
    return {
        "top": [
            f'<div class="{name()}"><ul>{links(3, 9)}</ul></div>',
            f'<div class="{name()}">{links(3, 8, "span")}</div>',
            f'<div class="{name()}"><div>{w(1, 3)}</div><ul>{links(4, 8)}</ul><p>{w(4, 16)}</p></div>',
            f"<table><tr><td>{links(3, 6, 'div')}</td></tr></table>",
            f'<div class="{name()}"><p>{w(5, 14)} <a href="/x">{w(1, 3)}</a></p></div>',
        ],
        "end": [
            f'<div class="{name()}"><h3>{w(1, 3)}</h3>{remarks()}</div>',
            f'<div class="{name()}"><h3>{w(1, 3)}</h3><ul>{links(3, 8)}</ul></div>',
            f'<div class="{name()}"><p>{w(5, 20)} <a href="/p">{w(2, 4)}</a></p>{links(2, 5, "p")}</div>',
            f'<div class="{name()}">{w(3, 14)} {links(1, 4, "span")}</div>',
            f"<table><tr><td><p>{w(5, 20)}</p></td><td>{links(2, 5, 'div')}</td></tr></table>",
        ],
    }


def labelled_page(rng: random.Random) -> list[tuple[str, bool]]:
    """One page in parts, in page order. On four of ten pages the markup names no
    part; of these half have no article element either."""
    noise, plain = _noise(rng), rng.random() < 0.4
    body: list[tuple[str, bool]] = [(f"<h1>{_words(rng, 3, 9)}</h1>", True)] if rng.random() < 0.85 else []
    for _ in range(rng.randint(3 if plain else 1, 9)):
        kind = rng.random()
        link = f' <a href="/x">{_words(rng, 1, 4)}</a> ' if rng.random() < 0.3 else " "
        text = f"{_words(rng, 4, 60)}{link}{_words(rng, 1, 30)}" if rng.random() < 0.8 else _words(rng, 1, 4)
        body.append(
            (
                f"<p>{text}</p>" if kind < 0.6
                else f"<p><b>{text}<br>" if kind < 0.68
                else f"<ul>{''.join(f'<li>{_words(rng, 2, 14)}</li>' for _ in range(rng.randint(2, 5)))}</ul>" if kind < 0.76
                else f"<h2>{_words(rng, 2, 6)}</h2>" if kind < 0.84
                else f"<blockquote>{text}</blockquote>" if kind < 0.9
                else f"<table><tr><td>{_words(rng, 1, 6)}</td><td>{_words(rng, 1, 6)}</td></tr></table>" if kind < 0.95
                else f"<div>{text}</div>",
                True,
            )
        )
        if rng.random() < 0.2:
            body.append((rng.choice(noise["middle"]), False))
    if plain:
        noise = _untold(rng)
    shells = ['<div class="a1">', "<div>", "<article>", "<main>"] if plain else ["<article>", "<main>", '<div class="post-content">', '<div id="content">', "<div>", "<main><article>"]
    shell = rng.choice(shells)
    names = [x.split()[0].strip("<>") for x in shell.replace("><", "> <").split("> ")]
    end = "".join(f"</{x}>" for x in reversed(names))
    top = [(x, False) for x in rng.sample(noise["top"], rng.randint(1, 4))]
    last = [(x, False) for x in rng.sample(noise["end"], rng.randint(1, 4))]
    inside = last.pop(0) if rng.random() < 0.2 and not plain else None
    body = [(shell, False), *body, *([inside] if inside else []), (end, False)]
    frame = rng.choice(["", "", ' class="single has-sidebar"', ' class="sidebar-right page"'])
    head = f"<!DOCTYPE html><html><head><title>{_words(rng, 3, 8)}</title><script>var a='<p>';</script></head><body{frame}>"
    return [(head, False), *top, *body, *last, ("</body></html>", False)]


def labelled_pages(n: int, seed: int = 11) -> list[list[tuple[str, bool]]]:
    rng = random.Random(seed)
    return [labelled_page(rng) for _ in range(n)]

"""Main texts of pages whose text is known as they are made, and of the shapes that real pages have."""

from __future__ import annotations

import random
from html import escape

import pytest

from wayfold.llm import html_extract

P = [f"Paragraph {k} with quite a lot of words in it, so that it weighs." for k in range(4)]
BODY = "".join(f"<p>{p}</p>" for p in P)
WANT = "\n\n".join(P)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<article>{BODY}</article><ol class="comment-list"><li><article class="comment-body"><p>I disagree with all of it.</p></article></li></ol>', WANT),
        (f'<main><article>{BODY}</article></main><aside class="related"><article class="card"><p>A teaser of some length.</p></article></aside>', WANT),
        (f'<main><article>{BODY}</article><article class="comment"><p>A reader says something long.</p></article></main>', WANT),
        (f'<form id="aspnetForm"><input name="x"><div>{BODY}</div></form>', WANT),
        (f'<article>{BODY}<form><label>Mail</label><p>Subscribe to it.</p></form></article>', WANT),
        (f'<article>{BODY}<section class="legal"><p>Legal words.</p></section></article>', WANT + "\n\nLegal words."),
        (f'<article>{BODY}</article><div class="legal"><p>Legal words.</p></div>', WANT),
        (f"<div>{'We use cookies here. ' * 15}</div><article>{BODY}</article>", WANT),
        (f"<div>We use cookies on this site.</div><div>{BODY}</div>", WANT),
        (f"<div>{BODY}{'<p><a href=x>a link of some text</a></p>' * 4}<p>The end.</p></div>", WANT + "\n\nThe end."),
        (f"<article>{BODY}<p>The end.</p></article>", WANT + "\n\nThe end."),
        # The advert's end tag is missing, and another element's stands in for it.
        (f'<div id="wrap"><div class="ad">Buy it<article>{BODY}</article></div>', WANT),
        (f'<div class="ad">Buy it<article>{BODY}</article>', WANT),
        (f"<ul><li class=ad>Buy it<li>{P[0]}<li>{P[1]}</ul>", "\n\n".join(P[:2])),
        (f"<p class=ad>Buy it<p>{P[0]}", P[0]),
    ],
)
def test_shapes_of_pages(page, want):
    assert html_extract.extract(f"<html><head><title>T</title></head><body>{page}</body></html>")[0] == want


def test_a_menu_without_a_name_is_cut_where_its_sums_dive():
    # No tag or class tells; a filter by names would keep it.
    page = f"<article>{BODY}<ul>{'<li><a href=x>See this other page as well</a></li>' * 8}</ul><p>Last words.</p></article>"
    assert html_extract.extract(page)[0] == WANT + "\n\nLast words."
    assert html_extract.extract(f"<article>{BODY}<p><a href=x>One link alone</a></p><p>Last words.</p></article>")[0] == WANT + "\n\nOne link alone\n\nLast words."


def test_pages_made_of_known_parts():
    rng = random.Random(12)
    say = lambda n: " ".join(rng.choice(["so", "the", "ten", "<b>", "&", "rain", "é", "walks"]) for _ in range(n))
    for _ in range(200):
        want, inner = [], []
        for _ in range(rng.randint(1, 12)):
            text = say(rng.randint(1, 40))
            kind = rng.random()
            if kind < 0.75:
                want.append(text)
                tag = rng.choice(["p", "h2", "blockquote", "li"])
                inner.append(f"<{tag}>\n {escape(text).replace(' ', rng.choice([' ', '  ', chr(10)]))}</{tag}>")
            elif kind < 0.9:
                inner.append(rng.choice([f'<div class="ad">{escape(text)}</div>', f"<aside><p>{escape(text)}</p></aside>", f'<script>var a = "{say(4)}</p>"</script>', f'<div class="social-share"><div>{escape(text)}</div></div>', f"<!-- {say(3)} -->"]))
            else:
                inner.append(f"<figure><img src=x alt='{say(2)}'></figure>")
        around = [f"<nav><ul>{'<li><a href=x>Go</a></li>' * rng.randint(1, 9)}</ul></nav>", "<header><h1>Site</h1></header>"]
        after = [f'<section id="comments"><article><p>{escape(say(30))}</p></article></section>', "<footer>&copy; us</footer>", f"<div><p>{escape(say(9))}</p></div>"]
        rng.shuffle(after)
        page = f"<!DOCTYPE html><html><body>{''.join(around)}<article>{''.join(inner)}</article>{''.join(after)}</body></html>"
        got = html_extract.extract(page)[0]
        assert got == "\n\n".join(want) or (not want and not any(p in got for p in ("Site", "Go")))

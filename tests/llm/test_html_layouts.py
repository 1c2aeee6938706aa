"""Articles of pages that no generator made: with and without named blocks, long attribute values, inline elements."""

import time

import pytest

from opinara.llm import html_main

LOREM = "Two rivers meet below the old mill, and in spring the lower road is often under water for a week or more."
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/c">Contact</a></li></ul></nav>'
FOOT = "<footer>&copy; 2024 Example Press. All rights reserved.</footer>"


def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title></head><body>{body}</body></html>"


def par(n, start=LOREM):
    text = (start + " ") * (n // len(start) + 1)
    return text[:n].strip()


P = {n: f"<p>{par(n)}</p>" for n in (125, 180, 200, 300)}
LAYOUTS = {
    "one paragraph": (f"<article>{P[125]}</article>", [par(125)]),
    "one paragraph, nav and footer": (f"{NAV}<article>{P[125]}</article>{FOOT}", [par(125)]),
    "straight in the body": (P[180] * 4, [par(180)] * 4),
    "straight in the body, nav and footer": (NAV + P[180] * 4 + FOOT, [par(180)] * 4),
    "nameless block": (f"<div>{P[180] * 4}</div>", [par(180)] * 4),
    "post-body": (f'<div class="post-body">{par(300)}</div>', [par(300)]),
    "links within": (f'<article>{P[200]}<ul><li><a href="/a">one</a></li><li><a href="/b">two</a></li></ul>{P[200]}</article>', [par(200), "one", "two", par(200)]),
    "nested nameless blocks": (f"{NAV}<div><div><h1>The flood</h1><div>{P[300]}</div>{P[180]}</div></div>{FOOT}", ["The flood", par(300), par(180)]),
    "blog": (f'<div id="page"><div class="site-header"><a href="/">My blog</a></div><div class="entry-content"><h2>The flood</h2>{P[300]}<blockquote>{par(125)}</blockquote></div><div class="sidebar"><h3>Recent</h3><ul><li><a href="/1">First</a></li></ul></div><div id="comments"><h3>2 comments</h3><div class="comment"><p>{par(125)}</p></div></div></div>', ["The flood", par(300), par(125)]),
    "news": (f'<div class="cookie-banner">We use cookies. <button>OK</button></div><header><p>Example Press</p>{NAV}</header><main><article><h1>The flood</h1><p>By the mill</p>{P[300]}<aside class="related"><h3>Related</h3><a href="/x">Other floods</a></aside>{P[200]}</article></main><div class="ad">Buy boots.</div>{FOOT}', ["The flood", "By the mill", par(300), par(200)]),
    "manual": (f'<nav class="toc"><a href="#a">A</a> <a href="#b">B</a></nav><main><h1>Pumps</h1>{P[125]}<pre>pump --on</pre><table><tr><th>Flag</th><th>Use</th></tr><tr><td>--on</td><td>starts it</td></tr></table></main>', ["Pumps", par(125), "pump --on", "Flag", "Use", "--on", "starts it"]),
    "beside a nameless line": (f"<div>Example Press, since 1901</div><article><h1>The flood</h1>{P[300]}{P[180]}</article>", ["The flood", par(300), par(180)]),
    "section and form": (f'<section>{P[200]}<form class="search"><label>Search</label><input><button>Go</button></form></section>', [par(200)]),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_article_is_found(name):
    body, want = LAYOUTS[name]
    assert html_main.default_model().extract(page(body)) == "\n".join(want)


def test_values_of_any_length_and_inline_elements():
    model, long_value = html_main.default_model(), "x > y " * 200_000
    began = time.time()
    assert model.extract(page(f'<article><p title="{long_value}" data-x=\'{long_value}\'>{par(125)}</p></article>')) == par(125)
    assert model.extract(page(f"<article><p title=it's>{par(125)} <a href=\"/it's\">isn't</a></p></article>")) == par(125) + " isn't"
    assert model.extract(page('<article><p class="a>' + "b" * 100_000)) == "b" * 100_000
    html_main.Page('<p class="' * 20_000 + "<p class='" * 20_000)
    assert time.time() - began < 20
    whole = "<p>Se<ruby>co<rt>o</rt></ruby>nd <my-mark>own</my-mark> <picture><img></picture><video>no</video><audio></audio><label>l</label><output>o</output><button>b</button> end</p>"
    got = html_main.Page(whole)
    assert got.text([True] * len(got.tags)) == "Secoond own nolob end"

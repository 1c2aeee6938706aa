"""HTML extraction (operator 7): a tree-structured graphical model over a page's block elements.

A page becomes a tree of its block elements; inline elements belong to the block they stand in. Each block is content or not: its
own potential comes from its tag, the words of its class, id and role, the length of its text, its share of
link text and whether it stands beside the page's article or main element; a potential between parent and child ties their labels. Sum-product messages go up from
the leaves and down from the root, and give each block's exact marginal. Weights are trained by
gradient ascent on the likelihood of labelled pages, where the same messages give the expected
counts. ``labelled_pages`` makes pages of many layouts with labels in ``data-main`` attributes; own labelled pages may be passed instead.

The text is that of blocks with a marginal of at least a half, in page order. Scripts, styles, comments of the markup and the head never count.

Defined results: null and empty pages give the empty text. Broken markup is read as browsers do where that
matters here: a new block closes an open paragraph, stray end tags are skipped, an unclosed page ends at its end. Very long and very deeply nested
pages are read whole, in time that grows with their length. Repeated rows each get a row, empty tables give empty results, and of other
columns those named in ``keep`` stay. Without labelled pages the weights are 0, every marginal is a half, and all text outside scripts, styles and the like counts.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Elements of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template svg iframe textarea title object math canvas".split())
INLINE = frozenset("a abbr acronym audio b bdi bdo big blink br button cite code data del dfn em font i img ins kbd label mark meter nobr output picture progress q rb rp rt rtc ruby s samp slot small span strike strong sub sup time tt u var video wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
ENDS_OWN_KIND = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
HOLDS = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select"}

# A quote is one only where a value begins; a value is read to its quote however long it is.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+(?:"[^"]*+"|'[^']*+')?)*+)(?:>|\Z)|([^<]+|<)""", re.S)
ATTRIBUTES = re.compile(r"""(?<![^\s"'/])(class|id|role|data-main)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[a-z]+")


def is_inline(tag: str) -> bool:
    """Elements of the page's own making are inline, as long as their style isn't read."""
    return tag in INLINE or "-" in tag


class Page:
    """Blocks in page order: tag, attribute text, parent, text pieces; ``flow`` is the text with block borders."""

    def __init__(self, source: str):
        self.tags, self.attributes, self.parents = ["#page"], [""], [-1]
        self.chars, self.linked, self.children = [0], [0], [0]
        self.flow: list[tuple[int, str | None]] = []  # (block, text), or (block, None) at a border
        stack: list[tuple[str, int]] = [("#page", 0)]  # open elements with their block
        self._open: dict[str, list[int]] = {}  # of each tag its places in the stack
        nearest = lambda tags: max((self._open[t][-1] for t in tags if self._open.get(t)), default=0)
        links, at = 0, 0
        head = False
        while m := TOKEN.match(source, at):
            at = m.end()
            close, tag, rest, text = m.groups()
            if text is not None:
                if not head:
                    block = stack[-1][1]
                    text = html.unescape(text) if "&" in text else text
                    self.flow.append((block, text))
                    n = len(text.strip())
                    self.chars[block] += n
                    self.linked[block] += n if links else 0
                continue
            if tag is None:
                continue
            tag = tag.lower()
            if tag == "head":
                head = not close
                continue
            if tag == "body":
                head = False
            if close:
                if self._open.get(tag):
                    links = self._close(stack, tag, links)
                continue
            if tag in SKIPPED:
                if not rest.rstrip().endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                    at = end.end() if end else len(source)
                continue
            if tag in CLOSES_P and self._open.get("p"):
                links = self._close(stack, "p", links)
            if tag in ENDS_OWN_KIND:
                k = nearest(ENDS_OWN_KIND[tag].split())
                if k > nearest(HOLDS[tag].split()):
                    links = self._close(stack, stack[k][0], links)
            if tag == "br":
                self.flow.append((stack[-1][1], " "))
            if tag in VOID:
                continue
            if is_inline(tag):
                self._open.setdefault(tag, []).append(len(stack))
                stack.append((tag, stack[-1][1]))
                links += tag == "a"
                continue
            parent = stack[-1][1]
            self.tags.append(tag)
            self.attributes.append(rest)
            self.parents.append(parent)
            self.chars.append(0)
            self.linked.append(0)
            self.children.append(0)
            self.children[parent] += 1
            self._open.setdefault(tag, []).append(len(stack))
            stack.append((tag, len(self.tags) - 1))
            self.flow.append((len(self.tags) - 1, None))
            if rest.endswith("/") and tag not in CLOSES_P:
                links = self._close(stack, tag, links)

    def _close(self, stack, tag: str, links: int) -> int:
        while True:
            t, _ = stack.pop()
            self._open[t].pop()
            if t == "a":
                links -= 1
            elif not is_inline(t):
                self.flow.append((stack[-1][1], None))
            if t == tag:
                return links

    @functools.cached_property
    def outside(self) -> list[bool]:
        """Blocks that neither are in an article or main element nor hold one; none, if such elements hold little of the page's plain text."""
        n = len(self.tags)
        inside, holds, plain = [False] * n, [False] * n, 0
        for i in range(n):
            inside[i] = self.tags[i] in ("article", "main") or i > 0 and inside[self.parents[i]]
        for i in range(n - 1, 0, -1):
            if inside[i] or holds[i]:
                holds[self.parents[i]] = True
        own = [c - k for c, k in zip(self.chars, self.linked)]
        plain = sum(own)
        if not any(inside) or sum(c for c, k in zip(own, inside) if k) < 0.3 * plain:
            return [False] * n
        return [not (a or b) for a, b in zip(inside, holds)]

    def text(self, keep) -> str:
        lines, now = [], []
        for block, text in self.flow:
            if text is None:
                if now and (line := " ".join("".join(now).split())):
                    lines.append(line)
                now = []
            elif keep[block]:
                now.append(text)
        if now and (line := " ".join("".join(now).split())):
            lines.append(line)
        return "\n".join(lines)

    def labels(self) -> list[int]:
        out = []
        for parent, a in zip(self.parents, self.attributes, strict=True):
            found = re.search(r'data-main="([01])"', a)
            out.append(int(found[1]) if found else out[parent] if parent >= 0 else 0)
        return [*out[1:2], *out[1:]]  # the page is what its outermost element is


@functools.lru_cache(maxsize=20_000)
def name_features(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag and the words of class, id and role."""
    words = set()
    for m in ATTRIBUTES.finditer(attributes):
        if m[1].lower() != "data-main":
            words.update(WORDS.findall((m[2] or m[3] or m[4] or "").lower()))
    return (f"t:{tag}", *(f"w:{w}" for w in sorted(words)))


def shape_features(page: Page, i: int) -> tuple[str, ...]:
    """How much text stands in the block itself, how much of it links, and whether the page's article is elsewhere."""
    n = page.chars[i]
    size = "none" if n == 0 else "few" if n < 25 else "some" if n < 80 else "many" if n < 300 else "lots"
    share = page.linked[i] / n if n else 0
    return (f"n:{size}", f"l:{'all' if share > 0.8 else 'half' if share > 0.3 else 'no'}:{size != 'none'}", *(("outside",) if page.outside[i] else ()))


def pair_feature(page: Page, i: int) -> str:
    """Which kind of edge leads to block i: to an article or main element, to a plain block, one that leaves the article's side, or one whose name may set it apart."""
    if page.tags[i] in ("article", "main"):
        return "main"
    if page.outside[i] and not page.outside[page.parents[i]]:
        return "beside"
    return "named" if len(name_features(page.tags[i], page.attributes[i])) > 1 or page.tags[i] in ("aside", "footer", "form", "header", "nav") else "plain"


def _logadd(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


class TreeModel:
    """weights: per feature, for content against not; pairs: per kind of edge, [parent label][child label]."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.pairs = {k: [[0.0, 0.0], [0.0, 0.0]] for k in ("beside", "main", "named", "plain")}
        self._own = functools.lru_cache(maxsize=50_000)(lambda tag, attributes: sum(self.weights.get(f, 0.0) for f in name_features(tag, attributes)))

    def __getstate__(self):
        return {"weights": self.weights, "pairs": self.pairs}

    def __setstate__(self, state):
        self.__init__()
        self.weights, self.pairs = state["weights"], state["pairs"]

    def messages(self, page: Page):
        """Per block its own log-odds with all messages from below, the messages up, and log-potentials with those from above."""
        n = len(page.tags)
        own = [0.0] * n
        for i in range(n):
            own[i] = self._own(page.tags[i], page.attributes[i]) + sum(self.weights.get(f, 0.0) for f in shape_features(page, i))
        below = [[0.0, u] for u in own]
        up: list = [None] * n
        kinds = [pair_feature(page, i) for i in range(n)]
        for i in range(n - 1, 0, -1):  # children come after parents
            (p00, p01), (p10, p11) = self.pairs[kinds[i]]
            b0, b1 = below[i]
            up[i] = (_logadd(p00 + b0, p01 + b1), _logadd(p10 + b0, p11 + b1))
            at = below[page.parents[i]]
            at[0] += up[i][0]
            at[1] += up[i][1]
        above = [[0.0, 0.0] for _ in range(n)]
        for i in range(1, n):
            k = page.parents[i]
            rest0, rest1 = below[k][0] - up[i][0] + above[k][0], below[k][1] - up[i][1] + above[k][1]
            (p00, p01), (p10, p11) = self.pairs[kinds[i]]
            above[i] = [_logadd(rest0 + p00, rest1 + p10), _logadd(rest0 + p01, rest1 + p11)]
            low = max(above[i])
            above[i] = [above[i][0] - low, above[i][1] - low]
        return below, up, above, kinds

    def marginals(self, page: Page) -> list[float]:
        below, _, above, _ = self.messages(page)
        return [1 / (1 + math.exp(min(700.0, max(-700.0, (b[0] + a[0]) - (b[1] + a[1]))))) for b, a in zip(below, above, strict=True)]

    def extract(self, source: str | None) -> str:
        if not source:
            return ""
        page = Page(source)
        return page.text([m >= 0.5 for m in self.marginals(page)])


def train(pages: list[str], rounds: int = 45, rate: float = 0.5, l2: float = 0.002) -> TreeModel:
    """Fit by adaptive gradient ascent on the pages' likelihood; labels are in ``data-main`` attributes."""
    model, parsed = TreeModel(), [Page(p) for p in pages]
    labels = [p.labels() for p in parsed]
    if not pages:
        return model
    seen_w: dict[str, float] = {}
    seen_p = {k: [[1e-8] * 2 for _ in range(2)] for k in model.pairs}
    for _ in range(rounds):
        gw: dict[str, float] = {}
        gp = {k: [[0.0, 0.0], [0.0, 0.0]] for k in model.pairs}
        for page, label in zip(parsed, labels, strict=True):
            below, up, above, kinds = model.messages(page)
            for i in range(len(page.tags)):
                z = (below[i][0] + above[i][0]) - (below[i][1] + above[i][1])
                off = label[i] - 1 / (1 + math.exp(min(700.0, max(-700.0, z))))
                for f in (*name_features(page.tags[i], page.attributes[i]), *shape_features(page, i)):
                    gw[f] = gw.get(f, 0.0) + off
                if i:
                    k = page.parents[i]
                    rest = [below[k][s] - up[i][s] + above[k][s] for s in (0, 1)]
                    joint = [[rest[s] + model.pairs[kinds[i]][s][c] + below[i][c] for c in (0, 1)] for s in (0, 1)]
                    top = max(map(max, joint))
                    total = sum(math.exp(x - top) for row in joint for x in row)
                    for s in (0, 1):
                        for c in (0, 1):
                            gp[kinds[i]][s][c] += (label[k] == s and label[i] == c) - math.exp(joint[s][c] - top) / total
        for f, g in gw.items():
            g = g / len(parsed) - l2 * model.weights.get(f, 0.0)
            seen_w[f] = seen_w.get(f, 1e-8) + g * g
            model.weights[f] = model.weights.get(f, 0.0) + rate * g / math.sqrt(seen_w[f])
        for k, rows in gp.items():
            for s in (0, 1):
                for c in (0, 1):
                    g = rows[s][c] / len(parsed) - l2 * model.pairs[k][s][c]
                    seen_p[k][s][c] += g * g
                    model.pairs[k][s][c] += rate * g / math.sqrt(seen_p[k][s][c])
        model._own.cache_clear()
    return model


# Names that pages give to their parts.
CONTENT_NAMES = ["article", "content", "post", "entry", "story", "body", "main", "text", "article-body", "article-content", "post-content", "post-body", "post-text", "entry-content", "entry-body", "story-body", "main-content", "page", "wrapper", "container"]
PART_NAMES = {
    "nav": ["nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "toc", "pagination", "pager"],
    "header": ["header", "masthead", "topbar", "branding", "site-header", "logo"],
    "footer": ["footer", "copyright", "site-footer", "bottom", "legal"],
    "aside": ["sidebar", "aside", "widget", "related", "recommended", "popular", "trending", "rail"],
    "notice": ["notice", "cookie", "cookie-banner", "consent", "alert", "gdpr", "popup", "modal", "newsletter", "subscribe", "paywall", "disclaimer"],
    "ad": ["ad", "ads", "advert", "advertisement", "banner", "sponsor", "sponsored", "promo", "promotion"],
    "form": ["form", "search", "login", "signup", "contact-form", "search-form"],
    "share": ["share", "social", "sharing", "tags", "meta", "byline"],
    "comments": ["comments", "comment", "comment-list", "reply", "replies", "discussion", "disqus", "respond", "reader-comments"],
}


def labelled_pages(n: int = 200, seed: int = 7, named: Callable[[list[str]], list[str]] = list) -> list[str]:
    """Pages of many layouts; ``data-main`` says what isn't the article: whatever isn't a part of another kind is. ``named`` picks, of each list of names, those to use.

    The article stands in an article or main element, in a named or nameless block, in several, in cells of a table, or straight in the body.
    """
    r = random.Random(seed)
    some = lambda kinds, p: "".join(part(k) for k in kinds if r.random() < p)

    def words(a: int, b: int) -> str:
        return " ".join("x" * r.randint(2, 9) for _ in range(r.randint(a, b)))

    def links(tag: str) -> str:
        rows = "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' if r.random() < 0.8 else f'<a href="/x">{words(1, 3)}</a>' for _ in range(r.randint(2, 8)))
        return f"<ul>{rows}</ul>" if tag != "div" or r.random() < 0.7 else rows

    def prose(k: int) -> str:
        out = ""
        for _ in range(k):
            kind = r.random()
            if kind < 0.62:
                out += f"<p>{words(1, 70)}" + (f' <a href="/x">{words(1, 4)}</a> {words(0, 9)}' if r.random() < 0.2 else "") + "</p>"
            elif kind < 0.7:
                out += f"<h{r.randint(2, 4)}>{words(2, 8)}</h2>"
            elif kind < 0.77:
                out += "<ul>" + "".join(f"<li>{words(2, 20)}</li>" for _ in range(r.randint(1, 5))) + "</ul>"
            elif kind < 0.82:
                out += "<ul>" + "".join(f'<li><a href="/x">{words(1, 5)}</a></li>' for _ in range(r.randint(1, 4))) + "</ul>"
            elif kind < 0.87:
                out += f"<blockquote><p>{words(5, 30)}</p></blockquote>"
            elif kind < 0.9:
                out += f"<pre>{words(5, 20)}</pre>"
            elif kind < 0.93:
                out += f"<table><tr><th>{words(1, 3)}</th></tr><tr><td>{words(1, 4)}</td><td>{words(1, 9)}</td></tr></table>"
            elif kind < 0.95:
                out += f"<figure><img><figcaption>{words(2, 15)}</figcaption></figure>"
            elif kind < 0.97:
                out += f"<div>{words(3, 40)}</div>"
            else:
                out += f"<dl><dt>{words(1, 3)}</dt><dd>{words(2, 20)}</dd></dl>"
        return out

    def part(kind: str) -> str:
        names = named(PART_NAMES[kind])
        semantic = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        tag = semantic if semantic and r.random() < 0.6 else "section" if r.random() < 0.15 else "div"
        shown = r.random() < 0.5 or tag in ("div", "section")
        name = f' {r.choice(["class", "class", "id"])}="{r.choice(names)}"' if shown else ""
        inner = {
            "nav": lambda: links(tag), "header": lambda: f'<h1>{words(1, 4)}</h1>' * (r.random() < 0.3) + f"<p>{words(2, 9)}</p>" + links(tag) * (r.random() < 0.5),
            "footer": lambda: f"&copy; {words(2, 12)} {links(tag) if r.random() < 0.5 else ''}" if r.random() < 0.6 else f"<p>{words(3, 25)}</p>", "aside": lambda: f"<h3>{words(1, 4)}</h3>" + (links(tag) if r.random() < 0.6 else f"<p>{words(5, 40)}</p>"),
            "notice": lambda: f"<p>{words(5, 40)}</p><button>{words(1, 2)}</button>" if r.random() < 0.5 else words(5, 40), "ad": lambda: words(3, 30) if r.random() < 0.6 else f"<p>{words(3, 30)}</p>",
            "form": lambda: f"<p>{words(1, 6)}</p><label>{words(1, 3)}</label><input><button>{words(1, 2)}</button><select><option>{words(1, 1)}</option></select>", "share": lambda: links("div") if r.random() < 0.5 else f"<span>{words(1, 4)}</span>",
            "comments": lambda: f"<h3>{words(1, 3)}</h3>" + "".join(comment() for _ in range(r.randint(1, 4))),
        }[kind]()
        return f'<{tag}{name} data-main="0">{inner}</{tag}>'

    def comment() -> str:
        tag = r.choice(["div", "div", "div", "li", "li", "article"])
        name = f' class="{r.choice(["comment", "reply", "comment-body"])}"' if r.random() < 0.7 or tag == "article" else ""
        return f"<{tag}{name}><p>{words(3, 50)}</p></{tag}>"

    def article() -> str:
        if r.random() < 0.2:  # hardly any text
            return f"<h1>{words(1, 9)}</h1>" * (r.random() < 0.5) + f"<p>{words(1, 25)}</p>"
        if r.random() < 0.1:  # lines without elements of their own
            return f"<h1>{words(1, 9)}</h1>" * (r.random() < 0.5) + "<br>".join(words(5, 60) for _ in range(r.randint(1, 4)))
        heads = r.random()
        head = f"<h1>{words(2, 10)}</h1>" if heads < 0.6 else f"<header><h1>{words(2, 10)}</h1></header>" if heads < 0.7 else ""
        out = head + prose(r.randint(1, 4)) + some(["ad", "share", "aside"], 0.15) + prose(r.randint(0, 6)) + some(["share", "form", "comments", "notice"], 0.12)
        return out + ("".join(f"<p>{words(1, 5)}</p>" for _ in range(r.randint(8, 40))) if r.random() < 0.2 else "")

    pages = []
    for _ in range(n):
        kind, beside = r.random(), ""
        if kind < 0.4:
            tag = r.choice(["article", "article", "main"])
            body = f'<{tag}{f" class={chr(34)}{r.choice(named(CONTENT_NAMES))}{chr(34)}" if r.random() < 0.3 else ""}>{article()}</{tag}>'
            if r.random() < 0.7:  # what has no name, but stands beside the article
                beside = f'<div data-main="0">{links("ul") if r.random() < 0.3 else words(2, 30)}</div>'
        elif kind < 0.6:
            body = f'<{r.choice(["div", "div", "section"])} {r.choice(["class", "id"])}="{r.choice(named(CONTENT_NAMES))}">{article()}</div>'
        elif kind < 0.75:
            tag = r.choice(["div", "div", "section"])
            body = "".join(f"<{tag}>{article()}</{tag}>" for _ in range(r.choice([1, 1, 2])))
        elif kind < 0.8:
            body = f'<table><tr><td>{article()}</td><td data-main="0">{links("ul")}</td></tr></table>'
        else:
            body = article()
        for _ in range(r.choice([0, 0, 0, 1, 1, 2])):  # blocks around it
            name = f' class="{r.choice(named(CONTENT_NAMES))}"' if r.random() < 0.5 else ""
            body = f'<div{name}>{some(["nav", "ad"], 0.2)}{body}{some(["aside", "comments"], 0.3)}</div>'
        more = r.random() * 0.9
        pages.append(f'<html data-main="1"><body>{some(["notice", "header", "nav", "form", "ad"], more)}{beside}{body}{some(["comments", "aside", "ad", "form", "notice", "footer"], more)}</body></html>')
    return pages


def learn(pages: DataFrame, html_col: str = "html", max_pages: int = 500) -> TreeModel:
    """A model from pages whose ``data-main`` attributes say what is content: at most ``max_pages``, those of the smallest hashes."""
    rows = pages.where(F.col(html_col).isNotNull()).select(F.col(html_col).alias("html")).orderBy(F.xxhash64("html"), "html").limit(max_pages)
    return train([r["html"] for r in rows.collect()])


@functools.cache
def default_model() -> TreeModel:
    return train(labelled_pages())


def _extract(shared, names: list[str]):
    def run(batches):
        model = shared.value
        for batch in batches:
            texts = [model.extract(t.as_py()) for t in batch.column(names[-1])]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in names[:-1]], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names[:-1], "text", "n_chars"])

    return run


def extract(pages: DataFrame, model: TreeModel | None = None, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The columns named in ``keep``, text and n_chars (code points)."""
    rows = pages.select(*keep, F.col(html_col).alias("_html"))
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + ["text string", "n_chars long"])
    return rows.mapInArrow(_extract(shared, rows.columns), out)

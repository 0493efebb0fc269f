"""HTML extraction with a tree-structured graphical model.

Every block element of a page is a node that is content or not. A node's own potential comes
from a logistic model of its tag, class and id words, length, links and children; each pair of
parent and child has a potential from how often their labels meet. Sum-product messages, from
the leaves up and from the root down, give each node's marginal probability of being content,
and the text directly in nodes at 0.5 or more is the result. Both kinds of potentials are fitted
on labelled pages, which ``labelled_pages`` writes from a seed; others can be given.

Blocks are joined by two line ends, also where only ``<hr>`` stands between them; white space within one
becomes one space (``<br>`` and table cells too); an image leaves no space; the contents of noscript are a
block like any other; character references are decoded. Scripts, styles, titles, form controls and comments
of the markup never reach the model. Cases: null and empty pages give empty text; unclosed and
stray tags are tolerated; a tag, comment, script, style, title or text area cut off by the end is
dropped; other elements that are ignored end with their end tag, or where that is missing with their
parent or before the next block, and self-closed ones are empty; repeated rows give equal rows; long
pages are read whole in linear time; an empty table stays empty.
"""

from __future__ import annotations

import html as references
import random
import re
from collections import Counter
from functools import lru_cache
from math import exp, log

from pyspark.sql import DataFrame, SparkSession

from spectraloom.llm.common import map_rows, pick, table

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|title|textarea)(?![a-z0-9:-])[^>]*+>.*?(?:</\1(?=[\s/>])[^>]*+>|\Z)|<(/?)([a-z][a-z0-9:-]*+)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>|<[!?/][^>]*+>|<[a-z/!?][^>]*+\Z""",
    re.S | re.I,
)
BLOCKS = frozenset("html body article aside section main nav header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr blockquote pre figure figcaption form fieldset address details summary dialog center hgroup menu caption noscript".split())
SPACES = frozenset("br td th".split())
CLOSES_P = BLOCKS - {"html", "body"}
VOID = frozenset("br hr img input meta link wbr area base col embed source track".split())
#: Elements whose contents are no text of the page, and those of them that do not nest.
IGNORED = frozenset("template iframe select button svg object".split())
ALONE = IGNORED - {"template", "svg", "object"}
#: A start tag ends an open element of these kinds, up to the nearest of the others.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "p": ({"p"}, set())}
NAMED = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
PART = re.compile(r"[a-z]+")


SECTIONS = frozenset("article main aside nav header footer form section figure table ul".split())


class Node:
    __slots__ = ("tag", "parent", "words", "chars", "linked", "stops", "kids", "items", "gold")

    def __init__(self, tag: str, parent: int, words: list[str]):
        self.tag, self.parent, self.words = tag, parent, words
        self.chars = self.linked = self.stops = self.kids = self.items = 0
        self.gold = None


def ignored(page: str, tokens: list[re.Match]) -> dict[int, tuple[int, int]]:
    """For each token that starts an ignored element: the token and the place to go on from."""
    names = [m[3].lower() if m[3] else "" for m in tokens]
    if IGNORED.isdisjoint(names):
        return {}
    on: dict[int, tuple[int, int]] = {}
    cut: dict[int, int] = {}
    stack, count = [], Counter()

    def close(tag: str, i: int) -> int:
        """Ends open elements up to the nearest of the tag, which is returned."""
        while True:
            k = stack.pop()
            count[names[k]] -= 1
            if names[k] in IGNORED:
                cut[k] = i
            if names[k] == tag:
                return k

    for i, (tag, m) in enumerate(zip(names, tokens)):
        if not tag or tag in VOID:
            continue
        if m[2]:
            if count[tag]:
                k = close(tag, i)
                if cut.pop(k, None) is not None:
                    on[k] = i + 1, m.end()
            continue
        if tag in ALONE and count[tag]:
            close(tag, i)
        if tag not in BLOCKS and m[4].rstrip().endswith("/"):
            if tag in IGNORED:
                on[i] = i + 1, m.end()
            continue
        stack.append(i)
        count[tag] += 1
    cut.update((k, len(tokens)) for k in stack if names[k] in IGNORED)
    following = len(tokens)
    for i in range(len(tokens) - 1, -1, -1):
        if i in cut:
            k = min(cut[i], following)
            on[i] = k, tokens[k].start() if k < len(tokens) else len(page)
        if names[i] in BLOCKS or names[i] in ("td", "th"):
            following = i
    return on


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements, parents first, and (element, text) of every block of text in page order."""
    nodes, texts = [Node("html", -1, [])], []
    stack, buffer, at, link = [0], [], 0, False
    linked, count = 0, Counter({"html": 1})  # open elements

    def close(k: int):
        for i in stack[k:]:
            count[nodes[i].tag] -= 1
        del stack[k:]

    def flush():
        nonlocal linked, link
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                node = nodes[stack[-1]]
                texts.append((stack[-1], text))
                node.chars += len(text)
                node.linked += min(linked, len(text))
                node.stops += text.count(". ") + text.count(", ") + (text[-1] in ".!?")
                node.items += 1
        linked, link = 0, False

    def say(piece: str):
        nonlocal linked
        if "&" in piece:
            piece = references.unescape(piece)
        buffer.append(piece)
        if link:
            linked += len(piece)

    tokens = list(TOKEN.finditer(page))
    skips, following = ignored(page, tokens), 0
    for i, m in enumerate(tokens):
        if i < following:
            continue
        if m.start() > at:
            say(page[at : m.start()])
        if i in skips:
            following, at = skips[i]
            continue
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:
            if tag in BLOCKS:
                flush()
                for k in range(len(stack) - 1, 0, -1) if count[tag] else ():
                    if nodes[stack[k]].tag == tag:
                        close(k)
                        break
            elif tag == "a":
                link = False
            continue
        if tag in SPACES:
            buffer.append(" ")
        elif tag == "hr":
            flush()
        elif tag == "a":
            link = True
        elif tag in BLOCKS:
            flush()
            if tag in ("html", "body") and len(stack) > 1 or tag == "html":
                continue
            if tag in CLOSES_P and nodes[stack[-1]].tag == "p":
                close(len(stack) - 1)
            same, stop = ENDS.get(tag, ((), ()))
            for k in range(len(stack) - 1, 0, -1) if any(count[t] for t in same) else ():
                if nodes[stack[k]].tag in same:
                    close(k)
                    break
                if nodes[stack[k]].tag in stop or nodes[stack[k]].tag not in ("p", "div"):
                    break
            words = []
            if m[4] and "=" in m[4]:
                for _, a, b, c in NAMED.findall(m[4]):
                    words += PART.findall((a or b or c).lower())
            nodes.append(Node(tag, stack[-1], words))
            nodes[stack[-1]].kids += 1
            if tag not in VOID:
                stack.append(len(nodes) - 1)
                count[tag] += 1
    if at < len(page):
        say(page[at:])
    flush()
    return nodes, texts


def _bucket(x: float, *edges: float) -> int:
    return sum(x >= e for e in edges)


def surroundings(x: Node) -> list[str]:
    """The features that a node gives to all below it."""
    return ([f"in={x.tag}"] if x.tag in SECTIONS else []) + [f"in:{w}" for w in x.words]


def below(nodes: list[Node]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Characters, linked characters, stops and paragraphs of each subtree."""
    n = len(nodes)
    chars, linked, stops, paragraphs = [x.chars for x in nodes], [x.linked for x in nodes], [x.stops for x in nodes], [int(x.tag == "p" and x.chars > 60) for x in nodes]
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        chars[p] += chars[i]
        linked[p] += linked[i]
        stops[p] += stops[i]
        paragraphs[p] += paragraphs[i]
    return chars, linked, stops, paragraphs


def own_features(nodes: list[Node]) -> list[list[str]]:
    """Names of the features that each node has itself; lengths are those of whole subtrees."""
    chars, linked, _, paragraphs = below(nodes)
    out = []
    for i, x in enumerate(nodes):
        size = _bucket(chars[i], 1, 20, 60, 150, 400, 1500)
        links = _bucket(linked[i] / chars[i] if chars[i] else 0, 0.01, 0.2, 0.5, 0.9)
        f = ["bias", f"tag={x.tag}", f"size={size}", f"links={links}", f"p={_bucket(paragraphs[i], 1, 2, 4)}"]
        f += [f"word={w}" for w in dict.fromkeys(x.words)]
        if i:
            f.append(f"under={nodes[x.parent].tag}")
        out.append(f)
    return out


def observed(nodes: list[Node]) -> list[list[str]]:
    """All features of each node, for training: its own and the distinct ones of those above it."""
    within: list[frozenset] = []
    for i, x in enumerate(nodes):
        above = within[x.parent] if i else frozenset()
        within.append(above.union(surroundings(x)))
    return [f + sorted(within[x.parent]) if i else f for i, (x, f) in enumerate(zip(nodes, own_features(nodes)))]


def scores(nodes: list[Node], weight: dict[str, float]) -> list[float]:
    """The sum of the weights of ``observed`` for each node. Nodes come parents first and in page order, so
    what stands above is kept as one path, with a sum and a count of each feature: the time is linear."""
    out, path, count, sums = [], [], Counter(), [0.0]
    for i, (x, f) in enumerate(zip(nodes, own_features(nodes))):
        while path and path[-1][0] != x.parent:
            for w in path.pop()[1]:
                count[w] -= 1
            sums.pop()
        out.append(sum(weight.get(w, 0.0) for w in f) + (sums[-1] if i else 0.0))
        gives = surroundings(x)
        more = 0.0
        for w in gives:
            if not count[w]:
                more += weight.get(w, 0.0)
            count[w] += 1
        path.append((i, gives))
        sums.append(sums[-1] + more)
    return out


WORDS = "of the and time people water small light house river market city paper garden music winter summer train letter table window answer question number story morning evening road bridge forest".split()


#: Marks of content and other text while a labelled page is parsed.
YES, NO = "\ue000", "\ue001"


def labelled_pages(n: int = 320, seed: int = 3) -> list[list[tuple[str, bool]]]:
    """Pages as runs of (markup, whether its text is content)."""
    r = random.Random(seed)

    style = [0]

    def sentence(least=4, most=18):
        w = [r.choice(WORDS) for _ in range(r.randint(least, most))]
        if style[0] == 1:  # no marks at all
            return " ".join(w)
        if style[0] == 2:  # marks that are no punctuation
            return " ".join(x.upper() + r.choice(("!!", "%%%", "*** |", " |")) for x in w)
        if len(w) > 8:
            w[len(w) // 2] += ","
        return " ".join(w).capitalize() + "."

    def prose(k=4):
        return " ".join(sentence() for _ in range(r.randint(1, k)))

    def menu(k=7):
        return "<ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in r.choices(WORDS, k=r.randint(2, k))) + "</ul>"

    def named(*names):
        return f'{r.choice(("class", "class", "id"))}="{r.choice(names)}"'

    def aside():
        kind = r.choice((0, 1, 2, 3, 4, 5, 6, 6, 6, 7, 8, 9, 10, 11))
        if kind == 11:
            role = r.choice(("navigation", "banner", "contentinfo", "complementary", "search"))
            inner = menu() if role == "navigation" else r.choice((f"<p>{sentence(1, 6)}</p>", menu(4), f"<p>&copy; {sentence(1, 6)}</p>{prose(2)}"))
            return f'<{(t := r.choice(("div", "div", "section")))} role="{role}">{inner}</{t}>'
        if kind == 0:
            return f"<nav>{menu()}</nav>"
        if kind == 1:
            return f"<div {named('nav', 'menu', 'navbar', 'main-menu', 'breadcrumb', 'breadcrumbs', 'topbar', 'nav-links')}>{menu()}</div>"
        if kind == 2:
            return f"<div {named('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner', 'ad-slot', 'sponsor')}>{prose(2)}</div>"
        if kind == 3:
            return f"<aside {named('sidebar', 'side', 'widget', 'related', 'related-posts', 'rail')}><h3>{sentence(1, 4)}</h3>{r.choice((menu(), f'<p>{prose(2)}</p>'))}</aside>"
        if kind == 4:
            return f"<div {named('sidebar', 'side', 'widget', 'related', 'recommended', 'share', 'social', 'tags', 'author-bio', 'newsletter', 'subscribe')}><h3>{sentence(1, 4)}</h3>{r.choice((menu(), f'<p>{prose(2)}</p>'))}</div>"
        if kind == 5:
            return f"<div {named('cookie', 'cookies', 'cookie-notice', 'notice', 'consent', 'gdpr', 'popup', 'modal', 'alert', 'banner', 'disclaimer', 'paywall')}><p>{prose(2)}</p></div>"
        if kind == 6:
            return f"<form>{r.choice((sentence(1, 4), f'<p>{sentence()}</p>'))}{r.choice(('', f'<fieldset>{sentence(1, 5)}</fieldset>'))}</form>"
        if kind == 7:
            inner = "".join(f"<div {named('comment', 'reply', 'comment-body')}><p>{r.choice(WORDS)}: {prose(3)}</p></div>" for _ in range(r.randint(1, 4)))
            return f"<{(t := r.choice(('div', 'section')))} {named('comments', 'comment-list', 'discussion', 'disqus', 'responses', 'comments-area')}><h2>{sentence(1, 3)}</h2>{inner}</{t}>"
        if kind == 8:
            return f"<ul {named('comments', 'comment-list', 'commentlist')}>" + "".join(f"<li><p>{prose(3)}</p></li>" for _ in range(r.randint(1, 4))) + "</ul>"
        if kind == 9:
            return f"<header><p>{sentence(1, 6)}</p>{menu(4)}</header>"
        return f"<footer><p>&copy; {sentence(2, 12)}</p>{r.choice(('', menu(4), prose(2)))}</footer>"

    def body():
        out = [f"<h1>{sentence(3, 12)}</h1>"]
        if r.random() < 0.25:
            out = [f"<header><h1>{sentence(3, 12)}</h1>{r.choice(('', f'<p>{sentence(6, 18)}</p>'))}</header>"]
        for _ in range(r.randint(1, 10)):
            kind = r.randrange(16)
            out.append(
                f"<h2>{sentence(2, 8)}</h2>" if kind == 0
                else "<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(r.randint(2, 5))) + "</ul>" if kind == 1
                else f"<blockquote><p>{prose()}</p></blockquote>" if kind == 2
                else f"<div>{prose()}</div>" if kind == 3
                else f"<table><tr><td>{sentence(1, 4)}</td><td>{sentence(1, 4)}</td></tr></table>" if kind == 4
                else f"<pre>{prose(2)}</pre>" if kind == 5
                else f"<figure><figcaption>{sentence()}</figcaption></figure>" if kind == 6
                else f'<p>{sentence()} <a href="#">{sentence(1, 3)}</a> {prose()}</p>' if kind == 7
                else f"<p><b>{sentence(1, 8)}<br></p>" if kind == 8
                else f"<p>{sentence(1, 5)}</p>" if kind == 9
                else f'<p><a href="#">{sentence(8, 18)}</a> {sentence(1, 5)}</p>' if kind == 14
                else f'<p>{sentence(1, 5)} <a href="#">{prose(2)}</a></p>' if kind == 15
                else f"<p>{prose(8)}</p>"
            )
        return out

    pages = []
    for _ in range(n):
        style[0] = r.choice((0, 0, 1, 2))
        page = [("<!DOCTYPE html><html><head><title>x</title></head><body>", False)]
        wrap = r.choice(("", "", "<div>", '<div class="container">', '<div id="page">'))
        page.append((wrap, False))
        if r.random() < 0.35:
            page.append((f"<header {r.choice(('', named('site-header', 'masthead', 'header')))}><p>{sentence(1, 5)}</p>{menu(4)}</header>", False))
        page += [(aside(), False) for _ in range(r.randint(0, 4))]
        start, end = r.choice((("<article>", "</article>"),) * 4 + (("<main>", "</main>"), ('<div role="main">', "</div>"), ('<div role="article">', "</div>"), ("<main><article>", "</article></main>"), (f"<div {named('content', 'post', 'entry', 'article', 'article-body', 'entry-content', 'main', 'story', 'text', 'post-content')}>", "</div>"), (f"<section {named('content', 'story', 'article', 'post')}>", "</section>")))
        page.append((start, False))
        for x in body():
            page.append((x, True))
            if r.random() < 0.12:
                page.append((aside(), False))
        page.append((end, False))
        page += [(aside(), False) for _ in range(r.randint(0, 4))]
        if r.random() < 0.7:
            page.append((f"<footer><p>{sentence(2, 12)}</p>{r.choice(('', menu(4)))}</footer>", False))
            if r.random() < 0.4:
                page[-1] = (f"<footer>&copy; {sentence(2, 12)} &middot; {prose(2)}</footer>", False)
        pages.append(page)
    return pages


def labelled_tree(page: list[tuple[str, bool]]) -> tuple[list[Node], list[bool]]:
    """The tree of a page and a label for each node: whether most of its text is content."""
    runs = "".join(re.sub(r"(^|>)(?=[^<>]*[^<>\s])", rf"\g<1>{YES if yes else NO}", x) for x, yes in page)
    nodes, texts = parse(runs)
    yes, no = [0] * len(nodes), [0] * len(nodes)
    for i, t in texts:
        k, n = t.count(YES), t.count(NO)
        yes[i] += k * len(t)
        no[i] += n * len(t)
    nodes, _ = parse("".join(x for x, _ in page))
    for i in range(len(nodes) - 1, 0, -1):
        yes[nodes[i].parent] += yes[i]
        no[nodes[i].parent] += no[i]
    labels = [y > n for y, n in zip(yes, no)]
    return nodes, [True if i == 0 or x.tag == "body" else v for i, (x, v) in enumerate(zip(nodes, labels))]


def fit(pages=None, rounds: int = 200, ridge: float = 0.02) -> dict:
    """Weights of features, and log potentials of (parent's label, child's label)."""
    import numpy as np

    trees = [labelled_tree(p) for p in (pages or labelled_pages())]
    rows, ys, pairs = [], [], np.ones((2, 2))
    for nodes, labels in trees:
        rows += observed(nodes)
        ys += labels
        for x, y in zip(nodes[1:], labels[1:]):
            pairs[int(labels[x.parent]), int(y)] += 1
    names = {f: i for i, f in enumerate(sorted({f for row in rows for f in row}))}
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    cols = np.array([names[f] for r in rows for f in r])
    y, w, step = np.array(ys, float), np.zeros(len(names)), np.zeros(len(names))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.bincount(at, w[cols], len(rows))))
        g = np.bincount(cols, (p - y)[at], len(names)) / len(rows) + ridge / 100 * w
        step += g * g
        w -= 0.5 * g / (np.sqrt(step) + 1e-8)
    share = pairs / pairs.sum()
    edge = np.log(share) - np.log(share.sum(1, keepdims=True)) - np.log(share.sum(0, keepdims=True))
    return {"weights": {f: float(w[i]) for f, i in names.items()}, "edge": edge.tolist()}


@lru_cache(maxsize=1)
def default_model() -> dict:
    return fit()


def _add(a: float, b: float) -> float:
    return max(a, b) + log(1 + exp(-abs(a - b)))


def marginals(nodes: list[Node], model: dict) -> list[float]:
    """P(content) of each node by sum-product: messages to parents in reverse order (children
    come after their parents), then to children in order. All in log space."""
    weight, ((e00, e01), (e10, e11)) = model["weights"], model["edge"]
    n = len(nodes)
    own = []
    for s in scores(nodes, weight):
        own.append((-_add(0.0, s), -_add(0.0, -s)))  # log P(0), log P(1)
    up0, up1 = [o[0] for o in own], [o[1] for o in own]  # own potential and messages of children
    to0, to1 = [0.0] * n, [0.0] * n  # message to the parent, by the parent's label
    for i in range(n - 1, 0, -1):
        to0[i], to1[i] = _add(e00 + up0[i], e01 + up1[i]), _add(e10 + up0[i], e11 + up1[i])
        p = nodes[i].parent
        up0[p] += to0[i]
        up1[p] += to1[i]
    all0, all1 = up0[:], up1[:]
    for i in range(1, n):
        p = nodes[i].parent
        a, b = all0[p] - to0[i], all1[p] - to1[i]  # all that the parent knows but this child
        all0[i] += _add(a + e00, b + e10)
        all1[i] += _add(a + e01, b + e11)
    return [1 / (1 + exp(min(700.0, a - b))) for a, b in zip(all0, all1)]


def extract(page: str | None, model: dict | None = None) -> str:
    if not page:
        return ""
    nodes, texts = parse(page)
    p = marginals(nodes, model or default_model())
    return "\n\n".join(t for i, t in texts if p[i] >= 0.5)


def extracted(pages: DataFrame, html: str = "html", page_id: str = "page_id", url: str = "url", model: dict | None = None) -> DataFrame:
    """page_id, url, text, n_chars. The model (some hundred weights) is fitted on the driver."""
    model = model or default_model()

    def setup():
        def one(key, address, page):
            text = extract(page, model)
            return key, address, text, len(text)

        return one

    return map_rows(pick(pages, page_id=page_id, url=url, html=html), "page_id long, url string, text string, n_chars long", setup, 128)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))

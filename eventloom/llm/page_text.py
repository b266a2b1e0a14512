"""Main text of HTML pages: gradient-boosted trees over DOM nodes, decoded over the tree.

A page is parsed into its block elements; text that stands next to blocks inside an element is a node of its own. Every node
is described by what its subtree holds (characters, words, share of link text, tags per character, blocks, punctuation), by
attribute tokens of itself and its ancestors, by its tag, depth, place among its siblings and place in the page. The trees
estimate whether a node holds main text. Decoding keeps the set of nodes with the largest sum of log odds in which no node is
kept without its parent, so a dropped menu drops all its items and a kept paragraph keeps its article.

Nothing labels the pages, so the trees learn from the table's own pages: a bounded sample, weakly labelled by semantic
elements (inside `article` or `main`, outside `nav`, `footer`, `aside`, `form` and the like), and pages composed anew from
the same paragraphs in other layouts (sections as plain `div`s with or without telling classes, side bars, notices, forms,
comments, advertisements inside the article), whose labels are known.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm import trees
from eventloom.llm.common import small_batches, text_of, written

SAMPLE_PAGES = 160  # pages to learn from, at most (chosen by a hash of the html)
LAYOUTS = 4  # new layouts made of each of them

# fixed values: elements of HTML
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template iframe object svg math select textarea title button head video audio canvas".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article aside body div fieldset figure footer form header html main nav section table td th blockquote".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog search".split())
# fixed values: attribute tokens that tell a section's purpose
GOOD = frozenset("article articlebody body content entry main maincontent post story text blog page column prose richtext".split())
BAD = frozenset(
    "ad ads advert advertisement adsense banner breadcrumb breadcrumbs bar byline comment comments consent contact cookie cookies "
    "copyright discussion disqus dialog feedback foot footer form gdpr head header login masthead menu meta modal nav navbar "
    "navigation newsletter notice pager pagination popup privacy promo promoted recommended related replies reply respond "
    "reviews rail search share sharing shoutbox side sidebar signup skip social sponsor sponsored subscribe tags toolbar topbar "
    "widget widgets warning alert overlay navi sidenav leaderboard outbrain taboola cta".split()
)
HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.DOTALL)
NAMED = re.compile(r"\b(?:class|id|role|itemprop|data-[\w-]+|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
PIECE = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Node:
    tag: str
    parent: Node | None
    attrs: str = ""
    children: list[Node] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)  # text directly inside, inline elements included
    link_chars: int = 0
    tags: int = 0
    keep: float = 0.0

    def tokens(self) -> set[str]:
        if not self.attrs:
            return set()
        values = " ".join(a or b or c for a, b, c in NAMED.findall(self.attrs))
        return set(PIECE.findall(CAMEL.sub(" ", values).lower())) | set(PIECE.findall(values.lower()))


def clean(text: str) -> str:
    return " ".join(html.unescape(text).split())


def parse(page: str) -> Node:
    """The block elements of a page. Unclosed elements end where the next one needs it, or with the page."""
    root = current = Node("body", None)
    stack: list[str] = []  # open elements, inline ones too
    open_at: dict[str, list[int]] = {}  # their places in the stack by name
    owners: list[Node] = []  # the current block at each of them
    run: list[str] = []
    links = silent = 0

    def flush() -> None:
        """End the run of text; where it stands next to blocks it becomes a node."""
        nonlocal run
        text = clean("".join(run)) if run else ""
        run = []
        if text:
            node = current
            if current.children or current.tag in ("body", "html"):
                node = Node("#text", current)
                current.children.append(node)
            node.parts.append(text)

    def close(at: int) -> None:
        nonlocal current, links, silent
        while len(stack) > at:
            name, owner = stack.pop(), owners.pop()
            open_at[name].pop()
            links -= name == "a"
            silent -= name in SILENT
            if name in BLOCKS:
                flush()
                current = owner

    def opened(name: str, owner: Node) -> None:
        open_at.setdefault(name, []).append(len(stack))
        stack.append(name)
        owners.append(owner)

    def add(text: str) -> None:
        if text and not silent:
            run.append(text)
            if links:
                current.link_chars += len(text)

    at = 0
    while at < len(page):
        match = TAG.search(page, at)
        if match is None:
            add(page[at:])
            break
        add(page[at : match.start()])
        at = match.end()
        slash, name, attrs = match.group(1), match.group(2), match.group(3)
        if name is None:
            continue
        name = name.lower()
        if slash:
            if open_at.get(name):
                close(open_at[name][-1])
            continue
        if name in RAW:
            end = _end(page, name, at)
            at = len(page) if end < 0 else page.find(">", end) + 1 or len(page)
            continue
        if name in BLOCKS:
            if open_at.get("head"):  # an unclosed head ends with the first block
                close(open_at["head"][0])
            if name not in ("body", "html"):
                _imply(name, open_at, close)
            if not silent:
                flush()
                if name not in ("body", "html", "hr"):
                    if current.parts and not current.children:  # text before a first block becomes a node
                        current.children.append(Node("#text", current, parts=current.parts))
                        current.parts = []
                    node = Node(name, current, attrs)
                    current.children.append(node)
                    opened(name, current)
                    current = node
                    continue
            if name not in ("body", "html", "hr"):
                opened(name, current)
            continue
        current.tags += 1
        if name == "br":
            add("\n")
        if name in VOID or attrs.endswith("/"):
            continue
        opened(name, current)
        links += name == "a"
        silent += name in SILENT
    close(0)
    flush()
    return root


def _end(page: str, name: str, at: int) -> int:
    match = re.compile(f"</{name}", re.IGNORECASE).search(page, at)
    return match.start() if match else -1


def _imply(name: str, open_at: dict[str, list[int]], close) -> None:
    """Close what a new block ends: a paragraph, an item by the next item, cells and rows; nothing beyond the nearest container."""

    def innermost(names) -> int:
        return max((open_at[n][-1] for n in names if open_at.get(n)), default=-1)

    ended = innermost({"p", *CLOSED_BY.get(name, ()), *(HEADINGS if name in HEADINGS else ())})
    if ended >= 0 and ended >= innermost({*CONTAINERS, "ul", "ol"}):
        close(ended)


FEATURES = 36


def describe(root: Node) -> tuple[list[Node], np.ndarray]:
    """All nodes below the root, parents first, and their features."""
    order: list[Node] = []
    info: dict[int, list[float]] = {}
    todo = [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(reversed(node.children))
    starts, at = {}, 0
    for node in order:
        starts[id(node)] = at
        at += sum(map(len, node.parts))
    page = max(1, at)
    for node in reversed(order):  # chars, words, link chars, tags, blocks, longest block, stops, paragraphs, links alone
        text = " ".join(node.parts)
        own = [len(text), text.count(" ") + 1 if text else 0, min(node.link_chars, len(text)), 1 + node.tags, 1 if text else 0, len(text)]
        own += [sum(map(text.count, ".,;:!?")), node.tag == "p" and bool(text), bool(text) and node.link_chars >= 0.8 * len(text)]
        for child in node.children:
            below = info[id(child)]
            own = [max(a, b) if i == 5 else a + b for i, (a, b) in enumerate(zip(own, below, strict=True))]
        info[id(node)] = own
    rows, above = [], {id(root): (0, 0, 0, 0, 0)}
    places = {id(child): place for node in order for place, child in enumerate(node.children)}
    tags_of = {id(node): Counter(child.tag for child in node.children) for node in order if node.children}
    for node in order[1:]:
        chars, words, links, tags, blocks, longest, stops, paragraphs, only = info[id(node)]
        depth, good, bad, main, boiler = above[id(node.parent)]
        tokens = node.tokens()
        own_good, own_bad = len(tokens & GOOD), len(tokens & BAD)
        siblings = node.parent.children
        place = places[id(node)]
        of_parent = max(1, info[id(node.parent)][0])
        hidden = bool(HIDDEN.search(node.attrs)) if node.attrs else False
        is_main, is_boiler = node.tag in ("article", "main"), node.tag in BOILERPLATE_TAGS
        header = node.tag == "header" or (node.tag == "#text" and node.parent.tag == "header")
        above[id(node)] = (depth + 1, good + own_good, bad + own_bad, main + is_main, boiler + is_boiler + header)
        heading = node.tag in HEADINGS
        rows.append(
            [
                np.log1p(chars), np.log1p(words), links / max(1, chars), tags / max(1, words), blocks, chars / max(1, blocks),
                np.log1p(longest), stops / max(1, words), paragraphs, only / max(1, blocks), chars / page, starts[id(node)] / page,
                chars / of_parent, depth, len(siblings), place / len(siblings), tags_of[id(node.parent)][node.tag] / len(siblings),
                own_good, own_bad, good, bad, main + is_main, boiler + is_boiler + header, is_main, is_boiler, header, heading,
                node.tag in ("p", "blockquote", "pre"), node.tag in ("li", "ul", "ol", "dl", "dt", "dd"), node.tag in ("div", "section"),
                node.tag in ("table", "tr", "td", "th", "tbody"), node.tag == "#text", hidden, len(node.children),
                info[id(siblings[place + 1])][0] / max(1, chars) if place + 1 < len(siblings) else -1.0,
                info[id(siblings[place - 1])][0] / max(1, chars) if place else -1.0,
            ]
        )
    return order, np.array(rows, float).reshape(-1, FEATURES)


def decode(order: list[Node], odds: np.ndarray) -> list[str]:
    """The kept texts in page order. A node is kept with its parent only; its gain is its log odds and its children's gains."""
    for node in order:
        node.keep = 0.0
    for node, own in zip(reversed(order[1:]), reversed(odds.tolist()), strict=True):
        node.keep += own
        if node.keep > 0:
            node.parent.keep += node.keep
    kept, out = {id(order[0])}, list(order[0].parts)
    for node in order[1:]:
        if node.keep > 0 and id(node.parent) in kept:
            kept.add(id(node))
            out += node.parts
    return out


def weak_labels(order: list[Node]) -> list[float] | None:
    """1 for nodes that hold main text by their semantic elements, else 0; None if nothing tells the main text."""
    inside: dict[int, tuple[bool, bool]] = {id(order[0]): (False, False)}
    label, any_main = {}, False
    for node in order[1:]:
        main, boiler = inside[id(node.parent)]
        named = node.tokens() & BAD
        main = main or node.tag in ("article", "main")
        boiler = boiler or node.tag in BOILERPLATE_TAGS or (node.tag == "header" and not main) or bool(named and not node.tokens() & GOOD)
        inside[id(node)] = (main, boiler)
        label[id(node)] = float(main and not boiler and bool(node.parts))
        any_main |= main
    if not any_main:
        return None
    for node in reversed(order[1:]):
        if label[id(node)] and node.parent is not order[0]:
            label[id(node.parent)] = 1.0
    return [label[id(n)] for n in order[1:]]


def compose(rng: np.random.Generator, main: list[str], other: list[str]) -> str:
    """A page of a random layout; what is main text stands between the signs \\x02 and \\x03."""

    def say(n: int, words: int = 200) -> str:
        text = " ".join(other[rng.integers(len(other))].split()[: rng.integers(2, words)])
        return html.escape(text or "more")

    def links(n: int) -> str:
        wrap = [("<ul>", "<li>", "</li>", "</ul>"), ("<div>", "", " | ", "</div>"), ("<p>", "", " ", "</p>")][rng.integers(3)]
        return wrap[0] + "".join(f'{wrap[1]}<a href="/x">{say(1, 5)}</a>{wrap[2]}' for _ in range(n)) + wrap[3]

    style = rng.integers(4)  # 0 semantic, 1 classes, 2 ids, 3 plain

    def box(tag: str, names: list[str], inner: str) -> str:
        name = names[rng.integers(len(names))]
        kind = style if rng.random() < 0.8 else rng.integers(3)
        if kind == 0:
            return f"<{tag}>{inner}</{tag}>" if tag != "div" else f'<div class="{name}">{inner}</div>'
        if kind == 3 and tag in ("nav", "header", "footer"):
            return f"<div>{inner}</div>"
        return f'<div {"class" if kind != 2 else "id"}="{name}">{inner}</div>'

    extras = {
        "ad": lambda: box("div", ["ad", "ads", "advert", "banner", "sponsored", "promo-box"], f"<p>{say(1, 30)}</p>" if rng.random() < 0.5 else say(1, 30)),
        "related": lambda: box("aside", ["related", "recommended", "related-posts"], f"<h3>{say(1, 4)}</h3>{links(4)}"),
        "share": lambda: box("div", ["share", "social", "share-bar"], links(3)),
    }
    paragraphs = []
    for text in main:
        tag = "p" if rng.random() < 0.85 else ["blockquote", "li", "h2", "div"][rng.integers(4)]
        text = f"\x02{html.escape(text)}\x03"
        paragraphs.append(f"<{tag}>{text}</{tag}>" if tag != "li" else f"<ul><li>{text}</li></ul>")
        if rng.random() < 0.15:
            paragraphs.append(extras[list(extras)[rng.integers(3)]]())
    title = f"<h1>\x02{html.escape(' '.join(main[0].split()[:8]))}\x03</h1>" if main else ""
    if rng.random() < 0.2:
        title = f"<header>{title}</header>"
    article = box(["article", "main"][rng.integers(2)], ["article", "content", "post-content", "entry", "main-content", "story-body"], title + "".join(paragraphs))
    side = box("aside", ["sidebar", "side", "widget", "rail", "sidebar-right"], f"<h3>{say(1, 4)}</h3><p>{say(1, 40)}</p>{links(5)}")
    before = [
        box("header", ["header", "masthead", "site-header", "topbar"], f"<div>{say(1, 6)}</div>"),
        box("nav", ["nav", "menu", "navbar", "navigation"], links(rng.integers(3, 9))),
    ]
    notice = box("div", ["cookie-notice", "notice", "consent", "cookie-banner", "alert", "newsletter"], f"<p>{say(1, 40)}</p><button>OK</button>")
    form = f'<form><label>{say(1, 4)}</label><input name="q"><p>{say(1, 12)}</p></form>'
    comments = "".join(f'<div class="comment"><p>{say(1, 120)}</p></div>' for _ in range(rng.integers(1, 6)))
    comments = ['<section id="comments">{}</section>', '<div class="comments">{}</div>', '<section class="comment-list">{}</section>'][rng.integers(3)].format(comments)
    after = [box("footer", ["footer", "site-footer", "copyright"], f"<p>{say(1, 30)}</p>{links(3)}")]
    before += [x for x in (notice, form, extras["ad"]()) if rng.random() < 0.4]
    middle = [article]
    if rng.random() < 0.5:
        middle.insert(rng.integers(2), side)
    middle += [x for x in (comments, form, notice, extras["related"](), extras["ad"]()) if rng.random() < 0.35]
    if rng.random() < 0.4:
        middle = ["<div>", *middle, "</div>"]
    return "<html><body>" + "".join([*before, *middle, *after]) + "</body></html>"


def composed_labels(order: list[Node]) -> list[float]:
    label = {id(n): float(any("\x02" in p for p in n.parts)) for n in order}
    for node in reversed(order[1:]):
        if label[id(node)]:
            label[id(node.parent)] = 1.0
        node.parts = [p.replace("\x02", "").replace("\x03", "") for p in node.parts]
    return [label[id(n)] for n in order[1:]]


def training_rows(pages: list[str], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the pages' nodes, and of pages composed of their paragraphs."""
    rng, features, labels, texts = np.random.default_rng(seed), [np.zeros((0, FEATURES))], [], []
    for page in pages:
        order, rows = describe(parse(page))
        own = weak_labels(order)
        if own is not None:
            features.append(rows)
            labels += own
        texts.append([p for n in order for p in n.parts if len(p.split()) > 5])
    texts = [t for t in texts if t] or [["A page has one main text, and around it there is more."], ["Other pages have other words, and more of them."]]
    other = [p for t in texts for p in t]
    for own in texts:
        for _ in range(LAYOUTS):
            main = [own[i] for i in sorted(rng.choice(len(own), rng.integers(1, len(own) + 1), replace=False))]
            tree = parse(compose(rng, main, other))
            whole = [n for n in _walk(tree)]
            values = composed_labels(whole)
            features.append(describe(tree)[1])
            labels += values
    return np.concatenate(features), np.array(labels)


def _walk(root: Node) -> Iterator[Node]:
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(reversed(node.children))


def sample_pages(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE_PAGES) -> DataFrame:
    """(part, html): the `sample` different pages of least hash, or all, in eight arrays; copies of a page count once.

    Pages are collected in sets within the tasks already, so a page of many rows is moved at most once a task.
    """
    rows = pages.select(text_of(html_col).alias("html")).filter("html <> ''").withColumn("key", F.xxhash64("html"))
    chosen = [r.key for r in rows.select("key").distinct().orderBy("key").limit(sample).collect()]
    part = F.pmod(F.xxhash64("html", F.lit(1)), F.lit(8)).alias("part")
    return rows.filter(F.col("key").isin(chosen)).groupBy(part).agg(F.collect_set("html").alias("html"))


def train(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE_PAGES) -> trees.Ensemble:
    """Fit the trees on at most `sample` different pages (by a hash of the html); an empty table trains on two sentences."""
    small_batches(pages)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        pages = sorted(page for listed in frame["html"] for page in listed)
        made, labels = training_rows(pages, int(frame["part"].iloc[0]))
        return pd.DataFrame({"features": list(made), "label": labels})

    shape = "features array<double>, label double"
    table = sample_pages(pages, html_col, sample).groupBy("part").applyInPandas(run, shape)
    table = written(table, "page-nodes")
    if table.isEmpty():
        made, labels = training_rows([], 0)
        table = pages.sparkSession.createDataFrame([(r.tolist(), v) for r, v in zip(made, labels.tolist(), strict=True)], shape)
    return trees.fit(table, iterations=15, depth=5, step=0.3)


def main_text(ensemble: trees.Ensemble, pages: list[str]) -> list[str]:
    described = [describe(parse(page)) for page in pages]
    if not described:
        return []
    p = np.clip(ensemble.probability(np.concatenate([rows for _, rows in described])), 1e-6, 1 - 1e-6)
    odds, at, out = np.log(p / (1 - p)), 0, []
    for order, rows in described:
        out.append("\n".join(decode(order, odds[at : at + len(rows)])))
        at += len(rows)
    return out


def text_column(ensemble: trees.Ensemble, pages: DataFrame, page: Column) -> Column:
    shared = pages.sparkSession.sparkContext.broadcast(ensemble)

    @F.pandas_udf("string")
    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for frame in frames:
            texts = frame.tolist()
            made = [t for a in range(0, len(texts), 200) for t in main_text(shared.value, texts[a : a + 200])]
            yield pd.Series(made, dtype=object)

    return run(page)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of `pages`; a null or empty page, or one without main text, has the text ''."""
    ensemble = train(pages, html_col, **options)
    text = text_column(ensemble, pages, text_of(html_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text.alias("text"))
    return rows.withColumn("n_chars", F.char_length("text").cast("bigint"))

"""Main text of web pages with a tree-structured graphical model.

Every DOM node is content or not. A node's own features (tag, words of its class and
id, amount of text, share of links) and a potential between each parent and child
give the model; sum-product messages pass from the leaves to the root and back and
yield each node's marginal. The weights are trained on labelled pages, by the
gradient of the labels' likelihood, which the same messages give.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked
from .dom import INLINE, Dom, parse

#: Characters of HTML that a task labels at a time.
BLOCK = 2_000_000
_white = re.compile(r"[ \t\n\x0b\x0c\r]+")

# Words by which labelled example pages name their parts.
MAIN_NAMES = "article content post entry story main body text page-content post-body entry-content article-text".split()
REST_NAMES = {
    "menu": "nav menu navbar navigation topnav breadcrumb tabs".split(),
    "header": "header masthead site-header top banner branding".split(),
    "footer": "footer site-footer bottom copyright legal colophon".split(),
    "sidebar": "sidebar aside rail widget related recommended popular".split(),
    "notice": "notice cookie-banner consent alert newsletter subscribe popup promo-bar".split(),
    "advert": "ad ads advert advertisement sponsor promo banner-ad".split(),
    "form": "search login signup form contact-form".split(),
    "comments": "comments comment-list discussion replies disqus responses".split(),
    "share": "share social tags meta byline-links pagination".split(),
}
REST_TAGS = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form", "comments": "section"}
NOT_MAIN = frozenset("nav aside footer form header script style button".split())
_rest_words = frozenset(w for names in REST_NAMES.values() for n in names for w in n.split("-")) - frozenset(("top", "body", "bottom", "meta", "tags"))


def example_pages(n: int, seed: int) -> list[tuple[str, str]]:
    """Labelled pages: (html, 'y' as class of the element that is content) in many layouts, from the names above."""
    rng = np.random.RandomState(seed)
    pick = lambda xs: xs[rng.randint(len(xs))]
    syllables = "ka lo mi tu re sa no vi de pa ri en ul os".split()
    word = lambda: "".join(pick(syllables) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: words(4, 25).capitalize() + pick([".", ".", ".", "?", "!"])
    prose = lambda: " ".join(sentence() for _ in range(1 + int(rng.exponential(3))))
    links = lambda: "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(rng.randint(3, 9)))

    def inline(text: str) -> str:
        kind = rng.randint(8)
        if kind == 0:
            return f"<b>{text}</b>"
        if kind == 1:
            return f'{text} <a href="/{word()}">{words(1, 4)}</a> {sentence()}'
        return f"<em>{word()}</em> {text}" if kind == 2 else text

    def rest(part: str) -> str:
        tag = REST_TAGS.get(part, "div") if rng.rand() < 0.5 else "div"
        name = pick(REST_NAMES[part])
        attrs = "" if tag != "div" and rng.rand() < 0.5 else f' {pick(["class", "id"])}="{name}"'
        if part in ("menu", "share"):
            inner = f"<ul>{links()}</ul>"
        elif part == "footer":
            inner = f"&copy; {word()}.example &middot; {sentence()}" if rng.rand() < 0.6 else f"<p>{words(2, 8)}</p><ul>{links()}</ul>"
        elif part == "header":
            inner = f"<a href='/'>{words(1, 3)}</a><p>{words(2, 6)}</p>"
        elif part == "sidebar":
            inner = f"<h3>{words(1, 3)}</h3>" + (f"<ul>{links()}</ul>" if rng.rand() < 0.7 else f"<p>{sentence()}</p>")
        elif part == "form":
            inner = f"<label>{word()}</label><input type='text'><button>{word()}</button>"
        elif part == "comments":
            inner = "".join(f'<div class="comment"><p>{word()}</p><p>{prose()}</p></div>' for _ in range(rng.randint(1, 4)))
        else:
            inner = sentence() if rng.rand() < 0.6 else f"<p>{sentence()}</p><a href='/x'>{words(1, 3)}</a>"
        return f"<{tag}{attrs}>{inner}</{tag}>"

    pages = []
    for _ in range(n):
        tag = pick(["article", "article", "main", "div", "div", "section"])
        name = "" if tag in ("article", "main") and rng.rand() < 0.6 else f"{pick(MAIN_NAMES)} "
        body = f"<h1>{inline(words(3, 10))}</h1>" + "".join(
            pick(["<p>{}</p>"] * 8 + ["<p>{}<br>", "<h2>{}</h2>", "<ul><li>{}</li></ul>", "<blockquote>{}</blockquote>", "<pre>{}</pre>", "<div><p>{}</p></div>"]).format(inline(prose()))
            for _ in range(rng.randint(1, 12))
        )
        if rng.rand() < 0.3:  # a boilerplate part inside the article
            body += "<i class=n>" + rest(pick(["share", "advert", "comments", "sidebar"])) + "</i>"
        main = f'<{tag} class="{name}y">{body}</{tag}>'
        before = "".join(rest(p) for p in ("header", "menu", "notice", "advert") if rng.rand() < 0.55)
        after = "".join(rest(p) for p in ("comments", "sidebar", "share", "form", "advert", "footer") if rng.rand() < 0.45)
        if rng.rand() < 0.3:
            main = f"<div class='{pick(['wrap', 'container', 'row', 'page'])}'>{main}{rest('sidebar') if rng.rand() < 0.5 else ''}</div>"
        pages.append((f"<html><head><title>{words(2, 8)}</title></head><body>{before}{main}{after}</body></html>", "y"))
    return pages


def _in_main(dom: Dom, labelled: bool) -> np.ndarray:
    """1 for nodes of the content. Example pages mark it (class word y, n for parts that aren't); other pages by their <article> or <main>."""
    y = np.zeros(len(dom.tags), np.int8)
    for i in range(1, len(dom.tags)):
        tag, marks, parent = dom.tags[i], dom.marks[i], dom.parents[i]
        inside = y[parent]
        if labelled:
            y[i] = 1 if "y" in marks else 0 if "n" in marks else inside
        elif tag in ("article", "main"):
            y[i] = 1
        else:
            y[i] = inside and tag not in NOT_MAIN and not _rest_words.intersection(marks)
    return y


def _bucket(n: float) -> int:
    return int(np.log2(n + 1))


def features(dom: Dom) -> list[list[str]]:
    """Names of each node's features; amounts are over the texts below a node."""
    n = len(dom.tags)
    chars, linked, stops = [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(n):
        p = dom.parents[i]
        in_link[i] = dom.tags[i] == "a" or (p >= 0 and in_link[p])
        if dom.tags[i] == "#text":
            size = len(dom.texts[i].strip())
            chars[i], linked[i] = size, size if in_link[i] else 0
            stops[i] = dom.texts[i].count(". ") + dom.texts[i].count(",") + dom.texts[i].rstrip().endswith((".", "!", "?"))
    for i in range(n - 1, 0, -1):
        p = dom.parents[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        stops[p] += stops[i]
    out = []
    for i in range(n):
        tag = dom.tags[i]
        share = linked[i] / chars[i] if chars[i] else 0.0
        own = [f"tag {tag}", f"chars {_bucket(chars[i])}", f"links {int(share * 4)}", f"stops {min(4, _bucket(stops[i]))}"]
        if tag == "#text":
            own.append(f"text in {dom.tags[dom.parents[i]]}")
        own += [f"mark {w}" for w in dom.marks[i] if w not in ("y", "n")]
        out.append(own)
    return out


def _edge_kind(dom: Dom, i: int) -> int:
    tag = dom.tags[i]
    return 0 if tag == "#text" else 1 if tag in INLINE else 2 if not dom.marks[i] else 3


@dataclass
class Forest:
    """Trees of a batch of pages: parent of each node, its depth, edge kind, and (node, feature) pairs."""

    parent: np.ndarray
    levels: list[np.ndarray]
    kind: np.ndarray
    node: np.ndarray
    feature: np.ndarray

    @classmethod
    def of(cls, doms: list[Dom], index: dict[str, int]) -> "Forest":
        parent, kind, depth, node, feature = [], [], [], [], []
        for dom in doms:
            base = len(parent)
            for i, own in enumerate(features(dom)):
                p = dom.parents[i]
                parent.append(base + p if p >= 0 else -1)
                depth.append(depth[base + p] + 1 if p >= 0 else 0)
                kind.append(_edge_kind(dom, i))
                for f in own:
                    k = index.get(f)
                    if k is not None:
                        node.append(base + i)
                        feature.append(k)
        depths = np.array(depth, np.int64)
        order = np.argsort(depths, kind="stable")
        cuts = np.flatnonzero(np.diff(depths[order])) + 1
        return cls(np.array(parent, np.int64), np.split(order, cuts), np.array(kind, np.int64), np.array(node, np.int64), np.array(feature, np.int64))


@dataclass
class ContentModel:
    """weights: of features for the state content; pair: (kind, parent state, child state) log potentials."""

    index: dict[str, int]
    weights: np.ndarray
    pair: np.ndarray

    def marginals(self, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
        """(P(content) of each node, P(parent state, child state) of each node with its parent)."""
        n = len(forest.parent)
        up = np.zeros((n, 2))  # a node's own score and its children's messages
        up[:, 1] = np.bincount(forest.node, self.weights[forest.feature], n) if len(forest.node) else 0
        sent = np.zeros((n, 2))  # message to the parent, by the parent's state
        for level in forest.levels[:0:-1]:
            joint = self.pair[forest.kind[level]] + up[level][:, None, :]
            sent[level] = np.logaddexp(joint[:, :, 0], joint[:, :, 1])
            parents = forest.parent[level]
            for s in (0, 1):
                up[:, s] += np.bincount(parents, sent[level, s], n)
        belief = up.copy()  # with the message from above
        pairs = np.zeros((n, 2, 2))
        for level in forest.levels[1:]:
            parents = forest.parent[level]
            rest = belief[parents] - sent[level]
            joint = rest[:, :, None] + self.pair[forest.kind[level]] + up[level][:, None, :]
            joint -= joint.max(axis=(1, 2), keepdims=True)
            p = np.exp(joint)
            p /= p.sum(axis=(1, 2), keepdims=True)
            pairs[level] = p
            belief[level] = np.log(p.sum(axis=1) + 1e-300)
        gap = np.clip(belief[:, 0] - belief[:, 1], -500, 500)
        return 1 / (1 + np.exp(gap)), pairs

    def texts(self, pages: list[str | None]) -> list[str]:
        """Main text of each whole page."""
        doms = [parse(p) for p in pages]
        forest = Forest.of(doms, self.index)
        content = self.marginals(forest)[0] >= 0.5
        out, base = [], 0
        for dom in doms:
            pieces: list[str] = []
            now = None
            for i, tag in enumerate(dom.tags):
                if tag == "#text" and content[base + i]:
                    if dom.blocks[i] == now:
                        pieces[-1] += dom.texts[i]
                    else:
                        pieces.append(dom.texts[i])
                        now = dom.blocks[i]
            blocks = (_white.sub(" ", p).strip(" ") for p in pieces)
            out.append(" ".join(b for b in blocks if b))
            base += len(dom.tags)
        return out


def fit_content_model(pages: list[tuple[Dom, np.ndarray]], rounds: int = 120, rate: float = 0.15, least_seen: int = 3, ridge: float = 1e-3) -> ContentModel:
    """Adam on the likelihood of the labels: observed less expected features and pairs."""
    seen: dict[str, int] = {}
    for dom, _ in pages:
        for f in {f for own in features(dom) for f in own}:
            seen[f] = seen.get(f, 0) + 1
    index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= least_seen))}
    model = ContentModel(index, np.zeros(len(index)), np.zeros((4, 2, 2)))
    if not pages:
        return model
    forest = Forest.of([d for d, _ in pages], index)
    gold = np.concatenate([y for _, y in pages]).astype(np.int64)
    inner = np.flatnonzero(forest.parent >= 0)
    seen_pairs = np.zeros((4, 2, 2))
    np.add.at(seen_pairs, (forest.kind[inner], gold[forest.parent[inner]], gold[inner]), 1)
    params = [model.weights, model.pair]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        content, pairs = model.marginals(forest)
        expected = np.zeros((4, 2, 2))
        np.add.at(expected, forest.kind[inner], pairs[inner])
        grads = [
            np.bincount(forest.feature, (gold - content)[forest.node], len(index)) / len(pages) - ridge * model.weights,
            (seen_pairs - expected) / len(pages) - ridge * model.pair,
        ]
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def train_page_content(pages: DataFrame, examples: int = 200, sample: int = 150, sample_chars: int = 2_000_000, seed: int = 17) -> ContentModel:
    """Train on ``examples`` labelled example pages and a bounded sample of ``pages`` that label themselves.

    The sample: the ``sample`` pages with an <article> or <main> whose hashes are the
    smallest, up to ``sample_chars`` characters; what is inside is content, but for parts
    named as menus, adverts, comments and the like.
    """
    own = pages.where(F.col("html").rlike("(?i)<(article|main)[ >]") & (F.length("html") <= sample_chars // 4))
    own = own.select(F.xxhash64("page_id", "html").alias("place"), "html")
    # the rows that come to the driver are few whatever the number of tasks: their hashes first, then they
    low = [r["place"] for r in own.select("place").distinct().orderBy("place").limit(sample).collect()]
    rows = [r["html"] for r in own.where(F.col("place").isin(low)).dropDuplicates(["place"]).orderBy("place").collect()]
    taken, chars = [], 0
    for page in rows:
        chars += len(page)
        if chars > sample_chars:
            break
        taken.append(page)
    labelled = [(dom := parse(p), _in_main(dom, True)) for p, _ in example_pages(examples, seed)]
    return fit_content_model(labelled + [(dom := parse(p), _in_main(dom, False)) for p in taken])


def extract_content(pages: DataFrame, model: ContentModel) -> DataFrame:
    """Add text and n_chars (code points) to ``pages``; columns of these names are replaced.

    The whole html is read (null: empty). Character references are decoded, white space
    within a block becomes one space, and blocks are joined by one space in page order. A
    page without content has an empty text. Nothing is shuffled.
    """
    columns = [c for c in pages.columns if c not in ("text", "n_chars")]
    shared = pages.sparkSession.sparkContext.broadcast(model)  # some thousand weights

    def slices(values: list[str | None]) -> Iterable[list[str | None]]:
        part: list[str | None] = []
        chars = 0
        for v in values:
            part.append(v)
            chars += len(v or "")
            if chars >= BLOCK:
                yield part
                part, chars = [], 0
        if part:
            yield part

    @F.pandas_udf("string")
    def main_text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in pages:
            values = [p if isinstance(p, str) else None for p in series]
            yield pd.Series([t for part in slices(values) for t in shared.value.texts(part)], dtype=object)

    found = packed(pages).withColumn("text", main_text(F.col("row")["html"]))
    return found.select(*unpacked(columns), "text", F.length("text").cast("long").alias("n_chars"))

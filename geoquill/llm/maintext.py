"""HTML extraction by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags negative; one linear scan finds the contiguous region of the highest sum, which is the content. Weights are learned from labelled pages: a tag costs what its
name's odds of standing outside the content say, and a word's score is the log odds, by logistic regression, of what it stands in (names, classes, ids and roles of the elements around it; tag, length and link share
of its block), so text inside a menu or among comments scores below zero. The region's edges then grow over blocks without links in the element of its outermost blocks, and
blocks inside the region that stand in an element of negative weight, such as an advert between paragraphs, are left out.

Labelled pages: those of the table that mark their article (`<article>` or `<main>`), LEARN_PAGES of them at most and of LEARN_CHARS characters each at most, and RESTYLED copies of each, whose article stands in other elements, among
menus, headers, sidebars, notices, adverts, forms and comments that hold texts of other pages. No page whose id's crc32 is divisible by 5 is learned from; they are for measuring.

Scale: one pass without a shuffle; each page is read by itself, whole, in time that grows with its length. What the driver fits on is bounded.

Defined cases: null and empty html gives an empty text; pages of any length are read whole; a page without any positive word gives an empty text; equal pages give equal texts; an empty table gives an empty result; without labelled
pages every word counts 1 and every tag -1; script, style and other raw text without its end tag, and comments without end, go on to the page's end; unclosed elements end where an outer one does; columns other than those
added are carried.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoquill.llm.common import crc_mod, hash_sample, prepare, read

LEARN_PAGES, LEARN_CHARS, RESTYLED = 200, 60_000, 3
#: Word scores are held between these: a word outside content takes less than one inside gives, so an advert doesn't part an article.
LEAST, MOST = -1.0, 3.0

RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "object", "select", "svg", "canvas", "video", "audio")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br meta link input".split())
HOLDERS = frozenset("article main section div nav aside header footer form ul ol dl table tr td th figure blockquote details dialog fieldset body menu center".split())
#: Elements whose name says nothing about what they hold.
NEUTRAL = frozenset("section div table tr td th body center".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+')*+>|[^>]*+(?:>|\Z))|<\?(?P<mark>\w*)[^>]*+(?:>|\Z)|<![^>]*+(?:>|\Z)|(?P<text>[^<]++|<)",
    re.S | re.I,
)
NAMED = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", re.I)
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    """Text between two block tags. words, linked: how many words, and how many of them in links; around: what it stands in; holder: the number of the innermost element."""

    tag: str
    around: frozenset
    holder: int
    at: int
    texts: list[str] = field(default_factory=list)
    words: int = 0
    linked: int = 0
    inside: bool = False
    closes: str = ""


def _names(rest: str) -> Iterator[str]:
    for value in NAMED.findall(rest):
        for piece in PIECE.findall(value):
            yield "c:" + piece.lower()
            if len(piece) > 5:
                yield "p:" + piece[:5].lower()


def parse(page: str) -> tuple[list[Block], list[tuple[int, str]]]:
    """Blocks with words in page order, and the tags, each with the number of blocks before it. A processing instruction `in` or `out` marks where labelled content begins and ends."""
    blocks: list[Block] = []
    tags: list[tuple[int, str]] = []
    stack: list[tuple[str, frozenset, int]] = [("", frozenset(), 0)]
    now, made, link, inside, at, tag = None, 0, False, False, 0, "div"
    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        text = m["text"]
        if text is not None:
            n = len(text.split())
            if now is None:
                if not n:
                    continue
                now = Block(tag, stack[-1][1], stack[-1][2], len(tags), inside=inside)
            now.texts.append(text)
            now.words += n
            now.linked += n * link
            continue
        if m["raw"]:
            close = re.compile(rf"</{m['raw']}\s*>?", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if m["mark"]:
            inside = m["mark"] == "in"
            continue
        name = (m["name"] or "").lower()
        if not name:
            continue
        ends = bool(m["end"])
        tags.append((len(blocks) + (now is not None), name))
        if name == "a":
            link = not ends
        if name == "br" and now is not None:
            now.texts.append(" ")
        if name in INLINE:
            continue
        if now is not None:
            blocks.append(now)
            now = None
        tag = "div" if ends else name
        if name in HOLDERS:
            if not ends:
                made += 1
                own = {*_names(m["rest"])}
                if name not in NEUTRAL:
                    own.add("t:" + name)
                stack.append((name, stack[-1][1] | own if own else stack[-1][1], made))
            else:
                link = False
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
    if now is not None:
        blocks.append(now)
    return [b for b in blocks if b.words], tags


def _own(b: Block) -> list[str]:
    """Features of the block itself."""
    share = b.linked / b.words
    return ["bias", f"b:{b.tag}", f"n:{min(b.words.bit_length(), 7)}", "l:" + ("0" if not b.linked else "1" if share < 0.3 else "2" if share < 0.7 else "3"), f"s:{b.texts[-1].rstrip()[-1:] in ('.', '!', '?', ':')}"]


@dataclass
class Weights:
    """words: log odds by feature; tags: the cost of a tag by its name, and, at "", of names not learned."""

    words: dict[str, float]
    tags: dict[str, float]

    def around(self, b: Block) -> float:
        return sum(self.words.get(f, 0.0) for f in b.around)

    def word(self, b: Block) -> float:
        if not self.words:
            return 1.0
        return min(MOST, max(LEAST, self.around(b) + sum(self.words.get(f, 0.0) for f in _own(b))))

    def tag(self, name: str) -> float:
        return -self.tags.get(name, self.tags[""])


def best_region(scores: Iterable[float]) -> tuple[int, int]:
    """First and last place, the latter not included, of the contiguous part of the greatest positive sum; (0, 0) if there is none. One pass; of equal sums the first."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best:
            best, at = total, (start, i + 1)
    return at


def extract(page: str | None, weights: Weights) -> str:
    """The page's main text, a line for each block."""
    blocks, tags = parse(page or "")
    if not blocks:
        return ""
    # The words of a block score alike, so the block counts as one step; the tags before it are another.
    scores, k = [], 0
    for b in blocks:
        cost = 0.0
        while k < len(tags) and k < b.at:
            cost += weights.tag(tags[k][1])
            k += 1
        scores += [cost, weights.word(b) * b.words]
    first, last = best_region(scores)
    first, last = first // 2, last // 2
    if first >= last:
        return ""
    first, last = _grown(blocks, first, -1, weights), _grown(blocks, last - 1, 1, weights) + 1
    lines = (" ".join("".join(map(entities.unescape, b.texts)).split()) for b in blocks[first:last] if not _foreign(b, weights))
    return "\n".join(x for x in lines if x)


def _foreign(b: Block, weights: Weights) -> bool:
    """Whether a block of the region stands in an element of negative weight, or is a link of a menu."""
    return weights.around(b) < 0 or (b.linked >= 0.7 * b.words and weights.word(b) < 0)


def _grown(blocks: list[Block], edge: int, step: int, weights: Weights) -> int:
    """The edge moved outward over blocks without links of the same element; foreign ones are passed by."""
    home, at = blocks[edge].holder, edge + step
    while home and 0 <= at < len(blocks):
        if blocks[at].holder == home and not blocks[at].linked and weights.around(blocks[at]) >= 0:
            edge = at
        elif not _foreign(blocks[at], weights):
            break
        at += step
    return edge


# Labelled pages

ARTICLE = re.compile(r"<(article|main)\b[^>]*>", re.I)
PARAGRAPH = re.compile(r"<p\b[^>]*>(.*?)(?=<p\b|</p|</article|</main|\Z)", re.S | re.I)
STRIP = re.compile(r"<[^>]*>")

#: What the copies' parts are called: fixed lists of usual names. A name with a dot is an element and its class, with # its id, with @ its role.
CONTENT = ("article", "main", "div.content", "div#content", "div.post", "div.entry-content", "div.article-body", "div.story", "section.text", "div", "td", "div@main", "div.page-body", "div#main", "section.body-copy")
PARTS = {
    "menu": ("nav", "ul.nav", "div.menu", "div#navbar", "div.navigation", "div.breadcrumbs", "ul.breadcrumb", "div#menu", "div@navigation", "menu", "div.toc", "div.topbar"),
    "header": ("header", "div.header", "div#header", "div.masthead", "div.site-header", "div.branding", "div@banner", "div.logo", "div.hero"),
    "footer": ("footer", "div.footer", "div#footer", "div.site-footer", "div.bottom", "div.copyright", "div.legal", "div@contentinfo", "div.colophon"),
    "sidebar": ("aside", "div.sidebar", "div#sidebar", "div.side", "div.widget", "div.rail", "div.related", "div.recommended", "section.popular", "div.trending", "div.tags", "div.archive", "div@complementary", "div.more-stories", "div.author-bio"),
    "notice": ("div.cookie-notice", "div.cookie-banner", "div.consent", "div.gdpr", "div.notice", "div.alert", "div.popup", "div.modal", "dialog", "div.overlay", "div.newsletter", "div.subscribe", "div@alert", "div.paywall", "div.disclaimer", "div.message"),
    "advert": ("div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsor", "div.sponsored", "div.promo", "div.promotion", "div.banner", "aside.ad", "div.commercial", "div#ad-slot", "div.adbox"),
    "form": ("form", "form.search", "form.login", "div.search", "div.signup", "fieldset", "form.contact", "div.poll", "form.newsletter"),
    "comments": ("div.comments", "section.comments", "div#comments", "ol.comment-list", "ul.replies", "div.discussion", "div.respond", "div#disqus", "div.feedback", "section.reader-comments", "div.thread", "div.reviews"),
    "share": ("div.share", "ul.social", "div.social-links", "div.follow", "div.toolbar", "div.pagination", "div.pager"),
}


def _element(name: str, inner: str) -> str:
    tag, kind, value = re.fullmatch(r"(\w+)(?:([.#@])(.*))?", name).groups()
    attr = {".": "class", "#": "id", "@": "role", None: ""}[kind]
    open_ = f'<{tag} {attr}="{value}">' if attr else f"<{tag}>"
    return f"<table><tr>{open_}{inner}</{tag}></tr></table>" if tag == "td" else f"{open_}{inner}</{tag}>"


def labelled(page: str) -> tuple[str, str, str] | None:
    """The page before, in and after its article; None where it marks none."""
    m = ARTICLE.search(page)
    end = page.lower().rfind(f"</{m[1].lower()}") if m else -1
    return (page[: m.end()], page[m.end() : end], page[end:]) if end > 0 and end >= m.end() else None


def restyled(article: str, texts: list[str], rng: random.Random) -> str:
    """A page whose content is the article, in another element and among other parts with the texts; marked."""
    few = lambda n: " ".join(rng.choice(texts).split()[:n]) or "more"
    links = lambda n: "".join(f'<li><a href="/x">{few(rng.randint(1, 4))}</a></li>' for _ in range(n))
    lines = lambda n: "".join(f"<p>{rng.choice(texts)}</p>" for _ in range(n))

    def part(kind: str) -> str:
        name = rng.choice(PARTS[kind])
        if kind == "menu" or kind == "share":
            inner = links(rng.randint(2, 9)) if name.startswith(("ul", "menu")) else f"<ul>{links(rng.randint(2, 9))}</ul>"
        elif kind == "header":
            inner = rng.choice((f"<h1>{few(4)}</h1><p>{few(9)}</p>", f'<a href="/">{few(3)}</a>', f"{few(5)}<ul>{links(4)}</ul>"))
        elif kind == "footer":
            inner = rng.choice((f"&copy; {few(9)}", f"<p>{few(20)}</p><ul>{links(4)}</ul>", lines(1)))
        elif kind == "sidebar":
            inner = f"<h3>{few(3)}</h3>" + rng.choice((f"<ul>{links(6)}</ul>", lines(rng.randint(1, 3)), f"<p>{few(25)}</p>"))
        elif kind == "form":
            inner = f'<label>{few(4)}</label><input name="q"><p>{few(12)}</p><button>{few(2)}</button>'
        elif kind == "comments":
            reply = lambda: f'<div class="comment"><b>{few(2)}</b><p>{rng.choice(texts)}</p></div>'
            inner = f"<h3>{few(2)}</h3>" + "".join(rng.choice((reply, lambda: f"<p>{rng.choice(texts)}</p>", lambda: f"<li>{rng.choice(texts)}</li>"))() for _ in range(rng.randint(1, 6)))
        else:
            inner = rng.choice((few(12), f"<p>{few(30)}</p>", lines(1), f'{few(8)} <a href="/y">{few(2)}</a>'))
        return _element(name, inner)

    outer = lambda kinds: "".join(part(k) for k in kinds if rng.random() < 0.5)
    body = article
    if rng.random() < 0.6:  # parts between paragraphs
        ends = [m.end() for m in re.finditer(r"</p>", article, re.I)][:-1]
        if ends:
            at = rng.choice(ends)
            body = article[:at] + f"<?out?>{part(rng.choice(('advert', 'advert', 'sidebar', 'form', 'notice', 'share')))}<?in?>" + article[at:]
    after = f"<?out?>{outer(('share', 'comments', 'sidebar', 'form'))}" if rng.random() < 0.5 else "<?out?>"
    main = _element(rng.choice(CONTENT), f"<?in?>{body}{after}")
    inner = outer(("sidebar", "advert")) + main + outer(("advert", "comments", "comments", "sidebar", "form"))
    if rng.random() < 0.5:
        inner = _element(rng.choice(("div", "div.wrapper", "div.container", "div#page", "section")), inner)
    return f"<html><body>{outer(('notice', 'header', 'menu', 'form', 'advert'))}{inner}{outer(('notice', 'sidebar', 'footer', 'footer'))}</body></html>"


def learn(pages: list[str], seed: int = 12) -> Weights:
    """Weights from the pages that mark their article and their restyled copies."""
    cut = [x for x in map(labelled, pages) if x]
    texts = [t for _, a, _ in cut for p in PARAGRAPH.findall(a) if (t := " ".join(STRIP.sub(" ", p).split()))][:5000]
    if not texts:
        return Weights({}, {"": 1.0})
    rng = random.Random(seed)
    marked = [f"{a}<?in?>{b}<?out?>{c}" for a, b, c in cut] + [restyled(b, texts, rng) for _, b, _ in cut for _ in range(RESTYLED)]
    names: dict[str, int] = {}
    rows, cols, label, weight = [], [], [], []
    inner, outer = Counter(), Counter()
    for page in marked:
        blocks, tags = parse(page)
        for b in blocks:
            cols += (own := [names.setdefault(f, len(names)) for f in (*b.around, *_own(b))])
            rows += [len(label)] * len(own)
            label.append(b.inside)
            weight.append(min(b.words, 20) ** 0.5)
        ends = np.array([b.at for b in blocks])
        for i, (_, name) in enumerate(tags):  # a tag belongs to the block after it
            k = int(np.searchsorted(ends, i, side="right")) if len(ends) else 0
            (inner if k < len(blocks) and blocks[k].inside else outer)[name] += 1
    words = _logistic(np.array(rows), np.array(cols), np.array(label, float), np.array(weight), len(names))
    cost = {n: float(np.clip(np.log((outer[n] + 1) / (inner[n] + 1)) + 1, 0.1, 5.0)) for n in {*inner, *outer}}
    return Weights({f: float(words[k]) for f, k in names.items()}, cost | {"": 1.0})


def _logistic(rows: np.ndarray, cols: np.ndarray, label: np.ndarray, weight: np.ndarray, n: int, rounds: int = 400, decay: float = 2.0) -> np.ndarray:
    """Logistic regression with a quadratic penalty over sparse 0/1 features, by full gradients with a step for each feature (Adam)."""
    w, m, v = np.zeros(n), np.zeros(n), np.zeros(n)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.bincount(rows, w[cols], len(label))))
        g = np.bincount(cols, (weight * (p - label))[rows], n) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def fit(pages: DataFrame, html: str = "html", key: str = "page_id") -> Weights:
    """Weights from a bounded sample of the pages outside the held-out fifth."""
    some = pages.where((crc_mod(key, 5) != 0) & (F.length(html) <= LEARN_CHARS) & F.col(html).rlike("(?i)<(article|main)[ >]")).select(key, html)
    return learn([r[0] for r in hash_sample(some, LEARN_PAGES, key, html).select(html).collect()])


def with_text(pages: DataFrame, weights: Weights, html: str = "html") -> DataFrame:
    """Adds text, the page's main text, and n_chars."""

    @F.pandas_udf("string")
    def main_text(column: pd.Series) -> pd.Series:
        return column.map(lambda page: extract(page, weights))

    return pages.withColumn("text", main_text(F.coalesce(F.col(html), F.lit("")))).withColumn("n_chars", F.length("text").cast("long"))


def op12_html_extract(spark, sf_dir: str) -> DataFrame:
    pages = read(prepare(spark), sf_dir, "pages")
    return with_text(pages.select("page_id", "url", "html"), fit(pages)).select("page_id", "url", "text", "n_chars")

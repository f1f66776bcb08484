"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes the sequence of its leaf blocks (runs of text between the borders of block elements). Features of a
block are its ancestors' tags and class words, shapes of its text, and whether the page marks its article elsewhere; a
model of two labels, trained on labelled pages that are generated here, is decoded by Viterbi, and the blocks labelled
as main text are joined. A page is read once from left to right, however broken its markup is.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose borders end a block. Fixed values.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html iframe label legend li main menu nav ol option p pre section select summary table tbody "
    "td tfoot th thead tr ul".split()
)
#: Elements whose content is no text of the page; of these, those that a page may leave open are ignored without an end. Fixed values.
UNSEEN = frozenset("title script style noscript template svg math textarea select object canvas audio video iframe".split())
#: Elements whose content is no markup. Fixed values.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
#: Elements that the start of a block outside them ends, and the blocks that they may hold. Fixed values.
LEFT_OPEN, INSIDE = frozenset(("svg", "math", "select")), frozenset(("option", "hr"))
#: Elements without an end. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag ends, if it is the innermost open block. Fixed values.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Word stems in class, id and role attributes, by what they say. Fixed values.
STEMS = {
    "ad": ("ad", "ads", "advert", "sponsor", "promo", "banner", "outbrain", "taboola", "commercial"),
    "menu": ("nav", "menu", "breadcrumb", "pagination", "pager", "toolbar", "tabs", "navigation", "skip"),
    "frame": ("header", "footer", "masthead", "copyright", "contentinfo", "topbar", "colophon", "legal"),
    "side": ("sidebar", "aside", "related", "recommend", "widget", "rail", "complementary", "popular", "trending", "more"),
    "notice": ("notice", "cookie", "consent", "gdpr", "popup", "modal", "alert", "disclaimer", "overlay", "dialog", "warning"),
    "form": ("form", "search", "login", "signup", "subscribe", "newsletter", "register"),
    "talk": ("comment", "comments", "reply", "replies", "discussion", "disqus", "respond", "reader"),
    "share": ("share", "social", "follow", "tags", "meta", "byline"),
    "main": ("article", "content", "main", "post", "entry", "story", "body", "text"),
}
STEM_OF = {word: kind for kind, words in STEMS.items() for word in words}


#: Elements deeper than this count as text of the one that holds them, as in browsers.
DEEPEST = 512
#: What begins at a <: the name of a tag, or a comment, a declaration or an instruction.
OPENER = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|[!?/])")
#: An attribute and its value, if it has one.
ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|(?!["'])([^\s>]+)))?""")
BETWEEN = re.compile(r"[\s/]*")


class LeafBlocks:
    """Collects (ancestors, text, characters inside links) of each leaf block; ancestors are (tag, class kinds) pairs."""

    def __init__(self):
        self.open: list[tuple[str, frozenset]] = []
        self.blocks: list[tuple[tuple, str, int]] = []
        self.text: list[str] = []
        self.linked = self.unseen = 0
        self.held: Counter[str] = Counter()  # how many elements of each tag are open

    def read(self, html: str) -> None:
        """All tags and texts of a page. A tag or comment that the page's end cuts is dropped."""
        at, ends = 0, Counter(x.lower() for x in re.findall("</([a-zA-Z]+)", html))
        while at < len(html):
            start = html.find("<", at)
            self.data(html[at:] if start < 0 else html[at:start])
            if start < 0:
                break
            found = OPENER.match(html, start)
            if not found:
                if start + 1 < len(html):
                    self.data("<")
                at = start + 1
                continue
            if not found[2]:
                comment = found[0] == "<!--"
                closed = re.compile("--!?>").search(html, start + 2) if comment else re.compile(">").search(html, start)
                if not closed:
                    break
                at = closed.end()
                continue
            tag, at, words = found[2].lower(), found.end(), []
            while (at := BETWEEN.match(html, at).end()) < len(html) and html[at] != ">":
                attribute = ATTRIBUTE.match(html, at)
                name, value = attribute[1].lower(), attribute[2] or attribute[3] or attribute[4]
                if value and name in ("class", "id", "role"):
                    words.append(unescape(value).lower())
                at = attribute.end()
            if at >= len(html):
                break
            closes_itself, at = html[at - 1] == "/", at + 1
            if found[1]:
                ends[tag] -= 1
                self.end(tag)
                continue
            if tag in UNSEEN and not ends[tag]:
                if tag in ("script", "style"):
                    break
                continue
            self.start(tag, " ".join(words))
            if closes_itself and (tag in LEFT_OPEN or self.held["svg"] or self.held["math"]):
                self.end(tag)
            elif tag in RAW and ends[tag]:
                closed = raw_end(tag).search(html, at)
                at = closed.start() if closed else len(html)
        self.end_block()

    def data(self, text: str) -> None:
        if text and not self.unseen:
            text = unescape(text)
            self.text.append(text)
            if self.held["a"]:
                self.linked += len(text)

    def end_block(self) -> None:
        if text := " ".join("".join(self.text).split()):
            self.blocks.append((tuple(self.open), text, min(self.linked, len(text))))
        self.text, self.linked = [], 0

    def cut(self, at: int) -> None:
        """Closes all elements from place `at` on."""
        gone = [tag for tag, _ in self.open[at:]]
        if any(tag in BLOCKS for tag in gone):
            self.end_block()
        self.unseen -= sum(tag in UNSEEN for tag in gone)
        self.held.subtract(gone)
        del self.open[at:]

    def innermost(self, wanted) -> int:
        """The place of the innermost open element that is among `wanted`; -1 without one."""
        if not any(self.held[x] for x in wanted):
            return -1
        return next(i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] in wanted)

    def start(self, tag: str, words: str) -> None:
        if tag == "br":
            self.text.append(" ")
        if tag in BLOCKS:
            self.end_block()
            if tag not in INSIDE and (at := self.innermost(LEFT_OPEN)) >= 0:
                self.cut(at)
            if tag not in ("html", "head") and (at := self.innermost(("head",))) >= 0:
                self.cut(at)
            if tag not in ("button", "label", "option", "select") and (at := self.innermost(("p",))) >= 0 and not any(x in BLOCKS for x, _ in self.open[at + 1 :]):
                self.cut(at)
            if tag in ENDS:
                inner = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] in BLOCKS), -1)
                if inner >= 0 and self.open[inner][0] in ENDS[tag]:
                    self.cut(inner)
        if tag in VOID or len(self.open) >= DEEPEST:
            return
        kinds = frozenset(STEM_OF[w] for w in re.findall("[a-z]+", words) if w in STEM_OF) if words else frozenset()
        self.open.append((tag, kinds))
        self.held[tag] += 1
        self.unseen += tag in UNSEEN

    def end(self, tag: str) -> None:
        if (at := self.innermost((tag,))) >= 0:
            self.cut(at)
        elif tag in BLOCKS:
            self.end_block()


@cache
def raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>]|$)", re.I)


def leaf_blocks(html: str | None) -> list[tuple[tuple, str, int]]:
    """The leaf blocks of a page in page order; none for null and empty pages."""
    page = LeafBlocks()
    page.read(html or "")
    return page.blocks


def page_features(blocks: list[tuple[tuple, str, int]]) -> list[list[str]]:
    """Names of what holds for each block of a page."""
    inside = [({tag for tag, _ in ancestors}, frozenset().union(*(kinds for _, kinds in ancestors))) for ancestors, _, _ in blocks]
    has_article, has_main = any(tags & {"article", "main"} for tags, _ in inside), any("main" in kinds for _, kinds in inside)
    return [features(block, tags, kinds, has_article, has_main) for block, (tags, kinds) in zip(blocks, inside, strict=True)]


def features(block: tuple[tuple, str, int], tags: set[str], kinds: frozenset, has_article: bool, has_main: bool) -> list[str]:
    ancestors, text, linked = block
    length = f"length {min(6, len(text).bit_length() // 2)}"
    out = ["any", length, f"linked {round(4 * linked / len(text))}", f"sentence {text[-1] in '.!?:;。'}"]
    out += [f"in {tag}" for tag in tags if tag in BLOCKS]
    out += [f"kind {kind}" for kind in kinds]
    leaf = next((tag for tag, _ in reversed(ancestors) if tag in BLOCKS), "none")
    out.append(f"leaf {leaf}")
    if has_article:
        out.append(f"article here {bool(tags & {'article', 'main'})}")
    elif has_main:
        out.append(f"main here {'main' in kinds}")
    else:
        out += [f"unmarked {length}", f"unmarked leaf {leaf}"]
    return out


class ChainCRF:
    """A linear-chain CRF of the labels 0 (other) and 1 (main text)."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.weights, self.steps, self.starts = np.zeros((0, 2)), np.zeros((2, 2)), np.zeros(2)

    def scores(self, page: list[list[str]]) -> np.ndarray:
        return np.array([self.weights[[i for x in names if (i := self.index.get(x)) is not None]].sum(0) for names in page]).reshape(-1, 2)

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], rounds: int = 12, rate: float = 0.3, decay: float = 1e-4, seed: int = 3) -> ChainCRF:
        """Maximum likelihood by Adagrad over (features of each block, labels) pages, with exact marginals."""
        for page, _ in pages:
            for names in page:
                for name in names:
                    self.index.setdefault(name, len(self.index))
        self.weights = np.zeros((len(self.index), 2))
        squares = [np.full_like(x, 1e-6) for x in (self.weights, self.steps, self.starts)]
        rng = random.Random(seed)
        for _ in range(rounds):
            for page, labels in rng.sample(pages, len(pages)):
                gradient = [np.zeros_like(x) for x in (self.weights, self.steps, self.starts)]
                one, two = self.marginals(self.scores(page))
                gold = np.eye(2)[labels]
                for names, slope in zip(page, gold - one, strict=True):
                    gradient[0][[self.index[x] for x in names]] += slope
                gradient[1] += np.einsum("ta,tb->ab", gold[:-1], gold[1:]) - two.sum(0)
                gradient[2] += gold[0] - one[0]
                for value, g, square in zip((self.weights, self.steps, self.starts), gradient, squares, strict=True):
                    g -= decay * value
                    square += g * g
                    value += rate * g / np.sqrt(square)
        return self

    def marginals(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each block's label, and of each pair of neighbours' labels."""
        n = len(scores)
        ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
        ahead[0] = self.starts + scores[0]
        for t in range(1, n):
            ahead[t] = scores[t] + np.logaddexp.reduce(ahead[t - 1][:, None] + self.steps, axis=0)
        for t in range(n - 2, -1, -1):
            back[t] = np.logaddexp.reduce(self.steps + scores[t + 1] + back[t + 1], axis=1)
        total = np.logaddexp.reduce(ahead[-1])
        two = ahead[:-1, :, None] + self.steps + (scores[1:] + back[1:])[:, None, :] - total
        return np.exp(ahead + back - total), np.exp(two)

    def decode(self, scores: np.ndarray) -> list[int]:
        """The most probable labels, by Viterbi."""
        if not len(scores):
            return []
        (s00, s01), (s10, s11) = self.steps.tolist()
        rows = scores.tolist()
        best0, best1 = self.starts[0] + rows[0][0], self.starts[1] + rows[0][1]
        came = []
        for a, b in rows[1:]:
            from0, from1 = (best0 + s00 < best1 + s10), (best0 + s01 < best1 + s11)
            came.append((from0, from1))
            best0, best1 = max(best0 + s00, best1 + s10) + a, max(best0 + s01, best1 + s11) + b
        labels = [int(best1 > best0)]
        for step in reversed(came):
            labels.append(int(step[labels[-1]]))
        return labels[::-1]


def labelled_pages(count: int = 400, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Generated pages of many layouts, with and without a marked article, each with the labels of its leaf blocks."""
    rng = random.Random(seed)

    def words(lo: int, hi: int, end: str = ".") -> str:
        return " ".join("".join(rng.choice("aeioumnrstl") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(lo, hi))).capitalize() + end

    pages = []
    for _ in range(count):
        parts: list[tuple[str, list[int]]] = []

        def put(html: str, *labels: int, to: list = parts) -> None:
            to.append((html, list(labels)))

        def junk(to: list, inside: bool) -> None:
            kind = rng.choice(["ad", "side", "notice", "form", "share", "talk", "menu"])
            name = rng.choice(STEMS[kind])
            tag = {"side": "aside", "form": "form", "menu": "nav"}.get(kind, "div") if rng.random() < 0.6 else rng.choice(["div", "section"])
            attribute = f' class="{name}"' if tag == "div" or rng.random() < 0.7 else ""
            if not attribute and tag == "section":
                attribute = f' id="{name}"'
            n = rng.randint(1, 4)
            inner = {"menu": "".join(f'<li><a href="/x">{words(1, 2, "")}</a></li>' for _ in range(n)), "form": "".join(f"<label>{words(1, 5, '')}</label>" for _ in range(n))}
            body = inner.get(kind) or "".join(f"<p>{words(1, 40)}</p>" for _ in range(n))
            if kind == "ad" and rng.random() < 0.5:
                n, body = 1, words(2, 12)
            put(f"<{tag}{attribute}>{body}</{tag}>", *[0] * n, to=to)

        if rng.random() < 0.6:
            put(f"<header><div class='logo'>{words(1, 4, '')}</div></header>", 0)
        if rng.random() < 0.8:
            n = rng.randint(1, 8)
            put("<nav><ul>" + "".join(f'<li><a href="/a">{words(1, 2, "")}</a></li>' for _ in range(n)) + "</ul></nav>", *[0] * n)
        for _ in range(rng.randint(0, 2)):
            junk(parts, False)
        main: list[tuple[str, list[int]]] = []
        if rng.random() < 0.85:
            head = f"<h1>{words(1, 12, rng.choice(['', '.']))}</h1>"
            put(f"<header>{head}</header>" if rng.random() < 0.15 else head, 1, to=main)
        for _ in range(rng.randint(0, 14)):
            kind = rng.random()
            if kind < 0.72:
                text = words(1, 60, rng.choice([".", ".", "", "!!", "$$$"]))
                put(rng.choice([f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>"]), 1, to=main)
            elif kind < 0.78:
                put(f"<h2>{words(1, 6, '')}</h2>", 1, to=main)
            elif kind < 0.84:
                n = rng.randint(1, 4)
                put("<ul>" + "".join(f"<li>{words(2, 20)}</li>" for _ in range(n)) + "</ul>", *[1] * n, to=main)
            elif kind < 0.88:
                put(f"<blockquote>{words(3, 30)}</blockquote>", 1, to=main)
            elif kind < 0.91:
                put(f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>", 1, 1, to=main)
            elif kind < 0.93:
                put(f'<p>{words(1, 6)} <a href="/l">{words(1, 8)}</a></p>', 1, to=main)
            elif kind < 0.95:
                put(f"<figure><figcaption>{words(2, 12)}</figcaption></figure>", 1, to=main)
            else:
                junk(main, True)
        name = rng.choice(STEMS["main"])
        marked = [("<article>", "</article>")] * 4 + [("<main>", "</main>"), (f'<div class="{name}">', "</div>"), (f'<div id="{name}">', "</div>"), ("<main><article>", "</article></main>")]
        bare = [("", ""), ("<div>", "</div>"), ("<div><div>", "</div></div>"), (f'<div class="{words(1, 1, "").lower()}">', "</div>"), ("<table><tr><td>", "</td></tr></table>")]
        before, after = rng.choice(marked if rng.random() < 0.65 else bare)
        put(before + "".join(h for h, _ in main) + after, *[x for _, own in main for x in own])
        for _ in range(rng.randint(0, 2)):
            junk(parts, False)
        if rng.random() < 0.25:
            n = rng.randint(1, 5)
            put('<section class="comments">' + "".join(f"<p>{words(3, 40)}</p>" for _ in range(n)) + "</section>", *[0] * n)
        if rng.random() < 0.85:
            put(f"<footer>&copy; {words(2, 14)}</footer>", 0)
        body = "".join(h for h, _ in parts)
        if rng.random() < 0.2:
            body = f'<div class="{rng.choice(["wrap", "page", "content"])}">{body}</div>'
        head, tail = rng.choice([("<html><head><title>x</title></head><body>", "</body></html>")] * 3 + [("<html><head><title>x</title>", ""), ("", "")])
        pages.append((head + body + tail, [x for _, own in parts for x in own]))
    return pages


@cache
def trained() -> ChainCRF:
    """The model of the labelled pages; their number is a bound on what training takes."""
    return fitted(labelled_pages())


def fitted(labelled: list[tuple[str, list[int]]]) -> ChainCRF:
    """The model of labelled pages (html and a label for each leaf block); a page whose blocks and labels differ in number is an error."""
    pages = []
    for place, (html, labels) in enumerate(labelled):
        blocks = leaf_blocks(html)
        if len(blocks) != len(labels):
            raise ValueError(f"labelled page {place} has {len(blocks)} blocks and {len(labels)} labels")
        if blocks:
            pages.append((page_features(blocks), labels))
    return ChainCRF().fit(pages)


def main_text(html: str | None, model: ChainCRF) -> str:
    blocks = leaf_blocks(html)
    labels = model.decode(model.scores(page_features(blocks)))
    return "\n".join(text for (_, text, _), label in zip(blocks, labels, strict=True) if label)


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text.

    text joins the blocks of main text by one line feed; it is empty if there is none, as for null and empty pages.
    Repeated rows stay repeated, null ids and urls stay null, other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trained())  # some hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                text = [main_text(x, shared.value) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string())], ["page_id", "url", "text"])

    plain = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return plain.mapInArrow(run, "page_id long, url string, text string")

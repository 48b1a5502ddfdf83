"""HTML extraction by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags, each with its open ancestors. A block's features
are its ancestors' tags and class or id words and properties of its text. The field has two labels (main text or not),
weights per feature and label and per label pair; it is trained by gradient steps on the exact conditional likelihood
(forward-backward) and decoded by Viterbi.

Labelled pages: LABELLED below (layouts written for this purpose, main blocks marked), and at most `max_pages` pages of
the table itself that mark their article (article, main or role=main); of those a copy without these marks is learned
too, so that pages without them are decoded from the rest. The sample is for fitting only; every page is decoded, whole.

Parsing is linear in a page's length, whatever is left open. Defined results: a null or empty html gives an empty text;
pages of any length are taken whole; unclosed and stray tags are tolerated, and text from a tag that never ends is text; text outside any tag is
a block of its own; equal pages give equal texts; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PAGES = 150
STEPS = 80

# How HTML's elements are laid out.
BLOCK_TAGS = frozenset("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style template svg iframe title head textarea audio video".split())
ENDS_P = BLOCK_TAGS - {"br", "label", "button", "option", "select"}
SAME_CLOSES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

MARKS = {"article", "main"}
# Class and id words of the parts that are not main text, by part.
PARTS = {
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promoted banner",
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs toc pagination pager tabs",
    "side": "sidebar side aside related recommended widget trending popular share social",
    "notice": "cookie cookies consent notice gdpr popup modal newsletter subscribe signup alert paywall",
    "comment": "comment comments reply replies disqus discussion respond",
    "foot": "footer foot copyright legal colophon credits",
    "head": "header masthead topbar logo site",
    "form": "form search login contact",
    "text": "content article post entry story body main text",
}
_PART = {w: part for part, words in PARTS.items() for w in words.split()}


KNOWN_TAGS = BLOCK_TAGS | VOID_TAGS | frozenset("a abbr b bdi bdo cite code datalist optgroup data del dfn em font i ins kbd mark math noscript object q s samp small span strong sub sup time tt u var".split())


_NAMED = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
_WORDS = re.compile(r"[a-z]+")
_NAME = re.compile(r"/?[A-Za-z][^\s/>]*")
_GAP, _ATTRIBUTE, _EQUALS, _BARE = (re.compile(p) for p in (r"[\s/]*", r"[^\s/>][^\s/>=]*", r"\s*=\s*", r"[^\s>]*"))
#: What a form's controls say is never part of a text.
CONTROLS = frozenset("button select option optgroup datalist".split())


@dataclass(slots=True)
class Place:
    """An open element with what its ancestors add up to, so that a block knows them all by one reference."""

    tag: str = ""
    tags: frozenset = frozenset()
    words: frozenset = frozenset()  # class, id and role words of known meaning
    near: str = "none"  # nearest block tag
    near_plain: str = "none"  # the same without the tags that mark an article
    marked: bool = False
    off: bool = False

    def inside(self, tag: str, named: set[str]) -> Place:
        here = tag if tag in BLOCK_TAGS and tag not in ("body", "html") else None
        known = {w for w in named if w in _PART}
        kind = tag if tag in KNOWN_TAGS else "other"
        return Place(
            tag, self.tags if kind in self.tags else self.tags | {kind}, self.words if known <= self.words else self.words | known, here or self.near, here if here and here not in MARKS else self.near_plain,
            self.marked or tag in MARKS or "main" in named and tag == "div", self.off or tag in ("nav", "footer", "aside", "form") or any(_PART[w] != "text" for w in known),
        )


class _Open:
    """The open elements. Where each tag stands is kept, so finding one takes no search."""

    def __init__(self):
        self.places, self.at = [Place()], defaultdict(list)

    def push(self, tag: str, named: set[str]) -> None:
        self.at[tag].append(len(self.places))
        self.places.append(self.places[-1].inside(tag, named))

    def last(self, tag: str) -> int:
        return self.at[tag][-1] if self.at.get(tag) else 0

    def cut(self, at: int) -> None:
        """Closes the element at this place and all in it."""
        for place in self.places[at:]:
            self.at[place.tag].pop()
        del self.places[at:]


class _Scanner:
    """Finds ends in a page from left to right; what isn't found once is not looked for again, so the work is linear."""

    def __init__(self, page: str):
        self.page, self.low, self.gone = page, None, set()

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """Place of the > that ends a tag. A quote counts only where an attribute's value begins with it; then the value may
        hold a >. -1: none."""
        page = self.page
        while True:
            at = _GAP.match(page, at).end()
            if at >= len(page):
                return -1
            if page[at] == ">":
                return at
            at = _ATTRIBUTE.match(page, at).end()
            if not (equals := _EQUALS.match(page, at)):
                continue
            at = equals.end()
            if page[at : at + 1] in ('"', "'"):
                close = self.find(page[at], at + 1)
                at = close + 1 if close >= 0 else at + 1
            else:
                at = _BARE.match(page, at).end()

    def raw_end(self, tag: str, at: int) -> int:
        """Where the text after the element's closing tag begins; -1: it has none."""
        if self.low is None:
            self.low = "".join(c.lower() if "A" <= c <= "Z" else c for c in self.page) if not self.page.isascii() else self.page.lower()
        if tag in self.gone:
            return -1
        found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>").search(self.low, at)
        if not found:
            self.gone.add(tag)
        return found.end() if found else -1


def blocks(page: str | None) -> list[tuple[str, Place, float]]:
    """(text, place, share of linked text) of each leaf block, in page order. Linear in the page's length."""
    page, out, opened = page or "", [], _Open()
    scanner = _Scanner(page)
    text: list[str] = []
    linked = at = 0

    def close():
        nonlocal linked
        whole = " ".join(html.unescape("".join(text)).split())
        if whole and not opened.places[-1].tags & CONTROLS:
            out.append((whole, opened.places[-1], min(1.0, linked / max(1, sum(map(len, text))))))
        text.clear()
        linked = 0

    def add(piece):
        nonlocal linked
        if piece:
            text.append(piece)
            if opened.at.get("a"):
                linked += len(piece)

    while (begin := page.find("<", at)) >= 0:
        add(page[at:begin])
        if page.startswith("<!--", begin):
            end = scanner.find("-->", begin + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        name = _NAME.match(page, begin + 1)
        end = scanner.tag_end(name.end()) if name else scanner.find(">", begin) if page[begin + 1 : begin + 2] in ("!", "?") else -1
        if end < 0:
            add("<")
            at = begin + 1
            if name:  # no tag ends behind here
                break
            continue
        at = end + 1
        if not name:
            continue
        tag, rest = name[0].lower(), page[name.end() : end]
        if tag[0] == "/":
            tag = tag[1:]
            if tag in BLOCK_TAGS:
                close()
            if here := opened.last(tag):
                opened.cut(here)
            continue
        if tag in RAW_TAGS and not rest.rstrip().endswith("/"):
            after = scanner.raw_end(tag, at)
            at = after if after >= 0 else len(page) if tag != "head" else at
            continue
        if tag in BLOCK_TAGS:
            close()
            if tag in ENDS_P and (here := opened.last("p")):
                opened.cut(here)
            if tag in SAME_CLOSES and (here := opened.last(tag)) > max(map(opened.last, SAME_CLOSES[tag])):
                opened.cut(here)
        if tag not in VOID_TAGS:
            opened.push(tag, {w for v in _NAMED.findall(rest) for w in _WORDS.findall(v.lower())} if rest else set())
    add(page[at:])
    close()
    return out


def features(page_blocks: list, masked: bool = False) -> list[list[str]]:
    """Feature names of each block. masked: without the tags and roles that mark an article."""
    out, n = [], len(page_blocks)
    for i, (text, place, linked) in enumerate(page_blocks):
        words = text.count(" ") + 1
        tags = place.tags - MARKS if masked else place.tags
        parts = {_PART[w] for w in place.words if not (masked and w in MARKS)}
        near = place.near_plain if masked else place.near
        f = ["bias", f"in={near}", f"words={min(7, words.bit_length())}", f"linked={int(linked * 4)}", f"at={4 * i // max(1, n)}"]
        f += [f"under={t}" for t in sorted(tags)]
        f += [f"part={p}" for p in sorted(parts)]
        end = text[-1]
        f.append("ends=stop" if end in ".!?…\"”»" else "ends=letter" if end.isalnum() else "ends=other")
        marks = sum(map(text.count, ".,;:"))
        f.append(f"stops={min(4, marks.bit_length())}")
        if "©" in text or text.startswith("(c)"):
            f.append("copyright")
        if near in ("h1", "h2", "h3"):
            f.append("heading")
        if not (tags - {"html", "body", "div", "section", "p", "b", "span"}) and not parts:
            f.append("plain-place")
        if not {"nav", "footer", "aside", "header", "form"} & tags and not parts - {"text"}:
            f.append("free-place")
        out.append(f)
    return out


P, H = "<p>{}</p>", "<h1>{}</h1>"
_LONG = ("The river rose again during the night, and by morning the lower fields were under water.", "Nobody had expected it, because the weather had been dry for weeks; still, the bridge held.", "She wrote, however, that the work would go on as planned until the end of the year.", "Later reports, printed in two papers, agreed on most points.")
_SHORT = ("It rained.", "So it was.", "Quiet hours followed.")
# Labelled layouts. Text between [[ and ]] is main text, all other text is not.
LABELLED = (
    "<body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><article><h1>[[{t}]]</h1><p>[[{a}]]</p><p>[[{s}]]</p><p>[[{b}]]</p></article><footer>&copy; site. {s}</footer></body>",
    "<div id=menu><a>Home</a> | <a>Contact</a></div><div class=ad>{b}</div><div class=content><h2>[[{t}]]</h2><p>[[{a}]]<p>[[{c}]]<p>[[{s}]]</div><div class=footer>All rights reserved. {t}</div>",
    "<header><div class=logo>{t}</div><form><label>Search</label><button>Go</button></form></header><main><p>[[{a}]]</p><ul><li>[[{s}]]</li><li>[[{c}]]</li></ul><blockquote>[[{b}]]</blockquote></main><aside><h3>Related</h3><p>{c}</p><a>More</a></aside>",
    "<div class=cookie-notice><p>We use cookies to improve this site. {s}</p><button>Accept</button></div><div><h1>[[{t}]]</h1><div>[[{a}]]</div><div>[[{b}]]</div></div><div class=comments><h3>Comments</h3><p>{a}</p><p>{s}</p></div>",
    "<article><header><h1>[[{t}]]</h1></header><p>[[{a}]]</p><div class=advert><p>{c}</p></div><p>[[{s}]]</p><pre>[[{c}]]</pre><section class=comments><p>{b}</p></section></article><footer><p>{s}</p></footer>",
    "<table><tr><td class=nav><a>One</a></td><td><p>[[{a}]]</p><p>[[{b}]]</p><p>[[{s}]]</p></td><td class=sidebar><p>{s}</p><a>Two</a></td></tr></table><div id=footer>{t} 2020</div>",
    "<div class=newsletter><form><p>{s}</p><input></form></div><section><h2>[[{t}]]</h2><p>[[{c}]]</p><table><tr><td>[[{s}]]</td><td>[[{t}]]</td></tr></table></section><nav><a>Next</a></nav>",
    "<div class=related><h4>{t}</h4><p>{a}</p></div><p>[[{a}]]</p><p>[[{s}]]</p><p>[[{b}]]</p><div class=share><a>Share</a></div><div class=banner>{b}</div>",
    "<body><div class=sponsored><p>{a}</p></div><div class=post><h1>[[{t}]]</h1><p>[[{b}]]</p><p>[[{c}]]</p></div><div id=comments><div class=comment><p>{c}</p></div><div class=comment><p>{a}</p></div></div></body>",
    "<nav>{t}</nav><article><p>[[{s}]]</p><p>[[{s}]]</p></article><aside>{a}</aside><form>{s}</form><footer>{b}</footer>",
)


def labelled_pages() -> list[tuple[list, np.ndarray]]:
    out = []
    for turn, layout in enumerate(layout for layout in LABELLED for _ in range(4)):
        page = layout.format(t=("River levels", "A plan", "Notes on the year")[turn % 3], s=_SHORT[turn % 3], a=_LONG[turn % 4], b=_LONG[(turn + 1) % 4], c=_LONG[(turn + 2) % 4])
        found = blocks(page)
        labels = np.array([int(t.startswith("[[")) for t, _, _ in found])
        out.append(([(t.replace("[[", "").replace("]]", ""), above, linked) for t, above, linked in found], labels))
    return out


def self_labelled(page: str | None) -> tuple[list, np.ndarray] | None:
    """Blocks and labels of a page that marks its article, else None."""
    found = blocks(page)
    if not any(place.marked for _, place, _ in found):
        return None
    return found, np.array([int(place.marked and not place.off) for _, place, _ in found])


def train(pages: list[tuple[list[list[str]], np.ndarray]], steps: int = STEPS, ridge: float = 1e-4) -> dict:
    """Weights by gradient ascent (Adam) on the conditional log-likelihood, all pages side by side."""
    names: dict[str, int] = {}
    pages = [(f, y) for f, y in pages if len(y)]
    rows = [[names.setdefault(x, len(names)) for x in block] for f, _ in pages for block in f]
    sizes = np.array([len(y) for _, y in pages])
    flat = np.array([i for r in rows for i in r])
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    label = np.concatenate([y for _, y in pages])
    longest, starts = sizes.max(), np.cumsum(sizes) - sizes
    slot = np.repeat(starts, sizes)
    page_of, nth = np.repeat(np.arange(len(pages)), sizes), np.arange(len(rows)) - slot
    w, trans = np.zeros((len(names), 2)), np.zeros((2, 2))
    pair_true = np.zeros((2, 2))
    inner = nth > 0
    np.add.at(pair_true, (label[np.flatnonzero(inner) - 1], label[inner]), 1)
    m1, m2, t1, t2 = np.zeros_like(w), np.zeros_like(w), np.zeros((2, 2)), np.zeros((2, 2))
    for step in range(1, steps + 1):
        scores = np.zeros((len(rows), 2))
        np.add.at(scores, of, w[flat])
        grid = np.full((len(pages), longest, 2), -1e9)
        grid[page_of, nth] = scores
        alpha, beta = np.zeros_like(grid), np.zeros_like(grid)
        alpha[:, 0] = grid[:, 0]
        for i in range(1, longest):
            alpha[:, i] = np.where((sizes > i)[:, None], np.logaddexp.reduce(alpha[:, i - 1, :, None] + trans, axis=1) + grid[:, i], -1e9)
        for i in range(longest - 2, -1, -1):
            ahead = np.logaddexp.reduce(trans + (grid[:, i + 1] + beta[:, i + 1])[:, None, :], axis=2)
            beta[:, i] = np.where((sizes > i + 1)[:, None], ahead, 0)
        total = np.logaddexp.reduce(alpha[np.arange(len(pages)), sizes - 1], axis=1)
        chance = np.exp(alpha + beta - total[:, None, None])[page_of, nth]
        pairs = alpha[:, :-1, :, None] + trans + (grid[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]
        pair_chance = np.where((np.arange(1, longest)[None] < sizes[:, None])[:, :, None, None], np.exp(np.minimum(pairs, 0)), 0).sum((0, 1))
        grad = np.zeros_like(w)
        np.add.at(grad, flat, (np.eye(2)[label] - chance)[of])
        grad, tgrad = grad / len(rows) - ridge * w, (pair_true - pair_chance) / len(rows) - ridge * trans
        for x, g, a, b in ((w, grad, m1, m2), (trans, tgrad, t1, t2)):
            a[:] = 0.9 * a + 0.1 * g
            b[:] = 0.99 * b + 0.01 * g * g
            x += 0.15 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return {"gain": {n: float(w[i, 1] - w[i, 0]) for n, i in names.items()}, "trans": trans.tolist()}


def viterbi(rows: list[list[str]], model: dict) -> list[bool]:
    """The likeliest labels of a page's blocks."""
    gain, ((t00, t01), (t10, t11)) = model["gain"], model["trans"]
    back, zero, one = [], 0.0, 0.0
    for i, row in enumerate(rows):
        g = sum(gain.get(f, 0.0) for f in row)
        if not i:
            zero, one = 0.0, g
            continue
        a, b = zero + t00, one + t10
        c, d = zero + t01, one + t11
        back.append((b > a, d >= c))
        zero, one = max(a, b), max(c, d) + g
    if not rows:
        return []
    out = [one >= zero]
    for choice in reversed(back):
        out.append(choice[out[-1]])
    return out[::-1]


def main_text(page: str | None, model: dict) -> str:
    found = blocks(page)
    return " ".join(t for (t, _, _), keep in zip(found, viterbi(features(found), model), strict=True) if keep)


def fit(pages: DataFrame, html_col: str = "html", max_pages: int = MAX_PAGES) -> dict:
    """A model from LABELLED and at most about max_pages self-labelled pages, which a hash of the html picks."""
    total = pages.count()
    share = int((1 << 30) * min(1.0, max_pages / max(1, total)))
    picked = pages.filter(F.pmod(F.xxhash64(F.col(html_col)), F.lit(1 << 30)) < share).select(html_col).distinct()
    own = [x for (page,) in picked.orderBy(F.xxhash64(html_col)).limit(2 * max_pages).collect() if (x := self_labelled(page))]
    known = labelled_pages()
    return train([(features(f, masked), y) for f, y in own for masked in (False, True)] + [(features(f), y) for f, y in known for _ in range(1 + len(own) // 40)])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: dict | None = None) -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    model = model or fit(pages, html_col)

    def run(batches):
        for batch in batches:
            texts = [main_text(page, model) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["_id", "_url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    out = rows.mapInArrow(run, f"_id {kinds[0]}, _url {kinds[1]}, text string, n_chars bigint")
    return out.withColumnsRenamed({"_id": id_col, "_url": url_col})

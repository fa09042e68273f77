"""Main text of web pages: a linear-chain CRF over DOM leaf blocks.

A page is scanned once.  Text gathers in leaf blocks, which block-level tags
bound; inline tags do not cut a block.  Each block has features of its ancestors
(tags, and keywords in class, id and role) and of its text (length, share inside
links, sentence ends and the like).  A conditional random field labels the
sequence of blocks and Viterbi decoding picks the article's blocks.

The field is trained on labelled pages that ``labelled_pages`` writes from a
seed: a fixed number of them, over many templates, with each block's label known
by construction.  So the model depends on no table.

Scripts, styles, templates, the head and comments in the markup hold no text.
Character references are decoded, white space inside a block becomes one blank,
and the blocks that stay are joined by an empty line, whole and in page order.
Null and empty pages give the empty text; null and repeated keys keep their rows.
End tags that HTML lets a page omit are implied: the head ends where the body or
anything that cannot stand in a head begins, a paragraph where a block opens, items,
cells, rows and terms at the next one or where their list or table ends.  Markup
that is cut off or not closed is read as far as it goes; a tag cut off at the end is
dropped.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casframe.llm import crf

TRAIN_PAGES = 320

# Element names of the HTML standard by how the scan treats them.
RAW = frozenset("script style noscript template iframe textarea title svg object noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
# Elements that end an open element of the same row, up to the list or table they stand in.
ENDS = {tag: frozenset(ends.split()) for tag, ends in {"li": "li", "dt": "dt dd", "dd": "dt dd", "td": "td th", "th": "td th", "tr": "td th tr", "tbody": "td th tr thead tbody", "tfoot": "td th tr thead tbody", "option": "option", "optgroup": "option optgroup"}.items()}
HOLDERS = frozenset("ul ol menu dl table select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACED = frozenset("br img input hr wbr td th".split())
# Ancestor features: a tag name, or words found in class, id or role.
TAGS = "article main section header footer nav aside form ul ol li table p h1 h2 h3 blockquote pre figure figcaption button label select dialog dl details menu address".split()
KEYWORDS = {
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner adsense dfp".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar tabs toc pagination pager skip".split(),
    "side": "sidebar side aside rail widget widgets related recommended recommendations trending popular more teaser teasers".split(),
    "foot": "footer foot copyright colophon legal bottom imprint".split(),
    "head": "header head masthead top branding logo site-header sitename".split(),
    "notice": "cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup popup modal overlay banner toast paywall privacy message".split(),
    "comment": "comment comments reply replies respond discussion disqus commentlist feedback reviews".split(),
    "share": "share sharing social follow tags meta byline author bio".split(),
    "form": "form search searchform login contact input".split(),
    "content": "content article post entry story body text main maincontent articlebody post-content entry-content page prose".split(),
}
_WORD_OF = {w: name for name, ws in KEYWORDS.items() for w in ws}
_NAMES = [*TAGS, *KEYWORDS]
_BIT = {name: 1 << k for k, name in enumerate(_NAMES)}
_APART = sum(_BIT[x] for x in ("nav", "aside", "footer", "form", "dialog", "menu", "button", "select", "advert", "side", "foot", "notice", "comment", "share"))
_OPEN = re.compile(r"<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_NAMED = re.compile(r"(?:^|[\s\"'])(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PARTS = re.compile(r"[a-z]+")


def _marks(tag: str, attributes: str) -> int:
    out = _BIT.get(tag, 0)
    if "=" in attributes:
        for groups in _NAMED.findall(attributes):
            for name in _PARTS.findall("".join(groups).lower()):
                if name in _WORD_OF:
                    out |= _BIT[_WORD_OF[name]]
    return out


def leaf_blocks(page: str) -> list[tuple[str, int, int, str]]:
    """(text, ancestor marks, characters inside links, innermost block tag) of the blocks with text."""
    out: list[tuple[str, int, int, str]] = []
    stack: list[tuple[str, int]] = [("", 0)]
    pieces: list[str] = []
    linked = links = 0
    low = None
    pos, size = 0, len(page)

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append((text, stack[-1][1], linked, stack[-1][0]))
            pieces, linked = [], 0

    def close(tag: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == tag:
                del stack[k:]
                return

    def imply(tag: str) -> None:
        """Closes what the start of ``tag`` ends."""
        if stack[-1][0] == "p":
            stack.pop()
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in HOLDERS:
                return
            if stack[k][0] in ENDS.get(tag, ()):
                del stack[k:]

    while pos < size:
        lt = page.find("<", pos)
        if lt < 0:
            lt = size
        if lt > pos:
            piece = page[pos:lt]
            if "&" in piece:
                piece = entities.unescape(piece)
            pieces.append(piece)
            if links:
                linked += len(piece.strip())
        if lt >= size:
            break
        sign = page[lt + 1 : lt + 2]
        if sign == "!" or sign == "?":
            end = page.find("-->", lt + 4) if page.startswith("<!--", lt) else page.find(">", lt)
            pos = size if end < 0 else end + (3 if page.startswith("<!--", lt) else 1)
        elif sign == "/":
            end = page.find(">", lt)
            if end < 0:
                break
            tag = page[lt + 2 : end].split(None, 1)[0].lower() if page[lt + 2 : end].strip() else ""
            pos = end + 1
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK:
                flush()
                close(tag)
        elif sign.isascii() and sign.isalpha():
            found = _OPEN.match(page, lt)
            if not found:
                end = page.find(">", lt)
                if end < 0:
                    break
                tag, attributes, pos = re.split(r"[\s/>]", page[lt + 1 : end + 1], maxsplit=1)[0].lower(), "", end + 1
            else:
                tag, attributes, pos = found[1].lower(), found[2], found.end()
            if tag in RAW:
                if not attributes.endswith("/") or tag not in ("svg", "object"):
                    low = page.lower() if low is None else low
                    end = low.find("</" + tag, pos) if len(low) == size else page.find("</" + tag, pos)
                    pos = size if end < 0 else end
                    end = page.find(">", pos)
                    pos = size if end < 0 else end + 1
            elif tag == "a":
                links += 1
            elif tag in SPACED and tag not in BLOCK:
                pieces.append(" ")
            elif tag in BLOCK:
                flush()
                imply(tag)
                if tag not in VOID and tag != "head":  # a head holds no text of its own: what stands in it is the body's
                    stack.append((tag, stack[-1][1] | _marks(tag, attributes)))
                if tag in ("nav", "article", "footer", "section"):
                    links = 0
        else:
            pieces.append("<")
            pos = lt + 1
    flush()
    return out


def features(blocks: list[tuple[str, int, int, str]]) -> np.ndarray:
    """One row for each block: ancestors, text, place, and the neighbours' link shares."""
    n, names = len(blocks), len(_NAMES)
    marks = np.array([b[1] for b in blocks], object)
    out = np.zeros((n, names + 22))
    for k in range(names):
        out[:, k] = [(m >> k) & 1 for m in marks]
    size = np.array([len(b[0]) for b in blocks], float)
    link = np.array([min(1.0, b[2] / max(1, len(b[0]))) for b in blocks])
    words = np.array([b[0].count(" ") + 1 for b in blocks], float)
    ends = np.array([b[0][-1] in ".!?…:;。" for b in blocks])
    in_body = (out[:, names - 1] > 0) | (out[:, TAGS.index("article")] > 0) | (out[:, TAGS.index("main")] > 0)
    lone = np.array([b[3] in ("p", "h1", "h2", "h3", "li", "blockquote", "pre") for b in blocks])
    apart = np.array([(m & _APART) != 0 for m in marks])
    title = np.array([b[3] in ("h1", "h2", "h3") for b in blocks])
    place = np.arange(n) / max(1, n - 1)
    extra = [
        np.ones(n), np.log1p(size) / 6, size > 80, words > 12, words < 4, link, link > 0.5, ends, np.array(["©" in b[0] or "(c)" in b[0].lower() for b in blocks]), in_body, lone,
        place, place > 0.85, np.append(0.0, link[:-1]), np.append(link[1:], 0.0), np.array([sum(map(b[0].count, "0123456789")) / max(1, len(b[0])) for b in blocks]), np.array(["|" in b[0] or "·" in b[0] or "»" in b[0] for b in blocks]), in_body & ends,
        apart, in_body & ~apart, ~in_body & ~apart & (size > 80), in_body & ~apart & title,
    ]
    for k, column in enumerate(extra):
        out[:, names + k] = column
    return out


class _Writer:
    """Writes one labelled page from a random stream."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def words(self, lo: int, hi: int) -> str:
        r = self.r
        return " ".join("".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(2, 9))) for _ in range(r.randint(lo, hi)))

    def sentence(self) -> str:
        return self.words(self.r.choice([1, 4]), 18).capitalize() + self.r.choice(".....!?")

    def prose(self) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(1, 6)))

    def link(self) -> str:
        return f'<a href="/{self.r.randint(1, 99)}">{self.words(1, 3)}</a>'

    def wrap(self, tags: list[str], inner: str) -> str:
        tag = self.r.choice(tags)
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    def content(self) -> str:
        r, out = self.r, []
        title = self.words(3, 9)
        if r.random() < 0.85:
            out.append(self.wrap(["h1", "h2", "header><h1"], title).replace("</header><h1>", "</h1></header>") if r.random() < 0.8 else f"<header><h1>{title}</h1></header>")
        for _ in range(r.randint(1, 9)):
            kind = r.random()
            if kind < 0.7:
                out.append(f"<p>{self.prose()}" + "</p>" * (r.random() < 0.85))
            elif kind < 0.76:
                out.append(f"<h{r.randint(2, 3)}>{self.words(2, 6)}</h2>")
            elif kind < 0.82:
                out.append("<ul>" + "".join(f"<li>{self.words(2, 14)}{r.choice(['', '.'])}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.86:
                out.append(f"<blockquote>{self.prose()}</blockquote>")
            elif kind < 0.89:
                out.append(f"<pre>{self.words(3, 12)}</pre>")
            elif kind < 0.92:
                out.append(f'<figure><img src="a.png"><figcaption>{self.sentence()}</figcaption></figure>')
            elif kind < 0.95:
                out.append("<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{r.randint(1, 99)}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>")
            else:
                out.append(f"<div>{self.prose()}</div>")
        return "\x01" + "\x02\x01".join(out) + "\x02"

    def apart(self) -> str:
        """A part that is not content."""
        r = self.r
        text = r.choice([self.prose, self.sentence, lambda: self.words(2, 8)])
        links = "".join(f"<li>{self.link()}</li>" for _ in range(r.randint(2, 8)))
        kind = r.randint(0, 11)
        if kind == 0:
            return self.wrap(["nav", 'div class="menu"', 'div id="navigation"', "nav role='navigation'"], f"<ul>{links}</ul>")
        if kind == 1:
            return self.wrap(['div class="ad"', 'div class="advert banner"', 'aside class="sponsored"', 'div id="ads-top"', 'section class="promo"'], r.choice(["", "<p>"]) + text())
        if kind == 2:
            return self.wrap(["aside", 'div class="sidebar"', 'div id="side"', 'aside class="widget"'], f"<h3>{self.words(1, 3)}</h3><p>{text()}</p><ul>{links}</ul>")
        if kind == 3:
            return self.wrap(['div class="cookie-notice"', 'div id="cookie-consent"', 'div class="alert"', 'section class="newsletter"', 'div class="notice" role="alert"', 'dialog'], f"<p>{text()}</p><button>{self.words(1, 2)}</button>")
        if kind == 4:
            return self.wrap(["form", 'form class="search"', 'form id="contact"'], f'<label>{self.words(1, 3)}</label><input type="text"><p>{text()}</p><select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select><button>{self.words(1, 2)}</button>')
        if kind in (5, 6):
            inner = "".join(f'<div class="{r.choice(["comment", "reply", "item"])}"><p><b>{self.words(1, 2)}</b></p><p>{self.prose()}</p></div>' for _ in range(r.randint(1, 4)))
            return self.wrap(['section class="comments"', 'div id="comments"', 'div class="comment-list"', 'section id="discussion"'], f"<h2>{self.words(1, 2)}</h2>{inner}")
        if kind == 7:
            return self.wrap(['div class="related"', 'section class="recommended"', 'div class="teasers"'], f"<h3>{self.words(1, 3)}</h3><ul>{links}</ul>" + f"<p>{text()}</p>" * (r.random() < 0.4))
        if kind == 8:
            return self.wrap(['div class="share"', 'div class="social"', 'ul class="breadcrumbs"'], f"{self.link()} {self.link()} {self.link()}")
        if kind == 9:
            return self.wrap(["header", 'div class="header"', 'div id="masthead"'], f"<div>{self.words(1, 3)}</div><p>{text()}</p>")
        if kind == 10:
            return self.wrap(['div class="popup"', 'div class="subscribe"', 'div id="paywall"'], f"<p>{text()}</p>")
        return self.wrap(["footer", 'div class="footer"', 'div id="foot"'], r.choice([f"&copy; {self.words(1, 3)} &middot; {text()}", f"<p>{text()}</p><ul>{links}</ul>", f"<p>&copy; {self.words(1, 4)}</p>"]))

    def omit(self, page: str) -> str:
        """The page without some of the tags that HTML lets it omit."""
        for tags in (["</head>"], ["<body>"], ["</p>"], ["</li>"], ["</td>", "</tr>"], ["</body>", "</html>"]):
            if self.r.random() < 0.5:
                for tag in tags:
                    page = page.replace(tag, "")
        return page

    def page(self) -> str:
        r = self.r
        if r.random() < 0.12:  # an article without any frame
            body = self.content()
            if r.random() < 0.3:
                body += self.apart()
            return self.omit(f"<html><head><title>{self.words(2, 5)}</title></head><body>{body}</body></html>")
        before = "".join(self.apart() for _ in range(r.randint(1, 3)))
        after = "".join(self.apart() for _ in range(r.randint(1, 4)))
        body = self.content()
        if r.random() < 0.4:
            body = body.replace("\x02\x01", f"\x02{self.apart()}\x01", 1)
        holder = r.choice(["article", "article", "main", "main><article", 'div class="content"', 'div id="main-content"', 'div class="post entry"', 'section class="article-body"', "div"])
        body = f"<{holder}>{body}" + ("</article></main>" if "><" in holder else f"</{holder.split()[0]}>")
        if r.random() < 0.3:
            body = f'<div class="{r.choice(["wrap", "page", "container", "layout"])}">{body}{after}</div>'
            after = ""
        page = f"<!DOCTYPE html><html><head><title>{self.words(2, 5)}</title></head><body>{before}{body}{after}</body></html>"
        return self.omit(page) if r.random() < 0.15 else page


def labelled_pages(n: int = TRAIN_PAGES, seed: int = 11) -> list[tuple[list[tuple[str, int, int, str]], np.ndarray]]:
    """Blocks and labels of ``n`` written pages.

    Content stands between two control characters, so a block's label is whether
    its text came from between them.
    """
    out = []
    for k in range(n):
        page = _Writer(seed * 100_003 + k).page()
        marked, inside = [], False
        for piece in re.split("([\x01\x02]|<[^>]*>)", page):
            if piece in ("\x01", "\x02"):
                inside = piece == "\x01"
            elif piece and piece[0] != "<" and piece.strip():
                marked.append(("\x03" if inside else "") + piece)
            else:
                marked.append(piece)
        blocks, labels = [], []
        for text, marks, linked, tag in leaf_blocks("".join(marked)):
            clean = text.replace("\x03", "")
            if clean:
                blocks.append((clean, marks, linked, tag))
                labels.append(int("\x03" in text))
        out.append((blocks, np.array(labels, int)))
    return out


def fit(n: int = TRAIN_PAGES) -> crf.Crf:
    return crf.train([(features(b), y) for b, y in labelled_pages(n) if b], steps=140)


def extract(page: str, model: crf.Crf) -> str:
    blocks = leaf_blocks(page)
    if not blocks:
        return ""
    labels = crf.viterbi(model.margins(features(blocks)).tolist(), model.move.tolist())
    return "\n\n".join(b[0] for b, y in zip(blocks, labels, strict=True) if y)


def apply(pages: DataFrame, model: crf.Crf, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """The key, the columns to keep, text and n_chars of each page."""
    names = [key, *keep]
    source = pages.select(*names, F.col(html).alias("_html"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [extract(p, model) if p else "" for p in (x.as_py() for x in part.column(len(names)))]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(names))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    kinds = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in names)
    return source.mapInArrow(run, f"{kinds}, text string, n_chars long")

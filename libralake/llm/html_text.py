"""Main text of web pages: parser events, text density per line, smoothing and clustering.

The standard library's parser streams events; each block of a page is a line with its
text and the number of tags in and before it.  Text-to-tag ratios are smoothed with a
Gaussian and split into two clusters by threshold; the container with most text in the
upper cluster is the content region; of marked ones (article, main) all that have a dense line.  Within a region
all blocks count, short ones too, but blocks of links in the lower cluster.  Outside the region containers that are mostly dense count whole,
and of the rest the dense blocks, the main heading and headings of what is kept.
Subtrees that are no article text (menus, headers, footers, asides, adverts, notices,
forms, scripts, styles, reader comments) are left out.  Of these, asides, forms, headers
and what is known by a role or name are so only where the rest of the page bears it out:
one that holds the main element or nearly all the text counts, and one of an ambiguous
name does where it is dense.  Work and memory are in proportion to the page, however deep or broken it is.

Character references are decoded, white space inside a block is one space, blocks are
joined by a line feed.  Null or empty html gives the empty text; broken markup gives
what the parser sees; repeated rows give repeated results; other columns are unread.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._arrow import filled, slices

BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style noscript template head title svg annotation annotation-xml iframe object canvas audio video map select textarea button datalist nav footer menu dialog".split())
#: What may stand in a head; anything else ends it.
IN_HEAD = frozenset("title meta link script style base noscript template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
REGION = frozenset(["article", "main"])
#: Tags whose start ends an open element of the same group.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notices?|alert|comments?|disqus|respond|replies|discussion|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|share|sharing|social|related|recommended|newsletter|subscribe|signup|popup|modal|overlay|toolbar|pagination|widget)(?:$|[\s_-])", re.I
)
_PLAIN = frozenset("no not has with without hide is show".split())
_ARTICLE = frozenset("article post entry content story chapter section paper".split())
#: Names that sections of articles have too.
_WEAK = frozenset("discussion related notice notices alert banner header widget social sharing navigation promotion".split())
_REMARKS = frozenset("comment comments disqus respond replies".split())
#: How sure a role or name is: it yields to density; to what else the page has; only to a page without other text.
WEAK, STRONG, REMARKS = 1, 2, 3
#: Characters a tag that prose has at least, and paragraphs of an article.
PROSE, PARAGRAPH = 15, 45
_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar toolbar alertdialog form".split())
_SPACE = re.compile(r"\s+")


def suspicion(name: str, in_article: bool) -> int:
    """How surely classes and identifiers say that a subtree is no article text; 0 where they do not."""
    most = 0
    for token in name.lower().split():
        parts = re.split("[_-]+", token)
        if parts[0] in _PLAIN or not _NAMES.search(token):
            continue
        hits = {p for p in parts if _NAMES.search(p)}
        if hits == {"header"} and (in_article or parts[0] in _ARTICLE) or hits == {"related"} and parts[-1] in ("work", "works"):
            continue
        most = max(most, REMARKS if hits & _REMARKS else WEAK if hits <= _WEAK else STRONG)
    return most


class _Page(HTMLParser):
    """Collects blocks: (pieces, tags seen since the last block, container, heading); a piece is its text, suspect subtree and whether it is a link's."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool, bool]] = []  # tag, begins an unread subtree, has a container of its own, is suspect
        self.places: dict[str, list[int]] = {}  # where in ``open`` each tag stands
        self.boxes: list[int] = [0]
        self.n_boxes, self.kinds, self.parents = 1, ["html"], [-1]
        self.unread = 0
        self.words: list[tuple[str, int, bool]] = []
        self.links = self.regions = 0
        self.tags = 0
        self.heading = ""
        self.blocks: list[tuple[list[tuple[str, int, bool]], int, int, str]] = []
        # Suspect subtrees: how sure, the one around, whether the main element is inside.
        self.sure, self.around, self.main = [], [], []
        self.suspect = -1

    def flush(self) -> None:
        if self.words:
            if any(not w.isspace() for w, _, _ in self.words):
                self.blocks.append((self.words, self.tags, self.boxes[-1], self.heading))
                self.tags = 0
            self.words = []

    def _pop(self, i: int) -> None:
        while len(self.open) > i:
            tag, unread, box, suspect = self.open.pop()
            self.places[tag].pop()
            self.unread -= unread
            self.links -= tag == "a"
            self.regions -= tag in REGION
            if tag in HEADINGS:
                self.heading = ""
            if box:
                self.boxes.pop()
            if suspect:
                self.suspect = self.around[self.suspect]

    def _last(self, tags: tuple[str, ...]) -> int:
        """Place of the innermost open element of some tags, -1 where none is open."""
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=-1)

    def _shut(self, names: tuple[str, ...], until: tuple[str, ...]) -> None:
        at = self._last(names)
        if at >= 0 and at > self._last(until):
            self._pop(at)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if self.open and self.open[-1][0] == "head" and tag not in IN_HEAD:
            self._pop(len(self.open) - 1)
        if tag == "br":
            self.words.append((" ", self.suspect, False))
            return
        if tag in BLOCK:
            self.flush()
            self._shut(("p",), ("article", "aside", "div", "section", "main", "td", "th", "li", "blockquote", "body", "nav", "footer", "header", "form"))
            if tag in CLOSES:
                self._shut(CLOSES[tag], ("ul", "ol", "dl", "table", "select", "menu") if tag not in ("td", "th") else ("tr", "table"))
        if tag in VOID:
            return
        # The footer of a quotation says whose it is.
        unread = tag in UNREAD and not (tag == "footer" and self.places.get("blockquote"))
        sure = STRONG if tag in ("aside", "form") or (tag == "header" and not self.regions) else 0
        if not unread and attrs and tag not in ("html", "body", "article", "main", "b", "i", "em", "strong"):
            a = dict(attrs)
            name = f"{a.get('class') or ''} {a.get('id') or ''}"
            unread = "hidden" in a
            if (a.get("role") or "").lower() in _ROLES or (a.get("aria-hidden") or "").lower() == "true":
                sure = STRONG
            if _NAMES.search(name):
                found = suspicion(name, self.regions > 0)
                # A title may be called a header or a banner.
                sure = max(sure, 0 if found == WEAK and tag in HEADINGS else found)
        if tag == "main":
            held = self.suspect
            while held >= 0 and not self.main[held]:
                self.main[held] = True
                held = self.around[held]
        if sure:
            self.sure.append(sure)
            self.around.append(self.suspect)
            self.main.append(False)
            self.suspect = len(self.sure) - 1
        self.links += tag == "a"
        self.regions += tag in REGION
        if tag in HEADINGS:
            self.heading = tag
        box = tag in ("div", "section", "article", "main", "td", "body")
        if box:
            self.kinds.append(tag)
            self.parents.append(self.boxes[-1])
            self.boxes.append(self.n_boxes)
            self.n_boxes += 1
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, unread, box, sure > 0))
        self.unread += unread

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        if (at := self._last((tag,))) >= 0:
            self._pop(at)

    def handle_data(self, data: str) -> None:
        if self.unread and self.open[-1][0] == "head" and not data.isspace():
            self._pop(len(self.open) - 1)
        if not self.unread:
            self.words.append((data, self.suspect, self.links > 0))

    def finish(self) -> None:
        self.close()
        self.flush()


def smooth(ratio: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing with the kernel renormalised at the ends."""
    reach = max(1, math.ceil(2 * sigma))
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = np.convolve(ratio, k)[reach : reach + len(ratio)]
    return full / np.convolve(np.ones(len(ratio)), k)[reach : reach + len(ratio)]


def density(blocks: list[tuple[str, int, int, int, str]], enough: float = math.inf, sigma: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Which blocks are in the upper cluster, and which are dense themselves and no links.

    Lines at or above the mean of the smoothed ratios less half their deviation form the upper cluster.
    A block of ``enough`` characters a tag is dense however long the others are.
    """
    ratio = np.array([len(b[0]) / max(1, b[1]) for b in blocks])
    s = smooth(ratio, sigma)
    least = s.mean() - 0.5 * s.std()
    return s >= least, ((s >= least) & (ratio >= least) | (ratio >= enough)) & np.array([2 * b[3] < len(b[0]) for b in blocks])


def regions(blocks: list[tuple[str, int, int, int, str]], kinds: list[str], parents: list[int], upper: np.ndarray, dense: np.ndarray) -> set[int]:
    """The containers whose blocks are the content.

    Lines of the upper cluster vote with their length.  All outermost article and main containers with
    a dense line are content (with any text, where none has one); where a page has none, the smallest container that holds nine tenths of the votes.
    """
    votes, outer, marked, solid = [0] * len(kinds), [], set(), set()
    for b, kind in enumerate(kinds):
        above = outer[parents[b]] if parents[b] >= 0 else -1
        outer.append(above if above >= 0 else b if kind in REGION else -1)
    for (text, _, box, _, _), up, own in zip(blocks, upper, dense):
        votes[box] += len(text) * int(up)
        if outer[box] >= 0:
            marked.add(outer[box])
            if own:
                solid.add(outer[box])
    if marked:
        return solid or marked
    for b in range(len(kinds) - 1, 0, -1):
        votes[parents[b]] += votes[b]
    return {max((b for b, v in enumerate(votes) if v >= 0.9 * votes[0]), default=0)}


def content(blocks: list[tuple[str, int, int, int, str]], kinds: list[str], parents: list[int]) -> list[bool]:
    """Which blocks are article text: those of the regions; outside, whole containers that are mostly dense, else dense blocks and headings."""
    upper, dense = density(blocks, PROSE)
    inside = regions(blocks, kinds, parents, upper, dense)
    around = set()
    for b in inside:
        while (b := parents[b]) >= 0 and b not in around:
            around.add(b)
    # The outermost container of each block that is no region and has none inside; -1 within a region, -2 for a block of its own.
    apart = []
    for b in range(len(kinds)):
        up = parents[b]
        apart.append(-1 if b in inside else -2 if b in around else b if up < 0 or apart[up] == -2 else apart[up])
    held: dict[int, list[int]] = {}
    for (text, _, box, _, _), d in zip(blocks, dense):
        x = held.setdefault(apart[box], [0, 0])
        x[0] += len(text)
        x[1] += len(text) * int(d)
    out = [False] * len(blocks)
    for i in range(len(blocks) - 1, -1, -1):
        text, _, box, links, heading = blocks[i]
        at = apart[box]
        if at == -1:
            out[i] = bool(upper[i]) or 2 * links < len(text) or heading != ""
        else:
            out[i] = bool(dense[i]) or heading == "h1" or (at >= 0 and 2 * held[at][1] >= held[at][0]) or (heading != "" and i + 1 < len(blocks) and out[i + 1] and apart[blocks[i + 1][2]] == at)
    return out


def _left(page: _Page, dead: list[bool]) -> list[tuple[str, int, int, int, str]]:
    """Blocks (text, tags before, container, characters of links, heading) without the pieces of dead subtrees."""
    out, tags = [], 0
    for pieces, n, box, heading in page.blocks:
        tags += n
        pieces = [p for p in pieces if p[1] < 0 or not dead[p[1]]]
        text = _SPACE.sub(" ", "".join(p[0] for p in pieces)).strip()
        if text:
            out.append((text, tags, box, sum(len(p[0]) for p in pieces if p[2]), heading))
            tags = 0
    return out


def judged(page: _Page) -> list[bool]:
    """Which suspect subtrees are no article text."""
    n = len(page.sure)
    gone = [not m for m in page.main]
    if not n:
        return gone
    # Own text of each subtree, without and with what links say; the last entry has the text outside.
    own, linked, marked = [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
    article = [k in REGION for k in page.kinds]
    for b in range(1, page.n_boxes):
        article[b] |= article[page.parents[b]]
    for pieces, _, box, _ in page.blocks:
        for text, s, link in pieces:
            if size := len(text.strip()):
                own[s] += size
                linked[s] += size * link
                marked[s] |= article[box]
    total, whole, links = sum(own), own[:n], linked[:n]
    for s in range(n - 1, -1, -1):
        if page.around[s] >= 0:
            whole[page.around[s]] += whole[s]
            links[page.around[s]] += links[s]

    def dead(gone: list[bool]) -> list[bool]:
        out: list[bool] = []
        for s in range(n):
            out.append(gone[s] or (page.around[s] >= 0 and out[page.around[s]]))
        return out

    # A page is not without text: from the outside in, subtrees that have nearly all of it are no boilerplate until some is left.
    by: list[int] = []  # the innermost subtree that takes each one out, n for none
    for s in range(n):
        by.append(s if gone[s] else by[page.around[s]] if page.around[s] >= 0 else n)
    back, shown = [0] * (n + 1), [False] * (n + 1)
    for s, k in enumerate([*by, n]):
        back[k] += own[s]
        shown[k] |= marked[s]
    rest, seen, live = back[n], shown[n], [False] * n
    for s in range(n):
        outer = page.around[s] < 0 or live[page.around[s]]
        if gone[s] and outer and rest < 0.1 * total and not seen and 2 * (whole[s] - links[s]) >= total and (page.sure[s] != REMARKS or not rest):
            gone[s] = False
            rest += back[s]
            seen |= shown[s]
        live[s] = outer and not gone[s]
    weak = [gone[s] and page.sure[s] == WEAK for s in range(n)]
    if any(weak):
        # Names that articles have too: density decides, over all that is not surely out.
        mine = dead([g and not w for g, w in zip(gone, weak)])
        kept = [p for p, *_ in page.blocks if any(not x[0].isspace() and (x[1] < 0 or not mine[x[1]]) for x in p)]
        blocks = _left(page, mine)
        _, dense = density(blocks, PARAGRAPH) if blocks else (None, np.zeros(0, bool))
        size, solid = [0] * (n + 1), [0] * (n + 1)
        for pieces, (text, *_), d in zip(kept, blocks, dense):
            s = max(x[1] for x in pieces)
            size[s] += len(text)
            solid[s] += len(text) * int(d)
        for s in range(n - 1, -1, -1):
            size[page.around[s]] += size[s]
            solid[page.around[s]] += solid[s]
            if weak[s]:
                gone[s] = 2 * solid[s] < size[s] or not size[s]
    return dead(gone)


_COMMENT_END = re.compile(r"--\s*>")
_ZEROS, _BEYOND = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,};?")


def closed(html: str) -> tuple[str, str]:
    """The part of a page that a parser reads in one go, and the rest, which is text.

    What would make the parser look for an end that never comes, once for each beginning, is taken out: comments without an
    end, marked sections (comments up to the next >, as in browsers), anything after the last >.
    """
    last = 0
    for m in _COMMENT_END.finditer(html):
        last = m.end()
    html = html[:last] + html[last:].replace("<!--", "")
    html = html.replace("<![", "<!_[")
    # Numbers that are no characters, however long.
    html = _BEYOND.sub("\ufffd", _ZEROS.sub("&#", html))
    end = html.rfind(">") + 1
    return html[:end], html[end:]


def main_text(html: str | None) -> str:
    """The article text of one page."""
    if not html:
        return ""
    page = _Page()
    head, tail = closed(html)
    page.feed(head)
    page.finish()
    if tail:
        page.handle_data(unescape(tail))
        page.flush()
    blocks = _left(page, judged(page))
    if not blocks:
        return ""
    return "\n".join(b[0] for b, keep in zip(blocks, content(blocks, page.kinds, page.parents)) if keep)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text, n_chars of every page; one scan, no shuffle."""
    schema = pa.schema([(key, pa.int64()), (url, pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_html"):
            texts = [main_text(h) for h in filled(b.column("_html")).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    src = pages.select(pages[key].cast("long").alias(key), pages[url].cast("string").alias(url), pages[html].cast("string").alias("_html"))
    return src.mapInArrow(run, f"{key} long, {url} string, text string, n_chars long")

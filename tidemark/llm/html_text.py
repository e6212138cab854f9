"""Main text of web pages by line-block distribution.

A page's markup is stripped into lines (a block element ends a line); lines
inside elements that never hold the article (menus, scripts, and the like) count
as empty. So do those inside a form, or an element named as boilerplate, unless
it holds most of the article-like text, or most of the page. The text length of a block is the sum over a
window of ``WINDOW`` lines. A surge is a block above the threshold whose
followers are filled too, a dive is the first empty block after it; the runs of
lines between surge and dive are the article's. The one with most text widens to
the innermost article-like container around it, so that short lines at the
article's edges stay with it; without such a container all runs are kept.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines that a block sums, and the text length from which a block is a surge.
WINDOW, SURGE = 3, 60

#: Elements whose content is never text of the article.
SKIPPED = frozenset("nav header footer aside script style noscript template svg math iframe object select button textarea head title dialog menu canvas audio video".split())
#: Elements that stay inside a line.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content has no markup.
RAW = frozenset("script style textarea title".split())
#: Words in class, id or role that mark boilerplate, and those that mark an article.
BOILER = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w+|signup|login|"
    r"nav|navbar|navigation|menu\w*|breadcrumbs?|pager|pagination|sidebar\w*|side|aside|widgets?|related|recommend\w*|share|sharing|social|"
    r"header|masthead|footer|foot|copyright|legal|disclaimer|comments?|commentlist|respond|reply|replies|disqus|contentinfo|complementary|search)(?=$|[\s_-])",
    re.I,
)
#: Of these words, those that the article's own text may be named with too.
WEAK = re.compile(r"(?:^|(?<=[\s_-]))(?:social|share|sharing|search|side|legal|alert|overlay)(?=$|[\s_-])", re.I)
ARTICLE = re.compile(r"(?:^|[\s_-])(?:article\w*|post|entry|story|content|main|body|text)(?=$|[\s_-])", re.I)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]{0,4096}\"|'[^']{0,4096}')*+>)?", re.S)
_UNQUOTED = re.compile(r"[^>\"']*")
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")


def _tag_end(page: str, at: int, unclosed: set[str]) -> int:
    """Where a tag ends whose name ends at ``at``; quotes count after "=" only. ``unclosed`` notes quotes that don't occur any more."""
    pos, end = at, len(page)
    while (stop := _UNQUOTED.match(page, pos).end()) < end and page[stop] != ">":
        before = stop - 1
        while before >= pos and page[before].isspace():  # within what lies since the last quote, so no character is met twice
            before -= 1
        quote, valued, pos = page[stop], before >= pos and page[before] == "=", stop + 1
        if valued:
            close = -1 if quote in unclosed else page.find(quote, pos)
            if close < 0:
                unclosed.add(quote)
                pos = page.find(">", at)
                return pos + 1 if pos >= 0 else end
            pos = close + 1
    return min(stop + 1, end)


class Page:
    """The lines of a page that may belong to its article, and the elements around them.

    A line is (text, container, link characters, doubtful element, clean):
    ``container`` numbers the innermost article-like element around it, and
    ``doubtful element`` the innermost form or element named as boilerplate; 0
    is none. ``around`` has the next one of its kind around each element, whose
    number is smaller. A line is clean if an article-like element that isn't
    named so is nearer. ``weak`` are doubtful elements whose name means
    boilerplate only if they hold no running text.
    """

    def __init__(self, page: str):
        self.around: dict[int, int] = {0: 0}
        self.weak: set[int] = set()
        self.lines = list(_lines_of(page, self))

    def within(self, elements: set[int]) -> set[int]:
        """``elements`` with all of their kind inside them."""
        found = set(elements)
        for e in sorted(self.around):
            if e and self.around[e] in found:
                found.add(e)
        return found

    def summed(self, own: dict[int, list[int]]) -> dict[int, list[int]]:
        """Sums of each element with those inside it."""
        for e in sorted(self.around, reverse=True):
            if e and e in own:
                above = own.setdefault(self.around[e], [0] * len(own[e]))
                for k, v in enumerate(own[e]):
                    above[k] += v
        own.pop(0, None)
        return own


def _lines_of(page: str, seen: Page) -> Iterator[tuple[str, int, int, int, bool]]:
    """The lines of ``Page``, whose elements are noted in ``seen``; every character and every element is met a bounded number of times."""
    stack: list[tuple[str, bool, bool, bool, bool]] = []  # element, skipped, container, doubtful, whether it tells if its lines are clean
    skipped, inside, numbers, links, link_chars = 0, [], 0, 0, 0
    doubts: list[int] = []
    clean = [False]
    open_names: Counter[str] = Counter()
    unclosed: set[str] = set()
    parts: list[str] = []
    at, end = 0, len(page)

    def flush() -> tuple[str, int, int, int, bool] | None:
        nonlocal parts, link_chars
        text, chars = _SPACE.sub(" ", "".join(parts)).strip(), link_chars
        parts, link_chars = [], 0
        return (text, inside[-1] if inside else 0, chars, doubts[-1] if doubts else 0, clean[-1]) if text else None

    def add(raw: str) -> None:
        nonlocal link_chars
        if not skipped and raw:
            text = html.unescape(raw)
            parts.append(text)
            if links:
                link_chars += len(text.strip())

    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:-3])
            continue
        rest = m[3]
        if rest is None:
            start, at = at, _tag_end(page, at, unclosed)
            rest = page[start:at]
        if not m[1]:  # a start tag
            if name == "br":
                add("\n")
                continue
            if name in VOID:
                if name == "hr" and (line := flush()):
                    yield line
                continue
            if name not in INLINE and (line := flush()):
                yield line
            if name in RAW:
                close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = close.end() if close else end
                continue
            if rest.endswith("/>"):
                continue
            named = " ".join(a or b or c for a, b, c in _NAMED.findall(rest)) if rest else ""
            container = name in ("article", "main") or bool(named and name in ("div", "section", "td") and ARTICLE.search(named))
            skip = name in SKIPPED and not (name == "header" and inside)
            boiler = bool(named and BOILER.search(named))
            doubt = not skip and (name == "form" or boiler and name not in ("html", "body", "article", "main"))
            skipped += skip
            if container and not skipped:
                numbers += 1
                seen.around[numbers] = inside[-1] if inside else 0
                inside.append(numbers)
            else:
                container = False
            if doubt:
                numbers += 1
                seen.around[numbers] = doubts[-1] if doubts else 0
                if name != "form" and not BOILER.search(WEAK.sub(" ", named)):
                    seen.weak.add(numbers)
                doubts.append(numbers)
            tells = doubt or container and not boiler
            if tells:
                clean.append(not doubt)
            links += name == "a"
            open_names[name] += 1
            stack.append((name, skip, container, doubt, tells))
        else:
            if name not in INLINE and (line := flush()):
                yield line
            if not open_names[name]:
                continue
            depth = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name)  # all that it passes is closed
            for open_name, skip, container, doubt, tells in reversed(stack[depth:]):
                open_names[open_name] -= 1
                skipped -= skip
                links -= open_name == "a"
                if container:
                    inside.pop()
                if doubt:
                    doubts.pop()
                if tells:
                    clean.pop()
            del stack[depth:]
    if line := flush():
        yield line


def _weight(line: tuple) -> int:
    """The text length of a line; text that links hold says little: a line of links counts as empty."""
    return len(line[0]) if line[2] * 2 <= len(line[0]) else 0


def _undoubted(page: Page) -> list[tuple]:
    """Lines without those of doubtful elements that are boilerplate.

    Such an element stays if it holds most of the clean text, or most of the
    page while clean text outside it is less than a quarter of its own; and a
    weak one, if most of its text are lines that would be a surge alone.
    """
    held: dict[int, list[int]] = {}
    total = clean = 0
    for line in page.lines:
        w = _weight(line)
        total += w
        clean += w * line[4]
        own = held.setdefault(line[3], [0, 0, 0, 0])
        for k, v in enumerate((w, w * line[4], len(line[0]), w if w >= SURGE else 0)):
            own[k] += v
    held = page.summed(held)
    most = lambda w, c: c and 2 * c >= clean or 2 * w > total and 4 * (clean - c) < w
    drop = page.within({e for e, (w, c, chars, running) in held.items() if not most(w, c) and not (e in page.weak and 2 * running > chars)})
    return [x for x in page.lines if x[3] not in drop]


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The article of a page: its blocks in order, one space between; empty if there is none."""
    found = Page(page or "")
    lines = _undoubted(found)
    if not lines:
        return ""
    weight = [_weight(x) for x in lines]
    n = len(lines)
    sums = [sum(weight[i : i + window]) for i in range(n)]
    best, run, i, runs = (0, 0), 0, 0, []
    while i < n:
        if not weight[i] or sums[i] < min(surge, max(sums)):
            i += 1
            continue
        j, total = i, 0
        while j < n and sums[j]:
            total += weight[j]
            j += 1
        runs.append((i, j))
        if total > run:
            best, run = (i, j), total
        i = j
    if not run:
        return ""
    first, last = best
    # the innermost container that holds most of the run's text
    held: dict[int, list[int]] = {}
    for k in range(first, last):
        held.setdefault(lines[k][1], [0])[0] += weight[k]
    inner = max((c for c, (w,) in found.summed(held).items() if 2 * w > run), default=None)
    if inner is not None:
        inside = found.within({inner})
        keep = [x[0] for x in lines if x[1] in inside]
    else:
        keep = [lines[k][0] for i, j in runs for k in range(i, j)]
    return " ".join(keep)


def _extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        text = [main_text(None if x is None or x != x else x) for x in frame["html"]]
        yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": text, "n_chars": [len(t) for t in text]})


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of ``pages``: id, url, text (empty if there is none), n_chars.

    Null and empty pages give an empty text. Repeated rows each give a row; no
    rows give none; other columns are ignored. Without any surge (a page of
    short lines only) the largest block marks the article.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = rows.mapInPandas(_extract, "page_id long, url string, text string, n_chars long")
    return out.withColumnsRenamed({"page_id": id_col, "url": url_col})

"""Main text of web pages by tree scoring.

Markup is read into a tree as browsers would build it in the common cases (implied ends of
paragraphs and list items, unclosed tags, raw text in scripts), in time linear in its size. Subtrees
that are page furniture by their element, or look like it by the words of their class, id or role,
are set aside. Each paragraph earns points for its length and its commas, and passes them to its
ancestors, less at each step but in full to the article element around it; an ancestor's points are
discounted by the share of its text that lies in links. The best container is kept, and siblings
that look like parts of the same text.

Words may mislead: if what is found is short, the subtree with the most prose of those that were
set aside for their looks is taken back, and the page is scored again.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>",
    re.DOTALL,
)
_NAME = re.compile(r"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")

#: Elements whose content is no markup.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
#: Elements without content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that are a block of their own.
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div",
    "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head",
    "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre",
    "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Elements that never hold main text.
FURNITURE = {
    "aside", "audio", "button", "canvas", "datalist", "embed", "footer", "head", "iframe", "input", "menu", "nav",
    "noembed", "noframes", "object", "option", "script", "search", "select", "style", "svg", "template", "textarea",
    "title", "video",
}
#: Elements that hold main text only if little is found elsewhere.
DOUBTFUL = {"dialog", "fieldset", "form", "header", "noscript"}
#: Words of a class, id or role that mark furniture, and beginnings of such words.
FURNITURE_WORDS = {
    "ad", "ads", "banner", "banners", "comment", "commentbox", "commentform", "commentlist", "complementary", "consent",
    "contentinfo", "footer", "footers", "guestbook", "header", "menu", "menus", "modal", "nav", "pager", "promo", "promos",
    "reactions", "recommended", "recommendations", "related", "remark", "remarks", "replies", "respond", "responses",
    "search", "share", "sharing", "signup", "skip", "social", "tags", "toc",
}
FURNITURE_STARTS = (
    "advert", "breadcrumb", "comments", "cookie", "disqus", "gdpr", "masthead", "navbar", "navigation", "newsletter",
    "paginat", "popup", "sidebar", "sponsor", "subscri",
)
#: The same, but as often the name of something else.
DOUBTFUL_WORDS = {
    "alert", "alerts", "dropdown", "notice", "notices", "notification", "notifications", "rail", "toolbar", "widget", "widgets",
}
#: Elements that are named after what they say.
_NAMED_BY_TEXT = {"a", "b", "code", "em", "h1", "h2", "h3", "h4", "h5", "h6", "i", "p", "span", "strong"}
#: Elements whose words don't matter, since they stand around the main text.
_TRUSTED = {"html", "body", "article", "main"}
#: What an opening tag ends: elements that are closed if they are open, up to the nearest of the second set.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
#: Blocks that have no points themselves; the first are kept before a text only.
_LEADING, _UNSCORED = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}, {"pre", "table"}
#: Characters from which a sibling counts as a paragraph of the text.
SHORT_BLOCK = 80
_NO_PARAGRAPH = BLOCK - {"body", "html", "head", "option", "optgroup"}
_IN_HEAD = {"base", "basefont", "bgsound", "html", "link", "meta", "noscript", "script", "style", "template", "title"}
_CONTAINERS = {"div", "section", "article", "main", "body", "td", "th", "#root"}
#: Characters of a main text below which furniture by looks is looked at again; and furniture by plain words.
SHORT_TEXT, NO_TEXT = 250, 50
_NONE, _DOUBTFUL, _WORD, _ELEMENT = range(4)


def _looks(tag: str, attrs: str) -> int:
    """How sure it is that an element is furniture, from ``_NONE`` to ``_ELEMENT``."""
    if tag in FURNITURE:
        return _ELEMENT
    looks = _DOUBTFUL if tag in DOUBTFUL else _NONE
    if not attrs or tag in _TRUSTED:
        return looks
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id", "role") and not (name == "id" and tag in _NAMED_BY_TEXT):
            for word in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()):
                if word in FURNITURE_WORDS or word.startswith(FURNITURE_STARTS):
                    looks = max(looks, _WORD)
                elif word in DOUBTFUL_WORDS:
                    looks = max(looks, _DOUBTFUL)
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return _ELEMENT
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
            return _ELEMENT
    return looks


class _Page:
    """The tree of a page as columns, and its texts and block ends in page order.

    Open elements are also kept by name with their places, so that neither an end tag nor an implied
    end walks through them.
    """

    def __init__(self, source: str):
        self.tags, self.parents, self.looks, self.link = ["#root"], [0], [_NONE], [False]
        self.events: list[tuple[int, str | None]] = []
        self.open, self.places, self.blocks = [0], defaultdict(list), [0]
        at, n, last = 0, len(source), source.rfind(">")
        lower, broken = None, False
        while at < n:
            start = source.find("<", at)
            found = None
            if 0 <= start < last or source.startswith("<!--", start):
                found = None if broken else _TAG.match(source, start)
                if not found and (name := _NAME.match(source, start)):
                    # A quote that is never closed hides all that follows: tags end at the next sign from here on.
                    broken, end = True, source.find(">", name.end())
                    found = name if end >= 0 else None
            if start < 0 or start > last and not found:
                self._text(source[at:])
                break
            self._text(source[at : start + (not found)])
            if not found:
                at = start + 1
                continue
            plain = found.re is _NAME
            at = end + 1 if plain else found.end()
            if not found["tag"]:
                continue
            tag, attrs = found["tag"].lower(), source[found.end() : end] if plain else found["attrs"]
            if found["end"]:
                self._close(tag)
                continue
            self._imply(tag)
            node = self._add(tag, attrs)
            if tag in BLOCK or tag == "br":
                self.events.append((node, None if tag in BLOCK else " "))
            if tag in VOID or attrs.endswith("/") and tag in ("svg", "path"):
                continue
            if tag in RAW:  # its content is furniture: skip it
                lower = lower if lower is not None else source.lower()
                close = lower.find(f"</{tag}", at)
                end = source.find(">", close) if close >= 0 else -1
                at = end + 1 if end >= 0 else n
                continue
            self.places[tag].append(len(self.open))
            if tag in BLOCK:
                self.blocks.append(len(self.open))
            self.open.append(node)

    def _text(self, text: str) -> None:
        if text:
            if self.places["head"] and not text.isspace():
                self._close("head")
            self.events.append((self.open[-1], html.unescape(text)))

    def _add(self, tag: str, attrs: str) -> int:
        parent = self.open[-1]
        self.tags.append(tag)
        self.parents.append(parent)
        self.looks.append(_looks(tag, attrs))
        self.link.append(self.link[parent] or tag == "a" and "href" in attrs.lower())
        return len(self.tags) - 1

    def _pop(self, to: int) -> None:
        while len(self.open) > to:
            node = self.open.pop()
            tag = self.tags[node]
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
                self.events.append((node, None))

    def _last(self, names) -> int:
        """The place of the innermost open element of ``names``, 0 if there is none."""
        return max((self.places[x][-1] for x in names if self.places[x]), default=0)

    def _imply(self, tag: str) -> None:
        if self.places["head"] and tag not in _IN_HEAD:
            self._close("head")
        if tag in _NO_PARAGRAPH:
            inner = max(self.blocks[-1], self._last(("button", "object")))
            if self.tags[self.open[inner]] == "p":
                self._pop(inner)
        if tag in _ENDS:
            ends, walls = _ENDS[tag]
            wall = self._last(walls)
            inside = [x[k] for x in (self.places[e] for e in ends) if (k := bisect(x, wall)) < len(x)]
            if inside:
                self._pop(min(inside))

    def _close(self, tag: str) -> None:
        place = self._last((tag,))
        # An inline end doesn't end the block around it.
        if place and (tag in BLOCK or place > self.blocks[-1]):
            self._pop(place)


def _points(size: int, commas: int) -> float:
    return min(size / 25, 1.0) + commas + min(size / 100, 3.0)


def _keep_short_siblings(
    page: _Page, best: int, dropped: list[bool], kept: list[bool], whole: list[int], linked: list[int]
) -> None:
    """Keep siblings of the text that have few points or none: headings and code pass all theirs on.

    Of the blocks without links that follow one another before or behind the kept ones, those up to
    the last heading (before only), code, table or paragraph's worth of text stay, and the one
    directly before. Between kept siblings, all without links stay.
    """
    while page.parents[best] and whole[page.parents[best]] == whole[best]:
        best = page.parents[best]
    kept[best] = True
    row = [
        i
        for i in range(1, len(page.tags))
        if page.parents[i] == page.parents[best] and page.tags[i] in BLOCK and not dropped[i] and whole[i]
    ]
    marks = [k for k, i in enumerate(row) if kept[i]]
    if not marks:
        return
    first, last = marks[0], marks[-1]
    low, high = first, last
    for k in range(first - 1, -1, -1):
        if linked[row[k]] >= 0.25 * whole[row[k]]:
            break
        if k == first - 1 or page.tags[row[k]] in _LEADING | _UNSCORED or whole[row[k]] >= SHORT_BLOCK:
            low = k
    for k in range(last + 1, len(row)):
        if linked[row[k]] >= 0.25 * whole[row[k]]:
            break
        if page.tags[row[k]] in _UNSCORED or whole[row[k]] >= SHORT_BLOCK:
            high = k
    for i in row[low : high + 1]:
        kept[i] |= linked[i] < 0.25 * whole[i]


def _family(page: _Page, best: int) -> list[int]:
    """The siblings of a node; those of a table's cell are all cells of the table."""
    n = len(page.tags)
    if page.tags[best] not in ("td", "th"):
        return [i for i in range(1, n) if page.parents[i] == page.parents[best]]
    table = [0] * n
    for i in range(1, n):
        table[i] = i if page.tags[i] == "table" else table[page.parents[i]]
    return [i for i in range(1, n) if page.tags[i] in ("td", "th") and table[i] == table[best]]


def _keep(page: _Page, looks: list[int], holder: list[int], lengths: list[int]) -> list[bool]:
    """Which nodes belong to the main text, if those with ``looks`` are furniture."""
    n = len(page.tags)
    dropped = [False] * n
    for i in range(1, n):
        dropped[i] = dropped[page.parents[i]] or looks[i] > _NONE
    size, commas, links = [0] * n, [0] * n, [0] * n
    for (node, text), length in zip(page.events, lengths, strict=True):
        if length and not dropped[node]:
            size[holder[node]] += length
            commas[holder[node]] += text.count(",") + text.count("、") + text.count("，")
            links[holder[node]] += length * page.link[node]
    article = [0] * n
    for i in range(1, n):
        article[i] = i if page.tags[i] == "article" else article[page.parents[i]]
    score = [0.0] * n
    for i in range(n):
        if size[i]:
            points = _points(size[i], commas[i]) * (1 - links[i] / size[i])
            at = i if page.tags[i] in _CONTAINERS else page.parents[i]
            share, full = 1.0, article[at]
            score[full] += points * (full > 0)
            for step in range(1, 6):
                if at != full or not full:
                    score[at] += points * share
                if not at:
                    break
                at, share = page.parents[at], 1 / (2 * step)
    whole, linked = size[:], links[:]
    for i in range(n - 1, 0, -1):
        whole[page.parents[i]] += whole[i]
        linked[page.parents[i]] += linked[i]
    kept = [False] * n
    if not whole[0]:
        return kept
    final = [s * (1 - linked[i] / whole[i]) if whole[i] else 0.0 for i, s in enumerate(score)]
    # Of equal ones an article, else the innermost.
    best = max(range(n), key=lambda i: (final[i], page.tags[i] == "article", i))
    kept[best] = True
    if best and page.tags[best] not in ("body", "main", "html"):
        limit = max(10.0, 0.2 * final[best])
        for i in _family(page, best):
            if not dropped[i] and whole[i]:
                density = linked[i] / whole[i]
                if page.tags[best] == "article":
                    kept[i] |= page.tags[i] == "article" and density < 0.5
                elif page.tags[i] == "p":
                    kept[i] |= density < 0.25
                elif page.tags[i] in ("td", "th"):
                    kept[i] |= density < 0.25 and (final[i] >= limit or whole[i] >= SHORT_BLOCK)
                else:
                    kept[i] |= final[i] >= limit
        if page.tags[best] != "article":
            _keep_short_siblings(page, best, dropped, kept, whole, linked)
    for i in range(1, n):
        kept[i] = (kept[i] or kept[page.parents[i]]) and not dropped[i]
    return kept


def _most_prose(page: _Page, lengths: list[int], kept: list[bool], found: int) -> list[int]:
    """``page.looks`` with the subtree of the most prose taken back, if that is more than what was ``found``.

    A text counts for the innermost node around it that looks like furniture, unless an element that
    never holds main text is around it. A page that says where its text is (article, main) has none
    elsewhere. Plain words are overruled only if next to nothing was found, and nothing there.
    """
    n = len(page.tags)
    stated, away = [False] * n, [False] * n
    for i in range(1, n):
        away[i] = away[page.parents[i]] or page.looks[i] > _NONE
        stated[i] = stated[page.parents[i]] or page.tags[i] in ("article", "main") and not away[i]
    anywhere = not any(stated)
    nothing = found < NO_TEXT and not (found and any(a and b for a, b in zip(stated, kept, strict=True)))
    owner, sure = [0] * n, [False] * n
    for i in range(1, n):
        owner[i] = i if page.looks[i] > _NONE else owner[page.parents[i]]
        sure[i] = sure[page.parents[i]] or page.looks[i] >= (_ELEMENT if nothing else _WORD)
    prose = [0] * n
    for (node, _), length in zip(page.events, lengths, strict=True):
        if length and owner[node] and not sure[node] and not page.link[node] and (anywhere or stated[node]):
            prose[owner[node]] += length
    best = max(range(n), key=lambda i: (prose[i], -i))
    looks = page.looks[:]
    if prose[best] > 2 * found:
        while best:
            looks[best] = _NONE
            best = page.parents[best]
    return looks


def main_text(source: str) -> str:
    """The main text of a page: its blocks joined by line ends, white space in a block made single."""
    page = _Page(source)
    n = len(page.tags)
    # Runs of text between block ends are paragraphs of the nearest block around them.
    holder = [0] * n
    for i in range(1, n):
        holder[i] = i if page.tags[i] in BLOCK else holder[page.parents[i]]
    lengths = [len(_SPACE.sub(" ", text).strip()) if text else 0 for _, text in page.events]
    kept = _keep(page, page.looks, holder, lengths)
    found = sum(length for (node, _), length in zip(page.events, lengths, strict=True) if kept[node])
    if found < SHORT_TEXT:
        looks = _most_prose(page, lengths, kept, found)
        if looks != page.looks:
            kept = _keep(page, looks, holder, lengths)
    blocks, current = [], []
    for node, text in [*page.events, (0, None)]:
        if text is None:
            block = _SPACE.sub(" ", "".join(current)).strip()
            if block:
                blocks.append(block)
            current = []
        elif kept[node]:
            current.append(text)
    return "\n".join(blocks)


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(id, url, text, n_chars) of each row. Null html gives an empty text.

    Nothing is cut off, and a page that can't be scored gives an empty text. Rows that repeat an id
    each give a row; null ids and urls stay null. Other columns are not read.
    """
    source = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html")
    )
    schema = T.StructType(
        [source.schema["id"], source.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = pa.array([main_text(x) if x else "" for x in batch["html"].to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch["id"], batch["url"], texts, pc.utf8_length(texts).cast(pa.int64())], names=schema.names
                )

    return source.mapInArrow(run, schema)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: its main text and the number of its code points."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumnRenamed("id", "page_id")

"""Main text of web pages by scoring the tree of elements.

Each paragraph gives points for its length and its commas: all of them to its parent, half to the
grandparent, a third to the next. A container's points are discounted by its link density, the share
of its text that stands in links. The best container is kept, and those of its siblings that score
well or are long paragraphs with few links. Where the best container lies in an article element, the
whole article is meant. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
and reader comments are taken out of the tree beforehand, by element, role and class. What holds the
article stays, whatever its class says, as does a form that holds most paragraphs of the page. Inside
an article, a class of comments counts only where the element is built like a list of comments.

The markup is read as browsers mend it: a paragraph ends where the next block begins, an end tag
without a start is passed over, open elements end with the one around them. Character references are
decoded, white space inside a block (a line break too) becomes one space, blocks are joined by an
empty line. A null or empty page gives an empty text, a page without any paragraph all the text that
was not taken out. Each page is judged alone; repeated rows and other columns have no influence.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanframe.llm.common import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page.
RAW = frozenset("script style noscript template svg math iframe object canvas textarea select title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
OUT_TAGS = frozenset("nav footer aside form dialog button menu head fieldset label".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words in a class or id that mark what is no article text.
OUT_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup paywall "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar widget widgets rail "
    "footer masthead header share sharing social related recommended recommendations teaser toolbar login search "
    "legal copyright disclaimer skip".split()
)
#: Words that name no thing of their own: ``ad-box`` is an ad, ``related-work`` is no list of related pages.
PLAIN_WORDS = frozenset(
    "area bar block bottom box btn button buttons col column container content desktop element fixed form group hidden "
    "home icon icons image img inner item items js label law left link links list logo mobile module outer page panel "
    "primary right row secondary section site slot small sticky text this tile title top unit us view wrap wrapper zone".split()
)
COMMENT_WORDS = frozenset("comment comments disqus respond reply replies discussion commentlist".split())
#: Beside a comment word in one name of a class these speak of a state of the page: comments-open.
STATE_WORDS = frozenset("open opened closed no not has have with without on off enabled disabled allowed status count".split())
#: Share of link text from which a part of an article with a doubtful name is taken for a list of links.
LINK_SHARE = 1 / 3
#: Code points of text directly in a div or cell that make it a paragraph.
PARAGRAPH_POINTS = 80
#: Elements that end when one of the second begins inside them.
ENDS = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option"]),
}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(
    r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b"
)
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE) for name in RAW}
_WORDS = re.compile(r"[a-z]+|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Page:
    """Elements in page order (a parent comes before its children) and the text between them."""

    def __init__(self, source: str):
        self.tags = ["#root"]
        self.parents = [0]
        self.marks = [""]
        #: (element, text) in page order; text None where a block begins or ends.
        self.events: list[tuple[int, str | None]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        open_ = [0]
        at = 0
        end = len(source)
        while at < end:
            m = _TAG.search(source, at)
            if m is None:
                self._text(open_[-1], source[at:])
                break
            if m.start() > at:
                self._text(open_[-1], source[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                if m[0].startswith("<![CDATA["):
                    self._text(open_[-1], m[0][9:].removesuffix("]]>"), decode=False)
                continue
            name = name.lower()
            if m[1] or m[4]:
                self._close(open_, name)
                continue
            if name in BLOCK:
                self._make_room(open_, name)
            node = len(self.tags)
            self.tags.append(name)
            self.parents.append(open_[-1])
            self.marks.append(m[3] or m[6] or "")
            if name in BLOCK:
                self.events.append((node, None))
            elif name == "br":
                self.events.append((open_[-1], " "))
            if name in RAW:
                stop = _RAW_END[name].search(source, at)
                at = stop.end() if stop else end
            elif name not in VOID:
                open_.append(node)

    def _text(self, node: int, text: str, decode: bool = True) -> None:
        self.events.append((node, html.unescape(text) if decode and "&" in text else text))

    def _make_room(self, open_: list[int], name: str) -> None:
        tags = self.tags
        for depth in range(len(open_) - 1, 0, -1):
            tag = tags[open_[depth]]
            if tag == "p" or name in HEADING and tag in HEADING:
                del open_[depth:]
                break
            if name in ENDS.get(tag, ()):
                del open_[depth:]
                if name in ("td", "th", "li", "dt", "dd"):
                    break
                continue
            if tag in BLOCK and (name not in HOLDS or tag in HOLDS[name] or tag not in ("tbody", "thead", "tfoot", "tr")):
                break

    def _close(self, open_: list[int], name: str) -> None:
        tags = self.tags
        for depth in range(len(open_) - 1, 0, -1):
            tag = tags[open_[depth]]
            if tag == name:
                if name in BLOCK:
                    self.events.append((open_[depth], None))
                del open_[depth:]
                return
            if name not in BLOCK and tag in BLOCK:
                return  # an inline end tag never ends a block
        if name == "br":
            self.events.append((open_[-1], " "))


def _attributes(mark: str) -> dict[str, str]:
    out = {}
    for name, a, b, c, bare in _ATTRIBUTE.findall(mark):
        out.setdefault((name or bare).lower(), html.unescape(a or b or c))
    return out


def _taken_out(page: Page) -> list[bool]:
    """For each element whether it, or one around it, is no part of an article."""
    n, tags, parents = len(page.tags), page.tags, page.parents
    comments = [_of_comments(mark) for mark in page.marks]  # what their class says, "" for others
    in_comments, nested = [False] * n, [False] * n
    for i in range(1, n):
        up = parents[i]
        in_comments[i] = in_comments[up] or bool(comments[up]) and tags[up] not in ("html", "body", "main", "article")
        nested[i] = nested[up] or tags[up] == "article"
    # Articles that are comments themselves: marked ones in an article, or those among comments where
    # the page has its article or, for marked ones, its heading elsewhere.
    free = {tags[i] for i in range(1, n) if tags[i] in ("article", "h1") and not in_comments[i] and not comments[i]}
    answer = [
        tags[i] == "article"
        and (nested[i] and bool(comments[i]) or in_comments[i] and (nested[i] or "article" in free or bool(comments[i]) and "h1" in free))
        for i in range(n)
    ]
    holds_article = [False] * n  # an article, a main element or a first heading lies inside
    holds_main = [False] * n  # the same; of headings only where the page has neither
    bare = not any(tags[i] == "main" or tags[i] == "article" and not answer[i] for i in range(1, n))
    lists = [False] * n  # an entry or a form of comments lies inside
    entries = Counter((parents[i], tags[i], comments[i]) for i in range(1, n) if comments[i])
    for i in range(n - 1, 0, -1):
        up, meant = parents[i], tags[i] == "main" or tags[i] == "article" and not answer[i]
        holds_article[up] |= not answer[i] and (holds_article[i] or meant or tags[i] == "h1")
        holds_main[up] |= not answer[i] and (holds_main[i] or meant or bare and tags[i] == "h1")
        lists[up] |= lists[i] or bool(comments[i]) or tags[i] in ("form", "textarea")
    paragraphs, mostly_links = _measured(page)
    most = [i > 0 and 2 * paragraphs[i] > paragraphs[0] for i in range(n)]
    out, in_article, in_text = [False] * n, [False] * n, [False] * n
    for i in range(1, n):
        up, tag = parents[i], tags[i]
        in_article[i] = in_article[up] or tag in ("article", "main")
        # Inside the part of the page that holds its text, whatever its name.
        in_text[i] = in_text[up] or in_article[up] or most[up] and tags[up] not in ("html", "body")
        if out[up]:
            out[i] = True
            continue
        holds = holds_article[i] or tag == "form" and most[i]
        if tag in RAW or tag in OUT_TAGS and not (tag == "form" and holds):
            out[i] = True
        elif tag == "header":
            out[i] = not in_article[i]
        mark = page.marks[i]
        if out[i] or not mark or "=" not in mark and "hidden" not in mark or tag in ("html", "body", "main", "a"):
            continue
        about = _attributes(mark)
        if "hidden" in about or about.get("aria-hidden") == "true" or _HIDDEN.search(about.get("style", "").lower()):
            out[i] = True
            continue
        if about.get("role", "").lower() in OUT_ROLES:
            out[i] = not (holds and about["role"].lower() == "form")
        if tag == "article":
            out[i] = out[i] or answer[i]
        elif comments[i] and not holds_main[i] and not (tag == "form" and most[i]):
            like_list = lists[i] or tag in ("ol", "ul", "li") or entries[up, tag, comments[i]] > 1
            out[i] = out[i] or like_list or not in_article[i]
        elif not holds:
            names = f"{about.get('class', '')} {about.get('id', '')}".lower().split()
            said = {_names_furniture(name) for name in names}
            if True in said:
                # What holds most of the text is no furniture, unless nothing else is said of it.
                out[i] = not (most[i] and len(names) > 1 and False in said)
            elif None in said and not most[i]:
                out[i] = not in_text[i] or mostly_links[i] or not paragraphs[i]
    return out


def _of_comments(mark: str) -> str:
    """The class (or id) if a name in them means comments, and not only whether there may be some."""
    if "=" not in mark:
        return ""
    about = _attributes(mark)
    names = f"{about.get('class', '')} {about.get('id', '')}".lower()
    said = (set(_WORDS.findall(name)) for name in names.split())
    if any(words & COMMENT_WORDS and not words & STATE_WORDS for words in said):
        return about.get("class") or about["id"]
    return ""


def _measured(page: Page) -> tuple[list[int], list[bool]]:
    """Paragraphs in each element, and whether an element is mostly links."""
    n, tags, parents = len(page.tags), page.tags, page.parents
    block_of, raw, linked = list(range(n)), [False] * n, [False] * n
    for i in range(1, n):
        raw[i] = raw[parents[i]] or tags[i] in RAW or tags[i] in OUT_TAGS and tags[i] != "form"
        linked[i] = linked[parents[i]] or tags[i] == "a"
        if tags[i] not in BLOCK:
            block_of[i] = block_of[parents[i]]
    size, text, links = [0] * n, [0] * n, [0] * n
    for node, said in page.events:
        if said is not None and not raw[node]:
            length = len(" ".join(said.split()))
            size[block_of[node]] += length
            text[node] += length
            links[node] += length * linked[node]
    inside = [
        int(size[i] > 0 and tags[i] == "p" or size[i] >= PARAGRAPH_POINTS and tags[i] not in HEADING) for i in range(n)
    ]
    for i in range(n - 1, 0, -1):
        up = parents[i]
        inside[up] += inside[i]
        text[up] += text[i]
        links[up] += links[i]
    return inside, [links[i] >= LINK_SHARE * text[i] for i in range(n)]


def _names_furniture(name: str) -> bool | None:
    """Whether a class or id speaks of something around an article; None if it may as well be its subject."""
    words = _WORDS.findall(name)
    if not OUT_WORDS.intersection(words):
        return False
    last = words[-1]
    return True if last in OUT_WORDS or last in PLAIN_WORDS or any(c.isdigit() for c in last) else None

def _blocks(page: Page, kept: list[bool]) -> list[str]:
    blocks, now = [], []
    for node, text in page.events:
        if not kept[node]:
            if text is None and now:
                blocks.append(" ".join("".join(now).split()))
                now = []
            continue
        if text is None:
            if now:
                blocks.append(" ".join("".join(now).split()))
                now = []
        else:
            now.append(text)
    if now:
        blocks.append(" ".join("".join(now).split()))
    return [b for b in blocks if b]


def main_text(source: str | None) -> str:
    """Blocks of the best container and its kept siblings, an empty line between them."""
    if not source:
        return ""
    page = Page(source)
    tags, parents = page.tags, page.parents
    n = len(tags)
    out = _taken_out(page)

    # Text that stands directly in the nearest block, and how much of it is in links.
    in_link = [False] * n
    block_of = list(range(n))
    for i in range(1, n):
        in_link[i] = in_link[parents[i]] or tags[i] == "a"
        if tags[i] not in BLOCK:
            block_of[i] = block_of[parents[i]]
    length, linked, commas = [0] * n, [0] * n, [0] * n
    for node, text in page.events:
        if text is None or out[node]:
            continue
        size = len(" ".join(text.split()))
        block = block_of[node]
        length[block] += size
        commas[block] += text.count(",") + text.count("、") + text.count("，")
        if in_link[node]:
            linked[block] += size

    points = [0.0] * n
    for i in range(1, n):
        if not length[i] or tags[i] in HEADING or tags[i] in ("body", "html"):
            continue
        own = (1 + commas[i] + min(length[i] / 100, 3)) * (1 - linked[i] / length[i])
        up, share = parents[i], 1.0
        for step in range(3):
            while up and tags[up] not in BLOCK:
                up = parents[up]
            if not up:
                break
            points[up] += own / (1, 2, 3)[step]
            up = parents[up]
    all_length, all_linked = length[:], linked[:]
    for i in range(n - 1, 0, -1):
        all_length[parents[i]] += all_length[i]
        all_linked[parents[i]] += all_linked[i]
    score = [
        points[i] * (1 - all_linked[i] / all_length[i]) if points[i] and all_length[i] and not out[i] else 0.0
        for i in range(n)
    ]
    best = max(range(n), key=lambda i: (score[i], -i))
    if score[best] <= 0:
        return "\n\n".join(_blocks(page, [not x for x in out]))

    around, article = best, None
    while around:
        if tags[around] == "article":
            article = around
            break
        around = parents[around]
    chosen = {best if article is None else article}
    root = next(iter(chosen))
    if article is None and tags[root] not in ("body", "html"):
        least = max(10.0, 0.2 * score[root])
        for i in range(1, n):
            if parents[i] != parents[root] or i == root or out[i]:
                continue
            free = 1 - all_linked[i] / all_length[i] if all_length[i] else 0
            if score[i] >= least or tags[i] == "p" and all_length[i] > 80 and free > 0.75:
                chosen.add(i)
            elif tags[i] in HEADING and i < root:
                chosen.add(i)
    kept = [False] * n
    for i in range(1, n):
        kept[i] = not out[i] and (kept[parents[i]] or i in chosen)
    return "\n\n".join(_blocks(page, kept))


def _main_texts(pages: pd.Series) -> pd.Series:
    return pd.Series([main_text(p) for p in pages], dtype=object)


def extract(pages: DataFrame, column: str = "html", name: str = "text") -> DataFrame:
    """All columns of ``pages`` and the main text of ``column``."""
    return pages.withColumn(name, F.pandas_udf(_main_texts, "string")(F.col(column)))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page and its code points."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


QUERIES = {"op9_html_extract": op9_html_extract}
ORACLE: dict[str, str] = {}

"""Main text of web pages by two passes of block rules.

A page falls into blocks at its block-level tags. The first pass looks at each block alone: link density, length, density of stop
words, whether it is made of sentences, and what its containers are (menus, forms, adverts and the like are never text). It decides good, bad, or
leaves a block open. In the second pass open blocks take the label of the nearest decided neighbours; in a declared article, where they
have none that differ, they are text. Where no block of a page has stop words, as in languages not listed, length and link density decide.

Names of classes are hints: they never rule out an article or what holds one, and a page of which they leave nothing is read without them.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of common Latin-script languages.
STOP_WORDS = frozenset(
    """the of and to in a is that for it on was as with be by at this from are or an have not which but had
    der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach
    de la le les et des en un une du que est pour qui dans sur au par pas plus ce ne se il avec son
    el los las y del que se por con una para su al lo como más pero sus o
    di che il per non della sono da i gli alla het een van op te zijn""".split()
)
LINKS_MOST, SHORT, LONG, STOP_LOW, STOP_HIGH = 0.33, 70, 140, 0.15, 0.30

# A tag, comment or declaration. Attribute values in quotes may hold >.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<[!?][^>]*>", re.S)
# Elements without text: up to their end tag, and if there is none, to the end of the page (True) or only their tag (False).
_RAW = {"script": True, "style": True, "textarea": True, "title": True, "iframe": False, "noscript": False, "template": False, "object": False}
# Elements without text that block-level tags end too.
_PASSING = frozenset("svg math button select head".split())
_BLOCKS = frozenset(
    """p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table caption thead tbody tfoot tr td th section article main aside nav header footer
    blockquote pre figure figcaption hr address details summary body html form fieldset legend center option menu dialog""".split()
)
_CONTAINERS = frozenset("div section article main aside nav header footer ul ol dl table form fieldset figure menu dialog details address".split())
_NEVER = frozenset("nav aside footer form menu dialog fieldset".split())
_BODY = frozenset(("article", "main"))
#: Blocks that need no sentences to be text: items, cells, captions, code.
_LISTED = frozenset("li td th dt dd pre figcaption caption summary".split())
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
# Words of class names and ids that mark what is no main text, as a part between hyphens.
_BAD_PART = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertis\w*|banners?|sponsor\w*|promo\w*|cookies?|consent|gdpr|popups?|newsletter|subscri\w*|sign-?up|log-?in|nav|navbar|navigation|menus?|"
    r"breadcrumbs?|pagination|pager|sidebars?|comments|disqus|replies|footer|copyright|masthead|toolbar)(?=$|[\s_-])",
    re.I,
)
# The same for whole names only: as parts of longer names they also mark articles, such as tag-politics or search-result.
_BAD_WHOLE = re.compile(
    r"(?:^|\s)(?:notices?|alerts?|modal|overlay|toc|side|widgets?|related(?:-\w+)*|recommend\w*|share|sharing|social|comment|comment-body|respond|discussion|foot|legal|header|tags?|tag-?list|"
    r"hidden|search|search-?(?:box|form|bar)|complementary|contentinfo|dialog)(?=$|\s)",
    re.I,
)
_COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?|replies|reply|disqus|respond|discussion)(?=$|[\s_-])", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?:;…。！？؟।][\"'”’»)\]]*$")


class _Block:
    __slots__ = ("parts", "never", "article", "heading", "listed")

    def __init__(self, never: bool, article: int, tag: str):
        self.parts: list[tuple[str, bool]] = []
        self.never, self.article = never, article
        self.heading, self.listed = tag[:1] == "h" and tag[1:].isdigit(), tag in _LISTED

    def text(self) -> str:
        return " ".join("".join(t for t, _ in self.parts).split())

    def link_density(self) -> float:
        return sum(len(t) for t, in_link in self.parts if in_link) / max(1, sum(len(t) for t, _ in self.parts))


def _attributes(raw: str) -> dict[str, str]:
    return {name.lower(): value.strip("\"'") for name, value in _ATTRIBUTE.findall(raw)}


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I) is not None


def blocks(page: str, by_name: bool = True) -> list[_Block]:
    """The page's non-empty blocks in order. article: number of the declared article it is in, 0 for none. by_name: class names and forms count."""
    out: list[_Block] = []
    stack: list[str] = []  # open containers
    open_of: Counter[str] = Counter()
    # Of the open containers those whose text never counts: place on the stack, and whether for good reason; how many for good reason.
    bads: list[tuple[int, bool]] = []
    sure_bad = 0
    articles: list[int] = []
    endless: set[str] = set()  # raw elements without an end tag from here on
    count, links, at = 0, 0, 0
    passing = ""  # open element without text
    now = _Block(False, 0, "")

    def close(tag: str = "") -> None:
        nonlocal now
        if now.parts and any(not t.isspace() for t, _ in now.parts):
            out.append(now)
        now = _Block(bool(bads), articles[-1] if articles else 0, tag)

    def add(raw: str) -> None:
        if raw and not passing:
            now.parts.append((entities.unescape(raw), links > 0))

    while m := _TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        closing, raw = bool(m[1]), m[3] or ""
        if not name:
            continue
        if name in _RAW and not closing and not raw.endswith("/"):
            end = None if name in endless else re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if end:
                at = end.end()
            elif _RAW[name]:
                at = len(page)
            else:
                endless.add(name)
            add(" ")
            continue
        if name in _PASSING:
            if closing:
                passing = "" if passing == name else passing
            elif not raw.endswith("/") and not passing:
                add(" ")
                passing = name
        elif passing and name in _BLOCKS and name != "option":
            passing = ""
        if name in ("br", "wbr"):
            add(" " if name == "br" else "")
        elif name == "a":
            links = 0 if closing else 1
        if name not in _BLOCKS:
            continue
        links = 0
        hide = False
        if name in _CONTAINERS and closing:
            while open_of[name]:  # an end tag ends what it has a beginning of, and all that is open within
                tag = stack.pop()
                open_of[tag] -= 1
                if bads and bads[-1][0] == len(stack):
                    sure_bad -= bads.pop()[1]
                if tag in _BODY and articles:
                    articles.pop()
                if tag == name:
                    break
        elif name in _CONTAINERS:
            attributes = _attributes(raw)
            hint = " ".join(attributes.get(k, "") for k in ("class", "id", "role", "aria-label"))
            hide = _hidden(attributes)
            named = by_name and bool(hint.strip()) and bool(_BAD_PART.search(hint) or _BAD_WHOLE.search(hint))
            sure = hide or name in _NEVER and name != "form" or bool(_COMMENT.search(hint))
            if name in _BODY:
                # An article is ruled out by what it is in, or as a reader's comment within another one, not by a name of its own.
                bad = hide or bool(articles) and bool(_COMMENT.search(attributes.get("class", "")))
                if not bad and not sure_bad:
                    bads.clear()  # what holds an article is neither advert nor form
                count += 1
                articles.append(count if not articles else articles[-1])
            else:
                bad = hide or named or name in _NEVER and (by_name or name != "form") or name == "header" and not articles
            if bad:
                bads.append((len(stack), bool(sure)))
                sure_bad += bool(sure)
            stack.append(name)
            open_of[name] += 1
        elif name == "p" and not closing:
            hide = _hidden(_attributes(raw))
        close("" if closing else name)
        now.never |= hide
    add(page[at:])
    close()
    return out


def speaks(texts: list[str]) -> bool:
    """Whether any block has stop words as a text of a listed language has."""
    return any(len(t) >= SHORT and _stops(t) >= STOP_LOW for t in texts)


def _stops(text: str) -> float:
    found = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in found) / max(1, len(found))


def first_pass(block: _Block, text: str, known: bool) -> str:
    """good, bad, short (open for its length) or near (open for its words). known: stop words tell on this page."""
    if block.never:
        return "bad"
    size, links = len(text), block.link_density()
    if links > LINKS_MOST:
        return "bad"
    if block.heading or size < SHORT:
        return "short" if block.article or not links and "©" not in text else "bad"
    if not known:
        return "good" if size > LONG else "near"
    stops = _stops(text)
    if stops >= STOP_HIGH:
        return "good" if size > LONG else "near"
    if stops >= STOP_LOW:
        return "near"
    return "near" if block.article and (not links or block.listed or _SENTENCE.search(text)) else "bad"


def second_pass(kept: list[_Block], labels: list[str]) -> list[bool]:
    """Whether each block is main text: open ones as their nearest decided neighbours on both sides."""

    def nearest(order: list[int]) -> list[str]:
        out, last = [""] * len(kept), {0: ""}
        for k in order:
            article = kept[k].article
            out[k] = last.get(article, "")
            if labels[k] in ("good", "bad"):
                last[0] = labels[k]
                if not kept[k].never:  # menus and adverts in the middle of an article say nothing about it
                    last[article] = labels[k]
        return out

    before, after = nearest(list(range(len(kept)))), nearest(list(range(len(kept) - 1, -1, -1)))
    out = []
    for block, label, *sides in zip(kept, labels, before, after, strict=True):
        around = set(sides) - {""}
        if label in ("good", "bad"):
            out.append(label == "good")
        elif block.article:
            out.append(label == "near" or around != {"bad"})
        elif label == "near":
            out.append(around != {"bad"})
        else:
            out.append(around == {"good"} or block.heading and sides[1] == "good")
    return out


def main_text(page: str | None) -> str:
    """Main text of a page, blocks in order with a line break between; empty if there is none."""
    if not page:
        return ""
    for by_name in (True, False):
        found = [(b, t) for b in blocks(page, by_name) if (t := b.text())]
        if any(b.article and not b.never for b, _ in found):  # what lies outside a declared article is around it
            for b, _ in found:
                b.never |= not b.article
        kept = [b for b, _ in found]
        known = speaks([t for b, t in found if not b.never])
        chosen = second_pass(kept, [first_pass(b, t, known) for b, t in found])
        if any(chosen):
            return "\n".join(t for (_, t), good in zip(found, chosen, strict=True) if good)
    return ""


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row of pages. Null or empty html: empty text. Repeated rows are rows of their own. A very long page is read
    whole, in time proportional to it. Other columns of pages play no part. Empty table: no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col(html).alias("html"))
    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")

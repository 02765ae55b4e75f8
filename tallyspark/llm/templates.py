"""HTML extraction with site template removal.

A page becomes a tree of elements. Every block element's subtree has a hash; a host's pages are counted in Spark for
each hash, and a subtree that recurs on many of them belongs to the site's template and is deleted. Boxes, lists and
tables are also counted within each part of a host (the first step of the path), and go from a fixed number of pages on
however large the host is.

Left out beforehand is only what the standard itself calls no content (scripts, menus, forms, asides, headers and
footers outside an article, hidden elements, such roles) and what counting can't see because it differs from page to
page: adverts, reader comments, and boxes that are called furniture and consist of links. Other furniture by name (a
class, or a box's id, made of such words alone) goes by its name only on hosts of too few pages to count.

Where a page marks its main content (article, main), only that is taken, and its running text is never template: a
paragraph, list or table stays however often it recurs. Boxes (div, section ...) in it that recur across different
articles go. Articles count as main content only if they hold as much text outside links as the rest of the page.

Parsing takes time in proportion to the page's length, also for broken markup.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, carried, chunks, stored

#: A subtree is template from this many distinct pages of its host on, if they are this share of them or more.
LEAST_PAGES = 5
SHARE_OF_HOST = 0.05
#: A box, list or table is template from this many distinct pages of its host on, whatever their share.
MANY_PAGES = 1000

# Element names and words of the HTML standard and of common page furniture.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("head nav footer aside form script style noscript template iframe textarea title button select dialog menu object svg canvas audio video xmp".split())
MAIN = frozenset(["article", "main"])
BOX = frozenset("div section aside nav header footer form".split())
CELLS = frozenset("td th table".split())
WIDE = BOX | frozenset("ul ol dl table menu".split())
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]), "option": frozenset(["option"]), "optgroup": frozenset(["optgroup", "option"]),
    "tbody": frozenset(["thead", "tbody", "tr", "td", "th"]), "tfoot": frozenset(["thead", "tbody", "tr", "td", "th"]), "body": frozenset(["head"]),
}
ADVERTS = "ad|ads|advert|adverts|advertisement|advertisements|advertising|banner|sponsor|sponsored|promo"
COMMENTS = "comment|comments|disqus|replies"
WORD = (
    f"(?:{ADVERTS}|{COMMENTS}|cookie|cookies|consent|gdpr|notice|newsletter|subscribe|popup|modal|overlay|nav|navbar|navigation|menu|breadcrumb|breadcrumbs"
    "|sidebar|side-bar|widget|footer|masthead|topbar|related|recommended|share|sharing|social|login|signup|search|pagination|pager)"
)
#: What furniture's names add to its word; a name with any other part ("market-share") may be the content's own.
FRAMES = "area|bar|block|body|box|btn|button|buttons|container|content|footer|form|header|icons|inner|item|items|link|links|list|main|outer|panel|post|posts|row|section|site|thread|top|bottom|left|right|unit|wrap|wrapper|div|[0-9]+"


def _names(least: str, others: str = FRAMES) -> re.Pattern:
    """Names that have one of the words ``least`` and, beside these, only words of ``others``."""
    return re.compile(rf"(?=.*(?:^|[_-])(?:{least})(?:$|[_-]))(?:{least}|{others})(?:[_-]+(?:{least}|{others}))*", re.I)


NAMED = _names(WORD)
VARYING = _names(f"{ADVERTS}|{COMMENTS}", f"{FRAMES}|cookie|widget|sidebar")
TEASER = _names(f"{COMMENTS}|related|recommended|teaser|promo|sponsored|advert|ad", f"{FRAMES}|{WORD}")
COMMENT = _names(COMMENTS)
TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 hgroup p blockquote pre dl dt dd li figure figcaption table caption thead tbody tfoot tr td th center address details summary a b i em strong span code small sub sup".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
TAG_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
MARKS = re.compile("""[>"']""")
#: One attribute after the other, each from where the last one ended; a quote that isn't closed is an ordinary character.
ATTRIBUTE = re.compile(r"""[\s/>]++|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?""")
NO_DISPLAY = re.compile(r"(?:^|;)\s*+display\s*+:\s*+none\s*+(?:!|;|$)", re.I)
READ = frozenset("class id role hidden aria-hidden style".split())
_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


class Element:
    __slots__ = ("tag", "parts", "first", "dropped", "main", "link", "named", "chars", "free")

    def __init__(self, tag: str, first: int, dropped: bool, main: int, link: bool, named: bool, chars: int, free: int):
        self.tag, self.first, self.dropped, self.main, self.link, self.named, self.chars, self.free = tag, first, dropped, main, link, named, chars, free
        self.parts: list[bytes] = [tag.encode()]


def attributes_of(text: str) -> dict[str, str]:
    """The attributes that matter here by name, the first of each; a name is compared whole, values aren't searched."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        name = (m[1] or "").lower()
        if name in READ and name not in out:
            value = m[2] or ""
            if len(value) > 1 and value[0] in "\"'" and value[0] == value[-1]:
                value = value[1:-1]
            out[name] = html.unescape(value) if "&" in value else value
    return out


def _furniture(tag: str, attributes: str, in_main: bool) -> tuple[bool, bool]:
    """Whether an element is no content on any page, and whether it is called furniture."""
    if tag in DROPPED or (tag == "header" and not in_main):
        return True, False
    if not attributes or tag in ("html", "body"):
        return False, False
    named = False
    own = attributes_of(attributes)
    role = own.get("role", "").lower().split()
    if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or (role and role[0] in ROLES) or NO_DISPLAY.search(own.get("style", "")):
        return True, False
    for name in ("class", "id"):
        words = own.get(name, "").split()
        if not words or tag == "main":
            continue
        if tag == "article":
            if any(map(COMMENT.fullmatch if name == "id" else TEASER.fullmatch, words)):
                return True, False
            continue
        # The ids of headings, running text and sections are anchors named after the content, but for readers' comments.
        if name == "id" and (tag in TEXTUAL or (tag != "div" and in_main) or tag == "section"):
            if tag in WIDE and any(map(COMMENT.fullmatch, words)):
                return True, False
            continue
        if any(map(VARYING.fullmatch, words)):
            return True, False
        named = named or any(map(NAMED.fullmatch, words))
    return False, named


def _tag_ends(page: str) -> tuple[list[int], list[int]]:
    """Every ``>`` and quote of a page, and where a tag ends in whose attributes it is the next one, -1 for nowhere.

    A quote that isn't closed is an ordinary character.
    """
    found = [(m.start(), m[0]) for m in MARKS.finditer(page)]
    ends = [-1] * (len(found) + 1)
    following: dict[str, int] = {}
    for k in range(len(found) - 1, -1, -1):
        at, mark = found[k]
        if mark == ">":
            ends[k] = at
        else:
            ends[k] = ends[following.get(mark, k) + 1]
            following[mark] = k
    return [at for at, _ in found], ends


def parse(page: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int, int, bool, bool, int]]]:
    """(blocks, subtrees): blocks of text outside furniture, whether they are in an article (1) or main element (2), and
    their characters outside links; for each block element a signed 64-bit hash of its subtree, the blocks [first,
    last) in it, whether it may be deleted, whether it is a box, list or table, and whether it is called furniture
    (1) and consists of links (2)."""
    blocks: list[tuple[str, int, int]] = []
    trees: list[tuple[int, int, int, bool, bool, int]] = []
    stack = [Element("", 0, False, 0, False, False, 0, 0)]
    open_at: dict[str, list[int]] = {}  # where in the stack the elements of a name stand
    block_at: list[int] = []
    cell_at: list[int] = []
    line: list[str] = []
    free = all_free = all_chars = 0

    def flush() -> None:
        nonlocal free
        if line:
            text = " ".join("".join(line).split())
            line.clear()
            if text:
                blocks.append((text, stack[-1].main, free))
            free = 0

    def close(depth: int) -> None:
        while len(stack) > depth:
            e = stack[-1]
            block = e.tag in BLOCK
            if block:
                flush()
                block_at.pop()
            stack.pop()
            open_at[e.tag].pop()
            if e.tag in CELLS:
                cell_at.pop()
            h = xxhash.xxh3_64_intdigest(b"\0".join(e.parts))
            stack[-1].parts.append(h.to_bytes(8, "little"))
            if block and e.tag not in ("html", "body", "head"):
                named = int(e.named) and 1 + (2 * (all_free - e.free) < all_chars - e.chars)
                trees.append((h - (1 << 63), e.first, len(blocks), (e.tag in BOX or not e.main) and e.tag not in MAIN, e.tag in WIDE, named))

    def text(raw: str) -> None:
        nonlocal free, all_free, all_chars
        if not raw:
            return
        bare = raw.strip()
        stack[-1].parts.append(bare.encode("utf-8", "surrogatepass"))
        if not stack[-1].dropped:
            line.append(html.unescape(raw) if "&" in raw else raw)
            all_chars += len(bare)
            if not stack[-1].link:
                all_free += len(bare)
                free += len(bare)

    at, n = 0, len(page)
    last_end = page.rfind(">")
    ends: tuple[list[int], list[int]] | None = None
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m[2] is not None:
            if ends is None:
                rest = TAG_REST.match(page, m.end())
                stop = rest.end() if rest else -1
                if rest is None:
                    ends = _tag_ends(page)
            if ends is not None:
                found = ends[1][bisect_left(ends[0], m.end())]
                stop = (found if found >= 0 or m.end() > last_end else page.find(">", m.end())) + 1
            if not stop:  # nothing ends this tag, so it is text
                text(page[at : m.end()])
                at = m.end()
                continue
        text(page[at : m.start()])
        if m[2] is None:
            at = m.end()
            if m[0].startswith("<![CDATA["):
                text(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        attributes, at = page[m.end() : stop - 1], stop
        tag = m[2].lower()
        if m[1]:
            places = open_at.get(tag)
            if places and (tag in BLOCK or not cell_at or cell_at[-1] < places[-1]):
                close(places[-1])
            elif tag in BLOCK:
                flush()
            continue
        if tag in BLOCK:
            flush()
            shut = CLOSES.get(tag, frozenset())
            while block_at and (stack[block_at[-1]].tag in shut or stack[block_at[-1]].tag == "p"):
                close(block_at[-1])
        elif tag == "br":
            line.append(" ")
        top = stack[-1]
        if tag in VOID:
            top.parts.append(tag.encode())
            continue
        dropped, named = (True, False) if top.dropped else _furniture(tag, attributes, top.main > 0)
        open_at.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            block_at.append(len(stack))
        if tag in CELLS:
            cell_at.append(len(stack))
        stack.append(Element(tag, len(blocks), dropped, max(top.main, 2 if tag == "main" else int(tag == "article")), top.link or tag == "a", named, all_chars, all_free))
        if tag in RAW:
            end = _END[tag].search(page, at)
            stop = end.start() if end else n
            text(page[at:stop])
            at = stop
    close(1)
    flush()
    return blocks, trees


def merged(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges [first, last) in order, those that meet as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def left(items: list, ranges: Iterable[tuple[int, int]]) -> list:
    """The items outside all ranges."""
    out, at = [], 0
    for a, b in merged(ranges):
        out += items[at:a]
        at = max(at, b)
    return out + items[at:]


def main_blocks(page: str | None) -> tuple[list[str], list[tuple[int, int, int, bool, bool]]]:
    """The blocks that can be in the main text, and (hash, first, last, wide, named) of the subtrees that may be deleted."""
    blocks, trees = parse(page or "")
    # Furniture by name says nothing about where the main content is.
    sure = left(blocks, ((a, b) for *_, a, b, _, _, named in trees if named))
    inside = sum(n for _, m, n in sure if m)
    marked = any(m == 2 for _, m, _ in blocks) or (any(m for _, m, _ in sure) and 2 * inside >= sum(n for *_, n in sure))
    out = merged((a, b) for _, a, b, _, _, named in trees if named == 2)
    gone = np.zeros(len(blocks) + 1, bool)
    for a, b in out:
        gone[a:b] = True
    if marked:
        gone[:-1] |= np.array([m == 0 for _, m, _ in blocks], bool)
    place = (np.cumsum(~gone) - ~gone).tolist()
    return [x[0] for x, g in zip(blocks, gone) if not g], [(h, place[a], place[b], w, named > 0) for h, a, b, d, w, named in trees if d or named]


def alone(page: str | None) -> list[str]:
    """The main text's blocks where the host has too few pages to count: furniture goes by its name."""
    blocks, trees = main_blocks(page)
    return left(blocks, ((a, b) for _, a, b, _, named in trees if named))


def subtrees(pages: DataFrame, html_column: str, carry: list[str]) -> DataFrame:
    """Carried columns with the page's deletable subtrees and a key of its text."""
    names, ddl = carried(pages, carry, ("trees", "page_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("hash", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("wide", pa.bool_()), ("named", pa.bool_())]))
        for whole in batches:
            for batch in chunks(whole, html_column):
                trees, keys = [], []
                for t in batch.column(html_column).to_pylist():
                    blocks, found = main_blocks(t)
                    trees.append([dict(zip(("hash", "first", "last", "wide", "named"), x)) for x in found])
                    keys.append(xxhash.xxh3_64_intdigest("\n".join(blocks).encode("utf-8", "surrogatepass")) - (1 << 63))
                yield batch_of(batch, names, trees=pa.array(trees, kind), page_key=pa.array(keys, pa.int64()))

    form = "trees array<struct<hash: long, first: int, last: int, wide: boolean, named: boolean>>, page_key long"
    return pages.select(*dict.fromkeys([*names, html_column])).mapInArrow(run, f"{ddl}{form}")


def without(pages: DataFrame, html_column: str, cuts: str, carry: list[str]) -> DataFrame:
    """Carried columns with the page's main text; ``cuts`` has the ranges of blocks to leave out, null for none."""
    names, ddl = carried(pages, carry, ("text",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, html_column):
                texts = []
                for t, out in zip(batch.column(html_column).to_pylist(), batch.column(cuts).to_pylist()):
                    texts.append("\n".join(left(main_blocks(t)[0], ((c["first"], c["last"]) for c in out or ()))))
                yield batch_of(batch, names, text=pa.array(texts, pa.string()))

    return pages.select(*dict.fromkeys([*names, html_column, cuts])).mapInArrow(run, f"{ddl}text string")


def host_of(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def part_of(url) -> F.Column:
    """The first step of the path."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*/+([^/?#]*)/", 1)


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE_OF_HOST, many_pages: int = MANY_PAGES) -> DataFrame:
    """page_id, url, text: the main text of every page, its blocks joined by line breaks, without its site's template.

    Pages of equal main text count once, so copies of a page don't make its content template. A null or empty html
    has an empty text; a null url counts to the host of no name. Repeated rows each get their row; long pages are read
    whole; an empty table gives no row; columns but page_id, url and html are ignored, whatever their names.
    """
    pages = pages.select("page_id", "url", "html")
    # Pages of one url and html have one key: the same subtrees are cut from them.
    key = F.md5(F.concat_ws("\0", F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))).cast("binary"))
    rows = pages.select("html", host_of(F.col("url")).alias("host"), part_of(F.col("url")).alias("part"), key.alias("key"))
    rows = stored(subtrees(rows, "html", ["host", "part", "key"]), "subtrees")
    # A page of a host lies in one part or, as copies, in several; it counts once in each part and once in the host.
    seen = rows.select("host", "part", "page_key").distinct()
    tree = rows.select("host", "part", "page_key", F.explode("trees").alias("t")).select("host", "part", "page_key", "t.hash", "t.wide")

    def size(of: list[str]) -> DataFrame:
        return seen.select(*of, "page_key").distinct().groupBy(*of).agg(F.count("*").alias("pages"))

    def often(of: list[str], some: DataFrame, enough) -> DataFrame:
        n = some.select(*of, "page_key", "hash", "wide").distinct().groupBy(*of, "hash", "wide").agg(F.count("*").alias("n")).filter(F.col("n") >= least_pages)
        return n.join(size(of), of).filter(enough).select(*of, "hash")

    large = F.col("n") >= share * F.col("pages")
    # Only subtrees that still hold blocks can change a text. The ranges are stored, so their size is known before
    # the join with the pages is planned: few are broadcast, many are joined by key.
    placed = rows.select("key", "host", "part", F.explode("trees").alias("t")).filter("t.last > t.first").select("key", "host", "part", "t.*")
    cuts = placed.join(often(["host"], tree, large | (F.col("wide") & (F.col("n") >= many_pages))), ["host", "hash"])
    own = placed.filter("wide and part <> ''").join(often(["host", "part"], tree.filter("wide and part <> ''"), large), ["host", "part", "hash"])
    called = placed.filter("named").join(size(["host"]).filter(F.col("pages") < least_pages), "host")
    all_cuts = cuts.select("key", "first", "last").union(own.select("key", "first", "last")).union(called.select("key", "first", "last"))
    cut = stored(all_cuts.groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("cuts")), "cuts")
    return without(pages.withColumn("key", key).join(cut, "key", "left"), "html", "cuts", ["page_id", "url"])

"""HTML extraction by wrappers: union-free regular expressions inferred from a host's pages.

The pages of a host come from few templates. A wrapper is a union-free regular expression over
elements and texts, built by aligning one page after the other: where the child lists of two
elements agree, the children are aligned in turn; a child that only one side has becomes
optional; neighbours of one kind (or that alternate in a short period) become one repeated
group; texts that differ become slots, texts that never differ are part of the template.

The wrapper says where a host's pages differ in running text: from the root, the region of the
article is the child that holds most of the slot text that is no link, as long as one child
does. An article that a page marks (``article``, ``main``) is a hint: it is checked against that
region, and the region is taken where it holds far more text. Texts of the template are left
out of every page, at their place only; so are menus, headers, footers, sidebars, notices,
adverts, forms and comments, by element and by the words of class, id and role.

Marked and unmarked pages of a host are two templates, aligned apart and then with each other.
A text is of the template if it is on all pages and three of them differ in what they say, so
copies of one page lose nothing.

Pages are dealt to groups by host; a host of more than ``GROUP_BYTES`` is cut into groups by a
hash of the page, each of which infers a wrapper of its own, so no task ever holds a host.

Defined results: a null or empty page has the empty text; pages without host form a host;
pages of any depth are read without recursion (below ``DEPTH`` elements keep their text only);
repeated rows each get a result row; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmaforge.llm.batches import table
from firmaforge.session import cut

GROUP_BYTES = 1 << 18
DEPTH = 80
DOMINATES = 0.6

# Elements of HTML by what they mean here.
UNSEEN = "script style noscript template svg math iframe object canvas audio video textarea title".split()
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
LEFT_OUT = set("nav footer aside form head button select option datalist dialog menu fieldset input".split())
ENDS_P = set(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"},
    "tfoot": {"tbody", "tr", "td", "th"}, "body": {"head"},
}
BARRIER = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}}
NOT_ARTICLE = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner banners "
    "cookie cookies consent gdpr notice notices notification alert sidebar sidebars menu menus nav navbar navigation "
    "topnav subnav breadcrumb breadcrumbs footer masthead topbar comment comments commentlist reply replies respond "
    "discussion disqus share sharing social related recommended recommendations newsletter subscribe subscription "
    "signup popup modal overlay login search widget widgets toolbar pagination pager skip".split()
)
LAYOUT = set(
    "area bar bars block blocks body bottom box card cards col column columns container content contents desktop div "
    "element entry first fixed float form global group head header heading holder id in inner item items js last left "
    "line link links list main mobile module modules nested outer overlay page panel part placeholder policy post posts "
    "primary rail region right root row section secondary shell site slot slots small stack static sticky story strip "
    "tag tags text thread title top tree unit ui view wide wrap wrapper zone".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = set("navigation banner complementary contentinfo search dialog alert menu menubar form".split())

_DROP = re.compile(rf"<({'|'.join(UNSEEN)})\b(?>[^>]*)>.*?(?:</\1\s*>|\Z)", re.DOTALL | re.IGNORECASE)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>", re.DOTALL)
_TOKEN = re.compile(
    # A quote opens a value only after "="; elsewhere it is a character like others.
    r"<(/?)([A-Za-z][A-Za-z0-9:-]*)((?>(?:[^<>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')?)*+)|[^<>]*)>|([^<]+|<)"
)
_ATTR = re.compile(r"([^\s=\"'/<>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@lru_cache(20_000)
def says_chrome(name: str) -> bool:
    """Whether a class or id names a part that is no article.

    One of its words must, and the others may only say how it is laid out: "site-footer" and
    "comment-list" do, "ad-hoc", "market-share" and "comments-on-method" don't.
    """
    words = {w.lower() for w in _WORD.findall(name)}
    return bool(words & NOT_ARTICLE) and all(w in NOT_ARTICLE or w in LAYOUT or w.isdigit() for w in words)


class Element:
    __slots__ = ("tag", "key", "out", "by_name", "article", "children")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.children = tag, []
        found = {}
        for m in _ATTR.finditer(attrs) if attrs.strip() else ():
            # The first of attributes of one name counts.
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        named = found.get("class", "").split()
        self.key = tag + "".join(f".{c}" for c in named[:1])
        # The id of a heading names its subject.
        names = named if tag in HEADINGS else (*named, found.get("id", ""))
        role = found.get("role", "").lower()
        self.article = tag in ("article", "main") or role in ("main", "article") or "articleBody" in found.get("itemprop", "")
        free = tag not in ("html", "body", "#page")
        self.by_name = free and any(map(says_chrome, names))
        self.out = tag in LEFT_OUT or (
            free
            and (
                self.by_name
                or role in ROLES
                or "hidden" in found
                or "hidden" in named
                or found.get("aria-hidden", "").lower() == "true"
                or "display:none" in found.get("style", "").replace(" ", "").lower()
            )
        )


def parse(page: str) -> Element:
    """The tree of a page; end tags that were left out are put in, stray ones are ignored."""
    root = Element("#page", "")
    stack = [root]
    page = _COMMENT.sub(" ", _DROP.sub(" ", page))
    for m in _TOKEN.finditer(page):
        if m[4] is not None:
            stack[-1].children.append(html.unescape(m[4]))
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in VOID:
            stack[-1].children.append(Element(tag, ""))
            continue
        # An element that the new one ends, with the inline elements left open in it.
        ends, stop = ({"p"} if tag in ENDS_P else CLOSES.get(tag, set())), BARRIER.get(tag, {"table", "ul", "ol", "dl"})
        cut_at = None
        for i in range(len(stack) - 1, 0, -1):
            name = stack[i].tag
            if name in ends:
                cut_at = i
                if tag not in ("tr", "tbody", "tfoot", "thead"):
                    break
            elif name not in INLINE and (name in stop or cut_at is None and tag in ENDS_P or name not in ends and cut_at is not None):
                break
        if cut_at is not None:
            del stack[cut_at:]
        new = Element(tag, m[3])
        if new.article or tag == "h1":
            # What holds the article is no sidebar, whatever its name says ("with-sidebar").
            for above in stack:
                if above.by_name and above.tag not in LEFT_OUT:
                    above.out = False
        stack[-1].children.append(new)
        if not m[3].endswith("/") and len(stack) < 4000:
            stack.append(new)
    return root


def texts(element: Element, skip: bool = True) -> Iterator[tuple[str, bool]]:
    """(text, in a link) below an element, without what is left out; no recursion."""
    stack = [(iter(element.children), False)]
    while stack:
        children, link = stack[-1]
        for c in children:
            if isinstance(c, str):
                yield c, link
            elif not (skip and c.out):
                stack.append((iter(c.children), link or c.tag == "a"))
                break
        else:
            stack.pop()


# Wrappers


class Wrapper:
    """One element of the expression: its items in order."""

    __slots__ = ("key", "out", "items", "optional", "repeated", "value", "seen", "mass", "link_mass")

    def __init__(self, key: str, out: bool = False):
        self.key, self.out = key, out
        self.items: list[Wrapper] = []
        self.optional = self.repeated = False
        self.value: str | None = None  # of a text that never differs
        self.seen = 1  # pages
        self.mass = self.link_mass = 0

    def __str__(self) -> str:
        if self.key == "#":
            body = "#" if self.value is None else repr(self.value)
        else:
            body = f"<{self.key}>" + " ".join(map(str, self.items)) + f"</{self.key}>"
        return f"({body})+" if self.repeated else f"({body})?" if self.optional else body


def _period(items: list[Wrapper], i: int) -> int:
    """Length of the shortest group (up to three items) that repeats at once from item i on."""
    for n in (1, 2, 3):
        a, b = items[i : i + n], items[i + n : i + 2 * n]
        if len(b) == n and all(x.key == y.key != "#" for x, y in zip(a, b, strict=True)):
            return n
    return 0


def collapse(items: list[Wrapper]) -> list[Wrapper]:
    """Repeated neighbours as one item, which is aligned from all of them."""
    out, i = [], 0
    while i < len(items):
        n = _period(items, i)
        if not n:
            out.append(items[i])
            i += 1
            continue
        group = items[i : i + n]
        i += n
        while len(items) - i >= n and all(x.key == y.key for x, y in zip(group, items[i : i + n], strict=True)):
            group = [align(x, y, same=True) for x, y in zip(group, items[i : i + n], strict=True)]
            i += n
        for g in group:
            g.repeated = True
        out += group
    return out


def of_element(element: Element, depth: int = 0, link: bool = False) -> Wrapper:
    """The wrapper of one element of one page."""
    w = Wrapper(element.key, element.out)
    parts: list = []
    text, in_link, solid = [], 0, 0

    def flush():
        nonlocal in_link, solid
        whole = " ".join("".join(text).split())
        if whole:
            t = Wrapper("#")
            t.value, t.mass, t.link_mass = whole, len(whole), len(whole) if in_link > solid else 0
            parts.append(t)
        text.clear()
        in_link = solid = 0

    def take(s, linked):
        nonlocal in_link, solid
        text.append(s)
        if linked:
            in_link += len(s)
        else:
            solid += len(s)

    for c in element.children:
        if isinstance(c, str):
            take(c, link)
        elif (c.tag in INLINE or c.tag in VOID) and not c.out:
            if any(not isinstance(x, str) and x.tag not in INLINE and x.tag not in VOID for x in c.children) and depth < DEPTH:
                flush()
                parts += of_element(c, depth + 1, link or c.tag == "a").items
            else:
                for s, linked in texts(c):
                    take(s, link or linked or c.tag == "a")
        elif depth >= DEPTH:
            for s, linked in texts(c):
                take(s, link or linked)
        else:
            flush()
            parts.append(of_element(c, depth + 1, link))
    flush()
    w.items = collapse(parts)
    w.mass, w.link_mass = sum(x.mass for x in w.items), sum(x.link_mass for x in w.items)
    return w


def _common(a: list[Wrapper], b: list[Wrapper]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of keys, exact at any length.

    A row of the table of lengths is one number: bit k is zero where the common length of the
    last k + 1 items of ``b`` exceeds that of the last k, so n by m items take n * m / 8 bytes.
    """
    n, m = len(a), len(b)
    places: dict[str, int] = {}
    for k, x in enumerate(reversed(b)):
        places[x.key] = places.get(x.key, 0) | 1 << k
    full = (1 << m) - 1
    rows = [full]
    for x in reversed(a):
        v = rows[-1]
        hit = v & places.get(x.key, 0)
        rows.append(((v + hit) | (v - hit)) & full)

    def length(i: int, j: int) -> int:
        """Of what is left behind place i of ``a`` and j of ``b``."""
        k = m - j
        return k - (rows[n - i] & ((1 << k) - 1)).bit_count()

    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i].key == b[j].key:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif length(i + 1, j) >= length(i, j + 1):
            i += 1
        else:
            j += 1
    return out


def align(a: Wrapper, b: Wrapper, same: bool = False) -> Wrapper:
    """One expression for what two match; both have one key. same: they may be of one page."""
    a.out = a.out or b.out
    a.optional, a.repeated = a.optional or b.optional, a.repeated or b.repeated
    a.seen = max(a.seen, b.seen) if same else a.seen + b.seen
    a.mass += b.mass
    a.link_mass += b.link_mass
    if a.key == "#":
        a.value = a.value if a.value == b.value else None
        return a
    if [x.key for x in a.items] == [x.key for x in b.items]:
        pairs = [(i, i) for i in range(len(a.items))]
    else:
        pairs = _common(a.items, b.items)
    items, i, j = [], 0, 0
    for x, y in [*pairs, (len(a.items), len(b.items))]:
        for lone in (*a.items[i:x], *b.items[j:y]):
            lone.optional = True
            items.append(lone)
        if x < len(a.items):
            items.append(align(a.items[x], b.items[y], same))
        i, j = x + 1, y + 1
    a.items = collapse(items) if len(items) != len(pairs) else items
    return a


def infer(pages: list[Element]) -> Wrapper | None:
    """The wrapper of some pages, aligned one after the other."""
    wrapper = None
    for page in pages:
        new = of_element(page)
        wrapper = new if wrapper is None else align(wrapper, new)
    return wrapper


def region(wrapper: Wrapper) -> list[str]:
    """Keys from the root to the item that holds the running text."""
    path, at = [], wrapper
    running = lambda w: 0 if w.out else w.mass - w.link_mass - sum(_left_out(x) for x in w.items)
    while True:
        kids = [x for x in at.items if x.key != "#" and not x.out and not x.repeated]
        top = max(kids, key=running, default=None)
        total = sum(max(0, running(x)) for x in at.items if not x.out)
        if top is None or running(top) < DOMINATES * total or running(top) <= 0 or not any(x.key != "#" for x in top.items):
            return path
        path.append(top.key)
        at = top


def _left_out(w: Wrapper) -> int:
    """Running text of the left-out items below a wrapper."""
    if w.out:
        return w.mass - w.link_mass
    return sum(_left_out(x) for x in w.items)


def constants(wrapper: Wrapper, pages: int) -> set[tuple[tuple[str, ...], str]]:
    """(place, text) of the template: on every one of three pages or more, at one place, never different."""
    found, stack = set(), [(wrapper, ())]
    while stack:
        w, place = stack.pop()
        if w.key == "#" and w.value is not None and w.seen >= max(3, pages) and not w.optional and not w.repeated:
            found.add((place, w.value))
        stack += [(x, place if x.key == "#" else (*place, x.key)) for x in w.items]
    return found


# Texts


def _length(element: Element) -> int:
    return sum(len(s) for s, link in texts(element) if not link)


def marked(page: Element) -> Element | None:
    """The article that a page marks: the innermost marked element that holds most text."""
    best, at = None, page
    while True:
        found, stack = [], list(at.children)
        while stack:
            c = stack.pop()
            if isinstance(c, str) or c.out:
                continue
            if c.article:
                found.append(c)
            else:
                stack += c.children
        if not found:
            return best
        top = max(reversed(found), key=_length)
        if best is not None and _length(top) < 0.5 * _length(best):
            return best
        best = at = top


def locate(page: Element, path: list[str]) -> Element:
    """Follow a wrapper's region in a page as far as it goes."""
    at = page
    for key in path:
        found = [c for c in at.children if not isinstance(c, str) and c.key == key]
        if not found:
            return at
        at = max(found, key=_length) if len(found) > 1 else found[0]
    return at


def trail(page: Element, element: Element) -> list[Element]:
    """The elements from a page to one below it, both included."""
    above, stack = [page], [iter(page.children)]
    while above[-1] is not element:
        for c in stack[-1]:
            if not isinstance(c, str):
                above.append(c)
                stack.append(iter(c.children))
                break
        else:
            stack.pop()
            above.pop()
    return above


def blocks(page: Element, element: Element, template: set[tuple[tuple[str, ...], str]], inside: bool) -> list[str]:
    """Texts of the blocks below an element of a page in page order, without those of the template."""
    out, line, text = [], [], []
    place = [e.key for e in trail(page, element)[1:] if e.tag not in INLINE]

    def part():
        # A text as the wrapper sees it; <br> parts lines of it, cells are parts of a line.
        if text and not (template and (tuple(place[:DEPTH]), " ".join("".join(t or "" for t in text).split())) in template):
            line.extend(text)
        text.clear()

    def flush():
        part()
        run = []
        for t in (*line, None):
            if t is not None:
                run.append(t)
                continue
            if whole := " ".join("".join(run).split()):
                out.append(whole)
            run.clear()
        line.clear()

    stack = [(element, iter(element.children))]
    while stack:
        at, children = stack[-1]
        for c in children:
            if isinstance(c, str):
                text.append(c)
                continue
            if c.out or c.tag == "header" and not inside:
                flush()
                continue
            if c.tag in ("td", "th"):
                part()
                line.append(" ")
            elif c.tag in VOID:
                if c.tag not in INLINE and c.tag not in ("img", "input"):
                    text.append(None)
            elif c.tag not in INLINE:
                flush()
            if c.tag not in INLINE and c.tag not in VOID:
                place.append(c.key)
            stack.append((c, iter(c.children)))
            break
        else:
            if at.tag in ("td", "th"):
                part()
                line.append(" ")
            elif at.tag not in INLINE and at.tag not in VOID:
                flush()
            if at.tag not in INLINE and at.tag not in VOID and place:
                place.pop()
            stack.pop()
    flush()
    return out


def part_of(page: Element, article: Element | None, path: list[str], template: set) -> tuple[Element, bool]:
    """The element that holds the article, and whether the page marks it."""
    own = locate(page, path)
    if article is None or own is article:
        return own, article is not None
    size = lambda e, inside: sum(map(len, blocks(page, e, template, inside)))
    if own in trail(page, article):
        # No region, or the marked element holds its share of it.
        if not path or size(article, True) >= (1 - DOMINATES) * size(own, False):
            return article, True
        return own, False
    if article in trail(page, own) or size(article, True) >= size(own, False):
        return article, True
    return own, False


def extract(pages: list[str | None]) -> list[str]:
    """The main text of each of a group of pages of one host."""
    trees = [parse(p) if p else None for p in pages]
    articles = [marked(t) if t is not None else None for t in trees]
    path: dict[bool, list[str]] = {}
    fixed: dict[bool, set] = {}
    whole, n, said = None, 0, set()
    for kind in (True, False):
        own = [t for t, a in zip(trees, articles, strict=True) if t is not None and (a is not None) == kind]
        if not own:
            continue
        different = {"\n".join(blocks(t, t, set(), True)) for t in own}
        wrapper = infer(own)
        path[kind] = region(wrapper)
        fixed[kind] = constants(wrapper, len(own)) if len(different) >= 3 else set()
        whole = wrapper if whole is None else align(whole, wrapper)
        n += len(own)
        said |= different
    if len(path) == 2 and len(said) >= 3:
        both = constants(whole, n)
        fixed = {kind: known | both for kind, known in fixed.items()}
    out = []
    for tree, article in zip(trees, articles, strict=True):
        if tree is None:
            out.append("")
            continue
        kind = article is not None
        element, inside = part_of(tree, article, path[kind], fixed[kind])
        out.append("\n".join(blocks(tree, element, fixed[kind], inside)))
    return out


def host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def main_texts(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", group_bytes: int = GROUP_BYTES
) -> DataFrame:
    """Columns page_id, url, text, n_chars of every row of ``pages``."""
    rows = pages.select(
        F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{page}`").alias("html")
    ).withColumn("host", host(F.col("url")))
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("long") + 64
    # Only hosts of more than one group; written, so that the planner knows how few they are.
    large = cut(
        rows.groupBy("host").agg(F.ceil(F.sum(size) / group_bytes).cast("long").alias("groups")).filter("groups > 1")
    )
    part = F.pmod(F.xxhash64("page_id", "url", F.octet_length("html")), F.coalesce("groups", F.lit(1)))
    dealt = rows.join(large, "host", "left").select("host", part.alias("part"), "page_id", "url", "html")
    schema = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url")).schema

    def run(group: pa.Table) -> pa.Table:
        found = extract(group.column("html").to_pylist())
        return pa.table(
            {
                "page_id": group.column("page_id"),
                "url": group.column("url"),
                "text": pa.array(found, pa.string()),
                "n_chars": pa.array([len(t) for t in found], pa.int64()),
            }
        )

    schema = schema.add("text", "string").add("n_chars", "long")
    return dealt.groupBy("host", "part").applyInArrow(run, schema)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))

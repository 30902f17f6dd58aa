"""HTML extraction with a site style tree.

The whole DOMs of one host are merged into a tree: a node is the path of elements (tag, classes, id,
digits as 0; equal holders without attributes are told apart by their number) from the root. Over the m pages that have a node,
  its presentation importance is the entropy, base m, of its looks, a look being the sequence of elements
  that it holds on a page;
  its content importance is 1 minus the mean, over the distinct features of the text directly in it, of log_m of the
  number of pages with that feature (one on every page adds 0, one on a single page adds 1). Features
  are the words of blocks of up to SHORT words, and longer blocks as a whole.
A node's importance is the larger of the two, smoothed by PRIOR + pages / SPREAD further pages of
importance 1, so that few pages, of all or of a host, can't show that a node is a template: with these values one on
every page with one look and text goes (LOW) from 5 pages on, in an article (LOW_IN_ARTICLE) from 28; there is no
least number of pages. A branch's importance is the largest of its nodes: every branch under LOW (in an
article or main element LOW_IN_ARTICLE, if its name hints at another role LOW_HINTED) is removed from each page. Pages of one host
with the same text count once for each of their looks, so a site of copies is not taken for a template.

The tree also finds the body: the deepest holder, on half of a host's pages, of a share of its words outside
links, each counted with its node's importance; the share falls with the host's pages from 0.92 to BODY. A page's text is what its article and main elements hold, if outside them there
are at most twice as many words outside links; else (no such element, or only cards) what the body holds, with top headings; on
a page without that node all.

Elements that state their role have importance 0 on any host: nav, footer, aside, script, style
and the like, a header outside the article, hidden elements, and readers' comments (a class, id or role made of
the word comment and others, as comments-area, but for has-comments and its like). Outside an article, elements of which a whole class, the
id or the role names such a role (menu, sidebar, notice, advert and so on: ROLES and HEADERS; a number at its end doesn't
count, has-sidebar is no such name) go, and forms; but not if they hold an article or main element, or more than half of a
page's words outside links: no name empties a page. Inside an article only names of comments, adverts and other parts of a page that
can't be a subject (WIDGETS) do so, the others are hints to the tree; headings and paragraphs are never removed by name.

Character references are decoded, white space in a block becomes one space, and blocks are joined in
page order by one space. Tags are read in one scan that never goes back: a page of unclosed tags or
quotes costs what its length costs.

Defined cases: a null or empty page gives an empty text, an empty table no rows; elements that are never
closed end with the page, a tag without its > ends the page; a closing tag ends the innermost open element of its name; a null or unparsable url is a host of its
own name (''). A very long page is handled whole by one task; elements over DEPTH levels deep belong to
the node at that depth. Repeated rows are reported each. Extra columns, whatever their names, are not
read.

Scale: pass 1 sends hashes of nodes, looks and texts, added up before and after the shuffle; a host's
number of pages is that of its root. Pass 2 joins each host's list of removed branches to its pages. By
the smoothing each of them is on over a sixteenth of the host's pages, so a list is at most 16 times as
long as a page. The lists are counted, and at most BROADCAST_NODES nodes are broadcast, so that no page
is shuffled; beyond that each list is repeated under SALTS salts and pages are dealt by host and salt, so
that one host's pages spread over that many tasks.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, texts

LOW = 0.2
LOW_IN_ARTICLE = 0.05
#: For parts inside an article with a name that hints at another role.
LOW_HINTED = 0.6
#: Share of the words, by importance, that the body holds on a host of many pages; with BODY_PRIOR pages it is halfway to all.
BODY, BODY_PRIOR = 0.6, 4.0
#: A block of at most so many words is known by its words, a longer one as a whole.
SHORT = 12
PRIOR, SPREAD = 1.0, 64.0
DEPTH = 64
BROADCAST_NODES = 200_000
SALTS = 64
ROOT = 0

# Possessive throughout, so a failed match has read its characters once.
_TAG = re.compile(r"""<(/?+)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))?+|=)*+)>""")
_ATTR = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)))?+""")
_WANTED = re.compile(r"class|id|role|hidden|style", re.I)
_NUMBER = re.compile(r"[-_]?\d+$")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in "script style title textarea noscript template iframe noembed noframes xmp".split()}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
GONE = frozenset("nav footer aside script style title head menu button select option textarea noscript template iframe object svg canvas audio video dialog input datalist map".split())
#: Words of class, id or role that name a part which isn't the article.
ROLES = frozenset(
    "nav navbar navigation menu menubar sidebar side footer foot masthead banner ad ads advert adverts advertisement advertising sponsor sponsored promo promotion "
    "notice notices cookie cookies consent gdpr popup modal overlay alert newsletter subscribe subscription signup login share sharing social related recommended "
    "breadcrumb breadcrumbs pagination pager toolbar widget respond reply replies discussion search searchform copyright legal complementary contentinfo skip hidden".split()
)
HEADERS = frozenset(("header", "head", "topbar", "top"))
#: Of these, what can't be the subject of a part of an article; the others are hints there.
WIDGETS = frozenset("ad ads advert adverts advertisement advertising sponsored nav navbar menu menubar sidebar footer masthead navigation breadcrumb breadcrumbs pagination pager toolbar share newsletter subscribe signup gdpr cookie cookies".split())
#: Names of readers' comments; names that only say whether there are any are none of these.
_COMMENTS = re.compile(r"(?:[a-z0-9]+[-_])*?(?:comments?|commentlist|disqus)(?:[-_][a-z0-9]+)*")
_NO_COMMENTS = re.compile(r"(?:has|no|with|without|show|hide|enable|disable|allow)s?[-_].*|.*[-_](?:open|closed|enabled|disabled|on|off|free|count|link)")
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p".split())
#: Elements that can be the body of a page, and of which equal ones side by side are told apart by their number.
HOLDERS = frozenset("div section center form fieldset table tbody td ul ol main article body".split())
HEAD_TAGS = frozenset("base link meta noscript script style template title".split())
_CELL = frozenset(("td", "th", "tr", "tbody", "tfoot"))
#: An open element of the first kind ends where one of the second kind begins.
ENDS = {
    "p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li dt dd".split()) | _CELL,
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "tbody", "tfoot")), "td": _CELL, "th": _CELL, "option": frozenset(("option",)),
}


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if _WANTED.search(raw) else {}


def _gone(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether the element goes with all that it holds, whatever it holds."""
    if tag in GONE or tag == "header" and not inside:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    if tag not in PROSE and any(_COMMENTS.fullmatch(x) and not _NO_COMMENTS.fullmatch(x) for x in _names(attributes, "class", "id", "role")):
        return True
    return tag not in ("article", "main") and ("hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(_HIDDEN.search(attributes.get("style", ""))))


def _names(attributes: dict[str, str], *which: str) -> set[str]:
    return {_NUMBER.sub("", x) for w in which for x in attributes.get(w, "").lower().split()}


def _named(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether it is a form, or a whole class, the id or the role, less a number at its end, names a part that isn't the article."""
    if tag == "form":
        return True
    if not attributes or tag in ("html", "body", "article", "main") or inside and tag in PROSE:
        return False
    names = _names(attributes, "class", "role")
    return bool(names & WIDGETS) if inside else bool((names | _names(attributes, "id")) & (ROLES | HEADERS))


def _hinted(tag: str, attributes: dict[str, str]) -> bool:
    """Whether a name inside an article says that a part may not be of it; the tree decides."""
    return bool(attributes) and tag not in PROSE and bool(_names(attributes, "class", "role") & (ROLES | HEADERS))


def _style(tag: str, attributes: dict[str, str]) -> str:
    if not attributes:
        return tag
    named = " ".join(sorted(attributes.get("class", "").split())) + "#" + attributes.get("id", "")
    return tag + (re.sub(r"\d+", "0", "." + named) if len(named) > 1 else "") + ("@main" if attributes.get("role") == "main" else "")


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


class Element:
    """An element that isn't inline: its node and those above it (line: the root first, its own last), whether
    an article or main element holds it (inside), what it holds (kids), whether it goes in any case (gone), by its name unless
    it is spared (named, spared), or is a hint to the tree (hint), and its words outside links (free)."""

    __slots__ = ("tag", "above", "line", "inside", "gone", "named", "spared", "namer", "hint", "kids", "seen", "inline", "open", "free")

    def __init__(self, tag: str, above: Element | None, style: str):
        self.tag, self.above, self.kids, self.inline, self.open, self.seen, self.free = tag, above, [], [], {}, {}, 0
        self.inside, self.gone, self.named, self.spared, self.namer, self.hint = False, False, False, False, None, False
        if above is None:
            self.line = (ROOT,)
            return
        if tag in HOLDERS and style == tag:
            number = above.seen[tag] = above.seen.get(tag, 0) + 1
            style = f"{tag} {number}"
        self.line = (*above.line, _hash(f"{above.line[-1]} {style}")) if len(above.line) < DEPTH else above.line


def parse(page: str) -> tuple[list[Element], list[tuple[Element, str]]]:
    """The page's elements, each after the one that holds it, and its blocks of text, each with the element
    that it is directly in and its number of words outside links, both without what goes by a stated role."""
    top = Element("", None, "")
    elements, found, parts = [top], [], []
    opened: dict[str, int] = {}
    # Open inline elements of the innermost element, each with whether the text in it goes.
    at, n, mute, free = 0, len(page), False, 0

    def flush():
        nonlocal free
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                found.append((top, text, free))
            free = 0

    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            begin = n
        if begin > at and not mute:
            parts.append(page[at:begin])
            if not top.open.get("a"):
                free += len(parts[-1].split())
        if begin >= n - 1:
            if begin == n - 1 and not mute:
                parts.append("<")
            break
        after = page[begin + 1]
        letter = page[begin + 2 : begin + 3] if after == "/" else after
        if after in "!?" or after == "/" and not (letter.isascii() and letter.isalpha()):
            comment = page.startswith("<!--", begin)
            end = page.find("-->" if comment else ">", begin + 2)
            if end < 0:
                break
            at = end + (3 if comment else 1)
            continue
        if not (letter.isascii() and letter.isalpha()):
            if not mute:
                parts.append("<")
            at = begin + 1
            continue
        m = _TAG.match(page, begin)
        if m is None:  # no > to the end of the page
            break
        at = m.end()
        tag = m[2].lower()
        if tag in INLINE:
            inline = top.inline
            if m[1]:
                if top.open.get(tag):
                    last = None
                    while last != tag:
                        last = inline.pop()[0]
                        top.open[last] -= 1
                    mute = inline[-1][1] if inline else top.gone
                continue
            top.kids.append(tag)
            if tag not in VOID and not m[3].endswith("/"):
                attributes = _attributes(m[3])
                mute = mute or _gone(tag, attributes, top.inside) or _named(tag, attributes, top.inside)
                inline.append((tag, mute))
                top.open[tag] = top.open.get(tag, 0) + 1
            continue
        flush()
        if m[1]:
            if opened.get(tag, 0):
                while top.above is not None:
                    last = top
                    top = top.above
                    opened[last.tag] -= 1
                    if last.tag == tag:
                        break
                mute = top.inline[-1][1] if top.inline else top.gone
            continue
        if tag in RAW:
            close = RAW[tag].search(page, at)
            if close is None:
                break
            end = page.find(">", close.end())
            at = end + 1 if end >= 0 else n
            continue
        while top.above is not None and (tag in ENDS.get(top.tag, ()) or top.tag == "head" and tag not in HEAD_TAGS):
            opened[top.tag] -= 1
            top = top.above
            mute = top.inline[-1][1] if top.inline else top.gone
        if tag in VOID or m[3].endswith("/"):
            top.kids.append(tag)
            continue
        attributes = _attributes(m[3])
        style = _style(tag, attributes)
        top.kids.append(style)
        new = Element(tag, top, style)
        own = tag in ("article", "main") or attributes.get("role") == "main"
        new.inside = top.inside or own
        new.gone = mute or _gone(tag, attributes, new.inside)
        new.named = _named(tag, attributes, new.inside)
        new.hint = new.inside and _hinted(tag, attributes)
        new.namer = top if top.named else top.namer
        if own and not top.inside and not new.gone and not new.named:
            # The names around it don't remove it; where one is spared, those around that are too.
            other = new.namer
            while other is not None and not other.spared:
                other.spared = True
                other = other.namer
        elements.append(new)
        opened[tag] = opened.get(tag, 0) + 1
        top, mute = new, new.gone
    flush()
    if any(e.named for e in elements):
        _spare(elements, found)
    for e in elements[1:]:
        e.gone = e.gone or e.above.gone or e.named and not e.spared
    return [e for e in elements if not e.gone], [x for x in found if not x[0].gone]


def _spare(elements: list[Element], found: list[tuple[Element, str, int]]) -> None:
    """Names (and forms) that hold more than half of a page's words outside links don't remove them."""
    for e, _, free in found:
        if not e.gone:
            e.free += free
    for e in reversed(elements[1:]):
        if not e.gone:
            e.above.free += e.free
    half = elements[0].free / 2
    for e in elements:
        e.spared = e.spared or e.named and e.free > half


def chosen(page: str, drop: set[int], body: int | None = None) -> list[str]:
    """The blocks of text of the article without the branches of drop. The article is what article and main elements hold, if outside them
    there aren't more than twice as many words outside links; else what the node `body` holds and top headings, or the
    whole page if it has no such node."""
    elements, found = parse(page)
    low = {id(e) for e in elements if any(node in drop for node in e.line)} if drop else ()
    kept = [x for x in found if id(x[0]) not in low]
    inside = [x for x in kept if x[0].inside]
    words = sum(free for _, _, free in inside)
    if any(e.inside for e, _, _ in found) and 2 * words >= sum(free for e, _, free in kept if not e.inside):
        return [text for _, text, _ in inside]
    if body is not None and any(body in e.line for e, _, _ in kept):
        return [text for e, text, _ in kept if body in e.line or e.tag == "h1"]
    return [text for _, text, _ in kept]


def host(url_col: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def features(text: str) -> list[int]:
    """What a block of text is known by: its words if they are few, else the whole."""
    words = text.split()
    return [_hash(w) for w in set(words)] if len(words) <= SHORT else [_hash(text)]


def page_rows(page: str) -> list[tuple[int, int, tuple[int, ...], int, int]]:
    """page, kind, line, sort, value of each look (kind 1), each feature of a text (kind 0) and the words outside links (kind 2) of
    a page's nodes. sort: 1 inside an article, 2 a hint there, 4 an element that can be the body."""
    elements, found = parse(page)
    any_inside = any(e.inside for e, _, _ in found)
    key = _hash("\0".join(text for e, text, _ in found if e.inside or not any_inside))
    looks: dict[tuple[int, ...], list[str]] = {}
    sort, words = {}, {}
    for e in elements:
        sort.setdefault(e.line, e.inside + 2 * e.hint + 4 * (e.tag in HOLDERS))
        looks.setdefault(e.line, []).append(" ".join(e.kids))
    for e, _, free in found:
        words[e.line] = words.get(e.line, 0) + free
    rows = [(key, 1, line, sort[line], _hash("\0".join(x))) for line, x in looks.items()]
    rows += [(key, 2, line, sort[line], n) for line, n in words.items() if n]
    return rows + [(key, 0, line, sort[line], value) for line, value in {(e.line, v) for e, text, _ in found for v in features(text)}]


def nodes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, line (the nodes down to this one), sort, m (pages), words (outside links), importance (before smoothing) of the nodes of each host's tree."""
    narrow = pages.select(host(url_col).alias("host"), F.col(html_col).alias("html"))
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.int64())
    names = ["host", "page", "kind", "line", "sort", "value"]

    def run(batches):
        for batch in batches:
            sites = batch.column("host").to_pylist()
            for at in range(0, len(sites), 256):
                rows = [(site, *row) for site, text in zip(sites[at : at + 256], texts(batch.column("html").slice(at, 256)), strict=True) for row in page_rows(text.decode("utf-8", "replace"))]
                yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)], names=names)

    seen = narrow.mapInArrow(run, "host string, page long, kind int, line array<long>, sort int, value long").distinct()
    spread = seen.groupBy("host", "kind", "line", "sort", "value").agg(F.count("*").alias("d"))
    sums = spread.groupBy("host", "line").agg(
        F.min("sort").alias("sort"),
        F.coalesce(F.sum(F.when(F.col("kind") == 1, F.col("d"))), F.lit(0)).alias("m"),
        F.sum(F.when(F.col("kind") == 1, F.col("d") * F.ln("d"))).alias("looks"),
        F.avg(F.when(F.col("kind") == 0, F.ln("d"))).alias("reads"),
        F.coalesce(F.sum(F.when(F.col("kind") == 2, F.col("d") * F.col("value"))), F.lit(0)).alias("words"),
    )
    importance = F.when(F.col("m") < 2, 1.0).otherwise(F.greatest(1 - F.col("looks") / (F.col("m") * F.ln("m")), F.coalesce(1 - F.col("reads") / F.ln("m"), F.lit(0.0))))
    return sums.select("host", "line", "sort", "m", "words", importance.alias("importance"))


def site_choices(pages: DataFrame, url_col: str = "url", html_col: str = "html", low: float = LOW, low_in_article: float = LOW_IN_ARTICLE, low_hinted: float = LOW_HINTED, prior: float = PRIOR, spread: float = SPREAD) -> DataFrame:
    """host, nodes (the tops of the branches of low importance in its style tree), body (the deepest node that can be a page's
    body, is on half of the pages and holds a share of BODY or more of the words outside links, each counted with its node's importance)."""
    tree = cut(nodes(pages, url_col, html_col))
    # The root is on each of a host's pages.
    total = tree.where(F.size("line") == 1).select("host", F.col("m").alias("pages"), (prior + F.col("m") / spread).alias("k"))
    smooth = (F.col("m") * F.col("importance") + F.col("k")) / (F.col("m") + F.col("k"))
    # A node counts for every branch that it is in; a branch's own row says what it is in.
    own = F.element_at("line", -1)
    branches = tree.join(total, "host").select("host", "pages", F.explode("line").alias("top"), smooth.alias("importance"), "words", "sort", "m", F.size("line").alias("depth"), own.alias("node"), F.try_element_at("line", F.lit(-2)).alias("above"))
    self = F.col("node") == F.col("top")
    mass = F.sum(F.col("words") * F.col("importance"))
    scored = cut(branches.groupBy("host", "top").agg(mass.alias("mass"), F.max("importance").alias("importance"), F.any_value("pages").alias("pages"), *[F.max(F.when(self, F.col(c))).alias(c) for c in ("sort", "above", "m", "depth")]))
    bound = F.when(F.col("sort").bitwiseAND(2) > 0, low_hinted).when(F.col("sort").bitwiseAND(1) > 0, low_in_article).otherwise(low)
    poor = scored.where((F.col("importance") < bound) & F.col("above").isNotNull()).select("host", "top", "above")
    inner = poor.select(F.col("host").alias("h"), F.col("top").alias("t"))
    gone = poor.join(inner, (F.col("host") == F.col("h")) & (F.col("above") == F.col("t")), "left_anti").groupBy("host").agg(F.collect_list("top").alias("nodes"))
    root = scored.where(F.col("top") == ROOT).select("host", F.col("mass").alias("whole"))
    share = 1 - (1 - BODY) * F.col("pages") / (F.col("pages") + BODY_PRIOR)
    # Nodes of more than half of the mass lie in one line, so the deepest is one.
    heavy = scored.join(root, "host").where((F.col("mass") >= share * F.col("whole")) & (F.col("whole") > 0) & (F.col("sort").bitwiseAND(4) > 0) & (2 * F.col("m") >= F.col("pages")))
    body = heavy.groupBy("host").agg(F.max_by("top", F.struct("depth", "top")).alias("body"))
    return body.join(gone, "host", "full")


def _with_choices(narrow: DataFrame, choices: DataFrame, broadcast_nodes: int, salts: int) -> DataFrame:
    """narrow with nodes and body, the choices for its host."""
    choices = cut(choices)
    if (choices.agg(F.sum(F.coalesce(F.size("nodes"), F.lit(0)) + 2)).first()[0] or 0) <= broadcast_nodes:
        return narrow.join(F.broadcast(choices), "host", "left")
    salted = choices.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return narrow.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).join(salted, ["host", "salt"], "left")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_nodes: int = BROADCAST_NODES, salts: int = SALTS) -> DataFrame:
    """One row per page: id_col, url_col, text, n_chars."""
    narrow = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host(url_col).alias("host"))
    narrow = _with_choices(narrow, site_choices(pages, url_col, html_col), broadcast_nodes, salts).select("id", "url", "html", "nodes", "body")

    def run(batches):
        for batch in batches:
            told = zip(batch.column("nodes").to_pylist(), batch.column("body").to_pylist(), texts(batch.column("html")), strict=True)
            out = [" ".join(chosen(page.decode("utf-8", "replace"), set(gone or ()), body)) for gone, body, page in told]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(out, pa.string())], names=["id", "url", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, url string, text string").select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))

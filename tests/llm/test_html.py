"""HTML extraction against a brute-force style tree, ordinary markup and hostile markup."""

import html.parser
import math
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from strandline.llm import html_main as h
from strandline.llm.common import table

SCHEMA = "page_id long, url string, html string"


def text_of(page, drop=()):
    return " ".join(h.chosen(page, set(drop)))


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><h2 id='related-work'>Head</h2><p>Body.</p><section id='discussion'>Said</section></article>", "Head Body. Said"),
        ("<article><h2 id=search>Search</h2><section id=legal>Law</section><p class=share>On sharing</p></article>", "Search Law On sharing"),
        ("<p>one</p><p><a href=foo'bar>two</a></p><p>three's</p>", "one two three's"),
        ("<main><p>intro</p><article>teaser</article><p>rest</p></main>", "intro teaser rest"),
        ("<article>A</article><div>between</div><article>B</article>", "A B"),
        ("<head><title>t</title><body><p>no head end<p>next</body>", "no head end next"),
        ("a < b<br>c &lt;x&gt; &amp;amp; &#233; <!--> d <!-- gone --> e</é f>g", "a < b c <x> &amp; é d eg"),
        ("<p>x<script>'</p>' + 1</script>y<style>p{}</style> z</p>", "x y z"),
        ("<ul><li><p>1<li><p>2</ul><table><tr><td><p>3<td>4<tr><td>5</table>", "1 2 3 4 5"),
        ("<div hidden>no</div><p>yes<span style='display: none'>no</span> too</p>", "yes too"),
        ('<a href="x>y">in</a> <b title=">">out</b>', "in out"),
        ("<article></article><p>body</p>", "body"),
        ("", ""),
        # No name empties a page, and inside an article names are hints.
        ('<body><div class="top"><p>Text of a page.', "Text of a page."),
        ('<div class="legal">Law</div>', "Law"),
        ('<div id="search">Found</div>', "Found"),
        ('<div class="sidebar">a b</div><p>one two three four', "one two three four"),
        ('<article><p>a</p><section class="related">Related work text</section><div class="sharing">How it works</div><div class="side">s</div><div class="ad">no</div></article>', "a Related work text How it works s"),
        ('<article><p>a b</p><section class="comments-area">nice!</section><div class="comment-list">x</div><ol id="comments">y</ol></article>', "a b"),
        ('<body class="comments-open"><div class="has-comments"><p>T u v</p></div><div class="post-comments">no</div>', "T u v"),
        ("<body><form id=aspnetForm><div><p>Body text", "Body text"),
        ("<form><article>in form</article></form>", "in form"),
        ("<article><p>some text</p><form><p>Name</p><input></form></article>", "some text"),
        ('<div class="body"><p>Long lead outside.</p><article>card</article><p>More text', "Long lead outside. card More text"),
        ("<span hidden>x" + "<b>" * 70 + "</span>kept text", "kept text"),
    ],
)
def test_markup(page, want):
    assert text_of(page) == want


@pytest.mark.parametrize("page", ["<a " * 350_000, "<!--" * 250_000, "<div>" * 200_000, "<p><b>x" * 100_000, "<div>" * 80_000 + "</p>" * 80_000, "<a b='x>" * 120_001, "<" * 1_000_000, "<script>" * 120_000, "<i>" * 100_000 + "</b>" * 100_000, "<div class=ad>" * 70_000 + "<article>x", "<div class=ad><article></article></div>" * 20_000, '<a b="' * 99_999 + "'" * 99_999])
def test_unclosed_markup_takes_linear_time(page):
    def seconds(text):
        began = time.process_time()
        h.parse(text)
        return time.process_time() - began

    quarter = min(seconds(page[: len(page) // 4]) for _ in range(2))
    assert seconds(page) < max(2.0, 12 * quarter)


class Peer(html.parser.HTMLParser):
    """Text of a well-formed page's body by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.out = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag in ("nav", "script", "footer")
        if tag not in h.INLINE:
            self.out.append("")

    def handle_endtag(self, tag):
        if tag not in h.INLINE:
            self.out.append("")
        self.depth -= tag in ("nav", "script", "footer")

    def handle_data(self, data):
        if not self.depth:
            self.out[-1] += data


def made(draw, depth=0):
    tag = draw.choice(["div", "p", "nav", "b", "i", "h2", "footer", "script", "blockquote"])
    if tag == "script":
        return "<script>if (a < b) '<p>'</script>"
    inner = "".join(draw.choice(["word ", "&lt;é&amp;", " \n", "x"]) if depth > 3 or draw.random() < 0.5 else made(draw, depth + 1) for _ in range(draw.randrange(5)))
    if tag in ("p", "h2", "b", "i"):  # text only, or the page isn't well-formed
        inner = draw.choice(["one &copy; two", "  ", "3 < 4 "])
    return f'<{tag} title="a>b">{inner}</{tag}>'


def test_against_the_standard_parser():
    draw = random.Random(5)
    for _ in range(400):
        page = "".join(made(draw) for _ in range(4))
        peer = Peer()
        peer.feed(page)
        peer.close()
        assert text_of(page) == " ".join(" ".join(x.split()) for x in peer.out if x.split()), page


def brute_choices(rows):
    """The maximal branches of low importance and the body of each host, node by node, page by page."""
    sites = defaultdict(dict)
    for _, url, page in rows:
        elements, found = h.parse(page or "")
        looks, reads, sort, words = defaultdict(list), defaultdict(set), {}, defaultdict(int)
        for e in elements:
            looks[e.line].append(tuple(e.kids))
            sort.setdefault(e.line, (e.inside, e.hint, e.tag in h.HOLDERS))
        for e, text, free in found:
            words[e.line] += free
            reads[e.line] |= set(text.split()) if len(text.split()) <= h.SHORT else {(text,)}
        any_inside = any(e.inside for e, _, _ in found)
        key = tuple(text for e, text, _ in found if e.inside or not any_inside)
        at = sites[url.split("/")[2]].setdefault(key, defaultdict(lambda: (set(), set(), set())))
        for line, x in looks.items():
            at[line][0].add(tuple(x))
            at[line][1].update(reads[line])
            at[line][2].add(words[line])
        known = sites[url.split("/")[2]].setdefault("sort", {})
        for line, x in sort.items():
            known[line] = min(known.get(line, x), x, key=lambda t: t[0] + 2 * t[1] + 4 * t[2])
    out = {}
    for site, pages in sites.items():
        sort = pages.pop("sort")
        pairs = {line: [look for p in pages.values() for look in (p[line][0] if line in p else ())] for line in sort}
        n = len(pairs[(h.ROOT,)])
        k = h.PRIOR + n / h.SPREAD
        own, mass = {}, {}
        for line, looks in pairs.items():
            m = len(looks)
            imp = 1.0
            if m > 1:
                spread = [looks.count(x) for x in set(looks)]
                contents = [sum(line in p and t in p[line][1] for p in pages.values()) for t in {t for p in pages.values() if line in p for t in p[line][1]}]
                imp = max(-sum(c / m * math.log(c / m, m) for c in spread), 1 - sum(math.log(c, m) for c in contents) / len(contents) if contents else 0)
            own[line] = (m * imp + k) / (m + k)
            mass[line] = own[line] * sum(sum(p[line][2]) for p in pages.values() if line in p)
        branch = {line: max(v for x, v in own.items() if x[: len(line)] == line) for line in own}
        bound = {line: h.LOW_HINTED if hint else h.LOW_IN_ARTICLE if inside else h.LOW for line, (inside, hint, _) in sort.items()}
        poor = {line for line in own if len(line) > 1 and branch[line] < bound[line] - 1e-9}
        nodes = sorted(line[-1] for line in poor if line[:-1] not in poor)
        masses = {line: sum(v for x, v in mass.items() if x[: len(line)] == line) for line in own}
        heavy = [line for line in own if masses[line] >= (1 - (1 - h.BODY) * n / (n + h.BODY_PRIOR)) * masses[(h.ROOT,)] > 0 and sort[line][2] and 2 * len(pairs[line]) >= n]
        if nodes or heavy:
            out[site] = nodes, max(heavy, key=lambda x: (len(x), x[-1]))[-1] if heavy else None
    return out


def neutral(n, layout, extra=""):
    strips = {0: "<div class='x1'><div class='x2'>Read all our offers</div><ul class='x3'><li>One</li><li>Two</li></ul></div>", 1: "<section class='y1'><p>Ring us now</p></section>", 2: "<div class='z1'>Terms as ever</div>"}
    return f"<html><body>{strips[layout]}<div class='q'><h1>Title {n}</h1><p>Some text {n} <b>bold</b>.</p><p>{'More. ' * (n % 3)}{n}</p>{extra}</div><div class='w'>Ours <i>since</i> 1901</div></body></html>"


@pytest.fixture(scope="module")
def hosts():
    draw = random.Random(3)
    rows = [(n, f"https://one.example.org/{n}", neutral(n, 0)) for n in range(12)]
    rows += [(100 + n, f"https://three.example.org/{n}", neutral(n, n % 3)) for n in range(60)]
    rows += [(200 + n, f"https://few.example.org/{n}", neutral(n, 0)) for n in range(3)]
    rows += [(300 + n, f"https://copies.example.org/{n}", neutral(7, 0)) for n in range(20)]
    rows += [(400 + n, f"https://art.example.org/{n}", f"<article><p>Text {n} {draw.random()}</p><div class='k'>Follow us</div></article>") for n in range(40)]
    return rows


def test_the_tree_alone_removes_neutral_templates(spark, hosts):
    got = {r.page_id: r.text for r in h.main_text(spark.createDataFrame(hosts, SCHEMA)).collect()}
    for n in range(12):
        assert got[n] == " ".join(f"Title {n} Some text {n} bold. {'More. ' * (n % 3)}{n}".split())
    for n in range(60):
        assert got[100 + n] == " ".join(f"Title {n} Some text {n} bold. {'More. ' * (n % 3)}{n}".split())
    for n in range(3):  # too few pages to tell: nothing goes
        assert got[200 + n].startswith("Read all our offers One Two Title") and got[200 + n].endswith("Ours since 1901")
    assert all(got[300 + n].startswith("Read all our offers") for n in range(20))  # copies of a page are one page
    assert all(got[400 + n].startswith(f"Text {n} ") and "Follow" not in got[400 + n] for n in range(40))


def test_the_tree_is_the_brute_force_one(spark, hosts):
    pages = spark.createDataFrame(hosts, SCHEMA)
    want = brute_choices(hosts)
    assert {r.host: (sorted(r.nodes or []), r.body) for r in h.site_choices(pages).collect()} == want
    assert sum(bool(nodes) for nodes, _ in want.values()) == 3 and sum(body is not None for _, body in want.values()) >= 3


def test_defined_cases(spark):
    long_page = "<article>" + "<p>word &amp; more</p>" * 60_000 + "</article>"
    rows = [(1, "https://a.example.org", long_page), (None, None, "<p>x"), (None, None, "<p>x"), (2, "no url", None), (3, "", "")]
    pages = spark.createDataFrame([(*r, "a", 1, 2, "b") for r in rows], SCHEMA + ", host string, line int, nodes int, id string")
    for most in (h.BROADCAST_NODES, 0):
        got = h.main_text(pages, broadcast_nodes=most).collect()
        assert sorted(len(r.text) for r in got) == [0, 0, 1, 1, len("word & more ") * 60_000 - 1]
        assert sorted((str(r.page_id), r.n_chars) for r in got) == sorted((str(r[0]), len(x)) for r, x in zip(rows, (" ".join(["word & more"] * 60_000), "x", "x", "", ""), strict=True))
    assert h.main_text(pages.limit(0)).count() == 0


RENAMED = ("article", "nav", "footer")


def without_roles(page):
    """The page with its articles, menus and footers as plain div elements, and without classes."""
    page = re.sub(rf"<(/?)(?:{'|'.join(RENAMED)})\b[^>]*>", r"<\1div>", page)
    return re.sub(r"""<([a-z0-9]+)\s+(?:class|id)=("[^"]*"|'[^']*'|[^\s>]+)""", r"<\1", page)


def test_the_tree_finds_the_body_without_any_role(spark):
    """On hosts of ten or more pages the text is the same when no tag and no name states a role."""
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.1", "pages").select("page_id", "url", "html").collect()]
    want = {r.page_id: r.text for r in h.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    bare = spark.createDataFrame([(i, u, without_roles(p)) for i, u, p in rows], SCHEMA)
    got = {r.page_id: r.text for r in h.main_text(bare).collect()}
    many = Counter(u.split("/")[2] for _, u, _ in rows)
    large = [i for i, u, _ in rows if many[u.split("/")[2]] >= 10]
    same = sum(got[i] == want[i] for i in large)
    print(f"{same} of {len(large)}, {sum(got[i] == want[i] for i in want)} of {len(want)}")
    assert len(large) > 500 and same >= 0.95 * len(large)

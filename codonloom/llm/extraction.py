"""Main text of web pages by minimum-cut labelling of their blocks.

A page's html is cut into blocks of text at block elements. What the markup says
about a block (its innermost telling element: an article, a menu, a form, a class
name) and a naive Bayes classifier of its text (length, links, punctuation, place,
kind of element) give what it costs to call it content or boilerplate: these costs
are the capacities from and to the terminals. Blocks that follow each other and
blocks of one parent in the document tree are joined by smoothness edges. The
maximum flow's smallest cut labels all blocks of a page at once.

The classifier is trained here, on blocks of about FIT_PAGES pages (chosen by a hash)
whose markup tells what they are; it sees only their text.

Defined results: null or empty html has no text; every row gives a row, repeated
ones too; page_id and url may be null; an empty table gives no rows; other columns
are ignored. Tags without an end, stray ends, cut-off references and unquoted
attributes are read as browsers read them, as far as blocks go; a cut-off tag at the
end is dropped.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import received, sent, slices, table, tidy

FIT_PAGES = 2000
#: Costs, in thousandths: of markup that tells content, boilerplate or a form, of a place outside a known article; most of the classifier's; of edges.
TOLD, TOLD_AGAINST, FORM, OUTSIDE, LIKELY, EDGE = 6000, -8000, -3000, -4000, 3000, 1000
#: Levels of the tree that are climbed to find how far two blocks are apart.
FAR = 8

#: Elements of HTML by what they do to text.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
SILENT = frozenset("audio button canvas datalist map math noscript object select svg template video".split())
#: An element that ends an open one of its own, and where the search for that stops.
ENDS_OWN = {"li": "ul ol menu dir", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "thead": "table", "tbody": "table", "tfoot": "table"}
#: Words in class names, ids and roles, and elements, that tell what a part of a page is; names with a modifier tell nothing.
AGAINST = frozenset(
    """ad adbox ads adsense adslot adunit adv advert adverts advertisement advertising alert announcement aside banner breadcrumb breadcrumbs comment commentlist comments complementary consent
    colophon contentinfo cookie cookies copyright dialog disclaimer discussion disqus drawer feedback footer gdpr leftnav legal login masthead menu menubar modal
    nav navbar navigation newsletter notice notices notification offcanvas outbrain overlay pager pagination paywall popular popup promo promotion recommended
    related reply replies respond responses search secondary share sharing sidebar sidemenu sidenav signup skip social sponsor sponsored subnav subscribe
    subscription taboola toc toolbar tooltip topbar topnav trending widget""".split()
)
FOR = frozenset("article articlebody content entry main maincontent post story".split())
MODIFIERS = frozenset("closed disabled enabled has is no open with without".split())
ELEMENTS_AGAINST = frozenset("nav footer aside dialog menu".split())

TAG = re.compile(r"""<!--(?:.*?-->|.*)|<([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>|</([a-zA-Z][^\s/>]*)[^>]*>|<[!?/][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+")


def told(tag: str, attributes: str, inherited: int, nested: bool) -> int:
    """What an element says of its text: TOLD, TOLD_AGAINST, FORM, or what its surroundings say. An article nested in another is a reader's comment, unless its name tells otherwise."""
    if inherited == TOLD_AGAINST or tag in ELEMENTS_AGAINST:
        return TOLD_AGAINST
    top, good = tag == "header", tag == "main" or tag == "article" and not nested
    for name, *values in ATTRIBUTE.findall(attributes) if attributes and tag not in ("html", "body") else ():
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return TOLD_AGAINST
        for words in ({w.lower() for w in WORD.findall(x)} for x in value.split() if name in ("class", "id", "role")):
            if words & MODIFIERS:
                continue
            if words & AGAINST:
                return TOLD_AGAINST
            top, good = top or "header" in words, good or bool(words & FOR)
    if top:  # an article's own header holds its title
        return inherited if inherited == TOLD else TOLD_AGAINST
    if good or tag not in ("form", "fieldset", "article"):
        return TOLD if good else inherited
    return TOLD_AGAINST if inherited == TOLD or tag == "article" else FORM  # a form may hold a whole page


class Blocks:
    """A page's blocks of text, in order: texts, links (share of characters), tags, told, and homes in the tree of elements."""

    def __init__(self, page: str):
        self.texts, self.links, self.tags, self.told, self.homes = [], [], [], [], []
        self.parent, self.depth = [-1], [0]  # of every element; 0 is the page
        self.stack, self.open = [("", 0, 0, False)], Counter()  # tag, element, what it says, whether its text is silent
        self.parts, self.linked, self.link = [], 0, 0
        self.silent = 0
        self.read(page)
        self.flush()

    def read(self, page: str) -> None:
        at, end = 0, page.rfind(">") + 1
        while m := TAG.search(page, at, end):
            if m.start() > at:
                self.text(page[at : m.start()])
            at = m.end()
            tag = (m[1] or m[3] or "").lower()
            if tag:
                self.start(tag, m[2] or m[4] or "")
                if tag in RAW:
                    closing = re.compile(f"</{tag}[\\s/>]", re.I).search(page, at)
                    at = closing.start() if closing else len(page)
                    end = max(end, at)
            elif m[5]:
                self.end(m[5].lower())
        rest = page[at:]
        cut = re.search("<[a-zA-Z/!?]", rest)
        self.text(rest[: cut.start()] if cut else rest)

    def text(self, s: str) -> None:
        if not self.silent:
            s = entities.unescape(s)
            self.parts.append(s)
            if self.link:
                self.linked += len("".join(s.split()))

    def flush(self) -> None:
        """Ends the block: white space becomes one space."""
        text = " ".join("".join(self.parts).split()) if self.parts else ""
        if text:
            tag, element, says, _ = self.stack[-1]
            self.texts.append(text)
            self.links.append(min(1.0, self.linked / len(text.replace(" ", ""))))
            self.tags.append(tag)
            self.told.append(says)
            self.homes.append(element)
        self.parts, self.linked = [], 0

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.flush()
            if self.open["p"]:
                self.close("p", "table td th")
            if tag in ENDS_OWN:
                for own in ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else ("tbody", "thead", "tfoot") if tag[0] == "t" and tag != "tr" else (tag,):
                    if self.open[own]:
                        self.close(own, ENDS_OWN[tag])
        elif tag == "br":
            self.parts.append(" ")
        elif tag == "a":
            self.link = len(self.stack)
        if (tag in BLOCKS or tag in SILENT) and tag not in VOID and not (tag in SILENT and attributes.endswith("/")):
            self.parent.append(self.stack[-1][1])
            self.depth.append(self.depth[self.stack[-1][1]] + 1)
            self.stack.append((tag, len(self.parent) - 1, told(tag, attributes, self.stack[-1][2], self.open["article"] > 0), tag in SILENT))
            self.open[tag] += 1
            self.silent += tag in SILENT

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link = 0
        elif tag == "br":
            self.parts.append(" ")
        elif tag in BLOCKS:
            self.flush()
        if self.open[tag]:
            self.close(tag, "table" if tag not in ("table", "body", "html") and self.open["table"] and tag not in ("tr", "td", "th", "thead", "tbody", "tfoot") else "")

    def close(self, tag: str, within: str) -> None:
        """Ends the innermost open element of this name, and all in it, unless it lies outside the nearest of `within`."""
        outside = within.split()
        k = len(self.stack) - 1
        while k and self.stack[k][0] != tag:
            if self.stack[k][0] in outside:
                return
            k -= 1
        while len(self.stack) > k > 0:
            gone = self.stack.pop()
            self.open[gone[0]] -= 1
            self.silent -= gone[3]
        if self.link > len(self.stack):
            self.link = 0

    def apart(self, a: int, b: int) -> int:
        """Steps between two elements through the tree, FAR + 1 if more than FAR."""
        for steps in range(FAR + 1):
            if a == b:
                return steps
            a, b = (self.parent[a], b) if self.depth[a] >= self.depth[b] else (a, self.parent[b])
        return FAR + 1

    def edges(self) -> list[tuple[int, int, int]]:
        """(block, block, capacity): of neighbours, less the farther apart their elements are, and of blocks of one parent element."""
        found, last = [], {}
        for i, home in enumerate(self.homes):
            if i:
                found.append((i - 1, i, 2 * EDGE // max(2, self.apart(self.homes[i - 1], home))))
            near = self.parent[home]
            if near in last:
                found.append((last[near], i, EDGE))
            last[near] = i
        return found

    def features(self, i: int) -> tuple[str, ...]:
        """What the classifier sees of a block: its text, the kind of its element and its place."""
        text, n = self.texts[i], len(self.texts)
        words = text.count(" ") + 1
        kind = self.tags[i] if self.tags[i] in ("p", "li", "td") else "heading" if re.fullmatch("h[1-6]", self.tags[i]) else "other"
        place = "first" if 10 * i < n else "last" if 10 * (n - 1 - i) < n else "middle"
        return (f"words {min(6, words.bit_length())}", f"links {int(3 * self.links[i])}", f"ends {text[-1] in '.!?…:;'}", f"commas {min(3, text.count(','))}", f"element {kind}", f"place {place}")


def smallest_cut(costs: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Labels of the smallest cut: a node with a positive cost wants to be content, a negative one boilerplate; an edge costs its capacity if it is cut.

    A node whose own cost outweighs its edges takes its label at once and passes their capacities on; what is left goes
    through Dinic's maximum flow. Ties go to boilerplate where a node has neither costs nor edges.
    """
    n = len(costs)
    costs, label, near = list(costs), [None] * n, [{} for _ in range(n)]
    for a, b, c in edges:
        if a != b and c > 0:
            near[a][b] = near[a].get(b, 0) + c
            near[b][a] = near[b].get(a, 0) + c
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(costs[i]) >= sum(near[i].values()):
            label[i] = costs[i] > 0
            for j, c in near[i].items():
                costs[j] += c if label[i] else -c
                del near[j][i]
                todo.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        place = {i: k for k, i in enumerate(rest)}
        flow = Flow(len(rest) + 2)
        source, sink = len(rest), len(rest) + 1
        for i in rest:
            flow.join(*((source, place[i]) if costs[i] > 0 else (place[i], sink)), abs(costs[i]), 0)
            for j, c in near[i].items():
                if i < j:
                    flow.join(place[i], place[j], c, c)
        reached = flow.run(source, sink)
        for i in rest:
            label[i] = reached[place[i]] >= 0
    return label


class Flow:
    """Dinic's maximum flow."""

    def __init__(self, n: int):
        self.out, self.to, self.left = [[] for _ in range(n)], [], []

    def join(self, a: int, b: int, there: int, back: int) -> None:
        for x, y, c in ((a, b, there), (b, a, back)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.left.append(c)

    def levels(self, source: int) -> list[int]:
        level, todo = [-1] * len(self.out), deque([source])
        level[source] = 0
        while todo:
            x = todo.popleft()
            for e in self.out[x]:
                if self.left[e] and level[self.to[e]] < 0:
                    level[self.to[e]] = level[x] + 1
                    todo.append(self.to[e])
        return level

    def run(self, source: int, sink: int) -> list[int]:
        """Saturates the graph; returns the levels of what the source still reaches (-1: not reached)."""
        while (level := self.levels(source))[sink] >= 0:
            tried, path, x = [0] * len(self.out), [], source
            while True:
                if x == sink:
                    least = min(self.left[e] for e in path)
                    for e in path:
                        self.left[e] -= least
                        self.left[e ^ 1] += least
                    while not self.left[path[0]] or any(not self.left[e] for e in path):
                        path.pop()
                        if not path:
                            break
                    x = self.to[path[-1]] if path else source
                elif tried[x] < len(self.out[x]):
                    e = self.out[x][tried[x]]
                    if self.left[e] and level[self.to[e]] == level[x] + 1:
                        path.append(e)
                        x = self.to[e]
                    else:
                        tried[x] += 1
                elif x == source:
                    break
                else:
                    e = path.pop()
                    x = self.to[e ^ 1]
                    tried[x] += 1
        return level


#: What a feature's presence says for content, in thousandths.
Model = dict[str, int]


def label(blocks: Blocks, model: Model) -> list[bool]:
    """Which blocks are content."""
    known = TOLD in blocks.told
    costs = []
    for i, says in enumerate(blocks.told):
        likely = sum(model.get(f, 0) for f in blocks.features(i)) // 2
        costs.append(max(-LIKELY, min(LIKELY, likely)) + (says or (OUTSIDE if known else 0)))
    return smallest_cut(costs, blocks.edges())


def fit(pages: DataFrame, about: int = FIT_PAGES) -> Model:
    """The classifier, from the blocks of about so many pages whose markup tells what they are. Only counts by feature leave the executors."""
    from math import log

    rows = pages.count()
    share = min(1 << 20, (about << 20) // rows + 1) if rows else 0
    chosen = pages.filter(F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 20)) < share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in slices(batches, "html"):
            for page in batch.column("html").to_pylist():
                blocks = Blocks(page or "")
                for i, says in enumerate(blocks.told):
                    if says in (TOLD, TOLD_AGAINST):
                        counts.update((f, says == TOLD) for f in ("any", *blocks.features(i)))
        names, good = [k[0] for k in counts], [k[1] for k in counts]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(good, pa.bool_()), pa.array(list(counts.values()), pa.int64())], ["feature", "good", "n"])

    found = chosen.select("html").mapInArrow(tidy(run), "feature string, good boolean, n long").groupBy("feature").agg(
        F.coalesce(F.sum(F.when(F.col("good"), F.col("n"))), F.lit(0)).alias("yes"), F.coalesce(F.sum(F.when(~F.col("good"), F.col("n"))), F.lit(0)).alias("no")
    )
    counts = {r["feature"]: (r["yes"], r["no"]) for r in found.collect()}  # a few dozen rows, however many pages
    yes, no = counts.pop("any", (0, 0))
    return {f: round(1000 * log((a + 1) / (yes + 2) * (no + 2) / (b + 1))) for f, (a, b) in counts.items()}


TEXTS = "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long"


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, text (the content blocks, one a line), n_chars, n_blocks, n_kept."""
    held = sent(pages.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = received(held)
        for batch in slices(batches, "html"):
            texts, sizes = [], []
            for page in batch.column("html").to_pylist():
                blocks = Blocks(page or "")
                kept = [t for t, good in zip(blocks.texts, label(blocks, learned)) if good]
                texts.append("\n".join(kept))
                sizes.append((len(texts[-1]), len(blocks.texts), len(kept)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), *(pa.array([s[c] for s in sizes], pa.int64()) for c in range(3))], [c.split()[0] for c in TEXTS.split(", ")]
            )

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(tidy(run), TEXTS)


def op12_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages)).select("page_id", "url", "text", "n_chars")


#: For pages whose article stands in <article>, holds only headings, paragraphs, bold text and line breaks, and few kinds of references, as in the given tables.
OP12_SQL = r"""
WITH a AS (SELECT page_id, url, string_split_regex(coalesce(regexp_extract(html, '(?s)<article>(.*)</article>', 1), ''), '</?(?:p|h1)>') AS parts FROM pages
), t AS (
  SELECT page_id, url, list_transform(parts, lambda s: regexp_replace(regexp_replace(s, '<br>', ' ', 'g'), '</?b>', '', 'g')) AS parts FROM a
), u AS (
  SELECT page_id, url, list_transform(parts, lambda s: trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(s, '&lt;', '<'), '&gt;', '>'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS parts FROM t
)
SELECT page_id, url, text, length(text) AS n_chars FROM (SELECT page_id, url, coalesce(array_to_string(list_filter(parts, lambda s: s <> ''), chr(10)), '') AS text FROM u)
"""

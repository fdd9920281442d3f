"""The main text of web pages by wrapper induction: the template that the pages of a host share, and the slots that they fill.

A page becomes a tree of its block elements, in which neighbouring siblings of one label (tag, class, id, role) are one repeated
node. Trees are few where pages are many: each task adds up the pages of a tree, and Spark the tasks, in sums, minima and maxima
alone. The different trees of a host are then aligned by simple tree matching (order-preserving, labels equal, the
most pairs) and merged into its template, whose nodes know whether their text is the same on every page, and how much of it is links.

A page is aligned with its host's template by the same matching. Nodes whose text never varies are template; varying slots are
content, unless their label says that they are something else (menus, footers, adverts, forms, comments, ...), they consist of
links, or the template has an article or main element and they are outside of it. Sameness counts only for nodes of at least
half of a host's pages, under different titles, where the host has MIN_PAGES titles, so that copies of one article aren't
taken for template, and never for a first heading inside the article.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from countspark.llm.common import drop, materialise, ship

MIN_PAGES = 5  # different titles of a host from which sameness counts
DEPTH, CHILDREN = 64, 64  # nodes deeper than this are part of their ancestor; more children than this are merged by label, then by tag
WIDE = 256  # children of a template's node from which further ones join those of their tag
FAR = 256  # open elements that a tag is matched against
HELD = 200_000  # nodes that a task adds up before it hands them on
SALTS = 64  # parts in which the trees of a host are merged first
SMALL = 32 << 20  # bytes of templates that are broadcast; more are joined by host

# Elements and words by which HTML pages mark what an element is.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = set("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes noscript xmp".split())
DROPPED = set("head script style noscript noembed noframes template nav footer aside form button select textarea iframe object svg math canvas audio video map dialog menu datalist title".split())
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
WORDS = set(
    "ad ads adbox adsense adslot banner promo promotion promoted consent gdpr notice notices notification alert popup modal overlay lightbox aside widget widgets related recommended "
    "recommendations share sharing social signup login nav navbar menu menus pagination pager footer copyright toolbar topbar search searchbox outbrain taboola paywall disqus reply replies "
    "respond".split()
)
BEGINNINGS = ("comment", "advert", "cookie", "sidebar", "breadcrumb", "sponsor", "newsletter", "navigation", "subscri")
HEADERS = {"header", "masthead"}
FOREIGN = {"related", "recommended", "promo", "promoted", "widget", "ad", "ads", "disqus", "reply", "replies"}  # what makes an article element no article
CLOSES = {  # an opening tag ends these open elements, up to a container
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}), "option": ({"option"}, {"select", "datalist"}),
}
HOLDS_P = BLOCKS - {"p"} | {"html"}  # each of these has ended an open paragraph
BOXES = {"div", "section", "center", "td", "th", "table"}  # siblings of one label that hold different elements are different nodes

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?][^>]*>""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def label_of(tag: str, attributes: str) -> str:
    """tag, then what marks the element, digits as one sign."""
    if not attributes or attributes.isspace():
        return tag
    said: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        said.setdefault(name.lower(), a or b or c)
    out = [tag]
    for name, mark in (("id", "#"), ("class", "."), ("role", "@"), ("itemprop", "%")):
        if said.get(name):
            out += [mark + re.sub(r"\d+", "0", x)[:40] for x in sorted(said[name].split())[:6]]
    if "hidden" in said or said.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", said.get("style", ""), re.I):
        out.append("!hidden")
    return "".join(out)


class Label:
    """What a label says about its element."""

    known: dict[str, Label] = {}

    def __init__(self, label: str):
        self.tag = re.match(r"[^#.@%!]*", label)[0]
        marks = re.findall(r"([#.@%!])([^#.@%!]*)", label[len(self.tag) :])
        roles = {x.lower() for m, x in marks if m == "@"}
        words = {p.lower() for m, x in marks if m in "#." for p in _PART.findall(x)}
        self.comment = any(w.startswith("comment") for w in words)
        odd = bool(words & WORDS) or any(w.startswith(BEGINNINGS) for w in words)
        main = self.tag == "main" or "main" in roles or any(m == "%" and x == "articleBody" for m, x in marks)
        self.main = main or self.tag == "article" and not (words & FOREIGN or self.comment or any(w.startswith(("advert", "sponsor")) for w in words))
        self.whole = self.tag == "main" or "main" in roles
        self.header = (self.tag == "header" or bool(words & HEADERS) or "banner" in roles) and not self.main
        self.hidden = ("!", "hidden") in marks
        body = self.tag in ("html", "body") or self.main
        self.odd = not body and (self.tag in DROPPED or odd or bool(roles & (ROLES - {"banner"}))) or self.hidden

    @classmethod
    def of(cls, label: str) -> Label:
        if label not in cls.known:
            if len(cls.known) > 50_000:
                cls.known.clear()
            cls.known[label] = cls(label)
        return cls.known[label]


class Page:
    """A parsed page: nodes by parent and label, and its text in order, with breaks (node -1) where blocks begin and end."""

    def __init__(self, source: str):
        self.parent, self.label, self.events = [-1], ["html"], []
        self.stack, self.depth = [(0, "html")], 0
        self.link, self.linking = -1, set()  # the node in which a link is open; those in which one was
        self.title = ""
        at, last = 0, source.rfind(">") + 1
        while m := _TOKEN.search(source, at, last):
            if m.start() > at:
                self._say(source[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                if m[0].startswith("<!--") and not m[0].endswith("-->"):
                    at = len(source)
                continue
            if m[1] or m[4]:
                self._close(tag)
                continue
            attributes = m[3] if m[2] else m[6]
            self._open(tag, attributes)
            if tag in RAW:
                end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(source, at)
                stop = end.start() if end else len(source)
                if tag == "title" and not self.title:
                    self.title = entities.unescape(source[at:stop])
                at = stop
        if at < len(source):
            comment = source.find("<!--", at)
            self._say(source[at : comment if comment >= 0 else len(source)])

    def _say(self, text: str) -> None:
        self.events.append((self.stack[-1][0], entities.unescape(text) if "&" in text else text, self.link >= 0))

    def _pop(self, k: int) -> None:
        for node, _ in self.stack[k:]:
            if node == self.link:
                self.link = -1
        if any(tag in BLOCKS for _, tag in self.stack[k:]):
            self.events.append((-1, "", False))
        del self.stack[k:]

    def _end(self, tags: set[str], scope: set[str]) -> None:
        """Close the innermost open element of these tags, unless a container is nearer."""
        for k in range(len(self.stack) - 1, max(0, len(self.stack) - FAR), -1):
            if self.stack[k][1] in tags:
                return self._pop(k)
            if self.stack[k][1] in scope:
                return None
        return None

    def _open(self, tag: str, attributes: str) -> None:
        block = tag in BLOCKS
        if block and tag not in ("option", "optgroup"):
            self._end({"p"}, HOLDS_P)
        if tag in CLOSES:
            self._end(*CLOSES[tag])
        if tag == "br":
            self.events.append((self.stack[-1][0], " ", False))
        if tag == "a":
            self.link = self.stack[-1][0]
            self.linking.add(self.link)
        if tag in ("html", "body") and any(t == tag for _, t in self.stack):
            return
        if tag in VOID:
            if block:
                self.events.append((-1, "", False))
            return
        label = label_of(tag, attributes)
        if not block and tag not in RAW and not Label.of(label).odd:
            return  # other inline elements are part of their block
        if block:
            self.events.append((-1, "", False))
        node = self.stack[-1][0]
        if len(self.stack) < DEPTH:
            node = len(self.label)
            self.parent.append(self.stack[-1][0])
            self.label.append(label)
        self.stack.append((node, tag))

    def _close(self, tag: str) -> None:
        if tag == "a":
            self.link = -1
        for k in range(len(self.stack) - 1, max(0, len(self.stack) - FAR), -1):
            if self.stack[k][1] == tag:
                return self._pop(k)
            if tag not in BLOCKS and self.stack[k][1] in BLOCKS:
                return None
        if tag == "p":
            self.events.append((-1, "", False))
        return None

    def tree(self) -> tuple[list, list[int]]:
        """The nodes with repeated siblings as one, [label, children] by preorder, and for each node its place in this preorder."""
        children: list[list[int]] = [[] for _ in self.label]
        for node, up in enumerate(self.parent):
            if up >= 0:
                children[up].append(node)
        boxes = [Label.of(x).tag in BOXES for x in self.label]
        kind = [(x, (frozenset(self.label[c] for c in cs), node in self.linking) if box else None) for node, (x, cs, box) in enumerate(zip(self.label, children, boxes))]
        place = [0] * len(self.label)
        count = 0

        def build(label: str, members: list[int]) -> list:
            nonlocal count
            for m in members:
                place[m] = count
            count += 1
            groups: list[tuple[str, list[int]]] = []
            for m in members:
                _align(groups, [(kind[c], c) for c in children[m]])
            groups = [(x[0], ms) for x, ms in groups]
            if len(groups) > CHILDREN:
                groups = _by_label(groups, lambda x: x)
            if len(groups) > CHILDREN:
                groups = _by_label(groups, lambda x: Label.of(x).tag + ("#comment" if Label.of(x).comment else ".ad" if Label.of(x).odd else ""))
            if len(groups) > CHILDREN:
                groups = _by_label(groups, lambda x: "x.ad" if Label.of(x).odd else "x")
            return [label, [build(x, ms) for x, ms in groups]]

        return build("html", [0]), place

    def numbers(self, place: list[int], title: int) -> np.ndarray:
        """NUMBERS for each place; the digest of a place without text is 0."""
        n = max(place) + 1
        said: dict[int, list[str]] = {}
        chars, links = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for node, text, link in self.events:
            if node >= 0 and not text.isspace():
                at = place[node]
                said.setdefault(at, []).append(text)
                chars[at] += len(text)
                links[at] += len(text) if link else 0
        digests = np.zeros(n, np.int64)
        for at, texts in said.items():
            digests[at] = xxh64_intdigest(" ".join(" ".join(texts).split()).encode("utf-8", "replace")) >> 1 or 1
        titles = np.full(n, title, np.int64)
        return np.stack([np.ones(n, np.int64), digests, digests, titles, titles, chars, links])

    def heading(self) -> int:
        """A digest of the first heading, or else of the title."""
        said: list[str] = []
        for node, text, _ in self.events:
            if node < 0 and said:
                break
            if node >= 0 and Label.of(self.label[node]).tag == "h1":
                said.append(text)
        return xxh64_intdigest(" ".join("".join(said or self.title).split()).encode("utf-8", "replace")) >> 1

    def text(self, place: list[int], kept: list[bool]) -> str:
        """The blocks of the kept places, one a line."""
        blocks: list[str] = []
        now: list[str] = []
        for node, text, _ in [*self.events, (-1, "", False)]:
            if node < 0:
                if block := " ".join("".join(now).split()):
                    blocks.append(block)
                now = []
            elif kept[place[node]]:
                now.append(text)
        return "\n".join(blocks)


def _align(groups: list[tuple], new: list[tuple]) -> None:
    """Add one member's children to the groups of those before it: to the nearest group of their kind further on or, but for boxes, up to three back (a repeated run), or as a new one."""
    at = -1
    for kind, child in new:
        ways = (*range(at, max(-1, at - 1 if kind[1] else at - 4), -1), *range(at + 1, min(len(groups), at + 1 + CHILDREN)))
        k = next((i for i in ways if groups[i][0] == kind), -1)
        if k < 0:
            k = at + 1
            groups.insert(k, (kind, []))
        groups[k][1].append(child)
        at = k


def _by_label(groups: list[tuple[str, list[int]]], of) -> list[tuple[str, list[int]]]:
    merged: dict[str, list[int]] = {}
    for label, members in groups:
        merged.setdefault(of(label), []).extend(members)
    return [(label, sorted(members)) for label, members in merged.items()]


def matching(a: list[list], b: list[list]) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two lists of siblings: the most pairs of nodes, in order, whose labels and ancestors match; and the pairs of siblings."""
    if not a or not b:
        return 0, []
    weight = [[1 + matching(x[-1], y[-1])[0] if x[0] == y[0] else 0 for y in b] for x in a]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, row in enumerate(weight, 1):
        for j, w in enumerate(row, 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + w if w else 0)
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return best[-1][-1], pairs[::-1]


def merged(a: list, b: list) -> list:
    """Two templates [label, *numbers, children] as one: matching nodes once, others where they stand."""
    pairs = matching(a[-1], b[-1])[1]
    children, i, j = [], 0, 0
    for x, y in [*pairs, (len(a[-1]), len(b[-1]))]:
        children += a[-1][i:x]
        for new in b[-1][j:y]:
            tag = Label.of(new[0]).tag
            like = next((k for k, c in enumerate(children) if Label.of(c[0]).tag == tag), -1) if len(a[-1]) + len(children) > WIDE else -1
            if like < 0:
                children.append(new)
            else:
                children[like] = merged(children[like], new)
        if x < len(a[-1]):
            children.append(merged(a[-1][x], b[-1][y]))
        i, j = x + 1, y + 1
    return [a[0], *(how(p, q) for how, p, q in zip(ADD, a[1:-1], b[1:-1])), children]


#: The numbers of a template's node, how two are added up: pages, least and greatest digest of the text, of the pages' titles, characters, those in links.
NUMBERS = ("n", "lo", "hi", "title_lo", "title_hi", "chars", "links")
ADD = (int.__add__, min, max, min, max, int.__add__, int.__add__)
ADD_ARRAYS = (np.add, np.minimum, np.maximum, np.minimum, np.maximum, np.add, np.add)


def template(tree: list, slots: list[tuple]) -> list:
    """A tree [label, children] with the numbers of each place of its preorder."""
    numbers = iter(slots)

    def build(node: list) -> list:
        return [node[0], *next(numbers), [build(c) for c in node[1]]]

    return build(tree)


def content(root: list, titles: int) -> list:
    """The template [label, ..., children] as [label, kept, children]."""

    def holds(node: list, what) -> bool:
        return what(node) or any(holds(c, what) for c in node[-1])

    is_main = lambda n: Label.of(n[0]).main
    is_h1 = lambda n: Label.of(n[0]).tag == "h1"
    has_main = False

    def odd(node: list, inside: bool) -> bool:
        """Whether the label alone rules out an element and all that it holds."""
        x = Label.of(node[0])
        if x.hidden or x.comment and not x.main and x.tag not in ("html", "body"):
            return not holds(node, lambda n: Label.of(n[0]).whole) or x.hidden
        if not (x.odd or x.header and not inside):
            return False
        return not (holds(node, is_main) or x.tag == "form" and holds(node, is_h1))

    def look(node: list, inside: bool) -> None:
        nonlocal has_main
        if not odd(node, inside):
            has_main = has_main or is_main(node)
            for c in node[-1]:
                look(c, inside or is_main(node))

    look(root, False)
    articles: list[list] = []

    def find(node: list, inside: bool) -> None:
        if odd(node, inside):
            return
        x = Label.of(node[0])
        if x.main and not x.whole:
            articles.append(node)
        for c in node[-1]:
            find(c, inside or x.main)

    find(root, False)
    headed = any(holds(a, is_h1) for a in articles)  # the article is whole then, and a main element around it holds more than it

    def decide(node: list, inside: bool) -> list:
        if odd(node, inside):
            return [node[0], False, [none(c) for c in node[-1]]]
        x = Label.of(node[0])
        inside = inside or x.main and not (x.whole and headed)
        _, n, lo, hi, title_lo, title_hi, chars, links, _ = node
        same = lo == hi and title_lo < title_hi and titles >= MIN_PAGES and n >= max(MIN_PAGES, root[1] / 2) and not (inside and x.tag == "h1")
        kept = (inside or not has_main) and not same and (inside or 2 * links <= chars)
        return [node[0], kept, [decide(c, inside) for c in node[-1]]]

    def none(node: list) -> list:
        return [node[0], False, [none(c) for c in node[-1]]]

    return decide(root, False)


def kept_places(tree: list, decided: list) -> list[bool]:
    """For each place of a page's tree, whether the template keeps what is there; a node that matches none goes with the node above it."""
    out: list[bool] = []

    def walk(node: list, match: list | None, above: bool) -> None:
        kept = match[1] if match else above and not Label.of(node[0]).odd
        out.append(kept)
        pairs = dict(matching(node[1], match[-1])[1]) if match else {}
        for i, c in enumerate(node[1]):
            walk(c, match[-1][pairs[i]] if i in pairs else None, kept)

    walk(tree, decided, False)
    return out


def host(url: Column) -> Column:
    """The host of a URL in lower case, without port and user; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


_SEEN = f"host string, key binary, tree string, {', '.join(f'{c} array<long>' for c in NUMBERS)}, titles array<long>"


def _trees(pages: DataFrame) -> DataFrame:
    """The pages (host, html) added up by task, host and tree; titles: the MIN_PAGES smallest digests of titles."""

    def rows(seen: dict, titles: dict) -> pa.RecordBatch:
        out = []
        for (name, key), (tree, numbers) in seen.items():
            out.append((name, key, tree, *(x.tolist() for x in numbers), sorted(titles.pop(name, ()))))
        names = [x.split()[0] for x in _SEEN.split(", ")]
        kinds = [pa.string(), pa.binary(), pa.string(), *[pa.list_(pa.int64())] * (len(names) - 3)]
        columns = zip(*out) if out else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        titles: dict = {}
        held = 0
        for batch in batches:
            for name, source in zip(batch.column(0).to_pylist(), batch.column(1)):
                page = Page(source.as_py() or "")
                tree, place = page.tree()
                said = json.dumps(tree, separators=(",", ":"))
                heading = page.heading()
                numbers = page.numbers(place, heading)
                key = (name, xxh64_intdigest(said).to_bytes(8, "big") + xxh64_intdigest(said, 1).to_bytes(8, "big"))
                if (old := seen.get(key)) is None:
                    held += numbers.shape[1] + 50
                else:
                    numbers = np.stack([how(p, q) for how, p, q in zip(ADD_ARRAYS, old[1], numbers)])
                seen[key] = said, numbers
                titles[name] = set(sorted(titles.get(name, set()) | {heading})[:MIN_PAGES])
                if held > HELD:
                    yield rows(seen, titles)
                    seen, titles, held = {}, {}, 0
        yield rows(seen, titles)

    return pages.mapInArrow(run, _SEEN)


def _folded(rows: DataFrame, keys: list[str], read) -> DataFrame:
    """(host, template): the rows of each group merged, in the order of their keys, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([group[0]], pa.string()), pa.array([json.dumps(held, separators=(",", ":"))], pa.string())], names=["host", "template"])
        for batch in batches:
            for row in batch.to_pylist():
                now = tuple(row[k] for k in keys)
                if group is not None and now != group:
                    yield out()
                    held = None
                group, held = now, read(row) if held is None else merged(held, read(row))
        if group is not None:
            yield out()

    return rows.mapInArrow(run, "host string, template string")


def induce(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, template JSON, titles): for each host the merged tree of all its pages, and how many different titles they have, MIN_PAGES at most.

    All pages count; a null page is an empty one, and those without a host are one host. The result doesn't depend on how the rows are dealt out.
    """
    ship(pages.sparkSession)
    seen = materialise(_trees(pages.select(host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))))
    each = seen.select("host", "key", F.posexplode(F.arrays_zip(*NUMBERS)).alias("pos", "x"))
    of = {int.__add__: F.sum, min: F.min, max: F.max}
    slots = each.groupBy("host", "key", "pos").agg(*[of[how](f"x.{c}").alias(c) for c, how in zip(NUMBERS, ADD)])
    shapes = slots.groupBy("host", "key").agg(F.sort_array(F.collect_list(F.struct("pos", *NUMBERS))).alias("slots"))  # as many as the tree has places
    trees = seen.groupBy("host", "key").agg(F.min("tree").alias("tree"))
    keys = ["host", "salt"]
    dealt = materialise(shapes.join(trees, ["host", "key"]).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")))
    titles = seen.select("host", F.explode("titles").alias("title")).distinct().groupBy("host").agg(F.least(F.count("*"), F.lit(MIN_PAGES)).cast("int").alias("titles"))
    parts = materialise(
        _folded(
            dealt.repartition(*keys).sortWithinPartitions(*keys, "key"),
            keys,
            lambda r: template(json.loads(r["tree"]), [tuple(x[c] for c in NUMBERS) for x in r["slots"]]),
        )
    )
    whole = _folded(parts.repartition("host").sortWithinPartitions("host", "template"), ["host"], lambda r: json.loads(r["template"]))
    templates = materialise(whole.join(titles, "host"))
    drop(seen, dealt, parts)
    return templates


def extract(pages: DataFrame, templates: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every row, by the templates of induce().

    White space inside a block is one space, blocks are lines, and nothing is cut. A null or empty page has an empty text; a page of a host without a
    template is its own. Repeated rows and ids give a row each; text outside of any element is a block. Other columns, whatever their names, are not read.
    """
    ship(pages.sparkSession)
    kinds = {"id": pages.schema[id_col].dataType.simpleString(), "url": pages.schema[url_col].dataType.simpleString()}
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host(F.col(url_col)).alias("host"))
    size = templates.agg(F.sum(F.octet_length("template") + F.octet_length("host"))).first()[0] or 0
    both = rows.join(F.broadcast(templates) if size <= SMALL else templates, "host", "left").select("id", "url", "html", "host", "template", "titles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decided: dict = {}
        places: dict = {}
        for batch in batches:
            texts = []
            for source, name, said, titles in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4), batch.column(5)):
                page = Page(source.as_py() or "")
                tree, place = page.tree()
                if said.is_valid:
                    key = (name, json.dumps(tree))
                    if key not in places:
                        if len(places) > 20_000 or len(decided) > 2_000:
                            places, decided = {}, {}
                        if name not in decided:
                            decided[name] = content(json.loads(said.as_py()), titles.as_py() or 0)
                        places[key] = kept_places(tree, decided[name])
                    kept = places[key]
                else:
                    kept = kept_places(tree, content(template(tree, page.numbers(place, 0).T.tolist()), 1))
                texts.append(page.text(place, kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    return both.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """induce() over all pages, then extract() from each of them."""
    return extract(pages, induce(pages, url_col, html_col), id_col, url_col, html_col)

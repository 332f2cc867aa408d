"""Operator 4: main text of web pages by inferred wrappers (union-free regular expressions over same-host token streams).

A page's token stream becomes a tree of labels (tag with class, id or role) and text slots. Pages of one host are aligned
one after another: labels that match are aligned further below, labels that don't become optional, neighbours with the
same label (or the same sequence of up to four labels) become one repeated group, and text that differs between pages is a
slot while text that never does belongs to the template. The result, a host's wrapper, is an expression of sequences,
optional and repeated groups only.

The wrapper alone says what is read. It is walked from its root to the groups that hold the content: down to the child that
holds most of the varying unlinked text of its parent, or to several optional children that do so together, as layouts do that
take each other's place; down to no single member of a repeated group, and to no list, paragraph or other element that only holds text. Article and
main elements and names like "content" are a hint (half of the text is enough then); what is named like furniture has no
weight. Inside the groups found, template text and elements of furniture go; names of furniture only count there for
containers, and those with other meanings only where no such group was found at all, so that the text's own paragraphs
stay whatever they are called. A page on which no content group of its host occurs is its own host. Text is the template's if
all that stands on its path is the same on every page with that path, and at least five pages that differ elsewhere have it;
text of a repeated group whose other members vary is a slot.

Wrappers merge in any order, so tasks infer partial ones, which are merged in two levels; a hot host is never in one task
with all of its pages. All pages take part.

Defined results: null html counts as empty and has the text ''; a null or unparsable url belongs to the host '';
repeated rows are extracted each; an empty table gives an empty result; extra columns are ignored. Line breaks (<br>) are
white space inside a block.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, table

# Elements of HTML by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An opening tag ends these open elements, up to the named borders.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
P_BORDERS = frozenset("table td th caption button object body html".split())
#: Never main text: elements and roles. Words in class or id have no weight when content is looked for.
FURNITURE = frozenset("head nav header footer aside form script style noscript template iframe button select textarea menu svg dialog canvas object video audio map fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
NAMED = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|header|masthead|footer|foot|sidebar|side|ad|ads|adv|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|banner|cookie|cookies|consent|gdpr|notice|notices|"
    r"alert|comment|comments|reply|replies|respond|disqus|share|sharing|social|related|recommended|breadcrumb|breadcrumbs|newsletter|subscribe|signup|popup|modal|overlay|login|search|widget|copyright|legal|skip|pagination|pager|toolbar|tags|toc)(?:$|[\s_-])",
    re.I,
)
#: Those of them that mean furniture even inside the content, on the containers below.
SURE = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|footer|sidebar|ad|ads|adv|advert|adverts|advertisement|advertising|sponsored|promo|cookie|cookies|consent|gdpr|comment|comments|respond|disqus|sharing|breadcrumb|breadcrumbs|newsletter|subscribe|signup|popup|modal|overlay|login|pagination|pager|toolbar)(?:$|[\s_-])",
    re.I,
)
CONTAINERS = frozenset("div section ul ol table center details".split())
#: Parts of a text, never all of it.
PARTS_OF_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl li dt dd blockquote pre figure figcaption address".split())
ARTICLE = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|main|body|text)(?:$|[\s_-])", re.I)

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^"'<>]|"[^"]*"|'[^']*')*+)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)|<""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPACE = re.compile(r"\s+")

#: Levels of elements that paths and wrappers tell apart.
DEEP = 64

#: A text block: path of labels, text, length of the part of it inside links.
Block = tuple[tuple[str, ...], str, int]


def label(tag: str, attributes: str) -> str:
    """The tag with what its class, id and role say; numbers in names don't count."""
    if not attributes or "=" not in attributes:
        return tag
    named = {}
    for m in ATTRIBUTE.finditer(attributes):
        named.setdefault(m[1].lower(), re.sub(r"[0-9]+", "0", (m[2] or m[3] or m[4] or "").strip().lower()))
    return tag + "".join(f" {k}={named[k]}" for k in ("role", "id", "class") if named.get(k))


@cache
def furniture(name: str) -> int:
    """0: none; 1: named like some furniture; 2: a container named like sure furniture; 3: by its element or role."""
    tag, _, rest = name.partition(" ")
    if tag in FURNITURE:
        return 3
    if not rest or tag in ("body", "html"):
        return 0
    role = re.search(r"role=(\S+)", rest)
    if role and role[1] in ROLES:
        return 3
    words = re.sub(r"(?:^| )(?:role|id|class)=", " ", rest)
    return 2 if tag in CONTAINERS and SURE.search(words) else 1 if NAMED.search(words) else 0


@cache
def hinted(name: str) -> bool:
    """Whether an element says of itself that it holds the content."""
    tag, _, rest = name.partition(" ")
    return tag in ("article", "main") or "role=main" in rest or "role=article" in rest or bool(tag in CONTAINERS and ARTICLE.search(re.sub(r"(?:^| )(?:role|id|class)=", " ", rest)))


def blocks(html: str) -> tuple[list[Block], set[tuple[tuple[str, ...], str]]]:
    """The page's text blocks in order, and its (path, label) pairs, which tell its structure whatever repeats."""
    tags: list[str] = []
    names: list[str] = []  # of the open elements that make blocks
    below: list[tuple[str, str]] = []  # for each of them, the first furniture and content hint at or above it that are too deep to have a level
    open_tags: Counter = Counter()
    out: list[Block] = []
    seen: set = set()
    text: list[str] = []
    linked, links = 0, 0

    def path() -> tuple[str, ...]:
        """Labels from the root; below DEEP levels, only the first content hint and the first furniture or else the innermost label count."""
        if len(names) <= DEEP:
            return tuple(names)
        hint = (below[-1][1],) if below[-1][1] else ()
        return (*names[: DEEP - 2], *hint, below[-1][0] or names[-1])

    def flush() -> None:
        nonlocal linked
        if text:
            joined = SPACE.sub(" ", unescape("".join(text))).strip()
            if joined:
                out.append((path(), joined, linked))
            text.clear()
        linked = 0

    def close(k: int) -> None:
        nonlocal links
        ended = tags[k:]
        made = sum(t not in INLINE for t in ended)
        if made:
            flush()
            del names[len(names) - made :], below[len(below) - made :]
        links -= ended.count("a")
        open_tags.subtract(ended)
        del tags[k:]

    def last(tag: str) -> int:
        k = len(tags) - 1
        while tags[k] != tag:
            k -= 1
        return k

    pos, n = 0, len(html)
    while pos < n:
        m = TOKEN.search(html, pos)
        end = m.start() if m else n
        if end > pos:
            text.append(html[pos:end])
            linked += end - pos if links else 0
        if not m:
            break
        pos = m.end()
        tag = m[2].lower() if m[2] else None
        if tag is None:
            if m[0] == "<":
                text.append("<")
            continue
        if m[1]:
            tag = f"{tag}!" if open_tags[f"{tag}!"] > open_tags[tag] else tag
            if open_tags[tag] > 0:
                k = last(tag)
                if tag not in INLINE or not any(t not in INLINE for t in tags[k:]):
                    close(k)
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, pos)
            pos = stop.end() if stop else n
            continue
        if tag not in INLINE:
            if open_tags["p"] > 0:
                for k in range(len(tags) - 1, -1, -1):
                    if tags[k] == "p":
                        close(k)
                        break
                    if tags[k] in P_BORDERS:
                        break
            if tag in ENDS and any(open_tags[x] > 0 for x in ENDS[tag][0]):
                ended, borders = ENDS[tag]
                cut_at = None
                for k in range(len(tags) - 1, -1, -1):
                    if tags[k] in borders:
                        break
                    if tags[k] in ended:
                        cut_at = k
                if cut_at is not None:
                    close(cut_at)
            flush()
        name = label(tag, m[3])
        block = tag not in INLINE
        if block:
            seen.add((path(), name))
        elif furniture(name) > 1:
            # an inline element that is furniture bounds a block like any other
            flush()
            tag, block = f"{tag}!", True
        if block:
            names.append(name)
            deep = len(names) >= DEEP - 1
            first, hint = below[-1] if below else ("", "")
            below.append((first or (name if deep and furniture(name) > 1 else ""), hint or (name if deep and hinted(name) else "")))
        tags.append(tag)
        open_tags[tag] += 1
        links += tag == "a"
    flush()
    return out, seen


# A wrapper node: [label, least, many, children]; least is 0 if optional, many if repeated. Text slots are labelled "#".
Node = list


def page_tree(found: list[Block], seen: set) -> Node:
    """The wrapper of one page: its blocks' paths in order, neighbours folded."""
    root: Node = ["", 1, False, []]
    open_nodes: list[Node] = [root]
    last: tuple[str, ...] = ()
    for path, _, _ in found:
        same = 0
        while same < min(len(path), len(last)) and path[same] == last[same]:
            same += 1
        if path == last and path:
            same = len(path) - 1  # the next block in an element with the same path is another element
        del open_nodes[same + 1 :]
        for name in path[same:]:
            node: Node = [name, 1, False, []]
            open_nodes[-1][3].append(node)
            open_nodes.append(node)
        open_nodes[-1][3].append(["#", 1, False, []])
        last = path
    return folded(root)


def folded(node: Node) -> Node:
    """Neighbouring repeats of one label or of a sequence of up to four become one repeated node (or group, "()")."""
    kids = [folded(k) for k in node[3]]
    for size in (1, 2, 3, 4):
        out: list[Node] = []
        k = 0
        while k < len(kids):
            both, names, follow = kids[k : k + size], [x[0] for x in kids[k : k + size]], k + size
            while len(both) == size and [x[0] for x in kids[follow : follow + size]] == names:
                both = [merged(a, b) for a, b in zip(both, kids[follow : follow + size], strict=True)]
                follow += size
            if follow > k + size:
                out.append([both[0][0], both[0][1], True, both[0][3]] if size == 1 else ["()", 1, True, both])
                k = follow
            else:
                out.append(kids[k])
                k += 1
        kids = out
    return [node[0], node[1], node[2], kids]


#: The k-th of a label's occurrences in one sequence is aligned with the (k - BAND)-th to (k + BAND)-th in the other.
BAND = 8


def alignment(x: list[str], y: list[str]) -> list[tuple[int | None, int | None]]:
    """Pairs of positions in the order of both, as many as can be; a label without a partner stands alone.

    The longest common subsequence as the longest increasing one among the pairs of equal labels (Hunt and Szymanski), in
    time of about the length of the sequences, as each position has at most 2 * BAND + 1 partners.
    """
    where: dict[str, list[int]] = {}
    for j, name in enumerate(y):
        where.setdefault(name, []).append(j)
    nth: Counter = Counter()
    ends: list[int] = []  # the smallest end in y of a chain of each length
    chains: list[tuple] = []  # (i, j, chain before) of these
    for i, name in enumerate(x):
        k = nth[name]
        nth[name] += 1
        for j in reversed(where.get(name, [])[max(0, k - BAND) : k + BAND + 1]):
            at = bisect_left(ends, j)
            chain = (i, j, chains[at - 1] if at else None)
            if at == len(ends):
                ends.append(j)
                chains.append(chain)
            else:
                ends[at], chains[at] = j, chain
    pairs, chain = [], chains[-1] if chains else None
    while chain:
        pairs.append(chain[:2])
        chain = chain[2]
    out: list[tuple[int | None, int | None]] = []
    i = j = 0
    for p, q in [*reversed(pairs), (len(x), len(y))]:
        out += [(k, None) for k in range(i, p)] + [(None, k) for k in range(j, q)]
        if p < len(x):
            out.append((p, q))
        i, j = p + 1, q + 1
    return out


def merged(a: Node, b: Node) -> Node:
    """The alignment of two nodes with one label: matches are aligned below, mismatches become optional."""
    if a[3] == b[3]:
        return [a[0], min(a[1], b[1]), a[2] or b[2], a[3]]
    x, y = a[3], b[3]
    kids: list[Node] = []
    for i, j in alignment([k[0] for k in x], [k[0] for k in y]):
        if i is not None and j is not None:
            kids.append(merged(x[i], y[j]))
        else:
            name, _, many, below = x[i] if j is None else y[j]
            kids.append([name, 0, many, below])
    tight: list[Node] = []
    for k in kids:
        if tight and tight[-1][0] == k[0] and k[0] != "()":
            p = tight.pop()
            k = merged(p, k)
            k = [k[0], k[1], True, k[3]]
        tight.append(k)
    return [a[0], min(a[1], b[1]), a[2] or b[2], tight]


#: Pages, different ones, on which a text has to be the same to belong to the template.
ALIKE = 5


class Wrapper:
    """A host's expression and, for each path of a slot, [the least hashes of its different pages (at most ALIKE), characters,
    linked characters, hash or None if it varies]."""

    def __init__(self, tree: Node | None = None, slots: dict | None = None):
        self.tree, self.slots, self.shapes = tree, slots or {}, set()

    def add(self, found: list[Block], seen: set) -> None:
        order = [p for k, (p, _, _) in enumerate(found) if not k or found[k - 1][0] != p]
        key = hash((frozenset(seen), frozenset(zip(order, order[1:], strict=False))))
        if key not in self.shapes:
            self.shapes.add(key)
            tree = page_tree(found, seen)
            self.tree = merged(self.tree, tree) if self.tree else tree
        page: dict[tuple[str, ...], list] = {}
        for path, text, linked in found:
            slot = page.setdefault(path, [[], 0, 0, 0])
            slot[1:4] = slot[1] + len(text), slot[2] + linked, zlib.crc32(text.encode(), slot[3])
        # what furniture says does not make another page
        own = [path for path in page if not any(map(furniture, path))]
        page_hash = zlib.crc32(json.dumps([[path, page[path][3]] for path in own]).encode())
        for path, slot in page.items():
            slot[0] = [page_hash]
            self._slot("\t".join(path), slot)

    def _slot(self, path: str, new: list) -> None:
        old = self.slots.get(path)
        if old is not None:
            pages = old[0] if old[0] == new[0] else sorted({*old[0], *new[0]})[:ALIKE]
            new = [pages, old[1] + new[1], old[2] + new[2], old[3] if old[3] == new[3] else None]
        self.slots[path] = new

    def merge(self, other: Wrapper) -> None:
        self.tree = merged(self.tree, other.tree) if self.tree and other.tree else self.tree or other.tree
        for path, new in other.slots.items():
            self._slot(path, new)

    def dumps(self) -> str:
        return json.dumps([self.tree, self.slots])

    @classmethod
    def loads(cls, text: str) -> Wrapper:
        return cls(*json.loads(text))

    def regions(self) -> tuple[list[str], list[str]]:
        """(paths of the content groups, paths inside them that are left out)."""
        weight: dict[str, int] = {}  # varying unlinked characters at or below a path
        own: dict[str, int] = {}
        constant = {path for path, (pages, _, _, same) in self.slots.items() if same is not None and len(pages) >= ALIKE}
        for path, (_, chars, linked, _) in self.slots.items():
            names = path.split("\t") if path else []
            if path in constant or any(map(furniture, names)):
                continue
            own[path] = max(0, chars - 2 * linked)
            for k in range(len(names) + 1):
                at = "\t".join(names[:k])
                weight[at] = weight.get(at, 0) + own[path]
        found, left_out = [], []

        def groups(node: Node) -> list[Node]:
            """A node's children, those of groups of several labels among them, with whether they are optional or repeated."""
            out = []
            for k in node[3]:
                out += [[c[0], min(k[1], c[1]), k[2] or c[2], c[3]] for c in groups(k)] if k[0] == "()" else [k] if k[0] != "#" else []
            return out

        def under(path: str, name: str) -> str:
            return f"{path}\t{name}" if path else name

        def content(node: Node, path: str) -> list[tuple[Node, str]]:
            """The groups below a node that hold its content, or the node itself."""
            kids: dict[str, list[Node]] = {}
            for k in groups(node):
                kids.setdefault(under(path, k[0]), []).append(k)
            # nothing below an element whose own text is most of it
            total = weight.get(path, 0)
            some = sorted((p for p in kids if weight.get(p, 0) and own.get(p, 0) < 0.5 * weight[p] and kids[p][0][0].partition(" ")[0] not in PARTS_OF_TEXT), key=lambda p: (-weight[p], p))
            down: list[str] = []
            if some:
                top = some[0]
                repeated = len(kids[top]) > 1 or kids[top][0][2]
                if hinted(kids[top][0][0]) and weight[top] >= 0.5 * total or not repeated and weight[top] >= 0.8 * total:
                    down = [top]
                elif (others := [p for p in some if all(k[1] == 0 for k in kids[p])]) and sum(weight[p] for p in others) >= 0.8 * total:
                    down = others
            if not down:
                return [(node, path)]
            return [x for p in down for x in content([kids[p][0][0], 1, False, [c for k in kids[p] for c in k[3]]], p)]

        def furnish(node: Node, path: str, least: int) -> None:
            for k in groups(node):
                at = under(path, k[0])
                if furniture(k[0]) >= least:
                    left_out.append(at)
                else:
                    furnish(k, at, least)

        if self.tree is None:
            return [""], sorted(constant)
        for node, path in content(self.tree, ""):
            found.append(path)
            narrowed = path.rpartition("\t")[2].partition(" ")[0] not in ("", "html", "body")
            if not any(furniture(x) > 1 for x in path.split("\t")):
                furnish(node, path, 2 if narrowed else 1)
        return sorted(found), sorted({*left_out, *constant})


def text_of(found: list[Block], regions: list[str], left_out: list[str]) -> str | None:
    """The page's blocks inside the regions without what is left out of them, or None if no region occurs on the page."""
    roots, drop, known, out = [tuple(r.split("\t")) if r else () for r in regions], {tuple(r.split("\t")) for r in left_out}, {}, []
    for path, text, _ in found:
        inside = known.get(path)
        if inside is None:
            # 0: in no region, 1: left out, 2: content
            inside = known[path] = 0 if not any(path[: len(r)] == r for r in roots) else 1 if any(path[:k] in drop for k in range(1, len(path) + 1)) else 2
        if inside == 2:
            out.append(text)
    return "\n".join(out) if any(known.values()) or not found else None


def extract(html: str, regions: list[str] | None = None, left_out: list[str] | None = None) -> str:
    """Main text of a page along its host's wrapper; without one, or if the wrapper fails on it, along its own."""
    found, seen = blocks(html)
    text = text_of(found, regions, left_out or []) if regions else None
    if text is None:
        own = Wrapper()
        own.add(found, seen)
        text = text_of(found, *own.regions())
    return text or ""


#: Hosts whose partial wrappers a task holds before it hands them on; parts in which a host's partial wrappers are merged first.
HELD, PARTS = 2_000, 16


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, regions, left_out) from (host, html)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Wrapper] = {}

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([w.dumps() for w in held.values()], pa.string())], names=["host", "wrapper"])
            held.clear()
            return batch

        for batch in batches:
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.setdefault(host, Wrapper()).add(*blocks(html.as_py() or ""))
                if len(held) > HELD:
                    yield out()
        yield out()

    def one(part: pa.Table) -> Wrapper:
        total = Wrapper()
        for w in sorted(part.column("wrapper").to_pylist()):
            total.merge(Wrapper.loads(w))
        return total

    def some(key: tuple, part: pa.Table) -> pa.Table:
        return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "wrapper": pa.array([one(part).dumps()], pa.string())})

    def final(key: tuple, part: pa.Table) -> pa.Table:
        regions, left_out = one(part).regions()
        return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "regions": pa.array([regions], pa.list_(pa.string())), "left_out": pa.array([left_out], pa.list_(pa.string()))})

    first = pages.select("host", "html").mapInArrow(partial, "host string, wrapper string")
    parts = first.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(PARTS)).cast("int")).groupBy("host", "part").applyInArrow(some, "host string, wrapper string")
    return parts.groupBy("host").applyInArrow(final, "host string, regions array<string>, left_out array<string>")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, host, text) for every row."""
    url = F.col(url_col).cast("string")
    host = F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), host.alias("host"), F.col(html_col).cast("string").alias("html"))
    found = cut(wrappers(rows))
    n = found.count()
    if n <= BROADCAST_ROWS:
        both = rows.join(F.broadcast(found), "host", "left")
    else:
        dealt = rows.withColumn("deal", F.pmod(F.xxhash64("page_id", "url"), F.lit(64)).cast("int"))
        both = dealt.join(found.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(63)))), ["host", "deal"], "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py() or "", r.as_py(), c.as_py()) for h, r, c in zip(*[batch.column(k) for k in (3, 4, 5)], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string())], names=["page_id", "url", "host", "text"])

    return both.select("page_id", "url", "host", "html", "regions", "left_out").mapInArrow(read, "page_id long, url string, host string, text string")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "host")

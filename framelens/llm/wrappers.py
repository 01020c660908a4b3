"""Main-text extraction by wrappers: union-free expressions inferred from the pages of each host.

A page is a tree of block elements and texts; inline markup belongs to the text around it.  Runs of
alike siblings, and tandem repeats, fold into repeated groups.  The wrapper of a host is made by
aligning its different pages one after the other: elements that both sides have are merged, those that
one side lacks become optional, runs become repeated, and texts that differ become slots, while texts
that every page has at their place stay constants of the template.  Pages are aligned in the order of
their digests, in about as many groups as a group has pages, and the groups' wrappers in order then:
no task gathers a host, and the layout of the input makes no difference.

A sequence of over ``WIDEST`` different neighbours is generalised to one repeated group, so an
alignment has a bound, and elements more than ``DEEPEST`` deep are not modelled; texts are taken from
pages of any width and depth.

Each page is matched against its host's expression, child by child, optional elements skipped and
repeated ones met again.  What the expression shows to be template (constants, lists of links outside
the article) is left out; of the rest the slots are taken: those of the article, if the page has one.
Tags with a meaning (nav, footer, form ...) and names of classes decide only where no inference can:
a random advert differs from page to page like an article does.  A name counts if all of its words
belong to such names (``ad-box``, not ``share-price``), and not for a block with most of a host's text.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import stage, text_groups, unstage

#: Elements that are part of the text they stand in; all others are blocks.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "noembed", "noframes", "xmp")
#: Elements that a start tag of the same set closes, with those that bound the search.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BOUNDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "p": ("div", "td", "li", "article", "section", "blockquote", "body", "main")}
NO_TEXT = frozenset("head nav footer aside form button select menu dialog iframe object embed script style noscript template textarea title svg noembed noframes xmp canvas audio video map".split())
CONTAINERS = ("article", "main")
#: Words of class, id or role that mark what is no main text, and words that may stand beside them.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising aside alert alerts banner banners breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disclaimer disqus footer footers form forms gdpr header headers hidden login masthead menu menus modal nav navbar navigation newsletter newsletters notice notices overlay pager pagination popup popups promo promos promotion promoted recommended recommendations related replies reply respond search share sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription toolbar widget widgets".split()
)
BESIDE = frozenset(
    "a area article bar big block blog body bottom box boxes button buttons by card cards col column container content count desktop div element entry first fixed float floating global google grid group holder icon icons id inline inner item items large last left link links list main mini mobile new news of outer page panel post posts primary reader readers right row section secondary site slot small sticky story text the thread title top unit user users visitor wide wrap wrapper".split()
)
CONTENT = frozenset("article post entry story content main body text".split())
#: Children of an element, and different labels, beyond which they are generalised; depth of expressions.
WIDEST, DEEPEST = 64, 40
#: Pages of a host at which texts that all of them have are template; more for texts of LONG characters, and within an article.
PAGES, LONG, LONG_PAGES = 3, 200, 10
#: What is left without template must be one of so many parts of the text.
LEFT = 5
#: Share of link text at which a repeated list is a menu.
LINKED = 0.6

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>(?P<in>.*?)(?:</(?P=raw)\b[^>]*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attr>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_MARKS = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


class Text(str):
    """A text with the number of its characters that are links."""

    __slots__ = ("links",)


@dataclass(slots=True)
class Node:
    """A block element: its tag, its marks (names of class, id and role), and its texts and elements."""

    tag: str
    marks: tuple[str, ...] = ()
    items: list = field(default_factory=list)

    @property
    def label(self) -> str:
        return ".".join((self.tag, *self.marks))


def _marks(attributes: str) -> tuple[str, ...]:
    """Names without digits, their words joined by hyphens."""
    found = set()
    for m in _MARKS.finditer(attributes):
        name = m[1].lower()
        if name == "hidden" or name == "aria-hidden" and (m[2] or m[3] or m[4]) == "true":
            found.add("hidden")
        elif name in ("class", "id", "role"):
            split = re.sub(r"([a-z])([A-Z])", r"\1-\2", m[2] or m[3] or m[4] or "").lower().split()
            found.update("-".join(w) for x in split if (w := re.findall(r"[a-z]+", x)))
    return tuple(sorted(found))


def noise_mark(mark: str, words: frozenset = NOISE) -> bool:
    """Whether a name says that its element is no main text: all its words do, or may stand beside such."""
    parts = mark.split("-")
    return any(w in words for w in parts) and all(w in NOISE or w in BESIDE for w in parts)


def parse(source: str) -> Node:
    """The tree of block elements, of any depth; unclosed and misplaced tags are tolerated."""
    root = Node("")
    stack, text, at = [root], [], 0
    open_: Counter[str] = Counter()
    links = linked = 0

    def flush():
        nonlocal links
        joined = Text(" ".join(html.unescape("".join(text)).split()))
        if joined:
            joined.links = min(links, len(joined))
            stack[-1].items.append(joined)
        text.clear()
        links = 0

    def close(depth: int):
        for x in stack[depth:]:
            open_[x.tag] -= 1
        del stack[depth:]

    for m in _TOKEN.finditer(source):
        if m.start() > at:
            text.append(source[at : m.start()])
            links += linked and len(text[-1].strip())
        at = m.end()
        tag = (m["tag"] or "").lower()
        if m["raw"]:
            if m["raw"].lower() not in INLINE:
                flush()
            continue
        if tag == "a":
            linked = not m["end"]
        if not tag or tag in INLINE and not (open_[tag] > 0 if m["end"] else any(map(noise_mark, _marks(m["attr"])))):
            continue  # inline, unless its marks make it noise
        if tag in ("br", "hr") or tag in VOID:
            text.append(" ")
            continue
        flush()
        if m["end"]:
            if open_[tag] > 0:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        for closed in CLOSES.get(tag, ()) if tag in CLOSES else ("p",):
            if open_[closed] <= 0:
                continue
            bounds = BOUNDS.get(tag, BOUNDS["p"])
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == closed:
                    close(i)
                    break
                if stack[i].tag in bounds:
                    break
        node = Node(tag, _marks(m["attr"]))
        stack[-1].items.append(node)
        stack.append(node)
        open_[tag] += 1
    text.append(source[at:])
    flush()
    return root


# Expressions: ["t", digests, characters, of links, pages] a text, where digests are those that every
# page with this text has (0: a slot); [label, optional, repeated, items] an element; ["+", 0, 1, items] a repeated group.


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(errors="surrogatepass"), digest_size=6).digest(), "big") | 1


def expression(node: Node, depth: int = 0) -> list:
    deep = depth >= DEEPEST
    items = [] if deep else [["t", [_digest(x)], len(x), x.links, 1] if isinstance(x, str) else expression(x, depth + 1) for x in node.items]
    return [node.label, 0, 0, _fold(items)]


def _fold(items: list) -> list:
    """Neighbours of one label, and tandem repeats of two or three labels, become repeated groups."""
    items = _fold_one(items)
    for period in (2, 3):
        out, i = [], 0
        while i < len(items):
            n = 1
            block = [x[0] for x in items[i : i + period]]
            while len(block) == period and "+" not in block and [x[0] for x in items[i + n * period : i + (n + 1) * period]] == block:
                n += 1
            if n > 1:
                out.append(["+", 0, 1, [_one(items[i + k : i + n * period : period]) for k in range(period)]])
                i += n * period
            else:
                out.append(items[i])
                i += 1
        items = out
    return _narrow(_fold_one(items))


def _one(items: list) -> list:
    """Items of one label and page merged, halves first, so that none is copied more often than its depth in a tree."""
    while len(items) > 1:
        items = [merge(*items[i : i + 2], True) if i + 1 < len(items) else items[i] for i in range(0, len(items), 2)]
    return items[0]


def _fold_one(items: list) -> list:
    out: list = []
    for label, run in groupby(items, key=lambda x: x[0]):
        run = list(run)
        out.append(_one(run))
        if len(run) > 1 and label != "t":
            out[-1][2] = 1
    return out


def _narrow(items: list) -> list:
    """A sequence that is too long becomes one repeated group of its labels; of too many labels only the tags stay."""
    if len(items) <= WIDEST:
        return items
    flat = [y for x in items for y in (x[3] if x[0] == "+" else [x])]
    if len({x[0] for x in flat}) > WIDEST:
        flat = [x if x[0] == "t" else [x[0].split(".")[0], *x[1:]] for x in flat]
    alike: dict[str, list] = {}
    for x in flat:
        alike.setdefault(x[0], []).append(x)
    made = [_one(x) for _, x in sorted(alike.items())]
    return [["+", 0, 1, [x if x[0] == "t" else [x[0], 1, 1, x[3]] for x in made]]]


def merge(a: list, b: list, same_page: bool = False) -> list:
    """The least expression of this kind that covers both; their labels are the same."""
    if a[0] == "t":
        x, y = set(a[1] or ()), set(b[1] or ())
        return ["t", sorted(x | y if same_page else x & y) or 0, a[2] + b[2], a[3] + b[3], max(a[4], b[4]) if same_page else a[4] + b[4]]
    return [a[0], a[1] | b[1], a[2] | b[2], align(a[3], b[3], same_page)]


def align(a: list, b: list, same_page: bool = False) -> list:
    """Both sequences by their longest common subsequence of labels; what one lacks is optional."""
    if [x[0] for x in a] == [x[0] for x in b]:
        return [merge(x, y, same_page) for x, y in zip(a, b)]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][0] == b[j][0]:
            out.append(merge(a[i], b[j], same_page))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append(_optional(a[i]))
            i += 1
        else:
            out.append(_optional(b[j]))
            j += 1
    return _narrow(_fold_one(out))


def _optional(x: list) -> list:
    return x if x[0] == "t" else [x[0], 1, *x[2:]]


def noisy(tag: str, marks, inside: bool) -> bool:
    """By tag and names alone. ``inside``: within the article, where a header belongs to it."""
    if tag in NO_TEXT or tag == "header" and not inside:
        return True
    if tag in CONTAINERS or tag in ("body", "html"):
        return "hidden" in marks
    return any(noise_mark(m, NOISE - {"header", "headers", "masthead"} if inside else NOISE) for m in marks)


def _mass(x: list) -> tuple[int, int]:
    """Characters of text, and of links, in an expression."""
    if x[0] == "t":
        return x[2], x[3]
    found = [_mass(y) for y in x[3]] if x[0] == "+" or x[0].split(".")[0] not in NO_TEXT else []
    return sum(f[0] for f in found), sum(f[1] for f in found)


# Programs: [label, repeated, verdict, items] an element, where the verdict is 0, "drop" or "keep" (against
# its names); ["+", 1, 0, items] a repeated group; ["t", digests, pages] a text with its constants.


def program(wrapper: list, pages: int) -> dict:
    """What to do with the pages of a host: the labels of content elements, and the decisions by place."""
    total = _mass(wrapper)[0]
    content: Counter[str] = Counter()

    def visit(x, inside):
        if x[0] == "t":
            return ["t", x[1] or [], x[4]] if x[4] >= PAGES else ["t", [], 0]
        if x[0] == "+":
            return ["+", 1, 0, [visit(y, inside) for y in x[3]]]
        tag, *marks = x[0].split(".")
        mass, links = _mass(x)
        verdict = 0
        if noisy(tag, marks, inside):
            if tag in NO_TEXT or tag == "header" or "hidden" in marks or 2 * (mass - links) <= total or pages < PAGES:
                return [x[0], x[2], 0, []]
            verdict = "keep"
        if not inside and pages >= PAGES and links > LINKED * mass and any(y[0] == "+" or y[0] != "t" and y[2] for y in x[3]):
            return [x[0], x[2], "drop", []]
        if not inside and tag in ("div", "section", "td") and any(m in CONTENT or len(p := m.split("-")) > 1 and all(w in CONTENT or w in BESIDE for w in p) and CONTENT & set(p) for m in marks):
            content[x[0]] += mass - links
        items = [visit(y, inside or tag in CONTAINERS) for y in x[3]]
        live = any(y[1] if y[0] == "t" else y[2] or y[3] for y in items)
        return [x[0], x[2], verdict, items if live else []]

    return {"content": [c for c, _ in sorted(content.items(), key=lambda c: (-c[1], c[0]))[:1]], "root": [visit(x, False) for x in wrapper[3]]}


def _step(items: list, at: int, label: str) -> tuple[list | None, int]:
    """The item that the next child is an instance of, and the place to go on from."""
    for j in range(at, len(items)):
        x = items[j]
        if x[0] == "+":
            for y in x[3]:
                if y[0] == label or y[0] == label.split(".")[0]:
                    return y, j
        elif x[0] == label:
            return x, j if x[0] == "t" or x[1] else j + 1
    return None, at


def _matched(root: Node, rules: dict, region) -> list[tuple[str, bool]]:
    """Texts of a page in order, and whether they are template; ``region``: the test for elements to take, or None for all."""
    out, constants = [], {}
    stack = [(iter(root.items), rules["root"], [0], region is None, False)]
    while stack:
        children, items, at, taken, inside = stack[-1]
        x = next(children, None)
        if x is None:
            stack.pop()
            continue
        own, at[0] = _step(items, at[0], "t" if isinstance(x, str) else x.label)
        if isinstance(x, str):
            if taken:
                known = constants.setdefault(id(own), set(own[1])) if own else ()
                out.append((x, bool(known) and (own[2] >= LONG_PAGES or region is None and len(x) < LONG) and _digest(x) in known))
            continue
        verdict = own[2] if own else 0
        if verdict == "drop" and not inside and not taken or verdict == "drop" and region is None or noisy(x.tag, x.marks, inside) and verdict != "keep":
            continue
        enters = region is not None and not taken and region(x)
        stack.append((iter(x.items), own[3] if own else [], [0], taken or enters, inside or enters or x.tag in CONTAINERS))
    return out


def extract(root: Node, rules: dict) -> str:
    """The text of the page's article, else of its main element, else of its host's content element, else all that is neither noise nor template.

    Template texts stay where little else would be left.
    """
    content = set(rules["content"])
    for region in (lambda x: x.tag == "article", lambda x: x.tag == "main", lambda x: x.label in content, None):
        found = _matched(root, rules, region)
        if found:
            break
    kept = [x for x, constant in found if not constant]
    if LEFT * sum(map(len, kept)) < sum(len(x) for x, _ in found):
        kept = [x for x, _ in found]
    return " ".join(kept)


def host(url: str | None) -> str:
    found = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", url or "")
    return found[1].rpartition("@")[2].lower() if found else ""


def _expressions(batches):
    for batch in batches:
        for group in text_groups(batch, "html"):
            made = [json.dumps(expression(parse(source or "")), separators=(",", ":")) for source in group.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([host(u) for u in group.column(0).to_pylist()]), pa.array([_digest(x) for x in made], pa.int64()), pa.array(made)], ["host", "digest", "wrapper"])


def _merger(batches):
    """Rows (host, part, at, wrapper) come sorted by the first three; each (host, part) is merged in order into one expression."""
    last, held, names = None, None, ["host", "part", "wrapper"]

    def out():
        return pa.RecordBatch.from_arrays([pa.array([last[0]]), pa.array([last[1]], pa.int64()), pa.array([json.dumps(held, separators=(",", ":"))])], names)

    for batch in batches:
        for name, part, _, wrapper in zip(*(c.to_pylist() for c in batch.columns)):
            made = json.loads(wrapper)
            if (name, part) != last:
                if last is not None:
                    yield out()
                last, held = (name, part), made
            else:
                held = merge(held, made)
    if last is not None:
        yield out()


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, pages): the expression of every host, as JSON, and how many different pages it was made of."""
    made = stage(pages.select("url", "html").mapInArrow(_expressions, "host string, digest long, wrapper string"), "expressions")
    hosts = made.select("host", "digest").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    hosts = stage(hosts.withColumn("parts", F.ceil(F.sqrt("pages"))), "hosts")
    one = made.dropDuplicates(["host", "digest"]).join(hosts, "host").select("host", F.pmod(F.xxhash64("digest"), "parts").alias("part"), F.col("digest").alias("at"), "wrapper")
    merged = lambda df: df.repartition("host", "part").sortWithinPartitions("host", "part", "at").mapInArrow(_merger, "host string, part long, wrapper string")
    two = merged(one).select("host", F.lit(0).cast("long").alias("part"), F.col("part").alias("at"), "wrapper")
    out = stage(merged(two).select("host", "wrapper").join(hosts.select("host", "pages"), "host"), "wrappers")
    unstage(made, hosts)
    return out


def _programs(batches):
    for batch in batches:
        rules = [json.dumps(program(json.loads(w), n), separators=(",", ":")) for w, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_digest(r) for r in rules], pa.int64()), pa.array(rules, pa.string())], ["of", "id", "program"])


def _extractor(batches):
    rules: dict[int, dict] = {}
    plain = {"content": [], "root": []}
    for batch in batches:
        for group in text_groups(batch, "html"):
            texts = []
            for i, (source, key) in enumerate(zip(group.column(2).to_pylist(), group.column(3).to_pylist())):
                if key is not None and key not in rules:
                    if len(rules) > 1000:
                        rules.clear()
                    rules[key] = json.loads(group.column(4)[i].as_py())
                texts.append(extract(parse(source or ""), plain if key is None else rules[key]))
            yield pa.RecordBatch.from_arrays([group.column(0), group.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``.

    A null or empty page, and one without main text, has an empty text.  A null url, and one without a
    host, shares the wrapper of the empty host.  Copies of a page count as one page of their host.
    Repeated rows give alike rows, and so does any layout of the input; an empty table gives none;
    other columns are not read.
    """
    made = wrappers(pages)
    programs = stage(made.select("host", "wrapper", "pages").mapInArrow(_programs, "of string, id long, program string"), "programs")
    unstage(made)
    keyed = pages.select("page_id", "url", "html", F.lower(F.regexp_replace(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1), "^.*@", "")).alias("host"))
    joined = keyed.join(programs, F.col("host") == F.col("of"), "left").select("page_id", "url", "html", "id", "program")
    return joined.mapInArrow(_extractor, "page_id long, url string, text string, n_chars long")

"""Operator 4: HTML extraction by union-free regular-expression inference.

A page is read as a tree of block elements with text slots. The pages of a
host are aligned one after the other into a wrapper, a union-free regular
expression over such trees: siblings of one kind and repeated sequences become
repeated groups, elements that some pages lack become optional ones, and texts
that differ become slots, while a text that outvotes the others of its place,
from two pages of different text on, is part of the template. The wrapper then tells where a host keeps its article: its
data slots are read from every page, template text and what the element names
mark as menus, adverts, comments and so on is left out.

Scale: alignment is associative enough to be done in parts. Each task folds
its pages into one wrapper a host, so what is shuffled is some hundred bytes
a host and task, however many pages a host has. These are merged by (host,
one of ``SALTS``) and then by host, never more than one task's wrappers or
``SALTS`` rows a group at a time. Only the rules found (a path and some text hashes a host)
meet the pages again, broadcast up to ``BROADCAST_HOSTS`` hosts and joined
beyond, where AQE splits a hot host.
"""

from __future__ import annotations

import html
import json
import re
import sys
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from matchbook.llm.common import map_arrow, ship_package, without, written
from matchbook.llm.urlfilter import host_of

SALTS = 64
BROADCAST_HOSTS = 50_000  # times some hundred bytes
TEMPLATE_SHARE = 0.8  # a text is template if it outvotes the others of its place by this share of the place's pages
LONGEST_GROUP = 4  # elements of a repeated sequence
ADDED = ("text", "n_chars")

# Element names by their meaning
RAW = "script style noscript template textarea title iframe noembed noframes xmp svg math object"
VOID = set("area base br col embed hr img input link meta source track wbr".split())
INLINE = set("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small
  span strike strong sub sup time tt u var wbr img area""".split())
DROPPED = set("nav footer aside form menu dialog button select input optgroup option fieldset head audio video canvas map".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
DROPPED_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
DROPPED_WORDS = set("""ad ads adv advert adverts advertisement advertising adsense banner banners promo promotion promoted sponsor
  sponsored cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup sidebar
  sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead comment
  comments disqus respond reply replies discussion share sharing social related recommended recommendations login toolbar
  alert paywall""".split())
HEADER_WORDS = set("header heading topbar".split())
MAIN_WORDS = set("content article articlebody post entry story main body text".split())
# a start tag of the left name ends an open element of the right names
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "tbody": {"tr", "td", "th", "thead", "tbody"}, "thead": set(), "option": {"option"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW.split()) + r")\b(?:[^>\"']|\"[^\"<]*\"|'[^'<]*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"<]*\"|'[^'<]*'|[\"'])*?)>|<[!?][^>]*>", re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+")


class Node:
    """A block element of a page, or of a wrapper; ``#`` is a text."""

    __slots__ = ("name", "words", "role", "hidden", "children", "text", "key")

    def __init__(self, name: str, words: tuple[str, ...] = (), role: str = "", hidden: bool = False):
        self.name, self.words, self.role, self.hidden = name, words, role, hidden
        self.children: list[Node] = []
        self.text = ""
        self.key = name + "".join("." + w for w in words)


def _element(name: str, attributes: str) -> Node:
    words, role, hidden = [], "", False
    for m in _ATTRIBUTE.finditer(attributes) if attributes.strip() else ():
        what, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if what == "role":
            role = value.lower()
        elif what == "hidden":
            hidden = True
        else:
            words += [w.lower() for w in _WORD.findall(value)]
    return Node(name, tuple(dict.fromkeys(words)), role, hidden)


def parse(page: str) -> Node:
    """The tree of block elements of a page; texts are decoded, white space is one blank."""
    root = Node("html")
    stack, buffer = [root], []
    open_names = Counter()

    def close(depth: int) -> None:
        open_names.subtract(x.name for x in stack[depth:])
        del stack[depth:]

    def flush() -> None:
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                leaf = Node("#")
                leaf.text = text
                stack[-1].children.append(leaf)

    at = deepest = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            buffer.append(page[at:m.start()])
        at = m.end()
        if not m[3]:  # comment, raw element, declaration
            continue
        name = m[3].lower()
        if name in INLINE:
            continue
        if name == "br":
            buffer.append(" ")
            continue
        flush()
        if m[2]:
            if open_names[name] > 0:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name))
            continue
        if name in ("html", "body"):
            continue
        ends = CLOSES.get(name, {"p"} | HEADINGS if name in HEADINGS else {"p"})
        if len(stack) > 1 and stack[-1].name in ends:
            close(len(stack) - 1)
        node = _element(name, m[4])
        stack[-1].children.append(node)
        if name not in VOID and not m[4].endswith("/"):
            stack.append(node)
            open_names[name] += 1
            deepest = max(deepest, len(stack))
    buffer.append(page[at:])
    flush()
    allow_depth(deepest)
    return root


def allow_depth(n: int) -> None:
    """Let the functions below recurse into trees of this depth: four frames a level at most, all of them Python's own.

    They call each other directly, not from within sum() or a generator, so that no level takes C stack.
    """
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 5 * n + 1000))


def dropped(node: Node, in_article: bool) -> bool:
    """True for elements whose name, role or class says that they are no article text."""
    if node.name in DROPPED or node.role in DROPPED_ROLES or node.hidden:
        return True
    if not in_article and (node.name == "header" or HEADER_WORDS.intersection(node.words)):
        return node.name not in HEADINGS
    return bool(DROPPED_WORDS.intersection(node.words)) and node.name not in ("article", "main")


# -- wrappers: [key, pages, optional, repeated, characters, text hash, its votes, page or 0, children] --
# The hash is the majority vote over the pages: each page with another text takes one vote away, so a
# text on nine pages of ten has at least eight votes a ten. PAGE is the digest of the page that voted,
# 0 once two pages of different text agree: copies of one page make no template.

KEY, PAGES, OPTIONAL, REPEATED, CHARS, HASH, VOTES, PAGE, CHILDREN = range(9)


def wrapper_of(node: Node, page: int | None = None) -> list:
    """The wrapper that fits exactly this element."""
    if page is None:
        page = xxh3_64_intdigest(" ".join(texts_of(node, False))) or 1
    if node.name == "#":
        return ["#", 1, False, False, len(node.text), xxh3_64_intdigest(node.text) or 1, 1, page, []]
    return [node.key, 1, False, False, 0, 0, 0, 0, fold([wrapper_of(c, page) for c in node.children])]


def _vote(a: list, b: list, same_page: bool) -> tuple[int, int, int]:
    if a[HASH] == b[HASH]:
        votes = max(a[VOTES], b[VOTES]) if same_page else a[VOTES] + b[VOTES]
        return a[HASH], votes, a[PAGE] if a[PAGE] == b[PAGE] else 0
    if same_page or a[VOTES] == b[VOTES]:
        return 0, 0, 0
    most, least = (a, b) if a[VOTES] > b[VOTES] else (b, a)
    return most[HASH], most[VOTES] - least[VOTES], most[PAGE]


def merge(a: list, b: list, same_page: bool = False) -> list:
    """Align two wrappers of one key."""
    pages = max(a[PAGES], b[PAGES]) if same_page else a[PAGES] + b[PAGES]
    return [a[KEY], pages, a[OPTIONAL] or b[OPTIONAL], a[REPEATED] or b[REPEATED] or same_page, a[CHARS] + b[CHARS],
            *_vote(a, b, same_page), align(a[CHILDREN], b[CHILDREN], same_page)]


def _optional(item: list) -> list:
    return [*item[:OPTIONAL], True, *item[OPTIONAL + 1:]]


def align(a: list[list], b: list[list], same_page: bool = False) -> list[list]:
    """Resolve mismatches of two sequences: what only one has becomes optional."""
    left, right = [x[KEY] for x in a], [x[KEY] for x in b]
    if left == right:
        return [merge(x, y, same_page) for x, y in zip(a, b)]
    out = []
    for what, i, j, k, n in SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
        if what == "equal":
            out += [merge(x, y, same_page) for x, y in zip(a[i:j], b[k:n])]
        else:
            out += [_optional(x) for x in a[i:j]] + [_optional(x) for x in b[k:n]]
    return fold(out)


def fold(items: list[list]) -> list[list]:
    """Replace repeated sequences of siblings (squares) by repeated groups."""
    for size in range(1, LONGEST_GROUP + 1):
        out, i = [], 0
        keys = [x[KEY] for x in items]
        while i < len(items):
            here, n = keys[i:i + size], 1
            while len(here) == size and keys[i + n * size:i + (n + 1) * size] == here:
                n += 1
            if n == 1:
                out.append(items[i])
                i += 1
                continue
            merged = items[i:i + size]
            for r in range(1, n):
                merged = [merge(x, y, True) for x, y in zip(merged, items[i + r * size:i + (r + 1) * size])]
            if size == 1:
                out += merged
            else:
                out.append(["(" + " ".join(here) + ")", max(x[PAGES] for x in merged), False, True, 0, 0, 0, 0, merged])
            i += n * size
        items = out
    return items


def _words(key: str) -> tuple[str, list[str]]:
    name, *words = key.split(".")
    return name, words


def _as_node(w: list) -> Node:
    name, words = _words(w[KEY])
    return Node(name, tuple(words))


def _steps(w: list) -> list[list]:
    """Child elements that are not dropped; groups have no step of their own."""
    out, todo = [], list(reversed(w[CHILDREN]))
    while todo:
        child = todo.pop()
        if child[KEY].startswith("("):
            todo += reversed(child[CHILDREN])
        elif child[KEY] != "#" and not dropped(_as_node(child), False):
            out.append(child)
    return out


def kept_chars(w: list, found: dict[int, int]) -> int:
    """Characters outside dropped elements; ``found`` gets those of each element, by its id()."""
    n = w[CHARS]
    for c in w[CHILDREN]:
        if c[KEY][0] in "#(" or not dropped(_as_node(c), False):
            n += kept_chars(c, found)
    found[id(w)] = n
    return n


def _path(link: tuple | None) -> tuple[str, ...]:
    out = []
    while link:
        link, key = link
        out.append(key)
    return tuple(reversed(out))


def rules_of(wrapper: list) -> dict:
    """Where the host keeps its article, and which texts there are template."""
    size: dict[int, int] = {}
    kept_chars(wrapper, size)
    tiers = [lambda n, w: n == "article", lambda n, w: n == "main",
             lambda n, w: n in ("div", "section", "td") and bool(MAIN_WORDS.intersection(w))]
    fitting: list[list] = [[] for _ in tiers]  # (depth, path as links, wrapper) in page order
    todo, links = [(0, None, wrapper)], {}
    while todo:
        depth, link, w = todo.pop()
        if link:
            name, words = _words(w[KEY])
            for tier, fits in zip(fitting, tiers):
                if fits(name, words):
                    tier.append((depth, link, w))
        for c in reversed(_steps(w)):  # siblings of one key, also of several parents of one path, share a link
            todo.append((depth + 1, links.setdefault((id(link), c[KEY]), (link, c[KEY])), c))
    for tier in fitting:
        if tier:
            own: dict[int, list] = {}
            for x in tier:
                own.setdefault(id(x[1]), []).append(x)
            best = max(own.values(), key=lambda x: (sum(size[id(w)] for *_, w in x), -x[0][0]))
            path, main = _path(best[0][1]), [w for *_, w in best]
            break
    else:  # down to the smallest element that has most of the text
        path, main = (), wrapper
        while True:
            best = max(_steps(main), key=lambda x: size[id(x)], default=None)
            if not best or best[REPEATED] or size[id(best)] < 0.7 * size[id(main)]:
                break
            path, main = (*path, best[KEY]), best
        main = [main]
    pages = max(w[PAGES] for w in main)  # with the article's element; an error page may lack it
    constant: list[int] = []
    total = {"all": 0, "slots": 0}

    def walk(w: list, repeated: bool, heading: bool) -> None:
        for c in w[CHILDREN]:
            if c[KEY] == "#":
                total["all"] += c[CHARS]
                agreed = c[HASH] and not c[PAGE] and c[VOTES] >= TEMPLATE_SHARE * c[PAGES] and 2 * c[VOTES] > pages
                if agreed and not (repeated or c[REPEATED] or heading):
                    constant.append(c[HASH])
                elif not c[HASH] or c[VOTES] < c[PAGES]:
                    total["slots"] += c[CHARS]
            else:
                walk(c, repeated or c[REPEATED], heading or _words(c[KEY])[0] in HEADINGS)

    for w in main:
        walk(w, False, False)
    return {"path": list(path), "template": constant if 2 * total["slots"] >= total["all"] else []}


# -- extraction ---------------------------------------------------------------

def _find(node: Node, path: list[str]) -> list[Node]:
    """The elements at a path, in page order, without those that are dropped."""
    found = [node]
    for key in path:
        found = [c for x in found for c in x.children if c.key == key and not dropped(c, False)]
    return found


def texts_of(node: Node, in_article: bool) -> list[str]:
    out, todo = [], list(reversed(node.children))
    while todo:
        c = todo.pop()
        if c.name == "#":
            out.append(c.text)
        elif c.name == "header" and in_article:
            todo += reversed([x for h in c.children if h.name in HEADINGS for x in h.children])
        elif not dropped(c, in_article):
            todo += reversed(c.children)
    return out


# -- wrappers as text: flat, as JSON's own nesting is bounded ------------------

def pack(w: list) -> str:
    out, todo = [], [(0, w)]
    while todo:
        depth, x = todo.pop()
        out.append([depth, *x[:CHILDREN]])
        todo += [(depth + 1, c) for c in reversed(x[CHILDREN])]
    return json.dumps(out)


def unpack(text: str) -> list:
    parents: list[list] = []
    deepest = 0
    for depth, *fields in json.loads(text):
        del parents[depth:]
        item = [*fields, []]
        if parents:
            parents[-1][CHILDREN].append(item)
        parents.append(item)
        deepest = max(deepest, depth)
    allow_depth(deepest)
    return parents[0]


def extract(page: str, rules: dict) -> str:
    """Texts of the article's slots in page order; of the whole page's kept elements if it lacks the path."""
    root = parse(page)
    main = _find(root, rules["path"]) or _find(root, rules_of(wrapper_of(root))["path"]) or [root]
    texts = [t for x in main for t in texts_of(x, x.name in ("article", "main"))]
    template = set(rules["template"])
    return " ".join(t for t in texts if not template or xxh3_64_intdigest(t) not in template)


# -- Spark ----------------------------------------------------------------------

def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper a host from the pages of a task."""
    from pyspark import TaskContext

    wrappers: dict[str, list] = {}
    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            if page:
                own = wrapper_of(parse(page))
                wrappers[host] = merge(wrappers[host], own) if host in wrappers else own
    salt = TaskContext.get().partitionId() % SALTS
    yield pa.RecordBatch.from_pydict({"host": pa.array(list(wrappers), pa.string()),
                                      "salt": pa.array([salt] * len(wrappers), pa.int32()),
                                      "wrapper": pa.array([pack(w) for w in wrappers.values()], pa.string())})


def _merge_all(rows: pd.DataFrame) -> list:
    out = None
    for text in sorted(rows["wrapper"]):  # any order of arrival gives one result
        out = unpack(text) if out is None else merge(out, unpack(text))
    return out


def _merge_part(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "salt": [rows["salt"].iloc[0]], "wrapper": [pack(_merge_all(rows))]})


def _merge_rules(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"__wrapper_host": [rows["host"].iloc[0]], "rules": [json.dumps(rules_of(_merge_all(rows)))]})


def host_rules(pages: DataFrame) -> DataFrame:
    """(__wrapper_host, rules): a row a host with a page that is not empty."""
    ship_package(pages.sparkSession)
    parts = map_arrow(pages.select(host_of(F.col("url")).alias("host"), "html"), _infer, "host string, salt int, wrapper string")
    merged = parts.groupBy("host", "salt").applyInPandas(_merge_part, "host string, salt int, wrapper string")
    return merged.groupBy("host").applyInPandas(_merge_rules, "__wrapper_host string, rules string")


def _read(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for page, rules in zip(batch.column("html").to_pylist(), batch.column("__rules").to_pylist()):
                if rules not in known:
                    known[rules] = json.loads(rules) if rules else {"path": [], "template": []}
                texts.append(extract(page, known[rules]) if page else "")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())],
                                             names=[*names, "text"])
    return run


def extract_pages(pages: DataFrame) -> DataFrame:
    """Replace ``html`` by the article's ``text`` and its length ``n_chars``.

    One row a page; a page without html or text has the empty text. Pages
    whose url has no host share the empty host. A page that lacks its
    host's article element is read by a wrapper of its own. Repeated rows are
    read alike, input columns with the added names are replaced, an empty table
    stays empty.
    """
    pages = without(pages, ADDED)
    rules = written(host_rules(pages), "rules").withColumnRenamed("rules", "__rules")
    small = rules.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    with_host = pages.withColumn("__host", host_of(F.col("url")))
    joined = with_host.join(F.broadcast(rules) if small else rules, F.col("__host") == F.col("__wrapper_host"), "left")
    names = [c for c in pages.columns if c != "html"]
    schema = T.StructType([*pages.select(*[f"`{c}`" for c in names]).schema.fields, T.StructField("text", T.StringType())])
    read = map_arrow(joined.select(*[f"`{c}`" for c in names], "html", "__rules"), _read(names), schema)
    return read.withColumn("n_chars", F.length("text").cast("long"))

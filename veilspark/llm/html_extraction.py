"""Main text of web pages by wrappers inferred for each host.

Method: union-free regular-expression inference. A page's token stream is read
as nested groups: an element with its neighbours of the same name is one
repeated group. The streams of a host's pages are aligned group by group, by
the names from the root down: what differs in a text becomes a slot, a group
that some pages lack becomes optional, one that stands several times repeated.
Each group of the wrapper knows its contents and on how many pages, which differ
in their other text, each of them stands; copies of a page count once. All of
this is counting, so wrappers of parts of the input merge exactly, in any order:
over a whole table it is one aggregation by host, path and content.

A group is template where each of its contents stands on at least ``SUPPORT``
such pages, and a page loses its template groups. Only containers go, never a
heading, a paragraph or a sentence by itself; and within an article only
containers that look like a menu or buttons: without paragraphs, headings or
sentences, and with links or short labels alone. What the wrapper does not
settle is judged by element and class names.

A page is parsed once, in time proportional to its length: its texts and groups
are stored, and the template decides over those.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.tables import lean, small_batches
from veilspark.session import store

SUPPORT = 3
LABEL_WORDS = 3     # of a menu entry or button

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*"|'[^']*'|[^>"'])*+)>""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
_SPACE = re.compile(r"\s+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea iframe svg math title xmp noembed".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rt s samp small span strike "
                    "strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
                      "hr main menu nav ol p pre section table ul".split())
_CLOSES_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
                "option": {"option"}}
_SCOPES = frozenset("ul ol dl table article main section div body select td th blockquote".split())
_OUTSIDE = frozenset("head nav header footer aside form script style noscript template iframe button select option textarea dialog menu "
                     "svg math title object canvas audio video label fieldset".split())
_OUTSIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar "
    "breadcrumb breadcrumbs sidebar side aside footer header masthead topbar toolbar cookie cookies consent gdpr notice notices notification "
    "alert popup modal overlay newsletter subscribe subscription signup login search social share sharing comment comments disqus reply "
    "replies respond discussion related recommended recommendations widget pagination pager skip copyright legal disclaimer complementary "
    "contentinfo form".split())
# What a class name may have beside those: site-header, share-buttons; but not has-sidebar or comment-open.
_BESIDE = frozenset("site page top bottom left right main global primary secondary box bar wrap wrapper container inner outer list links "
                    "link buttons button icons area block section item items mobile desktop post posts articles stories news".split())
# These go only with what holds them.
_PARAGRAPHS = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre table figure dl".split())
_PARTS = _PARAGRAPHS | frozenset("html body li dt dd tr td th thead tbody tfoot caption figcaption article main hr br".split())
_NO_CONTAINERS = _PARTS | _INLINE
_SENTENCE = re.compile(r"[.!?\u2026\u3002][\"'\u201d\u2019)]*$")
_NEVER_OUTSIDE = frozenset("html body main article".split())
_MAIN_NAMES = frozenset("main article article-body articlebody article-content article-text main-content main-text main-article".split())


def _signature(name: str, attributes: str) -> str:
    names = []
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id", "role", "itemprop"):
            names += ["-".join(re.findall(r"[a-z]+", n)) for n in (m[2] or m[3] or m[4] or "").lower().split()]
    return name + "".join("." + n for n in dict.fromkeys(names) if n)


def tokens(page: str) -> Iterator[tuple[str, str]]:
    """('start', signature), ('end', name), ('void', name) and ('text', decoded text), in page order."""
    at = 0
    while True:
        found = _TOKEN.search(page, at)
        if found is None:
            break
        if found.start() > at:
            yield "text", html.unescape(page[at:found.start()])
        at = found.end()
        if found[2] is None:
            continue
        name = found[2].lower()
        if found[1]:
            yield "end", name
        elif name in _VOID:
            yield "void", name
        elif name in _RAW and not found[3].rstrip().endswith("/"):
            close = re.compile(rf"</{re.escape(name)}[\s/>]", re.IGNORECASE | re.ASCII).search(page, at)
            end = close.start() if close else len(page)
            yield "raw", name
            at = page.find(">", end) + 1 if close and page.find(">", end) >= 0 else len(page)
        else:
            yield "start", _signature(name, found[3])
    if at < len(page):
        yield "text", html.unescape(page[at:])


@lru_cache(maxsize=10_000)
def outside(signature: str) -> bool:
    """Whether an element is no part of an article, by its names: whole class names, never those of main elements."""
    name, *classes = signature.split(".")
    if name in _OUTSIDE:
        return True
    if name in _NEVER_OUTSIDE:
        return False
    parts = [set(c.split("-")) for c in classes]
    return any(p & _OUTSIDE_NAMES and p <= _OUTSIDE_NAMES | _BESIDE for p in parts)


@lru_cache(maxsize=10_000)
def main(signature: str) -> bool:
    name, *classes = signature.split(".")
    return name in ("article", "main") or bool(_MAIN_NAMES.intersection(classes))



def _number(*parts: bytes) -> int:
    return int.from_bytes(blake2b(b"\0".join(parts), digest_size=8).digest(), "little", signed=True)


def _bytes(number: int) -> bytes:
    return number.to_bytes(8, "little", signed=True)


INSIDE, ENCLOSED, OTHER, GONE = range(4)        # where a text lies: in an article, in one within surroundings, in none, outside


@dataclass
class Group:
    """An element, or neighbours of one name, as the page has it."""

    path: int                   # number of the names from the root down
    name: str
    parent: int                 # place in the page's list of groups, -1 for the root
    place: int = 0              # among the groups of its parent
    size: int = 1
    content: bytes = b""
    whole: bool = False         # holds (part of) a main element
    strict: bool = False        # lies in an article
    paragraphs: bool = False    # holds a paragraph, heading or sentence
    labels: bool = True         # all its texts are short
    letters: int = 0
    linked: int = 0             # letters in links

    @property
    def container(self) -> bool:
        return self.parent >= 0 and self.name.split(".", 1)[0] not in _NO_CONTAINERS

    @property
    def removable(self) -> bool:
        if self.whole or not self.container:
            return False
        return not self.strict or (not self.paragraphs and (self.labels or 2 * self.linked >= self.letters))


@dataclass
class Page:
    """What a page's template and names decide over: texts with their block, kind and group, and the groups."""

    texts: list[str] = field(default_factory=list)
    block: list[int] = field(default_factory=list)
    kind: list[int] = field(default_factory=list)
    group: list[int] = field(default_factory=list)
    groups: list[Group] = field(default_factory=list)
    has_main: bool = False      # has an article element that counts even if it is empty
    essence: int = 0            # of the texts that the names leave: pages that differ only in menus or adverts are copies


@dataclass
class _Open:
    """An open element: what holds for all below it, and what closing it needs."""

    name: str
    group: int
    drop: bool
    article: bool
    around: bool
    outside: bool
    link: bool
    parts: list[bytes] = field(default_factory=list)
    last: str = ""              # name of the last child
    last_group: int = -1
    children: int = 0


def parse(page: str) -> Page:
    """Reads a page in one pass; what HTML closes by itself is closed."""
    out = Page()
    root = Group(0, "", -1)
    out.groups.append(root)
    stack = [_Open("", 0, False, False, False, False, False)]
    at: dict[str, list[int]] = {}       # places of open elements, by name
    scopes: list[int] = []
    essence, block = blake2b(digest_size=8), 0

    def close(to: int) -> None:
        while len(stack) > to:
            done = stack.pop()
            at[done.name].pop()
            if scopes and scopes[-1] == len(stack):
                scopes.pop()
            group, parent = out.groups[done.group], stack[-1]
            digest = blake2b(b"\0".join([group.name.encode("utf-8", "surrogatepass"), *done.parts]), digest_size=8).digest()
            parent.parts.append(digest)
            group.content = digest if not group.content else blake2b(group.content + digest, digest_size=8).digest()
            above = out.groups[parent.group]
            if group.parent >= 0 and above is not group:
                above.whole |= group.whole
                above.paragraphs |= group.paragraphs
                above.labels &= group.labels

    def enter(signature: str) -> Group:
        parent = stack[-1]
        if parent.last == signature and parent.last_group >= 0:
            group = out.groups[parent.last_group]
            group.size += 1
        else:
            above = out.groups[parent.group]
            group = Group(_number(_bytes(above.path), signature.encode("utf-8", "surrogatepass")), signature, parent.group, parent.children,
                          strict=parent.article)
            parent.children += 1
            out.groups.append(group)
            parent.last_group = len(out.groups) - 1
        parent.last = signature
        return group

    for kind, value in tokens(page):
        if kind == "text":
            text = _SPACE.sub(" ", value)
            top = stack[-1]
            out.texts.append(value)
            out.block.append(block)
            out.group.append(top.group)
            out.kind.append(GONE if top.drop else OTHER if not top.article else ENCLOSED if top.around else INSIDE)
            if text and text != " ":
                raw = text.strip().encode("utf-8", "surrogatepass")
                top.parts.append(raw)
                top.last = ""
                group, words = out.groups[top.group], text.split()
                group.labels &= len(words) <= LABEL_WORDS
                group.paragraphs |= _SENTENCE.search(words[-1]) is not None
                group.letters += len(text)
                group.linked += len(text) if top.link else 0
                if not top.drop:
                    essence.update(raw + b"\0")
            continue
        name = value.split(".", 1)[0]
        if name not in _INLINE or kind == "raw":
            block += 1
        if kind == "start":
            if name in _CLOSES_P and at.get("p") and not (scopes and scopes[-1] > at["p"][-1]):
                close(at["p"][-1])
            same = _CLOSES_SAME.get(name)
            if same:
                last = max((at[n][-1] for n in same if at.get(n)), default=-1)
                if last >= 0 and not any(k > last for k in scopes[-1:] if stack[k].name not in same):
                    close(last)
            parent, group = stack[-1], enter(value)
            away = outside(value)
            if main(value):
                out.has_main |= not (parent.outside or away)
                opened = _Open(name, parent.last_group, False, True, parent.around or parent.drop, parent.outside or away, parent.link)
                group.whole = True
            else:
                opened = _Open(name, parent.last_group, parent.drop or away, parent.article, parent.around, parent.outside or away,
                               parent.link or name == "a")
            group.paragraphs |= name in _PARAGRAPHS
            at.setdefault(name, []).append(len(stack))
            if name in _SCOPES:
                scopes.append(len(stack))
            stack.append(opened)
        elif kind == "end":
            if at.get(value):
                close(at[value][-1])
        elif kind == "void":
            if value == "hr" and at.get("p") and not (scopes and scopes[-1] > at["p"][-1]):
                close(at["p"][-1])
            stack[-1].parts.append(b"<" + value.encode() + b">")
            enter(value).content = b"<>"
    close(1)
    for group in out.groups[:0:-1]:         # children stand behind their parents
        above = out.groups[group.parent]
        above.letters += group.letters
        above.linked += group.linked
    out.essence = int.from_bytes(essence.digest(), "little", signed=True)
    return out


# ------------------------------------------------------------------ wrappers

@dataclass
class Wrapper:
    """A group of a host's wrapper: the groups of all its pages that have one path."""

    name: str
    pages: int = 0
    repeated: bool = False
    places: int = 0             # sum over occurrences, of which there are ``count``: gives the order among the parent's groups
    count: int = 0
    seen: dict[int, set[int]] = field(default_factory=dict)     # content -> pages, told apart by their essence
    removable: bool = False
    texts: set[str] | None = field(default_factory=set)         # of a group without elements; None: a slot
    inner: dict[int, Wrapper] = field(default_factory=dict)


def infer(pages: list[str]) -> Wrapper:
    """The wrapper of some pages of one host."""
    top = Wrapper("")
    for read in map(parse, pages):
        top.pages += 1
        made, counted = {0: top}, set()
        own: dict[int, str] = {}
        for text, at in zip(read.texts, read.group, strict=True):
            if value := _SPACE.sub(" ", text).strip():
                own[at] = f"{own[at]} {value}" if at in own else value
        for k, group in enumerate(read.groups[1:], 1):
            node = made[k] = made[group.parent].inner.setdefault(group.path, Wrapper(group.name))
            node.pages += group.path not in counted
            counted.add(group.path)
            node.repeated |= group.size > 1
            node.places, node.count = node.places + group.place, node.count + 1
            node.removable |= group.removable
            node.seen.setdefault(_content(group), set()).add(read.essence)
            if k in own and node.texts is not None:
                node.texts = {own[k]} if node.texts <= {own[k]} and group.size == 1 else None
    return top


def _content(group: Group) -> int:
    return int.from_bytes(group.content[:8].ljust(8, b"\0"), "little", signed=True)


def expression(node: Wrapper, pages: int | None = None) -> str:
    """A wrapper as a regular expression: # is a text slot, other texts are quoted."""
    pages = node.pages if pages is None else pages
    text = "" if node.texts == set() else "#" if node.texts is None else json.dumps(next(iter(node.texts)), ensure_ascii=False)
    inner = text + "".join(expression(c, node.pages) for c in sorted(node.inner.values(), key=lambda c: (c.places / c.count, c.name)))
    inner = f"<{node.name}>{inner}</>" if node.name else inner
    mark = {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}[node.pages < pages, node.repeated]
    return f"({inner}){mark}" if mark else inner


def template_paths(wrapper: Wrapper) -> list[int]:
    """Paths of the groups that belong to the template."""
    found, todo = [], [wrapper]
    while todo:
        node = todo.pop()
        for path, child in node.inner.items():
            if child.removable and all(len(p) >= SUPPORT for p in child.seen.values()):
                found.append(path)
            todo.append(child)
    return sorted(found)


def wrappers(parsed: DataFrame) -> DataFrame:
    """(host, template): of each host the paths of template groups, from all of its pages (rows of :func:`parse_pages`).

    Pages are told apart by their essence before they are counted, so a host with any part of all pages is spread.
    """
    groups = parsed.select("host", "essence", F.inline(F.arrays_zip("path", "content", "removable"))).where("path != 0")
    counted = groups.groupBy("host", "path", "content").agg(F.count_distinct("essence").alias("n"), F.max("removable").alias("removable"))
    paths = counted.groupBy("host", "path").agg(F.min("n").alias("least"), F.max("removable").alias("removable"))
    return paths.where((F.col("least") >= SUPPORT) & F.col("removable")).groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("template"))


# ------------------------------------------------------------------ texts

def text_of(texts: list[str], block: list[int], kind: list[int], gone: list[bool], has_main: bool) -> str:
    """The main text: that of article elements, or where there are none of what is not outside.

    The names of what surrounds an article count only where other articles, or more text, stand outside such surroundings.
    """
    blocks: list[list[str]] = [[], [], []]
    last = [-1, -1, -1]
    for text, b, k, out in zip(texts, block, kind, gone, strict=True):
        if k == GONE or out:
            continue
        if k == INSIDE:
            has_main = True
        if b != last[k]:
            blocks[k].append(text)
            last[k] = b
        else:
            blocks[k][-1] += text
    inside, enclosed, other = (" ".join(filter(None, (_SPACE.sub(" ", t).strip() for t in b))) for b in blocks)
    return inside if has_main else max(other, enclosed, key=len)


def extract(page: str | None, template: frozenset[int] = frozenset()) -> str:
    """The main text of a page without the groups of its host's template."""
    if not page:
        return ""
    read = parse(page)
    removed = _removed([g.path for g in read.groups], [g.parent for g in read.groups], [g.removable for g in read.groups], template)
    return text_of(read.texts, read.block, read.kind, [removed[g] for g in read.group], read.has_main)


def _removed(path: list[int], parent: list[int], removable: list[bool], template: frozenset[int]) -> list[bool]:
    """Of each group whether it lies in one that the page loses; parents stand before their children."""
    out = [False]
    for k in range(1, len(path)):
        out.append(out[parent[k]] or (removable[k] and path[k] in template))
    return out


_PAGE = pa.schema([("id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("essence", pa.int64()), ("has_main", pa.bool_()),
                   ("texts", pa.list_(pa.string())), ("block", pa.list_(pa.int32())), ("kind", pa.list_(pa.int32())), ("owner", pa.list_(pa.int32())),
                   ("path", pa.list_(pa.int64())), ("parent", pa.list_(pa.int32())), ("content", pa.list_(pa.int64())), ("removable", pa.list_(pa.bool_()))])
_PAGE_DDL = ("id long, url string, host string, essence long, has_main boolean, texts array<string>, block array<int>, kind array<int>, "
             "owner array<int>, path array<bigint>, parent array<int>, content array<bigint>, removable array<boolean>")
_AT_ONCE = 1 << 22      # letters of pages whose parts are put into one batch


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for batch in batches:
        for id_, url, host, page in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            read = parse(page or "")
            groups = read.groups
            # Texts outside stay in the groups' contents only; of groups that are no containers only their place is needed.
            contained = [g.container for g in groups]
            kept = [i for i, k in enumerate(read.kind) if k != GONE]
            rows.append((id_, url, host, read.essence, read.has_main, [read.texts[i].encode("utf-8", "replace").decode() for i in kept],
                         [read.block[i] for i in kept], [read.kind[i] for i in kept], [read.group[i] for i in kept], [g.path if c else 0 for g, c in zip(groups, contained, strict=True)],
                         [g.parent for g in groups], [_content(g) if c else 0 for g, c in zip(groups, contained, strict=True)], [g.removable for g in groups]))
            size += len(page or "")
            if size >= _AT_ONCE:
                yield _batch(rows)
                rows, size = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PAGE, strict=True)], schema=_PAGE)


def _host(url_col: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[^/?#]*://([^/?#]*)", 1))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for has_main, pieces, block, kind, owner, path, parent, removable, template in zip(*(batch.column(k).to_pylist() for k in range(2, 11)), strict=True):
            removed = _removed(path, parent, removable, frozenset(template)) if template else [False] * len(path)
            texts.append(text_of(pieces, block, kind, [removed[g] for g in owner], has_main))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["id", "url", "text", "n_chars"])


def parse_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: its texts, with what is outside by name left out, and its groups."""
    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), _host(url_col), F.col(html_col).cast("string"))
    return rows.mapInArrow(lean(_parsed), _PAGE_DDL)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars (code points of the text).

    Null and empty pages give an empty text; pages without a host share one
    wrapper. Repeated rows are extracted each for itself, and count as one page in the
    wrapper; other columns are not looked at. An empty table gives an empty result. Pages may be
    of any length and nested to any depth: the time of one follows its length. Of equally long texts in and
    outside surroundings the one outside counts.
    """
    small_batches(pages)
    parsed = store(parse_pages(pages, id_col, url_col, html_col), "pages-parsed")
    known = store(wrappers(parsed), "wrappers").select(F.col("host").alias("known_host"), "template")
    joined = parsed.join(known, F.col("host") == F.col("known_host"), "left").select(
        "id", "url", "has_main", "texts", "block", "kind", "owner", "path", "parent", "removable", "template")
    return joined.mapInArrow(lean(_texts), "id long, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})

"""Main text of HTML pages by removal of site templates.

Pass one hashes the element subtrees of every page in two ways and counts both per host in Spark. The content hash is of tags and texts
(no attributes, so link targets don't matter); the place hash is of the tags and classes on the way from the
root, so a menu or an advert whose words change from page to page recurs too. Pages of equal main text (copies of one page) count once.
Template are subtrees whose content recurs on many pages of the host (LEAST_PAGES, and SHARE of them), and places that recur as often and hold little
of their pages' words (at most LITTLE, or up to half of them if most are in links), directly below elements that hold most. Elements that hold
most of their pages' words, most of them in paragraphs of their own, are the host's content: places within them are no template.
Pass two deletes the template (never a subtree that holds the article or main element, nor, for its place, one that holds content), then what never holds main text by name, role or
class. What is left gives the blocks: those of the article, else of what is marked as main, else of the body; an article (or main) beside which FAR
times as many words of prose are left (PROSE words at least) is taken for a teaser, and the wider choice counts. marks=False leaves out all
rules of names, roles and classes: the templates alone decide.
Paragraphs, headings and list items are no template by themselves, however often they recur.

Defined results: a null or empty html gives an empty text; a null url, or one without a host, belongs to the host ''; null page_ids
and repeated rows are kept; malformed markup is read as far as it goes, in time linear in its length: from the first tag whose quotes don't close on, quotes are
read as any character; a `<` without any `>` behind it is text; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearcurve.llm.common import small, stored

LEAST_PAGES, SHARE, LITTLE = 8, 0.2, 0.2
FAR, PROSE = 3, 40
#: Names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noframes")
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split())
CONTAINER = frozenset("address aside details dialog div dl fieldset figure footer form header menu nav ol section table ul".split())
SILENT = frozenset("audio button canvas embed head iframe input map noframes noscript object option script select style svg template textarea title video xmp".split())
DROPPED = SILENT | frozenset("aside dialog fieldset footer form menu nav".split())
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-share comment comments commentlist consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices "
    "pagination popup promo promoted promotion recommended related replies respond share sharing sidebar skip social sponsor sponsored subscribe tags toolbar widget widgets".split()
)
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Classes that mark a page's head, outside of an article.
HEAD_WORDS = frozenset("header topbar".split())
#: Classes of articles that are readers' comments.
COMMENT_WORDS = frozenset("comment comments reply replies".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_INSIDE = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[a-z0-9]+")
_DIGITS = re.compile(r"[0-9]+")


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """('text', '', s), ('open', name, attributes) and ('close', name, '') in page order; references in texts are decoded."""
    at = done = 0  # done: what is behind has been given
    end, quotes = len(html), True
    while (at := html.find("<", at)) >= 0:
        close = html.startswith("</", at)
        name = _NAME.match(html, at + 1 + close)
        if name:
            m = _INSIDE.match(html, name.end()) if quotes else None
            if m:
                stop = m.end()
            else:  # at most once with quotes
                quotes, stop = False, html.find(">", name.end()) + 1
                if not stop:
                    break
        elif html.startswith("<!--", at):
            stop = html.find("-->", at + 4) + 3
            stop = end if stop < 3 else stop
        elif html.startswith(("<!", "<?"), at):
            stop = html.find(">", at) + 1
            if not stop:
                break
        else:
            at += 1
            continue
        if at > done:
            yield "text", "", unescape(html[done:at])
        if name:
            tag = name[0].lower()
            if close:
                yield "close", tag, ""
            else:
                inside = html[name.end() : stop - 1]
                yield "open", tag, inside
                if tag in VOID:
                    yield "close", tag, ""
                elif tag in RAW and not inside.endswith("/"):
                    m = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, stop)
                    until = m.start() if m else end
                    if until > stop:
                        yield "text", "", html[stop:until]
                    yield "close", tag, ""
                    stop = html.find(">", m.end()) + 1 if m else end
                    stop = stop or end
        at = done = stop
    if done < end:
        yield "text", "", unescape(html[done:])


class Node:
    __slots__ = ("name", "attributes", "children", "mark", "inside", "holds", "gone", "place")

    def __init__(self, name: str, attributes: str, mark: int):
        self.name, self.attributes, self.children, self.mark = name, attributes, [], mark
        self.inside, self.holds, self.gone, self.place = mark, mark, False, 0


class _Open:
    """The stack of open elements, with the places of each name, so that no step walks the stack."""

    def __init__(self, root: Node):
        self.stack, self.names, self.blocks = [root], {}, []

    def push(self, node: Node) -> None:
        self.names.setdefault(node.name, []).append(len(self.stack))
        if node.name in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack[-1].children.append(node)
        self.stack.append(node)

    def last(self, name: str) -> int:
        places = self.names.get(name)
        return places[-1] if places else 0

    def cut(self, k: int) -> None:
        while len(self.stack) > k:
            node = self.stack.pop()
            self.names[node.name].pop()
            if node.name in BLOCK:
                self.blocks.pop()


def tree(html: str, marks: bool = True) -> tuple[Node, int]:
    """The root, and which marks there are: 1 for main, 2 for article, without those in dropped elements. inside: the marks that the node has or is in; holds: that it has or that are in it."""
    root = Node("", "", 0)
    held = _Open(root)
    for kind, name, value in tokens(html):
        if kind == "text":
            held.stack[-1].children.append(value)
        elif kind == "open":
            gone = CLOSES.get(name, ("p",) if name in BLOCK else ())
            k = max(map(held.last, gone), default=0)
            barrier = held.last("table") if name in ("tr", "td", "th") else held.blocks[-1] if held.blocks else 0
            if k and k >= barrier:
                held.cut(k)
            mark = 0 if not marks else 2 if name == "article" else 1 if name == "main" or 'role="main"' in value else 0
            held.push(Node(name, value, mark))
        elif k := held.last(name):
            held.cut(k)
    order, todo = [], [root]
    while todo:  # parents before children
        node = todo.pop()
        for c in node.children:
            if not isinstance(c, str):
                c.inside = node.inside | c.mark
                c.gone = dropped(c) if marks else c.name in SILENT
                c.place = _place(node.place, c)
                todo.append(c)
                order.append((node, c))
    for node, c in reversed(order):
        if not c.gone:
            node.holds |= c.holds
    return root, root.holds


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


def _place(above: int, node: Node) -> int:
    """The hash of the names and classes of the containers from the root to node; other elements are at the place of their container."""
    if node.name not in CONTAINER and node.name not in ("article", "main", "body"):
        return above
    named = [_DIGITS.sub("#", v.strip("\"'")) for n, v in _ATTRIBUTE.findall(node.attributes) if n.lower() in ("class", "id")] if node.attributes else []
    return _signed(xxhash.xxh64_intdigest("\x01".join([str(above), node.name, *named])))


def subtrees(root: Node) -> dict[int, int]:
    """The 64-bit content hashes (of names and texts) of all containers below the root, by id(node)."""
    hashes: dict[int, int] = {}
    todo = [root]
    order = []
    while todo:  # parents before children
        node = todo.pop()
        order.append(node)
        todo.extend(c for c in node.children if not isinstance(c, str))
    for node in reversed(order):
        parts = [node.name, *(" ".join(c.split()) if isinstance(c, str) else str(hashes[id(c)]) for c in node.children)]
        hashes[id(node)] = _signed(xxhash.xxh64_intdigest("\x01".join(parts)))
    return {id(n): hashes[id(n)] for n in order if n.name in CONTAINER}


def places(root: Node) -> dict[int, list[int]]:
    """place -> [place above, words, words in links, words in no container below it] of a page, without elements that hold no text; the root is place 0."""
    out: dict[int, list[int]] = {0: [0, 0, 0, 0]}
    todo: list[tuple[Node, list, bool]] = [(root, out[0], False)]
    order: list[tuple[list, list]] = []  # (container, that above it)
    while todo:
        node, own, link = todo.pop()
        for c in node.children:
            if isinstance(c, str):
                if n := len(c.split()):
                    own[1] += n
                    own[3] += n
                    if link:
                        own[2] += n
            elif c.name not in SILENT:
                inner = own
                if c.place != node.place and c.place not in out:
                    inner = out[c.place] = [node.place, 0, 0, 0]
                    order.append((inner, own))
                elif c.place != node.place:
                    inner = out[c.place]
                todo.append((c, inner, link or c.name == "a"))
    for inner, own in reversed(order):  # a place is met after that above it
        own[1] += inner[1]
        own[2] += inner[2]
    return out


def dropped(node: Node) -> bool:
    """Never main text: by name, role or class."""
    if node.name in DROPPED or (node.name == "header" and not node.inside):
        return True
    if node.attributes and node.name not in ("main", "body", "html"):
        for name, value in _ATTRIBUTE.findall(node.attributes):
            name = name.lower()
            if name in ("class", "id"):
                words = _WORD.findall(value.lower())
                if node.name == "article":
                    if COMMENT_WORDS.intersection(words):
                        return True
                elif DROPPED_WORDS.intersection(words) or not node.inside and HEAD_WORDS.intersection(words):
                    return True
            elif name == "role" and DROPPED_ROLES.intersection(_WORD.findall(value.lower())) or name == "hidden":
                return True
    return False


NONE: frozenset[int] = frozenset()


def main_text(html: str, template: frozenset[int] = NONE, content: frozenset[int] = NONE, marks: bool = True) -> str:
    """template: hashes of subtrees and places that go; content: places of the host's content, in which no place is template."""
    root, found = tree(html, marks)
    return region_text(root, found, subtrees(root) if template else {}, template, content)


def region_text(root: Node, marks: int, hashes: dict[int, int], template: frozenset[int] = NONE, content: frozenset[int] = NONE) -> str:
    """The text of the article, else of what is marked as main, else of everything: the first that has any, unless far more prose is left beside it."""
    if template:
        _delete_template(root, hashes, template, content)
    wide: list[str] | None = None
    for want in (2, 1):
        if marks & want and (blocks := _blocks(root, want)):
            wide = _blocks(root, 0) if wide is None else wide
            n, rest = _words(blocks), _words(b for b in wide if len(b) > 80)
            if rest - n < max(PROSE, FAR * n):
                return "\n".join(blocks)
    return "\n".join(_blocks(root, 0) if wide is None else wide)


def _words(blocks) -> int:
    return sum(len(b.split()) for b in blocks)


def _delete_template(root: Node, hashes: dict[int, int], template: frozenset[int], content: frozenset[int]) -> None:
    full: set[int] = set()  # nodes that are, or hold, content by their place
    order, todo = [], [(root, False)]
    while todo:
        node, inner = todo.pop()
        order.append((node, inner))
        inner = inner or node.place in content or bool(node.mark)
        todo.extend((c, inner) for c in node.children if not isinstance(c, str))
    for node, _ in reversed(order):
        if node.place in content or any(id(c) in full for c in node.children if not isinstance(c, str)):
            full.add(id(node))
    for node, inner in order:
        if id(node) in hashes and not node.holds:
            node.gone = node.gone or hashes[id(node)] in template or not inner and id(node) not in full and node.place in template


def _blocks(root: Node, want: int) -> list[str]:
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if line:
            s = " ".join("".join(line).split())
            line.clear()
            if s:
                blocks.append(s)

    todo: list = [root]
    while todo:  # a stack of nodes, texts and (None: end of a block)
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x)
        elif x.gone:
            if x.name in BLOCK:
                flush()
        else:
            # outside the article only its ancestors matter
            children = x.children if not want or x.inside & want else [c for c in x.children if not isinstance(c, str)]
            if x.name in BLOCK:
                flush()
                todo.append(None)
            elif x.name in ("br", "td", "th"):
                line.append(" ")
            todo.extend(reversed(children))
    flush()
    return blocks


def host(url: str = "url") -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def site_templates(pages: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE, marks: bool = True) -> DataFrame:
    """host, template, content: hashes of its template's subtrees and places, and the places of its content; of each at most (containers of a page) / share a host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("place", pa.int64()), ("above", pa.int64()), ("words", pa.int64()), ("linked", pa.int64()), ("own", pa.int64())]))
        for batch in batches:
            contents, values, at, sizes = [], [], [], []
            for html in batch.column("html").to_pylist():
                root, found = tree(html or "", marks)
                hashes = subtrees(root)
                contents.append(xxhash.xxh3_128_digest(region_text(root, found, hashes)))
                values.append(sorted(set(hashes.values())))
                seen = places(root)
                sizes.append(seen[0][1])
                at.append([dict(zip(("place", "above", "words", "linked", "own"), (p, *x), strict=True)) for p, x in sorted(seen.items()) if p])
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(contents, pa.binary()), pa.array(values, pa.list_(pa.int64())), pa.array(at, kind), pa.array(sizes, pa.int64())], names=["host", "content", "hashes", "places", "words"])

    found = pages.select(host().alias("host"), "html").mapInArrow(run, "host string, content binary, hashes array<long>, places array<struct<place:long,above:long,words:long,linked:long,own:long>>, words long")
    page = F.min(F.struct("hashes", "places", "words")).alias("x")
    distinct = stored(found.groupBy("host", "content").agg(page).select("host", "x.*"), "contents")
    sizes = distinct.groupBy("host").agg(F.count("*").alias("n")).where(f"n >= {least_pages}")
    often = f"m >= {least_pages} AND m >= {share} * n"
    same = distinct.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("m")).where(f"m >= {least_pages}")
    same = same.join(sizes, "host").where(often).groupBy("host").agg(F.collect_list("hash").alias("same"))
    each = distinct.select("host", "words", F.explode("places").alias("p"))
    at = each.groupBy("host", "p.place").agg(F.count("*").alias("m"), F.min("p.above").alias("above"), F.sum("p.words").alias("w"), F.sum("p.linked").alias("linked"), F.sum("p.own").alias("own"), F.sum("words").alias("all"))
    at = stored(at.where(f"m >= {least_pages}").join(sizes, "host").where(often), "places")
    most = at.where("2 * w > all").select("host", F.col("place").alias("above")).union(sizes.select("host", F.lit(0).cast("long")))
    little = at.where(f"w <= {LITTLE} * all OR (2 * w <= all AND 2 * linked > w)").join(most, ["host", "above"], "left_semi")
    little = little.groupBy("host").agg(F.collect_list("place").alias("little"))
    full = at.where("2 * w > all AND 2 * own >= w").groupBy("host").agg(F.collect_list("place").alias("content"))
    none = F.array().cast("array<long>")
    d = same.join(little, "host", "full").join(full, "host", "full")
    return d.select("host", F.concat(F.coalesce("same", none), F.coalesce("little", none)).alias("template"), F.coalesce("content", none).alias("content"))


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE, marks: bool = True) -> DataFrame:
    """page_id, url, text: one row per row of pages."""
    templates, _ = small(stored(site_templates(pages, least_pages, share, marks), "templates"), 10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("html", "template", "content"))
            texts = [main_text(h or "", frozenset(t or ()), frozenset(c or ()), marks) for h, t, c in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    d = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host().alias("host")).join(templates, "host", "left")
    return d.select("page_id", "url", "html", "template", "content").mapInArrow(run, "page_id long, url string, text string")

"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: a node is an element's path of
tags, classes and ids. For every node Spark counts the styles (sequences of
children) its pages use and the contents (texts and link targets) they show.
Entropy gives the importance: many styles, or contents that differ from page
to page, are important; what all pages repeat is not. An importance measured on
n pages is drawn towards 1 by one page's weight, (n I + 1 - I) / n, so that one
rule holds for hosts of every size: with few pages little is known and little
goes. Branches of low importance are removed from each page.

Entropy cannot tell what differs from page to page but is not the article:
menus, adverts, footers, readers' comments. Tags and names weigh these:

- Tags nav, footer, aside, dialog and menu and names of comments and adverts
  are parts beside the article.
- A telling word beside a word of any topic (related-work) names nothing inside the article, and
  what has a telling name there is still its prose if it has words enough outside links, unless it is a form or a notice.
- Other telling names, header and form weigh little: such an element is a part
  unless the page has no article or main element and all its other text is at
  most a ninth of the element's; then it is the layout around the article. Names that say what an element lacks or holds
  (no-sidebar, has-sidebar) and headers of the article itself say nothing.
- Article and main elements that stay are read alone where they hold at least
  as many words as all else that stays. Otherwise (teaser cards beside a body in
  a plain element) they are elements like any other. Inside a part they count
  only on a page that has no other text.

Pages with equal bodies count once in a host's tree, so that copies of an
article do not make it look like a template. Each page is parsed once, into
flat arrays of its elements and text pieces; all later steps read those.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.runtime import Scratch, text_batches

GAMMA, LOW, SALT, OUTSIDE = 0.9, 0.25, 16, 9

# Elements by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
SILENT = RAW | frozenset("noscript template head svg object canvas audio video select datalist button annotation".split())
FIRM = frozenset("nav footer aside dialog menu".split())
MAIN = frozenset({"article", "main"})
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var math maction merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
P_STOPS = SILENT | frozenset("td th li div article section main blockquote".split())
#: Open elements that an opening tag ends, up to the nearest of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# Words in a class, an id or a role that name a part beside the article.
FIRM_WORDS = frozenset("ad ads advert adverts advertisement advertisements comment comments discussion disqus promo promoted promotion reply replies respond sponsor sponsored".split())
SOFT_WORDS = frozenset("alert banner breadcrumb breadcrumbs colophon complementary consent contentinfo cookie cookies copyright dialog disclaimer foot footer form gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination popup recommended related search share sharing sidebar signup skip social subscribe subscription tags toc toolbar topbar widget widgets".split())
# Of these, what is a notice or a form to fill in however much it says.
NOTICES = frozenset("consent cookie cookies disclaimer gdpr newsletter signup subscribe subscription".split())
# Words for pieces of a layout; beside any other word a telling one is part of a topic (related-work, social-policy).
LAYOUT = frozenset("area bar block body bottom box btn button buttons card cards col column container footer global group head icon icons inner item items left link links list main module outer panel posts primary right row secondary side site stories sub top wrap wrapper".split())
# Words that turn such a name into one of the layout, or of the article's own header.
LACKS = frozenset("has have no non not with without".split())
OWN = frozenset("article content entry headline page post section story title".split())

_SILENT, _FIRM, _SOFT, _MAIN, _INLINE, _NOTICE, _LINK = 1, 2, 4, 8, 16, 32, 64
#: What names say of an element inside the article is kept apart, until it is known whether it is in one.
_INSIDE = 128
#: Elements remembered by what tag and names say of them; words outside links that make a part of an article prose.
KINDS, PROSE = 1 << 16, 8
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?>=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}
#: A word; where a script has no blanks, a character.
WORD = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]|[^\s\u3040-\u30ff\u3400-\u9fff]+")


def words(text: str) -> int:
    return len(text.split()) if text.isascii() else len(WORD.findall(text))


def _digest(x: str) -> int:
    return xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63)


def _kind(tag: str, css: str, ident: str, role: str) -> tuple[str, int]:
    """The node's name and what tag and names say of an element: flags, and those it has inside an article times _INSIDE."""
    # A class tells columns apart by number; an id with a number is one page's own.
    name = ".".join([tag, *sorted(set(css.lower().split())), re.sub(r"\d+", "", ident.lower())]).rstrip(".")
    main = tag in MAIN or role.lower() in MAIN
    kind = _SILENT * (tag in SILENT) | _FIRM * (tag in FIRM) | _SOFT * (tag in ("header", "form")) | _INLINE * (tag in INLINE) | _NOTICE * (tag == "form") | _LINK * (tag == "a")
    inside = kind
    for token in f"{css} {ident} {role}".split():
        parts = {w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", token).lower()) if w}
        named = parts & (FIRM_WORDS | SOFT_WORDS)
        if named <= {"header"} and parts & OWN:
            if named and tag == "header":
                kind, inside = kind & ~_SOFT, inside & ~_SOFT
        elif named and not parts & LACKS and not (main and len(parts) > 1 and not parts & FIRM_WORDS):
            says = (_FIRM if parts & FIRM_WORDS else _SOFT) | _NOTICE * bool(parts & NOTICES)
            kind |= says
            if not parts - named - LAYOUT - OWN:
                inside |= says
    return name, kind | _MAIN * main | (inside | _MAIN * main) * _INSIDE


class Page:
    """Elements of a page and its text pieces, each with its element and its block."""

    def __init__(self, html: str, kinds: dict[tuple[str, str, str, str], tuple[str, int]] | None = None):
        self._kinds = {} if kinds is None else kinds
        self.parent, self.path, self.flag, self.tag = [-1], [0], [0], ["body"]
        self.kids: list[list[str]] = [[]]
        self.at, self.block, self.piece = [], [], []
        self.links: list[tuple[int, str]] = []
        self._open, self._hidden, self._in_main, self._many, self._n = [0], [False], [False], {}, 0
        self._read(html)

    def _read(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            match = _TOKEN.search(html, at)
            self._text(html[at : match.start() if match else size])
            if not match:
                break
            at = match.end()
            end, start, attributes = match.groups()
            if end:
                self._end(end.lower())
            elif start and html[at - 1] == ">":
                tag = start.lower()
                self._start(tag, attributes)
                if tag in RAW:
                    stop = _RAW_END[tag].search(html, at)
                    at = stop.start() if stop else size

    def _text(self, data: str) -> None:
        if data and not self._hidden[self._open[-1]]:
            self.at.append(self._open[-1])
            self.block.append(self._n)
            self.piece.append(entities.unescape(data) if "&" in data else data)

    def _pop_to(self, depth: int) -> None:
        for e in self._open[depth:]:
            self._many[self.tag[e]] -= 1
            if not self.flag[e] & _INLINE and not self._hidden[e]:  # what is not seen ends no block
                self._n += 1
        del self._open[depth:]

    def _close(self, tags: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        if not any(self._many.get(t) for t in tags):
            return
        for depth in range(len(self._open) - 1, 0, -1):
            tag = self.tag[self._open[depth]]
            if tag in tags:
                self._pop_to(depth)
                return
            if tag in stop:
                return

    def _start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "br":
            self._text(" ")
            return
        if tag in CLOSES_P:
            self._close({"p"}, P_STOPS)
        if tag in ENDS:
            self._close(*ENDS[tag])
        if tag in VOID:
            self._n += tag == "hr"
            return
        got = {}
        for key, *values in _ATTRIBUTE.findall(attributes) if attributes and not attributes.isspace() else ():
            got.setdefault(key.lower(), entities.unescape("".join(values)))
        said = (tag, got.get("class", ""), got.get("id", ""), got.get("role", ""))
        if said not in self._kinds:
            if len(self._kinds) >= KINDS:
                self._kinds.clear()
            self._kinds[said] = _kind(*said)
        name, kind = self._kinds[said]
        above = self._open[-1]
        kind = kind // _INSIDE if self._in_main[above] else kind % _INSIDE
        if tag == "header" and self._in_main[above] or "header" == got.get("class", "").lower() and self._in_main[above]:
            kind &= ~_SOFT
        if "hidden" in got:
            kind |= _SILENT
        self._n += not kind & (_INLINE | _SILENT) and not self._hidden[above]
        here = len(self.parent)
        self.kids[above].append(name)
        self.kids.append([])
        self.parent.append(above)
        self.tag.append(tag)
        self.flag.append(kind)
        self.path.append(_digest(f"{self.path[above]}/{name}"))
        self._hidden.append(self._hidden[above] or bool(kind & _SILENT))
        self._in_main.append(self._in_main[above] or bool(kind & _MAIN and not kind & _FIRM))
        self._open.append(here)
        self._many[tag] = self._many.get(tag, 0) + 1
        if tag == "a" and got.get("href"):
            self.links.append((here, got["href"]))

    def _end(self, tag: str) -> None:
        if self._many.get(tag):
            for depth in range(len(self._open) - 1, 0, -1):
                if self.tag[self._open[depth]] == tag:
                    self._pop_to(depth)
                    return
        elif tag not in INLINE | SILENT | VOID:
            self._n += 1

    def text(self, low: set[int] | frozenset[int] = frozenset()) -> str:
        return main_text(self.parent, self.path, self.flag, self.at, self.block, self.piece, low)

    def nodes(self) -> tuple[int, list[int], list[int], list[list[int]]]:
        """Body, and path, style and contents of the nodes that no name removes already.

        An element's contents are its blocks, its link targets and one digest of
        each child with contents, so that deep pages take no more than flat ones.
        """
        stays = _stays(self.parent, self.path, self.flag, self.at, [words(t) for t in self.piece], frozenset(), True, False)
        outer = [0] * len(self.parent)  # the element itself, or what an inline one stands in
        for e in range(1, len(outer)):
            outer[e] = outer[self.parent[e]] if self.flag[e] & _INLINE else e
        items: list[list[int]] = [[] for _ in outer]
        for e, what in [*_blocks(self.at, self.block, self.piece, stays), *((e, "\0" + href) for e, href in self.links if stays[e])]:
            items[outer[e]].append(_digest(what))
        contents: dict[int, set[int]] = {}
        styles: dict[int, int] = {}
        for e in range(len(outer) - 1, 0, -1):
            if items[e]:
                path, kids = self.path[e], self.kids[e]
                contents.setdefault(path, set()).update(items[e])
                styles[path] = _digest("|".join(n for i, n in enumerate(kids) if i == 0 or n != kids[i - 1]))
                items[outer[self.parent[e]]].append(_digest(",".join(map(str, items[e]))))
        return _digest(self.text()), list(contents), list(styles.values()), [sorted(marks) for marks in contents.values()]


def _blocks(at: list[int], block: list[int], piece: list[str], stays: list[bool]) -> list[tuple[int, str]]:
    """(element, text) of the blocks of elements that stay, white space folded."""
    out, now, parts, first = [], -1, [], 0

    def end() -> None:
        text = " ".join("".join(parts).split())
        if text:
            out.append((first, text))

    for e, b, t in zip(at, block, piece, strict=True):
        if stays[e]:
            if b != now:
                end()
                now, parts, first = b, [], e
            parts.append(t)
    end()
    return out


def _stays(parent: list[int], path: list[int], flag: list[int], at: list[int], mass: list[int], low: set[int] | frozenset[int], guard: bool, released: bool) -> list[bool]:
    """Elements that neither a part's name nor a low importance removes. Parents come before children.

    guard: a main element and what holds one are not removed for their
    importance. released: main elements inside parts count, and so no part that
    holds one is a part.
    """
    n = len(parent)
    holds, named = [False] * n, [False] * n  # named: in a part by its name alone
    for e in range(1, n):
        named[e] = named[parent[e]] or bool(flag[e] & (_SILENT if released else _SILENT | _FIRM | _SOFT))
    for e in range(1, n):
        if flag[e] & _MAIN and not named[e]:
            while e >= 0 and not holds[e]:
                holds[e] = True
                e = parent[e]
    gone = [False] * n
    for e in range(1, n):
        gone[e] = gone[parent[e]] or bool(flag[e] & _SILENT or flag[e] & _FIRM and not holds[e]) or (path[e] in low and not (guard and holds[e]))
    soft = [e for e in range(1, n) if flag[e] & _SOFT and not gone[e] and not holds[e]]
    if not soft:
        return [not g for g in gone]
    layout: set[int] = set()
    if not any(f & _MAIN and not p for f, p in zip(flag, named, strict=True)):
        own = [0] * n
        for e, w in zip(at, mass, strict=True):
            if not gone[e]:
                own[e] += w
        # Elements with over half of all words form one chain; other named ones are parts.
        whole = own[:]
        for e in range(n - 1, 0, -1):
            whole[parent[e]] += whole[e]
        chain = [e for e in soft if 2 * whole[e] > whole[0]]
        apart = set(soft).difference(chain)
        plain = own[:]
        for e in range(n - 1, 0, -1):
            if e not in apart:
                plain[parent[e]] += plain[e]
        layout = {e for e in chain if OUTSIDE * (plain[0] - plain[e]) <= plain[e]}
    parts = set(soft).difference(layout, _prose(parent, flag, at, mass, soft))
    for e in range(1, n):
        gone[e] = gone[parent[e]] or gone[e] or e in parts
    return [not g for g in gone]


def _prose(parent: list[int], flag: list[int], at: list[int], mass: list[int], soft: list[int]) -> list[int]:
    """Of elements with a telling name, those inside an article that are its prose: words enough outside links, and most of them there."""
    inside, linked = [False] * len(parent), [False] * len(parent)
    for e in range(1, len(parent)):
        inside[e] = inside[parent[e]] or bool(flag[parent[e]] & _MAIN)
        linked[e] = linked[parent[e]] or bool(flag[e] & _LINK)
    asked = [e for e in soft if inside[e] and not flag[e] & (_FIRM | _NOTICE)]
    if not asked:
        return []
    text, links = [0] * len(parent), [0] * len(parent)
    for e, w in zip(at, mass, strict=True):
        (links if linked[e] else text)[e] += w
    for e in range(len(parent) - 1, 0, -1):
        text[parent[e]] += text[e]
        links[parent[e]] += links[e]
    return [e for e in asked if text[e] >= PROSE and text[e] >= links[e]]


def main_text(parent: list[int], path: list[int], flag: list[int], at: list[int], block: list[int], piece: list[str], low: set[int] | frozenset[int]) -> str:
    """The text of a page, given the paths of low importance."""
    mass = [words(t) for t in piece]
    count = lambda stays: sum(w for e, w in zip(at, mass, strict=True) if stays[e])
    released = False
    if any(f & _MAIN for f in flag) and not count(_stays(parent, path, flag, at, mass, frozenset(), True, False)):
        released = True
    stays = _stays(parent, path, flag, at, mass, low, True, released)
    if any(f & _MAIN and s for f, s in zip(flag, stays, strict=True)):
        inside = [False] * len(parent)
        for e in range(1, len(parent)):
            inside[e] = stays[e] and (inside[parent[e]] or bool(flag[e] & _MAIN))
        if 2 * count(inside) >= count(stays):
            stays = inside
        else:
            stays = _stays(parent, path, flag, at, mass, low, False, released)
    return "\n\n".join(t for _, t in _blocks(at, block, piece, stays))


def extract(html: str | None, low: set[int] | frozenset[int] = frozenset()) -> str:
    return Page(html or "").text(low)


def _lists(values: list[list], kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array([x for v in values for x in v], kind))


_PAGE = {"parent": pa.int32(), "path": pa.int64(), "flag": pa.int32(), "at": pa.int32(), "block": pa.int32(), "piece": pa.string()}
_PAGE_SQL = "parent array<int>, path array<bigint>, flag array<int>, at array<int>, block array<int>, piece array<string>"


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, the arrays of a page, body, and path, style and contents of its nodes."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: dict[tuple[str, str, str, str], tuple[str, int]] = {}
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                made = [Page((raw or b"").decode("utf-8", "replace"), kinds) for raw in part.column("html").to_pylist()]
                nodes = [p.nodes() for p in made]
                arrays = [_lists([getattr(p, c) for p in made], kind) for c, kind in _PAGE.items()]
                arrays += [pa.array([n[0] for n in nodes], pa.int64()), _lists([n[1] for n in nodes], pa.int64()), _lists([n[2] for n in nodes], pa.int64()), _lists([n[3] for n in nodes], pa.list_(pa.int64()))]
                kept = [part.column(c) for c in ("page_id", "url", "host")]
                yield pa.RecordBatch.from_arrays([*kept, *arrays], names=["page_id", "url", "host", *_PAGE, "body", "node", "style", "contents"])

    rows = pages.select("page_id", "url", host.alias("host"), F.col("html").cast("binary").alias("html"))
    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, host string, {_PAGE_SQL}, body bigint, node array<bigint>, style array<bigint>, contents array<array<bigint>>")


def node_importance(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """host, path, pages, importance of the nodes of every site style tree; pages as ``parsed`` gives them."""
    each = pages.select("host", "body", F.explode(F.arrays_zip("node", "style", "contents")).alias("x"))
    nodes = scratch.put(each.select("host", "body", F.col("x.node").alias("path"), "x.style", "x.contents").dropDuplicates(["host", "path", "body"]), "nodes")
    node = ["host", "path"]
    styles = nodes.groupBy(*node, "style").count().groupBy(*node).agg(F.sum("count").alias("pages"), F.sum(F.expr("count * ln(count)")).alias("s"), F.count("*").alias("styles"))
    shown = nodes.select(*node, F.explode("contents").alias("content")).groupBy(*node, "content").count().groupBy(*node).agg(F.avg(F.log("count")).alias("h"))
    # Entropies to the base of the number of pages; one page says nothing.
    presentation = F.expr("(ln(pages) - s / pages) / ln(pages)")
    content = F.expr("1 - h / ln(pages)")
    weight = F.pow(F.lit(GAMMA), F.col("styles"))
    raw = F.when(F.col("pages") < 2, F.lit(1.0)).otherwise((1 - weight) * presentation + weight * content)
    return styles.join(shown, node).select(*node, "pages", ((raw * (F.col("pages") - 1) + 1) / F.col("pages")).alias("importance"))


def extract_pages(pages: DataFrame, scratch: Scratch | None = None, low: float = LOW) -> DataFrame:
    """page_id, url, text and n_chars of every row.

    A null html is empty; no text gives the empty string; bytes that are no
    UTF-8 become replacement characters; broken markup never fails. A null or
    odd url belongs to the host ''. Repeated rows come out as often as they come
    in. Work and memory of a page grow with its length, however deep its
    elements nest. Extra columns are not read.
    """
    scratch = scratch or Scratch(pages.sparkSession)
    text_batches(pages.sparkSession)
    # The number is written with the rows, so it stays theirs.
    rows = scratch.put(parsed(pages).withColumn("uid", F.monotonically_increasing_id()), "parsed")
    dull = node_importance(rows, scratch).where(F.col("importance") < low).select("host", "path", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    seen = rows.select("uid", "host", F.pmod("uid", F.lit(SALT)).cast("int").alias("salt"), F.explode("node").alias("path"))
    lists = seen.join(dull, ["host", "path", "salt"]).groupBy("uid").agg(F.collect_set("path").alias("low"))  # as many as the page has nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                columns = [part.column(c).to_pylist() for c in (*_PAGE, "low")]
                texts = [main_text(*page, frozenset(dull or ())) for *page, dull in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    joined = rows.join(scratch.put(lists, "low"), "uid", "left").select("page_id", "url", *_PAGE, "low")
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")

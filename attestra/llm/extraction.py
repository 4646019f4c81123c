"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

A page becomes a tree of block elements with a text slot where text stands. Wrappers are such trees
whose nodes may be optional or repeated: neighbouring siblings of one name fold into a repeated group,
and two trees are merged by aligning their children in order (longest common subsequence of names);
children without a partner become optional groups, partners are merged in turn. All pages of a host are
merged, structure by distinct structure, first in salted parts and then together, and each structure is
aligned with its host's wrapper, so that a place in the wrapper is a slot: the same path before and after
another element is two. Over the host's distinct pages Spark counts what each slot holds, a repeated
group as a whole. Slots that links or one constant text fill are the template; of the others, those count
that stand in the element which holds most of the unlinked text of the pages of one structure.
An article or main element tells a structure's content better: where there is one, the slots in it are the
content, and the template among them is what both links fill and the host's pages share, unless that is all.
Text slots know whether they stand in an article and whether names call them boilerplate, so that a slot is
never both.
Menus, headers, footers, sidebars, notices, adverts, forms, comments of readers, scripts and styles go
by the names, roles and classes of their elements. Articles that are named comment or reply are comments, unless
there is no other text. An article or main element inside a form is kept, the form is then the page's frame; the rest of
a form goes.

White space (as str.split sees it) inside a block is one space, blocks are joined by an empty line.
Null html is empty; a page without content has an empty text. Pages without a host in their url share
the empty host. Repeated rows get equal texts, an empty table gives an empty result, other columns are
not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices

#: Structures of a host that are merged at once; of more, the square root of their number makes a part.
PART = 256
#: Structures whose slots one file holds.
ROWS = 4096
#: Elements above a block that its path names; blocks below more of them stand in the slots of the last one. An
#: article is seen at any depth.
DEPTH = 64
#: Longest sequence of siblings that is recognised as a repeated group, and how often it must recur.
PERIOD, TIMES = 8, 3
#: Products of the numbers of siblings up to which they are aligned by dynamic programming, and places looked ahead beyond.
CELLS, AHEAD = 250_000, 64
MAIN_SHARE, LINKED, CONSTANT, CONSTANT_PAGES = 0.8, 0.6, 0.8, 5
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr".split()
)
#: Elements whose text is never main text.
DROPPED = set(
    "head title script style noscript template nav footer aside button select option input textarea iframe object embed svg canvas audio video "
    "dialog menu datalist map".split()
)
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: Words of a class or id that name boilerplate.
NAMED = set(
    "ad ads advert advertisement adverts advertising adsense banner promo promotion sponsor sponsored menu nav navbar navigation breadcrumb breadcrumbs sidebar "
    "widget footer masthead topbar header cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "login comment comments commentlist disqus reply replies respond response responses discussion share sharing social related recommended pagination pager toolbar "
    "skip hidden".split()
)
#: Of these, names that parts of an article bear too.
INSIDE = set("header hidden discussion notice notices alert overlay skip".split())
#: Names of an article that is a reader's comment.
COMMENT = set("comment comments reply replies response responses".split())
_WORD = re.compile(r"[a-z]+")
CLOSES = {t: {"p"} for t in "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()}
CLOSES |= {"li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "tr": {"p", "td", "th", "tr"}, "td": {"p", "td", "th"}, "th": {"p", "td", "th"}}
SCOPE = {"ul", "ol", "dl", "table", "article", "section", "div", "body"}


class _Blocks(HTMLParser):
    """Collects (path of block elements, text, linked characters, hinted, in an article) in page order, without dropped elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str, bool, bool]] = []  # tag, name in the path, dropped, hinted
        self.open: Counter = Counter()  # tags on the stack, and how many elements there are dropped and hinted
        self.names: list[str] = []
        self.blocks: list[tuple[str, str, int, bool, bool]] = []
        self.words: list[str] = []
        self.linked = 0

    def _flush(self) -> None:
        text = " ".join("".join(self.words).split())
        if text:
            self.blocks.append(("/".join(self.names[:DEPTH]), text, self.linked, self.open["#hinted"] > 0, self._within()))
        self.words, self.linked = [], 0

    def _push(self, tag: str, name: str, dropped: bool, hinted: bool) -> None:
        self.stack.append((tag, name, dropped, hinted))
        self.open.update((tag, *["#dropped"] * dropped, *["#hinted"] * hinted))
        if name:
            self.names.append(name)

    def _pop_from(self, at: int) -> None:
        while len(self.stack) > at:
            tag, name, dropped, hinted = self.stack.pop()
            self.open.subtract((tag, *["#dropped"] * dropped, *["#hinted"] * hinted))
            if name:
                self.names.pop()

    def _within(self) -> bool:
        """Whether an article or main element is open, however deep."""
        return self.open["article"] > 0 or self.open["main"] > 0

    def _dropped(self, tag: str, attrs: dict[str, str]) -> bool:
        if tag in DROPPED or (tag == "header" and not self._within()) or (tag == "form" and self._within()):
            return True
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role") in ROLES:
            return True
        return "display:none" in attrs.get("style", "").replace(" ", "").lower()

    def _hinted(self, tag: str, attrs: dict[str, str]) -> bool:
        """Names of boilerplate; in an article only whole names count, as parts of names are often about its subject."""
        if tag in ("html", "body", "main", "h1"):
            return False
        names = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()
        if tag == "article":
            return any(n in COMMENT for n in names.split())
        if self._within():
            return any(n in NAMED and n not in INSIDE for n in names.split())
        return any(n in NAMED for n in _WORD.findall(names.replace("_", "-")))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        values = {k: v or "" for k, v in attrs}
        if tag == "br":
            self.words.append(" ")
            return
        if tag in VOID:
            if tag == "hr":
                self._flush()
            return
        dropped, hinted = self._dropped(tag, values), self._hinted(tag, values)
        inline = tag in INLINE
        if inline:
            # an inline element has no block of its own: what names it boilerplate drops it
            self._push(tag, "", dropped or hinted, False)
            return
        self._flush()
        closes = CLOSES.get(tag, ())
        if any(self.open[t] for t in closes):
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in closes:
                    self._pop_from(i)
                    break
                if self.stack[i][0] in SCOPE:
                    break
        first = next(iter(values.get("class", "").split()), "")
        name = tag + (f".{re.sub('[0-9]+', '0', first)}" if first else "")
        self._push(tag, name.replace("/", "_"), dropped, hinted)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID or not self.open[tag]:
            return
        at = next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag)
        if tag in INLINE and any(s[0] not in INLINE for s in self.stack[at + 1 :]):
            return
        if tag not in INLINE:
            self._flush()
        self._pop_from(at)

    def handle_data(self, data: str) -> None:
        # a form around a whole page is its frame; what is in no article there goes as any form
        if self.open["#dropped"] or (self.open["form"] and not self._within()):
            return
        self.words.append(data)
        if self.open["a"]:
            self.linked += len(data.strip())

    def done(self) -> list[tuple[str, str, int, bool, bool]]:
        self.close()
        self._flush()
        return self.blocks


def blocks(html: str | None) -> list[tuple[str, str, int, bool, bool]]:
    page = _Blocks()
    page.feed(html or "")
    return page.done()


# A wrapper node: [name, optional, repeated, children]; the name of a text slot is TEXT, of one in an article ARTICLE,
# of one that names call boilerplate HINTED.
TEXT, ARTICLE, HINTED = "#", "#+", "#-"


def _tree(paths: list[str], kinds: list[str] | None = None) -> tuple[list, list[int]]:
    """The wrapper of one page, and for each path the number of its text slot in page order."""
    root: list = ["", False, False, []]
    leaves: list[list] = []
    for path, kind in zip(paths, kinds or [TEXT] * len(paths), strict=True):
        node, names = root, [*filter(None, path.split("/")), kind]
        for at, name in enumerate(names):
            last = node[3][-1] if node[3] else None
            if last and last[0] == name:
                last[2] = last[2] or at == len(names) - 2  # one more block of that name
            else:
                last = [name, False, False, []]
                node[3].append(last)
            node = last
        leaves.append(node)
    moved: dict[int, list] = {}
    _fold_groups(root, moved)
    number: dict[int, int] = {}
    for leaf in _text_slots(root):
        number[id(leaf)] = len(number)

    def place(leaf: list) -> int:
        while id(leaf) in moved:
            leaf = moved[id(leaf)]
        return number[id(leaf)]

    return root, [place(leaf) for leaf in leaves]


def _text_slots(node: list) -> Iterator[list]:
    for c in node[3]:
        if c[0].startswith("#"):
            yield c
        else:
            yield from _text_slots(c)


def _fold_groups(node: list, moved: dict[int, list]) -> None:
    """Sequences of siblings that recur TIMES times in a row become one repeated group, from the shortest on."""
    for c in node[3]:
        _fold_groups(c, moved)
    for period in range(2, PERIOD + 1):
        children, out, i = node[3], [], 0
        while i < len(children):
            end = i + period
            while end < len(children) and children[end][0] == children[end - period][0]:
                end += 1
            turns = (end - i) // period
            if turns >= TIMES:
                group = children[i : i + period]
                for k in range(i + period, i + turns * period):
                    _into(group[(k - i) % period], children[k], moved)
                out += group
                for g in group:
                    g[2] = True
                i += turns * period
            else:
                out.append(children[i])
                i += 1
        node[3] = out


def _into(a: list, b: list, moved: dict[int, list]) -> None:
    """Merge one turn's element into the group's; its text slots become those of the group."""
    moved[id(b)] = a
    x, y = a[3], b[3]
    pairs = dict((j, i) for i, j in _pairs(x, y))
    out, i = [], 0
    for j, child in enumerate(y):
        if j in pairs:
            out += x[i : pairs[j] + 1]
            i = pairs[j] + 1
            _into(x[pairs[j]], child, moved)
        else:
            child[1] = True
            out.append(child)
    a[3] = out + x[i:]


def tree(paths: list[str]) -> list:
    """The wrapper of one page: neighbouring siblings of one name, and sequences that recur, are repeated groups."""
    return _tree(paths)[0]


def _pairs(x: list, y: list) -> list[tuple[int, int]]:
    """Partners among two lists of siblings: equal ends, and of the rest a longest common subsequence of names.

    Very many siblings between the ends are aligned from left to right, each with the next of its name.
    """
    low, high = 0, min(len(x), len(y))
    while low < high and x[low][0] == y[low][0]:
        low += 1
    tail = 0
    while tail < high - low and x[-1 - tail][0] == y[-1 - tail][0]:
        tail += 1
    n, m = len(x) - tail, len(y) - tail
    found = [(k, k) for k in range(low)]
    if (n - low) * (m - low) <= CELLS:
        best = [[0] * (m - low + 1) for _ in range(n - low + 1)]
        for i in range(n - low - 1, -1, -1):
            for j in range(m - low - 1, -1, -1):
                best[i][j] = 1 + best[i + 1][j + 1] if x[low + i][0] == y[low + j][0] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < n - low and j < m - low:
            if x[low + i][0] == y[low + j][0]:
                found.append((low + i, low + j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    else:
        j = low
        for i in range(low, n):
            at = next((k for k in range(j, min(m, j + AHEAD)) if y[k][0] == x[i][0]), None)
            if at is not None:
                found.append((i, at))
                j = at + 1
    return found + [(n + k, m + k) for k in range(tail)]


def aligned(page: list, wrapper: list, path: str = "") -> list[str]:
    """Of each text slot of a page, in order: its place in the wrapper, as names with their numbers among siblings."""
    partner_of, found = dict(_pairs(page[3], wrapper[3])), []
    for i, c in enumerate(page[3]):
        at = partner_of.get(i, "-")
        partner = wrapper[3][at] if i in partner_of else ["", False, False, []]
        if c[0].startswith("#"):
            found.append(f"{path}/{c[0]}@{at}".lstrip("/"))
        else:
            found += aligned(c, partner, f"{path}/{c[0]}@{at}".lstrip("/"))
    return found


def merged(a: list, b: list) -> list:
    """The least general wrapper of both: partners merge, nodes without one become optional."""
    x, y = a[3], b[3]
    children, i, j = [], 0, 0
    for k, m in [*_pairs(x, y), (len(x), len(y))]:
        children += [[c[0], True, c[2], c[3]] for c in (*x[i:k], *y[j:m])]
        if k < len(x):
            children.append(merged(x[k], y[m]))
        i, j = k + 1, m + 1
    return [a[0], a[1] or b[1], a[2] or b[2], _folded(children)]


def _folded(children: list) -> list:
    """Neighbours of one name that alignment has put side by side are one repeated group."""
    out: list = []
    for c in children:
        if out and out[-1][0] == c[0]:
            out[-1] = [c[0], out[-1][1] and c[1], True, merged(out[-1], c)[3]]
        else:
            out.append(c)
    return out


def expression(node: list) -> str:
    """The wrapper as a union-free regular expression over elements and text slots."""
    name, optional, repeated, children = node
    inner = " ".join(map(expression, children))
    body = f"<{name}> {inner} </{name}>" if children and name else inner or name
    sign = "*" if optional and repeated else "?" if optional else "+" if repeated else ""
    return f"({body}){sign}" if sign else body


def slots(node: list, path: str = "") -> set[str]:
    """Paths of the wrapper's text slots."""
    found = set()
    for c in node[3]:
        if c[0].startswith("#"):
            found.add(path)
        else:
            found |= slots(c, f"{path}/{c[0]}" if path else c[0])
    return found


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages as their text slots in order of first appearance, and all blocks in page order with their slots."""
    kind = pa.list_(pa.struct([("text", pa.int64()), ("chars", pa.int64()), ("linked", pa.int64())]))
    block = pa.list_(pa.struct([("leaf", pa.int32()), ("text", pa.string())]))
    for batch in slices(batches, 256):
        found, shapes, texts = [], [], []
        for html in batch.column("html").to_pylist():
            own = blocks(html)
            shape, leaves = _tree([p for p, *_ in own], [HINTED if hinted else ARTICLE if within else TEXT for *_, hinted, within in own])
            slot: dict[int, dict] = {leaf: {"text": [], "chars": 0, "linked": 0} for leaf in range(max(leaves, default=-1) + 1)}
            for (_, text, linked, _, _), leaf in zip(own, leaves, strict=True):
                slot[leaf]["text"].append(text)
                slot[leaf]["chars"] += len(text)
                slot[leaf]["linked"] += linked
            found.append([x | {"text": _hash("\n\n".join(x["text"]))} for x in slot.values()])
            texts.append([{"leaf": leaf, "text": text} for (_, text, *_), leaf in zip(own, leaves, strict=True)])
            shapes.append(json.dumps(shape))
        arrays = [*[batch.column(c) for c in ("page_id", "url", "host")], pa.array(found, kind), pa.array(shapes, pa.string()), pa.array(texts, block)]
        yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "host", "slots", "shape", "blocks"])


def _hash(text: str) -> int:
    """64 bits that tell whether pages hold the same in a slot."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _merge_part(rows: pd.DataFrame) -> pd.DataFrame:
    whole = None
    for shape in sorted(rows["shape"]):
        own = json.loads(shape)
        whole = own if whole is None else merged(whole, own)
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "part": [0], "shape": [json.dumps(whole)]})


def wrappers(shapes: DataFrame) -> DataFrame:
    """(host, shape): one wrapper for each host of distinct (host, shape), merged part by part."""
    count = F.count("*")
    size = shapes.groupBy("host").agg(F.when(count > PART, F.ceil(F.sqrt(count))).otherwise(1).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("shape"), F.col("parts")).cast("int").alias("part")
    shapes = shapes.join(size, "host").select("host", part, "shape")
    schema = "host string, part int, shape string"
    parts = shapes.groupBy("host", "part").applyInPandas(_merge_part, schema)
    return parts.groupBy("host").applyInPandas(_merge_part, schema).select("host", "shape")


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found, last, wrapper = [], None, []
        for shape, whole in zip(batch.column("shape").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
            if whole != last:
                last, wrapper = whole, json.loads(whole)
            found.append(aligned(json.loads(shape), wrapper))
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("key"), pa.array(found, pa.list_(pa.string()))], names=["host", "key", "paths"])


def rules(parsed: DataFrame) -> DataFrame:
    """(host, key, kept): numbers of the text slots that hold content, of each structure."""
    shapes = materialize(parsed.select("host", "key", "shape").distinct(), "extraction-shapes")
    # what there is of each structure is little: it is written in few files
    files = -(-shapes.count() // ROWS) or 1
    whole = wrappers(shapes.select("host", "shape")).withColumnRenamed("shape", "wrapper")
    paths = shapes.join(whole, "host").mapInArrow(_align, "host string, key string, paths array<string>")
    paths = materialize(paths.repartition(files), "extraction-wrappers")
    # copies of a page are one page
    filled = F.transform("slots", lambda x: F.struct(x["text"].alias("t"), x["chars"].alias("chars"), x["linked"].alias("linked")))
    pages = parsed.select("host", "key", filled.alias("filled")).distinct()
    numbered = F.posexplode(F.arrays_zip("paths", "filled")).alias("leaf", "x")
    each = pages.join(paths, ["host", "key"]).select("host", "key", numbered).select("host", "key", "leaf", F.col("x.paths").alias("path"), "x.filled.*")
    texts = each.groupBy("host", "path", "t").agg(F.count("*").alias("times"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    stats = texts.groupBy("host", "path").agg(
        F.sum("times").alias("n"), F.max("times").alias("same"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked")
    )
    linked = F.col("linked") > LINKED * F.col("chars")
    constant = (F.col("n") >= CONSTANT_PAGES) & (F.col("same") >= CONSTANT * F.col("n"))
    stats = stats.select("host", "path", (linked | constant).alias("template"), (linked & constant).alias("shared"))
    plain = F.sum(F.greatest(F.col("chars") - F.col("linked"), F.lit(0))).alias("plain")
    slot = each.groupBy("host", "key", "leaf", "path").agg(plain).join(stats, ["host", "path"])
    name = F.element_at(F.split("path", "/"), -1)
    slot = slot.withColumn("hinted", name.startswith(f"{HINTED}@")).withColumn("article", name.startswith(f"{ARTICLE}@"))
    # names hint at boilerplate and the host's pages at a menu in an article, unless they would leave nothing of a structure's text
    own = Window.partitionBy("host", "key")
    trusted = F.sum(F.when(~F.col("hinted") & ~F.col("template"), F.col("plain")).otherwise(0)).over(own) > 0
    marked, told = F.max("article").over(own), F.max(F.col("article") & ~F.col("shared")).over(own)
    slot = slot.withColumns({"trusted": trusted, "marked": marked, "told": told})
    outside, template = ~F.col("article") | (F.col("shared") & F.col("told")), F.col("template") | (F.col("hinted") & F.col("trusted"))
    slot = slot.withColumn("template", F.when(F.col("marked"), outside).otherwise(template))
    slot = slot.withColumn("plain", F.when(F.col("template"), F.lit(0)).otherwise(F.col("plain")))
    slot = slot.select("host", "key", "leaf", "path", "plain", "template", "marked", F.sum("plain").over(own).alias("all"))
    slot = materialize(slot.repartition(files), "extraction-slots")
    # the deepest element that holds most of the unlinked text of a structure's pages; an article is whole
    parts = F.split("path", "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))
    inner = slot.filter((F.size(parts) > 1) & ~F.col("marked")).select("host", "key", "plain", "all", above.alias("box"))
    boxes = inner.groupBy("host", "key", "box").agg(F.sum("plain").alias("held"), F.first("all").alias("all"))
    boxes = boxes.filter((F.col("held") >= MAIN_SHARE * F.col("all")) & ~F.element_at(F.split("box", "/"), -1).rlike("^(p|li|h[1-6]|td|dd)"))
    depth = F.size(F.split("box", "/"))
    box = boxes.groupBy("host", "key").agg(F.max_by("box", F.struct(depth.alias("d"), "held", "box")).alias("box"))
    found = slot.join(box, ["host", "key"], "left")
    inside = F.col("marked") | F.col("box").isNull() | F.col("path").startswith(F.concat("box", F.lit("/")))
    kept = found.filter(inside & ~F.col("template")).groupBy("host", "key").agg(F.collect_set("leaf").alias("kept"))
    # a table of a few numbers a structure: Spark broadcasts it if its size allows
    return materialize(kept.repartition(files), "extraction-rules")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row of pages."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", host.alias("host"), "html")
    kind = pages.schema["page_id"].dataType.simpleString()
    slot, block = "text: bigint, chars: bigint, linked: bigint", "leaf: int, text: string"
    schema = f"page_id {kind}, url string, host string, slots array<struct<{slot}>>, shape string, blocks array<struct<{block}>>"
    parsed = rows.mapInArrow(_parse, schema)
    parsed = materialize(parsed.withColumn("key", F.md5("shape")), "extraction-blocks")
    kept = rules(parsed)
    main = F.filter("blocks", lambda x: F.array_contains("kept", x["leaf"]))
    text = F.array_join(F.transform(main, lambda x: x["text"]), "\n\n")
    return parsed.join(kept, ["host", "key"], "left").select("page_id", "url", F.coalesce(text, F.lit("")).alias("text"))

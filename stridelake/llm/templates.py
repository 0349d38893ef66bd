"""HTML extraction by equivalence classes: what the pages of a host share is their template, and what remains in its slots is text.

Tokens are elements and the texts of blocks, each told apart by its path of elements. Over the pages of a host a token has an
occurrence vector (how often it is on each page); tokens with the same vector form a class. Vectors are compared by sums of hashes
of (page, count), so they are added up map-side, however many pages a host has. A class is valid if every page has it; valid
classes nest along the paths. The class of what is once on every page is the root of the template: the article's element is looked for in it.
A block's text that shares its vector with an element around it (with the root, if it is once on each page) is part of the template.
What remains is kept if it lies in the article and in none of the regions that hold menus, headers, adverts, comments and the like.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.llm.common import stored

#: Pages with different texts that a host must have before a text that all of them share counts as its template's.
MIN_TEXTS = 8
#: Tokens of pages a task holds before it gives their vectors away.
HELD_TOKENS = 200_000
#: Templates of more bytes in all are joined by a shuffle; hosts with more than this share of all pages are then salted.
BROADCAST_BYTES, HOT_SHARE = 32 << 20, 1000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag; none of it is shown as the page's text.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot thead tr th caption ul".split())
#: A start tag closes an open element of these names, looked for no further than the elements after the bar.
CLOSES = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("tbody thead tfoot", "table"), "thead": ("tbody thead tfoot", "table"), "tfoot": ("tbody thead tfoot", "table")}
CLOSES = {tag: (frozenset(names.split()), frozenset(ends.split())) for tag, (names, ends) in CLOSES.items()}
SCOPE = frozenset("html table td th caption button object template".split())

#: Elements that are never part of an article.
APART = frozenset("head nav aside footer form menu dialog button select noscript template svg canvas object audio video map datalist".split())
#: Words of class, id or role that set a region apart, even one around an article.
TALK = frozenset("comment comments commentlist reply replies respond disqus discussion related recommended recommendations teaser teasers".split())
#: Those that do unless the article lies inside.
ASIDE = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside complementary footer contentinfo ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay subscribe subscription newsletter signup login share sharing social widget widgets toolbar pagination pager skip copyright legal disclaimer alert search form".split()
)
#: Those that do outside of the article alone, as the element header.
HEAD = frozenset("header masthead banner topbar".split())

_TAG = re.compile(r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*'|["'])*+)>?""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")


def _hash(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


@dataclass
class Node:
    tag: str
    parent: int
    key: int
    #: apart, aside, head or nothing: why the element by itself is no part of an article.
    kind: str = ""
    #: article or main, if the element is one by its name, role or property.
    part: str = ""


@dataclass
class Page:
    """Elements of a page, and its blocks: (element, text, whether all of it is links)."""

    nodes: list[Node] = field(default_factory=list)
    blocks: list[tuple[int, str, bool]] = field(default_factory=list)

    @classmethod
    def of(cls, source: str) -> Page:
        page = cls()
        reader = _Reader(page)
        at, end = 0, len(source)
        while at < end:
            m = _TAG.search(source, at)
            if m is None:
                reader.text(source[at:])
                break
            if m.start() > at:
                reader.text(source[at : m.start()])
            at, name = m.end(), m[2]
            if name:
                name = name.lower()
                if m[1]:
                    reader.close(name)
                else:
                    reader.open(name, m[3])
                    if name in RAW:
                        stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
                        at = stop.start() if stop else end
        reader.flush()
        page._settle()
        return page

    def _settle(self) -> None:
        """Regions: an aside around an article or main element that is apart from nothing else is none."""
        around: set[int] = set()
        for i, node in enumerate(self.nodes):
            if node.part and not node.kind:
                above, p = [], node.parent
                while p >= 0 and self.nodes[p].kind != "apart":
                    above.append(p)
                    p = self.nodes[p].parent
                if p < 0:
                    around.update(above)
        self.outside, self.inside = [], []
        for i, node in enumerate(self.nodes):
            p = node.parent
            inside = p >= 0 and (self.inside[p] or self.nodes[p].part != "")
            off = node.kind == "apart" or (node.kind == "aside" and i not in around) or (node.kind == "head" and not inside and i not in around)
            self.outside.append((p >= 0 and self.outside[p]) or off)
            self.inside.append(inside)

    def candidates(self) -> dict[str, list[int]]:
        """The outermost article and main elements that are not in a region apart."""
        out: dict[str, list[int]] = {"article": [], "main": []}
        within: list[frozenset[str]] = []
        for i, node in enumerate(self.nodes):
            above = within[node.parent] if node.parent >= 0 else frozenset()
            if node.part and not self.outside[i] and node.part not in above:
                out[node.part].append(i)
                above |= {node.part}
            within.append(above)
        return out

    def shown(self) -> list[tuple[int, str, bool]]:
        """Blocks outside the regions apart."""
        return [b for b in self.blocks if not self.outside[b[0]]]

    def body(self) -> int:
        """A hash of the texts that are shown: pages that differ in menus and adverts alone have the same."""
        return _hash(*(t for _, t, _ in self.shown()))

    def tokens(self) -> dict[int, tuple[int, int, int]]:
        """(parent token, kind, occurrences) of each token; kind 1: article, 2: main, 0: another element, 3: the text of a block."""
        kinds = {i: k for k, name in ((2, "main"), (1, "article")) for i in self.candidates()[name]}
        out: dict[int, tuple[int, int, int]] = {}
        for i, node in enumerate(self.nodes):
            if not self.outside[i]:
                _, kind, n = out.get(node.key, (0, 0, 0))
                out[node.key] = (self.nodes[node.parent].key if node.parent >= 0 else 0, max(kind, kinds.get(i, 0)), n + 1)
        for at, text, _ in self.shown():
            above = self.nodes[at].key
            key = _hash(above, text)
            out[key] = (above, 3, out.get(key, (0, 0, 0))[2] + 1)
        return out

    def text(self, containers: frozenset[int] = frozenset(), texts: frozenset[int] = frozenset()) -> str:
        """The blocks that remain: in the article's element, if there is one (of the template's, by key, before any other),
        and not among the template's texts."""
        found = self.candidates()
        every = [*found["article"], *found["main"]]
        chosen = set([i for i in every if self.nodes[i].key in containers] or found["article"] or found["main"])
        inside = [i in chosen for i in range(len(self.nodes))]
        for i, node in enumerate(self.nodes):
            inside[i] = inside[i] or (node.parent >= 0 and inside[node.parent])
        kept = [(at, t) for at, t, links in self.shown() if (inside[at] if chosen else not links)]
        return "\n".join(t for at, t in kept if not texts or _hash(self.nodes[at].key, t) not in texts)


class _Reader:
    """Follows start and end tags with an open stack, as a browser does for the tags that may be left out."""

    def __init__(self, page: Page) -> None:
        self.page, self.stack, self.open_tags = page, [0], Counter(["html"])
        page.nodes.append(Node("html", -1, _hash("html")))
        self.pieces: list[str] = []
        self.at, self.links = 0, True

    def text(self, source: str) -> None:
        if not self.pieces:
            self.at, self.links = self._block(), True
        value = html.unescape(source) if "&" in source else source
        self.pieces.append(value)
        if self.links and value.strip():
            self.links = self.open_tags["a"] > 0

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            self.page.blocks.append((self.at, text, self.links))
        self.pieces = []

    def _block(self) -> int:
        """The element that a text belongs to: the nearest that is a block or apart."""
        return next(i for i in reversed(self.stack) if i == 0 or self.page.nodes[i].tag in BLOCK or self.page.nodes[i].kind)

    def _cut(self, depth: int) -> None:
        for i in self.stack[depth:]:
            self.open_tags[self.page.nodes[i].tag] -= 1
        del self.stack[depth:]

    def _pop(self, names: frozenset[str], ends: frozenset[str]) -> None:
        if not any(self.open_tags[name] for name in names):
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.page.nodes[self.stack[depth]].tag
            if tag in names:
                self._cut(depth)
                return
            if tag in ends:
                return

    def open(self, tag: str, attributes: str) -> None:
        if tag == "br":
            if self.pieces:
                self.pieces.append(" ")
            return
        block = tag in BLOCK
        if block:
            self.flush()
        if tag in VOID or tag in ("html", "body") and self.open_tags[tag]:
            return
        if block and tag not in ("html", "body", "head"):
            self._pop(_P, SCOPE)
        if tag in CLOSES:
            self._pop(*CLOSES[tag])
        if tag not in ("html", "head") and self.page.nodes[self.stack[-1]].tag == "head" and (block or tag == "body"):
            self._cut(len(self.stack) - 1)
        words, label, part = self._named(attributes) if attributes else (frozenset(), "", "")
        part = tag if tag in ("article", "main") else part
        parent = self.stack[-1]
        above = self.page.nodes[parent]
        kind = "apart" if tag in APART or words & TALK and tag not in ("html", "body") else ""
        if not kind and not part and tag not in ("html", "body"):
            kind = "aside" if words & ASIDE else "head" if tag == "header" or words & HEAD else ""
        if kind and not block:
            self.flush()  # an inline region apart, as a span of adverts, is no part of the block around it
        self.page.nodes.append(Node(tag, parent, _hash(above.key, tag, label), kind, part))
        self.stack.append(len(self.page.nodes) - 1)
        self.open_tags[tag] += 1

    def close(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        for depth in range(len(self.stack) - 1, 0, -1) if self.open_tags[tag] else ():
            node = self.page.nodes[self.stack[depth]]
            if node.tag == tag:
                if node.kind:
                    self.flush()
                self._cut(depth)
                return
            if tag not in BLOCK and node.tag in BLOCK or node.tag in ("td", "th", "table") and tag not in ("tr", "tbody", "thead", "tfoot", "table", "body", "html"):
                return

    @staticmethod
    def _named(attributes: str) -> tuple[frozenset[str], str, str]:
        """Words of class, id and role, the label by which elements are told apart (without digits), and the part they name."""
        found = [(m[1].lower(), m[2].strip("\"'")) for m in _ATTRIBUTE.finditer(attributes)]
        words = frozenset(w.lower() for name, value in found if name != "itemprop" for w in _WORD.findall(value))
        told = {value.lower() for name, value in found if name in ("role", "itemprop")}
        part = "article" if told & {"article", "articlebody"} else "main" if "main" in told else ""
        return words, re.sub(r"\d+", "0", " ".join(f"{n}={v}" for n, v in sorted(found))), part


_P = frozenset(["p"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial occurrence vectors: of each host and token the pages that have it, sums of hashes of (page, count), least and greatest
    count. The host itself has token 0, its pages' texts are tokens of kind 4."""
    held: dict[tuple[str, int], list[int]] = {}
    names = ["host", "token", "parent", "kind", "pages", "v1", "v2", "least", "most"]

    def told() -> pa.RecordBatch:
        rows = list(held.items())
        columns = [pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.int64()), *(pa.array([v[i] for _, v in rows], pa.int64()) for i in range(7))]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, names=names)

    for batch in batches:
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            page = Page.of(source)
            key, tokens = _hash(source), page.tokens()
            tokens[page.body()] = (0, 4, 1)
            tokens[0] = (0, 5, 1)
            for token, (parent, kind, n) in tokens.items():
                x = _hash(key, n) & ((1 << 62) - 1)
                a, b = x >> 31, x & 0x7FFFFFFF
                old = held.get((host, token))
                if old is None:
                    held[host, token] = [parent, kind, 1, a, b, n, n]
                else:
                    old[1] = max(old[1], kind)
                    old[2] += 1
                    old[3] += a
                    old[4] += b
                    old[5], old[6] = min(old[5], n), max(old[6], n)
            if len(held) > HELD_TOKENS:
                yield told()
    if held:
        yield told()


def _template(part: pd.DataFrame) -> pd.DataFrame:
    """The template of one host from the tokens that all its pages have: no more than the least page has."""
    row = part.iloc[0]
    tokens = {int(t["token"]): t for t in row["tokens"]}
    once = {k for k, t in tokens.items() if t["least"] == t["most"] == 1}
    vector = {k: (t["v1"], t["v2"]) for k, t in tokens.items()}
    texts = []
    for key, t in tokens.items():
        if t["kind"] == 3:
            above = int(t["parent"])
            while above in tokens and vector[above] != vector[key]:
                above = int(tokens[above]["parent"])
            if above in tokens:  # nested: the same vector as an element around it, or as the root
                texts.append(key)
    containers = next((c for kind in (1, 2) if (c := [k for k in once if tokens[k]["kind"] == kind])), [])
    return pd.DataFrame([{"host": row["host"], "containers": sorted(containers), "texts": sorted(texts)}])


def hosts(url: DataFrame) -> DataFrame:
    """The lower-case host of a URL column; '' where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), r"^[^/?#]*//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def templates(pages: DataFrame, min_texts: int = MIN_TEXTS) -> DataFrame:
    """host, containers and texts (tokens of the article's element and of constant blocks), from pages (host, html) of the hosts
    that have at least `min_texts` different texts."""
    kinds = "host string, token long, parent long, kind long, pages long, v1 long, v2 long, least long, most long"
    parts = pages.select("host", "html").mapInArrow(_vectors, kinds)
    found = parts.groupBy("host", "token").agg(F.max("parent").alias("parent"), F.max("kind").alias("kind"), *(F.sum(c).alias(c) for c in ("pages", "v1", "v2")), F.min("least").alias("least"), F.max("most").alias("most"))
    found = stored(found)
    whole = found.filter("kind = 5").select("host", F.col("pages").alias("n"))
    varied = found.filter("kind = 4").groupBy("host").agg(F.count("*").alias("different")).filter(F.col("different") >= min_texts)
    every = found.filter("kind < 4").join(whole.join(varied, "host"), "host").filter("pages = n")
    rows = every.groupBy("host").agg(F.collect_list(F.struct("token", "parent", "kind", "v1", "v2", "least", "most")).alias("tokens"))
    return rows.mapInPandas(lambda frames: (_template(f.iloc[i : i + 1]) for f in frames for i in range(len(f))), "host string, containers array<long>, texts array<long>")


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        source, containers, texts = (batch.column(c).to_pylist() for c in ("html", "containers", "texts"))
        out = [Page.of(s).text(frozenset(c or ()), frozenset(t or ())) for s, c, t in zip(source, containers, texts, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, min_texts: int = MIN_TEXTS) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html): the blocks of the article, in order, a line each.

    Null html is empty and gives an empty text; a null URL has the host ''. Repeated rows each give a row, and weigh as several
    pages in the vectors. Hosts with few texts have no template: their pages' own elements decide. Other columns do not matter."""
    own = pages.select("page_id", "url", hosts(F.col("url")).alias("host"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    made = stored(templates(own, min_texts))
    size = made.agg(F.coalesce(F.sum(64 + F.octet_length("host") + 8 * (F.size("containers") + F.size("texts"))), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        joined = own.join(F.broadcast(made), "host", "left")
    else:
        # At most HOT_SHARE hosts hold more than so large a share of the pages each; their pages are dealt over several tasks.
        counts = stored(own.groupBy("host").agg(F.count("*").alias("n")))
        total = counts.agg(F.sum("n")).first()[0]
        hot = F.broadcast(counts.select("host", F.ceil(F.col("n") * HOT_SHARE / total).cast("int").alias("salts")).filter("salts > 1"))
        salt = F.coalesce(F.pmod(F.xxhash64("html"), F.col("salts")), F.lit(0)).cast("int").alias("salt")
        dealt = own.join(hot, "host", "left").select(*own.columns, salt)
        copies = made.join(hot, "host", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
        joined = dealt.join(copies.hint("merge"), ["host", "salt"], "left")
    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return joined.select("page_id", "url", "html", "containers", "texts").mapInArrow(_extracted, f"{kinds}, text string, n_chars long")

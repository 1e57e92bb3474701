"""HTML main text by template deduction from equivalence classes of tokens.

A page is read as tokens: start tags, told apart by the path of open elements they stand in, and texts, told apart by
their path and content. Over the pages of a host, a token's occurrence vector is how often each page holds it. Tokens
with equal vectors form an equivalence class. The class of the tokens that every page holds exactly once is valid if
its members keep one order on all pages and nest in one another: it is the host's template. Classes of fewer pages
are nested in its slots; they say which further elements are made by the site and not by one page. Vectors
are compared by their sums of hashes of (page, count), so they are partial sums before the shuffle and no host meets
in one task.

What is left between the template's tokens are slots. Each slot takes its meaning from the elements that
hold it: main text lies in the article (or main element) and in no part that is furniture, by its tag (menus, headers,
footers, sidebars, forms, scripts, styles) or by the class, id or role of an element that the site makes (notices,
adverts, comments). Where a host's template has no article, the deepest of its elements with most of the text that
differs between pages holds it; where a page has several articles, those that hold that element or lie in it count. Texts of the template itself, which all pages of a host of MIN_PAGES different pages or
more hold once, are no main text, unless they are most of it. A page that doesn't fit its host's template is read by
its own tags. Names of headings say what they are about and are not read; a wrapper round the article isn't furniture, nor is a form
round the page, nor any furniture round most of the text with an article in it. A self-closed svg, iframe or the like is
empty, as is one that is never closed; blocks after a button, select or label that is never closed are not its own.

Character references are decoded, white space in a block becomes one space, blocks join by a space in page order.
Null html is an empty page; null or scheme-less urls share one host; repeated pages are extracted one by one
(equal pages count as one where pages are counted). Pages are read in one pass, in time and memory that grow with
their length, however deep or broken. Empty tables give no rows. Further columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import ascii_lower, materialize, read

#: Elements by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg object canvas".split())
FURNITURE = frozenset("nav header footer aside form button select menu dialog head script style noscript template iframe textarea title svg object canvas label input".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSES_OWN = frozenset("li dt dd tr td th option".split())
STOPS = frozenset("article body div main section nav ul ol table td th li blockquote form aside header footer button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset(("article", "main"))
#: Words of class names, ids and roles of furniture, and words that such names may also hold.
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "header masthead footer notice notices cookie cookies consent gdpr comment comments commentlist reply replies responses discussion guestbook disqus share sharing social related recommended newsletter "
    "subscribe subscription popup modal overlay pagination pager widget widgets toolbar login signup complementary contentinfo search".split()
)
JOINING_WORDS = frozenset(
    "area bar bottom box block buttons container form global group inner items left links list message module more outer panel policy posts right section site "
    "slot stories thread top unit user wrap wrapper reader readers visitor visitors".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist reply replies responses discussion guestbook".split())
OF_COMMENTS = frozenset("article blog page post story".split())
MIN_PAGES, MOST_OF_TEXT, LABEL_SHARE = 4, 0.8, 0.01
BROADCAST_NUMBERS = 4_000_000
OPEN = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
GAP = re.compile(r"[\s/]*+")
ATTRIBUTE = re.compile(r"([^\s/>=]++|=)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?")
UNSHOWN = re.compile(r"display\s*:\s*none", re.I)
CLOSERS = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in RAW}
#: Flags of a place in a page: furniture by tag, or by name, above the main element; furniture inside it.
TAG_ABOVE, NAME_ABOVE, INSIDE, FORM_ABOVE = 1, 2, 4, 8
#: Elements of a line that authors forget to close: what follows them in blocks of its own is not theirs.
OFTEN_OPEN = frozenset("button select label".split())


class Block(NamedTuple):
    """A text and its place: path of its block, which main element holds it (-1: none), flags, template elements above."""

    path: int
    text: str
    main: int
    flags: int
    in_slot: bool


class Token(NamedTuple):
    """A start tag's path: how often and where it stands, its parent and depth, and whether its names say furniture."""

    n: int
    first: int
    parent: int
    depth: int
    named: bool


class Element(NamedTuple):
    tag: str
    path: int
    block: int
    main: int
    flags: int
    in_slot: bool
    depth: int
    above: int = 0  # flags of what holds it
    first: int = 0  # blocks before it


NOWHERE = Element("", 0, 0, -1, 0, False, 0)


def _digest(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\x00".join(map(str, parts)).encode("utf-8", "replace")) >> 1


def is_furniture_name(name: str) -> bool:
    """Whether a class, id or role as a whole says furniture: "cookie-notice", "ad_box2" and "post-comments" do,
    "related-work" and "post-header" don't."""
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    joining = JOINING_WORDS | OF_COMMENTS if any(w in COMMENT_WORDS for w in words) else JOINING_WORDS
    return any(w in FURNITURE_WORDS for w in words) and all(w in FURNITURE_WORDS or w in joining for w in words)


class Page:
    """One pass over a page. confirmed: paths whose furniture names count (all if None); slots: paths of main slots."""

    def __init__(self, page: str, confirmed: frozenset[int] | None = None, slots: frozenset[int] = frozenset()):
        self.blocks: list[Block] = []
        self.tokens: dict[int, Token] = {}
        self.mains = 0
        self._confirmed, self._slots = confirmed, slots
        self._stack: list[Element] = []
        self._open: dict[str, list[int]] = {}
        self._solid: list[int] = []  # places of elements that aren't inline
        self._stops: list[int] = []
        self._paths: dict[tuple[int, str], int] = {}
        self._parts: list[str] = []
        self._where = NOWHERE
        self._read(page)
        self._flush()
        self._cut(0)

    def _flush(self) -> None:
        text, w = " ".join("".join(self._parts).split()), self._where
        self._parts.clear()
        if text:
            self.blocks.append(Block(w.block, text, w.main, w.flags, w.in_slot))

    def _add(self, text: str, literal: bool = False) -> None:
        now, was = self._stack[-1] if self._stack else NOWHERE, self._where
        if (now.block, now.main, now.flags) != (was.block, was.main, was.flags):
            self._flush()
        self._where = now
        self._parts.append(text if literal or "&" not in text else entities.unescape(text))

    def _left_open(self, e: Element) -> None:
        """Blocks after a button or the like that its author forgot to close are not its own."""
        if e.tag in OFTEN_OPEN and e.flags != e.above:
            self._flush()
            own = e.flags & ~e.above
            self.blocks[e.first :] = [b if b.path == e.block else b._replace(flags=b.flags & ~own) for b in self.blocks[e.first :]]

    def _cut(self, k: int, closed: bool = False) -> None:
        """Close all elements from place k of the stack; closed: the one at k by its own end tag."""
        for place in range(len(self._stack) - 1, k - 1, -1):
            e = self._stack[place]
            self._open[e.tag].pop()
            if place > k or not closed:
                self._left_open(e)
        del self._stack[k:]
        for places in (self._solid, self._stops):
            while places and places[-1] >= k:
                places.pop()

    def _end(self, tag: str) -> None:
        places = self._open.get(tag)
        if not places:
            return
        inner = bool(self._solid) and self._solid[-1] > places[-1]
        if tag in INLINE and inner:
            return  # an inline end tag doesn't close blocks
        if tag not in INLINE:
            self._flush()
        self._cut(places[-1], closed=True)

    def _start(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in CLOSES_P or tag in CLOSES_OWN:
            self._flush()
            ends = [self._open[e][-1] for e in ((tag, "p") if tag in CLOSES_OWN else ("p",)) if self._open.get(e)]
            if ends and max(ends) >= (self._stops[-1] if self._stops else -1):
                self._cut(max(ends))
        above = self._stack[-1] if self._stack else NOWHERE
        label, named, role_main = tag, False, False
        if attributes:
            classes, role = sorted(attributes.get("class", "").lower().split()), attributes.get("role", "").lower().split()
            label, role_main = ".".join([tag, *classes]), "main" in role
            names = [*classes, *role, *([attributes["id"].lower()] if "id" in attributes and tag not in HEADINGS else [])]
            named = tag not in ("html", "body") and (any(map(is_furniture_name, names)) or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(UNSHOWN.search(attributes.get("style", ""))))
        path = self._paths.get((above.path, label))
        if path is None:
            path = self._paths[above.path, label] = _digest(above.path, label)
        if tag not in INLINE and tag != "br":
            old = self.tokens.get(path)
            self.tokens[path] = Token(old.n + 1, *old[1:]) if old else Token(1, len(self.tokens), above.path, above.depth + 1, named)
        if tag in VOID:
            if tag == "br":
                self._add(" ")
            return
        main, flags = above.main, above.flags
        if main < 0 and (tag in MAIN or role_main):
            main, self.mains = self.mains, self.mains + 1  # neither the article itself nor its own head is furniture
        else:
            if tag == "form":
                flags |= INSIDE if main >= 0 else FORM_ABOVE
            elif tag in FURNITURE and not (tag == "header" and main >= 0):
                flags |= INSIDE if main >= 0 else TAG_ABOVE
            if named and not (tag == "header" and main >= 0) and (self._confirmed is None or path in self._confirmed or tag in INLINE):
                flags |= INSIDE if main >= 0 else NAME_ABOVE
        inline = tag in INLINE and flags == above.flags
        if not inline:
            self._solid.append(len(self._stack))
        if tag in STOPS:
            self._stops.append(len(self._stack))
        self._open.setdefault(tag, []).append(len(self._stack))
        self._stack.append(Element(tag, path, above.block if inline else path, main, flags, above.in_slot or path in self._slots, above.depth + 1, above.flags, len(self.blocks)))

    def _read(self, page: str) -> None:
        at, size, cdata_ends, unclosed = 0, len(page), True, set()
        while at < size:
            k = page.find("<", at)
            if k < 0:
                self._add(page[at:])
                return
            if k > at:
                self._add(page[at:k])
            if page.startswith("<!--", k):
                end = page.find("-->", k + 4)
                at = size if end < 0 else end + 3
                continue
            if cdata_ends and page.startswith("<![CDATA[", k):
                end = page.find("]]>", k)
                if end >= 0:
                    self._add(page[k + 9 : end], literal=True)
                    at = end + 3
                    continue
                cdata_ends = False
            if page[k + 1 : k + 2] in ("!", "?"):
                end = page.find(">", k)
                at = size if end < 0 else end + 1
                continue
            m = OPEN.match(page, k + 1)
            if m is None:
                self._add("<")
                at = k + 1
                continue
            tag, at, attributes = m[2].lower(), m.end(), {}
            while at < size and page[at] != ">" and (at := GAP.match(page, at).end()) < size and page[at] != ">":
                found = ATTRIBUTE.match(page, at)
                attributes.setdefault(found[1].lower(), found[2] or found[3] or found[4] or "")
                at = found.end()
            if at >= size:
                return  # the page ends inside a tag
            empty = page[at - 1] == "/"
            at += 1
            if m[1]:
                self._end(tag)
                continue
            self._start(tag, attributes)
            if tag in RAW:
                if not empty and (tag in ("script", "style") or tag not in unclosed):
                    close = CLOSERS[tag].search(page, at)
                    end = page.find(">", close.start()) if close else -1
                    if end >= 0:
                        at = end + 1
                    elif tag in ("script", "style"):
                        at = size
                    else:
                        unclosed.add(tag)  # nothing of it is known, so it holds nothing
                self._end(tag)


OUTLINE = "host string, page long, token long, is_text boolean, n long, first long, parent long, depth long, chars long, named boolean"


def outline(pages: DataFrame) -> DataFrame:
    """pages(host, page, html) -> the tokens of each page; chars is the shown text in an element, or of a text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for host, page, body in zip(f["host"], f["page"], f["html"]):
                found = Page(body)
                chars, texts = dict.fromkeys(found.tokens, 0), {}
                for b in found.blocks:
                    shown = 0 if b.flags & ~FORM_ABOVE else len(b.text)
                    if b.path in chars:
                        chars[b.path] += shown
                    if not b.flags & ~(NAME_ABOVE | FORM_ABOVE):
                        key = _digest(b.path, b.text)
                        texts[key] = (texts.get(key, (0,))[0] + 1, len(b.text))
                for path in reversed(found.tokens):
                    parent = found.tokens[path].parent
                    if parent in chars:
                        chars[parent] += chars[path]
                rows += [(host, page, p, False, t.n, t.first, t.parent, t.depth, chars[p], t.named) for p, t in found.tokens.items()]
                rows.append((host, page, page, None, 1, -1, 0, 0, 0, False))  # the page itself
                rows += [(host, page, key, True, n, -1, 0, 0, size, False) for key, (n, size) in texts.items()]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in OUTLINE.split(", ")])

    return pages.mapInPandas(run, OUTLINE)


def templates(tokens: DataFrame) -> DataFrame:
    """tokens of outline() -> host, skeleton (paths in order), slots (one path at most), texts, names (arrays of tokens)."""
    total = lambda c: F.sum(c.cast("decimal(38,0)"))
    root = F.col("first") == 0
    vectors = tokens.groupBy("host", "token", "is_text").agg(
        total(F.xxhash64("page", "n")).alias("vector"), F.min("first").alias("lo"), F.max("first").alias("hi"), F.min("parent").alias("parent"), F.min("depth").alias("depth"),
        F.sum("chars").alias("chars"), F.bool_or("named").alias("named"), F.count(F.lit(1)).alias("on"), (F.min("page") < F.max("page")).alias("several"),
        F.count_if(root).alias("roots"), total(F.when(root, F.xxhash64("page", F.lit(1).cast("long")))).alias("root_marks"), 
    )
    vectors = materialize(vectors.filter("is_text is null or not is_text or several"))  # a row per host and token; texts of one page say nothing
    hosts = vectors.groupBy("host").agg(F.sum("roots").alias("pages"), F.sum("root_marks").alias("all_once"), F.count_if(F.col("is_text").isNull()).alias("different"), F.max(F.when(F.col("roots") > 0, F.col("chars"))).alias("whole"))
    known = vectors.filter("is_text is not null").drop("roots", "root_marks").join(hosts, "host")
    once = known.filter(F.col("vector") == F.col("all_once"))  # the class of the pages themselves: at most one page's tokens
    w = Window.partitionBy("host").orderBy("lo", "token")
    ordered = once.filter("not is_text").select("*", F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    kept = ordered.filter(F.col("before").isNull() | (F.col("lo") >= F.col("before")) | (F.col("hi") == F.col("lo")))
    skeleton = kept.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("lo", "token", "parent", "depth", "chars"))).alias("s"), F.first("whole").alias("whole"))
    paths = skeleton.select("host", "s", "whole", F.transform("s", lambda x: x["token"]).alias("paths"))
    nested = paths.select("host", "whole", F.filter("s", lambda x: (x["parent"] == 0) | F.array_contains(F.col("paths"), x["parent"])).alias("s"))
    rich = F.filter("s", lambda x: x["chars"] >= MOST_OF_TEXT * F.col("whole"))
    deepest = F.transform(F.slice(F.sort_array(F.transform(rich, lambda x: F.struct(x["depth"], x["token"].alias("token"))), asc=False), 1, 1), lambda x: x["token"])
    out = nested.select("host", F.transform("s", lambda x: x["token"]).alias("skeleton"), deepest.alias("slots"))
    texts = once.filter(F.col("is_text") & (F.col("different") >= MIN_PAGES)).groupBy("host").agg(F.collect_list("token").alias("texts"), F.sum("chars").alias("_c"), F.max("whole").alias("_w"))
    texts = texts.filter("2 * _c <= _w").select("host", "texts")
    # elements of classes of several pages; of a host of few pages all
    common = (F.col("different") < MIN_PAGES) | F.col("several") & (F.col("on") >= LABEL_SHARE * F.col("pages"))
    names = known.filter(F.col("named") & common).groupBy("host").agg(F.collect_list("token").alias("names"))  # at most 1 / LABEL_SHARE for one of a page
    return out.join(texts, "host", "left").join(names, "host", "left")


def main_text(page: str, skeleton: list[int], slots: list[int], texts: list[int], names: list[int]) -> str:
    """The main text of a page under its host's template."""
    found = Page(page, frozenset(names), frozenset(slots))
    fits = bool(skeleton) and all(p in found.tokens for p in skeleton)
    if not fits:
        found = Page(page)
    made = frozenset(texts if fits else ())
    chars: dict[int, int] = {}
    for b in found.blocks:
        chars[b.main] = chars.get(b.main, 0) + len(b.text)
    blocks = [b for b in found.blocks if not b.flags & INSIDE]
    held = [b for b in blocks if b.main >= 0]
    clean = [b for b in held if not b.flags & (TAG_ABOVE | NAME_ABOVE)]
    if clean:
        # of several articles those count that hold the template's main slot, or lie in it
        led = {b.main for b in clean if b.in_slot} if fits and slots else ()
        chosen = [b for b in clean if b.main in led] if led else clean
    elif held or not found.mains:
        shown = [b for b in blocks if not b.flags & TAG_ABOVE and b.main < 0]
        free = [b for b in shown if not b.flags & FORM_ABOVE]
        if sum(len(b.text) for b in free) * 2 < sum(len(b.text) for b in shown):
            free = shown  # a form round the page
        chosen = [b for b in free if not b.flags & NAME_ABOVE] or free
        if fits:
            chosen = [b for b in chosen if b.in_slot] or chosen
        if held:  # furniture round every article is a wrapper if it holds most of the text: the largest of those least wrapped
            least = [b for b in held if not b.flags & TAG_ABOVE] or held
            best = max({b.main for b in least}, key=lambda m: (chars[m], -m))
            if any(not b.flags & TAG_ABOVE for b in least) or chars[best] >= MOST_OF_TEXT * (chars[best] + sum(len(b.text) for b in chosen)):
                chosen = [b for b in least if b.main == best]
    else:
        return ""  # an article without text of its own
    if made:
        chosen = [b for b in chosen if _digest(b.path, b.text) not in made]
    return " ".join(b.text for b in chosen)


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars."""
    host = F.coalesce(ascii_lower(F.regexp_extract("url", r"^[\s\S]*?://([^/?#]*)", 1)), F.lit(""))
    base = pages.select("page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    found = materialize(templates(outline(base.select("host", F.xxhash64("html").alias("page"), "html"))))
    numbers = F.sum(sum((F.coalesce(F.size(c), F.lit(0)) for c in ("skeleton", "slots", "texts", "names")), F.lit(8)))
    small = (found.agg(numbers.alias("n")).first()["n"] or 0) <= BROADCAST_NUMBERS

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            told = zip(*[[() if x is None else x.tolist() for x in f[c]] for c in ("skeleton", "slots", "texts", "names")])
            texts = [main_text(body, *template) for body, template in zip(f["html"], told)]
            yield pd.DataFrame({"page_id": f["page_id"], "url": f["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    # templates go to the pages where their measured size allows; else pages move, and Spark splits a host of many pages
    return base.join(F.broadcast(found) if small else found, "host", "left").select("page_id", "url", "html", "skeleton", "slots", "texts", "names").mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))

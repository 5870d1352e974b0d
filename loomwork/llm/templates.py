"""Main text of pages by equivalence-class template deduction (after Arasu and Garcia-Molina, 2003).

Tokens of a page are its elements, told apart by their path of names, ids and classes, and its text blocks, told apart by
path and text. A token's occurrence vector is its number of occurrences on each page of a host. It is never built: its
two sums of hashes of (page, number) grow page by page in one aggregation by (host, token), so no task sees a host whole.

1. Tokens of one host with one vector are an equivalence class. A class counts if it is large enough (an element and a text
   in it at least) and frequent enough, and holds on pages that differ otherwise: copies of one page are no template.
2. Classes are nested by their paths: a text of a class belongs to the template if the element around it is in the same
   class, so that text fills that element on each page that has it. Elements that occur once a page are the frame; what
   lies in them beside template text is their slot. The slot with most of a host's unlinked text is its main slot.
3. A page is read with its host's template. Where its tokens of a class are not in the order of that class, the class is
   not valid there and takes nothing away. What the template does not hold is in slots; kept is the main one: an article
   element, else a main element, else an element named so, else the host's main slot, else the part of the page that
   holds most of its text. Parts of it that are menus, notices, adverts, forms, comments and the like by element, role
   or name go.

Templates are broadcast up to `broadcast_bytes`, else joined by host, each host dealt into parts.

Defined cases: null or empty html gives an empty text; a null url is the host ""; null ids and repeated rows are pages like
any other; text without markup is one block; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .markup import Block, Element, parse, path_of, signed
from .shared import shared_dir, stored

LEAST_PAGES, LEAST_SHARE = 4, 0.25
#: Within an article element text goes as template only if it is on most of a host's pages.
SURE_PAGES, SURE_SHARE = 8, 0.6
MOST = 0.6  # a part of a page that holds this share of its text is the way down to the article
SALTS = 16
TEXT, INNER, FRAME = 0, 1, 2  # kinds of tokens: text, an element, an element that can hold an article

ASIDE = set("nav aside footer form dialog menu select button datalist object audio video canvas svg math head search".split())
ASIDE_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
ASIDE_NAMES = set(
    "ad ads adv advert adverts advertisement advertising aside discussion discussions sponsor sponsored promo promotion banner sidebar comment comments reply replies respond disqus nav navbar navigation menu breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations trending widget widgets pagination pager skip toolbar search masthead topbar".split()
)
MAIN_NAMES = set("article post entry story content main maincontent articlebody".split())
FRAMES = set(" body div section main article td center table tbody tr form blockquote html".split(" "))
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def host_of(url: Column) -> Column:
    """What follows the first `://` up to a slash, question mark or number sign, A-Z as small letters; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- one page --------------------------------------------------------------------------------------------------------


def named(e: Element, names: set, exact: bool) -> bool:
    """Whether an element's id or one of its classes is, or (unless exact) contains, one of the names."""
    for c in (e.attributes.get("id", ""), *e.attributes.get("class", "").split()):
        if c.lower() in names:
            return True
        words = [] if exact else [w.lower() for w in WORD.findall(c)]
        if not {"has", "no", "with", "without"} & set(words) and names & set(words):
            return True
    return False


def aside(e: Element) -> bool:
    """Whether an element is no part of an article by its kind, role or name."""
    at = e.attributes
    if e.name in ASIDE or at.get("role", "").lower() in ASIDE_ROLES or "hidden" in at or at.get("aria-hidden", "").lower() == "true":
        return True
    if "display:none" in at.get("style", "").replace(" ", "").lower():
        return True
    return e.name not in ("html", "body", "main") and bool(at) and named(e, ASIDE_NAMES, e.name == "article")


class Page:
    """A parsed page with what holds of its elements."""

    def __init__(self, html: str | None):
        self.elements, self.blocks = parse(html, aside)
        n = len(self.elements)
        self.aside = [aside(e) for e in self.elements]
        for i, e in enumerate(self.elements):
            # a form around the whole page is none that an article could do without
            if e.name in ("article", "main", "h1"):
                while (i := self.elements[i].parent) > 0:
                    if self.elements[i].name == "form":
                        self.aside[i] = False
        self.in_aside, self.in_header, own = [False] * n, [False] * n, [0] * n
        for i in range(1, n):
            up = self.elements[i].parent
            self.in_aside[i] = self.aside[i] or self.in_aside[up]
            self.in_header[i] = self.elements[i].name == "header" or self.in_header[up]
        for b in self.blocks:
            own[b.element] += max(0, len(b.text) - b.linked)
        # unlinked text of an element without what is no part of an article; of the whole page also without headers
        self.weight, self.mass = own, [0 if self.in_aside[i] or self.in_header[i] else own[i] for i in range(n)]
        for i in range(n - 1, 0, -1):
            up = self.elements[i].parent
            self.weight[up] += 0 if self.aside[i] else self.weight[i]
            self.mass[up] += self.mass[i]

    def down(self) -> int:
        """The innermost frame that holds most of the page's text."""
        heavy, at = {}, 0
        for i in range(1, len(self.elements)):
            if self.elements[i].name in FRAMES and self.mass[i] >= MOST * self.mass[0] > 0:
                heavy[self.elements[i].parent] = i
        while at in heavy:
            at = heavy[at]
        return at

    def articles(self) -> list[int]:
        """Article elements with text, outermost ones, of the kind of the largest."""
        kind = [e.name == "article" for e in self.elements]
        within = [False] * len(kind)
        for i in range(1, len(kind)):
            up = self.elements[i].parent
            within[i] = within[up] or kind[up]
        for left_out in (self.in_aside, self.aside):
            found = [i for i, is_one in enumerate(kind) if is_one and not within[i] and not left_out[i] and self.weight[i]]
            if found:
                top = max(found, key=lambda i: (self.weight[i], -i))
                return [i for i in found if self.elements[i].path == self.elements[top].path]
        return []

    def mains(self, slot: int | None) -> tuple[list[int], bool]:
        """The elements that hold the article, and whether an article or main element says so."""
        if found := self.articles():
            return found, True
        full = [i for i in range(1, len(self.elements)) if self.mass[i]]
        largest = lambda found: [max(found, key=lambda i: (self.mass[i], -i))]
        if found := [i for i in full if self.elements[i].name == "main" or self.elements[i].attributes.get("role", "").lower() == "main"]:
            return largest(found), True
        if found := [i for i in full if self.elements[i].name in FRAMES and self.mass[i] >= MOST * self.mass[0] and named(self.elements[i], MAIN_NAMES, False)]:
            return found[-1:], False
        if slot is not None and (found := [i for i in full if self.elements[i].path == slot]):
            return largest(found), False
        return [self.down()], False

    def kept_in(self, mains: list[int]) -> list[int | None]:
        """For each element the main element that it belongs to, if nothing between them is no part of an article."""
        out: list[int | None] = []
        for i, e in enumerate(self.elements):
            out.append(i if i in mains else None if not i or self.aside[i] else out[e.parent])
        return out


def text_token(page: Page, b: Block) -> int:
    return path_of(page.elements[b.element].path, "\x1e" + b.text)


def extract(html: str | None, template: list[tuple[int, int, float, bool]] | None, slot: int | None) -> str:
    """The main text of a page. template: (token, class, place in the class, whether sure enough for articles) of template tokens."""
    page = Page(html)
    if not page.blocks:
        return ""
    mains, said = page.mains(slot)
    belongs = page.kept_in(mains)
    fixed = _fixed(page, template) if template else {}
    out, titles, seen = [], [], False
    for b in page.blocks:
        main = belongs[b.element]
        known = fixed.get(text_token(page, b)) if fixed else None
        if main is not None and (known is None or said and not known) and (said or not page.in_header[b.element] or page.in_header[main]):
            seen |= page.elements[b.element].name == "h1"
            out.append(b.text)
        elif not said and known is None and page.elements[b.element].name == "h1" and not page.in_aside[b.element]:
            titles.append((len(out), b.text))
    if not said and not seen and len(titles) == 1:
        out.insert(*titles[0])
    return "\n".join(out)


def _fixed(page: Page, template: list[tuple[int, int, float, bool]]) -> dict[int, bool]:
    """Tokens of the template's classes that are in order on this page, each with whether it is sure."""
    at = {}
    for k, (token, _) in enumerate(tokens(page)):
        at.setdefault(token, k)
    classes: dict[int, list] = {}
    for token, cls, place, sure in template:
        if token in at:
            classes.setdefault(cls, []).append((place, at[token], token, sure))
    out = {}
    for members in classes.values():
        members.sort()
        if all(a[1] < b[1] for a, b in zip(members, members[1:], strict=False)):
            out.update({token: sure for _, _, token, sure in members})
    return out


def tokens(page: Page) -> Iterator[tuple[int, int]]:
    """(token, the token of the element around it) of elements and blocks, each element before what it holds."""
    by: dict[int, list] = {}
    for b in page.blocks:
        by.setdefault(b.element, []).append(b)
    for i, e in enumerate(page.elements):
        if i:
            yield e.path, page.elements[e.parent].path
        for b in by.get(i, ()):
            yield text_token(page, b), e.path


# -- all pages -------------------------------------------------------------------------------------------------------


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("host", "token", "parent", "page", "sign", "n", "place", "mass", "kind")
    for b in batches:
        rows: list[tuple] = []
        for host, page_id, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
            page = Page(html)
            longest = max((x.text for x in page.blocks), key=len, default="")
            sign = signed(xxhash.xxh3_64_intdigest(longest.encode("utf-8", "surrogatepass")))
            seen: dict[int, list] = {}
            for k, (token, parent) in enumerate(tokens(page)):
                seen.setdefault(token, [parent, 0, k, 0, TEXT])[1] += 1
            for i, e in enumerate(page.elements[1:], 1):
                seen[e.path][3] += page.mass[i]
                seen[e.path][4] = FRAME if e.name in FRAMES and not page.in_aside[i] else INNER
            rows += [(host, t, p, page_id, sign, n, k, mass, kind) for t, (p, n, k, mass, kind) in seen.items()]
        kinds = (pa.int64(),) * 5 + (pa.int32(), pa.int32(), pa.int64(), pa.int8())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 9, kinds, strict=True)], names=names)


def learn(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host hash, template, slot) of each host that has either; see extract."""
    keyed = pages.select(F.xxhash64(host_of(F.col("url"))).alias("host"), F.xxhash64("page_id", "url", "html").alias("page"), "html")
    found = keyed.mapInArrow(_tokens, "host long, token long, parent long, page long, sign long, n int, place int, mass long, kind byte")
    h = F.xxhash64("page", "n")
    vectors = found.groupBy("host", "token").agg(
        F.sum(h.bitwiseAND(F.lit(0x7FFFFFFF))).alias("v1"),
        F.sum(F.shiftrightunsigned(h, 33)).alias("v2"),
        F.count("*").alias("support"),
        F.sum("n").alias("total"),
        F.min("parent").alias("parent"),
        (F.min("sign") != F.max("sign")).alias("differ"),
        F.avg("place").alias("place"),
        F.sum("mass").alias("mass"),
        F.max("kind").alias("kind"),
    )
    vectors = stored(vectors.where((F.col("support") >= least_pages) | (F.col("kind") == FRAME)), shared_dir(pages.sparkSession), "vectors")
    sizes = keyed.groupBy("host").agg(F.count("*").alias("pages"))
    enough = (F.col("support") >= least_pages) & (F.col("support") >= least_share * F.col("pages"))
    vectors = vectors.join(sizes, "host")
    around = vectors.where(F.col("kind") != TEXT).select("host", F.col("token").alias("parent"), F.col("v1").alias("p1"), F.col("v2").alias("p2"))
    texts = vectors.where(enough & F.col("differ") & (F.col("kind") == TEXT)).join(around, ["host", "parent"]).where("v1 = p1 AND v2 = p2")
    sure = (F.col("support") >= SURE_PAGES) & (F.col("support") >= SURE_SHARE * F.col("pages"))
    template = texts.groupBy("host").agg(F.collect_list(F.struct("token", F.xxhash64("v1", "v2").alias("cls"), "place", sure.alias("sure"))).alias("template"))
    # the frame: elements once on most pages; the innermost that holds most of the text is the main slot
    frames = vectors.where((F.col("kind") == FRAME) & (F.col("support") == F.col("total")) & (2 * F.col("support") >= F.col("pages")))
    whole = F.max("mass").over(Window.partitionBy("host"))
    slot = frames.withColumn("whole", whole).where((F.col("mass") >= MOST * F.col("whole")) & (F.col("mass") > 0)).groupBy("host").agg(F.max_by("token", "place").alias("slot"))
    return template.join(slot, "host", "full")


def main_text(pages: DataFrame, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    spark = pages.sparkSession
    learnt = stored(learn(pages.select("page_id", "url", "html")), shared_dir(spark), "templates")
    size = learnt.agg(F.sum(F.lit(64) + 40 * F.coalesce(F.size("template"), F.lit(0)))).first()[0] or 0
    rows = pages.select("page_id", "url", "html", F.xxhash64(host_of(F.col("url"))).alias("host"))
    if size <= broadcast_bytes:
        rows = rows.join(F.broadcast(learnt), "host", "left")
    else:
        salt = F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)).cast("int")
        rows = rows.withColumn("salt", salt).join(learnt.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"], "left")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    rows = rows.select("page_id", "url", "html", "template", "slot")
    return rows.mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = []
        for html, template, slot in zip(*(b.column(c).to_pylist() for c in ("html", "template", "slot")), strict=True):
            texts.append(extract(html, [(t["token"], t["cls"], t["place"], t["sure"]) for t in template] if template else None, slot))
        cols = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

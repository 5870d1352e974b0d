"""HTML columns to rows by regular expressions: cards, links, labelled fields, detail pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_tags, unescape


def extract_cards(pages: DataFrame, html: str, card: str, fields: dict[str, str], group: int = 0) -> DataFrame:
    """A row per match of `card`, in page order (pos), with the first group of each field pattern, tags stripped."""
    rows = pages.select(*[c for c in pages.columns if c != html], F.posexplode(F.regexp_extract_all(F.col(html), F.lit(card), group)).alias("pos", "card"))
    return rows.select(*[c for c in rows.columns if c != "card"], *[strip_tags(F.regexp_extract("card", p, 1)).alias(k) for k, p in fields.items()])


def segments(pages: DataFrame, html: str, anchor: str, fields: dict[str, str]) -> DataFrame:
    """As extract_cards, with each card reaching from an anchor to the next one or the end."""
    return extract_cards(pages, html, f"(?s)(?:{anchor})(?:(?!{anchor}).)*", fields)


def labelled_fields(html: Column, label: str = r"<dt[^>]*>([^<]*)</dt>\s*<dd[^>]*>[^<]*</dd>", value: str = r"<dt[^>]*>[^<]*</dt>\s*<dd[^>]*>([^<]*)</dd>") -> Column:
    """Map of label to value; of equal labels the first."""
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(label), 1).alias("k"), F.regexp_extract_all(html, F.lit(value), 1).alias("v"))
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == i + 1)
    return F.map_from_entries(F.transform(first, lambda p: F.struct(F.trim(p["k"]), F.trim(p["v"]))))


def has_class(name: str) -> str:
    """A look-ahead, set after a tag's name, for a class that holds `name`, wherever the attribute stands."""
    return rf'(?=[^>]*\sclass\s*=\s*"[^"]*{name})'


def element(tag: str, name: str) -> str:
    """Pattern of an element of a class, with its content as the group; flags stand in front of the whole pattern."""
    return rf"<{tag}\b{has_class(name)}[^>]*>(.*?)</{tag}>"


@dataclass(frozen=True)
class Markup:
    """Class names of the pages that are read."""

    # fixed values: the classes of labelled header fields and of result tables
    label: str = "JobHeaderField"
    value: str = "JobHeaderData"
    row: str = "data-row"
    link: str = "jobTitle-link"
    place: str = "jobLocation"
    date: str = "jobDate"


def header_fields(html: Column, m: Markup = Markup()) -> Column:
    """Map of label in lower case to value of header fields marked as such; empty values do not count, of equal labels the first does. Entities stay: `decoded` what is read from it."""
    pair = F.lit(f"(?is){element('dt', m.label)}\\s*{element('dd', m.value)}")
    pairs = F.arrays_zip(F.regexp_extract_all(html, pair, 1).alias("k"), F.regexp_extract_all(html, pair, 2).alias("v"))
    pairs = F.filter(F.transform(pairs, lambda p: F.struct(F.lower(strip_tags(p["k"])).alias("k"), strip_tags(p["v"]).alias("v"))), lambda p: p["v"] != "")
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == i + 1)
    return F.map_from_entries(first)


def table_rows(pages: DataFrame, html: str, base: str, m: Markup = Markup()) -> DataFrame:
    """Result tables: job_id, job_title, apply_url, location, posted_date of each row whose title links to a numbered posting, the first per page and id."""
    from ..functions.places import shouting_location
    from ..operators.lifecycle import keep_newest

    fields = {"href": rf'(?is)<a\b{has_class(m.link)}[^>]*\shref="([^"]*)"', "job_title": f"(?is){element('a', m.link)}", "place": f"(?is){element('span', m.place)}", "date": f"(?is){element('span', m.date)}"}
    rows = extract_cards(pages, html, f"(?is){element('tr', m.row)}", fields)
    day = F.coalesce(*[F.try_to_timestamp("date", F.lit(f)) for f in ("MMM d, yyyy", "M/d/yyyy", "d MMM yyyy", "yyyy-MM-dd")])
    rows = rows.withColumn("job_id", F.regexp_extract("href", r"^/job/.*/(\d+)/$", 1)).where("job_id <> ''")
    out = keep_newest(rows, ["page_id", "job_id"], F.asc("pos"))
    return out.select("page_id", "job_id", decoded(F.col("job_title")).alias("job_title"), F.concat(F.col(base), decoded(F.col("href"))).alias("apply_url"), shouting_location(decoded(F.col("place"))).alias("location"), day.alias("posted_date"))


def extract_detail(html: Column, body: str = r"(?s)<article[^>]*>(.*?)</article>") -> Column:
    """Struct of body (container, else meta description), title and date posted."""
    meta = F.regexp_extract(html, r'<meta\s+name="description"\s+content="([^"]*)"', 1)
    return F.struct(F.coalesce(F.nullif(strip_tags(F.regexp_extract(html, body, 1)), F.lit("")), meta).alias("body"), strip_tags(F.regexp_extract(html, r"(?s)<title[^>]*>(.*?)</title>", 1)).alias("title"), F.try_to_timestamp(F.regexp_extract(html, r'"datePosted"\s*:\s*"([^"]+)"', 1)).alias("date_posted"))


def harvest_links(pages: DataFrame, html: str, base: str, keyword: str | None = None, least: int = 8) -> DataFrame:
    """(page_id, href, text): anchors with a text of at least `least` characters, resolved against the page's url; the first per href."""
    from ..operators.lifecycle import keep_newest

    links = extract_cards(pages.select("page_id", base, html), html, r"(?s)<a\s[^>]*href=\"[^\"]*\"[^>]*>.*?</a>", {"href": r'href="([^"]*)"', "text": r"(?s)>(.*?)</a>"})
    links = links.where(F.length("text") >= least)
    if keyword:
        links = links.where(F.lower("text").rlike(keyword))
    root = F.regexp_extract(F.col(base), r"^([a-z]+://[^/?#]+)", 1)
    full = F.when(F.col("href").rlike("^[a-z]+://"), F.col("href")).when(F.col("href").startswith("/"), F.concat(root, F.col("href"))).otherwise(F.concat(root, F.lit("/"), F.col("href")))
    return keep_newest(links.select("page_id", "pos", full.alias("href"), "text"), ["page_id", "href"], F.asc("pos")).select("page_id", "href", "text")


def decoded(html: Column) -> Column:
    return unescape(html)

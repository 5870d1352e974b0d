"""Scalar text functions: HTML cleaning, titles, company names, dates and freshness. All are Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .entities import unescape

#: Words without meaning in a company name, removed one after the other in this order.
COMPANY_NOISE = ("design systems", "technologies", "technology", "semiconductors", "semiconductor", "corporation", "incorporated", "international", "solutions", "systems", "holdings", "company", "limited", "group", "corp", "gmbh", "inc", "llc", "ltd", "plc", "usa", "co", "the")


def cut_words(c: Column, n: int) -> Column:
    """At most n characters, cut at the last space before, with an ellipsis where something went."""
    head = F.substring(c, 1, n)
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.regexp_replace(head, r" [^ ]*\z", ""), F.lit("…")))


def strip_tags(c: Column) -> Column:
    """Tags to spaces, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " "))


def clean_html(c: Column, max_len: int = 4000) -> Column:
    """Entities decoded first, then tags to spaces, blanks collapsed, at most two line ends in a row, cut to max_len. Null is empty."""
    c = F.regexp_replace(unescape(F.coalesce(c, F.lit(""))), "<[^>]+>", " ")
    c = F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), r"\n{3,}", "\n\n")
    return cut_words(F.trim(c), max_len)


def snippet(c: Column, n: int = 300) -> Column:
    return cut_words(clean_html(c, 500), n)


# fixed values: notes that a normalised title loses, at its end and in brackets
END_NOTES = ("remote", "hybrid", "onsite", "new grad", "entry level", "entry-level")
BRACKET_NOTES = ("remote", "hybrid", "new grad", "entry level", "entry-level")


def normalize_title(c: Column) -> Column:
    """Lower case, blanks collapsed, without a last note after a dash, comma or bar, and without brackets that begin with a note."""
    c = F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")
    c = F.regexp_replace(c, rf"[-,|] ?(?:{'|'.join(END_NOTES)})\s*$", "")
    c = F.regexp_replace(c, rf" ?\((?:{'|'.join(BRACKET_NOTES)})[^)]*\)", "")
    return F.trim(F.regexp_replace(c, " +", " "))


def norm_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"\s+", " ")


def norm_company(c: Column, noise: tuple[str, ...] = COMPANY_NOISE) -> Column:
    """Letters and digits only, noise words removed in list order, blanks collapsed."""
    c = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " ")
    for word in noise:
        c = F.regexp_replace(c, rf"\b{word}\b", " ")
    return F.trim(F.regexp_replace(c, " +", " "))


def short_title(c: Column) -> Column:
    """What stands before a dash with spaces, a colon or a bracket, at most 60 characters."""
    return F.substring(F.trim(F.regexp_extract(c, r"^(.*?)(\s+[-–—]\s+|:|\(|$)", 1)), 1, 60)


def looks_like_title(c: Column, verbs: tuple[str, ...]) -> Column:
    """At most eight words, a capital first, and not one of the bullet verbs first."""
    return (F.size(F.split(F.trim(c), r"\s+")) <= 8) & c.rlike(r"^\s*\p{Lu}") & ~F.lower(F.regexp_extract(c, r"^\s*(\S+)", 1)).isin(*verbs)


def clean_keywords(c: Column, most: int = 6) -> Column:
    """A keyword array without place, tier and age notes; the first six."""
    return F.slice(F.filter(c, lambda x: ~F.lower(x).rlike(r"^(usa|priority-.*|recent|fresh|new)$")), 1, most)


def pretty_title(c: Column, acronyms: tuple[str, ...] = ()) -> Column:
    """Every word capitalised, known acronyms in capitals."""
    def one(w: Column) -> Column:
        capital = F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000)))
        return F.when(F.lower(w).isin(*acronyms), F.upper(w)).otherwise(capital) if acronyms else capital

    words = F.transform(F.split(c, " "), one)
    return F.array_join(words, " ")


def clean_job_title(title: Column, location: Column) -> Column:
    """Without a bracketed work mode, and without a trailing ` - place` whose city the location field names."""
    t = F.trim(F.regexp_replace(title, r"(?i)\s*\((onsite|remote|hybrid)\)", ""))
    tail = F.substring_index(t, " - ", -1)
    city = F.trim(F.substring_index(tail, ",", 1))
    named = t.contains(" - ") & (F.length(city) > 0) & F.contains(F.lower(location), F.lower(city))
    return F.when(named, F.trim(F.substr(t, F.lit(1), F.length(t) - F.length(tail) - 3))).otherwise(t)


def years_required(c: Column) -> Column:
    """Struct of min and max years: `N to M years` (or a dash), else `N+ years` (no max), else `N years of experience` (both N); else null."""
    t = F.lower(F.coalesce(c, F.lit("")))
    number = r"(\d+)\s*"
    found = lambda rest, g: F.regexp_extract(t, number + rest, g)
    span, plus, exact = rf"(?:-|–|to)\s*{number}years?", r"\+\s*years?", r"years?\s*(?:of\s+)?experience"
    lo, hi, least, n = found(span, 1), found(span, 2), found(plus, 1), found(exact, 1)
    year = lambda x: F.substring(x, 1, 9).cast("int")
    return F.struct(F.when(lo != "", year(lo)).when(least != "", year(least)).when(n != "", year(n)).alias("min"), F.when(lo != "", year(hi)).when((least == "") & (n != ""), year(n)).alias("max"))


def remote_status(location: Column, body: Column) -> Column:
    where = F.lower(F.trim(F.coalesce(location, F.lit(""))))
    text = F.concat_ws(" ", where, F.lower(F.coalesce(body, F.lit(""))))
    return F.when(F.contains(text, F.lit("hybrid")), "Hybrid").when(F.contains(text, F.lit("remote")), "Remote").when(where == "", "Unknown").otherwise("Onsite")


# dates; the clock is always a parameter


def relative_date(c: Column, as_of: Column) -> Column:
    """today, just posted, yesterday, N days, weeks or months (of 30 days) ago; else null."""
    t = F.lower(F.coalesce(c, F.lit("")))
    n = F.regexp_extract(t, r"(\d+)\+?\s*(day|week|month)", 1).cast("int")
    unit = F.regexp_extract(t, r"(\d+)\+?\s*(day|week|month)", 2)
    days = F.when(F.contains(t, F.lit("today")) | F.contains(t, F.lit("just posted")), 0).when(F.contains(t, F.lit("yesterday")), 1).when(unit == "day", n).when(unit == "week", n * 7).when(unit == "month", n * 30)
    return as_of - F.make_dt_interval(days)


def parse_date(c: Column, formats: tuple[str, ...] = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "MMMM d, yyyy", "MM/dd/yyyy")) -> Column:
    """The first format that fits."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def sane_posted(c: Column, as_of: Column) -> Column:
    """Null if later than today or more than five years old."""
    return F.when((F.to_date(c) <= F.to_date(as_of)) & (F.datediff(as_of, c) <= 5 * 365), c)


def effective_date(posted: Column, first_seen: Column, known: Column | None = None) -> Column:
    return F.coalesce(posted if known is None else F.when(known, posted), first_seen)


def freshness(posted: Column, known: Column, first_seen: Column, as_of: Column) -> Column:
    """Struct of label, is_new (three days or less), exact, days."""
    exact = known & posted.isNotNull()
    days = F.greatest(F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(F.when(exact, posted).otherwise(first_seen))) / 86400), F.lit(0)).cast("int")
    age = F.when(days == 0, "today").when(days == 1, "yesterday").when(days < 7, F.concat(days.cast("string"), F.lit("d ago"))).when(days < 30, F.concat(F.floor(days / 7).cast("string"), F.lit("w ago"))).when(days < 365, F.concat(F.floor(days / 30).cast("string"), F.lit("mo ago"))).otherwise(F.concat(F.floor(days / 365).cast("string"), F.lit("y ago")))
    return F.struct(F.concat(F.when(exact, "Posted ").otherwise("Added "), age).alias("label"), (days <= 3).alias("is_new"), exact.alias("exact"), days.alias("days"))

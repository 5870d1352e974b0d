"""Record keys, duplicate signatures and URLs. All are Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import norm_key

# fixed values: query parameters that only track, compared in lower case
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid", "ref", "source", "referral", "gh_src", "lever-source", "lever-origin")
#: Hosts of posting boards: their name says nothing about the company.
BOARD_HOSTS = ("greenhouse.io", "lever.co", "ashbyhq.com", "myworkdayjobs.com", "smartrecruiters.com", "icims.com", "jobvite.com", "eightfold.ai")


def fingerprint(company: Column, title: Column, location: Column, job_id: Column, url: Column) -> Column:
    """16 hex digits over company and job id, else url, else title and location. The job id is taken as it is."""
    blank = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    rest = F.coalesce(blank(job_id), blank(norm_key(url)), F.concat_ws("|", norm_key(title), norm_key(location)))
    return F.substring(F.sha2(F.concat_ws("|", norm_key(company), rest), 256), 1, 16)


def stable_id(key: Column) -> Column:
    """A 52-bit integer from the first 13 hex digits."""
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("bigint")


def chunk_of(c: Column, n: int = 16) -> Column:
    return F.pmod(c, F.lit(n)).cast("int")


def dup_group(company: Column, title: Column, body: Column) -> Column:
    """12 hex digits over company (any case, outer blanks gone), title and 700 characters of the body's words of letters a-z; a body without any signs as empty."""
    letters = F.trim(F.regexp_replace(F.lower(F.coalesce(body, F.lit(""))), "[^a-z]+", " "))
    sign = F.when(letters == "", "").otherwise(F.substring(F.sha1(F.substring(letters, 1, 700)), 1, 10))
    return F.substring(F.sha1(F.concat_ws("|", F.lower(F.trim(F.coalesce(company, F.lit("")))), F.trim(F.coalesce(title, F.lit(""))), sign)), 1, 12)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def strip_tracking(url: Column, names: tuple[str, ...] = TRACKING) -> Column:
    """Struct of the url without tracking parameters and how many went. Order and encoding of the rest stay."""
    base, query, fragment = (F.regexp_extract(url, r"^([^?#]*)(?:\?([^#]*))?(#.*)?$", g) for g in (1, 2, 3))
    parts = F.filter(F.split(query, "&"), lambda x: x != "")
    kept = F.filter(parts, lambda x: ~F.lower(F.substring_index(x, "=", 1)).isin(*names))
    return F.struct(F.concat(base, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""), fragment).alias("url"), (F.size(parts) - F.size(kept)).alias("removed"))


def in_domain(h: Column, domain: str) -> Column:
    return (h == domain) | h.endswith("." + domain)


def apply_url(url: Column, fallback: Column, direct: tuple[str, ...] = BOARD_HOSTS) -> Column:
    """Struct of url, status (ok, stripped, fallback, dead) and reason."""
    clean = strip_tracking(url)
    empty = F.coalesce(F.trim(url), F.lit("")) == ""
    h = host(url)
    board = F.lit(False)
    for d in direct:
        board = board | in_domain(h, d)
    generic = in_domain(h, "myworkdayjobs.com") & ~F.contains(url, F.lit("/job/"))
    lost = empty | generic
    return F.struct(
        F.when(lost, fallback).when(board, url).otherwise(clean["url"]).alias("url"),
        F.when(lost & (F.coalesce(fallback, F.lit("")) == ""), "dead").when(lost, "fallback").when(board, "ok").when(clean["removed"] > 0, "stripped").otherwise("ok").alias("status"),
        F.when(empty, "no url").when(generic, "listing page").when(board, "board link").when(clean["removed"] > 0, "tracking removed").otherwise("unchanged").alias("reason"),
    )


def logo_domain(url: Column, explicit: Column, boards: tuple[str, ...] = BOARD_HOSTS) -> Column:
    """The explicit domain, else the last two labels of the host; empty for boards."""
    site = F.array_join(F.slice(F.split(host(url), r"\."), -2, 2), ".")
    site = F.when(F.size(F.split(host(url), r"\.")) < 2, host(url)).otherwise(site)
    return F.coalesce(F.nullif(explicit, F.lit("")), F.when(site.isin(*boards), "").otherwise(site))

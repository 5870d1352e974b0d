"""Saved-filter predicates, AND-combined into one Column; `strict` follows exact values, `contains` substrings."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARRAYS = ("keywords", "skills")
HIDDEN = ("Software / Compiler", "Unknown", "Other EE", "Out of Scope")


@dataclass(frozen=True)
class Filters:
    status: str | None = None
    company: str | None = None
    priority: str | None = None
    role_category: str | None = None
    experience_level: str | None = None
    level_filter: str | tuple[str, ...] | None = None
    remote: str | None = None
    min_score: int | None = None
    usa_only: bool = False
    include_unknown: bool = False
    include_senior: bool | None = None
    state: str | None = None
    seen_within_hours: int | None = None
    posted_within_hours: int | None = None
    keyword: str | None = None
    skills: tuple[str, ...] = ()
    view: str | None = None
    hide_software: bool = False
    hidden: tuple[str, ...] = ()
    role_flag: str | None = None
    h1b_only: bool = False


def _low(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit("")))


# fixed value: the signs that count as blanks where whole words are searched
SIGNS = ",.;:()/[]{}-|\n\r\t\"'*•·"
#: Where a search looks: substrings of short fields (arrays joined), whole words of long ones. Columns that a table lacks are left out by naming others.
SHORT, LONG = ("title", "norm_title", "company", "keywords", "role_category", "experience_level", "state", "location", "platform"), ("body", "full_text", "snippet")


def keyword(q: str, short: tuple[str, ...] = SHORT, long: tuple[str, ...] = LONG, mode: str = "strict") -> Column:
    """Every token in some field: a substring of the short fields, a whole word (strict) or substring of the long ones. Tokens may hold signs such as + and #."""
    def text(c: str) -> Column:
        return F.lower(F.coalesce(F.array_join(c, " ") if c in ARRAYS else F.col(c), F.lit("")))

    out = F.lit(True)
    for token in q.lower().split():
        hits = [F.contains(text(f), F.lit(token)) for f in short]
        for f in long:
            whole = F.concat(F.lit(" "), F.translate(text(f), SIGNS, " " * len(SIGNS)), F.lit(" ")) if mode == "strict" else text(f)
            hits.append(F.contains(whole, F.lit(f" {token} " if mode == "strict" else token)))
        out = out & reduce(lambda a, b: a | b, hits)
    return out


def predicate(f: Filters, as_of: Column, mode: str = "strict", short: tuple[str, ...] = SHORT, long: tuple[str, ...] = LONG) -> Column:
    """All of a search as one condition; `short` and `long` are the fields that its keyword looks in."""
    same = (lambda c, v: _low(c) == v.lower()) if mode == "strict" else (lambda c, v: F.contains(_low(c), F.lit(v.lower())))
    out = []
    if f.status:
        out.append(F.col("status") == f.status)
    out += [same(c, v) for c, v in (("company", f.company), ("role_category", f.role_category), ("state", f.state)) if v]
    out += [F.contains(_low(c), F.lit(v.lower())) for c, v in (("experience_level", f.experience_level), ("remote_status", f.remote)) if v]
    if f.priority:
        out.append(F.col("priority") == f.priority)
    levels = [f.level_filter] if isinstance(f.level_filter, str) else list(f.level_filter or ())
    if levels:
        flags = {"entry": F.col("is_entry"), "senior": F.col("is_senior")}
        out.append(reduce(lambda a, b: a | b, [flags.get(x.lower(), _low("experience_level") == x.lower()) for x in levels]))
    if f.min_score is not None:
        out.append(F.col("new_grad_fit") >= f.min_score)
    if f.usa_only:
        out.append((F.col("is_usa") | (F.col("confidence") == 0)) if f.include_unknown else F.col("is_usa"))
    if f.include_senior is False or (f.include_senior is None and mode == "strict" and not f.keyword and "senior" not in [x.lower() for x in levels]):
        out.append(~F.col("is_senior"))
    if f.seen_within_hours:
        out.append(F.col("first_seen") >= as_of - F.make_dt_interval(F.lit(0), F.lit(f.seen_within_hours)))
    if f.posted_within_hours:
        out.append(F.coalesce("posted_date", "first_seen") >= as_of - F.make_dt_interval(F.lit(0), F.lit(f.posted_within_hours)))
    if f.keyword:
        out.append(keyword(f.keyword, short, long, mode))
    out += [F.contains(F.lower(F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), ", ")), F.lit(s.lower())) | F.contains(_low("snippet"), F.lit(s.lower())) for s in f.skills]
    if f.view:
        out.append({"entry_level": F.col("is_entry"), "best": F.col("new_grad_fit") >= 65, "all_usa": F.col("is_usa"), "adjacent": F.col("role_category").isin("Adjacent / Backup")}[f.view])
    if f.hide_software:
        out.append(F.col("role_category") != "Software / Compiler")
    if f.hidden:
        out.append(~F.col("role_category").isin(*f.hidden))
    if f.role_flag:
        out.append(F.coalesce(F.element_at("role_flags", f.role_flag), F.lit(False)))
    if f.h1b_only:
        out.append(F.coalesce(F.col("sponsors_h1b"), F.lit(False)) & ~F.col("eligibility_risk").isin("high", "medium"))
    return reduce(lambda a, b: a & b, out, F.lit(True))


def tracked(df: DataFrame) -> DataFrame:
    """Saved or applied rows; no other gate."""
    return df.where(F.col("application_status").isin("saved", "applied"))


def directory_filter(df: DataFrame, q: str = "", sector: str | None = None, hiring: bool | None = None) -> DataFrame:
    """Companies whose name, sector or headquarters (where there is such a column) hold q, of one sector (a company without one is in "Other")."""
    q = q.strip().lower()
    places = [c for c in ("company", "sector", "hq") if c in df.columns]
    out = df.where(reduce(lambda a, b: a | b, [F.contains(_low(c), F.lit(q)) for c in places])) if q else df
    out = out.where(F.coalesce(F.when(F.col("sector") != "", F.col("sector")), F.lit("Other")) == sector) if sector else out
    return out if hiring is None else out.where((F.col("viewable") > 0) == hiring)


def alert_predicate(score: int = 75, tiers=("S", "A")) -> Column:
    return (F.col("match_score") >= score) & F.col("priority").isin(*tiers) & F.col("is_entry")

"""Assertion jobs: rows of (check, n, violations, ok)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import LONG, SHORT, Filters, predicate

LEVELS = ("New Grad", "Entry Level", "Junior", "Associate", "Mid-Level", "Senior", "Staff", "Principal", "Lead", "Manager")


def audit(df: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """checks: name -> (rows looked at, violation among them). One pass, a row per check."""
    names = list(checks)
    sums = df.agg(*[F.count_if(checks[k][0]).alias(f"n{i}") for i, k in enumerate(names)], *[F.count_if(checks[k][0] & checks[k][1]).alias(f"v{i}") for i, k in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(k).alias("check"), F.col(f"n{i}").alias("n"), F.col(f"v{i}").alias("violations"), (F.col(f"v{i}") == 0).alias("ok")) for i, k in enumerate(names)])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def searches(as_of: Column, levels=LEVELS, windows=(24, 168, 720, 2160), company: str = "", state: str = "", remote: str = "Remote", role: str = "", word: str = "") -> dict[str, tuple[Filters, Column, bool]]:
    """Searches to audit: name -> (search, what must hold of its rows, whether it must hold of no other row). The conditions are said anew, not taken from the search."""
    c = F.col
    text = lambda x: F.lower(F.coalesce(c(x), F.lit("")))
    since = lambda h: as_of - F.make_dt_interval(F.lit(0), F.lit(h))
    every = {"include_senior": True}
    out = {f"level {x}": (Filters(level_filter=x, **every), c("experience_level").eqNullSafe(x), True) for x in levels}
    out["no senior by default"] = (Filters(), c("is_senior").eqNullSafe(False), True)
    out["country"] = (Filters(usa_only=True, **every), c("is_usa").eqNullSafe(True), True)
    out["country or unknown place"] = (Filters(usa_only=True, include_unknown=True, **every), c("is_usa").eqNullSafe(True) | (c("confidence") == 0), True)
    out |= {f"posted within {h}": (Filters(posted_within_hours=h, **every), F.datediff(as_of, F.coalesce("posted_date", "first_seen")) * 24 <= h + 24, False) for h in windows}
    out["least fit 75"] = (Filters(min_score=75, **every), ~(F.coalesce("new_grad_fit", F.lit(0)) < 75), True)
    out["remote"] = (Filters(remote=remote, **every), F.instr(text("remote_status"), F.lit(remote.lower())) > 0, True)
    if state:
        out["state"] = (Filters(state=state, **every), F.upper("state") == state.upper(), True)
    if role:
        out["category"] = (Filters(role_category=role, **every), F.upper("role_category") == role.upper(), True)
    if company:
        out["company"] = (Filters(company=company, **every), c("company") == company, True)
    if word:
        whole = F.concat_ws(" ", *[F.array_join(x, " ") if x == "keywords" else c(x) for x in (*SHORT, *LONG)])
        out["keyword"] = (Filters(keyword=word, **every), F.instr(F.lower(whole), F.lit(word.lower())) > 0, False)
    return out


def audit_filters(df: DataFrame, as_of: Column, **wanted) -> DataFrame:
    """Runs the searches and looks at their rows: (check, n, violations, ok), all in one pass.

    n is what a search finds; a violation is a row that it should not find, or does not find and should. Further checks: a
    longer window holds all of a shorter one, New Grad and Entry Level have no row in common, and with seniors there are
    seniors (where the table has any).
    """
    runs = searches(as_of, **wanted)
    found = {k: F.coalesce(predicate(f, as_of), F.lit(False)) for k, (f, _, _) in runs.items()}
    checks = {}
    for k, (_, must, exact) in runs.items():
        must = F.coalesce(must, F.lit(False))
        checks[k] = (found[k] | must, found[k] != must) if exact else (found[k], ~must)
    windows = [k for k in runs if k.startswith("posted within")]
    for a, b in zip(windows, windows[1:], strict=False):
        checks[f"{a} in {b}"] = (found[a], ~found[b])
    if "level New Grad" in found and "level Entry Level" in found:
        checks["new grads are no entry level"] = (found["level New Grad"] | found["level Entry Level"], found["level New Grad"] & found["level Entry Level"])
    seniors = F.coalesce(predicate(Filters(include_senior=True), as_of), F.lit(False))
    checks["seniors if wanted"] = (F.col("is_senior"), ~seniors)
    return audit(df, checks)


def audit_stale(stored: DataFrame, fresh: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per column: rows whose stored value differs from the one derived again."""
    j = stored.alias("s").join(fresh.alias("f"), key)
    sums = j.agg(*[F.count_if(~F.col(f"s.{c}").eqNullSafe(F.col(f"f.{c}"))).alias(c) for c in columns])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("mismatches")) for c in columns])).alias("r")).select("r.*")


def diagnose(df: DataFrame) -> DataFrame:
    """Counts of what a population is made of; a null confidence is a place unknown."""
    return df.agg(F.count("*").alias("total"), F.count_if("is_usa").alias("usa"), F.count_if(F.col("posted_date").isNull()).alias("undated"), F.count_if(F.col("is_senior") & (F.col("new_grad_fit") >= 60)).alias("senior_leaks"), F.count_if(F.col("new_grad_fit") < 60).alias("low_fit"), F.count_if(F.coalesce("confidence", F.lit(0.0)) == 0).alias("unplaced"), F.count_if("is_senior").alias("senior"), F.count_if("is_software").alias("software"))


def audit_catalog(catalog: DataFrame, classified: DataFrame, foreign: DataFrame) -> DataFrame:
    """catalog(company, platform, url, slug, enabled): enabled rows without a slug, whose slug is another owner's board, or
    whose slug and the board in their url have nothing in common; and companies without a classification.

    foreign(platform, slug) names boards known to be someone else's. Slug and url agree where one begins with the other,
    in any case and without what follows a dot.
    """
    plain = lambda c: F.split_part(F.lower(c), F.lit("."), F.lit(1))
    others = foreign.select(F.lower("platform").alias("_platform"), F.lower("slug").alias("_slug")).distinct().withColumn("_other", F.lit(True))
    j = catalog.join(classified.select("company").distinct().withColumn("_k", F.lit(True)), "company", "left")
    j = j.join(others, (F.lower("platform") == F.col("_platform")) & (F.lower("slug") == F.col("_slug")), "left")
    has, board, slug = F.coalesce("slug", F.lit("")) != "", plain(F.regexp_extract(F.coalesce("url", F.lit("")), "://[^/]+/([A-Za-z0-9_.-]+)", 1)), plain(F.col("slug"))
    on = F.coalesce("enabled", F.lit(True))
    return audit(j, {"has slug": (on, ~has), "own board": (on & has, F.col("_other").isNotNull()), "slug agrees with url": (on & has & (board != ""), ~(F.startswith(board, slug) | F.startswith(slug, board))), "classified": (F.lit(True), F.col("_k").isNull())})


def reconcile_counts(df: DataFrame, parts: DataFrame, key: str, n: str) -> DataFrame:
    """(total, summed, ok): a mart's counts against the rows themselves."""
    return df.agg(F.count("*").alias("total")).crossJoin(parts.agg(F.sum(n).cast("long").alias("summed"))).withColumn("ok", F.col("total") == F.col("summed"))

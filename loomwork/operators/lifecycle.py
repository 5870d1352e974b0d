"""Matching, upsert, removal, health and merging of a posting corpus. All are DataFrame -> DataFrame with the clock as a parameter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import classify, places, titles
from ..functions.text import norm_key, normalize_title, remote_status, sane_posted, years_required


def keep_newest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the first in the given order."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def match_existing(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """(in_id, key, tier): the stored row of each incoming one within its company, by job id, then url, then title and place.

    Three equi-joins on wide keys, never on the company alone; each stored side has one row per key first.
    """
    parts = []
    for tier, cols in ((1, ["job_id"]), (2, ["apply_url"]), (3, ["title", "location"])):
        def keyed(df: DataFrame, cols=cols) -> DataFrame:
            made = [F.col(c) if c in ("job_id", "apply_url") else normalize_title(F.col(c)) if c == "title" else norm_key(F.col(c)) for c in cols]
            out = df.select("*", norm_key(F.col("company")).alias("_c"), *[m.alias(f"_k{i}") for i, m in enumerate(made)])
            return out.where(" and ".join(f"_k{i} is not null and _k{i} <> ''" for i in range(len(cols))))
        on = ["_c", *[f"_k{i}" for i in range(len(cols))]]
        side = keyed(stored).groupBy(*on).agg(F.min("key").alias("key"))
        parts.append(keyed(incoming).select("in_id", *on).join(side, on).select("in_id", "key", F.lit(tier).alias("tier")))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("in_id").agg(F.min(F.struct("tier", "key")).alias("m")).select("in_id", "m.key", "m.tier")


def upsert(stored: DataFrame, incoming: DataFrame, as_of: Column, longer_by: int = 50) -> DataFrame:
    """Full outer merge by key: a hit is seen now, active and not missed.

    A body longer by more than `longer_by` replaces the old one; a posted date is filled where it is missing, and an
    insane stored one (in the future, or over five years old) gives way to the incoming one, be that null; a url that
    comes in replaces the stored one. Without a hit a row stays as it is.
    """
    s, i = stored.alias("s"), incoming.alias("i")
    hit, new = F.col("i.key").isNotNull(), F.col("s.key").isNull()
    longer = F.length(F.coalesce("i.body", F.lit(""))) > F.length(F.coalesce("s.body", F.lit(""))) + longer_by
    sick = F.col("s.posted_date").isNull() | sane_posted(F.col("s.posted_date"), as_of).isNull()
    return s.join(i, F.col("s.key") == F.col("i.key"), "full").select(
        F.coalesce("s.key", "i.key").alias("key"),
        F.coalesce("s.company", "i.company").alias("company"),
        F.when(new | longer, F.col("i.body")).otherwise(F.col("s.body")).alias("body"),
        F.when(hit & sick, F.col("i.posted_date")).otherwise(F.col("s.posted_date")).alias("posted_date"),
        F.coalesce(F.nullif(F.col("i.apply_url"), F.lit("")), F.col("s.apply_url")).alias("apply_url"),
        F.coalesce("s.first_seen", as_of).alias("first_seen"),
        F.when(hit, as_of).otherwise(F.col("s.last_seen")).alias("last_seen"),
        F.when(hit, "active").otherwise(F.col("s.status")).alias("status"),
        F.when(hit, 0).otherwise(F.col("s.missed")).alias("missed"),
        F.when(new, "inserted").when(hit & longer, "replaced").when(hit, "refreshed").otherwise("kept").alias("action"),
    )


#: What `enrich` derives from title, body and priority.
DERIVED = ("role_category", "level", "level_confidence", "is_entry_level", "is_senior", "years_min", "years_max", "friendly", "new_grad_fit", "experienced_fit", "eligibility_risk")


def enrich(df: DataFrame, verdict: Column | None = None) -> DataFrame:
    """df(title, body, priority, ...) with DERIVED, from the title and the whole body; columns of these names are replaced."""
    v = titles.verdict(F.col("title"), F.col("body")) if verdict is None else verdict
    kept = [c for c in df.columns if c not in (*DERIVED, "_v")]
    d = df.select(*kept, v.alias("_v"), classify.seniority(F.col("title"), F.col("body")).alias("_s"), years_required(F.col("body")).alias("_y"), classify.eligibility(F.col("body"))["risk"].alias("eligibility_risk"))
    d = d.withColumns({"level": F.col("_s.level"), "level_confidence": F.col("_s.confidence"), "is_entry_level": F.col("_s.level").isin(*classify.ENTRY_LEVELS), "is_senior": F.col("_s.level").isin(*classify.SENIOR_LEVELS), "years_min": F.col("_y.min"), "years_max": F.col("_y.max"), "role_category": titles.role_category(F.col("_v"))})
    d = d.withColumn("friendly", classify.candidate_friendly(F.col("_v"), F.col("title"), F.col("years_min"), F.col("priority")))
    fit = classify.new_grad_fit(F.col("level"), F.col("years_min"), F.col("is_senior"), F.col("is_entry_level"), F.col("friendly"), F.col("title"), F.col("body"))
    return d.withColumns({"new_grad_fit": fit, "experienced_fit": classify.experienced_fit(F.col("level"), F.col("years_min"), F.col("is_senior"))}).select(*kept, *DERIVED)


def reclassify(stored: DataFrame, verdict: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with everything derived again, report): total, changed (another role category) and dropped (of these, now out of scope or software).

    A row without a body keeps its stored eligibility risk. Nothing is joined: old and new stand side by side.
    """
    old = {c: f"_old_{c}" for c in ("role_category", "eligibility_risk")}
    d = enrich(stored.withColumnsRenamed(old), verdict)
    d = d.withColumn("eligibility_risk", F.when(F.coalesce("body", F.lit("")) == "", F.col("_old_eligibility_risk")).otherwise(F.col("eligibility_risk")))
    changed = ~F.col("role_category").eqNullSafe(F.col("_old_role_category"))
    report = d.agg(F.count("*").alias("total"), F.count_if(changed).alias("changed"), F.count_if(changed & F.col("role_category").isin(titles.OUTSIDE, titles.SOFTWARE)).alias("dropped"))
    return d.drop(*old.values()), report


def insert_new(incoming: DataFrame, matches: DataFrame, verdict: Column) -> DataFrame:
    """Incoming rows without a stored match and relevant by their body, with everything that is derived from title, place and body.

    A place of which nothing is known is read from the url's slug instead, where there is one.
    """
    new = incoming.join(matches.select("in_id").distinct(), "in_id", "left_anti").withColumn("_v", verdict).where("_v.relevant")
    known = places.parse_location(F.col("location"), F.col("body"))["confidence"] > 0
    new = new.withColumn("location", F.when(known, F.col("location")).otherwise(F.coalesce(places.location_from_url(F.col("apply_url")), F.col("location"))))
    new = enrich(new.withColumn("priority", F.col("priority") if "priority" in incoming.columns else F.lit(None).cast("string")), F.col("_v"))
    new = new.withColumns({"_l": places.parse_location(F.col("location"), F.col("body")), "remote_status": remote_status(F.col("location"), F.col("body")), "experience_level": classify.experience_level(F.col("title"), F.col("body"))})
    return new.select(*[c for c in incoming.columns if c not in DERIVED], F.col("_l.is_usa").alias("is_usa"), F.col("_l.state").alias("state"), F.col("_l.confidence").alias("location_confidence"), "remote_status", "experience_level", *DERIVED)


def publishable(outcomes: DataFrame) -> DataFrame:
    """(run, planned, succeeded, publish) of outcomes (company, run, ok): a run in which companies were planned and none succeeded is not published."""
    by = outcomes.groupBy("run").agg(F.count("*").alias("planned"), F.count_if("ok").alias("succeeded"))
    return by.withColumn("publish", F.col("succeeded") > 0)


def reconcile_removals(stored: DataFrame, seen: DataFrame, as_of: Column, threshold: int = 2) -> DataFrame:
    """Rows not seen, of companies seen at all, miss once more; at the threshold they are removed."""
    ran = seen.select("company").distinct().withColumn("_ran", F.lit(True))
    here = seen.select("key").distinct().withColumn("_seen", F.lit(True))
    j = stored.join(ran, "company", "left").join(here, "key", "left")
    missed = F.when(F.col("_ran") & F.col("_seen").isNull() & F.col("status").isin("active", "possibly_removed"), F.col("missed") + 1)
    j = j.withColumn("_m", missed)
    gone = F.col("_m") >= threshold
    return j.select(*[c for c in stored.columns if c not in ("status", "missed", "removed_at")], F.when(gone, "removed").when(F.col("_m").isNotNull(), "possibly_removed").otherwise(F.col("status")).alias("status"), F.coalesce("_m", "missed").alias("missed"), F.when(gone, as_of).otherwise(F.col("removed_at")).alias("removed_at"))


def streaks(log: DataFrame, key: str, at: str, hit: Column) -> DataFrame:
    """The log with `streak`: how many rows in a row, up to this one, are not a hit (gaps and islands, one window)."""
    w = W.partitionBy(key).orderBy(at)
    numbered = log.withColumn("_n", F.row_number().over(w))
    last = F.max(F.when(hit, F.col("_n"))).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return numbered.withColumn("streak", (F.col("_n") - F.coalesce(last, F.lit(0))).cast("int")).drop("_n")


def removal_history(log: DataFrame, key: str, at: str, hit: Column, threshold: int = 2) -> DataFrame:
    """Status after each observation: active, possibly_removed, removed."""
    return streaks(log, key, at, hit).withColumn("status", F.when(F.col("streak") == 0, "active").when(F.col("streak") >= threshold, "removed").otherwise("possibly_removed"))


def streak_parts(log: DataFrame, key: str, at: str, part: Column, hits: dict[str, Column]) -> DataFrame:
    """(key, part, and for each name whether the part has a hit and how many rows follow the last one): what a part of a log adds to its streaks.

    A part is a bounded stretch of time, such as a month. It is read once; later runs merge its row with those of newer
    parts, so history is not sorted again. A null hit is none.
    """
    rows = F.sort_array(F.collect_list(F.struct(F.col(at).alias("at"), *[F.coalesce(h, F.lit(False)).alias(k) for k, h in hits.items()])))
    g = log.groupBy(key, part.alias("part")).agg(F.reverse(rows).alias("_r"))

    def state(k: str) -> Column:
        back = F.array_position(F.col("_r")[k], True).cast("int")
        return F.struct((back > 0).alias("hit"), F.when(back > 0, back - 1).otherwise(F.size("_r")).alias("trail")).alias(k)

    return g.select(key, "part", *[state(k) for k in hits])


def merged_streaks(parts: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key, names): the streaks now, from streak_parts of any parts that together are the log, in whatever order they came."""
    g = parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("part", *names))).alias("_p"))
    fold = lambda k: F.aggregate("_p", F.lit(0), lambda acc, p: F.when(p[k]["hit"], 0).otherwise(acc) + p[k]["trail"]).alias(k)
    return g.select(key, *[fold(k) for k in names])


def health_of_parts(parts: DataFrame, quarantine: int = 8, stall: int = 12) -> DataFrame:
    """company_health from the streak parts `ok` and `found`, without a window over the log."""
    s = merged_streaks(parts, "company", ["ok", "found"])
    return s.select("company", F.col("ok").alias("error_count"), F.col("found").alias("empty_streak"), (F.col("ok") >= quarantine).alias("quarantined"), (F.col("found") >= stall).alias("stalled"))


def company_health(outcomes: DataFrame, quarantine: int = 8, stall: int = 12) -> DataFrame:
    """outcomes(company, run, ok, empty) -> errors and empty streak now: errors count since the last success, empties since the last find."""
    a = streaks(outcomes, "company", "run", F.col("ok")).withColumnRenamed("streak", "error_count")
    b = streaks(a.withColumn("_found", F.col("ok") & ~F.col("empty")), "company", "run", F.col("_found"))
    last = b.groupBy("company").agg(F.max_by(F.struct("error_count", "streak"), "run").alias("x"))
    return last.select("company", F.col("x.error_count").alias("error_count"), F.col("x.streak").alias("empty_streak"), (F.col("x.error_count") >= quarantine).alias("quarantined"), (F.col("x.streak") >= stall).alias("stalled"))


def prune_runs(runs: DataFrame, errors: DataFrame, as_of: Column, keep: int = 20, stale_minutes: int = 60) -> tuple[DataFrame, DataFrame]:
    """Unfinished runs of over an hour go, the newest `keep` stay, errors of the others go with them."""
    alive = runs.where(~(F.col("finished_at").isNull() & (F.col("started_at") < as_of - F.expr(f"make_dt_interval(0, 0, {stale_minutes})"))))
    kept = alive.orderBy(F.desc("started_at"), F.desc("run_id")).limit(keep)
    return kept, errors.join(F.broadcast(kept.select("run_id")), "run_id", "left_semi")


def browseable(df: DataFrame) -> DataFrame:
    return df.where("status = 'active' and in_scope and (is_usa or confidence = 0)")


@dataclass
class Corpus:
    """Published tables: live rows, state rows of what is not browseable, bodies."""

    live: DataFrame
    state: DataFrame
    bodies: DataFrame


def split_live_state(df: DataFrame) -> Corpus:
    """In-scope rows: browseable ones live, the others state; bodies of live rows only."""
    live = F.col("status").eqNullSafe("active") & (F.col("is_usa") | (F.col("confidence") == 0))
    inside = df.where("in_scope")
    return Corpus(inside.where(live).drop("body"), inside.where(~live).drop("body"), inside.where(live).select("key", "body"))


def authoritative_replace(published: DataFrame, shard: DataFrame, owned: DataFrame | None) -> DataFrame:
    """Rows of owned companies come from the shard; without a list of owners all of them do."""
    if owned is None:
        return shard
    return published.join(owned.select("company").distinct(), "company", "left_anti").select(published.columns).unionByName(shard.select(published.columns))


def merge_shards(published: DataFrame, shards: DataFrame) -> DataFrame:
    """Many shards at once (column seq): the last shard that names a company owns it."""
    owner = shards.groupBy("company").agg(F.max("seq").alias("seq"))
    last = shards.join(owner, ["company", "seq"], "left_semi")
    return published.join(owner, "company", "left_anti").select(published.columns).unionByName(last.select(published.columns))


def configured_only(df: DataFrame, catalog: DataFrame) -> DataFrame:
    return df.join(catalog.select("company").distinct(), "company", "left_semi")


def of_companies(df: DataFrame, directory: DataFrame, ids: str) -> DataFrame:
    """Rows of the companies whose ids a comma-separated list names; a list that names no known company is no filter. directory(company_id, company) has a row per company."""
    wanted = [int(x) for x in map(str.strip, ids.split(",")) if x.isdigit()]
    known = directory.where(F.col("company_id").isin(*wanted)).select("company").distinct() if wanted else None
    if known is None or known.limit(1).isEmpty():
        return df
    return df.join(known, "company", "left_semi")


def retire_stale(live: DataFrame, as_of: Column, days: int = 21) -> tuple[DataFrame, DataFrame]:
    """(still live, retired): rows unseen for more than `days`, removed now."""
    old = F.col("last_seen") < as_of - F.make_dt_interval(F.lit(days))
    return live.where(~old), live.where(old).withColumn("status", F.lit("removed")).withColumn("removed_at", as_of)


def purge_removed(state: DataFrame, as_of: Column, days: int = 60) -> DataFrame:
    return state.where(F.coalesce("removed_at", as_of) >= as_of - F.make_dt_interval(F.lit(days)))


def live_beats_state(state: DataFrame, live: DataFrame) -> DataFrame:
    return state.join(live.select("key"), "key", "left_anti")


def union_runs(a: DataFrame, b: DataFrame, keep: int = 30) -> DataFrame:
    """By (triggered_by, started_at) the later table wins; the newest stay."""
    both = a.withColumn("_seq", F.lit(0)).unionByName(b.withColumn("_seq", F.lit(1)))
    return keep_newest(both, ["triggered_by", "started_at"], F.desc("_seq")).drop("_seq").orderBy(F.desc("started_at"), "triggered_by").limit(keep)


def upsert_bodies(a: DataFrame, b: DataFrame, live: DataFrame) -> DataFrame:
    both = a.withColumn("_seq", F.lit(0)).unionByName(b.withColumn("_seq", F.lit(1)))
    return keep_newest(both, ["key"], F.desc("_seq")).drop("_seq").join(live.select("key"), "key", "left_semi")


def guard_total_failure(outcomes: DataFrame) -> None:
    """Raises if runs were planned and none succeeded."""
    n, ok = outcomes.agg(F.count("*"), F.count_if("ok")).first()
    if n and not ok:
        raise RuntimeError("no company succeeded: nothing is published")


def restore_health(catalog: DataFrame, prior: DataFrame) -> DataFrame:
    return catalog.join(prior, "company", "left").select(*[F.col(c) for c in catalog.columns], F.coalesce("error_count", F.lit(0)).alias("error_count"), F.coalesce("empty_streak", F.lit(0)).alias("empty_streak"))


def fill_missing(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """Empty or null columns get their expression; `changed` where any did."""
    new = {c: F.coalesce(F.nullif(F.col(c), F.lit("")) if dict(df.dtypes)[c] == "string" else F.col(c), e) for c, e in exprs.items()}
    changed = F.lit(False)
    for c, e in new.items():
        changed = changed | ~e.eqNullSafe(F.col(c))
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns], changed.alias("changed"))


def rescore_report(old: DataFrame, new: DataFrame, key: str, score: str, cuts=(90, 75, 60, 46)) -> DataFrame:
    """Per fit band: rows before and after."""
    band = lambda c: F.coalesce(*[F.when(F.col(c) >= k, F.lit(k)) for k in cuts], F.lit(0))
    j = old.select(key, F.col(score).alias("_a")).join(new.select(key, F.col(score).alias("_b")), key, "full")
    rows = j.select(F.explode(F.array(F.struct(band("_a").alias("band"), F.lit(1).alias("before"), F.lit(0).alias("after")), F.struct(band("_b").alias("band"), F.lit(0).alias("before"), F.lit(1).alias("after")))).alias("r")).select("r.*")
    return rows.groupBy("band").agg(F.sum("before").cast("long").alias("before"), F.sum("after").cast("long").alias("after"))


def flag_report(old: DataFrame, new: DataFrame, key: str, flags: list[str]) -> DataFrame:
    """Per boolean column: rows that have it before and after, and how many lost and gained it. Null is false."""
    has = lambda side, c: F.coalesce(F.col(f"{side}.{c}"), F.lit(False))
    counts = lambda c: {"before": has("o", c), "after": has("n", c), "lost": has("o", c) & ~has("n", c), "gained": ~has("o", c) & has("n", c)}
    sums = old.alias("o").join(new.alias("n"), key, "full").agg(*[F.count_if(x).alias(f"{c}_{k}") for c in flags for k, x in counts(c).items()])
    rows = F.array(*[F.struct(F.lit(c).alias("flag"), *[F.col(f"{c}_{k}").alias(k) for k in counts(c)]) for c in flags])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def overlay_marks(df: DataFrame, marks: DataFrame) -> DataFrame:
    return df.join(marks.select("key", F.col("status").alias("_mark"), "notes"), "key", "left").withColumn("application_status", F.coalesce("_mark", F.lit("none"))).drop("_mark")


def merge_marks(cur: DataFrame, incoming: DataFrame) -> DataFrame:
    """Union by key; fields that the incoming row has override."""
    c, i = cur.alias("c"), incoming.alias("i")
    rest = [x for x in cur.columns if x != "key"]
    return c.join(i, F.col("c.key") == F.col("i.key"), "full").select(F.coalesce("c.key", "i.key").alias("key"), *[F.coalesce(f"i.{x}", f"c.{x}").alias(x) for x in rest])


def fold_status(events: DataFrame, stages=("applied", "assessment", "interview", "offer")) -> DataFrame:
    """events(key, seq, ts, status) -> latest status and the first time of each kind; a pipeline stage implies applied."""
    first = lambda c: F.min(F.when(c, F.col("ts")))
    return events.groupBy("key").agg(F.max_by("status", F.struct("ts", "seq")).alias("status"), first(F.col("status") == "saved").alias("saved_at"), first(F.col("status").isin(*stages)).alias("applied_at"), first(F.col("status") == "ignored").alias("ignored_at"))


def active_profile(df: DataFrame) -> DataFrame:
    """One row per owner: the active one, else the newest."""
    return keep_newest(df, ["owner"], F.desc("is_active"), F.desc("id"))

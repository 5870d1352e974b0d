"""Aggregates: facets, dashboard, company and sector marts, health. One scan each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def facets(df: DataFrame, as_of: Column, most_states: int = 15) -> DataFrame:
    """(facet, value, n): category, tier, platform and state counts (states: the top ones), the total, and the counts of entry or friendly, friendly, senior, remote and new (a day, by effective date) rows, by one GROUPING SETS."""
    c = F.count_if
    new = F.coalesce("posted_date", "first_seen") >= as_of - F.make_dt_interval(F.lit(1))
    more = {"entry": F.col("is_entry") | F.col("friendly"), "friendly": F.col("friendly"), "senior": F.col("is_senior"), "remote": F.contains(F.lower("remote_status"), F.lit("remote")), "new_day": new}
    g = df.groupingSets([["role_category"], ["priority"], ["platform"], ["state"], []], "role_category", "priority", "platform", "state").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), *[c(x).alias(k) for k, x in more.items()])
    kind = F.when(F.col("g") == 7, "role_category").when(F.col("g") == 11, "priority").when(F.col("g") == 13, "platform").when(F.col("g") == 14, "state").otherwise("total")
    row = lambda facet, value, n: F.struct(facet.alias("facet"), value.alias("value"), n.alias("n"))
    one = row(kind, F.coalesce("role_category", "priority", "platform", "state", F.lit("all")), F.col("n"))
    every = F.array(one, *[row(F.lit(k), F.lit("all"), F.col(k)) for k in more])
    rows = g.select(F.explode(F.when(F.col("g") == 15, every).otherwise(F.array(one))).alias("r")).select("r.*")
    return rows.withColumn("_r", F.row_number().over(W.partitionBy("facet").orderBy(F.desc("n"), "value"))).where((F.col("facet") != "state") | (F.col("_r") <= most_states)).drop("_r")


def dashboard(df: DataFrame, as_of: Column) -> DataFrame:
    """All counts of the front page in one pass."""
    day = lambda n: F.col("first_seen") >= as_of - F.make_dt_interval(F.lit(n))
    c = F.count_if
    return df.agg(
        F.count("*").alias("total"), c("is_usa").alias("usa"), c("is_entry").alias("entry"), c("is_senior").alias("senior"), c(F.col("is_usa") & F.col("is_entry")).alias("usa_entry"),
        c(day(1)).alias("new_day"), c(day(7)).alias("new_week"), c(day(30)).alias("new_month"), c(F.col("match_score") >= 75).alias("strong"), c(F.col("new_grad_fit") >= 65).alias("best"),
        c(F.col("posted_date").isNotNull()).alias("dated"), c(F.col("eligibility_risk") == "high").alias("high_risk"), c(F.col("priority") == "S").alias("tier_s"), F.count_distinct("company").alias("companies"),
        c(~F.col("is_usa")).alias("non_usa"), c(F.col("role_category") == "Software / Compiler").alias("software"),
    )


def inventory(df: DataFrame, runs: DataFrame, as_of: Column) -> DataFrame:
    """The status counts of all stored postings in one pass, and what the latest of runs(started_at, jobs_found) scanned.

    Counts of browseable postings (`total_active` to `strong_new_grad`) are over active ones in the country or of unknown
    place that are no software roles; from `total_in_db` on, the funnel from everything stored down to these. Null flags
    are false; without a run `scanned_last_run` is null.
    """
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    status = lambda x: F.col("active_status") == x
    nowhere = F.coalesce("location_confidence", F.lit(0.0)) == 0.0
    active, senior, entry, friendly = status("active"), is_("is_senior"), is_("is_entry"), is_("friendly")
    view = active & (is_("is_usa") | nowhere) & ~is_("is_software")
    dated = F.coalesce("posted_date", "first_seen")
    counts = {
        "total_active": view, "new_24h": view & (dated >= as_of - F.make_dt_interval(F.lit(1))), "entry_level": view & (entry | friendly) & ~senior, "strict_entry": view & entry & ~senior,
        "candidate_friendly": view & friendly & ~entry & ~senior, "usa_count": active & is_("is_usa"), "remote_count": view & (F.lower("remote_status") == "remote"),
        "senior_filtered": view & senior, "high_score": view & (F.col("new_grad_fit") >= 70), "strong_new_grad": view & (F.col("new_grad_fit") >= 75),
        "total_in_db": F.lit(True), "active_all": active, "non_usa_filtered": active & ~is_("is_usa") & ~nowhere, "software_filtered": active & is_("is_software"),
        "saved": status("saved"), "applied": status("applied"),
    }
    last = runs.agg(F.max_by("jobs_found", "started_at").cast("long").alias("scanned_last_run"))
    return df.agg(*[F.count_if(c).alias(k) for k, c in counts.items()]).crossJoin(last)  # a row each


def company_confidence(df: DataFrame) -> DataFrame:
    """Per company the mean of its postings' data_quality_score, without zeros and nulls, rounded half to even; 0 where there is none."""
    return df.groupBy("company").agg(F.coalesce(F.bround(F.avg(F.when(F.col("data_quality_score") != 0, F.col("data_quality_score"))), 0), F.lit(0)).cast("long").alias("parser_confidence"))


def company_stats(df: DataFrame, as_of: Column) -> DataFrame:
    today = F.col("first_seen") >= as_of - F.make_dt_interval(F.lit(1))
    return df.groupBy("company").agg(F.count("*").alias("total"), F.count_if("is_usa").alias("usa"), F.count_if("is_entry").alias("entry"), F.count_if(F.col("match_score") > 0).alias("relevant"), F.count_if(F.col("is_usa") & ~F.col("is_senior")).alias("viewable"), F.count_if(today).alias("new_today"), F.avg("match_score").alias("avg_score"))


def company_tallies(df: DataFrame, as_of: Column) -> DataFrame:
    """Nested: viewable within usa; entry, new and unique within viewable."""
    v = F.col("is_usa") & ~F.col("is_senior")
    today = F.col("first_seen") >= as_of - F.make_dt_interval(F.lit(1))
    return df.groupBy("company").agg(F.count("*").alias("total"), F.count_if("is_usa").alias("usa"), F.count_if(v).alias("viewable"), F.count_if(v & F.col("is_entry")).alias("entry"), F.count_if(v & today).alias("new_today"), F.count_distinct(F.when(v, F.col("dup_group"))).alias("unique"))


def company_entries(catalog: DataFrame, tallies: DataFrame, health: DataFrame) -> DataFrame:
    """Catalog with tallies (with parser_confidence too, if they have it) and health; status: quarantined, error, stalled, ok, idle."""
    j = catalog.join(tallies, "company", "left").join(health, "company", "left")
    status = F.when(F.coalesce("quarantined", F.lit(False)), "quarantined").when(F.coalesce("error_count", F.lit(0)) > 2, "error").when(F.coalesce("stalled", F.lit(False)), "stalled").when(F.coalesce("total", F.lit(0)) > 0, "ok").otherwise("idle")
    return j.select(*[F.col(c) for c in catalog.columns], *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "usa", "viewable", "parser_confidence") if c in tallies.columns], status.alias("status"))


def corpus_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count_distinct(F.coalesce("dup_group", F.col("id").cast("string"))).alias("unique_visible"))


def skill_gaps(matches: DataFrame, min_match: int = 45, n: int = 15) -> DataFrame:
    """The skills most often missing in the pool of matches (weight, resume_match, missing); with the pool's size."""
    pool = matches.where(F.col("resume_match") >= min_match)
    top = pool.select("weight", F.explode("missing").alias("skill")).groupBy("skill").agg(F.sum("weight").alias("n")).where("n > 0").orderBy(F.desc("n"), "skill").limit(n)
    return top.crossJoin(F.broadcast(pool.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("pool"))))


def skill_gaps_simple(df: DataFrame, known: DataFrame, n: int = 12) -> DataFrame:
    return df.select(F.explode("skills").alias("skill")).groupBy("skill").agg(F.count("*").alias("n")).join(known, "skill", "left_anti").orderBy(F.desc("n"), "skill").limit(n)


def pipeline_health(runs: DataFrame, cadence: DataFrame, as_of: Column) -> DataFrame:
    """Per engine: the last good run, whether its age is within two (ok) or four (stale) cadences, and overall the worst state of all."""
    good = runs.where("finished and companies > 0").groupBy("engine").agg(F.max("started_at").alias("last_good"))
    age = (F.unix_timestamp(as_of) - F.unix_timestamp("last_good")) / 3600
    j = cadence.join(good, "engine", "left")
    state = F.when(F.col("last_good").isNull(), "down").when(age <= 2 * F.col("hours"), "ok").when(age <= 4 * F.col("hours"), "stale").otherwise("down")
    every = W.partitionBy()  # a row per engine
    worst = F.when(F.max(F.col("status") == "down").over(every), "down").when(F.max(F.col("status") == "stale").over(every), "stale").otherwise("ok")
    return j.select("engine", "last_good", state.alias("status")).withColumn("overall", worst)


def client_health(health: DataFrame, generated: Column, as_of: Column, fresh_hours: int = 12) -> DataFrame:
    """(overall, working, engines, corpus_age_hours) of pipeline_health's rows, as a reader of the corpus sees it.

    All engines well is ok; some well, or a corpus younger than `fresh_hours`, is stale: something still gets through.
    """
    age = F.round((F.unix_timestamp(as_of) - F.unix_timestamp(generated)) / 3600, 1)
    sums = health.agg(F.count_if(F.col("status") == "ok").alias("working"), F.count("*").alias("engines"))
    overall = F.when(F.col("working") == F.col("engines"), "ok").when((F.col("working") > 0) | F.coalesce(age <= fresh_hours, F.lit(False)), "stale").otherwise("down")
    return sums.select(overall.alias("overall"), "working", "engines", age.alias("corpus_age_hours"))


def attention(health: DataFrame) -> DataFrame:
    """health rows that want a look, with kind and place: quarantined or stalled ones first, then those with errors; the worst first. A row per company at most."""
    kind = F.when(F.col("quarantined") | F.col("stalled"), "attention").when(F.col("error_count") > 0, "erroring")
    worst = W.orderBy("kind", F.desc("error_count"), F.desc("empty_streak"), "company")
    return health.withColumn("kind", kind).where("kind is not null").withColumn("place", F.row_number().over(worst)).orderBy("place")


def sector_summary(entries: DataFrame) -> DataFrame:
    return entries.groupBy("sector").agg(F.count("*").alias("companies"), F.count_if(F.col("viewable") > 0).alias("hiring"), F.sum("usa").alias("us_roles"))


def board_yield(df: DataFrame, samples: int = 6) -> DataFrame:
    """Per company of df(company, title, role_category, is_usa, relevant, maybe): listed, keep (relevant), us_keep (of these in
    the country), maybe (undecided and not relevant), counts of the kept ones by category, and their first titles."""
    keep = F.coalesce("relevant", F.lit(False))
    us, maybe = keep & F.coalesce("is_usa", F.lit(False)), ~keep & F.coalesce("maybe", F.lit(False))
    by = df.groupBy("company", "role_category").agg(F.count("*").alias("n"), F.count_if(keep).alias("k"), F.count_if(us).alias("us"), F.count_if(maybe).alias("m"))
    kept = F.filter(F.collect_list(F.struct("role_category", F.col("k").alias("n"))), lambda x: (x["n"] > 0) & x["role_category"].isNotNull())
    cats = by.groupBy("company").agg(F.sum("n").alias("listed"), F.sum("k").alias("keep"), F.sum("us").alias("us_keep"), F.sum("m").alias("maybe"), F.map_from_entries(F.array_sort(kept)).alias("categories"))
    first = df.where(keep).select("company", "title").distinct().withColumn("_r", F.row_number().over(W.partitionBy("company").orderBy("title"))).where(F.col("_r") <= samples)
    first = first.groupBy("company").agg(F.array_sort(F.collect_list("title")).alias("samples"))
    return cats.join(first, "company", "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))


def run_totals(outcomes: DataFrame) -> DataFrame:
    """Per run: companies, postings found, new and removed, and errors."""
    return outcomes.groupBy("run").agg(F.count_distinct("company").alias("companies"), *[F.sum(c).alias(c) for c in ("found", "new", "removed")], F.count_if("error").alias("errors"))

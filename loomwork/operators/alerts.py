"""Saved searches, digests and alerts as result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.classify import once


EQUAL = ("role_category", "state", "priority", "level")
#: Searched texts, and the columns of postings that they are searched in.
HELD = {"company": ("company",), "remote": ("remote_status",), "keyword": ("title", "company", "role_category")}
LEVELS = 31  # of a score's intervals: whole numbers below 2 ** 31


def _code(kind: str, value: Column | str) -> Column:
    return F.xxhash64(F.lit(kind), value if isinstance(value, Column) else F.lit(value))


def _interval(level: Column, at: Column) -> Column:
    """Scores from at * 2 ** level up to the next one of that level."""
    return F.xxhash64(F.lit("score"), level.cast("int"), at.cast("long"))


def _grams(text: Column, n: int) -> Column:
    """Distinct runs of n characters."""
    run = lambda t: F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substr(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(once(text, run))


def _coded(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: _code(kind, v))


def _held_text(fields: tuple[str, ...]) -> Column:
    return F.array_join(F.transform(F.array(*[F.col(f) for f in fields]), lambda x: F.lower(F.coalesce(x, F.lit("")))), "\x1f")


def posting_atoms(postings: DataFrame, columns: list[str]) -> Column:
    """What a posting satisfies of what a search can ask for, each as a hash: nothing at all, its values, its true flags, the intervals that its score lies in, and the runs of up to three characters in what is searched."""
    out = [F.array(_code("all", ""))]
    out += [F.array(F.when(F.col(c).isNotNull(), _code(c, F.col(c)))) for c in EQUAL if c in columns]
    flags = [c for c, kind in postings.dtypes if kind == "boolean"]
    out.append(F.array(*[F.when(F.col(c), _code("flag", c)) for c in flags], F.when(~F.col("is_senior"), _code("junior", "")) if "is_senior" in flags else F.lit(None).cast("long")))
    score = F.col("new_grad_fit").cast("long")
    out.append(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda i: F.when(score >= 0, _interval(i, F.floor(score / F.pow(F.lit(2), i))))))
    for kind, fields in HELD.items():
        if kind in columns:
            out += [_coded(kind, _grams(_held_text(fields), n)) for n in (1, 2, 3)]
    return F.array_compact(F.array_distinct(F.concat(*out)))


def search_atoms(watchlists: DataFrame) -> Column:
    """What a search asks for, as an array of alternatives: each an array of hashes of which a posting that it finds has just one."""
    one = lambda ok, code: F.when(ok, F.array(code))
    out = [F.array(_code("all", ""))]
    out += [one(F.col(c).isNotNull(), _code(c, F.col(c))) for c in EQUAL if c in watchlists.columns]
    out.append(one(F.coalesce("usa_only", F.lit(False)), _code("flag", "is_usa")))
    if "include_senior" in watchlists.columns:
        out.append(one(~F.coalesce("include_senior", F.lit(True)), _code("junior", "")))
    # scores from the least one up: the right siblings on the way from it to the top, and itself
    least = F.col("min_score").cast("long")
    up = F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 2)), lambda i: F.struct(i.alias("i"), F.floor(least / F.pow(F.lit(2), i)).alias("at")))
    right = F.transform(F.filter(up, lambda x: F.pmod(x["at"], F.lit(2)) == 0), lambda x: _interval(x["i"], x["at"] + 1))
    out.append(F.when(least > 0, F.concat(F.array(_interval(F.lit(0), least)), right)))
    for kind in HELD:
        if kind in watchlists.columns:
            text = F.lower(kind)
            out.append(one(F.length(text) > 0, _code(kind, F.left(text, F.lit(3)))))
            out.append(one(F.length(text) > 3, _code(kind, F.right(text, F.lit(3)))))
    return F.array_compact(F.array(*out))


def watchlist_hits(watchlists: DataFrame, postings: DataFrame) -> DataFrame:
    """watchlists(watch_id, role_category, state, priority, min_score, usa_only, since) x postings; null filters match all.

    Further filters where watchlists has them: level (equal), company, remote, keyword (each held in any case; a keyword by
    title, company or category), include_senior (false hides senior postings) and role_flags (names of boolean columns of
    postings that have to be true; other names are ignored).

    A predicate index: searches are cut into conditions that postings either have or not. Of each search the one that
    fewest postings have is its way in: postings meet it there, in an equi-join, and the rest is looked at on the rows
    that come. A search that asks for nothing is met by all, as its result is.
    """
    asked = watchlists.withColumn("_groups", search_atoms(watchlists))
    had = postings.select("*", F.explode(posting_atoms(postings, watchlists.columns)).alias("_atom"))
    ways = asked.select("watch_id", F.posexplode("_groups").alias("_g", "_atoms")).select("watch_id", "_g", F.explode("_atoms").alias("_atom"))
    common = had.select("_atom").join(ways.select("_atom").distinct(), "_atom", "left_semi").groupBy("_atom").agg(F.count("*").alias("_n"))
    cost = ways.join(common, "_atom", "left").groupBy("watch_id", "_g").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_n"))
    best = cost.groupBy("watch_id").agg(F.min_by("_g", F.struct("_n", "_g")).alias("_g"))
    access = ways.join(best, ["watch_id", "_g"]).join(watchlists, "watch_id").drop("_g")
    w, p = access.alias("w"), had.alias("p")
    ok = F.col("w._atom") == F.col("p._atom")
    for c in EQUAL:
        if c in watchlists.columns:
            ok = ok & (F.col(f"w.{c}").isNull() | (F.col(f"w.{c}") == F.col(f"p.{c}")))
    for c, fields in HELD.items():
        if c in watchlists.columns:
            hit = reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(F.col(f"p.{f}"), F.lit(""))), F.lower(f"w.{c}")) for f in fields])
            ok = ok & (F.col(f"w.{c}").isNull() | hit)
    ok = ok & _flags_hold(watchlists, postings)
    return p.join(w, ok).select("w.watch_id", "p.id", "p.title", "p.company", "p.first_seen", (F.col("p.first_seen") >= F.col("w.since")).alias("is_new"))


def _with_held(postings: DataFrame, watchlists: DataFrame, kind: str) -> DataFrame:
    """postings with `_kind`: the texts that searches ask for and that its fields hold. Different values of the fields meet different texts by a text's first three characters."""
    fields = F.array(*[F.lower(F.coalesce(F.col(f), F.lit(""))) for f in HELD[kind]])
    asked = watchlists.select(F.lower(kind).alias("_t")).where("length(_t) > 0").distinct().withColumn("_run", F.left("_t", F.lit(3)))
    values = postings.select(fields.alias("_v")).distinct()
    runs = values.select("_v", F.explode(F.array_distinct(F.flatten(F.transform("_v", lambda t: F.concat(*[_grams(t, n) for n in (1, 2, 3)]))))).alias("_run"))
    held = runs.join(asked, "_run").where(F.exists("_v", lambda t: F.contains(t, F.col("_t")))).groupBy("_v").agg(F.array_sort(F.collect_set("_t")).alias(f"_{kind}"))
    return postings.withColumn("_v", fields).join(held, "_v", "left").drop("_v").withColumn(f"_{kind}", F.coalesce(f"_{kind}", F.array().cast("array<string>")))


def posting_classes(watchlists: DataFrame, postings: DataFrame, moments: int = 64) -> DataFrame:
    """Postings that no search tells apart: all that searches ask for, `_n` of them, and the newest as (first_seen, id, title, company).

    Of the searched texts a class has those that it holds. A posting's time counts by how many of the searches' times it
    has reached, or, if these are more than `moments`, as it is.
    """
    held = [k for k in HELD if k in watchlists.columns]
    for kind in held:
        postings = _with_held(postings, watchlists, kind)
    since = [r.at for r in watchlists.select(F.unix_micros(F.col("since").cast("timestamp")).alias("at")).where("at is not null").distinct().limit(moments + 1).collect()]
    if len(since) > moments:
        seen = F.col("first_seen")
    else:
        reached = F.greatest(F.lit(None).cast("timestamp"), *[F.when(F.col("first_seen") >= F.timestamp_micros(F.lit(t)), F.timestamp_micros(F.lit(t))) for t in since]) if since else F.lit(None).cast("timestamp")
        seen = F.coalesce(reached, F.when(F.col("first_seen").isNotNull(), F.expr("TIMESTAMP '0001-01-01'")))
    keys = [c for c in EQUAL if c in watchlists.columns] + [c for c, t in postings.dtypes if t == "boolean"] + ["new_grad_fit", *[f"_{k}" for k in held]]
    newest = F.struct("first_seen", "id", "title", "company")
    return postings.withColumn("_seen", seen).groupBy("_seen", *keys).agg(F.count("*").alias("_n"), F.max(newest).alias("_newest"))


def class_hits(watchlists: DataFrame, postings: DataFrame) -> DataFrame:
    """(_search, is_new, _n, _newest): each different search with the classes of postings that it finds, as `watchlist_hits` finds postings, through the same index."""
    filters = [c for c in watchlists.columns if c != "watch_id"]
    kinds = watchlists.select(*filters).distinct().withColumn("_search", _search(watchlists))
    classes = posting_classes(watchlists, postings)
    held = [k for k in HELD if k in watchlists.columns]
    plain = classes.drop(*[f"_{k}" for k in held])
    own = posting_atoms(plain, [c for c in watchlists.columns if c not in HELD])
    atoms = F.concat(own, *[_coded(f"held {k}", F.col(f"_{k}")) for k in held])
    had = classes.withColumn("_cls", F.xxhash64(F.struct(*[c for c in classes.columns if c != "_newest"]))).select("*", atoms.alias("_atoms"))
    groups = search_atoms(kinds.drop(*held))
    for k in held:
        groups = F.concat(groups, F.when(F.length(k) > 0, F.array(F.array(_code(f"held {k}", F.lower(k))))).otherwise(F.array().cast("array<array<bigint>>")))
    ways = kinds.select("_search", F.posexplode(groups).alias("_g", "_any")).select("_search", "_g", F.explode("_any").alias("_atom"))
    common = had.select(F.explode("_atoms").alias("_atom")).groupBy("_atom").agg(F.count("*").alias("_n"))
    cost = ways.join(common, "_atom", "left").groupBy("_search", "_g").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_n"))
    best = cost.groupBy("_search").agg(F.min_by("_g", F.struct("_n", "_g")).alias("_g"))
    w = ways.join(best, ["_search", "_g"]).drop("_g").join(kinds, "_search").alias("w")
    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = had.withColumn("_atom", F.explode("_atoms")).drop("_atoms").repartition(parts, "_cls").alias("p")
    ok = F.col("w._atom") == F.col("p._atom")
    for c in EQUAL:
        if c in watchlists.columns:
            ok = ok & (F.col(f"w.{c}").isNull() | (F.col(f"w.{c}") == F.col(f"p.{c}")))
    for k in held:
        ok = ok & ((F.coalesce(F.length(f"w.{k}"), F.lit(0)) == 0) | F.array_contains(f"p._{k}", F.lower(f"w.{k}")))
    ok = ok & _flags_hold(watchlists, postings)
    is_new = (F.col("p._seen") >= F.col("w.since")).alias("is_new")
    return p.join(w, ok).select("w._search", is_new, "p._n", "p._newest")


def _flags_hold(watchlists: DataFrame, postings: DataFrame) -> Column:
    """Conditions on seniority, flags and the score, of searches w and postings p."""
    ok = (F.col("p.new_grad_fit") >= F.coalesce("w.min_score", F.lit(0))) & (~F.coalesce("w.usa_only", F.lit(False)) | F.col("p.is_usa"))
    if "include_senior" in watchlists.columns:
        ok = ok & (F.coalesce("w.include_senior", F.lit(True)) | ~F.col("p.is_senior"))
    if "role_flags" in watchlists.columns:
        wanted = F.coalesce("w.role_flags", F.array().cast("array<string>"))
        for c, kind in postings.dtypes:
            if kind == "boolean":
                ok = ok & (~F.array_contains(wanted, c) | F.coalesce(F.col(f"p.{c}"), F.lit(False)))
    return ok


def _search(watchlists: DataFrame) -> Column:
    """All that a search asks for, as a key; its time in full."""
    return F.to_json(F.struct(*[F.unix_micros(F.col(c).cast("timestamp")).alias(c) if c == "since" else F.col(c) for c in watchlists.columns if c != "watch_id"]))


def _searches(watchlists: DataFrame) -> DataFrame:
    return watchlists.select("watch_id", _search(watchlists).alias("_search"))


def watchlist_counts(watchlists: DataFrame, postings: DataFrame) -> DataFrame:
    """Counted for different searches over classes of postings (see class_hits), so the work is not that of the hits."""
    n = class_hits(watchlists, postings).groupBy("_search").agg(F.sum("_n").alias("total"), F.sum(F.when(F.col("is_new"), F.col("_n"))).alias("new"))
    return _searches(watchlists).join(n, "_search", "left").select("watch_id", "total", "new").fillna(0, ["total", "new"])


def watchlist_delta(counts: DataFrame, last: DataFrame) -> DataFrame:
    return counts.join(last, "watch_id", "left").select("watch_id", "total", F.greatest(F.lit(0), F.col("total") - F.coalesce("last_count", F.lit(0))).cast("long").alias("delta"))


def watchlist_alerts(watchlists: DataFrame, postings: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(alerts with the newest hit, watchlists with the checkpoint moved)."""
    hits = class_hits(watchlists, postings).where("is_new").groupBy("_search").agg(F.sum("_n").alias("new"), F.max("_newest").alias("x"))
    alerts = _searches(watchlists).join(hits, "_search").select("watch_id", "new", F.format_string("%d new, latest: %s at %s", F.col("new"), F.col("x.title"), F.col("x.company")).alias("message"))
    return alerts, watchlists.withColumn("since", as_of)


def digest(df: DataFrame, as_of: Column) -> DataFrame:
    """(segment, place, id): six capped lists in one tagged pass."""
    fresh = F.col("first_seen") >= as_of - F.make_dt_interval(F.lit(7))
    kinds = (("apply_today", (F.col("new_grad_fit") >= 80) & ~F.col("is_senior"), 8), ("top_tier", F.col("priority") == "S", 8), ("matches", F.col("match_score") >= 50, 8), ("risk", F.col("eligibility_risk") == "high", 6), ("new_week", fresh, 8), ("entry", F.col("is_entry"), 8))
    tags = F.filter(F.array(*[F.struct(F.lit(k).alias("segment"), F.lit(m).alias("most"), c.alias("ok")) for k, c, m in kinds]), lambda x: x["ok"])
    rows = df.select("id", "match_score", "first_seen", F.explode(tags).alias("t")).select("id", "match_score", "first_seen", "t.segment", "t.most")
    w = W.partitionBy("segment").orderBy(F.desc("match_score"), F.desc("first_seen"), "id")
    return rows.withColumn("place", F.row_number().over(w)).where("place <= most").select("segment", "place", "id")


def posting_alerts(df: DataFrame, predicate: Column) -> DataFrame:
    return df.where(predicate).select("id", F.format_string("%s at %s (%d)", F.col("title"), F.col("company"), F.col("match_score")).alias("message"))

"""Profiles against postings: candidates by shared skills, scores as columns, top-k by window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Categories whose work is close to each other.
NEIGHBOURS = (("LARGE", "MEDIUM"), ("MEDIUM", "LARGE"), ("SMALL", "ECONOMY"), ("ECONOMY", "SMALL"))


def skills_score(matched: Column, wanted: Column) -> Column:
    """100 (half the share matched, half a count of eight); 45 where nothing is asked for."""
    m, n = F.size(matched), F.size(wanted)
    return F.when(n == 0, 45).otherwise(F.bround(100 * (0.5 * m / F.greatest(n, F.lit(1)) + 0.5 * F.least(F.lit(1.0), m / 8.0)), 0)).cast("int")


def projects_score(projects: Column, wanted: Column) -> tuple[Column, Column]:
    """(projects that use a wanted skill, 40/70/90/100 by their number); projects are (name, skills)."""
    hit = F.filter(projects, lambda p: F.arrays_overlap(p["skills"], wanted))
    n = F.size(hit)
    return F.transform(hit, lambda p: p["name"]), F.when(n == 0, 40).when(n == 1, 70).when(n == 2, 90).otherwise(100)


def domain_score(focus: Column, category: Column, neighbours=NEIGHBOURS) -> Column:
    near = F.lit(False)
    for a, b in neighbours:
        near = near | ((focus == a) & (category == b))
    return F.when(focus.isNull() | category.isNull(), 60).when(focus == category, 100).when(near, 85).when(focus == "General", 70).otherwise(55)


def no_skills() -> Column:
    return F.expr("cast(array() as array<string>)")


def no_projects() -> Column:
    return F.expr("cast(array() as array<struct<name: string, skills: array<string>>>)")


def _overlap(j: DataFrame, tools: tuple[str, ...]) -> DataFrame:
    """What skills, projects, focus and category give: of pairs that have a posting's `skills` and `role_category`, a profile's `own`, `projects` and `focus`, and `matched`."""
    names, project = projects_score(F.col("projects"), F.col("skills"))
    asked = F.array_intersect("skills", F.array(*[F.lit(t) for t in tools])) if tools else no_skills()
    tool = F.when(F.size(asked) == 0, 60).otherwise(F.bround(100 * F.size(F.array_intersect(asked, "own")) / F.greatest(F.size(asked), F.lit(1)), 0)).cast("int")
    j = j.withColumn("missing", F.array_except("skills", "own"))
    j = j.select("*", names.alias("backing"), skills_score(F.col("matched"), F.col("skills")).alias("skills_score"), project.alias("project_score"), domain_score(F.col("focus"), F.col("role_category")).alias("domain_score"), tool.alias("tool_score"))
    # scores are whole numbers, so weights in hundredths give exact halves
    j = j.withColumn("overlap_x100", 50 * F.col("skills_score") + 20 * F.col("project_score") + 20 * F.col("domain_score") + 10 * F.col("tool_score"))
    return j.withColumns({"overlap": F.bround(F.col("overlap_x100") / 100, 0).cast("int"), "backs": F.size("backing")})


def _fit(j: DataFrame) -> DataFrame:
    """The other scores, from `overlap`, `backs`, `years` and a posting's fits and risk."""
    j = j.withColumn("level_fit", F.when(F.col("years") < 3, F.col("new_grad_fit")).otherwise(F.col("experienced_fit")))
    j = j.withColumn("resume_match", F.bround((55 * F.col("overlap") + 45 * F.col("level_fit")) / 100, 0).cast("int"))
    penalty = F.when(F.col("eligibility_risk") == "high", 12).when(F.col("eligibility_risk") == "medium", 5).otherwise(0)
    j = j.withColumn("priority_x100", 55 * F.col("level_fit") + 45 * F.col("overlap") - 100 * penalty)
    return j.withColumn("apply_priority", F.when(F.col("priority_x100") >= 7200, "High").when(F.col("priority_x100") >= 5200, "Medium").otherwise("Low")).withColumn("defensibility", F.bround((55 * F.col("overlap") + 2250 * F.least("backs", F.lit(2))) / 100, 0).cast("int"))


def _scores(j: DataFrame, tools: tuple[str, ...]) -> DataFrame:
    """All scores of pairs that have a posting's columns, a profile's `own`, `projects`, `focus`, `years`, and `matched`."""
    return _fit(_overlap(j, tools))


def _owners(profiles: DataFrame) -> DataFrame:
    """Profiles with null lists as empty ones, and `_all`: their skills and those of their projects."""
    own, projects = F.coalesce("skills", no_skills()), F.coalesce("projects", no_projects())
    known = F.array_union(own, F.flatten(F.transform(projects, lambda p: F.coalesce(p["skills"], no_skills()))))
    return profiles.select("profile_id", own.alias("own"), projects.alias("projects"), "focus", "years", known.alias("_all"))


def _pairs(owners: DataFrame, postings: DataFrame, deal: tuple[str, ...], broadcast_rows: int) -> DataFrame:
    """Owners (from `_owners`) and postings that share a skill, with `matched`; of the skills that a pair shares only the first makes a row. Postings are dealt out by `deal` first, since the work is in the pairs and not in the bytes read."""
    small = owners.count() <= broadcast_rows
    p = owners.select("*", F.explode("_all").alias("_s"))
    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = postings.repartition(parts, *deal) if small else postings
    j = dealt.select("*", F.explode(F.array_distinct("skills")).alias("_s")).join(F.broadcast(p) if small else p, "_s")
    return j.where(F.get(F.array_intersect("skills", "_all"), F.lit(0)) == F.col("_s")).drop("_s", "_all").withColumn("matched", F.array_intersect("skills", "own"))


def match(profiles: DataFrame, postings: DataFrame, tools: tuple[str, ...] = (), broadcast_rows: int = 10_000) -> DataFrame:
    """A row per profile and posting that share a skill (the profile's own or one of its projects'), with all scores.

    Candidates are an equi-join on exploded skills, so nothing is made distinct or joined again. Profiles are broadcast only
    up to a counted number of rows.
    """
    return _scores(_pairs(_owners(profiles), postings, ("id",), broadcast_rows), tools)


#: What a score takes from a posting; the first two meet a profile, the others only its seniority.
SCORED = ("skills", "role_category", "new_grad_fit", "experienced_fit", "eligibility_risk")
MET = ("skills", "role_category")
#: What skills, projects, focus and category give to a pair.
PARTS = ("skills_score", "project_score", "domain_score", "tool_score", "overlap_x100", "overlap", "backs")


class _Meeting:
    """Kinds of profiles against kinds of postings.

    A pair's scores are those of its kinds, and there are far fewer kinds than rows: `kinds` are profiles alike in skills,
    projects' skills and focus (`_kind`), `groups` are postings alike in skills and category (`_group`). Kinds meet groups
    once, which gives PARTS; a posting's fits and risk then meet PARTS and the profile's seniority (`_new`) within its group.
    So the work grows with the kinds and not with the pairs of rows.
    """

    def __init__(self, profiles: DataFrame, classes: DataFrame, tools: tuple[str, ...], parts: tuple[str, ...], broadcast_rows: int):
        self.tools, self.parts, self.classes = tools, list(parts), classes
        p = _owners(profiles).withColumn("_new", F.coalesce(F.col("years") < 3, F.lit(False)))
        skills_only = F.transform("projects", lambda x: F.struct(F.lit("").alias("name"), x["skills"].alias("skills")))
        self.profiles = p.withColumn("_kind", F.to_json(F.struct("own", skills_only.alias("projects"), "focus")))
        self.people = self.profiles.groupBy("_kind", "focus", "_new").agg(F.count("*").alias("_p"))
        kinds = self.profiles.select("_kind", "own", skills_only.alias("projects"), "focus", "_all").distinct()
        self.groups = classes.select("_group", *MET).distinct()
        met = _overlap(_pairs(kinds, self.groups, ("_group",), broadcast_rows), tools)
        self.met = met.select("_kind", "focus", "_group", "missing", *self.parts)
        # each group as profiles of every focus and seniority meet it that share nothing with it
        foci = self.people.groupBy(F.col("focus").alias("_focus"), "_new").agg(F.sum("_p").alias("_w"))
        both = self.groups.withColumn("_new", F.explode(F.array(F.lit(True), F.lit(False))))
        bare = both.join(F.broadcast(foci) if foci.count() <= broadcast_rows else foci, "_new").withColumn("focus", F.col("_focus"))
        bare = _overlap(bare.withColumns({"own": no_skills(), "projects": no_projects(), "matched": no_skills()}), tools)
        self.bare = bare.select("_focus", "_new", "_w", "_group", "missing", *self.parts)

    def sharing(self) -> DataFrame:
        """A row for what each kind gives to a group that it shares a skill with (`_sign` 1), and one for what it would give without sharing (-1)."""
        out = self.people.drop("focus").join(self.met, "_kind")
        bare = self.bare.select("_focus", F.col("_new").alias("_as_new"), F.col("_group").alias("_g"), *[F.col(c).alias(f"_{c}") for c in ("missing", *self.parts)])
        out = out.join(bare, (F.col("_group") == F.col("_g")) & (F.col("_new") == F.col("_as_new")) & F.col("focus").eqNullSafe(F.col("_focus")))
        given = lambda sign, lead: F.struct(F.lit(sign).alias("_sign"), *[F.col(lead + c).alias(c) for c in ("missing", *self.parts)])
        return out.select("_kind", "_new", "_p", "_group", F.explode(F.array(given(1, ""), given(-1, "_"))).alias("x")).select("_kind", "_new", "_p", "_group", "x.*")

    def outlooks(self, *seen: DataFrame) -> DataFrame:
        """The classes of each group as new graduates and others score them, for all PARTS that are seen in the group."""
        parts = seen[0].select("_group", *self.parts)
        for more in seen[1:]:
            parts = parts.unionByName(more.select("_group", *self.parts))
        both = parts.distinct().withColumn("_new", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("years", F.when(F.col("_new"), 0.0).otherwise(3.0))
        return _fit(both.join(self.classes.drop(*MET), "_group"))


def _classes(postings: DataFrame, like: tuple[str, ...], *of: Column) -> DataFrame:
    """Postings alike in `like`, null skills being none, with their `_group`."""
    known = postings.withColumn("skills", F.coalesce("skills", no_skills()))
    return known.groupBy(*like).agg(*of).withColumn("_group", F.to_json(F.struct(*MET)))


def top_matches(profiles: DataFrame, postings: DataFrame, k: int = 5, tools: tuple[str, ...] = (), scored: tuple[str, ...] = SCORED, order: tuple[str, ...] = ("resume_match", "priority_x100"), broadcast_rows: int = 10_000) -> DataFrame:
    """The k best of all postings for each profile: by the columns of `order`, greatest first and nulls last, then least id.

    `order` names scores (which a shared skill never lowers) or columns of the postings. Postings alike in all that counts
    tie everywhere, so each such class stands with its k least ids. Kinds of profiles meet groups of classes (see _Meeting);
    of a group and of what a kind gives to it, the k best classes are enough, and of a kind the k best groups. Where
    nothing is shared the score depends on focus and seniority alone, and what shares nothing with a profile and is not
    among the k best of these is behind those k. Each profile takes the k postings of its kind. Null skills are none.
    """
    best = [F.col(c).desc_nulls_last() for c in order]
    like = (*scored, *[c for c in order if c in postings.columns and c not in scored])
    few = postings.select("id", *like).withColumn("skills", F.coalesce("skills", no_skills()))
    few = few.withColumn("_n", F.row_number().over(W.partitionBy(*like).orderBy("id"))).where(F.col("_n") <= k)
    classes = _classes(few, like, F.array_sort(F.collect_list(F.struct("_n", "id"))).alias("_ids")).withColumn("_least", F.get("_ids", F.lit(0))["id"])
    m = _Meeting(profiles, classes, tools, tuple(c for c in PARTS if c in (*order, "overlap", "backs")), broadcast_rows)
    first = lambda df, *keys, tie="_least": df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*best, tie))).where(F.col("_n") <= k)
    kept = ["_least", "_ids", *[c for c in dict.fromkeys((*order, *like)) if c not in MET]]

    def each_id(df: DataFrame, *keys: str) -> DataFrame:
        """The k best postings of the classes of each key."""
        return first(df.withColumn("id", F.explode("_ids.id")), *keys, tie="id")

    # of each group, by what is given to it: its k best classes in order, the best of them in front
    by = ["_group", "_new", *m.parts]
    ranked = first(m.outlooks(m.met).select(*by, *[c for c in kept if c not in by]), *by)
    lists = ranked.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_n", *[c for c in kept if c not in by]))).alias("_list"))
    own = m.people.select("_kind", "_new").join(m.met.drop("focus", "missing"), "_kind").join(lists, by).withColumn("_front", F.get("_list", F.lit(0)))
    own = first(own.select("_kind", *by, "_list", "_front._least", *[F.col(f"_front.{c}") for c in order if c not in by]), "_kind", "_new")
    own = own.select("_kind", *by, F.explode("_list").alias("_x")).select("_kind", *by, *[F.col(f"_x.{c}") for c in kept if c not in by])
    chosen = each_id(own, "_kind", "_new").select("_kind", "_new", "_group", "id", *kept[2:])
    # the k best where nothing is shared, for those that share nothing with them
    rest = _fit(m.bare.withColumn("years", F.when(F.col("_new"), 0.0).otherwise(3.0)).join(classes.drop(*MET), "_group"))
    rest = each_id(first(rest, "_focus", "_new"), "_focus", "_new").select("_focus", F.col("_new").alias("_as_new"), "_group", "id", *kept[2:])
    kinds = m.profiles.select("_kind", "_new", "focus", "_all").distinct()
    other = kinds.join(rest.join(m.groups, "_group"), F.col("focus").eqNullSafe(F.col("_focus")) & (F.col("_new") == F.col("_as_new")))
    other = other.where(F.size(F.array_intersect("skills", "_all")) == 0).select(*chosen.columns)
    placed = first(chosen.unionByName(other), "_kind", "_new", tie="id").withColumnRenamed("_n", "place").join(m.groups, "_group")
    top = m.profiles.drop("_all").join(placed.select("_kind", "_new", "id", *like, "place"), ["_kind", "_new"]).drop("_kind", "_new")
    return _scores(top.withColumn("matched", F.array_intersect("skills", "own")), tools)


def weighted_matches(profiles: DataFrame, postings: DataFrame, tools: tuple[str, ...] = (), scored: tuple[str, ...] = SCORED, broadcast_rows: int = 10_000) -> DataFrame:
    """(weight, resume_match, missing) whose weighted counts are those of all pairs of a profile and a posting.

    Groups of postings count for all profiles of a focus as if nothing were shared; kinds that share a skill with a group
    then count with what they give to it, against that. Profiles are added up by what they give and lack before the
    group's fits are met.
    """
    classes = _classes(postings, scored, F.count("*").alias("_c"))
    m = _Meeting(profiles, classes, tools, ("overlap", "backs"), broadcast_rows)
    by = ["_group", "_new", *m.parts, "missing"]
    pairs = m.sharing().withColumn("_w", F.col("_sign") * F.col("_p"))
    given = m.bare.select(*by, "_w").unionByName(pairs.select(*by, "_w")).groupBy(*by).agg(F.sum("_w").alias("_w")).where("_w <> 0")
    fits = m.outlooks(given).groupBy("_group", "_new", *m.parts, "resume_match").agg(F.sum("_c").alias("_c"))
    return given.join(fits, ["_group", "_new", *m.parts]).groupBy("resume_match", "missing").agg(F.sum(F.col("_w") * F.col("_c")).alias("weight")).select("weight", "resume_match", "missing")


def totals(profiles: DataFrame, postings: DataFrame, measures: dict[str, Column], tools: tuple[str, ...] = (), scored: tuple[str, ...] = SCORED, broadcast_rows: int = 10_000) -> DataFrame:
    """(profile_id, n, measures) over all pairs of a profile and a posting: n pairs, and the sum of each measure (a Column of scores).

    Each measure is summed over a group for all that is given to it. All groups are added up once for each focus and
    seniority as if nothing were shared; kinds that share a skill with a group then count with their own sums, against those.
    """
    m = _Meeting(profiles, _classes(postings, scored, F.count("*").alias("_c")), tools, PARTS, broadcast_rows)
    by = ["_group", "_new", *m.parts]
    sums = m.outlooks(m.met, m.bare).groupBy(*by).agg(F.sum("_c").cast("long").alias("_rows"), *[F.sum(F.col("_c") * v.cast("long")).cast("long").alias(f"_s_{c}") for c, v in measures.items()])
    base = m.bare.join(sums, by).groupBy("_focus", F.col("_new").alias("_as_new")).agg(F.sum("_rows").alias("n"), *[F.sum(f"_s_{c}").alias(f"_b_{c}") for c in measures])
    change = m.sharing().join(sums, by).groupBy("_kind", "_new").agg(*[F.sum(F.col("_sign") * F.col(f"_s_{c}")).alias(f"_d_{c}") for c in measures])
    out = m.profiles.join(base, F.col("focus").eqNullSafe(F.col("_focus")) & (F.col("_new") == F.col("_as_new"))).join(change, ["_kind", "_new"], "left")
    return out.select("profile_id", "n", *[(F.col(f"_b_{c}") + F.coalesce(f"_d_{c}", F.lit(0))).alias(c) for c in measures])


def backed(projects: Column, signals: Column, matched: Column, most: int = 4) -> Column:
    """(name, backs) of a profile's projects(name, skills, signals) that speak for a posting: its signals that they touch, then what they use of the first eight matched skills, six in all. The first `most` of them."""
    first = F.slice(matched, 1, 8)
    backs = lambda p: F.slice(F.array_union(F.array_intersect(signals, p["signals"]), F.array_intersect(first, p["skills"])), 1, 6)
    return F.slice(F.filter(F.transform(projects, lambda p: F.struct(p["name"].alias("name"), backs(p).alias("backs"))), lambda b: F.size(b["backs"]) > 0), 1, most)


def triage(missing: DataFrame, equivalences: DataFrame, strengths: DataFrame) -> DataFrame:
    """missing(profile_id, id, skill) -> tier: Safe to Add (a project shows it), Reword Only (an equal skill is known), Learn First (its area is known), Do Not Add.

    A profile's missing skills are judged once, not once for each posting, by equi-joins on (profile, skill): the equal
    and the near skills are exploded first, so nothing meets that is not named.
    """
    judged = _tiers(missing.select("profile_id", "skill").distinct(), equivalences, strengths)
    return missing.join(judged, ["profile_id", "skill"]).select("profile_id", "id", "skill", "tier")


def _tiers(wanted: DataFrame, equivalences: DataFrame, strengths: DataFrame) -> DataFrame:
    """(profile_id, skill, tier) of different (profile_id, skill)."""
    near = equivalences.select("skill", F.explode("equal").alias("_k"), F.lit(2).alias("_w")).unionByName(equivalences.select("skill", F.explode("area").alias("_k"), F.lit(1).alias("_w")))
    known = strengths.groupBy("profile_id", F.col("skill").alias("_k")).agg(F.max("in_project").alias("shown"))
    by = wanted.join(near, "skill").join(known, ["profile_id", "_k"]).groupBy("profile_id", "skill").agg(F.max("_w").alias("_w"))
    shown = known.where("shown").select("profile_id", F.col("_k").alias("skill"), F.lit(True).alias("_shown"))
    tier = F.when(F.col("_shown"), "Safe to Add").when(F.col("_w") == 2, "Reword Only").when(F.col("_w") == 1, "Learn First").otherwise("Do Not Add")
    return wanted.join(by, ["profile_id", "skill"], "left").join(shown, ["profile_id", "skill"], "left").select("profile_id", "skill", tier.alias("tier"))


def _chunks(df: DataFrame, key: str, of: str, size: int) -> DataFrame:
    """(key, _chunk, of): the values of each key in lists of about `size`, dealt by hash."""
    many = df.groupBy(key).agg(F.ceil(F.count("*") / size).alias("_many"))
    return df.join(many, key).groupBy(key, F.pmod(F.xxhash64(of), F.col("_many")).alias("_chunk")).agg(F.collect_list(F.struct(of)).alias(of))


def triage_matches(profiles: DataFrame, postings: DataFrame, equivalences: DataFrame, strengths: DataFrame, size: int = 1000, broadcast_rows: int = 10_000) -> DataFrame:
    """`triage` of what profiles lack in all postings that they share a skill with (see match).

    What a profile lacks is that of its kind and of the posting's skills, and its tiers are judged once for each profile and
    skill. Profiles of one kind and of one judgement, and postings of one set of skills, meet in lists of about `size`; the rows are
    written out of two lists in the task that has them, so nothing of the result's size is shuffled. Profiles and postings
    are read once: each is dealt out by all of its columns, and no use filters it, so that all take one and the same shuffle.
    """
    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    label = lambda *of: F.coalesce(F.to_json(F.struct(*of)), F.lit(""))
    p = _owners(profiles.where("profile_id is not null")).select("profile_id", "own", "_all").repartition(parts, "profile_id", "own", "_all").withColumn("_kind", label("own", "_all"))
    sets = postings.select("id", F.coalesce("skills", no_skills()).alias("skills")).repartition(parts, "id", "skills").withColumn("_set", label("skills"))
    kinds, asked = p.groupBy("_kind").agg(F.min("own").alias("own"), F.min("_all").alias("_all")), sets.groupBy("_set").agg(F.min("skills").alias("skills"))
    met = _pairs(kinds, asked, ("_set",), broadcast_rows)
    met = met.select("_kind", "_set", F.array_except("skills", "own").alias("missing")).where(F.size("missing") > 0)
    lacks = met.select("_kind", F.explode("missing").alias("skill")).distinct()
    judged = _tiers(p.join(lacks, "_kind").select("profile_id", "skill").distinct(), equivalences, strengths)
    said = p.join(judged.groupBy("profile_id").agg(F.array_sort(F.collect_list(F.struct("skill", "tier"))).alias("_tiers")), "profile_id")
    said = said.withColumn("_who", label("_kind", "_tiers"))
    rows = met.join(said.select("_kind", "_who", "_tiers").distinct(), "_kind")
    rows = rows.select("_who", "_set", F.filter("_tiers", lambda t: F.array_contains("missing", t["skill"])).alias("_rows"))
    lists = rows.join(_chunks(said.select("_who", "profile_id"), "_who", "profile_id", size).withColumnRenamed("_chunk", "_a"), "_who")
    ids = _chunks(sets.select("_set", "id"), "_set", "id", size).select("_set", F.col("_chunk").alias("_b"), F.transform("id", lambda x: x["id"]).alias("id"))
    dealt = lists.join(ids, "_set").repartition(4 * parts, "_who", "_set", "_a", "_b")
    # generated code gathers all that one input row gives before it hands rows on; explodes side by side are one such code, and
    # would gather every pair of two lists. A function over arrays is not part of it, so one profile's list is gathered at a time
    said_of = dealt.select("profile_id", "id", F.explode("_rows").alias("x")).select("profile_id", "id", "x.skill", "x.tier")
    one = said_of.select(F.explode(F.transform("profile_id", lambda x: x["profile_id"])).alias("profile_id"), "id", "skill", "tier")
    return one.select("profile_id", F.explode("id").alias("id"), "skill", "tier")


def triage_all(profiles: DataFrame, postings: DataFrame, equivalences: DataFrame, strengths: DataFrame) -> DataFrame:
    """(profile_id, skill, n, tier) of every skill that a profile lacks: in how many of all postings it is asked for, and its tier.

    A skill that a profile lacks is lacking in each posting with it, so postings are counted by skill, and the few
    skills meet the profiles by equi-joins alone: with each a list of what it lacks.
    """
    asked = postings.select("id", F.explode(F.array_distinct("skills")).alias("skill")).groupBy("skill").agg(F.count("*").alias("n"))
    # the vocabulary in pieces, each with a number that every profile takes in turn
    parts = asked.groupBy(F.pmod(F.xxhash64("skill"), F.lit(64)).alias("_part")).agg(F.collect_list(F.struct("skill", "n")).alias("_asked"))
    own = profiles.select("profile_id", F.coalesce("skills", no_skills()).alias("own"), F.explode(F.sequence(F.lit(0), F.lit(63)).cast("array<bigint>")).alias("_part"))
    lacks = own.join(parts, "_part").select("profile_id", F.explode(F.filter("_asked", lambda a: ~F.array_contains("own", a["skill"]))).alias("a"))
    missing = lacks.select("profile_id", F.col("a.n").alias("id"), F.col("a.skill").alias("skill"))
    return triage(missing, equivalences, strengths).select("profile_id", "skill", F.col("id").alias("n"), "tier")


def why(m: DataFrame) -> DataFrame:
    lines = F.array_compact(F.array(F.when(F.size("matched") > 0, F.concat(F.lit("Shares "), F.array_join(F.slice("matched", 1, 4), ", "))), F.when(F.size("backing") > 0, F.concat(F.lit("Backed by "), F.array_join(F.slice("backing", 1, 2), ", "))), F.when(F.col("domain_score") >= 85, F.lit("Close to your field")), F.when(F.col("level_fit") >= 75, F.lit("Fits your level"))))
    return m.withColumn("why", lines)


def recommended_profile(category: Column, labels: dict[str, str], other: str = "General") -> Column:
    out = F.lit(other)
    for k, v in labels.items():
        out = F.when(category == k, v).otherwise(out)
    return out


def missing_keywords(missing: Column, keywords: Column, most: int = 6) -> Column:
    return F.when(F.size(missing) > 0, F.slice(missing, 1, most)).otherwise(F.slice(keywords, 1, most))

import datetime as dt
import random

from pyspark.sql import functions as F

import __spark_entry__
from loomwork.functions import classify, identity, places, text
from loomwork.operators import lifecycle, matching
from loomwork.plans import registry
from loomwork.sources import html


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_clean_html_decodes_before_stripping(spark):
    assert one(spark, text.clean_html(F.lit("&lt;b&gt;a&lt;/b&gt;  b&amp;c"))) == "a b&c"
    assert one(spark, text.clean_html(F.lit(None).cast("string"))) == ""
    assert one(spark, text.cut_words(F.lit("one two three"), 8)) == "one two…"


def test_titles_and_years(spark):
    assert one(spark, text.normalize_title(F.lit("  Senior  Engineer - Remote"))) == "senior engineer"
    assert tuple(one(spark, text.years_required(F.lit("3 - 5 years")))) == (3, 5)
    assert tuple(one(spark, text.years_required(F.lit("7+ years")))) == (7, None)


def test_tracking_goes_and_the_rest_stays(spark):
    got = one(spark, identity.strip_tracking(F.lit("https://a.org/x?utm_source=f&q=a+b&REF=1#top")))
    assert (got.url, got.removed) == ("https://a.org/x?q=a+b#top", 2)


def test_places(spark):
    for loc, usa, state in (("Austin, TX", True, "TX"), ("Toronto, Canada", False, None), ("Tijuana, Baja California", False, None), ("", False, None)):
        got = one(spark, places.parse_location(F.lit(loc), F.lit("")))
        assert (got.is_usa, got.state) == (usa, state), loc


def test_merging_a_shard_twice_is_merging_it_once(spark):
    old = spark.createDataFrame([("a", "X"), ("b", "Y")], "key string, company string")
    shard = spark.createDataFrame([("c", "X", 1)], "key string, company string, seq int")
    once = lifecycle.merge_shards(old, shard)
    assert sorted(map(tuple, lifecycle.merge_shards(once, shard).collect())) == sorted(map(tuple, once.collect())) == [("b", "Y"), ("c", "X")]


def test_removal_needs_a_company_that_ran(spark):
    now = F.lit(dt.datetime(2024, 1, 1))
    old = spark.createDataFrame([("a", "X", "active", 1, None), ("b", "Y", "active", 1, None), ("c", "X", "active", 0, None)], "key string, company string, status string, missed int, removed_at timestamp")
    seen = spark.createDataFrame([("z", "X")], "key string, company string")
    got = {r.key: (r.status, r.missed) for r in lifecycle.reconcile_removals(old, seen, now).collect()}
    assert got == {"a": ("removed", 2), "b": ("active", 1), "c": ("possibly_removed", 1)}


def test_plans_have_no_cartesian_and_prune_columns(spark):
    plan = registry.QUERIES["g04_company_tallies"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "text" not in plan.split("Physical Plan")[-1].split("ReadSchema")[1][:120]


def test_the_lens_has_no_nested_loops(spark):
    for name in ("e15_keyword", "f03_group_roles", "h11_top_matches"):
        assert "NestedLoop" not in registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString(), name


def test_only_the_first_shared_skill_makes_a_pair(spark):
    profiles = spark.createDataFrame([(1, ["a", "b"], [("p", ["a"])], "LARGE", 1.0), (2, [], [], None, 1.0)], "profile_id long, skills array<string>, projects array<struct<name:string,skills:array<string>>>, focus string, years double")
    postings = spark.createDataFrame([(i, s, "LARGE", 50, 50, "low") for i, s in ((1, ["b", "a", "c"]), (2, ["c"]), (3, ["b", "a", "c"]), (4, []))], "id long, skills array<string>, role_category string, new_grad_fit int, experienced_fit int, eligibility_risk string")
    assert sorted((r.profile_id, r.id, tuple(r.matched), tuple(r.missing)) for r in matching.match(profiles, postings).collect()) == [(1, 1, ("b", "a"), ("c",)), (1, 3, ("b", "a"), ("c",))]
    # nothing is asked for in posting 4, which is worth more than a skill that is missing
    assert sorted((r.profile_id, r.id, r.place) for r in matching.top_matches(profiles, postings, 1).collect()) == [(1, 1, 1), (2, 4, 1)]


def test_matches_without_all_pairs_equal_all_pairs(spark):
    rng = random.Random(5)

    def some(most, odd=0.1):
        return None if rng.random() < odd else rng.sample("abcdef", rng.randint(0, most))

    field = ["LARGE", "MEDIUM", "SMALL", "General", None]
    people = [(i, some(3), None if i == 3 else [(n, some(2)) for n in "pq"[: rng.randint(0, 2)]], rng.choice(field), rng.choice([1.0, 5.0, None])) for i in range(25)]
    jobs = [(i, some(4), rng.choice(field), rng.choice([0, 40, 100, None]), rng.choice([0, 70, 100]), rng.choice(["high", "medium", "low", None]), rng.choice([1, 2, None])) for i in range(150)]
    profiles = spark.createDataFrame(people, "profile_id long, skills array<string>, projects array<struct<name:string,skills:array<string>>>, focus string, years double")
    postings = spark.createDataFrame(jobs, "id long, skills array<string>, role_category string, new_grad_fit int, experienced_fit int, eligibility_risk string, match_score int")
    owners, wanted = matching._owners(profiles), postings.withColumn("skills", F.coalesce("skills", matching.no_skills()))
    pairs = matching._scores(wanted.crossJoin(owners).withColumn("matched", F.array_intersect("skills", "own")), ("a", "b")).cache()
    least = -(10**9)
    for k, order in ((1, ("resume_match", "priority_x100")), (4, ("resume_match", "priority_x100")), (3, ("priority_x100", "match_score"))):
        by: dict[int, list] = {}
        for r in pairs.select("profile_id", "id", *order).collect():
            by.setdefault(r.profile_id, []).append((*[-(least if r[c] is None else r[c]) for c in order], r.id))
        want = sorted((p, x[-1], n) for p, rows in by.items() for n, x in enumerate(sorted(rows)[:k], 1))
        got = sorted((r.profile_id, r.id, r.place) for r in matching.top_matches(profiles, postings, k, ("a", "b"), order=order).collect())
        assert got == want, order
    want = pairs.where("resume_match >= 45").select(F.explode("missing").alias("s")).groupBy("s").count().collect()
    got = matching.weighted_matches(profiles, postings, ("a", "b")).where("resume_match >= 45").select("weight", F.explode("missing").alias("s")).groupBy("s").agg(F.sum("weight").alias("n")).where("n > 0").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert matching.top_matches(profiles.limit(0), postings).count() == matching.top_matches(profiles, postings.limit(0)).count() == 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.ORACLES) <= set(__spark_entry__.queries())


def test_foreign_places(spark):
    for loc, code in (("CAN - Burlington, ON", "CAN"), ("Burlington, on ", "CAN"), ("MEX-Aguascalientes", "MEX"), ("San Jose, CA", ""), ("XYZ - Town", ""), (None, "")):
        assert one(spark, places.foreign_code(F.lit(loc))) == code, loc
    got = one(spark, places.parse_location(F.lit("CAN - Burlington, ON"), F.lit("")))
    assert (got.is_usa, got.country) == (False, "CAN")
    assert one(spark, places.mask_false_friends(F.lit("Mexicali, BAJA California Sur, X"))) == "Mexicali,  mexico , X"


def test_experience_levels(spark):
    for title, body, want in (("Engineering Intern", "new grad", "Unknown"), ("Engineer", "recent graduate", "New Grad"), ("Engineer", "0 to 2 years", "0-3 Years"), ("Engineer I", None, "Entry Level"), ("Engineer III", "", "Senior"), ("Engineer", "10+ years", "Mid Level"), (None, None, "Unknown")):
        assert one(spark, classify.experience_level(F.lit(title), F.lit(body))) == want, title


def test_header_fields_and_rows(spark):
    page = '<dt class="JobHeaderField">City</dt> <dd class="JobHeaderData"><b>Erie</b></dd><dt class="JobHeaderField">State</dt><dd class="JobHeaderData">PA</dd>'
    assert one(spark, places.header_location(html.header_fields(F.lit(page)))) == "Erie, PA, United States"
    table = '<tr class="data-row"><a class="jobTitle-link" href="/job/x/7/">R&amp;D</a><span class="jobLocation"> ERIE, PA, US, 16501 </span><span class="jobDate">1/31/2024</span></tr>'
    rows = html.table_rows(spark.createDataFrame([(1, table + table + '<tr class="data-row">none</tr>', "https://h")], "page_id long, html string, base string"), "html", "base").collect()
    assert [(r.job_id, r.job_title, r.apply_url, r.location, r.posted_date) for r in rows] == [("7", "R&D", "https://h/job/x/7/", "Erie, PA, United States", dt.datetime(2024, 1, 31))]


def test_a_run_without_success_is_not_published(spark):
    rows = spark.createDataFrame([("a", 1, True), ("b", 1, False), ("a", 2, False)], "company string, run int, ok boolean")
    assert {r.run: (r.planned, r.succeeded, r.publish) for r in lifecycle.publishable(rows).collect()} == {1: (2, 1, True), 2: (1, 0, False)}


def test_term_hits_are_whole_words_in_list_order(spark):
    terms = ("load flow", "rf", "c++", "plc", " grid ")
    for body, want in (("PLC and RF: load flow", ["load flow", "rf", "plc"]), ("surf grids, load  flow", []), ("c++/grid", ["c++", " grid "]), ("", []), (None, [])):
        assert one(spark, classify.term_hits(F.lit(body).cast("string"), terms)) == want, body
    assert one(spark, classify.term_hits(F.lit("plc rf plc"), ("rf", "plc"))) == ["rf", "plc"]


def test_work_mode_reads_the_whole_body(spark):
    late = "x" * 5000
    for place, body, want in (("Erie, PA", late + " Hybrid", "Hybrid"), ("", late + " remote", "Remote"), ("", "remote " + late + " hybrid", "Hybrid"), ("Erie, PA", late, "Onsite"), ("", None, "Unknown")):
        assert one(spark, text.remote_status(F.lit(place), F.lit(body).cast("string"))) == want, (place, want)


def test_a_stream_of_observations_folds_into_the_published_table(spark, tmp_path):
    """Two landed batches: seen rows are active, unseen ones of a company that ran move towards removal, others stay."""
    from loomwork.streaming import ingest

    at = lambda day: dt.datetime(2024, 1, day)
    schema = "key string, company string, last_seen timestamp"
    table = [spark.createDataFrame([("a", "X", at(1), "active", 1, None), ("b", "X", at(1), "active", 0, None), ("c", "Y", at(1), "active", 0, None)], schema + ", status string, missed int, removed_at timestamp")]
    epochs = []

    def publish(df, epoch):
        out = f"{tmp_path}/v{len(epochs)}"
        df.write.parquet(out)
        epochs.append(epoch)
        table[0] = spark.read.parquet(out)

    for n, rows in enumerate(([("b", "X", at(2)), ("d", "X", at(2))], [("a", "X", at(3)), ("a", "X", at(3))]), 1):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/landing")
        ingest.run(spark, f"{tmp_path}/landing", schema, lambda: table[0], publish, f"{tmp_path}/checkpoint").awaitTermination()
        got = {r.key: (r.status, r.missed) for r in table[0].collect()}
        if n == 1:
            assert got == {"a": ("removed", 2), "b": ("active", 0), "c": ("active", 0), "d": ("active", 0)}
    assert got == {"a": ("active", 0), "b": ("possibly_removed", 1), "c": ("active", 0), "d": ("possibly_removed", 1)} and len(epochs) == 2


def test_profiles_and_titles_of_null_texts_are_empty(spark):
    from loomwork.functions import skills, titles

    none = F.lit(None).cast("string")
    p = one(spark, skills.parse_profile(none))
    assert (p.name, p.degree, p.field, p.grad_date, p.years, p.projects, p.skills.all_skills, p.role_focus) == ("", "", "", "", 0.0, [], [], skills.GENERAL)
    v = one(spark, titles.verdict(none, none))
    assert (v.relevant, v.category, v.reason, v.needs_description) == (False, "Out of Scope", "no title", False)
    assert one(spark, skills.extract_skills(none)) == []


def test_names_find_fallback_urls_whole_then_first_word_then_anywhere(spark):
    from loomwork.operators import lookups

    table = spark.createDataFrame([(1, "Acme", "a"), (2, "silicon", "s"), (3, "con", "c"), (4, "Acme Power", "p")], "ord long, name string, url string")
    names = spark.createDataFrame([(n,) for n in ("ACME power", "Acme Tools", "Big Silicon", "Falcon", "Nobody", "", None)], "company string")
    assert {r.company: r.fallback_url for r in lookups.fallback_url(names, table).collect()} == {"ACME power": "p", "Acme Tools": "a", "Big Silicon": "s", "Falcon": "c", "Nobody": "", "": "", None: ""}


def test_rare_matches_of_similar_postings(spark):
    """Against all pairs: ties, hot companies, postings alike in all but the id, and postings without skills."""
    import random

    from loomwork.operators import ranking

    r = random.Random(3)
    rows = [(i, r.choice("AAAAAAB"), r.choice(["t1", "t2", "t3"]), r.choice(["x", "y", "Unknown"]), r.choice(["e", None]), r.random() < 0.3, r.choice("SA"), r.choice([[], ["p"], ["p", "q"], None]), r.randrange(3)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, company string, title string, role_category string, level string, is_senior boolean, priority string, skills array<string>, new_grad_fit int")
    want = {}
    for a in rows:
        scored = []
        for b in rows:
            if a[0] != b[0] and (a[3] == b[3] or a[1] == b[1]):
                s = 4 * (a[3] == b[3] != "Unknown") + 2 * (a[4] == b[4]) + (a[5] == b[5]) + (a[6] == b[6]) + len({*(a[7] or ())} & {*(b[7] or ())}) + (a[1] != b[1])
                scored.append((-s, -b[8], b[0], b[1], b[2]))
        best, seen = [], set()
        for s, _, other, c, t in sorted(scored):
            if (c, t) not in seen:
                seen.add((c, t))
                best.append((other, -s))
        want[a[0]] = best[:6]
    got = {}
    for x in ranking.similar(df).orderBy("id", "n").collect():
        got.setdefault(x.id, []).append((x.other, x.score))
    assert got == want


def test_page_labels_and_ends_leave_a_location(spark):
    for given, want in (("placeMountain View", "Mountain View"), ("Location: Austin", "Austin"), ("Placentia, CA", "Placentia, CA"), ("place", ""), (None, "")):
        assert one(spark, places.unlabelled_location(F.lit(given).cast("string"))) == want, given
    assert one(spark, places.trimmed_location(F.lit(" <b>Oslo</b> , "))) == "Oslo"
    assert one(spark, places.trimmed_location(F.lit(None).cast("string"))) == ""

"""Phrases, published versions, audits that can fail, and sums over all pairs: against plain loops and made failures."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from loomwork.functions import classify, phrases, skills, titles
from loomwork.operators import audits, filters, matching
from loomwork.sources import corpus
from loomwork.streaming import ingest


def values(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", column.alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.i)]


def test_phrases_are_met_as_a_plain_loop_meets_them(spark):
    rng = random.Random(7)
    words = ["arc", "flash", "c", "++", "#", "&", "i", "élan", "p", "load", "flow", "3", "/", "-", ",", "Flow"]
    table = ["arc flash", "c++", "c#", "i&c", "load-flow", "flow", "élan", "p & i", "^ arc", "flow $", "3"]
    texts = [None, "", "  ", *[" ".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(150)]]
    cut = [phrases.cut(p) for p in table]

    def plain(text):
        w = ["^", *re.findall(phrases.WORDS_PY, (text or "").lower()), "$"]
        return sorted((" ".join(w[i : i + n]), i, n) for i in range(len(w)) for n in (1, 2, 3) if i + n <= len(w) and " ".join(w[i : i + n]) in cut)

    got = values(spark, texts, phrases.hits(phrases.words_of(F.col("text")), cut))
    assert [sorted((h.p, h.at, h.n) for h in g) for g in got] == [plain(t) for t in texts]


def test_conditions_of_phrases(spark):
    vocabulary = (phrases.When(("line",), after=("power",), unless_before=("sky",)), phrases.When(("c",), unless_next=("++", "#")), phrases.When(("grid",), before=("smart",)), "relay")
    cases = [("line of power", True), ("power line", False), ("sky line power", False), ("c", True), ("c++", False), ("c and c#", True), ("smart new grid", True), ("grid smart", False), ("a Relay!", True), ("relays", False), (None, False)]
    these = phrases.plain(vocabulary)
    x = classify.once(phrases.words_of(F.col("text")), lambda w: F.struct(w.alias("words"), phrases.hits(w, these).alias("hits")))
    assert values(spark, [c[0] for c in cases], classify.once(x, lambda s: phrases.met(s, vocabulary))) == [c[1] for c in cases]


def test_choices_of_words():
    assert phrases.each("a/b c/", "d") == ("a c", "a", "b c", "b", "d")


def test_transmission_and_interconnection_by_what_follows(spark):
    cases = [("Transmission Engineer", titles.POWER), ("Transmission Gear Engineer", None), ("Transmission Engineer, Wireless", titles.RADIO), ("Interconnection Engineer", titles.POWER), ("Interconnection Engineer, Data", None), ("Data Transmission Engineer", titles.POWER), ("Nuclear Electrical Engineer", titles.POWER), ("Nuclear Engineer", None)]
    assert values(spark, [c[0] for c in cases], titles.title_category(F.col("text"))) == [c[1] for c in cases]


def test_dictionary_holds_over_two_hundred_skills_and_reads_a_text_once(spark):
    assert sum(map(len, skills.FAMILIES.values())) > 200
    plan = spark.range(1).select(skills.extract_skills(F.lit("etap").alias("t")).alias("s"))
    assert plan.first().s == ["ETAP"]
    # every name is met by its own first phrase
    firsts = [(k, next(iter(v))) for d in skills.FAMILIES.values() for k, v in d.items() if isinstance(next(iter(v)), str)]
    got = values(spark, [p for _, p in firsts], skills.extract_skills(F.col("text")))
    assert all(k in g for (k, _), g in zip(firsts, got, strict=True))


def audit_rows(spark):
    at = dt.datetime(2024, 1, 30)
    rows = [(i, "Engineer", "Entry Level" if i % 2 else "Senior", i % 2 == 0, i % 3 == 0, 0.9, at, 70 + i, "CA", "Remote", "Power", "Acme") for i in range(12)]
    df = spark.createDataFrame(rows, "id int, title string, experience_level string, is_senior boolean, is_usa boolean, confidence double, first_seen timestamp, new_grad_fit int, state string, remote_status string, role_category string, company string")
    none = {c: F.lit("") for c in ("norm_title", "location", "platform", "body", "full_text", "snippet")}
    return df.withColumns({**none, "keywords": F.expr("cast(array() as array<string>)"), "is_entry": ~F.col("is_senior"), "posted_date": F.lit(None).cast("timestamp"), "priority": F.lit("S")})


@pytest.mark.parametrize("broken", [None, "include_senior", "min_score", "posted_within_hours", "level_filter", "usa_only"])
def test_the_audit_of_filters_finds_a_broken_one(spark, monkeypatch, broken):
    import dataclasses

    if broken:
        real = filters.predicate
        void = {"include_senior": True, "min_score": None, "posted_within_hours": None, "level_filter": None, "usa_only": False}[broken]
        monkeypatch.setattr(audits, "predicate", lambda f, *a: real(dataclasses.replace(f, **{broken: void}), *a))
    got = {r.check: r.ok for r in audits.audit_filters(audit_rows(spark), F.expr("TIMESTAMP '2024-06-30'"), state="CA", role="power", company="Acme").collect()}
    assert all(got.values()) == (broken is None), got


def test_a_version_is_read_whole_or_not_at_all(spark, tmp_path):
    path, schema = f"file://{tmp_path}", {"a": "x int", "b": "x int", "c": "x int"}
    assert all(t.count() == 0 for t in corpus.read_published(spark, path, schema).values())
    one, two = spark.range(1).selectExpr("cast(id as int) as x"), spark.range(2).selectExpr("cast(id as int) as x")
    assert corpus.publish(spark, path, {"a": one, "b": one}) == 0
    old = corpus.read_published(spark, path, schema)
    with pytest.raises(Exception, match="made to fail"):  # between two writes
        corpus.publish(spark, path, {"a": two, "b": two.select(F.raise_error(F.lit("made to fail")).cast("int").alias("x"))})
    assert [t.count() for t in corpus.read_published(spark, path, schema).values()] == [1, 1, 0]
    assert corpus.publish(spark, path, {"a": two, "b": two}) == 1 and corpus.publish(spark, path, {"a": one}, version=1) == 1
    assert [t.count() for t in corpus.read_published(spark, path, schema).values()] == [2, 2, 0] and old["a"].count() == 1
    assert corpus.read_published(spark, path, schema, version=0)["a"].count() == 1 and corpus.versions(spark, path) == [0, 1]


def test_another_schema_is_refused(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}"
    corpus.publish(spark, path, {"a": spark.range(1)})
    monkeypatch.setattr(corpus, "SCHEMA_VERSION", 2)
    with pytest.raises(ValueError, match="schema 1"):
        corpus.read_published(spark, path, {"a": "id long"})


def test_an_epoch_that_comes_again_changes_nothing(spark, tmp_path):
    path, at = f"file://{tmp_path}", dt.datetime(2024, 1, 2)
    corpus.publish(spark, path, {"stored": spark.createDataFrame([("a", "X", at, "active", 1, None)], ingest.STORED)}, version=0)
    batch = spark.createDataFrame([("b", "X", at)], "key string, company string, last_seen timestamp")
    for _ in range(2):
        ingest.fold_epoch(spark, batch, 0, path)
        got = {r.key: (r.status, r.missed) for r in corpus.read_published(spark, path, {"stored": ingest.STORED})["stored"].collect()}
        assert got == {"a": ("removed", 2), "b": ("active", 0)} and corpus.versions(spark, path) == [0, 1]
    ingest.fold_epoch(spark, batch.limit(0), 1, path)
    assert corpus.read_published(spark, path, {"stored": ingest.STORED})["stored"].count() == 2


def test_totals_are_those_of_all_pairs(spark):
    rng = random.Random(6)
    names = list("abcdef")
    people = [(i, rng.sample(names, rng.randint(0, 3)) if i else None, [("p", rng.sample(names, 1))] if i % 2 else None, rng.choice(["LARGE", "General", None]), rng.choice([1.0, 5.0, None])) for i in range(9)]
    posts = [(i, rng.sample(names, rng.randint(0, 4)) if i else None, rng.choice(["LARGE", "SMALL"]), rng.randint(0, 100), rng.randint(0, 100), rng.choice(["high", "low"])) for i in range(40)]
    p = spark.createDataFrame(people, "profile_id int, skills array<string>, projects array<struct<name:string,skills:array<string>>>, focus string, years double")
    q = spark.createDataFrame(posts, "id int, skills array<string>, role_category string, new_grad_fit int, experienced_fit int, eligibility_risk string")
    measures = {"m": F.col("resume_match"), "d": F.col("defensibility")}
    got = {r.profile_id: (r.n, r.m, r.d) for r in matching.totals(p, q, measures, tools=("a", "b")).collect()}
    full = matching._owners(p).crossJoin(q.withColumn("skills", F.coalesce("skills", matching.no_skills()))).withColumn("matched", F.array_intersect("skills", "own"))
    want = {r.profile_id: (r.n, r.m, r.d) for r in matching._scores(full, ("a", "b")).groupBy("profile_id").agg(F.count("*").alias("n"), F.sum("resume_match").alias("m"), F.sum("defensibility").alias("d")).collect()}
    assert got == want and matching.totals(p.limit(0), q, measures).count() == 0


def test_kinds_of_profiles_meet_kinds_of_postings(spark):
    """Profiles and postings that differ only in ids, names of projects and fits make one pair of kinds, however many they are."""
    p = spark.range(200).selectExpr("id as profile_id", "array('a', 'b') as skills", "array(struct(cast(id as string) as name, array('a') as skills)) as projects", "'LARGE' as focus", "cast(id % 6 as double) as years")
    q = spark.range(300).selectExpr("id", "array('a', 'c') as skills", "'LARGE' as role_category", "cast(id % 50 as int) as new_grad_fit", "cast(50 - id % 50 as int) as experienced_fit", "'low' as eligibility_risk")
    m = matching._Meeting(p, matching._classes(q, matching.SCORED, F.count("*").alias("_c")), (), matching.PARTS, 10)
    assert m.met.count() == 1 and m.outlooks(m.met).count() == 2 * 50
    best = {r.profile_id: (r.id, r.backing, r.place) for r in matching.top_matches(p, q, 1).collect()}
    assert best == {i: (49 if i % 6 < 3 else 0, [str(i)], 1) for i in range(200)}


def test_own_texts_of_postings_leave_posed_cases_alone(spark, monkeypatch):
    """Whatever a posting's own text says, a case posed on it has its written result."""
    import duckdb

    from loomwork.plans import registry, rules_q

    home = "/root/testdata/sf0.001"
    said = F.lit("BESS, hfss lora; Senior power relay engineer, 12+ years, 4 - 9 years, c++ sql")
    own = rules_q.lens(spark, home).withColumn("body", said)
    monkeypatch.setattr(rules_q, "lens", lambda spark, d: own)
    with duckdb.connect() as c:
        for t in ("documents", "supplier", "part", "nation", "region", "events"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{home}/{t}.parquet'")
        for name in ("c23_extract_skills", "c14_candidate_friendly", "c12_seniority"):
            want = sorted(c.execute(registry.ORACLES[name]).fetchall())
            assert sorted(map(tuple, registry.QUERIES[name](spark, home).collect())) == want, name


def test_triage_of_lists_is_that_of_pairs(spark):
    rng = random.Random(9)
    some = lambda n: rng.sample("abcde", rng.randint(0, n)) if rng.random() < 0.9 else None
    p = spark.createDataFrame([(i, some(3), [("x", some(1))] if i % 3 else None, "LARGE", 1.0) for i in range(30)], "profile_id int, skills array<string>, projects array<struct<name:string,skills:array<string>>>, focus string, years double")
    q = spark.createDataFrame([(i, some(4), "LARGE", 1, 1, "low") for i in range(90)], "id int, skills array<string>, role_category string, new_grad_fit int, experienced_fit int, eligibility_risk string")
    same = spark.createDataFrame([("a", ["b"], ["c", "d"]), ("e", [], ["a"])], "skill string, equal array<string>, area array<string>")
    known = p.select("profile_id", F.explode("skills").alias("skill"), F.lit(False).alias("in_project")).unionByName(p.where("profile_id % 4 = 0").select("profile_id", F.lit("c").alias("skill"), F.lit(True).alias("in_project")))
    want = matching.triage(matching.match(p, q).select("profile_id", "id", F.explode("missing").alias("skill")), same, known)
    got = matching.triage_matches(p, q, same, known, size=7)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode(_rows") < plan.index("Exchange")  # written out after the last shuffle
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 1000


def test_triage_reads_its_tables_once_and_gathers_one_list_at_a_time(spark):
    rng, read = random.Random(4), {k: spark.sparkContext.accumulator(0) for k in ("profiles", "postings")}

    def counted(which):
        def f(x):
            read[which].add(1)
            return x

        return F.udf(f, "array<string>")

    some = lambda n: rng.sample("abcde", rng.randint(0, n)) if rng.random() < 0.9 else None
    p = spark.createDataFrame([(i if i else None, some(3), None, "LARGE", 1.0) for i in range(20)], "profile_id int, skills array<string>, projects array<struct<name:string,skills:array<string>>>, focus string, years double")
    q = spark.createDataFrame([(i % 40 or None, some(4), "LARGE", 1, 1, "low") for i in range(60)], "id int, skills array<string>, role_category string, new_grad_fit int, experienced_fit int, eligibility_risk string")
    same = spark.createDataFrame([("a", ["b"], ["c", "d"])], "skill string, equal array<string>, area array<string>")
    known = p.select("profile_id", F.explode("skills").alias("skill"), F.lit(False).alias("in_project")).localCheckpoint()
    want = matching.triage(matching.match(p, q).select("profile_id", "id", F.explode("missing").alias("skill")), same, known)
    got = matching.triage_matches(p.withColumn("skills", counted("profiles")("skills")), q.withColumn("skills", counted("postings")("skills")), same, known, size=7)
    key = lambda r: tuple((x is not None, x) for x in r)
    read["profiles"].value = read["postings"].value = 0
    rows = got.collect()
    assert sorted(map(tuple, rows), key=key) == sorted(map(tuple, want.collect()), key=key) and any(r.id is None for r in rows)
    assert read["postings"].value == q.count()
    # profiles of a counted number are read once more to count their kinds, when the plan is made
    assert read["profiles"].value == p.where("profile_id is not null").count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = matching.triage_matches(p, q, same, known, size=7)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    code = {name: star for star, name in re.findall(r"(\*\(\d+\) )?Generate explode\((?:transform\()?(profile_id|id)#", plan)}
    assert len(code) == 2 and code["id"] != code["profile_id"]  # else all rows of a pair of lists are held before the first goes on


def test_a_hundred_thousand_searches_meet_postings_without_a_nested_loop(spark):
    from loomwork.operators import alerts

    rng = random.Random(8)
    pick = lambda *xs: rng.choice(xs)
    at = dt.datetime(2024, 1, 1)
    posts = [(i, pick("Grid Engineer", "Relay engineer", None, "ab"), pick("Acme", "Beta Co", None), pick("Power", "RF", None), pick("CA", "NY"), pick("S", "B"), pick("Senior", None), pick("Remote", "Onsite"), rng.randint(0, 100), rng.random() < 0.5, rng.random() < 0.3, at + dt.timedelta(days=i % 5)) for i in range(60)]
    df = spark.createDataFrame(posts, "id int, title string, company string, role_category string, state string, priority string, level string, remote_status string, new_grad_fit int, is_usa boolean, is_senior boolean, first_seen timestamp")
    few = [(i, pick("Power", None), pick("CA", None), pick("S", None), pick(None, 0, 1, 40, 64, 99, 200), pick(True, False, None), at + dt.timedelta(days=2), pick("Senior", None, None), pick("acme", "", None), pick("remote", "x", None, None), pick("grid", "E", "la", "power", None, "GRID ENGINEER"), pick(False, True, None), pick(["is_usa"], ["other"], None)) for i in range(400)]
    schema = "watch_id int, role_category string, state string, priority string, min_score int, usa_only boolean, since timestamp, level string, company string, remote string, keyword string, include_senior boolean, role_flags array<string>"

    def finds(w, p):
        _, cat, state, tier, least, usa, _, level, company, remote, word, senior, flags = w
        low = lambda x: (x or "").lower()
        return ((cat is None or cat == p[3]) and (state is None or state == p[4]) and (tier is None or tier == p[5]) and p[8] >= (least or 0) and (not usa or p[9]) and (level is None or level == p[6]) and (company is None or company.lower() in low(p[2]))
            and (remote is None or remote.lower() in low(p[7])) and (word is None or any(word.lower() in low(x) for x in (p[1], p[2], p[3]))) and (senior is not False or not p[10]) and (not flags or "is_usa" not in flags or p[9]))

    got = {r.watch_id: (r.total, r.new) for r in alerts.watchlist_counts(spark.createDataFrame(few, schema), df).collect()}
    assert got == {w[0]: (sum(finds(w, p) for p in posts), sum(finds(w, p) and p[11] >= w[6] for p in posts)) for w in few}
    many = spark.range(100_000).selectExpr("cast(id as int) as watch_id", "if(id % 3 = 0, 'Power', null) as role_category", "'CA' as state", "cast(null as string) as priority", "cast(id % 101 as int) as min_score", "id % 2 = 0 as usa_only", "timestamp'2024-01-03' as since")
    hits = alerts.watchlist_hits(many, df)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = sum(1 for i in range(100_000) for p in posts if p[4] == "CA" and (i % 3 or p[3] == "Power") and p[8] >= i % 101 and (i % 2 or p[9]))
    assert hits.count() == want


def test_searches_meet_classes_of_postings(spark):
    """Postings that no search tells apart are one class; times a microsecond apart are different searches."""
    from loomwork.operators import alerts

    df = spark.range(400).selectExpr("id", "concat('Job ', id) as title", "'Acme' as company", "'Power' as role_category", "'CA' as state", "'S' as priority", "50 as new_grad_fit", "true as is_usa", "timestamp_micros(1704067200000000 + id) as first_seen")
    w = spark.range(3).selectExpr("id as watch_id", "'Power' as role_category", "cast(null as string) as state", "cast(null as string) as priority", "10 as min_score", "true as usa_only", "timestamp_micros(1704067200000000 + id) as since", "'job 39' as keyword")
    assert alerts.posting_classes(w.drop("keyword"), df).count() == 3
    assert sorted(map(tuple, alerts.watchlist_counts(w, df).collect())) == [(i, 11, 11) for i in range(3)]
    assert sorted(map(tuple, alerts.watchlist_counts(w.drop("keyword"), df).collect())) == [(i, 400, 400 - i) for i in range(3)]
    got = alerts.watchlist_alerts(w, df, F.current_timestamp())[0].collect()
    assert sorted(map(tuple, got)) == [(i, 11, "11 new, latest: Job 399 at Acme") for i in range(3)]
    assert sorted(map(tuple, alerts.class_hits(w, df.limit(0)).collect())) == []


def test_the_inverted_index_finds_what_the_scan_finds(spark, tmp_path):
    from loomwork.operators import search_index

    rng = random.Random(12)
    words = ["Grid", "C++", "power-flow", "relay,", "intel", "intelligence", "(UVM)", "AXI/AHB", "é", "a"]
    say = lambda n: " ".join(rng.choices(words, k=n)) or None
    rows = [(i if i else None, say(2), None, say(1), rng.sample(words, 2) if i % 3 else None, "Power", None, "CA", "Erie", "lever", say(rng.randint(0, 6)), say(3), say(2)) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, title string, norm_title string, company string, keywords array<string>, role_category string, experience_level string, state string, location string, platform string, body string, full_text string, snippet string").withColumn("is_senior", F.lit(False))
    path = f"file://{tmp_path}"
    search_index.build(df, path)
    at = F.expr("TIMESTAMP '2024-01-01'")
    for keyword, skills_ in (("grid", ()), ("INTEL", ()), ("c++ uvm", ()), ("power flow", ()), ("power-flow", ()), ("ahb a", ()), ("é", ()), ("telli", ()), ("grid nowhere", ()), ("", ("relay", "C++")), ("intel", ("intelligence",)), ("er", ("el",))):
        f = filters.Filters(keyword=keyword or None, skills=skills_, include_senior=True)
        want = sorted((r.id or -1) for r in df.where(filters.predicate(f, at)).select("id").collect())
        assert sorted((r.id or -1) for r in search_index.search(spark, path, keyword, skills_).collect()) == want, (keyword, skills_)
    plan = search_index.search(spark, path, "grid")._jdf.queryExecution().toString()
    assert plan.count("PartitionFilters: [isnotnull(kind") >= 2 and "kind#" in plan and "In(term" in plan or "EqualTo(term" in plan
    assert search_index.search(spark, path) is None
    search_index.build(df.limit(0), f"{path}/none")


def test_character_references_decode_as_the_standard_says(spark):
    import html
    from html.entities import html5

    from loomwork.functions.entities import unescape

    rng = random.Random(3)
    texts = [f"a&{k}b" for k in html5] + [f"&{k}" for k in html5] + [f"&#{n};x&#x{n:x}y&#X{n:X};" for n in (*range(0, 180), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFFFE, 0xFFFF, 0x10000, 0x1F600, 0x10FFFF, 0x110000, 10**9, 10**30)]
    texts += ["", "&", "&&amp;&", "&;", "&#;", "&#x;", "&#xg", "&amp;lt;", "&notit;", "&notin;", "&copyright &ampere; & amp;", "&" + "x" * 40 + ";", "&é;", "&#00000000000065;", None]
    texts += ["".join(rng.choices(["&", "amp", ";", "#", "x", "41", "lt", " ", "not", "in", "é", "<"], k=rng.randint(1, 12))) for _ in range(400)]
    got = values(spark, texts, unescape(F.col("text")))
    wrong = [(t, g) for t, g in zip(texts, got, strict=True) if g != (None if t is None else html.unescape(t))]
    assert not wrong, wrong[:10]


def test_streaks_merge_from_parts_in_any_order(spark):
    from loomwork.operators import lifecycle

    rng = random.Random(9)
    log = spark.createDataFrame([(c, i, rng.choice([True, False, False, None])) for c in "abcde" for i in range(rng.randint(1, 40))], "k string, at int, ok boolean")
    hit = F.coalesce("ok", F.lit(False))
    want = {r.k: r.x for r in lifecycle.streaks(log, "k", "at", hit).groupBy("k").agg(F.max_by("streak", "at").alias("x")).collect()}
    parts = lifecycle.streak_parts(log, "k", "at", F.floor(F.col("at") / 7), {"ok": F.col("ok")})
    out = lifecycle.merged_streaks(parts.orderBy(F.desc("part")), "k", ["ok"])
    assert {r.k: r.ok for r in out.collect()} == want
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()

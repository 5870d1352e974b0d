"""Queries of rules with their default lists, of the directory, the reader's view of the pipeline, backing projects and the stream of observations."""

from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import places as P
from ..functions import skills as S
from ..operators import filters, lifecycle, marts, matching, search_index
from ..sources import corpus
from ..streaming import ingest
from .lens import SKILLS, duck, lens, read, with_skills
from .posed import expected, pick
from .registry import query
from .tables_q import searched

CITIZEN, CLEARED, PERSON, EXPORT, STATE, VISA = (k for _, k, _ in C.RISKS)
#: What a posting says, and the tier and terms that it then has.
SAID = [
    ("Applicants must hold US citizenship.", "high", CITIZEN), ("Open to a U.S. citizen only", "high", CITIZEN), ("United States citizens preferred; green card no use", "high", CITIZEN), ("TS/SCI with polygraph", "high", CLEARED),
    ("Active clearance and U.S. citizens", "high", f"{CITIZEN}|{CLEARED}"), ("You have to be a U.S. person", "medium", PERSON), ("Lawful permanent residents may apply", "medium", PERSON), ("ITAR rules hold here", "medium", EXPORT),
    ("Export-controlled technology", "medium", EXPORT), ("A defense contractor's cleared facility", "medium", STATE), ("We will not sponsor visas", "medium", VISA), ("Sponsorship is not available", "medium", VISA), ("No visa sponsorship", "medium", VISA),
    ("Candidates who can work without the need for current or future visa sponsorship", "medium", VISA), ("Unable to offer employment visa sponsorship", "medium", VISA), ("No sponsorship. US person, please", "medium", f"{PERSON}|{VISA}"),
    ("We do sponsor. Citizens of the world, ear plugs no, years of work", "medium", EXPORT), ("We sponsor visas; bear with us", "low", ""), ("Precious citizenry, unclear ance", "low", ""), ("", "low", ""),
]
#: What a posting asks, and its tags in order.
ASKED = [
    ("PE license required", "PE license"), ("Licensed Professional Engineer", "PE license"), ("P.E. registration a plus; PE is required", "PE license"), ("Ability to obtain a PE", "PE license"), ("EIT or FE exam passed", "EIT / FE"), ("Engineer-in-Training certificate", "EIT / FE"),
    ("NERC PRC work", "NERC"), ("Secret clearance, up to 25% travel", "Clearance|Travel"), ("ability to obtain and maintain security clearance", "Clearance"), ("travel up to 10 % of the time", "Travel"), ("overnight travel and storm restoration", "Travel|On-call / storm duty"),
    ("On-call, 24/7 support", "On-call / storm duty"), ("peer review, nerchaft, travelled 100% travels", ""), ("PE License, EIT, NERC, top secret, willingness to travel, storm duty", "PE license|EIT / FE|NERC|Clearance|Travel|On-call / storm duty"),
]


def saying(spark, d, said: list[str]):
    """The lens with the own name of a part after what is said."""
    return lens(spark, d).select("id", F.concat_ws(" : ", pick(said), "part_name").alias("text"))


@query("c09_default_risks", expected("risk, terms", [r[1:] for r in SAID], "id, risk, terms"))
def c09_default(spark, d):
    out = saying(spark, d, [r[0] for r in SAID]).select("id", C.eligibility(F.col("text")).alias("e"))
    return out.select("id", "e.risk", F.array_join("e.terms", "|").alias("terms"))


@query("c08_default_tags", expected("tags", [r[1:] for r in ASKED], "id, tags"))
def c08_default(spark, d):
    return saying(spark, d, [r[0] for r in ASKED]).select("id", F.array_join(C.requirements(F.col("text")), "|").alias("tags"))


#: What follows a place, and whether it goes.
TAILS = [(" Bldg 2", True), (", Suite 20", True), (" Ste 4, rear", True), (" fl 9", True), (", FLOOR 3", True), (" Stephens", False), (", Florida", False), ("building", False), (" building", True), ("", True)]


@query("b24_display_tails", expected("tail", [("" if gone else x,) for x, gone in TAILS], "id, CASE WHEN id % 7 = 0 THEN 'Erie, PA' ELSE location || tail END AS shown"))
def b24_tails(spark, d):
    us = F.col("id") % 7 == 0
    return lens(spark, d).select("id", P.display_location(us, F.lit("Erie"), F.lit("PA"), F.concat("location", pick([x for x, _ in TAILS])), F.col("state")).alias("shown"))


@query("e03_unknown_ids", duck("SELECT id FROM lens"))
def e03_unknown(spark, d):
    """A list of ids that name no company is no filter; so is one without numbers."""
    directory = read(spark, d, "supplier").select(F.col("s_suppkey").alias("company_id"), F.col("s_name").alias("company"))
    return lifecycle.of_companies(lifecycle.of_companies(lens(spark, d), directory, "-4, 99999999"), directory, "x,").select("id")


@query("e03_known_ids", duck("SELECT id FROM lens JOIN supplier ON s_name = company WHERE s_suppkey IN (1, 3)"))
def e03_known(spark, d):
    directory = read(spark, d, "supplier").select(F.col("s_suppkey").alias("company_id"), F.col("s_name").alias("company"))
    return lifecycle.of_companies(lens(spark, d), directory, "1, 3 ,x,99999999").select("id")


@query("e23_directory_hq", "SELECT s_name AS company FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE contains(lower(n_name), 'on_1') AND n_regionkey = 2")
def e23_hq(spark, d):
    """Found by headquarters alone; companies without a sector are in Other."""
    s = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    s = s.select(F.col("s_name").alias("company"), F.when(F.col("n_regionkey") != 2, F.col("n_regionkey").cast("string")).alias("sector"), F.col("n_name").alias("hq"), F.lit(1).alias("viewable"))
    return filters.directory_filter(s, " ON_1 ", "Other").select("company")


@query("g09_client_health", """
WITH g AS (SELECT o_orderpriority AS engine, n_regionkey AS k, max(o_orderdate) AS good FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus <> 'P' GROUP BY ALL),
e AS (SELECT engine, k, epoch(TIMESTAMP '1998-08-05' - good) / 3600 <= 2 * 24 * (ascii(engine) % 2 * 400 + 1) AS ok FROM g),
c AS (SELECT k, count(*) FILTER (ok) AS working, count(*) AS engines, CASE k WHEN 0 THEN 13.0 WHEN 1 THEN 12.0 ELSE 11.5 END AS age FROM e GROUP BY k)
SELECT k, CASE WHEN working = engines THEN 'ok' WHEN working > 0 OR age <= 12 THEN 'stale' ELSE 'down' END AS overall, working, engines, CAST(age AS DOUBLE) AS corpus_age_hours FROM c""")
def g09_client(spark, d):
    """The reader's view for each region's runs, with a corpus of 13, 12 and 11.5 hours."""
    at = F.expr("TIMESTAMP '1998-08-05'")
    places = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_regionkey").alias("k"))
    runs = read(spark, d, "orders").join(places, "o_custkey").where("o_orderstatus <> 'P'").select("k", F.col("o_orderpriority").alias("engine"), F.col("o_orderdate").cast("timestamp").alias("started_at"), F.lit(True).alias("finished"), F.lit(1).alias("companies"))
    cadence = runs.select("engine").distinct().withColumn("hours", 24 * (F.ascii("engine") % 2 * 400 + 1))
    out = None
    for k, age in enumerate((13.0, 12.0, 11.5, 11.5, 11.5)):
        generated = at - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(int(age * 60)))
        own = runs.where(f"k = {k}")
        seen = marts.pipeline_health(own, cadence.join(own.select("engine").distinct(), "engine", "left_semi"), at)
        one = marts.client_health(seen, generated, at).withColumn("k", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out.where("engines > 0")


def indexed(spark, d, keyword="", skills=()):
    from .tables_q import searchable

    home = corpus.scratch(spark)
    search_index.build(searchable(spark, d), home, kinds=("ws" if keyword else "") + ("k" if skills else ""))
    return search_index.search(spark, home, keyword, skills)


@query("e15_indexed", duck(f"SELECT id FROM skilled WHERE {searched('ring')} AND {searched('the')} AND {searched('n5orm')}"))
def e15_indexed(spark, d):
    """By the inverted index: words of the long fields, substrings of the short ones."""
    return indexed(spark, d, "ring the N5orm")


@query("e16_indexed", duck("SELECT id FROM skilled WHERE " + " AND ".join(f"(contains(array_to_string(skills[1:3], ', '), '{k}') OR contains(lower(substr(coalesce(body, ''), 1, 300)), '{k}'))" for k in ("the", "with"))))
def e16_indexed(spark, d):
    return indexed(spark, d, skills=("The", "with"))


AREAS = {"first area": ("the", "der"), "second area": ("les", "con")}


@query("h03_backed_projects", duck("""
, j AS (SELECT id, list_filter(['first area', 'second area'], lambda x: (x = 'first area' AND len(list_intersect(skills, ['the', 'der'])) > 0) OR (x = 'second area' AND len(list_intersect(skills, ['les', 'con'])) > 0)) AS sig, list_filter(skills, lambda x: list_contains(['the', 'and', 'que', 'los'], x))[1:8] AS m FROM skilled),
p AS (SELECT id, [{'n': 'one', 'b': list_filter(['first area'], lambda x: list_contains(sig, x)) || list_filter(m, lambda x: x IN ('and', 'que'))}, {'n': 'two', 'b': list_filter(['second area'], lambda x: list_contains(sig, x))}, {'n': 'three', 'b': list_filter(m, lambda x: x = 'los')}] AS p FROM j)
SELECT id, array_to_string(list_transform(list_filter(p, lambda x: len(x.b) > 0), lambda x: x.n || ':' || array_to_string(x.b, '+')), ',') AS backed FROM p"""))
def h03_backed(spark, d):
    """Three projects of a profile, and what of each posting they speak for."""
    df = with_skills(lens(spark, d))
    project = lambda name, skills, signals: F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, skills)).alias("skills"), F.array(*map(F.lit, signals)).alias("signals"))
    own = F.array(project("one", ("and", "que"), ("first area",)), project("two", ("none",), ("second area",)), project("three", ("los",), ("no area",)))
    matched = F.array_intersect("skills", F.array(*[F.lit(x) for x in ("the", "and", "que", "los")]))
    backed = matching.backed(own, S.signals_of(F.array_join("skills", " "), AREAS), matched)
    return df.select("id", F.array_join(F.transform(backed, lambda b: F.concat(b["name"], F.lit(":"), F.array_join(b["backs"], "+"))), ",").alias("backed"))


@query("h09_triage_counts", duck(f"""
, u AS (SELECT conv_id, {", ".join(f"max(CASE WHEN contains(' ' || regexp_replace(lower(coalesce(text, '')), '[^a-z]+', ' ', 'g') || ' ', ' {s} ') THEN 1 ELSE 0 END) AS h{i}" for i, s in enumerate(SKILLS))} FROM conversations WHERE role = 'user' GROUP BY conv_id),
pr AS (SELECT conv_id AS profile_id, list_filter([{", ".join(f"CASE WHEN h{i} = 1 THEN '{s}' END" for i, s in enumerate(SKILLS))}], lambda x: x IS NOT NULL) AS own FROM u),
w AS (SELECT unnest(skills) AS skill, count(*) AS n FROM skilled GROUP BY 1)
SELECT profile_id, skill, n, CASE WHEN skill = 'por' THEN 'Safe to Add' WHEN skill = 'the' AND list_contains(own, 'and') THEN 'Reword Only' ELSE 'Do Not Add' END AS tier FROM pr JOIN w ON NOT list_contains(own, skill)"""))
def h09_counts(spark, d):
    """All postings: what each profile lacks, in how many of them, and what to do about it."""
    from .tables_q import profiles

    who = profiles(spark, d)
    equal = read(spark, d, "region").where("r_regionkey = 0").select(F.lit("the").alias("skill"), F.array(F.lit("and")).alias("equal"), F.expr("cast(array() as array<string>)").alias("area"))
    known = F.concat(F.transform("skills", lambda x: F.struct(x.alias("skill"), F.lit(False).alias("in_project"))), F.array(F.struct(F.lit("por").alias("skill"), F.lit(True).alias("in_project"))))
    return matching.triage_all(who, with_skills(lens(spark, d)), equal, who.select("profile_id", F.explode(known).alias("x")).select("profile_id", "x.*"))


FOLD_SQL = """
, c1 AS (SELECT DISTINCT company FROM lens WHERE id % 3 = 0 AND id % 4 < 2), c2 AS (SELECT DISTINCT company FROM lens WHERE id % 4 = 1 AND id % 10 < 7),
s1 AS (SELECT id, company, CASE WHEN id % 3 = 0 AND id % 4 < 2 THEN TIMESTAMP '2024-02-01' ELSE last_seen END AS seen, CASE WHEN NOT (id % 3 = 0 AND id % 4 < 2) AND company IN (SELECT * FROM c1) THEN 1 ELSE 0 END AS m FROM lens WHERE id % 5 <> 0 OR (id % 3 = 0 AND id % 4 < 2)),
s2 AS (SELECT l.id, l.company, l.id % 4 = 1 AND l.id % 10 < 7 AS hit, s1.seen, coalesce(s1.m, 0) AS m, l.company IN (SELECT * FROM c2) AS ran FROM lens l LEFT JOIN s1 ON s1.id = l.id WHERE s1.id IS NOT NULL OR (l.id % 4 = 1 AND l.id % 10 < 7)),
s3 AS (SELECT *, CASE WHEN hit THEN 0 WHEN ran THEN m + 1 ELSE m END AS missed FROM s2)
SELECT CAST(id AS VARCHAR) AS key, company, CASE WHEN hit THEN TIMESTAMP '2024-02-02' ELSE seen END AS last_seen, CASE missed WHEN 0 THEN 'active' WHEN 1 THEN 'possibly_removed' ELSE 'removed' END AS status, CAST(missed AS INT) AS missed,
  CASE WHEN missed >= 2 THEN TIMESTAMP '2024-02-02' END AS removed_at FROM s3"""


@query("k01_stream_fold", duck(FOLD_SQL))
def k01(spark, d):
    """Two landed batches of observations as a stream, folded into published versions; the second epoch is then folded again, which changes nothing."""
    df = lens(spark, d).select(F.col("id").cast("string").alias("key"), "company", F.col("last_seen").cast("timestamp").alias("last_seen"), "id")
    home = corpus.scratch(spark)
    old = df.where("id % 5 <> 0").select("key", "company", "last_seen", F.lit("active").alias("status"), F.lit(0).alias("missed"), F.lit(None).cast("timestamp").alias("removed_at"))
    corpus.publish(spark, f"{home}/corpus", {"stored": old}, version=0)
    schema = "key string, company string, last_seen timestamp"
    for day, which in ((1, "id % 3 = 0 and id % 4 < 2"), (2, "id % 4 = 1 and id % 10 < 7")):
        seen = df.where(which).select("key", "company", F.expr(f"TIMESTAMP '2024-02-0{day}'").alias("last_seen"))
        seen.unionByName(seen.where("key like '%1'")).write.mode("append").parquet(f"{home}/landing")
        ingest.run_versions(spark, f"{home}/landing", schema, f"{home}/corpus", f"{home}/checkpoint").awaitTermination()
    ingest.fold_epoch(spark, seen, 1, f"{home}/corpus")
    return corpus.read_published(spark, f"{home}/corpus", {"stored": ingest.STORED})["stored"]

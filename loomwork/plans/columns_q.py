"""Queries of the scalar functions and classifiers (families B and C) over the posting lens, pages and conversations."""

from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import identity as I
from ..functions import places as P
from ..functions import text as X
from ..functions import titles as T
from .lens import duck, lens, read, with_skills
from .registry import query
from .rules_q import profile_texts


def as_of():
    return F.expr("TIMESTAMP '2024-01-31 00:00:00'")


def cleaned(most: int, shown: str) -> str:
    """DuckDB: pages cleaned; of references these tables have four kinds. The ampersand's comes last, so nothing is decoded twice."""
    plain = "replace(replace(replace(coalesce(html, ''), '&copy;', '©'), '&middot;', '·'), '&quot;', '\"')"
    text = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({plain}, '&amp;?', '&', 'g'), '<[^>]+>', ' ', 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'))"
    cut = lambda c, n: f"CASE WHEN length({c}) <= {n} THEN {c} ELSE regexp_replace(substr({c}, 1, {n}), ' [^ ]*$', '') || '…' END"
    return f"SELECT page_id, {cut('c', most) if shown == 'cleaned' else cut('c', 300)} AS {shown} FROM (SELECT page_id, {text if shown == 'cleaned' else cut('t', most)} AS c FROM (SELECT page_id, html, {text} AS t FROM pages))"


@query("b01_clean_html", cleaned(4000, "cleaned"))
def b01(spark, d):
    return read(spark, d, "pages").select("page_id", X.clean_html(F.col("html")).alias("cleaned"))


@query("b02_snippet", cleaned(500, "snippet"))
def b02(spark, d):
    return read(spark, d, "pages").select("page_id", X.snippet(F.col("html")).alias("snippet"))


@query("b03_strip_tags", r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS stripped FROM pages")
def b03(spark, d):
    return read(spark, d, "pages").select("page_id", X.strip_tags(F.col("html")).alias("stripped"))


@query("b05_norm_key", duck(r"SELECT id, regexp_replace(lower(trim('  ' || company || '   X ')), '\s+', ' ', 'g') AS norm FROM lens"))
def b05(spark, d):
    return lens(spark, d).select("id", X.norm_key(F.concat(F.lit("  "), "company", F.lit("   X "))).alias("norm"))


@query("b06_norm_company", duck("SELECT id, trim(regexp_replace(lower(company), '[^a-z0-9]+', ' ', 'g')) AS norm FROM lens"))
def b06(spark, d):
    return lens(spark, d).select("id", X.norm_company(F.concat(F.lit("The "), "company", F.lit(" Holdings, Inc."))).alias("norm"))


@query("b08_strip_tracking", """
WITH q AS (SELECT page_id, url, regexp_extract(url, '^([^?#]*)', 1) AS base, regexp_extract(url, '\\?([^#]*)', 1) AS qs, regexp_extract(url, '(#.*)$', 1) AS frag FROM pages),
p AS (SELECT *, list_filter(string_split(qs, '&'), lambda x: x <> '') AS parts FROM q),
k AS (SELECT *, list_filter(parts, lambda x: NOT list_contains(['utm_source','utm_medium','utm_campaign','utm_term','utm_content','fbclid','gclid','msclkid','ref','source','referral','gh_src','lever-source','lever-origin'], lower(string_split(x, '=')[1]))) AS kept FROM p)
SELECT page_id, base || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END || frag AS clean, CAST(len(parts) - len(kept) AS INT) AS removed FROM k""".replace("\\\\", "\\"))
def b08(spark, d):
    return read(spark, d, "pages").select("page_id", I.strip_tracking(F.col("url")).alias("s")).select("page_id", F.col("s.url").alias("clean"), "s.removed")


@query("b09_apply_url", "SELECT page_id, CASE WHEN regexp_matches(url, '[?&](utm_[a-z]+|ref)=') THEN 'stripped' ELSE 'ok' END AS status FROM pages")
def b09(spark, d):
    return read(spark, d, "pages").select("page_id", I.apply_url(F.col("url"), F.lit("https://example.org/")).alias("a")).select("page_id", "a.status")


@query("b11_location_from_url", duck("SELECT id, CASE WHEN id % 2 = 0 THEN replace(replace(location, '_', ' '), '-', ' ') || ', ' || state END AS place FROM lens"))
def b11(spark, d):
    slug = F.when(F.col("id") % 2 == 0, F.concat(F.regexp_replace("location", "_", "-"), F.lit("--"), "state")).otherwise(F.lit("R-12345"))
    return lens(spark, d).select("id", P.location_from_url(F.concat(F.lit("https://x.example.com/job/"), slug, F.lit("/apply"))).alias("place"))


@query("b12_relative_date", duck("SELECT id, TIMESTAMP '2024-01-31' - CAST(id % 20 * CASE WHEN id % 3 = 0 THEN 7 ELSE 1 END AS INT) * INTERVAL '1' DAY AS posted FROM lens"))
def b12(spark, d):
    text = F.concat(F.lit("Posted "), (F.col("id") % 20).cast("string"), F.when(F.col("id") % 3 == 0, " Weeks Ago").otherwise(" Days Ago"))
    return lens(spark, d).select("id", X.relative_date(text, as_of()).alias("posted"))


@query("b13_parse_date", duck("SELECT id, CAST(CAST(first_seen AS DATE) AS TIMESTAMP) AS parsed FROM lens"))
def b13(spark, d):
    text = F.when(F.col("id") % 2 == 0, F.date_format("first_seen", "yyyy-MM-dd")).otherwise(F.date_format("first_seen", "MMMM d, yyyy"))
    return lens(spark, d).select("id", X.parse_date(text).alias("parsed"))


@query("b14_sane_posted", duck("SELECT id, CASE WHEN id % 4 <> 0 THEN posted_date END AS sane FROM lens"))
def b14(spark, d):
    odd = F.when(F.col("id") % 4 == 0, F.when(F.col("id") % 8 == 0, F.expr("posted_date + interval 900 days")).otherwise(F.expr("posted_date - interval 4000 days"))).otherwise(F.col("posted_date"))
    return lens(spark, d).select("id", X.sane_posted(odd, as_of()).alias("sane"))


@query("b15_effective_date", duck("SELECT id, coalesce(posted_date, first_seen) AS effective, CASE WHEN id % 2 = 0 AND posted_date IS NOT NULL THEN posted_date ELSE first_seen END AS known FROM lens"))
def b15(spark, d):
    return lens(spark, d).select("id", X.effective_date(F.col("posted_date"), F.col("first_seen")).alias("effective"), X.effective_date(F.col("posted_date"), F.col("first_seen"), F.col("id") % 2 == 0).alias("known"))


@query("b16_freshness", duck("""
, a AS (SELECT id, posted_date IS NOT NULL AS exact, CAST(greatest(floor((epoch(TIMESTAMP '2024-01-31') - floor(epoch(coalesce(posted_date, first_seen)))) / 86400), 0) AS INT) AS days FROM lens)
SELECT id, exact, days, days <= 3 AS is_new, CASE WHEN exact THEN 'Posted ' ELSE 'Added ' END || CASE WHEN days = 0 THEN 'today' WHEN days = 1 THEN 'yesterday' WHEN days < 7 THEN days || 'd ago' WHEN days < 30 THEN (days // 7) || 'w ago' WHEN days < 365 THEN (days // 30) || 'mo ago' ELSE (days // 365) || 'y ago' END AS label FROM a"""))
def b16(spark, d):
    return lens(spark, d).select("id", X.freshness(F.col("posted_date"), F.lit(True), F.col("first_seen"), as_of()).alias("f")).select("id", "f.exact", "f.days", "f.is_new", "f.label")


def place():
    return F.concat_ws(", ", F.when(F.col("id") % 4 == 0, F.concat(F.col("location"), F.lit(", CA"))).when(F.col("id") % 4 == 1, F.lit("Texas")).when(F.col("id") % 4 == 2, F.lit("Munich, Germany")).otherwise(F.col("location")))


@query("b19_parse_location", duck("SELECT id, id % 4 < 2 AS is_usa, CASE id % 4 WHEN 0 THEN 'CA' WHEN 1 THEN 'TX' END AS state, CASE id % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.88 WHEN 2 THEN 0.97 ELSE 0 END::DOUBLE AS confidence, CASE id % 4 WHEN 0 THEN 'state code' WHEN 1 THEN 'state name' WHEN 2 THEN 'foreign country' ELSE 'unknown' END AS reason FROM lens"))
def b19(spark, d):
    return lens(spark, d).select("id", P.parse_location(place(), F.lit("")).alias("l")).select("id", "l.is_usa", "l.state", "l.confidence", "l.reason")


@query("b22_distinct_states", duck("SELECT id, CAST(CASE id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 0 END AS INT) AS n FROM lens"))
def b22(spark, d):
    return lens(spark, d).select("id", P.distinct_states(place()).alias("n"))


@query("b23_location_label", duck("SELECT id, CASE id % 4 WHEN 0 THEN 'Onsite' WHEN 1 THEN 'Onsite' WHEN 2 THEN 'Non-USA Excluded' ELSE 'Location Unknown' END AS label FROM lens"))
def b23(spark, d):
    df = lens(spark, d).select("id", P.parse_location(place(), F.lit("")).alias("l"), P.distinct_states(place()).alias("n"))
    return df.select("id", P.location_label(F.col("l.is_usa"), F.col("l.confidence"), F.col("n"), F.lit("Onsite")).alias("label"))


@query("b24_display_location", duck("SELECT id, location AS shown FROM lens"))
def b24(spark, d):
    return lens(spark, d).select("id", P.display_location(F.lit(False), F.lit(None).cast("string"), F.lit(None).cast("string"), F.concat("location", F.lit(", Suite 20")), F.col("state")).alias("shown"))


@query("b25_logo_domain", "SELECT page_id, regexp_extract(regexp_extract(url, '://([^/?#]*)', 1), '([^.]+\\.[^.]+)$', 1) AS site FROM pages".replace("\\\\", "\\"))
def b25(spark, d):
    return read(spark, d, "pages").select("page_id", I.logo_domain(F.col("url"), F.lit("")).alias("site"))


@query("b26_pretty_title", duck("SELECT id, array_to_string(list_transform(string_split(title, ' '), lambda w: CASE WHEN lower(w) = 'large' THEN upper(w) ELSE upper(substr(w, 1, 1)) || lower(substr(w, 2)) END), ' ') AS pretty FROM lens"))
def b26(spark, d):
    return lens(spark, d).select("id", X.pretty_title(F.col("title"), ("large",)).alias("pretty"))


@query("b27_short_title", duck("SELECT id, part_name AS short, true AS titled FROM lens"))
def b27(spark, d):
    return lens(spark, d).select("id", X.short_title(F.concat("part_name", F.lit(" - "), "role_category")).alias("short"), X.looks_like_title(F.initcap("part_name"), ("built", "led")).alias("titled"))


@query("b28_clean_keywords", duck("SELECT id, array_to_string(skills[1:6], ',') AS keywords FROM skilled"))
def b28(spark, d):
    return with_skills(lens(spark, d)).select("id", F.array_join(X.clean_keywords(F.concat(F.array(F.lit("usa"), F.lit("priority-s"), F.lit("new")), "skills")), ",").alias("keywords"))


#: Categories by words of the four languages of the prose.
TONGUES = (("English", ("the", "and", "that", "with")), ("German", ("der", "und", "nicht")), ("French", ("les", "des", "une")), ("Spanish", ("los", "las", "por")))
HIT = r"regexp_matches(lower(coalesce(body, '')), '(^|[^a-z0-9]){0}($|[^a-z0-9])')"
HITS = {k: "(" + " + ".join(f"CAST({HIT.format(t)} AS INT)" for t in terms) + ")" for k, terms in TONGUES}


@query("c01_term_hits", duck("SELECT id, array_to_string(list_filter(['the', 'and', 'der', 'les', 'los'], lambda t: regexp_matches(lower(coalesce(body, '')), '(^|[^a-z0-9])' || t || '($|[^a-z0-9])')), ',') AS hits FROM lens"))
def c01(spark, d):
    return lens(spark, d).select("id", F.array_join(C.term_hits(F.col("body"), ("the", "and", "der", "les", "los")), ",").alias("hits"))


@query("c04_body_gate", duck(f"SELECT id, {HITS['English']} >= 3 AS enough FROM lens"))
def c04(spark, d):
    return lens(spark, d).select("id", (F.size(C.term_hits(F.col("body"), TONGUES[0][1])) >= 3).alias("enough"))


@query("c05_best_category", duck("SELECT id, CASE WHEN m < 2 THEN NULL " + " ".join(f"WHEN {k} = m THEN '{k}'" for k, _ in TONGUES) + " END AS category FROM (SELECT *, greatest(English, German, French, Spanish) AS m FROM (SELECT id, " + ", ".join(f"{v} AS {k}" for k, v in HITS.items()) + " FROM lens))"))
def c05(spark, d):
    return lens(spark, d).select("id", C.best_category(F.col("body"), TONGUES).alias("category"))


@query("b20_foreign_code", duck("SELECT id, CASE id % 5 WHEN 0 THEN 'CAN' WHEN 1 THEN 'CAN' WHEN 2 THEN 'IND' ELSE '' END AS code FROM lens"))
def b20(spark, d):
    k = F.col("id") % 5
    loc = F.when(k == 0, F.concat(F.lit("CAN - "), "location")).when(k == 1, F.concat("location", F.lit(", ON"))).when(k == 2, F.concat(F.lit("ind \u2013 "), "location")).when(k == 3, F.concat(F.lit("XYZ - "), "location")).otherwise(F.concat("location", F.lit(", CA")))
    return lens(spark, d).select("id", P.foreign_code(loc).alias("code"))


@query("b21_false_friends", duck("SELECT id, CASE WHEN id % 2 = 0 THEN location || ',  mexico ' ELSE location END AS masked FROM lens"))
def b21(spark, d):
    loc = F.when(F.col("id") % 4 == 0, F.concat("location", F.lit(", Baja California Sur"))).when(F.col("id") % 2 == 0, F.concat("location", F.lit(", BAJA CALIFORNIA"))).otherwise(F.col("location"))
    return lens(spark, d).select("id", P.mask_false_friends(loc).alias("masked"))


LEVEL_TEXTS = ("new grad welcome", "0-2 years", "entry-level post", "a senior post", "6+ years", "nothing said", "2 years")


@query("c11_experience_level", duck("SELECT id, CASE WHEN id % 11 = 0 THEN 'Unknown' ELSE CASE id % 7 WHEN 0 THEN 'New Grad' WHEN 1 THEN '0-3 Years' WHEN 2 THEN 'Entry Level' WHEN 3 THEN 'Senior' WHEN 4 THEN 'Mid Level' ELSE 'Unknown' END END AS level FROM lens"))
def c11(spark, d):
    body = F.element_at(F.array(*[F.lit(x) for x in LEVEL_TEXTS]), (F.col("id") % 7 + 1).cast("int"))
    title = F.concat("title", F.when(F.col("id") % 11 == 0, " Intern").otherwise(""))
    return lens(spark, d).select("id", C.experience_level(title, body).alias("level"))


@query("c07_role_flags", duck("SELECT id, " + ", ".join(f"lang = '{k[:2].lower()}' OR {HITS[k]} >= 3 AS {k.lower()}" for k, _ in TONGUES) + " FROM lens"))
def c07(spark, d):
    own = F.create_map(*[F.lit(x) for k, _ in TONGUES for x in (k[:2].lower(), k)])
    v = F.struct(F.lit(True).alias("relevant"), F.coalesce(F.element_at(own, F.col("lang")), F.lit("")).alias("category"))
    m = lens(spark, d).select("id", T.role_flags(v, F.col("body"), TONGUES).alias("m"))
    return m.select("id", *[F.array_contains("m", k).alias(k.lower()) for k, _ in TONGUES])


@query("c08_labels", duck(r"SELECT id, array_to_string(list_filter([CASE WHEN regexp_matches(lower(coalesce(body, '')), '[0-9]{4}') THEN 'Number' END, CASE WHEN regexp_matches(lower(coalesce(body, '')), '@') THEN 'Mail' END, CASE WHEN regexp_matches(lower(coalesce(body, '')), 'licen[sc]e') THEN 'Licence' END], lambda x: x IS NOT NULL), ',') AS tags FROM lens"))
def c08(spark, d):
    return lens(spark, d).select("id", F.array_join(C.labels(F.col("body"), (("Number", "[0-9]{4}"), ("Mail", "@"), ("Licence", "licen[sc]e"))), ",").alias("tags"))


@query("c09_eligibility", duck("SELECT id, CASE WHEN regexp_matches(lower(coalesce(body, '')), '@') THEN 'high' WHEN regexp_matches(lower(coalesce(body, '')), '[0-9]{4}') THEN 'medium' ELSE 'low' END AS risk FROM lens"))
def c09(spark, d):
    return lens(spark, d).select("id", C.eligibility(F.col("body"), (("high", "mail", "@"), ("medium", "number", "[0-9]{4}"))).alias("e")).select("id", "e.risk")


def years():
    return (F.col("id") % 10).cast("int")


SCORE_SQL = "greatest(0, least(100, CASE WHEN is_usa THEN 35 ELSE 25 END + CASE WHEN h >= 4 THEN 20 WHEN h >= 1 THEN 10 ELSE 0 END + CASE WHEN is_entry THEN 20 ELSE 0 END + CASE WHEN priority IN ('S', 'A') THEN 10 ELSE 0 END + CASE WHEN posted_date IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN platform = 'src0' THEN 5 ELSE 0 END - CASE WHEN is_senior THEN 35 ELSE 0 END - CASE WHEN id % 10 >= 5 THEN 30 ELSE 0 END))"


def scored(spark, d):
    m = C.match_score(F.lit(True), F.col("is_usa"), F.size("skills"), F.col("is_entry"), F.col("priority"), F.col("posted_date").isNotNull(), F.col("platform") == "src0", F.col("is_senior"), years())
    return with_skills(lens(spark, d)).select("*", m.alias("m"))


@query("c15_match_score", duck(f"SELECT id, CAST({SCORE_SQL} AS INT) AS score FROM (SELECT *, len(skills) AS h FROM skilled)"))
def c15(spark, d):
    return scored(spark, d).select("id", "m.score")


@query("c16_score_label", duck(f"SELECT id, CASE WHEN s >= 85 THEN 'Excellent' WHEN s >= 75 THEN 'Strong' WHEN s >= 65 THEN 'Good' WHEN s >= 50 THEN 'Fair' ELSE 'Low' END AS label FROM (SELECT id, {SCORE_SQL} AS s FROM (SELECT *, len(skills) AS h FROM skilled))"))
def c16(spark, d):
    return scored(spark, d).select("id", C.bands(F.col("m.score"), C.SCORE_BANDS).alias("label"))


@query("c17_relevance_reason", duck("SELECT id, array_to_string(list_filter(['+title', CASE WHEN len(skills) >= 1 THEN '+body' END, CASE WHEN is_entry THEN '+entry' END, CASE WHEN priority IN ('S', 'A') THEN '+tier' END, CASE WHEN posted_date IS NOT NULL THEN '+recent' END, CASE WHEN platform = 'src0' THEN '+platform' END], lambda x: x IS NOT NULL)[1:3] || list_filter([CASE WHEN is_senior THEN '-senior' END, CASE WHEN id % 10 >= 5 THEN '-years' END], lambda x: x IS NOT NULL), ', ') AS reason FROM skilled"))
def c17(spark, d):
    return scored(spark, d).select("id", C.relevance_reason(F.col("m.breakdown")).alias("reason"))


@query("c20_fit_label", duck("SELECT id, CASE WHEN new_grad_fit >= 90 THEN 'Apply now' WHEN new_grad_fit >= 75 THEN 'Strong fit' WHEN new_grad_fit >= 60 THEN 'Possible' WHEN new_grad_fit >= 46 THEN 'Stretch' ELSE 'Skip' END AS label FROM lens"))
def c20(spark, d):
    return lens(spark, d).select("id", C.bands(F.col("new_grad_fit"), C.FIT_BANDS).alias("label"))


@query("c21_source_reliability", duck("SELECT id, CASE WHEN platform IN ('src0', 'src1') THEN 'high' WHEN platform = 'src2' THEN 'medium' ELSE 'low' END AS reliability FROM lens"))
def c21(spark, d):
    return lens(spark, d).select("id", C.source_reliability(F.col("platform"), (("high", ("src0", "src1")), ("medium", ("src2",)))).alias("reliability"))


@query("c22_data_quality", duck("SELECT id, CAST(10 + CASE WHEN length(coalesce(body, '')) > 0 THEN 30 ELSE 0 END + CASE WHEN is_usa THEN 25 ELSE 12 END + CASE WHEN posted_date IS NOT NULL THEN 20 ELSE 8 END + 15 AS INT) AS quality, CAST(40 + floor((id % 100) * 0.4) + CASE WHEN length(coalesce(body, '')) > 0 THEN 20 ELSE 5 END AS INT) AS confidence FROM lens"))
def c22(spark, d):
    return lens(spark, d).select("id", C.data_quality(F.col("body"), F.when(F.col("is_usa"), 0.9).otherwise(0.5), F.col("posted_date"), F.lit(True)).alias("quality"), C.classification_confidence(F.lit(True), F.col("id") % 100, F.col("body")).alias("confidence"))


USERS = "SELECT conv_id, string_agg(coalesce(text, ''), ' ' ORDER BY turn) AS body FROM conversations WHERE role = 'user' GROUP BY conv_id"


SUB = {k: "(" + " + ".join(f"CAST(contains(lower(body), '{t}') AS INT)" for t in terms) + ")" for k, terms in TONGUES}


@query("c27_role_focus", f"WITH u AS ({USERS}) SELECT conv_id, CASE WHEN m < 2 THEN NULL " + " ".join(f"WHEN {k} = m THEN '{k}'" for k in SUB) + " END AS focus FROM (SELECT *, greatest(" + ", ".join(SUB) + ") AS m FROM (SELECT conv_id, " + ", ".join(f"{v} AS {k}" for k, v in SUB.items()) + " FROM u))")
def c27(spark, d):
    return profile_texts(spark, d).select("conv_id", C.best_category(F.col("body"), TONGUES, 2, whole=False).alias("focus"))

"""Queries of sources (A), lifecycle (D), filters (E), ranking (F), marts (G), matching (H), alerts (I) and audits (J)."""

from pyspark.sql import functions as F

from ..functions import identity, places, titles
from ..functions import text as X
from ..operators import alerts, audits, filters, lifecycle, marts, matching, ranking
from ..sources import corpus, html, payloads
from .lens import SKILLS, duck, lens, read, with_skills
from .posed import expected, posed
from .registry import query

CLOCK = "TIMESTAMP '2024-01-31 00:00:00'"


def clock():
    return F.expr(CLOCK)


# A: landed payloads. The lens is packed as each platform would send it, landed as JSON text, and read back.

FLAT = duck("SELECT CAST(id AS VARCHAR) AS job_id, title AS job_title, location, 'https://x.example.com/job/' || id AS apply_url, CAST(CAST(first_seen AS DATE) AS TIMESTAMP) AS posted_date FROM lens")
DAY = "date_format(first_seen, 'yyyy-MM-dd')"
URL = "concat('https://x.example.com/job/', id)"
SENT = {
    "greenhouse": ("jobs", f"named_struct('id', id, 'title', title, 'absolute_url', {URL}, 'location', named_struct('name', location), 'published_at', {DAY}, 'content', '<p>x</p>')"),
    "lever": ("postings", f"named_struct('id', cast(id as string), 'text', title, 'hostedUrl', {URL}, 'createdAt', unix_millis(date_trunc('day', first_seen)), 'categories', named_struct('location', location), 'lists', array(named_struct('content', 'a'), named_struct('content', 'b')))"),
    "ashby": ("jobs", f"named_struct('id', cast(id as string), 'title', title, 'secondaryLocations', array(named_struct('location', location)), 'isListed', true, 'isRemote', false, 'jobUrl', {URL}, 'publishedAt', {DAY})"),
    "smartrecruiters": ("content", f"named_struct('id', cast(id as string), 'name', title, 'location', named_struct('city', location), 'releasedDate', {DAY}, 'ref', {URL})"),
    "eightfold": ("positions", f"named_struct('id', id, 'name', title, 'locations', array(location), 'creationTs', unix_seconds(date_trunc('day', first_seen)), 'publicUrl', {URL})"),
    "phenom": ("jobs", f"named_struct('slug', cast(id as string), 'title', title, 'city', location, 'posted_date', date_format(first_seen, 'MMMM d, yyyy'), 'apply_url', {URL})"),
    "amazon": ("jobs", f"named_struct('id', 'x', 'id_icims', cast(id as string), 'title', title, 'normalized_location', location, 'job_path', {URL}, 'posted_date', date_format(first_seen, 'MMMM d, yyyy'), 'description', 'a')"),
    "generic": ("jobs", f"named_struct('id', cast(id as string), 'title', title, 'location', location, 'url', {URL}, 'date', {DAY})"),
}
IDS = {"greenhouse": "a02", "lever": "a03", "ashby": "a04", "smartrecruiters": "a08", "eightfold": "a09", "phenom": "a10", "amazon": "a14", "generic": "a01"}
MORE = {
    "workday": ("a05", "jobPostings", "named_struct('title', title, 'externalPath', concat('/job/', id), 'locationsText', if(id % 2 = 0, '', location), 'primaryLocation', location, 'postedOn', concat('Posted ', id % 20, ' Days Ago'))", "SELECT CAST(id AS VARCHAR) AS job_id, title AS job_title, location, '/job/' || id AS apply_url, TIMESTAMP '2024-01-31' - CAST(id % 20 AS INT) * INTERVAL '1' DAY AS posted_date FROM lens"),
    "jibe": ("a11", "jobs", f"named_struct('data', named_struct('slug', cast(id as string), 'title', title, 'city', location, 'country', state, 'job_url', {URL}, 'posted_date', {DAY}))", "SELECT CAST(id AS VARCHAR) AS job_id, title AS job_title, location || ', ' || state AS location, 'https://x.example.com/job/' || id AS apply_url, CAST(CAST(first_seen AS DATE) AS TIMESTAMP) AS posted_date FROM lens"),
    "oracle": ("a12", "items", None, "SELECT CAST(id AS VARCHAR) AS job_id, title AS job_title, location, '/job/' || id AS apply_url, CAST(CAST(first_seen AS DATE) AS TIMESTAMP) AS posted_date FROM lens"),
    "jobs2web": ("a13", "jobs", f"named_struct('id', cast(id as string), 'title', title, 'urltitle', 'a-b', 'location', location, 'date', concat({DAY}, ' [UTC]'))", "SELECT CAST(id AS VARCHAR) AS job_id, title AS job_title, location, '/job/a-b/' || id AS apply_url, CAST(CAST(first_seen AS DATE) AS TIMESTAMP) AS posted_date FROM lens"),
}


def landed(df, platform, key, item):
    """One payload per company and a hundredth of its ids, so no payload grows with the corpus."""
    one = F.expr(item) if item else F.expr(f"named_struct('Id', cast(id as string), 'Title', title, 'PrimaryLocation', location, 'PostedDate', {DAY})")
    rows = df.groupBy("company", F.floor(F.col("id") / 1000).alias("page")).agg(F.collect_list(one).alias("rows"))
    body = F.struct(F.col("rows").alias(key)) if item else F.struct(F.array(F.struct(F.col("rows").alias("requisitionList"))).alias(key))
    return rows.select("company", F.lit(platform).alias("platform"), F.to_json(body).alias("body"))


def register_payloads():
    def add(name, platform, key, item, sql):
        @query(name, sql)
        def run(spark, d):
            raw = landed(lens(spark, d), platform, key, item)
            raw = raw.unionAll(raw) if platform == "workday" else raw  # a list that was read twice
            return payloads.normalise_payloads(raw, clock()).select("job_id", "job_title", "location", "apply_url", "posted_date")

    for platform, (key, item) in SENT.items():
        add(f"{IDS[platform]}_{platform}", platform, key, item, FLAT)
    for platform, (qid, key, item, sql) in MORE.items():
        add(f"{qid}_{platform}", platform, key, item, duck(sql))


register_payloads()


@query("a06_enrich_details", duck("SELECT CAST(id AS VARCHAR) AS job_id, CASE WHEN id % 2 = 0 THEN location || ', ' || state ELSE '3 Locations' END AS location, CASE WHEN id % 2 = 0 THEN lang ELSE '' END AS body FROM lens"))
def a06(spark, d):
    df = lens(spark, d).withColumn("job_id", F.col("id").cast("string"))
    listed = df.select("company", "platform", "job_id", F.col("title").alias("job_title"), F.lit("3 Locations").alias("location"), F.lit("u").alias("apply_url"), F.lit(None).cast("timestamp").alias("posted_date"), F.lit("").alias("body"))
    details = df.where("id % 2 = 0").select("company", "job_id", F.col("lang").alias("body"), "location", F.col("state").alias("country"), F.lit(None).cast("timestamp").alias("start_date"), F.lit(None).cast("string").alias("url"))
    return payloads.enrich_details(listed, details).select("job_id", "location", "body")


@query("a08_section_details", duck("""
SELECT CAST(id AS VARCHAR) AS job_id, CASE WHEN id % 4 = 0 THEN 'https://own/' || id ELSE 'https://jobs.smartrecruiters.com/' || platform || '/' || id END AS apply_url,
  CASE WHEN id % 3 = 0 THEN '' WHEN id % 3 = 1 THEN title || chr(10) || location ELSE location END AS body FROM lens WHERE id % 5 <> 0"""))
def a08_details(spark, d):
    df = lens(spark, d)
    item = "named_struct('id', cast(id as string), 'name', if(id % 5 = 0, ' ', title), 'location', named_struct('city', location), 'company', named_struct('identifier', platform))"
    section = lambda c, said: F.struct(F.when(said, F.concat(F.lit("<p>"), c, F.lit("</p>"))).otherwise("").alias("text"))
    sections = F.struct(section(F.col("title"), F.col("id") % 3 == 1).alias("jobDescription"), section(F.col("location"), F.col("id") % 3 > 0).alias("additionalInformation"))
    page = F.struct(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 4 == 0, F.concat(F.lit("https://own/"), "id")).alias("postingUrl"), F.struct(sections.alias("sections")).alias("jobAd"))
    listed = payloads.normalise(landed(df, "smartrecruiters", "content", item), "smartrecruiters")
    return payloads.enrich_details(listed, payloads.section_details(df.select("company", F.to_json(page).alias("body")))).select("job_id", "apply_url", "body")


@query("a15_html_cards", r"SELECT page_id, count(*) AS n, min(t) AS least FROM (SELECT page_id, trim(regexp_replace(regexp_replace(unnest(regexp_extract_all(html, '<p>([^<]*)</p>', 1)), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM pages) GROUP BY page_id")
def a15(spark, d):
    return html.extract_cards(read(spark, d, "pages").select("page_id", "html"), "html", r"<p>[^<]*</p>", {"t": r"<p>([^<]*)</p>"}).groupBy("page_id").agg(F.count("*").alias("n"), F.min("t").alias("least"))


STRIP = r"trim(regexp_replace(regexp_replace({}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
A18_SQL = f"""
WITH s AS (SELECT page_id, string_split(html, '<a href=') AS p FROM pages),
u AS (SELECT page_id, i, '<a href=' || p[i] AS part FROM (SELECT page_id, p, unnest(range(2, len(p) + 1)) AS i FROM s))
SELECT page_id, CAST(i - 2 AS INT) AS pos, {STRIP.format("regexp_extract(part, '<a href=\"([^\"]*)\"', 1)")} AS href, {STRIP.format("regexp_extract(part, '>([^<]*)</a>', 1)")} AS text FROM u"""


@query("a18_segments", A18_SQL)
def a18(spark, d):
    return html.segments(read(spark, d, "pages").select("page_id", "html"), "html", r"<a href=", {"href": r'<a href="([^"]*)"', "text": r">([^<]*)</a>"})


@query("a19_detail", r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS title, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM pages")
def a19(spark, d):
    return read(spark, d, "pages").select("page_id", html.extract_detail(F.col("html")).alias("x")).select("page_id", "x.title", F.coalesce("x.body", F.lit("")).alias("body"))


@query("a20_page_locations", duck("SELECT id, CASE WHEN id % 4 = 3 THEN 'Placentia ' ELSE '' END || location AS unlabelled, location || ', ' || state AS trimmed FROM lens"))
def a20_page(spark, d):
    df = posed(lens(spark, d), label=["place", "Location: ", "placeLocation ", "Placentia "])
    markup = F.concat(F.lit(" , <b>"), "location", F.lit("</b>,\n <i>"), "state", F.lit("</i> ,"))
    return df.select("id", places.unlabelled_location(F.concat("label", "location")).alias("unlabelled"), F.regexp_replace(places.trimmed_location(markup), " ,", ",").alias("trimmed"))


@query("a20_locations", duck("SELECT id, 'Irvine, CA, United States' AS icims, 'Nation, ' || state AS shouting FROM lens"))
def a20(spark, d):
    df = lens(spark, d)
    return df.select("id", places.icims_location(F.concat(F.lit("DE-BE-"), "location", F.lit(" | US-CA-Irvine"))).alias("icims"), places.shouting_location(F.concat(F.lit("NATION, "), "state", F.lit(", 92618"))).alias("shouting"))


@query("a21_clean_title", duck("SELECT id, CASE WHEN id % 2 = 0 THEN title ELSE title || ' - Elsewhere' END AS cleaned FROM lens"))
def a21(spark, d):
    t = F.concat("title", F.lit(" (Remote)"), F.when(F.col("id") % 2 == 0, F.concat(F.lit(" - "), "location", F.lit(", X"))).otherwise(F.lit(" - Elsewhere")))
    return lens(spark, d).select("id", X.clean_job_title(t, F.col("location")).alias("cleaned"))


@query("a22_harvest_links", r"""
WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?s)<a\s[^>]*href="[^"]*"[^>]*>.*?</a>')) AS a FROM pages),
l AS (SELECT page_id, url, regexp_extract(a, 'href="([^"]*)"', 1) AS href, trim(regexp_replace(regexp_replace(regexp_extract(a, '(?s)>(.*?)</a>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM a),
f AS (SELECT DISTINCT page_id, CASE WHEN regexp_matches(href, '^[a-z]+://') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || href ELSE regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/' || href END AS href FROM l WHERE length(text) >= 8)
SELECT page_id, count(*) AS n, min(href) AS first_href FROM f GROUP BY page_id""")
def a22(spark, d):
    return html.harvest_links(read(spark, d, "pages"), "html", "url").groupBy("page_id").agg(F.count("*").alias("n"), F.min("href").alias("first_href"))


@query("a23_first_seen", duck("SELECT company, role_category, min(id) AS id FROM lens GROUP BY ALL"))
def a23(spark, d):
    return payloads.first_seen(lens(spark, d), ["company", "role_category"], F.asc("id")).select("company", "role_category", "id")


@query("a24_gate", duck("SELECT id, NOT is_entry AS maybe FROM (SELECT *, row_number() OVER (PARTITION BY company, is_entry ORDER BY id) AS rn FROM lens) WHERE is_entry OR rn <= 3"))
def a24(spark, d):
    v = F.struct(F.col("is_entry").alias("relevant"), (~F.col("is_entry")).alias("needs_description"))
    return payloads.gate(lens(spark, d), v, 3, F.asc("id")).select("id", "maybe")


@query("a25_worklist", duck("SELECT id, place FROM (SELECT id, row_number() OVER (PARTITION BY company ORDER BY is_senior, CAST(id AS VARCHAR)) AS place FROM lens WHERE id % 3 <> 0 AND is_usa) WHERE place <= 5"))
def a25(spark, d):
    df = lens(spark, d).withColumn("job_id", F.col("id").cast("string"))
    known = payloads.known_ids(df.where("id % 3 = 0 and body is not null").select("company", "job_id", F.lit("x").alias("body")))
    return payloads.detail_worklist(df.select("id", "company", "job_id", F.col("is_senior").alias("maybe"), (~F.col("is_usa")).alias("foreign")), known, 5).select("id", F.col("place").cast("long").alias("place"))


FIELD = '<dt class="iCIMS_JobHeaderField">{}</dt><dd class="iCIMS_JobHeaderData"> {} </dd>'


def cell(label, value):
    before, after = FIELD.format(label, "\0").split("\0")
    return F.concat(F.lit(before), value, F.lit(after))


@query("a16_header_fields", duck("SELECT id, CASE id % 3 WHEN 0 THEN 'Irvine, CA, United States' WHEN 1 THEN location || ', ' || state || ', United States' ELSE location || ', ' || state END AS place FROM lens"))
def a16(spark, d):
    k = F.col("id") % 3
    card = F.when(k == 0, F.concat(cell("Job Locations", F.lit("<b>US-CA-Irvine</b>")), cell("City", F.col("location")))).when(k == 1, F.concat(cell("City", F.col("location")), cell("State", F.col("state")), cell("City", F.lit("Other")))).otherwise(F.concat(cell("Country", F.col("state")), cell("CITY", F.col("location")), cell("State", F.lit(""))))
    place = places.header_location(html.header_fields(F.col("card")))
    return lens(spark, d).select("id", card.alias("card")).select("id", html.decoded(place).alias("place"))


@query("a17_table_rows", duck("SELECT CAST(id AS VARCHAR) AS job_id, title AS job_title, 'https://x.example.com/job/a/' || id || '/' AS apply_url, 'Nation, ' || state || ', United States' AS location, CAST(CAST(first_seen AS DATE) AS TIMESTAMP) AS posted_date FROM lens WHERE id % 7 <> 0"))
def a17(spark, d):
    href, cls = F.concat(F.lit('href="/job/a/'), F.col("id").cast("string"), F.lit('/"')), F.lit('class="jobTitle-link"')
    link = F.when(F.col("id") % 7 == 0, F.lit("<a>")).when(F.col("id") % 2 == 0, F.concat(F.lit("<a "), href, F.lit(" "), cls, F.lit(">"))).otherwise(F.concat(F.lit("<a "), cls, F.lit(" "), href, F.lit(">")))
    day = F.when(F.col("id") % 3 == 0, F.date_format("first_seen", "MMM d, yyyy")).otherwise(F.date_format("first_seen", "MM/dd/yyyy"))
    row = F.concat(F.lit('<tr class="data-row">'), link, "title", F.lit('</a><span class="jobLocation"> NATION, '), "state", F.lit(', US, 92618 </span><span class="jobDate visible">'), day, F.lit("</span></tr>"))
    rows = lens(spark, d).select("company", F.floor(F.col("id") / 1000).alias("page"), row.alias("row"))
    pages = rows.groupBy("company", "page").agg(F.array_join(F.collect_list("row"), "\n").alias("html"))
    pages = pages.select(F.concat_ws("/", "company", "page").alias("page_id"), "html", F.lit("https://x.example.com").alias("base"))
    return html.table_rows(pages, "html", "base").drop("page_id")


@query("a26_known_ids", duck("SELECT DISTINCT company, role_category AS job_id FROM lens WHERE coalesce(body, '') <> '' AND id % 3 = 0"))
def a26(spark, d):
    return payloads.known_ids(lens(spark, d).select("company", F.col("role_category").alias("job_id"), F.when(F.col("id") % 3 == 0, F.col("body")).alias("body")))


@query("a28_read_tsv", "SELECT p_name AS name, p_type AS kind, CAST(p_partkey AS BIGINT) AS k FROM part")
def a28(spark, d):
    line = F.concat_ws("\t", F.concat(F.lit("  "), "p_name", F.lit(" ")), F.concat(F.lit(" "), "p_type"), F.col("p_partkey").cast("string"))
    path = corpus.scratch(spark) + "/parts"
    read(spark, d, "part").select(F.explode(F.array(line, F.lit("# a note"), F.lit(""))).alias("value")).write.text(path)
    return corpus.read_tsv(spark, path, "name string, kind string, k long")


CORPUS = {"live": "id long, company string, posted_date timestamp", "state": "id long, last_seen timestamp", "bodies": "id long, body string, chunk int", "details": "id long"}


def published(spark, d):
    """The lens written as a corpus and read back; `details` was never written."""
    df, path = lens(spark, d), corpus.scratch(spark)
    corpus.write_corpus(df.where("id % 3 <> 0").select("id", "company", "posted_date"), df.select("id", "last_seen"), df.select("id", "body"), path)
    return corpus.read_corpus(spark, path, CORPUS)


@query("a30_read_corpus", duck("SELECT 'live' AS part, count(*) AS n, sum(id)::BIGINT AS ids FROM lens WHERE id % 3 <> 0 UNION ALL SELECT 'state', count(*), sum(id)::BIGINT FROM lens UNION ALL SELECT 'details', 0, 0"))
def a30(spark, d):
    t = published(spark, d)
    one = lambda k: t[k].agg(F.lit(k).alias("part"), F.count("*").alias("n"), F.coalesce(F.sum("id"), F.lit(0)).alias("ids"))
    return one("live").unionByName(one("state")).unionByName(one("details"))


@query("a31_published_bodies", duck("SELECT id, CAST(id % 16 AS INT) AS chunk, body FROM lens WHERE id % 3 <> 0"))
def a31(spark, d):
    return published(spark, d)["bodies"].select("id", "chunk", "body")


@query("a32_export_csv", duck(r"SELECT 'k' || id AS key, title, regexp_replace(body, '[\r\n]+', ' ', 'g') AS notes, posted_date AS saved_at, CASE WHEN id % 2 = 0 THEN first_seen END AS applied_at FROM lens WHERE id % 3 = 1"))
def a32(spark, d):
    df, path = lens(spark, d).where("id % 3 = 1"), corpus.scratch(spark) + "/tracked"
    corpus.export_csv(df.select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), "title", F.col("body").alias("notes"), F.col("posted_date").alias("saved_at"), F.when(F.col("id") % 2 == 0, F.col("first_seen")).alias("applied_at")), path)
    return spark.read.csv(path, header=True, quote='"', escape='"', schema="key string, title string, notes string, saved_at timestamp, applied_at timestamp")


@query("a27_rejudge", duck("SELECT id FROM lens WHERE id % 3 = 0 OR is_entry"))
def a27(spark, d):
    df = lens(spark, d).withColumn("job_id", F.col("id").cast("string"))
    return payloads.rejudge(df, df.where("id % 3 = 0").select("company", "job_id"), F.struct(F.col("is_entry").alias("relevant"))).select("id")


@query("a29_build_catalog", "SELECT s_name AS company, CASE WHEN s_suppkey % 2 = 0 THEN 'greenhouse' ELSE 'generic' END AS platform, CASE WHEN s_suppkey % 2 = 0 THEN 's' || s_suppkey END AS slug, s_suppkey % 2 = 0 AS enabled FROM supplier")
def a29(spark, d):
    s = read(spark, d, "supplier")
    conn = s.where("s_suppkey % 2 = 0").select(F.col("s_name").alias("company"), F.lit("greenhouse").alias("platform"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("slug"))
    return corpus.build_catalog(s.select(F.col("s_name").alias("company")), conn)


# D: lifecycle


def stored_rows(df):
    return df.where("id % 5 <> 0").select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), "company", F.col("lang").alias("body"), "posted_date", "first_seen", "last_seen", F.lit("active").alias("status"), F.lit(0).alias("missed"), F.lit(None).cast("timestamp").alias("removed_at"))


def shard_rows(df):
    return df.where("id % 3 = 0").select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), "company", "body", "posted_date", "first_seen", F.expr(f"{CLOCK} - interval 1 day").alias("last_seen"), F.lit("active").alias("status"), F.lit(0).alias("missed"), F.lit(None).cast("timestamp").alias("removed_at"))


D_VIEWS = f"""
, stored AS (SELECT 'k' || id AS key, id, company, lang AS body, posted_date, first_seen, last_seen, 'active' AS status, 0 AS missed FROM lens WHERE id % 5 <> 0),
shard AS (SELECT 'k' || id AS key, id, company, body, posted_date, first_seen, {CLOCK} - INTERVAL '1' DAY AS last_seen, 'active' AS status, 0 AS missed FROM lens WHERE id % 3 = 0)
"""


@query("d01_match_existing", duck("SELECT 'i' || id AS in_id, 'k' || CASE WHEN id % 4 = 3 THEN (SELECT min(CAST(o.id AS VARCHAR)) FROM lens o WHERE o.company = l.company AND o.title = l.title AND o.location = l.location) ELSE CAST(id AS VARCHAR) END AS key, CAST(least(id % 4, 3) AS INT) AS tier FROM lens l WHERE id % 3 = 0 AND id % 4 <> 0"))
def d01(spark, d):
    """By job id, by url, by title and place; a quarter matches nothing."""
    df = lens(spark, d).withColumn("apply_url", F.concat(F.lit("https://x/"), F.col("id").cast("string")))
    k = F.col("id") % 4
    inc = df.where("id % 3 = 0").select(F.concat(F.lit("i"), F.col("id").cast("string")).alias("in_id"), F.concat(F.lit(" "), F.upper("company")).alias("company"), F.when(k == 1, F.col("id").cast("string")).alias("job_id"), F.when(k <= 2, F.when(k > 0, F.col("apply_url")).otherwise("https://y/")).alias("apply_url"), F.when(k == 0, "").otherwise(F.concat("title", F.lit(" (Remote)"))).alias("title"), "location")
    return lifecycle.match_existing(inc, df.select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), "company", F.col("id").cast("string").alias("job_id"), "apply_url", "title", "location"))


@query("d02_upsert", duck(D_VIEWS + f"""
, s AS (SELECT *, CASE WHEN id % 7 = 0 THEN {CLOCK} + INTERVAL '9' DAY WHEN id % 7 = 1 THEN NULL ELSE posted_date END AS p, 'https://old/' || id AS u FROM stored),
i AS (SELECT *, CASE WHEN id % 2 = 0 THEN posted_date END AS p, CASE WHEN id % 4 = 0 THEN '' ELSE 'https://new/' || id END AS u FROM shard)
SELECT coalesce(s.key, i.key) AS key, CASE WHEN i.key IS NOT NULL THEN {CLOCK} ELSE s.last_seen END AS last_seen,
  CASE WHEN i.key IS NOT NULL AND (s.p IS NULL OR s.p > {CLOCK} OR s.p < {CLOCK} - INTERVAL '1825' DAY) THEN i.p ELSE s.p END AS posted_date, CASE WHEN coalesce(i.u, '') <> '' THEN i.u ELSE s.u END AS apply_url,
  CASE WHEN s.key IS NULL THEN 'inserted' WHEN i.key IS NOT NULL AND length(coalesce(i.body, '')) > length(coalesce(s.body, '')) + 50 THEN 'replaced' WHEN i.key IS NOT NULL THEN 'refreshed' ELSE 'kept' END AS action,
  length(CASE WHEN s.key IS NULL OR length(coalesce(i.body, '')) > length(coalesce(s.body, '')) + 50 THEN i.body ELSE s.body END)::INT AS body_length FROM s FULL JOIN i ON s.key = i.key"""))
def d02(spark, d):
    df, n = lens(spark, d), F.substring("key", 2, 20).cast("long")
    s = stored_rows(df).withColumns({"posted_date": F.when(n % 7 == 0, clock() + F.expr("interval 9 days")).when(n % 7 != 1, F.col("posted_date")), "apply_url": F.concat(F.lit("https://old/"), n.cast("string"))})
    i = shard_rows(df).withColumns({"posted_date": F.when(n % 2 == 0, F.col("posted_date")), "apply_url": F.when(n % 4 == 0, "").otherwise(F.concat(F.lit("https://new/"), n.cast("string")))})
    return lifecycle.upsert(s, i, clock()).select("key", "last_seen", "posted_date", "apply_url", "action", F.length("body").alias("body_length"))


# title, role category, level, and whether its body lets it in
ENTERING = [("Senior Substation Engineer", "Power Systems", "Senior"), ("PLC Engineer", "Controls & Automation", "Unknown"), ("Software Engineer", None, None), ("Junior RF Engineer", "RF & Communications", "Junior"), ("Substation Electrician", None, None)]


@query("d03_insert_new", expected("role, lvl", [(r[1], r[2]) for r in ENTERING], "id, CASE WHEN id % 4 < 2 THEN 'Austin, TX' ELSE location || ', CA' END AS location, CASE WHEN id % 4 < 2 THEN 'TX' ELSE 'CA' END AS state, true AS is_usa, CASE WHEN id % 4 = 2 THEN 'Remote' WHEN id % 4 = 0 THEN 'Hybrid' ELSE 'Onsite' END AS remote_status, role AS role_category, CASE WHEN lvl = 'Unknown' THEN CASE WHEN id % 10 >= 8 THEN 'Principal' WHEN id % 10 >= 5 THEN 'Senior' WHEN id % 10 >= 3 THEN 'Mid-Level' ELSE 'Entry Level' END ELSE lvl END AS level, CAST(id % 10 AS INT) AS years_min") + " WHERE id % 3 = 1 AND id % 7 <> 0 AND role IS NOT NULL")
def d03(spark, d):
    """Levels from titles, years and work modes from whole bodies, which end with them."""
    df = posed(lens(spark, d), written=[r[0] for r in ENTERING])
    said = F.concat(F.lit(". Needs "), (F.col("id") % 10).cast("string"), F.lit("+ years"), F.when(F.col("id") % 4 == 2, ", remote").when(F.col("id") % 4 == 0, ", hybrid").otherwise(""))
    df = df.withColumns({"in_id": F.col("id").cast("string"), "title": F.concat_ws(" ", "written", "part_name"), "body": F.concat(F.repeat(F.lit("Plain words of no place. "), F.lit(21)), F.coalesce("body", F.lit("")), said)})
    inc = df.where("id % 3 = 1").select("id", "in_id", "company", F.col("in_id").alias("job_id"), F.when(F.col("id") % 4 < 2, F.lit("https://x.example.com/job/Austin--TX/apply")).otherwise(F.lit("https://x.example.com/")).alias("apply_url"), "title", F.when(F.col("id") % 4 < 2, F.lit("2 Locations")).otherwise(F.concat("location", F.lit(", CA"))).alias("location"), "body")
    old = df.where("id % 7 = 0").select(F.col("in_id").alias("key"), "company", F.col("in_id").alias("job_id"), F.lit("").alias("apply_url"), F.lit("").alias("title"), "location")
    out = lifecycle.insert_new(inc, lifecycle.match_existing(inc, old), titles.verdict(F.col("title"), F.col("body")))
    return out.select("id", "location", "state", "is_usa", "remote_status", "role_category", "level", "years_min")


@query("d04_reconcile_removals", duck(D_VIEWS + ", m AS (SELECT s.key, CASE WHEN s.company IN (SELECT company FROM shard) AND s.key NOT IN (SELECT key FROM shard) THEN s.id % 2 + 1 END AS m, s.id % 2 AS old FROM stored s) SELECT key, CAST(coalesce(m, old) AS INT) AS missed, CASE WHEN m >= 2 THEN 'removed' WHEN m IS NOT NULL THEN 'possibly_removed' ELSE 'active' END AS status FROM m"))
def d04(spark, d):
    df = lens(spark, d)
    s = stored_rows(df).withColumn("missed", (F.substring("key", 2, 20).cast("long") % 2).cast("int"))
    return lifecycle.reconcile_removals(s, shard_rows(df), clock()).select("key", "missed", "status")


OUTCOMES = "SELECT user_id AS company, CAST(ts AS DATE) AS run, count(*) FILTER (WHERE event_type = 'error') = 0 AS ok, count(*) FILTER (WHERE event_type = 'view') = 0 AS empty FROM events GROUP BY ALL"


def outcomes(spark, d):
    return read(spark, d, "events").groupBy(F.col("user_id").alias("company"), F.to_date("ts").alias("run")).agg((F.count_if(F.col("event_type") == "error") == 0).alias("ok"), (F.count_if(F.col("event_type") == "view") == 0).alias("empty"))


@query("d04_removal_history", f"WITH o AS ({OUTCOMES}), n AS (SELECT *, row_number() OVER w AS rn FROM o WINDOW w AS (PARTITION BY company ORDER BY run)), s AS (SELECT *, rn - coalesce(max(CASE WHEN NOT empty THEN rn END) OVER (PARTITION BY company ORDER BY run), 0) AS k FROM n) SELECT company, run, CAST(k AS INT) AS streak, CASE WHEN k = 0 THEN 'active' WHEN k >= 2 THEN 'removed' ELSE 'possibly_removed' END AS status FROM s")
def d04h(spark, d):
    return lifecycle.removal_history(outcomes(spark, d), "company", "run", ~F.col("empty")).select("company", "run", "streak", "status")


HEALTH = f"WITH o AS ({OUTCOMES}), n AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY run) AS rn FROM o), h AS (SELECT company, max(rn) - coalesce(max(rn) FILTER (WHERE ok), 0) AS e, max(rn) - coalesce(max(rn) FILTER (WHERE ok AND NOT empty), 0) AS z FROM n GROUP BY company)"


@query("d05_company_health", HEALTH + " SELECT company, CAST(e AS INT) AS error_count, CAST(z AS INT) AS empty_streak, e >= 8 AS quarantined, z >= 12 AS stalled FROM h")
def d05(spark, d):
    return lifecycle.company_health(outcomes(spark, d))


@query("d05_merged_health", HEALTH + " SELECT company, CAST(e AS INT) AS error_count, CAST(z AS INT) AS empty_streak, e >= 8 AS quarantined, z >= 12 AS stalled FROM h")
def d05_merged(spark, d):
    """The same from parts of a week each, of which the newer ones come to the older ones."""
    o, week = outcomes(spark, d), F.date_trunc("week", "run")
    hits = {"ok": F.col("ok"), "found": F.col("ok") & ~F.col("empty")}
    old, new = (lifecycle.streak_parts(o.where(x), "company", "run", week, hits) for x in ("run < '2024-01-15'", "run >= '2024-01-15'"))
    return lifecycle.health_of_parts(new.unionByName(old))


@query("d17_publishable", f"WITH o AS ({OUTCOMES}) SELECT run, count(*) AS planned, count(*) FILTER (WHERE ok) AS succeeded, count(*) FILTER (WHERE ok) > 0 AS publish FROM o GROUP BY run")
def d17(spark, d):
    return lifecycle.publishable(outcomes(spark, d))




def runs(spark, d):
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").cast("timestamp").alias("started_at"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("timestamp")).alias("finished_at"), F.col("o_orderpriority").alias("engine"))


@query("d06_prune_runs", "SELECT o_orderkey AS run_id FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def d06(spark, d):
    r = runs(spark, d)
    errors = r.select("run_id", F.lit("x").alias("message"))
    return lifecycle.prune_runs(r, errors, F.expr("TIMESTAMP '2030-01-01'"))[1].select("run_id")


@query("d07_browseable", duck("SELECT id FROM lens WHERE NOT is_senior AND (is_usa OR id % 5 = 0)"))
def d07(spark, d):
    return lifecycle.browseable(lens(spark, d).select("id", "is_usa", F.lit("active").alias("status"), (~F.col("is_senior")).alias("in_scope"), F.when(F.col("id") % 5 == 0, 0.0).otherwise(1.0).alias("confidence"))).select("id")


@query("d08_split", duck("SELECT is_usa AS live, count(*) AS n FROM lens WHERE NOT is_senior GROUP BY 1"))
def d08(spark, d):
    c = lifecycle.split_live_state(lens(spark, d).select(F.col("id").alias("key"), "is_usa", "body", F.lit("active").alias("status"), (~F.col("is_senior")).alias("in_scope"), F.lit(1.0).alias("confidence")))
    return c.live.select(F.lit(True).alias("live")).unionByName(c.state.select(F.lit(False).alias("live"))).groupBy("live").agg(F.count("*").alias("n"))


@query("d09_authoritative", duck(D_VIEWS + "SELECT key, company, 'old' AS origin FROM stored WHERE company NOT IN (SELECT company FROM lens WHERE state = 'ASIA') UNION ALL SELECT key, company, 'new' FROM shard WHERE company IN (SELECT company FROM lens WHERE state = 'ASIA')"))
def d09(spark, d):
    df = lens(spark, d)
    owned = df.where("state = 'ASIA'").select("company").distinct()
    shard = shard_rows(df).join(owned, "company", "left_semi").select("key", "company", F.lit("new").alias("origin"))
    return lifecycle.authoritative_replace(stored_rows(df).select("key", "company", F.lit("old").alias("origin")), shard, owned)


@query("d09_merge_shards", duck(D_VIEWS + ", s AS (SELECT key, company, id % 2 AS seq FROM shard), o AS (SELECT company, max(seq) AS seq FROM s GROUP BY company) SELECT key, company FROM stored WHERE company NOT IN (SELECT company FROM o) UNION ALL SELECT s.key, s.company FROM s JOIN o ON s.company = o.company AND s.seq = o.seq"))
def d09m(spark, d):
    df = lens(spark, d)
    return lifecycle.merge_shards(stored_rows(df).select("key", "company"), shard_rows(df).select("key", "company", (F.substring("key", 2, 20).cast("long") % 2).alias("seq")))


@query("d10_configured", duck("SELECT id FROM lens JOIN supplier ON s_name = company WHERE s_acctbal > 0"))
def d10(spark, d):
    return lifecycle.configured_only(lens(spark, d), read(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_name").alias("company"))).select("id")


@query("d11_retire_stale", duck(f"SELECT id, last_seen < {CLOCK} - INTERVAL '2' DAY AS retired FROM lens"))
def d11(spark, d):
    live, gone = lifecycle.retire_stale(lens(spark, d).select("id", "last_seen"), clock(), 2)
    return live.select("id", F.lit(False).alias("retired")).unionByName(gone.select("id", F.lit(True).alias("retired")))


@query("d12_purge", duck(f"SELECT id FROM lens WHERE posted_date IS NULL OR posted_date >= {CLOCK} - INTERVAL '35' DAY"))
def d12(spark, d):
    return lifecycle.purge_removed(lens(spark, d).select("id", F.col("posted_date").alias("removed_at")), clock(), 35).select("id")


@query("d13_keep_newest", duck("SELECT company, role_category, arg_max(id, struct_pack(a := last_seen, b := id)) AS id FROM lens GROUP BY ALL"))
def d13(spark, d):
    return lifecycle.keep_newest(lens(spark, d), ["company", "role_category"], F.desc("last_seen"), F.desc("id")).select("company", "role_category", "id")


@query("d14_live_beats_state", duck(D_VIEWS + "SELECT key FROM shard WHERE key NOT IN (SELECT key FROM stored)"))
def d14(spark, d):
    df = lens(spark, d)
    return lifecycle.live_beats_state(shard_rows(df).select("key"), stored_rows(df)).select("key")


@query("d15_union_runs", "SELECT engine, CAST(started_at AS TIMESTAMP) AS started_at, orders FROM (SELECT o_orderpriority AS engine, o_orderdate AS started_at, count(*) FILTER (WHERE o_orderkey % 2 = 1) AS new_n, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS old_n, CASE WHEN new_n > 0 THEN new_n ELSE old_n END AS orders FROM orders GROUP BY 1, 2) ORDER BY started_at DESC, engine LIMIT 30")
def d15(spark, d):
    def log(k):
        return runs(spark, d).where(f"run_id % 2 = {k}").groupBy(F.col("engine").alias("triggered_by"), "started_at").agg(F.count("*").alias("orders"))

    return lifecycle.union_runs(log(0), log(1)).select(F.col("triggered_by").alias("engine"), "started_at", "orders")


@query("d16_bodies", duck(D_VIEWS + "SELECT s.key, length(coalesce(i.body, s.body))::INT AS n FROM stored s LEFT JOIN shard i ON s.key = i.key"))
def d16(spark, d):
    df = lens(spark, d)
    s = stored_rows(df)
    return lifecycle.upsert_bodies(s.select("key", "body"), shard_rows(df).select("key", "body"), s).select("key", F.length("body").alias("n"))


@query("d18_restore_health", HEALTH + " SELECT s_suppkey AS company, CAST(coalesce(e, 0) AS INT) AS error_count, CAST(coalesce(z, 0) AS INT) AS empty_streak FROM supplier LEFT JOIN h ON h.company = s_suppkey")
def d18(spark, d):
    return lifecycle.restore_health(read(spark, d, "supplier").select(F.col("s_suppkey").alias("company")), lifecycle.company_health(outcomes(spark, d)))


@query("d19_fill_missing", duck("SELECT id, coalesce(posted_date, first_seen) AS posted_date, posted_date IS NULL AS changed FROM lens"))
def d19(spark, d):
    return lifecycle.fill_missing(lens(spark, d).select("id", "posted_date", "first_seen"), {"posted_date": F.col("first_seen")}).select("id", "posted_date", "changed")


BAND = "CASE WHEN {0} >= 90 THEN 90 WHEN {0} >= 75 THEN 75 WHEN {0} >= 60 THEN 60 WHEN {0} >= 46 THEN 46 ELSE 0 END"


@query("d20_flag_report", duck("""
SELECT 'is_usa' AS flag, count(*) FILTER (is_usa) AS before, count(*) FILTER (is_usa AND id % 3 <> 0) AS after, count(*) FILTER (is_usa AND id % 3 = 0) AS lost, CAST(0 AS BIGINT) AS gained FROM lens
UNION ALL SELECT 'is_senior', count(*) FILTER (is_senior), count(*) FILTER (is_entry), count(*) FILTER (is_senior AND NOT is_entry), count(*) FILTER (is_entry AND NOT is_senior) FROM lens"""))
def d20_flags(spark, d):
    df = lens(spark, d)
    after = df.select("id", (F.col("is_usa") & (F.col("id") % 3 != 0)).alias("is_usa"), F.col("is_entry").alias("is_senior"))
    return lifecycle.flag_report(df.select("id", "is_usa", "is_senior"), after, "id", ["is_usa", "is_senior"])


@query("d20_rescore_report", duck(f"SELECT CAST(band AS INT) AS band, CAST(sum(a) AS BIGINT) AS before, CAST(sum(b) AS BIGINT) AS after FROM (SELECT {BAND.format('match_score')} AS band, 1 AS a, 0 AS b FROM lens UNION ALL SELECT {BAND.format('new_grad_fit')}, 0, 1 FROM lens) GROUP BY 1"))
def d20(spark, d):
    df = lens(spark, d)
    return lifecycle.rescore_report(df.select("id", F.col("match_score").alias("s")), df.select("id", F.col("new_grad_fit").alias("s")), "id", "s")


@query("d21_overlay_marks", duck("SELECT id, CASE WHEN id % 7 = 0 THEN 'saved' ELSE 'none' END AS application_status FROM lens"))
def d21(spark, d):
    df = lens(spark, d).withColumn("key", F.col("id"))
    return lifecycle.overlay_marks(df, df.where("id % 7 = 0").select("key", F.lit("saved").alias("status"), F.lit("n").alias("notes"))).select("id", "application_status")


@query("d22_merge_marks", duck("SELECT id AS key, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN 'applied' WHEN id % 5 = 0 THEN 'saved' END AS status, CASE WHEN id % 5 = 0 THEN 'n' END AS notes FROM lens WHERE id % 5 = 0 OR id % 3 = 0"))
def d22(spark, d):
    df = lens(spark, d)
    cur = df.where("id % 5 = 0").select(F.col("id").alias("key"), F.lit("saved").alias("status"), F.lit("n").alias("notes"))
    return lifecycle.merge_marks(cur, df.where("id % 3 = 0").select(F.col("id").alias("key"), F.when(F.col("id") % 2 == 0, "applied").alias("status"), F.lit(None).cast("string").alias("notes")))


KINDS = "CASE event_type WHEN 'view' THEN 'saved' WHEN 'click' THEN 'applied' WHEN 'purchase' THEN 'interview' ELSE 'ignored' END"


@query("d23_fold_status", f"WITH e AS (SELECT user_id AS key, event_id, ts, {KINDS} AS status FROM events) SELECT key, arg_max(status, struct_pack(a := ts, b := event_id)) AS status, CAST(min(ts) FILTER (WHERE status = 'saved') AS TIMESTAMP) AS saved_at, CAST(min(ts) FILTER (WHERE status IN ('applied', 'interview')) AS TIMESTAMP) AS applied_at, CAST(min(ts) FILTER (WHERE status = 'ignored') AS TIMESTAMP) AS ignored_at FROM e GROUP BY key")
def d23(spark, d):
    return lifecycle.fold_status(read(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.expr(KINDS).alias("status")))


@query("d24_active_profile", "SELECT owner, id FROM (SELECT c_nationkey AS owner, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment = 'BUILDING' DESC, c_custkey DESC) AS rn FROM customer) WHERE rn = 1")
def d24(spark, d):
    return lifecycle.active_profile(read(spark, d, "customer").select(F.col("c_nationkey").alias("owner"), F.col("c_custkey").alias("id"), (F.col("c_mktsegment") == "BUILDING").alias("is_active"))).select("owner", "id")


# E: filters, each a saved search over the lens


#: The end of some bodies, for searches of words with signs.
SAYS = "coalesce(body, '') || CASE WHEN id % 9 = 0 THEN ' (C++)' WHEN id % 9 = 1 THEN ' c++x' ELSE '' END"


def searched(token, whole=True):
    """DuckDB: a token in some field of the lens."""
    short = ("title", "'n' || CAST(id % 13 AS VARCHAR) || 'orm'", "company", "role_category", "CASE WHEN is_senior THEN 'Senior' WHEN is_entry THEN 'Entry Level' ELSE 'Mid' END", "state", "location", "platform", "array_to_string(skills[1:3], ' ')")
    hits = [f"contains(lower({c}), '{token}')" for c in short]
    for c in (SAYS, "CASE WHEN id % 17 = 0 THEN 'whole posting: deep-term' ELSE '' END", "substr(coalesce(body, ''), 1, 300)"):
        hits.append(f"contains(' ' || regexp_replace(lower({c}), '[,.;:()/\\[\\]{{}}|\\n\\r\\t\"''*•·-]', ' ', 'g') || ' ', ' {token} ')" if whole else f"contains(lower({c}), '{token}')")
    return "(" + " OR ".join(hits) + ")"


def searchable(spark, d):
    """The lens with all that searches look at."""
    df = with_skills(lens(spark, d)).withColumns({"status": F.when(F.col("id") % 6 == 5, "removed").otherwise("active"), "keywords": F.slice("skills", 1, 3), "norm_title": F.concat(F.lit("n"), (F.col("id") % 13).cast("string"), F.lit("orm")), "full_text": F.when(F.col("id") % 17 == 0, "whole posting: deep-term"), "snippet": F.substring(F.coalesce("body", F.lit("")), 1, 300), "confidence": F.when(F.col("id") % 5 == 0, 0.0).otherwise(0.9), "experience_level": F.when(F.col("is_senior"), "Senior").when(F.col("is_entry"), "Entry Level").otherwise("Mid"), "remote_status": F.col("platform"), "role_flags": F.create_map(F.lower("role_category"), F.lit(True)), "sponsors_h1b": F.when(F.col("id") % 3 < 2, F.col("id") % 3 == 0)})
    return df.withColumn("body", F.concat(F.coalesce("body", F.lit("")), F.when(F.col("id") % 9 == 0, " (C++)").when(F.col("id") % 9 == 1, " c++x").otherwise("")))


def filtered(name, f, where, mode="strict"):
    @query(name, duck(f"SELECT id FROM skilled WHERE {where}"))
    def run(spark, d):
        df = searchable(spark, d)
        df = df.withColumn("role_category", F.when(F.lit(f.hide_software) & (F.col("role_category") == "PROMO"), "Software / Compiler").otherwise(F.col("role_category")))
        return df.where(filters.predicate(f, clock(), mode)).select("id")


Q = filters.Filters
for _name, _f, _where, *_mode in (
    ("e01_status", Q(status="active", include_senior=True), "id % 6 <> 5"),
    ("e02_company", Q(company="Supplier#000000001", include_senior=True), "company = 'Supplier#000000001'"),
    ("e02_company_contains", Q(company="#00000000", include_senior=True), "contains(company, '#00000000')", "contains"),
    ("e04_priority", Q(priority="S", include_senior=True), "priority = 'S'"),
    ("e05_category", Q(role_category="large", include_senior=True), "role_category = 'LARGE'"),
    ("e06_experience", Q(experience_level="entry", include_senior=True), "is_entry AND NOT is_senior"),
    ("e07_level_senior", Q(level_filter="senior"), "is_senior"),
    ("e07_level_label", Q(level_filter="Mid"), "NOT is_senior AND NOT is_entry"),
    ("e07_level_list", Q(level_filter=("Entry Level", "senior")), "is_senior OR is_entry"),
    ("e08_remote", Q(remote="src1", include_senior=True), "contains(platform, 'src1')"),
    ("e09_min_score", Q(min_score=60, include_senior=True), "new_grad_fit >= 60"),
    ("e10_usa_only", Q(usa_only=True, include_senior=True), "is_usa"),
    ("e10_usa_unknown", Q(usa_only=True, include_unknown=True, include_senior=True), "is_usa OR id % 5 = 0"),
    ("e11_senior_gate", Q(), "NOT is_senior"),
    ("e11_senior_contains", Q(include_senior=False, priority="S"), "NOT is_senior AND priority = 'S'", "contains"),
    ("e12_state", Q(state="asia", include_senior=True), "state = 'ASIA'"),
    ("e13_seen_within", Q(seen_within_hours=24 * 29, include_senior=True), f"first_seen >= {CLOCK} - INTERVAL '29' DAY"),
    ("e14_posted_within", Q(posted_within_hours=24 * 33, include_senior=True), f"coalesce(posted_date, first_seen) >= {CLOCK} - INTERVAL '33' DAY"),
    ("e15_keyword", Q(keyword="ring the"), f"{searched('ring')} AND {searched('the')}"),
    ("e15_keyword_signs", Q(keyword="c++"), searched("c++")),
    ("e15_keyword_fields", Q(keyword="n5orm deep"), f"{searched('n5orm')} AND {searched('deep')}"),
    ("e15_keyword_contains", Q(keyword="rin"), searched("rin", False), "contains"),
    ("e16_skills", Q(skills=("the", "with"), include_senior=True), " AND ".join(f"(list_contains(skills[1:3], '{k}') OR contains(lower(substr(coalesce(body, ''), 1, 300)), '{k}'))" for k in ("the", "with"))),
    ("e17_view_best", Q(view="best", include_senior=True), "new_grad_fit >= 65"),
    ("e18_hide_software", Q(hide_software=True, include_senior=True), "role_category <> 'PROMO'"),
    ("e19_hidden", Q(hidden=("SMALL", "PROMO"), include_senior=True), "role_category NOT IN ('SMALL', 'PROMO')"),
    ("e20_role_flag", Q(role_flag="large", include_senior=True), "role_category = 'LARGE'"),
    ("e21_h1b", Q(h1b_only=True, include_senior=True), "id % 3 = 0 AND eligibility_risk = 'low'"),
):
    filtered(_name, _f, _where, *_mode)


@query("e03_company_ids", duck("SELECT id FROM lens JOIN supplier ON s_name = company WHERE s_suppkey IN (1, 3, 5)"))
def e03(spark, d):
    return lifecycle.configured_only(lens(spark, d), read(spark, d, "supplier").where("s_suppkey in (1, 3, 5)").select(F.col("s_name").alias("company"))).select("id")


@query("e22_tracked", duck("SELECT id FROM lens WHERE id % 7 = 0 OR id % 11 = 0"))
def e22(spark, d):
    return filters.tracked(lens(spark, d).withColumn("application_status", F.when(F.col("id") % 7 == 0, "saved").when(F.col("id") % 11 == 0, "applied"))).select("id")


@query("e23_directory", "SELECT s_name AS company FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE contains(lower(s_name), '1') AND n_regionkey = 1")
def e23(spark, d):
    s = read(spark, d, "supplier").join(F.broadcast(read(spark, d, "nation")), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_name").alias("company"), F.col("n_regionkey").cast("string").alias("sector"), F.lit(1).alias("viewable"))
    return filters.directory_filter(s, "1", "1").where(F.contains("company", F.lit("1"))).select("company")


@query("e24_alerts", duck("SELECT id FROM lens WHERE match_score >= 75 AND priority IN ('S', 'A') AND is_entry"))
def e24(spark, d):
    return lens(spark, d).where(filters.alert_predicate()).select("id")


# F: ranking

SEARCHES = ("ring promo", "promo ring", "Large", "SUPPLIER", "und")
RANK_SQL = """
, p AS (SELECT id, company, role_category, skills, CASE id % 3 WHEN 0 THEN title WHEN 1 THEN part_name ELSE replace(part_name, ' ', '  ') END AS t FROM skilled),
q AS (SELECT p.*, q, lower(t) AS l, regexp_replace(lower(t), ' +', ' ', 'g') AS n, string_split(q, ' ') AS w FROM p, (VALUES ('ring promo'), ('promo ring'), ('large'), ('supplier'), ('und')) s(q))
SELECT id, q, CAST(CASE WHEN contains(l, q) THEN 100 WHEN contains(n, q) THEN 92 WHEN contains(lower(company), q) THEN 88
  WHEN len(w) > 1 AND len(list_filter(w, lambda x: NOT contains(l, x))) = 0 THEN 75 WHEN len(list_filter(skills, lambda k: contains(k, q))) > 0 THEN 60
  WHEN contains(lower(role_category), q) THEN 55 WHEN len(list_filter(w, lambda x: contains(l, x))) > 0 THEN 40 ELSE 10 END AS INT) AS tier FROM q"""


@query("f01_keyword_rank", duck(RANK_SQL))
def f01(spark, d):
    k = F.col("id") % 3
    title = F.when(k == 0, F.col("title")).when(k == 1, F.col("part_name")).otherwise(F.replace("part_name", F.lit(" "), F.lit("  ")))
    df = with_skills(lens(spark, d)).withColumns({"title": title, "keywords": F.col("skills")})
    tiers = F.array(*[F.struct(F.lit(q.lower()).alias("q"), ranking.keyword_rank(q).alias("tier")) for q in SEARCHES])
    return df.select("id", F.explode(tiers).alias("x")).select("id", "x.*")


@query("f02_sort_page", duck("SELECT id FROM lens ORDER BY posted_date DESC NULLS LAST, match_score DESC, first_seen DESC, id LIMIT 100"))
def f02(spark, d):
    return ranking.page(lens(spark, d), ranking.order_keys("posted"), 1, 100).select("id")


ORDER = "match_score DESC NULLS LAST, match_score DESC, first_seen DESC, id"


@query("f03_group_roles", duck(f"SELECT id, company, title, match_score, group_count FROM (SELECT *, count(*) OVER (PARTITION BY lower(company), lower(title)) AS group_count, row_number() OVER (PARTITION BY lower(company), lower(title) ORDER BY {ORDER}) AS rn FROM lens WHERE NOT is_senior) WHERE rn = 1"))
def f03(spark, d):
    df = lens(spark, d).where(~F.col("is_senior"))
    return ranking.group_roles(df, ranking.order_keys()).select("id", "company", "title", "match_score", "group_count")


@query("f04_group_count", duck(f"SELECT f.id, c.n AS group_count FROM (SELECT id, lower(company) AS c, lower(title) AS t, row_number() OVER (PARTITION BY lower(company), lower(title) ORDER BY {ORDER}) AS rn FROM lens WHERE is_usa) f JOIN (SELECT lower(company) AS c, lower(title) AS t, count(*) AS n FROM lens GROUP BY ALL) c ON f.c = c.c AND f.t = c.t WHERE rn = 1"))
def f04(spark, d):
    df = lens(spark, d)
    return ranking.group_roles(df.where("is_usa"), ranking.order_keys(), df).select("id", "group_count")


@query("f05_group_canonical", duck(f"SELECT b.id, array_to_string(list_sort(list_filter(g.l, lambda x: x <> b.location)), ',') AS other, g.n AS group_count FROM (SELECT *, row_number() OVER (PARTITION BY state, role_category ORDER BY {ORDER}) AS rn FROM lens) b JOIN (SELECT state, role_category, list(DISTINCT location) AS l, count(*) AS n FROM lens GROUP BY ALL) g ON g.state = b.state AND g.role_category = b.role_category WHERE rn = 1"))
def f05(spark, d):
    out = ranking.group_canonical(lens(spark, d), ranking.order_keys(), F.concat_ws("|", "state", "role_category"))
    return out.select("id", F.array_join("other_locations", ",").alias("other"), "group_count")


@query("f06_envelope", duck("SELECT count(*) AS total, CAST(2 AS INT) AS page, CAST(greatest(ceil(count(*) / 25.0), 1) AS BIGINT) AS pages, 2 < greatest(ceil(count(*) / 25.0), 1) AS has_next, true AS has_prev FROM lens"))
def f06(spark, d):
    return ranking.envelope(lens(spark, d), 2, 25)


@query("f07_siblings", duck("SELECT id, other, CAST(n AS INT) AS n FROM (SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY b.location, b.id) AS n FROM lens a JOIN lens b ON a.company = b.company AND a.role_category = b.role_category AND a.id <> b.id) WHERE n <= 50"))
def f07(spark, d):
    return ranking.siblings(lens(spark, d).withColumn("title", F.col("role_category")))


LIKE_SQL = """
, p AS (SELECT a.id, b.id AS other, b.company AS oc, b.title AS ot, b.new_grad_fit AS f,
  CAST(CASE WHEN a.role_category = b.role_category THEN 4 ELSE 0 END + CASE WHEN a.lang IS NOT DISTINCT FROM b.lang THEN 2 ELSE 0 END + CASE WHEN a.is_senior = b.is_senior THEN 1 ELSE 0 END
    + CASE WHEN a.priority = b.priority THEN 1 ELSE 0 END + least(4, len(list_intersect(a.skills, b.skills))) + CASE WHEN a.company <> b.company THEN 1 ELSE 0 END AS INT) AS score
  FROM skilled a JOIN skilled b ON a.id <> b.id AND (a.role_category = b.role_category OR a.company = b.company)),
o AS (SELECT *, row_number() OVER (PARTITION BY id, oc, ot ORDER BY score DESC, f DESC, other) AS r FROM p)
SELECT id, other, score, CAST(n AS INT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, f DESC, other) AS n FROM o WHERE r = 1) WHERE n <= 6"""


@query("f08_similar", duck(LIKE_SQL))
def f08(spark, d):
    return ranking.similar(with_skills(lens(spark, d)).withColumn("level", F.col("lang")))


@query("f09_similar_skills", duck(", p AS (SELECT a.id, b.id AS other, CAST(len(list_intersect(a.skills, b.skills)) + CASE WHEN a.role_category = b.role_category THEN 2 ELSE 0 END AS INT) AS score FROM skilled a JOIN skilled b ON a.id <> b.id) SELECT id, other, score, CAST(n AS INT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS n FROM p WHERE score > 0) WHERE n <= 6"))
def f09(spark, d):
    return ranking.similar_by_skills(with_skills(lens(spark, d)))


@query("f10_suggest", duck("""
, r AS (SELECT 0 AS o, 'company' AS kind, 3 AS most, company AS value FROM lens UNION ALL SELECT 1, 'title', 8, title FROM lens UNION ALL SELECT 2, 'role_category', 3, role_category FROM lens),
h AS (SELECT o, kind, most, value, count(*) AS n FROM r WHERE contains(lower(value), 're') GROUP BY ALL),
u AS (SELECT *, row_number() OVER (PARTITION BY lower(value) ORDER BY o, n DESC, value) AS u FROM h),
b AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY starts_with(lower(value), 're') DESC, n DESC, value) AS b FROM u WHERE u = 1)
SELECT kind, value, n FROM b WHERE b <= most"""))
def f10(spark, d):
    return ranking.suggest(lens(spark, d), "re")


@query("f12_directory_order", duck("SELECT sector, company, CAST(row_number() OVER (ORDER BY sector, n > 0 DESC, strpos('SABC', priority), n DESC, company) AS INT) AS place FROM (SELECT state AS sector, company, priority, count(*) FILTER (is_senior) AS n FROM lens GROUP BY ALL)"))
def f12(spark, d):
    by = lens(spark, d).groupBy("company", "priority", F.col("state").alias("sector")).agg(F.count_if("is_senior").alias("viewable"))
    return ranking.directory_order(by).select("sector", "company", "place")


@query("f13_newest", "SELECT o_orderkey AS run_id FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def f13(spark, d):
    return ranking.newest(runs(spark, d), "started_at", 20, "run_id").select("run_id")


# G: marts


@query("g01_facets", duck("SELECT facet, value, n FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS r FROM (SELECT 'role_category' AS facet, role_category AS value, count(*) AS n FROM lens GROUP BY 2 UNION ALL SELECT 'priority', priority, count(*) FROM lens GROUP BY 2 UNION ALL SELECT 'platform', platform, count(*) FROM lens GROUP BY 2 UNION ALL SELECT 'state', state, count(*) FROM lens GROUP BY 2 UNION ALL SELECT 'total', 'all', count(*) FROM lens UNION ALL SELECT unnest(['entry', 'friendly', 'senior', 'remote', 'new_day']), 'all', unnest([count(*) FILTER (is_entry OR priority = 'S'), count(*) FILTER (priority = 'S'), count(*) FILTER (is_senior), count(*) FILTER (contains(platform, '1')), count(*) FILTER (coalesce(posted_date, first_seen) >= TIMESTAMP '2024-01-30 00:00:00')]) FROM lens)) WHERE facet <> 'state' OR r <= 15"))
def g01(spark, d):
    df = lens(spark, d).withColumns({"friendly": F.col("priority") == "S", "remote_status": F.when(F.contains("platform", F.lit("1")), "Remote").otherwise("Onsite")})
    return marts.facets(df, clock())


@query("g02_dashboard", duck(f"SELECT count(*) AS total, count(*) FILTER (is_usa) AS usa, count(*) FILTER (is_entry) AS entry, count(*) FILTER (is_senior) AS senior, count(*) FILTER (is_usa AND is_entry) AS usa_entry, count(*) FILTER (first_seen >= {CLOCK} - INTERVAL '1' DAY) AS new_day, count(*) FILTER (first_seen >= {CLOCK} - INTERVAL '7' DAY) AS new_week, count(*) FILTER (first_seen >= {CLOCK} - INTERVAL '30' DAY) AS new_month, count(*) FILTER (match_score >= 75) AS strong, count(*) FILTER (new_grad_fit >= 65) AS best, count(posted_date) AS dated, count(*) FILTER (eligibility_risk = 'high') AS high_risk, count(*) FILTER (priority = 'S') AS tier_s, count(DISTINCT company) AS companies, count(*) FILTER (NOT is_usa) AS non_usa, count(*) FILTER (role_category = 'PROMO') AS software FROM lens"))
def g02(spark, d):
    kind = F.when(F.col("role_category") == "PROMO", "Software / Compiler").otherwise(F.col("role_category"))
    return marts.dashboard(lens(spark, d).withColumn("role_category", kind), clock())


G02_SQL = f"""
, s AS (SELECT *, CASE id % 7 WHEN 0 THEN 'saved' WHEN 1 THEN 'applied' WHEN 2 THEN 'removed' ELSE 'active' END AS status, CASE WHEN id % 4 = 0 THEN 0.0 ELSE 0.9 END AS conf, id % 6 = 0 AS friendly, role_category = 'PROMO' AS software FROM lens),
v AS (SELECT *, status = 'active' AND (is_usa OR conf = 0) AND NOT software AS view FROM s)
SELECT count(*) FILTER (view) AS total_active, count(*) FILTER (view AND coalesce(posted_date, first_seen) >= {CLOCK} - INTERVAL '25' DAY) AS new_24h, count(*) FILTER (view AND (is_entry OR friendly) AND NOT is_senior) AS entry_level,
  count(*) FILTER (view AND is_entry AND NOT is_senior) AS strict_entry, count(*) FILTER (view AND friendly AND NOT is_entry AND NOT is_senior) AS candidate_friendly, count(*) FILTER (status = 'active' AND is_usa) AS usa_count,
  count(*) FILTER (view AND id % 9 < 2) AS remote_count, count(*) FILTER (view AND is_senior) AS senior_filtered, count(*) FILTER (view AND new_grad_fit >= 70) AS high_score, count(*) FILTER (view AND new_grad_fit >= 75) AS strong_new_grad,
  count(*) AS total_in_db, count(*) FILTER (status = 'active') AS active_all, count(*) FILTER (status = 'active' AND NOT is_usa AND conf <> 0) AS non_usa_filtered, count(*) FILTER (status = 'active' AND software) AS software_filtered,
  count(*) FILTER (status = 'saved') AS saved, count(*) FILTER (status = 'applied') AS applied,
  (SELECT CAST(sum(o_orderkey) AS BIGINT) FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)) AS scanned_last_run
FROM v"""


@query("g02_inventory", duck(G02_SQL))
def g02_inventory(spark, d):
    i = F.col("id")
    status = F.when(i % 7 == 0, "saved").when(i % 7 == 1, "applied").when(i % 7 == 2, "removed").otherwise("active")
    remote = F.when(i % 9 == 0, "Remote").when(i % 9 == 1, "remote").when(i % 9 == 2, "Not remote")
    df = lens(spark, d).withColumns({"active_status": status, "location_confidence": F.when(i % 4 != 0, 0.9), "friendly": F.when(i % 6 == 0, F.lit(True)), "is_software": F.col("role_category") == "PROMO", "remote_status": remote})
    days = read(spark, d, "orders").groupBy(F.col("o_orderdate").alias("started_at")).agg(F.sum("o_orderkey").alias("jobs_found"))
    return marts.inventory(df, days, clock() - F.make_dt_interval(F.lit(24)))  # no posting is from the last day


@query("g03_company_stats", duck(f"SELECT company, count(*) AS total, count(*) FILTER (is_usa) AS usa, count(*) FILTER (is_entry) AS entry, count(*) FILTER (match_score > 0) AS relevant, count(*) FILTER (is_usa AND NOT is_senior) AS viewable, count(*) FILTER (first_seen >= {CLOCK} - INTERVAL '1' DAY) AS new_today, avg(match_score) AS avg_score FROM lens GROUP BY 1"))
def g03(spark, d):
    return marts.company_stats(lens(spark, d), clock())


TALLY = f"SELECT company, count(*) AS total, count(*) FILTER (is_usa) AS usa, count(*) FILTER (is_usa AND NOT is_senior) AS viewable, count(*) FILTER (is_usa AND NOT is_senior AND is_entry) AS entry, count(*) FILTER (is_usa AND NOT is_senior AND first_seen >= {CLOCK} - INTERVAL '1' DAY) AS new_today, count(DISTINCT title) FILTER (is_usa AND NOT is_senior) AS \"unique\" FROM lens GROUP BY 1"


def tallies(spark, d):
    return marts.company_tallies(lens(spark, d).withColumn("dup_group", F.col("title")), clock())


@query("g04_company_tallies", duck(TALLY))
def g04(spark, d):
    return tallies(spark, d)


@query("g05_company_entries", duck(f", t AS ({TALLY}), q AS (SELECT company AS c, avg(id % 90) FILTER (id % 90 <> 0) AS q FROM lens GROUP BY 1) SELECT s_name AS company, CAST(coalesce(round_even(q, 0), 0) AS BIGINT) AS parser_confidence, coalesce(total, 0) AS total, coalesce(usa, 0) AS usa, coalesce(viewable, 0) AS viewable, CASE WHEN s_suppkey % 9 = 8 THEN 'quarantined' WHEN s_suppkey % 9 > 2 THEN 'error' WHEN s_suppkey % 5 = 0 THEN 'stalled' WHEN total > 0 THEN 'ok' ELSE 'idle' END AS status FROM supplier LEFT JOIN t ON company = s_name LEFT JOIN q ON c = s_name"))
def g05(spark, d):
    s = read(spark, d, "supplier")
    health = s.select(F.col("s_name").alias("company"), (F.col("s_suppkey") % 9).alias("error_count"), (F.col("s_suppkey") % 9 == 8).alias("quarantined"), (F.col("s_suppkey") % 5 == 0).alias("stalled"))
    confidence = marts.company_confidence(lens(spark, d).withColumn("data_quality_score", F.col("id") % 90))
    return marts.company_entries(s.select(F.col("s_name").alias("company")), tallies(spark, d).join(confidence, "company"), health)


@query("g06_corpus_counts", duck("SELECT count(*) AS total, count(DISTINCT coalesce(CASE WHEN id % 2 = 0 THEN title END, CAST(id AS VARCHAR))) AS unique_visible FROM lens"))
def g06(spark, d):
    return marts.corpus_counts(lens(spark, d).withColumn("dup_group", F.when(F.col("id") % 2 == 0, F.col("title"))))


@query("g08_skill_gaps_simple", duck("SELECT skill, count(*) AS n FROM (SELECT unnest(skills) AS skill FROM skilled WHERE is_usa) WHERE skill NOT IN ('the', 'and') GROUP BY 1 ORDER BY n DESC, skill LIMIT 12"))
def g08(spark, d):
    df = with_skills(lens(spark, d)).where("is_usa")
    return marts.skill_gaps_simple(df, df.select(F.explode(F.array(F.lit("the"), F.lit("and"))).alias("skill")).distinct())


G09_SQL = """
WITH g AS (SELECT o_orderpriority AS engine, max(o_orderdate) FILTER (WHERE o_orderstatus <> 'P') AS good FROM orders GROUP BY 1),
c AS (SELECT engine, CAST(good AS TIMESTAMP) AS last_good, CASE substr(engine, 1, 1) WHEN '1' THEN 4000 WHEN '2' THEN 1500 ELSE 100 + 9900 * (ascii(engine) % 2) END AS hours, epoch(TIMESTAMP '1999-01-01' - good) / 3600 AS age FROM g),
s AS (SELECT engine, last_good, CASE WHEN last_good IS NULL OR age > 4 * hours THEN 'down' WHEN age > 2 * hours THEN 'stale' ELSE 'ok' END AS status FROM c)
SELECT *, CASE WHEN (SELECT count(*) FROM s WHERE status = 'down') > 0 THEN 'down' WHEN (SELECT count(*) FROM s WHERE status = 'stale') > 0 THEN 'stale' ELSE 'ok' END AS overall FROM s"""


@query("g09_pipeline_health", G09_SQL)
def g09(spark, d):
    r = runs(spark, d).select("engine", "started_at", F.col("finished_at").isNotNull().alias("finished"), F.lit(1).alias("companies"))
    first = F.substring("engine", 1, 1)
    hours = F.when(first == "1", 4000).when(first == "2", 1500).otherwise(100 + 9900 * (F.ascii("engine") % 2))
    return marts.pipeline_health(r, r.select("engine").distinct().withColumn("hours", hours), F.expr("TIMESTAMP '1999-01-01'"))


@query("g10_attention", HEALTH + " SELECT company, kind, CAST(row_number() OVER (ORDER BY kind, e DESC, z DESC, company) AS INT) AS place FROM (SELECT *, CASE WHEN e >= 3 OR z >= 3 THEN 'attention' ELSE 'erroring' END AS kind FROM h WHERE e >= 3 OR z >= 3 OR e > 0)")
def g10(spark, d):
    return marts.attention(lifecycle.company_health(outcomes(spark, d), 3, 3)).select("company", "kind", "place")


@query("g11_sector_summary", duck(f", t AS ({TALLY}) SELECT n_name AS sector, count(*) AS companies, count(*) FILTER (coalesce(viewable, 0) > 0) AS hiring, CAST(sum(coalesce(usa, 0)) AS BIGINT) AS us_roles FROM supplier JOIN nation ON n_nationkey = s_nationkey LEFT JOIN t ON company = s_name GROUP BY 1"))
def g11(spark, d):
    s = read(spark, d, "supplier").join(F.broadcast(read(spark, d, "nation")), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_name").alias("company"), F.col("n_name").alias("sector"))
    none = s.select("company", F.lit(0).alias("error_count"), F.lit(False).alias("quarantined"), F.lit(False).alias("stalled"))
    return marts.sector_summary(marts.company_entries(s, tallies(spark, d), none))


@query("g12_board_yield", duck("""
, b AS (SELECT company, title, role_category, is_usa, is_entry AS k, NOT is_entry AND NOT is_senior AS m FROM lens)
SELECT company, CAST(sum(n) AS BIGINT) AS listed, CAST(sum(k) AS BIGINT) AS keep, CAST(sum(us) AS BIGINT) AS us_keep, CAST(sum(m) AS BIGINT) AS maybe, coalesce(string_agg(role_category || '=' || k, ',' ORDER BY role_category) FILTER (k > 0), '') AS categories,
  coalesce(array_to_string(any_value(t)[1:6], '|'), '') AS samples
FROM (SELECT company, role_category, count(*) AS n, count(*) FILTER (k) AS k, count(*) FILTER (k AND is_usa) AS us, count(*) FILTER (m) AS m FROM b GROUP BY ALL)
LEFT JOIN (SELECT company, list_sort(list(DISTINCT title)) AS t FROM b WHERE k GROUP BY 1) s USING (company) GROUP BY company"""))
def g12(spark, d):
    m = marts.board_yield(lens(spark, d).withColumns({"relevant": F.col("is_entry"), "maybe": ~F.col("is_senior")}))
    kept = F.transform(F.array_sort(F.map_entries("categories")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return m.select("company", "listed", "keep", "us_keep", "maybe", F.array_join(kept, ",").alias("categories"), F.array_join("samples", "|").alias("samples"))


@query("g13_run_totals", "SELECT CAST(ts AS DATE) AS run, count(DISTINCT user_id) AS companies, count(*) AS found, count(*) FILTER (event_type = 'signup') AS new, count(*) FILTER (event_type = 'purchase') AS removed, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1")
def g13(spark, d):
    return marts.run_totals(read(spark, d, "events").select(F.to_date("ts").alias("run"), F.col("user_id").alias("company"), F.lit(1).alias("found"), *[(F.col("event_type") == e).cast("long").alias(k) for k, e in (("new", "signup"), ("removed", "purchase"))], (F.col("event_type") == "error").alias("error")))


# H: a profile per conversation (skills of its user turns) against all postings


def profiles(spark, d):
    t = with_skills(read(spark, d, "conversations").where("role = 'user'").select("conv_id", F.coalesce("text", F.lit("")).alias("body")))
    p = t.groupBy("conv_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("skills")))).alias("skills"))
    focus = F.element_at(F.array(*[F.lit(x) for x in ("LARGE", "MEDIUM", "SMALL", "ECONOMY", "General")]), (F.col("conv_id") % 5 + 1).cast("int"))
    made = [F.struct(F.lit(name).alias("name"), F.slice("skills", at, 1).alias("skills")) for at, name in enumerate(("first", "second", "third"), 1)]
    projects = F.slice(F.filter(F.array(*made), lambda x: F.size(x["skills"]) > 0), 1, (F.col("conv_id") % 4).cast("int"))
    return p.select(F.col("conv_id").alias("profile_id"), "skills", projects.alias("projects"), focus.alias("focus"), (F.col("conv_id") % 6).cast("double").alias("years"))


def pairs_sql(which: str) -> str:
    """All scores of the pairs of a profile and a posting for which `which` holds."""
    return f"""
, u AS (SELECT conv_id, {", ".join(f"max(CASE WHEN contains(' ' || regexp_replace(lower(coalesce(text, '')), '[^a-z]+', ' ', 'g') || ' ', ' {s} ') THEN 1 ELSE 0 END) AS h{i}" for i, s in enumerate(SKILLS))} FROM conversations WHERE role = 'user' GROUP BY conv_id),
pr AS (SELECT conv_id AS profile_id, list_sort(list_filter([{", ".join(f"CASE WHEN h{i} = 1 THEN '{s}' END" for i, s in enumerate(SKILLS))}], lambda x: x IS NOT NULL)) AS own, ['LARGE', 'MEDIUM', 'SMALL', 'ECONOMY', 'General'][conv_id % 5 + 1] AS focus, conv_id % 6 AS years FROM u),
j AS (SELECT p.*, s.id, s.skills, s.role_category, s.new_grad_fit, s.experienced_fit, s.eligibility_risk, s.is_usa, s.is_senior, len(list_intersect(s.skills, p.own)) AS m, len(s.skills) AS n FROM pr p JOIN skilled s ON {which}),
k AS (SELECT *, CASE WHEN n = 0 THEN 45 ELSE CAST(round_even(100 * (0.5 * m / n + 0.5 * least(1.0, m / 8.0)), 0) AS INT) END AS sk, len(list_intersect(own[1:least(3, profile_id % 4)], skills)) AS backs,
  [40, 70, 90, 100][backs + 1] AS pj,
  CASE WHEN focus = role_category THEN 100 WHEN (focus, role_category) IN (('LARGE', 'MEDIUM'), ('MEDIUM', 'LARGE'), ('SMALL', 'ECONOMY'), ('ECONOMY', 'SMALL')) THEN 85 WHEN focus = 'General' THEN 70 ELSE 55 END AS dm,
  CASE WHEN len(list_intersect(skills, ['the', 'und', 'les'])) = 0 THEN 60 ELSE CAST(round_even(100 * CAST(len(list_intersect(list_intersect(skills, ['the', 'und', 'les']), own)) AS DOUBLE) / len(list_intersect(skills, ['the', 'und', 'les'])), 0) AS INT) END AS tl FROM j),
o AS (SELECT *, CAST(round_even((50 * sk + 20 * pj + 20 * dm + 10 * tl) / 100.0, 0) AS INT) AS overlap, CASE WHEN years < 3 THEN new_grad_fit ELSE experienced_fit END AS fit FROM k),
r AS (SELECT *, CAST(round_even((55 * overlap + 45 * fit) / 100.0, 0) AS INT) AS resume_match, CAST(55 * fit + 45 * overlap - 100 * CASE eligibility_risk WHEN 'high' THEN 12 WHEN 'medium' THEN 5 ELSE 0 END AS INT) AS priority_x100, CAST(round_even((55 * overlap + 2250 * least(2, backs)) / 100.0, 0) AS INT) AS defensibility FROM o)
"""


#: Pairs that share a skill, and all pairs.
H_SQL, ALL_SQL = pairs_sql("len(list_intersect(s.skills, p.own)) > 0"), pairs_sql("true")


TOOLS = ("the", "und", "les")


def best(spark, d):
    return matching.top_matches(profiles(spark, d), with_skills(lens(spark, d)), tools=TOOLS)


@query("h01_h08_match", duck(ALL_SQL + "SELECT profile_id, count(*) AS n, CAST(sum(sk) AS BIGINT) AS skills_score, CAST(sum(pj) AS BIGINT) AS project_score, CAST(sum(dm) AS BIGINT) AS domain_score, CAST(sum(tl) AS BIGINT) AS tool_score, CAST(sum(resume_match) AS BIGINT) AS resume_match, CAST(sum(priority_x100) AS BIGINT) AS priority, count(*) FILTER (priority_x100 >= 7200) AS high, count(*) FILTER (priority_x100 BETWEEN 5200 AND 7199) AS medium, CAST(sum(defensibility) AS BIGINT) AS defensibility FROM r GROUP BY 1"))
def h01(spark, d):
    """All postings for every profile."""
    high = {"high": F.col("apply_priority") == "High", "medium": F.col("apply_priority") == "Medium"}
    measures = {c: F.col(c) for c in ("skills_score", "project_score", "domain_score", "tool_score", "resume_match")} | {"priority": F.col("priority_x100")} | {k: v.cast("int") for k, v in high.items()} | {"defensibility": F.col("defensibility")}
    return matching.totals(profiles(spark, d), with_skills(lens(spark, d)).drop("body"), measures, tools=TOOLS)


TOP_SQL = ALL_SQL + ", b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY resume_match DESC, priority_x100 DESC, id) AS place FROM r) WHERE place <= 5)"


@query("h11_top_matches", duck(TOP_SQL + "SELECT profile_id, id, resume_match, CAST(place AS INT) AS place FROM b"))
def h11(spark, d):
    return best(spark, d).select("profile_id", "id", "resume_match", "place")


@query("h10_why", duck(TOP_SQL + """
, c AS (SELECT *, list_filter(skills, lambda x: list_contains(own, x)) AS hit, list_filter(['first', 'second', 'third'][1:least(3, profile_id % 4)], lambda x, i: list_contains(skills, own[i])) AS named FROM b)
SELECT profile_id, id, array_to_string(list_filter([CASE WHEN len(hit) > 0 THEN 'Shares ' || array_to_string(hit[1:4], ', ') END, CASE WHEN len(named) > 0 THEN 'Backed by ' || array_to_string(named[1:2], ', ') END,
  CASE WHEN dm >= 85 THEN 'Close to your field' END, CASE WHEN fit >= 75 THEN 'Fits your level' END], lambda x: x IS NOT NULL), '; ') AS why FROM c"""))
def h10(spark, d):
    return matching.why(best(spark, d)).select("profile_id", "id", F.array_join("why", "; ").alias("why"))


@query("h15_missing_keywords", duck(TOP_SQL + ", c AS (SELECT profile_id, id, skills, list_filter(skills, lambda x: NOT list_contains(own, x)) AS gone FROM b) SELECT profile_id, id, array_to_string((CASE WHEN len(gone) > 0 THEN gone ELSE skills END)[1:6], ',') AS keywords FROM c"))
def h15(spark, d):
    return best(spark, d).select("profile_id", "id", F.array_join(matching.missing_keywords(F.col("missing"), F.col("skills")), ",").alias("keywords"))


@query("h09_triage", duck(H_SQL + ", miss AS (SELECT profile_id, id, unnest(list_filter(skills, lambda x: NOT list_contains(own, x))) AS skill, own FROM r) SELECT profile_id, id, skill, CASE WHEN skill = 'por' THEN 'Safe to Add' WHEN skill = 'the' AND list_contains(own, 'and') THEN 'Reword Only' WHEN skill IN ('the', 'und') AND (list_contains(own, 'nicht') OR list_contains(own, 'that')) THEN 'Learn First' ELSE 'Do Not Add' END AS tier FROM miss"))
def h09(spark, d):
    who = profiles(spark, d)
    rows = read(spark, d, "region").where("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, "the").otherwise("und").alias("skill"), F.when(F.col("r_regionkey") == 0, F.array(F.lit("and"))).otherwise(F.expr("cast(array() as array<string>)")).alias("equal"), F.array(F.lit("nicht"), F.lit("that")).alias("area"))
    return matching.triage_matches(who, with_skills(lens(spark, d)), rows, who.select("profile_id", F.explode(F.concat(F.transform("skills", lambda x: F.struct(x.alias("skill"), F.lit(False).alias("in_project"))), F.array(F.struct(F.lit("por").alias("skill"), F.lit(True).alias("in_project"))))).alias("x")).select("profile_id", "x.*"))


@query("f11_rank_matches", duck(ALL_SQL + "SELECT profile_id, id, CAST(place AS INT) AS place FROM (SELECT r.profile_id, r.id, row_number() OVER (PARTITION BY r.profile_id ORDER BY r.priority_x100 DESC NULLS LAST, l.match_score DESC, r.id) AS place FROM r JOIN lens l ON l.id = r.id) WHERE place <= 3"))
def f11(spark, d):
    top = matching.top_matches(profiles(spark, d), with_skills(lens(spark, d)), 3, TOOLS, order=("priority_x100", "match_score"))
    return ranking.rank_matches(top, "apply_priority").select("profile_id", "id", "place")


@query("g07_skill_gaps", duck(ALL_SQL + ", pool AS (SELECT * FROM r WHERE resume_match >= 45 AND is_usa AND NOT is_senior) SELECT skill, count(*) AS n, (SELECT count(*) FROM pool) AS pool FROM (SELECT unnest(list_filter(skills, lambda x: NOT list_contains(own, x))) AS skill FROM pool) GROUP BY 1 ORDER BY n DESC, skill LIMIT 15"))
def g07(spark, d):
    pool = with_skills(lens(spark, d)).where("is_usa and not is_senior")
    return marts.skill_gaps(matching.weighted_matches(profiles(spark, d), pool, TOOLS))


# I: a saved search per supplier


def watchlists(spark, d):
    kinds = F.array(*[F.lit(x) for x in ("LARGE", "MEDIUM", "SMALL", "ECONOMY", "PROMO", "STANDARD")])
    k = F.col("s_suppkey")
    return read(spark, d, "supplier").select(k.alias("watch_id"), F.when(k % 2 == 0, F.element_at(kinds, (k % 6 + 1).cast("int"))).alias("role_category"), F.when(k % 3 == 0, F.lit("ASIA")).alias("state"), F.when(k % 5 == 0, F.lit("S")).alias("priority"), (k % 100).cast("int").alias("min_score"), (k % 7 == 0).alias("usa_only"), F.expr("TIMESTAMP '2024-01-01 12:00:00'").alias("since"), F.when(k % 11 == 1, "R#00000000").alias("company"), F.when(k % 13 == 2, "SRC1").alias("remote"), F.when(k % 17 == 3, "Ring").alias("keyword"), F.when(k % 19 == 4, "en").alias("level"), (k % 4 != 1).alias("include_senior"), F.when(k % 23 == 5, F.array(F.lit("is_entry"), F.lit("no_such_flag"))).alias("role_flags"))


def searched_postings(spark, d):
    return lens(spark, d).withColumns({"remote_status": F.col("platform"), "level": F.col("lang")})


W_SQL = """
, w AS (SELECT s_suppkey AS watch_id, CASE WHEN s_suppkey % 2 = 0 THEN ['LARGE', 'MEDIUM', 'SMALL', 'ECONOMY', 'PROMO', 'STANDARD'][s_suppkey % 6 + 1] END AS c, CASE WHEN s_suppkey % 3 = 0 THEN 'ASIA' END AS s, CASE WHEN s_suppkey % 5 = 0 THEN 'S' END AS p, s_suppkey % 100 AS m, s_suppkey % 7 = 0 AS usa, s_suppkey AS k FROM supplier),
h AS (SELECT w.watch_id, l.*, l.first_seen >= TIMESTAMP '2024-01-01 12:00:00' AS is_new FROM w JOIN lens l ON (c IS NULL OR c = role_category) AND (s IS NULL OR s = state) AND (p IS NULL OR p = priority) AND new_grad_fit >= m AND (NOT usa OR is_usa)
  AND (k % 11 <> 1 OR contains(lower(company), 'r#00000000')) AND (k % 13 <> 2 OR contains(lower(platform), 'src1')) AND (k % 17 <> 3 OR contains(lower(title || ' ' || company || ' ' || role_category), 'ring'))
  AND (k % 19 <> 4 OR coalesce(lang = 'en', false)) AND (k % 4 <> 1 OR NOT is_senior) AND (k % 23 <> 5 OR is_entry)),
n AS (SELECT w.watch_id, count(h.id) AS total, count(h.id) FILTER (is_new) AS new FROM w LEFT JOIN h ON h.watch_id = w.watch_id GROUP BY 1)
"""


@query("i01_watchlist_counts", duck(W_SQL + "SELECT watch_id, total, new FROM n"))
def i01(spark, d):
    return alerts.watchlist_counts(watchlists(spark, d), searched_postings(spark, d))


@query("i02_watchlist_delta", duck(W_SQL + "SELECT watch_id, total, greatest(0, total - watch_id % 50) AS delta FROM n"))
def i02(spark, d):
    w = watchlists(spark, d)
    return alerts.watchlist_delta(alerts.watchlist_counts(w, searched_postings(spark, d)), w.select("watch_id", (F.col("watch_id") % 50).alias("last_count")))


@query("i03_watchlist_alerts", duck(W_SQL + "SELECT watch_id, count(*) AS new, count(*) || ' new, latest: ' || arg_max(title, struct_pack(a := first_seen, b := id)) || ' at ' || arg_max(company, struct_pack(a := first_seen, b := id)) AS message FROM h WHERE is_new GROUP BY 1"))
def i03(spark, d):
    return alerts.watchlist_alerts(watchlists(spark, d), searched_postings(spark, d), clock())[0]


@query("i04_digest", duck(f", t AS (SELECT 'apply_today' AS segment, 8 AS most, * FROM lens WHERE new_grad_fit >= 80 AND NOT is_senior UNION ALL SELECT 'top_tier', 8, * FROM lens WHERE priority = 'S' UNION ALL SELECT 'matches', 8, * FROM lens WHERE match_score >= 50 UNION ALL SELECT 'risk', 6, * FROM lens WHERE eligibility_risk = 'high' UNION ALL SELECT 'new_week', 8, * FROM lens WHERE first_seen >= {CLOCK} - INTERVAL '7' DAY UNION ALL SELECT 'entry', 8, * FROM lens WHERE is_entry) SELECT segment, CAST(place AS INT) AS place, id FROM (SELECT segment, most, id, row_number() OVER (PARTITION BY segment ORDER BY match_score DESC, first_seen DESC, id) AS place FROM t) WHERE place <= most"))
def i04(spark, d):
    return alerts.digest(lens(spark, d), clock())


@query("i05_posting_alerts", duck("SELECT id, title || ' at ' || company || ' (' || match_score || ')' AS message FROM lens WHERE match_score >= 75 AND priority IN ('S', 'A') AND is_entry"))
def i05(spark, d):
    return alerts.posting_alerts(lens(spark, d), filters.alert_predicate())


# J: audits


J01_CHECKS = [(f"level {x}", "lvl = '%s'" % x, "false") for x in audits.LEVELS] + [
    ("no senior by default", "NOT is_senior", "false"), ("country", "is_usa", "false"), ("country or unknown place", "is_usa OR id % 5 = 0", "false"),
    *[(f"posted within {h}", f"eff >= {CLOCK} - INTERVAL '{h}' HOUR", "false") for h in (24, 168, 720, 2160)], ("least fit 75", "new_grad_fit >= 75", "false"), ("remote", "platform LIKE '%src1%'", "false"),
    ("state", "state = 'ASIA'", "false"), ("category", "role_category = 'LARGE'", "false"), ("company", "company = 'Supplier#000000001'", "false"), ("keyword", "contains(lower(title), 'ring') OR regexp_matches(lower(coalesce(body, '')), '(^|[ ,.;:()/\\[\\]{}|\\n\\r\\t\"''*•·-])ring($|[ ,.;:()/\\[\\]{}|\\n\\r\\t\"''*•·-])')", "false"),
    *[(f"posted within {a} in posted within {b}", f"eff >= {CLOCK} - INTERVAL '{a}' HOUR", "false") for a, b in ((24, 168), (168, 720), (720, 2160))],
    ("new grads are no entry level", "lvl IN ('New Grad', 'Entry Level')", "false"), ("seniors if wanted", "is_senior", "false"),
]
J01_SQL = ", p AS (SELECT *, CASE WHEN is_senior THEN 'Senior' WHEN is_entry AND id % 2 = 0 THEN 'New Grad' WHEN is_entry THEN 'Entry Level' ELSE 'Mid-Level' END AS lvl, coalesce(posted_date, first_seen) AS eff FROM lens) " + " UNION ALL ".join(
    f"SELECT '{k}' AS \"check\", count(*) FILTER ({n}) AS n, count(*) FILTER ({v}) AS violations, true AS ok FROM p" for k, n, v in J01_CHECKS)


def audited(spark, d):
    level = F.when(F.col("is_senior"), "Senior").when(F.col("is_entry") & (F.col("id") % 2 == 0), "New Grad").when(F.col("is_entry"), "Entry Level").otherwise("Mid-Level")
    return lens(spark, d).withColumns({"experience_level": level, "confidence": F.when(F.col("id") % 5 == 0, 0.0).otherwise(0.9), "remote_status": F.col("platform"), "norm_title": F.lower("title"), "keywords": F.expr("cast(array() as array<string>)"), "snippet": F.lit(""), "full_text": F.lit("")})


@query("j01_audit_filters", duck(J01_SQL))
def j01(spark, d):
    """The searches are run, and their rows looked at by conditions of the audit's own."""
    return audits.audit_filters(audited(spark, d), clock(), state="asia", role="large", company="Supplier#000000001", remote="src1", word="ring")


@query("j02_audit_stale", duck("SELECT 'match_score' AS \"column\", count(*) FILTER (id % 4 = 0 AND match_score <> 0) AS mismatches FROM lens UNION ALL SELECT 'is_entry', 0 FROM lens GROUP BY 1"))
def j02(spark, d):
    df = lens(spark, d).select("id", "match_score", "is_entry")
    return audits.audit_stale(df.withColumn("match_score", F.when(F.col("id") % 4 == 0, 0).otherwise(F.col("match_score"))), df, "id", ["match_score", "is_entry"])


@query("j03_diagnose", duck("SELECT count(*) AS total, count(*) FILTER (is_usa) AS usa, count(*) FILTER (posted_date IS NULL) AS undated, count(*) FILTER (is_senior AND new_grad_fit >= 60) AS senior_leaks, count(*) FILTER (new_grad_fit < 60) AS low_fit, count(*) FILTER (id % 5 < 2) AS unplaced, count(*) FILTER (is_senior) AS senior, count(*) FILTER (role_category = 'PROMO') AS software FROM lens"))
def j03(spark, d):
    return audits.diagnose(lens(spark, d).withColumns({"confidence": F.when(F.col("id") % 5 == 0, 0.0).when(F.col("id") % 5 > 1, 0.9), "is_software": F.col("role_category") == "PROMO"}))


J04_SQL = """
SELECT 'has slug' AS "check", count(*) FILTER (s_suppkey % 7 <> 0) AS n, count(*) FILTER (s_suppkey % 7 <> 0 AND s_suppkey % 4 = 0) AS violations FROM supplier
UNION ALL SELECT 'own board', count(*) FILTER (s_suppkey % 7 <> 0 AND s_suppkey % 4 <> 0), count(*) FILTER (s_suppkey % 7 <> 0 AND s_suppkey % 4 <> 0 AND s_suppkey % 9 = 0) FROM supplier
UNION ALL SELECT 'slug agrees with url', count(*) FILTER (s_suppkey % 7 <> 0 AND s_suppkey % 4 <> 0), count(*) FILTER (s_suppkey % 7 <> 0 AND s_suppkey % 4 = 1) FROM supplier
UNION ALL SELECT 'classified', count(*), count(*) FILTER (s_suppkey % 11 = 0) FROM supplier"""


@query("j04_audit_catalog", f'SELECT "check", n, violations, violations = 0 AS ok FROM ({J04_SQL})')
def j04(spark, d):
    k = F.col("s_suppkey")
    s = read(spark, d, "supplier").withColumn("company", F.col("s_name"))
    slug = F.when(k % 4 != 0, F.concat(F.lit("Board"), k.cast("string")))
    url = F.when(k % 4 == 1, "https://x/none").when(k % 4 == 2, F.concat(F.lit("https://x/board"), k.cast("string"), F.lit(".com/jobs"))).otherwise(F.concat(F.lit("https://x/"), slug, F.lit("-us")))
    catalog = s.select("company", F.lit("Lever").alias("platform"), url.alias("url"), slug.alias("slug"), (k % 7 != 0).alias("enabled"))
    foreign = s.where(k % 9 == 0).select(F.lit("lever").alias("platform"), F.concat(F.lit("board"), k.cast("string")).alias("slug"))
    return audits.audit_catalog(catalog, s.where(k % 11 != 0), foreign)


@query("j05_reconcile", duck("SELECT count(*) AS total, count(*) FILTER (WHERE company NOT LIKE '%7') AS summed, count(*) FILTER (WHERE company LIKE '%7') = 0 AS ok FROM lens"))
def j05(spark, d):
    df = lens(spark, d)
    return audits.reconcile_counts(df, marts.company_stats(df.where("company not like '%7'"), clock()), "company", "total")


@query("b09_identity_of_pages", "SELECT lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1")
def b09h(spark, d):
    return read(spark, d, "pages").groupBy(identity.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))

"""Landed JSON payloads to raw postings: one specification per platform, read by from_json and explode."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import relative_date, strip_tags

RAW = ("company", "platform", "job_id", "job_title", "location", "apply_url", "posted_date", "body")


@dataclass(frozen=True)
class Spec:
    """Payload schema (DDL), path of the list of postings, and an SQL expression for each field over `j`.

    `age` is a text such as "Posted 3 Days Ago", read against the clock where there is no date; with `once` a job_id that
    comes again at its company, here or in another payload, is one row.
    """

    schema: str
    path: str
    job_id: str
    job_title: str
    location: str
    apply_url: str
    posted_date: str
    body: str
    where: str = "true"
    age: str | None = None
    once: bool = False


SPECS = {
    "greenhouse": Spec("jobs array<struct<id:bigint,title:string,absolute_url:string,location:struct<name:string>,updated_at:string,published_at:string,content:string>>", "jobs", "cast(j.id as string)", "j.title", "j.location.name", "j.absolute_url", "try_to_timestamp(coalesce(j.updated_at, j.published_at))", "j.content"),
    "lever": Spec("postings array<struct<id:string,text:string,hostedUrl:string,applyUrl:string,createdAt:bigint,categories:struct<location:string>,lists:array<struct<content:string>>>>", "postings", "j.id", "j.text", "j.categories.location", "coalesce(j.hostedUrl, j.applyUrl)", "timestamp_millis(j.createdAt)", "array_join(transform(j.lists, x -> x.content), ' ')"),
    "ashby": Spec("jobs array<struct<id:string,title:string,location:string,secondaryLocations:array<struct<location:string>>,isListed:boolean,isRemote:boolean,jobUrl:string,publishedAt:string,descriptionHtml:string>>", "jobs", "j.id", "j.title", "concat(coalesce(j.location, try_element_at(j.secondaryLocations, 1).location), case when j.isRemote and not contains(lower(coalesce(j.location, '')), 'remote') then ' (Remote)' else '' end)", "j.jobUrl", "try_to_timestamp(j.publishedAt)", "j.descriptionHtml", "coalesce(j.isListed, true)"),
    "workday": Spec("jobPostings array<struct<title:string,externalPath:string,locationsText:string,primaryLocation:string,postedOn:string>>", "jobPostings", "element_at(split(j.externalPath, '/'), -1)", "j.title", "coalesce(nullif(j.locationsText, ''), j.primaryLocation)", "j.externalPath", "cast(null as timestamp)", "cast('' as string)", "element_at(split(j.externalPath, '/'), -1) <> ''", "j.postedOn", True),
    "smartrecruiters": Spec("content array<struct<id:string,name:string,location:struct<fullLocation:string,city:string,region:string,country:string>,releasedDate:string,ref:string,company:struct<identifier:string>>>", "content", "j.id", "j.name", "coalesce(j.location.fullLocation, concat_ws(', ', j.location.city, j.location.region, upper(j.location.country)))", "coalesce(concat('https://jobs.smartrecruiters.com/', j.company.identifier, '/', j.id), j.ref)", "try_to_timestamp(j.releasedDate)", "cast('' as string)", "trim(j.name) <> '' and j.id <> ''"),
    "eightfold": Spec("positions array<struct<id:bigint,name:string,locations:array<string>,postedTs:bigint,creationTs:bigint,publicUrl:string>>", "positions", "cast(j.id as string)", "j.name", "array_join(j.locations, '; ')", "j.publicUrl", "timestamp_seconds(coalesce(j.postedTs, j.creationTs))", "cast('' as string)"),
    "phenom": Spec("jobs array<struct<req_id:string,slug:string,title:string,city:string,state:string,country:string,posted_date:string,apply_url:string,description:string>>", "jobs", "coalesce(j.req_id, j.slug)", "j.title", "concat_ws(', ', j.city, j.state, j.country)", "j.apply_url", "coalesce(try_to_timestamp(j.posted_date), try_to_timestamp(j.posted_date, 'MMMM d, yyyy'))", "j.description"),
    "jibe": Spec("jobs array<struct<data:struct<slug:string,title:string,city:string,state:string,country:string,full_location:string,job_url:string,apply_url:string,posted_date:string,description:string>>>", "jobs", "j.data.slug", "j.data.title", "coalesce(nullif(concat_ws(', ', j.data.city, j.data.state, j.data.country), ''), j.data.full_location)", "coalesce(j.data.job_url, j.data.apply_url)", "try_to_timestamp(j.data.posted_date)", "j.data.description"),
    "oracle": Spec("items array<struct<requisitionList:array<struct<Id:string,Title:string,PrimaryLocation:string,PostedDate:string,ShortDescriptionStr:string>>>>", "items[0].requisitionList", "j.Id", "j.Title", "j.PrimaryLocation", "concat('/job/', j.Id)", "try_to_timestamp(j.PostedDate)", "coalesce(j.ShortDescriptionStr, j.Title)"),
    "jobs2web": Spec("jobs array<struct<id:string,title:string,urltitle:string,location:string,date:string>>", "jobs", "j.id", "j.title", "j.location", "concat('/job/', coalesce(concat(j.urltitle, '/'), ''), j.id)", "try_to_timestamp(trim(replace(j.date, '[UTC]', '')))", "cast('' as string)"),
    "amazon": Spec("jobs array<struct<id:string,id_icims:string,title:string,normalized_location:string,job_path:string,posted_date:string,description:string,basic_qualifications:string>>", "jobs", "coalesce(j.id_icims, j.id)", "j.title", "j.normalized_location", "j.job_path", "try_to_timestamp(j.posted_date, 'MMMM d, yyyy')", "concat_ws(' ', j.description, j.basic_qualifications)"),
    "generic": Spec("jobs array<struct<id:string,title:string,location:string,url:string,date:string,body:string>>", "jobs", "j.id", "j.title", "j.location", "j.url", "try_to_timestamp(j.date)", "j.body"),
}


def normalise(raw: DataFrame, platform: str, as_of: Column | None = None) -> DataFrame:
    """raw(company, platform, body) of one platform to raw postings. Unreadable payloads give no rows; without a clock, ages give no date."""
    s = SPECS[platform]
    rows = raw.select("company", "platform", F.from_json("body", s.schema).alias("p")).select("company", "platform", F.explode(F.expr(f"p.{s.path}")).alias("j")).where(s.where)
    posted = relative_date(F.expr(s.age), as_of) if s.age and as_of is not None else F.expr(s.posted_date)
    out = rows.select("company", "platform", F.expr(s.job_id).alias("job_id"), F.expr(s.job_title).alias("job_title"), F.expr(s.location).alias("location"), F.expr(s.apply_url).alias("apply_url"), posted.alias("posted_date"), strip_tags(F.expr(s.body)).alias("body"))
    if not s.once:
        return out
    # payloads have no order among themselves, so of different rows of an id the least one stays
    rest = [c for c in RAW if c not in ("company", "platform", "job_id")]
    return out.groupBy("company", "platform", "job_id").agg(F.min(F.struct(*rest)).alias("r")).select("company", "platform", "job_id", "r.*")


def normalise_payloads(raw: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Payloads of all platforms in one scan, each read by the specification of its own; unknown ones as generic.

    Platforms whose ids come again are read once more, by themselves, as their rows have to meet.
    """
    fields = ("job_id", "job_title", "location", "apply_url", "posted_date", "age", "body")

    def items(k: str) -> Column:
        s = SPECS[k]
        values = ", ".join(f"'{f}', cast({getattr(s, f) or 'null'} as {'timestamp' if f == 'posted_date' else 'string'})" for f in fields)
        return F.expr(f"transform(filter(from_json(body, '{s.schema}').{s.path}, j -> coalesce({s.where}, false)), j -> named_struct({values}))")

    plain = [k for k, s in SPECS.items() if not s.once and k != "generic"]
    once = [k for k, s in SPECS.items() if s.once]
    of = F.col("platform")
    read = F.when(of.isin(*once), F.lit(None))
    for k in plain:
        read = read.when(of == k, items(k))
    rows = raw.select("company", "platform", F.explode(read.otherwise(items("generic"))).alias("j"))
    posted = F.col("j.posted_date") if as_of is None else F.when(F.col("j.age").isNull(), F.col("j.posted_date")).otherwise(relative_date(F.col("j.age"), as_of))
    out = rows.select("company", "platform", "j.job_id", "j.job_title", "j.location", "j.apply_url", posted.alias("posted_date"), strip_tags(F.col("j.body")).alias("body"))
    return reduce(DataFrame.unionByName, [normalise(raw.where(of == k), k, as_of) for k in once], out)


SECTIONS = ("jobDescription", "qualifications", "additionalInformation")


def section_details(raw: DataFrame) -> DataFrame:
    """raw(company, body), a detail page in JSON each, to what enrich_details takes: the sections that say anything, a line each, and the page's own url."""
    text = ", ".join(f"{s}:struct<text:string>" for s in SECTIONS)
    p = raw.select("company", F.from_json("body", f"id string, postingUrl string, jobAd struct<sections:struct<{text}>>").alias("p")).where("p.id <> ''")
    said = F.array_join(F.filter(F.array(*[strip_tags(F.col(f"p.jobAd.sections.{s}.text")) for s in SECTIONS]), lambda x: x != ""), "\n")
    none = F.lit(None).cast("string")
    return p.select("company", F.col("p.id").alias("job_id"), none.alias("location"), none.alias("country"), F.lit(None).cast("timestamp").alias("start_date"), F.nullif("p.postingUrl", F.lit("")).alias("url"), F.nullif(said, F.lit("")).alias("body"))


def enrich_details(listed: DataFrame, details: DataFrame) -> DataFrame:
    """List rows with what their detail page says: body, place where the list only counts places, country, exact date, url."""
    d = details.select("company", "job_id", F.col("body").alias("_b"), F.col("location").alias("_l"), F.col("country").alias("_c"), F.col("start_date").alias("_d"), F.col("url").alias("_u"))
    many = F.col("location").rlike(r"^\d+ Locations?$")
    place = F.when(many, F.coalesce("_l", "location")).otherwise(F.col("location"))
    place = F.when(F.col("_c").isNotNull() & ~F.contains(place, F.col("_c")), F.concat_ws(", ", place, F.col("_c"))).otherwise(place)
    j = listed.join(d, ["company", "job_id"], "left")
    return j.select("company", "platform", "job_id", "job_title", place.alias("location"), F.coalesce("_u", "apply_url").alias("apply_url"), F.coalesce("_d", "posted_date").alias("posted_date"), F.coalesce("_b", "body").alias("body"))


def first_seen(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row per key in reading order."""
    from ..operators.lifecycle import keep_newest

    return keep_newest(df, keys, *order)


def gate(df: DataFrame, verdict: Column, cap: int = 40, *order: Column) -> DataFrame:
    """Relevant rows, and up to `cap` undecided ones per company."""
    from pyspark.sql import Window as W

    j = df.withColumn("_v", verdict)
    maybe = F.col("_v.needs_description")
    j = j.withColumn("_m", F.row_number().over(W.partitionBy("company", maybe).orderBy(*order)))
    return j.where(F.col("_v.relevant") | (maybe & (F.col("_m") <= cap))).withColumn("maybe", maybe).drop("_v", "_m")


def known_ids(stored: DataFrame) -> DataFrame:
    return stored.where("body is not null and body <> ''").select("company", "job_id").distinct()


def detail_worklist(df: DataFrame, known: DataFrame, cap: int) -> DataFrame:
    """What to read in detail: not known, not foreign, relevant before undecided, at most cap per company."""
    from pyspark.sql import Window as W

    todo = df.join(known, ["company", "job_id"], "left_anti").where("not foreign")
    return todo.withColumn("place", F.row_number().over(W.partitionBy("company").orderBy("maybe", "job_id"))).where(F.col("place") <= cap)


def rejudge(df: DataFrame, known: DataFrame, verdict: Column) -> DataFrame:
    """Known rows pass; new ones only if relevant with their body."""
    k = known.withColumn("_known", F.lit(True))
    return df.join(k, ["company", "job_id"], "left").where(F.coalesce("_known", F.lit(False)) | verdict["relevant"]).drop("_known")

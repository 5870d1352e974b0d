"""Queries of the rule operators (B04, B07, B08, B10, B17, B18, C02 to C26) with expectations written from their rules."""

from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import identity as I
from ..functions import skills as S
from ..functions import text as X
from ..functions import titles as T
from ..operators import lifecycle, lookups
from .lens import duck, lens, read
from .posed import expected, literal, pick, posed, told
from .registry import query

# title, body, relevant, category, reason, needs_description
POWERFUL = "You will size transformers, set relays, run load flow and short circuit studies in ETAP"
CONTROLLING = "PLC and SCADA panels, HMI screens, ladder logic, wiring and schematics"
VAGUE = "Voltage, wiring, a conduit and a breaker"
NOTHING = "A team player with good coffee skills"
OUT = T.OUTSIDE
REJECTED = {
    # words of the field in programs, books, papers and pipes, each with a like title that stays
    "excluded: false friend": ["Power BI Engineer", "PowerApps and Power Apps Engineer", "Engineer for Export Controls", "Cost Control Engineer", "Wafer Fab Quality Controls Engineer", "Regional Controller", "Brand Protection Engineer", "Corrosion Protection Engineer",
        "Engineer, SDN Routing", "Test Automation Engineer", "Network Engineer, Campus", "Help Desk Engineer", "Water Transmission Main Engineer", "Engineer, Distribution Warehouse", "Lighting Director", "Wireless Store Advisor"],
    "excluded: not engineering": ["Grid Accountant", "Tax Counsel, Solar", "Relay Buyer", "Substation Project Manager", "Feeder Planner", "Energy Analyst", "Wind Farm Nurse", "Controls Sales Engineer"],
    "excluded: trade": ["Underground Splicer", "Controls Technician", "Switchgear Tech", "Wind Welder", "Relay Inspector"],
    "excluded: chip design": ["ASIC Floorplan Engineer", "Analog Circuit Design Engineer", "GPU Power Modelling Designer", "Wafer Test Engineer", "Data Converters Engineer"],
    "excluded: software": ["Backend Engineer, Metering", "Linux Kernel Engineer", "Cloud Grid Engineer", "ML Engineer, Wind", "Product Security Engineer", "Embedded Engineer"],
    "excluded: other discipline": ["Mechanical Engineer", "Civil Engineer, Wind Farms", "Thermal Hardware Engineer", "Quality Engineer, Relays and Hydraulics", "Electronics Materials Engineer", "Packaging Engineer"],
    "no engineering noun": ["Substation Specialist", "Solar Scientist", "Microgrid Lead"],
    "no electrical sign": ["Engineering Librarian", "Landscape Architect", "Transmission Engineer, Optical", "Interconnection Engineer, Network"],
}
ACCEPTED = {
    T.TRANSPORT: ["Traction Power Designer", "Railway Electrification Engineer", "High-Voltage Harness Engineer", "Avionics Integration Engineer", "Locomotive Electrical Engineer", "Powertrain Engineer", "EV Engineer"],
    T.EMC: ["EMC Chamber Engineer", "Power Integrity Engineer", "Avionic EMI Designer", "E3 Engineer"],
    T.POWER: ["Relaying Engineer", "P & C Designer", "Distribution Standards Engineer", "Power Flow Engineer", "Grid Reliability Engineer", "MV Switchgear Engineer", "HV Transformer Engineer", "HVDC Controls Engineer",
        "Nuclear Plant Electrical Engineer", "Engineer, T and D", "Arc-Flash Engineer", "Utility Telecom Engineer", "Power Quality Engineer", "Protection Software Engineer", "Underground Lines Engineer"],
    T.RENEWABLE: ["Hydropower Engineer", "Fuel Cells Engineer", "Microgrids Designer", "Battery Systems Engineer", "Wind Inverter Engineer", "PV Controls Engineer", "Scientist, Clean Energy and Grid"],
    T.INSTRUMENTS: ["I & C Designer", "Instrument and Control Engineer", "Metrology Engineer", "Analyzer Engineer", "Sensors Engineer Automation"],
    T.CONVERSION: ["Rectifier Engineer", "DC/DC Designer", "Motor Drives Controls Engineer", "UPS Systems Engineer", "Power Management Engineer", "SiC Engineer"],
    T.CONTROLS: ["Robotics Engineer", "BMS Engineer", "PLC Programmer Robotics", "DCS Software Developer Engineer", "Motor Controller Engineer Automation", "Safety Instrumented Engineer", "Mechatronics Designer"],
    T.MACHINES: ["Stator Winding Engineer", "Alternators Engineer", "Rotating Machines Engineer", "Generator Radar Engineer"],
    T.RADIO: ["Radar Engineer", "Telecom Engineer", "Beamforming Engineer", "Satellite Communications Engineer", "Optical Communications Engineer", "Network Engineer, Radio"],
    T.BUILDINGS: ["Data Centre Engineer", "MEP Designer", "Fire Alarm Engineer", "Lighting Engineer", "Electrical Construction Engineer", "Mission-Critical Engineer"],
    T.INDUSTRIAL: ["Refinery Electrical Engineer", "Electrical Site Engineer", "Pulp Mill Electronics Engineer", "Oil Field Electrical Engineer Technician"],
    T.DESIGN: ["Schematic Designer", "PCB Engineer", "Wiring Engineer", "Electronics Mechanical Engineer", "Panel Design Engineer", "Hardware Design Engineer"],
}
#: What the title names although it is rejected.
BESIDE = {"Wafer Fab Quality Controls Engineer": T.CONTROLS, "Engineer for Export Controls": T.CONTROLS, "Cost Control Engineer": T.CONTROLS, "Brand Protection Engineer": T.POWER, "Corrosion Protection Engineer": T.POWER, "Test Automation Engineer": T.CONTROLS,
    "Water Transmission Main Engineer": T.POWER, "Lighting Director": T.BUILDINGS, "Wireless Store Advisor": T.RADIO, "Tax Counsel, Solar": T.RENEWABLE, "Substation Project Manager": T.POWER, "Wind Farm Nurse": T.RENEWABLE, "Controls Sales Engineer": T.CONTROLS,
    "Controls Technician": T.CONTROLS, "Switchgear Tech": T.POWER, "Wind Welder": T.RENEWABLE, "Analog Circuit Design Engineer": T.DESIGN, "Data Converters Engineer": T.CONVERSION, "Backend Engineer, Metering": T.POWER, "Cloud Grid Engineer": T.POWER, "ML Engineer, Wind": T.RENEWABLE,
    "Civil Engineer, Wind Farms": T.RENEWABLE, "Thermal Hardware Engineer": T.DESIGN, "Electronics Materials Engineer": T.DESIGN, "Substation Specialist": T.POWER, "Solar Scientist": T.RENEWABLE, "Microgrid Lead": T.RENEWABLE}
#: title, body, relevant, category, reason, needs_description, category of the title
BODIED = [
    ("Relay Software Engineer II", "", False, T.OTHER, "needs a body", True, None),
    ("Mechanical and Electrical Engineer", POWERFUL, True, T.POWER, "electrical title, category from body", True, None),
    ("Electrical Engineer / Technician", "", True, T.DESIGN, "electrical title", False, None),
    ("PLC Engineer", POWERFUL, True, T.CONTROLS, "title", False, T.CONTROLS),
    ("Building Engineer", POWERFUL, True, T.BUILDINGS, "body", True, T.BUILDINGS),
    ("Building Engineer", "", False, T.BUILDINGS, "needs a body", True, T.BUILDINGS),
    ("Building Engineer", NOTHING, False, T.BUILDINGS, "too few terms in the body", True, T.BUILDINGS),
    ("Flight Engineer", POWERFUL, True, T.TRANSPORT, "body", True, T.TRANSPORT),
    ("Facilities Engineer", POWERFUL, True, T.POWER, "body", True, T.INDUSTRIAL),
    ("Project Engineer", CONTROLLING, True, T.CONTROLS, "body", True, T.INDUSTRIAL),
    ("Project Engineer", VAGUE, True, T.INDUSTRIAL, "body", True, T.INDUSTRIAL),
    ("Project Engineer", NOTHING, False, T.INDUSTRIAL, "too few terms in the body", True, T.INDUSTRIAL),
    ("Plant Electrical Engineer", NOTHING, True, T.INDUSTRIAL, "title", False, T.INDUSTRIAL),
    ("Electrical Engineer", POWERFUL, True, T.POWER, "electrical title, category from body", True, None),
    ("Electrical Engineer", NOTHING, True, T.DESIGN, "electrical title", False, None),
    ("Design Engineer", CONTROLLING, True, T.CONTROLS, "body", True, None),
    ("Engineer IV", VAGUE, True, T.OTHER, "body", True, None),
    ("Design Engineer", "", False, T.OTHER, "needs a body", True, None),
    ("Transmission Axle Engineer I", NOTHING, False, T.OTHER, "too few terms in the body", True, None),
]
JUDGED = [(t, "", False, OUT, why, False, BESIDE.get(t)) for why, ts in REJECTED.items() for t in ts] + [(t, "", True, k, "title", False, k) for k, ts in ACCEPTED.items() for t in ts] + BODIED
VERDICTS, NAMED = [r[:6] for r in JUDGED], [r[6] for r in JUDGED]
ROLES = [T.SOFTWARE if r[4] == "excluded: software" else r[3] if r[2] else OUT for r in VERDICTS]


def cased(spark, d, titles: list[str], bodies: list[str] | None = None):
    """The lens with written titles and bodies, each followed by the posting's own."""
    df = lens(spark, d).withColumnRenamed("body", "own_text")
    df = posed(df, title=titles, body=bodies or [""] * len(titles))
    title, body = told()
    return df.withColumns({"body": body, "title": title})


def judged(spark, d):
    return cased(spark, d, [r[0] for r in VERDICTS], [r[1] for r in VERDICTS])


@query("c02_classify", expected("relevant, category, reason, needs", [r[2:] for r in VERDICTS], "id, relevant, category, reason, needs"))
def c02(spark, d):
    v = judged(spark, d).select("id", T.verdict(F.col("title"), F.col("body")).alias("v"))
    return v.select("id", "v.relevant", "v.category", "v.reason", F.col("v.needs_description").alias("needs"))


@query("c03_title_category", expected("category", [(x,) for x in NAMED], "id, category"))
def c03(spark, d):
    return judged(spark, d).select("id", T.title_category(F.col("title")).alias("category"))


@query("c06_role_category", expected("role", [(x,) for x in ROLES], "id, role"))
def c06(spark, d):
    return judged(spark, d).select("id", T.verdict(F.col("title"), F.col("body")).alias("v")).select("id", T.role_category(F.col("v")).alias("role"))


# title, body, level, confidence
GRADED = [
    ("Electrical Engineering Intern", "", "Intern", 95),
    ("Senior Co-op Student", "5+ years", "Intern", 95),
    ("Engineer I, II or III", "10+ years", "Entry Level", 85),
    ("Planning Engineer (Entry, Staff or Senior)", "", "Entry Level", 85),
    ("Engineering Manager", "", "Manager", 95),
    ("Principal Engineer", "a recent graduate is welcome", "Principal", 95),
    ("Staff Engineer", "", "Staff", 94),
    ("Lead Engineer", "", "Lead", 88),
    ("Sr. Power Engineer", "", "Senior", 92),
    ("Controls Engineer III", "", "Senior", 86),
    ("Grid Architect Engineer", "", "Senior", 84),
    ("Power Engineer", "a recent graduate is welcome", "New Grad", 92),
    ("Engineer in Training", "", "Entry Level", 92),
    ("Associate Engineer", "", "Associate", 84),
    ("Junior Engineer", "8+ years", "Junior", 86),
    ("Power Engineer", "an entry-level post", "Entry Level", 86),
    ("Controls Engineer I", "", "Entry Level", 82),
    ("Controls Engineer II", "9 years of experience", "Mid-Level", 80),
    ("Power Engineer", "8+ years of experience", "Principal", 68),
    ("Power Engineer", "asks for 5 to 7 years", "Senior", 74),
    ("Power Engineer", "asks for 3+ years", "Mid-Level", 70),
    ("Power Engineer", "1 year of experience", "Entry Level", 66),
    ("Power Engineer", "0 to 2 seasons", "Entry Level", 72),
    ("Power Engineer", "with our junior engineer group", "Entry Level", 60),
    ("Power Engineer", NOTHING, "Unknown", 30),
]


def graded(spark, d):
    df = cased(spark, d, [r[0] for r in GRADED], [r[1] for r in GRADED])
    return df.select("id", C.seniority(F.col("title"), F.col("body")).alias("s")).select("id", "s.level", "s.confidence")


@query("c12_seniority", expected("level, confidence", [r[2:] for r in GRADED], "id, level, CAST(confidence AS INT) AS confidence"))
def c12(spark, d):
    return graded(spark, d)


@query("c13_level_flags", expected("entry, senior", [(r[2] in ("New Grad", "Entry Level"), r[2] in ("Senior", "Staff", "Principal", "Lead", "Manager")) for r in GRADED], "id, entry AS is_entry_level, senior AS is_senior_level"))
def c13(spark, d):
    return graded(spark, d).select("id", F.col("level").isin(*C.ENTRY_LEVELS).alias("is_entry_level"), F.col("level").isin(*C.SENIOR_LEVELS).alias("is_senior_level"))


# title, body, tier, friendly
FRIENDLY = [
    ("Substation Engineer", "3+ years", "S", True), ("Substation Engineer", "", "A", True), ("Substation Engineer", "4+ years", "S", False), ("Substation Engineer", "", "B", False),
    ("Senior Substation Engineer", "", "S", False), ("Substation Engineer IV", "", "S", False), ("Substation Engineer Intern", "", "S", False), ("Project Engineer", POWERFUL, "S", False),
    ("Electrical Engineer", POWERFUL, "S", False), ("Electrical Engineer", NOTHING, "A", True), ("Software Engineer", "", "S", False), ("Substation Engineer", "", None, False),
]


@query("c14_candidate_friendly", expected("friendly", [r[3:] for r in FRIENDLY], "id, friendly"))
def c14(spark, d):
    df = cased(spark, d, [r[0] for r in FRIENDLY], [r[1] for r in FRIENDLY]).withColumn("tier", pick([r[2] for r in FRIENDLY]))
    v = T.verdict(F.col("title"), F.col("body"))
    return df.select("id", C.candidate_friendly(v, F.col("title"), X.years_required(F.col("body"))["min"], F.col("tier")).alias("friendly"))


# level, years, senior, entry, friendly, title, body, fit
FITS = [
    ("New Grad", None, False, True, False, "Power Engineer", "", 100), ("Entry Level", 1, False, True, False, "Power Engineer", "", 90), ("Junior", 2, False, False, False, "Junior Engineer", "", 82),
    ("Associate", None, False, False, False, "Associate Engineer", "", 85), ("Mid-Level", None, False, False, False, "Engineer II", "", 70), ("Mid-Level", 3, False, False, False, "Power Engineer", "", 70),
    ("Mid-Level", 4, False, False, False, "Power Engineer", "", 60), ("Senior", None, True, False, False, "Senior Engineer", "a recent graduate is welcome", 55), ("Senior", 5, True, False, False, "Power Engineer", "", 50),
    ("Senior", 5, True, False, False, "Power Engineer", "a recent graduate is welcome", 75), ("Principal", 8, True, False, False, "Power Engineer", "", 45), ("Staff", None, True, False, False, "Staff Engineer", "new grad", 45),
    ("Entry Level", None, False, True, False, "Engineer I, II or Principal", "", 100), ("Entry Level", None, False, True, False, "Principal Engineer", "", 45), ("Intern", None, False, False, False, "Power Intern", "new grad", 50),
    ("Unknown", None, False, False, False, "Power Engineer", "", 66), ("Unknown", None, False, False, True, "Power Engineer", "", 72), ("Unknown", 1, False, False, False, "Power Engineer", "", 72), (None, 2, False, False, False, "Power Engineer", "", 72),
]


@query("c18_new_grad_fit", expected("fit", [r[7:] for r in FITS], "id, CAST(fit AS INT) AS fit"))
def c18(spark, d):
    df = cased(spark, d, [r[5] for r in FITS], [r[6] for r in FITS])
    level, years, senior, entry, friendly = (pick([r[i] for r in FITS]) for i in range(5))
    return df.select("id", C.new_grad_fit(level, years.cast("int"), senior, entry, friendly, F.col("title"), F.col("body")).alias("fit"))


# level, years, senior, fit
OLDER = [("Staff", None, True, 95), ("Lead", None, True, 90), ("Manager", None, True, 88), ("Senior", 5, True, 92), ("Mid-Level", 3, False, 82), ("Mid-Level", None, False, 80), ("Associate", 2, False, 62), ("Junior", 3, False, 82), ("Entry Level", None, False, 45), ("New Grad", 1, False, 40), ("Intern", None, False, 25), ("Unknown", None, False, 70), (None, None, False, 70), ("New Grad", 6, False, 92), ("Entry Level", None, True, 88)]


@query("c19_experienced_fit", expected("fit", [r[3:] for r in OLDER], "id, CAST(fit AS INT) AS fit"))
def c19(spark, d):
    level, years, senior = (pick([r[i] for r in OLDER]) for i in range(3))
    return lens(spark, d).select("id", C.experienced_fit(level, years.cast("int"), senior).alias("fit"))


@query("c10_sponsor", duck("SELECT id, CASE WHEN s_suppkey % 3 = 0 THEN true WHEN s_suppkey % 3 = 1 THEN false END AS sponsors, s_suppkey % 3 = 0 AND eligibility_risk = 'low' AS accessible FROM lens JOIN supplier ON s_name = company"))
def c10(spark, d):
    table = read(spark, d, "supplier").where("s_suppkey % 3 < 2").select(F.concat("s_name", F.lit(" Inc")).alias("name"), (F.col("s_suppkey") % 3 == 0).alias("sponsors"))
    out = lookups.with_sponsor(lens(spark, d).withColumn("company", F.concat(F.lit("The "), "company", F.lit(", LLC"))), table)
    return out.select("id", F.col("sponsors_h1b").alias("sponsors"), F.col("h1b_accessible").alias("accessible"))


# text, skills
SKILLED = [
    ("Knows ETAP and SKM, arc-flash studies, the National Electrical Code", ["NEC / NFPA 70", "Arc Flash Analysis", "ETAP", "SKM PowerTools"]),
    ("Siemens TIA Portal, PROFINET, PLC panels and C++", ["PLC Programming", "TIA Portal / STEP 7", "Profibus / Profinet", "C++"]),
    ("Grounding, load-flow, PSS/E, DNP3, IEC 61850 relay settings", ["IEC 61850", "Load Flow", "Relay Settings", "Grounding Design", "PSS/E", "DNP3"]),
    ("A spicy pythonic javascript, connected semiconductor groups", []),
    ("python, sql & Java with OPC-UA", ["OPC UA", "Python", "SQL"]),
    ("Firmware in C, not in C# or C++; P&IDs and an Op-Amp", ["P&IDs", "Analog Circuits", "C++", "C"]),
    ("NFPA 70E and nfpa70, MIL STD 461, isa-18.2, UL 508A", ["NEC / NFPA 70", "NFPA 70E", "MIL-STD-461", "UL 508A", "ISA-5.1 / ISA-88 / ISA-95"]),
    ("802.11 radios, CAN bus, RS-485, SEL-421, transformer design at 13.8 kV", ["Magnetics Design", "SEL AcSELerator", "RS-485 / RS-232", "CAN", "Wi-Fi / Bluetooth", "Transformers"]),
]


@query("c23_extract_skills", expected("skills", [(",".join(r[1]),) for r in SKILLED], "id, skills"))
def c23(spark, d):
    df = cased(spark, d, ["Engineer"] * len(SKILLED), [r[0] for r in SKILLED])
    return df.select("id", F.array_join(S.extract_skills(F.col("body")), ",").alias("skills"))


STORED = f"CASE WHEN id % 3 = 0 THEN {literal(T.POWER)} ELSE role END"


@query("c24_reclassify", expected("role", [(x,) for x in ROLES], f"count(*) AS total, count(*) FILTER (WHERE {STORED} <> role) AS changed, count(*) FILTER (WHERE {STORED} <> role AND role IN ({literal(OUT)}, {literal(T.SOFTWARE)})) AS dropped"))
def c24(spark, d):
    stored = F.when(F.col("id") % 3 == 0, T.POWER).otherwise(pick(ROLES))
    return lifecycle.reclassify(judged(spark, d).withColumns({"role_category": stored, "eligibility_risk": F.lit("low")}))[1]


USERS = "SELECT conv_id FROM conversations WHERE role = 'user' GROUP BY conv_id"
#: Profiles as written; name, degree, field, grad_date, years, projects, all_skills, licences.
PROFILES = [
    ("Jordan Lee\nB.S. Electrical Engineering, May 2025\n2 years of experience, EIT\nProjects\n• Arc flash study of a plant in ETAP\n- Modbus logger in Python\nshort\nALL IN CAPITALS\nEducation\nSkills: AutoCAD, MATLAB\n", "Jordan Lee", "BS", "ELECTRICAL ENGINEERING", "May 2025", 2.0, "Arc flash study of a plant in ETAP|Modbus logger in Python", "Arc Flash Analysis,AutoCAD,ETAP,MATLAB,Modbus,Python", "EIT / FE"),
    ("Maria Garcia\nPh.D. in Power Engineering, 2023\n10+ years experience, professional engineer\nPSCAD, IEC 61850, DNP3\n", "Maria Garcia", "PhD", "POWER ENGINEERING", "2023", 10.0, "", "DNP3,IEC 61850,PSCAD", "PE"),
    ("12345\nLooking for work\nMaster student, mechatronics, graduating December 2026\nKey Projects:\n* Robot arm with CAN bus and C++\nAwards\n", "Looking for work", "MS", "MECHATRONICS", "December 2026", 0.0, "Robot arm with CAN bus and C++", "C++,CAN", ""),
]


def profile_texts(spark, d):
    t = read(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    return t.select("conv_id", F.array_join("t.text", " ").alias("body"))


def parsed(spark, d):
    text = F.concat_ws("\n", pick([r[0] for r in PROFILES], "conv_id"), "body")
    return profile_texts(spark, d).select("conv_id", S.parse_profile(text).alias("p"))


@query("c25_profile_skills", expected("all_skills, licences", [r[7:] for r in PROFILES], "conv_id, all_skills, licences", f"({USERS}) u", "conv_id"))
def c25(spark, d):
    return parsed(spark, d).select("conv_id", F.array_join("p.skills.all_skills", ",").alias("all_skills"), F.array_join("p.skills.licences", ",").alias("licences"))


@query("c26_profile_fields", expected("name, degree, field, grad_date, years, projects", [r[1:7] for r in PROFILES], "conv_id, name, degree, field, grad_date, CAST(years AS DOUBLE) AS years, projects", f"({USERS}) u", "conv_id"))
def c26(spark, d):
    return parsed(spark, d).select("conv_id", "p.name", "p.degree", "p.field", "p.grad_date", "p.years", F.array_join("p.projects", "|").alias("projects"))


# what follows the name of a part, and what of it stays
NOTES = [(" - Remote", ""), (", hybrid ", ""), (" | Onsite", ""), (" - New  Grad", ""), (" - Entry-Level", ""), (" (Remote, US)", ""), (" (New grad 2025) II", " ii"), (" (onsite)", " (onsite)"), ("  Remote", " remote"), (" (hybrid) - remote", "")]


@query("b04_normalize_title", expected("rest", [(x[1],) for x in NOTES], "id, lower(part_name) || rest AS norm_title"))
def b04(spark, d):
    return lens(spark, d).select("id", X.normalize_title(F.concat("part_name", pick([x[0] for x in NOTES]))).alias("norm_title"))


@query("b07_identity", duck(r"""
, k AS (SELECT id, substr(sha256(lower(company) || '|' || CAST(id AS VARCHAR)), 1, 16) AS key,
  substr(sha1(lower(company) || '|' || lower(title) || '|' || CASE WHEN l = '' THEN '' ELSE substr(sha1(substr(l, 1, 700)), 1, 10) END), 1, 12) AS dup_group
  FROM (SELECT *, trim(regexp_replace(lower(repeat('1 <b>2</b> ', CAST(id % 3 * 100 AS INT)) || coalesce(body, '')), '[^a-z]+', ' ', 'g')) AS l FROM lens))
SELECT id, key, dup_group, CAST('0x' || substr(key, 1, 13) AS BIGINT) AS stable_id, CAST(CAST('0x' || substr(key, 1, 13) AS BIGINT) % 16 AS INT) AS chunk FROM k"""))
def b07(spark, d):
    """Some bodies begin with over 700 characters of numbers and markup."""
    body = F.concat(F.expr("repeat('1 <b>2</b> ', cast(id % 3 * 100 as int))"), F.coalesce("body", F.lit("")))
    df = lens(spark, d)
    df = df.select("id", I.fingerprint(F.col("company"), F.col("title"), F.col("location"), F.col("id").cast("string"), F.lit("")).alias("key"), I.dup_group(F.concat(F.lit(" "), "company", F.lit(" ")), F.lower("title"), body).alias("dup_group"))
    return df.select("*", I.stable_id(F.col("key")).alias("stable_id")).select("*", I.chunk_of(F.col("stable_id")).alias("chunk"))


@query("b10_fallback_url", duck("""
, t AS (SELECT id, s_suppkey AS k FROM lens JOIN supplier ON s_name = company)
SELECT id, CASE k % 4 WHEN 0 THEN 'https://whole/' || k WHEN 1 THEN 'https://first/' WHEN 2 THEN 'https://part/' || CASE WHEN k % 8 = 2 THEN 'a' ELSE 'b' END ELSE '' END AS url FROM t"""))
def b10(spark, d):
    s = read(spark, d, "supplier").select("s_name", F.col("s_suppkey").alias("k"))
    whole = s.where("k % 4 = 0").select(F.col("k").alias("ord"), F.col("s_name").alias("name"), F.concat(F.lit("https://whole/"), F.col("k").cast("string")).alias("url"))
    few = s.where("k = 0 or k = 1 or k = 2").select(F.lit(10**6).cast("long").alias("ord"), F.when(F.col("k") == 0, "Acme").when(F.col("k") == 1, "silicon").otherwise("con"), F.when(F.col("k") == 0, "https://first/").when(F.col("k") == 1, "https://part/a").otherwise("https://part/b"))
    few = few.toDF("ord", "name", "url").withColumn("ord", F.when(F.col("name") == "con", F.col("ord") + 1).otherwise(F.col("ord")))
    shown = F.when(F.col("k") % 4 == 0, F.concat(F.lit(" "), F.upper("s_name"))).when(F.col("k") % 4 == 1, F.lit("ACME Power")).when(F.col("k") % 8 == 2, F.lit("Big Silicon Works")).when(F.col("k") % 4 == 2, F.lit("Falcon Works")).otherwise("Nobody Else")
    df = lens(spark, d).join(s, F.col("company") == F.col("s_name")).select("id", shown.alias("company"))
    return lookups.fallback_url(df, whole.unionByName(few)).select("id", F.col("fallback_url").alias("url"))


# text, least and most years
YEARS = [("3 - 5 years", 3, 5), ("3 to 5 years", 3, 5), ("2–4 year", 2, 4), ("7+ years", 7, None), ("7 + years", 7, None), ("6 years of experience", 6, 6), ("1 year experience", 1, 1), ("12 months", None, None), ("founded 20 years ago", None, None), ("10+ years, 2 to 3 years", 2, 3)]


@query("b17_years_required", expected("min_years, max_years", [r[1:] for r in YEARS], "id, CAST(min_years AS INT) AS min_years, CAST(max_years AS INT) AS max_years"))
def b17(spark, d):
    text = F.concat_ws(" ", F.lit("Needs"), pick([r[0] for r in YEARS]), F.lit("and"), "part_name")
    return lens(spark, d).select("id", X.years_required(text).alias("y")).select("id", F.col("y.min").alias("min_years"), F.col("y.max").alias("max_years"))


@query("b18_remote_status", duck("SELECT id, CASE WHEN contains(lower(coalesce(body, '')), 'hybrid') OR id % 4 = 1 THEN 'Hybrid' WHEN contains(lower(coalesce(body, '')), 'remote') OR id % 4 IN (0, 2) THEN 'Remote' WHEN id % 8 = 3 THEN 'Unknown' ELSE 'Onsite' END AS remote FROM lens"))
def b18(spark, d):
    """The mode is said in the place, or at the end of the whole body."""
    k = F.col("id") % 4
    place = F.when(F.col("id") % 8 == 3, " ").otherwise(F.concat("location", F.when(k == 0, " (Remote)").otherwise("")))
    body = F.concat(F.coalesce("body", F.lit("")), F.when(k == 1, " Remote or HYBRID").when(k == 2, " Fully remote").otherwise(""))
    return lens(spark, d).select("id", X.remote_status(place, body).alias("remote"))

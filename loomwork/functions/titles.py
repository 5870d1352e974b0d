"""Is a posting of the field, and of which category: title rules first, the body only where the title leaves it open.

A title goes through the exclusions in order, needs an engineering noun, and then meets the category rules. Categories
whose title words are weak ask the body. All vocabularies are phrases of whole words, some with conditions on the words
around them (see phrases), and arguments. The words of a title are looked up once for all of them, those of a body too.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .classify import low, once
from .phrases import When, counted, each, hits, met, plain, words_of

# fixed values: the names of the categories
POWER, RENEWABLE, INDUSTRIAL = "Power Systems", "Renewable Energy", "Industrial & Plant"
CONTROLS, INSTRUMENTS, DESIGN = "Controls & Automation", "Instrumentation", "Electrical Design"
MACHINES, CONVERSION, RADIO = "Electrical Machines", "Power Electronics", "RF & Communications"
EMC, BUILDINGS, TRANSPORT = "EMC / EMI", "Buildings & Infrastructure", "Transportation & Aerospace"
OTHER, OUTSIDE, SOFTWARE = "Other EE", "Out of Scope", "Software / Compiler"

Vocabulary = tuple["str | When", ...]


@dataclass(frozen=True)
class Exclusion:
    """Titles with one of `terms` are out, unless one of `unless` is there too or the title's category is one of `spared`."""

    label: str
    terms: Vocabulary
    unless: Vocabulary = ()
    spared: tuple[str, ...] = ()


@dataclass(frozen=True)
class Weak:
    """A category that the title settles only with an electrical word or one of `signs`; else the body decides, also on the category where `open`."""

    category: str
    signs: Vocabulary = ()
    open: bool = False


@dataclass(frozen=True)
class TitleRules:
    categories: tuple[tuple[str, Vocabulary], ...]
    exclusions: tuple[Exclusion, ...] = ()
    nouns: Vocabulary = ("engineer", "engineers", "engineering", "designer")
    #: Words of the whole field; such a title without a category is `generic`, or what its body names.
    electrical: Vocabulary = ()
    generic: str = DESIGN
    weak: tuple[Weak, ...] = ()
    #: Engineering titles without a discipline, for the body to decide.
    ambiguous: Vocabulary = ()
    body_terms: tuple[str, ...] = ()
    body_categories: tuple[tuple[str, tuple[str, ...]], ...] = ()
    least_terms: int = 3
    least_hits: int = 2

    def title_phrases(self) -> list[str]:
        parts = [v for _, v in self.categories] + [self.nouns, self.electrical, self.ambiguous] + [w.signs for w in self.weak]
        return plain(e for v in parts + [x for e in self.exclusions for x in (e.terms, e.unless)] for e in v)

    def body_phrases(self) -> list[str]:
        return plain((*self.body_terms, *(t for _, v in self.body_categories for t in v)))


# The categories in the order in which a title is tried. Words are grouped by what they name.
TITLES = (
    (TRANSPORT, each("traction power", "rail/railway/railroad electrification", "aircraft/spacecraft/vehicle electrical", "high voltage harness/architecture") + ("catenary", "avionics", "ewis")),
    (EMC, ("emc", "emi", "e3") + each("electromagnetic compatibility/interference", "signal/power integrity")),
    (
        POWER,
        each("protection", "p &/and c", "protective/protection relay/relays/relaying", "relay/relaying engineer/settings/engineering", "substation/substations")
        + (When(("transmission",), unless_after=("rf", "wireless", "optical", "data", "fiber", "fibre", "gear", "axle", "driveline", "calibration")),)
        + each("distribution engineer/engineering/planning/design/system/systems/operations/automation/standards")
        + each("power system/systems/engineer/engineering/planning/quality/delivery/flow/lead/design/generation", "generation engineer/planning", "grid engineer/planning/operations/modernization/reliability/services")
        + each("high/medium/extra voltage", "extra high voltage", "hv/mv/ehv/hvdc/facts/statcom/switchgear", "gas insulated", "circuit breaker/breakers", "short circuit", "arc flash", "studies engineer")
        + each("utility/utilities/nerc/metering", "t &/and d", "overhead line/lines/design", "underground design/distribution/line/lines", "line design", "system operation/operations engineer")
        + each("energy management system/systems", "ems engineer", "adms/derms/derm")
        + (When(("interconnection", "interconnections"), unless_after=("network", "data")), When(("nuclear",), after=("electrical",))),
    ),
    (
        RENEWABLE,
        each("renewable/renewables/solar/photovoltaic/pv/wind/bess/der/hydrogen/geothermal/hydropower/hydroelectric/hydro", "microgrid/microgrids", "energy storage/engineer", "clean/distributed energy")
        + each("battery energy/storage/system/systems", "grid integration", "energy system/systems", "ev charging", "charging infrastructure/system/systems", "fuel cell/cells"),
    ),
    (INSTRUMENTS, each("instrumentation/metrology", "i &/and c", "instrument engineer/engineering", "instrument and/& control/controls", "measurement engineer/system/systems", "sensor/sensors engineer/system/systems", "analyzer engineer")),
    (
        CONVERSION,
        each("power electronic/electronics/conversion/supply/supplies/stage/hardware", "converter/converters/inverter/inverters/rectifier/rectifiers/magnetics/psu/smps/sic/gan/obc", "dc dc/ac", "ac dc", "dcdc/acdc")
        + each("gate driver/drivers", "motor drive/drives", "variable frequency drive/drives", "ups engineer/design/system/systems", "power design engineer", "wide bandgap", "on board charger", "onboard charger")
        + (When(("power management",), unless_after=("ic", "ics")),),
    ),
    (
        CONTROLS,
        each("control/controls/automation/plc/plcs/scada/dcs/hmi/mechatronics/robotics", "ot engineer/system/systems/network", "ics/bms/sis engineer", "safety instrumented"),
    ),
    (MACHINES, each("motor/motors/generator/generators/transformer/transformers/winding/windings/alternator/alternators", "electric/electrical machine/machines", "rotating machine/machines/equipment", "machine design", "e machine/machines")),
    (
        RADIO,
        each("rf/microwave/mmwave/antenna/antennas/electromagnetic/electromagnetics/wireless/radio/radar/satcom/beamforming/spectrum/gnss", "radio frequency", "millimeter/millimetre wave", "telecom/telecommunication/telecommunications")
        + each("phased array/arrays", "communication/communications engineer", "communication/communications system/systems engineer", "optical communication/communications/transmission", "fiber optic/network engineer", "signal processing", "dsp/gps engineer"),
    ),
    (
        BUILDINGS,
        each("mep/building/buildings/lighting/commissioning/infrastructure/construction", "data center/centre/centers/centres", "critical facilities/environment/environments/power", "mission critical", "facility/facilities electrical")
        + each("healthcare facilities", "fire alarm", "low voltage system/systems/design", "security systems engineer"),
    ),
    (
        TRANSPORT,
        each("aerospace/aircraft/airframe/spacecraft/satellite/space/launch/flight/missile/uav/drone/evtol", "marine/naval/shipboard/shipyard/ship/submarine/vessel", "rail/railway/railroad/traction/transit/locomotive/ocs", "rolling stock")
        + each("signaling/signalling engineer/design", "automotive/vehicle/vehicles/ev/powertrain/harness", "high voltage battery"),
    ),
    (INDUSTRIAL, each("industrial/plant/maintenance/reliability/field/project/manufacturing/production/startup/site/facilities", "mining/oil/gas/refinery/petrochemical/pulp/water/wastewater")),
    (
        DESIGN,
        each("electrical design/designer/system/systems/equipment/hardware/test", "hardware engineer", "hardware design engineer", "electronic/electronics/board/pcb/pcba/circuit/schematic/schematics/wiring", "product/panel design"),
    ),
)
ENGINEERS = ("engineer", "engineers")
EXCLUSIONS = (
    Exclusion(
        "false friend",
        # programs with "power" in their name
        each("power bi/platform/app/apps/automate/user", "powerbi/powershell")
        # controls of money, papers, access and time
        + each("financial/internal/sox/it/access/document/inventory/cost/project/production/quality/change/export/infection/pest/credit/fraud/security control/controls", "air traffic control/controls/controller", "sox")
        + (When(("controller",), unless_after=("engineer", "plc", "motor", "drive", "charge", "charger")),)
        + each("compliance analyst/officer/specialist/manager")
        # protection of other things than power systems
        + each("data/fire/cathodic/corrosion/environmental/asset/child/revenue/loss/privacy/consumer/information/cyber/radiation/brand/fall/identity/program protection")
        # computing and networks
        + each("grid computing", "utility software/computing/player", "control/data plane", "sdn/observability", "telemetry software/platform", "design/test automation", "software distribution", "materials specialist")
        + (When(each("network administrator/admin/engineer"), unless_after=("rf", "radio", "wireless", "optical", "fiber", "transmission")),)
        + each("help desk", "helpdesk", "desktop/it support", "service desk")
        # pipes and goods, light on stage, shops
        + (
            When(("gas", "pipeline", "water", "wastewater"), after=("transmission", "distribution"), unless_after=("electric", "electrical")),
            When(("transmission", "distribution"), after=("pipeline",)),
        )
        + each("natural gas transmission", "gas main/mains", "distribution center/centre/warehouse/logistics/sales", "food distribution", "lighting artist/director/technician", "technical artist", "wireless retail/sales/consultant/associate/advisor/store"),
    ),
    Exclusion(
        "not engineering",
        each("sales/marketing/recruiter/recruiting/recruitment/recruiters/hr/talent/payroll/benefits", "human resources", "accountant/accounting/finance/financial/audit/auditor/tax/legal/counsel/paralegal/attorney")
        + each("procurement/sourcing/buyer/purchasing", "customer success/service/care", "account manager/executive", "business development", "program/project/product/office manager", "administrative/receptionist")
        + each("technical writer", "communications specialist/manager/coordinator", "scheduler/estimator/dispatcher/coordinator/clerk", "retail/store/cashier/driver/nurse/teacher/instructor/professor/lecturer", "artist/graphic/ux", "security officer/guard", "janitor/janitorial/custodian")
        + (When(("planner", "assistant", "analyst", "consultant"), unless_after=("engineer", "engineers", "engineering")),),
    ),
    Exclusion(
        "trade",
        each("electrician/electricians/lineman/linemen/lineworker/linewoman/journeyman/journeyworker/apprentice/wireman/groundman/splicer", "line man/men/worker", "technician/technicians/mechanic/installer/operator/foreman/foreperson/helper/laborer")
        + each("fitter/welder/machinist/assembler/inspector/troubleshooter/drafter/draftsman/draftsperson", "meter reader")
        + (When(("tech",), unless_after=("engineer", "engineers", "engineering")),),
        unless=ENGINEERS,
    ),
    Exclusion(
        "chip design",
        each("rtl/asic/fpga/vlsi/soc/verilog/ams/rfic/pmic/serdes/pll/adc/dac/cpu/gpu/dft/silicon/wafer/yield/lithography/etch/cmp/diffusion", "design verification", "dv/verification/layout/device engineer", "physical/mask/ic design")
        + each("analog/digital ic/circuit design", "mixed signal ic/circuit design", "analog mixed signal", "circuit design engineer", "data converter/converters", "power management ic", "thin film", "standard cell"),
        spared=(POWER, RENEWABLE, INDUSTRIAL, BUILDINGS),
    ),
    Exclusion(
        "software",
        each("software/sde/developer/developers/firmware/devops/devsecops/sre/cloud/web/salesforce/servicenow/sap/linux/windows/database", "frontend/backend/fullstack", "front/back end", "full stack", "site reliability")
        + each("data engineer/scientist/analyst", "machine learning", "ml/ai/qa/security engineer", "cyber", "cybersecurity", "it engineer/specialist/manager", "information/cyber/it/network/cloud/application/product security", "customer system security")
        + (When(("programmer",), unless_after=("plc",), unless_before=("plc",)), When(("embedded",), unless_after=("hardware", "electrical"))),
        unless=each("control/controls/plc/scada/dcs/hmi/protection/relay"),
    ),
    Exclusion(
        "other discipline",
        each("mechanical/civil/structural/structures/chemical/geotechnical/environmental/hvac/plumbing/piping/petroleum/reservoir/drilling/biomedical", "industrial hygiene/hygienist", "safety/manufacturing/process/traffic engineer")
        + each("supplier quality", "quality assurance", "packaging/materials", "material engineer", "survey/surveyor/surveying", "hydraulic/hydraulics/thermal/propulsion/fluid/fluids/cryogenic/cryogenics")
        + (When(("quality engineer",), unless_before=("power",)), When(each("transportation planner/engineer"), unless_after=("electric", "electrical"))),
        unless=(When(("electronic", "electronics"), unless_after=("materials",)),) + each("electrical/electric/ee/electromechanical/pcb/pcba/avionics/instrumentation/control/controls", "e & i", "electro mechanical"),
    ),
)
NOUNS = each("engineer/engineers/engineering/eng/engr/designer/architect/eit", "plc programmer") + (When(("scientist",), after=("power", "grid", "rf", "electromagnetic", "electromagnetics", "antenna", "antennas", "energy")),)
ELECTRICAL = each("electrical/electric/electronic/electronics/ee/electromechanical/pcb/pcba/schematic", "e & i", "electro mechanical", "hardware engineer", "board design/level")
#: Words of a body that speak of electrical work.
BODY_TERMS = (
    each("electrical engineering/design", "one/single line", "single line diagram", "switchgear/switchboard/panelboard/mcc/transformer/transformers/substation/substations/relay/relays", "motor control center", "protective relay/relays", "protection and control")
    + each("short circuit", "arc flash", "load/power flow", "coordination study/studies", "grounding", "nec/nema/ieee/iec", "nfpa 70/70e", "ul 508", "iec 61850", "kv/kva/mva", "low/medium/high voltage", "distribution/power system", "transmission line/lines", "power distribution")
    + each("plc/scada/dcs/hmi", "ladder logic", "studio 5000", "tia portal", "rslogix", "instrumentation", "p & id", "loop diagram/diagrams", "control panel/panels", "schematic/schematics/pcb/circuit/circuits/oscilloscope/wiring/conduit/voltage/breaker/breakers")
    + each("power supply", "inverter/converter/motor/generator/drives/vfd/ups/battery", "motor control", "etap/skm/easypower/pss/psse/pscad/cyme/synergi/aspen", "autocad electrical", "revit", "rf/antenna/emc/emi", "photovoltaic/solar/microgrid/interconnection/harmonics", "wind turbine", "energy storage", "cable sizing")
)
BODIES = (
    (POWER, each("substation/substations/relay/relays/protection/transmission/etap/switchgear/utility/nerc/psse/cyme/synergi/feeder/overhead/underground/outage/grid/kv", "protective relay", "protection and control", "transmission line", "distribution/power system", "load/power flow", "short circuit", "arc flash", "coordination study", "high voltage", "pss e", "interconnection")),
    (RENEWABLE, each("solar/photovoltaic/pv/wind/bess/microgrid/renewable/inverter/interconnection/der", "energy/battery storage", "ev charging")),
    (INDUSTRIAL, each("plant/maintenance/reliability/manufacturing/production/mining/refinery/petrochemical/conveyor/turnaround", "motor control", "hazardous area", "root cause", "preventive maintenance")),
    (CONTROLS, each("plc/scada/hmi/dcs/servo/ignition/wonderware/rslogix/pid/automation", "ladder logic", "studio 5000", "tia portal", "control system/systems", "process control", "loop tuning")),
    (INSTRUMENTS, each("instrumentation/transmitter/transmitters/analyzer/calibration/sensors", "i & c", "p & id", "loop checks/diagram", "flow meter", "instrument index")),
    (DESIGN, each("schematic/schematics/pcb/circuit/altium/orcad/board/panel/layout/conduit", "cable sizing", "power distribution", "electrical design", "wiring diagram", "autocad electrical")),
    (MACHINES, each("motor/generator/rotating/winding/windings/stator/rotor/torque", "electric machine", "transformer design")),
    (CONVERSION, each("converter/inverter/magnetics/igbt/mosfet/plecs/ltspice/sic/gan/switching", "power electronics/stage", "dc dc", "ac dc", "gate driver", "motor drive", "switching losses")),
    (RADIO, each("rf/microwave/antenna/amplifier/hfss/vna/wireless/lte/5g/radar/electromagnetic", "spectrum analyzer", "link budget", "impedance matching")),
    (EMC, each("emc/emi/emissions/immunity/shielding/anechoic/cispr", "radiated/conducted emissions", "fcc part 15", "mil std 461", "do 160")),
    (BUILDINGS, each("building/mep/lighting/revit/commissioning/ups/nec", "data center", "critical facilities", "construction documents", "life safety", "fire alarm", "panel schedules")),
    (TRANSPORT, each("aircraft/avionics/aerospace/spacecraft/satellite/rail/traction/vehicle/automotive/marine/naval/harness/catenary", "do 178/254", "rolling stock")),
)
WEAK = (
    Weak(TRANSPORT, each("avionics/ewis/harness/traction/catenary/ocs/electric/electrical/electrification/power/powertrain/ev", "high voltage")),
    Weak(BUILDINGS, each("critical/lighting/mep", "data center/centre/centers/centres", "fire alarm", "low voltage")),
    Weak(INDUSTRIAL, open=True),
)
AMBIGUOUS = each(
    "project/field/design/system/systems/test/reliability/application/applications/startup/associate/graduate/development/product/facilities/site/plant/maintenance/service/staff/senior/principal/lead engineer",
    "engineer i/ii/iii/iv/1/2/3/4", "commissioning/designer/eit", "entry level engineer", "engineer in training", "engineering intern/coop", "engineering co op", "design engineering", "technical lead", "engineer $", "^ engineer",
)
RULES = TitleRules(TITLES, EXCLUSIONS, NOUNS, ELECTRICAL, weak=WEAK, ambiguous=AMBIGUOUS, body_terms=BODY_TERMS, body_categories=BODIES)


def _row(relevant: Column | bool, category: Column | str | None, reason: Column | str, needs: bool = False) -> Column:
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(col(relevant).alias("relevant"), col(category).cast("string").alias("category"), col(reason).alias("reason"), F.lit(needs).alias("needs_description"))


def verdict(title: Column, body: Column, rules: TitleRules = RULES) -> Column:
    """Struct of relevant, category, reason, needs_description.

    Rejected titles are out of scope; a title that only a body could decide keeps the category it would get. The body's
    words are cut once, however many vocabularies they meet. Null texts are empty.
    """
    phrases, body_phrases = rules.title_phrases(), rules.body_phrases()

    def seen(t: Column) -> Column:
        return once(words_of(t), lambda w: F.struct(t.alias("t"), w.alias("words"), hits(w, phrases).alias("hits"), _found(body, body_phrases).alias("found"), (low(body) == "").alias("no_body")))

    def named(x: Column) -> Column:
        return F.struct(x["t"].alias("t"), x["words"].alias("words"), x["hits"].alias("hits"), x["found"].alias("found"), x["no_body"].alias("no_body"), _category(x, rules).alias("cat"), met(x, rules.electrical).alias("electric"))

    def decide(x: Column) -> Column:
        cat, electric = x["cat"], x["electric"]
        guess = best_found(x["found"], rules.body_categories, rules.least_hits) if rules.body_categories else F.lit(None).cast("string")
        enough = counted(x["found"], rules.body_terms) >= rules.least_terms if rules.body_terms else F.lit(False)

        def by_body(default: str, fixed: bool) -> Column:
            found = F.lit(default) if fixed else F.coalesce(guess, F.lit(default))
            return F.when(x["no_body"], _row(False, default, "needs a body", True)).when(enough, _row(True, found, "body", True)).otherwise(_row(False, default, "too few terms in the body", True))

        steps = [(x["t"] == "", _row(False, OUTSIDE, "no title"))]
        for e in rules.exclusions:
            out = met(x, e.terms)
            if e.unless:
                out = out & ~met(x, e.unless)
            if e.spared:
                out = out & ~F.coalesce(cat.isin(*e.spared), F.lit(False))
            steps.append((out, _row(False, OUTSIDE, f"excluded: {e.label}")))
        steps.append((~met(x, rules.nouns), _row(False, OUTSIDE, "no engineering noun")))
        for w in rules.weak:
            unsure = (cat == w.category) & ~electric
            steps.append((unsure & ~met(x, w.signs) if w.signs else unsure, by_body(w.category, not w.open)))
        steps.append((cat.isNotNull(), _row(True, cat, "title")))
        steps.append((electric & guess.isNotNull(), _row(True, guess, "electrical title, category from body", True)))
        steps.append((electric, _row(True, rules.generic, "electrical title")))
        if rules.ambiguous:
            steps.append((met(x, rules.ambiguous), by_body(OTHER, False)))
        first, *rest = steps
        return reduce(lambda c, step: c.when(*step), rest, F.when(*first)).otherwise(_row(False, OUTSIDE, "no electrical sign"))

    return once(once(once(low(title), seen), named), decide)


def _found(body: Column, phrases: list[str]) -> Column:
    """The distinct phrases that a body holds."""
    return once(words_of(body), lambda w: F.array_distinct(F.transform(hits(w, phrases), lambda h: h["p"])))


def _category(x: Column, rules: TitleRules) -> Column:
    return F.coalesce(*[F.when(met(x, v), F.lit(k)) for k, v in rules.categories], F.lit(None).cast("string"))


def title_category(title: Column, rules: TitleRules = RULES) -> Column:
    """The category that a title names, whatever becomes of it; null if none."""
    phrases = plain(e for _, v in rules.categories for e in v)
    return once(once(words_of(title), lambda w: F.struct(w.alias("words"), hits(w, phrases).alias("hits"))), lambda x: _category(x, rules))


def best_found(found: Column, vocabulary, least: int) -> Column:
    """The label of which most phrases are among those found, the earlier one on a tie; null below `least`."""
    rows = F.array(*[F.struct(counted(found, v).alias("hits"), F.lit(-i).alias("ord"), F.lit(k).alias("label")) for i, (k, v) in enumerate(vocabulary)])
    return once(F.array_max(rows), lambda b: F.when(b["hits"] >= least, b["label"]))


def role_category(v: Column) -> Column:
    """The category that a verdict stands for: its own, that of software, or none of them."""
    return F.when(v["reason"] == "excluded: software", SOFTWARE).when(~v["relevant"], OUTSIDE).otherwise(v["category"])


def role_flags(v: Column, body: Column, vocabulary=BODIES, least: int = 3) -> Column:
    """Array of the categories that a posting touches: that of its verdict, if relevant, and any of which the body has `least` phrases."""
    def touched(found: Column) -> Column:
        return F.array_compact(F.array(*[F.when((v["relevant"] & (v["category"] == k)) | (counted(found, phrases) >= least), F.lit(k)) for k, phrases in vocabulary]))

    return once(_found(body, plain(p for _, phrases in vocabulary for p in phrases)), touched)

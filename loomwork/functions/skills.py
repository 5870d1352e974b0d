"""Skills of a text by a dictionary of families, and what a profile's text says of its owner.

The dictionary is met by runs of words (see phrases): one pass over a text, whatever the dictionary's size.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .classify import best_category, low, once
from .phrases import When, cut, each, hits, met, plain, words_of
from .titles import BODIES


def dictionary(text: str) -> dict[str, tuple[str, ...]]:
    """Skills from lines `name = phrase, phrase`; a name alone is its own phrase; slashes in phrases are choices of a word."""
    out = {}
    for line in filter(None, map(str.strip, text.strip().splitlines())):
        for entry in filter(None, map(str.strip, line.split(";"))):
            name, _, phrases = entry.partition(" = ")
            out[name] = each(*(p.strip() for p in phrases.split(","))) if phrases else (name,)
    return out


# fixed values: the names of the families and of their skills; after each name the words by which it is met
STANDARDS = dictionary("""
NEC / NFPA 70 = nec, national electrical code, nfpa 70, nfpa70; NFPA 70E = nfpa 70e, nfpa70e, arc flash safety; NFPA 72 = nfpa 72, nfpa72
IEEE 1547 = ieee 1547, ieee1547; IEEE 519 = ieee 519, ieee519; IEEE 1584 = ieee 1584, ieee1584; IEEE C37 = ieee c37, c37; IEEE 80 = ieee 80, ieee80, ieee std 80
IEEE Color Books = ieee 141/142/242/399/493, red/green/buff/gold/brown book; IEC 61850 = iec 61850, iec61850; IEC 61131-3 = iec 61131, iec61131
IEC 61511 / SIS = iec 61511, iec61511, sil 1/2/3/4, sil1/sil2/sil3/sil4, safety instrumented; IEC 61000 / CISPR = iec 61000, iec61000, cispr; FCC Part 15 = fcc
MIL-STD-461 = mil std 461, milstd 461; MIL-STD-704 = mil std 704, milstd 704; DO-160 = do 160, do160; DO-254 = do 254, do254
NERC CIP = nerc cip, cip 002/003/004/005/006/007/008/009/010/011/012/013/014; NERC Reliability Standards = nerc, prc 001/002/004/005/006/012/019/023/024/025/026/027/028/029, tpl 001/007/008, mod 025/026/027/032/033
UL 508A = ul 508, ul 508a, ul508/ul508a; UL 1741 = ul 1741, ul1741; UL 9540 = ul 9540, ul9540; NEMA = nema; ANSI C84.1 = c84 1; ISA-5.1 / ISA-88 / ISA-95 = isa 5 1, isa 88/95, isa 18 2, isa88/isa95
ISO 26262 = iso 26262, iso26262; TIA-942 = tia 942, tia942; OSHA = osha
""")
STUDIES = dictionary("""
Load Flow = load/power flow, loadflow/powerflow; Short Circuit Analysis = short circuit; Arc Flash Analysis = arc flash; Protective Device Coordination = coordination study/studies, tcc, selective coordination
Relay Settings = relay setting/settings, setting calculation/calculations, protective relay/relays; Transient Stability = transient/dynamic stability, stability study/studies; Harmonic Analysis = harmonic/harmonics
Motor Starting = motor starting; Grounding Design = grounding, earthing, ground grid; Cable Sizing / Ampacity = ampacity, cable/conductor sizing; Voltage Drop = voltage drop; Lightning Protection = lightning protection, surge
Interconnection Studies = interconnection study/studies, system impact study/studies, facilities study/studies; Hosting Capacity = hosting capacity; Transmission Planning = transmission planning; Distribution Planning = distribution planning
Power Quality = power quality; Reliability / RCM = reliability centered, rcm, fmea, mtbf; Root Cause Analysis = root cause, rca; Commissioning = commissioning, fat, sat, startup, start up; Loop Checks = loop check/checks
Load Calculations = load calc/calcs/calculation/calculations; Lighting Calculations = lighting calc/calcs/calculation/calculations, photometric/photometrics; Single-Line Diagrams = one/single line
Schematics & Wiring Diagrams = schematic/schematics, wiring/elementary diagram/diagrams, three line; Panel Design = panel design/layout, control panel/panels; PLC Programming = plc, ladder logic; HMI Development = hmi
Control Loop Tuning = pid, loop tuning, control loop/loops; Signal Integrity = signal integrity, si pi; Link Budget = link budget/budgets; EMC Testing = emc test/tests/testing, radiated/conducted emissions, pre compliance, precompliance
Converter Design = converter design, buck/boost/flyback/llc/dab; Magnetics Design = magnetics/transformer/inductor design; Motor Design = motor/machine design; EM / FEA Simulation = fea, finite element, electromagnetic simulation/simulations
Battery Management = battery management, bms; Grid-Forming Controls = grid forming/following; Circuit Design = circuit/analog design; PCB Layout = pcb/board layout
Hardware Testing = oscilloscope/oscilloscopes, bench test/tests/testing, hardware test/testing, dvt, evt
""")
TOOLS = dictionary("""
ETAP; SKM PowerTools = skm; EasyPower = easypower, easy power; PSS/E = pss e, psse; PSCAD; PowerWorld = powerworld, power world; PSLF; CYME; Synergi Electric = synergi; PowerFactory = powerfactory, power factory, digsilent
Aspen OneLiner = aspen, oneliner; CAPE; RTDS / RSCAD = rtds, rscad; WindMil; AutoCAD; AutoCAD Electrical = autocad electrical, acade; Revit; MicroStation; EPLAN; SolidWorks Electrical; PLS-CADD = pls cadd, plscadd; Bentley Substation
Studio 5000 / RSLogix = studio 5000, studio5000, rslogix, logix 5000, logix5000, allen bradley; TIA Portal / STEP 7 = tia portal, step 7, step7, siemens s7, s7 1200/1500; Ignition; AVEVA / Wonderware = wonderware, aveva, intouch
FactoryTalk; DeltaV; Experion; Ovation; CODESYS; OSIsoft PI = osisoft, pi system/historian; Altium Designer = altium; OrCAD; Cadence Allegro = allegro; KiCad; LTspice = ltspice, lt spice; PSpice / SPICE = spice, pspice; PLECS; PSIM; Simulink
ANSYS Maxwell = maxwell; ANSYS HFSS = hfss; CST Studio = cst; Keysight ADS = ads, advanced design system; AWR Microwave Office = microwave office, awr; COMSOL
SEL AcSELerator = acselerator, sel 311/351/387/411/421/451/487/551/587/700/710/735/751/787, sel351/sel387/sel411/sel421/sel451/sel487/sel751; Omicron / Doble Test Sets = omicron, doble; Megger
Oscilloscopes & Analyzers = oscilloscope/oscilloscopes, spectrum/network analyzer/analyzers/analyser/analysers, vna; PVsyst; HOMER; Helioscope; AGi32 / DIALux = agi32, dialux; ArcGIS = arcgis, esri; Maximo / SAP PM = maximo, sap pm
""")
PROTOCOLS = dictionary("""
DNP3 = dnp3, dnp 3; Modbus; IEC 61850 GOOSE/MMS = goose, mms; IEC 60870-5-104 = 60870; OPC UA = opc; Profibus / Profinet = profibus, profinet; EtherNet/IP = ethernet ip; DeviceNet; HART; Foundation Fieldbus = fieldbus; BACnet
RS-485 / RS-232 = rs 485/232, rs485/rs232; CAN = can bus/fd, canbus, j1939; ARINC 429 = arinc; MIL-STD-1553 = 1553; SpaceWire; LTE / 5G = lte, 5g, 4g; Wi-Fi / Bluetooth = wi fi, wifi, 802 11, bluetooth; LoRa / Zigbee = lora, zigbee
GNSS / GPS = gnss, gps; Fiber Optics = fiber/fibre optic/optics; SONET / Telecom Transport = sonet, mpls
""")
CONCEPTS = dictionary("""
Substation Design = substation/substations; Transmission Lines = transmission/overhead line/lines; Distribution Systems = distribution system/systems/line/lines/network/networks/feeder/feeders, feeder/feeders
Protective Relaying = protective relay/relays, relaying, protection and control/controls, p & c; Transformers = transformer/transformers; Switchgear = switchgear, switchboard/switchboards; Circuit Breakers = circuit breaker/breakers
Motor Control Centers = mcc, motor control center/centers; VFDs / Drives = vfd, variable frequency, motor drive/drives; UPS = ups, uninterruptible; Generators = generator/generators; Electric Motors = motor/motors
Battery Energy Storage = energy storage, bess, lithium ion; Solar PV = solar, photovoltaic/photovoltaics, pv; Wind Energy = wind; Microgrids = microgrid/microgrids; Inverters = inverter/inverters; DC-DC Converters = dc dc, dcdc, converter/converters
Power Electronics; Gate Drivers = gate driver/drivers; Wide Bandgap (SiC/GaN) = sic, gan, wide bandgap; SCADA; DCS; Instrumentation = instrumentation, transmitter/transmitters; P&IDs = p & id, p & ids; Lighting Design = lighting design, luminaire/luminaires
Fire Alarm = fire alarm/alarms; Data Centers = data center/centers/centre/centres; Medium Voltage = medium voltage, mv; High Voltage = high voltage, hv, ehv; HVDC; EMC / EMI = emc, emi; RF Design = rf, radio frequency; Antennas = antenna/antennas
Microwave = microwave, mmwave, millimeter; Radar; PCB Design = pcb; Analog Circuits = analog circuit/circuits, op amp/amps, opamp/opamps; Embedded Systems = embedded, microcontroller/microcontrollers, mcu, arduino, stm32; Avionics
Wire Harness = harness/harnesses; Traction Power = traction power, catenary; EV Charging = ev charger/chargers/charging, charging station/stations, evse; Electric Vehicles = electric vehicle/vehicles, ev; Three-Phase Power = three/3 phase
Power Systems = power system/systems
""")
LANGUAGES = dictionary("""
Python; MATLAB; C++ = c++; LabVIEW; VBA / Excel Macros = vba, excel macro/macros; Ladder Logic = ladder; Structured Text; Function Block Diagram = function block/blocks; SQL; Verilog / VHDL = verilog, systemverilog, vhdl
""") | {"C": (When(("c",), unless_next=("++", "#")),)}
FAMILIES = {"standards": STANDARDS, "studies": STUDIES, "tools": TOOLS, "protocols": PROTOCOLS, "concepts": CONCEPTS, "languages": LANGUAGES}
# fixed values: licences and areas of projects, each with the words by which it is met
LICENCES = dictionary("""
PE = professional engineer, registered engineer, pe license/licence/licensed; EIT / FE = eit, engineer in training, fe exam/certified, fundamentals of engineering
OSHA 10/30 = osha 10/30, osha10/osha30; Security Clearance = secret/active clearance, top secret, ts sci
""")
SIGNALS = dictionary("""
Substation = substation/substations; Solar = solar, photovoltaic, pv; Battery = battery, bms; Inverter = inverter/inverters; Converter = converter/converters, buck, boost; Motor = motor/motors; PLC = plc, ladder; Microgrid = microgrid/microgrids
Antenna = antenna/antennas; Relay = relay/relays; Transformer = transformer/transformers; Power Flow = power/load flow; EV = electric vehicle/vehicles, ev, charging; Robot / Drone = robot/robots/robotic/robotics, drone/drones, uav; PCB = pcb, circuit board/boards
RF = rf, radio; Lighting = lighting; Wind = wind; Grid = grid; SCADA = scada
""")
# fixed values: degrees from the highest, fields as written, months, the headers that begin and end a projects section
DEGREES = {"PhD": ("phd", "ph d", "doctorate"), "MS": ("ms", "m s", "master", "masters"), "BS": ("bs", "b s", "bachelor", "bachelors", "b tech", "btech", "b e")}
FIELDS = ("electrical and computer engineering", "electrical engineering", "computer engineering", "power engineering", "electronics engineering", "electronics", "mechatronics", "ece", "eece")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
PROJECT_HEADERS = ("projects", "project", "project experience", "academic projects", "technical projects", "key projects", "relevant projects")
END_HEADERS = ("experience", "work experience", "education", "skills", "certifications", "publications", "awards", "employment")
GENERAL = "Electrical Engineering (general)"
BULLETS = " -*•●▪"
#: What a profile is about, by substrings: plurals are in their singulars.
FOCUS = tuple((k, tuple(dict.fromkeys(p for p in map(cut, v) if not (p.endswith("s") and p[:-1] in v)))) for k, v in BODIES)


def phrases(*dictionaries: dict) -> list[str]:
    return plain(e for d in dictionaries for terms in d.values() for e in terms)


def found_in(text: Column, these: list[str]) -> Column:
    """Struct of a text's words and its hits of the phrases, to be met by many dictionaries."""
    return once(words_of(text), lambda w: F.struct(w.alias("words"), hits(w, these).alias("hits")))


def named(x: Column, names: dict) -> Column:
    """The names of a dictionary that x (from found_in) meets, in its order."""
    return F.array_compact(F.array(*[F.when(met(x, terms), F.lit(k)) for k, terms in names.items()]))


def listed(x: Column, names: dict) -> Column:
    """As named, through a table from phrase to place, for dictionaries without conditions: its cost is that of the hits."""
    free = {k: v for k, v in names.items() if not any(isinstance(e, When) for e in v)}
    order = {k: i for i, k in enumerate(names)}
    of: dict[str, list[int]] = {}
    for k, terms in free.items():
        for p in dict.fromkeys(map(cut, terms)):
            of.setdefault(p, []).append(order[k])
    known = F.create_map(*[c for p, at in of.items() for c in (F.lit(p), F.array(*map(F.lit, at)))])
    places = F.flatten(F.array_compact(F.transform(F.array_distinct(x["hits"]["p"]), lambda p: known[p])))
    rest = F.array_compact(F.array(F.lit(None).cast("int"), *[F.when(met(x, v), F.lit(order[k])) for k, v in names.items() if k not in free]))
    labels = F.array(*map(F.lit, names))
    return F.transform(F.array_sort(F.array_union(places, rest)), lambda i: F.get(labels, i))


def extract_skills(text: Column, families=FAMILIES) -> Column:
    """The canonical skills of a text, family by family in dictionary order; the text is cut into words once. Null has none."""
    every = {k: v for d in families.values() for k, v in d.items()}
    return once(found_in(text, phrases(*families.values())), lambda x: listed(x, every))


def projects(text: Column, most: int = 12) -> Column:
    """The lines of the projects section: from its header to the next one, without bullets, of 6 to 160 characters, none all in capitals, at most `most`."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda s: F.trim(s))
    bare = lambda s: F.rtrim(F.lower(s), F.lit(": "))

    def section(x: Column) -> Column:
        opens = F.array_position(F.transform(x, lambda s: bare(s).isin(*PROJECT_HEADERS)), True)
        rest = F.when(opens > 0, F.slice(x, opens.cast("int") + 1, F.size(x))).otherwise(F.slice(x, 1, 0))
        return once(rest, inside)

    def inside(x: Column) -> Column:
        ends = F.array_position(F.transform(x, lambda s: F.lower(s).rlike(rf"^(?:{'|'.join(END_HEADERS)})(?![a-z0-9])")), True)
        own = F.when(ends > 0, F.slice(x, 1, ends.cast("int") - 1)).otherwise(x)
        good = F.filter(own, lambda s: (F.length(s) >= 6) & ~((F.upper(s) == s) & s.rlike("[A-Z]")) & ~bare(s).isin(*PROJECT_HEADERS))
        return F.slice(F.filter(F.transform(good, lambda s: F.ltrim(s, F.lit(BULLETS))), lambda s: F.length(s).between(1, 160)), 1, most)

    return once(lines, section)


def signals_of(text: Column, signals: dict = SIGNALS) -> Column:
    """The areas that a posting or a project touches."""
    return once(found_in(text, phrases(signals)), lambda x: listed(x, signals))


def _person(text: Column) -> Column:
    """The first line that can be a name: 3 to 40 characters, up to four words of letters, dots, hyphens and apostrophes."""
    word = lambda w: F.translate(w, ".'-", "").rlike("^[A-Za-z]*$")
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda s: F.trim(s))
    return F.filter(lines, lambda s: F.length(s).between(3, 40) & (F.size(F.split(s, " +")) <= 4) & F.forall(F.split(s, " +"), word))


def _years(numbered: Column) -> Column:
    """The number that stands before the first "years (of) experience" among words that keep their decimals."""
    said = each("year/years experience", "year/years of experience")
    before = F.transform(hits(numbered, plain(said)), lambda h: F.get(numbered, h["at"] - 1).try_cast("double"))
    return F.coalesce(F.get(F.array_compact(before), F.lit(0)), F.lit(0.0))


def _graduation(words: Column) -> Column:
    """The first year from 2020 to 2039, after the month before it if there is one."""
    years = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("y"), F.lower(F.get(words, i - 1)).alias("m"))), lambda x: F.when(F.length(x["y"]) == 4, x["y"].try_cast("int")).between(2020, 2039))
    return once(F.get(years, F.lit(0)), lambda x: F.when(x.isNull(), "").otherwise(F.concat_ws(" ", F.when(F.left(x["m"], F.lit(3)).isin(*MONTHS), F.initcap(x["m"])), x["y"])))


def parse_profile(text: Column, families=FAMILIES) -> Column:
    """Struct of what a profile's text says: name, degree, field, grad_date, years, projects, an array for each family, licences, signals, all_skills (sorted), role_focus.

    Nothing is guessed: what is not found is empty (years 0). A null text gives empty fields. `signals` are the areas that
    its projects touch.
    """
    t = low(text)
    field = F.upper(F.regexp_extract(t, rf"(?<![a-z0-9])({'|'.join(FIELDS)})(?![a-z0-9])", 1))
    numbered = F.regexp_extract_all(t, F.lit(r"[0-9]+(?:\.[0-9]+)?|[a-z]+"), F.lit(0))
    grad, years = once(numbered, _graduation), once(numbered, _years)
    own_projects = projects(text)

    def skilled(x: Column) -> Column:
        own = {k: listed(x, d) for k, d in families.items()}
        rest = (named(x, LICENCES).alias("licences"), signals_of(F.array_join(own_projects, "\n")).alias("signals"), F.array_sort(F.array_distinct(F.concat(*own.values()))).alias("all_skills"))
        return F.struct(*[v.alias(k) for k, v in own.items()], *rest, F.coalesce(F.get(named(x, DEGREES), F.lit(0)), F.lit("")).alias("degree"))

    s = once(found_in(text, phrases(*families.values(), LICENCES, DEGREES)), skilled)
    focus = F.coalesce(best_category(F.array_join(words_of(text), " "), FOCUS, 2, whole=False), F.lit(GENERAL))
    return once(s, lambda s: F.struct(F.coalesce(F.get(_person(text), F.lit(0)), F.lit("")).alias("name"), s["degree"].alias("degree"), field.alias("field"), grad.alias("grad_date"), years.alias("years"), own_projects.alias("projects"), s.alias("skills"), focus.alias("role_focus")))

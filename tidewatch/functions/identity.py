"""Rules that tell real projects from report furniture."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.binding import let

# States and territories that appear as summary rows.
STATES = [
    "ANDHRA PRADESH", "ARUNACHAL PRADESH", "ASSAM", "BIHAR", "CHHATTISGARH", "GOA", "GUJARAT",
    "HARYANA", "HIMACHAL PRADESH", "JHARKHAND", "KARNATAKA", "KERALA", "MADHYA PRADESH",
    "MAHARASHTRA", "MANIPUR", "MEGHALAYA", "MIZORAM", "NAGALAND", "ODISHA", "ORISSA", "PUNJAB",
    "RAJASTHAN", "SIKKIM", "TAMIL NADU", "TELANGANA", "TRIPURA", "UTTAR PRADESH", "UTTARAKHAND",
    "WEST BENGAL", "DELHI", "JAMMU & KASHMIR", "JAMMU AND KASHMIR", "LADAKH", "CHANDIGARH",
    "PUDUCHERRY", "ANDAMAN & NICOBAR", "DADRA & NAGAR HAVELI", "DAMAN & DIU",
]
# Sectors that appear as summary rows.
SECTORS = [
    "RAILWAYS", "ROAD TRANSPORT AND HIGHWAYS", "POWER", "PETROLEUM", "TELECOMMUNICATIONS",
    "COAL", "FERTILISERS", "STEEL", "CIVIL AVIATION", "SHIPPING", "PORTS AND LIGHTHOUSES",
    "URBAN DEVELOPMENT", "WATER RESOURCES", "ATOMIC ENERGY", "MINES", "HEAVY INDUSTRY",
]
# Name patterns of macro-summary rows, in order.
MACRO_PATTERNS = [
    r"\bFLA\b", r"\bLAS\b", r"\bMULTI\s*STATE\b", r"\bTOTAL\b", r"\bSUMMARY\b", r"\bALL\s*INDIA\b",
    r"\bGRAND\s*TOTAL\b", r"\bSTATEMENT\b", r"\bTABLE\b",
    r"RAILWAYS\s+(?:LAS|AS|A|AND)?\s*ROAD TRANSPORT",
    r"ROAD TRANSPORT AND HIGHWAYS\s+(?:LAS|AS|AND)?\s*SHIPPING",
    r"PETROLEUM\s+(?:LAS|AS|A|AND)?\s*POWER",
    r"COAL\s+(?:LAS|AS|A|AND)?\s*MINES",
    r"^\s*FL\s+", r"^\s*F\s+",
]
# Titles that mark a summary row even under an official id.
MACRO_TITLES = ["TOTAL", "SUMMARY", "ALL INDIA", "MULTI STATE", "GRAND TOTAL"]
# Words of front-matter pages.
FRONT_MATTER = ["EXECUTIVE", "HIGHLIGHTS", "FLASH REPORT", "OVERVIEW"]

_TABLE = r"(?i)\b(?:table\s*[:-]?\s*\d+|table\s*[–-]\s*\d+|annexure(?:\s*[-–]\s*[a-z0-9]+)?)\b"
_SECTION_WORDS = (
    r"details?\s+of\s+central\s+sector|details?\s+of\s+ongoing|list\s+of\s+projects?|projects?\s+showing"
    r"|ahead\s+of\s+schedule|delayed|on\s+schedule|without\s+schedule|project\s+status\s+with\s+respect"
    r"|summary\s+of\s+projects|flash\s+report|status\s+report|costing\s+rs|statement\s+showing"
    r"|sector\s+wise|state\s+wise|ministry\s+wise|central\s+sector\s+projects?"
)
_COLUMN_WORDS = (
    r"sl\.?\s*no|si\.?\s*no|s\.?no|date\s+of\s+commissioning|date\s+of\s+approval|original\s*/\s*revised"
    r"|anticipated\s+cost|cumulative\s+expenditure|cost\s+overrun|time\s+overrun|expenditure\s+is\s+more"
    r"|project\s+doa\s+doc|sn\s+project"
)
_BARE_SECTORS = (
    r"civil\s+aviation|telecom(?:munications?)?|mines|fertilizers?|shipping|ports|dpiit|doner|home\s+affairs"
    r"|commerce|finance|social\s+justice|water\s+resources|health|heavy\s+industries"
    r"|department\s+of\s+[a-z\s]+|ministry\s+of\s+[a-z\s]+"
)
_BARE_HEAD = r"railways?|coal|power|petroleum|steel|atomic\s+energy"
_GENERIC = (
    r"(?i)^(?:total|grand\s+total|all\s+projects|sub[- ]?total|various|miscellaneous|ongoing\s+projects?"
    r"|completed\s+projects?|others?|nil|none|na|n\.a\.?)$"
)
_FRAGMENT = r"^([0-9\W_]{1,4}|[A-Za-z]{1,3})$"

# What makes a derived id no project.
EXCLUSION_PATTERNS = [
    _TABLE,
    rf"(?i)\b(?:{_SECTION_WORDS})\b",
    rf"(?i)\b(?:{_COLUMN_WORDS}|doa\s+doc)\b",
    rf"(?i)^(?:{_BARE_HEAD}|road\s+transport(?:\s+and\s+highways)?|{_BARE_SECTORS}|urban\s+development)$",
    _GENERIC,
    _FRAGMENT,
]
# Named audit rules, in order.
AUDIT_RULES = [
    ("TABLE_HEADING", _TABLE),
    ("REPORT_TITLE_OR_SECTION",
     rf"(?i)\b(?:{_SECTION_WORDS}|part\s*[-–]?\s*(?:i{{1,3}}|iv|v|1|2))\b"),
    ("COLUMN_HEADER_ARTIFACT",
     rf"(?i)\b(?:{_COLUMN_WORDS}|expenditure\s+cost|original/revised)\b"),
    ("GENERIC_MINISTRY_OR_SECTOR",
     rf"(?i)^(?:{_BARE_HEAD}|road\s+transport\s+and\s+highways|{_BARE_SECTORS})$"),
    ("GENERIC_NON_PROJECT", _GENERIC),
    ("FRAGMENT_OR_SHORT_CODE", _FRAGMENT),
]
# How a heading starts, and how a real works title starts.
HEADING_START = (
    r"(?i)^(?:table|annexure|details?\s+of|list\s+of|projects?\s+showing|summary|sector|state|ministry|railways"
    r"|coal|power|petroleum|steel|atomic\s+energy|civil\s+aviation|mines|dpiit|doner|commerce|finance"
    r"|road\s+transport|home\s+affairs|urban\s+development|water\s+resources|health|department\s+of"
    r"|telecommunications?)\b"
)
HEADING_COLUMNS = r"(?i)\b(?:sn\s+project|doa\s+doc)\b"
WORKS_START = (
    r"(?i)^(?:construction|widening|4-lan|four\s+lan|six\s+lan|transmission|ts\s+for|rehabilitation"
    r"|augmentation|development|laying|setting|bg\s+line|gauge|doubling)\b"
)


def is_derived_id(pid: Column) -> Column:
    return pid.startswith("PRJ_")


def is_non_project(pid: Column, name: Column) -> Column:
    """Furniture filter for derived ids; official ids always stay."""
    def furniture(n: Column) -> Column:
        hit = F.lit(False)
        for p in EXCLUSION_PATTERNS:
            hit = hit | n.rlike(p)
        return hit

    return is_derived_id(pid) & let(F.trim(F.coalesce(name, F.lit(""))), furniture)


def audit_reason(name: Column) -> Column:
    """``RULE: matched 'text'`` of the first rule the name meets, else NULL."""
    return F.coalesce(*[
        F.when(name.rlike(p), F.concat(
            F.lit(f"{rule}: matched '"), F.regexp_extract(name, p, 0), F.lit("'")))
        for rule, p in AUDIT_RULES])


def audit_action(pid: Column, primary_name: Column, reason: Column) -> Column:
    """KEEP, REVIEW or EXCLUDE for a flagged entity."""
    rule = F.substring_index(reason, ":", 1)
    heading = primary_name.rlike(HEADING_START) | primary_name.rlike(HEADING_COLUMNS)
    decisive = rule != "COLUMN_HEADER_ARTIFACT"
    return (
        F.when(~is_derived_id(pid) & primary_name.rlike(WORKS_START), F.lit("KEEP"))
        .when(~is_derived_id(pid), F.lit("REVIEW"))
        .when(heading | decisive, F.lit("EXCLUDE"))
        .otherwise(F.lit("REVIEW"))
    )


def macro_reason(pid: Column, name: Column) -> Column:
    """Why a row is a macro summary, or ``GENUINE``."""
    derived = is_derived_id(F.trim(F.coalesce(pid, F.lit(""))))

    def classify(n: Column) -> Column:
        keyword = F.coalesce(*[
            F.when(n.rlike("(?i)" + p), F.lit(f"MACRO_KEYWORD_{p}")) for p in MACRO_PATTERNS])
        state = F.trim(F.regexp_replace(n, r"^STATE\s*:\s*", ""))
        sector = F.trim(F.regexp_replace(
            F.trim(F.regexp_replace(n, r"^SECTOR\s*:\s*", "")), r"[\*\s]+$", ""))
        front = F.lit(False)
        for word in FRONT_MATTER:
            front = front | F.contains(n, F.lit(word))
        return F.coalesce(
            let(keyword, lambda k: F.when(derived, k).when(
                k.isNotNull() & n.isin(MACRO_TITLES), F.concat(F.lit("OFFICIAL_MACRO_TITLE_"), n))),
            let(state, lambda s: F.when(s.isin(STATES), F.concat(F.lit("STATE_SUMMARY_ROW: "), s))),
            let(sector, lambda s: F.when(s.isin(SECTORS), F.concat(F.lit("SECTOR_SUMMARY_ROW: "), s))),
            F.when(derived & front, F.lit("SYNTHETIC_EXECUTIVE_SUMMARY")),
            F.lit("GENUINE"),
        )

    return let(F.upper(F.trim(F.coalesce(name, F.lit("")))), classify)


def is_macro_summary(pid: Column, name: Column) -> Column:
    return macro_reason(pid, name) != "GENUINE"


def is_genuine(pid: Column, name: Column) -> Column:
    """An official id on a row that is no macro summary."""
    p = F.trim(F.coalesce(pid, F.lit("")))
    return ~is_macro_summary(pid, name) & (p.rlike(r"^\d{8,9}$") | p.rlike(r"^[A-Z]\d{7,8}$"))

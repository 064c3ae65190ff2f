"""Text normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.binding import let

# Every character Unicode-aware text tools treat as white space.
SPACE_CLASS = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)

# What clean_text has to change: runs of white space, and a single one that is no blank. Visible ASCII fails at the first test.
_UNCLEAN = rf"(?=[^!-~])(?! [!-~])(?:{SPACE_CLASS}{{2,}}|{SPACE_CLASS.replace(r'\x1F \x{85}', r'\x1F\x{85}')})"

PROJECT_CODE = r"[Nn]\d{8}|\b\d{9}\b"

# Sector words and their canonical titles. The first entry whose
# key occurs in the cleaned text wins, so the order matters.
SECTOR_TITLES = [
    ("ROAD TRANSPORT AND HIGHWAYS", "Road Transport And Highways"),
    ("ROAD TRANSPORT & HIGHWAYS", "Road Transport And Highways"),
    ("ROADS AND HIGHWAYS", "Road Transport And Highways"),
    ("ROADS & HIGHWAYS", "Road Transport And Highways"),
    ("RAILWAYS", "Railways"),
    ("RAILWAY", "Railways"),
    ("PETROLEUM", "Petroleum"),
    ("PETROLEUM AND NATURAL GAS", "Petroleum"),
    ("PETROLEUM & NATURAL GAS", "Petroleum"),
    ("COAL", "Coal"),
    ("POWER", "Power"),
    ("ATOMIC ENERGY", "Atomic Energy"),
    ("CIVIL AVIATION", "Civil Aviation"),
    ("MINES", "Mines"),
    ("STEEL", "Steel"),
    ("FERTILIZERS", "Fertilizers"),
    ("SHIPPING", "Shipping and Ports"),
    ("SHIPPING AND PORTS", "Shipping and Ports"),
    ("PORTS AND LIGHTHOUSES", "Shipping and Ports"),
    ("PORTS", "Shipping and Ports"),
    ("TELECOMMUNICATIONS", "Telecommunications"),
    ("TELECOM", "Telecommunications"),
    ("URBAN DEVELOPMENT", "Urban Development"),
    ("WATER RESOURCES", "Water Resources"),
    ("HEALTH AND FAMILY WELFARE", "Health and Family Welfare"),
    ("HEAVY INDUSTRY", "Heavy Industry"),
    ("COMMERCE AND INDUSTRY", "Commerce and Industry"),
    ("DEFENCE", "Defence"),
    ("FINANCE", "Finance"),
    ("TEXTILES", "Textiles"),
]

# Patterns removed from a title cell, applied in this order.
TITLE_NOISE = [
    r"-\s*\[.*?\](?:\s*,\s*[^,]+)?(?:\s*,\s*[^\n]+)?",
    r"-\s*\(.*?\)(?:\s*,\s*[^,]+)?(?:\s*,\s*[^\n]+)?",
    r"-\s*\[.*$",
    r"-\s*\(.*$",
    r"\[[Nn]?\d{8,9}\].*$",
    r"\([Nn]?\d{8,9}\).*$",
    r"\([A-Za-z0-9\s\.\&\-]{2,20}\)\s*$",
    r"[\s,\-]+$",
    r"^\s*-\s*",
]


def clean_text(c: Column) -> Column:
    """Collapse white space runs to one blank and trim; NULL becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), _UNCLEAN, " "))


def strip_brackets(c: Column) -> Column:
    return F.regexp_replace(c, r"[\[\](){}]", "")


def non_empty(c: Column) -> Column:
    return F.when(c != "", c)


def extract_project_code(c: Column) -> Column:
    """First official code in the text, upper-cased, else NULL."""
    return let(F.upper(F.regexp_extract(c, PROJECT_CODE, 0)), non_empty)


def derived_project_id(name: Column, sector: Column, ministry: Column, state: Column) -> Column:
    """Stable id from descriptive fields, for rows that carry no official code."""
    parts = [
        F.regexp_replace(F.upper(F.coalesce(x, F.lit(""))), "[^A-Z0-9]", "")
        for x in (name, sector, ministry, state)
    ]
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    return F.concat(F.lit("PRJ_"), F.upper(F.substring(digest, 1, 12)))


def normalize_project_id(
    code: Column, name: Column, sector: Column, ministry: Column, state: Column
) -> Column:
    """Official code from either cell, else the derived id, else empty."""
    usable = let(clean_text(name), lambda t: (F.length(t) >= 3) & ~t.rlike(r"^\d+$"))
    return F.coalesce(
        extract_project_code(code),
        extract_project_code(name),
        F.when(usable, derived_project_id(name, sector, ministry, state)),
        F.lit(""),
    )


def clean_sector_name(c: Column) -> Column:
    """Canonical sector title, or NULL when the text names no known sector."""
    letters = F.upper(F.regexp_replace(c, r"[^a-zA-Z\s&]", " "))

    def lookup(s: Column) -> Column:
        title = F.lit(None).cast("string")
        for key, value in reversed(SECTOR_TITLES):
            title = F.when(F.contains(s, F.lit(key)), F.lit(value)).otherwise(title)
        return F.when(F.length(s) >= 3, title)

    return let(F.trim(F.regexp_replace(letters, r"\s+", " ")), lookup)


def clean_project_title(c: Column) -> Column:
    """Drop codes, agencies and dangling punctuation from a title cell."""

    def strip_noise(t: Column) -> Column:
        for pattern in TITLE_NOISE:
            t = F.trim(F.regexp_replace(t, pattern, ""))
        return clean_text(t)

    # every pattern needs one of these marks, or white space at an end, which clean text has not
    return let(clean_text(c), lambda t: F.when(t.rlike(r"[-\[(,]"), strip_noise(t)).otherwise(t))


def multi_field(c: Column) -> Column:
    """Split a stacked cell into ``struct(original, revised, anticipated)``.

    Lines in braces or square brackets are anticipated, lines in parentheses
    are revised (the last one wins for both); plain lines fill the first slot
    still empty. One left fold over the lines; a cell of one line needs none.
    """
    text = F.coalesce(c, F.lit(""))
    lines = F.filter(
        F.transform(F.split(text, "\r\n|\r|\n"), lambda x: F.trim(x)),
        lambda x: x != "",
    )
    names = ("original", "revised", "anticipated")
    empty = F.struct(*[F.lit(None).cast("string").alias(n) for n in names])

    def kinds(line: Column) -> tuple[Column, Column, Column]:
        ahead = line.startswith("{") | line.startswith("[")
        paren = ~ahead & line.startswith("(") & line.endswith(")")
        return ahead, paren, ~ahead & ~paren

    def step(acc: Column, line: Column) -> Column:
        o, r, a = acc["original"], acc["revised"], acc["anticipated"]
        ahead, paren, plain = kinds(line)
        take_o = plain & o.isNull()
        take_r = plain & o.isNotNull() & r.isNull()
        take_a = plain & o.isNotNull() & r.isNotNull() & a.isNull()
        return F.struct(
            F.when(take_o, line).otherwise(o).alias("original"),
            F.when(paren | take_r, line).otherwise(r).alias("revised"),
            F.when(ahead | take_a, line).otherwise(a).alias("anticipated"),
        )

    only = F.trim(text)
    ahead, paren, plain = kinds(only)
    single = F.struct(*[F.when((only != "") & kind, only).alias(n) for n, kind in zip(names, (plain, paren, ahead))])
    return F.when(text.rlike(r"[\r\n]"), F.aggregate(lines, empty, step)).otherwise(single)

"""The target schema, the rule catalogue and the lookup tables of the property-schedule profile."""

from __future__ import annotations

# The seventeen target fields in their order, each with its type, its column here and its weight.
TARGET_FIELDS: list[tuple[str, str, str, float]] = [
    ("Reference", "string", "reference", 0.6),
    ("Address", "string", "address", 1.0),
    ("City", "string", "city", 0.7),
    ("State", "string", "state", 0.9),
    ("Zip", "integer", "zip", 0.9),
    ("County", "string", "county", 0.2),
    ("Country", "string", "country", 0.2),
    ("Building Value", "float", "building_value", 1.0),
    ("Contents", "float", "contents", 0.8),
    ("BI", "float", "bi", 0.7),
    ("Occupancy", "string", "occupancy", 0.8),
    ("Construction", "string", "construction", 0.9),
    ("Storeys", "integer", "storeys", 0.6),
    ("Number of Buildings", "integer", "number_of_buildings", 0.4),
    ("Year Built", "integer", "year_built", 0.7),
    ("Fire Sprinklers (Y/N)", "string", "sprinklers", 0.7),
    ("Other", "float", "other", 0.3),
]
FIELD_NAMES = [name for name, *_ in TARGET_FIELDS]
COLUMNS = [column for _, _, column, _ in TARGET_FIELDS]
FIELD_OF = {column: name for name, _, column, _ in TARGET_FIELDS}
COLUMN_OF = {name: column for name, _, column, _ in TARGET_FIELDS}
WEIGHTS = {name: weight for name, _, _, weight in TARGET_FIELDS}
VALUE_FIELDS = [name for name, kind, _, _ in TARGET_FIELDS if kind == "float"]
INTEGER_FIELDS = [name for name, kind, _, _ in TARGET_FIELDS if kind == "integer"]
VALUE_COLUMNS = [COLUMN_OF[f] for f in VALUE_FIELDS]
INTEGER_COLUMNS = [COLUMN_OF[f] for f in INTEGER_FIELDS]

# Texts that mean no value, for cells and (a shorter list) for the column profiler.
NULL_TOKENS = ["", "na", "n/a", "n.a.", "none", "null", "nil", "-", "--", "---", "?", "tbd", "tba", "unknown", "unk", "n/k", "not known", "#n/a", "#ref!", "#value!", "#div/0!"]
PROFILE_NULL_TOKENS = ["na", "n/a", "none", "null", "-", "--", "tbd", "unknown"]

# Each rule's severity, and its confidence when it proposes no operation.
RULES: dict[str, tuple[str, float | None]] = {
    "DQ-01": ("Medium", 0.60),
    "DQ-02": ("High", 0.65),
    "DQ-03": ("High", 0.65),
    "DQ-04": ("High", 0.62),
    "DQ-05": ("High", 0.65),
    "DQ-06": ("High", 0.62),
    "DQ-07": ("Medium", 0.60),
    "DQ-08": ("Low", 0.55),
    "DQ-09": ("Low", 0.55),
    "DQ-10": ("Low", None),
    "DQ-11": ("Medium", 0.60),
    "DQ-12": ("Medium", None),
    "DQ-13": ("Medium", 0.50),
    "DQ-14": ("Low", 0.55),
    "DQ-15": ("High", None),
    "DQ-16": ("Medium", 0.60),
    "DQ-17": ("Low", 0.58),
    "DQ-18": ("Low", 0.52),
}
DEFAULT_FLAG_CONFIDENCE, CAMPUS_CONFIDENCE = 0.55, 0.40
ELEVATED = [*VALUE_FIELDS, "Reference"]  # DQ-01 is High there
SUPERSEDES = {"DQ-12": ["DQ-05", "DQ-06"]}
SEVERITY_RANK = {"High": 0, "Medium": 1, "Low": 2}
SEVERITY_COST = {"High": 1.0, "Medium": 0.4, "Low": 0.1}
SCORE_WEIGHTS = {"completeness": 0.60, "validity": 0.25, "coverage": 0.15}
UNCERTAINTY_BELOW, EXAMPLES = 0.70, 20

# The operations, with confidence and kind of action.
OPERATIONS: dict[str, tuple[float, str]] = {
    "zip5": (0.95, "type_conversion"),
    "state_to_abbrev": (0.93, "normalise_value"),
    "strip_currency_to_float": (0.95, "type_conversion"),
    "to_float": (0.90, "type_conversion"),
    "to_int": (0.85, "type_conversion"),
    "map_values": (0.88, "normalise_value"),
    "trim_normalise": (0.90, "normalise_value"),
    "set_null": (0.85, "set_null"),
    "exclude_row": (0.78, "exclude_row"),
}
UNSUPPORTED_OPERATIONS = ["rename", "split_column", "merge_columns"]

# Spellings of states, and the ranges of the first three zip digits by state.
STATE_NAMES: dict[str, str] = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE",
    "district of columbia": "DC", "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA",
    "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA", "michigan": "MI", "minnesota": "MN",
    "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ",
    "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR",
    "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT",
    "vermont": "VT", "virginia": "VA", "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY",
    "puerto rico": "PR", "virgin islands": "VI", "guam": "GU", "american samoa": "AS", "northern mariana islands": "MP",
    "washington dc": "DC", "washington d.c.": "DC", "d.c.": "DC", "dc": "DC", "v.i.": "VI", "u.s.v.i.": "VI", "usvi": "VI", "virgin islands (us)": "VI",
    "p.r.": "PR", "puerto rico (us)": "PR", "n.y.": "NY", "calif": "CA", "calif.": "CA", "mass": "MA", "mass.": "MA", "penn": "PA", "penna": "PA",
    "penn.": "PA", "fla": "FL", "fla.": "FL", "tex": "TX", "tex.": "TX", "ariz": "AZ", "ariz.": "AZ", "wash": "WA",
}
STATE_CODES = sorted(set(STATE_NAMES.values()))
ZIP_RANGES: dict[str, list[tuple[int, int]]] = {
    "AL": [(350, 369)], "AK": [(995, 999)], "AZ": [(850, 853), (855, 857), (859, 860), (863, 865)], "AR": [(716, 729), (755, 755)],
    "CA": [(900, 908), (910, 928), (930, 961)], "CO": [(800, 816)], "CT": [(60, 69)], "DC": [(200, 205), (569, 569)], "DE": [(197, 199)],
    "FL": [(320, 339), (341, 342), (344, 344), (346, 347), (349, 349)], "GA": [(300, 319), (398, 399)], "HI": [(967, 968)], "ID": [(832, 838)],
    "IL": [(600, 629)], "IN": [(460, 479)], "IA": [(500, 528)], "KS": [(660, 679)], "KY": [(400, 427)], "LA": [(700, 701), (703, 708), (710, 714)],
    "ME": [(39, 49)], "MD": [(206, 219)], "MA": [(10, 27), (55, 55)], "MI": [(480, 499)], "MN": [(550, 567)], "MS": [(386, 397)], "MO": [(630, 658)],
    "MT": [(590, 599)], "NE": [(680, 693)], "NV": [(889, 898)], "NH": [(30, 38)], "NJ": [(70, 89)], "NM": [(870, 884)],
    "NY": [(4, 5), (63, 63), (100, 149)], "NC": [(269, 289)], "ND": [(580, 588)], "OH": [(430, 459)], "OK": [(730, 731), (734, 749)], "OR": [(970, 979)],
    "PA": [(150, 196)], "RI": [(28, 29)], "SC": [(290, 299)], "SD": [(570, 577)], "TN": [(370, 385)], "TX": [(733, 733), (750, 799), (885, 885)],
    "UT": [(840, 847)], "VT": [(50, 59)], "VA": [(201, 201), (220, 246)], "WA": [(980, 994)], "WV": [(247, 268)], "WI": [(530, 549)], "WY": [(820, 831)],
    "PR": [(6, 9)], "VI": [(8, 8)], "GU": [(969, 969)], "AS": [(967, 967)], "MP": [(969, 969)],
}
LEADING_ZERO_STATES = sorted(s for s, found in ZIP_RANGES.items() if any(lo < 100 for lo, _ in found))

# Sprinkler codes, their spellings, and terms that a human must code.
SPRINKLER_CODES = ["Y", "N", "Y13", "Y(13R)"]
SPRINKLER_SPELLINGS: dict[str, str] = {
    "y": "Y", "yes": "Y", "true": "Y", "t": "Y", "sprinklered": "Y", "fully sprinklered": "Y", "full": "Y", "wet": "Y", "dry": "Y",
    "n": "N", "no": "N", "false": "N", "f": "N", "none": "N", "not sprinklered": "N", "unsprinklered": "N", "non-sprinklered": "N",
    "y13": "Y13", "y 13": "Y13", "y-13": "Y13", "nfpa 13": "Y13", "nfpa13": "Y13",
    "y(13r)": "Y(13R)", "y13r": "Y(13R)", "y 13r": "Y(13R)", "y-13r": "Y(13R)", "nfpa 13r": "Y(13R)", "nfpa13r": "Y(13R)",
}
SPRINKLER_AMBIGUOUS = ["partial", "partially", "partially sprinklered", "part", "partial coverage", "some", "some areas", "p", "partial/none", "y/n", "mixed", "varies", "see schedule", "per schedule", "tbd", "under review", "in progress", "y - partial", "partial - y", "limited", "warehouse only", "office only"]

# Words of the construction, placeholder, totals and address rules.
FRAME_TERMS = ["frame", "wood", "woodframe", "wood frame", "timber", "joisted wood", "iso 1", "iso class 1", "construction class 1", "frame/wood"]
FRAME_EXCLUSIONS = ["non-combustible", "noncombustible", "non combustible", "steel frame", "metal frame", "concrete frame", "steel framed", "reinforced concrete", "fire resistive", "masonry"]
MAX_FRAME_STOREYS = 6
PLACEHOLDER_YEARS, PLACEHOLDER_REPEATS = [0, 1900, 1800, 1000, 1111, 9999], 3
EARLIEST_YEAR = 1700
COMPONENT_LIMIT, TOLERANCE, MIN_TOTAL_ROWS = 10.0, 0.01, 3
TOTAL_WORDS = ["total", "subtotal", "sub-total", "grand total", "sum of"]
TOTAL_LABEL_LENGTH = 32
TIV_HINTS = ["tiv", "total insured value", "total value", "total insurable value", "grand total", "total", "sum insured", "total limit", "combined value"]
STREET_WORDS: dict[str, str] = {
    "street": "st", "st": "st", "avenue": "ave", "ave": "ave", "road": "rd", "rd": "rd", "drive": "dr", "dr": "dr", "boulevard": "blvd", "blvd": "blvd",
    "lane": "ln", "ln": "ln", "court": "ct", "ct": "ct", "place": "pl", "pl": "pl", "parkway": "pkwy", "pkwy": "pkwy", "highway": "hwy", "hwy": "hwy",
    "suite": "ste", "ste": "ste", "north": "n", "south": "s", "east": "e", "west": "w", "northeast": "ne", "northwest": "nw", "southeast": "se", "southwest": "sw",
}
# Notations of a year, in the order in which they are tried. [0-9] is any digit, as Spark and SQL engines differ in what else \d is.
DATE_SHAPES: list[tuple[str, str]] = [
    ("bare year", r"^\s*(1[6-9][0-9]{2}|20[0-9]{2})\s*$"),
    ("ISO date", r"^\s*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"),
    ("slash date", r"^\s*[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\s*$"),
    ("dotted date", r"^\s*[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{2,4}\s*$"),
    ("decade", r"(?i)^\s*[0-9]{4}\s*'?s\s*$"),
    ("month name", r"[A-Za-z]{3,9}\s+[0-9]{4}"),
]

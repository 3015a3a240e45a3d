"""Fixed values that must equal the reference's for identical results.

FIXED VALUES — copied as plain data, in the reference's natural order.
Changing any entry changes normalised text, blocking keys and recall.
"""

# FIXED VALUES: legal suffixes, stripped from the end of a name one after
# another in exactly this order (a single ordered pass).
LEGAL_SUFFIXES = [
    "private limited", "pvt ltd", "pvt. ltd.", "pvt. ltd", "pvt ltd.",
    "public limited", "pub ltd",
    "limited liability partnership", "llp",
    "limited liability company", "llc",
    "incorporated", "incorporation",
    "corporation", "corp.", "corp",
    "limited", "ltd.", "ltd",
    "company", "co.",
    "partners", "partnership",
    "associates", "associate",
    "enterprises", "enterprise",
    "solutions", "solution",
    "services", "service",
    "group", "holdings", "holding",
    "industries", "industry",
    "international", "intl",
    "brothers", "bros.", "bros",
    "& sons", "and sons",
]

# FIXED VALUES: token expansions for business names.
NAME_ABBREV = {
    "&": "and",
    "st.": "saint",
    "dr.": "doctor",
    "mr.": "mister",
    "mrs.": "missus",
    "prof.": "professor",
    "natl": "national",
    "intl": "international",
    "assn": "association",
    "mgmt": "management",
    "mgr": "manager",
    "dept": "department",
    "univ": "university",
    "tech": "technology",
    "sys": "systems",
    "svc": "service",
    "svcs": "services",
    "mfg": "manufacturing",
    "dist": "distribution",
    "dev": "development",
    "res": "resources",
    "prop": "properties",
    "inv": "investments",
    "fin": "financial",
    "ins": "insurance",
    "med": "medical",
    "hosp": "hospital",
    "educ": "education",
    "comm": "communications",
}

# FIXED VALUES: token expansions for addresses.
ADDR_ABBREV = {
    "st": "street",
    "st.": "street",
    "ave": "avenue",
    "ave.": "avenue",
    "blvd": "boulevard",
    "blvd.": "boulevard",
    "rd": "road",
    "rd.": "road",
    "dr": "drive",
    "dr.": "drive",
    "ln": "lane",
    "ln.": "lane",
    "ct": "court",
    "ct.": "court",
    "pl": "place",
    "pl.": "place",
    "sq": "square",
    "sq.": "square",
    "fwy": "freeway",
    "hwy": "highway",
    "pkwy": "parkway",
    "expy": "expressway",
    "trl": "trail",
    "trce": "trace",
    "ter": "terrace",
    "ter.": "terrace",
    "terr": "terrace",
    "n": "north",
    "s": "south",
    "e": "east",
    "w": "west",
    "ne": "northeast",
    "nw": "northwest",
    "se": "southeast",
    "sw": "southwest",
    "apt": "apartment",
    "apt.": "apartment",
    "ste": "suite",
    "ste.": "suite",
    "fl": "floor",
    "bldg": "building",
    "bldg.": "building",
    "nagar": "nagar",
    "marg": "marg",
    "ph": "phase",
}

# FIXED VALUES: words dropped from names (never from addresses).
NAME_STOPWORDS = ["the", "a", "an", "of", "in", "at", "by", "for", "and", "or"]

# FIXED VALUES: address tokens too common for the v2 address keys.
COMMON_ADDR_TOKENS = [
    "ca", "ny", "tx", "fl", "il", "pa", "oh", "ga", "nc", "mi",
    "nj", "va", "wa", "az", "ma", "tn", "in", "mo", "md", "wi",
    "co", "mn", "sc", "al", "la", "ky", "or", "ok", "ct", "ut",
    "ia", "nv", "ar", "ms", "ks", "ne", "nm", "wv", "id", "hi",
    "nh", "me", "ri", "mt", "de", "sd", "nd", "ak", "vt", "wy",
    "pradesh", "maharashtra", "karnataka", "gujarat", "rajasthan",
    "tamil", "nadu", "bengal", "kerala", "andhra", "telangana",
    "bihar", "odisha", "jharkhand", "uttarakhand", "himachal",
    "north", "south", "east", "west", "new", "old", "main", "road",
    "street", "avenue", "near", "block", "sector", "phase", "plot",
    "null", "none", "na", "building", "floor", "unit", "suite",
    "india", "united", "states",
]

# FIXED VALUES: address tokens that suppress the v4 address keys.
SKIP_ADDR_V4 = [
    "road", "street", "avenue", "blvd", "drive", "lane", "court", "place",
    "near", "block", "sector", "phase", "plot", "null", "none",
    "north", "south", "east", "west", "new", "old", "main",
    "unit", "suite", "building", "floor", "apartment", "colony",
    "nagar", "marg", "vihar", "enclave", "park", "market", "complex", "tower",
    "india", "united", "states",
    "pradesh", "maharashtra", "karnataka", "gujarat", "rajasthan", "bengal",
    "kerala", "andhra", "telangana", "bihar", "odisha", "jharkhand", "tamil",
]

# FIXED VALUES: the v3 stop list (v4's plus two-letter entries and "na").
SKIP_ADDR_V3 = [
    "road", "street", "avenue", "blvd", "drive", "lane", "court", "place",
    "near", "block", "sector", "phase", "plot", "null", "none", "na",
    "north", "south", "east", "west", "new", "old", "main", "unit", "suite",
    "india", "united", "states", "building", "floor", "apartment", "colony",
    "nagar", "marg", "vihar", "enclave", "park", "market", "complex", "tower",
    "ca", "ny", "tx", "fl", "il", "pa", "oh", "ga", "nc", "mi", "nj", "va", "wa",
    "az", "ma", "tn", "in", "mo", "md", "wi", "co", "mn", "sc", "al", "la", "ky",
    "or", "ok", "ct", "ut", "ia", "nv", "ar", "ms", "ks", "ne", "nm", "wv", "id",
    "pradesh", "maharashtra", "karnataka", "gujarat", "rajasthan", "bengal",
    "kerala", "andhra", "telangana", "bihar", "odisha", "jharkhand", "tamil",
]

# FIXED VALUES: candidate caps per blocking generation.
MAX_CANDIDATES_V1 = 200
MAX_CANDIDATES_V2 = 300
MAX_CANDIDATES_V4 = 300

# FIXED VALUES: recall bands.
RECALL_WARNING_BELOW = 0.90
RECALL_NOTE_BELOW = 0.95

# FIXED VALUES: output file headers and validator example count.
MATCHING_HEADER = ["source1_entity_id", "matched_entity_ids"]
CANDIDATE_HEADER = ["source1_entity_id", "candidate_entity_ids"]
MAX_EXAMPLES = 5

"""Word lists and maps that results depend on."""

# Legal forms that end a business name.
LEGAL_SUFFIXES = [
    "pvt ltd", "private limited", "co ltd", "company limited", "pty ltd", "proprietory limited", "corp inc", "llc inc", "sa de cv", "s de rl de cv", "sp z o o",
    "inc", "incorporated", "corporation", "corp", "limited", "ltd", "llc", "llp", "plc", "lp", "pvt", "private", "co", "company",
    "gmbh", "ag", "kgaa", "sarl", "sas", "sasu", "sa", "srl", "spa", "snc", "sl", "slne", "bv", "nv", "vof", "ab", "aps", "as", "oy", "oyj",
    "kk", "kabushiki kaisha", "yk", "yugen kaisha",
]

# Endings of web addresses, after cleaning.
DOMAIN_ENDINGS = ["com", "org", "net", r"co\s+in", "in", "biz", "info"]

# Address abbreviations.
ADDRESS_WORDS = {
    "rd": "road", "st": "street", "str": "street", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane", "hwy": "highway", "bldg": "building",
    "fl": "floor", "flr": "floor", "ste": "suite", "apt": "apartment", "opp": "opposite", "nr": "near", "sec": "sector", "blk": "block", "dist": "district",
}

# Words that say little in a name.
NAME_STOPWORDS_V1 = [
    "the", "and", "for", "group", "services", "company", "international", "global", "solutions", "management", "systems", "technologies", "consulting", "enterprises",
    "partners", "associates", "holdings", "industries", "products", "national", "general", "american", "business", "financial", "capital", "investments", "properties",
    "construction", "development", "insurance", "marketing", "trading", "logistics", "communications", "engineering", "electric", "energy",
]
NAME_STOPWORDS_V2 = [*NAME_STOPWORDS_V1, "india", "first", "new", "all", "united", "central", "standard", "premier", "north", "south", "east", "west", "one", "two", "three", "alpha"]
NAME_STOPWORDS_V3_EVAL = [*NAME_STOPWORDS_V2, "ltd", "inc", "corp", "llc", "pvt"]
NAME_STOPWORDS_V3 = [*NAME_STOPWORDS_V2, "private", "pvt", "ltd", "limited", "corp", "inc", "llc", "gmbh"]

# Words that say little in an address.
ADDRESS_STOPWORDS_V3 = [
    "road", "rd", "street", "st", "avenue", "ave", "lane", "ln", "drive", "dr", "boulevard", "blvd", "way", "highway", "hwy", "floor", "fl", "suite", "ste", "block", "blk",
    "sector", "sec", "plot", "building", "bldg", "house", "no", "near", "opp", "opposite", "behind", "beside", "nagar", "colony", "complex", "market", "bazar", "chowk", "post",
    "dist", "district", "city", "state", "india", "usa", "uk", "tower", "plaza", "park", "industrial", "area", "phase",
]
ADDRESS_STOPWORDS_V3_EVAL = [
    "road", "street", "st", "rd", "floor", "fl", "suite", "ste", "avenue", "ave", "building", "bldg", "lane", "ln", "nagar", "block", "blk", "sector", "sec", "house", "plot",
    "near", "opp", "post", "dist", "state", "city", "west", "east", "north", "south", "delhi", "mumbai", "india", "usa", "france", "colony", "marg", "vihar", "apartment", "apt",
    "phase", "cross", "main", "circle", "park", "bazaar", "hall", "point", "tower", "plaza", "complex",
]

# Letters and their phonetic classes; others have none.
PHONETIC_FROM, PHONETIC_TO = "bcdfgjklmnpqrstvz", "BKTFKJKLMNPKRSTFS"

# Texts that a delimited file uses for a missing value.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

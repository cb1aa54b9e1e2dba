"""Word tables that name and address normalisation must share with the data's conventions."""

HONOR = "mr mrs ms smt shri sri dr the messrs mme m".split()
NAME_ABBR = {
    "pvt": "private", "pvte": "private", "ltd": "limited", "ltda": "limited", "inc": "incorporated",
    "corp": "corporation", "co": "company", "cos": "companies", "intl": "international",
    "mfg": "manufacturing", "bros": "brothers", "assoc": "associates", "svc": "services", "svcs": "services",
    "mgmt": "management", "ctr": "center", "centre": "center", "natl": "national", "cie": "compagnie",
    "ste": "societe", "and": "and",
}
LEGAL = """private limited llc llp lp pc pllc plc incorporated corporation company sarl sas sasu eurl sa sci ei snc
compagnie societe services service group center holdings partners associates and of india france usa us""".split()
DOMAINS = "com net org co.in in co fr us biz info io".split()
STATES = {
    "US": dict(
        al="alabama", ak="alaska", az="arizona", ar="arkansas", ca="california", co="colorado", ct="connecticut",
        de="delaware", fl="florida", ga="georgia", hi="hawaii", id="idaho", il="illinois", ia="iowa", ks="kansas",
        ky="kentucky", la="louisiana", me="maine", md="maryland", ma="massachusetts", mi="michigan",
        mn="minnesota", ms="mississippi", mo="missouri", mt="montana", ne="nebraska", nv="nevada",
        nh="new hampshire", nj="new jersey", nm="new mexico", ny="new york", nc="north carolina",
        nd="north dakota", oh="ohio", ok="oklahoma", pa="pennsylvania", ri="rhode island", sc="south carolina",
        sd="south dakota", tn="tennessee", tx="texas", ut="utah", vt="vermont", va="virginia", wa="washington",
        wv="west virginia", wi="wisconsin", wy="wyoming", dc="district of columbia", pr="puerto rico",
        mp="northern mariana islands", gu="guam", vi="virgin islands",
    ),
    "India": {
        "ap": "andhra pradesh", "ar": "arunachal pradesh", "as": "assam", "br": "bihar", "cg": "chhattisgarh",
        "ct": "chhattisgarh", "ga": "goa", "gj": "gujarat", "hr": "haryana", "hp": "himachal pradesh", "jh": "jharkhand",
        "ka": "karnataka", "kl": "kerala", "mp": "madhya pradesh", "mh": "maharashtra", "mn": "manipur", "ml": "meghalaya",
        "mz": "mizoram", "nl": "nagaland", "od": "odisha", "or": "odisha", "pb": "punjab", "rj": "rajasthan", "sk": "sikkim",
        "tn": "tamil nadu", "tg": "telangana", "ts": "telangana", "tr": "tripura", "up": "uttar pradesh", "uk": "uttarakhand",
        "ut": "uttarakhand", "wb": "west bengal", "an": "andaman and nicobar islands", "ch": "chandigarh",
        "dn": "dadra and nagar haveli", "dd": "daman and diu", "dl": "delhi", "jk": "jammu and kashmir", "la": "ladakh",
        "ld": "lakshadweep", "py": "puducherry", "orissa": "odisha", "pondicherry": "puducherry", "uttaranchal": "uttarakhand",
    },
}
ADDRESS = {
    "rd": "road", "st": "street", "str": "street", "ave": "avenue", "av": "avenue", "blvd": "boulevard",
    "dr": "drive", "ln": "lane", "ct": "court", "cir": "circle", "pl": "place", "hwy": "highway",
    "pkwy": "parkway", "sq": "square", "bldg": "building", "flr": "floor", "fl": "floor",
    "first": "1", "second": "2", "third": "3", "fourth": "4", "fifth": "5", "sixth": "6", "seventh": "7",
    "eighth": "8", "ninth": "9", "tenth": "10", "eleventh": "11", "twelfth": "12",
}
ADDRESS_BY_COUNTRY = {
    "US": {
        "n": "north", "s": "south", "e": "east", "w": "west", "ne": "northeast", "nw": "northwest",
        "se": "southeast", "sw": "southwest", "ter": "terrace", "trl": "trail", "mt": "mount",
        "ft": "fort", "pt": "point", "cv": "cove", "xing": "crossing", "expy": "expressway",
    },
    "India": {
        "nr": "near", "opp": "opposite", "apts": "apartment", "apt": "apartment", "dist": "district",
        "ngr": "nagar", "tq": "taluk", "tal": "taluk", "bombay": "mumbai", "calcutta": "kolkata",
        "madras": "chennai", "bangalore": "bengaluru", "gurgaon": "gurugram", "poona": "pune",
        "hissar": "hisar", "ahmadabad": "ahmedabad", "baroda": "vadodara", "cochin": "kochi",
        "calicut": "kozhikode", "trivandrum": "thiruvananthapuram", "mysore": "mysuru",
    },
    "France": {
        "r": "rue", "bd": "boulevard", "boul": "boulevard", "all": "allee", "imp": "impasse",
        "che": "chemin", "chem": "chemin", "q": "quai", "rte": "route", "st": "saint", "ste": "sainte",
        "fg": "faubourg", "fbg": "faubourg", "crs": "cours", "dr": "docteur", "gal": "general",
        "mal": "marechal", "pres": "president",
    },
}
ADDRESS_DROP = "city cty unit apt ste suite pmb po box no hno door hn null none nan na".split()
UNITS = "unit apt apartment fl floor suite ste pmb box room rm bldg building lot".split()
MARKED_UNITS = "apt apartment unit lot".split()
NUMBER_WORDS = "no n° nº hno khno plotno doorno".split()
#: Patterns that addresses are cleaned by (a number sign, a word for a missing value, an ordinal).
NUMBER_SIGN = r"\bn\s*[°º]|№|#|\bh\.?\s*no\b\.?|\bno\."
NULL_WORD = r"<\s*null\s*>|\bn/a\b|\bnull\b"
ORDINAL = r"\b(\d+)(?:st|nd|rd|th)\b"
MARKERS = ["dba", "d b a", "fka", "f k a", "aka", "a k a", "t a", "formerly known as", "formerly", "trading as", "doing business as", "known as", "nee"]
FRENCH = {"compagnie": "company", "societe": "company", "associes": "associates", "et": "and", "fils": "sons", "groupe": "group", "holding": "holdings", "developpement": "development"}
FRENCH_LEGAL = FRENCH | dict.fromkeys(["sarl", "sas", "sasu", "eurl", "sa", "sci", "snc", "ei"], "llc")

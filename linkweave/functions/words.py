"""Word lists of the normalizer and the blocking keys."""

# Legal forms of companies, which names are compared without.
LEGAL_SUFFIXES = [
    "inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "pvt", "private", "llc", "llp", "lp", "pc",
    "gmbh", "ag", "sa", "sas", "sasu", "sarl", "sci", "eurl", "snc", "bhd", "pty", "pllc",
]

# Words that carry no meaning in names.
STOPWORDS = ["and", "&", "the", "of", "in", "at", "for", "by", "on", "a", "an", "et", "du", "de", "des", "la", "le", "les", "d"]

# Street types and other words that carry no meaning in addresses.
ADDRESS_STOPWORDS = [
    "st", "street", "rd", "road", "ave", "avenue", "dr", "drive", "blvd", "boulevard", "ln", "lane", "way", "ct", "court", "pl", "place",
    "pkwy", "parkway", "cir", "circle", "fl", "floor", "ste", "suite", "unit", "apt", "apartment", "bldg", "building", "po", "box", "pobox",
    "near", "opp", "opposite", "behind", "beside", "adjacent", "block", "sector", "phase", "plot", "no", "shop", "flat",
    "rue", "r", "bd", "av", "allee", "route", "chemin", "impasse", "cours", "quai", "zone", "zi", "za", "zac", "bis", "ter",
]

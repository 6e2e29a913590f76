"""Fixed values the register functions work with, as plain text."""

from __future__ import annotations

# What registers write for "no value" (lower case, trimmed).
MISSING = ["", "na", "n/a", "n.a.", "nil", "none", "null", "-", "--", "not applicable", "not available", "see composition", "as above"]

# Legal forms and filler in company names.
LEGAL = [
    "ltd", "limited", "plc", "inc", "incorporated", "corp", "corporation", "co", "company", "gmbh", "ag", "sa", "srl", "spa", "bv", "nv", "as", "pvt",
    "pte", "private", "llc", "lp", "llp", "kg", "kft", "oy", "ab", "sas", "sarl", "cc", "and", "the", "of", "amp",
]

# Places in company names.
PLACES = [
    "nigeria", "nigerian", "nig", "tanzania", "tanzanian", "zambia", "kenya", "ghana", "uganda", "africa", "african", "india", "indian", "east", "west",
    "south", "north", "international", "global", "overseas", "export",
]

# Dosage forms by bucket, buckets in order.
FORMS = {
    "tablet": [
        "tablet", "tablets", "caplet", "caplets", "film coated tablet", "coated tablet", "dispersible tablet", "chewable tablet", "effervescent tablet",
        "scored tablet", "sugar coated tablet", "enteric coated tablet", "prolonged release tablet", "modified release tablet", "orodispersible tablet",
        "vaginal tablet",
    ],
    "capsule": ["capsule", "capsules", "hard capsule", "soft capsule", "softgel", "soft gelatin capsule", "hard gelatin capsule"],
    "injection": [
        "injection", "injections", "powder for injection", "solution for injection", "suspension for injection", "injectable", "infusion",
        "solution for infusion",
    ],
    "oral_liquid": [
        "syrup", "suspension", "oral solution", "oral suspension", "powder for suspension", "elixir", "oral liquid", "liquid", "solution", "drops",
        "oral drops",
    ],
    "cream": ["cream", "ointment", "gel", "lotion", "paste", "topical cream", "topical gel", "topical ointment"],
    "drops": ["solution/drops", "eye drops", "ear drops", "ophthalmic solution", "otic solution", "nasal drops"],
    "suppository": ["suppository", "suppositories", "pessary", "pessaries"],
    "powder": ["powder", "granules", "sachet", "powder for oral suspension"],
    "inhaler": ["inhaler", "inhalation", "metered dose inhaler", "nebuliser solution"],
    "patch": ["patch", "transdermal patch"],
}
FORM_VARIANTS = [(v, bucket) for bucket, names in FORMS.items() for v in names]

# Words of a free-text product description that are not part of the ingredient (a pattern).
DESCRIPTION_WORDS = r"film|sugar|enteric|coated|tablets?|capsules?|caplets?|injections?|syrups?|suspensions?|solutions?|creams?|ointments?|gels?|drops?|powders?|granules?|suppositor(?:y|ies)|dispersible|chewable|effervescent|oral|for|and|with|prolonged|modified|release|hard|soft|gelatin|infusion|sterile|vaginal|topical|ophthalmic|dry|bp|usp|ph\.?eur"

# Categories that are medicines, and the categories a Brazilian record must have to be kept.
MEDICINES = ["drugs", "vaccines and biologics"]

# Order of event kinds.
SEVERITY = {"lapsed": 0, "renewal_due": 1, "newly_granted": 2, "first_entry": 3}
EVENT_LABELS = {"lapsed": "Registration expired", "renewal_due": "Renewal due", "newly_granted": "Recently granted", "first_entry": "First registration in this market"}

# Phrases a report may not use (patterns of regular expressions).
FORBIDDEN = [
    (1, r"\b(?:is|are|was|were)\s+not\s+registered\b"),
    (2, r"\bnot\s+registered\s+in\b"),
    (3, r"\bunregistered\b"),
    (4, r"\bnon-?compliant\b"),
    (5, r"\bin\s+violation\b"),
    (6, r"\bfail(?:s|ed|ing)?\s+to\s+(?:register|comply)\b"),
    (7, r"\bhas\s+no\s+registration\b"),
    (8, r"\billegal(?:ly)?\b"),
]

# What is said in conversations for each market, region, service and kind of product, first synonym first.
SPOKEN = {
    "market": {
        "NG": ["nigeria", "nigerian", "nafdac"],
        "BR": ["brazil", "brasil", "brazilian", "anvisa"],
        "TZ": ["tanzania", "tanzanian", "tmda"],
    },
    "region": {
        "africa": ["africa", "african", "sub saharan", "sub-saharan", "east africa", "west africa", "southern africa"],
        "latam": ["latam", "latin america", "south america", "mercosur"],
        "apac": ["apac", "asia pacific", "southeast asia", "south east asia", "asean"],
        "mena": ["mena", "middle east", "gulf", "gcc"],
        "row": ["row", "rest of world", "rest-of-world", "emerging markets"],
    },
    "service": {
        "registration": [
            "registration", "register", "registering", "market authorisation", "market authorization", "marketing authorisation", "dossier submission",
            "new filing", "product registration",
        ],
        "renewal": ["renewal", "renew", "renewing", "re-registration", "reregistration"],
        "variation": ["variation", "variations", "post approval change", "post-approval change", "change control", "amendment"],
        "labelling": ["labelling", "labeling", "artwork", "pack insert", "leaflet", "smpc"],
        "pharmacovigilance": ["pharmacovigilance", "pv", "safety reporting", "psur", "adverse event"],
        "dossier_preparation": ["dossier preparation", "dossier prep", "ctd", "actd", "ectd", "compile the dossier", "dossier compilation"],
        "regulatory_strategy": ["regulatory strategy", "gap analysis", "feasibility", "pathway assessment", "market entry"],
    },
    "product_type": {
        "generic": ["generic", "generics", "multisource"],
        "similar": ["similar", "branded generic"],
        "biosimilar": ["biosimilar", "biosimilars"],
        "biological": ["biologic", "biological", "biologics", "vaccine", "vaccines"],
        "new_chemical_entity": ["new chemical entity", "nce", "innovator", "originator", "novel product"],
        "otc": ["otc", "over the counter", "over-the-counter"],
        "device": ["medical device", "device", "ivd", "in vitro diagnostic"],
    },
}
CONFIDENCE = {"market": 0.95, "region": 0.8, "service": 0.9, "product_type": 0.85, "constraint": 0.7, "volume": 0.9, "timing": 0.85, "product": 0.9}
CONSTRAINTS = [
    "already registered", "already have", "existing registration", "cpp", "certificate of pharmaceutical product", "gmp certificate", "reference market",
    "approved in", "budget", "no budget", "tender", "urgent",
]
VOLUME = r"\b(\d{1,4})\s+(?:of\s+(?:our|their)\s+)?(?:[a-z][a-z-]{2,14}\s+){0,3}(?:products?|skus?|molecules?|presentations?|dossiers?|items?|registrations?|filings?)\b"
TIMING = r"\b(?:by|before|end of|deadline(?: is)?|target(?:ing)?|no later than)\s+((?:Q[1-4]\s*(?:of\s*)?\d{4})|(?:\d{4})|(?:january|february|march|april|may|june|july|august|september|october|november|december)\s*\d{0,4})"

# Facts a scope must hold, and how much their absence weighs.
REQUIRED = {"product_type": "high", "product": "high", "market": "high", "service": "high", "volume": "medium", "timing": "medium"}

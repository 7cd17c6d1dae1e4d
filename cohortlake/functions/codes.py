"""Code sets, recode tables, bands and ordered rules.

Everything in this module is data that results depend on; operators take these
tables as arguments and hold no codes themselves.
"""

from __future__ import annotations

# --- fixed values -------------------------------------------------------------

CLAIM_TYPES_KEPT = ["1", "3"]
FEE_FOR_SERVICE = "1"
MANAGED_CARE = "3"

STUDY_STATES = [
    "AL", "AZ", "DC", "DE", "HI", "ID", "IL", "IN", "KS", "KY", "LA", "MD", "ME", "MI",
    "MS", "MT", "ND", "NM", "NV", "PA", "TN", "UT", "VA", "VT", "WA", "WV", "WY",
]
COST_STATES = ["AL", "ME", "MT", "VT", "WY", "IL"]
REGIONS = {
    "West": ["AZ", "HI", "ID", "MT", "NM", "NV", "UT", "WA", "WY"],
    "Midwest": ["IL", "IN", "KS", "MI", "ND"],
    "South": ["AL", "KY", "LA", "MS", "TN", "WV", "VA", "MD", "DC"],
}
OTHER_REGION = "Northeast"

DUAL_STATUS = {
    "no": ["00"],
    "yes": ["01", "02", "03", "04", "05", "06", "08", "09", "10"],
}
MANAGED_CARE_PLANS = [
    "01", "02", "03", "04", "06", "07", "08", "09", "12", "14", "15", "16", "17", "20",
    "60", "70", "80",
]
COVERAGE_TYPE = {"neither": ["0"], "medicaid": ["1"], "chip": ["2", "3"], "both": ["4"]}

ED_REVENUE_CODES = [
    "0450", "0451", "0452", "0453", "0454", "0456", "0457", "0458", "0459", "0981",
]
ED_PLACES_OF_SERVICE = ["23"]
ED_PROCEDURES = ["99281", "99282", "99283", "99284", "99285"]

# (label, lower bound exclusive, upper bound exclusive); first match wins
AGE_BANDS = [
    ("under10", None, 10),
    ("10To17", 9, 18),
    ("18To29", 17, 30),
    ("30To39", 29, 40),
    ("40To49", 39, 50),
    ("50To64", 49, 65),
    ("over64", 64, None),
]
CHILD_BANDS = ["under10", "10To17"]
MISSING = "missing"

# text codes: compared as strings
TEXT_RECODES = {
    "death": {"no": ["0"], "yes": ["1"]},
    "sex": {"male": ["M"], "female": ["F"]},
    "married": {
        "yes": ["01", "02", "03", "04", "05", "06", "07", "08"],
        "no": ["09", "10", "11", "12", "13", "14"],
    },
    "houseSize": {
        "single": ["01"],
        "twoToFive": ["02", "03", "04", "05"],
        "sixorMore": ["06", "07", "08"],
    },
    "fedPovLine": {
        "0To100": ["01"],
        "100To200": ["02", "03", "04"],
        "200AndMore": ["05", "06", "07", "08"],
    },
    "UsCitizen": {"yes": ["1"], "no": ["0"]},
    "ssdi": {"yes": ["1"], "no": ["0"]},
    "ssi": {"yes": ["1"], "no": ["0"]},
}
# number codes: compared after a tolerant cast to int
NUMBER_RECODES = {
    "race": {
        "white": [1],
        "black": [2],
        "asian": [3],
        "native": [4],
        "hawaiian": [5],
        "multiracial": [6],
        "hispanic": [7],
    },
    "speakEnglish": {"yes": [0, 1], "no": [2, 3]},
    "tanf": {"yes": [2], "no": [0, 1]},
}
RACE_GROUPS = {
    "White": ["white"],
    "missing": ["missing"],
    "Black": ["black"],
    "Hispanic": ["hispanic"],
}
OTHER_RACE_GROUP = "minority"

MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# completeness tiers: a claim passes when every listed field is present on at least
# one of its lines; a nested list means "any of these"
PROVIDER_FIELDS = ["service_npi", "service_specialty", "billing_npi", "billing_specialty"]
COMPLETENESS_TIERS = {
    "inpatient": {
        "all": ["procedure", "start", "end", "drg", "diagnosis", PROVIDER_FIELDS],
        "noProc": ["start", "end", "drg", "diagnosis", PROVIDER_FIELDS],
        "noProcDrg": ["start", "end", "diagnosis", PROVIDER_FIELDS],
    },
    "long_term": {
        "noMissing": ["start", "end", "revenue", "diagnosis", PROVIDER_FIELDS],
        "allButRev": ["start", "end", "diagnosis", PROVIDER_FIELDS],
    },
    "other_services": {
        "noMissing": ["procedure", "diagnosis", PROVIDER_FIELDS],
    },
    "pharmacy": {
        "noMissing": [
            "fill_date", "ndc", "days_supply", "brand",
            ["prescriber_npi", "billing_npi", "billing_specialty"],
        ],
        "noEssentialMissing": [
            "fill_date", "ndc", "days_supply",
            ["prescriber_npi", "billing_npi", "billing_specialty"],
        ],
        "noMinMissing": ["fill_date", "ndc", "days_supply"],
    },
}

OVERLAP_LABELS = {
    "first": "1.First",
    "new": "2.New Episode",
    "regular": "3.Regular Overlap",
    "same_start": "5.Same Start Date (SRO)",
    "embedded": "6.Embedded",
    "perfect": "7.Perfect Overlap",
}

# disease-payment rules, applied strictly in this order: (target, value, condition)
GROUP_RULES = [
    ("CARM", 1, "MRX1 = 1"),
    ("CAREL", 1, "MRX2 = 1"),
    ("CARM", 0, "CARVH = 1"),
    ("CARL", 0, "CARVH = 1"),
    ("CAREL", 0, "CARVH = 1"),
    ("CARL", 0, "CARM = 1"),
    ("CAREL", 0, "CARM = 1"),
    ("CAREL", 0, "CARL = 1"),
    ("PSYL", 1, "MRX3 = 1 AND PSYH + PSYM = 0"),
    ("DIA2", 1, "MRX4 = 1 AND DIA1 = 0 AND age >= 19"),
    ("HEMEH", 1, "MRX5 = 1"),
    ("HEMVH", 0, "MRX5 = 1"),
    ("HEMM", 0, "MRX5 = 1"),
    ("HEML", 0, "MRX5 = 1"),
    ("INFM", 1, "MRX6 = 1"),
    ("INFM", 1, "MRX7 = 1"),
    ("INFH", 1, "MRX8 = 1"),
    ("INFL", 1, "MRX15 = 1"),
    ("INFH", 0, "INFVH = 1"),
    ("INFM", 0, "INFVH = 1"),
    ("INFL", 0, "INFVH = 1"),
    ("INFM", 0, "INFH = 1"),
    ("INFL", 0, "INFH = 1"),
    ("INFL", 0, "INFM = 1"),
    ("SKCM", 1, "MRX9 = 1"),
    ("SKCL", 0, "MRX9 = 1"),
    ("SKCVL", 0, "MRX9 = 1"),
    ("CANM", 1, "MRX10 = 1 AND CANVH + CANH = 0"),
    ("CANL", 0, "MRX10 = 1 AND CANVH + CANH = 0"),
    ("CNSH", 1, "MRX11 = 1"),
    ("CNSL", 1, "MRX12 + MRX14 > 0"),
    ("CNSM", 0, "CNSH = 1"),
    ("CNSL", 0, "CNSM = 1"),
]
DISEASE_GROUPS = [
    "CARVH", "CARM", "CARL", "CAREL", "PSYH", "PSYM", "PSYL", "DIA1", "DIA2",
    "HEMEH", "HEMVH", "HEMM", "HEML", "INFVH", "INFH", "INFM", "INFL",
    "SKCM", "SKCL", "SKCVL", "CANVH", "CANH", "CANM", "CANL", "CNSH", "CNSM", "CNSL",
]
DRUG_GROUPS = [
    "MRX1", "MRX2", "MRX3", "MRX4", "MRX5", "MRX6", "MRX7", "MRX8", "MRX9", "MRX10",
    "MRX11", "MRX12", "MRX14", "MRX15",
]
# (cell, lowest age, highest age, male flag or None for either)
AGE_SEX_CELLS = [
    ("a_under1", None, 0, None),
    ("a_1_4", 1, 4, None),
    ("a_5_14m", 5, 14, 1),
    ("a_5_14f", 5, 14, 0),
    ("a_15_24m", 15, 24, 1),
    ("a_15_24f", 15, 24, 0),
    ("a_25_44m", 25, 44, 1),
    ("a_25_44f", 25, 44, 0),
    ("a_45_64m", 45, 64, 1),
    ("a_45_64f", 45, 64, 0),
    ("a_65", 65, None, None),
]

# model feature sets by role; the wide numeric blocks come from the data
STAGE1_CATEGORICAL = [
    "ageCat", "sex", "race", "state", "houseSize", "fedPovLine", "speakEnglish", "married",
    "UsCitizen", "ssi", "ssdi", "tanf", "disabled", "enrollMonth", "enrollYear", "cov2016yes",
]
STAGE1_BASELINE = ["ageCat", "sex", "race", "state", "enrollMonth", "enrollYear", "cov2016yes"]
STAGE2_BASELINE = ["ageCat", "sex"]
STAGE2_CATEGORICAL = [
    "ageCat", "sex", "race", "disabled", "enrollMonth", "enrollYear", "state", "enrollMonths",
    "cov2016yes",
]
INDIVIDUAL_CATEGORICAL = [
    "houseSize", "fedPovLine", "speakEnglish", "married", "UsCitizen", "ssi", "ssdi", "tanf",
]
AREA_RATES = [
    "saServRate", "saFacRate", "mhTreatRate", "popDensity", "povRate", "publicAssistRate",
    "highSchoolGradRate", "goodAirDays", "injDeathRate", "urgentCareRate", "drugdeathRate",
    "100HeatDays", "aprnRate",
]

# elastic-net grid and chosen learner settings
ELASTIC_NET_REG = [0.0001, 0.001, 0.01, 0.1, 1.0, 10.0, 100.0]
ELASTIC_NET_MIX = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]

# fixed values: the full search grid of the forests
FOREST_GRID = {
    "leaf": [1, 10, 20, 30, 40, 50, 60], "subset": ["auto", "sqrt", "log2"], "depth": [10, 12, 14, 16, 18, 20],
    "trees": [10, 20, 50, 75, 100, 125, 150, 175, 200],
}

# fixed values: settings that the searches chose (classifier), and the middle of the cost grid; 100 trees are what the learner grows untold
BOOSTED_TREES = 100
BOOSTED_CHOSEN = {"step": 0.005, "subsample": 0.4, "depth": 18, "alpha": 0.0, "lambda_": 0.25, "gamma": 0.0, "by_level": 1.0, "trees": BOOSTED_TREES}
COST_BOOSTED = {
    "step": 0.01, "subsample": 0.55, "depth": 19, "alpha": 0.5, "lambda_": 0.5, "gamma": 0.5, "by_tree": 0.75, "by_level": 0.75,
    "child": 2.5, "trees": BOOSTED_TREES,
}

NORMAL_95 = 1.96
INTERVAL_95 = [0.025, 0.975]

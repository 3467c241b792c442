"""Word lists and lookup tables of the cleaning rules. All are fixed values that results depend on."""

# Legal suffixes stripped from the end of organisation names.
LEGAL_SUFFIXES = (
    "INCORPORATED", "INC", "LLC", "L L C", "PLLC", "P L L C", "CORPORATION", "CORP",
    "PC", "P C", "PA", "P A", "LTD", "LIMITED", "LLP", "L L P", "LP", "L P", "CO",
    "COMPANY", "SC", "S C", "PSC", "PLC",
)

# Expansions of tokens and phrases in organisation names; an empty target deletes the token.
ORG_ALIASES = {
    "ST": "SAINT", "MT": "MOUNT", "FT": "FORT",
    "MED": "MEDICAL", "CTR": "CENTER", "CNTR": "CENTER", "CENTRE": "CENTER",
    "HOSP": "HOSPITAL", "ASSOC": "ASSOCIATES", "ASSOCS": "ASSOCIATES", "ASSN": "ASSOCIATION",
    "GRP": "GROUP", "SVCS": "SERVICES", "SVC": "SERVICE", "DEPT": "DEPARTMENT",
    "UNIV": "UNIVERSITY", "HLTH": "HEALTH", "HC": "HEALTHCARE", "HEALTH CARE": "HEALTHCARE",
    "FAM": "FAMILY", "PRAC": "PRACTICE", "PHYS": "PHYSICIANS", "CLIN": "CLINIC",
    "ORTHO": "ORTHOPEDIC", "ORTHOPAEDIC": "ORTHOPEDIC", "PEDS": "PEDIATRICS",
    "PEDIATRIC": "PEDIATRICS", "OB GYN": "OBSTETRICS GYNECOLOGY", "OBGYN": "OBSTETRICS GYNECOLOGY",
    "SURG": "SURGERY", "SURGICAL": "SURGERY", "REHAB": "REHABILITATION", "SYS": "SYSTEM",
    "INTL": "INTERNATIONAL", "NATL": "NATIONAL", "AMER": "AMERICAN", "&": "AND",
    "THE": "",
}

# US state and territory names and their postal codes.
STATE_CODES = {
    "ALABAMA": "AL", "ALASKA": "AK", "ARIZONA": "AZ", "ARKANSAS": "AR", "CALIFORNIA": "CA",
    "COLORADO": "CO", "CONNECTICUT": "CT", "DELAWARE": "DE", "FLORIDA": "FL", "GEORGIA": "GA",
    "HAWAII": "HI", "IDAHO": "ID", "ILLINOIS": "IL", "INDIANA": "IN", "IOWA": "IA", "KANSAS": "KS",
    "KENTUCKY": "KY", "LOUISIANA": "LA", "MAINE": "ME", "MARYLAND": "MD", "MASSACHUSETTS": "MA",
    "MICHIGAN": "MI", "MINNESOTA": "MN", "MISSISSIPPI": "MS", "MISSOURI": "MO", "MONTANA": "MT",
    "NEBRASKA": "NE", "NEVADA": "NV", "NEW HAMPSHIRE": "NH", "NEW JERSEY": "NJ", "NEW MEXICO": "NM",
    "NEW YORK": "NY", "NORTH CAROLINA": "NC", "NORTH DAKOTA": "ND", "OHIO": "OH", "OKLAHOMA": "OK",
    "OREGON": "OR", "PENNSYLVANIA": "PA", "RHODE ISLAND": "RI", "SOUTH CAROLINA": "SC",
    "SOUTH DAKOTA": "SD", "TENNESSEE": "TN", "TEXAS": "TX", "UTAH": "UT", "VERMONT": "VT",
    "VIRGINIA": "VA", "WASHINGTON": "WA", "WEST VIRGINIA": "WV", "WISCONSIN": "WI", "WYOMING": "WY",
    "DISTRICT OF COLUMBIA": "DC", "PUERTO RICO": "PR",
}

# Street words and their postal abbreviations; tokens that begin a unit.
STREET_ABBREVIATIONS = {
    "STREET": "ST", "AVENUE": "AVE", "AV": "AVE", "ROAD": "RD", "DRIVE": "DR", "BOULEVARD": "BLVD",
    "BOUL": "BLVD", "LANE": "LN", "COURT": "CT", "PLACE": "PL", "PARKWAY": "PKWY", "PKY": "PKWY",
    "HIGHWAY": "HWY", "CIRCLE": "CIR", "TRAIL": "TRL", "TERRACE": "TER", "SQUARE": "SQ",
    "PLAZA": "PLZ", "EXPRESSWAY": "EXPY", "TURNPIKE": "TPKE", "NORTH": "N", "SOUTH": "S",
    "EAST": "E", "WEST": "W", "NORTHEAST": "NE", "NORTHWEST": "NW", "SOUTHEAST": "SE",
    "SOUTHWEST": "SW", "SUITE": "STE", "APARTMENT": "APT", "UNIT": "UNIT", "FLOOR": "FL",
    "BUILDING": "BLDG", "ROOM": "RM", "DEPARTMENT": "DEPT", "FIRST": "1ST", "SECOND": "2ND",
    "THIRD": "3RD", "FOURTH": "4TH", "FIFTH": "5TH",
}
PO_BOX_PHRASES = ("POST OFFICE BOX", "P O BOX")
UNIT_TOKENS = ("STE", "APT", "UNIT", "FL", "BLDG", "RM", "DEPT", "#")

# Generational suffixes and credentials of person names.
GENERATIONAL_SUFFIXES = ("JR", "SR", "II", "III", "IV", "V")
CREDENTIALS = (
    "MD", "DO", "PHD", "RN", "NP", "PA", "PAC", "PA-C", "APRN", "ARNP", "CRNA", "DDS", "DMD",
    "DPM", "OD", "PSYD", "LCSW", "MPH", "MBA", "FACP", "FACS", "BSN", "MSN", "DNP", "FNP",
    "CNM", "LPN", "PT", "DPT", "OT", "PHARMD", "RPH",
)
TITLES = ("DR", "MR", "MRS", "MS", "MISS", "PROF", "REV", "HON", "SIR")

# Job titles and the canonical title of each.
TITLE_TAXONOMY = {
    "PHYSICIAN": "PHYSICIAN", "NURSE PRACTITIONER": "NURSE PRACTITIONER",
    "PHYSICIAN ASSISTANT": "PHYSICIAN ASSISTANT", "REGISTERED NURSE": "REGISTERED NURSE",
    "MEDICAL DIRECTOR": "MEDICAL DIRECTOR", "SURGEON": "SURGEON", "ADMINISTRATOR": "ADMINISTRATOR",
    "PHARMACIST": "PHARMACIST", "THERAPIST": "THERAPIST",
    "MD": "PHYSICIAN", "DO": "PHYSICIAN", "DOCTOR": "PHYSICIAN", "STAFF PHYSICIAN": "PHYSICIAN",
    "ATTENDING PHYSICIAN": "PHYSICIAN", "HOSPITALIST": "PHYSICIAN", "INTERNIST": "PHYSICIAN",
    "FAMILY MEDICINE PHYSICIAN": "PHYSICIAN", "FAMILY PRACTICE DOCTOR": "PHYSICIAN",
    "FAMILY PHYSICIAN": "PHYSICIAN", "PEDIATRICIAN": "PHYSICIAN", "CARDIOLOGIST": "PHYSICIAN",
    "PRIMARY CARE PHYSICIAN": "PHYSICIAN", "PCP": "PHYSICIAN",
    "NP": "NURSE PRACTITIONER", "ARNP": "NURSE PRACTITIONER", "APRN": "NURSE PRACTITIONER",
    "FNP": "NURSE PRACTITIONER", "FAMILY NURSE PRACTITIONER": "NURSE PRACTITIONER",
    "ADVANCED PRACTICE NURSE": "NURSE PRACTITIONER", "NURSE PRACTIONER": "NURSE PRACTITIONER",
    "PA": "PHYSICIAN ASSISTANT", "PA C": "PHYSICIAN ASSISTANT", "PAC": "PHYSICIAN ASSISTANT",
    "PHYSICIAN ASSOCIATE": "PHYSICIAN ASSISTANT", "PHYSICIANS ASSISTANT": "PHYSICIAN ASSISTANT",
    "RN": "REGISTERED NURSE", "STAFF RN": "REGISTERED NURSE", "STAFF NURSE": "REGISTERED NURSE",
    "NURSE": "REGISTERED NURSE", "CLINICAL NURSE": "REGISTERED NURSE", "CHARGE NURSE": "REGISTERED NURSE",
    "DIRECTOR OF MEDICINE": "MEDICAL DIRECTOR", "DIR OF MEDICINE": "MEDICAL DIRECTOR",
    "MED DIRECTOR": "MEDICAL DIRECTOR", "CHIEF MEDICAL OFFICER": "MEDICAL DIRECTOR", "CMO": "MEDICAL DIRECTOR",
    "ORTHOPEDIC SURGEON": "SURGEON", "GENERAL SURGEON": "SURGEON", "ORTHOPAEDIC SURGEON": "SURGEON",
    "PRACTICE ADMINISTRATOR": "ADMINISTRATOR", "PRACTICE MANAGER": "ADMINISTRATOR",
    "OFFICE MANAGER": "ADMINISTRATOR", "CLINIC MANAGER": "ADMINISTRATOR",
    "RPH": "PHARMACIST", "PHARMD": "PHARMACIST", "CLINICAL PHARMACIST": "PHARMACIST",
    "PHYSICAL THERAPIST": "THERAPIST", "PT": "THERAPIST", "OCCUPATIONAL THERAPIST": "THERAPIST",
}

# Common English short forms and the given names that they stand for.
NICKNAMES = {
    "BILL": ["ROBERT", "WILL", "WILLIAM", "WILLIS"], "WILL": ["WILLIAM"], "BILLY": ["WILLIAM"], "BOB": ["ROBERT"], "ROB": ["ROBERT"], "BOBBY": ["ROBERT"],
    "JIM": ["JAMES"], "JIMMY": ["JAMES"], "MIKE": ["MICHAEL"], "DAVE": ["DAVID"], "DAN": ["DANIEL"], "TOM": ["THOMAS"],
    "TONY": ["ANTHONY"], "JOE": ["JOSEPH"], "CHRIS": ["CHRISTINE", "CHRISTOPHER"], "STEVE": ["STEPHEN", "STEVEN"], "RICK": ["RICHARD"],
    "DICK": ["RICHARD"], "RICH": ["RICHARD"], "MATT": ["MATTHEW"], "ANDY": ["ANDREW"], "KEN": ["KENNETH"], "ED": ["EDWARD"], "TED": ["EDWARD", "THEODORE"],
    "GREG": ["GREGORY"], "JEFF": ["JEFFREY"], "PAT": ["PATRICIA", "PATRICK"], "SAM": ["SAMANTHA", "SAMUEL"], "ALEX": ["ALEXANDER", "ALEXANDRA"],
    "BEN": ["BENJAMIN"], "NICK": ["NICHOLAS"], "CHUCK": ["CHARLES"], "CHARLIE": ["CHARLES"], "LARRY": ["LAWRENCE"], "RON": ["RONALD"], "DON": ["DONALD"],
    "LIZ": ["ELIZABETH"], "BETH": ["ELIZABETH"], "BETTY": ["ELIZABETH"], "KATE": ["CATHERINE", "KATHERINE"], "KATHY": ["CATHERINE", "KATHERINE"],
    "SUE": ["SUSAN"], "PEGGY": ["MARGARET"], "MEG": ["MARGARET"], "MAGGIE": ["MARGARET"], "JEN": ["JENNIFER"], "JENNY": ["JENNIFER"], "BECKY": ["REBECCA"],
    "DEB": ["DEBORAH"], "DEBBIE": ["DEBORAH"], "BARB": ["BARBARA"], "CINDY": ["CYNTHIA"], "NANCY": ["ANN"], "TERRY": ["TERESA", "TERENCE"], "VICKY": ["VICTORIA"],
    "JACK": ["JOHN"], "JON": ["JONATHAN"], "TIM": ["TIMOTHY"], "FRED": ["FREDERICK"], "HANK": ["HENRY"], "HARRY": ["HAROLD", "HENRY"], "RAY": ["RAYMOND"],
}

# Valid first two digits of an employer number, as inclusive ranges.
EIN_PREFIX_RANGES = ((1, 6), (10, 16), (20, 27), (30, 48), (50, 59), (60, 68), (71, 77), (80, 88), (90, 95), (98, 99))
NPI_PREFIX = "80840"

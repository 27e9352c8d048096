"""Dimension tables: labels, keywords, hints, requirements. Small and fixed, so always broadcast.

All phrases are fixed values, in normalised form (upper case, A-Z, 0-9 and blanks).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: (doc_type, field): labels in order of priority.
LABELS = {
    ("pan", "name"): ["NAME", "NAME OF THE CARDHOLDER", "CARDHOLDER NAME", "CARD HOLDER NAME"],
    ("pan", "father_name"): ["FATHER S NAME", "FATHERS NAME", "FATHER NAME", "NAME OF FATHER", "PARENT S NAME", "PARENTS NAME", "NAME OF PARENT"],
    ("pan", "date_of_birth"): ["DATE OF BIRTH", "DATE OF BIRTH INCORPORATION", "DATE OF BIRTH OR INCORPORATION", "DOB"],
    ("pan", "pan_number"): ["PERMANENT ACCOUNT NUMBER", "PERMANENT ACCOUNT NUMBER CARD", "PAN"],
    ("voter_id", "name"): ["ELECTOR S NAME", "ELECTORS NAME", "ELECTOR NAME", "NAME OF ELECTOR", "NAME"],
    ("voter_id", "father"): ["FATHER S NAME", "FATHERS NAME", "FATHER NAME", "NAME OF FATHER", "FATHER"],
    ("voter_id", "husband"): ["HUSBAND S NAME", "HUSBANDS NAME", "HUSBAND NAME", "NAME OF HUSBAND", "HUSBAND"],
    ("voter_id", "date_of_birth"): ["DATE OF BIRTH", "DOB"],
    ("voter_id", "gender"): ["SEX", "GENDER"],
    ("driving_licence", "name"): ["NAME", "HOLDER S NAME", "HOLDERS NAME", "HOLDER NAME"],
    ("driving_licence", "date_of_birth"): ["DATE OF BIRTH", "DOB", "BIRTH"],
    ("driving_licence", "issue_date"): ["DATE OF ISSUE", "ISSUE DATE", "DOI", "ISSUE"],
    ("driving_licence", "validity_date"): ["VALID TILL", "VALID UPTO", "VALID UNTIL", "VALIDITY", "DATE OF EXPIRY", "EXPIRY"],
    ("nrega_job_card", "job_card_number"): ["JOB CARD NO", "JOB CARD NUMBER"],
    ("nrega_job_card", "head_of_household"): ["NAME OF HEAD OF HOUSEHOLD", "HEAD OF HOUSEHOLD"],
    ("nrega_job_card", "village"): ["VILLAGE", "NAME OF VILLAGE"],
    ("nrega_job_card", "gram_panchayat"): ["NAME OF GRAM PANCHAYAT", "GRAM PANCHAYAT", "G P NAME", "PANCHAYAT"],
    ("nrega_job_card", "district"): ["DISTRICT NAME", "DISTRICT"],
    ("aadhaar", "address"): ["ADDRESS"],
    ("passport", "surname"): ["SURNAME"],
    ("passport", "given_names"): ["GIVEN NAME S", "GIVEN NAMES", "GIVEN NAME"],
}
#: Printed labels of a passport's biodata page, checked against its zone.
PASSPORT_LABELS = {
    ("passport", "surname"): ["SURNAME", "FAMILY NAME", "LAST NAME", "NOM"],
    ("passport", "date_of_birth"): ["DATE OF BIRTH", "BIRTH DATE", "DOB", "NAISSANCE"],
    ("passport", "expiry_date"): ["DATE OF EXPIRY", "EXPIRY DATE", "DATE OF EXPIRATION", "EXPIRY", "EXPIRATION", "VALID UNTIL"],
    ("passport", "issue_date"): ["DATE OF ISSUE", "ISSUE DATE", "ISSUED", "D LIVRANCE"],
    ("passport", "place_of_birth"): ["PLACE OF BIRTH", "BIRTHPLACE", "LIEU DE NAISSANCE"],
}
#: Labels of its back page.
BACK_LABELS = {
    ("back", "father_name"): ["NAME OF FATHER", "FATHER LEGAL GUARDIAN", "NAME OF FATHER LEGAL GUARDIAN", "FATHER", "LEGAL GUARDIAN"],
    ("back", "mother_name"): ["NAME OF MOTHER", "MOTHER"],
    ("back", "spouse_name"): ["NAME OF SPOUSE", "SPOUSE"],
    ("back", "address"): ["ADDRESS"],
    ("back", "file_number"): ["FILE NO", "FILE NUMBER"],
    ("back", "old_passport"): ["OLD PASSPORT NO", "OLD PASSPORT NUMBER", "PREVIOUS PASSPORT", "OLD PASSPORT"],
    ("back", "old_issue_date"): ["DATE OF ISSUE"],
    ("back", "old_issue_place"): ["PLACE OF ISSUE"],
}
#: Labels of a population-register letter: English (normalised form) and Hindi (as printed) by field.
NPR_LABELS = {
    "reference_number": (["REFERENCE NUMBER", "REFERENCE NO", "REF NUMBER", "REF NO", "LETTER NUMBER", "LETTER NO", "FILE NUMBER", "FILE NO"], ["संदर्भ संख्या", "पत्र संख्या"]),
    "name": (["NAME OF RESIDENT", "RESIDENT NAME", "NAME"], ["निवासी का नाम", "नाम"]),
    "address": (["ADDRESS OF RESIDENT", "RESIDENT ADDRESS", "POSTAL ADDRESS", "ADDRESS"], ["निवासी का पता", "पता"]),
    "issue_date": (["DATE OF ISSUE", "ISSUE DATE", "LETTER DATE"], ["जारी करने की तिथि", "दिनांक"]),
    "pincode": (["PIN CODE", "PINCODE", "POSTAL CODE"], ["पिन कोड"]),
}
#: Labels that also occur in prose: they count alone or before a colon only.
NPR_GENERIC = ["NAME", "ADDRESS", "नाम", "पता"]
NPR_FOOTERS = ["YOURS FAITHFULLY", "AUTHORISED SIGNATORY", "AUTHORIZED SIGNATORY", "SIGNATURE", "REGISTRAR GENERAL", "CENSUS COMMISSIONER", "TELEPHONE", "PHONE", "EMAIL", "WEBSITE"]
#: Titles and issuers in Hindi.
NPR_TITLE_HINDI, NPR_ISSUERS_HINDI = "राष्ट्रीय जनसंख्या रजिस्टर", ["महापंजीयक", "जनगणना आयुक्त"]
#: Indian states by code.
STATES = {
    "AP": "Andhra Pradesh", "AR": "Arunachal Pradesh", "AS": "Assam", "BR": "Bihar", "CG": "Chhattisgarh", "GA": "Goa", "GJ": "Gujarat", "HR": "Haryana", "HP": "Himachal Pradesh", "JH": "Jharkhand",
    "KA": "Karnataka", "KL": "Kerala", "MP": "Madhya Pradesh", "MH": "Maharashtra", "MN": "Manipur", "ML": "Meghalaya", "MZ": "Mizoram", "NL": "Nagaland", "OD": "Odisha", "OR": "Odisha",
    "PB": "Punjab", "RJ": "Rajasthan", "SK": "Sikkim", "TN": "Tamil Nadu", "TS": "Telangana", "TR": "Tripura", "UP": "Uttar Pradesh", "UK": "Uttarakhand", "WB": "West Bengal",
    "AN": "Andaman and Nicobar Islands", "CH": "Chandigarh", "DN": "Dadra and Nagar Haveli and Daman and Diu", "DD": "Dadra and Nagar Haveli and Daman and Diu", "DL": "Delhi", "JK": "Jammu and Kashmir", "LA": "Ladakh", "LD": "Lakshadweep", "PY": "Puducherry",
}
#: Codes in a zone's country field besides the three-letter codes of countries.
EXTRA_COUNTRIES = ["D<<", "GBD", "GBN", "GBO", "GBP", "GBS", "XBA", "XIM", "XCC", "XOM", "XXA", "XXB", "XXC", "UNO", "UNA", "EUE"]
KEYWORDS = {
    ("pan", "keyword"): ["INCOME TAX DEPARTMENT", "PERMANENT ACCOUNT NUMBER", "INCOME TAX"],
    ("aadhaar", "keyword"): ["AADHAAR", "AADHAR", "UNIQUE IDENTIFICATION", "UIDAI", "MERA AADHAAR", "ENROLLMENT NO", "VID"],
    ("driving_licence", "keyword"): ["DRIVING LICENCE", "DRIVING LICENSE", "TRANSPORT DEPARTMENT", "MOTOR VEHICLE", "FORM 7"],
    ("voter_id", "keyword"): ["ELECTION COMMISSION", "ELECTORS PHOTO IDENTITY", "ELECTOR", "ELECTION", "IDENTITY CARD"],
    ("nrega_job_card", "title"): ["MAHATMA GANDHI NATIONAL RURAL EMPLOYMENT GUARANTEE ACT", "MAHATMA GANDHI NATIONAL RURAL EMPLOYMENT GUARANTEE SCHEME", "MAHATMA GANDHI NREGA", "MGNREGA"],
    ("nrega_job_card", "card"): ["JOB CARD", "EMPLOYMENT CARD"],
    ("nrega_job_card", "context"): ["GRAM PANCHAYAT", "RURAL EMPLOYMENT", "EMPLOYMENT GUARANTEE", "HOUSEHOLD MEMBERS WILLING TO WORK"],
    ("nrega_job_card", "acronym"): ["NREGA"],
    ("npr_letter", "title"): ["NATIONAL POPULATION REGISTER"],
    ("npr_letter", "issuer"): ["REGISTRAR GENERAL", "CENSUS COMMISSIONER"],
    ("npr_letter", "acronym"): ["NPR"],
    ("passport", "keyword"): ["PASSPORT", "REPUBLIC OF INDIA PASSPORT"],
}
#: Titles and words of job cards in Hindi.
NREGA_TITLES_HINDI, NREGA_CARD_HINDI, NREGA_CONTEXT_HINDI = ["राष्ट्रीय ग्रामीण रोजगार गारंटी", "महात्मा गांधी राष्ट्रीय ग्रामीण रोजगार गारंटी"], "जॉब कार्ड", ["ग्राम पंचायत", "रोजगार गारंटी"]
PAGE_HINTS = {
    "biodata": ["SURNAME", "GIVEN NAME", "PASSPORT NO", "PASSPORT NUMBER", "DATE OF BIRTH", "NATIONALITY", "PLACE OF BIRTH", "DATE OF ISSUE", "DATE OF EXPIRY", "SEX", "COUNTRY CODE"],
    "non_biodata": ["NAME OF FATHER", "LEGAL GUARDIAN", "NAME OF MOTHER", "NAME OF SPOUSE", "ADDRESS", "FILE NO", "OLD PASSPORT", "PLACE OF ISSUE"],
}
LABEL_HINTS = ["SURNAME", "GIVEN NAME", "NAME", "DATE", "BIRTH", "NATIONALITY", "PASSPORT", "SEX", "PLACE", "ISSUE", "EXPIRY", "EXPIRATION", "VALID", "COUNTRY", "CODE", "FATHER", "MOTHER", "SPOUSE", "ADDRESS", "FILE"]
#: Order in which equal scores are decided.
TYPES = ["pan", "aadhaar", "driving_licence", "voter_id", "nrega_job_card", "npr_letter", "passport"]
#: By type: what must be present, and the fields of which one is enough.
REQUIRED = {
    "pan": {"pan_number": ["pan_number"], "name": ["name"], "date_of_birth": ["date_of_birth"]},
    "aadhaar": {"aadhaar_number_or_masked_last4": ["aadhaar_number", "masked_last4"], "name": ["name"], "date_or_year_of_birth": ["date_of_birth", "year_of_birth"], "gender": ["gender"]},
    "driving_licence": {"dl_number": ["dl_number"], "name": ["name"], "date_of_birth": ["date_of_birth"], "issue_date": ["issue_date"], "validity_date": ["validity_date"]},
    "voter_id": {"epic_number": ["epic_number"], "name": ["name"], "date_of_birth_or_age": ["date_of_birth", "age"]},
    "nrega_job_card": {"job_card_number": ["job_card_number"], "household_or_member_name": ["head_of_household", "member_name"], "location": ["village", "gram_panchayat", "district", "address"]},
    "npr_letter": {"name": ["name"], "address": ["address"]},
}
#: What the address side of an Aadhaar card must have: it shows an address or pincode and none of the holder's particulars.
AADHAAR_BACK = {"aadhaar_number_or_masked_last4": ["aadhaar_number", "masked_last4"], "address": ["address"], "pincode": ["pincode"]}
AADHAAR_FRONT = ["name", "date_of_birth", "year_of_birth", "gender"]


def label_rows() -> list[tuple]:
    return [(t, f, label, k) for (t, f), labels in LABELS.items() for k, label in enumerate(labels)]


def keyword_rows() -> list[tuple]:
    return [(t, e, k) for (t, e), words in KEYWORDS.items() for k in words]


def hint_rows() -> list[tuple]:
    return [(kind, h) for kind, hints in PAGE_HINTS.items() for h in hints]


def nesting_rows() -> list[tuple]:
    """(doc_type, evidence, short, long): a keyword inside another of its list, at word boundaries."""
    return [(t, e, a, b) for (t, e), words in KEYWORDS.items() for a in words for b in words if a != b and f" {a} " in f" {b} "]


def rows_of(labels: dict) -> list[tuple]:
    """(type, field, label, priority) of one of the label tables above."""
    return [(t, f, label, k) for (t, f), names in labels.items() for k, label in enumerate(names)]


def label_dim(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(label_rows() if rows is None else rows, "doc_type string, field string, label string, priority int")


def country_dim(spark: SparkSession) -> DataFrame:
    """code: three-letter codes of all countries that the Java runtime lists, and EXTRA_COUNTRIES."""
    locale = spark.sparkContext._jvm.java.util.Locale
    codes = [locale("", c).getISO3Country() for c in locale.getISOCountries()]
    return spark.createDataFrame([(c,) for c in sorted({*codes, *EXTRA_COUNTRIES})], "code string")


def keyword_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(keyword_rows(), "doc_type string, evidence string, keyword string")


def hint_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(hint_rows(), "kind string, hint string")


def nesting_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(nesting_rows(), "doc_type string, evidence string, short string, long string")


def sizes(phrases: list[str]) -> list[int]:
    """Numbers of words that occur among the phrases."""
    return sorted({len(p.split()) for p in phrases})

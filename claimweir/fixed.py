"""Names, wordings, lists and patterns that results must agree with.

Everything here is plain data. Logic lives in the other modules.
"""

# Defaults of a raw claim.
DEFAULT_CURRENCY = "EUR"
DEFAULT_TIER = "Standard Operational Claim (Non-ICT)"
DEFAULT_INCIDENT = "Operational Impact"
DEFAULT_FILING_DATE = "2026-02-01"
POLICY_PLACEHOLDERS = ["", "N/A", "None", "[MISSING]", "[MISSING / NOT PROVIDED]", "null"]
POLICY_ABSENT_WORDS = ["MISSING", "NOT PROVIDED", "NONE", "N/A"]
ANOMALY_BANNER = "FLAGGED ANOMALY"

# Masking.
NAME_TITLES = ["mr.", "mrs.", "ms.", "dr.", "prof."]
NAME_REDACTED = "[NAME_REDACTED]"
EMAIL_REDACTED = "[EMAIL_REDACTED]"
PHONE_REDACTED = "[PHONE_REDACTED]"
PPSN_REDACTED = "[PPSN_REDACTED]"
HASH_PREFIX = "PPSN_"
UNKNOWN_COUNTY = "Unknown County"
UNKNOWN_ROUTING_KEY = "UNK"

# Patterns of personal data in free text.
PPSN_IN_TEXT = r"\b(\d{7}[A-Za-z]{1,2})\b"
EMAIL_IN_TEXT = r"\b([A-Za-z0-9._%+-]+)@([A-Za-z0-9.-]+\.[A-Z|a-z]{2,})\b"
PHONE_IN_TEXT = r"(\+?353[\s\-]?)?(0?[1-9]\d{1,2}[\s\-]?)?(\d{3}[\s\-]?\d{4})"
PPSN_WHOLE = r"^\d{7}[A-Za-z]{1,2}$"
COUNTY_IN_ADDRESS = r"Co\.\s*([A-Za-z\s]+?)(?:\[|$|\,)"

# Redaction tags.
TAG_PPSN = "PSEUDONYMIZED_IRISH_PPSN"
TAG_NAME = "MASKED_CLAIMANT_NAME"
TAG_EMAIL = "MASKED_CLAIMANT_EMAIL"
TAG_PHONE = "MASKED_CLAIMANT_PHONE"
TAG_GEO = "GENERALIZED_GEOGRAPHIC_LOCATION"
TAG_NARRATIVE = "SCRUBBED_NARRATIVE_PII"

# Field patterns of a dossier text.
DOSSIER_PATTERNS = {
    "claim_id": r"(?:Claim Reference:|DOSSIER ID:)\s*([A-Z0-9\-]+)",
    "policy_number": r"Policy Number:\s*([^\n\r]+)",
    "status_banner": r"STATUS:\s*([^\n\r]+)",
    "filing_date": r"Filing Date:\s*(\d{4}-\d{2}-\d{2})",
    "incident_date": r"Incident Date:\s*(\d{4}-\d{2}-\d{2})",
    "days_to_notify": r"Notice Latency:\s*(\d+)\s*days",
    "dora_classification": r"DORA Tier:\s*([^\n\r]+)",
    "claimant_name": r"Claimant Name:\s*([^\n\r]+)",
    "claimant_ppsn": r"Claimant PPSN:\s*([^\n\r]+)",
    "claimant_email": r"Contact Email:\s*([^\n\r]+)",
    "claimant_phone": r"Contact Phone:\s*([^\n\r]+)",
    "loss_location": r"Loss Location:\s*([^\n\r]+(?:\n[^\n\r]+)?)",
    "eircode": r"\[([A-Z0-9]{3}\s+[A-Z0-9]{4})\]",
    "incident_type": r"Incident Type:\s*([^\n\r]+)",
    "incident_description": r"INCIDENT SYNOPSIS & REGULATORY CLASSIFICATION\s*(.*?)\s*ITEMIZED FINANCIAL LOSS ASSESSMENT",
    "items_section": r"ITEMIZED FINANCIAL LOSS ASSESSMENT.*?Net Claim.*?\n(.*?)\s+TOTALS",
    "statutory_attestation": r"STATUTORY DECLARATION:\s*(.*?)\s*Claimant / Authorized",
}
MONEY = r"(-?\d[\d,]*\.\d{2})"
TOTALS_LABEL = r"TOTALS\s+Aggregated Claim Liquidation Value"
ITEM_CATEGORY = "Operational Loss Item "
ITEM_DESCRIPTION = "Incurred expense during event mitigation for "
EXTRACTION_METHOD = "deterministic_pypdf_regex"
EXTRACTION_VERSION = "parser_engine_v1"

# Quality rules.
RULE_POLICY = "RULE_POLICY_NUMBER_PRESENT"
RULE_AMOUNTS = "RULE_POSITIVE_AMOUNTS"
RULE_TIMELY = "RULE_TIMELY_NOTIFICATION"
RULE_CURRENCY = "RULE_ALLOWED_CURRENCY"
RULE_PPSN = "RULE_VALID_PPSN_FORMAT"
RULE_LEDGER = "RULE_LEDGER_RECONCILED"
RULE_METADATA = "RULE_METADATA_COMPLETENESS"
ALLOWED_CURRENCIES = ["EUR", "USD", "GBP", "CHF", "JPY", "CAD", "AUD"]
PROMOTED = "VALID_PROMOTED"
QUARANTINED = "QUARANTINED"

# Provinces and their counties.
PROVINCES = {
    "Leinster": [
        "Co. Dublin",
        "Co. Kildare",
        "Co. Meath",
        "Co. Wicklow",
        "Co. Wexford",
        "Co. Carlow",
        "Co. Kilkenny",
        "Co. Laois",
        "Co. Offaly",
        "Co. Westmeath",
        "Co. Longford",
        "Co. Louth",
    ],
    "Munster": [
        "Co. Cork",
        "Co. Kerry",
        "Co. Limerick",
        "Co. Tipperary",
        "Co. Waterford",
        "Co. Clare",
    ],
    "Connacht": [
        "Co. Galway",
        "Co. Mayo",
        "Co. Roscommon",
        "Co. Sligo",
        "Co. Leitrim",
    ],
    "Ulster": [
        "Co. Donegal",
        "Co. Cavan",
        "Co. Monaghan",
        "Co. Armagh",
        "Co. Antrim",
        "Co. Down",
        "Co. Derry",
        "Co. Fermanagh",
        "Co. Tyrone",
    ],
}
OTHER_PROVINCE = "Other / National"
COUNTRY = "Ireland"
TIER_1 = "Tier 1 - Major Incident"
TIER_2 = "Tier 2 - Significant Disruption"
TIER_3 = "Tier 3 - Standard Loss"
CONTRACT_STATUS = "ACTIVE_UNDERWRITTEN"
UNDERWRITER = "Emerald Shield Assurance DAC"
CLAIMANT_CATEGORY = "CONFIDENTIAL_INDIVIDUAL"

# Corpus chunks.
SECTION_HEADER = r"(SECTION\s+(\d+)\s*:[^\n]+)"
PREAMBLE_SECTION = "PREAMBLE & JURISDICTION"
WHOLE_SECTION = "GENERAL GUIDELINES"
REGULATORY_BODY = "Central Bank of Ireland / European Union"
FRAMEWORK = "DORA & Operational Resilience"

# Audit areas — name, corpus section, retrieval query, heading and excerpt when nothing is found,
# citation recorded on a breach.
AUDIT_AREAS = [
    (
        "STATUTORY_NOTIFICATION_SLA",
        3,
        "operational claims submission deadline 90 days statutory SLA notification latency",
        "SECTION 3: STATUTORY NOTIFICATION TIMELINES",
        "Claims must be submitted within 90 days from incident date.",
        "CBI-DORA Section 3.2 (90-Day SLA Limit)",
    ),
    (
        "MANDATORY_POLICY_NUMBER",
        4,
        "mandatory policy identification number contractual validity consumer protection",
        "SECTION 4: MANDATORY POLICY IDENTIFICATION",
        "Every claim must bear an active, verified Policy Number.",
        "CBI-DORA Section 4.1 & 4.2 (Mandatory Policy Identification)",
    ),
    (
        "FINANCIAL_VALUATION_INTEGRITY",
        5,
        "negative liquidation prohibition positive financial loss valuation integrity",
        "SECTION 5: FINANCIAL INTEGRITY AND VALUATION",
        "Negative liquidation claims are strictly prohibited and considered irregular.",
        "CBI-DORA Section 5.2 (Negative Liquidation Prohibition)",
    ),
    (
        "GDPR_DATA_PRIVACY_PPSN",
        6,
        "GDPR Article 4 restricted identifiers Irish PPSN cryptographic pseudonymization",
        "SECTION 6: DATA GOVERNANCE AND GDPR",
        "PPSNs must be pseudonymized using cryptographically salted digests.",
        None,
    ),
]
AUDIT_NO_POLICY = ["", "None", "null", "[MISSING]"]

# Review.
REGISTER_NO_POLICY = "[MISSING / NOT PROVIDED]"
OVERRIDE_ACTION = "Override with Force Majeure Exception (Promote to Silver)"
REJECT_ACTION = "Confirm Statutory Rejection (Enforce CBI Rule)"
RECTIFY_ACTION = "Request Contract Rectification (Policyholder Contact)"

# Preset retrieval questions.
PRESET_QUESTIONS = [
    "What is the statutory deadline and SLA for submitting an insurance claim notification?",
    "Is a policy number mandatory for claim liquidation and what happens if missing?",
    "What are the rules regarding negative liquidation and financial valuation?",
    "What are the requirements for Irish PPSN cryptographic pseudonymization under GDPR?",
    "What are the criteria for a Major ICT-Related Incident under DORA Article 18?",
]

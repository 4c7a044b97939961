"""Fixed values.

Word lists, weights, labels and formats that have to be exactly these for results to be
right. They are plain data; nothing here is computed.
"""

# --- fixed values: ingestion -------------------------------------------------------------
EXTENSIONS = ("eml", "msg", "txt", "csv", "xlsx", "docx", "pdf")
EXCLUDED_NAMES = ("ground_truth.csv", ".gitkeep", "README.md", "README_SYNTHETIC_DATA.txt")

# --- fixed values: entity types, in reporting order --------------------------------------
ENTITIES = (
    "IN_AADHAAR", "IN_PAN", "IN_IFSC", "IN_PHONE", "IN_UPI", "BANK_ACCOUNT", "SALARY",
    "HEALTH_INFO", "PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD", "US_SSN",
    "IBAN_CODE", "LOCATION", "DATE_TIME", "IP_ADDRESS",
)
# Types that win ties against the generic ones.
CUSTOM_TYPES = (
    "IN_AADHAAR", "IN_PAN", "IN_IFSC", "IN_PHONE", "IN_UPI", "BANK_ACCOUNT", "SALARY", "HEALTH_INFO",
)
# Types with fuzzy borders, trimmed around the others.
NER_TYPES = ("PERSON", "LOCATION", "DATE_TIME")
NER_LABELS = {
    "PER": "PERSON", "PERSON": "PERSON",
    "LOC": "LOCATION", "GPE": "LOCATION", "FAC": "LOCATION",
    "DATE": "DATE_TIME", "TIME": "DATE_TIME",
}

# --- fixed values: context words (regular-expression fragments) --------------------------
AADHAAR_WORDS = ("aadhaar", "aadhar", "adhaar", "uid", "uidai", "enrolment", "e-kyc", "ekyc", "kyc")
BANK_WORDS = ("account", "acc", "a/c", "acct", "ac no", "bank", "savings", "current a/c", "beneficiary")
CARD_WORDS = ("card", "credit", "debit", "visa", "mastercard", "rupay", "amex", "charged")
SALARY_WORDS = (
    "salary", "salaries", "ctc", "compensation", "pay", "payslip", "pay slip", "payroll", "bonus",
    "package", "wage", "wages", "remuneration", "stipend", "gross", "net pay", "earnings",
    "increment", "appraisal", "basic", "hra", "take-home", "take home",
)

# --- fixed values: lexicons --------------------------------------------------------------
PAN_HOLDERS = "PCHFATBLJG"
UPI_HANDLES = (
    "okaxis", "okhdfcbank", "okicici", "oksbi", "ybl", "ibl", "axl", "paytm", "upi", "apl",
    "ptyes", "ptsbi", "pthdfc", "ptaxis", "axisbank", "icici", "hdfcbank", "sbi", "kotak",
    "yesbank", "jupiteraxis", "fbl", "waaxis", "wahdfcbank", "waicici", "wasbi", "ikwik",
    "freecharge", "airtel", "jio", "slc", "abfspay", "idfcbank", "pingpay", "axisb", "rbl",
)
HEALTH_TERMS = (
    "diagnos(?:is|ed|es)", "prescription", "prescribed", "hospitali[sz](?:ed|ation)", "hospital",
    "surgery", "surgical", "diabet(?:es|ic)", "hypertension", "pregnan(?:cy|t)", "maternity leave",
    "miscarriage", "cancer", "chemotherapy", "tumou?r", "asthma", "dengue", "typhoid", "malaria",
    "tuberculosis", "hiv", "covid-19 positive", "fracture[sd]?", "clinical depression",
    "depression", "anxiety disorder", "thyroid", "blood pressure", "medical certificate",
    "medical leave", "physiotherapy", "cardiac", "angioplasty", "dialysis", "mri scan",
    "blood test", "insulin", "migraine", "jaundice", "appendicitis", "psychiatri(?:st|c)",
)
NAME_LABELS = (
    "name", "employee name", "customer name", "candidate name", "beneficiary name",
    "traveller [0-9]", "employee", "patient name",
)
NAME_CUES = (
    "dear", "hi", "hello", r"mr\.?", r"mrs\.?", r"ms\.?", r"dr\.?", "shri", r"smt\.?",
    "customer", "candidate", "employee",
)
NAME_CLOSINGS = ("regards,", "sincerely,")  # with a line end behind them
NAME_STOP_WORDS = (
    "team", "care", "customer", "support", "accounts", "account", "desk", "sir", "madam", "all",
    "travel", "operations", "acquisition", "talent", "hr", "manager", "department", "services",
    "name", "id", "bank", "office", "the", "and", "policy", "notes", "limited", "ltd", "pvt",
)

# --- fixed values: scoring ---------------------------------------------------------------
WEIGHTS = {
    "IN_AADHAAR": 10, "CREDIT_CARD": 10, "HEALTH_INFO": 9, "IN_PAN": 8, "BANK_ACCOUNT": 8,
    "US_SSN": 10, "IBAN_CODE": 8, "SALARY": 7, "IN_UPI": 6, "IN_PHONE": 4, "PHONE_NUMBER": 4,
    "IN_IFSC": 3, "EMAIL_ADDRESS": 2, "IP_ADDRESS": 2, "PERSON": 1, "LOCATION": 0, "DATE_TIME": 0,
}
UNSCORED = ("DATE_TIME", "LOCATION")
LEVELS = ("High", "Medium", "Low", "Clean")
BONUS_TIERS = ((10, 10), (50, 20), (200, 30))
IDENTITY_TYPES = (
    "PERSON", "IN_AADHAAR", "IN_PAN", "EMAIL_ADDRESS", "IN_PHONE", "PHONE_NUMBER", "US_SSN",
)
SENSITIVE_TYPES = ("HEALTH_INFO", "SALARY", "BANK_ACCOUNT", "CREDIT_CARD", "IN_UPI", "IBAN_CODE")
ACCOUNT_TYPES = ("BANK_ACCOUNT", "CREDIT_CARD", "IN_UPI", "IBAN_CODE")
IDENTIFIER_TYPES = (
    "IN_AADHAAR", "IN_PAN", "EMAIL_ADDRESS", "IN_PHONE", "PHONE_NUMBER", "CREDIT_CARD",
    "BANK_ACCOUNT", "US_SSN", "IN_UPI", "IBAN_CODE",
)
EVALUATED = (
    "IN_AADHAAR", "IN_PAN", "IN_IFSC", "IN_PHONE", "IN_UPI", "BANK_ACCOUNT", "SALARY",
    "HEALTH_INFO", "EMAIL_ADDRESS", "CREDIT_CARD", "IP_ADDRESS", "PERSON",
)
CLEAN_REASON = "No personal data detected"

# --- fixed values: friendly names (singular, plural) -------------------------------------
FRIENDLY = {
    "IN_AADHAAR": ("Aadhaar number", "Aadhaar numbers"),
    "IN_PAN": ("PAN", "PANs"),
    "IN_IFSC": ("IFSC code", "IFSC codes"),
    "IN_PHONE": ("Indian mobile number", "Indian mobile numbers"),
    "IN_UPI": ("UPI ID", "UPI IDs"),
    "BANK_ACCOUNT": ("bank account number", "bank account numbers"),
    "SALARY": ("salary amount", "salary amounts"),
    "HEALTH_INFO": ("health reference", "health references"),
    "PERSON": ("person name", "person names"),
    "EMAIL_ADDRESS": ("email address", "email addresses"),
    "PHONE_NUMBER": ("phone number", "phone numbers"),
    "CREDIT_CARD": ("credit card number", "credit card numbers"),
    "US_SSN": ("US SSN", "US SSNs"),
    "IBAN_CODE": ("IBAN", "IBANs"),
    "IP_ADDRESS": ("IP address", "IP addresses"),
    "LOCATION": ("location", "locations"),
    "DATE_TIME": ("date", "dates"),
}

# --- fixed values: regulation (type -> DPDP category, higher risk, GDPR category, financial)
REGULATION = {
    "IN_AADHAAR": ("Personal data (national ID)", True, "Personal data (national identifier, Art. 87)", False),
    "IN_PAN": ("Personal data (tax ID)", True, "Personal data (national identifier)", True),
    "IN_IFSC": ("Personal data when linked to an account", False, "Personal data when linked", True),
    "IN_PHONE": ("Personal data (contact)", False, "Personal data", False),
    "IN_UPI": ("Personal data (financial)", True, "Personal data (financial)", True),
    "BANK_ACCOUNT": ("Personal data (financial)", True, "Personal data (financial)", True),
    "SALARY": ("Personal data (financial)", True, "Personal data (financial)", True),
    "HEALTH_INFO": ("Personal data (health)", True, "Special category data (Art. 9 - health)", False),
    "CREDIT_CARD": ("Personal data (financial)", True, "Personal data (financial)", True),
    "IBAN_CODE": ("Personal data (financial)", True, "Personal data (financial)", True),
    "US_SSN": ("Personal data (national ID)", True, "Personal data (national identifier)", False),
    "PERSON": ("Personal data", False, "Personal data", False),
    "EMAIL_ADDRESS": ("Personal data (contact)", False, "Personal data", False),
    "PHONE_NUMBER": ("Personal data (contact)", False, "Personal data", False),
    "IP_ADDRESS": ("Personal data (online identifier)", False,
                   "Personal data (online identifier, Recital 30)", False),
    "LOCATION": ("Personal data when linked", False, "Personal data when linked", False),
    "DATE_TIME": ("Personal data when linked (e.g. DOB)", False, "Personal data when linked", False),
}
REGULATION_DEFAULT = ("Personal data", False, "Personal data", False)
OTHER_PENALTIES_CRORE = (
    ("Failure to notify a personal data breach", 200),
    ("Breach of obligations for children's data", 200),
    ("Breach of Significant Data Fiduciary obligations", 150),
    ("Breach of any other provision", 50),
)
EXPOSURE_BANDS = ((75, "Critical"), (50, "High"), (25, "Moderate"))

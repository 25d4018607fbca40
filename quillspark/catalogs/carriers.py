"""Carriers: names, acceptance, patterns in order, and the policies on them."""

# Fixed values.
#: name, status, patterns; doubled backslashes match a literal backslash, as they stand.
CARRIERS = [
    ("AARP", "accepted", (r"\\bAARP\\b",)),
    ("APWU", "accepted", ("APWU",)),
    ("Aetna", "accepted", (r"\bAETNA\b",)),
    ("Aetna Medicare", "accepted", (r"AETNA\s+MEDICARE",)),
    ("Alignment Health", "not_accepted", (r"ALIGN(?:N)?MENT\s+HEALTH",)),
    ("Allegiance Benefits", "accepted", (r"ALLEG(?:IANCE)?\\s+BENEFITS",)),
    ("Allied Benefits", "accepted", (r"ALLIED\\s+BENEFITS",)),
    ("AmBetter", "accepted", ("AMBETTER",)),
    ("Anthem BCBS", "accepted", (r"\bANTHEM\b", r"\bBLUE\s*CROSS\b", r"\bBLUE\s*SHIELD\b", r"\bBCBS\b")),
    ("Anthem BCBS Medicaid", "accepted", (r"ANTHEM\\s+BCBS\\s+MEDICAID", r"ANTHEM\\s+MEDICAID")),
    ("Anthem BCBS Medicare", "accepted", (r"ANTHEM\\s+BCBS\\s+MEDICARE", r"ANTHEM\\s+MEDIBLUE")),
    ("Anthem MediBlue", "accepted", (r"ANTHEM\\s+MEDIBLUE",)),
    ("Assurant Health", "accepted", (r"ASSURANT\\s+HEALTH",)),
    ("Beech Street", "accepted", (r"BEECH\\s+STREET",)),
    ("Blue Cross/Blue Shield", "accepted", (r"BLUE\s+CROSS/BLUE\s+SHIELD",)),
    ("Blue HPN", "accepted", (r"BLUE\\s+HPN",)),
    ("Carpenters Health", "accepted", (r"CARPENTERS\\s+HEALTH",)),
    ("Cash Pay", "self_pay", (r"CASH\\s+PAY",)),
    ("Champ VA", "accepted", (r"CHAMP\\s*VA",)),
    ("Cigna", "accepted", (r"\bCIGNA\b",)),
    ("Clark County Firefighters", "accepted", (r"CLARK\\s+COUNTY\\s+FIREFIGHTERS", r"LAS\\s+VEGAS\\s+FIRE\\s+FIGHTERS")),
    ("Clark County Self-Funded", "accepted", (r"CLARK\\s+COUNTY\\s+SELF\\s+FUNDED",)),
    ("Culinary", "not_accepted", (r"\bCULINARY\b",)),
    ("DCMWC", "accepted", ("DCMWC",)),
    ("DEEOIC", "accepted", ("DEEOIC",)),
    ("Department of Labor", "accepted", (r"DEPARTMENT\\s+OF\\s+LABOR", "DOL")),
    ("Dignity Health Ambulatory", "accepted", (r"DIGNITY\\s+HEALTH\\s+AMBULATORY", r"DIGNITY\\s+HEALTH\\s+AMB\\.?\s*(CENTER|CLINIC)?")),
    ("EBMS", "accepted", (r"\\bEBMS\\b",)),
    ("Electrical Workers", "accepted", (r"ELECTRICAL\\s+WORKERS",)),
    ("GEHA", "accepted", (r"\\bGEHA\\b",)),
    ("GHI", "accepted", (r"\\bGHI\\b", r"EMBLEM\\s+HEALTH")),
    ("Great West Health Care", "accepted", (r"GREAT\\s+WEST\\s+HEALTH\\s+CARE",)),
    ("HPN (HMO)", "accepted", (r"HPN\s*\(HMO\)", r"HEALTH\s*PLAN\s*OF\s*NEVADA\s*HMO")),
    ("HPN (POS)", "accepted", (r"HPN\s*\(POS\)",)),
    ("HPN (PPO)", "accepted", (r"HPN\s*\(PPO\)",)),
    ("HPN Medicaid", "accepted", (r"HPN\s+MEDICAID",)),
    ("Healthscope", "accepted", ("HEALTHSCOPE",)),
    ("Hometown Health", "accepted", (r"HOMETOWN\\s+HEALTH",)),
    ("Humana", "accepted", (r"\bHUMANA\b",)),
    ("Humana HMO", "accepted", (r"HUMANA\\s+HMO",)),
    ("Humana PPO", "accepted", (r"HUMANA\\s+PPO",)),
    ("Intermountain Health Plans", "not_accepted", (r"INTERMOUNTAIN\s+HEALTH",)),
    ("John Alden", "accepted", (r"JOHN\\s+ALDEN",)),
    ("Loomis", "accepted", ("LOOMIS",)),
    ("Lucent Health", "accepted", (r"LUCENT\\s+HEALTH",)),
    ("MGM Direct", "accepted", (r"MGM\\s+DIRECT",)),
    ("Mail Handlers", "accepted", ("MAILHANDLER'S", r"MAIL\\s*HANDLERS")),
    ("Medi-Share", "accepted", ("MEDI-?SHARE",)),
    ("Medicaid", "accepted", (r"\bMEDICAID\b",)),
    ("Medicare", "accepted", (r"\bMEDICARE\b", r"MEDICARE\s+B", r"MEDICARE\s+PART\s+B", r"MAC\s+J1", r"MAC\s+J\d+", r"PRIMARY\s+PAYER")),
    ("Meritain Health", "accepted", (r"MERITAIN\\s+HEALTH",)),
    ("Molina", "accepted", (r"\bMOLINA\b",)),
    ("Molina Medicaid", "accepted", (r"MOLINA\s+MEDICAID",)),
    ("Multiplan", "accepted", ("MULTIPLAN", r"\\bPHCS\\b")),
    ("Mutual of Omaha", "accepted", (r"MUTUAL\\s+OF\\s+OMAHA",)),
    ("NALC", "accepted", (r"\\bNALC\\b",)),
    ("No Insurance", "self_pay", (r"NO\\s+INSURANCE",)),
    ("One Health", "accepted", (r"ONE\\s+HEALTH",)),
    ("Operating Engineers", "accepted", (r"OPERATING\\s+ENGINEERS",)),
    ("OptumCare", "accepted", ("OPTUMCARE",)),
    ("P3 Health Partners", "not_accepted", (r"P3\s+HEALTH", r"P3\s+HEALTH\s+PARTNERS")),
    ("PEBP", "accepted", ("PEBP", r"PUBLIC\\s+EMPLOYEES\\s+BENEFITS\\s+PROGRAM")),
    ("Principal Life", "accepted", (r"PRINCIPAL\\s+LIFE",)),
    ("Prominence", "not_accepted", (r"\bPROMINENCE\b",)),
    ("Scan Health Plan", "not_accepted", (r"SCAN\s+HEALTH", r"\bSCAN\b")),
    ("Select Health", "not_accepted", (r"SELECT\s*HEALTH",)),
    ("Sheet Metal Workers", "accepted", (r"SHEET\\s+METAL\\s+WORKERS",)),
    ("SGIC", "accepted", (r"\\bSGIC\\b", r"SGIC\\s+(HEALTH|PLAN)")),
    ("Sierra Health & Life", "accepted", (r"SIERRA\s+HEALTH\s*&\s*LIFE",)),
    ("Sierra Healthcare Options", "accepted", (r"SIERRA\s+HEALTHCARE\s+OPTIONS",)),
    ("Silver Summit Health Plan", "unknown", (r"SILVER\s+SUMMIT",)),
    ("Southwest Carpenters", "accepted", (r"SOUTHWEST\\s+CARPENTERS",)),
    ("Teachers Health Trust", "accepted", (r"TEACHERS\\s+HEALTH\\s+TRUST",)),
    ("Teamsters", "accepted", ("TEAMSTERS",)),
    ("The Health Plan", "accepted", (r"THE\\s+HEALTH\\s+PLAN",)),
    ("TriWest", "accepted", ("TRIWEST",)),
    ("Tricare", "accepted", (r"\bTRI\s*CARE\b", r"\bTRICARE\b")),
    ("Trustmark", "accepted", ("TRUSTMARK",)),
    ("UFCW Local 711", "accepted", (r"UFCW\\s+LOCAL\\s+711",)),
    ("UMR", "accepted", (r"\bUMR\b",)),
    ("US Health Group", "accepted", (r"US\\s+HEALTH\\s+GROUP",)),
    ("UniCare", "accepted", (r"\\bUNICARE\\b",)),
    ("Uninsured", "self_pay", ("UNINSURED",)),
    ("United AARP Medicare", "accepted", (r"UNITED\\s+AARP\\s+MEDICARE",)),
    ("United Healthcare", "accepted", (r"UNITED\s*HEALTH\s*CARE", "UNITEDHEALTHCARE", r"\bUHC\b", r"PRIMARY\s+PAYER\s*-\s*MEDICAL")),
    ("United Healthcare Medicare", "accepted", (r"UNITED\\s+HEALTHCARE\\s+MEDICARE",)),
    ("United Healthcare Medicare Advantage", "accepted", (r"UNITED\\s+HEALTHCARE\\s+MEDICARE\\s+ADVANTAGE",)),
    ("United Medicare Focus", "accepted", (r"UNITED\s+MEDICARE\s+FOCUS",)),
    ("VA Choice", "accepted", (r"VA\\s+CHOICE",)),
    ("Venetian", "accepted", ("VENETIAN",)),
    ("WellCare", "not_accepted", (r"WELL\s*CARE", "WELLCARE")),
]
#: Names that are accepted.
ACCEPTED = [
    "AARP",
    "APWU",
    "Aetna",
    "Aetna Medicare",
    "Allegiance Benefits",
    "Allied Benefits",
    "AmBetter",
    "Anthem BCBS",
    "Anthem BCBS Medicaid",
    "Anthem BCBS Medicare",
    "Anthem MediBlue",
    "Assurant Health",
    "Beech Street",
    "Blue Cross/Blue Shield",
    "Blue HPN",
    "Carpenters Health",
    "Champ VA",
    "Cigna",
    "Clark County Firefighters",
    "Clark County Self-Funded",
    "DCMWC",
    "DEEOIC",
    "Department of Labor",
    "Dignity Health Ambulatory",
    "EBMS",
    "Electrical Workers",
    "GEHA",
    "GHI",
    "Great West Health Care",
    "HPN (HMO)",
    "HPN (POS)",
    "HPN (PPO)",
    "HPN Medicaid",
    "Healthscope",
    "Hometown Health",
    "Humana",
    "Humana HMO",
    "Humana PPO",
    "John Alden",
    "Loomis",
    "Lucent Health",
    "MGM Direct",
    "Mail Handlers",
    "Medi-Share",
    "Medicaid",
    "Medicare",
    "Meritain Health",
    "Molina",
    "Molina Medicaid",
    "Multiplan",
    "Mutual of Omaha",
    "NALC",
    "One Health",
    "Operating Engineers",
    "OptumCare",
    "PEBP",
    "Principal Life",
    "Sheet Metal Workers",
    "SGIC",
    "Sierra Health & Life",
    "Sierra Healthcare Options",
    "Southwest Carpenters",
    "Teachers Health Trust",
    "Teamsters",
    "The Health Plan",
    "TriWest",
    "Tricare",
    "Trustmark",
    "UFCW Local 711",
    "UMR",
    "US Health Group",
    "UniCare",
    "United AARP Medicare",
    "United Healthcare",
    "United Healthcare Medicare",
    "United Healthcare Medicare Advantage",
    "United Medicare Focus",
    "VA Choice",
    "Venetian",
]
#: Names that are not.
NOT_ACCEPTED = [
    "Alignment Health",
    "Culinary",
    "Intermountain Health Plans",
    "P3 Health Partners",
    "Prominence",
    "Scan Health Plan",
    "Select Health",
    "WellCare",
]
#: Names of self-payers.
SELF_PAY = [
    "Cash Pay",
    "No Insurance",
    "Uninsured",
]
#: Words that flag a text.
AUTO_FLAG = [
    "alignment",
    "alignment health",
    "apollo care",
    "culinary",
    "intermountain",
    "intermountain health plans",
    "p3",
    "p3 health",
    "p3 health partners",
    "prominence",
    "scan health",
    "scan health plan",
    "select health",
    "selecthealth",
    "well care",
    "wellcare",
]
#: carrier, last day of its contract.
CONTRACT_END = [
    ("Prominence", "2025-10-31"),
]
#: carrier, note.
PLAN_NOTES = [
    ("Anthem BCBS", "Authorization may be required for titration (95811)"),
    ("Anthem BCBS", "Check plan product for HSAT (G0399) precert"),
    ("Aetna", "Precert varies by product for split-night (95810→95811)"),
    ("Aetna", "Some plans require in-lab criteria before HSAT"),
    ("United Healthcare", "May require prior diagnostic evidence before titration"),
    ("United Healthcare", "Check network status of sleep facility"),
    ("Cigna", "HSAT (G0399) allowed for uncomplicated suspected OSA"),
    ("Cigna", "Titration (95811) often needs prior positive diagnostic"),
    ("Humana", "Confirm authorization for pediatric codes (95782/95783)"),
    ("Prominence", "Monitor contract end date; warn within 30 days"),
]
#: carrier, code, action, note.
PREAUTH = [
    ("Aetna", "95811", "preauth_check_needed", "Aetna: verify prior authorization criteria for titration (95811)."),
    ("United Healthcare", "95811", "preauth_check_needed", "United Healthcare: confirm documentation supporting in-lab titration 95811."),
    ("Anthem BCBS", "95810", "preauth_check_needed", "Anthem BCBS: check if diagnostic PSG (95810) requires prior auth when HSAT criteria not met."),
    ("Cigna", "95811", "preauth_check_needed", "Cigna: ensure prior positive diagnostic study documented before titration (95811)."),
    ("Humana", "95782", "preauth_check_needed", "Humana: pediatric PSG (95782) often requires prior authorization."),
    ("Humana", "95783", "preauth_check_needed", "Humana: pediatric titration (95783) verify medical necessity and prior diagnostic."),
    ("Tricare", "95811", "preauth_check_needed", "Tricare: confirm referral authorization and prior study before titration (95811)."),
    ("United Healthcare", "95810", "preauth_check_needed", "United Healthcare: diagnostic PSG (95810) may need prior auth if HSAT not appropriate."),
]
# End of fixed values.

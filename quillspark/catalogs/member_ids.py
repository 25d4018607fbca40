"""Member-id rules of carriers."""

# Fixed values.
#: carrier, synonyms, labels, preferred section, least length, most, needs letters and digits, not all digits, excluded patterns.
RULES = [
    ("AARP", ("aarp",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Aetna", ("aetna", "aetha", "aethna"), ("insurance id", "member id", "subscriber id", "aetna id"), "insurance_section", 9, 11, False, False, ()),
    ("Aetna Medicare", ("aetna medicare",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Alignment Health", ("alignment health",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Allegiance Benefits", ("allegiance benefits",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Allied Benefits", ("allied benefits",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("AmBetter", ("ambetter",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Anthem BCBS", ("anthem bcbs",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Anthem BCBS Medicaid", ("anthem bcbs medicaid",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Anthem BCBS Medicare", ("anthem bcbs medicare",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Anthem MediBlue", ("anthem mediblue",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("APWU", ("apwu",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Assurant Health", ("assurant health",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Blue Cross Blue Shield", ("bcbs", "blue cross", "blue shield", "anthem", "anthem blue cross", "anthem bcbs", "wellpoint"), ("insurance id", "member id", "subscriber id", "policy number", "id number"), "insurance_section", 8, 13, True, False, ()),
    ("Beech Street", ("beech street",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Blue Cross/Blue Shield", ("blue cross/blue shield",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Blue HPN", ("blue hpn",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Carpenters Health", ("carpenters health",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Cash Pay", ("cash pay",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Champ VA", ("champ va",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Cigna", ("cigna",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Clark County Firefighters", ("clark county firefighters",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Clark County Self-Funded", ("clark county self-funded",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Culinary", ("culinary",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("DCMWC", ("dcmwc",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("DEEOIC", ("deeoic",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Department of Labor", ("department of labor",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Dignity Health Ambulatory", ("dignity health ambulatory",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("EBMS", ("ebms",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Electrical Workers", ("electrical workers",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("GEHA", ("geha",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("GHI", ("ghi",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Great West Health Care", ("great west health care",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Healthscope", ("healthscope",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Hometown Health", ("hometown health",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("HPN (HMO)", ("hpn (hmo)",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("HPN (POS)", ("hpn (pos)",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("HPN (PPO)", ("hpn (ppo)",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("HPN Medicaid", ("hpn medicaid",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Humana", ("humana",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Humana HMO", ("humana hmo",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Humana PPO", ("humana ppo",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Intermountain Health Plans", ("intermountain health plans",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("John Alden", ("john alden",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Loomis", ("loomis",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Lucent Health", ("lucent health",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Mail Handlers", ("mail handlers",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Medi-Share", ("medi-share",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Medicaid", ("medicaid",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Medicare", ("medicare", "cms", "centers for medicare", "medicare part b", "medicare b", "mac j1", "mac j", "primary payer"), ("insurance id", "member id", "medicare #", "medicare number", "beneficiary id", "hicn", "mbi"), "insurance_section", 6, 15, False, False, (r"^\d{10}$", r"^\d{2}/\d{2}/\d{4}$", "^17027102839$")),
    ("Meritain Health", ("meritain health",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("MGM Direct", ("mgm direct",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Molina", ("molina",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Molina Medicaid", ("molina medicaid",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Multiplan", ("multiplan",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Mutual of Omaha", ("mutual of omaha",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("NALC", ("nalc",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("No Insurance", ("no insurance",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("One Health", ("one health",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Operating Engineers", ("operating engineers",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("OptumCare", ("optumcare",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("P3 Health Partners", ("p3 health partners",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("PEBP", ("pebp",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Principal Life", ("principal life",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Prominence", ("prominence",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Scan Health Plan", ("scan health plan",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Select Health", ("select health",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("SGIC", ("sgic",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Sheet Metal Workers", ("sheet metal workers",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Sierra Health & Life", ("sierra health & life",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Sierra Healthcare Options", ("sierra healthcare options",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Silver Summit Health Plan", ("silver summit health plan",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Southwest Carpenters", ("southwest carpenters",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Teachers Health Trust", ("teachers health trust",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Teamsters", ("teamsters",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("The Health Plan", ("the health plan",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Tricare", ("tricare",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("TriWest", ("triwest",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Trustmark", ("trustmark",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("UFCW Local 711", ("ufcw local 711",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("UMR", ("umr",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("UniCare", ("unicare",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Uninsured", ("uninsured",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("UnitedHealthcare", ("united", "uhc", "united healthcare", "unitedhealthcare", "united health", "optum"), ("insurance id", "member id", "subscriber id", "id number"), "insurance_section", 9, 11, False, False, ()),
    ("United AARP Medicare", ("united aarp medicare",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("United Healthcare", ("united healthcare",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("United Healthcare Medicare", ("united healthcare medicare",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("United Healthcare Medicare Advantage", ("united healthcare medicare advantage",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("United Medicare Focus", ("united medicare focus",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("US Health Group", ("us health group",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("VA Choice", ("va choice",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("Venetian", ("venetian",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
    ("WellCare", ("wellcare",), ("insurance id", "member id", "subscriber id", "policy number"), "insurance_section", 6, 15, False, False, ()),
]
#: carrier, order, pattern, score, deprecated.
PATTERNS = [
    ("AARP", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Aetna", 0, r"^[A-Z]{1}\d{8}$", 22, False),
    ("Aetna", 1, r"^W\d{9}$", 25, False),
    ("Aetna", 2, "^[A-Z0-9]{9,11}$", 12, False),
    ("Aetna Medicare", 0, r"^W\d{9}$", 25, False),
    ("Aetna Medicare", 1, r"^[A-Z]{1}\d{8}$", 22, False),
    ("Aetna Medicare", 2, "^[A-Z0-9]{9,11}$", 12, False),
    ("Alignment Health", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Allegiance Benefits", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Allied Benefits", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("AmBetter", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Anthem BCBS", 0, r"^[A-Z]{3}\d{9}$", 22, False),
    ("Anthem BCBS", 1, r"^[A-Z]{2}\d{10}$", 18, False),
    ("Anthem BCBS", 2, "^[A-Z0-9]{11}$", 15, False),
    ("Anthem BCBS", 3, r"^[A-Z]{1}\d{8}$", 12, False),
    ("Anthem BCBS Medicaid", 0, r"^\d{8,12}$", 18, False),
    ("Anthem BCBS Medicaid", 1, r"^[A-Z]{2}\d{6,10}$", 15, False),
    ("Anthem BCBS Medicare", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Anthem MediBlue", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("APWU", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Assurant Health", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Blue Cross Blue Shield", 0, r"^[A-Z]{3}\d{9}$", 22, False),
    ("Blue Cross Blue Shield", 1, r"^[A-Z]{2}\d{10}$", 18, False),
    ("Blue Cross Blue Shield", 2, "^[A-Z0-9]{11}$", 15, False),
    ("Blue Cross Blue Shield", 3, r"^[A-Z]{1}\d{8}$", 12, False),
    ("Beech Street", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Blue Cross/Blue Shield", 0, r"^[A-Z]{3}\d{9}$", 22, False),
    ("Blue Cross/Blue Shield", 1, r"^[A-Z]{2}\d{10}$", 18, False),
    ("Blue Cross/Blue Shield", 2, "^[A-Z0-9]{11}$", 15, False),
    ("Blue Cross/Blue Shield", 3, r"^[A-Z]{1}\d{8}$", 12, False),
    ("Blue HPN", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Carpenters Health", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Cash Pay", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Champ VA", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Cigna", 0, "^[A-Z0-9]{8,11}$", 18, False),
    ("Clark County Firefighters", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Clark County Self-Funded", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Culinary", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("DCMWC", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("DEEOIC", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Department of Labor", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Dignity Health Ambulatory", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("EBMS", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Electrical Workers", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("GEHA", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("GHI", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Great West Health Care", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Healthscope", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Hometown Health", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("HPN (HMO)", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("HPN (POS)", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("HPN (PPO)", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("HPN Medicaid", 0, r"^\d{8,12}$", 18, False),
    ("HPN Medicaid", 1, r"^[A-Z]{2}\d{6,10}$", 15, False),
    ("Humana", 0, r"^H\d{8,9}$", 22, False),
    ("Humana", 1, r"^\d{9,11}$", 15, False),
    ("Humana HMO", 0, r"^H\d{8,9}$", 22, False),
    ("Humana HMO", 1, r"^\d{9,11}$", 15, False),
    ("Humana PPO", 0, r"^H\d{8,9}$", 22, False),
    ("Humana PPO", 1, r"^\d{9,11}$", 15, False),
    ("Intermountain Health Plans", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("John Alden", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Loomis", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Lucent Health", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Mail Handlers", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Medi-Share", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Medicaid", 0, r"^\d{8,12}$", 18, False),
    ("Medicaid", 1, r"^[A-Z]{2}\d{6,10}$", 15, False),
    ("Medicare", 0, r"^[A-Z]{1}\d{1}[A-Z]{1}\d{1}[A-Z]{1}\d{4}$", 25, False),
    ("Medicare", 1, r"^[A-Z]{2,3}\d{2,4}[A-Z0-9]{2,4}$", 20, False),
    ("Medicare", 2, r"^\d{9}[A-Z]?$", 8, True),
    ("Medicare", 3, "^[A-Z0-9]{9,12}$", 5, False),
    ("Meritain Health", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("MGM Direct", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Molina", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Molina Medicaid", 0, r"^\d{8,12}$", 18, False),
    ("Molina Medicaid", 1, r"^[A-Z]{2}\d{6,10}$", 15, False),
    ("Multiplan", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Mutual of Omaha", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("NALC", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("No Insurance", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("One Health", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Operating Engineers", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("OptumCare", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("P3 Health Partners", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("PEBP", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Principal Life", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Prominence", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Scan Health Plan", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Select Health", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("SGIC", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Sheet Metal Workers", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Sierra Health & Life", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Sierra Healthcare Options", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Silver Summit Health Plan", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Southwest Carpenters", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Teachers Health Trust", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Teamsters", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("The Health Plan", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Tricare", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("TriWest", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Trustmark", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("UFCW Local 711", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("UMR", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("UniCare", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Uninsured", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("UnitedHealthcare", 0, r"^\d{9}$", 20, False),
    ("UnitedHealthcare", 1, r"^[A-Z]{1}\d{8}$", 18, False),
    ("UnitedHealthcare", 2, "^[A-Z0-9]{9,11}$", 12, False),
    ("United AARP Medicare", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("United Healthcare", 0, r"^\d{9}$", 20, False),
    ("United Healthcare", 1, r"^[A-Z]{1}\d{8}$", 18, False),
    ("United Healthcare", 2, "^[A-Z0-9]{9,11}$", 12, False),
    ("United Healthcare Medicare", 0, r"^\d{9}$", 20, False),
    ("United Healthcare Medicare", 1, r"^[A-Z]{1}\d{8}$", 18, False),
    ("United Healthcare Medicare", 2, "^[A-Z0-9]{9,11}$", 12, False),
    ("United Healthcare Medicare Advantage", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("United Medicare Focus", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("US Health Group", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("VA Choice", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("Venetian", 0, "^[A-Z0-9]{8,12}$", 10, False),
    ("WellCare", 0, "^[A-Z0-9]{8,12}$", 10, False),
]
#: Patterns of whole lines that propose ids, by words of a carrier's name, in order.
ID_PATTERNS = {
    "aetna": (r"^[A-Z]\d{8,10}$", r"^[A-Z]{2}\d{7,9}$"), "anthem": (r"^[A-Z]{3}\d{9}$", r"^[A-Z]{2,3}\d{6,10}$"), "blue cross": (r"^[A-Z]{2,3}\d{6,10}$",), "cigna": (r"^[A-Z]\d{8,10}$", "^[A-Z0-9]{9,12}$"),
    "humana": ("^[A-Z0-9]{9,12}$",), "united": (r"^[A-Z]\d{8,10}$", "^[A-Z0-9]{9,12}$"),
    "medicare": (r"^[A-Z]{2}\d[A-Z]{2}\d[A-Z]\d{2,3}$", r"^\d{3}-\d{2}-\d{4}[A-Z]?$", r"^\d{9}[A-Z]?$", "^[A-Z0-9]{9,12}$"), "medicaid": ("^[A-Z0-9]{9,12}$",),
}
# End of fixed values.

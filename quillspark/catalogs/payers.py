"""Payers: routes by name and by member-id pattern, and allowable rates."""

# Fixed values.
#: name, payer.
ROUTES = [
    ("aetna", "aetna"),
    ("aetna medicare", "aetna"),
    ("meritain health", "meritain"),
    ("meritain", "meritain"),
    ("anthem bcbs", "bcbs_carelon"),
    ("anthem bcbs medicaid", "anthem_medicaid"),
    ("anthem bcbs medicare", "bcbs_carelon"),
    ("anthem mediblue", "bcbs_carelon"),
    ("anthem", "bcbs_carelon"),
    ("bcbs", "bcbs_carelon"),
    ("bcbs federal", "bcbs_non_carelon"),
    ("blue cross/blue shield", "bcbs_carelon"),
    ("carpenters health", "bcbs_carelon"),
    ("electrical workers", "bcbs_carelon"),
    ("operating engineers", "bcbs_carelon"),
    ("southwest carpenters", "bcbs_carelon"),
    ("teamsters", "bcbs_carelon"),
    ("ufcw local 711", "bcbs_carelon"),
    ("sheet metal workers", "bcbs_carelon"),
    ("lucent health", "bcbs_non_carelon"),
    ("cigna", "cigna"),
    ("great west health care", "cigna"),
    ("united healthcare", "uhc_commercial"),
    ("uhc", "uhc_commercial"),
    ("uhg", "uhc_commercial"),
    ("unicare", "uhc_commercial"),
    ("united aarp medicare", "uhc_medicare_direct"),
    ("united medicare focus", "uhc_medicare_direct"),
    ("aarp", "uhc_medicare_direct"),
    ("aarp medicare", "uhc_medicare_direct"),
    ("optumcare", "uhc_medicare_optum"),
    ("surest", "uhc_surest"),
    ("humana", "humana"),
    ("tricare", "tricare"),
    ("triwest", "tricare"),
    ("medicare", "medicare_ffs"),
    ("medicare advantage", "medicare_ffs"),
    ("medicaid", "nevada_medicaid_ffs"),
    ("medicaid (sami)", "nevada_medicaid_ffs"),
    ("silver summit health plan", "silversummit"),
    ("ambetter", "silversummit"),
    ("molina medicaid", "molina"),
    ("sierra health & life", "sierra_hpn"),
    ("sierra healthcare options", "sierra_hpn"),
    ("hpn (hmo)", "sierra_hpn"),
    ("hpn (pos)", "sierra_hpn"),
    ("hpn (ppo)", "sierra_hpn"),
    ("hpn medicaid", "sierra_hpn"),
    ("blue hpn", "sierra_hpn"),
    ("umr", "umr"),
    ("clark county self-funded", "sierra_hpn"),
    ("mgm direct", "sierra_hpn"),
    ("loomis", "sierra_hpn"),
    ("pebp", "sierra_hpn"),
    ("venetian", "sierra_hpn"),
    ("hometown health", "sierra_hpn"),
    ("teachers health trust", "champva"),
    ("va choice", "va"),
    ("champ va", "champva"),
    ("department of labor", "workers_comp"),
    ("dcmwc", "workers_comp"),
    ("deeoic", "workers_comp"),
    ("geha", "geha"),
    ("apwu", "geha"),
    ("nalc", "geha"),
    ("mailhandler's", "geha"),
    ("ebms", "ebms"),
    ("allegiance benefits", "ebms"),
    ("principal life", "ebms"),
    ("trustmark", "ebms"),
    ("multiplan/phcs", "multiplan_phcs"),
    ("phcs", "multiplan_phcs"),
    ("beech street", "multiplan_phcs"),
    ("first health", "first_health"),
    ("allied benefits", "multiplan_phcs"),
    ("assurant health", "multiplan_phcs"),
    ("john alden", "multiplan_phcs"),
    ("healthscope", "multiplan_phcs"),
    ("ghi (emblem health)", "multiplan_phcs"),
    ("mutual of omaha", "multiplan_phcs"),
    ("one health", "multiplan_phcs"),
    ("the health plan", "multiplan_phcs"),
    ("us health group", "first_health"),
    ("medi-share", "multiplan_phcs"),
    ("las vegas fire fighters", "lv_firefighters"),
    ("clark county firefighters", "lv_firefighters"),
    ("caresource", "caresource"),
    ("prominence", "sierra_hpn"),
]
#: name, pattern, payer, confidence.
ID_ROUTES = [
    ("bcbs_alpha_prefix", "^[A-Z]{3}", "bcbs_carelon", "high"),
    ("bcbs_federal_r_prefix", r"^R\d{8,}$", "bcbs_non_carelon", "high"),
    ("medicare_mbi", r"^\d[A-Z][A-Z0-9]\d[A-Z][A-Z0-9]\d[A-Z][A-Z0-9]\d\d$", "medicare_ffs", "high"),
    ("medicaid_nv", r"^\d{10,12}$", "nevada_medicaid_ffs", "medium"),
    ("tricare_dod", r"^\d{10}$", "tricare", "medium"),
    ("uhc_format", r"^\d{9}$", "uhc_commercial", "low"),
]
#: payer, aliases, (code, rate) in order.
RATES = [
    ("Medicare FFS", ("Medicare", "Traditional Medicare", "Medicare Part B"), (("95806", 102.95), ("95810", 673.5), ("95811", 707.49))),
    ("Medi-Share", (), (("95810", 568.11), ("95811", 597.11))),
    ("Aetna", ("Aetna Commercial",), (("G0399", 117.32), ("95782", 1047.27), ("95810", 624.74), ("95811", 652.21))),
    ("Aetna Medicare", ("Aetna Medicare Advantage", "Aetna MA"), (("G0399", 180.0), ("95810", 591.28), ("95811", 617.69))),
    ("Ambetter", ("Silversummit Commercial", "Silver Summit Commercial", "AM Better"), (("G0399", 102.68), ("95782", 963.49), ("95810", 622.4), ("95811", 652.21))),
    ("Anthem Medicaid", (), (("G0399", 157.72), ("95782", 916.52), ("95810", 553.25), ("95811", 580.41))),
    ("BCBS", ("BCBS Commercial", "Anthem BCBS"), (("G0399", 203.17), ("95782", 1039.63), ("95810", 835.31), ("95811", 877.95))),
    ("BCBS Medicare Advantage", ("BCBS MA", "Anthem Medicare"), (("95810", 719.86), ("95811", 799.54))),
    ("Multiplan", ("Beechstreet", "PHCS", "UFCW 711", "Beechstreet / Multiplan / PHCS"), (("95806", 140.55), ("95810", 655.55), ("95811", 671.03))),
    ("Cigna", ("Health Partners", "Cigna / Health Partners"), (("95806", 155.0), ("95782", 1100.0), ("95810", 650.0), ("95811", 685.0))),
    ("UMR_CCSF", ("CCSF", "Clark County School Flex"), (("95806", 334.04), ("95782", 881.91), ("95810", 401.4), ("95811", 495.0))),
    ("Coventry", (), (("95810", 729.58), ("95811", 799.54))),
    ("EBMS", (), (("G0399", 193.44), ("95810", 645.54), ("95811", 677.27))),
    ("Electrical Workers 357", ("ELECTRICAL WORKERS LOCAL 357", "IBEW 357"), (("G0399", 203.17), ("95810", 835.31), ("95811", 877.95))),
    ("GEHA", (), (("G0399", 193.44), ("95810", 622.4), ("95811", 650.2))),
    ("HealthSmart", (), (("95810", 631.28), ("95811", 663.22))),
    ("Hometown Health", (), (("95806", 175.56), ("95810", 615.0), ("95811", 685.0))),
    ("HPN", ("HPN PPO", "HPN POS", "HPN HMO", "SHL", "SHO", "SHL/SHO"), (("95806", 334.04), ("95782", 881.91), ("95810", 374.4), ("95811", 495.24))),
    ("Sierra Health", ("SHL", "SHO", "SHL/SHO", "Sierra Healthcare Options"), (("95806", 334.04), ("95782", 881.91), ("95810", 374.4), ("95811", 495.24))),
    ("Humana", ("Humana PPO", "Humana HMO"), (("G0399", 165.65), ("95810", 529.04), ("95811", 588.59))),
    ("Loomis", ("LOOMIS",), (("95806", 334.04), ("95810", 401.4), ("95811", 495.0))),
    ("Nevada Medicaid FFS", ("Medicaid", "NV Medicaid"), (("95782", 916.52), ("95810", 553.25), ("95811", 580.41))),
    ("MGM Direct", ("MGM",), (("95806", 334.04), ("95810", 401.4), ("95811", 495.0))),
    ("OneHealth", (), (("95806", 166.3), ("95782", 1022.52), ("95810", 615.0), ("95811", 665.0))),
    ("Optum", ("UHC Optum", "Optum Medicare"), (("G0399", 128.02), ("95810", 570.4), ("95811", 598.02))),
    ("UMR_PEBP", ("PEBP", "Public Employees Benefits Program"), (("95806", 334.04), ("95782", 881.91), ("95810", 401.4), ("95811", 495.0))),
    ("Prominence", (), (("G0399", 93.44), ("95810", 489.4), ("95811", 511.58))),
    ("Silversummit Medicaid", ("Silver Summit Medicaid",), (("G0399", 157.72), ("95810", 553.25), ("95811", 580.41))),
    ("UMR_Teachers", ("Teachers", "CCSD Teachers"), (("95806", 334.04), ("95782", 734.4), ("95810", 401.4), ("95811", 495.0))),
    ("Tricare", ("Tricare Prime", "Tricare Select"), (("95806", 140.98), ("95810", 527.05), ("95811", 553.97))),
    ("UHC", ("United Healthcare", "United Health Care"), (("G0399", 126.71), ("95782", 679.67), ("95810", 430.76), ("95811", 459.3))),
    ("UMR", ("UMR Generic",), (("95806", 334.04), ("95782", 881.91), ("95810", 401.4), ("95811", 495.0))),
    ("VA", ("VA Choice", "VA Community Care"), (("95806", 128.02), ("95810", 570.4), ("95811", 598.02))),
    ("Self Pay", ("Cash", "Cash Pay", "Private Pay", "Self-Pay"), (("95806", 250.0), ("95782", 1200.0), ("95810", 600.0), ("95811", 650.0))),
]
# End of fixed values.

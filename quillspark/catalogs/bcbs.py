"""Routing of alpha-prefixed plans."""

# Fixed values.
#: administrator, words.
TPA = [
    ("quantum_health", ("quantum health", "quantum", "CCBYQH")),
    ("benesys_union", ("benesys", "union", "electrical workers", "pipe fitters", "ironworkers", "teamsters", "carpenters")),
]
#: key, name.
AFFILIATES = [
    ("bcbs_il", "BCBS IL"),
    ("bcbs_tx", "BCBS TX"),
    ("bcbs_ca", "BCBS CA (Anthem)"),
    ("horizon_nj", "Horizon BCBS NJ"),
    ("bcbs_fep", "BCBS FEP (Federal)"),
    ("bcbs_sc", "BCBS SC"),
    ("bcbs_fl", "BCBS FL"),
    ("bcbs_mi", "BCBS MI"),
    ("premera", "Premera BCBS"),
    ("carefirst", "CareFirst BCBS"),
    ("hmsa", "BCBS HI / HMSA"),
    ("bcbs_ma", "BCBS MA"),
    ("regence", "Regence BCBS"),
    ("bcbs_kc", "BCBS KC"),
    ("bcbs_mn", "BCBS MN"),
    ("highmark", "Highmark BCBS"),
    ("bcbs_al", "BCBS AL"),
    ("bcbs_va", "BCBS VA (Anthem)"),
    ("bcbs_nv", "BCBS NV (Anthem)"),
    ("independence", "Independence BCBS"),
    ("wellmark", "Wellmark BCBS"),
    ("bcbs_ne", "BCBS NE"),
]
# End of fixed values.

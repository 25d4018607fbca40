"""Contraindications of tests."""

# Fixed values.
#: kind, rule, flag, code triggers, word triggers (matched against lower-case text as they stand).
RULES = [
    ("hard", "homebound_with_o2", "STOP_CANNOT_TEST", ("Z99.81", "Z99.1"), ()),
    ("hard", "age_under_2", "STOP_AGE", (), ()),
    ("hst", "home_oxygen", "REMOVE_HST", ("Z99.81",), ("home oxygen", "supplemental oxygen", "O2 dependent", "on oxygen", "oxygen therapy", "nasal cannula", "home O2")),
    ("soft", "copd_moderate_severe", "FLAG_PSG_RECOMMENDED", ("J44.0", "J44.1"), ("copd", "chronic obstructive", "emphysema", "chronic bronchitis")),
    ("soft", "chf", "FLAG_PSG_RECOMMENDED", ("I50.1", "I50.20", "I50.21", "I50.22", "I50.23", "I50.30", "I50.31", "I50.32", "I50.33", "I50.40", "I50.41", "I50.42", "I50.43", "I50.810", "I50.811", "I50.812", "I50.813", "I50.814", "I50.82", "I50.83", "I50.84", "I50.89", "I50.9"), ("heart failure", "chf", "congestive heart", "ejection fraction", "cardiomyopathy")),
    ("soft", "opioid_use", "FLAG_PSG_RECOMMENDED", ("F11.10", "F11.20", "F11.90"), ("opioid", "oxycodone", "hydrocodone", "morphine", "methadone", "fentanyl", "tramadol", "codeine", "vicodin", "percocet", "norco", "dilaudid", "suboxone", "buprenorphine")),
    ("soft", "morbid_obesity", "FLAG_PSG_RECOMMENDED", (), ("morbid obesity", "super morbid", "bmi 50", "bmi over 50")),
    ("soft", "neuromuscular_disease", "FLAG_PSG_RECOMMENDED", ("G71.0", "G71.11", "G71.2", "G12.21"), ("myasthenia gravis", "muscular dystrophy", "als", "amyotrophic lateral sclerosis")),
    ("soft", "suspected_central_apnea", "FLAG_PSG_RECOMMENDED", ("G47.31",), ("central apnea", "central sleep apnea", "csa", "cheyne-stokes")),
    ("soft", "multiple_moderate_comorbidities", "FLAG_COMPLEX_CASE", (), ()),
]
# End of fixed values.

"""Conditions and their diagnosis codes."""

# Fixed values.
#: condition, code; a later entry of a name replaces an earlier one.
CONDITIONS = [
    ("obstructive sleep apnea", "G47.33"),
    ("sleep apnea", "G47.30"),
    ("sleep apnea, unspecified", "G47.30"),
    ("central sleep apnea", "G47.31"),
    ("insomnia", "G47.00"),
    ("insomnia, unspecified", "G47.00"),
    ("narcolepsy", "G47.419"),
    ("restless legs syndrome", "G25.81"),
    ("restless leg syndrome", "G25.81"),
    ("circadian rhythm sleep disorder", "G47.20"),
    ("hypersomnia", "G47.10"),
    ("parasomnia", "G47.50"),
    ("sleep disorder", "G47.9"),
    ("obesity", "E66.9"),
    ("obesity, unspecified", "E66.9"),
    ("morbid obesity", "E66.01"),
    ("overweight", "E66.3"),
    ("body mass index", "Z68.1"),
    ("type 2 diabetes", "E11.9"),
    ("type 2 diabetes mellitus", "E11.9"),
    ("type 2 diabetes mellitus without complications", "E11.9"),
    ("type 1 diabetes", "E10.9"),
    ("type 1 diabetes mellitus", "E10.9"),
    ("diabetes mellitus", "E11.9"),
    ("hyperlipidemia", "E78.5"),
    ("hyperlipidemia, unspecified", "E78.5"),
    ("dyslipidemia", "E78.5"),
    ("hypothyroidism", "E03.9"),
    ("hyperthyroidism", "E05.90"),
    ("vitamin d deficiency", "E55.9"),
    ("hypertension", "I10"),
    ("essential hypertension", "I10"),
    ("hypertensive heart disease", "I11.9"),
    ("atrial fibrillation", "I48.91"),
    ("atrial fibrillation, unspecified", "I48.91"),
    ("coronary artery disease", "I25.10"),
    ("coronary arteriosclerosis", "I25.10"),
    ("atherosclerotic heart disease", "I25.10"),
    ("old myocardial infarction", "I25.2"),
    ("myocardial infarction", "I25.2"),
    ("heart failure", "I50.9"),
    ("congestive heart failure", "I50.9"),
    ("coronary artery bypass graft", "Z95.1"),
    ("snoring", "R06.83"),
    ("shortness of breath", "R06.02"),
    ("dyspnea", "R06.00"),
    ("chronic obstructive pulmonary disease", "J44.1"),
    ("copd", "J44.1"),
    ("asthma", "J45.909"),
    ("pneumoconiosis", "J62.8"),
    ("fatigue", "R53.83"),
    ("chronic fatigue", "R53.83"),
    ("malaise and fatigue", "R53.83"),
    ("excessive daytime sleepiness", "R40.0"),
    ("depression", "F33.9"),
    ("major depressive disorder", "F33.9"),
    ("anxiety", "F41.9"),
    ("anxiety disorder", "F41.9"),
    ("generalized anxiety disorder", "F41.1"),
    ("ptsd", "F43.10"),
    ("post-traumatic stress disorder", "F43.10"),
    ("nocturia", "R35.1"),
    ("witnessed apnea", "G47.33"),
    ("neck pain", "M54.2"),
    ("back pain", "M54.5"),
    ("chronic pain", "G89.29"),
    ("gastroesophageal reflux", "K21.9"),
    ("gerd", "K21.9"),
    ("gastroesophageal reflux disease", "K21.9"),
    ("polycythemia", "D75.1"),
    ("tobacco use", "F17.210"),
    ("tobacco dependence", "F17.210"),
    ("nocturia", "R35.1"),
    ("frequent urination", "R35.0"),
    ("edema", "R60.9"),
]
# End of fixed values.

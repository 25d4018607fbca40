"""Diagnosis codes that are accepted, with alerts and enrichment."""

# Fixed values.
#: code, description.
ICD = [
    ("G47.30", "Sleep Apnea, Unspecified"),
    ("G47.33", "Obstructive Sleep Apnea (Adult)"),
    ("G47.31", "Primary Central Sleep Apnea"),
    ("G47.32", "High Altitude Periodic Breathing"),
    ("G47.34", "Idiopathic Sleep Related Nonobstructive Alveolar Hypoventilation"),
    ("G47.35", "Congenital Central Alveolar Hypoventilation Syndrome"),
    ("G47.36", "Sleep Related Hypoventilation in Conditions Classified Elsewhere"),
    ("G47.37", "Central Sleep Apnea in Conditions Classified Elsewhere"),
    ("G47.39", "Other Sleep Apnea"),
    ("P28.3", "Primary Sleep Apnea of Newborn (Pediatric)"),
    ("G47.20", "Circadian Rhythm Sleep Disorder, Unspecified"),
    ("G47.21", "Circadian Rhythm Sleep Disorder, Delayed Sleep Phase Type"),
    ("G47.22", "Circadian Rhythm Sleep Disorder, Advanced Sleep Phase Type"),
    ("G47.23", "Circadian Rhythm Sleep Disorder, Irregular Sleep Wake Type"),
    ("G47.24", "Circadian Rhythm Sleep Disorder, Free Running Type"),
    ("G47.25", "Circadian Rhythm Sleep Disorder, Jet Lag Type"),
    ("G47.26", "Circadian Rhythm Sleep Disorder, Shift Work Type"),
    ("G47.27", "Circadian Rhythm Sleep Disorder in Conditions Classified Elsewhere"),
    ("G47.29", "Other Circadian Rhythm Sleep Disorder"),
    ("G47.00", "Insomnia, Unspecified"),
    ("G47.01", "Insomnia Due to Medical Condition"),
    ("G47.09", "Other Insomnia"),
    ("G47.10", "Hypersomnia, Unspecified"),
    ("G47.11", "Idiopathic Hypersomnia with Long Sleep Time"),
    ("G47.12", "Idiopathic Hypersomnia without Long Sleep Time"),
    ("G47.13", "Recurrent Hypersomnia"),
    ("G47.14", "Hypersomnia Due to Medical Condition"),
    ("G47.19", "Other Hypersomnia"),
    ("G47.50", "Parasomnia, Unspecified"),
    ("G47.51", "Confusional Arousals"),
    ("G47.52", "REM Sleep Behavior Disorder"),
    ("G47.53", "Recurrent Isolated Sleep Paralysis"),
    ("G47.54", "Parasomnia in Conditions Classified Elsewhere"),
    ("G47.59", "Other Parasomnia"),
    ("G47.62", "Sleep Related Leg Cramps"),
    ("G47.63", "Sleep Related Bruxism"),
    ("G47.69", "Other Sleep Related Movement Disorders"),
    ("G47.8", "Other Sleep Disorders"),
    ("G47.9", "Sleep Disorder, Unspecified"),
    ("G25.81", "Restless Legs Syndrome"),
    ("F51.01", "Primary Insomnia"),
    ("F51.02", "Adjustment Insomnia"),
    ("F51.03", "Paradoxical Insomnia"),
    ("F51.04", "Psychophysiologic Insomnia"),
    ("F51.05", "Insomnia Due to Other Mental Disorder"),
    ("F51.09", "Other Insomnia Not Due to a Substance or Known Physiological Condition"),
    ("F51.11", "Primary Hypersomnia"),
    ("F51.12", "Insufficient Sleep Syndrome"),
    ("F51.13", "Hypersomnia Due to Other Mental Disorder"),
    ("F51.19", "Other Hypersomnia Not Due to a Substance or Known Physiological Condition"),
    ("R06.83", "Snoring"),
    ("R40.0", "Somnolence (Excessive Sleepiness)"),
    ("R40.1", "Stupor"),
    ("R06.00", "Dyspnea, Unspecified"),
    ("R06.02", "Shortness of Breath on Exertion"),
    ("R06.03", "Acute Respiratory Distress"),
    ("R06.09", "Other Forms of Dyspnea"),
    ("R51", "Headache"),
    ("R51.0", "Headache with Orthostatic Component"),
    ("R51.9", "Headache, Unspecified"),
    ("R91.1", "Solitary Pulmonary Nodule"),
    ("J98.11", "Atelectasis"),
    ("R53.1", "Weakness"),
    ("R53.83", "Fatigue"),
    ("F06.8", "Other Specified Mental Disorders Due to Known Physiological Condition"),
    ("F41.1", "Generalized Anxiety Disorder"),
    ("F32.9", "Major Depressive Disorder, Single Episode, Unspecified"),
    ("R41.840", "Attention and Concentration Deficit"),
    ("R41.3", "Other Amnesia (Memory Problems)"),
    ("R45.4", "Irritability and Anger"),
    ("R35.0", "Frequency of Micturition (Nocturia)"),
    ("I10", "Essential Hypertension"),
    ("I25.10", "Atherosclerotic Heart Disease of Native Coronary Artery without Angina Pectoris"),
    ("I48.91", "Unspecified Atrial Fibrillation"),
    ("I48.0", "Paroxysmal Atrial Fibrillation"),
    ("I48.1", "Persistent Atrial Fibrillation"),
    ("I48.2", "Chronic Atrial Fibrillation"),
    ("I47.1", "Supraventricular Tachycardia (SVT)"),
    ("I47.2", "Ventricular Tachycardia (VTAC)"),
    ("I49.9", "Cardiac Arrhythmia, Unspecified"),
    ("I49.8", "Other Specified Cardiac Arrhythmias"),
    ("Z95.0", "Presence of Cardiac Pacemaker"),
    ("Z95.810", "Presence of Automatic (Implantable) Cardiac Defibrillator"),
    ("I50.9", "Heart Failure, Unspecified"),
    ("I27.20", "Pulmonary Hypertension, Unspecified"),
    ("Z87.891", "Personal History of Nicotine Dependence"),
    ("E11.9", "Type 2 Diabetes Mellitus without Complications"),
    ("E66.9", "Obesity, Unspecified"),
    ("E66.01", "Morbid (Severe) Obesity Due to Excess Calories"),
    ("J44.1", "Chronic Obstructive Pulmonary Disease with Acute Exacerbation"),
    ("J44.0", "Chronic Obstructive Pulmonary Disease with Acute Lower Respiratory Infection"),
    ("J45.9", "Asthma, Unspecified"),
    ("J45.909", "Unspecified Asthma, Uncomplicated"),
    ("J47.9", "Bronchiectasis, Uncomplicated"),
    ("J84.10", "Pulmonary Fibrosis, Unspecified"),
    ("J96.90", "Respiratory Failure, Unspecified, Unspecified whether with Hypoxia or Hypercapnia"),
    ("J96.00", "Acute Respiratory Failure, Unspecified whether with Hypoxia or Hypercapnia"),
    ("J96.10", "Chronic Respiratory Failure, Unspecified whether with Hypoxia or Hypercapnia"),
    ("J60", "Coalworker's Pneumoconiosis"),
    ("J61", "Pneumoconiosis Due to Asbestos and Other Mineral Fibers"),
    ("J64", "Unspecified Pneumoconiosis"),
    ("J68.4", "Chronic Respiratory Conditions Due to Chemicals, Gases, Fumes and Vapors"),
    ("Z99.81", "Dependence on Supplemental Oxygen"),
    ("G40.9", "Epilepsy, Unspecified"),
    ("G40.909", "Epilepsy, Unspecified, Not Intractable, without Status Epilepticus"),
    ("R56.9", "Unspecified Convulsions"),
    ("G93.1", "Anoxic Brain Damage, Not Elsewhere Classified"),
    ("F07.81", "Postconcussional Syndrome"),
    ("G35", "Multiple Sclerosis"),
    ("G20", "Parkinson's Disease"),
    ("F03.90", "Unspecified Dementia without Behavioral Disturbance"),
    ("G47.411", "Narcolepsy with Cataplexy"),
    ("G47.419", "Narcolepsy without Cataplexy"),
    ("G47.429", "Narcolepsy in Conditions Classified Elsewhere without Cataplexy"),
    ("I63.9", "Cerebral Infarction, Unspecified (Stroke)"),
    ("I21.9", "Acute Myocardial Infarction, Unspecified"),
    ("G82.20", "Paraplegia, Unspecified"),
    ("G82.21", "Paraplegia, Complete"),
    ("G82.22", "Paraplegia, Incomplete"),
    ("G83.9", "Paralytic Syndrome, Unspecified"),
    ("F90.9", "Attention-Deficit/Hyperactivity Disorder, Unspecified Type"),
    ("F98.0", "Enuresis Not Due to a Substance or Known Physiological Condition"),
    ("N39.44", "Nocturnal Enuresis"),
    ("R62.50", "Unspecified Lack of Expected Normal Physiological Development in Childhood"),
    ("J35.1", "Hypertrophy of Tonsils"),
    ("J35.2", "Hypertrophy of Adenoids"),
    ("J35.3", "Hypertrophy of Tonsils with Hypertrophy of Adenoids"),
    ("Q67.4", "Other Congenital Deformities of Skull, Face and Jaw"),
    ("K07.0", "Major Anomalies of Jaw Size"),
    ("Z74.01", "Bed Confinement Status (Homebound)"),
    ("Z74.09", "Other Reduced Mobility"),
    ("Z99.89", "Dependence on Other Enabling Machines and Devices"),
    ("Z93.0", "Tracheostomy Status"),
    ("Z99.11", "Dependence on Respirator [Ventilator] Status"),
    ("Z99.12", "Dependence on Wheelchair"),
    ("Z59.0", "Homelessness"),
    ("Z59.1", "Inadequate Housing"),
    ("Z59.8", "Other Problems Related to Housing and Economic Circumstances"),
    ("Z60.2", "Problems Related to Living Alone"),
    ("Z63.79", "Other Stressful Life Events Affecting Family and Household"),
    ("B20", "Human Immunodeficiency Virus [HIV] Disease"),
    ("Z21", "Asymptomatic Human Immunodeficiency Virus [HIV] Infection Status"),
    ("B18.0", "Chronic Viral Hepatitis B with Delta-Agent"),
    ("B18.1", "Chronic Viral Hepatitis B without Delta-Agent"),
    ("B18.2", "Chronic Viral Hepatitis C"),
    ("B19.9", "Unspecified Viral Hepatitis"),
    ("A15.9", "Respiratory Tuberculosis, Unspecified"),
    ("A16.9", "Respiratory Tuberculosis, Unspecified, without Mention of Bacteriological or Histological Confirmation"),
    ("B37.1", "Pulmonary Candidiasis"),
    ("J12.9", "Viral Pneumonia, Unspecified"),
    ("U07.1", "COVID-19"),
    ("Z11.59", "Encounter for Screening for Other Viral Diseases"),
    ("Z22.321", "Carrier of Methicillin Resistant Staphylococcus Aureus (MRSA)"),
    ("Z22.322", "Carrier of Methicillin Susceptible Staphylococcus Aureus (MSSA)"),
    ("B02.9", "Zoster without Complications (Shingles)"),
    ("B01.9", "Varicella without Complication (Chickenpox)"),
    ("B08.1", "Molluscum Contagiosum"),
    ("B07.9", "Viral Wart, Unspecified"),
    ("A49.9", "Bacterial Infection, Unspecified"),
    ("L08.9", "Local Infection of Skin and Subcutaneous Tissue, Unspecified"),
    ("B08.5", "Enteroviral Vesicular Pharyngitis (Hand, Foot and Mouth Disease)"),
    ("B35.9", "Dermatophytosis, Unspecified (Fungal Skin Infection)"),
    ("H90.3", "Sensorineural Hearing Loss, Bilateral"),
    ("H91.90", "Unspecified Hearing Loss, Unspecified Ear"),
    ("Z46.1", "Encounter for Fitting and Adjustment of Hearing Aid"),
    ("H54.7", "Unspecified Visual Loss"),
    ("H54.0", "Blindness, Both Eyes"),
    ("Z46.2", "Encounter for Fitting and Adjustment of Other Devices Related to Nervous System and Special Senses"),
    ("Z91.82", "Personal History of Military Deployment"),
    ("F80.9", "Developmental Disorder of Speech and Language, Unspecified"),
    ("Z56.82", "Problem Related to Current Military Deployment Status"),
    ("Z91.19", "Patient's Noncompliance with Other Medical Treatment and Regimen"),
]
#: code, action.
ALERTS = [
    ("I47.1", "alert_cardiac_svt"),
    ("I47.2", "alert_cardiac_vt"),
    ("Z95.0", "alert_pacemaker"),
    ("Z95.810", "alert_icd_defibrillator"),
    ("E66.01", "alert_mobility"),
    ("U07.1", "alert_infectious_covid"),
]
#: Chronic codes.
CHRONIC = [
    "G47.33",
    "I10",
    "E11.9",
    "J45.909",
]
#: code, severity.
SEVERITY = [
    ("G47.33", "moderate"),
    ("I10", "variable"),
    ("E11.9", "uncomplicated"),
    ("J45.909", "unspecified"),
]
#: code, note.
NOTES = [
    ("G47.33", "Obstructive sleep apnea is generally chronic and requires longitudinal management."),
    ("I10", "Essential hypertension is chronic; severity staging not encoded in code."),
    ("E11.9", "Type 2 diabetes without complications; monitor for progression."),
    ("J45.909", "Asthma unspecified; assess control level separately."),
]
# End of fixed values.

"""Synthetic referral texts (invented people), so detectors meet the vocabulary that general tables lack."""

from __future__ import annotations

TEXTS = [
    "Patient John Doe DOB 01/02/1970\nInsurance: Aetna Member ID: ABC12345 Group: GRP1\nPlease attach insurance card.",
    "Insurance: Aetna Member ID: ABC1234567 Group: GRP1\nOther Insurance: Medicare Member ID: Z99999123 Group: MGRP",
    "Insurance: Aetna Member ID: A11122233 Group: G1\nInsurance: Cigna Member ID: C22233344 Group: G2",
    "Diagnosis / ICD: G47.33 patient presents with witnessed apnea and snoring\nAHI: 4.2\n90% pressure 11.5\n82% of nights\n5-15 cm",
    "Referral for sleep study due to snoring and fatigue. CPT 95810 requested.\nBMI: 34.5 BP 132/84 Weight: 210 lbs Height: 5'11\"",
    "Patient John Doe DOB 01/02/1971\nOrder: 95811 titration polysomnography due to snoring and daytime sleepiness.\nDiagnosis ICD: G47.33 obstructive sleep apnea.\nInsurance: Aetna Member ID: ABC1001777 Group: GRP1",
    "Facesheet\nPatient Phone\nH: (702) 234-4511\nFax: (702) 555-2222\nPharmacy 702-345-6789\nPatient email: jane.roe.patient@gmail.com",
    "Insurance: Aetna ID W123456789\nMember ID: W12345678O\nGroup Number: 88991",
    "Fax cover sheet\nConfidential: if you are not the intended recipient destroy this fax\nTo: Sleep Center\nFrom: Desert Clinic\nDate: 03/04/2024\nRE: patient referral",
    "Ordering Provider: Dr. Alice Carter MD\nNPI: 1234567893\nPractice: Desert Sleep Medicine\nPhone: (702) 555-1111\nFax: (702) 555-3333",
    "Emergency contact: Maria Lopez (702) 234-9988 mother\nReferral date: 02/11/24\nOrder date 02-12-2024\nStudy scheduled: 3/1/2024\nseen 7/4/1969",
    "Name: Roe, Jane\nDate of Birth: 05/17/1988\nAddress: 12 Oak Street, Henderson, NV 89015\nHome Phone (702) 345-1212",
    "DME: APRIA supplies E0601 and A7034. mask leak, uses CPAP, pressure too high.\nOxygen dependent, wheelchair, interpreter needed.",
    "Chief complaint: snoring. Assessment / Plan: split night. History of present illness. Review of systems. Physical exam.\nNo PPE. Pediatric patient age 4.",
    "Quest Diagnostics\nReference range 4-10 mg/dl\nSpecimen ID 88\nDate collected 01/01/2024\nnormal result value",
    "Denies snoring. Patient reports gasping and insomnia. Restless legs confirmed. Father has sleep apnea.\nCPT 95806 home sleep test. G0399 mentioned. ICD: J45.909 I10",
    "2024-01-05 Intake; SSN 123-45-6789; contact a.b@clinic.org or 702.345.6789; ID A123456789",
    "Sunrise Smith, Bob_95811_20240102.pdf",
    "Past encounters\nObstructive sleep apnea 12345678 G47.33\nHypertension 7654321 I10.0\nInsomnia G47.09 then G47.00, no evidence of asthma J45.909\nProblem list: high blood  pressure, obesity, denies diabetes\nProcedure 95810 for G47.10",
    "Obstructve slep apnea wth snornig; Pateint reports 0xygen use and hypertensi0n\n{'carrier': 'Aetna', cpt: 95810,}\nlll|| ~~ xkcd ]] zz9q",
]
SCHEMA = "doc_id long, page int, text string"


def rows() -> list[tuple[int, int, str]]:
    """(doc_id, page, text); ids are negative, so they never meet a table's."""
    return [(-i, 1, t) for i, t in enumerate(TEXTS, 1)]

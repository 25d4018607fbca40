"""Procedure codes in the order of the catalog, with the phrases that name them."""

# Fixed values.
#: code, description, phrases; a phrase that holds another one of its code is left out, as it adds no match.
CPT = [
    ("95811", "In-lab PAP titration / split-night polysomnography", (r"\b95811\b", "titration", "split-night", "split night", "needs settings", "need updated settings", "need cpap settings", "need pap settings", "need bipap settings", "lost weight pressure too strong", "gained weight pressure too weak", "pressure adjustment", "optimize cpap", "pressure too high", "pressure too low", "not tolerating pressure", "not tolerating cpap", "still tired on cpap", "increase pressure", "decrease pressure", "pap intolerance", "failed cpap", "failed pap", "failed apap", "failed auto-cpap")),
    ("95783", None, (r"\b95783\b", "pediatric cpap", "pediatric titration", "child titration", "pediatric split-night", "pediatric split night", "pediatric pap titration")),
    ("95810", "In-lab diagnostic polysomnography", (r"\b95810\b", "sleep study", "sleep evaluation", "diagnostic study", "full-night study", "full night study", "nocturnal study", "polysomnography", "polysomnogram", "psg", "overnight testing", "overnight evaluation", "evaluation and treatment", "r/o osa", "split-night", "split night", "rule out osa", "osa evaluation", "eval&treat", "sleep disorder evaluation", "estudio del sueño", "polisomnografía", "evaluación del sueño", "r/o seizure", "rule out seizure", "seizure evaluation", "seizure disorder eval", "polysomngram with o2", "polysomngram w/ o2", "polysomngram with oxygen", "polysomngram w/ oxygen", "diagnostic sleep test", "evaluate", "initial consultation", "consultation for sleep apnea evaluation")),
    ("95782", None, (r"\b95782\b", "pediatric sleep study", "pediatric polysomnography", "child sleep study", "under 6 sleep study", "peds sleep study", "pediatric overnight study", "complete sleep study", "sleep disorder evaluation", "diagnostic polysomnography", "estudio del sueño pediátrico", "polisomnografía pediátrica", "evaluación del sueño pediátrico", "child polysomnography", "child overnight study", "rule out osa", "r/o osa", "osa evaluation", "eval&treat", "evaluation and treatment")),
    ("95806", "Home sleep apnea test (HSAT)", (r"\b95806\b", "95800", "95801", "G0398", "G0400", "home sleep test", "home test with titration if positive", "hst", "hsat", "home sleep apnea test", "portable monitor", "out-of-center sleep test", "out of center sleep test", "ocst", "prueba del sueño en casa", "sleep apnea test at home", "sleep study", "sleep evaluation", "diagnostic study", "full-night study", "full night study", "nocturnal study", "polysomnography", "polysomnogram", "psg", "overnight testing", "overnight evaluation", "split", "evaluation and treatment", "eval&treat", "rule out osa", "r/o osa", "osa evaluation", "sleep disorder evaluation", "estudio del sueño", "polisomnografía", "evaluación del sueño", "portable sleep test", "diagnostic sleep test", "evaluate", "osa workup", "specialist sleep apnea evaluation", "specialist sleep apnea study", "consultation for sleep apnea evaluation", "initial consultation")),
    ("G0399", None, (r"\bG0399\b", "95800", "95801", "G0398", "G0400", "home sleep test", "home test with titration if positive", "hst", "hsat", "home sleep apnea test", "portable monitor", "out-of-center sleep test", "out of center sleep test", "ocst", "prueba del sueño en casa", "sleep apnea test at home", "sleep study", "sleep evaluation", "diagnostic study", "full-night study", "full night study", "nocturnal study", "polysomnography", "polysomnogram", "psg", "overnight testing", "overnight evaluation", "split", "evaluation and treatment", "eval&treat", "rule out osa", "r/o osa", "osa evaluation", "sleep disorder evaluation", "estudio del sueño", "polisomnografía", "evaluación del sueño", "portable sleep test", "diagnostic sleep test", "evaluate", "osa workup", "specialist sleep apnea evaluation", "specialist sleep apnea study", "consultation for sleep apnea evaluation", "initial consultation")),
    ("95805", None, (r"\b95805\b", "mslt", "multiple sleep latency test", "mwt", "sleepiness test", "wakefulness test", "evaluate for narcolepsy", "narcolepsy evaluation", "narcolepsy testing", "narcolepsy workup", "rule out narcolepsy", "r/o narcolepsy")),
    ("99245", "Office consultation (80 minutes)", (r"\b99245\b", r"consultation\s*(?:code)?\s*99245", r"consult(?:ation)?\s+5", r"consult\s*5\s*\(80\s*min\)")),
]
# End of fixed values.

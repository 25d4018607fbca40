"""Symptoms: label, positive patterns, negative patterns."""

# Fixed values.
#: label, positive, negative.
SYMPTOMS = [
    ("snoring", ("snor(?:e|ing)", r"loud\s+snor(?:e|ing)", r"disruptive\s+snor(?:e|ing)", r"sawing\s+logs", r"freight\s+train", r"heroic\s+snor(?:e|ing)", r"habitual\s+snor(?:e|ing)", r"chronic\s+snor(?:e|ing)", r"partner\s+complaints?\s+of\s+snor(?:e|ing)", r"bed\s+partner\s+reports?\s+snor(?:e|ing)", r"kids?\s+complain\s+about\s+.*snor"), (r"denies[^\n.]{0,60}snor", r"no[^\n.]{0,60}snor", r"without[^\n.]{0,60}snor")),
    ("witnessed_apnea", (r"witnessed\s+(?:apnea|apneic)", r"apneic\s+episodes?", r"stops?\s+breathing", r"holds?\s+breath", r"breathing\s+pauses", r"gasping\s+for\s+air", r"partner\s+observes?\s+.*breathing", r"spouse\s+reports?\s+apneas", r"choking\s+episodes", r"startles?\s+awake\s+gasping", r"fights?\s+for\s+breath", r"catches?\s+breath"), (r"denies\s+(?:witnessed|observed)\s+(?:apnea|apneic)", r"no\s+witnessed\s+apneas?")),
    ("daytime_sleepiness", (r"excessive\s+daytime\s+sleepiness", r"\bEDS\b", "hypersomnia", r"falls?\s+asleep\s+(?:driving|in\s+meetings|in\s+conversations)", r"can't\s+stay\s+awake", r"nodding\s+off", "dozing", "microsleep", r"uncontrollable\s+sleepiness", r"could\s+sleep\s+anywhere", r"cat\s+naps?\s+constantly"), (r"denies[^\n.]{0,60}sleepiness", r"no[^\n.]{0,60}sleepiness")),
    ("fatigue", ("fatigue", r"chronic\s+fatigue", "exhaustion", r"tired\s+all\s+the\s+time", r"no\s+energy", r"lack\s+of\s+energy", r"energy\s+depletion", r"wiped\s+out", "drained", r"running\s+on\s+empty", r"never\s+rested", r"never\s+refreshed", r"unrefreshing\s+sleep", r"sleep\s+but\s+don't\s+feel\s+better"), (r"denies[^\n.]{0,60}fatigue", r"no[^\n.]{0,60}fatigue")),
    ("morning_symptoms", (r"morning\s+headaches?", r"AM\s+headaches?", r"wakes?\s+with\s+headache", r"morning\s+grogginess", r"hard\s+to\s+wake\s+up", r"sleep\s+inertia", r"dry\s+mouth", r"cotton\s+mouth", r"throat\s+dryness", r"feels?\s+like\s+hangover", r"thick\s+headed"), (r"denies[^\n.]{0,60}headache", r"no[^\n.]{0,60}headache")),
    ("headache", ("headaches?", "migraine", r"ha\b", r"am\s+ha"), (r"denies[^\n.]{0,60}headache", r"no[^\n.]{0,60}headache")),
    ("cognitive_issues", (r"difficulty\s+concentrating", r"poor\s+concentration", r"can't\s+focus", r"memory\s+problems", "forgetful", r"brain\s+fog", r"attention\s+deficit", r"easily\s+distracted", "spacey", r"mental\s+fatigue", r"cognitive\s+dysfunction", r"can't\s+think\s+straight", r"mind\s+feels\s+cloudy"), ()),
    ("mood_changes", ("irritability", "irritable", r"short\s+tempered", "cranky", r"mood\s+swings", "depression", r"depressed\s+mood", "anxiety", "restlessness", r"on\s+edge", r"personality\s+changes", r"not\s+myself", r"behavioral\s+issues"), ()),
    ("physical_risk", ("obesity", r"morbid\s+obesity", "overweight", r"bmi\s*>?=?.*30", r"large\s+neck", r"thick\s+neck", r"neck\s+circumference", r"crowded\s+airway", r"small\s+airway", r"narrow\s+throat", r"large\s+tonsils", r"tonsillar\s+hypertrophy", r"deviated\s+septum", r"nasal\s+obstruction", r"stuffy\s+nose", r"small\s+jaw", "retrognathia", r"receding\s+chin", "micrognathia", r"large\s+tongue", "macroglossia"), ()),
    ("urinary_symptoms", ("nocturia", r"frequent\s+nighttime\s+urination", r"up\s+all\s+night\s+pee", r"bathroom\s+trips?\s+at\s+night", r"can't\s+sleep\s+through\s+night", "polyuria", r"urinary\s+frequency"), (r"denies[^\n.]{0,60}nocturia", r"no[^\n.]{0,60}nocturia")),
    ("sleep_disruption", (r"restless\s+sleep", r"tossing\s+and\s+turning", r"can't\s+get\s+comfortable", r"frequent\s+awakenings", r"wake\s+up\s+multiple\s+times", r"light\s+sleeper", r"easily\s+awakened", r"any\s+noise\s+wakes", r"can't\s+fall\s+asleep", r"can't\s+stay\s+asleep", r"sleep\s+but\s+don't\s+rest", r"tired\s+when\s+i\s+wake"), (r"denies\s+insomnia", r"no\s+sleep\s+issues")),
    ("sleep_position_issue", (r"sleep\s+in\s+chair", r"sleeps\s+in\s+recliner", r"can\s+only\s+sleep\s+sitting", "orthopnea", r"multiple\s+pillows", r"need\s+pillows\s+propped", r"can't\s+lay\s+flat", r"positional\s+sleep\s+issues"), ()),
    ("pediatric_behavior", ("hyperactivity", r"can't\s+sit\s+still", "adhd", r"poor\s+school\s+performance", r"grades\s+declining", r"trouble\s+in\s+school", r"behavioral\s+problems", "aggression", r"acting\s+out", r"growth\s+delays", r"not\s+growing\s+normally", r"short\s+stature", "bedwetting", "enuresis"), ()),
    ("pediatric_physical", (r"mouth\s+breathing", r"always\s+breathes\s+through\s+mouth", r"enlarged\s+tonsils", r"big\s+tonsils", r"tonsillar\s+hypertrophy", r"snores\s+like\s+an\s+adult", r"loud\s+snoring\s+for\s+a\s+child", r"restless\s+sleep", r"tosses\s+all\s+night", r"kicks\s+covers\s+off"), ()),
    ("safety_risk", (r"falls\s+asleep\s+driving", r"nodding\s+off\s+at\s+wheel", r"motor\s+vehicle\s+accident", r"work\s+accidents", r"nearly\s+hurt\s+at\s+work", r"boss\s+complained\s+about\s+sleeping", r"can't\s+stay\s+awake\s+in\s+meetings"), ()),
    ("functional_impairment", (r"affects\s+daily\s+life", r"can't\s+function\s+normally", r"family\s+complains", r"relationship\s+strain", r"spouse\s+frustrated", r"social\s+withdrawal", r"don't\s+go\s+out\s+anymore"), ()),
    ("partner_observation", (r"wife\s+says\s+i\s+stop\s+breathing", r"husband\s+snor(?:e|ing)", r"partner\s+sleeps\s+in\s+other\s+room", r"family\s+worr(?:y|ied)\s+about\s+my\s+breathing", r"loved\s+ones\s+concerned"), ()),
]
# End of fixed values.

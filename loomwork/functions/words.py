"""Lexicons. All lists here are fixed values."""

#: English function words that a lexical index leaves out (a parameter of the index).
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can cannot could did do does doing down during each "
    "few for from further had has have having he her here hers herself him himself his how i if in into is it its itself me more most my myself no nor not of off on once only or "
    "other our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until up "
    "very was we were what when where which while who whom why will with would you your yours yourself yourselves"
).split()

CASE_THEMES = {
    "v001": ["work", "failure", "shut", "avoid", "not good enough", "procrastinat"],
    "v002": ["mistake", "careless", "critic", "embarrass", "lazy", "self-critical"],
    "v003": ["say yes", "agreeable", "rejected", "too much", "people", "conflict"],
    "v004": ["numb", "flat", "wall", "arguments", "overwhelmed", "hurt"],
    "v005": ["rest", "lazy", "demanding", "worthless", "control", "productive"],
    "v006": ["drink", "buzzing", "pressure", "loneliness", "critic", "numb"],
    "v007": ["partner", "defensive", "wall", "accused", "connection", "closeness"],
    "v008": ["crowded", "scanning", "danger", "survival", "escape", "terrified"],
    "v009": ["guilt", "responsibility", "caretaking", "abandoning", "exhausted"],
    "v010": ["snapped", "anger", "critic", "shame", "overwhelmed", "bad person"],
    "v011": ["job", "irresponsible", "stability", "freedom", "risk", "polarization"],
    "v012": ["chest", "throat", "tight", "bracing", "crying", "exposed"],
}
CORE_TERMS = ["part", "protector", "self", "curious", "curiosity", "compassion", "unblend", "manager", "firefighter", "exile", "positive intention", "nonjudgment", "non-judgment", "befriend"]
PATHOLOGIZING = ["bad person", "broken", "wrong with you", "disordered"]
SOURCE_MARKERS = ["rank", "source", "passage", "retrieved"]
GENERIC_PHRASES = ["it sounds like", "it makes sense", "working very hard", "protect you", "stay curious", "positive intention", "approach with curiosity"]
SPECIFIC_SIGNALS = ["failure", "mistake", "rejected", "numb", "drink", "scanning", "partner", "rest", "anger", "job", "tightness", "caretaking"]
BAD_CLAIMS = ["diagnosis", "cure", "guaranteed", "always works", "scientifically proven", "you should stop medication", "this means you have"]

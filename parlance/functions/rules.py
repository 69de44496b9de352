"""Word lists, patterns and limits of the text rules.

Fixed values: results depend on exactly these words, patterns and numbers.
"""

CONNECTORS = (
    "and but because so if when that which who to for with of from about in on at by as than while although unless or "
    "y pero porque si cuando que cual quien para con de desde sobre en por como aunque mientras o "
    "e mas pois se quando qual quem com em embora enquanto ou"
).split()
AUXILIARIES = (
    "is are was were be been have has had do does did can could will would should may might must "
    "es son era eran ser estar estoy está estan he ha han puede podría debe "
    "é são estou tenho tem pode deve"
).split()
OPEN_ENDS = (
    r"\b(?:want(?:ed)?|need(?:ed)?|try(?:ing|ied)?|going|used)\s+to\s*$",
    r"\b(?:because|although|unless|while|when|if)\s+[^.!?]{0,80}$",
    r"\b(?:quiero|quería|necesito|trato|voy)\s+(?:a|de)\s*$",
    r"\b(?:porque|aunque|mientras|cuando|si)\s+[^.!?]{0,80}$",
    r"\b(?:quero|queria|preciso|tento|vou)\s+(?:a|de)\s*$",
)
FINITE_VERBS = (
    "am is are was were have has had do does did can could will would should want need think feel know mean went said made works? matters? "
    "soy es somos son era fui fue tengo tiene quiero necesito pienso siento sé dijo hice funciona importa "
    "sou é são foi tenho tem quero preciso penso sinto sei disse"
).split()
CONTRACTIONS = (("gonna", "going to"), ("wanna", "want to"), ("gotta", "got to"), ("kinda", "kind of"), ("sorta", "sort of"), ("lemme", "let me"), ("gimme", "give me"), ("dunno", "do not know"))
ACOUSTIC_REPAIRS = (
    (r"\b(?:looking\s+outside)\b(?=.*(?:breath|journal|walk|run|jog|step|fresh\s+air))", "walking outside", 0.88),
    (r"\bpeace\s+of\s+cake\b", "piece of cake", 0.95),
    (r"\bbare\s+in\s+mind\b", "bear in mind", 0.95),
)
FUNCTION_WORDS = "the that a an in on at of to for is are was were".split()
LEADING_FILLERS = (r"^\s*(?:like|you know|i mean|well|so)\s*,\s*", r"^\s*(?:honestly|basically|actually|literally)\s*,\s*")
HEDGES = (
    (r"\b(?:kind\s+of|sort\s+of)\s+just\b", "just"),
    (r"\b(am|is|are|was|were)\s+(?:kind\s+of|sort\s+of)\s+(\w+ing)\b", "$1 $2"),
    (r",\s*you\s+know\s*,", ","),
    (r",\s*like\s*,", ","),
)
BRIEF_ANSWERS = {"absolutely": "Totalmente.", "definitely": "Sin duda.", "exactly": "Exacto.", "for sure": "Por supuesto.", "right": "De acuerdo.", "totally": "Totalmente.", "sure": "Claro."}
MULTILINGUAL = ("", "auto", "automático", "es", "de", "fr", "it", "pt", "ja", "zh")
ARTICLES = "el la los las un una unos unas de a".split()
#: Pauses in ms and scores of the completion rule; its least total; the longest turn in seconds.
SHORT_PAUSE, SENTENCE_PAUSE, TURN_PAUSE, COMPLETE, LONGEST_TURN = 250, 650, 900, 0.58, 18.0
WEIGHTS = {"pause": 0.32, "punct": 0.22, "syntax": 0.28, "speaker": 0.12, "duration": 0.06}
#: Limits of the recognition checks: probability of no speech, mean log-probability, confidence.
NO_SPEECH, LOGPROB, CONFIDENCE = 0.60, -1.2, 0.45
#: Words after which an English fragment goes on, verbs that need an object, words at which a Spanish line may break.
CONTINUATIONS = "and but because so or that which who whom when while if for to like then with about at in on of as how what where than though although since until unless".split()
ENGLISH_AUXILIARIES = "is are was were be been being have has had do does did can could will would shall should may might must".split()
OPEN_PHRASES = (
    r"(?:i\s+want\s+to|i\s+wanted\s+to|i\s+just\s+wanted\s+to)\s*$",
    r"(?:because\s+i\s+feel\s+like|because\s+i\s+think|because\s+it)\s*$",
    r"(?:that'?s\s+(?:at\s+least\s+)?how|that'?s\s+what|that'?s\s+why)\s*$",
    r"(?:the\s+way|the\s+reason\s+why|something\s+like|kind\s+of|sort\s+of)\s*$",
    r"(?:i\s+mean|you\s+know|in\s+terms\s+of|as\s+well\s+as)\s*$",
)
BREAKS = "y e o u pero sino que porque cuando donde aunque para como sin con en de a".split()
#: Of the continuity score: words that link clauses, verbs that need an object.
LINKS = (
    "to for with about in on at of from by into through during before after above below between "
    "and but or because so if that which who whom when while as than though although since until unless "
    "like then where how what whose"
).split()
TRANSITIVE = (
    "admire admires admiring get gets getting want wants wanted wanting need needs needed needing like likes liked liking love loves loved loving "
    "make makes made making know knows knew knowing think thinks thought thinking feel feels felt feeling see sees saw seeing find finds found finding"
).split()
#: Literal Spanish renderings and what is said instead, in the order of their use.
NATURAL_SPANISH = (
    (r"\bcomo\s+una\s+fiesta\s+de\s+l[aá]stima\s+en\s+absoluto\b", "para dar lástima en absoluto"),
    (r"\buna\s+fiesta\s+de\s+l[aá]stima\b", "dar lástima"),
    (r"\bparte\s+de\s+pena\b", "dar lástima"),
    (r"\bhaciendo\s+un\s+diario\b", "escribir en un diario"),
    (r"\bcreando\s+un\s+diario\b", "escribir en un diario"),
    (r"\bbrilla\s+a\s+trav[eé]s\b", "se nota"),
    (r"\bbrilla\s+tambi[eé]n\b", "también se nota"),
    (r"\btambi[eé]n\s+brilla\b", "también se nota"),
    (r"\bviene\s+a\s+trav[eé]s\b", "da la impresión"),
    (r"\bva\s+a\s+funcionar\b", "va a salir bien"),
)

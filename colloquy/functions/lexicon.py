"""Word lists, patterns and tables whose contents decide results."""

STOPWORDS = """
a about above after again against all also am an and another any anything are around as at back be because been
before being below between both but by can catching change coffee correction could did do does doing down during
each else few finance for from further get got had has have having he heads her here hers him his how i if in into
is it its just let like made make makes me might more most much must my need no nor not noted now of off okay on
once one only or other our out over own picking please quick reminder right same she should since so some spent
still such than thanks that the their theirs them then there these they this those through to today tomorrow too
under understood until up update us very was we were what when where which while who whom why will with would yes
yesterday you your yours
""".split()

MONTHS = (
    "january february march april may june july august september october november december".split()
)
MONTH_SHORT = "jan feb mar apr may jun jul aug sep oct nov dec".split()
MONTH_NUMBER = {
    **{name: i + 1 for i, name in enumerate(MONTHS)},
    **{name: i + 1 for i, name in enumerate(MONTH_SHORT)},
    "sept": 9,
}
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
COUNTS = "one two three four five six seven eight nine ten eleven twelve".split()
YEAR_INTRODUCERS = "in during of for throughout".split()

CONNECTORS = "of de van von der and & the".split()
EXTENSIONS = """
c cc cjs cpp css go h html java js json jsonl jsx kt lock md mjs py rb rs sh sql swift toml ts tsx txt yaml yml
""".split()

TEMPORAL_CUES = [
    "current", "currently", "latest", "last", "lately", "now", "nowadays", "recent", "recently", "still", "today",
    "yesterday", "this week", "these days", "at the moment", "as of",
]
HISTORY_CUES = [
    "previously", "previous", "used to", "formerly", "former", "originally", "prior to", "back then", "at first",
]
BEFORE_WHAT = [
    "it", "that", "this", "then", "now", "the change", "the switch", "the move", "the latest", "the last",
    "the current",
]
QUESTION_WORDS = "what who when where which how why is are does do did was were".split()
PREDICATE_FAMILY = [
    "own", "owns", "owned", "owner", "ownership", "responsible", "responsibility", "point person", "in charge",
    "maintainer", "maintains", "accountable",
]
CHANGE_CUES = "update updated now changed moved instead longer correction actually switched plan".split()
MAX_KEY_WORDS = 4

#: A word: letters, digits and the signs that occur inside things worth keeping whole.
WORD = r"[\p{L}\p{N}'\-.$%#/+’]+"
#: The same, ending in a sign that is kept: a match is a word with its trailing punctuation off.
TRIMMED_WORD = r"[\p{L}\p{N}'\-.$%#/+’]*[\p{L}\p{N}$%+’]"
KEY_POSSESSIVE = r"'*(?:’s)*(?:'s)*$"

"""Word lists and fixed tables."""

# English stop words of the search index.
SEARCH_STOPWORDS = """
a about above after again against all am an and any are aren't as at be because been before being below between both
but by can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from further had
hadn't has hasn't have haven't having he he'd he'll he's her here here's hers herself him himself his how how's i i'd
i'll i'm i've if in into is isn't it it's its itself let's me more most mustn't my myself no nor not of off on once
only or other ought our ours ourselves out over own same shan't she she'd she'll she's should shouldn't so some such
than that that's the their theirs them themselves then there there's these they they'd they'll they're they've this
those through to too under until up very was wasn't we we'd we'll we're we've were weren't what what's when when's
where where's which while who who's whom why why's with won't would wouldn't you you'd you'll you're you've your yours
yourself yourselves
""".split()

# Stop words of the summariser.
SUMMARY_STOPWORDS = {
    "en": """a about an and are as at be been but by can could did do does during for from had has have he her hers him
    his how i if in into is it its may more most my no nor not of on or our ours she should so some such than that the
    their them there these they this those through to too under was were what when where which while who will with would
    you your""".split(),
    "es": """a al algo algunas algunos ante antes como con contra cual cuales cuando de del desde donde dos el ella ellas
    ellos en entre era eran es esa esas ese esos esta están estaban este esto estos fue fueron ha han hasta hay la las
    le les lo los mas más me mi mis mucha muchos muy ni no nos o para pero por porque que quien se ser si sin sobre son
    su sus tambien también te tiene tienen todo todos tu un una unas unos y ya""".split(),
}

# Words an essay's most frequent words leave out.
ESSAY_STOPWORDS = """
a an and are as at be but by for from has he her his i in is it its of on or she that the their there they this to was
were with you
""".split()

# Phrases that mark the parts of an essay.
ESSAY_MARKERS = {
    "thesis": ["i argue", "this essay argues", "my thesis", "i believe"],
    "evidence": ["for example", "for instance", "the text shows", "the author writes"],
    "conclusion": ["in conclusion", "to conclude", "overall"],
}

# Suffixes the stemmer takes off when two letters or more remain, in this order of preference.
STEM_SUFFIXES = ["ational", "ization", "iveness", "fulness", "ousness", "ing", "edly", "ed", "ies", "es", "s", "ly", "ion", "ment"]

# What the tags mean.
TAG_MEANINGS = {
    "CC": "сочинительный союз",
    "CD": "числительное",
    "DT": "определитель",
    "EX": "оборот there is",
    "FW": "иностранное слово",
    "IN": "предлог / подчинительный союз",
    "JJ": "прилагательное",
    "JJR": "прилагательное, сравнительная степень",
    "JJS": "прилагательное, превосходная степень",
    "LS": "маркер списка",
    "MD": "модальный глагол",
    "NN": "существительное, ед. ч.",
    "NNS": "существительное, мн. ч.",
    "NNP": "имя собственное, ед. ч.",
    "NNPS": "имя собственное, мн. ч.",
    "PDT": "предопределитель",
    "POS": "притяжательное окончание",
    "PRP": "личное местоимение",
    "PRP$": "притяжательное местоимение",
    "RB": "наречие",
    "RBR": "наречие, сравнительная степень",
    "RBS": "наречие, превосходная степень",
    "RP": "частица",
    "TO": "частица to",
    "UH": "междометие",
    "VB": "глагол, начальная форма",
    "VBD": "глагол, прошедшее время",
    "VBG": "глагол, причастие наст. вр.",
    "VBN": "глагол, причастие прош. вр.",
    "VBP": "глагол, наст. вр. (не 3-е лицо)",
    "VBZ": "глагол, наст. вр. (3-е лицо)",
    "WDT": "вопросительный определитель",
    "WP": "вопросительное местоимение",
    "WP$": "притяжательное вопросительное местоимение",
    "WRB": "вопросительное наречие",
}
# The meaning of other tags and of phrases.
OTHER_TAG = "другая часть речи"
PHRASE_MEANINGS = {"S": "предложение", "CLAUSE": "основа предложения", "NP": "именная группа", "VP": "глагольная группа", "PP": "предложная группа"}
OTHER_PHRASE = "группа"

# The tags whose entries serve a word of a rarer tag.
TAG_FALLBACKS = {
    "NNS": ["NN"],
    "NNPS": ["NNP", "NN"],
    "VBZ": ["VB"],
    "VBP": ["VB"],
    "VBD": ["VB"],
    "VBN": ["VB"],
    "VBG": ["VB"],
    "JJR": ["JJ"],
    "JJS": ["JJ"],
    "RBR": ["RB"],
    "RBS": ["RB"],
}

# Spoken commands.
COMMANDS = ["analyze essay", "dictate", "read results", "show plan", "clear essay", "help"]

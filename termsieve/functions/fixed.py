"""They must equal published or expected ones for results to agree."""

# Emoticon -> code, applied in this order.
EMOTICONS = [
    ("...", "XA"), (":)", "XB"), (":-)", "XC"), ("<3", "XD"), (":(", "XE"), (":P", "XF"),
    (":p", "XG"), ("8)", "XH"), (":*", "XI"), (">:(", "XJ"), (":D", "XL"), (":O", "XM"),
    (":|", "XN"), ("O:)", "XO"), (":@", "XP"), (";)", "XR"), (";(", "XS"), (";*", "XT"),
    ("!", "XO"),
]

# Characters blanked as punctuation.
PUNCTUATION = "!()-[]{};:'\",<>./?@#$%^&*_~"

# Two-word contractions the word tokenizer splits.
CONTRACTIONS = [("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"),
                ("wan", "na")]

# The common public list of English stopwords.
STOPWORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself
yourselves he him his himself she she's her hers herself it it's its itself they them their
theirs themselves what which who whom this that that'll these those am is are was were be been
being have has had having do does did doing a an the and but if or because as until while of at
by for with about against between into through during before after above below to from up down
in out on off over under again further then once here there when where why how all any both each
few more most other some such no nor not only own same so than too very s t can will just don
don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn
doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn
needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()

# Character classes of Unicode whitespace and word characters.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD = r"\p{L}\p{N}_"
# Whitespace but the blank.
BREAKS = SPACE.replace(r"\x1c-\x20", r"\x1c-\x1f")

# Suffix tables of the Porter (1980) stemmer, longest suffix first where they overlap.
PORTER_STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
PORTER_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
                ("ful", ""), ("ness", "")]
PORTER_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
                "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

# Irregular forms and their stems.
IRREGULAR_STEMS = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}

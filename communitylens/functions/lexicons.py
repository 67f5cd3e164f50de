"""Word lists and tables.  Those marked as fixed values must equal the
reference's for right results; the others are stand-ins, and say so."""

# The stopword list of the post analyser (X09), in file order.
ANALYSER_STOPWORDS = tuple("""
a about above after again against all am an and any are aren't as at be because been before being below between
both but by can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from further
had hadn't has hasn't have haven't having he he'd he'll he's her here here's hers herself him himself his how how's
i i'd i'll i'm i've if in into is isn't it it's its itself let's me more most mustn't my myself no nor not of off on
once only or other ought our ours ourselves out over own same shan't she she'd she'll she's should shouldn't so some
such than that that's the their theirs them themselves then there there's these they they'd they'll they're they've
this those through to too under until up very was wasn't we we'd we'll we're we've were weren't what what's when
when's where where's which while who who's whom why why's with won't would wouldn't you you'd you'll you're you've
your yours yourself yourselves
""".split())

# Characters that folding maps although neither their
# decomposition nor their Unicode name gives the ASCII letters.
FOLD_SINGLE = {"Ø": "O", "ø": "o", "Đ": "D", "đ": "d", "Ð": "D", "ð": "d", "Ħ": "H", "ħ": "h", "ı": "i", "Ł": "L", "ł": "l",
               "Ŋ": "N", "ŋ": "n", "ŉ": "n", "ĸ": "q", "Ŧ": "T", "ŧ": "t", "‘": "'", "’": "'"}
FOLD_MULTI = {"ß": "ss", "ẞ": "SS", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Þ": "TH", "þ": "th"}

# Label precedence (X23): advocates are dropped when one of
# these labels is present; the short patient code is expanded.
PRECEDENCE_OVER_ADVOCATE = ("hpo", "hpi", "research")
LABEL_EXPANSION = {"P": "Patient"}

# Sentiment lexicon stand-in (U-S1).  The published feature uses a
# third-party rule-based analyser that is not available here; this small
# word -> valence table feeds the same compound formula s / sqrt(s^2 + 15).
SENTIMENT_LEXICON = {
    "good": 1.9, "great": 3.1, "new": 1.0, "hot": 0.6, "large": 0.4,
    "bad": -2.5, "poor": -2.1, "old": -0.6, "cold": -0.7, "small": -0.3,
}
SENTIMENT_ALPHA = 15.0
POLARITY_THRESHOLD = 0.05

# The English stopword list of the text features (the public
# NLTK list) followed by the extra words the feature code adds.
TEXT_STOPWORDS = tuple("""
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself
she she's her hers herself it it's its itself they them their theirs themselves what which who whom this that that'll
these those am is are was were be been being have has had having do does did doing a an the and but if or because as
until while of at by for with about against between into through during before after above below to from up down in
out on off over under again further then once here there when where why how all any both each few more most other
some such no nor not only own same so than too very s t can will just don don't should should've now d ll m o re ve y
ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn
mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
http tweet retweet rt twitter https tweets #ff ff rt
""".split())

# Manual keyword lists per class (T06), a hand-made configuration.
MANUAL_DICTIONARIES = {
    "en": ("the", "and", "of", "with"), "fr": ("le", "la", "des", "une"),
    "de": ("der", "die", "und", "nicht"), "es": ("el", "la", "los", "que"),
}
# Stand-in gazetteers (T09), written to list files and read back: person titles and professions (professions also match
# any token ending in 'ist').
GAZETTEERS = {
    "title": ("dr", "prof", "mr", "mrs", "ms"),
    "profession": ("doctor", "nurse", "scientist", "researcher", "engineer"),
}

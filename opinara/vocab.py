"""Fixed values.

Word lists, patterns, thresholds and output names that define the results. They are data, not logic:
every function that uses one of them takes it as a parameter with the value below as default.
"""

# --- fixed values: platform tags written to the `source` column -------------------------------------
PLATFORM_A = "reddit"
PLATFORM_B = "youtube"

# --- fixed values: keyword lists ---------------------------------------------------------------------
AI_KEYWORDS = [
    "artificial intelligence", "AI", "GPT", "ChatGPT", "DeepSeek", "Claude", "Gemini",
    "LLM", "Large Language Model", "machine learning", "neural network", "transformer",
    "AGI", "Artificial General Intelligence", "generative AI", "AI model", "AI system",
]
AI_WHOLE_WORDS = ["ai", "gpt", "llm", "agi"]
AI_PHRASES = [
    "artificial intelligence", "machine learning", "neural network", "deep learning",
    "chatgpt", "openai", "claude", "gemini",
]
OPINION_KEYWORDS = [
    "think", "believe", "feel", "opinion", "perspective", "view", "standpoint",
    "should", "would", "could", "might", "argument", "debate", "discussion",
    "pro", "con", "advantage", "disadvantage", "benefit", "drawback",
]
SOCIETAL_KEYWORDS = [
    "ethical", "ethics", "moral", "society", "societal", "impact", "consequence",
    "future", "humanity", "job", "employment", "economy", "privacy", "security",
    "bias", "fair", "transparent", "accountable", "responsible", "regulation",
]
SOCIETAL_KEYWORDS_WIDE = SOCIETAL_KEYWORDS + [
    "govern", "control", "risk", "danger", "opportunity", "potential",
]
FEATURE_AI_KEYWORDS = [
    "ai", "artificial intelligence", "machine learning", "deep learning",
    "neural network", "algorithm", "chatgpt", "gpt", "llm", "transformer",
]
SEARCH_GROUPS = [
    ["artificial intelligence", "AI", "GPT", "ChatGPT", "DeepSeek"],
    ["opinion", "ethical", "impact", "future"],
]

# --- fixed values: subjectivity phrase groups, 0.125 each --------------------------------------------
SUBJECTIVE_GROUPS = [
    ["i think", "i believe", "i feel", "in my opinion", "personally", "seems like"],
    ["should", "would", "could", "might", "probably", "possibly", "maybe"],
    ["amazing", "terrible", "awesome", "horrible", "love", "hate", "best", "worst"],
    ["clearly", "obviously", "definitely", "certainly", "surely"],
]

# --- fixed values: thresholds and bounds -------------------------------------------------------------
LABEL_THRESHOLD = 0.05
MIN_WORDS = 10
MAX_WORDS_POST = 1500
MAX_WORDS_COMMENT = 300
MIN_SUBJECTIVITY_POST = 0.3
MIN_SUBJECTIVITY_COMMENT = 0.15
MIN_POST_COMMENTS = 5
MIN_VIDEO_COMMENTS = 10
START_DATE = "2020-01-01 00:00:00"
END_DATE_A = "2025-12-31 00:00:00"
END_DATE_B = "2025-12-31 23:59:59"
TARGET_COMMENTS = 1000
VIDEOS_PER_QUERY = 3
COMMENTS_PER_VIDEO = 100
REMOVED_BODIES = ["[deleted]", "[removed]"]

# --- fixed values: labels ----------------------------------------------------------------------------
LABELS = ["negative", "neutral", "positive"]

# --- fixed values: ASCII punctuation and contractions split by the word tokenizer --------------------
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPLIT_WORDS = ["can|not", "gim|me", "gon|na", "got|ta", "lem|me", "wan|na"]

# --- fixed values: English stop words -----------------------------------------------------------------
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're", "you've", "you'll", "you'd",
    "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "she's", "her", "hers",
    "herself", "it", "it's", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which",
    "who", "whom", "this", "that", "that'll", "these", "those", "am", "is", "are", "was", "were", "be", "been",
    "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if",
    "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between",
    "into", "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out",
    "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why",
    "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not",
    "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "don't",
    "should", "should've", "now", "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn",
    "couldn't", "didn", "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't", "haven", "haven't",
    "isn", "isn't", "ma", "mightn", "mightn't", "mustn", "mustn't", "needn", "needn't", "shan", "shan't",
    "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn", "wouldn't",
]

# --- fixed values: polarity rule constants of the published rule set (Hutto and Gilbert, ICWSM 2014) --
BOOST = 0.293
CAPS_BOOST = 0.733
NEGATION_SCALE = -0.74
NORMALISE_ALPHA = 15.0
EXCLAMATION_STEP = 0.292
QUESTION_STEP = 0.18
QUESTION_MAX = 0.96
BOOSTERS = [
    "absolutely", "amazingly", "awfully", "completely", "considerable", "considerably", "decidedly",
    "deeply", "effing", "enormous", "enormously", "entirely", "especially", "exceptional",
    "exceptionally", "extreme", "extremely", "fabulously", "flipping", "flippin", "frackin",
    "fracking", "fricking", "frickin", "frigging", "friggin", "fully", "fuckin", "fucking", "fuggin",
    "fugging", "greatly", "hella", "highly", "hugely", "incredible", "incredibly", "intensely",
    "major", "majorly", "more", "most", "particularly", "purely", "quite", "really", "remarkably",
    "so", "substantially", "thoroughly", "total", "totally", "tremendous", "tremendously", "uber",
    "unbelievably", "unusually", "utter", "utterly", "very",
]
DAMPENERS = [
    "almost", "barely", "hardly", "just enough", "kind of", "kinda", "kindof", "kind-of", "less",
    "little", "marginal", "marginally", "occasional", "occasionally", "partly", "scarce", "scarcely",
    "slight", "slightly", "somewhat", "sort of", "sorta", "sortof", "sort-of",
]
# Phrases before a word, from the list above, and fixed expressions with the valence they set.
DAMPENING_PHRASES = ["just enough", "kind of", "sort of"]
IDIOMS = {
    "the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "badass": 1.5, "bus stop": 0.0, "yeah right": -2.0,
    "kiss of death": -1.5, "to die for": 3.0, "beating heart": 3.1, "broken heart": -2.9,
}
NEGATIONS = [
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt", "ain't", "aren't",
    "can't", "couldn't", "daren't", "didn't", "doesn't", "dont", "hadnt", "hasnt", "havent", "isnt",
    "mightnt", "mustnt", "neither", "don't", "hadn't", "hasn't", "haven't", "isn't", "mightn't",
    "mustn't", "neednt", "needn't", "never", "none", "nope", "nor", "not", "nothing", "nowhere",
    "oughtnt", "shant", "shouldnt", "uhuh", "wasnt", "werent", "oughtn't", "shan't", "shouldn't",
    "uh-uh", "wasn't", "weren't", "without", "wont", "wouldnt", "won't", "wouldn't", "rarely",
    "seldom", "despite",
]

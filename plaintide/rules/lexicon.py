"""Fixed values of the published valence-scoring rules (Hutto and Gilbert, ICWSM 2014)."""

BOOSTER = 0.293
CAPS_BOOST = 0.733
NEGATION_SCALE = -0.74
NORMALISER = 15.0

# Words that strengthen (+1) or weaken (-1) the word after them.
DEGREE_WORDS = {
    "absolutely": 1, "amazingly": 1, "awfully": 1, "completely": 1, "considerably": 1, "deeply": 1,
    "enormously": 1, "entirely": 1, "especially": 1, "exceptionally": 1, "extremely": 1,
    "greatly": 1, "highly": 1, "hugely": 1, "incredibly": 1, "intensely": 1, "particularly": 1,
    "purely": 1, "quite": 1, "really": 1, "remarkably": 1, "so": 1, "substantially": 1,
    "thoroughly": 1, "totally": 1, "tremendously": 1, "unbelievably": 1, "utterly": 1, "very": 1,
    "almost": -1, "barely": -1, "hardly": -1, "less": -1, "little": -1, "marginally": -1,
    "occasionally": -1, "partly": -1, "scarcely": -1, "slightly": -1, "somewhat": -1,
}

NEGATION_WORDS = [
    "aint", "arent", "cannot", "cant", "couldnt", "didnt", "doesnt", "dont", "hadnt", "hasnt",
    "havent", "isnt", "neither", "never", "none", "nope", "nor", "not", "nothing", "nowhere",
    "rarely", "seldom", "shouldnt", "uhuh", "wasnt", "werent", "without", "wont", "wouldnt", "despite",
    "ain't", "aren't", "can't", "couldn't", "didn't", "doesn't", "don't", "hadn't", "hasn't",
    "haven't", "isn't", "shouldn't", "wasn't", "weren't", "won't", "wouldn't",
]

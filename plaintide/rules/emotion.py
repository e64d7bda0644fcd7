"""Emotion rules: keywords with a weight per emotion, intensifiers and negations."""

# Fixed values. A trailing "*" marks a word prefix; anything else is a whole word or phrase.
# The order of the emotions decides ties; "fantastic" is listed twice on purpose and counts twice.
EMOTION_KEYWORDS = {
    "Angry": [
        "furious", "outraged", "infuriated", "enraged", "livid", "angry", "terrible", "horrible",
        "disgusting", "unacceptable", "appalling", "scam", "fraud", "cheat*", "worst", "hate",
        "ridiculous", "absurd", "pathetic", "useless", "incompetent", "rude",
    ],
    "Frustrated": [
        "frustrat*", "annoying", "irritating", "fed up", "keeps failing", "keeps showing",
        "not working", "still no*", "still waiting", "still hasn't", "again and again",
        "waste of time", "poor experience", "no response", "no reply", "no resolution", "no fix",
        "never resolved", "never got resolved", "second time", "needs serious improvement", "hassle",
        "multiple times", "crashes", "crashed", "timed out", "hasn't happened", "not been processed",
        "never showed up",
    ],
    "Disappointed": [
        "disappoint*", "let down", "letdown", "expected better", "expected a bit more",
        "not what i expected", "below expectations", "not satisfied", "unsatisfied", "not happy",
        "poor quality", "not worth", "waste of money", "regret", "unfortunately", "underwhelming",
        "forgettable", "flimsy", "not great", "would not recommend", "wouldn't recommend",
        "won't order again", "not planning to purchase", "not worth the price", "overcharged",
        "took longer", "slower than",
    ],
    "Confused": [
        "confused", "unclear", "not sure", "don't understand", "no idea", "complicated",
        "hard to understand", "difficult to navigate", "confusing", "misleading", "not clear", "vague",
        "how do i", "without any explanation", "no explanation",
    ],
    "Satisfied": [
        "satisfied", "happy with", "pleased", "decent", "okay", "alright", "fine", "works",
        "good enough", "acceptable", "meets expectations", "as expected", "delivered on time",
        "got my order", "polite", "courteous", "smooth", "accurate", "reasonable", "eventually",
        "no complaints", "gets the job done", "solid", "average",
    ],
    "Happy": [
        "love*", "excellent", "amazing", "fantastic", "wonderful", "brilliant", "superb",
        "outstanding", "perfect*", "great", "awesome", "best", "happy", "delighted", "thrilled",
        "impressed", "incredible", "10/10", "five star", "highly recommend", "will buy again",
        "top notch", "worth every", "premium", "flawless", "fantastic",
    ],
}

EMOTION_WEIGHTS = {"Angry": 3, "Frustrated": 2, "Disappointed": 2, "Confused": 2, "Satisfied": 2, "Happy": 3}

INTENSIFIERS = ["very", "extremely", "so", "really", "absolutely", "totally", "completely"]

NEGATIONS = [
    "not", "never", "no", "don't", "doesn't", "didn't", "won't", "isn't", "wasn't", "couldn't", "can't",
    "hasn't",
]

# Factors applied to a score when the text holds a negation.
NEGATION_FACTORS = {"Happy": 0.3, "Satisfied": 0.5, "Frustrated": 1.2, "Disappointed": 1.2}

NEGATIVE_EMOTIONS = ["Angry", "Frustrated", "Disappointed", "Confused"]
POSITIVE_EMOTIONS = ["Happy", "Satisfied"]

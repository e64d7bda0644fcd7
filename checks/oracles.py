"""SQL for DuckDB that gives the same results as the queries, built from the rule tables.

The SQL takes its own way: one regular expression per keyword over the distinct texts, windows for
the first record of a set, all pairs for similarity. Each statement is a chain of WITH parts; a part
names the parts it needs.
"""

from __future__ import annotations

import re

from checks.fixture import FEEDBACK_SQL
from plaintide.functions.matching import parse_term
from plaintide.functions.lexicon import seed_lexicon
from plaintide.rules import emotion as emo
from plaintide.rules import lexicon as lex
from plaintide.rules import priority as pri
from plaintide.rules import sentiment as sen
from plaintide.rules.actions import ACTIONS, DEFAULT_ACTION
from plaintide.rules.issue import ANY_ISSUE, ISSUE_PATTERNS, NO_ISSUE
from plaintide.rules.stopwords import ENGLISH
from plaintide.rules.topic import TOPIC_KEYWORDS


def lit(value) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def items(values) -> str:
    return ", ".join(lit(v) for v in values)


def slug(label: str) -> str:
    return label.lower().replace(" ", "_").replace("/", "_")


def issue_slug(label: str) -> str:
    return "_".join(label.lower().replace("/", " ").split())


def pct(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} = 0 THEN 0.0 ELSE round_even(CAST({part} AS DOUBLE) / {whole} * 100, 1) END"


def body(term) -> str:
    return r"\s+".join(re.escape(w) for w in term.text.split())


def emotion_terms() -> str:
    rows = []
    for emotion, specs in emo.EMOTION_KEYWORDS.items():
        for number, spec in enumerate(specs):
            term = parse_term(spec)
            inner = f"({body(term)}" + (r"\w*)" if term.prefix else r")(?:$|[^\w'])")
            rows.append(f"({lit(emotion)}, {number}, {lit('(?:^|[^' + chr(92) + 'w' + chr(39) + '])' + inner)})")
    return "VALUES " + ", ".join(rows)


def topic_terms() -> str:
    rows = []
    for topic, specs in TOPIC_KEYWORDS.items():
        for number, spec in enumerate(specs):
            term = parse_term(spec)
            pattern = r"\b" + body(term) + ("" if term.prefix else r"\b")
            rows.append(f"({lit(topic)}, {number}, {lit(pattern)}, {term.weight})")
    return "VALUES " + ", ".join(rows)


EMOTIONS = list(emo.EMOTION_KEYWORDS)
TOPICS = list(TOPIC_KEYWORDS)
CLEAN = r"trim(regexp_replace({c}, '[\s\x00-\x1f\x7f]+', ' ', 'g'))"


def emotion_score(emotion: str) -> str:
    score = f"boosted_{slug(emotion)} * {float(emo.EMOTION_WEIGHTS[emotion])}::DOUBLE"
    factor = emo.NEGATION_FACTORS.get(emotion)
    return f"CASE WHEN negated THEN {score} * {factor}::DOUBLE ELSE {score} END" if factor else score


def argmax(labels, column, best) -> str:
    return "CASE " + " ".join(f"WHEN {column(x)} = {best} THEN {lit(x)}" for x in labels) + " END"


def found_terms(terms, column) -> str:
    listed = ", ".join(f"CASE WHEN contains({column}, {lit(t)}) THEN {lit(t)} END" for t in terms)
    return f"list_filter([{listed}], lambda x: x IS NOT NULL)"


def points(column, table) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {lit(k)} THEN {v}" for k, v in table.items()) + " ELSE 0 END"


EDGE = r"\b(" + "|".join(emo.NEGATIONS) + r")\b"
E_SUM = " + ".join(f"e_{slug(e)}" for e in EMOTIONS)
T_SUM = " + ".join(f"score_{slug(t)}" for t in TOPICS)
E_BEST = "greatest(" + ", ".join(f"e_{slug(e)}" for e in EMOTIONS) + ")"
T_BEST = "greatest(" + ", ".join(f"score_{slug(t)}" for t in TOPICS) + ")"
HIGH = items(pri.HIGH_IMPACT_ISSUES)
ISSUE_CASE = "CASE " + " ".join(
    f"WHEN regexp_matches(low2, {lit(p)}) THEN {lit(i)}" for i, p in ISSUE_PATTERNS.items()
) + " END"
WORD_RUN = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}]{2,}"

# name: (needs, SQL)
PARTS: dict[str, tuple[list[str], str]] = {
    "src": ([], FEEDBACK_SQL),
    "told": (
        ["src"],
        f"SELECT * EXCLUDE (feedback), {CLEAN.format(c='feedback')} AS feedback FROM src "
        "WHERE feedback IS NOT NULL",
    ),
    "filled": (["told"], "SELECT * FROM told WHERE feedback <> ''"),
    "firsts": (
        ["filled"],
        "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, product, "
        "channel, date, rating, feedback_category, feedback ORDER BY feedback_id) AS rn FROM filled) "
        "WHERE rn = 1",
    ),
    "clean": (["firsts"], "SELECT * FROM firsts WHERE len(string_split(feedback, ' ')) >= 2"),
    "texts": (
        ["clean"],
        "SELECT feedback, replace(lower(feedback), '’', '''') AS low, "
        "replace(replace(lower(feedback), '’', ''''), '‘', '''') AS low2, "
        "lower(feedback) AS lower_text FROM (SELECT DISTINCT feedback FROM clean)",
    ),
    "kw": (
        ["texts"],
        "SELECT feedback, CASE WHEN p > n THEN 0.15 WHEN n > p THEN 0.65 ELSE 0.2 END::DOUBLE AS negative, "
        "CASE WHEN p <> n THEN 0.2 ELSE 0.6 END::DOUBLE AS neutral, "
        "CASE WHEN p > n THEN 0.65 WHEN n > p THEN 0.15 ELSE 0.2 END::DOUBLE AS positive, "
        "CASE WHEN p > n THEN 'Positive' WHEN n > p THEN 'Negative' ELSE 'Neutral' END AS label, "
        "CASE WHEN p <> n THEN 65.0 ELSE 60.0 END::DOUBLE AS confidence "
        f"FROM (SELECT feedback, len(list_intersect(w, [{items(sen.POSITIVE_WORDS)}])) AS p, "
        f"len(list_intersect(w, [{items(sen.NEGATIVE_WORDS)}])) AS n FROM (SELECT feedback, "
        "list_distinct(regexp_extract_all(lower_text, '[a-z'']+')) AS w FROM texts))",
    ),
    "emotion_terms(emotion, ord, pattern)": ([], emotion_terms()),
    "emotion_found": (
        ["texts", "emotion_terms(emotion, ord, pattern)"],
        r"SELECT feedback, emotion, ord, regexp_extract_all(low, '[\w'']+') AS words, "
        "split_part(regexp_extract(low, pattern, 1), ' ', 1) AS first "
        "FROM texts, emotion_terms WHERE regexp_matches(low, pattern)",
    ),
    "emotion_boosts": (
        ["emotion_found"],
        "SELECT feedback, emotion, CASE WHEN pos > 1 AND words[pos - 1] IN "
        f"({items(emo.INTENSIFIERS)}) THEN 1.5 ELSE 1.0 END::DOUBLE AS boost FROM (SELECT *, "
        "list_position(list_transform(words, lambda w: starts_with(w, first)), true) AS pos FROM emotion_found)",
    ),
    "emotion_sums": (
        ["texts", "emotion_boosts"],
        "SELECT t.feedback, "
        + ", ".join(
            f"coalesce(sum(b.boost) FILTER (b.emotion = {lit(e)}), 0.0) AS boosted_{slug(e)}, "
            f"count(b.boost) FILTER (b.emotion = {lit(e)}) AS hits_{slug(e)}"
            for e in EMOTIONS
        )
        + f", regexp_matches(any_value(t.low), {lit(EDGE)}) AS negated "
        "FROM texts t LEFT JOIN emotion_boosts b ON b.feedback = t.feedback GROUP BY t.feedback",
    ),
    "emotion_scored": (
        ["emotion_sums"],
        "SELECT *, " + ", ".join(f"{emotion_score(e)} AS e_{slug(e)}" for e in EMOTIONS) + " FROM emotion_sums",
    ),
    "emotions": (
        ["emotion_scored"],
        f"SELECT feedback, CASE WHEN len(trim(feedback)) < 3 OR {E_BEST} = 0 THEN 'Neutral' ELSE "
        + argmax(EMOTIONS, lambda e: f"e_{slug(e)}", E_BEST)
        + " END AS raw_emotion, CASE WHEN len(trim(feedback)) < 3 THEN 50.0 "
        f"WHEN {E_BEST} = 0 THEN 55.0 ELSE round_even(least(95.0, 50 + ({E_BEST} / ({E_SUM})) * 45), 1) "
        "END::DOUBLE AS raw_confidence FROM emotion_scored",
    ),
    "topic_terms(topic, ord, pattern, weight)": ([], topic_terms()),
    "topic_scored": (
        ["texts", "topic_terms(topic, ord, pattern, weight)"],
        "SELECT t.feedback, "
        + ", ".join(
            f"coalesce(sum(k.weight) FILTER (k.topic = {lit(t)}), 0)::BIGINT AS score_{slug(t)}"
            for t in TOPICS
        )
        + " FROM texts t LEFT JOIN topic_terms k ON regexp_matches(t.low, k.pattern) GROUP BY t.feedback",
    ),
    "topics": (
        ["topic_scored"],
        f"SELECT feedback, CASE WHEN {T_BEST} = 0 THEN 'Other' ELSE "
        + argmax(TOPICS, lambda t: f"score_{slug(t)}", T_BEST)
        + f" END AS topic_detected, CASE WHEN {T_BEST} = 0 THEN 50.0 ELSE round_even(least(95.0, "
        f"50 + ({T_BEST}::DOUBLE / ({T_SUM})) * 45), 1) END::DOUBLE AS confidence FROM topic_scored",
    ),
    "matches": (["texts"], f"SELECT feedback, {ISSUE_CASE} AS match FROM texts"),
    "signals": (
        ["texts"],
        f"SELECT feedback, {found_terms(pri.URGENCY_TERMS, 'lower_text')} AS urgency, "
        f"{found_terms(pri.IMPACT_TERMS, 'lower_text')} AS impact FROM texts",
    ),
    "sentiments": (
        ["clean", "kw"],
        "SELECT c.*, coalesce(rated, label) AS sentiment, CASE WHEN rated IS NULL THEN confidence "
        "WHEN rated = label THEN 95.0 ELSE 80.0 END::DOUBLE AS sentiment_confidence, "
        "CASE WHEN rated IS NULL THEN 'text' ELSE 'rating' END AS sentiment_source, label AS text_label, "
        "confidence AS text_confidence, rated "
        "FROM (SELECT *, CASE WHEN rating BETWEEN 1 AND 5 THEN CASE WHEN rating <= 2 THEN 'Negative' "
        "WHEN rating < 4 THEN 'Neutral' ELSE 'Positive' END END AS rated FROM clean) c "
        "JOIN kw USING (feedback)",
    ),
    "emoted": (
        ["sentiments", "emotions"],
        "SELECT * EXCLUDE (fix), coalesce(fix, raw_emotion) AS emotion, "
        "CASE WHEN fix IS NULL THEN raw_confidence ELSE 60.0 END::DOUBLE AS emotion_confidence FROM "
        "(SELECT s.*, raw_emotion, raw_confidence, CASE "
        f"WHEN sentiment = 'Negative' AND raw_emotion IN ({items(emo.POSITIVE_EMOTIONS + ['Neutral'])}) "
        "THEN 'Disappointed' "
        f"WHEN sentiment = 'Positive' AND raw_emotion IN ({items(emo.NEGATIVE_EMOTIONS + ['Neutral'])}) "
        "THEN 'Satisfied' "
        f"WHEN sentiment = 'Neutral' AND raw_emotion IN ({items(emo.POSITIVE_EMOTIONS)}) "
        "AND raw_confidence < 70 THEN 'Neutral' END AS fix "
        "FROM sentiments s JOIN emotions USING (feedback))",
    ),
    "topiced": (
        ["emoted", "topics"],
        "SELECT * EXCLUDE (given, confidence), coalesce(given, topic_detected) AS topic, "
        "CASE WHEN given IS NULL THEN confidence ELSE 98.0 END::DOUBLE AS topic_confidence, "
        "CASE WHEN given IS NULL THEN 'detected' ELSE 'dataset' END AS topic_source FROM "
        "(SELECT e.*, topic_detected, t.confidence, CASE WHEN trim(feedback_category) <> '' AND "
        "lower(trim(feedback_category)) <> 'nan' THEN trim(feedback_category) END AS given "
        "FROM emoted e JOIN topics t USING (feedback))",
    ),
    "issued": (
        ["topiced", "matches"],
        "SELECT t.*, match, CASE WHEN sentiment = 'Positive' THEN "
        f"{lit(NO_ISSUE)} WHEN match IS NOT NULL THEN match WHEN sentiment = 'Negative' THEN "
        f"{lit(ANY_ISSUE)} ELSE {lit(NO_ISSUE)} END AS detected_issue, "
        "CASE WHEN sentiment = 'Positive' THEN 45.0 WHEN match IS NOT NULL THEN 72.0 "
        "WHEN sentiment = 'Negative' THEN 55.0 ELSE 45.0 END::DOUBLE AS issue_confidence, "
        "CASE WHEN sentiment = 'Negative' THEN true WHEN sentiment = 'Positive' THEN false "
        "ELSE match IS NOT NULL END AS is_complaint FROM topiced t JOIN matches USING (feedback)",
    ),
    "enriched": (
        ["issued", "signals"],
        "SELECT *, CASE WHEN priority_score >= 7 THEN 'HIGH' WHEN priority_score >= 4 THEN 'MEDIUM' "
        "ELSE 'LOW' END AS priority, strftime(date, '%Y-%m') AS period FROM (SELECT i.*, urgency, impact, "
        f"({points('sentiment', pri.SENTIMENT_POINTS)} + {points('emotion', pri.EMOTION_POINTS)} "
        f"+ CASE WHEN is_complaint THEN 2 ELSE 0 END + CASE WHEN detected_issue IN ({HIGH}) THEN 2 ELSE 0 END "
        "+ len(urgency) + len(impact) + CASE WHEN rating <= 2 THEN 2 WHEN rating <= 3 THEN 1 ELSE 0 END"
        ")::BIGINT AS priority_score FROM issued i JOIN signals USING (feedback))",
    ),
    "summary": (
        ["enriched"],
        "SELECT detected_issue, occurrences, avg_confidence, percentage, avg_sentiment FROM (SELECT "
        "detected_issue, count(*) AS occurrences, avg(issue_confidence) AS avg_confidence, "
        f"{pct('count(*)', '(SELECT count(*) FROM enriched)')} AS percentage FROM enriched "
        f"WHERE detected_issue <> {lit(NO_ISSUE)} GROUP BY 1) JOIN (SELECT detected_issue, sentiment AS "
        "avg_sentiment FROM (SELECT detected_issue, sentiment, row_number() OVER (PARTITION BY "
        "detected_issue ORDER BY count(*) DESC, sentiment) AS rn FROM enriched GROUP BY 1, 2) WHERE rn = 1) "
        "USING (detected_issue)",
    ),
    "complaints": (
        ["enriched"],
        f"SELECT *, detected_issue AS issue_label FROM enriched WHERE is_complaint AND detected_issue <> {lit(NO_ISSUE)}",
    ),
    "numbered": (
        ["complaints"],
        "SELECT issue_label, row_number() OVER (ORDER BY min(feedback_id)) - 1 AS cluster_id "
        "FROM complaints GROUP BY 1",
    ),
    "recurring": (
        ["complaints", "enriched", "numbered"],
        "SELECT *, row_number() OVER (ORDER BY occurrences DESC, priority = 'HIGH' DESC, cluster_id) AS rank "
        "FROM (SELECT *, CASE WHEN occurrences >= 10 OR share >= 0.08 OR (occurrences >= 6 AND issue_label IN "
        f"({items(pri.HIGH_IMPACT_RECURRING)})) THEN 'HIGH' WHEN occurrences >= 5 OR share >= 0.04 THEN 'MEDIUM' "
        "ELSE 'LOW' END AS priority FROM (SELECT issue_label, count(*) AS occurrences, "
        "count(*)::DOUBLE / (SELECT count(*) FROM enriched) AS share, "
        f"{pct('count(*)', '(SELECT count(*) FROM enriched)')} AS percentage, "
        "round_even(avg(rating), 2) AS avg_rating FROM complaints GROUP BY 1 HAVING count(*) >= 3) "
        "JOIN numbered USING (issue_label) JOIN (SELECT issue_label, sentiment AS avg_sentiment FROM "
        "(SELECT issue_label, sentiment, row_number() OVER (PARTITION BY issue_label ORDER BY count(*) DESC, "
        "sentiment) AS rn FROM complaints GROUP BY 1, 2) WHERE rn = 1) USING (issue_label))",
    ),
    "complaint_texts": (
        ["complaints"],
        "SELECT issue_label, feedback AS text, count(*) AS copies, row_number() OVER (ORDER BY "
        "min(feedback_id), issue_label, feedback) AS text_id FROM complaints GROUP BY 1, 2",
    ),
    "document_texts": (
        [],
        "SELECT lang AS issue_label, text, count(*) AS copies, row_number() OVER (ORDER BY min(doc_id), lang, text) "
        "AS text_id FROM "
        "(SELECT doc_id, lang, trim(regexp_replace(coalesce(text, ''), '[\\s\\x00-\\x1f\\x7f\\x{85}\\p{Z}]+', "
        "' ', 'g')) AS text FROM documents) WHERE text <> '' AND len(string_split(text, ' ')) >= 2 GROUP BY 1, 2",
    ),
    "samples": (
        ["complaint_texts"],
        "SELECT issue_label, string_agg(text, ' | ' ORDER BY rn) AS samples FROM (SELECT *, row_number() "
        "OVER (PARTITION BY issue_label ORDER BY copies DESC, text_id) AS rn FROM complaint_texts) "
        "WHERE rn <= 3 GROUP BY 1",
    ),
}


def segment(column: str) -> str:
    return (
        f"SELECT issue_label, {column} AS top_{column}, n AS top_{column}_count FROM (SELECT issue_label, "
        f"{column}, count(*) AS n, row_number() OVER (PARTITION BY issue_label ORDER BY count(*) DESC, "
        f"{column}) AS rn FROM complaints WHERE {column} IS NOT NULL GROUP BY 1, 2) WHERE rn = 1"
    )


PARTS["m_words"] = (
    ["clean"], f"SELECT DISTINCT feedback, regexp_extract_all(lower(feedback), {lit(WORD_RUN)}) AS w FROM clean")
PARTS["m_counts"] = (
    ["m_words"],
    "SELECT feedback, term, count(*) AS tf FROM (SELECT feedback, unnest(list_concat(w, list_transform(range(1, len(w)), "
    "lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM m_words) GROUP BY 1, 2")
PARTS["m_known"] = (
    ["m_counts", "m_words"],
    "SELECT term, n, ln((1 + (SELECT count(*) FROM m_words)) / (1 + n)) + 1 AS idf FROM (SELECT term, count(*) AS n, "
    "row_number() OVER (ORDER BY count(*) DESC, term) AS rn FROM m_counts GROUP BY 1) WHERE rn <= 400")
PARTS["m_scores"] = (
    ["m_words", "m_counts", "m_known"],
    "SELECT feedback, 0.1 + coalesce(sum(x * (n * 1 % 7 - 3) / 2), 0) AS a, coalesce(sum(x * (n * 2 % 7 - 3) / 2), 0) AS b, "
    "-0.2 + coalesce(sum(x * (n * 3 % 7 - 3) / 2), 0) AS c FROM (SELECT w.feedback, k.n, k.v / sqrt(sum(k.v * k.v) OVER "
    "(PARTITION BY w.feedback)) AS x FROM m_words w LEFT JOIN (SELECT c.feedback, k.n, (1 + ln(c.tf)) * k.idf AS v FROM "
    "m_counts c JOIN m_known k USING (term)) k ON k.feedback = w.feedback) GROUP BY 1")
PARTS["products"] = (["complaints"], segment("product"))
PARTS["channels"] = (["complaints"], segment("channel"))


def term_parts(prefix: str, texts: str) -> None:
    """Parts <prefix>_... for TF-IDF, similar pairs and components over the part `texts`."""
    p = prefix
    PARTS[f"{p}_words"] = (
        [texts],
        f"SELECT issue_label, text_id, copies, list_filter(regexp_extract_all(lower(text), {lit(WORD_RUN)}), "
        f"lambda w: w NOT IN ({items(ENGLISH)})) AS w FROM {texts}",
    )
    PARTS[f"{p}_counts"] = (
        [f"{p}_words"],
        "SELECT issue_label, text_id, copies, term, count(*) AS tf FROM (SELECT issue_label, text_id, copies, "
        "unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term "
        f"FROM {p}_words) GROUP BY 1, 2, 3, 4",
    )
    PARTS[f"{p}_kept"] = (
        [f"{p}_counts", texts],
        "SELECT issue_label, term, ln((1 + n) / (1 + holding)) + 1 AS idf FROM (SELECT issue_label, term, "
        "sum(copies)::DOUBLE AS holding, row_number() OVER (PARTITION BY issue_label ORDER BY "
        f"sum(tf * copies) DESC, term) AS rn FROM {p}_counts GROUP BY 1, 2) "
        f"JOIN (SELECT issue_label, sum(copies)::DOUBLE AS n FROM {texts} GROUP BY 1) USING (issue_label) "
        "WHERE rn <= 300",
    )
    PARTS[f"{p}_mass"] = (
        [f"{p}_counts", f"{p}_kept"],
        "SELECT issue_label, term, round_even(sum(copies * w / norm), 6) AS mass FROM (SELECT *, sqrt(sum(w * w) "
        "OVER (PARTITION BY issue_label, text_id)) AS norm FROM (SELECT c.*, tf * idf AS w "
        f"FROM {p}_counts c JOIN {p}_kept USING (issue_label, term))) GROUP BY 1, 2",
    )
    PARTS[f"{p}_weights"] = (
        [f"{p}_counts", texts],
        "SELECT issue_label, text_id, term, holding, w / sqrt(sum(w * w) OVER (PARTITION BY issue_label, "
        "text_id)) AS w FROM (SELECT c.issue_label, c.text_id, c.term, h.holding, "
        "c.tf * (ln((1 + n) / (1 + h.holding)) + 1) AS w "
        f"FROM {p}_counts c JOIN (SELECT issue_label, term, count(*)::DOUBLE AS holding FROM {p}_counts "
        f"GROUP BY 1, 2) h USING (issue_label, term) JOIN (SELECT issue_label, count(*)::DOUBLE AS n FROM {texts} "
        "GROUP BY 1) USING (issue_label))",
    )
    PARTS[f"{p}_pairs"] = (
        [f"{p}_weights"],
        "SELECT x.issue_label, x.text_id AS a, y.text_id AS b, sum(x.w * y.w) AS cosine "
        f"FROM {p}_weights x JOIN {p}_weights y ON x.issue_label = y.issue_label AND x.term = y.term "
        "AND x.text_id < y.text_id GROUP BY 1, 2, 3 HAVING sum(x.w * y.w) >= 0.45",
    )
    PARTS[f"{p}_prefix"] = (
        [f"{p}_weights"],
        "SELECT * FROM (SELECT *, sum(w * w) OVER (PARTITION BY issue_label, text_id ORDER BY holding, term "
        f"ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward FROM {p}_weights) "
        "WHERE onward >= 0.45 * 0.45 - 1e-9",
    )
    PARTS[f"{p}_links"] = (
        [f"{p}_prefix", f"{p}_pairs"],
        f"SELECT DISTINCT q.issue_label, q.a, q.b FROM {p}_pairs q JOIN {p}_prefix t ON t.text_id = q.b "
        f"AND t.issue_label = q.issue_label JOIN (SELECT issue_label, term, min(text_id) AS pivot FROM {p}_prefix "
        "GROUP BY 1, 2) v ON v.issue_label = t.issue_label AND v.term = t.term AND v.pivot = q.a",
    )
    PARTS[f"{p}_reach(a, b)"] = (
        [f"{p}_pairs", texts],
        f"SELECT text_id, text_id FROM {texts} UNION SELECT r.a, q.b FROM {p}_reach r JOIN (SELECT a, b FROM "
        f"{p}_pairs UNION ALL SELECT b, a FROM {p}_pairs) q ON q.a = r.b",
    )
    PARTS[f"{p}_members"] = (
        [f"{p}_reach(a, b)", texts],
        f"SELECT issue_label, text_id, theme_id FROM {texts} JOIN (SELECT a AS text_id, min(b) AS theme_id "
        f"FROM {p}_reach GROUP BY 1) USING (text_id)",
    )


term_parts("c", "complaint_texts")
term_parts("d", "document_texts")

PARTS["themes"] = (
    ["c_members", "complaint_texts"],
    "SELECT issue_label, theme, example, n AS count FROM (SELECT *, row_number() OVER (PARTITION BY issue_label "
    "ORDER BY n DESC, theme_id) AS theme FROM (SELECT issue_label, theme_id, sum(copies)::BIGINT AS n, "
    "first(text ORDER BY copies DESC, text_id) AS example FROM c_members JOIN complaint_texts "
    "USING (issue_label, text_id) GROUP BY 1, 2)) WHERE theme <= 3",
)


PARTS["keywords"] = (
    ["c_mass"],
    "SELECT issue_label, array_to_string(list_reduce(list([term] ORDER BY mass DESC, term), lambda taken, x: CASE WHEN "
    "len(taken) < 4 AND len(list_filter(taken, lambda t: contains(t, x[1]) OR contains(x[1], t))) = 0 "
    "THEN list_concat(taken, x) ELSE taken END), ', ') AS keywords FROM c_mass GROUP BY 1",
)


def renamed(names: list[str], prefix: str, **replaced: str) -> None:
    """Copies of parts under new names, reading each other and the parts `replaced` by others."""
    swaps = {n: prefix + n for n in names} | replaced
    pattern = re.compile(r"\b(" + "|".join(swaps) + r")\b")
    for name in names:
        needs, sql = PARTS[name]
        PARTS[prefix + name] = (
            [swaps.get(n, n) for n in needs], pattern.sub(lambda m: swaps[m[1]], sql))


# The valence rules on the words of every text, one row per word.
LEXICON_MAP = "MAP {" + ", ".join(f"{lit(w)}: {float(v)}::DOUBLE" for w, v in seed_lexicon().items()) + "}"
DEGREE = (
    f"CASE WHEN low IN ({items(w for w, s in lex.DEGREE_WORDS.items() if s > 0)}) THEN 1.0 WHEN low IN "
    f"({items(w for w, s in lex.DEGREE_WORDS.items() if s < 0)}) THEN -1.0 ELSE 0.0 END::DOUBLE"
)
PARTS["lex_words"] = (
    ["texts"],
    "SELECT feedback, i, word, lower(word) AS low FROM (SELECT feedback, i, CASE WHEN length(inner_) <= 2 THEN w ELSE "
    "inner_ END AS word FROM (SELECT feedback, i, w, regexp_replace(w, '^[[:punct:]]+|[[:punct:]]+$', '', 'g') AS inner_ "
    "FROM (SELECT feedback, unnest(string_split(feedback, ' ')) AS w, generate_subscripts(string_split(feedback, ' '), 1) "
    "AS i FROM texts)))",
)
PARTS["lex_facts"] = (
    ["lex_words"],
    "SELECT *, CASE WHEN degree = 0 THEN coalesce(own, 0.0) ELSE 0.0 END AS valence, own IS NOT NULL AS known, "
    "count(*) FILTER (upper_) OVER t > 0 AND count(*) FILTER (upper_) OVER t < count(*) OVER t AS mixed, "
    "min(i) FILTER (low = 'but') OVER t AS but_at FROM (SELECT *, "
    f"{LEXICON_MAP}[low] AS own, {DEGREE} AS degree, low IN ({items(lex.NEGATION_WORDS)}) OR contains(low, 'n''t') "
    "AS negates, upper(word) = word AND lower(word) <> word AS upper_ FROM lex_words) "
    "WINDOW t AS (PARTITION BY feedback)",
)
PARTS["lex_context"] = (
    ["lex_facts"],
    "SELECT *, "
    + ", ".join(
        f"coalesce(lag(CASE WHEN degree <> 0 AND NOT known THEN (degree * {lex.BOOSTER}::DOUBLE + CASE WHEN upper_ AND mixed "
        f"THEN {lex.CAPS_BOOST}::DOUBLE ELSE 0 END) * {scale}::DOUBLE ELSE 0 END, {k}) OVER w, 0) AS push{k}, "
        f"coalesce(lag(CASE WHEN negates AND NOT known THEN {lex.NEGATION_SCALE}::DOUBLE ELSE 1 END, {k}) OVER w, 1) AS turn{k}"
        for k, scale in ((1, 1.0), (2, 0.95), (3, 0.9))
    )
    + f", valence + CASE WHEN upper_ AND mixed THEN sign(valence) * {lex.CAPS_BOOST}::DOUBLE ELSE 0 END AS v0 "
    "FROM lex_facts WINDOW w AS (PARTITION BY feedback ORDER BY i)",
)
PARTS["lex_sums"] = (
    ["lex_context"],
    "SELECT feedback, coalesce(sum(CASE WHEN valence = 0 THEN 0 ELSE v3 * CASE WHEN i < but_at THEN 0.5 WHEN i > but_at "
    "THEN 1.5 ELSE 1.0 END END), 0) AS total, length(feedback) - length(replace(feedback, '!', '')) AS shouts, "
    "length(feedback) - length(replace(feedback, '?', '')) AS asks FROM (SELECT *, (v2 + sign(v2) * push3) * turn3 AS v3 FROM "
    "(SELECT *, (v1 + sign(v1) * push2) * turn2 AS v2 FROM (SELECT *, (v0 + sign(v0) * push1) * turn1 AS v1 "
    "FROM lex_context))) GROUP BY feedback",
)
PARTS["lex_scores"] = (
    ["lex_sums"],
    "SELECT feedback, round_even(s / sqrt(s * s + 15), 4) AS compound FROM (SELECT feedback, total + sign(total) * "
    "(least(shouts, 4) * 0.292::DOUBLE + CASE WHEN asks > 3 THEN 0.96 WHEN asks > 1 THEN asks * 0.18 ELSE 0 END::DOUBLE) AS s "
    "FROM lex_sums)",
)


def insight(order, source, title, description, severity, where="true") -> str:
    return (
        f"SELECT {order}::BIGINT AS ord, {title} AS title, {description} AS description, {severity} AS severity "
        f"FROM {source} WHERE {where}"
    )


def share(source, condition) -> str:
    return (
        f"(SELECT total, n, {pct('n', 'total')} AS p FROM (SELECT count(*) AS total, "
        f"count(*) FILTER ({condition}) AS n FROM {source}))"
    )


def top1(column, source, where="true") -> str:
    return (
        f"(SELECT {column} AS label, n, {pct('n', f'(SELECT count(*) FROM {source})')} AS p FROM (SELECT {column}, "
        f"count(*) AS n FROM {source} WHERE {where} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1))"
    )


PARTS["sentiment_months"] = (
    ["enriched"], "SELECT period, sentiment, count(*) AS count FROM enriched GROUP BY 1, 2"
)
PARTS["halves"] = (
    ["sentiment_months"],
    "SELECT max(n) AS months, avg(c) FILTER (i <= n // 2) AS first_half, avg(c) FILTER (i > n // 2) AS second_half "
    "FROM (SELECT count AS c, row_number() OVER (ORDER BY period) AS i, count(*) OVER () AS n "
    "FROM sentiment_months WHERE sentiment = 'Negative')",
)

INSIGHTS = {
    "insight_negative_rate": (["enriched"], insight(
        1, share("enriched", "sentiment = 'Negative'"),
        "CASE WHEN p >= 40 THEN 'High Negative Feedback Rate' ELSE 'Elevated Negative Feedback' END",
        "CASE WHEN p >= 40 THEN p || '% of customer feedback is negative — this significantly exceeds the "
        "healthy threshold of 20%. Immediate review of the main complaint areas is recommended.' ELSE p || "
        "'% of customer feedback is negative. This is above the ideal range and warrants attention.' END",
        "CASE WHEN p >= 40 THEN 'critical' ELSE 'warning' END", "p >= 25")),
    "insight_positive_rate": ([], insight(
        2, share("(SELECT CASE WHEN o_totalprice > 100000 THEN 'Positive' ELSE 'Neutral' END AS sentiment "
                 "FROM orders)", "sentiment = 'Positive'"),
        "'Strong Positive Customer Sentiment'",
        "p || '% of feedback is positive, indicating high customer satisfaction. Focus on maintaining current "
        "standards.'", "'info'", "p >= 60")),
    "insight_top_topic": (["enriched"], insight(
        3, top1("topic", "enriched"), "'Top Feedback Topic: ' || label",
        "p || '% of all feedback is related to ''' || label || '''. This is the primary area of customer concern "
        "and should be prioritized.'", "CASE WHEN p > 30 THEN 'warning' ELSE 'info' END")),
    "insight_worst_topic": (["enriched"], insight(
        4, top1("topic", "enriched", "sentiment = 'Negative'"), "'Most Negative Topic: ' || label",
        "'''' || label || ''' has the highest concentration of negative feedback with ' || n || ' negative "
        "reviews. This represents a critical pain point.'",
        "CASE WHEN n >= 20 THEN 'critical' ELSE 'warning' END")),
    "insight_high_priority": (["enriched"], insight(
        5, share("enriched", "priority = 'HIGH'"), "n || ' High-Priority Issues Detected'",
        "p || '% of feedback (' || n || ' records) has been classified as HIGH priority based on sentiment, "
        "emotion, complaint type, and urgency signals. These require immediate business action.'",
        "CASE WHEN p > 20 THEN 'critical' ELSE 'warning' END", "n > 0")),
    "insight_top_recurring": (["recurring"], insight(
        6, "recurring", "'Most Frequent Recurring Issue: ' || issue_label",
        "'''' || issue_label || ''' appears ' || occurrences || ' times (' || percentage || '% of all feedback), "
        "making it the most critical recurring problem. This pattern suggests a systemic operational issue.'",
        "CASE WHEN priority = 'HIGH' THEN 'critical' ELSE 'warning' END", "rank = 1")),
    "insight_systemic": (["recurring"], insight(
        7, "(SELECT count(*) AS n FROM recurring WHERE priority = 'HIGH')",
        "n || ' Systemic High-Priority Issues Found'",
        "'Analysis detected ' || n || ' distinct recurring issues at HIGH priority, suggesting multiple systemic "
        "operational failures that need strategic intervention.'", "'critical'", "n >= 3")),
    "insight_emotion": (["enriched"], insight(
        8, top1("emotion", "enriched"), "'Dominant Customer Emotion: ' || label",
        "p || '% of customers express ''' || label || ''' emotion in their feedback. High levels of this emotion "
        "indicate a poor customer experience that needs addressing.'", "'warning'",
        "label IN ('Angry', 'Frustrated', 'Disappointed')")),
    "insight_complaint_rate": (["enriched"], insight(
        9, share("enriched", "is_complaint"), "'Complaint Rate: ' || p || '%'",
        "n || ' out of ' || total || ' feedback records contain identifiable complaints. A complaint rate of ' "
        "|| p || '% requires systematic response management.'",
        "CASE WHEN p > 40 THEN 'critical' WHEN p > 20 THEN 'warning' ELSE 'info' END", "total > 0")),
    "insight_rising_negatives": (["halves"], insight(
        10, "halves", "'Increasing Negative Sentiment Trend'",
        "'Negative feedback volume has increased over time. The trend shows growing customer dissatisfaction "
        "that requires urgent attention.'", "'critical'", "months >= 2 AND second_half > first_half * 1.2")),
}

# In the whole set the positive rate is that of the feedback itself.
ALL_INSIGHTS = {k: v for k, v in INSIGHTS.items() if k != "insight_positive_rate"} | {
    "insight_positive_rate": (["enriched"], INSIGHTS["insight_positive_rate"][1].replace(
        "(SELECT CASE WHEN o_totalprice > 100000 THEN 'Positive' ELSE 'Neutral' END AS sentiment FROM orders)",
        "enriched"))
}
PARTS["insights"] = (
    sorted({n for needs, _ in ALL_INSIGHTS.values() for n in needs}),
    " UNION ALL ".join(f"SELECT * FROM ({sql})" for _, sql in ALL_INSIGHTS.values()),
)
PARTS["actions(issue, action, details, kpi, department)"] = (
    [], "VALUES " + ", ".join(f"({items([issue, *texts])})" for issue, texts in ACTIONS.items())
)
FILLED = ", ".join(
    f"coalesce(t.{c}, {lit(v)}) AS {c}"
    for c, v in zip(("action", "details", "kpi", "department"), DEFAULT_ACTION)
)
ACTION_TABLE = "actions(issue, action, details, kpi, department)"
PARTS["from_recurring"] = (
    ["recurring", ACTION_TABLE],
    "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY action ORDER BY ord) AS rn FROM (SELECT "
    f"rank AS ord, issue_label AS issue, occurrences, percentage, priority, avg_sentiment, {FILLED}, occurrences || "
    "' occurrences detected (' || percentage || '% of all feedback) with ' || avg_sentiment || "
    "' average sentiment.' AS evidence FROM recurring r LEFT JOIN actions t ON t.issue = r.issue_label)) "
    "WHERE rn = 1",
)
PARTS["from_summary"] = (
    ["summary", ACTION_TABLE],
    "SELECT * EXCLUDE (rn), row_number() OVER (ORDER BY occurrences DESC, issue) AS ord FROM (SELECT *, "
    "row_number() OVER (PARTITION BY action ORDER BY occurrences DESC, issue) AS rn FROM (SELECT detected_issue AS "
    f"issue, occurrences, percentage, 'MEDIUM' AS priority, avg_sentiment, {FILLED}, occurrences || "
    "' occurrences detected (' || percentage || '% of feedback).' AS evidence FROM summary s LEFT JOIN actions t "
    "ON t.issue = s.detected_issue WHERE occurrences >= 3)) WHERE rn = 1",
)
PARTS["recommended"] = (
    ["from_recurring", "from_summary"],
    "SELECT * EXCLUDE (ord, src), row_number() OVER (ORDER BY CASE priority WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 "
    "WHEN 'LOW' THEN 2 ELSE 3 END, src, ord) AS ord FROM (SELECT *, 0 AS src FROM from_recurring UNION ALL BY NAME "
    "SELECT *, 1 AS src FROM from_summary WHERE action NOT IN (SELECT action FROM from_recurring))",
)


def statement(needs: list[str], sql: str) -> str:
    """`sql` after the WITH parts it needs, each after its own needs."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name not in ordered:
            for need in PARTS[name][0]:
                add(need)
            ordered.append(name)

    for need in needs:
        add(need)
    if not ordered:
        return sql
    materialized = ", ".join(
        f"{name} AS {'' if '_reach' in name else 'MATERIALIZED '}({PARTS[name][1]})" for name in ordered
    )
    return f"WITH RECURSIVE {materialized} {sql}"


def probs(compound: str) -> list[str]:
    """The three class probabilities of a compound score before normalising."""
    up, down = f"{compound} >= 0.05", f"{compound} <= -0.05"
    strong, weak = f"(0.7::DOUBLE + 0.25::DOUBLE * abs({compound}))", f"(0.25::DOUBLE - 0.1::DOUBLE * abs({compound}))"
    return [
        f"greatest(CASE WHEN {up} THEN 0.05 WHEN {down} THEN {strong} ELSE 0.2 END::DOUBLE, 0.01::DOUBLE)",
        f"greatest(CASE WHEN {up} OR {down} THEN {weak} ELSE 0.6 END::DOUBLE, 0.01::DOUBLE)",
        f"greatest(CASE WHEN {up} THEN {strong} WHEN {down} THEN 0.05 ELSE 0.2 END::DOUBLE, 0.01::DOUBLE)",
    ]


CLASSES = ["negative", "neutral", "positive"]


def normalised(compound: str) -> list[str]:
    raw = probs(compound)
    return [f"({p}) / ({' + '.join(raw)})" for p in raw]


def _ensemble() -> str:
    first, second = normalised("(rating / 3 - 1)"), normalised("((customer_id % 201)::DOUBLE / 100 - 1)")
    columns = [
        f"round_even(CASE WHEN rating IS NOT NULL AND channel IS NOT NULL THEN 0.7::DOUBLE * ({m}) + 0.3::DOUBLE * ({x}) "
        f"WHEN rating IS NOT NULL THEN {m} WHEN channel IS NOT NULL THEN {x} ELSE kw.{c} END, 12) AS {c}"
        for c, m, x in zip(CLASSES, first, second)
    ]
    return f"SELECT feedback_id, {', '.join(columns)} FROM clean JOIN kw USING (feedback)"


TEXT_POINTS = (
    f"({points('label', pri.SENTIMENT_POINTS)} + {points('raw_emotion', pri.EMOTION_POINTS)} "
    f"+ CASE WHEN match IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN match IN ({HIGH}) THEN 2 ELSE 0 END "
    "+ len(urgency) + len(impact))::BIGINT"
)


def _single() -> str:
    """The text-only profile from the text-level parts."""
    points_of = TEXT_POINTS
    reasons = (
        "list_filter([CASE WHEN label <> 'Positive' THEN 'Negative sentiment (' || label || ')' END, "
        "CASE WHEN raw_emotion IN ('Angry', 'Frustrated', 'Disappointed', 'Confused') THEN "
        "'Strong negative emotion (' || raw_emotion || ')' END, CASE WHEN match IS NOT NULL THEN 'Complaint detected' END, "
        f"CASE WHEN match IN ({HIGH}) THEN 'High-impact issue type (' || match || ')' END, "
        "CASE WHEN len(urgency) > 0 THEN 'Urgency signals: ' || array_to_string(urgency[1:2], ', ') END, "
        "CASE WHEN len(impact) > 0 THEN 'Business impact signals: ' || array_to_string(impact[1:2], ', ') END], "
        "lambda x: x IS NOT NULL)"
    )
    return (
        "SELECT feedback_id, label AS sentiment, k.confidence AS sentiment_confidence, raw_emotion AS emotion, "
        "raw_confidence AS emotion_confidence, topic_detected AS topic, t.confidence AS topic_confidence, "
        f"coalesce(match, {lit(NO_ISSUE)}) AS detected_issue, CASE WHEN match IS NULL THEN 45.0 ELSE 72.0 END::DOUBLE "
        f"AS issue_confidence, match IS NOT NULL AS is_complaint, {points_of} AS priority_score, "
        f"CASE WHEN {points_of} >= 7 THEN 'HIGH' WHEN {points_of} >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS priority, "
        f"array_to_string({reasons}, '; ') AS priority_reasons, coalesce(a.action, {lit(DEFAULT_ACTION[0])}) AS "
        "recommended_action FROM clean JOIN kw k USING (feedback) JOIN emotions USING (feedback) JOIN topics t USING "
        "(feedback) JOIN matches USING (feedback) JOIN signals USING (feedback) LEFT JOIN actions a ON a.issue = "
        f"coalesce(match, {lit(NO_ISSUE)})"
    )


REASONS = (
    "list_filter([CASE WHEN sentiment <> 'Positive' THEN 'Negative sentiment (' || sentiment || ')' END, "
    "CASE WHEN emotion IN ('Angry', 'Frustrated', 'Disappointed', 'Confused') THEN "
    "'Strong negative emotion (' || emotion || ')' END, CASE WHEN is_complaint THEN 'Complaint detected' END, "
    f"CASE WHEN detected_issue IN ({HIGH}) THEN 'High-impact issue type (' || detected_issue || ')' END, "
    "CASE WHEN len(urgency) > 0 THEN 'Urgency signals: ' || array_to_string(urgency[1:2], ', ') END, "
    "CASE WHEN len(impact) > 0 THEN 'Business impact signals: ' || array_to_string(impact[1:2], ', ') END, "
    "CASE WHEN rating <= 2 THEN 'Very low rating (' || rating || ')' END], lambda x: x IS NOT NULL)"
)
QUALITY = (
    "SELECT count(*) AS records_received, (SELECT count(*) FROM {valid}) AS records_processed, "
    "(SELECT count(*) FROM {filled}) - (SELECT count(*) FROM {firsts}) AS duplicates_removed, "
    "count(*) - (SELECT count(*) FROM {filled}) AS missing_handled, "
    "(SELECT count(*) FROM {firsts}) - (SELECT count(*) FROM {valid}) AS short_removed, "
    "(SELECT count(*) FROM {valid}) AS valid_records FROM {src}"
)
SPACES = r"[\s\x00-\x1f\x7f\x{85}\p{Z}]+"
PARTS["docs"] = (
    [],
    f"SELECT doc_id, lang, trim(regexp_replace(coalesce(text, ''), {lit(SPACES)}, ' ', 'g')) AS text FROM documents",
)
PARTS["docs_filled"] = (["docs"], "SELECT doc_id, text FROM docs WHERE text <> ''")
PARTS["docs_firsts"] = (["docs_filled"], "SELECT min(doc_id) AS doc_id, text FROM docs_filled GROUP BY text")
PARTS["docs_valid"] = (
    ["docs_firsts"], "SELECT * FROM docs_firsts WHERE len(string_split(text, ' ')) >= 2"
)
EXPLORED = (
    "feedback_id, feedback, sentiment, emotion, topic, detected_issue, priority, sentiment_confidence"
)
KPI = (
    "SELECT total, positive, neutral, negative, high_priority, complaints, recurring_issues, "
    + ", ".join(f"{pct(c, 'total')} AS {c}_pct" for c in ("positive", "neutral", "negative"))
    + " FROM (SELECT count(*) AS total, "
    + ", ".join(f"count(*) FILTER (sentiment = {lit(s)}) AS {s.lower()}" for s in ("Positive", "Neutral", "Negative"))
    + ", count(*) FILTER (priority = 'HIGH') AS high_priority, count(*) FILTER (is_complaint) AS complaints, "
    "(SELECT count(*) FROM recurring) AS recurring_issues FROM enriched)"
)

_shares = ", ".join(f"{p} AS {c}" for c, p in zip(CLASSES, normalised("compound")))
PARTS["lex_kw"] = (
    ["lex_scores"],
    "SELECT feedback, CASE greatest(negative, neutral, positive) WHEN negative THEN 'Negative' WHEN neutral THEN 'Neutral' "
    "ELSE 'Positive' END AS label, round_even(greatest(negative, neutral, positive) * 100, 1) AS confidence "
    f"FROM (SELECT feedback, {_shares} FROM lex_scores)",
)
renamed(["sentiments", "emoted", "topiced", "issued", "enriched"], "lex_", kw="lex_kw")
# Words of other alphabets keep their edges as plain letters; the rules' words are ASCII.
PARTS["v_texts"] = (
    [],
    "SELECT feedback, low, low AS low2, low AS lower_text FROM (SELECT text AS feedback, "
    "regexp_replace(replace(lower(text), '’', chr(39)), '[^\\x00-\\x7f]', 'x', 'g') AS low "
    "FROM (SELECT DISTINCT text FROM conversations WHERE text IS NOT NULL))",
)
renamed(["kw", "emotion_found", "emotion_boosts", "emotion_sums", "emotion_scored", "emotions", "matches", "signals"],
        "v_", texts="v_texts")
PARTS["few"] = (["recurring"], "SELECT * FROM recurring WHERE rank <= 3")
renamed(["from_recurring", "recommended"], "few_", recurring="few")
PARTS["csv_told"] = (
    ["src"],
    f"SELECT CASE WHEN feedback IS NOT NULL THEN channel END AS channel, {CLEAN.format(c='feedback')} AS feedback FROM src",
)
PARTS["csv_filled"] = (["csv_told"], "SELECT * FROM csv_told WHERE feedback <> ''")
PARTS["csv_firsts"] = (["csv_filled"], "SELECT DISTINCT * FROM csv_filled")
PARTS["csv_valid"] = (["csv_firsts"], "SELECT * FROM csv_firsts WHERE len(string_split(feedback, ' ')) >= 2")

ORACLES: dict[str, tuple[list[str], str]] = {
    "read_feedback_table": (
        [], "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"),
    "csv_round_trip": (
        ["enriched"],
        "SELECT feedback_id, customer_id, product, channel, rating, feedback_category, feedback, sentiment, emotion, "
        "topic, detected_issue, priority, priority_score FROM enriched"),
    "normalize_headers": ([], "SELECT doc_id, lang AS label_1, source AS label_2, n_chars FROM documents"),
    "training_rows": (
        ["sentiments"],
        "SELECT feedback AS text, first(sentiment ORDER BY feedback_id) AS label FROM sentiments GROUP BY 1"),
    "preview": (["src"], "SELECT feedback_id, product, feedback FROM src ORDER BY feedback_id LIMIT 5"),
    "non_null_count": (["src"], "SELECT count(feedback) AS non_null, count(*) AS rows FROM src"),
    "text_lengths": (
        [],
        "SELECT 0::BIGINT AS position, 'text' AS column, avg(length(text)) AS avg_length FROM documents UNION ALL "
        "SELECT 1, 'lang', avg(length(lang)) FROM documents UNION ALL SELECT 2, 'source', avg(length(source)) "
        "FROM documents"),
    "feedback_column": ([], "SELECT 'utterance' AS column, count(text) AS values FROM conversations"),
    "date_column": ([], "SELECT 'o_orderdate' AS column, count(o_orderdate) AS values FROM orders"),
    "numeric_ranges": (
        [],
        " UNION ALL ".join(
            f"SELECT {i}::BIGINT AS position, '{c}' AS column, min({c})::DOUBLE AS low, max({c})::DOUBLE AS high, "
            f"count({c}) AS values FROM events" for i, c in enumerate(("event_id", "user_id", "value")))),
    "rating_column": (["src"], "SELECT 'points' AS column, count(customer_id) AS values FROM src"),
    "category_candidates": (
        ["src"],
        "SELECT 0::BIGINT AS position, 'feedback_category' AS column, count(DISTINCT feedback_category) AS labels, "
        "avg(length(feedback_category)) AS avg_length FROM src"),
    "category_column": (["src"], "SELECT 'feedback_category' AS column, count(feedback_category) AS values FROM src"),
    "csv_quality": (
        ["csv_told", "csv_filled", "csv_firsts", "csv_valid"],
        QUALITY.format(src="csv_told", filled="csv_filled", firsts="csv_firsts", valid="csv_valid")),
    "lexicon_sentiment": (
        ["clean", "lex_scores"], "SELECT feedback_id, compound FROM clean JOIN lex_scores USING (feedback)"),
    "lexicon_labels": (
        ["clean", "lex_kw"],
        "SELECT feedback_id, label AS sentiment, confidence AS sentiment_confidence FROM clean JOIN lex_kw USING (feedback)"),
    "enriched_with_lexicon": (
        ["lex_enriched"],
        "SELECT feedback_id, sentiment, sentiment_confidence, sentiment_source, emotion, detected_issue, is_complaint, "
        "priority FROM lex_enriched"),
    "training_folds": (
        ["sentiments"],
        "SELECT label, fold, (n - fold + 4) // 5 AS texts FROM (SELECT label, count(*) AS n FROM (SELECT "
        "first(sentiment ORDER BY feedback_id) AS label FROM sentiments GROUP BY feedback) GROUP BY 1), range(0, 5) f(fold) "
        "WHERE n > fold"),
    "top_terms": (["keywords"], "SELECT issue_label, keywords FROM keywords"),
    "recurring_themes_repeated_ids": (
        ["recurring", "themes"],
        "SELECT issue_label, occurrences, percentage, priority, theme_counts FROM recurring LEFT JOIN (SELECT issue_label, "
        "string_agg(count, ', ' ORDER BY theme) AS theme_counts FROM themes GROUP BY 1) USING (issue_label)"),
    "text_date_shapes": (
        [], "SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) AS count FROM orders GROUP BY 1"),
    "csv_codes": (
        [], "SELECT o_orderkey, o_orderkey || 'd' AS code, o_totalprice AS price, CASE WHEN o_orderkey % 3 = 0 "
        "THEN o_orderpriority || chr(10) || 'said \"no\"' ELSE o_orderstatus END AS note FROM orders"),
    "model_probabilities": (
        ["clean", "m_scores"],
        "SELECT feedback_id, round_even(exp(a) / (exp(a) + exp(b) + exp(c)), 9) AS negative, "
        "round_even(exp(b) / (exp(a) + exp(b) + exp(c)), 9) AS neutral, "
        "round_even(exp(c) / (exp(a) + exp(b) + exp(c)), 9) AS positive FROM clean JOIN m_scores USING (feedback)"),
    "text_dates": ([], "SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) AS count FROM orders GROUP BY 1"),
    "insight_rising_negatives_of_orders": ([], insight(
        10, "(SELECT max(n) AS months, avg(c) FILTER (i <= n // 2) AS first_half, avg(c) FILTER (i > n // 2) AS second_half "
        "FROM (SELECT count(*) AS c, row_number() OVER (ORDER BY strftime(o_orderdate, '%Y-%m')) AS i, count(*) OVER () AS n "
        "FROM orders WHERE o_orderkey % 10 < year(o_orderdate) - 1990 GROUP BY strftime(o_orderdate, '%Y-%m')))",
        "'Increasing Negative Sentiment Trend'",
        "'Negative feedback volume has increased over time. The trend shows growing customer dissatisfaction "
        "that requires urgent attention.'", "'critical'", "months >= 2 AND second_half > first_half * 1.2")),
    "recommendations_from_both": (["few_recommended"], "SELECT * FROM few_recommended"),
    "conversation_profile": (
        ["v_kw", "v_emotions", "v_matches", "v_signals"],
        "SELECT conv_id, turn, label AS sentiment, coalesce(match, " + lit(NO_ISSUE) + ") AS detected_issue, "
        + TEXT_POINTS + " AS priority_score FROM conversations c JOIN v_kw k ON k.feedback = c.text JOIN v_emotions e ON "
        "e.feedback = c.text JOIN v_matches m ON m.feedback = c.text JOIN v_signals s ON s.feedback = c.text"),
    "drop_missing": (["src"], "SELECT feedback_id, feedback FROM src WHERE feedback IS NOT NULL"),
    "clean_feedback": (
        ["src"], f"SELECT feedback_id, coalesce({CLEAN.format(c='feedback')}, '') AS feedback FROM src"),
    "clean_conversations": (
        [],
        "SELECT conv_id, turn, text, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END::BIGINT AS words "
        f"FROM (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), {lit(SPACES)}, ' ', 'g')) AS text "
        "FROM conversations)"),
    "drop_empty": (["filled"], "SELECT feedback_id, feedback FROM filled"),
    "dedupe_records": (["firsts"], "SELECT feedback_id, customer_id, product, feedback FROM firsts"),
    "dedupe_documents": (["docs"], "SELECT min(doc_id) AS doc_id, lang, text FROM docs GROUP BY lang, text"),
    "min_words": (
        ["docs"], "SELECT doc_id FROM docs WHERE text <> '' AND len(string_split(text, ' ')) >= 2"),
    "clean_records": (["clean"], "SELECT feedback_id, customer_id, channel, rating, feedback FROM clean"),
    "assign_feedback_id": (
        [], "SELECT conv_id, turn, role, row_number() OVER (ORDER BY conv_id, turn) AS feedback_id FROM conversations"),
    "keep_feedback_id": (["clean"], "SELECT feedback_id, feedback FROM clean"),
    "quality_report": (
        ["src", "filled", "firsts", "clean"],
        QUALITY.format(src="src", filled="filled", firsts="firsts", valid="clean")),
    "quality_of_documents": (
        ["docs", "docs_filled", "docs_firsts", "docs_valid"],
        QUALITY.format(src="docs", filled="docs_filled", firsts="docs_firsts", valid="docs_valid")),
    "rating_to_sentiment": (
        ["src"],
        "SELECT feedback_id, CASE WHEN rating BETWEEN 1 AND 5 THEN CASE WHEN rating <= 2 THEN 'Negative' "
        "WHEN rating < 4 THEN 'Neutral' ELSE 'Positive' END END AS sentiment FROM src"),
    "keyword_sentiment": (
        ["clean", "kw"], "SELECT feedback_id, negative, neutral, positive FROM clean JOIN kw USING (feedback)"),
    "compound_to_probabilities": (
        [],
        "SELECT o_orderkey, "
        + ", ".join(f"round_even({p}, 9) AS {c}" for c, p in zip(CLASSES, normalised("c")))
        + " FROM (SELECT o_orderkey, (o_orderkey % 201)::DOUBLE / 100 - 1 AS c FROM orders)"),
    "ensemble_probabilities": (["clean", "kw"], _ensemble()),
    "text_sentiment": (
        ["sentiments"],
        "SELECT feedback_id, text_label AS sentiment, text_confidence AS sentiment_confidence, 'text' AS "
        "sentiment_source FROM sentiments"),
    "score_sentiment": (
        ["sentiments"], "SELECT feedback_id, sentiment, sentiment_confidence, sentiment_source FROM sentiments"),
    "sentiment_agreement": (
        ["sentiments"],
        "SELECT count(rated) AS compared, avg((rated = text_label)::INT) AS agreement FROM sentiments"),
    "emotion_keyword_hits": (
        ["clean", "emotion_sums"],
        f"SELECT feedback_id, {', '.join(f'hits_{slug(e)}' for e in EMOTIONS)} FROM clean JOIN emotion_sums "
        "USING (feedback)"),
    "intensifier_boost": (
        ["clean", "emotion_sums"],
        f"SELECT feedback_id, {', '.join(f'boosted_{slug(e)}' for e in EMOTIONS)} FROM clean JOIN emotion_sums "
        "USING (feedback)"),
    "emotion_scores": (
        ["clean", "emotion_scored"],
        "SELECT feedback_id, " + ", ".join(f"round_even(e_{slug(e)}, 9) AS score_{slug(e)}" for e in EMOTIONS)
        + " FROM clean JOIN emotion_scored USING (feedback)"),
    "detect_emotion": (
        ["clean", "emotions"],
        "SELECT feedback_id, raw_emotion AS emotion, raw_confidence AS emotion_confidence FROM clean JOIN emotions "
        "USING (feedback)"),
    "score_emotion": (["emoted"], "SELECT feedback_id, sentiment, emotion, emotion_confidence FROM emoted"),
    "topic_scores": (
        ["clean", "topic_scored"],
        f"SELECT feedback_id, {', '.join(f'score_{slug(t)}' for t in TOPICS)} FROM clean JOIN topic_scored "
        "USING (feedback)"),
    "detect_topic": (
        ["clean", "topics"],
        "SELECT feedback_id, topic_detected, confidence AS topic_confidence FROM clean JOIN topics USING (feedback)"),
    "score_topic": (
        ["topiced"], "SELECT feedback_id, topic_detected, topic, topic_confidence, topic_source FROM topiced"),
    "topic_distribution": (["topiced"], "SELECT topic, count(*) AS count FROM topiced GROUP BY 1"),
    "topic_agreement": (
        ["topiced"],
        "SELECT compared, agreed, agreed::DOUBLE / compared AS agreement FROM (SELECT count(*) FILTER (topic_source = "
        "'dataset') AS compared, count(*) FILTER (topic_source = 'dataset' AND topic = topic_detected) AS agreed "
        "FROM topiced)"),
    "issue_matches": (
        ["clean", "texts"],
        "SELECT feedback_id, " + ", ".join(
            f"regexp_matches(low2, {lit(p)}) AS is_{issue_slug(i)}" for i, p in ISSUE_PATTERNS.items())
        + " FROM clean JOIN texts USING (feedback)"),
    "detect_issue": (["issued"], "SELECT feedback_id, sentiment, detected_issue, issue_confidence FROM issued"),
    "is_complaint": (["issued"], "SELECT feedback_id, sentiment, is_complaint FROM issued"),
    "issue_summary": (
        ["summary"],
        "SELECT detected_issue, occurrences, round_even(avg_confidence, 9) AS avg_confidence, percentage, "
        "avg_sentiment FROM summary"),
    "issue_priority_mode": (
        ["enriched"],
        "SELECT detected_issue, occurrences, priority FROM (SELECT detected_issue, priority, sum(count(*)) OVER "
        "(PARTITION BY detected_issue)::BIGINT AS occurrences, row_number() OVER (PARTITION BY detected_issue "
        f"ORDER BY count(*) DESC, priority) AS rn FROM enriched WHERE detected_issue <> {lit(NO_ISSUE)} GROUP BY 1, 2) "
        "WHERE rn = 1 AND priority IN ('HIGH', 'MEDIUM')"),
    "priority_score": (["enriched"], "SELECT feedback_id, priority_score FROM enriched"),
    "score_priority": (["enriched"], "SELECT feedback_id, priority, priority_score FROM enriched"),
    "priority_reasons": (
        ["enriched"], f"SELECT feedback_id, array_to_string({REASONS}, '; ') AS reasons FROM enriched"),
    "priority_distribution": (
        ["enriched"],
        "SELECT " + ", ".join(f"count(*) FILTER (priority = '{p}') AS {p}" for p in ("HIGH", "MEDIUM", "LOW"))
        + " FROM enriched"),
    "enriched_rows": (
        ["enriched"],
        "SELECT feedback_id, sentiment, sentiment_confidence, sentiment_source, emotion, emotion_confidence, topic, "
        "topic_confidence, topic_source, detected_issue, issue_confidence, is_complaint, priority, priority_score "
        "FROM enriched"),
    "complaint_rows": (["complaints"], "SELECT feedback_id, issue_label FROM complaints"),
    "recurring_counts": (
        ["recurring"], "SELECT issue_label, occurrences, percentage, avg_sentiment FROM recurring"),
    "recurring_priority": (["recurring"], "SELECT issue_label, priority FROM recurring"),
    "recurring_rating": (["recurring"], "SELECT issue_label, avg_rating FROM recurring"),
    "sample_feedbacks": (["samples"], "SELECT * FROM samples"),
    "top_product": (["products"], "SELECT * FROM products"),
    "top_channel": (["channels"], "SELECT * FROM channels"),
    "ranked_terms": (["c_mass"], "SELECT * FROM c_mass"),
    "similarity_links": (["c_links"], "SELECT * FROM c_links"),
    "theme_members": (["c_members"], "SELECT * FROM c_members"),
    "theme_examples": (["themes"], "SELECT * FROM themes"),
    "document_theme_members": (["d_members"], "SELECT * FROM d_members"),
    "recurring_issues": (
        ["recurring", "samples", "products", "channels", "themes", "keywords"],
        "SELECT rank, issue_label, occurrences, percentage, avg_sentiment, priority, avg_rating, cluster_id, "
        "top_product, top_product_count, top_channel, top_channel_count, samples, themes, theme_counts, keywords "
        "FROM recurring LEFT JOIN keywords USING (issue_label) "
        "LEFT JOIN samples USING (issue_label) LEFT JOIN products USING (issue_label) LEFT JOIN channels USING "
        "(issue_label) LEFT JOIN (SELECT issue_label, string_agg(example, ' | ' ORDER BY theme) AS themes, "
        "string_agg(count, ', ' ORDER BY theme) AS theme_counts FROM themes GROUP BY 1) USING (issue_label)"),
    "with_period": (["src"], "SELECT feedback_id, strftime(date, '%Y-%m') AS period FROM src WHERE date IS NOT NULL"),
    "volume_trend": (
        ["clean"], "SELECT strftime(date, '%Y-%m') AS period, count(*) AS count FROM clean GROUP BY 1"),
    "event_volume_trend": ([], "SELECT strftime(ts, '%Y-%m') AS period, count(*) AS count FROM events GROUP BY 1"),
    "sentiment_trend": (["sentiment_months"], "SELECT * FROM sentiment_months"),
    "topic_trend": (
        ["topiced"], "SELECT strftime(date, '%Y-%m') AS period, topic, count(*) AS count FROM topiced GROUP BY 1, 2"),
    "issue_trend": (
        ["enriched"],
        f"SELECT period, count(*) AS complaints FROM enriched WHERE detected_issue <> {lit(NO_ISSUE)} GROUP BY 1"),
    **INSIGHTS,
    "rising_negatives": (
        ["halves"],
        "SELECT months, round_even(first_half, 6) AS first_half, round_even(second_half, 6) AS second_half FROM halves"),
    "all_insights": (["insights"], "SELECT * FROM insights"),
    "recommend_from_recurring": (["from_recurring"], "SELECT * FROM from_recurring"),
    "recommend_from_summary": (["from_summary"], "SELECT * FROM from_summary"),
    "recommendations": (
        ["recommended"], "SELECT * FROM recommended WHERE priority IN ('HIGH', 'MEDIUM')"),
    "text_only_profile": (["clean", "kw", "emotions", "topics", "matches", "signals", ACTION_TABLE], _single()),
    "kpi_summary": (["enriched", "recurring"], KPI),
    "quality_table": (
        ["src", "filled", "firsts", "clean"],
        "SELECT metric, count FROM (" + QUALITY.format(src="src", filled="filled", firsts="firsts", valid="clean")
        + ") q, LATERAL (VALUES ('Records Received', q.records_received), ('Duplicates Removed', "
        "q.duplicates_removed), ('Missing Values Handled', q.missing_handled), ('Short Records Removed', "
        "q.short_removed), ('Valid Records Processed', q.valid_records)) v(metric, count)"),
    "sentiment_table": (
        ["sentiments"],
        f"SELECT s.sentiment, count(e.feedback_id) AS count, {pct('count(e.feedback_id)', '(SELECT count(*) FROM sentiments)')} "
        "AS percentage FROM (VALUES ('Positive'), ('Neutral'), ('Negative')) s(sentiment) LEFT JOIN sentiments e "
        "ON e.sentiment = s.sentiment GROUP BY 1"),
    "recurring_table": (
        ["recurring"],
        "SELECT rank, issue_label, occurrences, percentage, avg_sentiment, priority FROM recurring WHERE rank <= 10"),
    "report_insights": (["insights"], "SELECT * FROM insights ORDER BY ord LIMIT 8"),
    "report_recommendations": (
        ["recommended"], "SELECT ord, issue, action, priority, department FROM recommended ORDER BY ord LIMIT 8"),
    "emotion_distribution": (["enriched"], "SELECT emotion, count(*) AS count FROM enriched GROUP BY 1"),
    "sentiment_distribution": (["enriched"], "SELECT sentiment, count(*) AS count FROM enriched GROUP BY 1"),
    "explore": (
        ["enriched"],
        f"SELECT {EXPLORED} FROM enriched WHERE sentiment IN ('Negative', 'Neutral') AND priority IN "
        "('HIGH', 'MEDIUM') AND regexp_matches(feedback, '(?i)refund|ORDER') ORDER BY feedback_id LIMIT 200"),
    "explore_count": (
        ["enriched"],
        "SELECT count(*) AS rows FROM enriched WHERE topic IN ('Delivery', 'Billing') AND "
        "regexp_matches(feedback, '(?i)(box|item) ')"),
    "distinct_topics": (["enriched"], "SELECT DISTINCT topic FROM enriched"),
}


def oracle_sql() -> dict[str, str]:
    return {name: statement(needs, sql) for name, (needs, sql) in ORACLES.items()}

"""The pipeline's input tables, derived from the driver's tables.

Each text is plain SQL that runs unchanged in Spark and DuckDB; `{name}` stands for a table or an
earlier view. Every row and every whole text takes part: a document's first line is its title, the
rest its body, exact copies share a url, and some scores, dates and sources are junk on purpose.
"""

from __future__ import annotations

AS_OF = "2024-01-31 00:00:00"
BURST_DAY = "2024-01-20"

RAW_POSTS = """
SELECT doc_id AS seq,
  CASE WHEN doc_id % 10 = 0 THEN 'blog' WHEN doc_id % 2 = 1 THEN 'reddit' ELSE 'news' END AS source,
  split_part(text, chr(10), 1) AS title,
  substring(text, length(split_part(text, chr(10), 1)) + 2) AS body,
  concat('https://www.reddit.com/r/', lang, '/comments/', md5(text), '/') AS url,
  CASE WHEN doc_id % 17 = 0 THEN 'n/a' ELSE concat('2024-01-', lpad(CAST(1 + (doc_id * 7) % 30 AS STRING), 2, '0'),
    'T', lpad(CAST(doc_id % 24 AS STRING), 2, '0'), ':00:00.000+00:00') END AS created_at,
  CASE WHEN doc_id % 13 = 0 THEN 'n/a' ELSE CAST(n_chars % 997 AS STRING) END AS score,
  lang AS subreddit, source AS author
FROM {documents}
"""

# Daily activity of a user stands for the daily score of the forum posts linked to that user.
POST_SCORES = """
SELECT p.url AS url, s.date AS date, s.score AS score
FROM (SELECT url, seq % (SELECT 2 * (1 + max(user_id)) FROM {events}) AS user_id FROM {raw_posts} WHERE source = 'reddit') p
JOIN (SELECT user_id, CAST(ts AS DATE) AS date, count(*) AS score
      FROM {events} GROUP BY user_id, CAST(ts AS DATE)) s
ON p.user_id = s.user_id
"""

# The daily peaks of a user stand for the search interest in the title of the linked news posts.
SEARCH_INTEREST = """
SELECT k.keyword AS keyword, CAST(e.date AS TIMESTAMP) AS ts, e.value AS value
FROM (SELECT DISTINCT keywords AS keyword, seq % (SELECT 2 * (1 + max(user_id)) FROM {events}) AS user_id
      FROM {news_keywords} WHERE keywords <> '') k
JOIN (SELECT user_id, CAST(ts AS DATE) AS date, max(value) AS value
      FROM {events} GROUP BY user_id, CAST(ts AS DATE)) e
ON k.user_id = e.user_id
"""

SNAPSHOTS = """
SELECT concat('https://www.reddit.com/r/', lang, '/comments/', md5(text), '/x/') AS url,
  CAST('2024-01-30' AS DATE) AS date, n_chars % 50 AS score
FROM {documents}
"""

# English forum posts are tracked already, the others not: both the insert and the keep path run.
TRACKED = """
SELECT url, 'general' AS category, 'reddit' AS source, CAST('2024-01-02' AS DATE) AS added_date
FROM (SELECT DISTINCT url FROM {raw_posts} WHERE source = 'reddit' AND subreddit = 'en') t
"""

SUBMISSIONS = """
SELECT doc_id AS seq, concat('/r/', lang, '/comments/', md5(text), '/') AS permalink,
  CAST(1704067200 + doc_id * 977 AS DOUBLE) AS created_utc,
  substring(text, length(split_part(text, chr(10), 1)) + 2) AS selftext,
  split_part(text, chr(10), 1) AS title, n_chars % 997 AS score, lang AS subreddit,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END AS author
FROM {documents}
"""

RSS_ENTRIES = """
SELECT CAST(page_id % 4 AS STRING) AS feed, page_id AS pos, url AS link,
  CASE page_id % 9 WHEN 0 THEN NULL
    WHEN 1 THEN concat('2024-01-', lpad(CAST(1 + page_id % 30 AS STRING), 2, '0'), 'T08:00:00Z')
    WHEN 2 THEN concat(split_part('Mon,Tue,Wed,Thu,Fri,Sat,Sun', ',', CAST(1 + page_id % 7 AS INT)), ', 0', CAST(1 + page_id % 7 AS STRING), ' Jan 2024 10:00:00 GMT')
    WHEN 3 THEN 'Wed, 03 Jan 2024 10:00:00 +0530'
    WHEN 4 THEN '2024-01-01T10:00:00+05:00'
    WHEN 5 THEN '3 Jan 24 10:15 EST'
    WHEN 6 THEN '2024-01-07'
    WHEN 7 THEN '2024-01-01T23:30-02:00'
    ELSE 'last Tuesday' END AS published,
  CASE WHEN page_id % 6 = 0 THEN NULL ELSE '2024-01-05T06:07:08Z' END AS updated,
  CASE WHEN page_id % 5 = 0 THEN '' ELSE html END AS summary,
  html AS description, concat('Page ', CAST(page_id AS STRING)) AS title, NULL AS author
FROM {pages}
"""

_CATEGORY_ROWS = [
    ("the", "tech", 0.11), ("of", "politics", 0.21), ("and", "sports", 0.23), ("to", "business", 0.31),
    ("in", "entertainment", 0.17), ("a", "science", 0.29), ("is", "environment", 0.37),
    ("that", "health", 0.41), ("de", "politics", 0.19), ("la", "business", 0.22),
    ("der", "sports", 0.27), ("die", "environment", 0.33), ("und", "health", 0.43),
    ("en", "entertainment", 0.13), ("que", "science", 0.35), ("le", "tech", 0.39),
    ("les", "health", 0.47), ("el", "sports", 0.53), ("los", "environment", 0.59),
    ("thtion", "tech", 1.7), ("attion", "politics", 1.9), ("ertion", "science", 2.3),
    ("the", "business", 0.07), ("of", "general", 0.05),
    ("THE", "tech", 0.02), ("the", "tech", 0.03), ("of", "politics", None), ("Met", "sports", 0.5),
]
_VALENCE_ROWS = [
    ("the", 0.1), ("of", -0.2), ("and", 0.15), ("to", -0.1), ("is", 0.3), ("that", -0.4),
    ("de", 0.2), ("la", -0.3), ("der", -0.2), ("die", 0.1), ("und", 0.3), ("en", 0.1),
    ("que", -0.5), ("le", 0.4), ("les", -0.6), ("el", 0.7), ("los", -0.8), ("thtion", 1.9),
    ("attion", -1.3), ("ertion", 2.1), ("ontion", -2.4), ("antion", 1.1),
    ("THE", 0.05), ("the", None), ("Of", -0.1),
]
_GAZETTEER_ROWS = [
    ("Thtion", "PERSON"), ("Attion", "PRODUCT"), ("anea eriner thanea", "EVENT"),
    ("eriner thanea", "ORG"), ("in onbleea", "GPE"), ("esndha reedes ha", "ORG"),
    ("ingre onanshat", "PERSON"), ("thanedble the anea eriner", "EVENT"), ("ciónas", "GPE"),
    ("ertion", "PRODUCT"), ("queque", "PERSON"), ("ntre in onbleea of", "ORG"),
    ("and attion to thanedble the", "ORG"), ("The-And attion", "EVENT"), ("eriner", "DATE"),
]
_TAG_ROWS = [
    ("the", "D", -10), ("The", "D", -5), ("a", "D", -20), ("of", "P", -10), ("to", "P", -120), ("to", "X", -150), ("in", "P", -15),
    ("and", "X", -10), ("is", "V", -10), ("was", "V", -12), ("be", "V", -14), ("it", "X", -30), ("that", "D", -210), ("that", "X", -190),
    ("de", "P", -10), ("la", "D", -12), ("der", "D", -11), ("die", "D", -13), ("und", "X", -10), ("en", "P", -22), ("que", "X", -25),
    ("le", "D", -17), ("les", "D", -18), ("el", "D", -19), ("los", "D", -21), ("for", "P", -33), ("on", "P", -27),
    ("thtion", "N", -40), ("ertion", "A", -80), ("ertion", "N", -95), ("antion", "V", -60), ("antion", "N", -70), ("ontion", "A", -35),
    ("", "N", -610), ("", "A", -840), ("", "V", -905), ("", "X", -1900), ("ha", "?", -1), ("ha", "V", None),
]
_MOVE_ROWS = [
    ("", "D", -300), ("", "A", -700), ("", "N", -500), ("", "V", -1200), ("", "P", -800), ("", "X", -900),
    ("D", "A", -420), ("D", "N", -130), ("D", "X", -2500), ("A", "A", -900), ("A", "N", -210), ("A", "X", -1500), ("A", "P", -1700),
    ("N", "N", -950), ("N", "V", -480), ("N", "P", -520), ("N", "X", -610), ("N", "D", -1900), ("N", "A", -2100),
    ("V", "D", -390), ("V", "A", -980), ("V", "N", -870), ("V", "P", -660), ("V", "X", -1010), ("V", "V", -1900),
    ("P", "D", -310), ("P", "A", -900), ("P", "N", -560), ("P", "P", -2400), ("P", "X", -2300), ("P", "V", -1800),
    ("X", "D", -520), ("X", "A", -910), ("X", "N", -700), ("X", "V", -640), ("X", "P", -1100), ("X", "X", -1300), ("X", "X", -1400),
]
_SHIFTER_ROWS = [
    ("und", "booster", 0.293), ("in", "booster", -0.293), ("on", "booster", 0.293), ("In", "booster", 0.1), ("en", "booster", 0.2),
    ("was", "negation", None), ("les", "negation", None), ("no", "negation", None), ("de", "negation", None), ("it", "turn", None),
    ("un", "turn", None), ("ha", "other", 1.0),
]


def _values(rows: list[tuple], names: str, casts: str) -> str:
    body = ", ".join(
        "(" + ", ".join(f"'{v}'" if isinstance(v, str) else "NULL" if v is None else repr(v) for v in row) + ")"
        for row in rows
    )
    return f"SELECT {casts} FROM (VALUES {body}) AS t({names})"


CATEGORY_LEXICON = _values(
    _CATEGORY_ROWS, "term, category, weight", "term, category, CAST(weight AS DOUBLE) AS weight"
)
VALENCE_LEXICON = _values(_VALENCE_ROWS, "term, valence", "term, CAST(valence AS DOUBLE) AS valence")
GAZETTEER = _values(_GAZETTEER_ROWS, "entity, type", "entity, type")
TAG_LEXICON = _values(_TAG_ROWS, "term, tag, score", "term, tag, CAST(score AS BIGINT) AS score")
TAG_MOVES = _values(_MOVE_ROWS, "previous, tag, score", "previous, tag, CAST(score AS BIGINT) AS score")
SHIFTERS = _values(_SHIFTER_ROWS, "term, kind, weight", "term, kind, CAST(weight AS DOUBLE) AS weight")

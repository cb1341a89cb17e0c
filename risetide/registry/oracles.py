"""Oracle SQL (DuckDB) for the registered queries.

Each query is assembled from the common table expressions below, which restate the semantics row by
row, independently of the Spark expressions.
"""

from __future__ import annotations

import re

from ..vocab import KEYWORD_STOPWORDS, RAKE_STOPWORDS, TOPIC_STOPWORDS
from ..schema import VALID_CATEGORIES
from . import views

_NOW = f"TIMESTAMP '{views.AS_OF}'"
_DAY = f"DATE '{views.AS_OF[:10]}'"
_BURST_DAY = f"DATE '{views.BURST_DAY}'"
_WORD = r"[\p{L}\p{N}_]+"
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _strip(c: str) -> str:
    out = f"regexp_replace(coalesce({c}, ''), '<[^>]+>', '', 'g')"
    for old, new in (
        ("'&nbsp;'", "' '"), ("'&amp;'", "'&'"), ("'&lt;'", "'<'"), ("'&gt;'", "'>'"),
        ("chr(8203)", "''"), ("chr(65533)", "''"),
    ):
        out = f"replace({out}, {old}, {new})"
    return f"trim(regexp_replace({out}, '{_SPACE}', ' ', 'g'))"


def _valid(t: str) -> str:
    stop = "|".join(TOPIC_STOPWORDS)
    return (
        f"(length({t}) >= 4 AND NOT contains({t}, 'nan') AND NOT contains({t}, 'none') "
        f"AND NOT regexp_matches({t}, '(^| )({stop})( |$)'))"
    )


def _view(text: str, **names: str) -> str:
    plain = ("documents", "events", "pages", "raw_posts", "news_keywords")
    return text.format(**{n: names.get(n, n) for n in plain if "{" + n + "}" in text})


def _grams(source: str, key: str, low: int, high: int) -> str:
    """(key, n, j, gram) from (key, j, w) rows with consecutive j."""
    leads = ", ".join(
        f"lead(w, {k}) OVER (PARTITION BY {key} ORDER BY j) AS w{k}" for k in range(1, high)
    )
    parts = []
    for n in range(low, high + 1):
        gram = " || ' ' || ".join(["w"] + [f"w{k}" for k in range(1, n)])
        last = "w" if n == 1 else f"w{n - 1}"
        parts.append(f"SELECT {key}, {n} AS n, j, {gram} AS gram FROM g WHERE {last} IS NOT NULL")
    return f"WITH g AS (SELECT {key}, j, w, {leads} FROM {source}) " + " UNION ALL ".join(parts)


def _growth(latest: str, previous: str) -> str:
    return (
        f"greatest(0, least(100, 50 + 25 * greatest(-1, least(1, CASE WHEN {previous} = 0 THEN 0 "
        f"ELSE CAST({latest} - {previous} AS DOUBLE) / greatest({previous}, 1) END))))"
    )


_RANKED_CATEGORIES = "CASE category " + " ".join(
    f"WHEN '{c}' THEN {i}" for i, c in enumerate(VALID_CATEGORIES)
) + " END"

_CTES: dict[str, str] = {
    "raw_posts": _view(views.RAW_POSTS),
    "first_rows": "SELECT * FROM raw_posts QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1",
    "posts": f"""SELECT seq, source, url, {_strip('title')} AS title, {_strip('body')} AS body,
        substring(split_part(split_part(replace(trim(created_at), 'T', ' '), '.', 1), '+', 1), 1, 19) AS created_at,
        coalesce(CAST(trunc(TRY_CAST(trim(score) AS DOUBLE)) AS BIGINT), 0) AS score, subreddit, author
        FROM first_rows WHERE source IN ('reddit', 'news')""",
    "timed": """SELECT *, coalesce(try_strptime(created_at, '%Y-%m-%d %H:%M:%S'),
        try_strptime(created_at, '%Y-%m-%d')) AS created FROM posts""",
    "words": f"""SELECT seq, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM
        (SELECT seq, regexp_extract_all(title || ' ' || body, '{_WORD}') AS ws FROM posts)""",
    "lower_words": "SELECT seq, i, lower(w) AS w FROM words",
    "title_words": f"""SELECT seq, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM
        (SELECT seq, regexp_extract_all(title, '{_WORD}') AS ws FROM posts)""",
    "category_lexicon": views.CATEGORY_LEXICON,
    "valence_lexicon": views.VALENCE_LEXICON,
    "gazetteer": views.GAZETTEER,
    "category_sums": """SELECT seq, category, round(sum(weight), 9) AS weight
        FROM lower_words JOIN category_lexicon ON w = lower(term) GROUP BY ALL""",
    "categories": f"""SELECT seq, category FROM category_sums WHERE weight > 0
        QUALIFY row_number() OVER (PARTITION BY seq ORDER BY weight DESC, {_RANKED_CATEGORIES}) = 1""",
    "classified": """SELECT p.*, coalesce(c.category, 'general') AS category
        FROM timed p LEFT JOIN categories c USING (seq)""",
    "valences": "SELECT seq, sum(valence) AS s FROM lower_words JOIN valence_lexicon ON w = lower(term) GROUP BY seq",
    "sentiments": """SELECT seq, round(coalesce(s, 0) / sqrt(coalesce(s, 0) ** 2 + 15), 4) + 0 AS sentiment_score
        FROM posts LEFT JOIN valences USING (seq)""",
    "labels_of": """SELECT seq, sentiment_score, CASE WHEN sentiment_score >= 0.02 THEN 'positive'
        WHEN sentiment_score <= -0.02 THEN 'negative' ELSE 'neutral' END AS sentiment_label FROM sentiments""",
    # keywords
    "query_text": "SELECT seq, CASE WHEN title <> '' THEN title ELSE body END AS t FROM posts",
    "query_words": f"""SELECT seq, w, min(i) AS i FROM (SELECT seq, generate_subscripts(ws, 1) AS i, unnest(ws) AS w
        FROM (SELECT seq, regexp_extract_all(t, '{_WORD}') AS ws FROM query_text))
        WHERE length(w) > 2 AND lower(w) NOT IN {_in(KEYWORD_STOPWORDS)} GROUP BY seq, w""",
    "longest": """SELECT seq, string_agg(w, ' ' ORDER BY r) AS k FROM (SELECT *, row_number() OVER
        (PARTITION BY seq ORDER BY length(w) DESC, i) AS r FROM query_words) WHERE r <= 3 GROUP BY seq""",
    "keyworded": """SELECT seq, coalesce(k, substring(t, 1, 50)) AS keywords
        FROM query_text LEFT JOIN longest USING (seq)""",
    # trend
    "history": "SELECT url, date, max(score) AS score FROM (" + _view(views.POST_SCORES) + ") GROUP BY url, date",
    "growth": f"""SELECT url, {_growth('latest', 'previous')} AS growth_score FROM (SELECT url,
        max(score) FILTER (r = 1) AS latest, max(score) FILTER (r = 2) AS previous FROM (SELECT *,
        row_number() OVER (PARTITION BY url ORDER BY date DESC) AS r FROM history) GROUP BY url)
        WHERE previous IS NOT NULL""",
    "no_growth": "SELECT * FROM growth WHERE false",
    "news_keywords": "SELECT seq, keywords FROM keyworded JOIN posts USING (seq) WHERE source = 'news'",
    "interest_tail": f"""SELECT keyword, value, row_number() OVER (PARTITION BY keyword ORDER BY ts DESC, value DESC) AS r
        FROM ({_view(views.SEARCH_INTEREST)}) WHERE value IS NOT NULL QUALIFY r <= 4""",
    "interest": f"""SELECT keyword, CASE WHEN n = 1 THEN latest ELSE {_growth('latest', 'previous')} END AS interest
        FROM (SELECT keyword, count(*) AS n, max(value) FILTER (r = 1) AS latest, arg_max(value, r) AS previous
        FROM interest_tail GROUP BY keyword)""",
}


def _trend(growth: str, news: str) -> str:
    velocity = (
        f"CASE WHEN created IS NULL THEN 50.0 ELSE score / greatest((epoch_us({_NOW}) "
        "- epoch_us(created)) / 3.6e9, 0.5) END"
    )
    return f"""SELECT c.* EXCLUDE (v, growth_score), CASE WHEN source = 'news' THEN {news}
        WHEN growth_score IS NOT NULL THEN growth_score
        WHEN max(v) OVER () = min(v) OVER () THEN 50.0
        ELSE (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) * 100 END AS trend_score
        FROM (SELECT p.*, growth_score, CASE WHEN source = 'reddit' AND growth_score IS NULL THEN {velocity} END AS v
              FROM classified p LEFT JOIN {growth} USING (url)) c"""


_CTES["scored"] = _trend("growth", "50.0")
_CTES["scored_velocity"] = _trend("no_growth", "50.0")
_CTES["scored_interest"] = f"""SELECT t.* REPLACE (CASE WHEN source = 'news' THEN coalesce(interest, 50.0)
    ELSE trend_score END AS trend_score), keywords FROM scored t JOIN keyworded USING (seq)
    LEFT JOIN interest ON keyword = CASE WHEN trim(keywords) <> '' THEN substring(trim(keywords), 1, 50) END"""
_CTES["full_posts"] = """SELECT s.*, sentiment_score, sentiment_label, keywords FROM scored s
    JOIN labels_of USING (seq) JOIN keyworded USING (seq)"""
_CTES["bucketed"] = """SELECT *, CASE WHEN trend_score >= 70 THEN 'rising' WHEN trend_score <= 30 THEN 'falling'
    ELSE 'new' END AS bucket FROM scored"""


def _top(partition: str) -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY {partition} ORDER BY
        CASE bucket WHEN 'rising' THEN -trend_score WHEN 'falling' THEN trend_score END,
        CASE bucket WHEN 'new' THEN created_at END DESC NULLS LAST, seq) AS rank FROM bucketed"""


_CTES.update({
    "top_category": _top("category, bucket"),
    "top_overall": _top("bucket"),
    # history and tracking
    "tracked": _view(views.TRACKED),
    "snapshots": _view(views.SNAPSHOTS),
    "tracked_ids": "SELECT url, regexp_extract(url, '(?i)/comments/([a-z0-9]+)/', 1) AS sid FROM tracked",
    "refetched": """SELECT t.url, s.date, max(s.score) AS score FROM tracked_ids t JOIN
        (SELECT regexp_extract(url, '(?i)/comments/([a-z0-9]+)/', 1) AS sid, date, score FROM snapshots) s
        ON t.sid = s.sid AND t.sid <> '' GROUP BY t.url, s.date""",
    "merged": f"""SELECT url, date, max(score) AS score FROM (SELECT * FROM (
        SELECT url, date, score, 0 AS writer FROM history UNION ALL SELECT url, date, score, 1 FROM refetched
        UNION ALL SELECT url, {_DAY}, score, 2 FROM posts) WHERE date >= {_DAY} - 14
        QUALIFY writer = max(writer) OVER (PARTITION BY url, date)) GROUP BY url, date""",
    "steps": """SELECT url, r, CASE WHEN older IS NULL THEN 'none' WHEN score < older THEN 'losing'
        WHEN score = older OR abs(score - older) / greatest(older, 1) < 0.01 THEN 'stale' ELSE 'growth' END AS step
        FROM (SELECT url, score, row_number() OVER w AS r, lead(score) OVER w AS older FROM history
              WINDOW w AS (PARTITION BY url ORDER BY date DESC))""",
    "first_stop": "SELECT url, min(r) AS stop FROM steps WHERE step IN ('none', 'growth') GROUP BY url",
    "kept_steps": """SELECT url, r, step, max(r) OVER (PARTITION BY url) AS final FROM steps JOIN first_stop USING (url)
        WHERE r < stop""",
    "last_step": "SELECT url, step AS last, r AS final FROM kept_steps WHERE r = final",
    "other_step": """SELECT k.url, max(k.r) AS r FROM kept_steps k JOIN last_step l ON k.url = l.url AND k.step <> l.last
        GROUP BY k.url""",
    "runs": """SELECT u.url,
        CAST(CASE WHEN last = 'losing' THEN final - coalesce(o.r, 0) ELSE 0 END AS BIGINT) AS days_losing,
        CAST(CASE WHEN last = 'stale' THEN final - coalesce(o.r, 0) ELSE 0 END AS BIGINT) AS days_stale
        FROM (SELECT DISTINCT url FROM history) u LEFT JOIN last_step l ON u.url = l.url
        LEFT JOIN other_step o ON u.url = o.url""",
    # phrases
    "content": f"""SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY i) AS j, w FROM lower_words
        WHERE length(w) > 2 AND w NOT IN {_in(KEYWORD_STOPWORDS)}""",
    "text_grams": _grams("content", "seq", 2, 4),
    "all_words": "SELECT seq, i AS j, w FROM lower_words",
    "all_grams": _grams("all_words", "seq", 1, 6),
    "names": f"""SELECT DISTINCT array_to_string(regexp_extract_all(lower(entity), '{_WORD}'), ' ') AS name FROM gazetteer
        WHERE type IN ('PERSON', 'ORG', 'GPE', 'EVENT', 'PRODUCT')""",
    "found_entities": "SELECT DISTINCT seq, gram AS entity FROM all_grams JOIN names ON gram = name",
    "entity_order": """SELECT seq, gram, min(n) AS n, min(j) AS j FROM all_grams
        JOIN names ON gram = name GROUP BY seq, gram""",
    "keyword_words": f"""SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY i) AS j, w FROM (
        SELECT seq, generate_subscripts(ws, 1) AS i, lower(unnest(ws)) AS w FROM
        (SELECT seq, regexp_extract_all(keywords, '{_WORD}') AS ws FROM keyworded))
        WHERE length(w) >= 2 AND w NOT IN {_in(TOPIC_STOPWORDS)}""",
    "keyword_grams": _grams("keyword_words", "seq", 2, 3),
    "keyword_phrases": f"""SELECT seq, gram FROM keyword_grams WHERE {_valid('gram')}
        QUALIFY row_number() OVER (PARTITION BY seq ORDER BY n, j) <= 8""",
    "pieces": rf"""SELECT seq, generate_subscripts(ps, 1) AS i, unnest(ps) AS w FROM (SELECT seq,
        regexp_extract_all(lower(title || ' ' || body), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]+') AS ps FROM posts)""",
    "breaks": rf"""SELECT *, (w IN {_in(RAKE_STOPWORDS)} OR NOT regexp_matches(w, '^[\p{{L}}\p{{N}}_]')) AS brk FROM pieces""",
    "run_words": """SELECT seq, i, w, run, count(*) OVER (PARTITION BY seq, run) AS n FROM (SELECT *,
        sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY seq ORDER BY i) AS run FROM breaks) WHERE NOT brk""",
    "word_ratio": "SELECT seq, w, sum(n) / count(*) AS ratio FROM run_words GROUP BY seq, w",
    "key_phrases": """SELECT seq, run, string_agg(w, ' ' ORDER BY i) AS phrase, round(sum(ratio), 9) AS score
        FROM run_words JOIN word_ratio USING (seq, w) GROUP BY seq, run""",
    "best_phrases": """SELECT *, row_number() OVER (PARTITION BY seq ORDER BY score DESC, phrase DESC, run) AS rank
        FROM key_phrases QUALIFY rank <= 5""",
    "base_phrases": """SELECT seq, gram AS phrase FROM text_grams
        UNION SELECT seq, entity FROM found_entities WHERE len(string_split(entity, ' ')) BETWEEN 2 AND 4
        UNION SELECT seq, phrase FROM best_phrases
          WHERE len(string_split(phrase, ' ')) BETWEEN 2 AND 5 AND length(phrase) > 4
        UNION SELECT seq, gram FROM keyword_phrases""",
    "few_phrases": """SELECT seq FROM posts LEFT JOIN base_phrases USING (seq)
        GROUP BY seq HAVING count(phrase) < 3""",
    "post_phrases": f"""SELECT seq, phrase FROM base_phrases UNION ALL
        SELECT seq, lower(w) FROM title_words JOIN few_phrases USING (seq)
        WHERE length(w) >= 4 AND lower(w) NOT IN {_in(TOPIC_STOPWORDS)}""",
    # topics
    "terms": f"""SELECT seq, phrase AS term, category, source, trend_score, created FROM post_phrases
        JOIN scored USING (seq) WHERE {_valid('phrase')}""",
    "scoped_terms": """SELECT 'all' AS scope, '' AS scope_key, term, trend_score FROM terms
        UNION ALL SELECT 'category', category, term, trend_score FROM terms
        UNION ALL SELECT 'source', source, term, trend_score FROM terms""",
    "rising_posts": "SELECT * FROM scored WHERE trend_score >= 70",
    "scope_totals": """SELECT 'all' AS scope, '' AS scope_key, count(*) AS n FROM rising_posts
        UNION ALL SELECT 'category', category, count(*) FROM rising_posts GROUP BY category
        UNION ALL SELECT 'source', source, count(*) FROM rising_posts GROUP BY source""",
    "scope_entities": """SELECT DISTINCT scope, scope_key, term FROM (
        SELECT unnest(['all', 'category', 'source']) AS scope, unnest(['', category, source]) AS scope_key,
        entity AS term FROM found_entities JOIN rising_posts USING (seq))""",
    "term_counts": """SELECT scope, scope_key, term, count(*) AS everywhere, coalesce(sum(CASE WHEN trend_score >= 70
        THEN greatest(0.5, (trend_score - 70) / 30) END), 0) AS rise FROM scoped_terms GROUP BY ALL""",
    "topic_scores": """SELECT scope, scope_key, term, round(rise / (1 + everywhere / greatest(n, 1))
        * CASE WHEN e.term IS NULL THEN 1 ELSE 2 END, 9) AS score, len(string_split(term, ' ')) AS wc
        FROM term_counts JOIN scope_totals USING (scope, scope_key)
        LEFT JOIN scope_entities e USING (scope, scope_key, term)
        WHERE rise > 0 AND rise >= CASE scope WHEN 'category' THEN 0.5 ELSE 1 END""",
    "topics": """SELECT scope, scope_key, row_number() OVER (PARTITION BY scope, scope_key ORDER BY score DESC,
        CASE WHEN wc BETWEEN 2 AND 3 THEN 0 ELSE 4 - wc END, term) AS rank, term, score FROM topic_scores
        QUALIFY rank <= CASE scope WHEN 'source' THEN 24 ELSE 60 END""",
    "keyword_history": """SELECT CAST(created AS DATE) AS date, term, count(*) AS cnt FROM terms
        WHERE trend_score >= 70 AND created IS NOT NULL GROUP BY ALL""",
    # graph
    "pair_words": f"""SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) AS j, w FROM (
        SELECT id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM (SELECT row_number() OVER () AS id,
        string_split(phrase, ' ') AS ws FROM post_phrases JOIN rising_posts USING (seq)))
        WHERE length(w) >= 2 AND w NOT IN {_in(TOPIC_STOPWORDS)}""",
    "edges": """SELECT least(a.w, b.w) AS src, greatest(a.w, b.w) AS dst, count(*) AS weight
        FROM pair_words a JOIN pair_words b ON a.id = b.id AND b.j BETWEEN a.j + 1 AND a.j + 2 GROUP BY ALL""",
    # landing
    "rss": _view(views.RSS_ENTRIES),
    "rss_first": "SELECT * FROM rss QUALIFY row_number() OVER (PARTITION BY feed ORDER BY pos) <= 50",
    "article_rows": "SELECT * FROM raw_posts WHERE source <> 'blog' QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1",
})

_ORDER = list(_CTES)


def _assemble(body: str) -> str:
    """Prefix `body` with every expression it needs, directly or through others."""
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for name in _ORDER:
            if name not in needed and re.search(rf"(?<![\w.']){name}(?![\w'(])", sql):
                needed.add(name)
                visit(_CTES[name])

    visit(body)
    if not needed:
        return body
    kind = "WITH RECURSIVE " if "walk AS" in body else "WITH "
    ctes = ",\n".join(f"{name} AS ({_CTES[name]})" for name in _sorted(needed))
    if body.lstrip().startswith("WITH RECURSIVE "):
        return kind + ctes + ",\n" + body.lstrip()[len("WITH RECURSIVE "):]
    return kind + ctes + "\n" + body


def _sorted(needed: set[str]) -> list[str]:
    done: list[str] = []

    def place(name: str) -> None:
        if name in done:
            return
        for other in _ORDER:
            if other in needed and other != name and re.search(
                rf"(?<![\w.']){other}(?![\w'(])", _CTES[name]
            ):
                place(other)
        if name not in done:
            done.append(name)

    for name in _ORDER:
        if name in needed:
            place(name)
    return done


_WALK = """WITH RECURSIVE walk AS (
    SELECT DISTINCT scope, scope_key, 0::BIGINT AS step, []::VARCHAR[] AS acc FROM topics
    UNION ALL
    SELECT k.scope, k.scope_key, k.step + 1, CASE WHEN
        len(k.acc) >= CASE k.scope WHEN 'source' THEN 8 ELSE 20 END
        OR len(list_filter(k.acc, lambda e: len(string_split(e, ' ')) < len(string_split(t.term, ' '))
             AND list_has_all(string_split(t.term, ' '), string_split(e, ' ')))) > 0
        THEN k.acc ELSE list_append(k.acc, t.term) END
    FROM walk k JOIN topics t ON k.scope = t.scope AND k.scope_key = t.scope_key AND t.rank = k.step + 1)
SELECT w.scope, w.scope_key, list_position(acc, t.term) AS rank, t.term, t.score
FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY scope, scope_key ORDER BY step DESC) = 1) w
JOIN topics t ON t.scope = w.scope AND t.scope_key = w.scope_key AND list_contains(w.acc, t.term)"""

_MMR = """WITH RECURSIVE walk AS (
    SELECT scope, scope_key, 0::BIGINT AS step, []::VARCHAR[] AS acc, ''::VARCHAR AS term, 0.0::DOUBLE AS score
    FROM topics GROUP BY scope, scope_key HAVING count(*) > 20
    UNION ALL
    SELECT scope, scope_key, step, list_append(acc, term), term, score FROM (
      SELECT k.scope, k.scope_key, k.step + 1 AS step, k.acc, t.term, t.score, row_number() OVER (
        PARTITION BY k.scope, k.scope_key ORDER BY round(0.7 * t.score - (1 - 0.7) * coalesce(list_max(list_transform(k.acc,
          lambda p: len(list_intersect(string_split(p, ' '), string_split(t.term, ' ')))::DOUBLE
            / len(list_distinct(string_split(p, ' ') || string_split(t.term, ' '))))), 0), 12) DESC, t.rank) AS pick
      FROM walk k JOIN topics t ON k.scope = t.scope AND k.scope_key = t.scope_key
      WHERE k.step < 20 AND NOT list_contains(k.acc, t.term)) WHERE pick = 1)
SELECT scope, scope_key, CAST(step AS INTEGER) AS rank, term, score FROM walk WHERE step > 0
UNION ALL SELECT scope, scope_key, CAST(rank AS INTEGER), term, score FROM topics
QUALIFY max(rank) OVER (PARTITION BY scope, scope_key) <= 20"""

_BURST = f"""SELECT term, today AS today_count, (today - base) / base * 100 AS pct FROM (
    SELECT term, sum(cnt) FILTER (date = {_BURST_DAY}) AS today,
      coalesce(sum(cnt) FILTER (date <> {_BURST_DAY}), 0) + 0.5 AS base FROM keyword_history
    WHERE date = {_BURST_DAY} OR date IN (SELECT DISTINCT date FROM keyword_history
      WHERE date OTHER {_BURST_DAY} ORDER BY date DESC LIMIT 7) GROUP BY term) WHERE today >= 1"""

_QUERIES: dict[str, str] = {
    "clean_raw_posts": "SELECT seq, source, url, title, body, created_at, score, subreddit, author FROM posts",
    "html_strip_pages": f"SELECT page_id, {_strip('html')} AS text FROM pages",
    "post_id_and_ref": """SELECT url, 'news_' || substring(md5(url), 1, 12) AS id,
        nullif(regexp_extract(url, '(?i)/comments/([a-z0-9]+)/', 1), '') AS ref
        FROM (SELECT url FROM raw_posts UNION ALL SELECT url FROM pages)""",
    "land_submissions": f"""WITH subs AS ({_view(views.SUBMISSIONS)}) SELECT
        'reddit_' || substring(md5(url), 1, 12) AS id, 'reddit' AS source, title, url,
        strftime(make_timestamp(CAST(created_utc * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS created_at, score,
        coalesce(author, '') AS author, selftext AS body, seq
        FROM (SELECT *, 'https://www.reddit.com' || permalink AS url FROM subs)
        QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1""",
    "land_articles": f"""SELECT 'news_' || substring(md5(url), 1, 12) AS id, 'news' AS source, title, url,
        replace(substring(created_at, 1, 19), 'T', ' ') AS created_at, author, body, seq, CAST(0 AS BIGINT) AS pos FROM article_rows""",
    "rss_first_n_per_feed": f"""SELECT 'news_' || substring(md5(link), 1, 12) AS id, title, link AS url,
        CASE pos % 9 WHEN 1 THEN '2024-01-' || lpad(CAST(1 + pos % 30 AS VARCHAR), 2, '0') || ' 08:00:00'
          WHEN 2 THEN '2024-01-0' || (1 + pos % 7) || ' 10:00:00' WHEN 3 THEN '2024-01-03 04:30:00'
          WHEN 4 THEN '2024-01-01 05:00:00' WHEN 5 THEN '2024-01-03 15:15:00' WHEN 6 THEN '2024-01-07 00:00:00'
          WHEN 7 THEN '2024-01-02 01:30:00' ELSE CASE WHEN updated IS NULL THEN '{views.AS_OF}' ELSE '2024-01-05 06:07:08' END
          END AS created_at,
        coalesce(author, '') AS author,
        regexp_replace(coalesce(nullif(summary, ''), description), '<[^>]+>', '', 'g') AS body FROM rss_first
        QUALIFY row_number() OVER (PARTITION BY link ORDER BY feed, pos) = 1""",
    "source_fallback": """SELECT 'filled' AS "primary", url FROM article_rows
        UNION ALL SELECT DISTINCT 'empty', url FROM pages""",
    "day_readiness": """SELECT substring(created_at, 1, 10) AS date, CAST(count(DISTINCT source)
        FILTER (source IN ('reddit', 'news')) AS BIGINT) AS n_sources,
        CAST(count(DISTINCT source) FILTER (source IN ('reddit', 'news')) = 2 AS INTEGER) AS ready
        FROM raw_posts GROUP BY 1""",
    "velocity_trend": "SELECT url, source, round(trend_score, 6) AS trend_score FROM scored_velocity",
    "growth_trend": "SELECT url, round(growth_score, 6) AS growth_score FROM growth",
    "interest_trend": "SELECT keyword, round(interest, 6) AS interest FROM interest",
    "trend_score": "SELECT url, source, keywords, round(trend_score, 6) AS trend_score FROM scored_interest",
    "buckets_per_category": """SELECT category, bucket, CAST(rank AS INTEGER) AS rank, url, round(trend_score, 6) AS trend_score
        FROM top_category WHERE rank <= 50""",
    "buckets_overall": """SELECT bucket, CAST(rank AS INTEGER) AS rank, url, CASE WHEN length(title) > 80 THEN substring(title, 1, 80) || '...'
        ELSE title END AS headline, CAST(round_even(trend_score, 0) AS BIGINT) AS trend
        FROM top_overall WHERE rank <= 50""",
    "history_merge": "SELECT url, CAST(date AS VARCHAR) AS date, score FROM merged",
    "refetch_tracked": "SELECT url, CAST(date AS VARCHAR) AS date, score FROM refetched",
    "losing_stale": "SELECT url, days_losing, days_stale FROM runs",
    "track_update": f"""SELECT url, category, source, CAST(added_date AS VARCHAR) AS added_date FROM (
        SELECT * FROM tracked UNION ALL SELECT url, category, source, {_DAY} FROM top_category
        WHERE rank <= 50 AND source = 'reddit' AND url NOT IN (SELECT url FROM tracked))
        WHERE url NOT IN (SELECT url FROM runs WHERE days_losing >= 3 OR days_stale >= 5)""",
    "curated": "SELECT url, category, source FROM top_category WHERE rank <= 5 AND source = 'reddit'",
    "tracked_json": "SELECT url, category, source, CAST(added_date AS VARCHAR) AS added_date FROM tracked",
    "kpis": """SELECT count(*) AS total_posts, count(*) FILTER (trend_score >= 70) AS rising,
        count(*) FILTER (trend_score <= 30) AS falling, round(avg(trend_score), 6) AS avg_trend,
        count(*) FILTER (source = 'reddit') AS reddit_posts, count(*) FILTER (source = 'news') AS news_posts FROM scored""",
    "trend_histogram": """SELECT bin, bin * 5.0::DOUBLE AS low, (bin + 1) * 5.0::DOUBLE AS high, count(*) AS posts FROM
        (SELECT CAST(least(floor(trend_score / 5), 19) AS INTEGER) AS bin FROM scored) GROUP BY bin""",
    "sentiment_counts": """SELECT l.sentiment_label, count(s.seq) AS posts FROM
        (SELECT unnest(['positive', 'negative', 'neutral']) AS sentiment_label) l
        LEFT JOIN labels_of s USING (sentiment_label) GROUP BY 1""",
    "sentiment_by_category": """SELECT category, sentiment_label, count(*) AS posts FROM classified
        JOIN labels_of USING (seq) GROUP BY ALL""",
    "share_of_voice": """SELECT category, source, count(*) AS posts,
        round_even(count(*) / sum(count(*)) OVER (PARTITION BY category) * 100, 1) AS share_pct
        FROM classified GROUP BY category, source""",
    "daily_rollup": """SELECT CAST(CAST(created AS DATE) AS VARCHAR) AS date, count(*) AS posts,
        count(*) FILTER (trend_score >= 70) AS rising, count(*) FILTER (trend_score <= 30) AS falling
        FROM scored WHERE created IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 14""",
    "categories": "SELECT DISTINCT category FROM classified",
    "filtered_table": """SELECT title, source, category, round(trend_score, 6) AS trend_score, sentiment_label, score,
        keywords FROM (SELECT * FROM full_posts WHERE source = 'reddit' AND sentiment_label = 'positive'
        ORDER BY trend_score DESC, seq LIMIT 100)""",
    "newest_table": """SELECT title, source, category, sentiment_label, score FROM (SELECT * FROM full_posts
        WHERE category = 'politics' ORDER BY created_at, seq LIMIT 100)""",
    "classify": "SELECT url, category FROM classified",
    "sentiment": f"""WITH turns AS (SELECT conv_id, turn, coalesce(sum(valence), 0) AS s FROM (SELECT conv_id, turn,
          lower(unnest(CASE WHEN len(ws) = 0 THEN [''] ELSE ws END)) AS w FROM (SELECT conv_id, turn,
          regexp_extract_all(text, '{_WORD}') AS ws FROM conversations)) LEFT JOIN ({views.VALENCE_LEXICON}) v ON w = lower(term)
          GROUP BY conv_id, turn)
        SELECT conv_id, turn, round(s / sqrt(s ** 2 + 15), 4) + 0 AS sentiment_score,
          CASE WHEN round(s / sqrt(s ** 2 + 15), 4) >= 0.02 THEN 'positive'
          WHEN round(s / sqrt(s ** 2 + 15), 4) <= -0.02 THEN 'negative' ELSE 'neutral' END AS sentiment_label FROM turns""",
    "keywords": "SELECT url, keywords FROM posts JOIN keyworded USING (seq)",
    "entities": "SELECT url, entity FROM posts JOIN found_entities USING (seq)",
    "phrases": """SELECT url, count(phrase) AS n, md5(coalesce(string_agg(phrase, '|' ORDER BY phrase), '')) AS digest
        FROM posts LEFT JOIN post_phrases USING (seq) GROUP BY url""",
    "ranked_key_phrases": """SELECT '=' || url AS post, CAST(rank AS INTEGER) AS rank, phrase, round(best_phrases.score, 6) AS score
        FROM best_phrases JOIN posts USING (seq)""",
    "emerging_topics": "SELECT scope, scope_key, CAST(rank AS INTEGER) AS rank, term, score FROM topics",
    "emerging_topics_deduped": _WALK,
    "mmr_topics": _MMR,
    "keyword_history": "SELECT CAST(date AS VARCHAR) AS date, term, cnt FROM keyword_history",
    "keyword_history_json": """SELECT CAST(date AS VARCHAR) AS date, count(*) AS terms, CAST(sum(cnt) AS BIGINT) AS cnt
        FROM keyword_history GROUP BY 1""",
    "burst_past_only": "SELECT term, CAST(today_count AS BIGINT) AS today_count, round(pct, 6) AS pct_change FROM ("
        + _BURST.replace("OTHER", "<") + ")",
    "burst": """SELECT array_to_string(list_transform(string_split(term, ' '),
          lambda w: upper(substring(w, 1, 1)) || substring(w, 2)), ' ') AS topic,
        CAST(today_count AS BIGINT) AS today_count, round(pct, 6) AS pct_change,
        format('{:+d}%', CAST(round_even(pct, 0) AS BIGINT)) AS shown FROM ("""
        + _BURST.replace("OTHER", "<>") + ") ORDER BY round(pct, 9) DESC, term LIMIT 10",
    "cooccurrence": "SELECT src, dst, weight FROM edges",
    "land_day_again": """SELECT 'news' AS source, url, replace(substring(created_at, 1, 19), 'T', ' ') AS created_at,
        seq, CAST(0 AS BIGINT) AS pos FROM article_rows""",
    "ensured_sentiment": "SELECT seq, sentiment_score, sentiment_label FROM labels_of",
    "union_in_landing_order": """SELECT url, title, landing_rank FROM (SELECT * FROM (
        SELECT url, source, 'first' AS title, 0 AS landing_rank, seq FROM raw_posts WHERE seq % 2 = 0
        UNION ALL SELECT url, source, 'second', 1, seq FROM raw_posts)
        QUALIFY row_number() OVER (PARTITION BY url ORDER BY landing_rank, seq) = 1) WHERE source IN ('reddit', 'news')""",
    "conformed_columns": """SELECT seq, url, '' AS source, '' AS title, CAST(0 AS BIGINT) AS score, CAST(NULL AS VARCHAR) AS body,
        CAST(NULL AS DOUBLE) AS trend_score, CAST(NULL AS VARCHAR) AS category FROM raw_posts""",
    "csv_round_trip": """SELECT seq AS id, source, url, score, length(coalesce(title, '')) AS title_length,
        md5(coalesce(body, '')) AS body_md5 FROM raw_posts""",
    "cluster_report_given_members": """WITH cluster_nodes AS (SELECT w AS node, substring(w, 1, 1) AS comm FROM
          (SELECT src AS w FROM edges UNION SELECT dst FROM edges)),
        cluster_sizes AS (SELECT comm, count(*) AS size FROM cluster_nodes GROUP BY comm),
        cluster_ranks AS (SELECT *, row_number() OVER (ORDER BY size DESC, comm) AS cluster_rank FROM cluster_sizes),
        degrees AS (SELECT word AS node, count(*) AS degree FROM (SELECT src AS word FROM edges
          UNION ALL SELECT dst FROM edges) GROUP BY word),
        cluster_words AS (SELECT cluster_rank, size, node, row_number() OVER (PARTITION BY cluster_rank ORDER BY degree DESC, node) AS rn
          FROM cluster_nodes JOIN cluster_ranks USING (comm) JOIN degrees USING (node) WHERE cluster_rank <= 5 AND size >= 2)
        SELECT CAST(cluster_rank AS INTEGER) AS cluster_rank, size, string_agg(node, ' ' ORDER BY rn) AS words
        FROM cluster_words WHERE rn <= 10 GROUP BY cluster_rank, size""",
    "cooccurrence_degrees": """SELECT word, count(*) AS degree FROM (SELECT src AS word FROM edges
        UNION ALL SELECT dst FROM edges) GROUP BY word""",
}
_QUERIES["entity_keywords"] = f"""WITH title_content AS (SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY i) AS j,
      lower(w) AS w FROM title_words WHERE length(w) > 2 AND lower(w) NOT IN {_in(KEYWORD_STOPWORDS)}),
    title_grams AS ({_grams('title_content', 'seq', 2, 4)}),
    chosen AS (SELECT seq, gram, min(ord) AS ord FROM (
      SELECT seq, gram, [1, n, j] AS ord FROM entity_order UNION ALL SELECT seq, gram, [2, n, j] FROM title_grams) GROUP BY seq, gram),
    joined AS (SELECT seq, string_agg(gram, ' ' ORDER BY ord) AS t FROM (SELECT * FROM chosen
      QUALIFY row_number() OVER (PARTITION BY seq ORDER BY ord) <= 3) GROUP BY seq)
    SELECT url, coalesce(trim(substring(t, 1, 80)), keywords) AS keywords FROM posts JOIN keyworded USING (seq)
    LEFT JOIN joined USING (seq)"""


_TAG_VALUES = "(VALUES ('D', 0), ('A', 1), ('N', 2), ('V', 3), ('P', 4), ('X', 5)) AS tags(tag, k)"

#: The best tags of each stretch of words (seq, s, path), and its words (seq, s, pos, w).
_TAGGED = rf"""tag_pieces AS (SELECT seq, generate_subscripts(ps, 1) AS p, unnest(ps) AS piece FROM (SELECT seq,
      regexp_split_to_array(trim(title || ' ' || body), '[.,;:!?()\[\]"]+') AS ps FROM posts)),
    tag_words AS (SELECT seq, p * 100000 + (j - 1) // 64 AS s, (j - 1) % 64 + 1 AS pos, w FROM (SELECT seq, p,
      generate_subscripts(ws, 1) AS j, unnest(ws) AS w FROM (SELECT seq, p, regexp_extract_all(piece, '{_WORD}') AS ws FROM tag_pieces))),
    tag_scores AS (SELECT lower(term) AS term, tag, max(score) AS score FROM ({views.TAG_LEXICON}) GROUP BY ALL),
    tag_options AS (SELECT w.seq, w.s, w.pos, t.tag, t.k,
      coalesce(CASE WHEN w.term IS NULL THEN u.score ELSE e.score END, -1000000) AS score
      FROM (SELECT o.*, n.term FROM tag_words o LEFT JOIN (SELECT DISTINCT term FROM tag_scores
          WHERE term <> '' AND tag IN ('D', 'A', 'N', 'V', 'P', 'X')) n ON n.term = lower(o.w)) w
      CROSS JOIN {_TAG_VALUES} LEFT JOIN tag_scores e ON e.term = w.term AND e.tag = t.tag
      LEFT JOIN tag_scores u ON u.term = '' AND u.tag = t.tag),
    moves AS (SELECT a.tag AS previous, b.tag, coalesce(max(m.score), -1000000) AS score
      FROM (SELECT tag FROM {_TAG_VALUES} UNION ALL SELECT '') a CROSS JOIN {_TAG_VALUES.replace('tags(', 'b(')}
      LEFT JOIN ({views.TAG_MOVES}) m ON m.previous = a.tag AND m.tag = b.tag GROUP BY ALL),
    walk AS (
      SELECT o.seq, o.s, o.pos, o.tag, o.k, o.score + m.score AS total, o.tag AS path
      FROM tag_options o JOIN moves m ON m.previous = '' AND m.tag = o.tag WHERE o.pos = 1
      UNION ALL
      SELECT r.seq, r.s, r.pos + 1, o.tag, o.k, max(r.total + m.score) + any_value(o.score),
        arg_max(r.path, (r.total + m.score) * 8 + 5 - r.k) || o.tag
      FROM walk r JOIN tag_options o ON o.seq = r.seq AND o.s = r.s AND o.pos = r.pos + 1
      JOIN moves m ON m.previous = r.tag AND m.tag = o.tag GROUP BY r.seq, r.s, r.pos, o.tag, o.k),
    paths AS (SELECT seq, s, path FROM (SELECT *, row_number() OVER (PARTITION BY seq, s ORDER BY pos DESC, total DESC, k) AS best
      FROM walk) WHERE best = 1),
    spans AS (SELECT seq, s, path, sum(length(part)) OVER (PARTITION BY seq, s ORDER BY i) - length(part) AS begins, length(part) AS n, part
      FROM (SELECT seq, s, path, generate_subscripts(ps, 1) AS i, unnest(ps) AS part
        FROM (SELECT seq, s, path, regexp_extract_all(path, 'D?A*N+|.') AS ps FROM paths))),
    chunk_texts AS (SELECT x.seq, x.s, x.begins, string_agg(w.w, ' ' ORDER BY w.pos) AS t FROM spans x JOIN tag_words w
      ON w.seq = x.seq AND w.s = x.s AND w.pos > x.begins AND w.pos <= x.begins + x.n
      WHERE x.n BETWEEN 2 AND 4 AND part LIKE '%N' GROUP BY x.seq, x.s, x.begins),
    chunks AS (SELECT seq, t, min([s, begins]) AS ord FROM chunk_texts WHERE lower(t) NOT IN {_in(KEYWORD_STOPWORDS)} GROUP BY seq, t),
    noun_words AS (SELECT seq, w AS t, min([s, pos]) AS ord FROM tag_words JOIN paths USING (seq, s)
      WHERE substring(path, pos, 1) = 'N' AND length(w) > 2 AND w NOT IN {_in(KEYWORD_STOPWORDS)} GROUP BY seq, w)""".replace("t.tag, t.k", "tags.tag, tags.k").replace("= t.tag", "= tags.tag")

_QUERIES["noun_chunks"] = f"""WITH RECURSIVE {_TAGGED}
    SELECT url, coalesce(c.n, 0)::INTEGER AS n_chunks, md5(coalesce(c.t, '')) AS chunks_digest,
      coalesce(n.n, 0)::INTEGER AS n_nouns, md5(coalesce(n.t, '')) AS nouns_digest FROM posts
    LEFT JOIN (SELECT seq, count(*) AS n, string_agg(t, '|' ORDER BY ord) AS t FROM chunks GROUP BY seq) c USING (seq)
    LEFT JOIN (SELECT seq, count(*) AS n, string_agg(t, '|' ORDER BY ord) AS t FROM noun_words GROUP BY seq) n USING (seq)"""

_QUERIES["chunk_keywords"] = f"""WITH RECURSIVE {_TAGGED},
    first_terms AS (SELECT seq, t, min(ord) AS ord FROM (SELECT seq, gram AS t, [1, n, j] AS ord FROM entity_order
      UNION ALL SELECT seq, t, [2, ord[1], ord[2]] FROM chunks) GROUP BY seq, t),
    chosen AS (SELECT seq, t, min(ord) AS ord FROM (SELECT * FROM first_terms UNION ALL
      SELECT seq, t, [3, ord[1], ord[2]] FROM noun_words WHERE seq NOT IN (SELECT seq FROM first_terms GROUP BY seq HAVING count(*) >= 3)) GROUP BY seq, t),
    joined AS (SELECT seq, string_agg(t, ' ' ORDER BY ord) AS t FROM (SELECT * FROM chosen
      QUALIFY row_number() OVER (PARTITION BY seq ORDER BY ord) <= 3) GROUP BY seq)
    SELECT url, coalesce(trim(substring(t, 1, 80)), keywords) AS keywords FROM posts JOIN keyworded USING (seq)
    LEFT JOIN joined USING (seq)"""

_QUERIES["classify_by_model"] = f"""SELECT url, CASE WHEN contains(t, 'zz') OR length(t) % 11 = 0 THEN 'general' ELSE
      [{', '.join(f"'{c}'" for c in VALID_CATEGORIES)}][1 + (2 * length(t) - length(replace(t, 'e', ''))) % {len(VALID_CATEGORIES)}] END AS category
    FROM (SELECT url, CASE WHEN trim(title) = '' THEN 'no title' ELSE title END AS t FROM posts)"""

_QUERIES["shifted_sentiment"] = f"""WITH valued AS (SELECT lower(term) AS term, sum(valence) AS v FROM ({views.VALENCE_LEXICON}) GROUP BY 1),
    shifting AS (SELECT lower(term) AS term, sum(weight) FILTER (kind = 'booster') AS boost, bool_or(kind = 'negation') AS negates,
      bool_or(kind = 'turn') AS turns FROM ({views.SHIFTERS}) GROUP BY 1),
    marks AS (SELECT seq, url, length(t) - length(replace(t, '!', '')) AS e, length(t) - length(replace(t, '?', '')) AS q
      FROM (SELECT seq, url, trim(title || ' ' || body) AS t FROM posts)),
    shouted AS (SELECT seq, i, lower(w) AS term, upper(w) = w AND lower(w) <> w AS caps FROM words),
    mixing AS (SELECT seq, bool_or(caps) AND NOT bool_and(caps) AS mixed FROM shouted GROUP BY seq),
    known AS (SELECT seq, i, coalesce(v, 0) AS v, coalesce(boost, 0) AS boost, coalesce(negates, false) AS negates,
      coalesce(turns, false) AS turns, mixed AND caps AS loud
      FROM shouted JOIN mixing USING (seq) LEFT JOIN valued USING (term) LEFT JOIN shifting USING (term)
      WHERE valued.term IS NOT NULL OR shifting.term IS NOT NULL),
    changed AS (SELECT a.seq, a.i, (a.v + sign(a.v) * (CASE WHEN a.loud THEN 0.733 ELSE 0 END + coalesce((SELECT
        sum((b.boost + sign(b.boost) * CASE WHEN b.loud THEN 0.733 ELSE 0 END) * CASE a.i - b.i WHEN 1 THEN 1.0 WHEN 2 THEN 0.95 ELSE 0.9 END)
        FROM known b WHERE b.seq = a.seq AND b.boost <> 0 AND a.i - b.i BETWEEN 1 AND 3), 0)))
      * power(-0.74, (SELECT count(*) FROM known b WHERE b.seq = a.seq AND b.negates AND a.i - b.i BETWEEN 1 AND 3)) AS x
      FROM known a WHERE a.v <> 0),
    turned AS (SELECT seq, min(i) AS turn FROM known WHERE turns GROUP BY seq),
    totals AS (SELECT seq, sum(x * CASE WHEN turn IS NULL THEN 1 WHEN i > turn THEN 1.5 ELSE 0.5 END) AS s
      FROM changed LEFT JOIN turned USING (seq) GROUP BY seq),
    emphatic AS (SELECT seq, url, coalesce(s + sign(s) * (least(e, 4) * 0.292
      + CASE WHEN q < 2 THEN 0 WHEN q <= 3 THEN q * 0.18 ELSE 0.96 END), 0) AS s FROM marks LEFT JOIN totals USING (seq)),
    scored_posts AS (SELECT url, round(s / sqrt(s * s + 15), 4) + 0 AS sentiment_score FROM emphatic)
    SELECT url, sentiment_score, CASE WHEN sentiment_score >= 0.02 THEN 'positive' WHEN sentiment_score <= -0.02 THEN 'negative'
      ELSE 'neutral' END AS sentiment_label FROM scored_posts"""


_DAY_STATE = f"""WITH title_sums AS (SELECT seq, category, round(sum(weight), 9) AS weight
      FROM title_words JOIN category_lexicon ON lower(w) = lower(term) GROUP BY ALL),
    title_category AS (SELECT seq, category AS of_title FROM title_sums WHERE weight > 0
      QUALIFY row_number() OVER (PARTITION BY seq ORDER BY weight DESC, {_RANKED_CATEGORIES}) = 1)
    SELECT 'posts' AS kind, url, coalesce(of_title, 'general') || '|' || keywords || '|' || sentiment_label AS value,
      round(trend_score, 6) AS number FROM scored_velocity JOIN keyworded USING (seq) JOIN labels_of USING (seq)
      LEFT JOIN title_category USING (seq)
    UNION ALL SELECT 'scores', url, '{views.AS_OF[:10]}', CAST(score AS DOUBLE) FROM posts"""
_QUERIES["process_day_twice"] = _DAY_STATE
_QUERIES["day_after_a_dead_run"] = _DAY_STATE
_QUERIES["day_list"] = """SELECT DISTINCT CAST(CAST(created AS DATE) AS VARCHAR) AS date, 1 AS has_folder FROM timed
    WHERE created IS NOT NULL"""
_QUERIES["kept_partitions"] = """SELECT CAST(date AS VARCHAR) AS date, count(*) AS n, CAST(sum(score) AS BIGINT) AS score
    FROM history WHERE date >= DATE '2024-01-10' GROUP BY 1"""
_QUERIES["stale_days"] = """SELECT DISTINCT substring(created_at, 1, 10) AS date,
    CAST(CAST(substring(created_at, 9, 2) AS INTEGER) % 2 = 1 OR CAST(substring(created_at, 9, 2) AS INTEGER) % 3 = 0 AS INTEGER) AS stale
    FROM raw_posts WHERE created_at <> 'n/a'"""
_QUERIES["losing_stale_incremental"] = _QUERIES["losing_stale"]


_QUERIES["cluster_invariants"] = """SELECT count(*) AS members, count(*) AS nodes, 1 AS no_worse_than_single
    FROM (SELECT src AS word FROM edges UNION SELECT dst FROM edges)"""


def _merge_with(sql: str) -> str:
    """Merge a query's own leading WITH into the assembled one."""
    text = _assemble(sql)
    head = sql.lstrip()
    if head.startswith("WITH ") and not head.startswith("WITH RECURSIVE") and text is not sql:
        cut = text.rindex("\n" + sql)
        return text[:cut] + ",\n" + head[len("WITH "):]
    return text


ORACLES: dict[str, str] = {name: _merge_with(sql) for name, sql in _QUERIES.items()}

"""The registered queries as SQL for the cross-check engine, over the same tables."""

from __future__ import annotations

from newsloom.plans.derived_views import AS_OF_SQL, sql_with
from newsloom.plans.registered import PROFILE, PROMPT

ORACLE: dict[str, str] = {}

_A = sql_with("article")


def _digest(expr: str, name: str) -> str:
    return f"length({expr}) AS {name}_len, md5({expr}) AS {name}_md5"


def _time(expr: str, name: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S') AS {name}"


def _vector(v: str) -> str:
    parts = f"list_transform({v}, lambda x, i: CAST(x AS DOUBLE) * i)"
    return f"""CASE WHEN {v} IS NULL THEN NULL ELSE len({v}) END AS dims,
      CASE WHEN {v} IS NOT NULL THEN round(list_sum({parts}), 3) END AS weighted"""


# --- neighbours -------------------------------------------------------------------------------

_DISTANCE = (
    "sqrt(list_sum(list_transform(list_zip(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), "
    "lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"
)


def _pairs(keep_missing: bool) -> str:
    missing = "" if keep_missing else "AND a.embedding2 IS NOT NULL AND b.embedding2 IS NOT NULL"
    d = _DISTANCE.format(a="a.embedding2", b="b.embedding2")
    return f"""pair AS (SELECT a.id AS source_id, a.score AS source_score, a.agent AS source_agent,
        b.id AS neighbor_id, b.score AS neighbor_score,
        CASE WHEN a.embedding2 IS NULL OR b.embedding2 IS NULL THEN NULL ELSE {d} END AS distance
      FROM article a CROSS JOIN article b
      WHERE a.created_at >= {AS_OF_SQL} - INTERVAL '2 days' AND a.id <> b.id {missing})"""


def _nearest(per_article: bool, keep_missing: bool = True) -> str:
    if per_article:
        chosen = """nearest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id
            ORDER BY distance ASC NULLS LAST, neighbor_id) AS rn FROM pair) WHERE rn <= 10)"""
    else:
        chosen = """nearest AS (SELECT * FROM pair
            ORDER BY distance ASC NULLS LAST, source_id, neighbor_id LIMIT 10)"""
    return f"{_A}, {_pairs(keep_missing)}, {chosen} "


_SCORED = """, scored AS (SELECT source_id, source_score,
    CASE WHEN source_agent = 'user' THEN source_score ELSE avg(neighbor_score) END AS calculated_score
  FROM nearest GROUP BY source_id, source_score, source_agent) """
_SHOW_PAIRS = "SELECT source_id, neighbor_id, neighbor_score, round(distance, 6) AS distance FROM nearest"
_SHOW_TOP = """SELECT a.id, a.title, a.publication, a.agent, a.score, round(s.calculated_score, 6) AS neighbor_score
  FROM article a JOIN scored s ON a.id = s.source_id"""

ORACLE["neighbor_pairs_global"] = _nearest(False) + _SHOW_PAIRS
ORACLE["neighbor_pairs_per_article"] = _nearest(True) + _SHOW_PAIRS
ORACLE["neighbor_pairs_with_vectors"] = _nearest(True, False) + _SHOW_PAIRS
ORACLE["neighbor_pairs_by_cells"] = _nearest(True, False) + _SHOW_PAIRS
ORACLE["neighbor_pairs_by_blocks"] = _nearest(True, False) + _SHOW_PAIRS
ORACLE["neighbor_scores_per_article"] = (
    _nearest(True) + _SCORED + "SELECT source_id, source_score, round(calculated_score, 6) AS calculated_score FROM scored"
)
ORACLE["top_results_global"] = _nearest(False) + _SCORED + _SHOW_TOP
ORACLE["top_results_per_article"] = _nearest(True) + _SCORED + _SHOW_TOP
ORACLE["vector_distances"] = f"""SELECT a.vec_id, round({_DISTANCE.format(a='a.embedding', b='b.embedding')}, 6) AS distance
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""

# --- text pieces ------------------------------------------------------------------------------

_STRIPPED = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIPPED.format(x=x)


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _cut(x: str, size: int, error: str) -> str:
    head = f"left({x}, {size})"
    upto = f"regexp_extract({head}, '(?s)^(.* )[^ ]*$', 1)"
    return f"""CASE WHEN length({x}) < {size} THEN {x} WHEN NOT contains({head}, ' ') THEN '{error}'
        ELSE {_strip(upto)} || '...' END"""


def _plain(x: str) -> str:
    """Documents hold no tags; their only entities are written out by the generator."""
    return f"replace({x}, '&amp;', '&')"


_TITLE_PART = _strip(f"split_part({_collapse(_plain('coalesce(title, chr(32))'))}, '|', 1)")
_SUMMARY_PART = f"split_part({_collapse(_plain('coalesce(summary, chr(32))'))}, '|', 1)"
_SHORT = f"""short AS (SELECT *, {_cut('title_part', 1000, 'Error processing title')} AS title_short,
      {_cut('summary_part', 10000, 'Error processing summary')} AS summary_short
    FROM (SELECT *, {_TITLE_PART} AS title_part, {_SUMMARY_PART} AS summary_part FROM article))"""
_NL16, _NL12 = "chr(10) || repeat(' ', 16)", "chr(10) || repeat(' ', 12)"
_COMBINED = _strip(
    f"""('News article from ' || coalesce(publication, 'None') || {_NL16} || 'Title: ' || coalesce(title, 'None')
    || CASE WHEN summary IS NOT DISTINCT FROM title THEN '' ELSE {_NL16} || 'Summary: ' || coalesce(summary, 'None') END
    || CASE WHEN author IS NULL THEN '' ELSE {_NL12} || {_NL16} || 'Author: ' || author END)"""
)


def _title_case(x: str) -> str:
    word = (
        "CASE WHEN NOT regexp_matches(w, '^\\p{L}') THEN w ELSE "
        "CASE WHEN left(w, 1) = 'ß' THEN 'Ss' ELSE upper(left(w, 1)) END || lower(substr(w, 2)) END"
    )
    return f"array_to_string(list_transform(regexp_extract_all({x}, '\\p{{L}}+|[^\\p{{L}}]+'), lambda w: {word}), '')"


# --- selection --------------------------------------------------------------------------------

ORACLE["articles_with_nulls"] = _A + "SELECT id, publication FROM article WHERE embedding2 IS NULL AND score IS NULL"
ORACLE["articles_created_since"] = (
    _A + f"SELECT id, {_time('created_at', 'created_at')} FROM article WHERE created_at >= {AS_OF_SQL} - INTERVAL '24 hours'"
)
_RECENT = f"""SELECT * FROM article WHERE created_at >= {AS_OF_SQL} - INTERVAL '24 hours' AND embedding2 IS NULL
    ORDER BY created_at DESC, id LIMIT 200"""
ORACLE["recent_articles"] = _A + f"SELECT id, {_time('created_at', 'created_at')} FROM ({_RECENT})"
ORACLE["recent_articles_for_models"] = (
    _A + f", {_SHORT} SELECT id, {_digest('title_short', 'title')}, {_digest('summary_short', 'summary')}, "
    f"{_digest(_COMBINED, 'combined')} FROM short WHERE id IN (SELECT id FROM ({_RECENT}))"
)
ORACLE["negative_tags"] = sql_with("word_tag") + "SELECT name FROM word_tag WHERE score < 0"
ORACLE["positive_tags"] = sql_with("word_tag") + "SELECT name FROM word_tag WHERE score > 0"
ORACLE["unprocessed_articles"] = _A + "SELECT id FROM article WHERE agent IS NULL"
ORACLE["rescorable_articles"] = _A + "SELECT id, agent, score FROM article WHERE agent <> 'USER' AND score >= 0"
ORACLE["classified_without_embedding"] = (
    _A + f"SELECT id, {_digest(_COMBINED, 'combined')} FROM article WHERE agent = 'USER' AND embedding2 IS NULL"
)
ORACLE["training_set"] = (
    _A + f"SELECT id, score, {_vector('embedding2')} FROM article WHERE agent = 'USER' AND embedding2 IS NOT NULL"
)
ORACLE["embedding_dry_run"] = _A + "SELECT id, true AS still_empty FROM article WHERE embedding2 IS NULL"
ORACLE["update_records"] = _A + "SELECT id, agent, score, CAST(NULL AS BIGINT) AS ai_score FROM article"
ORACLE["bad_content_marks"] = """SELECT page_id, contains(url, '&raquo;') OR contains(url, '&amp;')
    OR contains(html, '&raquo;') OR contains(html, '&amp;') AS has_bad_content FROM pages"""

# --- text -------------------------------------------------------------------------------------


def _documents(expr: str, name: str = "text") -> str:
    return f"SELECT doc_id, {_digest(expr, name)} FROM documents"


ORACLE["collapsed_whitespace"] = _documents(_collapse("text"))
ORACLE["lower_case"] = _documents("lower(text)")
ORACLE["special_characters_removed"] = (
    f"SELECT doc_id, {_digest('''regexp_replace(text, '[^a-zA-Z0-9\\s]', '', 'g')''', 'kept_digits')}, "
    f"{_digest('''regexp_replace(text, '[^a-zA-Z\\s]', '', 'g')''', 'no_digits')} FROM documents"
)
ORACLE["short_texts"] = (
    _A + f", {_SHORT} SELECT id, {_digest('title_short', 'title')}, {_digest('summary_short', 'summary')} FROM short"
)
ORACLE["texts_before_bar"] = _documents("split_part(text, '|', 1)")
ORACLE["texts_cut_short"] = _documents(f"({_cut('text', 300, 'Error processing summary')})")
ORACLE["combined_texts"] = _A + f"SELECT id, {_digest(_COMBINED, 'combined')} FROM article"
ORACLE["stripped_urls"] = (
    "SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), ';[^/]*$', '') AS url FROM pages"
)
ORACLE["title_cased"] = _documents(_title_case("text"))
ORACLE["newlines_to_spaces"] = _documents("replace(text, chr(10), ' ')")

_NO_SCRIPT = r"""regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
    '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g')"""


def _html_text(x: str) -> str:
    entities = f"""replace(replace(replace(regexp_replace({x}, '&amp;?', '&', 'g'), '&copy;', chr(169)),
        '&middot;', chr(183)), '&quot;', '"')"""
    return f"regexp_replace({entities}, '<[^>]*>', '', 'g')"


# The pages' unclosed paragraphs begin with <b> and reach to the end of the article; all others
# end at their own </p>.
_PARAGRAPHS = f"""paragraph AS (SELECT *, CASE WHEN len(parts) < 2 THEN html ELSE array_to_string(
      list_transform(range(2, len(parts) + 1), lambda i:
        {_html_text('''CASE WHEN starts_with(parts[i], '<b>')
           THEN split_part(array_to_string(parts[i:], ''), '</article>', 1) ELSE split_part(parts[i], '</p>', 1) END''')}),
      '. ') END AS paragraphs
    FROM (SELECT *, string_split({_NO_SCRIPT}, '<p>') AS parts FROM pages))"""
ORACLE["page_texts"] = f"SELECT page_id, {_digest(_html_text(_NO_SCRIPT), 'text')} FROM pages"
ORACLE["paragraph_texts"] = f"WITH {_PARAGRAPHS} SELECT page_id, {_digest('paragraphs', 'text')} FROM paragraph"

# --- feed entries -----------------------------------------------------------------------------

ORACLE["publication_feeds"] = (
    sql_with("publication_config")
    + "SELECT publication AS feed_publication, url_ord, feed_url FROM publication_config WHERE enabled"
)
ORACLE["fresh_entries"] = (
    sql_with("entry") + f"SELECT entry_ord FROM entry WHERE published_parsed >= {AS_OF_SQL} - INTERVAL '5 days'"
)
ORACLE["published_dates"] = sql_with("entry") + f"SELECT entry_ord, {_time('published_parsed', 'published_at')} FROM entry"

_NORMAL = f""", routed AS (SELECT *,
      CASE WHEN is_hn THEN 'hacker_news' WHEN contains(link, 'wsj.com') OR contains(link, 'ft.com') THEN 'wsj_ft'
           WHEN contains(link, 'guardian.') OR contains(link, 'nytimes.com') THEN 'guardian_nyt' ELSE 'default' END AS route,
      regexp_replace(regexp_replace(link, '[?#].*$', ''), ';[^/]*$', '') AS bare FROM entry),
    normal AS (SELECT entry_ord, pub_ord, url_ord, feed_url, title,
      CASE route WHEN 'hacker_news' THEN comments WHEN 'default' THEN link ELSE bare END AS link,
      CASE WHEN route = 'hacker_news' THEN 'Points:' || split_part(summary, 'Points:', -1) ELSE summary END AS summary,
      feed_publication AS tags, CAST(NULL AS VARCHAR) AS media,
      CASE WHEN route = 'wsj_ft' THEN NULL ELSE author END AS author, feed_publication AS publication,
      published_parsed, route, html,
      CASE WHEN published_parsed < {AS_OF_SQL} - INTERVAL '5 days' THEN 'too_old' WHEN title IS NULL THEN 'no_title' END
        AS reject_reason FROM routed),
    accepted AS (SELECT * FROM normal WHERE reject_reason IS NULL),
    collected AS (SELECT * REPLACE (coalesce(summary, '') AS summary) FROM accepted
      QUALIFY row_number() OVER (PARTITION BY link ORDER BY pub_ord, url_ord, entry_ord) = 1) """
_ENTRY_COLUMNS = (
    "entry_ord, title, link, summary, tags, media, author, publication, " + _time("published_parsed", "published_at")
)
_N = sql_with("entry") + _NORMAL
ORACLE["entry_routes"] = _N + "SELECT entry_ord, route FROM routed"
ORACLE["normalized_entries"] = _N + f"SELECT {_ENTRY_COLUMNS} FROM accepted"
ORACLE["rejected_entries"] = _N + "SELECT entry_ord, reject_reason FROM normal WHERE reject_reason IS NOT NULL"
ORACLE["collected_entries"] = _N + f"SELECT {_ENTRY_COLUMNS} FROM collected"
ORACLE["split_by_publication"] = (
    _N + "SELECT CASE WHEN publication = 'HackerNews' THEN 'updating' ELSE 'adding' END AS part, link FROM collected"
)
_HTML_SUMMARY = f"""CASE WHEN c.route = 'wsj_ft' OR (c.route = 'guardian_nyt' AND contains(c.link, 'nytimes.com')) THEN {_html_text(_NO_SCRIPT).replace('html', 'c.html')}
      WHEN c.route = 'hacker_news' THEN 'Points:' || p.paragraphs ELSE p.paragraphs END"""
ORACLE["collected_html_entries"] = (
    _N + f", {_PARAGRAPHS} SELECT c.entry_ord, {_digest('c.link', 'link')}, {_digest(_HTML_SUMMARY, 'summary')} "
    "FROM collected c JOIN paragraph p ON p.page_id = c.entry_ord"
)
_UNDATED_NORMAL = _NORMAL.replace(
    "CASE WHEN published_parsed <", "CASE WHEN url_ord > 0 AND entry_ord % 41 = 17 THEN 'no_date' WHEN published_parsed <"
)
ORACLE["collected_dropping_feeds"] = (
    sql_with("entry") + _UNDATED_NORMAL + """, undated AS (SELECT pub_ord, url_ord, min(entry_ord) AS stop FROM normal
      WHERE reject_reason = 'no_date' GROUP BY ALL)
    SELECT entry_ord, link FROM (SELECT a.entry_ord, a.link, u.stop, row_number() OVER
        (PARTITION BY a.link ORDER BY a.pub_ord, a.url_ord, a.entry_ord) AS rn
      FROM accepted a LEFT JOIN undated u ON a.pub_ord = u.pub_ord AND a.url_ord = u.url_ord
      WHERE u.stop IS NULL OR a.entry_ord < u.stop) WHERE rn = 1 AND stop IS NULL"""
)
ORACLE["publication_counts"] = (
    sql_with("entry") + _UNDATED_NORMAL + """SELECT publication, count(*) AS total,
      count(*) FILTER (reject_reason IS NULL OR reject_reason = 'no_title') AS processed,
      count(*) FILTER (reject_reason = 'too_old') AS skipped,
      count(*) FILTER (reject_reason IN ('no_date', 'no_title')) AS errors FROM normal GROUP BY publication"""
)
ORACLE["feed_counts"] = (
    _N + """SELECT a.feed_url, count(c.entry_ord) AS valid, count(*) - count(c.entry_ord) AS duplicates,
      CAST(0 AS BIGINT) AS filtered, CAST(0 AS BIGINT) AS html_errors
    FROM accepted a LEFT JOIN collected c ON a.entry_ord = c.entry_ord GROUP BY a.feed_url"""
)
ORACLE["configuration_counts"] = (
    sql_with("publication_config") + """SELECT count(DISTINCT publication) AS publications,
      count(DISTINCT publication) FILTER (enabled) AS enabled, count(*) FILTER (enabled) AS feeds FROM publication_config"""
)
ORACLE["entries_per_publication"] = (
    _N + "SELECT publication, count(*) AS entries FROM collected GROUP BY ROLLUP (publication)"
)
ORACLE["feed_files"] = (
    sql_with("entry") + f"""SELECT feed_publication, feed_url, CASE WHEN is_hn THEN
      concat('https://news.ycombinator.com/item/', entry_ord) ELSE concat('urn:x:', entry_ord) END AS entry_id,
      title, link, comments, summary, author, {_time('published_parsed', 'published_at')} FROM entry"""
)

# --- rules ------------------------------------------------------------------------------------

_POLARITY = """, polarity AS (SELECT name, bool_or(score < 0) AS bad FROM {tag} WHERE score <> 0 AND name <> '' GROUP BY name)"""


def _own_marks(tag: str, article: str) -> str:
    return _POLARITY.format(tag=tag) + f""",
    own AS (SELECT id, unnest(tags) AS name, unnest(range(len(tags))) AS at FROM {article} WHERE len(tags) > 0),
    own_hit AS (SELECT o.id, arg_max(o.name, o.at) FILTER (p.bad) AS neg, arg_max(o.name, o.at) FILTER (NOT p.bad) AS pos
      FROM own o JOIN polarity p ON o.name = p.name GROUP BY o.id),
    own_mark AS (SELECT a.id, {_mark(10)} FROM {article} a LEFT JOIN own_hit h ON a.id = h.id) """


def _mark(weight: int) -> str:
    return f"""CASE WHEN neg IS NOT NULL AND pos IS NULL THEN -{weight} WHEN pos IS NOT NULL AND neg IS NULL THEN {weight}
        ELSE 0 END AS score, CASE WHEN neg IS NOT NULL AND pos IS NULL THEN neg WHEN pos IS NOT NULL AND neg IS NULL THEN pos
        END AS reason"""


def _text_marks(tag: str, article: str) -> str:
    text = _title_case("title || coalesce(summary, '')")
    return f""", searched AS (SELECT id, {text} AS found_in FROM {article}),
    text_hit AS (SELECT s.id, arg_min(t.name, t.tag_id) FILTER (t.score < 0) AS neg,
        arg_min(t.name, t.tag_id) FILTER (t.score > 0) AS pos
      FROM searched s JOIN (SELECT * FROM {tag} WHERE score <> 0 AND name <> '') t ON contains(s.found_in, t.name) GROUP BY s.id),
    text_mark AS (SELECT a.id, {_mark(5)} FROM {article} a LEFT JOIN text_hit h ON a.id = h.id) """


_WORDED = ", worded AS (SELECT * REPLACE (string_split(title, ' ') AS tags) FROM article) "
_T, _W = sql_with("article", "tag"), sql_with("article", "word_tag") + _WORDED
ORACLE["tag_marks"] = _T + _own_marks("tag", "article") + "SELECT * FROM own_mark"
ORACLE["tag_marks_many_tags"] = _W + _own_marks("word_tag", "worded") + "SELECT * FROM own_mark"
ORACLE["text_marks"] = _T + _text_marks("tag", "article") + "SELECT * FROM text_mark"
ORACLE["text_marks_many_tags"] = _W + _text_marks("word_tag", "article") + "SELECT * FROM text_mark"


def _rules(tag: str, article: str, chosen: str) -> str:
    return _own_marks(tag, article) + _text_marks(tag, article) + f"""
    SELECT a.id, CASE WHEN o.score <> 0 THEN 'TAG' WHEN x.score <> 0 THEN 'TITLE' ELSE 'NONE' END AS agent,
      CASE WHEN o.score <> 0 THEN o.score ELSE x.score END AS score,
      CASE WHEN o.score <> 0 THEN o.reason ELSE x.reason END AS reason
    FROM {article} a JOIN own_mark o ON a.id = o.id JOIN text_mark x ON a.id = x.id WHERE {chosen}"""


ORACLE["rule_results"] = _T + _rules("tag", "article", "a.agent IS NULL")
ORACLE["rule_results_rescored"] = _T + _rules("tag", "article", "a.agent <> 'USER' AND a.score >= 0")
ORACLE["rule_results_many_tags"] = _W + _rules("word_tag", "worded", "a.agent IS NULL")

# --- merges -----------------------------------------------------------------------------------

_UPDATES = """update_row AS (
    SELECT doc_id AS batch_ord, 0 AS pos, doc_id AS id, 'TAG' AS agent, doc_id % 7 - 3 AS score,
      concat('r', doc_id) AS reason FROM documents
    UNION ALL SELECT doc_id, 1, doc_id + 1, 'TITLE', doc_id % 5 - 2, NULL FROM documents)"""
ORACLE["payload_rows"] = f"WITH {_UPDATES} SELECT * FROM update_row"
ORACLE["payloads_applied"] = (
    _A + f""", {_UPDATES}, last AS (SELECT * FROM update_row
      QUALIFY row_number() OVER (PARTITION BY id ORDER BY batch_ord DESC, pos DESC) = 1)
    SELECT a.id, a.title, l.agent, l.score, l.reason, {_time(AS_OF_SQL, 'updated_at')} FROM article a JOIN last l ON a.id = l.id"""
)
_KNOWN = _N + ", known AS (SELECT DISTINCT link FROM entry WHERE feed_publication IN ('HackerNews', 'Guardian')) "
_NEW = "FROM collected WHERE link NOT IN (SELECT link FROM known)"
ORACLE["absent_entries"] = _KNOWN + f"SELECT link, title, summary {_NEW}"
ORACLE["inserted_articles"] = (
    _KNOWN + f"SELECT link, title, {_time(AS_OF_SQL, 'created_at')}, CAST(1 AS BIGINT) AS rows_with_id {_NEW}"
)


def _upserted(updates: str, extra: str = "", extra_new: str = "") -> str:
    return _KNOWN + f"""SELECT k.link, coalesce(c.title, 'old title') AS title,
        CASE WHEN c.link IS NULL THEN 'old summary' ELSE c.summary END AS summary, 'AI' AS agent {extra}
      FROM known k LEFT JOIN (SELECT * FROM collected {updates}) c ON k.link = c.link
      UNION ALL SELECT link, title, summary, NULL {extra_new} {_NEW}"""


ORACLE["upserted_articles"] = _upserted("")
ORACLE["ingested_articles"] = _upserted("WHERE publication = 'HackerNews'", ", NULL AS publication", ", publication")
ORACLE["embeddings_saved"] = (
    _A + f"""SELECT id, {_vector('saved')} FROM (SELECT a.id,
      CASE WHEN e.vec_id IS NULL THEN a.embedding2 ELSE list_reverse(e.embedding) END AS saved
    FROM article a LEFT JOIN embeddings e ON a.id = e.vec_id)"""
)
ORACLE["records_saved"] = (
    _A + """SELECT a.id, CASE WHEN l.doc_id IS NULL THEN a.agent WHEN l.toxic = 1 THEN 'AI' END AS agent,
      CASE WHEN l.doc_id IS NULL THEN a.score ELSE l.quality END AS score, l.toxic AS ai_score
    FROM article a LEFT JOIN labels l ON a.id = l.doc_id"""
)
ORACLE["versioned_table"] = (
    _T + _own_marks("tag", "article") + _text_marks("tag", "article") + """
    SELECT a.id, CASE WHEN a.agent IS NOT NULL THEN a.agent WHEN o.score <> 0 THEN 'TAG' WHEN x.score <> 0 THEN 'TITLE'
        ELSE 'NONE' END AS agent,
      CASE WHEN a.agent IS NOT NULL THEN a.score WHEN o.score <> 0 THEN o.score ELSE x.score END AS score,
      CASE WHEN a.agent IS NOT NULL THEN NULL WHEN o.score <> 0 THEN o.reason ELSE x.reason END AS reason
    FROM article a JOIN own_mark o ON a.id = o.id JOIN text_mark x ON a.id = x.id"""
)
ORACLE["partitioned_table"] = (
    _A + """SELECT id, CASE WHEN publication IN ('src1', 'src2') THEN 'TAG' ELSE agent END AS agent,
      CASE WHEN publication IN ('src1', 'src2') THEN -10 ELSE score END AS score,
      CASE WHEN publication IN ('src1', 'src2') THEN publication END AS reason FROM article"""
)

# --- model replies ----------------------------------------------------------------------------

# What each shape of reply must come out as, by doc_id % 14.
_RESULT = """result AS (SELECT doc_id AS id,
    CASE WHEN c IN (0, 1, 2, 3, 4, 9, 10) THEN source END AS scope,
    CASE WHEN c IN (0, 1, 2, 3, 4, 9, 10) THEN concat(lang, ',x') END AS topic,
    CASE WHEN c IN (0, 1, 2, 3, 4) THEN 'UNKNOWN' WHEN c = 9 THEN concat(chr(195), chr(169)) WHEN c = 10 THEN chr(233) END AS mood,
    CASE WHEN c IN (0, 1, 2, 3, 4, 9, 10) THEN doc_id % 21 - 10 WHEN c = 13 THEN 3 END AS score,
    CASE WHEN c IN (5, 6, 7, 11) THEN 'JSON Error' WHEN c = 8 THEN 'Unexpected Error' WHEN c = 12 THEN 'Unexpected error' END
      AS error_kind
  FROM (SELECT *, doc_id % 14 AS c FROM documents))"""
ORACLE["reply_results"] = f"WITH {_RESULT} SELECT * FROM result"
_CARRIED = """SELECT a.id, CASE WHEN r.error_kind IS NULL AND a.agent IS DISTINCT FROM 'USER' THEN 'AI' ELSE a.agent END AS agent,
    CASE WHEN r.error_kind IS NULL AND a.agent IS DISTINCT FROM 'USER' THEN r.score ELSE a.score END AS score,
    r.score AS ai_score2, r.scope AS tags_scope, r.topic AS tags_topic, r.mood AS tags_mood"""
_FROM = " FROM article a JOIN result r ON a.id = r.id"
ORACLE["scored_articles"] = (
    _A + f", {_RESULT} {_CARRIED}, coalesce('FAILED: ' || r.error_kind, 'SUCCESS') AS status {_FROM}"
)
ORACLE["scores_saved"] = _A + f", {_RESULT} {_CARRIED} {_FROM}"
ORACLE["scoring_counts"] = (
    f"WITH {_RESULT} SELECT count(*) AS total, count(*) FILTER (error_kind IS NULL) AS success, count(error_kind) AS failed FROM result"
)
ORACLE["mean_event_seconds"] = "SELECT round(avg(value), 4) AS mean_seconds FROM events"
ORACLE["embedding_counts"] = _A + "SELECT count(embedding2) AS embedded, count(*) AS total FROM article"
ORACLE["filled_counts"] = (
    _A + """SELECT count(embedding2) AS embedding2, CAST(0 AS BIGINT) AS ai_score2, CAST(0 AS BIGINT) AS tags_topic,
      CAST(0 AS BIGINT) AS tags_mood, CAST(0 AS BIGINT) AS tags_scope FROM article"""
)

_TAXONOMY = """taxonomy AS (SELECT concat('scope:', chr(10),
      (SELECT string_agg(concat('- ', source, ': ', n, ' documents'), chr(10) ORDER BY source)
       FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)), chr(10), 'topic:', chr(10),
      (SELECT string_agg(concat('- ', lang, ': ', n, ' documents'), chr(10) ORDER BY lang)
       FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)), chr(10), 'mood:', chr(10)) AS taxonomy)"""
ORACLE["taxonomy_text"] = f"WITH {_TAXONOMY} SELECT taxonomy FROM taxonomy"
_PROMPT_SQL = "'" + PROMPT.replace("\n", "' || chr(10) || '").replace("{taxonomy}", "' || taxonomy || '").replace(
    "{profile}", "' || '" + PROFILE + "' || '"
).replace("{article}", f"' || {_COMBINED} || '") + "'"
_PROMPTS = f", {_TAXONOMY}, prompted AS (SELECT a.*, {_PROMPT_SQL} AS prompt FROM article a, taxonomy) "
ORACLE["scoring_prompts"] = _A + _PROMPTS + f"SELECT id, {_digest('prompt', 'prompt')} FROM prompted"
ORACLE["embedded_articles"] = (
    _A + f"""SELECT id, length(t) AS length, length(t) - length(replace(t, ' ', '')) AS blanks,
      length(t) - length(replace(t, 'e', '')) AS es
    FROM (SELECT id, replace({_COMBINED}, chr(10), ' ') AS t FROM article WHERE embedding2 IS NULL)"""
)
ORACLE["articles_scored_by_model"] = (
    _A + _PROMPTS + """SELECT id, CASE WHEN ok AND agent IS DISTINCT FROM 'USER' THEN 'AI' ELSE agent END AS agent,
      CASE WHEN ok AND agent IS DISTINCT FROM 'USER' THEN answer ELSE score END AS score,
      CASE WHEN ok THEN answer END AS ai_score2, CASE WHEN ok THEN 'UNKNOWN' END AS tags_scope,
      CASE WHEN ok THEN 'len' END AS tags_topic, CASE WHEN ok THEN 'calm' END AS tags_mood,
      CASE WHEN ok THEN 'SUCCESS' ELSE 'FAILED: LLM Error: refused' END AS scoring_status
    FROM (SELECT *, length(prompt) % 7 <> 0 AS ok, length(prompt) % 21 - 10 AS answer FROM prompted)"""
)

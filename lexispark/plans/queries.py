"""The registered corpus queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions.text import SPACE, document_of_sentence, entities, is_marker, short_hash, strip_markup, tag_text, year_of
from ..operators import collocation, cql, explore, merge, search, stats
from ..operators.filters import Filters, filter_options
from ..operators.segments import display_segments
from ..scratch import new_folder
from .adapter import corpus, utterances

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
STOPWORDS = "the, and of"
NEWS = Filters(category=("news",), year=("2010", "2011"))

_EDGE = rf"[\p{{P}}\p{{S}}{SPACE}]+"
_NORMAL = f"""CASE WHEN regexp_matches(surface, '^\\{{[^}}]+\\}}$') THEN lower(surface)
  ELSE coalesce(nullif(lower(regexp_replace(regexp_replace(surface, '^{_EDGE}', ''), '{_EDGE}\\z', '')), ''), lower(surface)) END"""
#: The adapter's views in DuckDB's SQL.
VIEWS = f"""WITH RECURSIVE utt AS (
  SELECT 'conv' AS corpus_id, CAST(conv_id AS VARCHAR) AS doc_id, conv_id * 1000000 + turn + 1 AS row_id, conv_id || '.' || turn AS utterance_id, role AS speaker_id,
    CAST(turn + 1 AS BIGINT) AS sequence, '{{' || role || '}} ' || text AS form, text AS original_form,
    CASE conv_id % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'service' ELSE 'news' END AS category, 'topic' || (conv_id % 5) AS topic, CAST(2010 + conv_id % 4 AS VARCHAR) AS year,
    CASE role WHEN 'user' THEN '20' WHEN 'assistant' THEN '' ELSE '30' END AS speaker_age, CASE role WHEN 'user' THEN 'F' WHEN 'system' THEN 'M' ELSE '' END AS speaker_sex
  FROM conversations
  UNION ALL
  SELECT 'docs', CAST(doc_id AS VARCHAR), doc_id * 1000000 + i, doc_id || '.' || i, 'text', i, line, line, lang, source, '', '', ''
  FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
  WHERE regexp_replace(line, '[{SPACE}]+', '', 'g') <> ''
), words AS (
  SELECT *, list_filter(regexp_split_to_array(form, '[{SPACE}]+'), lambda x: x <> '') AS w FROM utt
), raw AS (
  SELECT * EXCLUDE (w), unnest(w) AS surface, generate_subscripts(w, 1) - 1 AS token_index FROM words
), tok AS (
  SELECT *, {_NORMAL} AS term FROM raw
), prov AS (
  SELECT *, regexp_replace(term, '(ing|ed|s)$', '') AS lemma, CASE WHEN regexp_matches(term, '^[0-9]+$') THEN 'SN' WHEN regexp_matches(term, '(ing|ed)$') THEN 'VV' ELSE 'NNG' END AS pos
  FROM tok WHERE corpus_id = 'conv'
), doc AS (
  SELECT DISTINCT corpus_id, doc_id, 'conversation ' || doc_id AS title, topic, category, year FROM utt WHERE corpus_id = 'conv'
  UNION ALL SELECT 'docs', CAST(doc_id AS VARCHAR), 'document ' || doc_id, source, lang, '' FROM documents
)
"""


def register(name: str, sql: str | None = None):
    """Register a query; ``sql`` follows the views unless it starts with WITH or SELECT on the tables alone."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = VIEWS + sql
        return f

    return keep


def _t(spark, d, name):
    return corpus(spark, d).table(name)


def _top(value: str, rows: str, n: int) -> str:
    return f"SELECT {value} AS value, count(*) AS count FROM {rows} GROUP BY 1 ORDER BY count DESC, value LIMIT {n}"


@register("token_frequency", _top("term", "tok", 100))
def token_frequency(spark, d):
    return stats.token_frequency(utterances(spark, d), _t(spark, d, "token_stats"))


@register("token_frequency_stopwords", _top("term", "tok WHERE term NOT IN ('the', 'and', 'of')", 100))
def token_frequency_stopwords(spark, d):
    return stats.token_frequency(utterances(spark, d), _t(spark, d, "token_stats"), Filters(stopwords=STOPWORDS))


@register("token_frequency_provided", _top("term", "prov WHERE category = 'news' AND year IN ('2010', '2011')", 100))
def token_frequency_provided(spark, d):
    return stats.token_frequency(utterances(spark, d), _t(spark, d, "token_stats"), Filters(category=("news",), year=("2010", "2011"), source="provided"))


_SUMMARY = """SELECT count(DISTINCT corpus_id) AS corpus_count, count(DISTINCT corpus_id || '::' || doc_id) AS document_count, count(*) AS utterance_count,
  count(DISTINCT corpus_id || '::' || doc_id || '::' || speaker_id) AS speaker_count, (SELECT count(*) FROM tok {0}) AS token_count,
  (SELECT count(*) FROM tok {0} {1} term LIKE '{{%' AND term LIKE '%}}') AS non_speech_count FROM utt {0}"""


@register("stats_summary", _SUMMARY.format("", "WHERE"))
def stats_summary(spark, d):
    return _summary(spark, d, Filters())


def _summary(spark, d, filters):
    return stats.summary(utterances(spark, d), filters, *(_t(spark, d, t) for t in ("document_stats", "token_stats", "value_stats")))


@register("stats_summary_by_corpus", _SUMMARY.format("WHERE corpus_id = 'conv'", "AND"))
def stats_summary_by_corpus(spark, d):
    return _summary(spark, d, Filters(corpus_id=("conv",)))


@register("stats_summary_provided", _SUMMARY.format("", "WHERE").replace("FROM tok )", "FROM prov)"))
def stats_summary_provided(spark, d):
    """Tokens of the provided layer, and markers of the raw one, as no filter but by corpus is set."""
    return _summary(spark, d, Filters(source="provided"))


@register("stats_summary_filtered", _SUMMARY.format("WHERE category = 'news' AND year IN ('2010', '2011')", "AND"))
def stats_summary_filtered(spark, d):
    return stats.summary(utterances(spark, d), NEWS)


@register("topic_distribution_docs", _top("topic", "doc WHERE topic <> ''", 100))
def topic_distribution_docs(spark, d):
    return stats.distribution(utterances(spark, d), _t(spark, d, "value_stats"), "topic")


@register("topic_distribution_filtered", _top("topic", "utt WHERE category = 'news' AND year IN ('2010', '2011')", 50))
def topic_distribution_filtered(spark, d):
    return stats.distribution(utterances(spark, d), _t(spark, d, "value_stats"), "topic", NEWS)


@register("category_distribution", _top("category", "doc WHERE corpus_id = 'docs' AND category <> ''", 100))
def category_distribution(spark, d):
    return stats.distribution(utterances(spark, d), _t(spark, d, "value_stats"), "category", Filters(corpus_id=("docs",)))


@register("speaker_distribution", _top("coalesce(nullif(speaker_sex, ''), '미상') || ' / ' || coalesce(nullif(speaker_age, ''), '미상')", "utt", 100))
def speaker_distribution(spark, d):
    return stats.speaker_distribution(utterances(spark, d), _t(spark, d, "value_stats"))


@register("marker_distribution", _top("term", "tok WHERE term LIKE '{%' AND term LIKE '%}'", 100))
def marker_distribution(spark, d):
    return stats.marker_distribution(utterances(spark, d), _t(spark, d, "value_stats"))


@register("document_stats", "SELECT corpus_id, doc_id, count(*) AS utterance_count, min(sequence) AS first_sequence, max(sequence) AS last_sequence FROM utt GROUP BY ALL")
def document_stats(spark, d):
    return _t(spark, d, "document_stats").drop("speaker_count")


@register(
    "filter_options",
    " UNION ".join(f"SELECT '{c}' AS kind, {c} AS value FROM doc WHERE {c} <> ''" for c in ("year", "category", "topic")) + "".join(f" UNION SELECT '{k}', speaker_{k} FROM utt WHERE speaker_{k} <> ''" for k in ("sex", "age")),
)
def options(spark, d):
    return filter_options(_t(spark, d, "documents"), _t(spark, d, "speakers"))


def _page(spark, d, request):
    _, rows, _ = search.page(utterances(spark, d), _t(spark, d, "token_stats"), request, corpus(spark, d).index())
    keyed = rows.select("corpus_id", "row_id", "doc_id", "utterance_id", "sequence", *(F.concat_ws(" ", c).alias(c) for c in ("left", "hit", "right")))
    return keyed.orderBy("corpus_id", "row_id").limit(request.limit).drop("row_id")


_FIRST = """, hits AS ({0}), first AS (SELECT corpus_id, row_id, min(token_index) FILTER (WHERE {1}) AS hit_at, list(surface ORDER BY token_index) AS w FROM tok SEMI JOIN hits USING (corpus_id, row_id) GROUP BY ALL)
SELECT corpus_id, doc_id, utterance_id, sequence, CASE WHEN hit_at IS NULL THEN '' ELSE array_to_string(w[greatest(hit_at - 6, 1) : hit_at], ' ') END AS "left",
  CASE WHEN hit_at IS NULL THEN array_to_string(w, ' ') ELSE w[hit_at + 1] END AS hit, CASE WHEN hit_at IS NULL THEN '' ELSE array_to_string(w[hit_at + 2 : hit_at + 8], ' ') END AS "right"
FROM utt JOIN first USING (corpus_id, row_id) ORDER BY corpus_id, row_id LIMIT 100"""


@register("search_exact_token", _FIRST.format("SELECT DISTINCT corpus_id, row_id FROM tok WHERE term = 'the'", "contains(term, 'the')"))
def search_exact_token(spark, d):
    return _page(spark, d, search.Request("The"))


@register("kwic_exact", _FIRST.format("SELECT DISTINCT corpus_id, row_id FROM tok WHERE term = 'here' AND category = 'news'", "contains(term, 'here')"))
def kwic_exact(spark, d):
    return _page(spark, d, search.Request("here", filters=Filters(category=("news",))))


@register("search_substring_all", "SELECT corpus_id, doc_id, utterance_id FROM utt WHERE lower(form) LIKE '%er%ing the _o%'")
def search_substring_all(spark, d):
    """Every utterance of a query with wildcards, found by its threes of signs."""
    hits, _ = search.matched(utterances(spark, d), _t(spark, d, "token_stats"), search.Request("er%ing the _o"), corpus(spark, d).index())
    return hits.rows.select("corpus_id", "doc_id", "utterance_id")


@register("search_substring", _FIRST.format("SELECT corpus_id, row_id FROM utt WHERE lower(form) LIKE '%ion th%'", "contains(term, 'ion th')"))
def search_substring(spark, d):
    return _page(spark, d, search.Request("ioN th"))


# the pattern's classes are written out, as the SQL's engine has other ones for white space and edges of words
_EDGES = r"(^|[^A-Za-z0-9_])of[ \x{a0}\x{3000}]the([^A-Za-z0-9_]|$)"


@register("search_regex_dialect", f"SELECT corpus_id, doc_id, utterance_id FROM utt WHERE regexp_matches(form, '{_EDGES}')")
def search_regex_dialect(spark, d):
    hits, _ = search.matched(utterances(spark, d), _t(spark, d, "token_stats"), search.Request(r"\bof\sthe\b", mode="regex"), corpus(spark, d).index())
    return hits.rows.select("corpus_id", "doc_id", "utterance_id")


@register("search_regex", _FIRST.format("SELECT corpus_id, row_id FROM utt WHERE regexp_matches(form, 'tion[a-z]{3}s')", "regexp_matches(surface, 'tion[a-z]{3}s') OR regexp_matches(term, 'tion[a-z]{3}s')"))
def search_regex(spark, d):
    return _page(spark, d, search.Request("tion[a-z]{3}s", mode="regex"))


def _cql(spark, d, query, source="raw", corpora=()):
    hits, _ = search.matched(utterances(spark, d), _t(spark, d, "token_stats"), search.Request(query, mode="cql", filters=Filters(corpus_id=corpora, source=source)), corpus(spark, d).index())
    return hits.rows.select("corpus_id", "doc_id", "utterance_id", "s", "e")


_PAIR = """SELECT a.corpus_id, a.doc_id, a.utterance_id, CAST(a.token_index AS INT) AS s, CAST(b.token_index + 1 AS INT) AS e
FROM {0} a JOIN {0} b ON a.corpus_id = b.corpus_id AND a.row_id = b.row_id AND b.token_index - a.token_index - 1 BETWEEN {1} AND {2} WHERE {3}"""


@register("cql_distance", _PAIR.format("tok", 0, 3, "a.term = 'the' AND b.term = 'of'"))
def cql_distance(spark, d):
    return _cql(spark, d, '[text="the"] []{0,3} [text="of"]')


@register(
    "cql_repeat",
    """SELECT corpus_id, doc_id, utterance_id, CAST(token_index AS INT) AS s, CAST(token_index + 1 AS INT) AS e FROM tok WHERE term = 'the'
UNION ALL """
    + _PAIR.format("tok", 0, 0, "a.term = 'the' AND b.term = 'the'"),
)
def cql_repeat(spark, d):
    return _cql(spark, d, '[text="the"]{1,2}')


@register("cql_wildcard_range", _PAIR.format("tok", 1, 2, "a.term = 'here' AND regexp_matches(b.term, '^th')"))
def cql_wildcard_range(spark, d):
    return _cql(spark, d, '[text="here"] []{1,2} [text~"^th"]')


@register("cql_regex_pos", _PAIR.format("prov", 0, 0, "a.pos = 'VV' AND regexp_matches(b.term, 'ly')"))
def cql_regex_pos(spark, d):
    return _cql(spark, d, '[pos="VV"] [text~"ly"]', "provided", ("conv",))


@register("cql_lemma", _PAIR.format("prov", 0, 4, "a.lemma = 'er' AND b.pos = 'VV'"))
def cql_lemma(spark, d):
    return _cql(spark, d, '[lemma="er"] []{0,4} [pos="VV"]', "provided", ("conv",))


@register("cql_rarest", "SELECT DISTINCT a.corpus_id, a.doc_id, a.utterance_id, CAST(a.token_index AS INT) AS s, CAST(b.token_index + 2 AS INT) AS e FROM tok a JOIN tok b ON a.corpus_id = b.corpus_id AND a.row_id = b.row_id AND b.token_index = a.token_index + 1 JOIN tok c ON c.corpus_id = a.corpus_id AND c.row_id = a.row_id AND c.token_index = a.token_index + 2 WHERE a.term = 'the' AND regexp_matches(b.term, 'a') AND c.term = 'here'")
def cql_rarest(spark, d):
    """The rarer of two words drives, and the frequent one is not looked up."""
    return _cql(spark, d, '[text="the"] [text~"a"] [text="here"]')


_COLLOCATION = """, node AS (SELECT corpus_id, row_id, token_index FROM tok WHERE term = '{node}' {where} ORDER BY 1, 2, 3 {cap}),
near AS (SELECT c.term AS token, CASE WHEN c.token_index < n.token_index THEN 'left' ELSE 'right' END AS side, count(*) AS frequency
  FROM node n JOIN tok c ON c.corpus_id = n.corpus_id AND c.row_id = n.row_id AND c.token_index BETWEEN n.token_index - {w} AND n.token_index + {w} AND c.token_index <> n.token_index
  WHERE {stop} GROUP BY ALL HAVING count(*) >= {least}),
whole AS (SELECT term AS token, count(*) AS n FROM tok GROUP BY 1),
scored AS (SELECT *, (SELECT count(*) FROM tok WHERE term = '{node}' {where}) * n / (SELECT count(*) FROM tok)::DOUBLE AS expected FROM near JOIN whole USING (token))
SELECT token, side, frequency, round(log2(frequency / expected), 6) AS mi, round((frequency - expected) / sqrt(frequency), 6) AS t_score FROM scored ORDER BY frequency DESC, token, side {limit}"""


def _rounded(found: collocation.Collocations) -> DataFrame:
    return found.rows.withColumns({c: F.round(c, 6) for c in ("mi", "t_score")})


@register("collocation_raw", _COLLOCATION.format(node="here", where="", cap="", w=5, stop="true", least=2, limit=""))
def collocation_raw(spark, d):
    return _rounded(collocation.collocations(utterances(spark, d), _t(spark, d, "token_stats"), "here"))


@register("collocation_filtered", _COLLOCATION.format(node="the", where="AND category = 'news' AND year IN ('2010', '2011')", cap="", w=3, stop="c.term NOT IN ('and', 'of')", least=2, limit="LIMIT 200"))
def collocation_filtered(spark, d):
    return _rounded(collocation.collocations(utterances(spark, d), _t(spark, d, "token_stats"), "the", 3, 2, 200, filters=Filters(category=("news",), year=("2010", "2011"), stopwords="and, of")))


@register("collocation_capped", _COLLOCATION.format(node="the", where="", cap="LIMIT 500", w=2, stop="true", least=3, limit=""))
def collocation_capped(spark, d):
    return _rounded(collocation.collocations(utterances(spark, d), _t(spark, d, "token_stats"), "the", 2, 3, max_occurrences=500))


@register("explore_tree_categories", "SELECT corpus_id, category, count(*) AS count FROM doc GROUP BY ALL")
def explore_tree_categories(spark, d):
    return explore.category_counts(_t(spark, d, "topic_stats"))


@register(
    "explore_topics_top100",
    "SELECT *, CAST(row_number() OVER (PARTITION BY corpus_id, category ORDER BY count DESC, topic) AS INT) AS rank FROM (SELECT corpus_id, category, topic, count(*) AS count FROM doc GROUP BY ALL) QUALIFY rank <= 100",
)
def explore_topics_top100(spark, d):
    return explore.topic_counts(_t(spark, d, "topic_stats"))


@register(
    "list_documents",
    """, page AS (SELECT * FROM doc WHERE corpus_id = 'docs' AND category = 'en' AND lower(title) LIKE '%document 1%' ORDER BY doc_id LIMIT 50 OFFSET 10)
SELECT doc_id, any_value(title) AS title, any_value(topic) AS topic, count(row_id) AS utterance_count, min(sequence) AS first_sequence, max(sequence) AS last_sequence FROM page LEFT JOIN (SELECT doc_id, row_id, sequence FROM utt WHERE corpus_id = 'docs') USING (doc_id) GROUP BY doc_id""",
)
def list_documents(spark, d):
    rows = explore.list_documents(_t(spark, d, "documents"), _t(spark, d, "document_stats"), "docs", category="en", query="Document 1", limit=50, offset=10)
    return rows.select("doc_id", "title", "topic", "utterance_count", "first_sequence", "last_sequence")


@register("document_detail_page", "SELECT utterance_id, speaker_id, sequence, form, original_form FROM utt WHERE corpus_id = 'conv' AND doc_id = '7' ORDER BY sequence LIMIT 500")
def document_detail_page(spark, d):
    return explore.document_page(utterances(spark, d), "conv", "7").select("utterance_id", "speaker_id", "sequence", "form", "original_form")


@register("speaker_pivot", """SELECT doc_id, sequence, any_value(CASE WHEN speaker_id NOT IN ('assistant') THEN form END) AS "user", any_value(CASE WHEN speaker_id = 'assistant' THEN form END) AS assistant FROM utt WHERE corpus_id = 'conv' GROUP BY ALL""")
def speaker_pivot(spark, d):
    return explore.speaker_columns(utterances(spark, d, ("conv",)), ["user", "assistant"]).drop("corpus_id")


#: One utterance after the other: the group it belongs to, whether that is still open, and whether it came after it was closed.
_FOLDED = rf""", base AS (
  SELECT *, trim(form, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS t, row_number() OVER (PARTITION BY corpus_id, doc_id ORDER BY sequence, row_id) AS n FROM utt WHERE trim(form) <> ''
), marked AS (
  SELECT corpus_id, doc_id, n, utterance_id, speaker_id, sequence, t, regexp_matches(t, '^[.!?。？！ㅋㅎㅜㅠ{SPACE}]+$') AS short, regexp_matches(t, '^[.!?。？！]+[ㅋㅎㅜㅠ]*$') AS glue,
    regexp_matches(t, '[.!?。？！]+(?:[{SPACE}]*[ㅋㅎㅜㅠ]+)?["'')\]}}”’]*$') AS ends FROM base
), fold AS (
  SELECT *, CAST(1 AS BIGINT) AS grp, NOT ends AS open, false AS late, '' AS sep FROM marked WHERE n = 1
  UNION ALL
  SELECT x.*, f.grp + CASE WHEN f.speaker_id = x.speaker_id AND (f.open OR x.short) THEN 0 ELSE 1 END,
    CASE WHEN f.speaker_id = x.speaker_id AND x.short AND NOT f.open THEN false ELSE NOT x.ends END, f.speaker_id = x.speaker_id AND x.short AND NOT f.open,
    CASE WHEN f.speaker_id = x.speaker_id AND x.short AND x.glue THEN '' ELSE ' ' END
  FROM fold f JOIN marked x ON x.corpus_id = f.corpus_id AND x.doc_id = f.doc_id AND x.n = f.n + 1
), merged AS (
  SELECT corpus_id, doc_id, grp AS "group", any_value(speaker_id) AS speaker_id, min(sequence) AS start_sequence, max(sequence) AS end_sequence, count(*) AS utterance_count,
    trim(regexp_replace(string_agg(sep || t, '' ORDER BY n), '[{SPACE}]+', ' ', 'g')) AS text, '' AS time_label,
    any_value(speaker_id) || ':' || min(sequence) || CASE WHEN min(sequence) = max(sequence) FILTER (NOT late) THEN '' ELSE '-' || max(sequence) FILTER (NOT late) END || ':' || string_agg(utterance_id, '|' ORDER BY n) AS id
  FROM fold GROUP BY corpus_id, doc_id, grp
)"""
_PACKED = """, sized AS (
  SELECT *, length(text) AS chars, text <> '' AND (length(text) <= 35 OR len(string_split(text, ' ')) <= 7) AS short FROM merged
), packed AS (
  SELECT *, CAST(1 AS BIGINT) AS bundle, utterance_count AS us, chars AS cs FROM sized WHERE "group" = 1
  UNION ALL
  SELECT x.*, p.bundle + j.new, CASE WHEN j.new = 0 THEN p.us ELSE 0 END + x.utterance_count, CASE WHEN j.new = 0 THEN p.cs + 1 ELSE 0 END + x.chars
  FROM packed p JOIN sized x ON x.corpus_id = p.corpus_id AND x.doc_id = p.doc_id AND x."group" = p."group" + 1,
    LATERAL (SELECT CASE WHEN x.short AND p.short AND x.speaker_id = p.speaker_id AND p.us + x.utterance_count <= 6 AND p.cs + 1 + x.chars <= 180 THEN 0 ELSE 1 END AS new) j
)
SELECT corpus_id, doc_id, bundle, any_value(speaker_id) AS speaker_id, min(start_sequence) AS start_sequence, max(end_sequence) AS end_sequence, CAST(sum(utterance_count) AS BIGINT) AS utterance_count, count(*) AS sentence_count,
  string_agg(text, ' ' ORDER BY "group") AS text, '' AS time_label, CASE WHEN count(*) > 1 THEN 'bundle:' ELSE '' END || string_agg(id, '|' ORDER BY "group") AS id FROM packed GROUP BY corpus_id, doc_id, bundle"""


@register("sentence_merge", _FOLDED + " SELECT * FROM merged")
def sentence_merge(spark, d):
    return merge.sentences(utterances(spark, d))


@register("bundle_merge", _FOLDED + _PACKED)
def bundle_merge(spark, d):
    return merge.bundles(merge.sentences(utterances(spark, d)))


@register(
    "speaker_view_sentences",
    _FOLDED + """ SELECT doc_id, "group", start_sequence, any_value(CASE WHEN speaker_id <> 'assistant' THEN text END) AS "user", any_value(CASE WHEN speaker_id = 'assistant' THEN text END) AS assistant FROM merged WHERE corpus_id = 'conv' GROUP BY ALL""",
)
def speaker_view_sentences(spark, d):
    rows = merge.sentences(utterances(spark, d, ("conv",)))
    return explore.speaker_columns(rows, ["user", "assistant"], "text", ("doc_id", "group", "start_sequence"))


@register("display_segments")
def segments(spark, d):
    rows = utterances(spark, d).select("corpus_id", "utterance_id", display_segments(F.col("form")).alias("parts"))
    return rows.select("corpus_id", "utterance_id", F.size("parts").cast("long").alias("n_segments"), F.array_join("parts", " | ").alias("segments"))


_STRIP = rf"trim(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<[^>]+>', '', 'gs'), '[{SPACE}]+', ' ', 'g'))"
_DECODED = "replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&')"


@register("strip_html_text", f"SELECT page_id, {_DECODED.format(_STRIP)} AS text, regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1) AS title FROM pages")
def strip_html_text(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return pages.select("page_id", strip_markup(F.col("html")).alias("text"), tag_text(F.col("html"), "title").alias("title"))


@register(
    "entity_decode",
    # each item's text with its signs written as entities of all kinds, which decode to the text again
    "SELECT item_id, text AS plain, text || ' &lt; & < ''é' AS decoded FROM benchmark",
)
def entity_decode(spark, d):
    rows = spark.read.parquet(f"{d}/benchmark.parquet")
    coded = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("e"), F.lit("&#101;")), F.lit("a"), F.lit("&#x61;"))
    return rows.select("item_id", entities(coded).alias("plain"), entities(F.concat(F.col("text"), F.lit(" &amp;lt; &AMP; &lt; &apos;&#xE9;"))).alias("decoded"))


@register(
    "explore_tree",
    """, n AS (SELECT corpus_id, category, topic, count(*) AS n FROM doc GROUP BY corpus_id, category, topic), t AS (SELECT *, row_number() OVER (PARTITION BY corpus_id, category ORDER BY n DESC, topic) AS r FROM n),
c AS (SELECT corpus_id, category, sum(n)::BIGINT AS n, string_agg(topic || '=' || n, ',' ORDER BY r) FILTER (r <= 100) AS topics FROM t GROUP BY corpus_id, category)
SELECT corpus_id, corpus_id AS corpus_name, '문장' AS unit_label, CAST(sum(n) AS BIGINT) AS count, string_agg(category || ':' || n || '(' || topics || ')', ';' ORDER BY n DESC, category) AS tree FROM c GROUP BY corpus_id""",
)
def explore_tree(spark, d):
    rows = Engine(spark, corpus(spark, d).folder).explore_tree()
    number = lambda x: x["count"].cast("string")
    node = lambda c: F.concat(c["category"], F.lit(":"), number(c), F.lit("("), F.array_join(F.transform(c["topics"], lambda t: F.concat(t["topic"], F.lit("="), number(t))), ","), F.lit(")"))
    return rows.select("corpus_id", "corpus_name", "unit_label", "count", F.array_join(F.transform("categories", node), ";").alias("tree"))


@register("token_stats", "SELECT corpus_id, 'raw' AS kind, term, count(*) AS count FROM tok GROUP BY ALL UNION ALL SELECT corpus_id, k, t, count(*) FROM (SELECT corpus_id, unnest(['provided', 'lemma', 'pos']) AS k, unnest([term, lemma, pos]) AS t FROM prov) GROUP BY ALL")
def token_stats(spark, d):
    return _t(spark, d, "token_stats").select("corpus_id", "kind", "term", "count")


@register(
    "value_stats",
    """SELECT corpus_id, 'topic' AS kind, topic AS value, count(*) AS count FROM doc WHERE topic <> '' GROUP BY ALL UNION ALL SELECT corpus_id, 'category', category, count(*) FROM doc WHERE category <> '' GROUP BY ALL
UNION ALL SELECT corpus_id, 'speaker', coalesce(nullif(speaker_sex, ''), '미상') || ' / ' || coalesce(nullif(speaker_age, ''), '미상') AS v, count(*) FROM utt GROUP BY corpus_id, v
UNION ALL SELECT corpus_id, 'marker', term, count(*) FROM tok WHERE term LIKE '{%' AND term LIKE '%}' GROUP BY corpus_id, term""",
)
def value_stats(spark, d):
    return _t(spark, d, "value_stats").select("corpus_id", "kind", "value", "count")


@register("corpus_records", "SELECT u.corpus_id, u.n AS utterance_count, d.n AS document_count, t.n + coalesce(p.n, 0) AS token_count FROM (SELECT corpus_id, count(*) AS n FROM utt GROUP BY 1) u JOIN (SELECT corpus_id, count(*) AS n FROM doc GROUP BY 1) d USING (corpus_id) JOIN (SELECT corpus_id, count(*) AS n FROM tok GROUP BY 1) t USING (corpus_id) LEFT JOIN (SELECT corpus_id, count(*) AS n FROM prov GROUP BY 1) p USING (corpus_id)")
def corpus_records(spark, d):
    return corpus(spark, d).catalog().select("corpus_id", "utterance_count", "document_count", "token_count")


@register(
    "utterances_with_corpus",
    "SELECT corpus_id, corpus_id AS corpus_name, doc_id, utterance_id, row_id, year FROM utt",
)
def utterances_with_corpus(spark, d):
    return Engine(spark, corpus(spark, d).folder).utterances().select("corpus_id", "corpus_name", "doc_id", "utterance_id", "row_id", "year")


_CSV = """, p AS (SELECT a.*, b.token_index AS e FROM tok a JOIN tok b ON a.corpus_id = b.corpus_id AND a.row_id = b.row_id AND b.token_index = a.token_index + 1 WHERE a.term = 'of' AND b.term = 'the'),
x AS (SELECT p.*, array_to_string(list_slice(w, greatest(token_index - 1, 1), token_index), ' ') AS l, array_to_string(list_slice(w, token_index + 1, token_index + 2), ' ') AS h, array_to_string(list_slice(w, token_index + 3, token_index + 4), ' ') AS r FROM p JOIN words u ON p.corpus_id = u.corpus_id AND p.row_id = u.row_id)
"""


@register(
    "csv_export",
    # every field as it is quoted in the file, the file's lines numbered in order
    _CSV
    + """SELECT n AS line, array_to_string(list_transform(f, lambda v: CASE WHEN regexp_matches(v, '[",\\r\\n]') THEN '"' || replace(v, '"', '""') || '"' ELSE v END), ',') AS text FROM (
  SELECT row_number() OVER (ORDER BY corpus_id, row_id, token_index) AS n, [corpus_id, corpus_id, doc_id, utterance_id, speaker_id, CAST(sequence AS VARCHAR), year, category, topic, '', '', '', speaker_sex, speaker_age, '', l, h, r, form, original_form, ''] AS f FROM x)""",
)
def csv_export(spark, d):
    """The lines of an exported file, read again as they stand in it."""
    engine = Engine(spark, corpus(spark, d).folder)
    path = f"{new_folder(spark)}/found.csv"
    engine.export_csv(search.Request('[text="of"] [text="the"]', mode="cql", context=2), path)
    return numbered_lines(spark, path).where((F.col("line") > 0) & (F.col("text") != ""))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, text) of a file's lines from 0, read by blocks of the file: a block's lines follow each other within a task, so the number of its first
    one gives all."""
    rows = spark.read.option("lineSep", "\r\n").text(path).select(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("text"))
    before, firsts = 0, []
    for r in sorted(rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).collect()):
        firsts.append((r["block"], before - r["id"]))
        before += r["n"]
    ahead = F.broadcast(spark.createDataFrame(firsts, "block long, ahead long"))
    return rows.join(ahead, "block").select((F.col("id") + F.col("ahead")).alias("line"), "text")


@register(
    "text_functions",
    """SELECT page_id, coalesce(nullif(regexp_extract(url, '[0-9]{3,4}'), ''), trim(url)) AS year, CASE WHEN len(p) > 2 THEN array_to_string(p[1 : len(p) - 1], '.') ELSE u END AS document, substring(sha1(url), 1, 10) AS hash, page_id % 2 = 0 AS marker
FROM (SELECT page_id, url, split_part(url, '/', 3) AS u, string_split(split_part(url, '/', 3), '.') AS p FROM pages WHERE url IS NOT NULL AND contains(url, '://'))""",
)
def text_functions(spark, d):
    rows = spark.read.parquet(f"{d}/pages.parquet").where("url is not null and contains(url, '://')")
    host = F.split_part("url", F.lit("/"), F.lit(3))
    mark = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" {"), host, F.lit("}"))).otherwise(F.concat(F.lit("{"), host, F.lit("} x")))
    return rows.select("page_id", year_of(F.col("url")).alias("year"), document_of_sentence(host).alias("document"), short_hash(F.col("url")).alias("hash"), is_marker(mark).alias("marker"))


@register(
    "document_detail",
    """SELECT 'conversation 7' AS title, any_value(topic) AS topic, any_value(category) AS category, '발화' AS unit_label, count(*) AS total, count(*) > 2 AS has_more, string_agg(DISTINCT speaker_id, ',' ORDER BY speaker_id) AS speakers FROM utt WHERE corpus_id = 'conv' AND doc_id = '7'""",
)
def document_detail(spark, d):
    engine = Engine(spark, corpus(spark, d).folder)
    doc = engine.document("conv", "7", limit=2)
    row = {k: doc.row[k] for k in ("title", "topic", "category")} | {"unit_label": doc.unit_label, "total": doc.total, "has_more": doc.has_more, "speakers": ",".join(sorted(engine.speakers_of(doc)))}
    return spark.createDataFrame([row], "title string, topic string, category string, unit_label string, total long, has_more boolean, speakers string")


@register(
    "search_page",
    """, hits AS (SELECT corpus_id, row_id, min(token_index) AS at FROM tok WHERE contains(term, 'of') AND (corpus_id, row_id) IN (SELECT corpus_id, row_id FROM tok WHERE term = 'of') GROUP BY ALL)
SELECT corpus_id, utterance_id, (SELECT count(*) FROM hits) > 47 AS has_more FROM hits JOIN utt USING (corpus_id, row_id) ORDER BY corpus_id, row_id LIMIT 7 OFFSET 40""",
)
def search_page(spark, d):
    page = Engine(spark, corpus(spark, d).folder).search(search.Request("of", limit=7, offset=40))
    return page.rows.select("corpus_id", "utterance_id", F.lit(page.has_more).alias("has_more"))

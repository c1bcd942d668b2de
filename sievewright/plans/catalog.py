"""The registered queries and their SQL counterparts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievewright.functions import content, planning, text, urls
from sievewright.functions.reputation import DOMAINS, ENDINGS, credibility
from sievewright.operators import analyze, daily, feed, pairs, post_index, quality, recursion, report, secret_rules, vectors
from sievewright.operators.lineage import checkpoint_dir, cut
from sievewright.sources import memory, state, tables
from sievewright.sources.tables import table
from sievewright.sources.versions import VersionedTable
from sievewright.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---- pieces of the SQL side ----
_STOP = "[" + ", ".join(map(_quote, text.STOPWORDS)) + "]"
_TOKENS = r"list_concat(list_transform(regexp_extract_all(coalesce(text, ''), '[a-zA-Z]{2,}'), lambda x: lower(x)), regexp_extract_all(coalesce(text, ''), '[\x{4e00}-\x{9fff}]'))"
_FILTERED = f"list_filter({_TOKENS}, lambda t: NOT list_contains({_STOP}, t))"
_NEGATES = " OR ".join(f"regexp_matches(coalesce(text, ''), {_quote(p)})" for p in text.NEGATION)
_HOST = r"regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', '')"
_LEVELS = "(VALUES " + ", ".join(f"({_quote(d)}, {_quote(v)})" for d, v in DOMAINS.items()) + ") levels(domain, level)"
_ENDS = "(VALUES " + ", ".join(f"({_quote(d)}, {_quote(v)})" for d, v in ENDINGS.items()) + ") ends(ending, level)"


def _credibility_sql(source: str) -> str:
    """CTEs hosts (url, host) and cred (url, level) over `source` (a table or subquery with url)."""
    return f"""hosts AS (SELECT DISTINCT url, {_HOST} AS host FROM {source}),
names AS (SELECT url, i, array_to_string(string_split(host, '.')[i:], '.') AS domain FROM (SELECT url, host, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM hosts)),
exact AS (SELECT url, arg_min(level, i) AS level FROM names JOIN {_LEVELS} USING (domain) GROUP BY url),
ending AS (SELECT url, arg_max(level, length(ending)) AS level FROM hosts JOIN {_ENDS} ON ends_with(host, ending) GROUP BY url),
cred AS (SELECT url, coalesce(exact.level, ending.level, 'MEDIUM') AS level FROM hosts LEFT JOIN exact USING (url) LEFT JOIN ending USING (url))"""


_NORMAL = r"""lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) || '://' || """ + _HOST + r""" ||
 CASE WHEN regexp_replace(regexp_extract(url, '^[a-zA-Z0-9+.-]+://[^/?#]*([^?#]*)', 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(url, '^[a-zA-Z0-9+.-]+://[^/?#]*([^?#]*)', 1), '/+$', '') END ||
 CASE WHEN regexp_extract(url, '^[^?#]*\?([^#]*)', 1) = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&')), '&') END"""
_FACTS = "facts AS (SELECT doc_id AS seq, doc_id AS id, text, source AS source_title, doc_id % 4 AS depth_level, p.url AS source_url FROM documents LEFT JOIN pages p ON p.page_id = doc_id % (SELECT count(*) FROM pages))"
_QUERIES = "queries AS (SELECT conv_id * 10000 + turn AS seq, text FROM conversations WHERE role = 'user')"


def _terms_sql(source: str) -> str:
    """CTE counts (seq, term, n, pos, total)."""
    return f"""counts AS (SELECT seq, term, count(*) AS n, min(pos) AS pos, any_value(total) AS total
 FROM (SELECT seq, len(t) AS total, unnest(t) AS term, unnest(range(0, len(t))) AS pos FROM (SELECT seq, {_FILTERED} AS t FROM {source})) GROUP BY seq, term)"""


def _weights_sql(source: str) -> str:
    return f"""{_terms_sql(source)},
weights AS (SELECT seq, term, n, pos, total, df, n / total * (ln(((SELECT count(*) FROM {source}) + 1) / (df + 1)) + 1) AS weight
 FROM counts JOIN (SELECT term, count(*) AS df FROM counts GROUP BY term) USING (term))"""


def _cosine_sql(rows: str, weight: str, least: float, name: str = "pairs") -> str:
    return f"""{name}_unit AS (SELECT seq, term, {weight} / norm AS w FROM {rows} JOIN (SELECT seq, sqrt(sum({weight} * {weight})) AS norm FROM {rows} GROUP BY seq) USING (seq)),
{name} AS (SELECT x.seq AS a, y.seq AS b, sum(x.w * y.w) AS sim FROM {name}_unit x JOIN {name}_unit y ON x.term = y.term AND x.seq < y.seq GROUP BY x.seq, y.seq HAVING sum(x.w * y.w) >= {least} - 1e-9)"""


def _leaders_sql(nodes: str, edges: str, name: str = "dup") -> str:
    """CTE `name` (node, duplicate_of) of the ordered pass, by rounds over lists of settled nodes."""
    return f"""{name}_order AS (SELECT seq, row_number() OVER (ORDER BY seq) AS i FROM (SELECT DISTINCT seq FROM (SELECT a AS seq FROM {edges} UNION ALL SELECT b FROM {edges}))),
{name}_near AS (SELECT o.i, o.seq, list(e.a) FILTER (e.a IS NOT NULL) AS before FROM {name}_order o LEFT JOIN {edges} e ON e.b = o.seq GROUP BY o.i, o.seq),
{name}_pass AS (
  SELECT 0::BIGINT AS i, []::BIGINT[] AS lead
  UNION ALL
  SELECT p.i + 1, CASE WHEN list_has_any(p.lead, coalesce(n.before, []::BIGINT[])) THEN p.lead ELSE list_append(p.lead, n.seq::BIGINT) END FROM {name}_pass p JOIN {name}_near n ON n.i = p.i + 1
),
{name}_lead AS (SELECT unnest(lead) AS lead FROM (SELECT lead FROM {name}_pass ORDER BY i DESC LIMIT 1)),
{name} AS (SELECT b AS node, min(a) AS duplicate_of FROM {edges} WHERE a IN (SELECT lead FROM {name}_lead) AND b NOT IN (SELECT lead FROM {name}_lead) GROUP BY b)"""


_SOURCE_INDEX = f"""{_FACTS}, used AS (SELECT source_url AS url, min(seq) AS seq, arg_min(source_title, seq) AS title FROM facts WHERE coalesce(source_url, '') <> '' GROUP BY source_url),
{_credibility_sql("used")}, sources AS (SELECT row_number() OVER (ORDER BY seq) AS index, url, title, level AS credibility,
 CASE level WHEN 'HIGH' THEN '高可信度' WHEN 'MEDIUM' THEN '中等可信度' WHEN 'LOW' THEN '低可信度' ELSE '未知' END AS credibility_label FROM used JOIN cred USING (url))"""


# ---- scalars ----
@query(f"SELECT doc_id, array_to_string({_TOKENS}, ' ') AS tokens FROM documents")
def tokenize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(text.tokens(F.coalesce("text", F.lit(""))), " ").alias("tokens"))


@query(f"SELECT doc_id, array_to_string({_FILTERED}, ' ') AS tokens FROM documents")
def tokens_filtered(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(text.filtered_tokens(F.coalesce("text", F.lit(""))), " ").alias("tokens"))


@query(f"WITH f AS (SELECT doc_id AS seq, text FROM documents), {_terms_sql('f')} SELECT seq, term, n, pos, total FROM counts")
def term_counts(spark, d):
    return vectors.term_counts(tables.bare_facts(spark, d))


@query(f"SELECT doc_id, {_NEGATES} AS negated FROM documents")
def negation_flag(spark, d):
    return table(spark, d, "documents").select("doc_id", text.has_negation(F.coalesce("text", F.lit(""))).alias("negated"))


@query(f"SELECT page_id, {_NORMAL} AS normalized FROM pages")
def url_normalize(spark, d):
    return table(spark, d, "pages").select("page_id", urls.normalise(F.col("url")).alias("normalized"))


@query(f"WITH {_credibility_sql('pages')} SELECT page_id, host, level AS credibility FROM pages JOIN hosts USING (url) JOIN cred USING (url)")
def url_credibility(spark, d):
    return table(spark, d, "pages").select("page_id", urls.host(F.col("url")).alias("host"), credibility(urls.host(F.col("url"))).alias("credibility"))


@query(f"""WITH n AS (SELECT page_id, {_NORMAL} AS normalized FROM pages) SELECT normalized, min(page_id) AS page_id FROM n
 WHERE page_id > (SELECT median(page_id) FROM pages) AND normalized NOT IN (SELECT normalized FROM n WHERE page_id <= (SELECT median(page_id) FROM pages)) GROUP BY normalized""")
def url_dedup(spark, d):
    """The first half of the pages, by id, has been visited; of the others the first of each URL that is not among them."""
    rows = table(spark, d, "pages").select(F.col("page_id").alias("seq"), "url")
    half = rows.agg(F.median("seq").alias("half"))  # one row
    rows = rows.crossJoin(F.broadcast(half))
    visited = rows.where("seq <= half").select(urls.normalise(F.col("url")).alias("normalized"))
    return state.unseen_urls(visited, rows.where("seq > half").select("seq", "url")).select("normalized", F.col("seq").alias("page_id"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM pages")
def html_strip_regex(spark, d):
    return table(spark, d, "pages").select("page_id", content.strip_tags(F.col("html")).alias("text"))


@query(r"SELECT page_id, regexp_matches(html[1:500], '(?i)<\s*(html|body|div|p|span|head)([^\p{L}\p{N}_]|$)') AS is_html FROM pages")
def html_sniff(spark, d):
    return table(spark, d, "pages").select("page_id", content.is_html(F.col("html")).alias("is_html"))


def _type_sql() -> str:
    scores = {t: " + ".join(f"regexp_matches(s, {_quote(p)})::INT" for p in ps) for t, ps in content.type_patterns().items()}
    best = "greatest(" + ", ".join(scores.values()) + ")"
    cases = " ".join(f"WHEN {s} = {best} THEN '{t}'" for t, s in scores.items())
    return f"CASE WHEN {best} < 2 THEN 'unknown' {cases} END"


@query(f"SELECT page_id, {_type_sql()} AS content_type FROM (SELECT page_id, html[1:3000] AS s FROM pages)")
def content_type(spark, d):
    return table(spark, d, "pages").select("page_id", content.content_type(F.col("html")).alias("content_type"))


_NAV = " OR ".join(f"regexp_matches(x, {_quote(p)})" for p in content.NAVIGATION)


@query(rf"""SELECT doc_id, regexp_replace(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT ({_NAV})), chr(10)), '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents""")
def markdown_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", content.clean_markdown(F.col("text")).alias("text"))


@query()
def html_extract(spark, d):
    return table(spark, d, "pages").select("page_id", content.extract_html(F.col("html")).alias("text"))


@query()
def process_content(spark, d):
    return table(spark, d, "pages").select("page_id", content.process(F.col("html"), F.col("url")).alias("p")).select("page_id", "p.*")


_RULE_HITS = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS rule FROM documents WHERE regexp_matches(text, {_quote(p)})" for n, p in secret_rules.RULES.items())


@query(_RULE_HITS)
def secret_scan(spark, d):
    return secret_rules.hits(table(spark, d, "documents"))


@query(f"SELECT count(DISTINCT doc_id) AS docs_hit, count(DISTINCT doc_id) > 0 AS blocked FROM ({_RULE_HITS})")
def secret_gate(spark, d):
    return secret_rules.gate(table(spark, d, "documents"))


@query("""SELECT mode, max_depth, base_breadth, min_sources, count(doc_id) AS documents FROM (VALUES ('quick', 1, 3, 5, 0), ('standard', 3, 4, 10, NULL), ('deep', 5, 5, 15, 1)) m(mode, max_depth, base_breadth, min_sources, q)
 LEFT JOIN (SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)) ON quality IS NOT DISTINCT FROM q GROUP BY ALL""")
def mode_config(spark, d):
    """The modes and how many documents ask for each, by their quality label."""
    named = F.when(F.col("quality") == 0, "quick").when(F.col("quality") == 1, "deep").otherwise("standard")
    asked = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").groupBy(named.alias("mode")).agg(F.count(F.lit(1)).alias("documents"))
    return planning.modes(spark).join(asked, "mode", "left").select("mode", "max_depth", "base_breadth", "min_sources", F.coalesce("documents", F.lit(0)).alias("documents"))


_TURNS = "(SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS turns FROM conversations)"


def _turns(spark, d):
    """Every turn with the number of its conversation's, which is counted before the rows meet."""
    rows = table(spark, d, "conversations").select("conv_id", "turn")
    return rows.join(rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns")), "conv_id")


@query(f"SELECT conv_id, turn, greatest(2, floor(turns * pow(0.7, turn))::INT) AS breadth FROM {_TURNS}")
def breadth_schedule(spark, d):
    """Every turn as a depth of its conversation, whose number of turns is the breadth at the first."""
    return _turns(spark, d).select("conv_id", "turn", planning.breadth(F.col("turns"), F.col("turn")).alias("breadth"))


@query(f"SELECT conv_id, turn, breadth, greatest(1, breadth // 2)::INT AS agents, greatest(2, ceil(breadth / greatest(1, breadth // 2)))::INT AS queries_per_agent FROM (SELECT conv_id, turn, greatest(2, floor((turns + turn) * pow(0.7, turn))::INT) AS breadth FROM {_TURNS})")
def query_allocation(spark, d):
    """Agents and their queries at every turn, by the breadth there."""
    rows = _turns(spark, d).select("conv_id", "turn", planning.breadth(F.col("turns") + F.col("turn"), F.col("turn")).alias("breadth"))
    return rows.withColumns({"agents": planning.agents(F.col("breadth")), "queries_per_agent": planning.queries_per_agent(F.col("breadth"))})


@query("""SELECT conv_id, turn, CASE role WHEN 'system' THEN 'deep' WHEN 'assistant' THEN 'quick' ELSE 'standard' END AS mode, CASE WHEN turn % 3 > 0 THEN turn % 3 ELSE CASE role WHEN 'system' THEN 5 WHEN 'assistant' THEN 1 ELSE 3 END END::INT AS depth,
 CASE WHEN turn % 4 > 0 THEN turn % 4 ELSE CASE role WHEN 'system' THEN 5 WHEN 'assistant' THEN 3 ELSE 4 END END::INT AS breadth FROM conversations""")
def run_settings(spark, d):
    """Every turn as a run that asks for a depth and a breadth, 0 being what its mode has."""
    named = F.when(F.col("role") == "system", "deep").when(F.col("role") == "assistant", "quick").when(F.col("role") == "user", "standard")
    rows = table(spark, d, "conversations").select("conv_id", "turn", named.alias("mode"), (F.col("turn") % 3).cast("int").alias("depth"), (F.col("turn") % 4).cast("int").alias("breadth"))
    return planning.with_settings(rows, "mode", "depth", "breadth").select("conv_id", "turn", "mode", "depth", "breadth")


@query(r"""SELECT conv_id, turn, 'https://example.org/search?q=' || replace(replace(replace(replace(url_encode(text), '%20', '+'), '~', '%7E'), '%2A', '*'), '%2a', '*') || '&src=typed' AS url FROM conversations WHERE role = 'user' AND text IS NOT NULL""")
def search_urls(spark, d):
    """Every user turn as a search."""
    rows = table(spark, d, "conversations").where("role = 'user' AND text IS NOT NULL")
    return rows.select("conv_id", "turn", urls.search_url("https://example.org/search", F.col("text"), src="typed").alias("url"))


# ---- vectors ----
@query(f"WITH f AS (SELECT doc_id AS seq, text FROM documents), {_terms_sql('f')} SELECT term, count(*) AS df FROM counts GROUP BY term")
def doc_freq(spark, d):
    return vectors.document_frequency(vectors.term_counts(tables.bare_facts(spark, d)))


@query(f"WITH f AS (SELECT doc_id AS seq, text FROM documents), {_weights_sql('f')} SELECT seq, term, round(weight, 6) AS weight FROM weights")
def tfidf_vectors(spark, d):
    return vectors.weighted(tables.bare_facts(spark, d)).select("seq", "term", F.round("weight", 6).alias("weight"))


def _top_sql(rows: str, by: str, k: int) -> str:
    return f"SELECT seq, rank, term FROM (SELECT seq, term, row_number() OVER (PARTITION BY seq ORDER BY {by} DESC, pos) AS rank FROM {rows}) WHERE rank <= {k}"


@query(f"WITH f AS (SELECT doc_id AS seq, text FROM documents), {_weights_sql('f')} {_top_sql('weights', 'round(weight, 12)', 8)}")
def keywords_topk(spark, d):
    return vectors.top_keywords(tables.bare_facts(spark, d), 8)


@query(f"WITH f AS (SELECT doc_id AS seq, text FROM documents), {_terms_sql('f')} {_top_sql('counts', 'n', 10)}")
def keywords_tf(spark, d):
    return vectors.top_keywords(tables.bare_facts(spark, d), 10, by="n")


@query(f"WITH f AS (SELECT item_id AS seq, text FROM benchmark), {_terms_sql('f')}, {_cosine_sql('counts', 'n', 0.3)} SELECT a, b, round(sim, 6) AS sim FROM pairs")
def bow_pairs(spark, d):
    facts = table(spark, d, "benchmark").select(F.col("item_id").alias("seq"), "text")
    return pairs.bow_pairs(facts, 0.3).select("a", "b", F.round("sim", 6).alias("sim"))


@query(f"WITH f AS (SELECT doc_id AS seq, text FROM documents), {_weights_sql('f')}, {_cosine_sql('weights', 'weight', 0.5)} SELECT a, b, round(sim, 6) AS sim FROM pairs")
def tfidf_pairs(spark, d):
    return pairs.tfidf_pairs(tables.bare_facts(spark, d), 0.5).select("a", "b", F.round("sim", 6).alias("sim"))


@query(f"""WITH f AS (SELECT doc_id AS seq, text FROM documents), {_terms_sql('f')}, two AS (SELECT a, b FROM (SELECT seq AS a, lead(seq) OVER (ORDER BY seq) AS b FROM f) WHERE b IS NOT NULL),
own AS (SELECT a, b, seq, term, n / total AS tf, ln(3 / (count(*) OVER (PARTITION BY a, term) + 1)) + 1 AS idf FROM two JOIN counts ON seq = a OR seq = b),
norms AS (SELECT a, seq, sqrt(sum(tf * idf * tf * idf)) AS norm FROM own GROUP BY a, seq),
sims AS (SELECT x.a, sum(x.tf * x.idf * y.tf * y.idf) / any_value(nx.norm * ny.norm) AS sim FROM own x JOIN own y ON x.a = y.a AND x.term = y.term AND x.seq = x.a AND y.seq = y.b JOIN norms nx ON nx.a = x.a AND nx.seq = x.a JOIN norms ny ON ny.a = x.a AND ny.seq = x.b GROUP BY x.a)
SELECT a, b, round(coalesce(sim, 0), 6) AS sim FROM two LEFT JOIN sims USING (a)""")
def tfidf_pair_each(spark, d):
    """The cosine of each document and its successor by doc_id, every pair under its own statistics."""
    return pairs.successor_cosines(tables.bare_facts(spark, d)).select("a", "b", F.round("sim", 6).alias("sim"))


# ---- dedup and clusters ----
_DEDUP = f"WITH RECURSIVE f AS (SELECT doc_id AS seq, text FROM documents), {_weights_sql('f')}, {_cosine_sql('weights', 'weight', 0.85)}, {_leaders_sql('f', 'pairs')}"


@query(f"{_DEDUP} SELECT seq AS doc_id, duplicate_of IS NOT NULL AS is_duplicate, duplicate_of FROM f LEFT JOIN dup ON node = seq")
def dedup_leaders(spark, d):
    return analyze.deduplicate(tables.bare_facts(spark, d)).select(F.col("seq").alias("doc_id"), "is_duplicate", "duplicate_of")


@query(f"{_DEDUP} SELECT count(*) AS before, count(*) - count(duplicate_of) AS after, count(duplicate_of) AS removed, round(count(duplicate_of) / count(*), 6) AS rate FROM f LEFT JOIN dup ON node = seq")
def dedup_stats(spark, d):
    flagged = analyze.deduplicate(tables.bare_facts(spark, d))
    n, gone = F.count(F.lit(1)), F.count_if("is_duplicate")
    return flagged.agg(n.alias("before"), (n - gone).alias("after"), gone.alias("removed"), F.round(gone / n, 6).alias("rate"))


@query(f"WITH RECURSIVE {_QUERIES}, {_terms_sql('queries')}, {_cosine_sql('counts', 'n', 0.75)}, {_leaders_sql('queries', 'pairs')} SELECT seq, duplicate_of IS NOT NULL AS is_duplicate, duplicate_of FROM queries LEFT JOIN dup ON node = seq")
def query_dedup(spark, d):
    return analyze.query_dedup(tables.queries_log(spark, d)).select("seq", "is_duplicate", "duplicate_of")


@query(f"WITH {_QUERIES}, {_terms_sql('queries')}, {_cosine_sql('counts', 'n', 0.75)} SELECT b AS seq, min(a) AS match FROM pairs GROUP BY b")
def query_earliest_match(spark, d):
    """Every user query against all before it: the earliest alike."""
    return pairs.earliest_match(tables.queries_log(spark, d), analyze.QUERY)


_ACTIVE = f"{_DEDUP}, act AS (SELECT seq, text FROM f WHERE seq NOT IN (SELECT node FROM dup))"
_ACT_WEIGHTS = _weights_sql("act").replace("counts", "acounts").replace("weights", "aweights")
_KEYWORDS = f"{_ACTIVE}, {_ACT_WEIGHTS}, kw AS ({_top_sql('aweights', 'round(weight, 12)', 8)})"
_EDGES = f"""{_KEYWORDS}, kn AS (SELECT seq, count(*) AS n FROM kw GROUP BY seq),
edges AS (SELECT x.seq AS a, y.seq AS b, count(*) AS shared, round(count(*) / least(nx.n, ny.n), 6) AS overlap FROM kw x JOIN kw y ON x.term = y.term AND x.seq < y.seq JOIN kn nx ON nx.seq = x.seq JOIN kn ny ON ny.seq = y.seq GROUP BY x.seq, y.seq, nx.n, ny.n HAVING count(*) / least(nx.n, ny.n) >= 0.3)"""
_COMPONENTS = f"""{_EDGES}, labels AS (
  SELECT 0 AS round, seq AS node, seq AS label FROM act
  UNION ALL
  SELECT round + 1, node, min(label) FROM (
    SELECT round, node, label FROM labels UNION ALL
    SELECT l.round, e.b, l.label FROM labels l JOIN edges e ON e.a = l.node UNION ALL
    SELECT l.round, e.a, l.label FROM labels l JOIN edges e ON e.b = l.node) WHERE round < 40 GROUP BY round, node
), comp AS (SELECT node, label FROM labels WHERE round = 40)"""


def _active(spark, d):
    return cut(analyze.active(analyze.deduplicate(tables.bare_facts(spark, d))).select("seq", "id", "text"))


@query(f"{_EDGES} SELECT a, b, shared, overlap FROM edges")
def keyword_edges(spark, d):
    return analyze.keyword_edges(_active(spark, d)).select("a", "b", "shared", F.round("overlap", 6).alias("overlap"))


@query(f"{_COMPONENTS} SELECT node, label AS component FROM comp")
def keyword_components(spark, d):
    rows = _active(spark, d)
    found = analyze.keyword_components(rows).withColumnRenamed("node", "seq")
    return rows.join(found, "seq", "left").select(F.col("seq").alias("node"), F.coalesce("component", "seq").alias("component"))


@query(f"""{_COMPONENTS}, ids AS (SELECT node, dense_rank() OVER (ORDER BY label) - 1 AS cluster_id FROM comp),
words AS (SELECT cluster_id, term, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, min(seq), arg_min(rank, seq)) AS r FROM kw JOIN ids ON node = seq GROUP BY cluster_id, term)
SELECT cluster_id, coalesce((SELECT string_agg(term, ' / ' ORDER BY r) FROM words w WHERE w.cluster_id = ids.cluster_id AND r <= 3), '') AS label,
 coalesce((SELECT string_agg(term, ' ' ORDER BY r) FROM words w WHERE w.cluster_id = ids.cluster_id AND r <= 5), '') AS keywords,
 string_agg(node, ' ' ORDER BY node) AS members, count(*) AS size FROM ids GROUP BY cluster_id""")
def clusters(spark, d):
    found = analyze.clusters(_active(spark, d))
    return found.select("cluster_id", "label", F.array_join("keywords", " ").alias("keywords"), F.array_join(F.transform("member_ids", lambda x: x.cast("string")), " ").alias("members"), "size")


_CONFLICTS = f"""{_ACTIVE}, {_ACT_WEIGHTS}, {_cosine_sql('aweights', 'weight', 0.5, 'apairs')}, neg AS (SELECT seq, {_NEGATES} AS neg FROM act),
found AS (SELECT a, b, sim FROM apairs JOIN neg x ON x.seq = a JOIN neg y ON y.seq = b WHERE x.neg <> y.neg)"""


@query(f"{_CONFLICTS} SELECT a AS learning_a, b AS learning_b, round(sim, 6) AS similarity FROM found")
def conflicts(spark, d):
    return analyze.conflicts(_active(spark, d)).select("learning_a", "learning_b", F.round("similarity", 6).alias("similarity"))


@query(f"{_CONFLICTS} SELECT learning, string_agg(other, ' ' ORDER BY a, b) AS conflicts_with FROM (SELECT a AS learning, b AS other, a, b FROM found UNION ALL SELECT b, a, a, b FROM found) GROUP BY learning")
def conflict_lists(spark, d):
    found = analyze.conflict_lists(analyze.conflicts(_active(spark, d)))
    return found.select("learning", F.array_join(F.transform("conflicts_with", lambda x: x.cast("string")), " ").alias("conflicts_with"))


@query(f"""{_COMPONENTS}, {_cosine_sql('aweights', 'weight', 0.5, 'apairs')}, neg AS (SELECT seq, {_NEGATES} AS neg FROM act)
SELECT (SELECT count(*) FROM f) AS total_learnings, (SELECT count(*) FROM act) AS active_learnings, (SELECT count(*) FROM dup) AS duplicates_found,
 (SELECT count(DISTINCT label) FROM comp) AS total_clusters, (SELECT count(*) FROM apairs JOIN neg x ON x.seq = a JOIN neg y ON y.seq = b WHERE x.neg <> y.neg) AS total_conflicts""")
def analysis_summary(spark, d):
    flagged = cut(analyze.deduplicate(tables.bare_facts(spark, d)))
    rows = analyze.active(flagged).select("seq", "id", "text")
    return analyze.summary(flagged, analyze.assigned(rows).select("cluster_id").distinct(), analyze.conflicts(rows))


# ---- output ----
@query(f"WITH {_SOURCE_INDEX} SELECT * FROM sources")
def source_index(spark, d):
    return report.source_index(tables.facts(spark, d))


@query(f"WITH {_SOURCE_INDEX} SELECT seq, index AS cite FROM facts LEFT JOIN sources ON url = source_url")
def cited_facts(spark, d):
    rows = tables.facts(spark, d)
    return report.cited(rows, report.source_index(rows)).select("seq", "cite")


@query(f"WITH {_SOURCE_INDEX} SELECT seq, source_url, credibility FROM facts JOIN sources ON url = source_url ORDER BY CASE credibility WHEN 'HIGH' THEN 0 WHEN 'LOW' THEN 2 ELSE 1 END, seq LIMIT 15")
def brief_top15(spark, d):
    return report.brief_order(state.with_credibility(tables.facts(spark, d))).select("seq", "source_url", "credibility")


_BY_SOURCE = "g AS (SELECT doc_id AS seq, text, dense_rank() OVER (ORDER BY source) AS grp, source AS label FROM documents)"


@query(f"WITH {_BY_SOURCE} SELECT grp AS \"group\", label, n, place, text[1:80] || '...' AS preview FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n, row_number() OVER (PARTITION BY grp ORDER BY seq) AS place FROM g) WHERE place <= 3")
def outline_preview(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("seq"), "text", "source")
    names = rows.select("source").distinct().withColumn("group", F.row_number().over(Window.orderBy("source")))
    return report.outline_preview(rows, rows.join(names, "source").select("seq", "group", F.col("source").alias("label")))


@query(f"""{_COMPONENTS}, ids AS (SELECT node, dense_rank() OVER (ORDER BY label) AS grp FROM comp) SELECT seq, coalesce(grp, (SELECT max(grp) FROM ids) + 1) AS "group" FROM f LEFT JOIN ids ON node = seq""")
def group_assignment(spark, d):
    """Facts by cluster; the duplicates, which have none, in a last group."""
    every = tables.bare_facts(spark, d)
    rows = _active(spark, d)
    member = cut(analyze.assigned(rows))
    return report.grouped(every, member, member.select("cluster_id").distinct().withColumn("label", F.lit("x"))).select("seq", "group")


_REPORTS = """reports AS (SELECT page_id AS id, 'See [' || page_id % 7 || '] and [' || page_id || '] [2-3] ' || url || ' (' || url || 'x) ' || CASE WHEN page_id % 5 = 0 THEN 'todo: TBD' ELSE 'done' END AS text FROM pages)"""


def _reports(spark, d):
    i = F.col("page_id").cast("string")
    said = F.concat(F.lit("See ["), (F.col("page_id") % 7).cast("string"), F.lit("] and ["), i, F.lit("] [2-3] "), F.col("url"), F.lit(" ("), F.col("url"), F.lit("x) "), F.when(F.col("page_id") % 5 == 0, "todo: TBD").otherwise("done"))
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), said.alias("text"))


@query(rf"""WITH {_REPORTS}, c AS (SELECT id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '\[(\d+)\]', 1), lambda x: x::INT))) AS c FROM reports)
SELECT id, array_to_string(c, ' ') AS cited, array_to_string(list_filter(c, lambda x: x < 1 OR x > 20), ' ') AS missing, len(list_filter(range(1, 21), lambda x: NOT list_contains(c, x::INT)))::INT AS n_unused FROM c""")
def citation_check(spark, d):
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return report.citations(_reports(spark, d), 20).select("id", join("cited").alias("cited"), join("missing").alias("missing"), F.size("unused").alias("n_unused"))


@query(rf"WITH {_REPORTS} SELECT DISTINCT id, u AS url FROM (SELECT id, unnest(regexp_extract_all(text, 'https?://[^\s)]+')) AS u FROM reports) WHERE u NOT IN (SELECT url FROM pages)")
def url_check(spark, d):
    return report.unvisited(_reports(spark, d), table(spark, d, "pages"))


@query(f"WITH {_REPORTS} SELECT id, len(regexp_extract_all(text, '(?i)({'|'.join(report.PLACEHOLDERS)})'))::INT AS placeholders FROM reports")
def placeholder_check(spark, d):
    return _reports(spark, d).select("id", report.placeholders(F.col("text")).alias("placeholders"))


@query(rf"WITH {_REPORTS} SELECT id, len(regexp_extract_all(text, '\[\d+-\d+\]'))::INT AS ranges FROM reports")
def range_check(spark, d):
    return _reports(spark, d).select("id", F.size(F.regexp_extract_all("text", F.lit(report.RANGE), F.lit(0))).alias("ranges"))


@query(rf"""WITH {_SOURCE_INDEX}, {_REPORTS}, n AS (SELECT count(*)::INT AS n FROM sources),
c AS (SELECT id, text, list_distinct(list_transform(regexp_extract_all(text, '\[(\d+)\]', 1), lambda x: x::INT)) AS c FROM reports),
bad AS (SELECT id, count(DISTINCT u) AS bad FROM (SELECT id, unnest(regexp_extract_all(text, 'https?://[^\s)]+')) AS u FROM reports) WHERE u NOT IN (SELECT url FROM pages) GROUP BY id),
t AS (SELECT id, len(list_filter(c, lambda x: x < 1 OR x > n))::INT AS missing_citations, coalesce(bad, 0) AS unvisited_urls, len(regexp_extract_all(text, '(?i)({'|'.join(report.PLACEHOLDERS)})'))::INT AS placeholders,
 len(regexp_extract_all(text, '\[\d+-\d+\]'))::INT AS ranges, len(c)::INT AS cited_sources, n AS total_sources, (n - len(list_filter(c, lambda x: x >= 1 AND x <= n)))::INT AS unused_sources, coalesce(list_max(c), 0) = len(c) AS gapless FROM c LEFT JOIN bad USING (id), n)
SELECT *, missing_citations + unvisited_urls + placeholders + ranges = 0 AS valid FROM t""")
def report_validation(spark, d):
    pages = table(spark, d, "pages")
    rows = report.source_index(tables.facts(spark, d))
    return report.validate(_reports(spark, d), rows, pages)


_FULL_REPORTS = """full_reports AS (SELECT page_id AS id, '## 摘要' || chr(10) || CASE WHEN page_id % 4 = 0 THEN '<!-- 200-300 -->' ELSE 'All of ' || url END || chr(10) || chr(10) || '## 1. A' || chr(10) || '- x [1] [2]' || CASE WHEN page_id % 7 = 0 THEN ' [4]' ELSE '' END || chr(10)
 || '## 2. B' || chr(10) || CASE WHEN page_id % 3 = 0 THEN '' ELSE '- y [' || (page_id % 16 + 1) || ']' END || chr(10) || '## 信息来源' || chr(10) || url || CASE page_id % 11 WHEN 0 THEN ' [2-3]' WHEN 1 THEN ' tbd' WHEN 2 THEN ' due to length' WHEN 3 THEN 'x' ELSE '' END AS text FROM pages)"""


def _full_reports(spark, d):
    i, nl, url = F.col("page_id"), F.lit("\n"), F.col("url")
    tail = F.when(i % 11 == 0, " [2-3]").when(i % 11 == 1, " tbd").when(i % 11 == 2, " due to length").when(i % 11 == 3, "x").otherwise("")
    summary = F.when(i % 4 == 0, "<!-- 200-300 -->").otherwise(F.concat(F.lit("All of "), url))
    second = F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("- y ["), (i % 16 + 1).cast("string"), F.lit("]")))
    text = F.concat(F.lit("## 摘要\n"), summary, F.lit("\n\n## 1. A\n- x [1] [2]"), F.when(i % 7 == 0, " [4]").otherwise(""), F.lit("\n## 2. B\n"), second, F.lit("\n## 信息来源\n"), url, tail)
    return table(spark, d, "pages").select(i.alias("id"), text.alias("text"))


def _nine_sql() -> str:
    cut_short, rest = "|".join(report.CUT_SHORT), "|".join(p for p in report.PLACEHOLDERS if p not in report.CUT_SHORT)
    good = (
        "coalesce(list_max(c), 0) = len(c) AND coalesce(list_min(c), 1) >= 1", "len(list_filter(c, lambda x: x < 1 OR x > n)) = 0", r"NOT regexp_matches(text, '\[\d+-\d+\]')", f"NOT regexp_matches(text, '(?i)({rest})')", f"NOT regexp_matches(text, '(?i)({cut_short})')",
        "id NOT IN (SELECT id FROM bad)", "len(c) >= 5", r"len(list_filter(parts, lambda x: regexp_matches(x, '^\d+\. ') AND NOT regexp_matches(x, '(?s)\n.*\S'))) = 0",
        r"len(list_filter(parts, lambda x: starts_with(x, '摘要'))) > 0 AND len(list_filter(parts, lambda x: starts_with(x, '摘要') AND NOT regexp_matches(regexp_replace(x, '(?s)<!--.*?-->', '', 'g'), '(?s)\n.*\S'))) = 0",
    )
    each = " UNION ALL ".join(f"SELECT id, '{name}' AS check, {g} AS good FROM c" for name, g in zip(quality.CHECKS, good))
    return rf"""WITH {_SOURCE_INDEX}, {_FULL_REPORTS},
bad AS (SELECT id FROM (SELECT id, unnest(regexp_extract_all(text, 'https?://[^\s)]+')) AS u FROM full_reports) WHERE u NOT IN (SELECT url FROM pages)),
c AS (SELECT id, text, list_distinct(list_transform(regexp_extract_all(text, '\[(\d+)\]', 1), lambda x: x::INT)) AS c, regexp_split_to_array(text, '(?m)^## ') AS parts, (SELECT count(*) FROM sources) AS n FROM full_reports)
SELECT * FROM ({each})"""


@query(_nine_sql())
def nine_checks(spark, d):
    """The nine checks of reports over the pages, all from tables."""
    return quality.nine_checks(_full_reports(spark, d), report.source_index(tables.facts(spark, d)), table(spark, d, "pages"), "quick")


def _brief_sql() -> str:
    head = f"(SELECT count(*) FROM pages) || ' 个来源 | ' || (SELECT count(*) FROM documents) || ' 条有效发现'"
    lines = ["'# 研究简报：documents'", "''", f"'> 访问 ' || {head}", "''", "'## 主要发现'"]
    heads = " UNION ALL ".join(f"SELECT 'header', 0, {i}, {x}" for i, x in enumerate(lines))
    return f"""WITH {_SOURCE_INDEX}, shown AS (SELECT seq, text, index, row_number() OVER (ORDER BY CASE credibility WHEN 'HIGH' THEN 0 WHEN 'LOW' THEN 2 ELSE 1 END, seq) AS r FROM facts LEFT JOIN sources ON url = source_url)
SELECT section, part::INT AS part, ord::BIGINT AS ord, line FROM (SELECT * FROM ({heads}) t(section, part, ord, line) UNION ALL
 SELECT 'cluster', 1, r, '- ' || coalesce(text, '') || CASE WHEN index IS NULL THEN '' ELSE ' [' || index || ']' END FROM shown WHERE r <= 15 UNION ALL SELECT 'sources', 0, 0, '## 来源' UNION ALL
 SELECT 'sources', 0, index, '[' || index || '] [' || coalesce(title, '') || '](' || url || ') (' || credibility_label || ')' FROM sources)"""


@query(_brief_sql())
def brief_lines(spark, d):
    """The brief report over all facts."""
    facts = state.with_credibility(tables.facts(spark, d))
    config = {"query": "documents", "visited": table(spark, d, "pages").count(), "active": table(spark, d, "documents").count()}
    return report.brief_lines(facts, report.source_index(facts), config)


@query(f"""WITH {_FACTS}, {_credibility_sql("(SELECT source_url AS url FROM facts WHERE source_url IS NOT NULL)")},
support AS (SELECT DISTINCT sha256(text) AS claim, url, level AS kind, 2000 + regexp_extract(url, '/([0-9]+)', 1)::INT % 25 AS year FROM facts JOIN cred ON url = source_url WHERE text IS NOT NULL),
k AS (SELECT claim, count(*) AS n_kinds, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS kind_entropy FROM (SELECT claim, kind, count(*) AS n FROM support GROUP BY claim, kind) GROUP BY claim),
y AS (SELECT claim, count(year) AS n_years, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS year_entropy FROM (SELECT claim, year, count(*) AS n FROM support GROUP BY claim, year) GROUP BY claim)
SELECT claim, n_sources, n_kinds, n_years, round(kind_entropy, 6) AS kind_entropy, round(year_entropy, 6) AS year_entropy, n_sources >= 2 AS enough, n_kinds >= 2 AND n_years >= 2 AS diverse
FROM (SELECT claim, count(DISTINCT url) AS n_sources FROM support GROUP BY claim) JOIN k USING (claim) JOIN y USING (claim)""")
def claim_diversity(spark, d):
    """Equal texts as one claim, and the pages that they come from: how many, and how evenly spread over kinds and years."""
    facts = state.with_credibility(tables.facts(spark, d)).where("text IS NOT NULL AND source_url IS NOT NULL")
    year = 2000 + F.regexp_extract("source_url", "/([0-9]+)", 1).try_cast("int") % 25
    support = facts.select(F.sha2("text", 256).alias("claim"), F.col("source_url").alias("url"), F.col("credibility").alias("kind"), year.alias("year"))
    return quality.claim_diversity(support, "standard").withColumns({c: F.round(c, 6) for c in ("kind_entropy", "year_entropy")})


@query(f"""{_DEDUP}, {_FACTS}, {_credibility_sql("(SELECT source_url AS url FROM facts WHERE source_url IS NOT NULL)")},
g AS (SELECT facts.seq, coalesce(duplicate_of, facts.seq) AS same, coalesce(level, 'MEDIUM') AS level FROM facts LEFT JOIN dup ON node = facts.seq LEFT JOIN cred ON url = source_url)
SELECT same AS "group", arg_min(seq, (CASE level WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, seq)) AS seq, min(level) FILTER (level = 'HIGH') IS NOT NULL AS high, count(*) AS members FROM g GROUP BY same""")
def most_authoritative(spark, d):
    """Of each group of facts that say the same, the one of the best source."""
    flagged = analyze.deduplicate(state.with_credibility(tables.facts(spark, d))).withColumn("group", F.coalesce("duplicate_of", "seq"))
    rows = cut(flagged.select("seq", "group", "credibility"))
    best = feed.most_authoritative(rows, "group").select("group", "seq", (F.col("credibility") == "HIGH").alias("high"))
    return best.join(rows.groupBy("group").agg(F.count(F.lit(1)).alias("members")), "group")


@query()
def report_lines(spark, d):
    """The comprehensive report over active facts by cluster, with their conflicts."""
    return _report(tables.facts(spark, d), table(spark, d, "pages"), tables.queries_log(spark, d))


def _report(facts, visited, queries):
    rows = cut(analyze.active(analyze.deduplicate(facts)).select("seq", "id", "text", "source_url", "source_title"))
    found = cut(analyze.clusters(rows))
    member = found.select("cluster_id", F.explode("member_ids").alias("id")).join(rows.select("id", "seq"), "id")
    config = {"query": "documents", "max_depth": 3, "base_breadth": 4, "visited": visited.count(), "queries": queries.count(), "active": rows.count(), "written_at": "-"}
    return report.report_lines(rows, report.grouped(rows, member.select("seq", "cluster_id"), found), analyze.conflicts(rows), report.source_index(rows), config)


# ---- state ----
@query("SELECT (SELECT count(*) FROM documents) AS learnings, (SELECT count(*) FROM pages) AS urls, (SELECT count(*) FROM conversations WHERE role = 'user') AS queries, (SELECT count(*) FROM conversations WHERE role <> 'user') AS followups, (SELECT count(*) FROM conversations WHERE role <> 'user' AND turn % 2 = 0) AS unused_followups")
def stats(spark, d):
    follow = table(spark, d, "conversations").where("role <> 'user'").withColumn("used", F.col("turn") % 2 == 1)
    return state.stats(table(spark, d, "documents"), table(spark, d, "pages"), tables.queries_log(spark, d), follow)


@query("""SELECT (SELECT count(*) FROM documents) AS learnings, (SELECT count(*) FROM pages) AS urls, (SELECT count(*) FROM conversations WHERE role = 'user') AS queries, (SELECT count(*) FROM conversations WHERE role <> 'user') AS followups, (SELECT count(*) FROM conversations WHERE role <> 'user' AND turn % 2 = 0) AS unused_followups,
 (SELECT count(*) FROM labels) > 0 AS has_analysis, 'standard' AS mode, 3 AS max_depth, 4 AS base_breadth, (SELECT arg_max((user_id % 4)::INT, event_id) FROM events) AS current_depth, (SELECT arg_max(event_type, event_id) FROM events) AS status""")
def run_stats(spark, d):
    """All that a run says of itself: counts, whether it is analysed, its settings, and the latest progress (events)."""
    follow = table(spark, d, "conversations").where("role <> 'user'").withColumn("used", F.col("turn") % 2 == 1)
    config = planning.modes(spark).where(F.col("mode") == planning.DEFAULT_MODE).select("mode", "max_depth", "base_breadth")
    progress = table(spark, d, "events").select(F.col("event_id").alias("at"), (F.col("user_id") % 4).cast("int").alias("current_depth"), F.col("event_type").alias("status"))
    return state.stats(table(spark, d, "documents"), table(spark, d, "pages"), tables.queries_log(spark, d), follow, table(spark, d, "labels"), config, progress)


_FOLLOW = "SELECT conv_id * 10000 + turn AS seq, text AS question, CASE role WHEN 'system' THEN 'high' WHEN 'assistant' THEN 'low' ELSE 'medium' END AS priority, turn % 2 = 1 AS used FROM conversations"


def _followups(spark, d):
    priority = F.when(F.col("role") == "system", "high").when(F.col("role") == "assistant", "low").otherwise("medium")
    return table(spark, d, "conversations").select((F.col("conv_id") * 10_000 + F.col("turn")).alias("seq"), F.col("text").alias("question"), priority.alias("priority"), (F.col("turn") % 2 == 1).alias("used"))


@query(f"SELECT seq, question, priority FROM ({_FOLLOW}) WHERE NOT used ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'low' THEN 2 ELSE 1 END, seq LIMIT 10")
def unused_followups(spark, d):
    return state.unused_followups(_followups(spark, d)).select("seq", "question", "priority")


@query(f"SELECT seq, used OR seq = (SELECT min(seq) FROM ({_FOLLOW}) WHERE question = (SELECT min(text) FROM conversations)) AS used FROM ({_FOLLOW})")
def mark_followup(spark, d):
    rows = _followups(spark, d)
    question = rows.agg(F.min("question").alias("q")).first()["q"]  # one value
    return state.mark_followup(rows, question).select("seq", "used")


@query("""WITH g AS (SELECT (doc_id % 4)::INT AS depth, count(*) AS n FROM documents GROUP BY 1), w AS (SELECT depth, n, coalesce(lag(n) OVER (ORDER BY depth), 0) AS before FROM g)
SELECT depth, CASE WHEN depth >= 3 THEN 'max_depth_reached' WHEN depth > 0 AND before > 0 AND n / before < 0.2 THEN 'diminishing_returns' ELSE 'continue' END AS decision, greatest(2, floor(4 * pow(0.7, depth + 1)))::INT AS next_breadth FROM w""")
def next_depth(spark, d):
    rows = table(spark, d, "documents").select((F.col("doc_id") % 4).cast("int").alias("depth_level"))
    return state.gains(rows).select("depth", planning.decision(F.col("depth"), F.lit(3), F.lit(1), F.col("n"), F.col("n_before")).alias("decision"), planning.breadth(F.lit(4), F.col("depth") + 1).alias("next_breadth"))


@query("SELECT user_id, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id")
def latest_status(spark, d):
    return state.latest(table(spark, d, "events"), "user_id", ["event_id"]).select("user_id", F.col("event_type").alias("status"))


@query("""WITH c AS (SELECT conv_id, count(*) FILTER (role = 'user') AS depth, count(*) FILTER (role = 'system') AS unused, count(*) FILTER (role = 'assistant') AS n, count(*) AS before FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN depth >= 5 THEN 'max_depth_reached' WHEN depth > 0 AND unused = 0 THEN 'no_followups' WHEN depth > 0 AND before > 0 AND n / before < 0.2 THEN 'diminishing_returns' ELSE 'continue' END AS decision FROM c""")
def stop_rule(spark, d):
    """The stop rule on the counts of each conversation: every branch of it."""
    of = lambda role: F.count_if(F.col("role") == role)
    c = table(spark, d, "conversations").groupBy("conv_id").agg(of("user").alias("depth"), of("system").alias("unused"), of("assistant").alias("n"), F.count(F.lit(1)).alias("before"))
    return c.select("conv_id", planning.decision(F.col("depth"), F.lit(5), F.col("unused"), F.col("n"), F.col("before")).alias("decision"))


@query("""WITH m AS (SELECT doc_id, CASE quality WHEN 0 THEN 'quick' WHEN 1 THEN 'deep' END AS mode FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, coalesce(mode, 'standard') AS mode, CASE mode WHEN 'quick' THEN 1 WHEN 'deep' THEN 5 ELSE 3 END AS max_depth, CASE mode WHEN 'quick' THEN 3 WHEN 'deep' THEN 5 ELSE 4 END AS base_breadth, CASE mode WHEN 'quick' THEN 5 WHEN 'deep' THEN 15 ELSE 10 END AS min_sources FROM m""")
def mode_lookup(spark, d):
    """Settings by a name that may be missing: of each document by its quality label."""
    named = F.when(F.col("quality") == 0, "quick").when(F.col("quality") == 1, "deep")
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", named.alias("mode"))
    return planning.with_mode(rows, "mode").select("doc_id", "mode", "max_depth", "base_breadth", "min_sources")


@query("""SELECT text AS link, min(turn) AS round, arg_min(conv_id, (turn, conv_id)) AS found_by FROM conversations WHERE text IS NOT NULL GROUP BY text""")
def rounds_merged(spark, d):
    """The turns of all conversations as search rounds: each text from the first round that has it."""
    c = table(spark, d, "conversations").where("text IS NOT NULL").groupBy(F.col("turn").alias("round"), F.col("text").alias("link")).agg(F.min("conv_id").alias("found_by"))
    even, odd = c.where("round % 2 = 0"), c.where("round % 2 = 1")
    return memory.merge_rounds([even, odd], "link").select("link", "round", "found_by")


def _depths_sql(max_depth: int = 3, base: int = 4) -> str:
    """The rounds one behind the other: queries q, what they find f, what the rule says s."""
    ctes = ["conv AS (SELECT conv_id, turn AS seq, role, CASE role WHEN 'system' THEN 0 WHEN 'assistant' THEN 2 ELSE 1 END AS rank FROM conversations)", "q0 AS (SELECT conv_id, seq FROM conv WHERE seq = 0)"]
    told = []
    for d in range(max_depth + 1):
        ctes.append(f"f{d} AS (SELECT c.* FROM q{d} q JOIN conv c ON c.conv_id = q.conv_id AND c.seq IN (2 * q.seq + 1, 2 * q.seq + 2))")
        found = " UNION ALL ".join(f"SELECT * FROM f{k}" for k in range(d + 1))
        asked = " UNION ALL ".join(f"SELECT * FROM q{k}" for k in range(d + 1))
        ctes.append(f"open{d} AS (SELECT * FROM ({found}) WHERE (conv_id, seq) NOT IN ({asked}))")
        n = lambda t, more="": f"(SELECT count(*) FROM {t} x WHERE x.conv_id = r.conv_id{more})"
        facts, before = n(f"f{d}", " AND x.role = 'assistant'"), n(f"f{d - 1}", " AND x.role = 'assistant'") if d else "0"
        rule = f"CASE WHEN {d} >= {max_depth} THEN 'max_depth_reached' WHEN {d} > 0 AND unused = 0 THEN 'no_followups' WHEN {d} > 0 AND before > 0 AND facts / before < 0.2 THEN 'diminishing_returns' ELSE 'continue' END"
        ctes.append(f"s{d} AS (SELECT conv_id, {d} AS depth, queries, facts, questions, {rule} AS decision FROM (SELECT conv_id, {n(f'q{d}')} AS queries, {facts} AS facts, {n(f'f{d}')} AS questions, {before} AS before, {n(f'open{d}')} AS unused FROM (SELECT DISTINCT conv_id FROM q{d}) r))")
        ctes.append(f"q{d + 1} AS (SELECT conv_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY rank, seq) AS i FROM open{d} WHERE conv_id IN (SELECT conv_id FROM s{d} WHERE decision = 'continue')) WHERE i <= {recursion.breadth_at(base, d + 1)})")
        told.append(f"SELECT * FROM s{d}")
    return "WITH " + ",\n".join(ctes) + "\n" + " UNION ALL ".join(told)


@query(_depths_sql())
def depth_recursion(spark, d):
    """Every conversation as a run: asking turn t finds turns 2t + 1 and 2t + 2, of which the assistant's are facts."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("run_id"), F.col("turn").alias("seq"), "role", "text")
    priority = F.when(F.col("role") == "system", "high").when(F.col("role") == "assistant", "low").otherwise("medium")

    def search(queries: DataFrame, _: int) -> DataFrame:
        asked = queries.select("run_id", F.explode(F.array(2 * F.col("seq") + 1, 2 * F.col("seq") + 2)).alias("seq"))
        kinds = F.when(F.col("role") == "assistant", F.array(F.lit("question"), F.lit("fact"))).otherwise(F.array(F.lit("question")))
        return asked.join(turns, ["run_id", "seq"]).select("run_id", F.explode(kinds).alias("kind"), "seq", "text", priority.alias("priority"))

    log = VersionedTable(spark, f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}", recursion.SCHEMA)
    told = recursion.by_depth(recursion.research(log, turns.where("seq = 0"), search))
    return told.select(F.col("run_id").cast("long").alias("conv_id"), "depth", "queries", "facts", "questions", "decision")


@query("""SELECT user_id, arg_max(event_type, event_id) FILTER (ts < '2024-01-16') AS was, arg_max(event_type, event_id) AS status, count(*) AS events FROM events GROUP BY user_id""")
def versioned_status(spark, d):
    """Events appended to a versioned table in four commits by week and compacted: the status of each user then and now."""
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    log = VersionedTable(spark, f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}", ", ".join(f"{c} {kind}" for c, kind in events.dtypes))
    ends = ["2024-01-08", "2024-01-16", "2024-01-24"]
    for lo, hi in zip([None, *ends], [*ends, None]):
        part = events if lo is None else events.where(F.col("ts") >= lo)
        log.append(part if hi is None else part.where(F.col("ts") < hi))
    log.compact()
    last = lambda rows, name: rows.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias(name), F.count(F.lit(1)).alias("events"))
    return last(log.read(), "status").join(last(log.read(version=2), "was").drop("events"), "user_id", "left")


# ---- feed ----
_SEARCH = '(from:7 OR from:11 OR from:13) since:2024-01-05 until:2024-01-20 -"99" k'


@query("SELECT event_id AS post_id FROM events WHERE user_id IN (7, 11, 13) AND ts >= '2024-01-05' AND ts < '2024-01-20' AND NOT contains(lower(props), '99') AND contains(lower(props), 'k')")
def post_search(spark, d):
    return tables.posts(spark, d).where(feed.search(_SEARCH)).select("post_id")


_WORDS = r"(' ' || array_to_string(list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+'), lambda x: lower(x)), ' ') || ' ')"


@query(f"""WITH p AS (SELECT doc_id AS post_id, lang, {_WORDS} AS w, doc_id % (SELECT count(*) FROM customer) + 1 AS author FROM documents)
SELECT post_id FROM p WHERE (contains(w, ' the and ') OR contains(w, ' en de ') OR contains(w, ' la ')) AND NOT contains(w, ' er ') AND author IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_mktsegment = 'MACHINERY')
UNION SELECT post_id FROM p WHERE lang = 'fr' AND contains(w, ' es ') AND NOT contains(w, ' la ')""")
def post_index_search(spark, d):
    """Documents as posts by customers, through a positional index: phrases, OR, exclusion, lists of accounts and a language."""
    n = table(spark, d, "customer").agg(F.count(F.lit(1)).alias("n"))  # one row
    posts = table(spark, d, "documents").crossJoin(F.broadcast(n)).select(F.col("doc_id").alias("post_id"), "text", "lang", (F.col("doc_id") % F.col("n") + 1).cast("string").alias("author"))
    members = table(spark, d, "customer").select(F.col("c_mktsegment").alias("list_id"), F.col("c_custkey").cast("string").alias("account"))
    at = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    post_index.build(posts, at)
    index = post_index.PostIndex(spark, at, posts, members)
    return index.search('(("the and" OR "en de" OR la) -er (list:BUILDING OR list:MACHINERY)) OR (es -la lang:fr)')


@query("SELECT event_id AS post_id FROM events ORDER BY ts DESC, event_id LIMIT 20")
def latest_feed(spark, d):
    return feed.latest(tables.posts(spark, d)).select("post_id")


@query("SELECT event_id AS post_id FROM events ORDER BY value DESC, event_id LIMIT 20")
def top_feed(spark, d):
    return feed.top(tables.posts(spark, d)).select("post_id")


_SCORES = "event_id % 5 + 1 AS i, event_id // 5 % 5 + 1 AS n, event_id // 25 % 5 + 1 AS c, user_id % 5 + 1 AS r, CASE WHEN date_diff('day', ts::DATE, DATE '2024-01-31') <= 0 THEN 5 WHEN date_diff('day', ts::DATE, DATE '2024-01-31') = 1 THEN 4 WHEN date_diff('day', ts::DATE, DATE '2024-01-31') <= 7 THEN 3 WHEN date_diff('day', ts::DATE, DATE '2024-01-31') <= 30 THEN 2 ELSE 1 END AS t"
_TOTAL = f"SELECT event_id AS id, event_type, round(0.3::DOUBLE * i + 0.25::DOUBLE * n + 0.2::DOUBLE * c + 0.15::DOUBLE * t + 0.1::DOUBLE * r, 6) AS total FROM (SELECT *, {_SCORES} FROM events)"


def _findings(spark, d, *more):
    e = table(spark, d, "events")
    at = lambda k: (F.floor(F.col("event_id") / k) % 5 + 1)
    total = planning.total_score(at(1), at(5), at(25), planning.timeliness(F.to_date("ts"), F.lit("2024-01-31").cast("date")), F.col("user_id") % 5 + 1)
    return e.select(F.col("event_id").alias("id"), "event_type", F.round(total, 6).alias("total"), *more)


@query(_TOTAL)
def score_total(spark, d):
    return _findings(spark, d)


_KIND = {"click": "signal", "view": "opinion", "purchase": "breakthrough", "signup": "release", "error": "research"}


@query(f"""WITH s AS ({_TOTAL}), t AS (SELECT id, total, CASE WHEN total < 2 THEN 'Unclassified' ELSE CASE event_type WHEN 'click' THEN 'Trend Signals' WHEN 'view' THEN 'Industry & Opinions' WHEN 'purchase' THEN 'Breakthroughs' WHEN 'signup' THEN 'Releases' WHEN 'error' THEN 'Research' END END AS tier FROM s)
SELECT id, tier, rank() OVER (PARTITION BY tier ORDER BY total DESC) AS rank_in_tier FROM t""")
def tier_rank(spark, d):
    kind = F.create_map(*[F.lit(x) for p in _KIND.items() for x in p])[F.col("event_type")]
    rows = _findings(spark, d)
    return feed.ranked(rows.withColumn("tier", planning.tier(kind, F.col("total")))).select("id", "tier", "rank_in_tier")


@query("SELECT DISTINCT user_id FROM events WHERE ts >= '2024-01-16' AND user_id NOT IN (SELECT user_id FROM events WHERE ts < '2024-01-16' AND event_type = 'purchase' AND value > 60)")
def history_anti(spark, d):
    e = table(spark, d, "events")
    return feed.new_items(e.where("ts >= '2024-01-16'").select("user_id").distinct(), e.where("ts < '2024-01-16' AND event_type = 'purchase' AND value > 60"), "user_id")


@query("""WITH x AS (SELECT user_id, count(*) AS n FROM events WHERE ts < '2024-01-16' GROUP BY 1), y AS (SELECT user_id, count(*) AS n FROM events WHERE ts >= '2024-01-16' GROUP BY 1)
SELECT user_id, coalesce(x.n, 0) AS n_before, coalesce(y.n, 0) AS n_now, CASE WHEN x.n IS NULL THEN 'new' WHEN y.n IS NULL THEN 'gone' WHEN y.n > x.n THEN 'hotter' WHEN y.n < x.n THEN 'cooler' ELSE 'same' END AS change FROM x FULL JOIN y USING (user_id)""")
def period_diff(spark, d):
    e = table(spark, d, "events")
    return feed.period_change(e.where("ts < '2024-01-16'"), e.where("ts >= '2024-01-16'"), "user_id")


@query("""WITH x AS (SELECT user_id, count(*) AS n FROM events WHERE ts < '2024-01-16' GROUP BY 1), y AS (SELECT user_id, count(*) AS n FROM events WHERE ts >= '2024-01-16' GROUP BY 1),
b AS (SELECT user_id, coalesce(x.n, 0) AS n_before, coalesce(y.n, 0) AS n_now FROM x FULL JOIN y USING (user_id))
SELECT user_id, n_before, n_now, CASE WHEN 4 * n_now >= 5 * n_before THEN 'rising' WHEN 4 * n_now <= 3 * n_before THEN 'falling' WHEN n_now >= (SELECT avg(n_now) FROM b) THEN 'high' ELSE 'stable' END AS heat FROM b""")
def topic_heat(spark, d):
    e = table(spark, d, "events")
    return feed.heat(e.where("ts < '2024-01-16'"), e.where("ts >= '2024-01-16'"), "user_id")


_TIERED = f"""SELECT id, ts, CASE WHEN total < 2 THEN 'Unclassified' ELSE CASE event_type WHEN 'click' THEN 'Trend Signals' WHEN 'view' THEN 'Industry & Opinions' WHEN 'purchase' THEN 'Breakthroughs' WHEN 'signup' THEN 'Releases' WHEN 'error' THEN 'Research' END END AS tier, props AS topic, event_type AS source, user_id::VARCHAR AS author, user_id || ':' || props AS link, total FROM (SELECT id, total FROM ({_TOTAL})) JOIN events ON event_id = id"""
_DAILY = f"""f AS ({_TIERED}),
g AS (SELECT CASE grouping(tier, topic, source, author) WHEN 7 THEN 'tier' WHEN 11 THEN 'topic' WHEN 13 THEN 'source' WHEN 14 THEN 'author' ELSE 'all' END AS level,
 coalesce(tier, topic, source, author) AS key, count(*) AS n, count(*) FILTER (ts < '2024-01-16') AS n_before, count(*) FILTER (ts >= '2024-01-16') AS n_now, count(DISTINCT link) AS items, arg_max(id, (total, -id)) AS top_id, max(total) AS top_total
 FROM f GROUP BY GROUPING SETS ((tier), (topic), (source), (author), ())),
levels AS (SELECT level, key, n, n_before, n_now, items, (n - items) / n AS dedup_rate, n / (SELECT count(*) FROM f) AS share, top_id, top_total,
 CASE WHEN n_before = 0 THEN 'new' WHEN n_now = 0 THEN 'gone' WHEN 4 * n_now >= 5 * n_before THEN 'rising' WHEN 4 * n_now <= 3 * n_before THEN 'falling' ELSE 'stable' END AS heat FROM g)"""


def _daily(spark, d):
    kind = F.create_map(*[F.lit(x) for p in _KIND.items() for x in p])[F.col("event_type")]
    scored = _findings(spark, d, "ts", "props", "user_id").withColumn("tier", planning.tier(kind, F.col("total")))
    author = F.col("user_id").cast("string")
    rows = scored.select("id", F.col("ts").cast("timestamp").alias("created"), "tier", F.col("props").alias("topic"), F.col("event_type").alias("source"), author.alias("author"), F.concat(author, F.lit(":"), "props").alias("link"), "total")
    return daily.levels(rows, "2024-01-16")


@query(f"WITH {_DAILY} SELECT level, key, n, n_before, n_now, items, round(dedup_rate, 6) AS dedup_rate, round(share, 6) AS share, top_id, top_total, heat FROM levels")
def daily_levels(spark, d):
    """Events as findings: every table of the daily report from one scan."""
    return _daily(spark, d).withColumns({c: F.round(c, 6) for c in ("dedup_rate", "share")})


def _daily_lines_sql() -> str:
    cells = {
        "tier": "key || ' | ' || n || ' | ' || top_id || ' | ' || printf('%.2f', top_total)", "topic": "key || ' | ' || n_now || ' | ' || n_before || ' | ' || heat", "author": "key || ' | ' || n_now || ' | ' || top_id",
        "source": "key || ' | ' || n || ' | ' || printf('%.1f', 100 * share) || '%'", "all": "n || ' | ' || items || ' | ' || printf('%.1f', 100 * dedup_rate) || '%'",
    }
    parts = ["SELECT 0 AS part, 0 AS ord, '# Daily report 2024-01-30' AS line"]
    for p, (title, head, level, most) in enumerate(daily.TABLES, start=1):
        by = "n_now" if level in ("topic", "author") else "n"
        parts.append(f"SELECT {p}, i, x FROM (VALUES (0, '## {title}'), (1, '{head}'), (2, '|{'---|' * (head.count('|') - 1)}')) t(i, x)")
        parts.append(f"SELECT {p}, r + 2, '| ' || {cells[level]} || ' |' FROM (SELECT *, row_number() OVER (ORDER BY {by} DESC, key) AS r FROM levels WHERE level = '{level}') WHERE r <= {most}")
    return f"WITH {_DAILY} SELECT part::INT AS part, ord::INT AS ord, line FROM ({' UNION ALL '.join(parts)})"


@query(_daily_lines_sql())
def daily_lines(spark, d):
    """The daily report as lines."""
    return daily.lines(_daily(spark, d), "2024-01-30")


@query("""SELECT user_id AS account, min(CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END) AS level FROM events GROUP BY user_id""")
def account_levels(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("account"), "event_type")
    return feed.accounts_by_level([e.where("event_type = 'purchase'"), e.where("event_type = 'signup'"), e])


@query("SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY event_type")
def coverage_share(spark, d):
    return feed.shares(table(spark, d, "events"), "event_type").withColumn("share", F.round("share", 6))


@query("SELECT user_id::VARCHAR AS author, count(*) AS n, arg_max(event_id, (value, -event_id)) AS top_post FROM events GROUP BY user_id")
def tracked_user_digest(spark, d):
    return feed.digest(tables.posts(spark, d))


@query("SELECT count(*) AS n, count(*) FILTER (regexp_matches(url, '^https?://')) AS with_url, round(count(*) FILTER (regexp_matches(url, '^https?://')) / count(*), 6) AS share, count(*) FILTER (regexp_matches(url, '^https?://')) / count(*) >= 0.7 AS good FROM pages")
def url_coverage(spark, d):
    return feed.url_coverage(table(spark, d, "pages")).withColumn("share", F.round("share", 6))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 200")
def history_prune(spark, d):
    return feed.pruned(table(spark, d, "events"), "event_type", [F.desc("ts"), F.desc("event_id")]).select("event_id")


@query("SELECT props AS item, count(DISTINCT user_id) AS authors FROM events GROUP BY props HAVING count(DISTINCT user_id) >= 2")
def shared_items(spark, d):
    return feed.shared_by(table(spark, d, "events"), "props", "user_id").withColumnRenamed("props", "item")


@query(r"""WITH s AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda p: regexp_matches(p, '\S'))) AS n_paragraphs, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')) AS lines FROM documents)
SELECT doc_id AS id, n_paragraphs::INT AS n_paragraphs, round(CASE WHEN len(lines) > 0 THEN len(list_filter(lines, lambda x: NOT regexp_matches(x, '^\s*([-*+|>#]|[0-9]+\.)'))) / len(lines) ELSE 0 END, 6) AS prose_share FROM s""")
def section_quality(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return quality.section_gates(rows).select("id", "n_paragraphs", F.round("prose_share", 6).alias("prose_share"))


# ---- streams, read to their end ----
def _finished(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream over present files has written when all are read: appended rows, or the last batch's whole result."""
    spark = stream.sparkSession
    at = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    written = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        written.format("parquet").start(f"{at}/out").awaitTermination()
    else:
        written.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{at}/out")).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


@query(f"SELECT DISTINCT {_NORMAL} AS normalized FROM pages")
def stream_url_dedup(spark, d):
    pages = table(spark, d, "pages")
    rows = spark.readStream.schema(pages.schema).parquet(f"{d}/pages.parquet*")
    return _finished(ingest.dedup_urls(rows.select("url")).select("normalized"), "append")


@query("SELECT date_trunc('day', ts) AS start, event_type AS kind, count(*) AS n, round(sum(value), 4) AS engagement FROM events GROUP BY 1, 2")
def stream_window_counts(spark, d):
    events = table(spark, d, "events")
    rows = spark.readStream.schema(events.schema).parquet(f"{d}/events.parquet*").select(F.col("ts").cast("timestamp").alias("created"), F.col("event_type").alias("kind"), F.col("value").alias("engagement"))
    return _finished(ingest.windowed_counts(rows), "complete").withColumn("engagement", F.round("engagement", 4))


@query(f"WITH RECURSIVE {_QUERIES}, {_terms_sql('queries')}, {_cosine_sql('counts', 'n', 0.75)}, {_leaders_sql('queries', 'pairs')} SELECT seq FROM queries WHERE seq NOT IN (SELECT node FROM dup)")
def stream_query_log(spark, d):
    """User turns through the stream of queries, five batches in order of seq; the accepted ones."""
    rows = cut(tables.queries_log(spark, d))
    at = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    ends = rows.approxQuantile("seq", [0.2, 0.4, 0.6, 0.8], 0.0)
    for lo, hi in zip([None, *ends], [*ends, None]):  # each part is a batch, of a stream that is stopped and taken up again
        part = rows if lo is None else rows.where(F.col("seq") > lo)
        (part if hi is None else part.where(F.col("seq") <= hi)).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{at}/in")
        ingest.log_queries(stream, f"{at}/log", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/log/*").where("duplicate_of IS NULL").select("seq")

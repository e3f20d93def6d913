"""Search and retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tabularium.functions.text import highlight, unmark_stop_words
from tabularium.operators import graph, search
from tabularium.sources.tables import table

QUERY = "facture pétrolière retenue"
TERMS = ("facture", "petroliere", "retenue")
TYPOS = ["facturre", "retenu", "taxx", "exoneratoin"]
TOPICS = ["retenue", "art. 1", "facture"]


def _fold_sql(x: str) -> str:
    return f"replace(replace(regexp_replace(strip_accents(lower({x})), '\\p{{M}}+', '', 'g'), 'œ', 'oe'), 'æ', 'ae')"


def _tokens_sql(x: str) -> str:
    return f"list_filter(string_split_regex({_fold_sql(x)}, '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def _score_sql(tokens: str, prefix: str, k1: float, b: float) -> str:
    parts = []
    for i, _ in enumerate(TERMS):
        tf = f"len(list_filter({tokens}, lambda t: t = '{TERMS[i]}'))"
        idf = f"ln(1 + ({prefix}n - {prefix}df{i} + 0.5) / ({prefix}df{i} + 0.5))"
        parts.append(f"CASE WHEN {tokens} IS NOT NULL AND {tf} > 0 THEN {idf} * {tf} / ({tf} + {k1} * (1 - {b} + {b} * len({tokens}) / {prefix}avg)) ELSE 0 END")
    return "(" + " + ".join(parts) + ")"


def _stats_sql(tokens: str, prefix: str) -> str:
    dfs = ", ".join(f"count(*) FILTER (list_contains({tokens}, '{t}')) AS {prefix}df{i}" for i, t in enumerate(TERMS))
    return f"count(*) FILTER (len({tokens}) > 0) AS {prefix}n, avg(len({tokens})) FILTER (len({tokens}) > 0) AS {prefix}avg, {dfs}"


def bm25_search(spark: SparkSession, root: str) -> DataFrame:
    return search.top(search.bm25(table(spark, root, "documents").select("doc_id", "source", "text"), "text", QUERY), 50, "doc_id").select("doc_id", "source", "score")


_BM25_SQL = f"""
WITH d AS (SELECT doc_id, source, {_tokens_sql('text')} w FROM documents), s AS (SELECT {_stats_sql('w', '')} FROM d)
SELECT doc_id, source, round({_score_sql('w', '', 1.5, 0.6)}, 6) AS score FROM d, s WHERE {_score_sql('w', '', 1.5, 0.6)} > 0 ORDER BY score DESC, doc_id LIMIT 50
"""


#: Boosts of the fields that a search asks (fixed values).
BOOSTS = {"content": 3.0, "article_number": 2.0, "section_title": 1.5, "filename": 1.0}


def bm25_fields_boost(spark: SparkSession, root: str) -> DataFrame:
    """The best of four fields, near spellings of the terms counted with them."""
    rows = table(spark, root, "index_chunk").select("row_no", *BOOSTS)
    return search.top(search.best_fields(rows, BOOSTS, TYPED, fuzzy=True), 50, "row_no").select("row_no", "score")


#: A query with slips of the pen, and how many edits its terms allow.
TYPED, EDITS = "factre pétroliere retenue", {"factre": 2, "petroliere": 2, "retenue": 2}


def _boost_sql() -> str:
    # letters beyond ASCII become one sign, as this levenshtein counts bytes
    short = {"content": "c", "article_number": "a", "section_title": "s", "filename": "f"}
    terms = list(EDITS)
    toks = ", ".join(f"{_tokens_sql(f)} {k}" for f, k in short.items())
    vocab = " UNION ALL ".join(f"SELECT row_no, unnest(list_distinct({k})) term FROM d" for k in short.values())
    near = f"SELECT q, list_concat([q], coalesce((list(term ORDER BY n DESC, term) FILTER (term IS NOT NULL))[:100], [])) ws FROM (SELECT unnest({terms}) q) LEFT JOIN (SELECT term, count(*) n FROM ({vocab}) GROUP BY 1) ON levenshtein(regexp_replace(term, '[^a-z0-9]', '~', 'g'), q) BETWEEN 1 AND 2 GROUP BY q"
    held = ", ".join(f"any_value(ws) FILTER (q = '{t}') w{i}" for i, t in enumerate(terms))
    counts = ", ".join(f"len(list_filter({k}, lambda t: list_contains(w{i}, t))) {k}{i}" for k in short.values() for i, t in enumerate(terms))
    stats = ", ".join(f"count(*) FILTER (len({k}) > 0) n_{k}, avg(len({k})) FILTER (len({k}) > 0) avg_{k}, " + ", ".join(f"count(*) FILTER ({k}{i} > 0) df_{k}{i}" for i in range(len(terms))) for k in short.values())

    def score(k: str, k1: float, b: float) -> str:
        return "(" + " + ".join(f"CASE WHEN {k}{i} > 0 THEN ln(1 + (n_{k} - df_{k}{i} + 0.5) / (df_{k}{i} + 0.5)) * {k}{i} / ({k}{i} + {k1} * (1 - {b} + {b} * len({k}) / avg_{k})) ELSE 0 END" for i in range(len(terms))) + ")"

    best = ", ".join(f"{w} * {score(short[f], *((1.5, 0.6) if f == 'content' else (1.2, 0.75)))}" for f, w in BOOSTS.items())
    return f"WITH d AS (SELECT row_no, {toks} FROM index_chunk), near AS ({near}), m AS (SELECT {held} FROM near), t AS (SELECT *, {counts} FROM d, m), z AS (SELECT {stats} FROM t), x AS (SELECT row_no, greatest({best}) score FROM t, z) SELECT row_no, round(score, 6) AS score FROM x WHERE score > 0 ORDER BY 2 DESC, row_no LIMIT 50"


_BOOST_SQL = _boost_sql()


def filtered_search(spark: SparkSession, root: str) -> DataFrame:
    """Filters restrict the hits, not the statistics."""
    rows = table(spark, root, "index_chunk").select("row_no", "document_type", "chunk_type", "content")
    hits = search.bm25(rows, "content", QUERY, search.exact_filters(document_type="code", chunk_type="article"))
    return search.top(hits, 50, "row_no").select("row_no", "document_type", "score")


_FILTERED_SQL = f"""
WITH d AS (SELECT row_no, document_type, chunk_type, {_tokens_sql('content')} w FROM index_chunk), s AS (SELECT {_stats_sql('w', '')} FROM d)
SELECT row_no, document_type, round({_score_sql('w', '', 1.5, 0.6)}, 6) AS score FROM d, s WHERE document_type = 'code' AND chunk_type = 'article' AND {_score_sql('w', '', 1.5, 0.6)} > 0 ORDER BY score DESC, row_no LIMIT 50
"""


def search_totals(spark: SparkSession, root: str) -> DataFrame:
    hits = search.bm25(table(spark, root, "index_chunk").select("row_no", "content"), "content", QUERY)
    return hits.agg(F.count(F.lit(1)).alias("total"), F.round(F.max("score"), 6).alias("max_score"))


_TOTALS_SQL = f"""
WITH d AS (SELECT {_tokens_sql('content')} w FROM index_chunk), s AS (SELECT {_stats_sql('w', '')} FROM d), x AS (SELECT {_score_sql('w', '', 1.5, 0.6)} score FROM d, s)
SELECT count(*) AS total, round(max(score), 6) AS max_score FROM x WHERE score > 0
"""


def facet_terms(spark: SparkSession, root: str) -> DataFrame:
    """Facets of the rows that a query finds, by one scan."""
    return search.facets(search.matching(table(spark, root, "index_chunk").select("document_type", "chunk_type", "content"), "content", QUERY), {"document_type": 10, "chunk_type": 20})


_MATCH_SQL = f"list_has_any({_tokens_sql('content')}, ['{TERMS[0]}', '{TERMS[1]}', '{TERMS[2]}'])"
_FACET_SQL = f"""
WITH h AS (SELECT document_type, chunk_type FROM index_chunk WHERE {_MATCH_SQL})
(SELECT 'document_type' AS field, document_type AS value, count(*) AS n FROM h WHERE document_type IS NOT NULL GROUP BY ALL ORDER BY n DESC, value LIMIT 10)
UNION ALL (SELECT 'chunk_type', chunk_type, count(*) FROM h WHERE chunk_type IS NOT NULL GROUP BY ALL ORDER BY 3 DESC, 2 LIMIT 20)
"""


def fuzzy_terms(spark: SparkSession, root: str) -> DataFrame:
    return search.fuzzy_terms(search.vocabulary(table(spark, root, "documents"), "text"), TYPOS)


_FUZZY_SQL = f"""
WITH v AS (SELECT term, count(*) df FROM (SELECT doc_id, unnest(list_distinct({_tokens_sql('text')})) term FROM documents) GROUP BY 1),
q AS (SELECT unnest({TYPOS}) query_term)
SELECT query_term, term, df, CAST(levenshtein(term, query_term) AS INT) AS edits FROM v, q
WHERE levenshtein(term, query_term) <= CASE WHEN length(query_term) < 3 THEN 0 WHEN length(query_term) <= 5 THEN 1 ELSE 2 END
"""


def ranked_results(spark: SparkSession, root: str) -> DataFrame:
    """A page of results: place and percentage of the best score."""
    return search.ranked(bm25_search(spark, root), "doc_id").select("doc_id", "rank", "percent")


_RANKED_SQL = f"WITH h AS ({_BM25_SQL}) SELECT doc_id, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INT) AS rank, CAST(greatest(2, least(100, floor(score / greatest(max(score) OVER (), 0.01) * 100 + 0.5))) AS INT) AS percent FROM h"


def postings(spark: SparkSession, root: str) -> DataFrame:
    """Posting lists of the query's terms, out of the whole inverted index."""
    return search.build_postings(table(spark, root, "documents"), "doc_id", "text").where(F.col("term").isin(*TERMS))


_POSTINGS_SQL = f"""
WITH d AS (SELECT doc_id, {_tokens_sql('text')} w FROM documents), e AS (SELECT doc_id, len(w) dl, unnest(w) term FROM d)
SELECT term, doc_id, CAST(count(*) AS INT) AS tf, CAST(any_value(dl) AS INT) AS dl FROM e WHERE term IN {TERMS} GROUP BY term, doc_id
"""


def highlight_snippets(spark: SparkSession, root: str) -> DataFrame:
    """Fragments of the fifty best hits only."""
    hits = search.top(search.bm25(table(spark, root, "index_chunk").select("row_no", "content"), "content", QUERY), 50, "row_no")
    return hits.select("row_no", unmark_stop_words(highlight(F.col("content"), QUERY.split())).alias("snippet"))


def keyword_fallback(spark: SparkSession, root: str) -> DataFrame:
    rows = search.keyword_any(table(spark, root, "graph_chunk").select("id", "text", "doc_name", "page_num", "article_ref"), ["text", "article_ref", "doc_name"], "Facture pétrolière".split(" "))
    return rows.select("id", F.lit(0.5).alias("score")).orderBy("id").limit(100)


_KEYWORD_SQL = " OR ".join(f"contains(lower({c}), '{w}')" for c in ("text", "article_ref", "doc_name") for w in ("facture", "pétrolière"))


def topic_score(spark: SparkSession, root: str) -> DataFrame:
    return graph.topic_search(table(spark, root, "graph_chunk").select("id", "text", "doc_name", "page_num", "article_ref", "section_title"), TOPICS, 50).select("id", "doc_name", "page_num", "score")


def _topic_sql(topics: str, prefix: str = "") -> str:
    c = lambda x: f"coalesce(contains(lower({x}), lower(t)), false) AND t <> ''"
    case = f"CASE WHEN {c(prefix + 'text')} THEN 2.0 WHEN {c(prefix + 'article_ref')} THEN 1.5 WHEN {c(prefix + 'section_title')} THEN 1.0 WHEN {c(prefix + 'doc_name')} THEN 0.5 ELSE 0.0 END"
    return f"coalesce(list_sum(list_transform({topics}, lambda t: {case})), 0)::DOUBLE"


_TOPIC_SQL = f"SELECT id, doc_name, page_num, {_topic_sql(str(TOPICS))} AS score FROM graph_chunk WHERE {_topic_sql(str(TOPICS))} > 0 ORDER BY score DESC, doc_name, page_num, id LIMIT 50"


def scenario_topk(spark: SparkSession, root: str) -> DataFrame:
    chunks = table(spark, root, "graph_chunk").select("id", "text", "doc_name", "page_num", "article_ref", "section_title").dropDuplicates(["id"])
    return graph.scenario_topk(chunks, table(spark, root, "scenario"))


_SCENARIO_SQL = f"""
WITH g AS (SELECT DISTINCT id, text, doc_name, page_num, article_ref, section_title FROM graph_chunk),
s AS (SELECT idx, 0 src, coalesce(topics, []) ts FROM scenario UNION ALL SELECT idx, 1, list_concat(coalesce(topics, []), coalesce(extra_topics, [])) FROM scenario),
x AS (SELECT idx, src, g.*, {_topic_sql('ts', 'g.')} score FROM g, s),
r AS (SELECT *, row_number() OVER (PARTITION BY idx, src ORDER BY score DESC, doc_name, page_num, id) r FROM x WHERE score > 0),
k AS (SELECT * FROM r WHERE r <= CASE WHEN src = 0 THEN 8 ELSE 6 END),
f AS (SELECT *, row_number() OVER (PARTITION BY idx, trim(text, ' ' || chr(10) || chr(9) || chr(13)) ORDER BY src, r) f FROM k),
p AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY src, r) place FROM f WHERE f = 1)
SELECT idx, CAST(place AS INT) AS place, id, score FROM p WHERE place <= 10
"""


def vector_topk(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "embeddings")
    query = rows.where("vec_id = 0").select("embedding").first()[0]
    return graph.vector_topk(rows, "vec_id", "embedding", list(query), 8)


_VECTOR_SQL = """
WITH q AS (SELECT embedding::DOUBLE[] q FROM embeddings WHERE vec_id = 0), x AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) similarity FROM embeddings, q)
SELECT vec_id, similarity, round((1 + similarity) / 2, 6) AS score FROM x ORDER BY similarity DESC, vec_id LIMIT 8
"""


def merged_ranking(spark: SparkSession, root: str) -> DataFrame:
    """Keyword and topic retrieval merged, each chunk once with its best score."""
    chunks = table(spark, root, "graph_chunk").select("id", "text", "doc_name", "page_num", "article_ref", "section_title")
    words = search.keyword_any(chunks, ["text"], ["facture"]).select("id", F.lit(0.5).alias("score")).orderBy("id").limit(100)
    return graph.merge_ranked(graph.topic_search(chunks, TOPICS, 20), words, limit=30)


_MERGED_SQL = f"""
WITH t AS (SELECT id, score FROM ({_TOPIC_SQL.replace('LIMIT 50', 'LIMIT 20')})), w AS (SELECT id, 0.5::DOUBLE score FROM graph_chunk WHERE contains(lower(text), 'facture') ORDER BY id LIMIT 100)
SELECT id, max(score) AS score FROM (SELECT * FROM t UNION ALL SELECT * FROM w) GROUP BY id ORDER BY score DESC, id LIMIT 30
"""


def last_turns(spark: SparkSession, root: str) -> DataFrame:
    """The last four events of every user, as turns of a conversation."""
    rows = table(spark, root, "events").select("user_id", "event_id", "event_type")
    r = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))
    return rows.withColumn("r", r).where("r <= 4").drop("r")


def index_health(spark: SparkSession, root: str) -> DataFrame:
    """Whether the index answers, and how many rows it has."""
    return table(spark, root, "index_chunk").agg(F.lit(True).alias("alive"), F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (bm25_search, bm25_fields_boost, filtered_search, search_totals, facet_terms, ranked_results, fuzzy_terms, postings, highlight_snippets, keyword_fallback, topic_score, scenario_topk, vector_topk, merged_ranking, last_turns, index_health)}
ORACLES = {
    "index_health": "SELECT true AS alive, count(*) AS n FROM index_chunk",
    "bm25_search": _BM25_SQL, "bm25_fields_boost": _BOOST_SQL, "filtered_search": _FILTERED_SQL, "search_totals": _TOTALS_SQL, "facet_terms": _FACET_SQL, "ranked_results": _RANKED_SQL, "fuzzy_terms": _FUZZY_SQL, "postings": _POSTINGS_SQL,
    "keyword_fallback": f"SELECT id, 0.5::DOUBLE AS score FROM graph_chunk WHERE {_KEYWORD_SQL} ORDER BY id LIMIT 100", "topic_score": _TOPIC_SQL, "scenario_topk": _SCENARIO_SQL, "vector_topk": _VECTOR_SQL, "merged_ranking": _MERGED_SQL,
    "last_turns": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 4",
}

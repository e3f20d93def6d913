"""Graph, statistics and progress queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tabularium.functions import extract
from tabularium.functions.extract import article_refs, cross_refs, thresholds
from tabularium.functions.text import category, document_type, short_reference, slug, text_key, type_by_name
from tabularium.operators import graph
from tabularium.plans.latest import latest_rows
from tabularium.sources.tables import table
from tabularium.streaming import ingest


def _chunks(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "graph_chunk").select("id", "text", "doc_name", "page_num", "chunk_type", "doc_type", "article_ref", "section_title").dropDuplicates(["id"])


_CHUNKS_SQL = "(SELECT DISTINCT id, text, doc_name, page_num, chunk_type, doc_type, article_ref, section_title FROM graph_chunk)"


def same_page_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of chunks of one known page; page 0 stands for unknown and is no page."""
    return graph.same_page(_chunks(spark, root).where("page_num > 0"))


def same_page_links(spark: SparkSession, root: str) -> DataFrame:
    return graph.same_page_rows(_chunks(spark, root).where("page_num > 0")).select("id", "page_key", "n_links")


# The extractors' patterns for SQL: classes that know ASCII only are spelled out, and each sign that is no part of a word
# is doubled, so that two neighbouring words can each be found with the signs around them.
_S, _D, _W, _NW = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]", r"\p{Nd}", r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]", r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]"


def _sql_pattern(pattern: str) -> str:
    return pattern.replace(r"[\d\w]", _W).replace(r"\s", _S).replace(r"\d", _D).replace(r"\w", _W).replace("'", "''")


def _found_sql(pattern: str, group: int = 0, x: str = "text", flags: str = "(?im)") -> str:
    return f"regexp_extract_all({x}, '{flags}{_sql_pattern(pattern)}', {group})"


def _concept_sql(pattern: str, x: str) -> str:
    body = _sql_pattern(pattern.removeprefix(r"\b").removesuffix(r"\b")).replace("-", "--").replace(" ", "  ")  # as doubled
    return f"list_transform(regexp_extract_all({x}, '(?:^|{_NW})({body})(?:{_NW}|$)', 1), lambda v: replace(replace(v, '--', '-'), '  ', ' '))"


def _distinct_sql(x: str) -> str:
    return f"list_filter({x}, lambda v, k: list_position({x}, v) = k)"


def _entities_sql(kind: str = "code") -> str:
    """``e(id, ord, name, type)`` of all mentions, distinct in the order they are seen, at most 15 of a chunk."""
    parts = [_concept_sql(p, "twice") for p in extract.CONCEPTS[kind]]
    concepts = "list_concat(" * (len(parts) - 1) + parts[0] + "".join(f", {p})" for p in parts[1:])
    tag = lambda x, t: f"list_transform({x}, lambda v: {{'name': v, 'type': '{t}'}})"
    return f"""d0 AS (SELECT id, text, regexp_replace(text, '({_NW})', '\\1\\1', 'g') twice FROM {_CHUNKS_SQL} WHERE text IS NOT NULL),
d1 AS (SELECT id, {concepts} c0, {_found_sql(extract.ARTICLE_REF[kind])} r0, {_found_sql(extract.CROSS_REF, 1)} x1, {_found_sql(extract.CROSS_REF, 2)} x2, {_found_sql(extract.AMOUNT[kind])} a0, {_found_sql(extract.AMOUNT[kind], 1)} a1 FROM d0),
d2 AS (SELECT id, {_distinct_sql('c0')} c, ({_distinct_sql('r0')})[:10] r, list_transform(range(1, len(x1) + 1), lambda i: 'Art. ' || x1[i] || ' ' || x2[i]) x0, list_transform(range(1, least(len(a0), 5) + 1), lambda i: a1[i] || ' ' || a0[i]) a FROM d1),
d3 AS (SELECT id, list_concat(list_concat({tag('c', 'tax_concept')}, {tag('r', 'article_reference')}), list_concat({tag(f"list_transform(({_distinct_sql('x0')})[:15], lambda y: substr(y, 1, 100))", 'cross_reference')}, {tag('a', 'threshold')})) l FROM d2),
d4 AS (SELECT id, ({_distinct_sql('l')})[:15] l FROM d3), e AS (SELECT id, CAST(i - 1 AS INT) ord, l[i].name AS name, l[i].type AS type FROM (SELECT *, unnest(range(1, len(l) + 1)) i FROM d4))"""


def _named(spark: SparkSession, root: str) -> DataFrame:
    """All mentions whose entity has a name; others make no node."""
    return graph.mentions(_chunks(spark, root)).where("entity_name <> ''")


def graph_mentions(spark: SparkSession, root: str) -> DataFrame:
    return graph.mentions(_chunks(spark, root))


def graph_entities(spark: SparkSession, root: str) -> DataFrame:
    return graph.entity_nodes(graph.mentions(_chunks(spark, root)))


def graph_concepts(spark: SparkSession, root: str) -> DataFrame:
    """Concept nodes with the number of chunks that mention them."""
    return graph.entity_nodes(_named(spark, root).where("type = 'tax_concept'"))


def graph_expand(spark: SparkSession, root: str) -> DataFrame:
    chunks = _chunks(spark, root)
    return graph.expand(_named(spark, root), chunks, ["RETENUE", "taux"], 200).select("id", "doc_name", "page_num", "score")


_EXPAND_SQL = f"""WITH {_entities_sql()}, m AS (SELECT DISTINCT id FROM e WHERE name <> '' AND (contains(lower(name), 'retenue') OR contains(lower(name), 'taux')))
SELECT id, doc_name, page_num, 1.0::DOUBLE AS score FROM {_CHUNKS_SQL} SEMI JOIN m USING (id) ORDER BY doc_name, page_num, id LIMIT 200"""


def extract_thresholds(spark: SparkSession, root: str) -> DataFrame:
    """Percentages and amounts of each chunk, with value and wording, in order."""
    rows = _chunks(spark, root).select("id", F.posexplode(thresholds(F.col("text"))).alias("pos", "t"))
    return rows.select("id", "pos", F.col("t.value").alias("value"), F.col("t.full_text").alias("full_text"))


_THRESHOLDS_SQL = f"""
WITH x AS (SELECT id, {_found_sql(extract.AMOUNT["code"])}[:20] m, {_found_sql(extract.AMOUNT["code"], 1)}[:20] v FROM {_CHUNKS_SQL})
SELECT id, CAST(i - 1 AS INT) AS pos, v[i] AS value, m[i] AS full_text FROM (SELECT *, unnest(range(1, len(m) + 1)) i FROM x)
"""


def threshold_context(spark: SparkSession, root: str) -> DataFrame:
    rows = _chunks(spark, root).select("id", F.posexplode(thresholds(F.col("text"))).alias("pos", "t"))
    return rows.select("id", "pos", F.col("t.context").alias("context"))


_CONTEXT_SQL = f"""
WITH s AS (SELECT id, text, string_split(regexp_replace(text, '(?im){_sql_pattern(extract.AMOUNT["code"])}', chr(1) || '\\0' || chr(2), 'g'), chr(1)) s FROM {_CHUNKS_SQL} WHERE text IS NOT NULL),
p AS (SELECT *, unnest(range(2, least(len(s), 21) + 1)) i FROM s), o AS (SELECT id, text, i, list_sum(list_transform(s[:i - 1], lambda v: length(replace(v, chr(2), '')))) o, length(split_part(s[i], chr(2), 1)) n FROM p)
SELECT id, CAST(i - 2 AS INT) AS pos, regexp_replace(substr(text, CAST(greatest(o - 50, 0) + 1 AS BIGINT), CAST(o + n + 50 - greatest(o - 50, 0) AS BIGINT)), '^{_S}+|{_S}+$', '', 'g') AS context FROM o
"""


def extract_refs(spark: SparkSession, root: str) -> DataFrame:
    """Distinct references to articles of each chunk, by the patterns of codes and of conventions."""
    rows = _chunks(spark, root)
    both = [rows.select("id", F.lit(k).alias("kind"), F.array_join(F.array_sort(article_refs(F.col("text"), k)), ",").alias("refs")) for k in ("code", "convention")]
    return both[0].unionAll(both[1]).where("refs <> ''")


_REFS_SQL = " UNION ALL ".join(
    f"SELECT id, '{k}' AS kind, array_to_string(list_sort(({_distinct_sql('a')})[:10]), ',') AS refs FROM (SELECT id, {_found_sql(extract.ARTICLE_REF[k], 0 if k == 'code' else 1)} a FROM {_CHUNKS_SQL}) WHERE len(a) > 0 AND list_aggregate(({_distinct_sql('a')})[:10], 'string_agg', ',') <> ''"
    for k in ("code", "convention")
)


def extract_cross_refs(spark: SparkSession, root: str) -> DataFrame:
    return _chunks(spark, root).select("id", F.explode(cross_refs(F.col("text"))).alias("ref"))


_CROSS_SQL = f"""
WITH a AS (SELECT id, {_found_sql(extract.CROSS_REF, 1)} x1, {_found_sql(extract.CROSS_REF, 2)} x2 FROM {_CHUNKS_SQL}), b AS (SELECT id, list_transform(range(1, len(x1) + 1), lambda i: 'Art. ' || x1[i] || ' ' || x2[i]) x FROM a)
SELECT id, unnest(({_distinct_sql('x')})[:15]) AS ref FROM b
"""


def kb_stats(spark: SparkSession, root: str) -> DataFrame:
    """Figures of the graph and of the index side by side: one row from each."""
    graph_side = graph.knowledge_stats(table(spark, root, "graph_chunk"))
    entities = _named(spark, root).agg(F.count_distinct("entity_name").alias("total_entities"))
    relations = rel_counts(spark, root).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_relations"))
    index = table(spark, root, "index_chunk").agg(F.count(F.lit(1)).alias("index_chunks"))
    return graph_side.crossJoin(entities).crossJoin(relations).crossJoin(index)  # one row each


_STATS_SQL = f"""
WITH {_entities_sql()}
SELECT count(*) AS total_chunks, count(*) FILTER (contains(doc_name, 'loi') OR contains(doc_name, 'finances')) AS lois, count(*) FILTER (contains(doc_name, 'note')) AS notes,
count(*) FILTER (contains(doc_name, 'code') OR contains(doc_name, 'recueil')) AS codes, count(*) FILTER (contains(doc_name, 'convention')) AS conventions,
count(*) FILTER (chunk_type = 'text') AS text_chunks, count(*) FILTER (starts_with(chunk_type, 'table')) AS table_chunks, count(gnn_embedding) > 0 AS gnn_active,
(SELECT count(DISTINCT name) FROM e WHERE name <> '') AS total_entities,
(SELECT count(DISTINCT (name, id)) FROM e WHERE name <> '') + (SELECT count(*) FROM {_CHUNKS_SQL} a JOIN {_CHUNKS_SQL} b USING (doc_name, page_num) WHERE a.id < b.id AND page_num > 0) AS total_relations,
(SELECT count(*) FROM index_chunk) AS index_chunks FROM graph_chunk
"""


def label_counts(spark: SparkSession, root: str) -> DataFrame:
    """Nodes by label with a running total, most first: the labels are few."""
    nodes = _chunks(spark, root).select(F.lit("Chunk").alias("label")).unionAll(_named(spark, root).select("entity_name").distinct().select(F.lit("Entity")))
    counts = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("running", F.sum("n").over(Window.orderBy(F.desc("n"), "label").rowsBetween(Window.unboundedPreceding, 0)))


_LABELS_SQL = f"""
WITH {_entities_sql()}, c AS (SELECT 'Chunk' AS label, count(*) AS n FROM {_CHUNKS_SQL} UNION ALL SELECT 'Entity', count(DISTINCT name) FROM e WHERE name <> '')
SELECT label, n, CAST(sum(n) OVER (ORDER BY n DESC, label ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM c
"""


def property_hits(spark: SparkSession, root: str) -> DataFrame:
    """How many chunks hold a word in each of their text fields, in lower case; what a diagnosis of the graph asks."""
    rows, fields = _chunks(spark, root), ("text", "article_ref", "section_title", "doc_name")
    counts = rows.agg(*[F.count_if(F.lower(f).contains(w)).alias(f"{f}_{i}") for f in fields for i, w in enumerate(PROBES)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(w).alias("word"), F.col(f"{f}_{i}").alias("n")) for f in fields for i, w in enumerate(PROBES)])).alias("r")).select("r.*")


#: Words of the diagnosis (fixed values).
PROBES = ("tva", "retenue", "article", "impot", "taxe")
_HITS_SQL = " UNION ALL ".join(f"SELECT '{f}' AS field, '{w}' AS word, count(*) FILTER (contains(lower({f}), '{w}')) AS n FROM {_CHUNKS_SQL}" for f in ("text", "article_ref", "section_title", "doc_name") for w in PROBES)


def null_audit(spark: SparkSession, root: str) -> DataFrame:
    return graph.null_audit(table(spark, root, "graph_chunk"), ["text", "article_ref", "section_title"])


_AUDIT_SQL = " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER ({c} IS NULL) AS n_null, count(*) FILTER ({c} = '') AS n_empty, count(*) FILTER ({c} <> '') AS n_filled FROM graph_chunk" for c in ("text", "article_ref", "section_title"))


def rel_counts(spark: SparkSession, root: str) -> DataFrame:
    """Edges by relation: mentions of all entities and same-page pairs, most first."""
    m = _named(spark, root).select("entity_name", "chunk_id").distinct()
    both = m.select(F.lit("MENTIONED_IN").alias("rel")).unionAll(same_page_pairs(spark, root).select(F.lit("SAME_PAGE")))
    return both.groupBy("rel").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"))


_PAIRS_SQL = f"SELECT a.id AS src, b.id AS dst FROM {_CHUNKS_SQL} a JOIN {_CHUNKS_SQL} b USING (doc_name, page_num) WHERE a.id < b.id AND page_num > 0"


def doc_type_pivot(spark: SparkSession, root: str) -> DataFrame:
    kinds = ["text", "table_markdown", "table_prose"]
    return table(spark, root, "graph_chunk").groupBy("doc_name").pivot("chunk_type", kinds).agg(F.count(F.lit(1))).na.fill(0)


_PIVOT_SQL = "SELECT doc_name, " + ", ".join(f"count(*) FILTER (chunk_type = '{k}') AS {k}" for k in ("text", "table_markdown", "table_prose")) + " FROM graph_chunk GROUP BY doc_name"


def progress_summary(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "progress").agg(F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum(F.when(F.col("status") == "done", F.col("chunks"))).alias("chunks"))


def progress_state(spark: SparkSession, root: str) -> DataFrame:
    """The status of each file after all its attempts: the latest counts, errors are cut at 300 characters.

    Of attempts of one minute a finished one counts before a failed and a failed before an open one, then the larger count.
    """
    return ingest.latest_status(table(spark, root, "progress"))


_STATE_SQL = """
SELECT filename, status, CASE WHEN status = 'done' THEN chunks END AS chunks, CASE WHEN status = 'failed' THEN substr(error, 1, 300) END AS error, timestamp_text, CASE WHEN status = 'done' THEN output END AS output FROM progress
QUALIFY row_number() OVER (PARTITION BY filename ORDER BY timestamp_text DESC NULLS LAST, CASE status WHEN 'done' THEN 2 WHEN 'failed' THEN 1 ELSE 0 END DESC, chunks DESC NULLS LAST, error DESC NULLS LAST, output DESC NULLS LAST) = 1
"""


def run_counters(spark: SparkSession, root: str) -> DataFrame:
    """What a run would do with the files of the index: skip the finished, take the rest; and what it left before."""
    files = table(spark, root, "index_chunk").where("filename IS NOT NULL").select("filename").distinct()
    return ingest.run_counters(files, ingest.latest_status(table(spark, root, "progress")))


_COUNTERS_SQL = f"""
WITH s AS ({_STATE_SQL}), f AS (SELECT DISTINCT filename FROM index_chunk WHERE filename IS NOT NULL)
SELECT count(*) FILTER (status = 'done') AS skipped, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status IS DISTINCT FROM 'done') AS todo, CAST(coalesce(sum(chunks) FILTER (status = 'done'), 0) AS BIGINT) AS indexed FROM f LEFT JOIN s USING (filename)
"""


def resume_anti(spark: SparkSession, root: str) -> DataFrame:
    """Files that still have to be processed: those without a finished attempt that left an output."""
    files = table(spark, root, "index_chunk").select("filename").distinct()
    done = table(spark, root, "progress").where("status = 'done' AND output IS NOT NULL").select("filename").distinct()
    return files.join(done, "filename", "left_anti")


def upsert_last(spark: SparkSession, root: str) -> DataFrame:
    """The index after all deliveries: the latest row of each chunk."""
    rows = latest_rows(table(spark, root, "index_chunk"), ["chunk_id"], [F.col("indexed_at")], "row_no")
    return rows.select("row_no", "chunk_id", "filename", "document_type")


def dedup_hash(spark: SparkSession, root: str) -> DataFrame:
    """Texts once, by hash of the trimmed text: the least id stands for each."""
    return table(spark, root, "documents").where("text IS NOT NULL").groupBy(text_key(F.col("text")).alias("text_hash")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies"))


_DEDUP_SQL = r"""
SELECT substr(sha256(regexp_replace(text, '^[\s\x0B\x{85}\p{Z}]+|[\s\x0B\x{85}\p{Z}]+$', '', 'g')), 1, 16) AS text_hash, min(doc_id) AS doc_id, count(*) AS n_copies FROM documents WHERE text IS NOT NULL GROUP BY 1
"""


def classify_docs(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "index_chunk")
    return rows.select("row_no", document_type(F.col("filename"), F.col("content")).alias("detected"), type_by_name(F.col("filename")).alias("by_name"), category(F.col("filename")).alias("category"))


_CLASSIFY_SQL = """
WITH x AS (SELECT row_no, lower(filename) f, coalesce(lower(substr(content, 1, 600)), '') s FROM index_chunk)
SELECT row_no, CASE WHEN contains(f, 'loi') THEN 'loi' WHEN contains(f, 'note') OR contains(f, 'commune') OR contains(f, 'مذكرة') THEN 'note_commune'
WHEN contains(s, 'loi de finances') OR contains(s, 'article premier') THEN 'loi' WHEN contains(s, 'note commune') OR contains(s, 'objet :') OR contains(s, 'مذكرة') OR contains(s, 'قانون') THEN 'note_commune' ELSE 'loi' END AS detected,
CASE WHEN contains(f, 'code') THEN 'code' WHEN contains(f, 'convention') THEN 'convention' WHEN contains(f, 'note') THEN 'note' ELSE 'loi' END AS by_name,
CASE WHEN contains(f, 'note') THEN 'note' WHEN contains(f, 'code') OR contains(f, 'recueil') THEN 'code' WHEN contains(f, 'convention') THEN 'convention' ELSE 'loi' END AS category FROM x
"""


def source_references(spark: SparkSession, root: str) -> DataFrame:
    """Short reference and slug of every retrieved source."""
    rows = table(spark, root, "legal_source")
    return rows.select("row_no", short_reference(F.col("doc_name"), F.col("year"), F.col("page_num"), F.col("article_ref")).alias("short_ref"), slug(F.regexp_replace("doc_name", r"\.pdf$", "")).alias("doc_slug"))


_REFERENCES_SQL = r"""
SELECT row_no, concat_ws(' — ', doc_name, CASE WHEN year > 0 THEN year::VARCHAR END, 'p.' || page_num, nullif(trim(article_ref), '')) AS short_ref, regexp_replace(regexp_replace(doc_name, '\.pdf$', ''), '[^\p{L}\p{M}\p{Nd}_\p{Pc}]', '_', 'g') AS doc_slug FROM legal_source
"""

QUERIES = {f.__name__: f for f in (same_page_pairs, same_page_links, graph_mentions, graph_entities, graph_concepts, graph_expand, extract_thresholds, threshold_context, extract_refs, extract_cross_refs, kb_stats, label_counts, property_hits, null_audit, rel_counts, doc_type_pivot, progress_summary, progress_state, run_counters, resume_anti, upsert_last, dedup_hash, classify_docs, source_references)}
ORACLES = {
    "same_page_pairs": _PAIRS_SQL,
    "same_page_links": f"SELECT id, concat_ws('#', doc_name, page_num::VARCHAR) AS page_key, count(*) OVER (PARTITION BY doc_name, page_num) - 1 AS n_links FROM {_CHUNKS_SQL} WHERE page_num > 0",
    "graph_mentions": f"WITH {_entities_sql()} SELECT name AS entity_name, type, id AS chunk_id, ord FROM e",
    "graph_entities": f"WITH {_entities_sql()} SELECT name, arg_min(type, (id, ord)) AS type, count(DISTINCT id) AS n_chunks FROM e GROUP BY name",
    "graph_concepts": f"WITH {_entities_sql()} SELECT name, 'tax_concept' AS type, count(DISTINCT id) AS n_chunks FROM e WHERE type = 'tax_concept' AND name <> '' GROUP BY name",
    "graph_expand": _EXPAND_SQL, "extract_thresholds": _THRESHOLDS_SQL, "threshold_context": _CONTEXT_SQL, "extract_refs": _REFS_SQL, "extract_cross_refs": _CROSS_SQL,
    "kb_stats": _STATS_SQL, "label_counts": _LABELS_SQL, "property_hits": _HITS_SQL, "null_audit": _AUDIT_SQL, "progress_state": _STATE_SQL, "run_counters": _COUNTERS_SQL,
    "rel_counts": f"WITH {_entities_sql()} SELECT 'MENTIONED_IN' AS rel, count(DISTINCT (name, id)) AS n FROM e WHERE name <> '' UNION ALL SELECT 'SAME_PAGE', count(*) FROM ({_PAIRS_SQL})",
    "doc_type_pivot": _PIVOT_SQL,
    "progress_summary": "SELECT count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed, CAST(sum(chunks) FILTER (status = 'done') AS BIGINT) AS chunks FROM progress",
    "resume_anti": "SELECT DISTINCT filename FROM index_chunk WHERE filename NOT IN (SELECT filename FROM progress WHERE status = 'done' AND output IS NOT NULL)",
    "upsert_last": "SELECT row_no, chunk_id, filename, document_type FROM index_chunk QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC NULLS LAST, row_no DESC) = 1",
    "dedup_hash": _DEDUP_SQL, "classify_docs": _CLASSIFY_SQL, "source_references": _REFERENCES_SQL,
}

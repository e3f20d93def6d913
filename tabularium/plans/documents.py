"""Segmentation, tables and context queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabularium.functions.segment import cut_before, packed_paragraphs
from tabularium.functions.text import table_prose, type_by_name
from tabularium.operators import chunkers, report, running, tables
from tabularium.plans.latest import latest_rows
from tabularium.sources.tables import table

HEAD = r"(?m)^Art\. [0-9]+"


def article_split(spark: SparkSession, root: str) -> DataFrame:
    """Segments of each content at its article headings, with their place and length."""
    rows = table(spark, root, "index_chunk").where("content IS NOT NULL").select("row_no", F.posexplode(cut_before(F.col("content"), HEAD)).alias("pos", "segment"))
    return rows.select("row_no", "pos", F.md5("segment").alias("segment_md5"))


_SPLIT_SQL = """
WITH s AS (SELECT row_no, string_split(regexp_replace(content, '(?m)^Art\\. [0-9]+', chr(1) || '\\0', 'g'), chr(1)) s FROM index_chunk WHERE content IS NOT NULL)
SELECT row_no, CAST(i - 1 AS INT) AS pos, md5(s[i]) AS segment_md5 FROM (SELECT *, unnest(range(1, len(s) + 1)) i FROM s)
"""


def packed_articles(spark: SparkSession, root: str) -> DataFrame:
    """Contents packed into groups of at most 800 characters, by numbered paragraphs or sentences."""
    rows = table(spark, root, "index_chunk").where("content IS NOT NULL")
    return rows.select("row_no", F.posexplode(packed_paragraphs(F.col("content"), 800)).alias("sub_index", "text"))


def packed_round_trip(spark: SparkSession, root: str) -> DataFrame:
    """The groups of each content put together again, white space aside; of several parts none above the size is made."""
    rows = packed_articles(spark, root).groupBy("row_no").agg(F.array_sort(F.collect_list(F.struct("sub_index", "text"))).alias("p"))
    return rows.select("row_no", F.md5(F.regexp_replace(F.array_join(F.transform("p", lambda x: x["text"]), ""), f"{_S}+", "")).alias("squeezed_md5"))


def carry_forward(spark: SparkSession, root: str) -> DataFrame:
    """The section title that was last seen in the file's delivery order."""
    rows = table(spark, root, "index_chunk").select("row_no", "filename", "section_title")
    return running.carried(rows, "filename", "row_no", "section_title", "carried_title").drop("section_title")


def offset_to_page(spark: SparkSession, root: str) -> DataFrame:
    """Character range of each chunk in its file when joined by empty lines."""
    rows = table(spark, root, "index_chunk").select("row_no", "filename", "page_number", F.coalesce(F.length("content"), F.lit(0)).alias("n"))
    rows = running.running_sum(rows, "filename", "row_no", F.col("n") + 2, "hi")
    return rows.select("row_no", "page_number", (F.col("hi") - F.col("n") - 2).alias("lo"), "hi")


#: White space, figures and signs of words as Unicode has them, for SQL whose classes know ASCII only.
_S, _D, _W = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]", r"\p{Nd}", r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]"


def _wide(pattern: str) -> str:
    """A pattern of the chunkers for SQL: the same flags, classes spelled out."""
    flags, body = re.match(r"\(\?([a-zA-Z]+)\)(.*)", pattern, re.S).groups()
    kept = "".join(f for f in flags if f in "ims")
    body = body.replace(r"[\d\w]", _W).replace(r"\s", _S).replace(r"\d", _D).replace(r"\w", _W)
    return (f"(?{kept})" if kept else "") + body.replace("'", "''")


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"


def asof_article(spark: SparkSession, root: str) -> DataFrame:
    """For each extracted table the article of the last text at most nine pages before it in its document."""
    t = table(spark, root, "raw_tables").where("doc_name IS NOT NULL AND page_num IS NOT NULL").select("doc_name", "page_num", F.col("row_no").alias("row"))
    named = chunkers.articles_of_pages(_page_rows(spark, root))
    return chunkers.nearest_article(t, named).select(F.col("row").alias("row_no"), "article_ref")


_NAMED_SQL = f"""a AS (SELECT filename doc_name, page_number page_num, arg_max(ref, row_no) ref FROM (SELECT *, rtrim({_strip_sql(f"regexp_extract(content, '{_wide(chunkers.LEGAL_ARTICLE)}')")}, '-:—–( ') ref FROM index_chunk)
WHERE ref <> '' AND page_number IS NOT NULL GROUP BY ALL)"""
_ASOF_SQL = f"""
WITH {_NAMED_SQL}, t AS (SELECT row_no, doc_name, page_num FROM raw_tables WHERE doc_name IS NOT NULL AND page_num IS NOT NULL)
SELECT row_no, coalesce(arg_max(a.ref, a.page_num), '') AS article_ref FROM t LEFT JOIN a ON a.doc_name = t.doc_name AND a.page_num BETWEEN t.page_num - 9 AND t.page_num GROUP BY row_no
"""


def table_islands(spark: SparkSession, root: str) -> DataFrame:
    rows = tables.text_tables(table(spark, root, "index_chunk"), "row_no", "content")
    return rows.select("row_no", "first_line", "n_lines", F.md5("content").alias("content_md5"))


_ISLANDS_SQL = r"""
WITH l AS (SELECT row_no, unnest(string_split(content, chr(10))) line, generate_subscripts(string_split(content, chr(10)), 1) - 1 i FROM index_chunk WHERE content IS NOT NULL),
m AS (SELECT *, len(regexp_extract_all(line, '\|')) + len(regexp_extract_all(line, '\t')) + len(regexp_extract_all(line, ' {3,}')) >= 2 t FROM l),
g AS (SELECT *, sum(CASE WHEN t THEN 0 ELSE 1 END) OVER (PARTITION BY row_no ORDER BY i) g FROM m)
SELECT row_no, CAST(min(i) AS INT) AS first_line, CAST(count(*) AS INT) AS n_lines, md5(string_agg(line, chr(10) ORDER BY i)) AS content_md5 FROM g WHERE t GROUP BY row_no, g HAVING count(*) >= 3
"""


def table_prose_rows(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "raw_tables").where("raw_data IS NOT NULL")
    heads = F.coalesce("headers", F.array().cast("array<string>"))
    grid = F.filter("raw_data", lambda r: r.isNotNull())
    return rows.select("row_no", F.md5(table_prose(grid, heads)).alias("prose_md5"))


_PROSE_SQL = """
WITH t AS (SELECT row_no, coalesce(headers, []) h, list_filter(raw_data, lambda r: r IS NOT NULL) d FROM raw_tables WHERE raw_data IS NOT NULL),
x AS (SELECT row_no, list_filter(list_transform(d, lambda r: array_to_string(list_filter(list_transform(r, lambda c, i: CASE WHEN trim(coalesce(c, '')) <> '' THEN coalesce(nullif(trim(h[i]), ''), 'Colonne ' || i) || ': ' || trim(c) || '.' END), lambda v: v IS NOT NULL), ' ')), lambda l: l <> '') l FROM t)
SELECT row_no, md5(array_to_string(l, chr(10))) AS prose_md5 FROM x
"""


def _current_tables(spark: SparkSession, root: str) -> DataFrame:
    return latest_rows(table(spark, root, "raw_tables"), ["doc_name", "page_num", "table_index"], [F.col("extracted_at")], "row_no")


def table_chunk_rows(spark: SparkSession, root: str) -> DataFrame:
    """Markdown chunks of all current tables, with the text to embed: the prose where there is one."""
    rows = tables.prose_of_markdown(tables.table_chunks(_current_tables(spark, root)))
    return rows.select("doc_name", "page_num", "table_index", "chunk_type", F.md5("text").alias("text_md5"), F.md5("embed_text").alias("embed_md5"))


_CELL_SQL = f"trim(regexp_replace(coalesce(c, ''), '{_S}+', ' ', 'g'))"
_ROW_SQL = f"'| ' || array_to_string(list_transform(range(1, w + 1), lambda i: coalesce(list_transform(r, lambda c: {_CELL_SQL})[i], '')), ' | ') || ' |'"
_CURRENT_SQL = """t AS (SELECT doc_name, page_num, table_index, coalesce(method, '') method, substr(coalesce(context_before, ''), 1, 200) context, coalesce(headers, []) h, list_transform(coalesce(raw_data, []), lambda r: coalesce(r, [])) d
FROM raw_tables QUALIFY row_number() OVER (PARTITION BY doc_name, page_num, table_index ORDER BY extracted_at DESC NULLS LAST, row_no DESC) = 1)"""
_MARKDOWN_SQL = f"""w AS (SELECT *, greatest(coalesce(list_max(list_transform(d, lambda r: len(r))), 0), len(h), 1) w FROM t),
m AS (SELECT *, CASE WHEN len(d) > 0 THEN array_to_string(list_concat([{_ROW_SQL.replace('(r,', '(CASE WHEN len(h) > 0 THEN h ELSE d[1] END,')}, '| ' || array_to_string(list_transform(range(1, w + 1), lambda i: '---'), ' | ') || ' |'],
list_transform(CASE WHEN len(h) > 0 THEN d ELSE d[2:] END, lambda r: {_ROW_SQL})), chr(10)) ELSE '' END md,
array_to_string(list_filter(list_transform(d, lambda r: array_to_string(list_filter(list_transform(r, lambda c, i: CASE WHEN trim(coalesce(c, '')) <> '' THEN coalesce(nullif(trim(h[i]), ''), 'Colonne ' || i) || ': ' || trim(c) || '.' END), lambda v: v IS NOT NULL), ' ')), lambda l: l <> ''), chr(10)) pr FROM w),
x AS (SELECT doc_name, page_num, table_index, '[TABLE – page ' || coalesce(page_num::VARCHAR, '') || ', extracted via ' || method || ']' || chr(10) || 'Context avant: ' || context || chr(10) || chr(10) || md AS md_text, '[TABLE NARRATIVE – page ' || coalesce(page_num::VARCHAR, '') || ']' || chr(10) || pr AS pr_text, md, pr FROM m)"""
_TABLE_CHUNK_SQL = f"WITH {_CURRENT_SQL}, {_MARKDOWN_SQL} SELECT doc_name, page_num, table_index, 'table_markdown' AS chunk_type, md5(md_text) AS text_md5, md5(CASE WHEN pr <> '' THEN pr_text ELSE md_text END) AS embed_md5 FROM x WHERE md <> ''"


def table_passthrough(spark: SparkSession, root: str) -> DataFrame:
    """Text chunks of all documents and the chunks of all tables, of which each names the last article before it."""
    rows = chunkers.with_table_chunks(chunkers.graph_chunks(_pages(spark, root)), tables.table_chunks(_current_tables(spark, root)), _page_rows(spark, root))
    return rows.where("doc_kind = 'table'").select("doc_name", "page_num", "table_index", "chunk_type", "article_ref", F.md5("text").alias("text_md5"))


_PASS_SQL = f"""
WITH {_CURRENT_SQL}, {_MARKDOWN_SQL}, {_NAMED_SQL}, c AS (SELECT doc_name, page_num, table_index, 'table_markdown' AS chunk_type, md5(md_text) AS text_md5 FROM x WHERE md <> '' UNION ALL SELECT doc_name, page_num, table_index, 'table_prose', md5(pr_text) FROM x WHERE pr <> '')
SELECT c.doc_name, c.page_num, table_index, chunk_type, coalesce(arg_max(a.ref, a.page_num), '') AS article_ref, text_md5 FROM c LEFT JOIN a ON a.doc_name = c.doc_name AND a.page_num BETWEEN c.page_num - 9 AND c.page_num GROUP BY ALL
"""


def _boxes(spark: SparkSession, root: str) -> DataFrame:
    """Word boxes laid out from order lines."""
    li = table(spark, root, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity").distinct()
    return li.select(
        F.col("l_orderkey").alias("page"), F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int")).alias("text"), ((F.col("l_partkey") * 37) % 600).cast("int").alias("left"),
        ((F.col("l_linenumber") * 9) + F.col("l_suppkey") % 5).cast("int").alias("top"), (F.col("l_quantity") + 10).cast("int").alias("width"), F.lit(14).alias("height"), (F.col("l_suppkey") % 101).cast("int").alias("conf"),
    )


def ocr_rows_cols(spark: SparkSession, root: str) -> DataFrame:
    """Word boxes clustered into lines and columns."""
    return tables.word_columns(tables.word_rows(_boxes(spark, root), ["page"]), ["page"]).select("page", "text", "line_no", "column_no")


def ocr_tables(spark: SparkSession, root: str) -> DataFrame:
    """Runs of at least two recognised lines with two or more columns, with their bounds on the page."""
    return tables.row_islands(tables.word_rows(_boxes(spark, root), ["page"]), ["page"], 620, 80, least=2)


_OCR_SQL = """
WITH b AS (SELECT DISTINCT l_orderkey page, concat_ws('-', l_partkey, l_suppkey, l_linenumber, l_quantity::INT) AS text, (l_partkey * 37) % 600 l, l_linenumber * 9 + l_suppkey % 5 t, (l_quantity + 10)::INT w, l_suppkey % 101 conf FROM lineitem),
k AS (SELECT * FROM b WHERE conf > 40), c AS (SELECT *, lag(t + 7.0) OVER (PARTITION BY page ORDER BY t, l, text) c FROM k),
r AS (SELECT *, sum(CASE WHEN c IS NULL OR c < t OR c > t + 14 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY t, l, text ROWS UNBOUNDED PRECEDING) line_no FROM c),
e AS (SELECT *, lag(l + w) OVER (PARTITION BY page, line_no ORDER BY l, text) e FROM r)
SELECT page, text, CAST(line_no AS BIGINT) AS line_no, CAST(sum(CASE WHEN e IS NULL OR l - e > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY page, line_no ORDER BY l, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS column_no FROM e
"""


_OCR_TABLES_SQL = _OCR_SQL[: _OCR_SQL.index("e AS (")] + """o AS (SELECT *, lag(l) OVER (PARTITION BY page, line_no ORDER BY l, text) p FROM r),
n AS (SELECT page, line_no, sum(CASE WHEN l - p > 20 THEN 1 ELSE 0 END) + 1 cols, min(l) x0, min(t) y0, max(l + w) x1, max(t + 14) y1 FROM o GROUP BY ALL),
g AS (SELECT *, sum(CASE WHEN cols < 2 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY line_no ROWS UNBOUNDED PRECEDING) g FROM n)
SELECT page, CAST(min(line_no) AS BIGINT) AS first_line, count(*) AS n_lines, CAST(greatest(min(x0) - 5, 0) AS INT) AS x0, CAST(greatest(min(y0) - 5, 0) AS INT) AS y0, CAST(least(max(x1) + 5, 620) AS INT) AS x1, CAST(least(max(y1) + 5, 80) AS INT) AS y1 FROM g WHERE cols >= 2 GROUP BY page, g HAVING count(*) >= 2
"""


def chat_context(spark: SparkSession, root: str) -> DataFrame:
    """Context of each request: the first ten distinct texts of its retrievers' answers, numbered, cut at 600 characters."""
    rows = table(spark, root, "legal_source").where("text IS NOT NULL").select("row_no", "request_no", "doc_name", "year", "page_num", "article_ref", "text")
    kept = report.distinct_texts(rows, ["request_no"], "text", [F.col("row_no")], 10)
    return report.context_of(kept, "request_no", "text", "place", 600).select("request_no", F.md5("context").alias("context_md5"))


_CONTEXT_SQL = r"""
WITH s AS (SELECT *, regexp_replace(text, '^[\s\x0B\x{85}\p{Z}]+|[\s\x0B\x{85}\p{Z}]+$', '', 'g') k FROM legal_source WHERE text IS NOT NULL),
f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY request_no, k ORDER BY row_no) = 1), p AS (SELECT *, row_number() OVER (PARTITION BY request_no ORDER BY row_no) place FROM f),
e AS (SELECT request_no, place, '[' || place || '] ' || concat_ws(' — ', doc_name, CASE WHEN year > 0 THEN year::VARCHAR END, 'p.' || page_num, nullif(trim(article_ref), '')) || chr(10) || CASE WHEN length(text) > 600 THEN substr(text, 1, 600) || '…' ELSE text END t FROM p WHERE place <= 10)
SELECT request_no, md5(string_agg(t, chr(10) || chr(10) ORDER BY place)) AS context_md5 FROM e GROUP BY request_no
"""


def _page_rows(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "index_chunk").where("content IS NOT NULL AND filename IS NOT NULL").select(F.col("filename").alias("doc_name"), F.col("page_number").alias("page_num"), F.col("row_no").alias("ord"), F.col("content").alias("text"))


def _pages(spark: SparkSession, root: str) -> DataFrame:
    return chunkers.joined_pages(_page_rows(spark, root))


def law_index_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Documents chunked by their type: articles of laws, sections of notes."""
    docs = _pages(spark, root).select(F.col("doc_name").alias("document_id"), F.col("doc_name").alias("filename"), "text")
    return chunkers.index_chunks(docs)


def law_index_whole(spark: SparkSession, root: str) -> DataFrame:
    """The chunks of laws that are no parts of a larger article: whole documents, preambles and articles."""
    rows = law_index_chunks(spark, root).where("document_type = 'loi' AND chunk_type <> 'article_part'")
    return rows.select("chunk_id", "chunk_type", "article_number", F.md5("content").alias("content_md5"))


_LAW_SQL = f"""
WITH j AS (SELECT filename id, string_agg(content, chr(10) || chr(10) ORDER BY page_number NULLS FIRST, row_no) AS text FROM index_chunk WHERE content IS NOT NULL AND filename IS NOT NULL GROUP BY 1),
d AS (SELECT id, text, lower(id) f, lower(substr(text, 1, 600)) h FROM j),
t AS (SELECT id, text FROM d WHERE CASE WHEN contains(f, 'loi') THEN true WHEN contains(f, 'note') OR contains(f, 'commune') OR contains(f, 'مذكرة') THEN false WHEN contains(h, 'loi de finances') OR contains(h, 'article premier') THEN true ELSE NOT (contains(h, 'note commune') OR contains(h, 'objet :') OR contains(h, 'مذكرة') OR contains(h, 'قانون')) END),
s AS (SELECT id, text, string_split(regexp_replace(text, '{_wide(chunkers.ARTICLE.removesuffix(chr(92) + 'b'))}(?:[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]|$)', chr(1) || '\\0', 'g'), chr(1)) s FROM t),
u AS (SELECT id, i, len(s) n, {_strip_sql('s[i]')} x FROM (SELECT *, unnest(range(1, len(s) + 1)) i FROM s)),
a AS (SELECT *, {_strip_sql(f"regexp_extract(x, '{_wide(chunkers.ARTICLE.removesuffix(chr(92) + 'b'))}', 2)")} k FROM u)
SELECT id || '_full' AS chunk_id, 'full_document' AS chunk_type, NULL::VARCHAR AS article_number, md5(x) AS content_md5 FROM a WHERE n = 1
UNION ALL SELECT id || '_preamble', 'preamble', NULL, md5(x) FROM a WHERE n > 1 AND i = 1 AND length(x) > 50
UNION ALL SELECT id || '_art_' || k, 'article', k, md5(x) FROM a WHERE i > 1 AND length(x) <= 2000
"""


def _units(rows: DataFrame) -> DataFrame:
    return rows.select("doc_name", "ord", "start", F.coalesce("page_num", F.lit(-1)).alias("page_num"), F.md5("raw").alias("unit_md5"))


def legal_units(spark: SparkSession, root: str) -> DataFrame:
    """Every document cut at its article headings: place, page and text of each unit; the units make up the whole text."""
    return _units(chunkers.placed_units(_pages(spark, root), chunkers._cut_units(chunkers.LEGAL_ARTICLE)))


def note_units(spark: SparkSession, root: str) -> DataFrame:
    """The same at the numbered sections of notes."""
    return _units(chunkers.placed_units(_pages(spark, root), chunkers._cut_units(chunkers.NOTE_SECTION)))


def code_units(spark: SparkSession, root: str) -> DataFrame:
    """The same at the chapters, sections and articles of codes."""
    return _units(chunkers.placed_units(_pages(spark, root), chunkers.code_units("code")))


def _units_sql(*patterns: str, columns: str = "a.st AS start, CAST(coalesce(k.page, -1) AS INT) AS page_num, md5(a.raw) AS unit_md5", where: str = "true") -> str:
    cut = "text"
    for p in patterns:  # a heading of one level is none of another, so the levels can be marked one after the other
        cut = f"regexp_replace({cut}, '{_wide(p)}', chr(1) || '\\0', 'g')"
    return f"""
WITH p AS (SELECT filename doc, page_number page, row_no, content c, coalesce(sum(length(content) + 2) OVER (PARTITION BY filename ORDER BY page_number NULLS FIRST, row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) lo FROM index_chunk WHERE content IS NOT NULL AND filename IS NOT NULL),
t AS (SELECT doc, string_agg(c, chr(10) || chr(10) ORDER BY page NULLS FIRST, row_no) text FROM p GROUP BY doc), s AS (SELECT doc, string_split({cut}, chr(1)) s FROM t),
u AS (SELECT doc, i - 1 ord, s[i] raw FROM (SELECT *, unnest(range(1, len(s) + 1)) i FROM s)), o AS (SELECT *, coalesce(sum(length(raw)) OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT st FROM u),
a AS (SELECT *, st + length(raw) - length(regexp_replace(raw, '^{_S}+', '')) pos FROM o)
SELECT a.doc AS doc_name, CAST(a.ord AS INT) AS ord, {columns} FROM a ASOF LEFT JOIN (SELECT * FROM p WHERE page IS NOT NULL) k ON a.doc = k.doc AND a.pos >= k.lo WHERE {where}
"""


def _by_name(spark: SparkSession, root: str, kind: str) -> DataFrame:
    return _pages(spark, root).where(type_by_name(F.col("doc_name")) == kind)


def graph_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Every document by the chunker that its name and text ask for."""
    return chunkers.graph_chunks(_pages(spark, root))


def chunker_routes(spark: SparkSession, root: str) -> DataFrame:
    """Which chunker each document goes to."""
    return _pages(spark, root).select("doc_name", chunkers.chunker_of(F.col("doc_name"), F.col("text")).alias("doc_kind"))


def _score_sql(words: list[str]) -> str:
    return "(" + " + ".join(f"contains(lower(text), lower('{w}'))::INT" for w in words) + ")"


_ROUTES_SQL = f"""
WITH t AS (SELECT filename doc_name, string_agg(content, chr(10) || chr(10) ORDER BY page_number NULLS FIRST, row_no) AS text FROM index_chunk WHERE content IS NOT NULL AND filename IS NOT NULL GROUP BY 1)
SELECT doc_name, CASE WHEN contains(lower(doc_name), 'code') THEN 'code' WHEN contains(lower(doc_name), 'convention') THEN 'convention'
WHEN {_score_sql(chunkers.LAW_WORDS)} >= 2 THEN CASE WHEN regexp_matches(text, '{_wide(chunkers.LEGAL_ARTICLE)}') THEN 'loi' ELSE 'generic' END
WHEN {_score_sql(chunkers.NOTE_WORDS)} >= 2 AND regexp_matches(text, '{_wide(chunkers.NOTE_SECTION)}') THEN 'note' ELSE 'generic' END AS doc_kind FROM t
"""


def legal_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Articles of the files that are neither codes, conventions nor notes by name."""
    return chunkers.legal_article_chunks(_by_name(spark, root, "loi"))


def note_chunks(spark: SparkSession, root: str) -> DataFrame:
    return chunkers.note_section_chunks(_by_name(spark, root, "note"))


def legal_refs(spark: SparkSession, root: str) -> DataFrame:
    """Article and page of every unit that ``legal_chunks`` makes chunks of."""
    return legal_chunks(spark, root).where("sub_index = 0").select("doc_name", "ord", "article_ref", F.coalesce("page_num", F.lit(-1)).alias("page_num"))


def note_refs(spark: SparkSession, root: str) -> DataFrame:
    """Section, page and subject of every unit that ``note_chunks`` makes chunks of."""
    return note_chunks(spark, root).where("sub_index = 0").select("doc_name", "ord", "article_ref", F.coalesce("page_num", F.lit(-1)).alias("page_num"))


def _refs_sql(pattern: str, kind: str, first: str, lead: str, rim: str, least: int) -> str:
    ref = f"CASE WHEN a.ord = 0 THEN '{first}' ELSE '{lead}' || rtrim({_strip_sql(f"regexp_extract({_strip_sql('a.raw')}, '{_wide(pattern)}')")}, '{rim}') END"
    by_name = "CASE WHEN contains(lower(a.doc), 'code') THEN 'code' WHEN contains(lower(a.doc), 'convention') THEN 'convention' WHEN contains(lower(a.doc), 'note') THEN 'note' ELSE 'loi' END"
    return _units_sql(pattern, columns=f"{ref} AS article_ref, CAST(coalesce(k.page, -1) AS INT) AS page_num", where=f"{by_name} = '{kind}' AND (a.ord > 0 OR length({_strip_sql('a.raw')}) > {least})")


def code_chunks(spark: SparkSession, root: str) -> DataFrame:
    return chunkers.code_chunks(_by_name(spark, root, "code"))


def convention_chunks(spark: SparkSession, root: str) -> DataFrame:
    return chunkers.code_chunks(_by_name(spark, root, "convention"), "convention")


QUERIES = {f.__name__: f for f in (article_split, packed_articles, packed_round_trip, carry_forward, offset_to_page, asof_article, table_islands, table_prose_rows, table_chunk_rows, table_passthrough, ocr_rows_cols, ocr_tables, chat_context, law_index_chunks, law_index_whole, legal_units, note_units, code_units, chunker_routes, graph_chunks, legal_chunks, note_chunks, legal_refs, note_refs, code_chunks, convention_chunks)}
ORACLES = {
    "packed_round_trip": f"SELECT row_no, md5(regexp_replace(content, '{_S}+', '', 'g')) AS squeezed_md5 FROM index_chunk WHERE content IS NOT NULL", "law_index_whole": _LAW_SQL,
    "article_split": _SPLIT_SQL, "asof_article": _ASOF_SQL, "table_islands": _ISLANDS_SQL, "table_prose_rows": _PROSE_SQL, "table_chunk_rows": _TABLE_CHUNK_SQL, "table_passthrough": _PASS_SQL, "ocr_rows_cols": _OCR_SQL, "ocr_tables": _OCR_TABLES_SQL, "chat_context": _CONTEXT_SQL,
    "legal_refs": _refs_sql(chunkers.LEGAL_ARTICLE, "loi", "Préambule", "", "-:—–( ", 50), "note_refs": _refs_sql(chunkers.NOTE_SECTION, "note", "En-tête / Résumé", "Section ", ".-–—) ", 30),
    "legal_units": _units_sql(chunkers.LEGAL_ARTICLE), "note_units": _units_sql(chunkers.NOTE_SECTION), "code_units": _units_sql(*chunkers.HEADINGS["code"]), "chunker_routes": _ROUTES_SQL,
    "carry_forward": "SELECT row_no, filename, last_value(section_title IGNORE NULLS) OVER (PARTITION BY filename ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS carried_title FROM index_chunk",
    "offset_to_page": "SELECT row_no, page_number, CAST(hi - n - 2 AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM (SELECT row_no, page_number, coalesce(length(content), 0) n, sum(coalesce(length(content), 0) + 2) OVER (PARTITION BY filename ORDER BY row_no) hi FROM index_chunk)",
}

"""Problem 3: lines repeated across the documents of one source.

Lines are normalised and hashed, distinct documents are counted per (source, hash), and hashes above an absolute and a
relative threshold are joined back to the lines of every document, which is rebuilt without them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabularium.plans.staging import staged
from tabularium.sources.tables import table

#: White space as the tables mean it: ASCII controls, the separators of Unicode and NEL.
BLANKS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"


def normal_line(line: Column) -> Column:
    """Lower-cased, without the digits 0-9, each run of white space one blank, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", ""), BLANKS, " "))


def _letters(line: Column) -> Column:
    return F.length(F.regexp_replace(line, r"\P{L}+", ""))


def numbered_lines(df: DataFrame, text: str, keep: list[str], min_letters: int) -> DataFrame:
    """``keep`` columns, ``line_no`` from 1 and the hash of each normal line of at least ``min_letters`` letters.

    Lines with fewer letters can be no case and go before anything is shuffled. A null text has no lines.
    """
    lines = df.select(*keep, F.posexplode(F.split(text, "\n", -1)).alias("_at", "_line")).where(F.length("_line") >= min_letters)
    lines = lines.withColumn("_norm", normal_line(F.col("_line"))).where(_letters(F.col("_norm")) >= min_letters)
    return lines.select(*keep, (F.col("_at") + 1).alias("line_no"), F.xxhash64("_norm").alias("line_hash"))


def repeated_lines(df: DataFrame, source: str, document: str, text: str, row: str, min_letters: int = 15, min_documents: int = 6, min_share: float = 0.05) -> DataFrame:
    """``(source, row, line_no)`` of every line to take out of every row of ``df``.

    A line is one if it stands, in any row, in at least ``min_documents`` distinct documents of its source and in at
    least ``min_share`` of them. Rows with a null source belong to no source and give none; a null document counts for
    none. Lines are normalised once and staged as hashes. Distinct counting shuffles (source, hash, document) after a
    map-side distinct, so neither a hot source nor a hot line meets in one task; the join back leaves skewed keys to the
    adaptive planner, whose other side has one row per key.
    """
    at = df.where(F.col(source).isNotNull())
    lines = staged(numbered_lines(at, text, [source, document, row], min_letters), "lines")
    counts = lines.where(F.col(document).isNotNull()).select(source, "line_hash", document).distinct().groupBy(source, "line_hash").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_documents)
    sizes = at.where(F.col(document).isNotNull()).select(source, document).distinct().groupBy(source).agg(F.count(F.lit(1)).alias("n_all"))
    frequent = counts.join(sizes, source).where(F.col("n_docs") >= min_share * F.col("n_all")).select(source, "line_hash", "n_docs", "n_all")
    return lines.drop(document).join(frequent, [source, "line_hash"]).select(source, row, "line_no", "n_docs", "n_all")


def drop_repeated_lines(df: DataFrame, source: str, document: str, text: str, row: str, **limits) -> DataFrame:
    """``df`` with repeated lines gone from ``text`` and their number in ``n_removed``; other rows are untouched.

    A column ``n_removed`` of the input is replaced; a null text stays null.
    """
    out = repeated_lines(df, source, document, text, row, **limits).groupBy(row).agg(F.collect_set("line_no").alias("__out"))
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda line, i: ~F.array_contains("__out", i + 1)), "\n")
    joined = df.join(out, row, "left")
    columns = [F.when(F.col("__out").isNull(), F.col(text)).otherwise(kept).alias(text) if c == text else F.col(c) for c in df.columns if c != "n_removed"]
    return joined.select(*columns, F.coalesce(F.size("__out"), F.lit(0)).alias("n_removed"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    lines = repeated_lines(table(spark, root, "index_chunk").select("row_no", "chunk_id", "filename", "content"), "filename", "chunk_id", "content", "row_no")
    return lines.select("row_no", "line_no")


def p3_clean(spark: SparkSession, root: str) -> DataFrame:
    return drop_repeated_lines(table(spark, root, "index_chunk").select("row_no", "chunk_id", "filename", "content"), "filename", "chunk_id", "content", "row_no")


_LINES_SQL = r"""
WITH s AS (SELECT row_no, filename, chunk_id, unnest(string_split(content, chr(10))) line, generate_subscripts(string_split(content, chr(10)), 1) line_no FROM index_chunk WHERE filename IS NOT NULL),
n AS (SELECT *, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '', 'g'), '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+', ' ', 'g')) norm FROM s),
k AS (SELECT * FROM n WHERE length(regexp_replace(norm, '\P{L}+', '', 'g')) >= 15),
c AS (SELECT filename, norm FROM k JOIN (SELECT filename, count(DISTINCT chunk_id) n_all FROM index_chunk GROUP BY 1) USING (filename) GROUP BY filename, norm HAVING count(DISTINCT chunk_id) >= 6 AND count(DISTINCT chunk_id) >= 0.05 * any_value(n_all))
"""
QUERIES = {"p3_found": p3_found, "p3_clean": p3_clean}
ORACLES = {
    "p3_found": _LINES_SQL + "SELECT row_no, CAST(line_no AS INT) AS line_no FROM k JOIN c USING (filename, norm)",
    "p3_clean": _LINES_SQL + """, o AS (SELECT row_no, list(DISTINCT line_no) gone FROM k JOIN c USING (filename, norm) GROUP BY row_no)
SELECT i.row_no, chunk_id, filename, CASE WHEN gone IS NULL THEN content ELSE array_to_string(list_filter(string_split(content, chr(10)), lambda l, n: NOT list_contains(gone, n)), chr(10)) END AS content, coalesce(len(gone), 0)::INT AS n_removed
FROM index_chunk i LEFT JOIN o ON i.row_no = o.row_no""",
}

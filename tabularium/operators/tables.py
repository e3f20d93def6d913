"""Tables: text islands, word boxes of recognised pages, and tables as chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window

from tabularium.functions.text import table_markdown, table_prose


def table_like(line: Column) -> Column:
    """Whether pipes, tabs and runs of three blanks come to two or more."""
    return (F.regexp_count(line, F.lit(r"\|")) + F.regexp_count(line, F.lit("\t")) + F.regexp_count(line, F.lit(" {3,}"))) >= 2


def text_tables(docs: DataFrame, key: str, text: str, least: int = 3) -> DataFrame:
    """``(key, first_line, n_lines, content)`` of runs of at least ``least`` table-like lines. Lines count from 0.

    The fold stays within the row: islands of a text are arrays, and nothing is shuffled.
    """
    lines = F.split(F.col(text), "\n")
    start = F.struct(F.array().cast("array<struct<first:int,lines:array<string>>>").alias("done"), F.array().cast("array<string>").alias("now"), F.lit(0).alias("i"))

    def flush(s: Column) -> Column:
        island = F.struct((s["i"] - F.size(s["now"])).alias("first"), s["now"].alias("lines"))
        return F.when(F.size(s["now"]) >= least, F.array_append(s["done"], island)).otherwise(s["done"])

    def step(s: Column, x: Column) -> Column:
        grown = F.struct(s["done"].alias("done"), F.array_append(s["now"], x).alias("now"), (s["i"] + 1).alias("i"))
        closed = F.struct(flush(s).alias("done"), F.array().cast("array<string>").alias("now"), (s["i"] + 1).alias("i"))
        return F.when(table_like(x), grown).otherwise(closed)

    islands = F.aggregate(lines, start, step, flush)
    return docs.where(F.col(text).isNotNull()).select(key, F.explode(islands).alias("t")).select(key, F.col("t.first").alias("first_line"), F.size("t.lines").alias("n_lines"), F.array_join("t.lines", "\n").alias("content"))


def word_rows(words: DataFrame, page: list[str], least_conf: int = 40) -> DataFrame:
    """``words`` with ``line_no``: a word opens a line if the centre of the word above lies outside its height."""
    kept = words.where((F.col("conf") > least_conf) & (F.trim("text") != ""))
    w = Window.partitionBy(*page).orderBy("top", "left", "text")
    centre = F.lag(F.col("top") + F.col("height") / 2).over(w)
    opens = F.when(centre.isNull() | (centre < F.col("top")) | (centre > F.col("top") + F.col("height")), 1).otherwise(0)
    return kept.withColumn("_o", opens).withColumn("line_no", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_o")


def word_columns(lines: DataFrame, page: list[str], gap: int = 20) -> DataFrame:
    """With ``column_no``: a word opens a column if it begins more than ``gap`` right of the end of the word before."""
    w = Window.partitionBy(*page, "line_no").orderBy("left", "text")
    end = F.lag(F.col("left") + F.col("width")).over(w)
    opens = F.when(end.isNull() | (F.col("left") - end > gap), 1).otherwise(0)
    return lines.withColumn("_o", opens).withColumn("column_no", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_o")


def row_islands(lines: DataFrame, page: list[str], width: int, height: int, gap: int = 20, least: int = 3, pad: int = 5) -> DataFrame:
    """``(page, first_line, n_lines, x0, y0, x1, y1)`` of runs of at least ``least`` lines with two or more columns.

    ``lines`` is what ``word_rows`` gives. A word opens a column if it begins more than ``gap`` right of the word before.
    Bounds are padded and clipped to the page.
    """
    before = F.lag("left").over(Window.partitionBy(*page, "line_no").orderBy("left", "text"))
    opened = lines.withColumn("_o", F.when(F.col("left") - before > gap, 1).otherwise(0))
    rows = opened.groupBy(*page, "line_no").agg(
        (F.sum("_o") + 1).alias("_cols"), F.min("left").alias("_x0"), F.min("top").alias("_y0"), F.max(F.col("left") + F.col("width")).alias("_x1"), F.max(F.col("top") + F.col("height")).alias("_y1")
    )
    island = F.sum(F.when(F.col("_cols") < 2, 1).otherwise(0)).over(Window.partitionBy(*page).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    runs = rows.withColumn("_g", island).where("_cols >= 2").groupBy(*page, "_g").agg(
        F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("n_lines"), *[F.min(c).alias(c) for c in ("_x0", "_y0")], *[F.max(c).alias(c) for c in ("_x1", "_y1")]
    )
    clip = lambda c, most: F.least(F.col(c) + pad, F.lit(most))
    return runs.where(F.col("n_lines") >= least).select(*page, "first_line", "n_lines", F.greatest(F.col("_x0") - pad, F.lit(0)).alias("x0"), F.greatest(F.col("_y0") - pad, F.lit(0)).alias("y0"), clip("_x1", width).alias("x1"), clip("_y1", height).alias("y1"))


def anchored_rows(words: Column, reach: int = 12) -> Column:
    """Rows of an array of word boxes: a word joins while its top is within ``reach`` of the row's first word."""
    ordered = F.array_sort(F.transform(words, lambda x: F.struct(x["top"].alias("top"), x["left"].alias("left"), x["text"].alias("text"))))
    kind = "struct<top:int,left:int,text:string>"
    start = F.struct(F.array().cast(f"array<array<{kind}>>").alias("done"), F.array().cast(f"array<{kind}>").alias("now"))
    near = lambda s, x: (F.size(s["now"]) > 0) & (F.abs(x["top"] - F.get(s["now"], F.lit(0))["top"]) <= reach)
    closed = lambda s: F.when(F.size(s["now"]) > 0, F.array_append(s["done"], s["now"])).otherwise(s["done"])
    step = lambda s, x: F.when(near(s, x), F.struct(s["done"].alias("done"), F.array_append(s["now"], x).alias("now"))).otherwise(F.struct(closed(s).alias("done"), F.array(x).alias("now")))
    return F.aggregate(ordered, start, step, closed)


def table_regions(boxes: DataFrame, page_width: str, page_height: str) -> DataFrame:
    """Boxes large enough for a table, padded by 5 and clipped to the page."""
    big = boxes.where((F.col("width") * F.col("height") > 20000) & (F.col("width") > 100) & (F.col("height") > 50))
    return big.select(
        "*", F.greatest(F.col("left") - 5, F.lit(0)).alias("x0"), F.greatest(F.col("top") - 5, F.lit(0)).alias("y0"),
        F.least(F.col("left") + F.col("width") + 5, F.col(page_width)).alias("x1"), F.least(F.col("top") + F.col("height") + 5, F.col(page_height)).alias("y1"),
    )


def column_of(x: Column, bounds: Column) -> Column:
    """Index of the interval ``start <= x < end`` of sorted bounds, else the last."""
    inside = F.array_position(F.transform(bounds, lambda b: (b["start"] <= x) & (x < b["end"])), True)
    return F.when(inside > 0, inside - 1).otherwise(F.size(bounds) - 1).cast("int")


def is_image_page(text: Column, area: Column, largest_image: Column | None = None) -> Column:
    """A page with hardly any text for its area; with ``largest_image`` also only if an image of some size is on it."""
    sparse = F.coalesce(F.length(text), F.lit(0)) / area < 0.002
    return sparse if largest_image is None else sparse & (F.coalesce(largest_image, F.lit(0)) > 5000)


def usable_tables(tables: DataFrame, least: int = 2) -> DataFrame:
    """Extracted tables of at least ``least`` rows, null cells empty; null rows count for none."""
    rows = F.transform(F.filter(F.coalesce("raw_data", F.array().cast("array<array<string>>")), lambda r: r.isNotNull()), lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit(""))))
    return tables.withColumn("raw_data", rows).where(F.size("raw_data") >= least)


def image_table_chunks(found: DataFrame) -> DataFrame:
    """Texts recognised in cropped tables (doc_name, page_num, table_index, text) as chunks under their head; empty ones go."""
    text = F.concat(F.lit("[TABLE IMAGE — page "), F.coalesce(F.col("page_num").cast("string"), F.lit("")), F.lit("]\n"), F.trim("text"))
    return found.where("trim(text) <> ''").select("doc_name", "page_num", "table_index", F.lit("table_image").alias("chunk_type"), text.alias("text"))


def table_chunks(tables: DataFrame) -> DataFrame:
    """Markdown and prose chunk of each table, in that order, under their heads; the markdown shows up to 200 characters of
    context. A table without rows has no markdown, one without a filled cell no prose. Null fields are shown empty.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    heads = F.coalesce("headers", F.array().cast("array<string>"))
    rows = F.transform(F.coalesce("raw_data", F.array().cast("array<array<string>>")), lambda r: F.coalesce(r, F.array().cast("array<string>")))
    markdown, prose = table_markdown(rows, heads), table_prose(rows, heads)
    led = F.concat(F.lit("[TABLE – page "), text("page_num"), F.lit(", extracted via "), text("method"), F.lit("]\nContext avant: "), F.substring(text("context_before"), 1, 200), F.lit("\n\n"), markdown)
    told = F.concat(F.lit("[TABLE NARRATIVE – page "), text("page_num"), F.lit("]\n"), prose)
    both = F.array(F.struct(F.lit("table_markdown").alias("chunk_type"), F.when(markdown != "", led).alias("text")), F.struct(F.lit("table_prose").alias("chunk_type"), F.when(prose != "", told).alias("text")))
    return tables.select("doc_name", "page_num", "table_index", F.posexplode(both).alias("ord", "c")).select("doc_name", "page_num", "table_index", "ord", "c.chunk_type", "c.text").where("text IS NOT NULL")


def prose_of_markdown(chunks: DataFrame) -> DataFrame:
    """Markdown chunks with the first prose of the same document, page and table, else their own text, to be embedded."""
    keys = ["doc_name", "page_num", "table_index"]
    prose = chunks.where("chunk_type = 'table_prose'").groupBy(*keys).agg(F.min_by("text", "ord").alias("prose"))
    return chunks.where("chunk_type = 'table_markdown'").join(prose, keys, "left").withColumn("embed_text", F.coalesce("prose", "text")).drop("prose")

"""Context windows, answer assembly and the parsing of generated sections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window

from tabularium.functions.text import short_reference, strip, text_key, truncated, word_runs, xml_escape

#: Section names and what marks them in a generated text (fixed values).
SECTIONS = {"FAITS": (1, "COMPRÉHENSION"), "ETENDUE": (2, "ÉTENDUE"), "SOMMAIRE_EXECUTIF": (3, "SOMMAIRE"), "ANALYSES": (4, "ANALYSES")}


def distinct_texts(df: DataFrame, group: list[str], text: str, order: list[Column], most: int) -> DataFrame:
    """First row of each text within its group, then the first ``most`` of the group."""
    first = F.row_number().over(Window.partitionBy(*group, "_key").orderBy(*order))
    kept = df.withColumn("_key", text_key(F.col(text))).withColumn("_f", first).where("_f = 1")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= most).drop("_key", "_f")


def context_of(df: DataFrame, group: str, text: str, place: str, most: int = 600) -> DataFrame:
    """``(group, context)``: numbered sources with their reference and up to ``most`` characters, in order of place."""
    ref = short_reference(F.col("doc_name"), F.col("year"), F.col("page_num"), F.col("article_ref"))
    entry = F.concat(F.lit("["), F.col(place).cast("string"), F.lit("] "), ref, F.lit("\n"), truncated(F.col(text), most))
    rows = df.select(group, F.struct(F.col(place).alias("p"), entry.alias("t")).alias("e"))
    return rows.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["t"]), "\n\n").alias("context"))


def last_turns(turns: DataFrame, conversation: str, turn: str, n: int = 4) -> DataFrame:
    return turns.withColumn("_r", F.row_number().over(Window.partitionBy(conversation).orderBy(F.desc(turn)))).where(F.col("_r") <= n).drop("_r")


#: Where a generated text lists its abbreviations, in the order they are tried (fixed values).
ABBREVIATIONS = (r"--- SECTION 5.*?ABRÉVIATIONS.*?:\s*(.*?)(?=---|\z)", r"5\.\s*DOCUMENTS.*?ABRÉVIATIONS.*?:\s*(.*?)(?=5\.|\z)", r"ABRÉVIATIONS\s*:\s*(.*?)(?=---|Sources|\z)")


def abbreviations(text: Column, least: int = 100) -> Column:
    """The first of the known forms whose text is longer than ``least`` characters, else an empty text."""
    found = [strip(F.regexp_extract(text, "(?isdU)" + p, 1)) for p in ABBREVIATIONS]
    return F.coalesce(*[F.when(F.length(x) > least, x) for x in found], F.lit(""))


def generated_sections(text: Column) -> Column:
    """Struct of the numbered sections of a generated text; a missing one is empty, and so are all of a null text."""
    body = lambda i, word: F.coalesce(strip(F.regexp_extract(text, rf"(?isdU)--- SECTION {i}.*?{word}.*?\n(.*?)--- SECTION {i + 1}", 1)), F.lit(""))
    return F.struct(*[body(i, w).alias(k) for k, (i, w) in SECTIONS.items()], abbreviations(text).alias("ABREVIATIONS"))


def formatted(template: str, values: dict[str, Column]) -> Column:
    """``{name}`` places of a prompt filled as they stand, all at once, so a value that holds such a place stays as it is.

    A null value is empty; a place without a value stays.
    """
    parts = re.split("(" + "|".join(re.escape("{" + n + "}") for n in values) + ")", template) if values else [template]
    return F.concat(*[F.coalesce(values[p[1:-1]].cast("string"), F.lit("")) if p[:1] == "{" and p[1:-1] in values else F.lit(p) for p in parts])


def chat_prompts(questions: DataFrame, contexts: DataFrame, history: DataFrame, key: str, template: str) -> DataFrame:
    """``(key, prompt)``: each question with its context and the turns kept of its conversation, oldest first.

    ``questions`` has ``(key, question)``, ``contexts`` ``(key, context)``, ``history`` ``(key, turn, role, text)``. A question
    without context or history has empty places.
    """
    said = history.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("history"))
    rows = questions.select(key, "question").join(contexts.select(key, "context"), key, "left").join(said, key, "left")
    return rows.select(key, formatted(template, {n: F.col(n) for n in ("question", "context", "history")}).alias("prompt"))


def filled_template(template: Column, values: dict[str, Column], markup: bool = False) -> Column:
    """``{{NAME}}`` tokens replaced by escaped values, or by word-processing runs."""
    for name, v in values.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), word_runs(v) if markup else xml_escape(v))
    return template

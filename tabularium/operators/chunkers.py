"""Structure-aware chunking: articles, sections, numbered paragraphs.

A document is one row. Boundaries become array segments, segments become rows, and what a segment inherits (chapter,
section, header line, page) is merged in by offset within the document, so a chunker reads its text once and shuffles
nothing after the pages of a document have met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window

from tabularium.functions.extract import article_key, concepts, cross_refs, article_refs, chapter_refs, legal_terms, section_refs, thresholds
from tabularium.functions.segment import cut_before, let, packed_by, packed_paragraphs, sentence_windows
from tabularium.functions.text import document_type, strip
from tabularium.plans.staging import staged

# Headings (fixed values).
ARTICLE = r"(?imdU)^(Art(?:icle)?\.?)\s*(\d+\s*(?:bis|ter)?|premier)\b"
SUBSECTION = r"(?mdU)^\s*(\d+\)|[A-Za-z]\)|[IVX]+\.)\s+"
MAJOR = r"(?mdU)^([IVX]+)\.\s+(.+)$"
MINOR = r"(?mdU)^\s{0,4}([A-Z])\.\s+(.+)$"
SUMMARY = r"(?isdU)RESUM[EÉ]\s*\n(.*?)(?=\n\s*[IVX]+\.|\z)"
LEGAL_ARTICLE = r"(?imdU)^(?:Art(?:icle)?\.?\s*(?:premier|première|\d+(?:\s*(?:bis|ter|quater|quinquies|sexies|septies|octies|novies|decies))?))\s*[-:—–(]"
NOTE_SECTION = r"(?mdU)^(?:(?:I{1,3}V?|VI{0,3})\s*[.)\-–—]|\d{1,2}\s*[.)\-–—])\s+"
HEADINGS = {
    "code": (
        r"(?imdU)^(?:CHAPITRE|CH\.?)\s+(?:PREMIER|I{1,3}V?|VI{0,3}|\d+)\s*[\-:—–]",
        r"(?imdU)^(?:SECTION|SEC\.?)\s+(?:\d+|I{1,3}V?|VI{0,3})\s*[\-:—–]",
        r"(?imdU)^(?:ARTICLE|ART\.?)\s+(?:PREMIER|PREMIER BIS|[\d\w]+(?:\s+bis|\s+ter|\s+quater)?)\s*[\-:—–]",
    ),
    "convention": (
        r"(?imdU)^(?:CHAPITRE|CH\.?)\s+(?:I{1,3}V?|VI{0,3}|\d+)\s*[\-:—–]",
        None,
        r"(?imdU)^(?:ARTICLE|ART\.?)\s+(\d+(?:\s+bis)?)\s*[\-:—–]",
    ),
}
MOST_ARTICLE, MOST_PART = 2000, 1800


def _first_line(x: Column) -> Column:
    return F.get(F.split(x, "\n"), F.lit(0))


def article_parts(text: Column) -> Column:
    """An oversized article: its sub-sections under the first line, else its paragraphs packed under it."""
    head = F.concat(_first_line(text), F.lit("\n\n"))
    subs = cut_before(text, SUBSECTION)
    led = F.transform(F.slice(subs, F.lit(2), F.size(subs)), lambda s: F.concat(head, strip(s)))
    paragraphs = F.split(text, "\n\n")
    start = F.struct(F.array().cast("array<string>").alias("done"), head.alias("now"))

    def step(s: Column, p: Column) -> Column:
        full = F.length(s["now"]) + F.length(p) > MOST_PART
        done = F.when(strip(s["now"]) != _first_line(text), F.array_append(s["done"], strip(s["now"]))).otherwise(s["done"])
        return F.when(full, F.struct(done.alias("done"), F.concat(head, p, F.lit("\n\n")).alias("now"))).otherwise(F.struct(s["done"].alias("done"), F.concat(s["now"], p, F.lit("\n\n")).alias("now")))

    rest = F.slice(paragraphs, F.lit(2), F.size(paragraphs))
    groups = F.aggregate(rest, start, step, lambda s: F.when(strip(s["now"]) != _first_line(text), F.array_append(s["done"], strip(s["now"]))).otherwise(s["done"]))
    out = F.when(F.size(subs) > 1, led).otherwise(groups)
    return F.when(F.size(out) > 0, out).otherwise(F.array(text))


def law_chunks(docs: DataFrame) -> DataFrame:
    """``docs`` (document_id, filename, document_type, text) by article; texts without one stay whole.

    A preamble above 50 characters is a chunk. Articles above 2,000 characters come in numbered parts. One pass: what a
    segment becomes is decided in its row.
    """
    keep = ["document_id", "filename", "document_type"]
    rows = docs.select(*keep, cut_before(F.col("text"), ARTICLE).alias("_s")).select(*keep, F.size("_s").alias("_all"), F.posexplode("_s").alias("_i", "_t"))
    rows = rows.withColumn("_t", strip(F.col("_t"))).withColumn("_n", strip(F.regexp_extract("_t", ARTICLE, 2)))
    none = F.lit(None).cast("string")
    chunk = lambda kind, key, content, number, part: F.struct(F.lit(kind).alias("chunk_type"), key.alias("_k"), content.alias("content"), number.alias("article_number"), part.cast("int").alias("part"))
    named = F.concat(F.lit("art_"), "_n")
    made = (
        F.when(F.col("_all") == 1, F.array(chunk("full_document", F.lit("full"), F.col("_t"), none, F.lit(None))))
        .when(F.col("_i") == 0, F.filter(F.array(chunk("preamble", F.lit("preamble"), F.col("_t"), none, F.lit(None))), lambda c: F.length(c["content"]) > 50))
        .when(F.length("_t") <= MOST_ARTICLE, F.array(chunk("article", named, F.col("_t"), F.col("_n"), F.lit(None))))
        .otherwise(F.transform(article_parts(F.col("_t")), lambda p, j: chunk("article_part", F.concat(named, F.lit("_p"), (j + 1).cast("string")), p, F.col("_n"), j + 1)))
    )
    out = rows.select(*keep, F.explode(made).alias("c")).select(*keep, "c.*")
    return out.select(F.concat_ws("_", "document_id", "_k").alias("chunk_id"), *keep, "chunk_type", "content", "article_number", "part")


def note_chunks(docs: DataFrame) -> DataFrame:
    """Notes: summary block, major sections, lettered sub-sections under their section's title; else the whole text.

    One pass: the chunks of a note are one array.
    """
    keep = ["document_id", "filename", "document_type"]
    none = F.lit(None).cast("string")

    def chunk(kind: str, key: Column, content: Column, number: Column = none, title: Column = none, letter: Column = none, below: Column = none) -> Column:
        return F.struct(F.lit(kind).alias("chunk_type"), key.alias("_k"), content.alias("content"), number.alias("section_number"), title.alias("section_title"), letter.alias("subsection_letter"), below.alias("subsection_title"))

    def minor(x: Column, u: Column) -> Column:
        letter = F.regexp_extract(u, MINOR, 1)
        return chunk("subsection", F.concat_ws("_", F.lit("sec"), x["n"], letter), F.concat(x["n"], F.lit(". "), x["h"], F.lit("\n\n"), strip(u)), x["n"], x["h"], letter, strip(F.regexp_extract(u, MINOR, 2)))

    def major(t: Column) -> Column:
        parts = F.struct(F.regexp_extract(t, MAJOR, 1).alias("n"), strip(F.regexp_extract(t, MAJOR, 2)).alias("h"), cut_before(t, MINOR).alias("m"))
        plain = lambda x: F.array(chunk("section", F.concat(F.lit("sec_"), x["n"]), strip(t), x["n"], x["h"]))
        return let(parts, lambda x: F.when(F.size(x["m"]) == 1, plain(x)).otherwise(F.transform(F.slice(x["m"], F.lit(2), F.size(x["m"])), lambda u: minor(x, u))))

    rows = docs.select(*keep, "text", cut_before(F.col("text"), MAJOR).alias("_s"), F.regexp_extract("text", SUMMARY, 0).alias("_r"))
    summary = F.filter(F.array(chunk("resume", F.lit("resume"), strip(F.col("_r")), F.lit("RESUME"), F.lit("Résumé"))), lambda c: F.col("_r") != "")
    sections = F.flatten(F.transform(F.slice("_s", F.lit(2), F.size("_s")), major))
    whole = F.filter(F.array(chunk("full_document", F.lit("full"), strip(F.col("text")))), lambda c: (F.size("_s") == 1) & (F.col("_r") == ""))
    out = rows.select(*keep, F.explode(F.concat(summary, sections, whole)).alias("c")).select(*keep, "c.*")
    return out.select(F.concat_ws("_", "document_id", "_k").alias("chunk_id"), *keep, "chunk_type", "content", "section_number", "section_title", "subsection_letter", "subsection_title")


def index_chunks(docs: DataFrame) -> DataFrame:
    """Documents (document_id, filename, text) by their detected type, as one schema. Null texts have no chunk.

    Documents are staged by type, so that each is read by its own chunker only.
    """
    typed = staged(docs.where("text IS NOT NULL").withColumn("document_type", document_type(F.col("filename"), F.col("text"))), "typed", ["document_type"])
    return law_chunks(typed.where("document_type = 'loi'")).unionByName(note_chunks(typed.where("document_type <> 'loi'")), allowMissingColumns=True)


def joined_pages(pages: DataFrame, doc: str = "doc_name", page: str = "page_num", text: str = "text", order: str = "ord") -> DataFrame:
    """``(doc, pages, text)``: texts of a document in order, joined by an empty line. A document is one row by design."""
    held = F.array_sort(F.collect_list(F.struct(F.col(page).alias("page"), F.col(order).alias("ord"), F.coalesce(F.col(text), F.lit("")).alias("text"))))
    rows = pages.groupBy(F.col(doc).alias("doc_name")).agg(held.alias("pages"))
    return rows.select("doc_name", "pages", F.array_join(F.transform("pages", lambda p: p["text"]), "\n\n").alias("text"))


def _title_before(text: Column) -> Column:
    """The last line of five that looks like a heading."""
    lines = F.transform(F.split(strip(text), "\n"), strip)
    tail = F.slice(lines, F.greatest(F.lit(1), F.size(lines) - 4), F.lit(5))
    good = F.filter(tail, lambda x: (F.length(x) > 20) & (F.length(x) < 250) & ~x.startswith("Art") & ~x.startswith("Page ") & F.substring(x, 1, 1).rlike(r"\p{Lu}"))
    return F.when(F.size(good) > 0, F.element_at(good, -1))


def placed_units(docs: DataFrame, units: Column) -> DataFrame:
    """``(doc_name, ord, start, page_num, page_end, before, <fields of the unit>)`` of the units of each document.

    ``docs`` is what ``joined_pages`` gives, ``units`` an array of structs whose ``raw`` parts make up ``text`` in order.
    Units and pages are exploded together, once, and merged by their offset in two sorts within the document, so the work
    grows with the text and not with its square. A unit stands on the last numbered page that begins at or before its
    first sign that is no white space; ``page_end`` is where that page's text ends, ``before`` the 300 signs in front.
    """
    u = F.transform(units, lambda x, i: F.struct(F.lit(1).alias("k"), i.alias("ord"), F.length(x["raw"]).alias("n"), F.lit(None).cast("int").alias("page"), x.alias("u")))
    kind = docs.select(units.alias("u")).schema["u"].dataType.elementType.simpleString()
    p = F.transform("pages", lambda x, i: F.struct(F.lit(0).alias("k"), i.alias("ord"), (F.length(x["text"]) + 2).alias("n"), x["page"].cast("int").alias("page"), F.lit(None).cast(kind).alias("u")))
    rows = docs.select("doc_name", F.explode(F.concat(u, p)).alias("x")).select("doc_name", "x.*")
    own = Window.partitionBy("doc_name", "k").orderBy("ord")
    rows = rows.withColumn("start", F.coalesce(F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint"))
    tail = F.right(F.col("u.raw"), F.lit(300))
    rows = rows.withColumn("tail", tail)
    for step in (1, 2, 4, 8, 16, 32):  # each doubles how many units the tail may reach over; a heading has five signs at least
        rows = rows.withColumn("tail", F.right(F.concat(F.coalesce(F.lag("tail", step).over(own), F.lit("")), F.coalesce("tail", F.lit(""))), F.lit(300)))
    rows = rows.withColumn("before", F.coalesce(F.lag("tail", 1).over(own), F.lit("")))
    at = F.col("start") + F.when(F.col("k") == 1, F.length("u.raw") - F.length(F.regexp_replace("u.raw", r"(?U)^\s+", ""))).otherwise(0)
    page = F.when((F.col("k") == 0) & F.col("page").isNotNull(), F.struct("page", (F.col("start") + F.col("n") - 2).alias("end")))
    merged = Window.partitionBy("doc_name").orderBy("at", "k", "ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("at", at).withColumn("p", F.last(page, True).over(merged)).where("k = 1")
    return rows.select("doc_name", "ord", "at", "start", F.col("p.page").alias("page_num"), F.col("p.end").alias("page_end"), "before", "u.*")


def _cut_units(pattern: str) -> Column:
    return F.transform(cut_before(F.col("text"), pattern), lambda x: F.struct(x.alias("raw")))


def legal_article_chunks(docs: DataFrame, most: int = 1500) -> DataFrame:
    """Laws as graph chunks: an article under the heading that was last seen before it, with its page.

    ``docs`` is what ``joined_pages`` gives. Large articles are packed by numbered paragraphs, what is still too large
    by sentences.
    """
    rows = placed_units(docs, _cut_units(LEGAL_ARTICLE))
    w = Window.partitionBy("doc_name").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_h", F.when(F.col("ord") > 0, _title_before(strip(F.col("before"))))).withColumn("section_title", F.coalesce(F.last("_h", True).over(w), F.lit(""))).withColumn("_t", strip(F.col("raw")))
    ref = F.when(F.col("ord") == 0, F.lit("Préambule")).otherwise(F.rtrim(strip(F.regexp_extract("_t", LEGAL_ARTICLE, 0)), F.lit("-:—–( ")))
    rows = rows.where((F.col("ord") > 0) | (F.length("_t") > 50)).withColumn("article_ref", ref).drop("raw", "before", "_h").repartition("doc_name", "ord")  # no document's articles stay in one task
    titled = F.when((F.col("section_title") != "") & (F.col("ord") > 0), F.concat(F.lit("["), "section_title", F.lit("]\n"), "_t")).otherwise(F.col("_t"))
    lead = F.concat(F.lit("["), F.when(F.col("section_title") != "", F.concat("section_title", F.lit(" — "), "article_ref")).otherwise(F.col("article_ref")), F.lit("]\n"))
    numbered = packed_by(F.col("_t"), most, r"(?U)(?=\n\s*\d{1,2}\)\s)")
    fitted = F.flatten(F.transform(numbered, lambda p: F.when(F.length(F.concat(lead, p)) <= most, F.array(F.concat(lead, p))).otherwise(sentence_windows(F.concat(lead, p)))))
    led = F.when(F.size(numbered) > 0, fitted).otherwise(F.transform(sentence_windows(F.col("_t")), lambda p: F.concat(lead, p)))
    parts = F.when((F.length("_t") <= most) | (F.col("ord") == 0), F.array(titled)).otherwise(led)
    return rows.select("doc_name", "page_num", "article_ref", "section_title", "ord", F.posexplode(parts).alias("sub_index", "text")).withColumn("chunk_type", F.lit("text"))


def note_section_chunks(docs: DataFrame, most: int = 1500) -> DataFrame:
    """Notes as graph chunks: the head with its subject, then numbered sections; large ones by sentences."""
    rows = placed_units(docs, _cut_units(NOTE_SECTION)).withColumn("_t", strip(F.col("raw")))
    rows = rows.where((F.col("ord") > 0) | (F.length("_t") > 30)).drop("raw", "before").repartition("doc_name", "ord")
    subject = F.substring(strip(F.regexp_extract("_t", r"(?iU)OBJET\s*:\s*(.+?)(?:\n|$)", 1)), 1, 200)
    ref = F.when(F.col("ord") == 0, F.lit("En-tête / Résumé")).otherwise(F.concat(F.lit("Section "), F.rtrim(strip(F.regexp_extract("_t", NOTE_SECTION, 0)), F.lit(".-–—) "))))
    parts = F.when((F.length("_t") <= most) | (F.col("ord") == 0), F.array("_t")).otherwise(sentence_windows(F.col("_t")))
    return rows.select("doc_name", "page_num", ref.alias("article_ref"), F.when(F.col("ord") == 0, subject).otherwise(F.lit("")).alias("section_title"), "ord", F.posexplode(parts).alias("sub_index", "text")).withColumn("chunk_type", F.lit("text"))


def generic_chunks(docs: DataFrame) -> DataFrame:
    """Documents of no known kind: every page by sentences; an empty page has no chunk."""
    pages = docs.select("doc_name", F.posexplode("pages").alias("ord", "p")).select("doc_name", F.col("p.page").cast("int").alias("page_num"), "ord", F.posexplode(sentence_windows(F.col("p.text"))).alias("sub_index", "text"))
    return pages.where("text <> ''").select("doc_name", "page_num", F.lit("").alias("article_ref"), F.lit("").alias("section_title"), "ord", "sub_index", "text", F.lit("text").alias("chunk_type"))


def code_units(kind: str) -> Column:
    """Chapters, sections and articles of ``text`` as one array of structs, nested cuts flattened in order."""
    chapter, section, article = HEADINGS[kind]
    cut = lambda x, pattern: F.array(x) if pattern is None else cut_before(x, pattern)
    title = lambda x, i, pattern: F.lit("") if pattern is None else F.when(i > 0, strip(F.rtrim(F.regexp_extract(x, pattern, 0), F.lit("-:—– ")))).otherwise(F.lit(""))
    unit = lambda ct, ci, st, si, a, ai: F.struct(
        ci.alias("_chapter_i"), si.alias("_section_i"), ai.alias("_article_i"), ct.alias("_chapter"), st["title"].alias("_section"), title(a, ai, article).alias("_article"), st["n"].alias("_section_n"), a.alias("raw")
    )
    # titles are taken once for a chapter and a section, not once for each of their articles
    below = lambda ct, ci, s, si: let(F.struct(title(s, si, section).alias("title"), F.length(strip(s)).alias("n")), lambda st: F.transform(cut(s, article), lambda a, ai: unit(ct, ci, st, si, a, ai)))
    per = lambda c, ci: let(title(c, ci, chapter), lambda ct: F.flatten(F.transform(cut(c, section), lambda s, si: below(ct, ci, s, si))))
    return F.flatten(F.transform(cut(F.col("text"), chapter), per))


def code_chunks(docs: DataFrame, kind: str = "code", most: int = 2000) -> DataFrame:
    """Codes (chapter, section, article) and conventions (chapter, article) with what is extracted from each article.

    Text before the first heading of a level is a unit without title: chapters always, sections above 30 and articles
    above 20 characters. Parts of a large article repeat the extracts of the whole article. The page is the first on
    which an article with the same fifty leading signs begins, 0 where those signs run over the end of a page.
    """
    section = HEADINGS[kind][1]
    rows = placed_units(docs, code_units(kind)).withColumn("_t", strip(F.col("raw")))
    least = (F.col("_section_i") > 0) | (F.col("_section_n") > 30) if section else F.lit(True)
    rows = rows.where((F.col("_t") != "") & least & ((F.col("_article_i") > 0) | (F.length("_t") > 20)))
    head = F.substring("_t", 1, 50)
    seen = F.when(F.col("at") + F.length("_head") <= F.col("page_end"), F.col("page_num"))
    rows = rows.withColumn("_head", head).drop("raw", "before").repartition("doc_name", "_head")  # no document's articles stay in one task
    rows = rows.withColumn("page_num", F.coalesce(F.first(seen, True).over(Window.partitionBy("doc_name", "_head").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0)))
    lead = F.concat(F.lit("["), "_chapter", F.lit("]\n"), F.concat(F.lit("["), "_section", F.lit("]\n")) if section else F.lit(""), "_article", F.lit("\n"))
    parts = F.when(F.length("_t") > most, packed_paragraphs(F.col("_t"), most)).otherwise(F.array("_t"))
    extracts = F.struct(concepts(F.col("_t"), kind).alias("tax_concepts"), article_refs(F.col("_t"), kind).alias("article_references"), section_refs(F.col("_t")).alias("section_references"), chapter_refs(F.col("_t")).alias("chapter_references"), legal_terms(F.col("_t"), kind).alias("legal_terms"))
    return rows.select(
        "doc_name", "page_num", F.lit("text").alias("chunk_type"), article_key(F.col("_article")).alias("article_ref"), F.col("_chapter").alias("chapter_ref"), F.col("_section").alias("section_ref"),
        extracts.alias("entities"), thresholds(F.col("_t"), kind).alias("thresholds"), cross_refs(F.col("_t")).alias("cross_references"),
        F.lit(kind).alias("doc_type"), "_chapter_i", "_section_i", "_article_i", "ord", lead.alias("_lead"), F.posexplode(parts).alias("sub_index", "_p"),
    ).withColumn("text", F.concat("_lead", "_p")).drop("_lead", "_p")


#: Words that tell a law from a note (fixed values).
LAW_WORDS = ["loi de finances", "décret-loi", "Art.", "Article premier", "Journal Officiel", "Dispositions"]
NOTE_WORDS = ["Note commune", "NOTE COMMUNE", "OBJET :", "RESUME", "Direction Générale des Impôts"]


def legal_document_kind(text: Column, law_words: list[str] = LAW_WORDS, note_words: list[str] = NOTE_WORDS) -> Column:
    """``loi`` or ``note`` by at least two indicator words, law first; else ``generic``. A null text is generic."""
    low = F.coalesce(F.lower(text), F.lit(""))
    score = lambda words: sum((low.contains(w.lower()).cast("int") for w in words), F.lit(0))
    return F.when(score(law_words) >= 2, "loi").when(score(note_words) >= 2, "note").otherwise("generic")


def chunker_of(name: Column, text: Column) -> Column:
    """Which chunker takes a document: codes and conventions by name, others by content; without headings generic."""
    low, kind = F.lower(name), legal_document_kind(text)
    found = F.when(kind == "loi", F.when(text.rlike(LEGAL_ARTICLE), "loi")).when(kind == "note", F.when(text.rlike(NOTE_SECTION), "note"))
    return F.when(low.contains("code"), "code").when(low.contains("convention"), "convention").otherwise(F.coalesce(found, F.lit("generic")))


GRAPH_COLUMNS = ["doc_name", "page_num", "chunk_type", "article_ref", "section_title", "ord", "sub_index", "text"]


def graph_chunks(docs: DataFrame) -> DataFrame:
    """Every document by the chunker that fits it, as one schema with ``doc_kind``; extracts where a chunker makes them.

    ``docs`` is what ``joined_pages`` gives. Documents are staged by their kind, so that each is read by its own chunker only.
    """
    typed = staged(docs.withColumn("doc_kind", chunker_of(F.col("doc_name"), F.col("text"))), "routed", ["doc_kind"])
    of = lambda kind: typed.where(F.col("doc_kind") == kind).drop("doc_kind")
    branches = [("loi", legal_article_chunks), ("note", note_section_chunks), ("generic", generic_chunks), ("code", lambda d: code_chunks(d, "code")), ("convention", lambda d: code_chunks(d, "convention"))]
    out = None
    for kind, build in branches:
        part = build(of(kind)).withColumn("doc_kind", F.lit(kind))
        part = part.withColumn("section_title", F.col("section_ref")) if "section_ref" in part.columns else part
        part = part.select(*GRAPH_COLUMNS, "doc_kind", *[c for c in ("chapter_ref", "section_ref", "entities", "thresholds", "cross_references") if c in part.columns])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def articles_of_pages(pages: DataFrame) -> DataFrame:
    """``(doc_name, page_num, ord, article_ref)``: of the texts of a page the last one that has an article, by its first."""
    ref = F.rtrim(strip(F.regexp_extract("text", LEGAL_ARTICLE, 0)), F.lit("-:—–( "))
    named = pages.select("doc_name", "page_num", "ord", ref.alias("article_ref")).where("article_ref <> '' AND page_num IS NOT NULL")
    return named.groupBy("doc_name", "page_num").agg(F.max_by("article_ref", "ord").alias("article_ref"), F.max("ord").alias("ord"))


def with_table_chunks(chunks: DataFrame, tables: DataFrame, pages: DataFrame) -> DataFrame:
    """Text chunks and the chunks of tables, which stay whole and get the last article up to nine pages back.

    ``tables`` is what ``tables.table_chunks`` gives; ``pages`` has ``(doc_name, page_num, ord, text)``, of which the
    first article of a page counts, as the last text of the page that has one. Tables without a page have no article.
    """
    keys = tables.where("page_num IS NOT NULL AND doc_name IS NOT NULL").select("doc_name", "page_num").distinct().withColumn("row", F.lit(0))
    known = nearest_article(keys, articles_of_pages(pages)).select("doc_name", "page_num", "article_ref")
    rows = tables.join(known, ["doc_name", "page_num"], "left")
    rows = rows.select("doc_name", "page_num", "chunk_type", F.coalesce("article_ref", F.lit("")).alias("article_ref"), F.lit("").alias("section_title"), F.col("table_index").cast("int").alias("ord"), F.lit(0).alias("sub_index"), "text", "table_index", F.lit("table").alias("doc_kind"))
    return chunks.unionByName(rows, allowMissingColumns=True)


def nearest_article(tables: DataFrame, articles: DataFrame, reach: int = 9) -> DataFrame:
    """``tables`` (doc_name, page_num, row) with ``article_ref`` of the last article at most ``reach`` pages back, else ''.

    An as-of join without a range join: articles and tables are interleaved by page, and the last article is carried
    forward. Documents are the partitions, so one huge document is cut into page blocks of ``64`` with ``reach`` pages
    of overlap.
    """
    block = 64
    a = articles.select("doc_name", "page_num", F.col("ord").cast("bigint").alias("o"), "article_ref").where("article_ref IS NOT NULL")
    a = a.withColumn("b", F.explode(F.array_distinct(F.array(F.floor(F.col("page_num") / block), F.floor((F.col("page_num") + reach) / block)))))
    t = tables.select("doc_name", "page_num", "row", F.floor(F.col("page_num") / block).alias("b"))
    both = a.select("doc_name", "b", "page_num", F.lit(0).alias("k"), "o", "article_ref", F.lit(None).cast("bigint").alias("row")).unionAll(t.select("doc_name", "b", "page_num", F.lit(1), F.lit(0).cast("bigint"), F.lit(None).cast("string"), F.col("row").cast("bigint")))
    w = Window.partitionBy("doc_name", "b").orderBy("page_num", "k", "o").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("k") == 0, F.struct("page_num", "article_ref")), True).over(w)
    return both.withColumn("l", last).where("k = 1").select("doc_name", "page_num", "row", F.when(F.col("page_num") - F.col("l.page_num") <= reach, F.col("l.article_ref")).otherwise(F.lit("")).alias("article_ref"))

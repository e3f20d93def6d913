"""Text functions as column expressions. None needs a Python worker."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

#: Words whose highlight is taken back (fixed values).
STOP_WORDS = "de la le à au que et ou un une du des en par pour avec sans sur dans entre selon lors via".split()


def _folding() -> tuple[str, str]:
    """Latin letters with accents and their bases, from the decompositions of Unicode."""
    accented, plain = [], []
    for point in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFD", chr(point)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(point):
            accented.append(chr(point))
            plain.append(base)
    return "".join(accented), "".join(plain)


_ACCENTED, _PLAIN = _folding()


def fold(x: Column) -> Column:
    """Lower case without accents; ligatures are spelled out."""
    marks = F.regexp_replace(F.translate(F.lower(x), _ACCENTED, _PLAIN), r"\p{M}+", "")
    return F.replace(F.replace(marks, F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae"))


def tokens(x: Column) -> Column:
    """Folded words: maximal runs of letters and digits. Null gives null."""
    return F.filter(F.split(fold(x), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def slug(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)[^\w]", "_")


def key_of(*parts) -> Column:
    """Parts joined by underscores."""
    return F.concat_ws("_", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def collapse(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\s+", " ")


def document_type(filename: Column, text: Column) -> Column:
    """Type by file name, else by the first 600 characters, else ``loi`` (fixed words)."""
    name, head = F.lower(filename), F.lower(F.substring(text, 1, 600))
    has = lambda col, *words: F.coalesce(F.greatest(*[col.contains(w) for w in words], F.lit(False)), F.lit(False))
    return (
        F.when(has(name, "loi"), "loi").when(has(name, "note", "commune", "مذكرة"), "note_commune")
        .when(has(head, "loi de finances", "article premier"), "loi").when(has(head, "note commune", "objet :", "مذكرة", "قانون"), "note_commune").otherwise("loi")
    )


def type_by_name(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.contains("code"), "code").when(low.contains("convention"), "convention").when(low.contains("note"), "note").otherwise("loi")


def category(name: Column) -> Column:
    """Another precedence than ``type_by_name``: a note about a code is a note."""
    low = F.lower(name)
    return F.when(low.contains("note"), "note").when(low.contains("code") | low.contains("recueil"), "code").when(low.contains("convention"), "convention").otherwise("loi")


def table_markdown(rows: Column, headers: Column, dedupe_header: bool = False) -> Column:
    """Header, rule and body lines; ragged rows are padded to the widest, cells are put on one line.

    Where ``headers`` repeats the first row, that row is kept in the body unless ``dedupe_header``.
    """
    cell = lambda c: F.trim(collapse(F.coalesce(c, F.lit(""))))
    width = F.greatest(F.array_max(F.transform(rows, lambda r: F.size(r))), F.size(headers), F.lit(1))
    pad = lambda r: F.slice(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width)), F.lit(1), width)
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    has_head = F.size(headers) > 0
    head = F.when(has_head, headers).otherwise(F.coalesce(F.get(rows, F.lit(0)), F.array().cast("array<string>")))
    start = F.when(has_head, F.lit(2 if dedupe_header else 1)).otherwise(F.lit(2))
    body = F.slice(rows, start, F.greatest(F.size(rows) - start + 1, F.lit(0)))
    out = F.concat(F.array(line(pad(head)), line(F.array_repeat(F.lit("---"), width))), F.transform(body, lambda r: line(pad(r))))
    return F.when(F.size(rows) > 0, F.array_join(out, "\n")).otherwise(F.lit(""))


def table_prose(rows: Column, headers: Column) -> Column:
    """``header: cell.`` for each filled cell, a line for each row that has one; unnamed columns are numbered."""
    named = lambda i: F.coalesce(F.nullif(F.trim(F.get(headers, i)), F.lit("")), F.concat(F.lit("Colonne "), (i + 1).cast("string")))
    parts = lambda r: F.filter(
        F.transform(r, lambda c, i: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(named(i), F.lit(": "), F.trim(c), F.lit(".")))), lambda x: x.isNotNull()
    )
    return F.array_join(F.filter(F.transform(rows, lambda r: F.array_join(parts(r), " ")), lambda x: x != ""), "\n")


def xml_escape(x: Column, apostrophe: bool = True) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")] + ([("'", "&apos;")] if apostrophe else [])
    for a, b in pairs:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def word_runs(x: Column) -> Column:
    """Lines of a text as runs of a word-processing document, breaks between them."""
    run = lambda t: F.concat(F.lit('<w:r><w:t xml:space="preserve">'), t, F.lit("</w:t></w:r>"))
    return F.array_join(F.transform(F.split(xml_escape(x), "\n"), run), "<w:r><w:br/></w:r>")


def light_markdown(x: Column) -> Column:
    """Bold, italic, code and line breaks as HTML."""
    x = xml_escape(x, apostrophe=False)
    for pattern, to in ((r"\*\*(.+?)\*\*", "<strong>$1</strong>"), (r"\*(.+?)\*", "<em>$1</em>"), (r"`(.+?)`", "<code>$1</code>"), (r"\n", "<br/>")):
        x = F.regexp_replace(x, pattern, to)
    return x


def text_key(x: Column) -> Column:
    """Sixteen hex digits that tell trimmed texts apart."""
    return F.substring(F.sha2(strip(x), 256), 1, 16)


def short_reference(doc: Column, year: Column, page: Column, article: Column) -> Column:
    return F.concat_ws(" — ", doc, F.when(year > 0, year.cast("string")), F.concat(F.lit("p."), page.cast("string")), F.nullif(F.trim(article), F.lit("")))


def title_of(*parts: Column) -> Column:
    """Filled parts joined, or a default."""
    return F.coalesce(F.nullif(F.concat_ws(" — ", *[F.nullif(F.trim(p), F.lit("")) for p in parts]), F.lit("")), F.lit("Sans titre"))


def label_of(key: Column, labels: dict[str, str]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in labels.items() for v in kv]), key), key) if labels else key


def stamp(at: Column) -> Column:
    """A time as run logs write it: to the minute."""
    return F.date_format(at, "yyyy-MM-dd HH:mm")


def duration(seconds: Column) -> Column:
    """``3m 05s`` for 185 seconds; a null or negative duration gives null."""
    whole = F.floor(seconds).cast("bigint")
    return F.when(whole >= 0, F.format_string("%dm %02ds", F.floor(whole / 60).cast("bigint"), whole % 60))


def truncated(x: Column, most: int, mark: str = "…") -> Column:
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit(mark))).otherwise(x)


def highlight(text: Column, terms: list[str], size: int = 200, fragments: int = 3, fallback: int = 300) -> Column:
    """Up to ``fragments`` pieces of about ``size`` characters with the terms in ``<em>``; the head of the text else.

    Matching ignores case; accents must agree. Stop words are not marked.
    """
    wanted = [t for t in terms if t and t.lower() not in STOP_WORDS]
    head = F.when(F.length(text) > fallback, F.concat(F.substring(text, 1, fallback), F.lit("…"))).otherwise(text)
    if not wanted:
        return head
    word = r"(?iU)\b(" + "|".join(_quoted(t) for t in wanted) + r")\b"
    pieces = F.regexp_extract_all(text, F.lit(r"(?s).{1,%d}(?=\s|$)" % size), F.lit(0))
    hits = F.slice(F.filter(pieces, lambda p: p.rlike(word)), 1, fragments)
    return F.when(F.size(hits) > 0, F.array_join(F.transform(hits, lambda p: F.regexp_replace(p, word, "<em>$1</em>")), " … ")).otherwise(head)


def unmark_stop_words(x: Column) -> Column:
    """Marks around stop words are taken back; the words come out in lower case."""
    word = "(?iU)<em>(" + "|".join(STOP_WORDS) + ")</em>"
    parts = F.split(F.regexp_replace(x, word, "\u0001$1\u0002"), "\u0001")
    low = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lower(F.substring_index(p, "\u0002", 1)), F.substring(p, F.locate("\u0002", p) + 1, F.length(p)))))
    return F.array_join(low, "")


def _quoted(term: str) -> str:
    return "".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in term)
